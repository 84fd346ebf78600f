"""Episodes of conversations: turn blocks, lexical valleys between them, size ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import token_estimate

WINDOW, MIN_BLOCKS, TOKEN_CEILING = 3, 2, 32_000
RESET = r"(?i)^\s*(?:/clear|/reset|/compact)\b"
WORD = r"\p{L}{2,}"
#: Digits that depths are compared to, so that the order of summing decides nothing.
DIGITS = 9


def turn_blocks(events: DataFrame) -> DataFrame:
    """Events with their ``block``: a user turn and what follows it; rows before the first user turn
    make the first block.  Columns: conversation_id, event_index, role, text."""
    order = W.partitionBy("conversation_id").orderBy("event_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    users = F.sum((F.col("role") == "user").cast("int")).over(order)
    leading = F.first((F.col("role") != "user").cast("int")).over(order)
    return events.withColumn("block", (users + leading - 1).cast("int"))


def boundary_depths(blocks: DataFrame, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """``depth`` of each boundary (before block ``at``): one less the cosine, weighted by the words'
    rarity among the conversation's blocks, of the words of up to ``WINDOW`` blocks on either side.

    A word of a block is sent to the boundaries it lies beside, so that sums by boundary and word give
    all products; no conversation is held in one place.  A side without words gives depth 1."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(*stopwords))
    counts = blocks.select("conversation_id", "block", F.explode(words).alias("word")).groupBy("conversation_id", "word", "block").agg(F.count("*").alias("n"))
    held = counts.withColumn("df", F.count("*").over(W.partitionBy("conversation_id", "word")))
    size = blocks.groupBy("conversation_id").agg(F.count("*").alias("blocks"))
    weighed = held.join(size, "conversation_id").withColumn("weight", F.pow(F.log(F.col("blocks") / (1 + F.col("df"))) + 1, F.lit(2)))
    before = F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda k: F.struct((F.col("block") + k).cast("int").alias("at"), F.lit(True).alias("left")))
    after = F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.struct((F.col("block") - k).cast("int").alias("at"), F.lit(False).alias("left")))
    beside = weighed.select("conversation_id", "word", "n", "weight", F.explode(F.concat(before, after)).alias("b")).where("b.at > 0 AND b.at < blocks")
    by_word = beside.groupBy("conversation_id", F.col("b.at").alias("at"), "word").agg(F.sum(F.when(F.col("b.left"), F.col("n")).otherwise(0)).alias("l"), F.sum(F.when(F.col("b.left"), 0).otherwise(F.col("n"))).alias("r"), F.first("weight").alias("weight"))
    product = lambda x, y: F.sum(F.col(x) * F.col(y) * F.col("weight"))
    sums = by_word.groupBy("conversation_id", "at").agg(product("l", "r").alias("lr"), product("l", "l").alias("ll"), product("r", "r").alias("rr"))
    every = blocks.where("block > 0").select("conversation_id", F.col("block").alias("at"))
    norm = F.sqrt("ll") * F.sqrt("rr")
    return every.join(sums, ["conversation_id", "at"], "left").select("conversation_id", "at", F.round(1 - F.coalesce(F.when(norm > 0, F.col("lr") / norm), F.lit(0.0)), DIGITS).alias("depth"))


def spaced(places: Column, least: int = MIN_BLOCKS) -> Column:
    """Of sorted places, from 0 on, each that lies at least so far behind the last one taken."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("taken"))
    take = lambda s, p: F.when(p - s["last"] >= least, F.struct(p.alias("last"), F.concat(s["taken"], F.array(p)).alias("taken"))).otherwise(s)
    return F.aggregate(places, start, take)["taken"]


def valleys(depths: DataFrame) -> DataFrame:
    """Per conversation, ``valleys``: the boundaries deeper than the upper median of all by more than the
    upper median deviation, spaced apart.  A conversation's boundaries make one short array of numbers."""
    middle = lambda a: F.element_at(F.sort_array(a), F.floor(F.size(a) / 2).cast("int") + 1)
    listed = depths.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("at", "depth"))).alias("all"))
    median = listed.withColumn("median", middle(F.transform("all", lambda x: x["depth"])))
    spread = median.withColumn("spread", middle(F.transform("all", lambda x: F.round(F.abs(x["depth"] - F.col("median")), DIGITS))))
    deep = F.filter("all", lambda x: x["depth"] > F.round(F.col("median") + F.col("spread"), DIGITS))
    return spread.select("conversation_id", spaced(F.transform(deep, lambda x: x["at"])).alias("valleys"))


def episodes(blocks: DataFrame, stopwords: frozenset[str] = frozenset()) -> DataFrame:
    """Blocks of conversations with their ``episode`` number, from the users' texts (conversation_id,
    block, text): a new one begins at each valley and where the user resets the session."""
    blocks = blocks.withColumn("text", F.coalesce("text", F.lit("")))
    cuts = valleys(boundary_depths(blocks, stopwords)).select("conversation_id", F.explode("valleys").alias("block"))
    resets = blocks.where(F.col("text").rlike(RESET) & (F.col("block") > 0)).select("conversation_id", "block")
    marks = cuts.unionByName(resets).distinct().withColumn("cut", F.lit(1))
    order = W.partitionBy("conversation_id").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    return blocks.join(marks, ["conversation_id", "block"], "left").select("conversation_id", "block", F.coalesce(F.sum("cut").over(order), F.lit(0)).cast("int").alias("episode"))


def human_texts(blocked: DataFrame) -> DataFrame:
    """The user's text of every block; empty for a block without."""
    return blocked.groupBy("conversation_id", "block").agg(F.coalesce(F.max(F.when(F.col("role") == "user", F.trim("text"))), F.lit("")).alias("text"))


def token_totals(events: DataFrame, key: list[str]) -> DataFrame:
    """Estimated tokens by key and whether they pass the ceiling."""
    out = events.groupBy(*key).agg(F.sum(token_estimate(F.col("text"))).cast("long").alias("tokens"))
    return out.withColumn("over", F.col("tokens") > TOKEN_CEILING)
