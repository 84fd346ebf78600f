"""Context assembly: recency recall, budgets, demotion, links, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import question_key

SNAPSHOT_CHARS, MAX_LINKS = 3_600, 4


def recent(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order with ``position`` and a score that falls by one from 0."""
    top = rows.orderBy(*order).limit(limit)
    top = top.withColumn("position", F.row_number().over(W.orderBy(*order)))
    return top.withColumn("score", (1 - F.col("position")).cast("double"))


def within_budget(rows: DataFrame, position: str, size: str, most: int = SNAPSHOT_CHARS) -> DataFrame:
    """Rows in order as long as all so far fit into a number of characters.  Rows: at most a limit's."""
    used = F.sum(size).over(W.orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("used", used).where(F.col("used") <= most)


def first_seen(rows: DataFrame, text_col: str, position: str) -> DataFrame:
    """Rows whose text no earlier row has but for case and white space."""
    key = F.sha2(question_key(F.col(text_col)), 256)
    first = rows.groupBy(key.alias("_key")).agg(F.min(position).alias(position))
    return rows.join(first.select(position), position, "left_semi")


def mentions(text: Column, terms: list[str]) -> Column:
    """Whether a text names one of the terms as a whole word, whatever its case."""
    import re

    if not terms:
        return F.lit(False)
    return F.coalesce(text.rlike(r"(?i)(^|[^\w])(" + "|".join(re.escape(t) for t in terms) + r")([^\w]|$)"), F.lit(False))


def outdated(rows: DataFrame, text_col: str, at_col: str, retirements: list[tuple[list[str], str]]) -> DataFrame:
    """Rows with ``outdated``: whether they name a retired term and are older than its retirement.  An
    undated row is older than any."""
    flag = F.lit(False)
    for terms, since in retirements:
        flag = flag | (mentions(F.col(text_col), terms) & (F.coalesce(F.col(at_col), F.lit("")) < since))
    return rows.withColumn("outdated", flag)


def demoted(rows: DataFrame, position: str, superseded: str | None = None) -> DataFrame:
    """A new order: current rows, then outdated ones, then superseded ones, each as they were.  Rows: at
    most a limit's."""
    order = [F.col(superseded)] if superseded else []
    return rows.withColumn("new_position", F.row_number().over(W.orderBy(*order, "outdated", position)))


def linked(roots: DataFrame, links: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Notes one link away from the first roots: each once, with the root that led there, at most four
    per root.  roots: id, position; links: id, ordinal, target; known: id."""
    first = roots.where(F.col("position") <= limit)
    hops = first.join(links, "id").join(roots.select(F.col("id").alias("target")), "target", "left_anti").join(known.select(F.col("id").alias("target")), "target", "left_semi")
    # the driver's cap of links: at most limit roots of at most fifty links each reach this window
    seen = hops.withColumn("_nth", F.row_number().over(W.partitionBy("target").orderBy("position", "ordinal"))).where("_nth = 1")
    ranked = seen.withColumn("link_position", F.row_number().over(W.orderBy("position", "ordinal")))
    return ranked.where(F.col("link_position") <= MAX_LINKS * limit).select(F.col("target").alias("id"), F.col("id").alias("parent"), "link_position")


def fair_budget(rows: DataFrame, position: str, size: str, most: int) -> DataFrame:
    """Characters for each row of a small answer: an even share of what is left, unused parts roll on."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(size).cast("long").alias("n")))).alias("all"))
    start = F.struct(F.lit(most).cast("long").alias("left"), F.array().cast("array<struct<p:int,given:bigint>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        share = F.floor(state["left"] / (F.size("all") - F.size(state["out"])))
        given = F.least(row["n"], share)
        return F.struct((state["left"] - given).alias("left"), F.concat(state["out"], F.array(F.struct(row["p"].cast("int").alias("p"), given.alias("given")))).alias("out"))

    out = listed.select(F.explode(F.aggregate("all", start, step)["out"]).alias("o"))
    return rows.join(F.broadcast(out.select(F.col("o.p").alias(position), F.col("o.given").alias("given"))), position)  # an answer's rows


TRUST = {"user": "stated", "assistant": "derived", "note": "curated", "synthesis": "derived", "source": "third-party"}


def rendered(rows: DataFrame, excerpt_col: str, text_col: str) -> DataFrame:
    """Evidence rows with trust, date status and whether the text was cut."""
    trust = F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair))
    stamp = F.try_to_timestamp("authored_at")
    status = F.when(F.coalesce("authored_at", F.lit("")) == "", "unknown").when(stamp.isNull(), "invalid").otherwise("known")
    return rows.withColumns({"trust": F.coalesce(trust[F.col("role")], F.lit("unknown")), "date_status": status, "truncated": F.length(excerpt_col) < F.length(text_col)})


def selected(candidates: DataFrame, text_col: str, limit: int, max_chars: int) -> DataFrame:
    """Candidates that make an answer, in order: each text once, a link only if its parent was taken before
    it, and no more than the limit.

    candidates: id, parent, position and the text.  A candidate depends on those before it, so the few
    hundred of one answer fold as one row, by the hashes of their texts."""
    key = F.sha2(question_key(F.col(text_col)), 256)
    listed = candidates.agg(F.sort_array(F.collect_list(F.struct("position", F.col("id").alias("id"), F.col("parent").alias("parent"), key.alias("key")))).alias("all"))
    kind = dict(candidates.dtypes)["id"]
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{kind}>").alias("ids"), F.array().cast("array<int>").alias("at"))

    def take(state: Column, row: Column) -> Column:
        fits = (row["parent"].isNull() | F.array_contains(state["ids"], row["parent"])) & ~F.array_contains(state["seen"], row["key"])
        added = F.struct(F.concat(state["seen"], F.array(row["key"])).alias("seen"), F.concat(state["ids"], F.array(row["id"])).alias("ids"), F.concat(state["at"], F.array(row["position"].cast("int"))).alias("at"))
        return F.when(fits, added).otherwise(state)

    taken = listed.select(F.slice(F.aggregate("all", start, take)["at"], 1, min(limit, max_chars)).alias("at"))
    places = taken.select(F.posexplode("at").alias("place", "position")).withColumn("place", F.col("place") + 1)
    return candidates.join(F.broadcast(places), "position")  # an answer's rows


def annotated(evidence: DataFrame, supersessions: DataFrame, hosts: DataFrame) -> DataFrame:
    """Evidence with what replaced it and where it was seen.  supersessions: id, superseded_by, at; hosts:
    id, hosts; an answer's rows."""
    marks = supersessions.select("id", "superseded_by", F.col("at").alias("superseded_at"))
    return evidence.join(marks, "id", "left").join(hosts.select("id", "hosts"), "id", "left")


def declared_outdated(rows: DataFrame, text_col: str, at_col: str, role_col: str, id_col: str, retirements: list[tuple]) -> DataFrame:
    """Rows with ``outdated``: of notes, only the one that declares a retirement (its id comes with it); of
    others, those that name a retired term and are older than the retirement."""
    flag = F.lit(False)
    for terms, since, declared_by in retirements:
        older = F.coalesce(F.col(at_col), F.lit("")) < since
        flag = flag | (mentions(F.col(text_col), terms) & F.when(F.col(role_col) == "note", F.col(id_col) == declared_by).otherwise(older))
    return rows.withColumn("outdated", F.coalesce(flag, F.lit(False)))


def query_names(query: str, retirements: list[tuple[list[str], str]]) -> bool:
    """Whether a question itself asks for a retired thing, so that nothing is demoted for naming it."""
    import re

    terms = [re.escape(t) for terms, *_ in retirements for t in terms]
    return bool(terms) and re.search(r"(?i)(^|[^\w])(" + "|".join(terms) + r")([^\w]|$)", query) is not None


#: Retirements that are sent to every task; more of them meet the words of texts in an exchange.
MAX_SENT = 100_000


def retired_by(rows: DataFrame, retirements: DataFrame, id_col: str, text_col: str, at_col: str) -> DataFrame:
    """Rows with ``retired_since``, the first day of a retirement whose term they name and that they are
    older than; null if there is none.

    retirements: term, since, of any number.  Texts meet terms by the term's first word, and only these pairs
    are tested for the whole term.  The words of texts are as many as their tokens: the retirements go to
    them, and where these are too many, words go to the exchange with an id and without their text."""
    from quarry.functions.text import tokens

    words = F.array_distinct(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")))
    word = F.get(tokens(F.col("term")), F.lit(0))
    wanted = retirements.where(word.isNotNull()).select(word.alias("_word"), "term", "since").distinct()
    quoted = F.concat(F.lit(r"(?i)(^|[^\w])\Q"), "term", F.lit(r"\E([^\w]|$)"))
    dated = rows.select(id_col, text_col, F.coalesce(at_col, F.lit("")).alias("_at"))
    if wanted.limit(MAX_SENT + 1).count() <= MAX_SENT:
        told = dated.select("*", F.explode(words).alias("_word"))
        pairs = told.join(F.broadcast(wanted), "_word").where("_at < since")
    else:
        told = dated.select(id_col, "_at", F.explode(words).alias("_word"))
        met = told.hint("shuffle_merge").join(wanted, "_word").where("_at < since").select(id_col, "term", "since")
        pairs = met.join(dated.select(id_col, text_col), id_col)
    found = pairs.withColumn("_shape", quoted).where(F.expr(f"`{text_col}` RLIKE _shape")).groupBy(id_col).agg(F.min("since").alias("retired_since"))
    return rows.join(found, id_col, "left")
