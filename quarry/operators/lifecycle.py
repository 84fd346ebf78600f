"""Lifecycle of records: forget and restore, supersession, erasure, new keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.identity import joined_key


def latest(events: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in columns))


def supersessions(statements: DataFrame, target: str, by: str, at: str) -> DataFrame:
    """What replaced each record: the later statement wins, the larger id on ties, undated ones first."""
    best = statements.where(F.col(target).isNotNull()).groupBy(target).agg(F.max(F.struct(F.coalesce(F.col(at).cast("string"), F.lit("")).alias("at"), F.col(by).alias("by"))).alias("_s"))
    return best.select(target, F.col("_s.by").alias("superseded_by"), F.col("_s.at").alias("at"))


def forget_plan(records: DataFrame, ledger: DataFrame, key: str, rule: Column) -> DataFrame:
    """Records that a rule forgets now.  A record that the ledger knows stays as it says: a restored one
    is pinned."""
    return records.where(F.coalesce(rule, F.lit(False))).join(ledger.select(key).distinct(), key, "left_anti")


def restored(latest_events: DataFrame, key: str, event: str, selector: Column) -> DataFrame:
    """Forgotten records that a selector restores."""
    return latest_events.where((F.col(event) == "forget") & F.coalesce(selector, F.lit(False))).select(key)


def erased(rows: DataFrame, key: str, gone: DataFrame, text_col: str | None = None) -> DataFrame:
    """Rows left after an erasure: those of erased keys go, and those whose text names one.

    The names come as words of the text, so that they are an equality join and not a search of every
    text for every name."""
    left = rows.join(gone.select(key).distinct(), key, "left_anti")
    if text_col is None:
        return left
    names = gone.select(F.col(key).cast("string").alias("_name")).distinct()
    told = left.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)))).alias("_name"))
    return left.join(told.join(names, "_name", "left_semi").select(key).distinct(), key, "left_anti")


def rekeyed(records: DataFrame, conversation: str, event: str) -> DataFrame:
    """Records under keys made of conversation and event, with how many share a new key; doing it again
    changes nothing, since new keys are functions of old ids alone."""
    new = records.withColumn("new_id", joined_key(F.col(conversation), F.col(event)))
    clashes = new.groupBy("new_id").agg(F.count("*").alias("holders")).where("holders > 1")
    return new.join(clashes, "new_id", "left").fillna(1, ["holders"])


def forgotten_counts(latest_events: DataFrame, event: str, rule: str) -> DataFrame:
    return latest_events.where(F.col(event) == "forget").groupBy(rule).agg(F.count("*").alias("forgotten"))


#: Roles whose records a retirement can forget; curated notes never are.
FORGETTABLE = ("user", "assistant", "synthesis")


def retired_records(records: DataFrame, retirements: list[tuple[list[str], str]], key: str = "record_id") -> DataFrame:
    """Records that name a retired term and are older than its retirement, with the ``nth`` retirement
    that does so first.  A cheap search for any term spares other texts the whole-word test."""
    from quarry.operators.context import mentions

    low = F.lower(F.coalesce("text", F.lit("")))
    nth = F.lit(None).cast("int")
    any_term = F.lit(False)
    for n, (terms, since) in reversed(list(enumerate(retirements))):
        for term in terms:
            any_term = any_term | F.contains(low, F.lit(term.lower()))
        nth = F.when(mentions(F.col("text"), terms) & (F.coalesce("authored_at", F.lit("")) < since), n).otherwise(nth)
    rows = records.where(F.col("role").isin(*FORGETTABLE) & any_term).withColumn("nth", nth)
    return rows.where("nth IS NOT NULL").select(key, "role", "nth")


def remembered(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Payloads with ``outcome``: ``remembered``, or ``refused`` with the targets that do not exist.

    payloads: record_id, supersedes (array of ids); a payload is refused as a whole."""
    wanted = payloads.select("record_id", F.explode("supersedes").alias("target"))
    known = records.select(F.col("record_id").alias("target")).distinct()
    missing = wanted.join(known, "target", "left_anti").groupBy("record_id").agg(F.array_sort(F.collect_set("target")).alias("missing"))
    out = payloads.join(missing, "record_id", "left")
    return out.withColumn("outcome", F.when(F.col("missing").isNull(), "remembered").otherwise("refused"))


def upserted(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Stored rows with arriving ones in the place of those of their key."""
    return stored.join(arriving.select(key), key, "left_anti").unionByName(arriving)


def mis_stamped(cited: DataFrame, archive: DataFrame, record: str) -> DataFrame:
    """Records by what the archive says of the events they cite: ``intact`` (all there), ``repairable``
    (all there under ids qualified by their conversation) or ``unexplained``.

    cited: the record's column, conversation_id, event_id; archive: conversation_id, event_id.  Citations
    meet events by equality, once as they are and once qualified; no list of a conversation is made."""
    known = archive.select("conversation_id", F.col("event_id").alias("_event")).distinct()
    ids = F.array(F.col("event_id").cast("string"), joined_key(F.col("conversation_id"), F.col("event_id")))
    tried = cited.select(record, "conversation_id", F.posexplode(ids).alias("_way", "_event"))
    found = tried.join(known.withColumn("_there", F.lit(1)), ["conversation_id", "_event"], "left")
    share = lambda way: F.min(F.when(F.col("_way") == way, F.coalesce("_there", F.lit(0))))
    kinds = found.groupBy(record).agg(share(0).alias("plain"), share(1).alias("qualified"))
    return kinds.select(record, F.when(F.col("plain") == 1, "intact").when(F.col("qualified") == 1, "repairable").otherwise("unexplained").alias("state"))


def served_synthesis(records: DataFrame, rank: Column, forgotten: DataFrame, automation: DataFrame, workspaces: DataFrame, replaced: DataFrame) -> DataFrame:
    """The synthesis records that an index serves: of each episode the best-ranked record, without those
    forgotten or of automation, under the workspace its conversation mostly has, with what replaced it.

    records: record_id, episode_id, conversation_id; forgotten: record_id; automation: conversation_id;
    workspaces: conversation_id, workspace; replaced: record_id, superseded_by."""
    from quarry.operators.reconcile import dominant

    left = records.join(forgotten.select("record_id"), "record_id", "left_anti").join(automation.select("conversation_id"), "conversation_id", "left_anti")
    best = left.groupBy("episode_id").agg(F.min(F.struct(rank.alias("_rank"), "record_id", "conversation_id")).alias("b")).select("episode_id", "b.record_id", "b.conversation_id")
    placed = best.join(dominant(workspaces, "conversation_id", "workspace").drop("n"), "conversation_id", "left")
    return placed.join(replaced.select("record_id", "superseded_by"), "record_id", "left")
