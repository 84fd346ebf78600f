"""Queries of synthesis, its records and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import synthesis
from quarry.plans.registry import query
from quarry.sources.tables import table

CEILING = 120
CHUNKS_SQL = f"""WITH RECURSIVE e AS (SELECT conv_id, turn, role = 'user' AS opens, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))::bigint AS w, length(text)::bigint AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, text FROM conversations),
t AS (SELECT conv_id, greatest(sum(w), sum(c) // 4) AS whole FROM e GROUP BY 1), big AS (SELECT e.* FROM e JOIN t USING (conv_id) WHERE whole > {CEILING}),
f AS (SELECT conv_id, nth, turn, 0 AS chunk, w, c FROM big WHERE nth = 1 UNION ALL SELECT b.conv_id, b.nth, b.turn, CASE WHEN cut THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN b.w ELSE hw + b.w END, CASE WHEN cut THEN b.c ELSE hc + b.c END
FROM (SELECT big.*, f.chunk, f.w AS hw, f.c AS hc, greatest(f.w, f.c // 4) > {CEILING} AND (big.opens OR greatest(f.w, f.c // 4) > {2 * CEILING}) AS cut FROM f JOIN big ON big.conv_id = f.conv_id AND big.nth = f.nth + 1) b),
chunks AS (SELECT conv_id, turn, chunk FROM f UNION ALL SELECT e.conv_id, e.turn, 0 FROM e JOIN t USING (conv_id) WHERE whole <= {CEILING})"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("event_index"), "role", "text", (F.col("role") == "user").alias("opens"))


@query(CHUNKS_SQL + " SELECT conv_id, turn::int AS event_index, chunk::int AS chunk FROM chunks")
def episode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map chunks of conversations under a small ceiling."""
    return synthesis.map_chunks(_events(spark, sf_dir), "conv_id", CEILING)


@query(
    CHUNKS_SQL
    + r""", tr AS (SELECT conv_id, chunk, string_agg(trim(text), chr(10) ORDER BY turn) AS transcript FROM chunks JOIN e USING (conv_id, turn) GROUP BY 1, 2),
    l AS (SELECT conv_id, chunk, list_filter(list_transform(string_split(transcript, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM tr),
    fact AS (SELECT DISTINCT conv_id, f FROM (SELECT conv_id, unnest(list_filter(lines, lambda x: length(x) >= 30 AND regexp_matches(x, '[.!?]$'))) AS f FROM l))
    SELECT conv_id, count(*)::int AS map_chunks, arg_min(left(coalesce(lines[1], ''), 80), chunk) AS title, (SELECT count(*) FROM fact WHERE fact.conv_id = l.conv_id)::int AS facts FROM l GROUP BY conv_id"""
)
def episode_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through the offline producer, half of them from kept partials, and reduced by episode."""
    events = _events(spark, sf_dir)
    rows = synthesis.map_chunks(events, "conv_id", CEILING).join(events.select("conv_id", "event_index", "text"), ["conv_id", "event_index"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_index", F.trim("text").alias("text")))), lambda x: x["text"]), "\n")
    chunks = rows.groupBy("conv_id", "chunk").agg(text.alias("transcript")).withColumn("key", synthesis.partial_key(F.lit("offline"), F.lit("extract"), F.col("transcript")))
    _, kept = synthesis.produced(chunks.where("conv_id % 2 = 0"), None)
    maps, _ = synthesis.produced(chunks, kept)
    return synthesis.reduced(maps, "conv_id", "chunk").withColumn("facts", F.size("facts"))


@query(
    "SELECT 'j' || o_orderkey AS job_key, o_custkey::varchar AS conversation_id, o_orderpriority AS model_requested, o_orderstatus AS model_resolved, (o_orderkey % 4)::int AS events, o_orderkey * 10 AS input_tokens, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS output_tokens, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS duration_ms, (o_orderkey % 3)::int AS facts, 0 AS open_ends FROM orders"
)
def record_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    repeat = lambda n: F.when(n > 0, F.array_repeat(F.lit("x"), n.cast("int")))
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("j"), k.cast("string")).alias("job_key"), F.col("o_custkey").cast("string").alias("conversation_id"), F.col("o_orderpriority").alias("model_requested"), F.col("o_orderstatus").alias("model_resolved"), repeat(k % 4).alias("event_ids"),
        F.struct((k * 10).alias("input_tokens"), F.when(k % 3 > 0, k).alias("output_tokens")).alias("usage"), F.when(k % 5 > 0, k % 5).otherwise(-1).alias("duration_ms"), F.struct(repeat(k % 3).alias("facts"), F.lit(None).cast("array<string>").alias("open_ends")).alias("output"),
    )
    return synthesis.record_metadata(rows)


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN left('[REDACTED:unverified-excerpt]', 36) WHEN 1 THEN 'password: [REDACTED:secret]' ELSE 'plain text of no more than that' END AS text, CASE doc_id % 4 WHEN 2 THEN 'whole' WHEN 3 THEN 'redacted_text' ELSE 'redacted_text' END AS excerpt_basis,
    CASE WHEN doc_id % 4 >= 2 THEN doc_id END AS excerpt_start, doc_id % 4 = 0 AS withheld FROM documents"""
)
def sanitised_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, "a text that is cut with no known basis").when(kind == 1, "password: hunter2-hunter2-hunter2").otherwise("plain text of no more than that")
    basis = F.when(kind == 3, "redacted_text").otherwise("whole")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), ((kind == 0) | (kind == 3)).alias("truncated"), basis.alias("excerpt_basis"), F.col("doc_id").alias("excerpt_start"), F.lit(0).alias("excerpt_end"))
    return synthesis.sanitised(rows).select("doc_id", "text", "excerpt_basis", "excerpt_start", "withheld")


@query(
    """SELECT o_orderpriority AS plan, count(*) AS conversations, count(*) FILTER (WHERE c_custkey IS NULL) AS unknown, CASE WHEN o_orderpriority = '5-LOW' THEN 'other lineage' WHEN count(*) FILTER (WHERE c_custkey IS NULL) > 0 THEN 'unknown conversations' ELSE 'ready' END AS finding
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 7) ON c_custkey = o_custkey WHERE o_orderpriority <> '2-HIGH' OR o_custkey % 10 <> 7 GROUP BY 1"""
)
def erasure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority <> '2-HIGH' OR o_custkey % 10 <> 7")
    plan = orders.select(F.col("o_orderpriority").alias("plan"), F.when(F.col("o_orderpriority") == "5-LOW", "g9").otherwise("g1").alias("from_generation"), F.col("o_custkey").alias("conversation_id"))
    archive = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 7").select(F.col("c_custkey").alias("conversation_id"))
    return synthesis.erasure_findings(plan, archive, spark.range(3).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("generation")))


@query(
    """WITH j AS (SELECT user_id % 50 AS job_id, event_id AS conversation_id, CASE WHEN event_type IN ('view', 'signup') THEN 'submitted' ELSE 'collected' END AS event, event_id AS at_ FROM events)
    SELECT job_id, max_by(conversation_id, at_) FILTER (WHERE event = 'submitted') AS conversation_id, max_by(event, at_) = 'submitted' AS pending FROM j GROUP BY job_id"""
)
def job_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("job_id"), F.col("event_id").alias("conversation_id"), F.when(F.col("event_type").isin("view", "signup"), "submitted").otherwise("collected").alias("event"), F.col("event_id").alias("at"))
    return synthesis.job_owners(rows)


@query(
    """WITH c AS (SELECT user_id AS session, event_id % 5 AS checkpoint, ['frozen', 'reissued', 'consumed', 'resolved'][event_id % 4 + 1] AS event, event_id AS at_ FROM events), s AS (SELECT session, checkpoint, max_by(event, at_) AS state, count(*) FILTER (WHERE event = 'reissued') AS reissues FROM c GROUP BY 1, 2)
    SELECT *, state IN ('frozen', 'reissued') AS waiting FROM s"""
)
def session_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("frozen", "reissued", "consumed", "resolved")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 5).alias("checkpoint"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("event"), F.col("event_id").alias("at"))
    return synthesis.checkpoints(rows)
