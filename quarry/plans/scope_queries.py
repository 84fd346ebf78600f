"""Queries of populations, two-pass searches, sampled checks, recursive unions and fuller reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import link_candidates, population_scope, renamed_home
from quarry.operators import context, curation, evaluation, lexical, reconcile, reports
from quarry.operators.word_index import WordIndex
from quarry.plans.ingest_queries import PATHS_SQL, _paths
from quarry.plans.registry import query
from quarry.plans.report_queries import RESULTS_SQL, _results
from quarry.plans.search_queries import TOKENS, bm25_sql
from quarry.sources.tables import table

D = "doc_id"
ROLE_SQL = "['user', 'assistant', 'synthesis', 'note', 'source'][doc_id % 5 + 1]"


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*(F.lit(r) for r in ("user", "assistant", "synthesis", "note", "source"))), (F.col(D) % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("role", role).withColumn("workspace", F.concat(F.lit("/w/"), "source"))


@query(f"SELECT doc_id, 'curated' AS population FROM documents WHERE {ROLE_SQL} = 'note' UNION ALL SELECT doc_id, 'history' FROM documents WHERE {ROLE_SQL} IN ('user', 'assistant', 'synthesis') AND source = 'src1'")
def population_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of any workspace, and history of one."""
    rows = _roles(spark, sf_dir)
    curated = rows.where(population_scope(F.col("role"), F.col("workspace"), "curated", "/w/src1")).select(D, F.lit("curated").alias("population"))
    return curated.unionByName(rows.where(population_scope(F.col("role"), F.col("workspace"), "history", "/w/src1")).select(D, F.lit("history").alias("population")))


DAY_SQL = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') END"


@query(f"SELECT doc_id, regexp_matches(lower(text), '(^|[^\\w])(clown|scum)([^\\w]|$)') AND CASE WHEN {ROLE_SQL} = 'note' THEN doc_id = 8 ELSE {DAY_SQL} < '2024-01-20' END AS outdated FROM documents")
def declared_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of retired things: of notes, only the one that declares it; of others, the older ones."""
    day = F.when(F.col(D) % 11 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col(D) % 28 + 1).cast("string"), 2, "0")))
    rows = _roles(spark, sf_dir).withColumn("day", day)
    return context.declared_outdated(rows, "text", "day", "role", D, [(["clown", "scum"], "2024-01-20", 8)]).select(D, "outdated")


def _index(spark: SparkSession, sf_dir: str) -> WordIndex:
    return WordIndex.of_table(spark, f"{sf_dir}/documents.parquet", D, "text")


@query(
    f"""WITH t AS (SELECT doc_id, text, {TOKENS} AS toks FROM documents), p AS (SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\w])example(?:[^\\w\\s]|_)+com([^\\w]|$)') AS a, regexp_matches(text, '(?i)(^|[^\\w])apache(?:[^\\w\\s]|_)+org([^\\w]|$)') AS b FROM t)
    SELECT doc_id, CASE WHEN a AND b THEN 1 ELSE 2 END AS lane_pass FROM p WHERE a OR b ORDER BY lane_pass, doc_id LIMIT 30"""
)
def verified_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuated terms as written: rows with all of them, then rows with any."""
    return lexical.verified_passes(table(spark, sf_dir, "documents"), D, "text", "example.com apache.org", 30)


@query(
    bm25_sql(["the", "clown", "moron", "of"])
    + """, f AS (SELECT tf0, tf1, tf2, tf3 FROM counts), b AS (SELECT doc_id, 2 AS lane_pass, round(greatest(ln((n - df1 + 0.5::double) / (df1 + 0.5::double)), 1e-6::double) * tf1 * 2.2::double / (tf1 + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)) + greatest(ln((n - df2 + 0.5::double) / (df2 + 0.5::double)), 1e-6::double) * tf2 * 2.2::double / (tf2 + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)), 6) AS score FROM counts, stats WHERE tf1 > 0 OR tf2 > 0),
    a AS (SELECT doc_id, 1 AS lane_pass, score FROM scored WHERE matched = 4), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) SELECT doc_id, lane_pass, score FROM u ORDER BY lane_pass, score DESC, doc_id LIMIT 15"""
)
def narrow_then_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms first, then any of the terms that few documents have."""
    return _index(spark, sf_dir).narrow_then_selective(["the", "clown", "moron", "of"], 15, 0.2).withColumnRenamed("id", D)


@query("SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey")
def smallest_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("status"))


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AS known FROM (SELECT * FROM orders ORDER BY sha256('membership:' || o_orderkey), o_orderkey LIMIT 60)")
def sampled_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a fixed sample of 60 rows cites exists."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return reconcile.sampled_membership(table(spark, sf_dir, "orders"), known, "o_orderkey", "o_custkey", 60).select("o_orderkey", "known")


@query("SELECT source AS provider, count(*) AS records, sum(n_chars)::bigint AS chars, row_number() OVER (ORDER BY count(*) DESC, source)::int AS by_size FROM documents GROUP BY source")
def provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.providers(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT event_type, max(ts) AS newest, count(*) FILTER (WHERE value < 5) AS malformed, count(*) AS n FROM events GROUP BY event_type")
def lane_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest use of each lane, whatever is null, and malformed uses."""
    return reports.lane_freshness(table(spark, sf_dir, "events"), "event_type", "ts", F.col("value") < 5)


@query(
    """WITH f AS (SELECT doc_id, lower(trim(split_part(text, ' ', 1))) AS key, 'src' || (doc_id % 3) AS source FROM documents) SELECT key, count(*) AS sightings, list_sort(list(DISTINCT source)) AS sources FROM f WHERE key <> '' GROUP BY key"""
)
def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.lower(F.trim(F.split_part("text", F.lit(" "), F.lit(1)))).alias("key"), F.concat(F.lit("src"), (F.col(D) % 3).cast("string")).alias("source")).where("key <> ''")
    return curation.claim_sources(rows, "key", "source")


@query(
    f"""SELECT quality, toxic, band, parity, count(*) AS questions, sum((coalesce(rank <= 8, false))::int)::bigint AS hits FROM (SELECT *, doc_id % 3 AS band, doc_id % 2 AS parity FROM ({RESULTS_SQL})) GROUP BY GROUPING SETS ((quality), (toxic), (band), (parity), ())"""
)
def eval_four_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumn("band", F.col(D) % 3).withColumn("parity", F.col(D) % 2)
    return evaluation.strata(rows, ["quality", "toxic", "band", "parity"])


@query(
    f"""SELECT quality, count(*) AS questions, count(*) FILTER (WHERE doc_id % 19 = 0) AS errors, sum(CASE WHEN doc_id % 5 = 0 THEN 2 WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END)::bigint AS warnings, sum((doc_id % 19 <> 0 AND coalesce(rank <= 8, false))::int)::bigint AS hits FROM ({RESULTS_SQL}) GROUP BY quality"""
)
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col(D)
    warned = F.when(d % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(d % 5 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    rows = _results(spark, sf_dir).withColumn("error", F.when(d % 19 == 0, "timeout")).withColumn("warnings", warned)
    return evaluation.outcomes(rows, ["quality"])


@query(
    """WITH RECURSIVE g AS (SELECT doc_id AS id, doc_id // 3 AS up FROM documents WHERE doc_id % 2 = 0), r AS (SELECT id, up, 1 AS depth FROM g WHERE id >= 60 UNION ALL SELECT r.id, g.up, r.depth + 1 FROM r JOIN g ON g.id = r.up WHERE r.depth < 12)
    SELECT id, max(depth)::int AS depth, min(up) AS root FROM r GROUP BY id"""
)
def recursive_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of parents by a recursive union."""
    table(spark, sf_dir, "documents").where("doc_id % 2 = 0").selectExpr("doc_id AS id", "doc_id div 3 AS up").createOrReplaceTempView("_parents")
    return spark.sql(
        """WITH RECURSIVE r(id, up, depth) AS (SELECT id, up, 1 FROM _parents WHERE id >= 60 UNION ALL SELECT r.id, g.up, r.depth + 1 FROM r JOIN _parents g ON g.id = r.up WHERE r.depth < 12)
        SELECT id, max(depth) AS depth, min(up) AS root FROM r GROUP BY id"""
    )


@query("SELECT doc_id, [CASE WHEN doc_id % 2 = 0 THEN 'notes/here/' || source || '.md' END, source || '.md', 'tree/' || source || '.md'] AS candidates FROM documents")
def note_link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a link of a note may lead: beside it, from the root, and in a tree of its own."""
    target = F.concat(F.when(F.col(D) % 2 == 0, "").otherwise("../../../"), F.col("source"), F.lit(".md"))
    own = F.when(F.col(D) % 2 == 0, target).otherwise(target)
    rows = table(spark, sf_dir, "documents").select(D, link_candidates(F.lit("notes/here/x.md"), own, F.concat("source", F.lit(".md")), "tree").alias("candidates"))
    return rows


@query(f"WITH p AS ({PATHS_SQL}) SELECT c_custkey, CASE WHEN starts_with(path, '/ASIA/CHINA/') THEN '/cn' || substr(path, 12) ELSE '[HOME]' || path END AS place FROM p")
def canonical_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below home in canonical form, with aliases applied to them."""
    aliases = spark.createDataFrame([("[HOME]/ASIA/CHINA", "/cn")], "old string, new string")
    paths = _paths(spark, sf_dir).select("c_custkey", renamed_home(F.concat(F.lit("/home/user"), "path"), "/home/user").alias("path"))
    return reconcile.longest_prefix(paths, "path", aliases).select("c_custkey", F.col("renamed").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def claim_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass still has to do: neither done nor of a conversation that a session covers."""
    from quarry.operators import sessions

    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    left = orders.join(orders.where("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey", "left_anti")
    done = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sessions.covered(left, done, "o_custkey").select("o_orderkey")
