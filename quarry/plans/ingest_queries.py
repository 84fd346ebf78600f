"""Queries of admission, identity, reconciliation and the joins around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import in_scope, link_targets, normal_path, project, scope_range
from quarry.functions.text import question_key
from quarry.operators import admission, reconcile
from quarry.plans.registry import query
from quarry.sources.tables import conversation_records, table

ACK = "(?i)^(ok|an|the|is|of)[ a-z]{0,12}[.,!]*$"
CALL = "^(The|An|Er|In|Th)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("event_index"), F.col("turn").cast("string").alias("event_id"), "role", F.when(F.col("turn") % 7 == 6, "tool-use").otherwise("message").alias("kind"), "text"
    )


@query(
    f"""WITH e AS (SELECT conv_id, turn, role, CASE WHEN turn % 7 = 6 THEN 'tool-use' ELSE 'message' END AS kind, trim(coalesce(text, '')) AS text FROM conversations)
    SELECT rule, CASE WHEN rule = 'admit' THEN role END AS admitted_role, count(*) AS events FROM (
    SELECT role, CASE WHEN kind <> 'message' THEN 'kind ' || kind WHEN role NOT IN ('user', 'assistant') THEN 'role ' || role WHEN text = '' OR regexp_matches(text, '{ACK}') THEN 'empty or acknowledgement' ELSE 'admit' END AS rule FROM e)
    GROUP BY 1, 2"""
)
def scan_admission_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.tally(admission.admission_rules(_events(spark, sf_dir), acknowledgement=ACK))


@query(
    f"""WITH RECURSIVE e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, regexp_matches(trim(text), '{CALL}') AS opens FROM conversations),
    f AS (SELECT conv_id, nth, turn, CASE WHEN role = 'assistant' AND opens THEN 'rendered tool call' END AS tool_rule, CASE WHEN role = 'assistant' AND opens THEN 1 ELSE 0 END AS pending FROM e WHERE nth = 1
    UNION ALL SELECT e.conv_id, e.nth, e.turn,
    CASE WHEN e.role = 'assistant' AND e.opens THEN 'rendered tool call' WHEN e.role = 'user' AND f.pending > 0 THEN 'rendered tool result' END,
    CASE WHEN e.role = 'assistant' THEN CASE WHEN e.opens THEN f.pending + 1 ELSE 0 END WHEN e.role = 'user' AND f.pending > 0 THEN f.pending - 1 ELSE f.pending END
    FROM f JOIN e ON e.conv_id = f.conv_id AND e.nth = f.nth + 1)
    SELECT conv_id AS conversation_id, turn AS event_index, tool_rule FROM f"""
)
def tool_round_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("kind", F.lit("message")).withColumn("text", F.trim("text"))
    return admission.pair_tool_rounds(events, CALL, None).select("conversation_id", "event_index", "tool_rule")


@query("SELECT sha256(conv_id::varchar || chr(0) || turn::varchar) AS record_id, conv_id AS conversation_id, turn AS event_index, role FROM conversations")
def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_records(table(spark, sf_dir, "conversations")).select("record_id", "conversation_id", "event_index", "role")


@query(
    "WITH s AS (SELECT conv_id, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM (SELECT conv_id, sha256(turn::varchar || chr(31) || role || chr(31) || text) AS h FROM conversations) GROUP BY conv_id, left(h, 4)) SELECT conv_id, sha256(string_agg(d, chr(10) ORDER BY d)) AS rows_sha256, sum(n)::bigint AS n_rows FROM s GROUP BY conv_id"
)
def rows_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.rows_digest(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"])


PATHS_SQL = "SELECT c_custkey, '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic workspaces of customers: region, nation, segment, name."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_mktsegment", F.lit("/"), "c_name")
    return joined.select("c_custkey", path.alias("path"), "c_acctbal")


@query(f"WITH p AS ({PATHS_SQL}) SELECT c_custkey, path FROM p WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')")
def path_prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(in_scope(F.col("path"), "/ASIA/")).select("c_custkey", "path")


@query(f"WITH p AS ({PATHS_SQL}) SELECT c_custkey, path FROM p WHERE starts_with(path, '/EUROPE/')")
def range_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(scope_range(F.col("path"), "/EUROPE")).select("c_custkey", "path")


@query(f"WITH p AS ({PATHS_SQL}) SELECT split_part(path, '/', 5) AS project, count(*) AS n FROM p GROUP BY 1")
def project_of_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select(project(F.col("path")).alias("project")).groupBy("project").agg(F.count("*").alias("n"))


@query(
    f"""WITH p AS ({PATHS_SQL}), a AS (SELECT * FROM (VALUES ('/ASIA', '/A'), ('/ASIA/CHINA', '/cn'), ('/EUROPE/FRANCE', '/fr'), ('/ASIA/INDIA/BUILDING', '/ib')) t(old, new))
    SELECT c_custkey, coalesce((SELECT new || substr(path, length(old) + 1) FROM a WHERE path = old OR starts_with(path, old || '/') ORDER BY length(old) DESC LIMIT 1), path) AS renamed FROM p"""
)
def alias_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("/ASIA", "/A"), ("/ASIA/CHINA", "/cn"), ("/EUROPE/FRANCE", "/fr"), ("/ASIA/INDIA/BUILDING", "/ib")], "old string, new string")
    return reconcile.longest_prefix(_paths(spark, sf_dir), "path", aliases).select("c_custkey", "renamed")


STORED = "SELECT o_orderkey, md5(o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END) AS digest, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 3"
ARRIVING = "SELECT o_orderkey, md5(o_orderpriority) AS digest, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderstatus <> 'P'"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    key, old = F.col("o_orderkey"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    stored = orders.where(key % 7 != 3).select("o_orderkey", F.md5(old).alias("digest"), "o_orderstatus")
    arriving = orders.where((key % 4 != 1) & (F.col("o_orderstatus") != "P")).select("o_orderkey", F.md5("o_orderpriority").alias("digest"), "o_orderstatus")
    return stored, arriving


@query(
    f"""WITH s AS ({STORED}), a AS ({ARRIVING}) SELECT coalesce(s.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(a.o_orderstatus, s.o_orderstatus) AS o_orderstatus,
    CASE WHEN a.digest IS NULL THEN CASE WHEN s.o_orderstatus IN (SELECT o_orderstatus FROM a) THEN 'sweep' ELSE 'keep' END WHEN a.digest = s.digest THEN 'unchanged' ELSE 'write' END AS action FROM s FULL JOIN a ON s.o_orderkey = a.o_orderkey"""
)
def incremental_ingest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, arriving = _snapshots(spark, sf_dir)
    return reconcile.ingest_actions(stored, arriving, "o_orderkey", "digest", "o_orderstatus")


@query(
    f"""WITH s AS ({STORED}), a AS ({ARRIVING}), d AS (SELECT coalesce(s.o_orderkey, a.o_orderkey) AS k, CASE WHEN a.digest IS NULL THEN 'only_test' WHEN s.digest IS NULL THEN 'only_live' WHEN a.digest <> s.digest THEN 'changed' END AS difference FROM s FULL JOIN a ON s.o_orderkey = a.o_orderkey)
    SELECT difference, count(*) AS n, (list(k ORDER BY k))[1:3] AS sample FROM d WHERE difference IS NOT NULL GROUP BY difference"""
)
def index_parity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, arriving = _snapshots(spark, sf_dir)
    return reconcile.parity_summary(reconcile.parity(stored, arriving, "o_orderkey", "digest"), "o_orderkey")


@query("SELECT l_orderkey, l_returnflag, n FROM (SELECT l_orderkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS nth FROM lineitem GROUP BY 1, 2) WHERE nth = 1")
def dominant_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.dominant(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", "l_returnflag", "n")


@query(
    """WITH c AS (SELECT doc_id, unnest(['src' || (doc_id % 31), 'src' || (doc_id % 23), 'src' || (doc_id % 20)]) AS source, unnest([0, 1, 2]) AS position FROM documents)
    SELECT doc_id, min(position)::int AS position, arg_min(source, position) AS source FROM c WHERE source IN (SELECT source FROM documents) GROUP BY doc_id"""
)
def first_resolving_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = F.array(*(F.concat(F.lit("src"), (F.col("doc_id") % m).cast("string")) for m in (31, 23, 20)))
    return reconcile.first_resolving(docs.select("doc_id", named.alias("candidates")), docs, "doc_id", "candidates", "source")


@query(
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS target FROM pages)
    SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM h GROUP BY target"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#?]+)'), F.lit(1))).alias("target"))
    per_page = targets.groupBy("target", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("target").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query(
    "SELECT doc_id, 'notes/' || source || '/' || doc_id || '.md' AS target FROM documents UNION ALL SELECT doc_id, 'notes/' || source || '.md' FROM documents WHERE doc_id % 2 = 0"
)
def note_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of synthetic notes, resolved against their folder."""
    docs = table(spark, sf_dir, "documents")
    note = F.concat(F.lit("see [[../"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("|it]] and ![no](x.png)"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" [up](<../"), "source", F.lit(".md#top> \"t\")"))).otherwise(""))
    each = docs.select("doc_id", F.explode(link_targets(note)).alias("target"))
    return each.select("doc_id", normal_path(F.concat(F.lit("notes/here/"), "target")).alias("target"))


@query(
    """WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k, c_mktsegment FROM customer), x AS (SELECT k FROM c WHERE c_mktsegment = 'BUILDING')
    SELECT 'expected' AS measure, count(*) AS n FROM c WHERE k NOT IN (FROM x) UNION ALL SELECT 'missing', count(*) FROM c WHERE k NOT IN (FROM x) AND k NOT IN (FROM o)
    UNION ALL SELECT 'extra', count(*) FROM o WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT 'excluded', count(*) FROM x UNION ALL SELECT 'excluded_present', count(*) FROM o WHERE k IN (FROM x)"""
)
def coverage_anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return reconcile.coverage(customer, orders, customer.where("c_mktsegment = 'BUILDING'"), "k")


@query(
    """SELECT c_nationkey, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS covered, count(DISTINCT o_custkey) AS customers, sum((o_orderstatus = 'O')::int)::bigint AS open_orders
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(DISTINCT o_custkey) >= 20"""
)
def project_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "F").alias("any_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    joined = per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count_if("any_f").alias("covered"), F.count("*").alias("customers"), F.sum("n_open").alias("open_orders")).where("customers >= 20")


@query(r"SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS first_doc FROM documents QUALIFY first_doc <> doc_id")
def doc_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents equal to an earlier one but for case and white space, by hash: no group is gathered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(question_key(F.col("text")), 256).alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, "key").where("doc_id <> first_doc").select("doc_id", "first_doc")
