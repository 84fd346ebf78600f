"""Queries of the search lanes, their fusion and the page shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dense, fusion, lexical
from quarry.operators.word_index import WordIndex
from quarry.plans.registry import query
from quarry.sources.tables import note_path, table

WORDS = "idiot clown worthless trash"
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


def _index(spark: SparkSession, sf_dir: str) -> WordIndex:
    return WordIndex.of_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def bm25_sql(words: list[str]) -> str:
    """BM25 over documents for plain words: doc_id, matched, score."""
    tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{w}'))::double AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum((tf{i} > 0)::int)::double AS df{i}" for i in range(len(words)))
    score = " + ".join(
        f"greatest(ln((n - df{i} + 0.5::double) / (df{i} + 0.5::double)), 1e-6::double) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))"
        for i in range(len(words))
    )
    matched = " + ".join(f"(tf{i} > 0)::int" for i in range(len(words)))
    return f"""
    WITH toks AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
    counts AS (SELECT doc_id, len(toks) AS dl, {tf} FROM toks),
    stats AS (SELECT count(*)::double AS n, avg(dl) AS avgdl, {df} FROM counts),
    scored AS (SELECT doc_id, {matched} AS matched, round({score}, 6) AS score FROM counts, stats WHERE {matched} > 0)
    """


@query(
    f"""SELECT tok, count(*) AS df, sum(n)::bigint AS cf FROM (
    SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS tok FROM documents) GROUP BY 1, 2) GROUP BY tok"""
)
def word_token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.token_frequencies(table(spark, sf_dir, "documents"), "text")


@query(bm25_sql(["idiot", "clown", "worthless", "trash"]) + "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20")
def word_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _index(spark, sf_dir).scored(lexical.query_terms(WORDS))
    return found.select(F.col("id").alias("doc_id"), "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query(bm25_sql(["the", "idiot"]) + "SELECT doc_id, CASE WHEN matched = 2 THEN 1 ELSE 2 END AS lane_pass, score FROM scored ORDER BY lane_pass, score DESC, doc_id LIMIT 25")
def word_and_then_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search(lexical.query_terms("the idiot"), 25).withColumnRenamed("id", "doc_id")


@query(
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents)
    SELECT doc_id, len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the'))::int AS occurrences FROM t WHERE occurrences > 0"""
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    (parts,) = lexical.query_terms('"of-the"')
    return _index(spark, sf_dir).phrase(parts).withColumnRenamed("id", "doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\w])example(?:[^\w\s]|_)+com([^\w]|$)')")
def adjacency_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.verified(table(spark, sf_dir, "documents"), "text", "example.com").select("doc_id")


SELECTIVE = ["the", "clown", "moron", "of", "stupid", "and", "scum"]


@query(
    f"""WITH d AS (SELECT tok, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS tok FROM documents) GROUP BY tok),
    q AS (SELECT unnest({SELECTIVE!r}) AS tok, unnest(range(1, {len(SELECTIVE) + 1})) AS place),
    k AS (SELECT q.tok, coalesce(df, 0) AS df, place, coalesce(df, 0) <= 0.01::double * (SELECT count(*) FROM documents) AS rare FROM q LEFT JOIN d USING (tok))
    SELECT tok, df, place FROM (SELECT *, row_number() OVER (ORDER BY df, place) AS nth FROM k WHERE df > 0 AND (rare OR NOT (SELECT bool_or(rare) FROM k))) WHERE nth <= 32"""
)
def selective_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    n_docs = spark.range(1).select(F.lit(index.n_docs).alias("n_docs"))
    return lexical.selective_terms(index.frequencies(SELECTIVE), n_docs, SELECTIVE)


@query(
    """WITH c AS (SELECT doc_id, greatest(length(lower(text)) - 2, 0) AS dl, ((length(lower(text)) - length(replace(lower(text), 'orthless', ''))) // 8)::int AS occurrences FROM documents),
    s AS (SELECT count(*)::double AS n, avg(dl) AS avgdl, sum((occurrences > 0)::int)::double AS df FROM c)
    SELECT doc_id, occurrences, round(greatest(ln((n - df + 0.5::double) / (df + 0.5::double)), 1e-6::double) * occurrences * 2.2::double / (occurrences + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)), 6) AS score
    FROM c, s WHERE occurrences > 0 ORDER BY score DESC, doc_id LIMIT 20"""
)
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).substring("orthless", 20).withColumnRenamed("id", "doc_id")


CLAIM_WORDS = ["disgusting", "loser", "moron", "that"]


@query(
    "WITH w AS (SELECT doc_id, "
    + ", ".join(f"list_contains(toks, '{w}') AS h{i}" for i, w in enumerate(CLAIM_WORDS))
    + " FROM (SELECT doc_id, regexp_extract_all(translate(lower(text), 'áàâäãåāăąçćčďèéêëēęěìíîïīłñńňòóôöõøōřśšťùúûüūůýÿžźż', 'aaaaaaaaacccdeeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzz'), '[a-z0-9_]+') AS toks FROM documents)), "
    + "s AS (SELECT count(*)::double AS n, "
    + ", ".join(f"sum(h{i}::int)::double AS d{i}" for i in range(4))
    + " FROM w) SELECT doc_id, round("
    + " + ".join(f"CASE WHEN h{i} THEN ln(n / d{i}) ELSE 0::double END" for i in range(4))
    + ", 6) AS score FROM w, s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"
)
def page_idf_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.idf_overlap(table(spark, sf_dir, "documents"), "doc_id", "text", "That loser moron was a disgusting sod", 20)


@query(
    bm25_sql(["la", "de"]).replace("FROM documents", "FROM (SELECT * FROM documents WHERE lang = 'fr' AND (source = 'src1' OR starts_with(source, 'src1')))")
    + "SELECT doc_id, CASE WHEN matched = 2 THEN 1 ELSE 2 END AS lane_pass, score FROM scored ORDER BY lane_pass, score DESC, doc_id LIMIT 20"
)
def scoped_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "documents").where((F.col("lang") == "fr") & F.startswith("source", F.lit("src1")))
    eligible = scope.select(F.col("doc_id").alias("id"))
    return _index(spark, sf_dir).search(lexical.query_terms("la de"), 20, eligible).withColumnRenamed("id", "doc_id")


DOT = "list_inner_product(a.embedding::double[], b.embedding::double[])"


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of id 0, the query of the dense queries."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


@query(f"SELECT b.vec_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, b.vec_id LIMIT 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_topk(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), "vec_id", "embedding")


@query(f"SELECT b.vec_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.label IN (3, 4) ORDER BY score DESC, b.vec_id LIMIT 20")
def dense_scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "embeddings").where(F.col("label").isin(3, 4))
    return dense.dense_topk(scope, _probe(spark, sf_dir), "vec_id", "embedding")


@query(
    f"""SELECT label, vec_id, score FROM (SELECT b.label, b.vec_id, round({DOT}, 6) AS score, row_number() OVER (PARTITION BY b.label ORDER BY round({DOT}, 6) DESC, b.vec_id) AS nth
    FROM embeddings a, embeddings b WHERE a.vec_id = 0) WHERE nth = 1 ORDER BY score DESC, label LIMIT 20"""
)
def dense_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.best_per_group(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), "vec_id", "embedding", "label")


@query(
    f"""WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS nth FROM s WHERE score >= 0.4::double)
    SELECT least(a, b) AS left_id, greatest(a, b) AS right_id, max(score) AS score FROM t WHERE nth <= 5 GROUP BY 1, 2"""
)
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.neighbour_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4, 5)


FUSED = (
    bm25_sql(["idiot", "clown", "worthless", "trash"])
    + """, lane_a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 60),
    lane_b AS (SELECT b.vec_id AS doc_id, row_number() OVER (ORDER BY round("""
    + DOT
    + """, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 0 QUALIFY rank <= 60)
    """
)


def rrf_sql(w: str, v: str) -> str:
    return FUSED + f"SELECT doc_id, round(sum(part), 9) AS score FROM (SELECT doc_id, {w} / (60::double + rank) AS part FROM lane_a UNION ALL SELECT doc_id, {v} / (60::double + rank) FROM lane_b) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"



def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = _index(spark, sf_dir).scored(lexical.query_terms(WORDS)).select(F.col("id").alias("doc_id"), "score")
    vectors = dense.dense_topk(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), _probe(spark, sf_dir), "doc_id", "embedding", 60)
    return words, vectors


@query(rrf_sql(w="0.7::double", v="(1::double - 0.7::double)"))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, vectors = _lanes(spark, sf_dir)
    return fusion.rrf([(fusion.ranked(words, "doc_id"), 0.7), (fusion.ranked(vectors, "doc_id"), 1 - 0.7)], "doc_id", 20)


@query("SELECT doc_id, score, 'fused' AS via FROM (" + rrf_sql(w="0.5::double", v="0.5::double") + ")")
def adaptive_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, vectors = _lanes(spark, sf_dir)
    return fusion.adaptive(words, vectors, "doc_id", 20, 0.5)


@query(
    bm25_sql(["idiot", "clown", "worthless", "trash"])
    + f""", lex AS (SELECT doc_id, round(score, 9) AS score FROM scored ORDER BY score DESC, doc_id LIMIT 20), den AS (SELECT b.vec_id AS doc_id, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, b.vec_id LIMIT 20)
    SELECT doc_id, score, 'lexical' AS via FROM lex UNION ALL SELECT doc_id, score, 'dense' FROM den"""
)
def single_lane_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer where only one lane has hits, for each lane."""
    words, vectors = _lanes(spark, sf_dir)
    nothing = words.where("doc_id < -1")
    return fusion.adaptive(words, nothing, "doc_id", 20).unionByName(fusion.adaptive(nothing, vectors, "doc_id", 20))


POPULATIONS = (
    FUSED
    + """, pops AS (SELECT 'history' AS population, doc_id AS id, rank FROM lane_a WHERE rank <= 12 UNION ALL SELECT 'note', doc_id, rank FROM lane_b WHERE rank <= 10),
    judged AS (SELECT population, id, rank, ((id * 37) % 41)::double / 10 - 2 AS score FROM pops)
    """
)


def _populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, vectors = _lanes(spark, sf_dir)
    history = fusion.ranked(words, "doc_id", depth=12).select(F.lit("history").alias("population"), F.col("doc_id").alias("id"), "rank")
    notes = fusion.ranked(vectors, "doc_id", depth=10).select(F.lit("note").alias("population"), F.col("doc_id").alias("id"), "rank")
    return history.unionByName(notes).withColumn("score", (F.col("id") * 37 % 41).cast("double") / 10 - 2)


@query(POPULATIONS + "SELECT population, id, rank, score, row_number() OVER (ORDER BY score DESC, CASE WHEN population = 'history' THEN 0 ELSE 1 END, id)::int AS position FROM judged WHERE score >= -0.8")
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merged(_populations(spark, sf_dir)).select("population", "id", F.col("rank").cast("long").alias("rank"), "score", "position")


@query(POPULATIONS + "SELECT population, id, rank, row_number() OVER (ORDER BY rank, CASE WHEN population = 'history' THEN 0 ELSE 1 END, id)::int AS position FROM judged")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.interleaved(_populations(spark, sf_dir).drop("score")).select("population", "id", F.col("rank").cast("long").alias("rank"), "position")


@query(
    POPULATIONS
    + """SELECT id, rank, CASE WHEN id % 3 <> 0 THEN score END AS rerank, row_number() OVER (ORDER BY id % 3 = 0, CASE WHEN id % 3 <> 0 THEN score END DESC, rank)::int AS position FROM judged WHERE population = 'history'"""
)
def reorder_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _populations(spark, sf_dir).where("population = 'history'").select("id", F.col("rank").cast("long").alias("rank"), "score")
    return fusion.reordered(history.select("id", "rank"), history.where("id % 3 <> 0").select("id", "score"), "id").select("id", "rank", "rerank", "position")


@query(
    bm25_sql(["idiot", "clown", "worthless", "trash"])
    + """, paths AS (SELECT s.doc_id AS chunk, d.source AS path, score FROM scored s JOIN documents d USING (doc_id)),
    la AS (SELECT path, min(rank) AS rank FROM (SELECT path, row_number() OVER (ORDER BY score DESC, chunk) AS rank FROM paths) WHERE rank <= 40 AND (starts_with(path, 'src1') OR starts_with(path, 'src2')) GROUP BY path),
    lv AS (SELECT b.vec_id AS chunk, 'src' || (b.vec_id % 20) AS path, round("""
    + DOT
    + """, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0),
    lb AS (SELECT path, min(rank) AS rank FROM (SELECT path, row_number() OVER (ORDER BY score DESC, chunk) AS rank FROM lv) WHERE rank <= 40 AND (starts_with(path, 'src1') OR starts_with(path, 'src2')) GROUP BY path)
    SELECT path, round(sum(1::double / (60 + rank)), 6) AS score FROM (SELECT * FROM la UNION ALL SELECT * FROM lb) GROUP BY path ORDER BY score DESC, path LIMIT 5"""
)
def page_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words, _ = _lanes(spark, sf_dir)
    chunks = words.join(docs.select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("chunk"), F.col("source").alias("path"), "score")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), "embedding")
    near = dense.dense_topk(vectors, _probe(spark, sf_dir), "chunk", "embedding", 40)
    near = near.select("chunk", F.concat(F.lit("src"), (F.col("chunk") % 20).cast("string")).alias("path"), "score")
    return fusion.page_shortlist([chunks, near], ["src1", "src2"], 5)
