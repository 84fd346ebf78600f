"""Lexical lanes: postings, document frequency, BM25, conjunctive and broad passes, phrases, substrings.

The lanes scan: a projection counts each query term in a row's tokens, one aggregate gathers the
corpus statistics, and one row of statistics is broadcast.  No row is exploded and only the top rows
are sorted, so a query costs one pass over two columns.  ``postings`` builds the inverted index as a
table for repeated use.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fold, tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6
MAX_TERMS, SELECTIVE_SHARE, BROAD_TERMS, MIN_FRAGMENT = 128, 0.01, 32, 3


def query_terms(query: str) -> list[list[str]]:
    """The query's terms in order, each a list of adjacent parts (one part: a word; more: a phrase)."""
    terms: list[list[str]] = []
    for raw in query.split():
        parts = [p.lower() for p in re.findall(r"[^\W_]+", raw)]
        if parts and (len(parts) > 1 or len(parts[0]) > 1 or len(raw) > len(parts[0])) and parts not in terms:
            terms.append(parts)
    return terms[:MAX_TERMS]


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index: ``tok``, id, ``tf``, ``dl``; an empty text has no postings."""
    rows = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("toks")).withColumn("dl", F.size("toks"))
    return rows.select(id_col, "dl", F.explode("toks").alias("tok")).groupBy("tok", id_col).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def token_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """Documents and occurrences of every token.

    A row sends each token once with a mark and each occurrence without, so that one exchange with
    partial sums carries distinct tokens per task and never pairs of document and token."""
    toks = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    marked = lambda a, mark: F.transform(a, lambda t: F.struct(t.alias("tok"), F.lit(mark).alias("once")))
    flat = docs.select(toks.alias("toks")).select(F.explode(F.concat(marked(F.array_distinct("toks"), 1), marked(F.col("toks"), 0))).alias("p"))
    return flat.groupBy(F.col("p.tok").alias("tok")).agg(F.sum("p.once").cast("long").alias("df"), (F.count("*") - F.sum("p.once")).cast("long").alias("cf"))


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: list[list[str]]) -> DataFrame:
    """id, ``dl`` and ``tf`` (occurrences of each term, phrases of adjacent words) of every document."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    size = F.when(F.col("flat") == "", 0).otherwise(F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit(""))) + 1)
    rows = docs.select(F.col(id_col), flat.alias("flat")).select(id_col, size.alias("dl"), "flat")
    starts = [F.regexp_count("flat", F.lit(f"(?:^| )(?={' '.join(map(re.escape, t))}(?: |$))")) for t in terms]
    return rows.select(id_col, "dl", F.array(*starts).alias("tf"))


def with_bm25(counts: DataFrame, n_terms: int) -> DataFrame:
    """Counts with their BM25 ``score`` and ``matched`` terms; scores are rounded to six digits."""
    stats = counts.agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(n_terms))).alias("df")
    )
    rows = counts.where(F.exists("tf", lambda t: t > 0)).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(n_terms):
        tf, df = F.col("tf")[i].cast("double"), F.col("df")[i].cast("double")
        idf = F.greatest(F.log((F.col("n_docs") - df + 0.5) / (df + 0.5)), F.lit(FLOOR))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    matched = F.size(F.filter("tf", lambda t: t > 0))
    return rows.select(*[c for c in counts.columns if c not in ("tf", "dl")], F.round(score, 6).alias("score"), matched.alias("matched"))


def search_words(docs: DataFrame, id_col: str, text_col: str, query: str, limit: int = 20) -> DataFrame:
    """Top rows by BM25: rows that hold all terms (two or more) come before any others."""
    terms = query_terms(query)
    if not terms:
        return docs.select(F.col(id_col), F.lit(0).alias("lane_pass"), F.lit(0.0).alias("score")).limit(0)
    scored = with_bm25(term_counts(docs, id_col, text_col, terms), len(terms))
    lane = F.when((F.col("matched") == len(terms)) & F.lit(len(terms) > 1), 1).otherwise(2)
    return scored.select(id_col, lane.alias("lane_pass"), "score").orderBy("lane_pass", F.desc("score"), id_col).limit(limit)


def search_phrase(docs: DataFrame, id_col: str, text_col: str, phrase: str) -> DataFrame:
    """Documents that hold the words of a phrase next to each other, with how often."""
    parts = [p.lower() for p in re.findall(r"[^\W_]+", phrase)]
    if not parts:
        return docs.select(F.col(id_col), F.lit(0).alias("occurrences")).limit(0)
    return term_counts(docs, id_col, text_col, [parts]).select(id_col, F.col("tf")[0].alias("occurrences")).where("occurrences > 0")


def adjacency_pattern(term: str) -> str:
    """Regular expression of a punctuated term: its parts with only punctuation between them, as a word."""
    parts = [re.escape(p) for p in re.findall(r"[^\W_]+", term)]
    return r"(?i)(^|[^\w])" + r"(?:[^\w\s]|_)+".join(parts) + r"([^\w]|$)"


def verified(docs: DataFrame, text_col: str, query: str) -> DataFrame:
    """Rows that hold every punctuated term as written; applied only if every term is punctuated."""
    raw = [r for r in query.split() if re.findall(r"[^\W_]+", r)]
    if not raw or any(len(re.findall(r"[^\W_]+", r)) == 1 for r in raw):
        return docs
    for term in raw:
        docs = docs.where(fold(F.col(text_col)).rlike(adjacency_pattern(term)))
    return docs


def selective_terms(frequencies: DataFrame, n_docs: DataFrame, words: list[str], share: float = SELECTIVE_SHARE, most: int = BROAD_TERMS) -> DataFrame:
    """The words of a query worth scoring: those in at most a share of all documents (all words if none
    is), of these the rarest that occur, in query order."""
    wanted = frequencies.where(F.col("tok").isin(words)).join(F.broadcast(n_docs), how="cross")
    place = F.array_position(F.array(*(F.lit(w) for w in words)), F.col("tok"))
    known = wanted.select("tok", "df", place.alias("place"), (F.col("df") <= share * F.col("n_docs")).alias("rare"))
    from pyspark.sql import Window as W

    whole = W.partitionBy(F.lit(0))  # at most as many rows as the query has words
    absent = F.lit(len(set(words))) > F.count("*").over(whole)  # a word that no document has counts as rare
    kept = known.withColumn("any_rare", F.max("rare").over(whole) | absent).where("rare OR NOT any_rare")
    ranked = kept.withColumn("nth", F.row_number().over(W.orderBy("df", "place"))).where(F.col("nth") <= most)
    return ranked.select("tok", "df", "place").orderBy("place")


def search_substring(docs: DataFrame, id_col: str, text_col: str, fragment: str, limit: int = 20) -> DataFrame:
    """Top rows that hold a fragment of three characters or more anywhere, also inside words."""
    needle = fragment.lower()
    if len(needle) < MIN_FRAGMENT:
        return docs.select(F.col(id_col), F.lit(0).alias("occurrences"), F.lit(0.0).alias("score")).limit(0)
    low = F.lower(fold(F.coalesce(F.col(text_col), F.lit(""))))
    n = ((F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
    rows = docs.select(F.col(id_col), F.greatest(F.length(low) - 2, F.lit(0)).alias("dl"), F.array(n).alias("tf"), n.alias("occurrences"))
    return with_bm25(rows, 1).select(id_col, "occurrences", "score").orderBy(F.desc("score"), id_col).limit(limit)


def idf_overlap(docs: DataFrame, id_col: str, text_col: str, claim: str, limit: int = 20) -> DataFrame:
    """Documents by the summed ln(N / df) of the claim's words of four characters or more."""
    words = sorted({w for w in re.findall(r"[a-z0-9_]+", claim.lower()) if len(w) >= 4})
    if not words:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    has = F.array_distinct(F.regexp_extract_all(F.lower(fold(F.coalesce(F.col(text_col), F.lit("")))), F.lit("[a-z0-9_]+"), F.lit(0)))
    rows = docs.select(F.col(id_col), F.array(*(F.array_contains(has, w) for w in words)).alias("hit"))
    stats = rows.agg(F.count("*").alias("n_docs"), F.array(*(F.count_if(F.col("hit")[i]) for i in range(len(words)))).alias("df"))
    score = F.lit(0.0)
    for i in range(len(words)):
        score = score + F.when(F.col("hit")[i], F.log(F.col("n_docs") / F.col("df")[i])).otherwise(0.0)
    scored = rows.crossJoin(F.broadcast(stats)).select(id_col, F.round(score, 6).alias("score"))  # one row of statistics
    return scored.where("score > 0").orderBy(F.desc("score"), id_col).limit(limit)


def verified_passes(docs: DataFrame, id_col: str, text_col: str, query: str, limit: int) -> DataFrame:
    """Rows that hold punctuated terms as written: those with all terms (``lane_pass`` 1) before those with
    any.  One scan tests all terms."""
    raw = [r for r in query.split() if len(re.findall(r"[^\W_]+", r)) > 1]
    if not raw:
        return docs.select(id_col, F.lit(0).alias("lane_pass")).limit(0)
    # a cheap look for a term's first part spares most texts the pattern
    low = fold(F.coalesce(F.col(text_col), F.lit("")))
    has = [F.contains(F.lower(low), F.lit(re.findall(r"[^\W_]+", term)[0].lower())) & low.rlike(adjacency_pattern(term)) for term in raw]
    rows = docs.select(id_col, F.array(*has).alias("has")).where(F.exists("has", lambda h: h))
    lane = F.when(F.forall("has", lambda h: h) & F.lit(len(raw) > 1), 1).otherwise(2)
    return rows.select(id_col, lane.alias("lane_pass")).orderBy("lane_pass", id_col).limit(limit)


#: File names that many files have.
GENERIC_FILE_NAMES = (
    "__init__.py", "index.js", "index.ts", "index.tsx", "main.py", "main.go", "main.rs", "mod.rs", "lib.rs", "package.json", "readme.md", "todo.md", "todo_log.md",
    "agents.md", "claude.md", "config.json", "settings.json", "page.tsx", "layout.tsx", "route.ts", "utils.ts", "types.ts", "pyproject.toml", "cargo.toml", "makefile", "dockerfile",
)


def file_phrase(path: str) -> str | None:
    """The phrase by which texts name a file: its name, with its folder if many files have that name; a
    file of such a name at the root has none."""
    folder, _, name = path.rstrip("/").rpartition("/")
    if not name or name.lower() not in GENERIC_FILE_NAMES:
        return name or None
    parent = folder.rpartition("/")[2]
    return f"{parent}/{name}" if parent not in ("", ".") else None
