"""Reconciliation: what an ingest writes, keeps or sweeps; differences of snapshots; key look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import in_scope


def rows_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One digest per key of its rows, whatever their order: the hash of the sorted digests of its shares,
    each the hash of the sorted row hashes that begin alike.  No list is longer than a key's 65,536th part,
    or 65,536 digests."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    shares = rows.select(key, row.alias("_row")).groupBy(key, F.substring("_row", 1, 4).alias("_share")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_row")), "\n"), 256).alias("_digest"), F.count("*").alias("_n"))
    return shares.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_digest")), "\n"), 256).alias("rows_sha256"), F.sum("_n").alias("n_rows"))


def ingest_actions(stored: DataFrame, arriving: DataFrame, key: str, digest: str, group: str, full: bool = True) -> DataFrame:
    """Per key ``unchanged``, ``write`` or ``sweep``.  Only a full ingest sweeps, and only groups that
    it brought something of."""
    new = arriving.select(key, F.col(digest).alias("_new"), F.col(group).alias("_new_group"))
    old = stored.select(key, F.col(digest).alias("_old"), F.col(group).alias("_old_group"))
    brought = arriving.select(F.col(group).alias("_old_group")).distinct().withColumn("_brought", F.lit(True))
    both = old.join(new, key, "full").join(brought, "_old_group", "left")
    action = F.when(F.col("_new").isNull(), F.when(F.lit(full) & F.coalesce("_brought", F.lit(False)), "sweep").otherwise("keep")).when(F.col("_new") == F.col("_old"), "unchanged").otherwise("write")
    return both.select(key, F.coalesce("_new_group", "_old_group").alias(group), action.alias("action"))


def replaced(stored: DataFrame, arriving: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """The stored rows after an ingest: rows of written and swept keys go, written rows come."""
    touched = actions.where(F.col("action").isin("write", "sweep")).select(key)
    fresh = arriving.join(actions.where("action = 'write'").select(key), key, "left_semi")
    return stored.join(touched, key, "left_anti").unionByName(fresh)


def parity(test: DataFrame, live: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that two snapshots disagree on: ``only_test``, ``only_live`` or ``changed``."""
    a, b = test.select(key, F.col(digest).alias("_a")), live.select(key, F.col(digest).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "only_test").when(F.col("_a").isNull(), "only_live").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, kind.alias("difference")).where("difference IS NOT NULL")


def parity_summary(differences: DataFrame, key: str, sample: int = 3) -> DataFrame:
    """Count and smallest keys of each difference; the sample is kept while counting."""
    from pyspark.sql import Window as W

    counts = differences.groupBy("difference").agg(F.count("*").alias("n"))
    first = differences.withColumn("_nth", F.row_number().over(W.partitionBy("difference").orderBy(key))).where(F.col("_nth") <= sample)
    samples = first.groupBy("difference").agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return counts.join(samples, "difference")


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; the smallest of equally frequent ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(key).agg(F.max("_n").alias("_most"))
    return counts.join(best, key).where("_n = _most").groupBy(key).agg(F.min(value).alias(value), F.first("_most").alias("n"))


def longest_prefix(rows: DataFrame, path_col: str, aliases: DataFrame, at_col: str | None = None) -> DataFrame:
    """Paths renamed by the longest alias that holds them; an alias with ``until`` only holds rows
    before it.  aliases: old, new, until.

    A path is sent once under each of its own folders, so that aliases of any number meet it by equality."""
    parts = F.split(F.rtrim(F.col(path_col), F.lit("/")), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    paths = rows.select(path_col, *([at_col] if at_col else [])).where(F.col(path_col).isNotNull()).distinct()
    named = paths.withColumn("_old", F.explode(folders)).join(aliases.withColumn("_old", F.rtrim("old", F.lit("/"))).where("_old <> ''"), "_old")
    if at_col:
        named = named.where(F.col("until").isNull() | F.col(at_col).isNull() | (F.col(at_col) < F.col("until")))
    best = named.groupBy(*paths.columns).agg(F.max_by(F.struct("_old", "new"), F.length("_old")).alias("_alias"))
    same = F.col(path_col) == F.col("_path")
    best = best.withColumnRenamed(path_col, "_path")
    if at_col:
        best, same = best.withColumnRenamed(at_col, "_at"), same & F.col(at_col).eqNullSafe(F.col("_at"))
    renamed = F.concat(F.col("_alias.new"), F.substr(F.col(path_col), F.length("_alias._old") + 1))
    return rows.join(best, same, "left").withColumn("renamed", F.coalesce(renamed, F.col(path_col))).drop("_alias", "_path", "_at")


def first_resolving(links: DataFrame, known: DataFrame, id_col: str, candidates_col: str, key: str) -> DataFrame:
    """The first candidate of each link that exists; links that none resolves are left out."""
    each = links.select(id_col, F.posexplode(candidates_col).alias("_pos", key))
    hit = each.join(known.select(key).distinct(), key, "left_semi")
    return hit.groupBy(id_col).agg(F.min(F.struct("_pos", key)).alias("_hit")).select(id_col, F.col("_hit._pos").alias("position"), F.col(f"_hit.{key}").alias(key))


def coverage(expected: DataFrame, present: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Counts of a set's coverage: missing, extra, excluded and wrongly present keys."""
    want, have, out = (d.select(key).distinct() for d in (expected, present, excluded))
    parts = {
        "expected": want.join(out, key, "left_anti"),
        "missing": want.join(out, key, "left_anti").join(have, key, "left_anti"),
        "extra": have.join(want, key, "left_anti"),
        "excluded": want.join(out, key, "left_semi"),
        "excluded_present": have.join(out, key, "left_semi"),
    }
    frame = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
        frame = one if frame is None else frame.unionByName(one)
    return frame


def first_writer_wins(stored: DataFrame, arriving: DataFrame, key: str, order: str) -> DataFrame:
    """Arriving rows that a registry of immutable rows takes: new keys, once each, the first in order."""
    from pyspark.sql import Window as W

    fresh = arriving.join(stored.select(key), key, "left_anti")
    return fresh.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_nth = 1").drop("_nth")


def decoded_segments(segments: DataFrame, folders: DataFrame, segment: str, folder: str, home: str) -> DataFrame:
    """Segments with the one known folder below home that encodes to them; null if none or several do.

    Folders are a table, so that the answer depends on no machine's disk."""
    from quarry.functions.paths import encoded

    inside = folders.where(in_scope(F.col(folder), home)).select(encoded(F.col(folder)).alias(segment), F.col(folder).alias("_folder")).distinct()
    single = inside.groupBy(segment).agg(F.count("*").alias("_n"), F.min("_folder").alias("folder")).where("_n = 1").drop("_n")
    return segments.join(single, segment, "left")


def project_roots(paths: DataFrame, roots: DataFrame, path_col: str, home: str) -> DataFrame:
    """The nearest folder at or above each path that is a repository, in canonical form and without a
    worktree's own part; null if there is none.  A path meets roots by equality of its folders."""
    from quarry.functions.paths import WORKTREES, canonical

    parts = F.split(F.rtrim(F.col(path_col), F.lit("/")), "/")
    each = paths.select(path_col).distinct().select(path_col, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("root"))
    near = each.join(roots.select("root").distinct(), "root").groupBy(path_col).agg(F.max_by("root", F.length("root")).alias("_root"))
    bare = F.regexp_replace(canonical(F.col("_root"), home), rf"/{WORKTREES.replace('.', '[.]')}(?:/.*)?$", "")
    return paths.join(near.select(path_col, bare.alias("project_root")), path_col, "left")


def metadata_upserts(stored: DataFrame, arriving: DataFrame, key: str, value: str) -> DataFrame:
    """What a metadata table has to do per key: ``write`` what differs, ``delete`` what has become unknown."""
    both = arriving.select(key, F.col(value).alias("_new")).join(stored.select(key, F.col(value).alias("_old")), key, "left")
    action = F.when(F.col("_new").isNull(), F.when(F.col("_old").isNotNull(), "delete")).when(~F.col("_new").eqNullSafe(F.col("_old")), "write")
    return both.select(key, action.alias("action")).where("action IS NOT NULL")


def sampled_membership(rows: DataFrame, known: DataFrame, id_col: str, cited: str, size: int) -> DataFrame:
    """A fixed random sample of rows with ``known``, whether what they cite exists."""
    order = F.sha2(F.concat(F.lit("membership:"), F.col(id_col).cast("string")), 256)
    sample = rows.select(id_col, cited, order.alias("_order")).orderBy("_order", id_col).limit(size)
    marks = known.select(cited).distinct().withColumn("_there", F.lit(True))
    return marks.join(F.broadcast(sample), cited, "right").withColumn("known", F.coalesce("_there", F.lit(False))).drop("_there", "_order")  # the sample's rows
