"""Readers, writers and the facade over small files."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.engine import Engine
from quarry.operators import lexical
from quarry.operators.word_index import WordIndex
from quarry.sources import readers, writers
from quarry.streaming import streams


def test_archive(spark, tmp_path):
    lines = [{"kind": "manifest", "schemaVersion": 2}, {"id": "c1", "source": "x", "startedAt": "2026-01-01", "events": [{"id": "e1", "kind": "message", "role": "user", "text": "hi"}], "provenance": {"contentSha256": "s"}, "hosts": ["b", "a", "b"]}]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    rows = readers.archive_events(readers.archive(spark, str(tmp_path / "a.jsonl"))).collect()
    assert [(r.conversation_id, r.event_id, r.authored_at, r.hosts) for r in rows] == [("c1", "e1", "2026-01-01", ["a", "b"])]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.archive(spark, str(tmp_path / "b.jsonl")).collect()


def test_notes(spark, tmp_path):
    for name in ("a.md", "sub/b.md", ".hidden/c.md", "node_modules/d.md", "skip/e.md", "f.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    assert sorted(r.path for r in readers.notes(spark, str(tmp_path), ("skip",)).collect()) == ["a.md", "sub/b.md"]


def test_registry_and_logs(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/1.json").write_text(json.dumps({"job_key": "k", "output": {"facts": ["a"]}}, indent=1))
    (tmp_path / "r/2.json").write_text("{torn")
    assert [(r.job_key, r.file) for r in readers.registry(spark, str(tmp_path / "r")).collect()] == [("k", "1.json")]
    assert readers.registry_files(spark, str(tmp_path / "r")).count() == 2
    (tmp_path / "2026-01-02.jsonl").write_text('{"query": "q", "evidence": []}\n{torn\n')
    assert readers.query_log(spark, str(tmp_path), 3, date(2026, 1, 3)).count() == 1
    assert readers.query_log(spark, str(tmp_path), 1, date(2025, 1, 3)).count() == 0
    assert readers.ledger(spark, str(tmp_path / "none"), T.StructType([T.StructField("x", T.StringType())])).count() == 0
    (tmp_path / "log").write_text("2026-01-01 00:00:00 pass start: night --model m\nnoise\n2026-01-01 01:00:00 pass done: night exit 124; synthesized 3\n")
    assert [(r.kind, r.lane, r.code) for r in readers.pass_log(spark, str(tmp_path / "log")).orderBy("stamp").collect()] == [("start", "night", None), ("done", "night", 124)]


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, d string, g string, v string")
    frame([(1, "a", "p", "one"), (2, "b", "p", "two"), (3, "c", "q", "three")]).write.parquet(path)
    writers.replace_by_key(path, frame([(1, "a", "p", "changed nothing"), (4, "x", "p", "four")]), "k", "d", "g")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "one"), (3, "three"), (4, "four")]
    writers.append_new(path, frame([(4, "y", "p", "late"), (5, "z", "p", "first"), (5, "z", "p", "second")]), "k", "v")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect())[-2:] == [(4, "four"), (5, "first")]
    writers.erase(path, "k", spark.createDataFrame([(3,)], "k int"))
    assert 3 not in {r.k for r in spark.read.parquet(path).collect()}
    writers.write_ledger(str(tmp_path / "l"), spark.read.parquet(path), "k")
    assert [json.loads(r.value)["k"] for r in spark.read.text(str(tmp_path / "l")).collect()] == [1, 4, 5]
    writers.append_daily(str(tmp_path / "d"), spark.createDataFrame([(datetime(2026, 1, 2), "x")], "ts timestamp, lane string"), "ts")
    assert (tmp_path / "d/day=2026-01-02").is_dir()


def test_engine(spark):
    rows = [("1", "user", "the red apple pie", "/a/b", "2024-01-01"), ("2", "assistant", "The  red APPLE pie", "/a/b", "2024-01-02"), ("3", "user", "green apple of redis", "/a/c", "2024-01-03"), ("4", "source", "apple red red", "/x", None), ("5", "note", "nothing", "/x", None)]
    records = spark.createDataFrame(rows, "record_id string, role string, text string, workspace string, authored_at string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("3", [0.0, 1.0])], "record_id string, vector array<float>")
    engine = Engine(records, vectors)
    assert {r.record_id for r in engine.search("red apple", "words").collect()} == {"1", "2", "3", "4"}
    assert [r.record_id for r in engine.search("appl", "substring", scope="/x").collect()] == ["4"]
    assert [r.record_id for r in engine.search("x", "dense", vector=[0.0, 1.0], limit=1).collect()] == ["3"]
    found = engine.context("red apple", vector=[0.0, 1.0], retirements=[(["redis"], "2025-01-01")]).collect()
    assert [r.record_id for r in found][-1] == "3" and found[-1].outdated and len(found) == 2
    assert [r.record_id for r in engine.recall("/a", 2).collect()] == ["3", "2"]
    for bad in ({"query": " "}, {"query": "x", "limit": 0}, {"query": "x", "lane": "none"}):
        with pytest.raises(ValueError):
            engine.search(**bad)


def test_stream_is_exactly_the_batch(spark, sf):
    events = streams.event_stream(spark, f"{sf}/events.parquet")
    assert streams.run_available(spark, streams.tumbling(events)).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_swaps_recover(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, d string, g string, v string")
    frame([(1, "a", "p", "old")]).write.parquet(f"{path}.swap-x.old")
    assert writers.recover(spark, path) == "undone" and spark.read.parquet(path).first().v == "old"
    frame([(1, "a", "p", "new")]).write.parquet(f"{tmp_path}/u.swap-x.new")
    frame([(1, "a", "p", "old")]).write.parquet(f"{tmp_path}/u.swap-x.old")
    assert writers.recover(spark, f"{tmp_path}/u") == "finished" and spark.read.parquet(f"{tmp_path}/u").first().v == "new"
    assert writers.recover(spark, path) is None and not list(tmp_path.glob("*.swap-*"))
    before = sorted(p.name for p in (tmp_path / "t").glob("part-*"))
    actions = writers.replace_by_key(path, frame([(1, "a", "p", "same")]), "k", "d", "g")
    assert [r.action for r in actions.collect()] == ["unchanged"] and sorted(p.name for p in (tmp_path / "t").glob("part-*")) == before


def test_published_documents_and_metadata(spark, tmp_path):
    for n in (1, 2):
        writers.publish_json(spark, str(tmp_path / "status.json"), {"n": n, "é": "x"})
        assert json.loads((tmp_path / "status.json").read_text()) == {"n": n, "é": "x"}
    path = str(tmp_path / "m")
    meta = lambda rows: spark.createDataFrame(rows, "k int, v string")
    meta([(1, "a"), (2, "b"), (3, "c")]).write.parquet(path)
    writers.write_metadata(path, meta([(1, "a"), (2, "x"), (3, None), (4, "d"), (5, None)]), "k", "v")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "x"), (4, "d")]


def test_claims_and_vectors_resume(spark, tmp_path):
    path = str(tmp_path / "claims")
    claims = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    writers.append_claims(path, claims.where("id = 'a'"), "id")
    (tmp_path / "claims/torn.json").write_text('{"id": "b", "n"')
    writers.append_claims(path, claims, "id")
    assert sorted(r.id for r in writers.done_keys(spark, path, "id").collect()) == ["a", "b"]
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    embed = lambda rows: rows.selectExpr("id", "array(1f, 0f) AS vector")
    assert [writers.resume_vectors(str(tmp_path / "v"), t, "id", embed) for t in (texts.limit(1), texts, texts)] == [1, 1, 0]
    vectors = spark.read.parquet(str(tmp_path / "v"))
    writers.save_vectors(str(tmp_path / "m"), vectors, "g1")
    assert writers.load_vectors(spark, str(tmp_path / "m"), "g1").count() == 2
    assert writers.load_vectors(spark, str(tmp_path / "m"), "g2") is None and writers.load_vectors(spark, str(tmp_path / "none"), "g1") is None
    texts.write.parquet(str(tmp_path / "bad"))
    assert writers.load_vectors(spark, str(tmp_path / "bad"), "g1") is None


def test_tails_stubs_and_snapshots(spark, tmp_path):
    (tmp_path / "log").write_text("first line\nsecond\nthird é\n")
    assert readers.log_tail(spark, str(tmp_path / "log"), 12) == ["third é"]
    assert readers.log_tail(spark, str(tmp_path / "log"), 16) == ["second", "third é"]
    assert readers.log_tail(spark, str(tmp_path / "log")) == ["first line", "second", "third é"] and readers.log_tail(spark, str(tmp_path / "none")) == []
    lines = [{"kind": "manifest"}] + [{"id": f"c{i}", "source": "x", "startedAt": f"2026-01-0{i}", "updatedAt": u, "events": [], "provenance": {"contentSha256": "s"}} for i, u in ((1, "2026-02-01"), (2, None), (3, None))]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    stubs = readers.newest_conversations(spark, str(tmp_path / "a.jsonl"))
    assert [r.id for r in stubs.collect()] == ["c1", "c3", "c2"]
    assert [r.id for r in readers.conversation_bodies(spark, str(tmp_path / "a.jsonl"), stubs.limit(1)).collect()] == ["c1"]
    records = spark.createDataFrame([("1", "note", "same"), ("2", "synthesis", "same"), ("3", "note", "password: hunter2hunter2"), ("4", "user", "x"), ("5", "note", "long")], "record_id string, role string, text string")
    vectors = spark.createDataFrame([("1", [0.6, 0.8]), ("2", [1.0, 0.0]), ("3", [1.0, 0.0]), ("4", [1.0, 0.0]), ("5", [2.0, 0.0])], "record_id string, vector array<float>")
    found = readers.semantic_snapshot(records, vectors).collect()
    assert sorted((r.record_id, round(r.vector[0], 3)) for r in found) == [("1", 0.6), ("2", 0.6)]


def test_late_rows_and_batches(spark, tmp_path):
    """Rows behind the watermark are left out, state goes from batch to batch, and ingest takes files once."""
    schema = "ts timestamp, event_type string, user_id long, value double"
    root = tmp_path / "in"
    for n, days in enumerate(([10, 11], [12], [1, 12], [20])):
        rows = [(datetime(2026, 1, d, 12), "x", 7, 1.0) for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/part={n}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(root)).withWatermark("ts", "2 days")
    windows = streams.run_available(spark, streams.tumbling(stream()), "append").collect()
    assert sorted((r.start.day, r.n) for r in windows) == [(10, 1), (11, 1), (12, 2)]
    totals = streams.run_available(spark, streams.running_totals(stream()), "update").collect()
    assert sorted(r.n for r in totals) == [2, 3, 5, 6]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    take = lambda batch: batch.write.mode("append").parquet(out)
    for _ in range(2):
        streams.ingest_stream(stream(), take, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 6
    spark.createDataFrame([(datetime(2026, 1, 21), "x", 8, 1.0)], schema).coalesce(1).write.parquet(f"{root}/part=9")
    streams.ingest_stream(stream(), take, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_context_of_two_populations(spark):
    rows = [("h1", "user", "red apple pie", "/a", "2024-01-01"), ("h2", "assistant", "red apple jam", "/a", "2024-01-02"), ("h3", "user", "red apple tart", "/b", "2024-01-03"), ("n1", "note", "apple red note", "/x", "2024-02-01"), ("n2", "note", "second red apple note", "/x", "2024-02-02"), ("l1", "note", "linked text", "/x", None), ("s1", "source", "red apple source", "/a", None)]
    records = spark.createDataFrame(rows, "record_id string, role string, text string, workspace string, authored_at string")
    links = spark.createDataFrame([("n1", "l1", 0), ("n1", "h1", 1), ("gone", "l1", 0)], "parent string, id string, ordinal int")
    old = spark.createDataFrame([("h1", "h2", "2024-03-01")], "id string, superseded_by string, at string")
    hosts = spark.createDataFrame([("h2", ["m"])], "id string, hosts array<string>")
    engine = Engine(records)
    found = engine.context("red apple", scope="/a", links=links, supersessions=old, hosts=hosts).collect()
    assert [r.record_id for r in found] == ["n1", "l1", "h2", "n2", "h1"] or [r.record_id for r in found][-1] == "h1"
    by = {r.record_id: r for r in found}
    assert set(by) == {"h1", "h2", "n1", "n2", "l1"} and by["l1"].parent == "n1" and by["l1"].via == "link"
    assert by["h1"].superseded_by == "h2" and by["h2"].hosts == ["m"] and by["n1"].hosts is None
    judged = engine.context("red apple", scope="/a", reranker=lambda text, query: F.when(F.contains(text, F.lit("second")), 5.0).when(F.contains(text, F.lit("jam")), 1.0).otherwise(-2.0)).collect()
    assert [r.record_id for r in judged] == ["n2", "h2"]
    named = engine.context("apple pie", retirements=[(["pie"], "2030-01-01")]).collect()
    assert not any(r.outdated for r in named)
    more, outcome = engine.remember(spark.createDataFrame([("r1", "synthesis", "new red apple", "/a", "2025-01-01", ["h1"]), ("r2", "synthesis", "x", "/a", None, ["nope"])], "record_id string, role string, text string, workspace string, authored_at string, supersedes array<string>"))
    assert {r.record_id: (r.outcome, r.missing) for r in outcome.collect()} == {"r1": ("remembered", None), "r2": ("refused", ["nope"])} and more.records.count() == 8


def test_file_phrases(spark):
    assert [lexical.file_phrase(p) for p in ("src/reader.py", "src/pay/index.ts", "README.md", "a/README.md", "./main.py", "")] == ["reader.py", "pay/index.ts", None, "a/README.md", None, None]
    rows = [("1", "user", "see pay/index.ts", "/a", "2024-01-01"), ("2", "user", "see index.ts of ship", "/a", "2024-01-02")]
    engine = Engine(spark.createDataFrame(rows, "record_id string, role string, text string, workspace string, authored_at string"))
    assert [r.record_id for r in engine.file_context("src/pay/index.ts").collect()] == ["1"] and engine.file_context("index.ts").count() == 0


def test_engine_with_an_index_answers_alike(spark, tmp_path):
    rows = [(str(i), ("user", "assistant", "note")[i % 3], f"red apple {'pie ' * (i % 4)}{'jam' if i % 5 else ''}", f"/w/{i % 2}", f"2024-01-{i % 28 + 1:02d}") for i in range(40)]
    records = spark.createDataFrame(rows, "record_id string, role string, text string, workspace string, authored_at string")
    index = WordIndex.build(records, "record_id", "text", str(tmp_path / "index"))
    plain, fast = Engine(records), Engine(records, None, index)
    for scope in (None, "/w/1"):
        assert [tuple(r) for r in plain.search("pie jam", "words", 7, scope).collect()] == [tuple(r) for r in fast.search("pie jam", "words", 7, scope).collect()]
        assert [r.record_id for r in plain.context("pie jam", scope).collect()] == [r.record_id for r in fast.context("pie jam", scope).collect()]
    assert index.orphans().first().wrong_lengths == 0
    assert readers.written_at(spark, str(tmp_path / "index")).first().files > 2
    (tmp_path / "r").mkdir()
    for n in range(3):
        (tmp_path / f"r/{n}.json").write_text("{}")
    assert readers.registry_files(spark, str(tmp_path / "r"), 2).count() == 2


def test_index_holds_a_token_once_a_run(spark, tmp_path, monkeypatch):
    """Postings are grouped where texts are read, whatever the runs, and say what a scan says."""
    from collections import Counter

    from quarry.operators import word_index

    texts = [(f"d{i}", " ".join(f"w{(i * j) % (3 + i % 5)}" for j in range(i % 9)) or None) for i in range(300)] + [("long", "w1 W2 w1 é " * 700), ("", "w1")]
    docs = spark.createDataFrame(texts, "id string, t string").coalesce(1)
    index = WordIndex.build(docs, "id", "t", str(tmp_path / "one"))
    assert index.orphans().first().asDict() == {"texts": 302, "texts_with_postings": sum(bool(t) for _, t in texts), "unknown_texts": 0, "wrong_lengths": 0}
    assert spark.read.parquet(str(tmp_path / "one/postings")).count() == len({w for _, t in texts if t for w in t.lower().split()})
    want = {(w, i, len(t.split()), tuple(n for n, x in enumerate(t.lower().split()) if x == w)) for i, t in texts if t for w in ("w1", "w2", "é") if w in t.lower().split()}
    assert {(r.tok, r.id, r.dl, tuple(r["at"])) for r in index.postings(["w1", "w2", "é"]).collect()} == want
    monkeypatch.setattr(word_index, "RUN", 50)
    found = [b for b in word_index.blocks(iter(docs.selectExpr("id", "filter(split(lower(coalesce(t, '')), ' '), x -> x <> '') AS toks").toArrow().to_batches()))]
    flat = [(tok, i, dl, tuple(at[(ends[n - 1] if n else 0) : ends[n]])) for b in found for tok, ids, dls, ends, at in zip(*(c.to_pylist() for c in b.columns), strict=True) for n, (i, dl) in enumerate(zip(ids, dls, strict=True))]
    assert len(found) > 10 and max(Counter(flat).values()) == 1 and {x for x in flat if x[0] in ("w1", "w2", "é")} == want


def test_updated_index_leaves_what_did_not_change(spark, tmp_path):
    """An ingest writes its own texts alone, again and again, and answers as one index of all would."""
    docs = spark.createDataFrame([(i, f"red apple w{i % 7} " * (1 + i % 4)) for i in range(200)] + [(200, None)], "id long, t string")
    one = WordIndex.build(docs, "id", "t", str(tmp_path / "one"))
    changed = spark.createDataFrame([(3, "red pear"), (4, None), (500, "apple pear w1")], "id long, t string")
    two = one.updated(changed, spark.createDataFrame([(7,), (999,)], "id long"), "id", "t", str(tmp_path / "two"))
    three = two.updated(spark.createDataFrame([(500, "plum"), (8, "pear red apple")], "id long, t string"), spark.createDataFrame([(3,)], "id long"), "id", "t", str(tmp_path / "three"))
    now = docs.where("id NOT IN (3, 4, 7, 8)").unionByName(spark.createDataFrame([(4, None), (500, "plum"), (8, "pear red apple")], "id long, t string"))
    whole = WordIndex.build(now, "id", "t", str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "two/texts")).count() == 3 and spark.read.parquet(str(tmp_path / "three/postings")).count() == 4
    for ask in (lambda x: x.frequencies(["red", "pear", "apple", "plum"]), lambda x: x.search([["red"], ["pear"]], 300), lambda x: x.phrase(["red", "apple"]), lambda x: x.substring("pple", 300), lambda x: x.orphans()):
        assert sorted(map(tuple, ask(three).collect())) == sorted(map(tuple, ask(whole).collect()))
    assert (three.n_docs, three.mean_words, three.mean_grams) == (whole.n_docs, whole.mean_words, whole.mean_grams)


def test_running_totals_are_summed_before_they_are_sent(spark, tmp_path):
    """No row goes to Python, and a user without values has no total, as in SQL."""
    schema = "ts timestamp, event_type string, user_id long, value double"
    root = tmp_path / "in"
    for n, values in enumerate(([(1, 0.5), (2, None), (None, 1.0)], [(1, 2.0), (1, None), (2, None)])):
        spark.createDataFrame([(datetime(2026, 1, 1 + n), "x", u, v) for u, v in values], schema).coalesce(1).write.parquet(f"{root}/part={n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(root)).withWatermark("ts", "2 days")
    totals = streams.running_totals(stream)
    assert "InPandas" not in totals._jdf.queryExecution().analyzed().toString()
    found = streams.run_available(spark, totals, "update").collect()
    assert sorted((str(r.user_id), r.n, r.total) for r in found) == [("1", 1, 0.5), ("1", 3, 2.5), ("2", 1, None), ("2", 2, None), ("None", 1, 1.0)]
