"""Notes, payloads, sessions and reranking on hand-made rows."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.functions import records
from quarry.operators import rerank, sessions


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_retirements(spark):
    note = "---\ntitle: x\nretired:\n  since: 2024-05-01\n  terms: [Redis, 'old cache']\n  replaced_by: \"valkey\"\n---\nbody"
    r = one(spark, records.retirement(F.col("t")), t=note)
    assert (r.terms, r.since, r.replaced_by) == (["Redis", "old cache"], "2024-05-01", "valkey")
    assert one(spark, records.retirement(F.col("t")), t="retired:\n  since: soon\n  terms: [a]\n") is None
    assert one(spark, records.retirement(F.col("t")), t="none") is None


def test_descriptors(spark):
    note = "---\ntitle: 'A page'\nsummary: first\n  second line\nother: x\n---\nbody"
    assert one(spark, records.page_descriptor(F.col("t"), F.lit("p.md")), t=note) == "A page -- first second line"
    assert one(spark, records.page_descriptor(F.col("t"), F.lit("p.md")), t="no matter") == "p.md"


def test_table_cells(spark):
    assert one(spark, records.table_cells(F.col("t")), t=r"| a | b\|c | d\\|e") == ["", " a ", r" b\|c ", " d\\\\", "e"]


def test_payloads(spark):
    read = lambda t: one(spark, records.payload(F.col("t")), t=t)
    good = read('{"title": " t ", "summary": "s", "facts": ["a ", " "], "open_ends": []}')
    assert (good.title, good.facts, good.open_ends) == ("t", ["a"], [])
    assert read('{"title": "", "summary": "s", "facts": [], "open_ends": []}') is None
    assert read('{"title": "t", "summary": "s", "facts": [], "open_ends": [], "more": 1}') is None and read("torn") is None


def test_warnings(spark):
    assert one(spark, records.degraded(F.col("w")), w=["no_matches", "rerank_failed"]) and not one(spark, records.degraded(F.col("w")), w=["no_matches"])


def test_sessions(spark):
    schema = "session string, offset long, kind string, model string, size long, parts array<struct<type:string,name:string,command:string>>"
    lines = [("s", 1, "user", None, 10, [("text", None, None)]), ("s", 2, "assistant", "m1", 20, [("tool_use", "Edit", None), ("tool_use", "Bash", "git -C x commit -m y"), ("tool_use", "Bash", "ls")]), ("s", 3, "user", None, 5, [("text", None, None), ("tool_result", None, None)]), ("s", 4, "assistant", "m2", 1, None)]
    r = sessions.scanned(spark.createDataFrame(lines, schema)).first()
    assert (r.prompts, r.bytes, r.edits, r.boundary, r.model) == (1, 36, 2, 4, "m2")
    over = lambda p, b, age: one(spark, sessions.over_limits(F.col("p"), F.col("b"), F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit(f"2024-01-01 0{age}:00:00"))), p=p, b=b)
    assert over(10, 0, 0) and over(1, 5000, 3) and not over(1, 5000, 1) and not over(0, 5000, 3)
    events = spark.createDataFrame([("a", "user", "JOB one"), ("a", "user", "NOTE x"), ("b", "user", "JOB"), ("b", "user", "hello"), ("c", "user", "NOTE")], "episode string, role string, text string")
    assert [r.episode for r in sessions.machine_job_episodes(events, ("JOB",), ("NOTE",)).collect()] == ["a"]


def test_reranking(spark):
    rows = spark.createDataFrame([(1, 1, "red apple"), (2, 2, "apple"), (3, 3, None)], "id long, rank int, t string")
    assert {r.id: r.score for r in rerank.overlap_scores(rows, "Red Apple", "t").collect()} == {1: 1.0, 2: 0.0, 3: -1.0}
    assert {r.id: r.score for r in rerank.model_scores(rows, "id", "t", lambda ts: [float(len(t or "")) for t in ts], 2).collect()} == {1: 9.0, 2: 5.0}
