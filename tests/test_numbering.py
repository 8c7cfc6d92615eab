"""Numbering by ranges, bitmaps over codes, and documents made by many tasks, against plain Python."""

import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import distinct as D
from quern.operators import scoring as SC
from quern.operators import skills as K
from quern.operators.numbering import numbered
from quern.sources import files as FS


def test_places_by_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice([None, "é", "a", "b" * r.randrange(4), str(r.random())]), r.choice([None, *range(9)]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "s string, n int, i int").repartition(5)
    out = numbered(df, "s", "n", "i", rows_a_range=300)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number()" in plan and "[__range#" in plan  # no window over all rows
    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    assert [(x.s, x.n, x.i) for x in sorted(out.collect(), key=lambda x: x.no)] == sorted(rows, key=lambda x: tuple(map(low, x)))
    assert sorted(x.no for x in out.collect()) == list(range(5000))
    assert sorted(x.no for x in numbered(df.select("n"), "n", rows_a_range=200).collect()) == list(range(5000))  # ties, and a hot null
    assert numbered(df.limit(0), "s").collect() == []


def test_lines_and_indexes(spark, tmp_path):
    (tmp_path / "many.txt").write_text("".join(f"  line {i} \n" for i in range(30_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        got = FS.lines(spark, str(tmp_path / "many.txt"))
        assert got.rdd.getNumPartitions() > 4
        assert sorted((x.no, x.value) for x in got.collect()) == [(i, f"line {i}") for i in range(30_000)]
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "none.txt").write_text("")
    assert FS.lines(spark, str(tmp_path / "none.txt")).collect() == []
    values = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert sorted((x.no, x.v) for x in FS.indexed(values, "v").collect()) == [(0, None), (1, "a"), (2, "b")]
    assert sorted(x.no for x in FS.indexed(values, "v", ordered=False).collect()) == [0, 1, 2]


def test_choices_by_position_look_at_no_more_than_is_picked(spark):
    c = spark.createDataFrame([("a", 5, "x"), ("b", 9, "x"), ("c", 9, "x"), ("d", None, "x")], "skill string, lines long, choice string")
    out = K.update_choices(c, {2: "p", 4: "q", 9: "r", 0: "s", -1: "t"})
    assert {x.skill: x.choice for x in out.collect()} == {"a": "x", "b": "x", "c": "p", "d": "q"}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {x.choice for x in K.update_choices(c, {}).collect()} == {"x"}


def test_bitmaps_merge_exactly(spark):
    r = random.Random(5)
    rows = [(f"r{r.randrange(6)}", r.choice(["users", "skills"]), r.choice([None, str(r.randrange(70_000))])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "repo string, kind string, value string").repartition(3)
    first = D.codes(df.filter("repo < 'r3'"), rows_a_range=1000).cache()
    every = D.codes(df, first, rows_a_range=1000).cache()
    assert {(x.kind, x.value, x.code) for x in first.collect()} <= {(x.kind, x.value, x.code) for x in every.collect()}
    assert sorted(x.code for x in every.collect()) == list(range(every.count()))  # dense
    assert {(x.kind, x.value) for x in every.collect()} == {x[1:] for x in rows if x[2]}
    bits = D.bitmaps(df, every).cache()
    by_repo = {(x.repo, x.kind): x.n for x in D.counted(bits, ["repo"]).collect()}
    assert by_repo == {k: n for k in {x[:2] for x in rows} if (n := len({x[2] for x in rows if x[:2] == k and x[2]}))}
    out = D.counted(bits.filter("repo <> 'r4'"))
    assert {x.kind: x.n for x in out.collect()} == {k: len({x[2] for x in rows if x[1] == k and x[0] != "r4" and x[2]}) for k in ("users", "skills")}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert D.codes(df.limit(0)).collect() == [] and D.codes(df.limit(0), first).count() == first.count()
    empty = D.merged_summary(bits.limit(0), spark.createDataFrame([], "repo string, lines long")).first()
    assert (empty["users"], empty["skills"], empty["lines"]) == (0, 0, None)


def test_a_document_by_many_tasks(spark, tmp_path):
    rows = [(f"r{i % 7}", f"a{i}@x", "é\n,]}" * (i % 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "repo string, author string, note string").repartition(6)
    label = spark.createDataFrame([("l",)], "label string")
    at = str(tmp_path / "doc.json.gz")
    for parts in (1, 5, 40):
        FS.write_merged(df, label, 3, at, "crew", parts=parts)
        with gzip.open(at, "rt") as f:
            doc = json.load(f)
        assert (doc["user"], doc["timestamp"], doc["team"]) == ("l", 3, "crew")
        assert [(p["repo"], p["author"], p["note"]) for p in doc["profiles"]] == sorted(rows)
        assert [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["doc.json.gz"]
    assert FS.document(spark, at).select(F.explode("profiles")).count() == 500
    FS.write_merged(df.limit(0), label, 3, str(tmp_path / "none.gz"))
    assert json.loads(gzip.decompress((tmp_path / "none.gz").read_bytes())) == {"user": "l", "timestamp": 3, "profiles": []}
    before = (tmp_path / "doc.json.gz").read_bytes()
    bad = df.withColumn("note", F.when(F.col("author") == "a499@x", F.raise_error(F.lit("broken"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="broken"):
        FS.write_merged(bad, label, 3, at, parts=5)
    assert (tmp_path / "doc.json.gz").read_bytes() == before  # a failed run leaves what was there, and nothing else
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["doc.json.gz", "none.gz"]


def test_the_best_few_are_those_of_all(spark):
    vocabulary = [f"s{i}" for i in range(30)]
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(60)] + [(60, None)], "i int, chunk string").repartition(3)
    loader = SC.stub_loader(vocabulary)
    for k in (1, 3, 29, 30, 99):
        want = {(r.i, r["rank"]): r for r in SC.ranked(SC.logits(df, loader, vocabulary, ["i"]), ["i"], k=k).collect()}
        out = SC.best(df, loader, vocabulary, ["i"], k, batch=7)
        got = {(r.i, r["rank"]): r for r in out.collect()}
        assert got.keys() == want.keys() and "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("Exchange RoundRobin")[0]
        for key, r in got.items():
            assert r.skill == want[key].skill and math.isclose(r.sm_score, want[key].sm_score) and math.isclose(r.score, want[key].score, rel_tol=1e-6)
    ties = SC.best(df, lambda: lambda texts: [[1.0, 1.0, 800.0] for _ in texts], ["z", "y", "x"], ["i"], 3)
    assert {(r.skill, r["rank"]) for r in ties.collect()} == {("x", 1), ("y", 2), ("z", 3)}


def test_ranges_are_not_searched_one_by_one(spark):
    df = spark.range(4000).select(F.col("id"), F.pmod(F.col("id") * 7919, F.lit(4001)).alias("x"))
    out = numbered(df, "x", rows_a_range=20)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()  # a row is not compared with each of the 199 bounds
    rows = sorted(out.collect(), key=lambda r: r.no)
    assert [r.no for r in rows] == list(range(4000)) and [r.x for r in rows] == sorted(r.x for r in rows)


def test_a_document_is_read_line_by_line(spark, tmp_path):
    rows = [(f"r{i % 7}", f"a{i}@x", 'é\n,]}"profiles":[' * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "repo string, author string, note string").repartition(6)
    label = spark.createDataFrame([('l"profiles":[',)], "label string")
    kind = "repo string, author string, note string"
    for parts in (1, 7, 40):
        FS.write_merged(df, label, 3, at := str(tmp_path / f"d{parts}.json.gz"), "crew", parts=parts)
        got = FS.document_profiles(spark, at, kind)
        assert sorted(got.select("profile.*").collect()) == sorted(rows) and {(x.user, x.timestamp, x.team) for x in got.collect()} == {('l"profiles":[', 3, "crew")}
    FS.write_document(FS.merged(df, label, 3), at := str(tmp_path / "lines"), compress=True)
    assert sorted(FS.document_profiles(spark, at, kind).select("profile.*").collect()) == sorted(rows)
    FS.write_merged(df.limit(0), label, 3, at := str(tmp_path / "none.gz"))
    assert FS.document_profiles(spark, at, kind).collect() == []
