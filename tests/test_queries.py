"""Every query of the engine against its SQL in DuckDB, on the smallest tables; the stream against a batch."""

import math
import os

import duckdb
import pytest

import quern.plans.files  # noqa: F401, adds its queries
from quern.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in df.columns]
        assert sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall()) == sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", ["huge_commit_drop", "lang_month_activity", "reformat_retraction", "quarter_rollup", "quarter_gapfill", "quarters_descending"])
def test_joins_are_dealt_by_rows(spark, con, monkeypatch, name):
    from pyspark.sql import functions as F

    from quern.plans import tables

    monkeypatch.setattr(tables, "ROWS", 100, raising=False)
    tasks = tables.changes(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 50 and max(r["count"] for r in tasks) < 300  # else one task has all
    test_query(spark, con, name)


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_stream_of_events(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.streaming.activity import monthly_events

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{SF}/events.parq*")
    q = monthly_events(stream).writeStream.outputMode("complete").format("memory").queryName("ev").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) as n, round(sum(total), 3) as t from ev").first()
    want = spark.read.parquet(f"{SF}/events.parquet").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("t")).first()
    assert (got.n, got.t) == (want.n, want.t)


def test_changed_chars_of_whole_texts(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rows = [(1, "\n".join(["abc " * 200 + "x", "abd " * 190, "", "q1w2e3"])), (2, "one"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, t in rows:
        lines = ["".join(c for c in x if c.isascii() and c.isalpha()) for x in (t or "").split("\n")]
        want += [(d, i, k := distance(a, b), k < 50) for i, (a, b) in enumerate(zip(lines, [*lines[1:], ""]))]
    assert sorted(tuple(r) for r in QUERIES["changed_chars"](spark, str(tmp_path)).collect()) == want


def test_dear_rows_are_dealt_and_texts_come_in_small_batches(spark, tmp_path):
    from quern.plans import tables

    spark.range(50).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(50).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name, n in (("cipher_feedback", 50), ("changed_chars", 50)):
        rows = QUERIES[name](spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and rows.count() == n
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert tables.texts(spark, str(tmp_path)).count() == 50 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
