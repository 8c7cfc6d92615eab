"""Chunks in the JVM against the plain function."""

import random

from pyspark.sql import functions as F

from quern.functions import text as TX


def texts():
    rnd = random.Random(7)
    parts = ["a", "bb c", " ", "\n", "\n\n", "}\n\n", "end\n\n", "é\U0001f600", "\t", "\x1c", "\xa0", "x" * 9, "\\E", "\\Q.", "y" * 40, "\r\n"]
    for _ in range(600):
        yield "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))), rnd.choice(["\n", "\n\n", "}\n\n", "end\n\n", "\\E", ".", None])
    yield None, "\n"
    yield "", "\n\n"
    yield "z" * 5000, "}\n\n"
    yield "\n".join("line %d" % i for i in range(4000)), "}\n\n"
    yield "}\n\n".join("line %d\n" % i * 40 for i in range(300)), "}\n\n"


def test_chunks_in_the_jvm(spark):
    every = list(texts())
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(every)], "i int, code string, sep string")
    for limit, least in ((1500, 100), (50, 10), (20, 5), (7, 0), (30, 60)):
        got = {r.i: r.x for r in df.select("i", TX.chunks_of("code", "sep", limit, least).alias("x")).collect()}
        for i, (code, sep) in enumerate(every):
            assert got[i] == TX.chunks(code, sep, limit, least), (code, sep, limit, least)


def test_chunks_have_no_python_node(spark):
    df = spark.createDataFrame([("a", "py")], "code string, ext string")
    plan = df.select(TX.chunks_of("code", F.lit("\n")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
