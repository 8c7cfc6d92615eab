"""Scalar and text functions against vectors derived by hand."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.functions import text as TX


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'bigint' if isinstance(values[n], int) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "ext"), [("a/b.py", "py"), ("Makefile", "unknown"), (".bashrc", "unknown"), ("..py", "unknown"), ("x.c++", "c"), ("C.CS", "CS"), ("a.b/c", "unknown"), ("b.h", "h")])
def test_file_extension(spark, path, ext):
    assert one(spark, S.file_extension("p"), p=path) == ext


def test_dates(spark):
    assert one(spark, S.year_month("t"), t=1704067199) == 202312
    assert one(spark, S.quarter("m"), m=202403) == "2024Q1"
    assert one(spark, S.half("m"), m=202407) == "2024H2"
    assert one(spark, S.days_in_month("m"), m="2024-02") == 29
    assert one(spark, S.short_date("m"), m=202403) == "Mar\n2024"


def test_hashes_and_keys(spark):
    assert one(spark, S.stable_hash("s"), s="/home/a/repo") == 479202432447765704
    assert one(spark, S.sha256("s"), s="x") == hashlib.sha256(b"x").hexdigest()
    assert one(spark, S.pair_key(F.lit("b"), F.lit("a")), s="") == "a:b"
    assert one(spark, S.safe_email("s"), s="a.b@c.d") == "a_b_c_d"
    assert one(spark, S.email_key("s"), s=" \tA@B.c\n") == "a@b.c"


def test_paths_and_names(spark):
    assert one(spark, S.renamed_to("p"), p="src/{old => new}/t.py") == "src/new/t.py"
    assert one(spark, S.renamed_to("p"), p="old.py => new.py") == "old.py => new.py"
    assert one(spark, S.repo_name("p"), p="/a/b/c") == "c"
    assert [one(spark, S.truncated("s", n), s=t) for t, n in (("abcdefg", 10), ("abcdefgh", 10), ("abcdefgh", 8))] == ["abcdefg", "abcdefg...", "abcde..."]
    assert one(spark, S.title_name("s"), s="ci/cd o'brien 3d-graphics") == "Ci/Cd O'Brien 3D-Graphics"
    assert one(spark, S.language_name("s"), s="h") == "C/C++" and one(spark, S.language_name("s"), s="zz") == "zz"
    assert one(spark, S.separator("s"), s="rb") == "end\n\n" and one(spark, S.separator("s"), s="zz") is None
    assert one(spark, S.import_prefix("s"), s="cpp") == "#include "
    assert [one(spark, S.expert("p"), p=p) for p in ("a.py", "b.tsx", "c.cs", "d.go", "e.rb")] == ["python", "javascript", "java_or_csharp", "go", "others"]


def test_buckets_labels_and_distances(spark):
    assert [one(spark, S.quality_bucket("n"), n=n) for n in (0, 19, 20, 500)] == ["life_of_py_0", "life_of_py_0", "life_of_py_20", "life_of_py_80"]
    assert one(spark, S.changed_chars("d"), d="+ki t\tten\n context\n-sitting") == 3
    assert one(spark, S.distance_below(F.lit("a" * 50), F.lit("b" * 50), 50), d="") is False
    assert one(spark, S.distance_below(F.lit("a" * 49), F.lit("b" * 49), 50), d="") is True
    assert one(spark, S.doc_lines("c"), c="a b\nhttp://x\nauthor me\nc") is None  # too few spaces
    assert one(spark, S.doc_lines("c"), c="one two three four five six seven eight nine\nwww x y z a b c d e f g h\nauthor me you they all of us\nlast line") == ["one two three four five six seven eight nine", "last line"]
    assert one(spark, S.doc_lines("c"), c="the License of this") is None
    top = one(spark, S.top_labels(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.9), F.lit(0.5)), F.array(*map(F.lit, "adcb")), 2), d="")
    assert [tuple(x) for x in top] == [(0.9, "c"), (0.5, "b")]


def test_masks():
    assert [TX.mask(x) for x in ("ab", "a", "abcdef", "", None)] == ["a*", "a*", "ab****", "", None]
    m = TX.mask("somebody@example.org")
    assert len(m) == 20 and m[:2] == "so" and m[-2:] == "rg" and sum(c != "*" for c in m) == 10 and m == TX.mask("somebody@example.org")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_masks_show_no_more_than_their_share(t):
    m = TX.mask(t)
    assert len(m) == max(len(t), 2 if t else 0)
    if len(t) > 6:
        assert sum(a == b and b != "*" for a, b in zip(t, m, strict=True)) <= max(4, -(-len(t) // 2))


def test_chunks():
    assert TX.chunks("short", "\n\n") == ["short"]
    assert TX.chunks("x" * 2000, None) == []
    a, b, c = "a" * 800, "b" * 800, "c" * 90
    assert TX.chunks("\n\n".join([a, b, c]), "\n\n") == [a, f"{b}\n\n{c}"]
    assert TX.chunks(f"{a}\n\n{'d' * 1600}\n\n{b}", "\n\n") == [a, b]  # a line that is too long has no chunk
    long = "\n".join(["e" * 700] * 3)
    assert TX.chunks(f"{a}\n\n{long}\n\n{c}", "\n\n") == [f"{'e' * 700}\n{'e' * 700}", f"{a}\n\n{c}"]  # ahead of what gathers
    rest = "f" * 1499
    assert TX.chunks(rest + "\n\n" + "g" * 98, "\n\n") == [rest]  # 100 with its separator: dropped
    assert TX.chunks(rest + "\n\n" + "g" * 99, "\n\n") == [rest, "g" * 99]


def test_documentation():
    py = ['"""one line"""', '"""First', "middle", '"""', "# no", "x = 1", 'ends"""']
    assert TX.documentation(py, "py") == ["First\nmiddle", '\nends']
    c = ["/** Start", " * a line", " */", "int x; /* no */", "// " + "y" * 200, "// " + "z" * 200, "int y;"]
    assert TX.documentation(c, "java") == ["Start\n a line", f"{'y' * 200}\n {'z' * 200}"]
    assert TX.documentation(["// short", "code"], "go") == []
    assert TX.documentation(["=begin", "text", "=end"], "rb") == ["text"]
    assert TX.documentation(["--[[ a", "b ]]"], "lua") == ["a\nb"]
    assert TX.documentation(['@doc """', "says this", '"""'], "ex") == ["says this"]
    assert TX.documentation(py, "txt") == []
    assert TX.documentation_lines('"""one two three four five six\nauthor x\n"""', "py") == 1
    assert TX.documentation_lines('"""one two three four five six seven eight nine ten eleven twelve\nmore\n"""', "py") == 2


def test_imports():
    assert TX.imports(["import os, sys as s", "from a import b, c", "from m import (", "  d,", "  e)", "from q import (f)"], "py") == ["a.b", "a.c", "m.d", "m.e", "os", "q.f", "sys"]
    assert TX.imports(["import (", '  "fmt"', '  "os"', ")", 'import "io"'], "go") == ["fmt", "os", "io"]
    assert TX.imports(["import a.b.C;", "import x.*;"], "java") == ["a.b.C", "x.*"]
    assert TX.imports(["import React from 'react';", 'import { a } from "b"', "import 'c'"], "ts") == ["react", "b", "c"]
    assert TX.imports(["#include <stdio.h>", '#include "x.h"'], "c") == ["stdio.h", "x.h"]
    assert TX.imports(["using A.B;"], "cs") == ["A.B"] and TX.imports(["require 'json'"], "rb") == ["json"]
    assert TX.imports(["use std::io;"], "rs") == ["std::io"] and TX.imports(["import Foundation"], "swift") == ["Foundation"]
    assert TX.imports(["include 'a.php'", 'require_once "b.php"'], "php") == ["a.php", "b.php"]
    assert TX.imports(["import 'package:x/y.dart';"], "dart") == ["package:x/y.dart"]
    assert TX.imports(["import Ecto.Query", "alias A.B"], "ex") == ["Ecto.Query", "A.B"]
    assert TX.imports(["import kotlin.io.*"], "kt") == ["kotlin.io.*"] and TX.imports(["x"], "zz") == []


def test_udfs_take_nulls(spark):
    df = spark.createDataFrame([(None, None), ("x", "py")], "c string, e string")
    r = df.select(TX.chunks_udf("c", F.lit("\n"), F.lit(1500), F.lit(100)).alias("a"), TX.documentation_lines_udf("c", "e").alias("b"), TX.imports_udf("c", "e").alias("i"), TX.mask_of("c").alias("m")).collect()
    assert [tuple(x) for x in r] == [([], 0, [], None), (["x"], 0, [], "x*")]
    assert df.select(TX.salted_hash("c").alias("h")).filter("h is not null").count() == 1


def test_cipher_feedback(spark):
    """A published vector (zeros under a key of zeros), and round trips of every length and key size."""
    from quern.functions.crypto import decrypt, encrypt

    zero = spark.range(1).select(F.hex(encrypt(F.unhex(F.lit("00" * 32)), "00" * 16)).alias("c")).first()["c"]
    assert zero == "66E94BD4EF8A2C3B884CFA59CA342B2E" + "F795BD4A52E29ED713D313FA20E98DBC"
    rows = [(n, bytes((7 * i + n) % 256 for i in range(n))) for n in (0, 1, 15, 16, 17, 31, 32, 100)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, data binary")
    for size in (16, 24, 32):
        key = bytes(range(size)).hex()
        got = df.withColumn("c", encrypt(F.col("data"), key)).select("n", "data", "c", decrypt(F.col("c"), key).alias("p")).collect()
        assert all(r.p == r.data and (r.c is None) == (r.data is None) and (r.data is None or len(r.c) == len(r.data)) for r in got)
        assert all(r.c != r.data for r in got if r.n > 0)


def test_edit_distance_over_what_differs(spark):
    import random

    r = random.Random(4)
    rows = [(None, "a"), ("a", None), ("", ""), ("", "abc"), ("abc", "abc"), ("aé\U0001f642b", "aé\U0001f642xb"), ("a" * 5000 + "x" + "b" * 3000, "a" * 5000 + "b" * 3000), ("aa", "aaa"), ("abab", "ab")]
    for _ in range(400):
        a = "".join(r.choice("abé") for _ in range(r.randrange(30)))
        rows.append((a, "".join(c for c in a if r.random() < 0.9) if r.random() < 0.6 else "".join(r.choice("abé") for _ in range(r.randrange(30)))))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("w"), *[S.distance_below("a", "b", n).alias(f"b{n}") for n in (1, 3, 10)]).collect()
    for x in got:
        assert x.d == x.w and all(x[f"b{n}"] == (None if x.w is None else x.w < n) for n in (1, 3, 10))
