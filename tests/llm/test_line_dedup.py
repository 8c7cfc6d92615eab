"""Repeated multi-line chunks against brute force, and the plan's operators."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup as line_dedup_module
from quern.llm.line_dedup import KINDS, line_dedup, passage_dedup

SCHEMA = "doc_id long, text string"


def _full(lines):
    return [i for i, x in enumerate(lines) if re.search(r"[^ \t\n\x0b\f\r]", x)]


def chunks(lines, kinds):
    """(first, last) of the chunks of all chunkings, each cut on its own as the method says."""
    full, out = _full(lines), set()
    kind = {i: int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) % kinds for i in full}
    for k in range(kinds):
        at = 0
        for j, i in enumerate(full):
            if kind[i] != k or j == len(full) - 1:
                if j > at:
                    out.add((full[at], i))
                at = j + 1
    return sorted(out)


def pairs(lines):
    return list(zip(_full(lines), _full(lines)[1:]))


def brute(rows, cut):
    """For distinct ids: what repeats earlier chunks goes."""
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines, gone = (t or "").split("\n"), set()
        for a, b in cut(lines):
            at = first.setdefault("\n".join(lines[a : b + 1]), (d, b))
            if at != (d, b) and (at[0] != d or a > at[1]):
                gone |= set(range(a, b + 1))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, kept if gone else t, len(lines), len(gone), len(gone - {i + 1 for i in gone})))
    return sorted(out)


def deduped(rows, kinds=KINDS):
    return brute(rows, lambda lines: chunks(lines, kinds))


BLANKS = [(300, "a\na\na\na\na"), (301, "p q\n\n\nr s\nt"), (302, "x\np q\n\n\nr s\nu"), (303, "p q\n\n\nr s")]


def fixture(seed=1, n=60):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(["ab", "cd", "é", "x"]) for _ in range(r.randrange(0, 6)))
    blocks = [[line() for _ in range(r.randrange(2, 15))] for _ in range(6)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(r.randrange(0, 4)):
            t += r.choice(blocks) if r.random() < 0.6 else [line() for _ in range(r.randrange(1, 9))]
        rows.append((i, "\n".join(t)))
    return rows + [(200, None), (201, ""), (202, "\n\n\n\n\n"), (203, "\n\n\n\n\n"), (204, "one line"), (205, "same\n" * 50), (206, "same\n" * 50)]


@pytest.mark.parametrize(("seed", "kinds"), [(1, KINDS), (2, 3), (3, 1)])
def test_against_brute_force(spark, seed, kinds):
    rows = [*fixture(seed), *BLANKS]
    got = line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), kinds)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed", "chunks_removed"]
    assert sorted(tuple(r) for r in got.collect()) == deduped(rows, kinds)


def test_equal_hashes_alone_remove_nothing(spark, monkeypatch):
    """All chunks of one length have one hash here: their bytes tell them apart."""
    monkeypatch.setattr(line_dedup_module, "_name", lambda chunk: F.length(chunk).cast("bigint") * 0)
    rows = [*fixture(4), *BLANKS]
    got = line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == deduped(rows)


def test_other_columns_nulls_and_repeated_rows(spark):
    text = "\n".join(f"line {i}" for i in range(40))
    df = spark.createDataFrame([(None, text, 1, "a"), (None, text, 1, "a"), (5, text, 2, "b"), (5, "other", 3, "c")], "doc_id long, text string, no int, n_lines string")
    got = line_dedup(df, counts=False).collect()
    assert [f for f in got[0].asDict()] == ["doc_id", "text", "no", "n_lines"]
    by = sorted((str(r.doc_id), r.no, r.text == text, len(r.text) < 200) for r in got)
    assert by == [("5", 2, False, True), ("5", 3, False, True), ("None", 1, True, False), ("None", 1, True, False)]
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_insertion_moves_only_near_boundaries():
    r = random.Random(0)
    lines = [str(r.random()) for _ in range(400)]
    texts = lambda ls: {tuple(ls[a : b + 1]) for a, b in chunks(ls, KINDS)}
    assert len(texts(lines) - texts(["new"] + lines[:200] + ["more"] + lines[200:])) <= 5


def test_no_python_in_the_plan(spark):
    plan = line_dedup(spark.createDataFrame(fixture(), SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_brute_force(spark, seed):
    rows = [*fixture(seed), *BLANKS]
    got = passage_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed", "chunks_removed"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, pairs)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def planted(seed):
    """Fifty passages of two to six lines, each in two documents; texts, and what is left where nothing else goes."""
    r = random.Random(seed)
    line = lambda: " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(1000)) for _ in range(40))
    rows, left = [], {}
    for n in range(2, 7):
        for _ in range(10):
            passage = [line() for _ in range(n)]
            for copy in range(2):
                around = [line() for _ in range(r.randrange(2, 8))]
                at, d = r.randrange(1, len(around)), len(rows)
                rows.append((d, "\n".join(around[:at] + passage + around[at:])))
                left[d] = "\n".join(around) if copy else rows[-1][1]
    return rows, left


def test_planted_passages_in_different_documents_go(spark):
    rows, left = planted(3)
    got = passage_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.doc_id: x.text for x in got} == left


def test_chunks_find_planted_passages(spark):
    """At least nine lines in ten of them go, and no other line."""
    asked = found = 0
    for seed in (3, 4, 5):
        rows, left = planted(seed)
        for x in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect():
            kept, wanted, whole = x.text.split("\n"), left[x.doc_id].split("\n"), dict(rows)[x.doc_id].split("\n")
            assert set(wanted) <= set(kept)
            asked += len(whole) - len(wanted)
            found += len(whole) - len(kept)
    assert asked == 600 and found >= 0.9 * asked
