"""Repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import suffix_dedup as sd
from quern.llm.suffix_dedup import multikey_sort, shared, suffix_dedup


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(r, gone, strict=False) if not g)
        out.append((d, len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture(n=60, seed=1, length=200):
    rng = np.random.default_rng(seed)

    def text(k):
        return "".join(rng.choice(list("abcdeé \n"), k))

    shared_ = [text(int(x)) for x in (length, length - 3, 3 * length, length + 1, 40)]
    rows = []
    for i in range(n):
        t = text(int(rng.integers(0, 900)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(t) + 1))
            t = t[:at] + shared_[int(rng.integers(5))] + t[at:]
        rows.append((i, t))
    rows += [(1000, rows[5][1]), (1001, rows[5][1][7:-5] if len(rows[5][1]) > 20 else "x"), (1002, None), (1003, ""), (1004, "ab" * 400), (1005, "z" * 300), (1006, "x" * (length - 1)), (1007, "q" * length)]
    return rows


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize(("length", "k", "hot"), [(200, 40, 4096), (60, 12, 4096), (60, 12, 1)])
def test_against_brute_force(spark, monkeypatch, length, k, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = fixture(length=length, seed=length + hot)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), length, k)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, length)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(sd, "_PART", 500)
    rows = fixture(40, 8)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), 200)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 200)


def test_empty_table_null_and_repeated_rows(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    t = "".join(np.random.default_rng(4).choice(list("abcdef"), 700))
    got = suffix_dedup(spark.createDataFrame([(None, t), (None, t), (3, t[:400]), (4, "short")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in got) == [("3", 400, 1), ("4", 0, 0), ("None", 700, 1), ("None", 700, 1)]


def test_one_very_long_text_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    part = "".join(rng.choice(list("abcdefgh "), 900_000))
    rows = [(1, part + "#" + part[200_000:201_000] + "#"), (2, part[500_000:500_300] + "!"), (3, "x" * 199)]
    df = spark.createDataFrame([(*r, 0, b"x", "y") for r in rows], SCHEMA + ", n_bytes int, raw binary, th string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(df).collect()}
    assert got == {1: (901_002, 2300, 3), 2: (301, 300, 1), 3: (199, 0, 0)}


def test_multikey_sort():
    rng = np.random.default_rng(2)
    words, group = rng.integers(0, 3, (400, 4)).astype(np.uint64), rng.integers(0, 4, 400)
    order = multikey_sort(words, group)
    keys = [(int(group[i]), *words[i].tolist()) for i in order]
    assert keys == sorted(keys)
    lcp = shared(words, group, order)
    for i in range(1, 400):
        a, b = words[order[i - 1]].astype(">u8").tobytes(), words[order[i]].astype(">u8").tobytes()
        want = next((j for j in range(32) if a[j] != b[j]), 32) if group[order[i]] == group[order[i - 1]] else -1
        assert lcp[i] == want
