"""Leaks of benchmark items against brute force."""

import io
import math
import string
from collections import Counter

import numpy as np
import pytest

from quern.llm import decontamination as dc
from quern.llm.decontamination import build, decontaminate, leaks


def plain(text):
    lower = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return "".join(" " if c in string.punctuation else c for c in lower).split()


def bm25(items):
    w = {i: plain(t) for i, t in items}
    w = {i: x for i, x in w.items() if x}
    df = Counter(t for x in w.values() for t in set(x))
    mean = sum(map(len, w.values())) / len(w)
    idf = {t: math.log(1 + (len(w) - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    out = {}
    for i, x in w.items():
        c = Counter(x)
        s = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, n in c.items()}
        out[i] = {t: v / sum(s.values()) for t, v in s.items()}
    return w, out


def brute(docs, items, threshold=0.7):
    """(document, item): (score, question's overlap, answer's overlap, passage) of the best passage."""
    w, weight = bm25(items)
    found = {}
    for d, text in docs:
        x = plain(text)
        for i, weights in weight.items():
            stride = 64
            while stride < len(w[i]):
                stride *= 2
            for p in range(max(1, -(-len(x) // stride) - 1)):
                passage = x[p * stride : (p + 2) * stride]
                have = set(passage)
                score = sum(v for t, v in weights.items() if t in have)
                if score >= threshold - 1e-9:
                    cut = max(1, 3 * len(w[i]) // 4)
                    q, a = w[i][:cut], w[i][cut:]
                    k = min(5, len(q))
                    grams = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)}
                    seen = {tuple(passage[j : j + k]) for j in range(len(passage) - k + 1)}
                    q, a = len(grams & seen) / len(grams), len(set(a) & have) / len(set(a)) if a else 1.0
                    if q >= 0.8 and a >= 0.6:
                        found[d, i] = max(found.get((d, i), (0,)), (round(score, 6), q, a, -p * stride))
    return {k: (*v[:3], -v[3]) for k, v in found.items()}


def as_found(rows):
    return {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap, r.passage) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6)


def fixture(seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["".join(rng.choice(list("abcdé"), int(rng.integers(2, 5)))) for _ in range(400)])
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(3, 60) if i % 5 else rng.integers(60, 2000)))) + ".") for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(120):
        t = list(rng.choice(vocabulary, int(rng.integers(0, 500))))
        if d % 3 == 0:
            item = items[int(rng.integers(30))][1].split()
            if d % 2:
                item[int(rng.integers(len(item)))] = "changed"
            if d % 9 == 0:
                item = item[: max(1, len(item) // 2)]
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = item
        docs.append((d, " ".join(t).upper() if d % 5 == 0 else " ".join(t)))
    return docs + [(500, None), (501, "")], items


def test_against_brute_force(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 15
    same(as_found(leaks(d, i).collect()), want)
    kept = decontaminate(d.withColumn("score", d.doc_id), i)
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x for x, _ in docs} - {x for x, _ in want})


def test_several_shards_find_the_same_and_no_item_changes_another(spark):
    docs, items = fixture(4)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert any(dc.stride_of(len(plain(t))) > 64 for _, t in items if t) and len(want) > 15
    assert len(build(i).shards) < len(build(i, postings=100).shards)
    same(as_found(leaks(d, i, postings=100).collect()), want)


def test_block_max_and_pivots_lose_nothing(monkeypatch):
    """The index against sums over all items, where hardly anything is above the threshold and where much is."""
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2)
    made = []
    for j in range(100):
        terms = np.unique(rng.choice(vocabulary, int(rng.integers(1, 40)), p=np.arange(200, 0, -1) / 20100))
        impacts = rng.random(len(terms)) + 0.01
        made.append(dc.Item(j, terms, impacts / impacts.sum(), terms, terms[:0]))
    h = rng.choice(np.r_[vocabulary, vocabulary + np.uint64(1)], 6000)
    starts = np.arange(0, 5900, 30)
    ends = np.minimum(starts + 60, 6000)
    monkeypatch.setattr(dc, "ENTRIES", 500)
    shard = dc.Shard.of(made, 64)
    again = dc.Shard.load(io.BytesIO(shard.dump()))
    for threshold in (0.2, 0.5, 0.8):
        want = {(p, j): x for p, (s, e) in enumerate(zip(starts, ends, strict=True)) for j, item in enumerate(made) if (x := item.impacts[np.isin(item.terms, h[s:e])].sum()) >= threshold}
        got = {(p, j): x for p, j, x in again.search(h, starts, ends, threshold)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_texts_equal_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(8)
    item = " ".join(f"w{x}" for x in rng.integers(0, 300, 40))
    long = " ".join(f"v{x}" for x in rng.integers(0, 5000, 200_000))
    docs = [(1, long + " " + item + " " + long, 5), (1, long + " " + item + " " + long, 5), (2, long, 6), (None, item.upper(), None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long").withColumn("score", dc.F.lit(1)).withColumn("terms", dc.F.lit("x"))
    i = spark.createDataFrame([(9, item, 3), (9, item, 3), (None, "  .", 1)], "item_id long, text string, row long").withColumn("q", dc.F.lit(1))
    got = leaks(d, i).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.score) for r in got) == [(0, 9, 1.0), (1, 9, 1.0), (1, 9, 1.0)]
    kept = decontaminate(d, i)
    assert kept.columns == ["doc_id", "text", "item_id", "score", "terms"] and [r.doc_id for r in kept.collect()] == [2]


def test_own_question_and_answer_columns_nulls_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "what is the tall red thing over there", "what is the tall red thing over there", "a tower of bricks"), (2, None, None, None)], "item_id long, text string, q string, a string")
    docs = spark.createDataFrame([(None, "so: What is the tall red thing over there? A tower of bricks."), (7, "what is the tall red thing over there"), (7, None)], "doc_id long, text string")
    got = leaks(docs, items, question="q", answer="a").collect()
    assert [(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in got] == [(None, 1, 1.0, 1.0)]
    assert leaks(docs, items.limit(0)).collect() == [] and leaks(docs.limit(0), items).collect() == []
    assert decontaminate(docs, items.limit(0)).count() == 3
