"""The string kernel and the machine against their definitions, held-out accuracy on sentences with planted insults."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quern.llm import toxicity as tox
from quern.llm.toxicity import DECAY, SPAN, WINDOW, Landmarks, Model, Reader, Scorer, keep_clean, pieces, plain, plane, score, soft, toxicity, train

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def defined(a, b):
    """Sum over common subsequences of three symbols that span at most SPAN of the decay to both spans, with a mark at each end."""
    a, b = f"^{a}$", f"^{b}$"

    def k(s, t):
        return sum(DECAY ** (i[2] - i[0] + j[2] - j[0] + 2) for i in combinations(range(len(s)), 3) if i[2] - i[0] < SPAN for j in combinations(range(len(t)), 3) if j[2] - j[0] < SPAN and [s[x] for x in i] == [t[x] for x in j])

    return k(a, b) / (k(a, a) * k(b, b)) ** 0.5


def test_kernel_is_the_defined_one():
    words = ["idiot", "idxiot", "banana", "abc", "aaa", "ab", "a", "banana" * 4]
    got = Landmarks([plain(w) for w in words]).kernel([plain(w) for w in words])
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(defined(a, b), abs=1e-5)


def test_words_of_whole_texts():
    read = lambda t: Reader().words(t)
    assert read("One, (two) THREE! two") == {plain("one"), plain("two"), plain("three")} and read(None) == set() == read(" \n ... ")
    assert plain("ÉTÉ") == plain("ete") and plain("b_l.o-c*k") == plain("block") and plain("дом") != plain("кот")
    long = plain("x" * 5 + "yz" * 50 + "blockhead" + "zy" * 50)
    assert any(plain("blockhead") in p and len(p) <= WINDOW for p in pieces(long))
    assert plain("blockhead") in pieces(plain("blllockhead"))


def matches(word, mark):
    return max(float(soft(np.array(defined(p, mark)))) for p in pieces(word))


def test_scores_are_those_of_a_plain_version():
    marks = [plain(w) for w in ("blockhead", "numbskull", "river")]
    m = Model(marks, np.array([1.5, 0.7, -0.4]), -0.8, 3.0, 0.2)
    texts = ["the bloxckhead, numbskull", "river rivers", None, "", "b l o c k h e a d", "a " * 50 + "numbskullnumbskullnumbskull"]
    for t, got in zip(texts, Scorer(m).probabilities(texts), strict=True):
        f = -0.8 + sum(w * matches(x, mark) for x in Reader().words(t) for w, mark in zip(m.weights, marks, strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-(3.0 * f + 0.2))), abs=1e-4)


def test_the_plane_is_the_minimum():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(300, 6)), (r.random(300) < 0.3).astype(float)
    x[y > 0] += 0.8

    def loss(v):
        s = np.where(y > 0, 1, -1)
        w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        return (w * np.maximum(0, 1 - s * (x @ v[:-1] + v[-1])) ** 2).sum() + 1e-2 * (v[:-1] ** 2).sum() + 1e-6 * v[-1] ** 2

    v = plane(x, y, 1e-2)
    assert all(loss(v) <= loss(v + e) + 1e-12 for e in 1e-3 * r.normal(size=(200, 7)))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    clean = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    insults = ["blockhead", "numbskull", "halfwit"]
    docs, labels = [], []
    for i in range(600):
        words = [r.choice(clean) for _ in range(r.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w = r.choice(insults)
                if r.random() < 0.3:
                    at = r.randrange(1, len(w))
                    w = w[:at] + r.choice("x*-") + w[at:]
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs + [(9000, None), (9001, ""), (None, "halfwit and blockhead"), (9002, "word " * 20000 + "numbskull")], labels


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    d, l = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)  # noqa: E741
    got = toxicity(d, l).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95
    by = {r.doc_id: r.predicted for r in got}
    assert (by[9000], by[9001], by[None], by[9002]) == (0, 0, 1, 1)  # whole texts, never prefixes


def test_labels_that_are_held_out_are_not_learnt(spark, corpus):
    docs, labels = corpus
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = spark.createDataFrame(docs[:200], DOCS)
    a, b = (sorted((r.doc_id, r.score) for r in toxicity(d, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert a == b


def test_without_labels_or_documents(spark, corpus):
    docs, labels = corpus
    d, l = spark.createDataFrame(docs[:20], DOCS), spark.createDataFrame(labels, LABELS)  # noqa: E741
    assert {r.predicted for r in toxicity(d, l.limit(0)).collect()} <= {0, 1}
    assert toxicity(d.limit(0), l).collect() == []
    assert {r.predicted for r in score(d, train(d, l.filter("toxic = 0"))).selectExpr("int(score >= 0.5) as predicted").collect()} == {0}


def test_keep_clean_keeps_columns_and_treats_equal_rows_alike(spark):
    m = Model([plain("halfwit")], np.array([2.0]), -1.0, 4.0, 0.0)
    df = spark.createDataFrame([(1, "a b", "x", "p"), (2, None, "y", None), (2, "halfwit!", "y", "q"), (1, "a b", "x", "p"), (None, "", None, None)], "score int, text string, label string, words string")
    assert sorted(map(tuple, keep_clean(df, m).collect()), key=str) == sorted([(1, "a b", "x", "p"), (2, None, "y", None), (1, "a b", "x", "p"), (None, "", None, None)], key=str)


def test_gapped_and_inserted_characters_that_no_text_of_the_training_has(spark):
    """Insults with gaps of white space, marks, inserted and repeated characters, learnt from plain ones alone."""
    r = random.Random(4)
    clean = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    docs = [(i, " ".join([r.choice(clean) for _ in range(r.randrange(5, 60))] + [r.choice(["blockhead", "numbskull", "halfwit"])] * (i % 4 == 0))) for i in range(600)]
    m = train(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], LABELS))
    rows = ["b l o c k h e a d", "\n".join("numbskull"), "so b. l. o. c. k. h. e. a. d. there", "b_l_o_c_k_h_e_a_d", "n-u-m-b-s-k-u-l-l", "blooooockhead", "nnnumbskulll", "halfffwit", "blockxhead", "numbqskull", "halfwzit", "BLOCKHEAD!!", "halfwits"]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(list(enumerate(rows)), DOCS), m).collect()}
    assert all(got[i] >= 0.5 for i in range(len(rows))), [(rows[i], x) for i, x in got.items() if x < 0.5]
    others = [" ".join(r.choice(clean) for _ in range(40)) for _ in range(100)] + ["block of a head", "half wit", "numb skulls are full", "", None]
    got = score(spark.createDataFrame(list(enumerate(others)), DOCS), m).collect()
    assert sum(x.score >= 0.5 for x in got) <= 2


def brute_training(docs, labels, landmarks=250, least=3):
    """What ``train`` learns, in plain Python, from all texts."""
    y = {}
    for i, t in labels:
        if i is not None and t in (0, 1):
            y[i] = max(t, y.get(i, 0))
    bags = {(frozenset(Reader().words(t)), y[i]): t for i, t in docs if i in y}  # in the fixture equal bags are copies
    p, n = Counter(), Counter()
    for words, label in bags:
        (p if label else n).update(words)
    a, b = sum(x for _, x in bags), sum(1 - x for _, x in bags)
    z = {}
    for w in p:
        both = (p[w] + n[w]) / (a + b)
        z[w] = (p[w] / a - n[w] / b) / math.sqrt(max(both * (1 - both), 1e-12) * (1 / a + 1 / b))
    top = sorted((w for w in p if p[w] >= least and z[w] > 2), key=lambda w: (-round(z[w], 9), w))[: 4 * landmarks]
    marks = []
    for w in top:
        if all(defined(w, m) < 0.8 for m in marks):
            marks.append(w)
    sums = np.array([[sum(matches(w, m) for w in words) for m in marks] for words, _ in bags])
    return marks, sums, np.array([x for _, x in bags], float)


def test_training_is_that_of_a_plain_version(spark):
    r = random.Random(9)
    clean = ["".join(r.choice("aeiobcdlmnrst") for _ in range(r.randrange(3, 7))) for _ in range(60)]
    docs = [(i, " ".join([r.choice(clean) for _ in range(8)] + r.sample(["blockhead", "numbskull"], 1) * (i % 3 == 0))) for i in range(90)]
    labels = [(i, int(i % 3 == 0)) for i, _ in docs] + [(0, 0), (None, 1), (5, None)]
    got = train(spark.createDataFrame(docs + [(1000, "no label blockhead")], DOCS), spark.createDataFrame(labels, LABELS))
    marks, sums, y = brute_training(docs, labels)
    assert sorted(got.landmarks) == sorted(marks) and plain("blockhead") in marks
    order = [marks.index(m) for m in got.landmarks]
    values, vectors = np.linalg.eigh(np.array([[1 / (1 + math.exp((0.6 - defined(a, b)) / 0.05)) for a in got.landmarks] for b in got.landmarks]))
    keep = values > 1e-2 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    v = plane(sums[:, order] @ root, y, 3e-3)
    assert sums[:, order] @ (root @ v[:-1]) + v[-1] == pytest.approx(sums[:, order] @ got.weights + got.bias, abs=2e-2)


def test_repeated_rows_and_clashing_columns(spark, corpus):
    docs, labels = corpus
    d, l = spark.createDataFrame(docs[:300], DOCS), spark.createDataFrame(labels, LABELS)  # noqa: E741
    want = {r.doc_id: r.score for r in toxicity(d, l).collect()}
    more = d.withColumns({"toxic": tox.F.lit(1), "score": tox.F.lit("x"), "y": tox.F.col("doc_id"), "words": tox.F.lit(None)})
    got = toxicity(more, l.withColumns({"text": tox.F.lit("blockhead"), "id": tox.F.lit(1)})).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "held_out", "score", "predicted"] and {r.doc_id: r.score for r in got} == pytest.approx(want)
    twice = toxicity(d.union(d), l).collect()
    assert len(twice) == 600 and all(r.score == pytest.approx(want[r.doc_id]) for r in twice)


def test_texts_that_share_a_passage_are_no_copies(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(6))
    opening, clean = " ".join(word() for _ in range(60)), [word() for _ in range(40)]
    docs = [(i, f"{opening} {r.choice(clean)} {r.choice(clean)} {'blockhead' if i % 4 == 0 else r.choice(clean)}") for i in range(160)]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], LABELS)  # noqa: E741
    assert {(r.doc_id % 4 == 0, r.predicted) for r in toxicity(d, l).collect()} == {(True, 1), (False, 0)}
