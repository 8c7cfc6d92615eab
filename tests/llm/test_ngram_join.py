"""The n-gram join against brute force."""

import re
import string

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import ngram_join as nj
from quern.llm import shingles
from quern.llm.ngram_join import linked, ngram_join


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    s, up, links = [plain_set(t, k) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s[i]), links[i], low[find(i)]) for i, (d, _) in enumerate(rows))


def fixture(n=240, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["".join(rng.choice(list("abcdefgé"), 3)) for _ in range(300)])
    hot = " ".join(rng.choice(vocabulary, 12))
    base = [list(rng.choice(vocabulary, int(rng.integers(5, 150)))) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(base[int(rng.integers(30)) if i % 3 else 0])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocabulary))
        text = (hot + "\n" if i % 2 else "") + " ".join(w)
        rows.append((int(2000 - 3 * i), text.upper() if i % 7 == 0 else text))
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"), (8, "One two\x0bthree  four")]


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize(("docs_in_block", "list_"), [(256, 256), (8, 3), (8, 0)])
def test_against_brute_force(spark, monkeypatch, docs_in_block, list_):
    monkeypatch.setattr(nj, "BLOCK_DOCS", docs_in_block)
    monkeypatch.setattr(nj, "LIST", list_)
    rows = fixture()
    got = ngram_join(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 85)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 85)


def test_other_parameters_and_clashing_columns(spark):
    rows = fixture(90, 9)
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], SCHEMA + ", component_id int, node int")
    assert sorted(tuple(r) for r in ngram_join(df, 5, 80).collect()) == brute(rows, 5, 80)


def test_empty_table_null_and_repeated_ids(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []
    got = ngram_join(spark.createDataFrame([(None, "a b c d e"), (9, "a b c d e"), (9, "x y z w v"), (9, "x y z w v")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links, str(r.component_id)) for r in got) == [("9", 2, 1, "9"), ("9", 2, 1, "9"), ("9", 2, 1, "None"), ("None", 2, 1, "None")]


def test_words_of_long_texts_do_not_depend_on_the_cut(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000)) + " " + "x" * 900 + " end"
    one = shingles.words(["a b", text, "c"])
    monkeypatch.setattr(shingles, "_AT_ONCE", 500)
    cut = shingles.words(["a b", text, "c"])
    assert [len(x) for x in cut] == [len(x) for x in one] == [2, 3002, 1]
    assert (cut[1][:3000] == one[1][:3000]).all() and (one[0] == cut[0]).all()


def near_sets(seed=0, groups=12, each=6):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.integers(0, 4000, int(rng.integers(1, 120)))
        for _ in range(each):
            s = base.copy()
            s[rng.random(len(s)) < rng.choice([0.0, 0.02, 0.1, 0.4])] += 10_000
            out.append(np.unique(s).astype(np.uint64))
    return [*out, np.zeros(0, np.uint64), np.arange(300, dtype=np.uint64)]


@pytest.mark.parametrize(("columns", "sparse"), [(2048, 16), (16, 2), (7, 1)])
def test_product_finds_all_pairs_and_opens_few(columns, sparse):
    found = near_sets()
    want = {(i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if len(found[i]) and 100 * len(np.intersect1d(found[i], found[j])) >= 85 * len(np.union1d(found[i], found[j]))}
    i, j, opened = linked(found, 85, columns=columns, sparse=sparse)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > 20
    sizes = np.array([len(s) for s in found])
    allowed = sum(185 * min(a, b) >= 85 * (a + b) for k, a in enumerate(sizes) for b in sizes[k + 1 :])
    assert len(want) <= opened <= allowed < len(found) * (len(found) - 1) / 2
    side = np.arange(len(found)) % 2
    i, j, _ = linked(found, 85, side, columns, sparse)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if (a + b) % 2}


def test_rows_of_one_group_that_share_or_lack_an_identifier(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58)) + " x y"
    rows = [(None, a, 1), (None, b, 2), (None, a, 3), (7, a, 4), (7, b, 5), (8, "other words that stand here alone", 6), (8, "other words that stand here alone", 7), (8, "quite another text of the same number", 8), (9, None, 9), (9, None, 10), (None, "", 11)]
    got = nj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, copies int"), 5, 80).collect()
    by = sorted((str(r.doc_id), r.text or "") for r in got)
    assert len([x for x in by if x[1] in (a, b)]) == 1 and [x for x in by if x[1] in (a, b)][0][0] == "None"
    assert [x for x in by if x[0] in ("8", "9")] == [("8", rows[5][1]), ("8", rows[7][1]), ("9", ""), ("9", "")] and ("None", "") in by and len(got) == 6


@pytest.mark.parametrize("sizes", [[100] * 12, [100] * 5 + [110, 120, 130, 140, 150, 160, 170]])
def test_a_run_that_is_a_star_stays_one(monkeypatch, sizes):
    """The held run shrinks to its first and last; what follows still gets edges to its first."""
    monkeypatch.setattr(nj, "HELD", 4)
    rows = [(1, 50, 1)] + [(5, n, 10 + i) for i, n in enumerate(sizes)] + [(9, 50, 90)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 4], strict=True)], ["h", "n", "node"]) for i in range(0, len(rows), 4)]
    got = [r for b in nj.edges_of_runs(batches, 85, 0) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in got if r["end"] is None} == {(10, 10 + i) for i in range(1, len(sizes))}
    assert not [r for r in got if r["end"] == 2]


def test_rows_without_own_ids_cost_what_others_do(spark):
    """Null, or equal, ids for thousands of near copies: the same links in about the same time, and repeated rows are read once."""
    import time

    rng = np.random.default_rng(9)
    vocabulary = np.array(["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(5000)])
    texts = []
    for _ in range(700):
        w = list(rng.choice(vocabulary, 120))
        texts += [" ".join(w), " ".join([*w[:60], "other", *w[61:]])]
    texts += [texts[0]] * 1000

    def run(ids):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
        began = time.time()
        found = sorted((r.n_shingles, r.n_links) for r in ngram_join(docs).collect())
        return found, time.time() - began

    run(range(len(texts)))
    own, took = run(range(len(texts)))
    assert own.count((117, 1)) == 1398 and own.count((117, 1001)) == 1002
    for ids in ([None] * len(texts), [7] * len(texts)):
        found, longer = run(ids)
        assert found == own and longer < 2 * took + 2
