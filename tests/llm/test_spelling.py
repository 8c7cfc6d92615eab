"""Spelling variants against plain Python that compares every two words."""

import random
import re
import zlib
from collections import Counter

from quern.llm.spelling import near_words, spelling_variants, variants, word_counts

SCHEMA = "doc_id long, text string"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def grouped(n, ratio=5):
    form, near = {}, {}
    for w in n:
        met = sorted((x for x in n if one_apart(w, x)), key=lambda x: (-n[x], x))
        near[w] = len(met)
        form[w] = met[0] if met and n[met[0]] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_random_words(spark):
    """Few letters and syllables: many anagrams, many near words, chains of forms."""
    for seed, letters in ((1, "ab"), (2, "abé"), (3, "×÷ßàÿ"), (4, ["er", "on", "th", "a"])):
        r = random.Random(seed)
        made = {"".join(r.choice(letters) for _ in range(r.randrange(2 if seed < 4 else 3, 9))) for _ in range(150)}
        n = {w: 5 ** r.randrange(1, 8) + r.randrange(3) for w in made if len(w) >= 6 or seed == 1}
        table = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
        assert got(variants(table)) == grouped(n)


def test_each_pair_comes_once(spark):
    r = random.Random(5)
    n = {"".join(r.choice("abc") for _ in range(r.randrange(2, 7))): r.randrange(1, 99) for _ in range(400)}
    pairs = [(x.a, x.b, x.n_a, x.n_b) for x in near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()]
    assert sorted(pairs) == sorted((a, b, n[a], n[b]) for a in n for b in n if a < b and one_apart(a, b))


def test_anagrams_meet_by_halves_only(spark):
    """All orders of eight letters are one class of anagrams: what meets is verified, and few meet."""
    from itertools import permutations

    words = ["".join(p) for p in permutations("abcdefg")] + ["abcdefgh", "abxdefg"]
    table = spark.createDataFrame([(w, 7) for w in words], "word string, n long")
    near = {frozenset((r.a, r.b)) for r in near_words(table).collect()}
    assert near == {frozenset(("abcdefg", "abcdefgh")), frozenset(("abcdefg", "abxdefg"))}


def documents():
    r = random.Random(7)
    base = ["grandeur", "Grandeur", "grandeurs", "lumière", "LUMIère", "lumiere", "ÉCLAIR", "éclairs", "Éclairs", "çamçam", "aaaaaa", "aaaaaaa", "aaaaaaaa", "petit", "stones", "tsones", "x" * 300, "x" * 301]
    rows = []
    for k in range(400):
        rows.append((r.choice([k, k, k - 10**6]), r.choice([" ", "-", "1", "\n"]).join(r.choice(base[: r.randrange(3, len(base))]) for _ in range(r.choice([0, 1, 30, 60])))))
    rows += [(20, "colours " * 300), (21, "colors " * 2), (22, "colours colors " * 30), (23, "colrs! " * 2), (24, "xcolors, " * 6)]
    return rows + [(None, "grandeur " * 50), (None, None), (5, None), (6, ""), (7, "7 8 9"), (8, "stones " * 9), (8, "stones " * 9), (9, "été" * 4 + "\U0001f642lumière"), (10, "grandeur " * 30_000)]


def test_query_against_plain_python(spark):
    rows = documents()
    docs = spark.createDataFrame([(k, t, "w", 3) for k, t in rows], "doc_id long, text string, word string, n long").repartition(5)
    want = counted(rows)
    assert {r.word: r.n for r in word_counts(docs).collect()} == want
    out = spelling_variants(docs)
    assert got(out) == grouped(want)
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert any(f and r != f for _, f, r, *_ in grouped(want)), "a chain of forms"


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "short ones")], SCHEMA)).collect() == []
