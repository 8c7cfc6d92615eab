"""Token ids, lengths, packing and shards against the tokenizer itself, and exact round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import sstable, tokens
from quern.llm.packing import differencing, pack, windows
from quern.llm.sstable import Reader, find, key_of, round_trip, with_starts
from quern.llm.tokens import Encoder, at_limit, at_quantile, length_histogram

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ENC = Encoder(PATH)
SCHEMA = "doc_id long, text string"


def plain(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def made(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in ENC.many(texts)]


HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "\n", " \n", "\n a", "a\n b", "a \nb", "a\n \nb", "a\n\nb", "x.\n\nY z", "it's we'll  I'd 's", "a\tb \t c", "<|endoftext|> <|endoftext|>x", "a <|endoftext|> b", "x<|endoftext|>\n y  z", "<|endoftext |>",
    "é è ü  　z", "word***,word$$$ a.b", "\x1ca \x1cb", "🙂 🙂🙂  x", "1 22 333 4444a", "a\r\n b", "don’t — “so”", "x" * 300 + " " + "y" * 300, "Ö.Ä, ß!\nÉ", "a .\n b", "  \n  a  \n\n  b\t",
]


def test_hard_texts():
    assert made(HARD) == [plain(t) for t in HARD]
    assert made([" ".join(HARD), None]) == [plain(" ".join(HARD)), []]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t aBé'st.*1\r\x1c🙂")), max_size=40))
def test_any_text(t):
    assert made([t]) == [plain(t)]


def test_an_added_token_is_one_id():
    assert made(["a <|endoftext|> b"])[0].count(TOK.token_to_id("<|endoftext|>")) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "\n", "a", "B."]), max_size=12))
def test_added_tokens_anywhere(parts):
    t = "".join(parts)
    assert made([t, t + " x", "plain " + t]) == [plain(t), plain(t + " x"), plain("plain " + t)]


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    monkeypatch.setattr(tokens, "AT_ONCE", 20)
    assert made(HARD * 2) == [plain(t) for t in HARD * 2]


def documents(n=90, seed=1):
    r = random.Random(seed)
    rows = [(r.randrange(-(10**6), 10**6), " ".join(r.choice(["tree", "Stone.", "riversix", "é", "a\nb"]) for _ in range(r.choice([0, 3, 50, 900, 2500])))) for _ in range(n)]
    return rows + [(None, "no id"), (None, None), (7, "same"), (7, "same"), (7, "other"), (8, "")]


def test_histogram_answers_every_limit(spark):
    rows = documents()
    lengths = [len(plain(t)) for _, t in rows]
    hist = length_histogram(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, bucket=64).cache()
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(lengths)
    for r in hist.collect():
        limit = r.n_tokens
        assert r.docs_longer == sum(x > limit for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > limit)
        assert r.tokens_upto == sum(x for x in lengths if x <= limit)
        assert r.truncated_total == sum(min(x, limit) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    for share in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert at_quantile(hist, share).first().n_tokens == next(x for x in sorted(lengths) if sum(y <= x for y in lengths) >= share * len(lengths))
    for limit in (0, 1, 17, 1000, 10**6):
        r = at_limit(hist, limit).first()
        assert (r.tokens, r.docs_cut, r.tokens_kept) == (sum(lengths), sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    assert length_histogram(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_packing_covers_every_id_once(spark):
    rows = documents()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA + ", start int").repartition(2)
    got = [r.asDict() for r in pack(df, PATH, with_ids=True).collect()]
    want = Counter((d, tuple(plain(t) + [0])) for d, t in rows)
    docs, sequences = {}, {}
    for p in got:
        assert p["length"] == len(p["ids"]) > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        docs.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for d, pieces in docs.items():
        ids = Counter()
        for (i, x), n in want.items():
            if i == d:
                for a, t in enumerate(x):
                    ids[a, t, len(x)] += n
        assert Counter((p["start"] + k, t, p["doc_tokens"]) for p in pieces for k, t in enumerate(p["ids"])) == ids
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    total = sum(p["length"] for p in got)
    assert len(sequences) * 1024 <= total * 1.03 + 3 * 1024
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=80))
def test_windows_hold_all_items_within_capacity(sizes):
    got = windows(sizes, 1024)
    assert sorted(i for w in got for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 1024 for w in got)


def test_differencing_balances():
    r = random.Random(0)
    sizes = [r.randrange(1, 257) for _ in range(1000)]
    sums = [sum(sizes[i] for i in w) for w in differencing(sizes, 130)]
    assert len(sums) == 130 and max(sums) - min(sums) <= 10


def test_shards_round_trip(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in round_trip(df, PATH, shard_bytes=3000).collect()]
    got.sort(key=lambda r: r[1])
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in rows)
    start = 0
    for r in got:
        assert r[1] == start
        start += r[2]
    want = [(d, len(plain(t)) + 1, zlib.crc32(np.array(plain(t) + [0], "<u4").tobytes())) for d, t in rows]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter(want)
    assert round_trip(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_rows_without_identifier_are_dealt_to_many_tasks(spark, tmp_path):
    rows = [(None, f"text {i}") for i in range(300)] + [(None, "same")] * 300 + [(5, "x")]
    manifest = sstable.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/s", PATH).collect()
    assert len({r.part for r in manifest}) == 4 and sum(r.docs for r in manifest) == 601 and max(r.docs for r in manifest) < 400


def test_clashing_columns_change_nothing(spark):
    rows = documents(30)
    plain_, more = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(*r, 1, "a", 2.0, b"x") for r in rows], SCHEMA + ", start long, ids string, n_tokens double, th binary")
    for f in (lambda d: length_histogram(d, PATH), lambda d: round_trip(d, PATH).drop("start"), lambda d: pack(d, PATH).drop("sequence_id")):
        a, b = f(plain_), f(more)
        assert a.columns == b.columns and Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_lookup_by_bloom_filter_and_search(spark, tmp_path):
    rows = documents()
    to = f"file://{tmp_path}/shards"
    manifest = with_starts(sstable.write(spark.createDataFrame(rows, SCHEMA), to, PATH, shard_bytes=2000)).cache()
    assert manifest.count() > 4
    got = find(manifest, to, [7, 8, 123456789])
    assert sorted((i, x) for i, x in got) == sorted((d, plain(t) + [0]) for d, t in rows if d in (7, 8))
    name = manifest.first()["name"]
    with open(f"{tmp_path}/shards/{name}", "rb") as f:
        reader = Reader(f)
        keys = [k for k, _ in reader]
        assert keys == sorted(keys) and len(keys) == reader.docs
        assert all(len(reader.get(k)) >= 1 for k in keys) and reader.get(key_of(10**15)) == []
