"""Byte-level BPE by a sentencepiece model against the library of the rank file."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe
from quern.llm.bpe import Bpe, model_bytes, read_ranks, round_trip

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = Bpe(PATH, P.PATTERN)
CODEC = BPE.codec()

HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", " \n a", "it's we'll  I'd 's 'S", "\x00\x01\xa0\xad", "Ġ Ċ ▁ ▁▁x", "é è ü  　z", "naïve façade", "<unk> <s> <|endoftext|>", "🙂🙂🙂 👩‍👩‍👧", "1 22 ²³ ½ ١٢", "a\r\n\r\n b\x1c c\x85d",
    "x" * 5000, "ab" * 3000 + " " + "é" * 2000, "!" * 3000, " " * 3000, "你好，世界。", "Привет мир", "́á", "﻿x", "￿\U0010ffff",
]


def ids(text, codec=CODEC):
    return np.frombuffer(codec.encode([text])[0], "<u4").tolist()


def test_hard_texts():
    for t in [*HARD, "".join(HARD)]:
        assert ids(t) == OWN.encode_ordinary(t)
        assert CODEC.decode(CODEC.encode([t])[0]) == t.encode()


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    assert ids(t) == OWN.encode_ordinary(t)
    assert CODEC.decode(CODEC.encode([t])[0]) == t.encode()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t aBé'stl.*1\r\x1c🙂Ġ▁")), max_size=40))
def test_any_text_of_hard_characters(t):
    assert ids(t) == OWN.encode_ordinary(t)


def test_characters_that_unicode_versions_class_differently():
    odd = bpe.regex.findall(bpe.doubtful(), "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    for c in random.Random(1).sample(odd, min(60, len(odd))):
        for t in (f"a{c}b", f"1{c}1 {c}", f"!{c}! {c}a", c * 3):
            assert ids(t) == OWN.encode_ordinary(t)
        ranks = {bytes([b]): b for b in range(256)}
        for k in range(2, len(c.encode()) + 1):
            ranks[c.encode()[:k]] = len(ranks)
        for before in "a1!":  # ranks by which it shows whether the match goes on
            ranks[before.encode() + c.encode()] = len(ranks)
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        codec = bpe.Codec(sorted(ranks.values()), model_bytes(ranks), P.PATTERN, bpe.doubtful())
        for t in (f"a{c}", f"1{c}", f"!{c}", f" {c}a"):
            assert ids(t, codec) == own.encode_ordinary(t)


def test_other_ranks(tmp_path):
    """Ranks with gaps, and a token that merges don't reach."""
    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"th": 1000, b"he": 1001, b"the": 1002, b" the": 1003, b"qzj": 2000}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    codec = Bpe(str(path), P.PATTERN).codec()
    for t in ("the the qzj xqzj", "qzj", " theqzj hehe"):
        assert ids(t, codec) == own.encode_ordinary(t)
        assert codec.decode(codec.encode([t])[0]) == t.encode()
    with pytest.raises(ValueError, match="without a rank"):
        model_bytes({b"a": 0})


def test_the_model_is_one_of_sentencepiece():
    sp = sentencepiece.SentencePieceProcessor(model_proto=BPE.model)
    assert sp.get_piece_size() == len(RANKS) + 1 and sp.unk_id() == len(RANKS)
    assert [sp.get_score(i) for i in (0, 255, 50_000)] == [0, -255, -50_000]
    assert sp.decode(sp.encode("ĠhelloĠworld")) == "ĠhelloĠworld"


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(list(CODEC.bytes_of), BPE.model, P.PATTERN, bpe.doubtful())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(HARD)] == [OWN.encode_ordinary(t) for t in HARD]


def test_query_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["tree", "Stone.", "é", "a\nb", "你好"]) for _ in range(r.choice([0, 3, 50, 3000])))) for k in range(40)]
    rows += [(k, t) for k, t in enumerate(HARD)] + [(None, "no id"), (None, None), (7, "same"), (7, "same"), (8, None)]
    docs = spark.createDataFrame([(k, t, "x", b"y") for k, t in rows], "doc_id long, text string, ids string, decoded binary").repartition(3)

    def digest(t):
        return hashlib.sha256(np.array(OWN.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()

    want = [(k, len(OWN.encode_ordinary(t or "")), digest(t), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows]
    out = round_trip(docs, PATH, P.PATTERN)
    assert out.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().optimizedPlan().toString()
