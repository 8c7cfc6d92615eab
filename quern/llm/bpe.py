"""Byte-level BPE by a sentencepiece model that is written from a rank file (operator 12).

A token's bytes are mapped to visible characters, one a byte; the piece so spelled scores minus its rank, and text is
taken as it is. Sentencepiece then joins, again and again, the neighbours whose piece scores highest, the leftmost
first: the merges of the rank file. Each match of the pattern is encoded alone; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import varint

#: Matches kept in memory by one worker, longest match kept, and characters handled at once. None changes the ids.
CACHE, LONGEST, AT_ONCE = 700_000, 48, 4_000_000
#: Bytes that are their own character; the others take the characters from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in set(_VISIBLE)]
#: Character of each byte, for bytes read as Latin-1; and back.
SPELLED = {b: b for b in _VISIBLE} | {b: 256 + k for k, b in enumerate(_HIDDEN)}
BYTE_OF = {c: b for b, c in SPELLED.items()}
#: Wire types and numbers of the fields of a sentencepiece model that are written here (fixed values of the format).
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and number a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _field(1, _field(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def spelled(raw: bytes) -> str:
    return raw.decode("latin-1").translate(SPELLED)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks' order; the unknown piece, which no bytes reach, comes last.

    Scores are 32-bit floats, so ranks must stay below 2^24. Every single byte must have a rank.
    """
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a rank: {missing}")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks from 2^24 on are not exact scores")
    pieces = [_piece(spelled(token), -float(rank), _NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _number(3, _BPE)
    identity = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)  # no prefix, no trimming, no escapes
    return b"".join(pieces) + _piece("<unk>", 0.0, _UNKNOWN) + _field(2, trainer) + _field(3, identity)


@lru_cache(1)
def doubtful() -> str:
    """A class of the characters that Python's own Unicode tables don't put where the pattern's library does."""
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    letters, numbers = set(regex.findall(r"\p{L}", everything)), set(regex.findall(r"\p{N}", everything))
    odd = [ord(c) for c in everything if (c in letters) != ((k := unicodedata.category(c)[0]) == "L") or (c in numbers) != (k == "N")]
    spans: list[list[int]] = []
    for c in odd:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]" if spans else r"(?!)"


@lru_cache(100_000)
def stand_in(char: str, pattern: str) -> str:
    """A character that every Unicode version puts where tiktoken's puts ``char``: a letter, a number or another mark.

    Which it is shows in whether tiktoken keeps it in one match with a letter, a number or a mark before it.
    """
    import tiktoken

    raw = char.encode()
    for before, like in (("a", "ƀ"), ("1", "²"), ("!", "¬")):
        ranks = {bytes([b]): b for b in range(256)}
        for k in range(2, len(raw) + 1):
            ranks[raw[:k]] = len(ranks)
        ranks[before.encode() + raw] = len(ranks)
        if len(tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(before + char)) == 1:
            return like
    return char


class Codec:
    """Encodes and decodes; ids are ranks, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: list[int], model: bytes, pattern: str, odd: str):
        import sentencepiece

        self.pattern, self.split, self.odd = pattern, regex.compile(pattern), regex.compile(odd)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = None if ranks == list(range(len(ranks))) else ranks
        self.bytes_of = {r: bytes(map(BYTE_OF.__getitem__, map(ord, self.sp.id_to_piece(i)))) for i, r in enumerate(ranks)}
        # a match that is a token is that token, whether or not merges lead to it
        names = [self.sp.id_to_piece(i) for i in range(len(ranks))]
        self.whole = {self.bytes_of[r]: self._packed([r]) for i, (r, ids) in enumerate(zip(ranks, self.sp.encode(names, num_threads=1), strict=True)) if ids != [i]}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def matches(self, text: str) -> list[str]:
        """What the pattern cuts the text into, by tiktoken's Unicode tables."""
        if text.isascii() or not (odd := set(self.odd.findall(text))):
            return self.split.findall(text)
        like = text.translate({ord(c): stand_in(c, self.pattern) for c in odd})
        return [text[m.start() : m.end()] for m in self.split.finditer(like)]

    def _new(self, parts: list[str]) -> list[bytes]:
        raw = [p.encode() for p in parts]
        got = self.sp.encode([spelled(r) for r in raw], num_threads=1)
        if self.ranks is not None:
            got = [[self.ranks[i] for i in ids] for ids in got]
        if array("I").itemsize == 4 and np.little_endian:
            out = [array("I", ids).tobytes() for ids in got]
        else:
            out = list(map(self._packed, got))
        return [self.whole.get(r, ids) for r, ids in zip(raw, out, strict=True)] if self.whole else out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        lists = [self.matches(t) for t in texts]
        unknown = list(set().union(*lists).difference(self.known))
        fresh: dict[str, bytes] = {}
        for i in range(0, len(unknown), 20_000):
            some = unknown[i : i + 20_000]
            fresh.update(zip(some, self._new(some), strict=True))
        if len(self.known) < CACHE:  # what is frequent comes early
            self.known.update((p, v) for p, v in fresh.items() if len(p) <= LONGEST)
        known = self.known
        return [b"".join([v if (v := known.get(p)) is not None else fresh[p] for p in parts]) for parts in lists]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def _codec(ranks: tuple[int, ...], model: bytes, pattern: str, odd: str) -> Codec:
    return Codec(list(ranks), model, pattern, odd)


class Bpe:
    """Columns of texts to ids and back, by the ranks in ``path``, which only the driver reads.

    The tasks get the model itself, a megabyte for 50,000 tokens, whatever the size of the data.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.model = model_bytes(ranks)
        self._how = tuple(sorted(ranks.values())), self.model, pattern, doubtful()

    def codec(self) -> Codec:
        return _codec(*self._how)

    def encode(self, docs: DataFrame, text: str = "text", into: str = "ids") -> DataFrame:
        """Adds the ids of each whole text as bytes, four an id; null counts as empty."""
        how = self._how

        def work(texts: list[str | None]) -> Iterator[bytes]:
            codec = _codec(*how)
            at = 0
            while at < len(texts):
                some, held = [], 0
                while at < len(texts) and (not some or held < AT_ONCE):
                    some.append(texts[at] or "")
                    held += len(some[-1])
                    at += 1
                yield from codec.encode(some)

        return _mapped(docs, text, into, work)

    def decode(self, docs: DataFrame, ids: str = "ids", into: str = "decoded") -> DataFrame:
        """Adds the bytes that the ids stand for; null counts as no ids."""
        how = self._how
        return _mapped(docs, ids, into, lambda column: map(_codec(*how).decode, (x or b"" for x in column)))


def _mapped(docs: DataFrame, column: str, into: str, work) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(work(b.column(b.schema.get_field_index(column)).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, into])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every whole text encoded and its ids decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null texts count as empty; empty texts have no ids. Rows are kept one for one, with null, equal or repeated ids as
    they come; an empty table gives no rows. Only ``doc_id`` and the text are read, whatever other columns are called.
    Texts of any length are encoded whole. Nothing is shuffled.
    """
    bpe = Bpe(path, pattern)
    coded = bpe.decode(bpe.encode(docs.select("doc_id", F.col(text).cast("string").alias("text"))).drop("text"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
