"""Token ids of whole texts, and the exact length histogram (operator 6).

Texts are cut before every single space that a visible character follows. Byte-level BPE never merges
across such a place, so the ids of the parts, joined, are the ids of the text; each distinct part is
encoded once by the tokenizers library and remembered. The library reads the tokenizer's added tokens (special
ones among them) as one id wherever they stand; texts that hold the string of one go to the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch

_CUT = re.compile(r" (?=\S)")
#: Empty, or beginning with white space of any kind.
_ODD = r"^$|^[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Parts kept in memory by one worker, longest part kept, and bytes handled at once. None changes the ids.
CACHE, LONGEST, AT_ONCE = 700_000, 64, 4_000_000
#: Marks that end a word and are no part of a contraction.
MARKS = ".,!?;:"


class Encoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tok = Tokenizer.from_file(path)  # for parts, which hold no added token
        self.tok.encode_special_tokens = True
        added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(re.escape(t) for t in added) if added else None
        self.head: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        vocabulary = self.tok.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        # the pattern of byte-level BPE ends a word before a mark, and marks before a space
        how = json.loads(self.whole.to_str()).get("pre_tokenizer") or {}
        self.apart = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space", True)

    def _each(self, into: dict, parts: list[str], prefix: str) -> None:
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            for part, enc in zip(some, self.tok.encode_batch_fast([prefix + x for x in some], add_special_tokens=False), strict=True):
                into[part] = np.array(enc.ids, "<u4").tobytes()

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without spaces that follow one; a word with marks at its end is known by the word and by the marks."""
        if not self.apart:
            return self._remembered(parts)
        words, marks = [], []
        for p in parts:
            w = p.rstrip(MARKS)
            apart = len(w) < len(p) and w[-1:].isalpha()
            words.append(w if apart else p)
            marks.append(p[len(w) :] if apart else "")
        some = {m for m in marks if m not in self.marks}
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
            some = set(marks) - {""}
        self._each(self.marks, list(some), "")
        ids = list(map(self.tail.get, words))
        unknown = list(dict.fromkeys(w for w, v in zip(words, ids, strict=True) if v is None))
        fresh = dict(zip(unknown, self._remembered(unknown), strict=True))
        return [(v if v is not None else fresh[w]) + self.marks[m] for w, v, m in zip(words, ids, marks, strict=True)]

    def _remembered(self, parts: list[str]) -> list[bytes]:
        """Encodes parts, and remembers them while there is room: what is frequent comes early."""
        out = self._encoded(parts)
        if len(self.tail) < CACHE:
            self.tail.update((p, v) for p, v in zip(parts, out, strict=True) if len(p) <= LONGEST)
        return out

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Many at once, joined by their spaces, are told apart by the tokens that begin with one."""
        out: list[bytes] = []
        for i in range(0, len(parts), 10_000):
            some = parts[i : i + 10_000]
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some):
                alone: dict[str, bytes] = {}
                self._each(alone, some, " ")
                out += map(alone.__getitem__, some)
                continue
            raw, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            out += map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))
        return out

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        return self.column(pa.array(texts, pa.large_string()))

    def column(self, texts: pa.Array) -> list[bytes]:
        """The same for an Arrow array, which is cut and deduplicated outside Python."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends, out, at = np.cumsum(np.asarray(pc.binary_length(texts))), [], 0
        while at < len(texts):
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
            out += self._parted(texts.slice(at, to - at))
            at = to
        return out

    def _parted(self, texts: pa.Array) -> list[bytes]:
        apart = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, self.added))) if self.added else ()
        if not len(apart):
            return self._slice(texts)
        holds = np.zeros(len(texts), bool)
        holds[apart] = True
        out = self._slice(pc.if_else(pa.array(holds), "", texts))
        for i in apart.tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _slice(self, texts: pa.Array) -> list[bytes]:
        if len(self.head) > CACHE // 8:
            self.head.clear()
        lists = pc.split_pattern(texts, " ")
        ends = np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)
        firsts = np.r_[0, ends[:-1]]
        encoded_ = lists.flatten().dictionary_encode()
        codes, parts = np.asarray(encoded_.indices), encoded_.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = np.asarray(pc.match_substring_regex(encoded_.dictionary, _ODD))
        follows = np.ones(len(codes), bool)
        follows[firsts] = False
        slow = np.unique(np.searchsorted(ends, np.flatnonzero(odd[codes] & follows), "right"))  # a space next to white space
        wanted = np.zeros(len(parts), bool)
        wanted[codes[follows]] = True
        wanted[odd] = False
        ids: list[bytes | None] = list(map(self.tail.get, parts))
        new = [i for i, (v, want) in enumerate(zip(ids, wanted.tolist(), strict=True)) if want and v is None]
        names = [parts[i] for i in new]
        for i, v in zip(new, self._ids(names), strict=True):
            ids[i] = v
        for i in np.flatnonzero(odd).tolist():  # of slow texts, which are encoded apart
            ids[i] = b""
        heads = [parts[c] for c in codes[firsts].tolist()]
        self._each(self.head, list(set(heads).difference(self.head)), "")
        pieces = list(map(ids.__getitem__, codes.tolist()))
        for i, h in zip(firsts.tolist(), heads, strict=True):
            pieces[i] = self.head[h]
        out = [b"".join(pieces[x:y]) for x, y in zip(firsts.tolist(), ends.tolist(), strict=True)]
        for i in slow.tolist():
            out[i] = self._hard(texts[i].as_py())
        for h in heads:
            if len(h) > LONGEST:
                self.head.pop(h, None)
        return out

    def _hard(self, text: str) -> bytes:
        """Ids of a text that has a space next to other white space."""
        first, *rest = _CUT.split(text)
        known = {x: v for x in set(rest) if (v := self.tail.get(x)) is not None}
        new = [x for x in set(rest) if x not in known]
        plain = [x for x in new if " " not in x]
        known.update(zip(plain, self._ids(plain), strict=True))
        self._each(known, [x for x in new if " " in x], " ")
        head: dict[str, bytes] = {}
        self._each(head, [first], "")
        return head[first] + b"".join(map(known.__getitem__, rest))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; what one task has learnt serves the next."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = 0, rows: int = 2000) -> Iterator[tuple[list, list[bytes]]]:
    """(first column, ids of the second column with ``end_id`` after each) of small groups of rows."""
    enc, end = encoder(path), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), [x + end for x in enc.column(part.column(1))]


def lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row ``n_tokens`` per document, without an end id."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                got = enc.column(b.column(0).slice(at, 2000))
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in got], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text", bucket: int = 1024) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums, one row per length that occurs.

    For a context limit L equal to the row's ``n_tokens``: ``docs_longer`` and ``tokens_longer`` count the
    documents of more than L tokens, ``tokens_upto`` the tokens of the others, ``truncated_total`` is the sum
    of min(length, L), and ``quantile`` the share of documents of at most L tokens. Between two rows nothing
    changes but ``truncated_total``, which grows by ``docs_longer`` a token, so every limit is answered:
    see :func:`at_limit`. Null and empty texts have length 0. An empty table gives no rows.

    Only lengths are shuffled, added up before the shuffle. Suffix sums go by two levels: buckets of
    ``bucket`` lengths, then the lengths of each bucket, so that no task holds all lengths. Columns other than
    ``text`` are never read, whatever their names.
    """
    hist = lengths(docs, tokenizer, text).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    hist = Scratch(docs.sparkSession, "lengths").keep(hist, "histogram")  # it is read twice, the texts once
    hist = hist.withColumn("b", F.expr(f"n_tokens div {int(bucket)}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    top = hist.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = top.select("b", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("later_d"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("later_t"), F.sum("bd").over(everything).alias("all_d"), F.sum("bt").over(everything).alias("all_t"))
    inside = Window.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(top, "b").withColumns({"docs_longer": F.col("later_d") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "tokens_longer": F.col("later_t") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    upto = F.col("all_t") - F.col("tokens_longer")
    return out.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", upto.alias("tokens_upto"),
        (upto + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        (1 - F.col("docs_longer") / F.col("all_d")).alias("quantile"),
    )


def at_quantile(hist: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of all documents don't exceed, from the histogram's rows alone; null without documents."""
    return hist.agg(F.min(F.when(F.col("quantile") >= share, F.col("n_tokens"))).alias("n_tokens"))


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """Total tokens, documents cut and tokens kept under any context limit, from the histogram's rows alone."""
    over = F.col("n_tokens") > limit
    return hist.agg(
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_kept"),
    )
