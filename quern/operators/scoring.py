"""Scores of chunks against a vocabulary: a pluggable batch scorer, then ranks and conditional probabilities."""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes a function from a batch of chunks to a list of logits for each, one per vocabulary entry.
Loader = Callable[[], Callable[[list[str]], list[list[float]]]]


#: The models that this worker has loaded, by the run that wants them.
_LOADED: dict[str, Callable] = {}


def stub_loader(vocabulary: list[str]) -> Loader:
    """A stand-in for a model: logits that only a hash of chunk and entry decides. It says nothing about skills."""

    def load():
        def score(texts: list[str]) -> list[list[float]]:
            return [[int.from_bytes(hashlib.sha256(f"{t}\x00{v}".encode()).digest()[:4], "little") / 2**32 * 8 - 4 for v in vocabulary] for t in texts]

        return score

    return load


@dataclass(frozen=True)
class Batches:
    """How rows are cut into the batches that a model is fed.

    ``rows`` is the most of a batch; ``padded``, if given, the most that its rows times its longest text may be, so that
    a batch of long texts fits where one of short ones does (a text that is longer by itself goes alone). A task
    gathers ``window`` batches' rows and cuts them in the order of ``length``, which counts a text's characters if not
    its tokens. Every batch then begins where the one before it ended, so padding every text to its batch's longest
    adds less than ``rows`` times the window's longest text to a whole window, whatever the order of the rows;
    nothing is shuffled for it. A window of 1 leaves rows as they come. No score depends on any of this.
    """

    rows: int = 20
    window: int = 100
    padded: int | None = None
    length: Callable[[str], int] = len

    def ends(self, sizes: list[int]) -> Iterator[int]:
        """Where the batches of texts of these lengths, in order, end."""
        begin, longest = 0, 0
        for i, n in enumerate(sizes):
            longest = max(longest, n)
            if i > begin and (i - begin == self.rows or (self.padded is not None and (i - begin + 1) * longest > self.padded)):
                yield i
                begin, longest = i, n
        if len(sizes) > begin:
            yield len(sizes)

    def window_of(self, df: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
        sizes = [self.length(t or "") for t in df[text]]
        order = sorted(range(len(sizes)), key=sizes.__getitem__) if self.window > 1 else range(len(sizes))
        begin = 0
        for end in self.ends([sizes[i] for i in order]):
            yield df.iloc[list(order[begin:end])]
            begin = end

    def of(self, frames: Iterable[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
        """The batches of all frames of a task, one window held at a time."""
        held, most = None, max(1, self.rows * self.window)
        for df in frames:
            held = df if held is None or held.empty else pd.concat([held, df], ignore_index=True)
            whole = len(held) // most * most
            for at in range(0, whole, most):
                yield from self.window_of(held.iloc[at : at + most], text)
            held = held.iloc[whole:]
        if held is not None:
            yield from self.window_of(held, text)


def _model(run_id: str, loader: Loader) -> Callable[[list[str]], list[list[float]]]:
    """The worker's model of one run; it holds one at a time."""
    from quern.operators.scoring import _LOADED as loaded  # the worker's own

    if run_id not in loaded:
        loaded.clear()
        loaded[run_id] = loader()
    return loaded[run_id]


def logits(chunks: DataFrame, loader: Loader, vocabulary: list[str], keys: list[str], batch: int | Batches = 20, text: str = "chunk", profile: ResourceProfile | None = None) -> DataFrame:
    """keys, skill, logit: every chunk against every entry. The model is loaded once per worker, whatever tasks it runs.

    It is fed batches of texts of about equal lengths (:class:`Batches`, or their number of rows). ``profile`` says what a
    task needs, such as an accelerator, where the cluster deals resources; a local session has none to deal.
    """
    run_id, cut = uuid.uuid4().hex, batch if isinstance(batch, Batches) else Batches(batch)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _model(run_id, loader)
        for part in cut.of(frames, text):
            rows = part[keys].copy()
            rows["skill"] = [vocabulary] * len(part)
            rows["logit"] = score([t or "" for t in part[text]])
            yield rows.explode(["skill", "logit"]).astype({"logit": "float64"})

    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    return chunks.select(*keys, text).mapInPandas(run, ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", skill string, logit double", profile=profile)


def best(chunks: DataFrame, loader: Loader, vocabulary: list[str], keys: list[str], k: int = 10, batch: int | Batches = 20, text: str = "chunk", profile: ResourceProfile | None = None) -> DataFrame:
    """:func:`ranked` of :func:`logits` for each row, made where the row is scored: of the vocabulary only the best ``k`` leave the worker.

    A heap of ``k`` entries is kept a row; nothing is shuffled. Rows with equal keys are ranked apart. ``batch`` and
    ``profile`` are those of :func:`logits`.
    """
    run_id, cut = uuid.uuid4().hex, batch if isinstance(batch, Batches) else Batches(batch)

    def top(scores: list[float]) -> list[tuple[str, float, float, int, float]]:
        first = heapq.nsmallest(k, zip(scores, vocabulary, strict=True), key=lambda x: (-x[0], x[1]))
        if not first:
            return []
        most = first[0][0] if k else max(scores)
        total = math.fsum(math.exp(x - most) for x in scores)
        out, left = [], 1.0
        for rank, (x, skill) in enumerate(first, 1):
            p = math.exp(x - most) / total
            out.append((skill, x, p, rank, p / left if left > 0 else None))
            left -= p
        if len(first) == len(scores):  # nothing is left after the last: it is certain
            skill, x, p, rank, _ = out[-1]
            out[-1] = (skill, x, p, rank, 1.0 if p > 0 else None)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _model(run_id, loader)
        for part in cut.of(frames, text):
            rows = part[keys].copy()
            rows["_best"] = [top([float(x) for x in s]) for s in score([t or "" for t in part[text]])]
            rows = rows.explode("_best").dropna(subset=["_best"])
            for i, (c, kind) in enumerate((("skill", object), ("logit", "float64"), ("sm_score", "float64"), ("rank", "int32"), ("score", "float64"))):
                rows[c] = pd.Series([x[i] for x in rows["_best"]], index=rows.index, dtype=kind)
            yield rows.drop(columns="_best")

    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    return chunks.select(*keys, text).mapInPandas(run, ", ".join(f"`{c}` {fields[c]}" for c in keys) + ", skill string, logit double, sm_score double, rank int, score double", profile=profile)


def softmax(x: str | Column, keys: list[str]) -> Column:
    """Probabilities within ``keys``; shifted by the maximum, so large values don't overflow."""
    w = Window.partitionBy(*keys)
    c = F.col(x) if isinstance(x, str) else x
    e = F.exp(c - F.max(c).over(w))
    return e / F.sum(e).over(w)


def ranked(rows: DataFrame, keys: list[str], score: str = "logit", k: int = 10, label: str = "skill") -> DataFrame:
    """The best ``k`` of each chunk: sm_score, rank, and score, the probability given that none before was right.

    That is p over what the better ones leave of the whole. Ties go by label. One window over the keys serves
    ranks, sums and softmax.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(score), label)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("sm_score", softmax(score, keys)).withColumn("rank", F.row_number().over(order))
    left = F.sum("sm_score").over(Window.partitionBy(*keys)) - F.coalesce(F.sum("sm_score").over(before), F.lit(0.0))
    return out.withColumn("score", F.try_divide(F.col("sm_score"), left)).filter(F.col("rank") <= k)
