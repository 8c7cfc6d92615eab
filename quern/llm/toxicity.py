"""Toxicity of texts (operator 9): a subsequence string kernel, Nystroem landmarks and a support vector machine on labelled texts.

The kernel of two strings sums, over all common subsequences of three characters that span at most ``SPAN``, the
decay to the power of the lengths they span in both, normalised, so inserted characters and gaps only lower it. Two
texts are as alike as their strings match: a text is the sum, over its distinct strings, of how well each matches
the landmarks, and the machine is a plane over these sums, trained on the texts' labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, let_go
from quern.llm.shingles import set_hash, sets

DECAY, SPAN = 0.7, 6
#: Where a kernel value counts as half a match, how fast it grows to a whole one, and below what it counts nothing.
MIDDLE, WIDTH, FLOOR = 0.55, 0.05, 0.4
#: Landmarks of a group on average.
GROUP = 8
#: a-z, 0-9, 26 for letters of other scripts, a string's start and end, and the padding between strings.
START, END, PAD, SYMBOLS = 62, 63, 64, 65
#: Strings longer than this are also taken as windows of this length, so often that every shorter stretch lies in one.
WINDOW, STEP = 16, 4
#: Longest string that may become a landmark.
LONGEST = 64
#: Words whose evidence one worker remembers, and characters looked at in one go. Neither changes a score.
CACHE, POOLED, AT_ONCE = 400_000, 200_000, 400_000
#: Three or more words in a row of one or two characters: what gaps of white space make of a word.
_GAPPED = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
_THRICE = re.compile(r"(.)\1{2,}", re.S)
#: Distances of a subsequence's second and third character from its first, and its weight.
_SHAPES = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]


def symbol(c: str) -> str | None:
    """The character that stands for ``c``, its ordinal one above the symbol's; None for what is no letter or digit.

    Letters with marks count as those without (``é`` as ``e``); those of other scripts share 26 symbols.
    """
    if not c.isalnum():
        return None
    base = unicodedata.normalize("NFKD", c)[0].lower()
    if "a" <= base <= "z":
        return chr(1 + ord(base) - 97)
    if "0" <= base <= "9":
        return chr(1 + 26 + ord(base) - 48)
    return chr(1 + 36 + ord(base) % 26)


class _Symbols(dict):
    def __missing__(self, c):
        self[c] = symbol(chr(c))
        return self[c]


_TABLE = _Symbols()


def plain(word: str) -> str:
    """A word in symbols, without its marks."""
    return word.lower().translate(_TABLE)


def pieces(word: str) -> list[str]:
    """The strings that a word in symbols is taken as: itself, its windows if it is long, and it without characters that come three times in a row or more."""
    out = [word]
    single = _THRICE.sub(r"\1", word)
    for s in (word, single) if single != word else (word,):
        if s != word:
            out.append(s)
        if len(s) > WINDOW:
            out += [s[i : i + WINDOW] for i in range(0, len(s) - WINDOW + STEP, STEP)]
    return out


class Reader:
    """Texts to their distinct words in symbols; a worker remembers those of words."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def words(self, text: str | None) -> set[str]:
        """Distinct words of a whole text; runs of words of one or two characters, what gaps of white space make of a word, count joined, too."""
        text = text or ""
        found = {*text.split(), *("".join(run.split()) for run in _GAPPED.findall(text))}
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in found.difference(known):
            known[w] = plain(w)
        out = set(map(known.__getitem__, found))
        out.discard("")
        return out


@dataclass
class Laid:
    """Strings in symbols laid end to end with padding: where each begins, its size with its ends, and all their subsequences.

    ``codes`` has, for each shape, the subsequence that begins at each place; one that would reach beyond its string holds
    padding.
    """

    starts: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray
    codes: list[np.ndarray]

    @classmethod
    def of(cls, strings: list[str]) -> Laid:
        gap = chr(1 + END) + chr(1 + PAD) * (SPAN - 1)
        raw = np.frombuffer((chr(1 + START) + (gap + chr(1 + START)).join(strings) + gap).encode("latin-1"), np.uint8)
        c = raw.astype(np.int32) - 1
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 2
        n = len(c) - SPAN + 1
        first, second = c[:n] * (SYMBOLS * SYMBOLS), c * SYMBOLS
        codes = [first + second[a : a + n] + c[b : b + n] for a, b, _ in _SHAPES]
        return cls(np.cumsum(sizes + SPAN - 1) - (sizes + SPAN - 1), sizes, c, codes)

    def norms(self) -> np.ndarray:
        """Lengths of the strings' features: equal subsequences of a string add up first."""
        n = len(self.codes[0])
        which = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, n]))
        key, end = which * SYMBOLS**3, (self.starts + self.sizes)[which] - np.arange(n)
        keys, weights = [], []
        for (_, b, w), code in zip(_SHAPES, self.codes, strict=True):
            inside = np.flatnonzero(end > b)
            keys.append(key[inside] + code[inside])
            weights.append(np.full(len(inside), w))
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = np.add.reduceat(weights, first)
        return np.sqrt(np.maximum(np.bincount(keys[first] // SYMBOLS**3, sums * sums, len(self.starts)), 1e-12))


def _groups(strings: list[str], most: int = AT_ONCE):
    """Slices of strings of about ``most`` characters."""
    ends = np.cumsum([len(s) + 2 for s in strings])
    at = 0
    while at < len(strings):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def features(string: str) -> dict[int, float]:
    """The feature map of one string in symbols: subsequence to weight."""
    s, out = [START, *(ord(c) - 1 for c in string), END], {}
    for i in range(len(s)):
        for a, b, w in _SHAPES:
            if i + b < len(s):
                code = (s[i] * SYMBOLS + s[i + a]) * SYMBOLS + s[i + b]
                out[code] = out.get(code, 0.0) + w
    norm = sum(v * v for v in out.values()) ** 0.5
    return {c: v / norm for c, v in out.items()}


class _Table:
    """Weights of subsequences in some columns; those that have none are the last row."""

    def __init__(self, maps: list[dict[int, float]]):
        codes = np.unique(np.array([c for m in maps for c in m], np.int64))
        self.row = np.full(SYMBOLS**3, len(codes), np.int16 if len(codes) < 2**15 else np.int32)
        self.row[codes] = np.arange(len(codes))
        self.weights = np.zeros((len(codes) + 1, len(maps)), np.float32)
        for j, m in enumerate(maps):
            self.weights[self.row[np.fromiter(m, np.int64, len(m))], j] = list(m.values())

    def sums(self, laid: Laid, some: np.ndarray | None = None) -> np.ndarray:
        """Of each string, or of some: the weights of all its subsequences, added up."""
        if some is None:
            at, starts = slice(None), laid.starts
        else:
            sizes = laid.sizes[some]
            starts = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) + np.repeat(laid.starts[some] - starts, sizes)
        total = None
        for (_, _, w), code in zip(_SHAPES, laid.codes, strict=True):
            part = self.weights[self.row[code[at]]]
            part *= np.float32(w)
            total = part if total is None else np.add(total, part, out=total)
        return np.add.reduceat(total, starts, axis=0)


class Landmarks:
    """Strings that others are compared with.

    Landmarks that are alike form a group. Of each subsequence a group has the largest weight in any of its landmarks, so
    one sum for a group bounds the kernel with all of them; only strings whose bound reaches ``FLOOR`` meet the
    landmarks themselves. Smaller values count nothing (see :func:`soft`), so nothing is lost.
    """

    def __init__(self, strings: list[str]):
        self.strings, maps = strings, [features(m) for m in strings]
        self.groups: list[np.ndarray] = []
        self.every: _Table | None = None
        if not strings:
            return
        self.every = _Table(maps)
        like, own = self.kernel(strings), [0]
        best = like[:, 0].copy()
        while len(own) < -(-len(strings) // GROUP):  # the landmark least like those that lead a group
            own.append(int(best.argmin()))
            best = np.maximum(best, like[:, own[-1]])
        nearest = like[:, own].argmax(axis=1)
        self.groups = [g for g in (np.flatnonzero(nearest == j) for j in range(len(own))) if len(g)]
        bounds = []
        for g in self.groups:
            most: dict[int, float] = {}
            for j in g.tolist():
                for code, w in maps[j].items():
                    most[code] = max(w, most.get(code, 0.0))
            bounds.append(most)
        self.bounds, self.parts = _Table(bounds), [_Table([maps[j] for j in g.tolist()]) for g in self.groups]

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Kernel of every string with every landmark."""
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        for at, to in _groups(strings, 10_000):
            laid = Laid.of(strings[at:to])
            out[at:to] = self.every.sums(laid) / laid.norms()[:, None]
        return out

    def matches(self, words: list[str]) -> np.ndarray:
        """How well each word's best string matches each landmark, from 0 to 1."""
        out = np.zeros((len(words), len(self.strings)), np.float32)
        if not self.groups:
            return out
        parts, owner = [], []
        for i, w in enumerate(words):
            p = pieces(w)
            parts += p
            owner += [i] * len(p)
        owner = np.array(owner, np.int64)
        for at, to in _groups(parts, 20_000):
            laid = Laid.of(parts[at:to])
            norms = laid.norms()
            reach = self.bounds.sums(laid) >= (FLOOR - 1e-4) * norms[:, None]
            for g, table, may in zip(self.groups, self.parts, reach.T, strict=True):
                some = np.flatnonzero(may)
                if len(some):
                    k = soft(table.sums(laid, some) / norms[some, None])
                    own = owner[at + some]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    cells = np.ix_(own[first], g)
                    out[cells] = np.maximum(out[cells], np.maximum.reduceat(k, first, axis=0))
        return out


def soft(k: np.ndarray) -> np.ndarray:
    """How much of a match a kernel value is; below FLOOR it is none."""
    return np.where(k < FLOOR, 0, 1 / (1 + np.exp((MIDDLE - k) / WIDTH)))


@dataclass
class Model:
    """The landmarks' weights, the machine's bias, and the logistic curve from decisions to probabilities."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    slope: float = 4.0
    shift: float = 0.0

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30)))


class Scorer:
    """Decisions of texts: the bias and the evidence of each distinct word. A worker remembers that of words."""

    def __init__(self, model: Model):
        self.model, self.landmarks, self.reader = model, Landmarks(model.landmarks), Reader()
        self.landmarks.every = None  # texts only meet the groups' tables
        self.known: dict[str, float] = {}

    def evidence(self, words: list[str]) -> np.ndarray:
        return self.landmarks.matches(words) @ self.model.weights

    def texts(self, texts: list[str | None]) -> np.ndarray:
        bags = [self.reader.words(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*bags).difference(self.known))
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            self.known.update(zip(some, self.evidence(some).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([self.model.bias + math.fsum(map(get, b)) for b in bags])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return self.model.probability(self.texts(texts))


_SCORERS: dict[str, Scorer] = {}


def _scorer(key: str, held: Broadcast) -> Scorer:
    """The worker's scorer of one run: what one task has learnt of words serves the next."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(held.value)
    return _SCORERS[key]


def unlike(strings: list[str], most: int, alike: float = 0.8) -> list[str]:
    """The first ``most`` strings of which none is as like an earlier one as ``alike``."""
    if not strings:
        return []
    k, own = Landmarks(strings).kernel(strings), [0]
    for i in range(1, len(strings)):
        if len(own) == most:
            break
        if k[i, own].max() < alike:
            own.append(i)
    return [strings[i] for i in own]


def plane(x: np.ndarray, y: np.ndarray, penalty: float, use: np.ndarray | None = None, block: int = 2048) -> np.ndarray:
    """Weights and bias of the squared-hinge support vector machine over the rows in use, both classes weighing the same; the bias is hardly penalised."""
    use = np.ones(len(x), bool) if use is None else use
    s = np.where(y > 0, 1.0, -1.0)
    w = np.where(y > 0, 0.5 / max(1, ((y > 0) & use).sum()), 0.5 / max(1, ((y <= 0) & use).sum()))
    ridge, v, before = penalty * np.eye(x.shape[1] + 1), np.zeros(x.shape[1] + 1), None
    ridge[-1, -1] = 1e-6
    for _ in range(100):  # Newton steps over the rows inside the margin
        active = use & (s * (x @ v[:-1] + v[-1]) < 1)
        if before is not None and np.array_equal(active, before):
            break
        left, right = ridge.copy(), np.zeros(len(v))
        for at in range(0, len(x), block):
            rows = at + np.flatnonzero(active[at : at + block])
            z = np.c_[x[rows], np.ones(len(rows))]
            wz = w[rows, None] * z
            left += wz.T @ z
            right += wz.T @ s[rows]
        v, before = np.linalg.solve(left, right), active
    return v


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of labels over decisions, with a weak penalty; Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    v = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        step = np.linalg.solve(a.T @ ((p * (1 - p))[:, None] * a) + 1e-2 * np.eye(2), a.T @ (p - t) + 1e-2 * (v - [4.0, 0.0]))
        v -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(v[0], 0.1)), float(v[1])


def fit(sums: np.ndarray, y: np.ndarray, landmarks: list[str], penalty: float = 3e-3, folds: int = 5) -> Model:
    """The machine over texts, given each text's sum of matches with every landmark, in Nystroem coordinates of the landmarks.

    The logistic curve is fitted to decisions of machines that haven't seen the text: every ``folds``-th row is left out in turn.
    """
    values, vectors = np.linalg.eigh(soft(Landmarks(landmarks).kernel(landmarks).astype("f8")))
    keep = values > 1e-2 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x, unseen = np.empty((len(y), root.shape[1])), np.zeros(len(y))
    for at in range(0, len(y), 2048):
        x[at : at + 2048] = sums[at : at + 2048] @ root
    v = plane(x, y, penalty)
    for k in range(folds):
        out = np.arange(len(y)) % folds == k
        if out.any() and len(set(y[~out])) == 2:
            other = plane(x, y, penalty, ~out)
            unseen[out] = x[out] @ other[:-1] + other[-1]
        else:
            unseen[out] = x[out] @ v[:-1] + v[-1]
    return Model(landmarks, root @ v[:-1], float(v[-1]), *logistic(unseen, y))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, landmarks: int = 250, least: int = 3, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fits a model on at most ``sample`` labelled texts of each class (those of smallest hash of the identifier).

    The landmarks are the strings whose presence separates the two classes most, by the statistic of two shares, and
    that aren't much like each other: ``landmarks`` at most, each of ``least`` toxic texts and at most LONGEST letters. Every text of the
    sample is counted whole; texts with equal sets of shingles and one label count once. The machine then learns from
    the texts' sums of matches. Of a repeated identifier the largest label counts; rows with a null identifier or
    label teach nothing. Without labels of both kinds, or without a string that separates them, every text scores low.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(toxic).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = spark.createDataFrame([tuple(r) for c in chosen for r in c.collect()], "id long, y int")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def bags(batches):
        """Each text's words, and the hash of its set of shingles, which copies share."""
        let_go()
        reader = Reader()
        for b in batches:
            text_ = b.column(1).to_pylist()
            copy = [set_hash(s) if len(s) else None for s in sets(text_, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(copy, pa.int64()), b.column(0), pa.array([sorted(reader.words(t)) for t in text_], pa.list_(pa.string()))], ["copy", "y", "words"])

    every = texts.select("y", "text").mapInArrow(bags, "copy long, y int, words array<string>")
    bag = Scratch(spark, "toxicity").keep(every.groupBy("copy", "y").agg(F.max("words").alias("words")).select("y", "words"), "bags")
    total = {r["y"]: r["count"] for r in bag.groupBy("y").count().collect()}
    if not total.get(0) or not total.get(1):
        return Model(shift=-2.0 if total.get(0) else 0.0)
    counts = bag.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    both = (F.col("p") + F.col("n")) / (total[0] + total[1])
    z = (F.col("p") / total[1] - F.col("n") / total[0]) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / total[0] + 1 / total[1]))
    top = counts.filter((F.col("p") >= least) & (F.length("w") <= LONGEST)).select("w", z.alias("z")).filter("z > 2").orderBy(F.desc("z"), "w").limit(4 * landmarks)
    marks = unlike([r["w"] for r in top.collect()], landmarks)
    if not marks:
        return Model(shift=-2.0)
    held = spark.sparkContext.broadcast(marks)

    def pool(batches):
        let_go()
        scale, seen = Landmarks(held.value), {}
        scale.every = None  # texts only meet the groups' tables
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256).column(0).to_pylist()
                if len(seen) > POOLED:
                    seen.clear()
                new = list(set().union(*rows).difference(seen))
                for i in range(0, len(new), 10_000):
                    # of most words nothing matches: what is remembered are the few that do
                    m = scale.matches(new[i : i + 10_000])
                    seen.update(zip(new[i : i + 10_000], (m[j] if hit else None for j, hit in enumerate((m > 1e-3).any(axis=1).tolist())), strict=True))
                sums = [np.sum([v for v in map(seen.__getitem__, sorted(r)) if v is not None] or [np.zeros(len(held.value))], axis=0, dtype=np.float64) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float32())), b.slice(at, 256).column(1)], ["sums", "y"])

    got = bag.select("words", "y").mapInArrow(pool, "sums array<float>, y int").toArrow()  # at most 2 * sample rows
    sums, y = np.array(got["sums"].combine_chunks().flatten()).reshape(-1, len(marks)), np.array(got["y"]).astype(float)
    del got
    let_go(scorer=True)  # on the driver: what the rows came in, before the machine needs room of its own
    model = fit(sums, y, marks)
    del sums, y
    let_go(scorer=True)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row, from the whole text. Null and empty texts score as texts without evidence."""
    held, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        let_go(scorer=True)
        scorer = _scorer(key, held)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.probabilities(part.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label may not be learnt: crc32 of the identifier as text, modulo 5, is 0. False for a null identifier."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels are learnt from rows that aren't held out.

    An empty ``docs`` gives no rows. Rows with equal or null ids are scored each by its text, and null and empty texts
    as texts without evidence. Columns other than doc_id, text and toxic are never read, whatever their names.
    """
    model = train(docs, labels.filter(~held_out()), sample)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5.

    Null and empty texts have no evidence and stay (unless the labels were such that no evidence means toxic). Rows
    that repeat stay or go together; an empty table gives no rows.
    """
    held, at, key = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), uuid.uuid4().hex

    def run(batches):
        let_go(scorer=True)
        scorer = _scorer(key, held)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(scorer.probabilities(part.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
