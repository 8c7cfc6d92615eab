"""Spelling variants found by anagram hashing (operator 13).

A word's anagram key is the sum of the fifth powers of its letters' code points, whatever their order. Two words that
one inserted, deleted or replaced letter tells apart have keys that differ by that letter's value, or by the difference
of two. So every word has its own key and one for each letter that it can lose: where two words share one of these, and
at least one of them lost a letter for it, their keys differ by one such value. What such words have in common is then
verified in the order of their letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch

#: Letters of a word: ASCII and the upper half of Latin-1 from 192 on.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lowered(run: Column) -> Column:
    """A-Z alone becomes small; the quick way where there are no other letters."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _UPPER.lower()))


def word_counts(docs: DataFrame, text: str = "text", shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur ``least`` times or more in all whole texts.

    A word is a longest run of letters, A-Z made small. Where ``every`` divides the crc32 of "<doc_id>:<run>", the run
    loses the letter at that crc32 modulo its length first, in all its places in the document. Null texts have no words;
    a null id is spelled as nothing. Counts are added up before the shuffle, so a frequent word is a few rows of it.
    """
    # a run only gets shorter, so shorter runs are never words
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), 0)).alias("run"))
    runs = runs.select("id", _lowered(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")))
    lost = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a < b, once for every two words of ``words`` (word, n) that differ by one letter, as the module says.

    Words must be distinct and not null; those of fewer than two letters are near nothing. A word of m + 1 letters that
    loses one, or one of m letters as it is, has m left. Wherever the one letter is that tells two words apart, their
    first ceil(m/2) or their last ceil(m/2) letters are the same ones in the same order; so words meet by key, m and
    half, and never in whole classes of anagrams. Words that meet by both halves count at the first.
    """
    letters = F.transform(F.split("word", ""), lambda c: F.pow(F.ascii(c), F.lit(5)).cast("long"))
    w = words.filter(F.length("word") > 1).select("word", "n", F.array_distinct(letters).alias("loses"), F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: s + x).alias("sum"))
    w = w.select("word", "n", "sum", F.explode(F.concat("loses", F.array(F.lit(0).cast("long")))).alias("lost"))
    w = w.withColumn("m", F.length("word") - (F.col("lost") != 0).cast("int"))
    half = F.ceil(F.col("m") / 2).cast("int")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.substring("word", start, half).alias("half")) for k, start in ((0, F.lit(1)), (1, F.length("word") - half + 1))])
    w = w.select("word", "n", (F.col("sum") - F.col("lost")).alias("key"), (F.col("lost") == 0).alias("own"), "m", half.alias("k"), F.explode(sides).alias("at"))
    w = w.select("word", "n", "key", "own", "m", "k", F.col("at.side").alias("side"), F.col("at.half").alias("half"))
    a, b = w.alias("a"), w.alias("b")
    meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "m", "side", "half")]
    first = (F.col("a.side") == 0) | (F.substring("a.word", F.lit(1), F.col("a.k")) != F.substring("b.word", F.lit(1), F.col("a.k")))
    ordered = F.expr("levenshtein(a.word, b.word, 1) = 1")
    met = a.hint("merge").join(b, [*meet, F.col("a.word") < F.col("b.word"), ~(F.col("a.own") & F.col("b.own")), first, ordered])
    return met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (word, n; distinct, n > 0).

    ``n_near`` counts the words near it. Its form is the near word of the largest n, of equal ones the first in
    code-point order, if that n is at least ``ratio`` times the word's own; else form and ``form_n`` are null. ``root`` is
    where the forms lead in the end, the word itself without a form. As n grows by ``ratio`` from form to form, that
    is a few steps away; each round doubles how many are taken. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("forms might go round in circles")
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    met = near_words(words)
    both = met.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("x")).select("x.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    near = scratch.keep(near.select("word", "n_near", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "near")
    roots = scratch.keep(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots-0")
    k = 0
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("then"))
        step = roots.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved"))
        step = scratch.keep(step, f"roots-{k + 1}")
        roots, k = step.drop("moved"), k + 1
        if not step.filter("moved").head(1):
            break
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """:func:`variants` of :func:`word_counts` over all whole texts of ``docs``.

    Only ``doc_id`` and the text are read, whatever other columns are called. Null and empty texts have no words, repeated
    rows count as often as they come, texts and words of any length are whole; an empty table gives no rows.
    """
    return variants(word_counts(docs.select("doc_id", F.col(text).alias("text"))))
