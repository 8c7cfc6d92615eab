"""Removal of repeated multi-line chunks (operator 10), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NULL_ID, Scratch

#: Kinds that lines are told into by their hashes.
KINDS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _text_of(span: Column) -> Column:
    return F.array_join(F.slice(F.col("__q_lines"), span["first"] + 1, span["last"] - span["first"] + 1), "\n")


def _paired(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__q_lines`` and ``__q_pairs``, (first, last) of every two neighbouring lines that aren't blank, with the blank lines between them."""
    df = docs.withColumn("__q_lines", _lines(F.col(text)))
    marked = F.transform("__q_lines", lambda x, i: F.when(x.rlike(r"\S"), i))
    df = df.withColumn("__q_full", F.filter(marked, lambda x: x.isNotNull()))
    size = F.greatest(F.size("__q_full") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("__q_full", F.lit(1), size), F.slice("__q_full", F.lit(2), size), lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return df.withColumn("__q_pairs", pairs).drop("__q_full")


def _name(chunk: Column) -> Column:
    """What a chunk is known by before its bytes are compared."""
    return F.xxhash64(chunk)


def _chunked(docs: DataFrame, text: str, kinds: int) -> DataFrame:
    """Adds ``__q_lines`` and ``__q_pairs``, (first, last) line of each chunk of two or more lines that aren't blank.

    A line's hash tells its kind. For each of the ``kinds`` there is a chunking of its own, in which every line of
    another kind, and the last, ends a chunk. Its chunks of more than a line are the runs of lines of that kind, each with
    the line that ends it; so one pass over the runs has the chunks of all chunkings, about one a line.
    """
    df = docs.withColumn("__q_lines", _lines(F.col(text)))
    kind = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint") % kinds
    full = F.filter(F.transform("__q_lines", lambda x, i: F.when(x.rlike(r"\S"), F.struct(i.alias("i"), kind(x).alias("kind")))), lambda x: x.isNotNull())
    df = df.withColumn("__q_full", full)
    before = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform("__q_full", lambda x: x["kind"]))
    df = df.withColumn("__q_starts", F.filter(F.zip_with("__q_full", F.slice(before, F.lit(1), F.size("__q_full")), lambda x, k: F.when(x["kind"] != k, x["i"])), lambda i: i.isNotNull()))
    last = F.try_element_at("__q_full", F.lit(-1))["i"]  # the end of the last run's chunk
    ends = F.concat(F.slice("__q_starts", F.lit(2), F.size("__q_starts")), F.array(last))
    pairs = F.filter(F.zip_with("__q_starts", ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda s: s["last"] > s["first"])
    return df.withColumn("__q_pairs", pairs).drop("__q_full", "__q_starts")


def line_dedup(docs: DataFrame, kinds: int = KINDS, doc_id: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """Removes every repeated chunk of two or more lines but its first occurrence; returns all rows and columns.

    Boundaries depend on a line's own hash (:func:`_chunked`), so what is around a passage moves at most the chunk at
    each end of it, where the line next to the passage is by chance (one of ``kinds``) of the kind of the first or last.
    A line goes if it lies in a chunk that occurs earlier, in the order of (doc_id, hash of the text, line); null ids come
    first. Chunks of one text that overlap are no copies of each other. A line that repeats alone, and blank ones, stay.

    Hashes only name candidates: of chunks with a hash and length that occur twice the bytes are read again and the least and
    the largest of each hash compared, which partial aggregation does before the shuffle. Where they are one, all are; where
    they differ, chunks are told apart by their bytes. So equal hashes alone never remove anything, no text of a chunk
    that occurs once is shuffled, and a frequent chunk is one row for each task.

    A null text stays null; an empty text has one empty line. Rows equal in id and text are treated alike: all
    keep or lose the same chunks. With ``counts``, the columns n_lines, n_removed (lines that go) and chunks_removed (their
    runs) are added (those of the input with these names go).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    key = _row_of(doc_id, text)
    narrow = _chunked(docs.select(*key, F.col(text).cast("string").alias("text")), "text", kinds)
    named = F.transform("__q_pairs", lambda s: F.struct(s["first"].alias("no"), s["last"].alias("to"), _name(_text_of(s)).alias("h"), F.length(_text_of(s)).alias("size")))
    # the outer form, lest Catalyst derive a filter on the array's size and compute all of it again below
    rows = narrow.select("d", "th", named.alias("chunks")).select("d", "th", F.explode_outer("chunks").alias("c")).select("d", "th", "c.*")
    rows = scratch.keep(rows.filter("h is not null"), "chunks")
    seen = rows.groupBy("h", "size").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    candidates = scratch.keep(rows.join(seen, ["h", "size"]), "candidates")
    scratch.drop("chunks")

    spans = candidates.groupBy("d", "th").agg(F.collect_set(F.struct(F.col("no").alias("first"), F.col("to").alias("last"), "h", "size")).alias("spans"))
    texts = docs.select(*key, F.col(text).cast("string").alias("text")).join(spans.hint("merge"), ["d", "th"]).withColumn("__q_lines", _lines(F.col("text"))).drop("text")
    whole = F.transform("spans", lambda s: F.struct(s["first"].alias("no"), s["last"].alias("to"), s["h"].alias("h"), s["size"].alias("size"), _text_of(s).alias("chunk")))
    whole = texts.select("d", "th", F.explode_outer(whole).alias("c")).select("d", "th", "c.*")
    compared = scratch.keep(whole.groupBy("h", "size").agg((F.min("chunk") == F.max("chunk")).alias("one")), "compared")
    clash = compared.filter("not one").drop("one")
    alike = candidates.join(compared.filter("one").drop("one"), ["h", "size"]).withColumn("chunk", F.lit(""))
    both, columns = alike, ["d", "th", "no", "to", "h", "size", "chunk"]
    if clash.head(1):
        both = alike.select(columns).union(whole.join(clash, ["h", "size"]).select(columns))
    return _without(docs, _gone(both, ["h", "size", "chunk"], scratch), doc_id, text, counts)


def passage_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """Removes every repeated passage of two or more lines, whatever is around it; returns all rows and columns.

    Every two neighbouring lines are a window, so no boundary hangs on the lines before a passage: a line goes if
    it lies in a window that occurs earlier, in the order of (doc_id, hash of the text, line). Windows of one
    text that overlap are no copies of each other. The first occurrence of each line stays, and so does a line that
    repeats alone. Windows are keyed by their SHA-256, so each is a narrow row however long its lines are. Nulls, equal
    rows and ``counts`` are as in :func:`line_dedup`; n_removed counts the lines that go and chunks_removed their runs.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    narrow = _paired(docs.select(*_row_of(doc_id, text), F.col(text).cast("string").alias("text")), "text")
    # the windows with their digests are one column, so that Catalyst computes them once
    cut = narrow.select("d", "th", F.transform("__q_pairs", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.unhex(F.sha2(_text_of(s), 256)).alias("h"))).alias("chunks"))
    rows = cut.select("d", "th", F.explode_outer("chunks").alias("c")).select("d", "th", F.col("c.first").alias("no"), F.col("c.last").alias("to"), F.col("c.h").alias("h"))
    rows = scratch.keep(rows.filter("h is not null"), "windows")
    return _without(docs, _gone(rows, ["h"], scratch), doc_id, text, counts)


def _row_of(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("d"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("th")]


def _gone(rows: DataFrame, same: list[str], scratch: Scratch) -> DataFrame:
    """(d, th, __q_gone) of the texts that repeat (no, to) of ``rows``: what is equal in ``same`` repeats its first."""
    first = rows.groupBy(*same).agg(F.min(F.struct("d", "th", "no", "to")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    later = F.struct("d", "th") != F.struct("first.d", "first.th")
    extra = rows.join(first, same).filter(later | (F.col("no") > F.col("first.to")))
    return scratch.keep(extra.groupBy("d", "th").agg(F.collect_set(F.struct("no", "to")).alias("__q_gone")), "gone")


def _without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str, counts: bool) -> DataFrame:
    """``docs`` without the lines of ``gone``."""
    old = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed", "chunks_removed")]
    key = _row_of(doc_id, text)
    all_rows = docs.select(*[F.col(f"`{c}`") for c in old], key[0].alias("__q_d"), key[1].alias("__q_th"))
    met = all_rows.join(gone.withColumnsRenamed({"d": "__q_d", "th": "__q_th"}).hint("merge"), ["__q_d", "__q_th"], "left")  # either side grows with the input
    met = met.withColumn("__q_lines", _lines(F.col(text)))
    cut = F.array_sort(F.array_distinct(F.flatten(F.transform("__q_gone", lambda s: F.sequence(s["no"], s["to"])))))
    met = met.withColumn("__q_cut", F.coalesce(cut, F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__q_lines") - 1), F.col("__q_cut"))
    met = met.withColumn("__q_stay", stay)
    new = F.array_join(F.transform("__q_stay", lambda i: F.col("__q_lines")[i]), "\n")
    out = [F.when(F.size("__q_cut") > 0, new).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in old]
    if counts:
        runs = F.size(F.array_except(F.col("__q_cut"), F.transform("__q_cut", lambda i: i + 1)))
        out += [F.size("__q_lines").cast("long").alias("n_lines"), F.size("__q_cut").cast("long").alias("n_removed"), runs.cast("long").alias("chunks_removed")]
    return met.select(*out)




_SPANS = {
    # runs of lines of one kind, each with the line after it
    "line_dedup": f"""k AS (SELECT *, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % {KINDS} AS kind FROM f),
    b AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS begins FROM k),
    s AS (SELECT doc_id, i AS no, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), m) AS to_ FROM (SELECT * FROM b JOIN (SELECT doc_id, max(i) AS m FROM f GROUP BY doc_id) USING (doc_id) WHERE begins))""",
    # every two neighbouring lines
    "passage_dedup": "s AS (SELECT doc_id, i AS no, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS to_ FROM f)",
}
ORACLES = {
    name: f"""
    WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    u AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM d),
    f AS (SELECT * FROM u WHERE regexp_matches(x, '[^ \\t\\n\\r\\f\\x0B]')),
    {spans},
    c AS (SELECT s.*, array_to_string(ls[no + 1 : to_ + 1], chr(10)) AS chunk FROM s JOIN d USING (doc_id) WHERE to_ > no),
    o AS (SELECT chunk, min({{'d': doc_id, 'no': no, 'to_': to_}}) AS first FROM c GROUP BY chunk HAVING count(*) > 1),
    g AS (SELECT DISTINCT doc_id, unnest(range(no, to_ + 1)) AS i FROM c JOIN o USING (chunk) WHERE doc_id <> first.d OR no > first.to_),
    r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (run) AS runs FROM (SELECT *, i - 1 IS DISTINCT FROM lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id),
    l AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS t FROM u ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n IS NULL THEN text ELSE coalesce(t, '') END AS text, CAST(len(ls) AS BIGINT) AS n_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS chunks_removed
    FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)"""
    for name, spans in _SPANS.items()
}
