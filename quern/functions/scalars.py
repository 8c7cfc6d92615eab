"""Scalar functions as Column expressions: they stay in the JVM and in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the names their languages are shown by.
LANGUAGES = {
    "py": "Python", "js": "Javascript", "ts": "Typescript", "jsx": "Javascript", "tsx": "Typescript", "java": "Java",
    "cs": "C#", "go": "go", "cpp": "C++", "c": "C", "h": "C/C++", "php": "PHP", "rb": "Ruby", "rs": "Rust",
    "scala": "Scala", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin", "lua": "Lua", "dart": "Dart", "ex": "Elixir", "exs": "Elixir",
}
# What separates top-level blocks; other supported languages have "}\n\n".
SEPARATORS = {"py": "\n\n", "rb": "end\n\n", "lua": "end\n\n"}
# Statements that import, by extension; other supported languages have "import ".
IMPORT_PREFIXES = {"c": "#include ", "cpp": "#include ", "h": "#include ", "cs": "using ", "rb": "require ", "lua": "require ", "rs": "use ", "php": "include "}
# Groups of languages that one model serves; the rest are "others".
EXPERTS = {"python": ["py"], "javascript": ["js", "ts", "jsx", "tsx"], "java_or_csharp": ["java", "cs"], "go": ["go"]}
# Names of the supported languages.
LANGUAGE_NAMES = ["python", "javascript", "typescript", "java", "csharp", "go", "golang", "c", "c++", "c/c++", "php", "ruby", "c#", "rust", "scala", "swift", "kotlin", "lua", "dart", "elixir"]

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def strip(x: Text) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def language_names() -> list[str]:
    """The names of the supported languages, as people write them."""
    return list(LANGUAGE_NAMES)


def email_key(x: Text) -> Column:
    return F.lower(strip(x))


def file_extension(path: Text) -> Column:
    """Extension with its case, only letters and digits of it; ``unknown`` where there is none. Leading dots don't begin one."""
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    ext = F.regexp_replace(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1), r"[^a-zA-Z0-9]", "")
    return F.when(ext == "", "unknown").otherwise(ext)


def is_supported(ext: Text) -> Column:
    return _c(ext).isin(list(LANGUAGES))


def language_name(ext: Text) -> Column:
    return F.coalesce(F.try_element_at(_map(LANGUAGES), _c(ext)), _c(ext))


def separator(ext: Text) -> Column:
    return F.when(is_supported(ext), F.coalesce(F.try_element_at(_map(SEPARATORS), _c(ext)), F.lit("}\n\n")))


def import_prefix(ext: Text) -> Column:
    return F.when(is_supported(ext), F.coalesce(F.try_element_at(_map(IMPORT_PREFIXES), _c(ext)), F.lit("import ")))


def renamed_to(path: Text) -> Column:
    """``a/{x => y}/b`` as ``a/y/b``. A rename without braces stays as it is."""
    return F.regexp_replace(_c(path), r"(.*)\{.* => (.*)\}(.*)", "$1$2$3")


def repo_name(path: Text) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def year_month(epoch: Text) -> Column:
    t = F.timestamp_seconds(_c(epoch))
    return (F.year(t) * 100 + F.month(t)).cast("int")


def month_of(ts: Text) -> Column:
    return (F.year(_c(ts)) * 100 + F.month(_c(ts))).cast("int")


def quarter(ym: Text) -> Column:
    y, m = F.floor(_c(ym) / 100).cast("int"), _c(ym) % 100
    return F.concat(y.cast("string"), F.lit("Q"), (F.floor((m - 1) / 3) + 1).cast("string"))


def half(ym: Text) -> Column:
    y, m = F.floor(_c(ym) / 100).cast("int"), _c(ym) % 100
    return F.concat(y.cast("string"), F.lit("H"), (F.floor((m - 1) / 6) + 1).cast("string"))


def days_in_month(year_dash_month: Text) -> Column:
    return F.dayofmonth(F.last_day(F.to_date(F.concat(_c(year_dash_month), F.lit("-01")))))


def short_date(ym: Text) -> Column:
    """``202403`` as ``Mar`` and, on a second line, ``2024``."""
    return F.date_format(F.to_date(_c(ym).cast("string"), "yyyyMM"), "MMM\nyyyy")


def truncated(s: Text, most: int) -> Column:
    keep = most - 3
    return F.when(F.length(_c(s)) > keep, F.concat(F.substring(_c(s), 1, keep), F.lit("..."))).otherwise(_c(s))


def sha256(s: Text) -> Column:
    return F.sha2(_c(s), 256)


def stable_hash(s: Text) -> Column:
    """The last 60 bits of the SHA-256."""
    return F.conv(F.right(sha256(s), F.lit(15)), 16, 10).cast("bigint")


def in_test_split(s: Text, percent: int = 20) -> Column:
    return stable_hash(s) % 100 < percent


def split_half(s: Text) -> Column:
    return stable_hash(s) % 2


def pair_key(a: Text, b: Text) -> Column:
    return F.concat_ws(":", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def safe_email(s: Text) -> Column:
    return F.translate(_c(s), "@.", "__")


def title_name(s: Text) -> Column:
    """Every letter after something that isn't one in upper case, the others in lower case."""
    chars = F.split(F.lower(_c(s)), "")
    before = F.concat(F.array(F.lit(" ")), F.slice(chars, F.lit(1), F.size(chars) - 1))
    return F.array_join(F.zip_with(chars, before, lambda c, p: F.when(p.rlike(r"\p{L}"), c).otherwise(F.upper(c))), "")


def quality_bucket(lines: Text) -> Column:
    """Name of the bucket of 20 lines; the last, ``life_of_py_80``, is open."""
    return F.concat(F.lit("life_of_py_"), (F.least(F.floor(_c(lines) / 20), F.lit(4)) * 20).cast("string"))


def changed_sides(diff: Text) -> tuple[Column, Column]:
    """What a diff adds and what it removes, white space left out."""

    def side(sign):
        lines = F.filter(F.split(strip(diff), "\n"), lambda x: x.startswith(sign))
        return F.translate(F.array_join(F.transform(lines, lambda x: F.substring(x, 2, 2**31 - 1)), ""), "\n\t ", "")

    return side("+"), side("-")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _shared(x: Column, part) -> Column:
    """How many characters ``part`` of both sides of x has in common: the largest power of two first, then the next."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    grown = lambda n, step: F.when((n + step <= x["n"]) & (part(x["a"], n + step) == part(x["b"], n + step)), n + step).otherwise(n)
    return F.aggregate(F.filter(steps, lambda s: s <= x["n"]), F.lit(0), grown)


def _sides(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n"))


def _trimmed(a: Column, b: Column, f) -> Column:
    """``f`` of both texts without what they begin and end with alike, which no shortest way of edits touches."""
    rest = lambda s, n: F.substring(s, n + 1, F.length(s))
    cut = lambda s, n: F.substring(s, F.lit(1), F.length(s) - n)
    begun = lambda x: _let(_shared(x, F.left), lambda n: _sides(rest(x["a"], n), rest(x["b"], n)))
    ended = lambda x: _let(_shared(x, F.right), lambda n: F.struct(cut(x["a"], n).alias("a"), cut(x["b"], n).alias("b")))
    return _let(_let(_let(_sides(a, b), begun), ended), lambda x: f(x["a"], x["b"]))


def edit_distance(a: Text, b: Text) -> Column:
    """Edit distance, counted over what the texts don't begin and end with alike; null for a null."""
    a, b = _c(a), _c(b)
    return F.when(a == b, 0).when(a.isNotNull() & b.isNotNull(), _trimmed(a, b, F.levenshtein))


def changed_chars(diff: Text) -> Column:
    """Edit distance between what a diff adds and what it removes, white space left out."""
    return edit_distance(*changed_sides(diff))


def distance_below(a: Text, b: Text, limit: int) -> Column:
    """Whether the edit distance is below ``limit``: lengths that differ by as much decide alone, and counting stops there."""
    a, b = _c(a), _c(b)
    far = F.abs(F.length(a) - F.length(b)) >= limit
    return F.when(a == b, limit > 0).when(far, False).when(a.isNotNull() & b.isNotNull(), _trimmed(a, b, lambda x, y: F.levenshtein(x, y, limit - 1) >= 0))


def is_documentation(s: Text) -> Column:
    n = lambda c: F.length(_c(s)) - F.length(F.replace(_c(s), F.lit(c), F.lit("")))
    return n(" ") >= 5 * n("\n")


def doc_lines(comment: Text) -> Column:
    """A comment's lines that count as documentation; null for licences and for what isn't prose."""
    text = F.translate(_c(comment), "\t\r", "  ")
    kept = F.filter(F.split(text, "\n"), lambda x: ~(x.startswith("http") | x.startswith("www") | x.contains("author ") | x.contains("param ")))
    return F.when(_c(comment).rlike("license|License|LICENSE") | ~is_documentation(comment), None).otherwise(kept)


def model_type(tag: Text) -> Column:
    return F.element_at(F.split(_c(tag), "::"), 1)


def expert(path: Text) -> Column:
    """Which of five groups of languages a file belongs to."""
    ext = file_extension(path)
    out = F.when(F.lit(False), "")
    for name, exts in EXPERTS.items():
        out = out.when(ext.isin(exts), name)
    return out.otherwise("others")


def flagged_names(flags: Text, names: Text) -> Column:
    """The names whose flag or score is above 0, joined by commas."""
    both = F.arrays_zip(_c(flags).alias("f"), _c(names).alias("n"))
    return F.array_join(F.transform(F.filter(both, lambda x: x["f"] > 0), lambda x: x["n"]), ",")


def top_labels(scores: Text, names: Text, k: int = 10) -> Column:
    """The ``k`` largest positive scores with their names, as (score, name); ties by name."""
    both = F.arrays_zip(_c(scores).alias("score"), _c(names).alias("name"))
    order = F.array_sort(F.filter(both, lambda x: x["score"] > 0), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return F.slice(order, 1, k)
