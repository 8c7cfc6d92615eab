"""Text functions that need a state machine: chunks, documentation, imports, masking.

Each is a pure Python function of one text, and an Arrow UDF over batches of them for the DataFrame API.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalars import IMPORT_PREFIXES, LANGUAGES, SEPARATORS


@dataclass(frozen=True)
class Language:
    """What the engine has to know of a language that isn't among its own: :func:`register` makes it known."""

    ext: str
    name: str
    separator: str = "}\n\n"
    import_prefix: str = "import "
    import_pattern: str | None = None
    comments: Comments | None = None


def register(language: Language) -> None:
    """Makes a language known to the functions of this process; call it before a plan is made, which takes it to the workers."""
    LANGUAGES[language.ext] = language.name
    SEPARATORS[language.ext] = language.separator
    IMPORT_PREFIXES[language.ext] = language.import_prefix
    if language.import_pattern:
        IMPORTS[language.ext] = language.import_pattern
    if language.comments:
        COMMENTS[language.ext] = language.comments


def separator_of(ext: str) -> str | None:
    return SEPARATORS.get(ext, "}\n\n") if ext in LANGUAGES else None


def chunks(code: str | None, sep: str | None, limit: int = 1500, least: int = 100) -> list[str]:
    """Cuts a snippet of more than ``limit`` characters at the separator into chunks of about that size.

    Parts gather until the next one would pass the limit; what has gathered is given out if it is longer than
    ``least``. A part that is too long itself is cut at line ends instead and only the first chunk of it is
    taken, ahead of what is still gathering. A line that is too long is left out. Without a separator (the
    language isn't supported) there are no chunks.
    """
    if code is None or sep is None:
        return []
    if len(code) <= limit:
        return [code]
    given: list[str] = []
    gathered: list[str] = []
    size = 0

    def give():
        nonlocal size
        if size > least:
            given.append("".join(gathered).strip())
        gathered.clear()
        size = 0

    for part in code.split(sep):
        if len(part) > limit:
            given += chunks(part, "\n", limit, least)[:1] if sep != "\n" else []
            continue
        if size + len(part) > limit:
            give()
        gathered += (part, sep)
        size += len(part) + len(sep)
    give()
    return given


@dataclass(frozen=True)
class Comments:
    """How a language writes documentation.

    ``opens`` begin a block (not if ``unless`` is in the same line), ``closes`` end it; ``single`` begins a
    line of a comment that gathers until a line of code ends it.
    """

    opens: tuple[str, ...]
    closes: str
    unless: str = ""
    single: str = ""
    star: bool = False
    close_at: str = "in"


# The marks of documentation.
C_LIKE = Comments(("/**", "/*"), "*/", "*/", "//", star=True)
LUA = Comments(("--[[",), "]]", "", "--", close_at="end")
RUBY = Comments(("=begin",), "=end", "=end", close_at="start")
ELIXIR = Comments(("@moduledoc", "@doc"), '"""')
#: The languages that don't write comments as C does.
COMMENTS = {"rb": RUBY, "lua": LUA, "ex": ELIXIR, "exs": ELIXIR}
#: A comment that nothing closes, or of single lines, is documentation only beyond this length.
LONG = 300


def _python_docs(lines: list[str]) -> list[str]:
    out, text, inside = [], "", False
    for line in map(str.strip, lines):
        begins, ends = (line[:3] in ('"""', "'''")), (line[-3:] in ('"""', "'''"))
        if begins and ((len(line) > 3 and line.count('"""') > 1) or line.count("'''") > 1):
            continue
        if begins and not inside:
            inside, text = True, text + line[3:]
        elif begins or ends:
            out.append(text if begins else f"{text}\n{line[:-3]}")
            inside, text = False, ""
        elif inside:
            text += "\n" + line
    return out


def _block_docs(lines: list[str], how: Comments) -> list[str]:
    out: list[str] = []
    text, inside = "", False

    def is_end(line):
        return {"in": how.closes in line, "end": line.endswith(how.closes), "start": line.startswith(how.closes)}[how.close_at]

    for line in map(str.strip, lines):
        mark = next((m for m in how.opens if line.startswith(m)), None)
        if mark and how.close_at == "start":
            mark = None if line.endswith(how.unless) else mark
        elif mark and how.unless and how.unless in line:
            mark = None
        if mark:
            inside, text = True, text + ("" if how == ELIXIR else line[len(mark) :])
        elif how.single and line.startswith(how.single) and (how == C_LIKE or not inside):
            text += "\n" + line[len(how.single) :]
        elif inside and is_end(line):
            rest = {"in": line[: -len(how.closes)], "end": line[: -len(how.closes)], "start": line[len(how.closes) :]}[how.close_at]
            out.append((text if how == ELIXIR else f"{text}\n{rest}").strip())
            inside, text = False, ""
        elif inside:
            text += f"{line}\n" if how == ELIXIR else "\n" + (line[1:] if how.star and line.startswith("*") else line)
        elif how.single and len(text) > LONG:
            out.append(text.strip())
            text = ""
    if inside and len(text) > LONG and how != RUBY:
        out.append(text.strip())
    return out


def documentation(lines: list[str], ext: str, comments: dict[str, Comments | None] | None = None) -> list[str]:
    """The documentation comments in lines of code of a language. ``comments`` has the languages that are known, if not those of this process."""
    known = {e: COMMENTS.get(e) for e in LANGUAGES} if comments is None else comments
    if ext not in known:
        return []
    if ext == "py":
        return _python_docs(lines)
    return _block_docs(lines, known[ext] or C_LIKE)


def documentation_lines(code: str | None, ext: str | None, comments: dict[str, Comments | None] | None = None) -> int:
    """How many lines of a snippet's documentation count (see :func:`quern.functions.scalars.doc_lines`)."""
    total = 0
    for doc in documentation((code or "").split("\n"), ext or "", comments):
        if re.search("license|License|LICENSE", doc) or doc.count(" ") < 5 * doc.count("\n"):
            continue
        total += sum(not (x.startswith(("http", "www")) or "author " in x or "param " in x) for x in re.sub("[\t\r]", " ", doc).split("\n"))
    return total


# What an import of one line looks like; the group is the library.
IMPORTS = {
    "java": r"import\s+([\w.]+(?:\*|[\w*]+)?);",
    **dict.fromkeys(("js", "ts", "jsx", "tsx"), r"import\s+(?:[\w{},*\s$]+\s+from\s+)?['\"]([^'\"]+)['\"]"),
    **dict.fromkeys(("kt", "kts"), r"import\s+([\w.*]+)"),
    **dict.fromkeys(("c", "cpp", "h"), r"#include\s+[<\"]([^<\"]+)[>\"]"),
    "cs": r"using\s+([\w.]+);",
    "php": r"(?:include|require)(?:_once)?\s+['\"]([^'\"]+)['\"]",
    "rb": r"require\s+['\"]([\w-]+)['\"]",
    "lua": r"require\s+['\"]([\w-]+)['\"]",
    "rs": r"use\s+([\w:]+);",
    "swift": r"import\s+([\w.]+)",
    "dart": r"import\s+['\"]([^'\"]+)['\"]",
    **dict.fromkeys(("ex", "exs"), r"(?:import|alias|require|use)\s+([A-Z][\w.]*)"),
}


# What older reports took for an import of one line, where that differs; those marked True only in lines that begin with ``import``.
OLD_IMPORTS = {
    **dict.fromkeys(("js", "ts", "jsx", "tsx", "ex", "exs"), (True, r"import\s+\w+\s+from\s+'([\w-]+)';")),
    "java": (True, r"import\s+([\w.]+(?:\*|[\w*]+)?);"),
    "swift": (True, r"import\s+([\w.]+)"),
    "dart": (True, r"import\s+([\w.]+);"),
    "php": (False, r"(?:include|require)(?:_once)?\s*[\"']([^\"']+?)[\"'];"),
}


def _statements(lines: list[str], begins: tuple[str, ...], opening: str, closing: str) -> list[str]:
    """Import statements of one line, and those in brackets over several lines as one."""
    out: list[str] = []
    block: list[str] | None = None
    for line in lines:
        if block is None and not line.startswith(begins):
            continue
        if block is None and opening not in line:
            out.append(line)
        elif block is None:
            block = [line]
            if closing in line:  # opened and closed at once
                out.append(line)
                block = None
        else:
            block.append(line)
            if closing in line:
                out.append(" ".join(block))
                block = None
    return out


def _python_imports(lines: list[str]) -> list[str]:
    found = set()
    for s in _statements(lines, ("import ", "from "), "(", ")"):
        token = [t for t in re.sub(r"[\n(),]", " ", s).split(" ") if t]
        if token[0] == "import":
            found |= {t for before, t in zip(token, token[1:], strict=False) if t != "as" and before != "as"}
        elif "import" in token:
            names = token[token.index("import") + 1 :]
            found |= {f"{token[1]}.{t}" for before, t in zip(["", *names], names, strict=False) if t != "as" and before != "as"}
    return sorted(found)


def imports(lines: list[str], ext: str) -> list[str]:
    """The libraries that lines of code import."""
    if ext == "py":
        return _python_imports(lines)
    if ext == "go":
        return [t for s in _statements(lines, ("import ",), "(", ")") for t in re.sub(r'[()";,\t\n]', " ", s).split(" ") if t and t != "import"]
    if ext == "scala":
        return [t for s in _statements(lines, ("import ",), "{", "}") for t in re.sub(r'[{}";,\t\n]', " ", s).split(" ") if t and t != "import"]
    if ext not in IMPORTS:
        return []
    return [x for line in lines if line.strip() for x in re.findall(IMPORTS[ext], line)]


def mask(text: str | None, share: float = 0.5) -> str | None:
    """Hides a name but for its ends and a stable choice of its middle: ``share`` of the characters stay readable.

    Up to two characters leave the first, up to six the first two. Otherwise two at each end stay, and as
    many of the middle as the share asks for beyond these; the bytes of the name's SHA-256 pick them, each
    among the places that are still hidden.
    """
    if not text:
        return text
    n = len(text)
    if n <= 2:
        return text[0] + "*"
    if n <= 6:
        return text[:2].ljust(n, "*")
    hidden = list(range(2, n - 2))
    for byte in hashlib.sha256(text.encode()).digest()[: max(0, math.ceil(n * share) - 4)]:
        hidden.pop(byte % len(hidden))
    gone = set(hidden)
    return "".join("*" if i in gone else c for i, c in enumerate(text))


def _strings(values):
    return [None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for v in values]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks_udf(code: pd.Series, sep: pd.Series, limit: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([chunks(c, s, int(a), int(b)) for c, s, a, b in zip(_strings(code), _strings(sep), limit, least, strict=True)], dtype=object)


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _first_of_lines(part: Column, limit: Column, least: Column) -> Column:
    """The first chunk of a text that is cut at line ends, as an array of one or none."""
    start = F.struct(F.lit(None).cast("string").alias("given"), F.lit("").alias("gathered"), F.lit(0).alias("size"))

    def step(s: Column, line: Column) -> Column:
        n = F.length(line)
        begun = F.struct(F.when(s["size"] > least, s["gathered"]).alias("given"), F.concat(line, F.lit("\n")).alias("gathered"), (n + 1).alias("size"))
        grown = F.struct(s["given"].alias("given"), F.concat(s["gathered"], line, F.lit("\n")).alias("gathered"), (s["size"] + n + 1).alias("size"))
        return F.when(s["given"].isNotNull() | (n > limit), s).when(s["size"] + n > limit, begun).otherwise(grown)

    def finish(s: Column) -> Column:
        found = F.coalesce(s["given"], F.when(s["size"] > least, s["gathered"]))
        return F.when(found.isNotNull(), F.array(_stripped(found))).otherwise(F.array().cast("array<string>"))

    return F.aggregate(F.split(part, "\n"), start, step, finish)


def chunks_of(code: Column | str, sep: Column | str, limit: int = 1500, least: int = 100) -> Column:
    """:func:`chunks` in the JVM: a fold over the parts between separators, whose state is what has been given out and what is gathering."""
    code, sep = (F.col(x) if isinstance(x, str) else x for x in (code, sep))
    # an array of the one row, so that the separator is looked up once and not for every part
    return F.transform(F.array(F.struct(code.alias("code"), sep.alias("sep"))), lambda x: _chunks(x["code"], x["sep"], F.lit(limit), F.lit(least)))[0]


def _chunks(code: Column, sep: Column, limit: Column, least: Column) -> Column:
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("given"), F.lit("").alias("gathered"), F.lit(0).alias("size"))
    give = lambda s: F.when(s["size"] > least, F.array_append(s["given"], _stripped(s["gathered"]))).otherwise(s["given"])

    def step(s: Column, part: Column) -> Column:
        n = F.length(part)
        cut = F.struct(F.concat(s["given"], F.when(sep == "\n", none).otherwise(_first_of_lines(part, limit, least))).alias("given"), s["gathered"].alias("gathered"), s["size"].alias("size"))
        begun = F.struct(give(s).alias("given"), F.concat(part, sep).alias("gathered"), (n + F.length(sep)).alias("size"))
        grown = F.struct(s["given"].alias("given"), F.concat(s["gathered"], part, sep).alias("gathered"), (s["size"] + n + F.length(sep)).alias("size"))
        return F.when(n > limit, cut).when(s["size"] + n > limit, begun).otherwise(grown)

    mark = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    long = F.aggregate(F.split(code, mark), start, step, give)
    return F.when(code.isNull() | sep.isNull(), none).when(F.length(code) <= limit, F.array(code)).otherwise(long)


def documentation_lines_udf(code: Column | str, ext: Column | str) -> Column:
    known = {e: COMMENTS.get(e) for e in LANGUAGES}

    @F.pandas_udf(T.IntegerType())
    def count(code: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([documentation_lines(c, e, known) for c, e in zip(_strings(code), _strings(ext), strict=True)], dtype="int32")

    return count(code, ext)


def documentation_of(code: Column | str, ext: Column | str) -> Column:
    """The documentation comments of code, also of languages that are registered when the plan is made."""
    known = {e: COMMENTS.get(e) for e in LANGUAGES}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(code: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([documentation((c or "").split("\n"), e or "", known) for c, e in zip(_strings(code), _strings(ext), strict=True)], dtype=object)

    return found(code, ext)


@F.pandas_udf(T.ArrayType(T.StringType()))
def imports_udf(code: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([imports((c or "").split("\n"), e or "") for c, e in zip(_strings(code), _strings(ext), strict=True)], dtype=object)


def _every_match(pattern: str):
    return lambda x: F.regexp_extract_all(x, F.lit(f"(?U){pattern}"), F.lit(1))


def imports_of(code: Column, ext: Column, compat: bool = False) -> Column:
    """The libraries that code imports. Languages whose imports are one line each never leave the JVM.

    With ``compat`` lines are read as older reports read them: of JavaScript only default imports, of Dart and Elixir
    only what real code hasn't.
    """
    lines = F.filter(F.split(code, "\n"), lambda x: x.rlike(r"(?U)\S"))
    out = F.when(ext.isin("py", "go", "scala"), imports_udf(F.when(ext.isin("py", "go", "scala"), code), ext))
    patterns = {e: (False, p) for e, p in IMPORTS.items()} | (OLD_IMPORTS if compat else {})
    for begins, pattern in dict.fromkeys(patterns.values()):
        some = F.filter(lines, lambda x: x.startswith("import")) if begins else lines
        found = F.flatten(F.transform(some, _every_match(pattern)))
        out = out.when(ext.isin([e for e, p in patterns.items() if p == (begins, pattern)]), F.coalesce(found, F.array().cast("array<string>")))
    return out.otherwise(F.array().cast("array<string>"))


def mask_of(text: Column | str, share: float = 0.5) -> Column:
    """:func:`mask` in the JVM: a fold over the hash's bytes takes one place after another out of those that are hidden."""
    text = F.col(text) if isinstance(text, str) else text
    n, digest = F.length(text), F.sha2(text.cast("binary"), 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    shown = F.least(F.lit(32), F.greatest(F.lit(0), F.ceil(n * share).cast("int") - 4))
    without = lambda places, k: F.concat(F.slice(places, F.lit(1), k), F.slice(places, k + 2, F.size(places)))
    steps = F.when(shown > 0, F.sequence(F.lit(0), shown - 1)).otherwise(F.array().cast("array<int>"))
    hidden = F.aggregate(steps, F.sequence(F.lit(2), n - 3), lambda places, i: without(places, byte(i) % F.size(places)))
    # an array of the one value, so that the fold is done once and not for every character
    chars = F.transform(F.array(hidden), lambda gone: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(F.array_contains(gone, i), "*").otherwise(c)), ""))
    return F.when(n == 0, text).when(n <= 2, F.concat(F.left(text, F.lit(1)), F.lit("*"))).when(n <= 6, F.rpad(F.left(text, F.lit(2)), n, F.lit("*"))).when(n.isNotNull(), chars[0])


@F.pandas_udf(T.StringType())
def _salted(text: pd.Series) -> pd.Series:
    import os

    return pd.Series([None if x is None else hashlib.sha256(x.encode() + os.urandom(32)).hexdigest() for x in _strings(text)], dtype=object)


#: A hash with a new salt for every value: it can't be found again.
salted_hash = _salted.asNondeterministic()
