"""Readers of the small files of a run, and writers of its results."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import itertools
import os
import shutil
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators.numbering import numbered

#: A profile record. Values of a month are of two kinds, so they are two columns here.
PROFILE = """version string, timestamp bigint, repo_path string, repo string, author string,
 langs array<struct<lang: string, st: int, et: int, months: array<struct<ym: int, added: bigint, deleted: bigint, sig_cont: bigint, too_big: bigint>>>>,
 stats array<struct<lang: string, ym: int, model: string, skill: string, max_score: double, min_score: double, sum_score: double, max_sm: double, min_sm: double, sum_sm: double, snippets: bigint, code_lines: bigint, doc_lines: bigint, is_labeled: int>>,
 skills array<struct<skill: string, code_lines: bigint>>"""


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repo string, file string").json(path).dropna(subset=["repo", "file"]).distinct()


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repo string, user string").csv(path, sep="\t").distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """skill, display_name; files of one column show the skill with capital letters."""
    rows = spark.read.text(path).filter("trim(value) <> ''").withColumn("p", F.split("value", "\t"))
    skill = S.strip(F.col("p")[0])
    return rows.select(skill.alias("skill"), F.when(F.size("p") > 1, S.strip(F.try_element_at("p", F.lit(2)))).otherwise(S.title_name(skill)).alias("display_name"))


def library_ids(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """lang, library, id from ``<language>.txt`` files, and lang, next_id."""
    name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))  # Spark gives the name as a URL
    rows = spark.read.text(folder, pathGlobFilter="*.txt").select(F.regexp_extract(name, r"([^/]*)\.txt$", 1).alias("lang"), F.split("value", "\t").alias("p")).filter("size(p) >= 2")
    ids = rows.select("lang", F.col("p")[0].alias("library"), F.col("p")[1].try_cast("int").alias("id"))
    return ids, ids.groupBy("lang").agg((F.max("id") + 1).alias("next_id"))


def public_libraries(spark: SparkSession, folder: str) -> DataFrame:
    return library_ids(spark, folder)[0].select("lang", "library").distinct()


def public_imports(imports: DataFrame, public: DataFrame) -> DataFrame:
    return imports.join(public, ["lang", "library"], "left_semi")


def lines(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """The lines of a text file, also gzipped (by suffix), with their numbers from 0 unless ``distinct``.

    The parts that the file is read in are counted, and each numbers its own lines from where those before it end. How a
    file is cut depends on the cluster at that time, so the cut lines are kept (on disk) between the two.
    """
    rows = spark.read.text(path).select(S.strip("value").alias("value"))
    if distinct:
        return rows.distinct()
    at = F.monotonically_increasing_id()  # the part in the upper bits, the place in it in the lower 33
    rows = rows.select("value", at.alias("_at")).select("value", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    rows = rows.persist(StorageLevel.DISK_ONLY)
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = list(itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=0))
    before = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_part") + 1)
    return rows.select("value", (before + F.col("_place")).alias("no"))


def indexed(values: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Distinct values with their places from 0, in order of the values, or of their hashes."""
    found = values.select(column).distinct()
    return numbered(found, column) if ordered else numbered(found.withColumn("_h", F.xxhash64(column)), "_h", column).drop("_h")


def code_file(spark: SparkSession, path: str) -> DataFrame:
    """path, lines of whole files; one that isn't UTF-8 has no lines."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return rows.select("path", F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")).alias("lines"))


def profiles(spark: SparkSession, path: str, allow: DataFrame | None = None) -> DataFrame:
    """Profile records of a run, also of an unfinished one, of allowed users only; library files are skipped."""
    from quern.operators.activity import allowed

    rows = spark.read.schema(PROFILE).json(path, pathGlobFilter="[!_]*.json*").filter(~F.input_file_name().contains("_libs.json"))
    return allowed(rows, allow)


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """repo_path, repo, file, imports of the records that :func:`write_libraries` writes."""
    return spark.read.schema("repo_path string, repo string, file string, imports array<string>").json(path)


def document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def document_profiles(spark: SparkSession, path: str, schema: str = PROFILE) -> DataFrame:
    """user, timestamp, team, profile of each profile of a document of :func:`merged` or :func:`write_merged`, which have a profile a line.

    The one task that inflates the file passes line after line on, and all tasks parse them: nobody holds the document,
    as :func:`document` does, which takes any layout.
    """
    v, mark = F.col("value"), '"profiles":['
    begin = F.concat(F.substring_index(v, mark, 1), F.lit(mark + "]}"))
    head = spark.read.text(path).limit(1).select(F.from_json(begin, "user string, timestamp bigint, team string").alias("h"))
    first = v.startswith('{"user":') & v.contains(mark)  # a quotation mark inside a string is written with a backslash
    one = F.when(v.startswith(","), F.substring(v, 2, 2**31 - 1)).when(first, F.substr(v, F.instr(v, mark) + len(mark))).otherwise(v)
    rows = spark.read.text(path).select(one.alias("p")).filter(~F.col("p").isin("", "]}"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p").select(F.from_json("p", schema).alias("profile"))
    return rows.crossJoin(F.broadcast(head)).select("h.user", "h.timestamp", "h.team", "profile")  # one row


def choices(spark: SparkSession, path: str) -> DataFrame:
    """skill, choice from a JSON object of skills to choices."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("skill", "choice"))


# -- sinks ------------------------------------------------------------------------------------------------
def write_profiles(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per repository: many writers, no single file."""
    df.withColumn("part", F.col("repo")).write.mode("overwrite").partitionBy("part").json(path)


def write_libraries(df: DataFrame, path: str) -> None:
    """JSON lines of repo_path, repo, file, imports: one record for each file of code."""
    df.select("repo_path", "repo", "file", "imports").write.mode("overwrite").json(path)


def _head(timestamp: int, team: str | None, program: str | None) -> Column:
    """How a merged document begins, given its ``label``."""
    extra = [F.lit(team).alias("team")] if team else []
    extra += [F.lit(file_hash(program)).alias("hc")] if program else []
    head = F.to_json(F.struct(F.col("label").alias("user"), F.lit(timestamp).alias("timestamp"), *extra))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"profiles":['))


def merged(profiles_: DataFrame, label: DataFrame, timestamp: int, team: str | None = None, program: str | None = None) -> DataFrame:
    """The lines of one JSON document of all profiles, a profile a line, as ``value`` in the order of ``no``; with the hash of a program's file, if one is given.

    The profiles stream through the one task that writes the document; they are never gathered in a row.
    """
    first = label.select(F.lit(0).cast("bigint").alias("no"), _head(timestamp, team, program).alias("value"))
    rows = profiles_.select(F.to_json(F.struct(*profiles_.columns)).alias("p")).select(F.row_number().over(Window.orderBy("p")).cast("bigint").alias("no"), "p")
    rows = rows.select("no", F.concat(F.when(F.col("no") > 1, ",").otherwise(""), "p").alias("value"))
    last = label.select(F.lit(2**62).alias("no"), F.lit("]}").alias("value"))
    return first.union(rows).union(last)


def write_merged(profiles_: DataFrame, label: DataFrame, timestamp: int, path: str, team: str | None = None, program: str | None = None, order: tuple[str, ...] = ("repo", "author"), parts: int | None = None) -> None:
    """The document of :func:`merged` as one gzip file at ``path``, made by many tasks, in the order of the columns ``order``.

    Each task writes a range of profiles as a gzip member; Spark's committer keeps those of the attempts that succeeded.
    The members, with the document's beginning, its end and the commas between, are then copied one after another, as
    bytes, beside ``path`` and renamed: a reader sees a whole document or none, and a failed run leaves neither parts
    nor a piece of it.
    """
    spark = profiles_.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    conf = spark._jsc.hadoopConfiguration()
    fs, aside = at(path).getFileSystem(conf), f"{path}.{uuid.uuid4().hex}"
    head = label.select(_head(timestamp, team, program).alias("v")).first()["v"]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = profiles_.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.to_json(F.struct(*profiles_.columns)).alias("p"))
    keys = [f"_{i}" for i in range(len(order))]
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "p")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    try:
        rows.select(F.concat(F.when(first, "").otherwise(","), "p").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 0).text(f"{aside}.parts")
        found = sorted((f.getPath().getName(), f.getLen()) for f in fs.globStatus(at(f"{aside}.parts/part-*")))
        names = [name for name, size in found if size > len(gzip.compress(b""))]  # a task without rows leaves an empty member or none
        out = fs.create(at(aside), True)
        out.write(bytearray(gzip.compress(head.encode())))
        for i, name in enumerate(names):
            if i:
                out.write(bytearray(gzip.compress(b",")))
            part = fs.open(at(f"{aside}.parts/{name}"))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.write(bytearray(gzip.compress(b"]}\n")))
        out.close()
        fs.delete(at(path), True)
        if not fs.rename(at(aside), at(path)):
            raise OSError(f"{path} could not be put in its place")
    finally:
        fs.delete(at(f"{aside}.parts"), True)
        fs.delete(at(aside), True)


def merged_name(stem: str, day: str | None = None) -> str:
    """Name of a compressed merged document: the stem, the day (today by default) and ``.gz``."""
    return f"{stem}_{day or datetime.datetime.now(datetime.UTC).date().isoformat()}.gz"


def write_document(df: DataFrame, path: str, compress: bool = False) -> None:
    """Writes ``value``, in the order of ``no`` if there is one, as one text file."""
    rows = df.repartition(1).sortWithinPartitions("no") if "no" in df.columns else df.coalesce(1)
    rows.select("value").write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def report_document(facts: DataFrame) -> DataFrame:
    """The rows of :func:`quern.operators.report.report_facts` as one JSON object by repository: files by quarter, and big commits."""
    files = facts.filter("kind = 'file'").groupBy("repo", "qtr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "lines")))).alias("m"))
    files = files.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qtr", F.to_json("m").alias("m"))))).alias("q"))
    quoted = lambda s: F.to_json(F.struct(s.alias("s")))
    name = lambda s: F.substring(quoted(s), 6, 2**30)
    entry = lambda k, v: F.concat(F.regexp_replace(name(k), r"\}$", ""), F.lit(":"), v)
    files = files.select("repo", F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("q"), lambda x: entry(x["key"], x["value"])), ","), F.lit("}")).alias("files"))
    big = facts.filter("kind = 'big_commit'").groupBy("repo").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "lines"))))).alias("big"))
    both = files.join(big, "repo", "full_outer").select("repo", F.concat(F.lit('{"big_commits":'), F.coalesce("big", F.lit("{}")), F.lit(',"files":'), F.coalesce("files", F.lit("{}")), F.lit("}")).alias("v"))
    out = both.agg(F.array_sort(F.collect_list(F.struct("repo", "v"))).alias("r"))
    return out.select(F.concat(F.lit("{"), F.array_join(F.transform("r", lambda x: entry(x["repo"], x["v"])), ","), F.lit("}")).alias("value"))


def edited(profiles_: DataFrame, not_relevant: DataFrame, timestamp: int) -> DataFrame:
    """Profiles as they are after curation: each with the list of skills to keep out of reports, and the time of the edit."""
    names = not_relevant.select("skill").distinct().agg(F.array_sort(F.collect_list("skill")).alias("nr_skills"))
    return profiles_.drop("nr_skills").crossJoin(names).withColumn("timestamp", F.lit(timestamp).cast("bigint"))  # one row


def pretty(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))


def compress_file(source: str, target: str) -> None:
    with open(source, "rb") as f, gzip.open(target, "wb") as g:
        shutil.copyfileobj(f, g)


def compress(data: bytes) -> bytes:
    return gzip.compress(data)


def decompress(data: bytes) -> bytes:
    return gzip.decompress(data)


def file_hash(path: str, algorithm: str = "sha256") -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, algorithm).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of any number of files, on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def signed_name(path: str, email: str, stem: str = "mt_stats", day: str | None = None) -> str:
    """Name of the signed copy: the day (``2024-03-05``; today by default), and the hash of the file's hash and of the key that stands for the e-mail."""
    key = hashlib.sha256(email.encode()).hexdigest()
    return f"{stem}_{day or datetime.date.today().isoformat()}_{hashlib.sha256((file_hash(path) + key).encode()).hexdigest()}.json.gz"


def sign(path: str, email: str, folder: str, day: str | None = None) -> str:
    to = os.path.join(folder, signed_name(path, email, day=day))
    compress_file(path, to)
    return to
