"""Queries that write files of the driver's tables and read them back through the engine's sources, with equal SQL for DuckDB.

Files go to a folder of their own below ``spark.checkpoint.dir``, or a temporary one where a local session has none.
"""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import scalars as S
from quern.operators import activity as A
from quern.operators import distinct as D
from quern.operators import scoring as SC
from quern.operators import skills as K
from quern.operators.numbering import numbered
from quern.plans import profile as P
from quern.plans.queries import _CHANGES, ORACLES, QUERIES, _scores, query
from quern.plans.tables import changes, table
from quern.sources import files as FS
from quern.sources import git as G
from quern.streaming import resume as RS


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see, as a local path; it goes when the program ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if "://" in shared and not shared.startswith("file://"):
            raise RuntimeError("git and single files need a shared folder that is mounted, not " + shared)
        out = os.path.join(shared.removeprefix("file://").removeprefix("file:"), f"quern-files-{uuid.uuid4().hex}")
        os.makedirs(out)
    elif spark.sparkContext.master.startswith("local"):
        out = tempfile.mkdtemp(prefix="quern-files-")
    else:
        raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that all of them see")
    atexit.register(shutil.rmtree, out, True)
    return out


def _text(df: DataFrame, path: str, **options) -> str:
    df.write.options(**options).text(f"file://{path}")
    return f"file://{path}"


# -- small files ------------------------------------------------------------------------------------------
@query("SELECT DISTINCT lang AS repo, source AS file FROM documents WHERE doc_id % 10 <> 0 AND lang IS NOT NULL AND source IS NOT NULL")
def label_file(spark, sf):
    """Every tenth record lacks its file."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("repo"), F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("file"))
    return FS.labels(spark, _text(d.select(F.to_json(F.struct("repo", "file"))), f"{folder(spark)}/labels"))


@query("SELECT DISTINCT c_mktsegment AS repo, c_name || '@x.org' AS user FROM customer")
def allow_list_file(spark, sf):
    c = table(spark, sf, "customer").select(F.concat_ws("\t", "c_mktsegment", F.concat("c_name", F.lit("@x.org"))))
    return FS.allow_list(spark, _text(c.union(c), f"{folder(spark)}/allow"))


@query("SELECT n_name AS skill, CASE WHEN n_nationkey % 2 = 0 THEN 'shown ' || n_name ELSE list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ') END AS display_name FROM nation")
def vocabulary_file(spark, sf):
    n = table(spark, sf, "nation")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name", F.lit("\tshown "), "n_name")).otherwise(F.concat("n_name", F.lit("\n  ")))
    return FS.vocabulary(spark, _text(n.select(line), f"{folder(spark)}/vocabulary"))


def _library_files(spark, sf) -> str:
    """One file for each region, of nations as libraries; small tables of a fixed size."""
    at = folder(spark)
    for r in table(spark, sf, "region").collect():
        rows = table(spark, sf, "nation").filter(F.col("n_regionkey") == r.r_regionkey).collect()
        with open(f"{at}/{r.r_name}.txt", "w") as f:
            f.writelines(f"{x.n_name}\t{x.n_nationkey + 3}\n" for x in rows)
    return f"file://{at}"


@query("SELECT r_name AS lang, n_name AS library, CAST(n_nationkey + 3 AS INTEGER) AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
def library_id_files(spark, sf):
    return FS.library_ids(spark, _library_files(spark, sf))[0]


@query("SELECT r_name AS lang, CAST(max(n_nationkey) + 4 AS INTEGER) AS next_id FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def library_next_ids(spark, sf):
    return FS.library_ids(spark, _library_files(spark, sf))[1]


@query("SELECT c_custkey, r_name AS lang, n_name AS library FROM customer JOIN nation ON n_nationkey = (c_nationkey + c_custkey % 2) % 25 JOIN (SELECT c_custkey AS k, r_name, r_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON k = c_custkey WHERE n_regionkey = r_regionkey")
def public_imports(spark, sf):
    """Customers import a nation under their own region's name; only those of that region's list are public."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    own = table(spark, sf, "customer").join(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("lang"), ((F.col("c_nationkey") + F.col("c_custkey") % 2) % 25).alias("k"))
    rows = own.join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("library")), "k").drop("k")
    return FS.public_imports(rows, FS.public_libraries(spark, _library_files(spark, sf))).select("c_custkey", "lang", "library")


@query("SELECT s_name AS value, row_number() OVER (ORDER BY s_suppkey) - 1 AS no FROM supplier")
def numbered_lines(spark, sf):
    s = table(spark, sf, "supplier").coalesce(1).sortWithinPartitions("s_suppkey").select(F.concat(F.lit("  "), "s_name", F.lit("\t ")))
    return FS.lines(spark, _text(s, f"{folder(spark)}/lines", compression="gzip"))


@query("SELECT DISTINCT n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def distinct_lines(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return FS.lines(spark, _text(s.select(F.concat("n_name", F.lit(" "))), f"{folder(spark)}/lines"), distinct=True)


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS no FROM (SELECT DISTINCT p_brand FROM part)")
def indexed_values(spark, sf):
    return FS.indexed(table(spark, sf, "part"), "p_brand")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS no FROM lineitem")
def numbered_rows(spark, sf):
    """Every line item's place by ship date, in ranges of some ten thousand."""
    rows = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return numbered(rows, "l_shipdate", "l_orderkey", "l_linenumber", rows_a_range=20_000).drop("l_shipdate")


@query(ORACLES["merge_summary"])
def merge_summary_by_bitmaps(spark, sf):
    """The summary from tables written by repository (codes, bitmaps, lines), the second half of the repositories coded after the first."""
    at = f"file://{folder(spark)}"
    activity, totals = A.monthly(changes(spark, sf)), K.skill_totals(_scores(spark, sf))
    D.summary_values(activity, totals).distinct().write.parquet(f"{at}/values")
    activity.groupBy("repo").agg(F.sum("added").alias("lines")).write.parquet(f"{at}/lines")
    values = spark.read.parquet(f"{at}/values")
    known = None
    for half in (F.col("repo") < "O", F.col("repo") >= "O"):
        D.codes(values.filter(half), known).write.parquet(to := f"{at}/codes-{known is None}")
        known = spark.read.parquet(to)
        D.bitmaps(values.filter(half), known).write.mode("append").partitionBy("repo").parquet(f"{at}/bitmaps")
    return D.merged_summary(spark.read.parquet(f"{at}/bitmaps"), spark.read.parquet(f"{at}/lines"))


def _nation_files(spark, sf) -> str:
    """One file for each nation: its name and its key, a line each; that of nation 3 isn't UTF-8."""
    at = folder(spark)
    for n in table(spark, sf, "nation").collect():
        with open(f"{at}/{n.n_nationkey}.py", "wb") as f:
            f.write(b"\xff\xfe" if n.n_nationkey == 3 else f"{n.n_name}\nkey = {n.n_nationkey}".encode())
    return f"file://{at}"


def _nation():
    return F.regexp_extract("path", r"([^/]*)\.py$", 1).cast("int").alias("n_nationkey")


@query("SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, CASE WHEN n_nationkey = 3 THEN '' ELSE n_name || '|key = ' || n_nationkey END AS lines FROM nation")
def code_files(spark, sf):
    return FS.code_file(spark, _nation_files(spark, sf)).select(_nation(), F.array_join("lines", "|").alias("lines"))


@query("""
    WITH f AS (SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, sha256(n_name || chr(10) || 'key = ' || n_nationkey) AS h FROM nation WHERE n_nationkey <> 3)
    SELECT n_nationkey, h AS sha256, 'mt_stats_2024-03-05_' || sha256(h || sha256('a@x.org')) || '.json.gz' AS signed, true AS whole FROM f""")
def file_signatures(spark, sf):
    at = _nation_files(spark, sf)
    rows = FS.file_hashes(spark, at).select(_nation(), "sha256").filter("n_nationkey <> 3")
    local = at.removeprefix("file://")
    made = []
    for n in range(25):
        if n != 3:
            to = FS.sign(f"{local}/{n}.py", "a@x.org", local, "2024-03-05")
            with open(to, "rb") as f, open(f"{local}/{n}.py", "rb") as g:
                made.append((n, os.path.basename(to), FS.decompress(f.read()) == g.read()))
    return rows.join(spark.createDataFrame(made, "n_nationkey int, signed string, whole boolean"), "n_nationkey")


@query("SELECT n_name AS skill, CASE n_nationkey % 3 WHEN 0 THEN 'Relevant' WHEN 1 THEN 'Not Relevant' ELSE 'Top Secret' END AS choice FROM nation")
def choices_file(spark, sf):
    k = F.col("n_nationkey") % 3
    choice = F.when(k == 0, "Relevant").when(k == 1, "Not Relevant").otherwise("Top Secret")
    one = table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", choice)))))
    return FS.choices(spark, _text(one, f"{folder(spark)}/choices"))


@query("SELECT 'r' AS repo, p_brand || '.py' AS file, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS imports FROM part GROUP BY p_brand")
def library_records(spark, sf):
    rows = table(spark, sf, "part").groupBy(F.concat("p_brand", F.lit(".py")).alias("file")).agg(F.array_sort(F.collect_set("p_type")).alias("imports"))
    at = f"file://{folder(spark)}/libs"
    FS.write_libraries(rows.withColumns({"repo": F.lit("r"), "repo_path": F.lit("/r")}), at)
    return FS.libraries(spark, at).select("repo", "file", F.array_join("imports", ",").alias("imports"))


# -- profiles ---------------------------------------------------------------------------------------------
def _profiles(spark, sf) -> DataFrame:
    """A record for every author and repository: its months by language, its skills by lines."""
    c = changes(spark, sf).withColumn("author", F.concat(F.lit("c"), "author", F.lit("@x.org")))
    month = c.groupBy("repo", "author", F.col("ext").alias("lang"), "ym").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    months = F.array_sort(F.collect_list(F.struct("ym", "added", "deleted", F.lit(1).cast("bigint").alias("sig_cont"), F.lit(0).cast("bigint").alias("too_big"))))
    langs = month.groupBy("repo", "author", "lang").agg(F.min("ym").alias("st"), F.max("ym").alias("et"), months.alias("months")).groupBy("repo", "author").agg(F.array_sort(F.collect_list(F.struct("lang", "st", "et", "months"))).alias("langs"))
    skills = c.groupBy("repo", "author", F.col("o_orderpriority").alias("skill")).agg(F.sum("added").alias("code_lines")).groupBy("repo", "author").agg(F.array_sort(F.collect_list(F.struct("skill", "code_lines"))).alias("skills"))
    return langs.join(skills, ["repo", "author"]).withColumns({"version": F.lit("v"), "timestamp": F.lit(7).cast("bigint"), "repo_path": F.concat(F.lit("/src/"), "repo")})


_MONTHS = f"WITH {_CHANGES}, a AS (SELECT repo, 'c' || author || '@x.org' AS author, ext AS lang, ym, CAST(sum(added) AS BIGINT) AS added FROM c GROUP BY ALL)"


@query(_MONTHS + " SELECT repo, author, lang, ym, added FROM a WHERE author LIKE '%1@x.org'")
def profile_files(spark, sf):
    """Records written by repository and read again by an allow list: the months of allowed authors."""
    at, rows = f"file://{folder(spark)}/profiles", _profiles(spark, sf)
    FS.write_profiles(rows, at)
    allow = rows.filter("author like '%1@x.org'").select("repo", F.col("author").alias("user"))
    got = FS.profiles(spark, at, allow).select("repo", "author", F.explode("langs").alias("l")).select("repo", "author", "l.lang", F.explode("l.months").alias("m"))
    return got.select("repo", "author", "lang", "m.ym", "m.added")


@query(f"WITH {_CHANGES} SELECT 'label' AS user, 9 AS timestamp, 'crew' AS team, repo, 'c' || author || '@x.org' AS author, o_orderpriority AS skill, CAST(sum(added) AS BIGINT) AS code_lines FROM c GROUP BY ALL")
def merged_document(spark, sf):
    at = f"file://{folder(spark)}/{FS.merged_name('merged.json', '2024-03-05')}"
    FS.write_merged(_profiles(spark, sf), spark.createDataFrame([("label",)], "label string"), 9, at, "crew")
    doc = FS.document_profiles(spark, at).select("user", F.col("timestamp").cast("int").alias("timestamp"), "team", F.col("profile").alias("p"))
    return doc.select("user", "timestamp", "team", "p.repo", "p.author", F.explode("p.skills").alias("s")).select("user", "timestamp", "team", "repo", "author", "s.skill", "s.code_lines")


@query(f"WITH {_CHANGES} SELECT DISTINCT repo, 'c' || author || '@x.org' AS author, CAST(11 AS BIGINT) AS timestamp, 'a,b' AS nr_skills FROM c")
def edited_profiles(spark, sf):
    at = f"file://{folder(spark)}/edited"
    hidden = spark.createDataFrame([("b",), ("a",), ("b",)], "skill string")
    FS.pretty(FS.edited(_profiles(spark, sf).drop("langs", "skills"), hidden, 11)).write.text(at, lineSep="\n\n")
    rows = spark.read.text(at, lineSep="\n\n").select(F.from_json("value", "repo string, author string, timestamp bigint, nr_skills array<string>").alias("v")).select("v.*")
    return rows.withColumn("nr_skills", F.array_join("nr_skills", ","))


@query(
    f"""WITH {_CHANGES}, o AS (SELECT *, CAST(ym // 100 AS VARCHAR) || 'Q' || CAST(((ym % 100 - 1) // 3 + 1) AS VARCHAR) AS qtr FROM c WHERE author % 10 = 1)
    SELECT repo, qtr, CAST(file AS VARCHAR) AS name, CAST(sum(added) AS BIGINT) AS lines FROM o GROUP BY repo, qtr, file
    UNION ALL SELECT repo, NULL, CAST(commit_id AS VARCHAR), CAST(sum(added) AS BIGINT) FROM o GROUP BY repo, commit_id HAVING sum(added) > 100"""
)
def report_document(spark, sf):
    at = _text(FS.report_document(QUERIES["report_facts"](spark, sf)), f"{folder(spark)}/report")
    doc = spark.read.text(at, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<big_commits: map<string, bigint>, files: map<string, map<string, bigint>>>>")).alias("repo", "v"))
    big = doc.select("repo", F.lit(None).cast("string").alias("qtr"), F.explode("v.big_commits").alias("name", "lines"))
    files = doc.select("repo", F.explode("v.files").alias("qtr", "m")).select("repo", "qtr", F.explode("m").alias("name", "lines"))
    return files.union(big)


# -- git --------------------------------------------------------------------------------------------------
def _history(nation: int, suppliers) -> Iterator[bytes]:
    """A repository's commits as git's import format: of each supplier k, in their order, an hour apart, five days from one supplier to the next.

    0. ``src/f<k % 4>.py`` anew with k % 40 + 5 lines; every tenth adds a binary file. By Dev<k % 7>.
    1. every fifth (k % 5 = 1): ``side/b<k>.py`` on a branch, by Dev<(k + 1) % 7>, and 2. its merge.
    3. k % 6 = 2: ``lib/r<k>.py`` of 30 lines, which 4. becomes ``lib/s<k>.py``, with one line changed.
    5. k % 7 = 3: the lines of 0 are indented. 6. k % 8 = 4: ``big/g<k>.py`` of 400 lines.
    """

    def text(k: int, n: int, indent: str = "", other: int = -1) -> bytes:
        return "".join(f"{indent}value_{k}_{i} = compute({k * 7919 + i + (i == other)})\n" for i in range(n)).encode()

    def inline(path: str, data: bytes) -> bytes:
        return f"M 100644 inline {path}\ndata {len(data)}\n".encode() + data + b"\n"

    def commit(k: int, event: int, *files: bytes, by: int = 0, branch: str = "main", parents: str = "") -> bytes:
        who = f"n <Dev{(k + by) % 7}@X.org> {1577836800 + 432000 * k + 3600 * event} +0000"
        return f"commit refs/heads/{branch}\nmark :{8 * k + event + 1}\nauthor {who}\ncommitter {who}\ndata 1\nx\n{parents}".encode() + b"".join(files)

    for k in suppliers:
        path = f"src/f{k % 4}.py"
        yield commit(k, 0, inline(path, text(k, k % 40 + 5)), *([inline(f"b{k}.bin", b"\x00\x01\x02")] if k % 10 == 0 else []))
        if k % 5 == 1:
            side = inline(f"side/b{k}.py", text(k, 12))
            yield commit(k, 1, side, by=1, branch="side", parents=f"from :{8 * k + 1}\n")
            yield commit(k, 2, side, parents=f"from :{8 * k + 1}\nmerge :{8 * k + 2}\n")
        if k % 6 == 2:
            yield commit(k, 3, inline(f"lib/r{k}.py", text(k, 30)))
            yield commit(k, 4, f"R lib/r{k}.py lib/s{k}.py\n".encode(), inline(f"lib/s{k}.py", text(k, 30, other=7)))
        if k % 7 == 3:
            yield commit(k, 5, inline(path, text(k, k % 40 + 5, indent="    ")))
        if k % 8 == 4:
            yield commit(k, 6, inline(f"big/g{k}.py", text(k, 400)))


def _repositories(spark, sf) -> DataFrame:
    """repo_path, repo: a repository of each nation that has suppliers, made by the tasks that have its suppliers, in one pass over them.

    A repository is made aside and moved, so a task that runs again leaves a whole one.
    """
    at = folder(spark)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((int(n), int(k)) for df in frames for n, k in zip(df["s_nationkey"], df["s_suppkey"], strict=True))
        for nation, some in itertools.groupby(rows, lambda r: r[0]):
            aside, path = f"{at}/.making-{uuid.uuid4().hex}", f"{at}/team/n{nation}"
            subprocess.run(["git", "init", "-q", "-b", "main", aside], check=True, capture_output=True)
            with subprocess.Popen(["git", "-C", aside, "fast-import", "--quiet", "--force"], stdin=subprocess.PIPE) as p:
                for x in _history(nation, (k for _, k in some)):
                    p.stdin.write(x)
                p.stdin.close()
            if p.returncode:
                raise RuntimeError("git fast-import failed")
            for key, value in (("remote.origin.url", f"git@h:team/n{nation}.git"), ("user.email", f"n{nation}@x.org")):
                subprocess.run(["git", "-C", aside, "config", key, value], check=True)
            os.makedirs(f"{at}/team", exist_ok=True)
            if not os.path.isdir(path):
                os.rename(aside, path)
            yield pd.DataFrame([(path, f"n{nation}")], columns=["repo_path", "repo"])

    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey").dropna()
    rows = rows.repartition(G.tasks(spark), "s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").mapInPandas(make, "repo_path string, repo string")
    rows.write.parquet(f"file://{at}/made")  # once
    return spark.read.parquet(f"file://{at}/made")


def _commits(spark, sf) -> DataFrame:
    return A.parse_commits(G.log(_repositories(spark, sf)).filter("error is null").drop("error"))


#: Every changed file of text of :func:`_history`; of a merge what it merges. ``event`` tells the commits of a supplier apart.
_EVENTS = """
    WITH k AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS repo, CAST(s_suppkey % 40 + 5 AS BIGINT) AS n FROM supplier),
    f AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY repo, k % 4 ORDER BY k), 0) AS was FROM k),
    e AS (
        SELECT k, repo, 0 AS event, 0 AS by_, 'src/f' || k % 4 || '.py' AS path, n AS added, was AS deleted FROM f
        UNION ALL SELECT k, repo, 1, 1, 'side/b' || k || '.py', 12, 0 FROM f WHERE k % 5 = 1
        UNION ALL SELECT k, repo, 2, 0, 'side/b' || k || '.py', 12, 0 FROM f WHERE k % 5 = 1
        UNION ALL SELECT k, repo, 3, 0, 'lib/r' || k || '.py', 30, 0 FROM f WHERE k % 6 = 2
        UNION ALL SELECT k, repo, 4, 0, 'lib/s' || k || '.py', 1, 1 FROM f WHERE k % 6 = 2
        UNION ALL SELECT k, repo, 5, 0, 'src/f' || k % 4 || '.py', n, n FROM f WHERE k % 7 = 3
        UNION ALL SELECT k, repo, 6, 0, 'big/g' || k || '.py', 400, 0 FROM f WHERE k % 8 = 4),
    c AS (SELECT *, 'dev' || (k + by_) % 7 || '@x.org' AS author, CAST(1577836800 + 432000 * k + 3600 * event AS BIGINT) AS ts,
                 event IN (0, 3) AND added >= 20 AS is_new, event = 5 AND added >= 20 AS is_reformat FROM e)"""


@query(_EVENTS + " SELECT repo, author, ts FROM c")
def git_commits(spark, sf):
    """A walk over the folder that the repositories lie in."""
    paths = _repositories(spark, sf)
    root = os.path.dirname(paths.first()["repo_path"])
    os.makedirs(f"{root}/.hidden", exist_ok=True)
    repos = G.repositories(spark, root, prune_hidden=True)
    return A.parse_commits(G.log(repos).filter("error is null").drop("error")).select("repo", "author", "ts")


@query(_EVENTS + " SELECT repo, author, ts FROM c WHERE author IN ('dev1@x.org', 'dev4@x.org') AND ts >= 1577923200 AND repo <> 'n3'")
def git_commits_of_some(spark, sf):
    """The data source in ranges of ten commits, its filters in git's arguments; repositories of a file with their list."""
    at = f"file://{folder(spark)}/list"
    _repositories(spark, sf).select("repo_path").write.text(at)
    paths = [r.repo_path for r in G.repositories(spark, list_file=at).collect()]  # a name each, as the source's option
    G.register(spark)
    rows = spark.read.format("git_log").option("paths", ",".join(paths)).option("commits", 10).load()
    return rows.filter(F.col("author").isin("dev1@x.org", "dev4@x.org") & (F.col("ts") >= 1577836800 + 86400) & (F.col("repo") != "n3")).select("repo", "author", "ts")


@query(_EVENTS + " SELECT repo, author, ts, path, added, deleted, 'py' AS ext FROM c")
def git_changes(spark, sf):
    """Every change of a file of text, with renames and merges; git gives no numbers for the binary ones."""
    commits = _commits(spark, sf)
    rows = A.supported_changes(A.valid_changes(G.numstat(commits).filter("error is null").drop("error")))
    return rows.join(commits.select("repo_path", "commit_id", "author", "ts"), ["repo_path", "commit_id"]).select("repo", "author", "ts", "path", "added", "deleted", "ext")


@query(_EVENTS + " SELECT repo, author, ts, path, added, deleted FROM c WHERE ts < 1609459200")
def git_changes_in_ranges(spark, sf):
    """The same numbers by the data source: ranges of seven commits, each one git process, of the time before 2021."""
    paths = [r.repo_path for r in _repositories(spark, sf).collect()]
    G.register(spark)
    rows = spark.read.format("git_numstat").option("paths", ",".join(paths)).option("commits", 7).load().filter(F.col("ts") < 1609459200)
    return A.supported_changes(A.valid_changes(rows)).select("repo", "author", "ts", "path", "added", "deleted")


_MONTH = "CAST(year(make_timestamp(ts * 1000000)) * 100 + month(make_timestamp(ts * 1000000)) AS INTEGER)"
_ACTIVITY = f"""
    SELECT repo, author, 'py' AS lang, {_MONTH} AS ym, CAST(sum(CASE WHEN is_reformat THEN 0 ELSE added END) AS BIGINT) AS added,
           CAST(sum(CASE WHEN is_reformat THEN 0 ELSE deleted END) AS BIGINT) AS deleted, count(*) AS commits,
           count(*) FILTER (is_new) AS sig_cont, count(*) FILTER (event = 6) AS too_big FROM c GROUP BY ALL"""


@query(_EVENTS + _ACTIVITY)
def git_activity(spark, sf):
    """The whole run: log, numbers, diffs, verdicts (reformats are taken back, too large files counted), snippets, months."""
    return P.facts(_repositories(spark, sf)).activity


@query(_EVENTS + _ACTIVITY)
def git_activity_resumed(spark, sf):
    """The same by two runs that go on: the first stops each repository's branch in the middle, the second reads the rest."""
    at, repos = folder(spark), _repositories(spark, sf)
    paths = [r.repo_path for r in repos.collect()]

    def move(frames: Iterator[pd.DataFrame], back: bool) -> Iterator[pd.DataFrame]:
        for df in frames:
            for path in df["repo_path"]:
                if back:  # to the middle one of the branch's own commits
                    own = G.git(path, "rev-list", "--first-parent", "main")[0].split()
                    G.git(path, "update-ref", "refs/heads/end", own[0])
                    G.git(path, "update-ref", "refs/heads/main", own[len(own) // 2])
                else:
                    G.git(path, "update-ref", "refs/heads/main", "refs/heads/end")
            yield df[["repo_path"]]

    for back in (True, False):
        repos.select("repo_path").mapInPandas(lambda frames, back=back: move(frames, back), "repo_path string").write.mode("overwrite").parquet(f"file://{at}/moved")
        state = RS.advance(spark, paths, f"file://{at}/state", commits=16)
    return RS.results(state).activity


@query(
    _EVENTS
    + """ SELECT repo, author, path, added AS n_lines, sha256(string_agg('value_' || k || '_' || i || ' = compute(' || (k * 7919 + i) || ')', chr(10) ORDER BY i)) AS snippet
    FROM (SELECT *, unnest(range(0, added)) AS i FROM c WHERE is_new) GROUP BY k, event, repo, author, path, added"""
)
def git_snippets(spark, sf):
    """The snippets of all diffs: of new files of 20 added lines and more, the whole file."""
    f = P.facts(_repositories(spark, sf), folder=f"file://{folder(spark)}/run")
    return f.snippets.select("repo", "author", "path", "n_lines", S.sha256("snippet").alias("snippet"))


@query("SELECT DISTINCT 'n' || s_nationkey AS repo, 'git@h:team/n' || s_nationkey || '.git' AS remote, 'n' || s_nationkey || '@x.org' AS email FROM supplier")
def git_settings(spark, sf):
    """A repository whose settings git can't tell ends the query: the result has no column that would say so."""
    rows = G.settings(_repositories(spark, sf), remote="remote.origin.url", email="user.email")
    told = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "repo_path", "error")).cast("boolean"))
    return rows.filter(told).select("repo", "remote", "email")


@query(_EVENTS + " SELECT author, count(DISTINCT repo) AS count FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def git_authors(spark, sf):
    """The people of all repositories, those of most repositories first."""
    lines = G.log(_repositories(spark, sf)).filter("error is null")
    return A.author_ranking(lines.select("repo", F.split("line", "\x01")[0].alias("raw_author")))


@query(_EVENTS + f", m AS (SELECT repo, author, count(DISTINCT {_MONTH}) AS n, count(*) FILTER (is_new) AS news FROM c GROUP BY ALL) SELECT repo, author, 'py' AS lang FROM m WHERE n >= 2 AND news > 0")
def active_languages(spark, sf):
    """The languages that are scored: of two months of activity and more, with a snippet."""
    return P.active_languages(P.facts(_repositories(spark, sf)), Config(min_months=2))


_SCORED = ", s AS (SELECT * FROM c WHERE is_new)"


@query(_EVENTS + _SCORED + " SELECT repo, author, path, CAST(added AS INTEGER) AS line_count, model, count(*) AS n FROM s, (SELECT unnest(['c2s::m', 'i2s::m']) AS model), (SELECT unnest(range(2))) GROUP BY k, event, repo, author, path, added, model")
def scored_chunks(spark, sf):
    """Every snippet here is one chunk, since it is short, and is scored against two skills by two models, one of them fed with the file's libraries."""
    f = P.facts(_repositories(spark, sf))
    libraries = f.changes.select("repo", "path", F.concat(F.lit("import "), F.split("path", "/")[0]).alias("libs")).distinct()
    tags = {"c2s::m": SC.stub_loader(["a", "b"]), "i2s::m": SC.stub_loader(["a", "b"])}
    scores = P.scored(f, tags, dict.fromkeys(tags, ["a", "b"]), config=Config(chunk_chars=10_000), libraries=libraries)
    return scores.groupBy("repo", "commit_id", "author", "path", "line_count", "model").agg(F.count(F.lit(1)).alias("n")).drop("commit_id")


@query(
    _EVENTS
    + f""", a AS ({_ACTIVITY}),
    m AS (SELECT repo, author, count(*) AS n, CAST(sum(added) AS BIGINT) AS added, CAST(sum(sig_cont) AS BIGINT) AS sig_cont FROM a GROUP BY ALL HAVING count(*) >= 2 AND sum(sig_cont) > 0),
    w AS (SELECT repo, author, min({_MONTH}) AS st, max({_MONTH}) AS et FROM c WHERE added > 10 GROUP BY ALL)
    SELECT repo, author, CAST(7 AS BIGINT) AS timestamp, 'py' AS lang, st, et, CAST(n AS INTEGER) AS months, added, sig_cont FROM m JOIN w USING (repo, author)"""
)
def repository_profiles(spark, sf):
    """The end of a run: a record for each repository and author with a language of two months, written as JSON lines and read back."""
    config = Config(min_months=1)
    f = P.facts(_repositories(spark, sf))
    scores = P.scored(f, {"c2s::m": SC.stub_loader(["a", "b"])}, {"c2s::m": ["a", "b"]}, config=config)
    at = f"file://{folder(spark)}/profiles"
    FS.write_profiles(P.profiles(f, scores, 7, Config(min_months=2)), at)
    rows = FS.profiles(spark, at).select("repo", "author", F.col("timestamp").cast("long").alias("timestamp"), F.explode("langs").alias("l"))
    total = lambda c: F.aggregate(F.col("l.months"), F.lit(0).cast("long"), lambda s, x: s + x[c])
    return rows.select("repo", "author", "timestamp", "l.lang", "l.st", "l.et", F.size("l.months").alias("months"), total("added").alias("added"), total("sig_cont").alias("sig_cont"))
