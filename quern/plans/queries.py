"""Queries over the driver's tables, each applying operators of the engine, with equal SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import crypto as CR
from quern.functions import scalars as S
from quern.functions import text as TX
from quern.operators import activity as A
from quern.operators import report as R
from quern.operators import scoring as SC
from quern.operators import skills as K
from quern.operators import snippets as SN
from quern.plans.tables import changes, commits, spread, table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_YM = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER)"
_CHANGES = f"""
    c AS (SELECT l_orderkey AS commit_id, l_returnflag AS ext, l_suppkey AS file, CAST(l_quantity AS BIGINT) AS added,
                 CAST(l_linenumber AS BIGINT) AS deleted, l_linestatus, l_discount, l_tax, o_custkey AS author, o_orderstatus AS repo,
                 {_YM} AS ym, o_orderpriority, o_totalprice
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# -- activity ---------------------------------------------------------------------------------------------
@query(f"WITH {_CHANGES} SELECT repo, author, ext AS lang, ym, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(DISTINCT commit_id) AS commits FROM c GROUP BY ALL")
def lang_month_activity(spark, sf):
    return A.monthly(changes(spark, sf))


@query(f"SELECT o_custkey AS author, o_orderstatus AS repo, count(*) AS commits FROM orders JOIN (SELECT o_custkey AS k, o_orderstatus AS s FROM orders GROUP BY ALL HAVING count(DISTINCT {_YM}) >= 5) ON o_custkey = k AND o_orderstatus = s GROUP BY ALL")
def author_min_months(spark, sf):
    rows = commits(spark, sf).withColumn("ts", F.unix_timestamp(F.col("at").cast("timestamp")))
    return A.active_authors(rows, Config(min_months=5)).groupBy("author", "repo").agg(F.count(F.lit(1)).alias("commits"))


@query(f"WITH {_CHANGES} SELECT repo, author, ext AS lang, min(ym) AS st, max(ym) AS et FROM c WHERE added > 10 GROUP BY ALL")
def lang_span(spark, sf):
    return A.spans(changes(spark, sf))


@query(f"WITH {_CHANGES}, s AS (SELECT *, sum(added) OVER (PARTITION BY repo, commit_id) AS a, sum(deleted) OVER (PARTITION BY repo, commit_id) AS d FROM c) SELECT commit_id, file, added FROM s WHERE a <= 150 AND d <= 150")
def huge_commit_drop(spark, sf):
    return A.without_huge_commits(changes(spark, sf), 150).select("commit_id", "file", "added")


@query(f"WITH {_CHANGES}, s AS (SELECT *, sum(added) OVER (PARTITION BY repo, commit_id) AS a FROM c WHERE added > 10) SELECT commit_id, file, added FROM s WHERE a < 120")
def analysed_files(spark, sf):
    return A.analysed_files(changes(spark, sf), Config(max_commit_lines=120)).select("commit_id", "file", "added")


@query(f"WITH {_CHANGES} SELECT repo, author, ext AS lang, ym, CAST(sum(CASE WHEN l_tax < 0.02 THEN 0 ELSE added END) AS BIGINT) AS added, CAST(sum(CASE WHEN l_tax < 0.02 THEN 0 ELSE deleted END) AS BIGINT) AS deleted, count(DISTINCT commit_id) AS commits FROM c GROUP BY ALL")
def reformat_retraction(spark, sf):
    return A.monthly(changes(spark, sf), F.col("l_tax") < 0.02)


@query("SELECT o_orderkey AS commit_id, o_custkey AS author FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def allow_list_semi(spark, sf):
    allow = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.explode(F.array(*[F.lit(x) for x in ("F", "O", "P")])).alias("repo"), F.col("c_custkey").alias("user"))
    return A.allowed(commits(spark, sf), allow).select("commit_id", "author")


@query("""
    WITH r AS (SELECT o_orderstatus AS repo, CASE o_orderkey % 4 WHEN 0 THEN ' User' || o_custkey % 90 || '@X.org' WHEN 1 THEN 'user' || o_custkey % 90 || '@x.org' WHEN 2 THEN '' ELSE 'USER' || o_custkey % 90 || '@x.org ' END AS raw FROM orders),
    n AS (SELECT lower(trim(raw)) AS author, count(*) AS count FROM (SELECT DISTINCT repo, raw FROM r WHERE raw <> '') GROUP BY 1 UNION ALL SELECT 'new@x.org', 0)
    SELECT author, CAST(count AS BIGINT) AS count FROM n ORDER BY author <> 'new@x.org', count DESC, author LIMIT 20""")
def author_rank_repo(spark, sf):
    """Spellings that differ in case and white space, empty ones, and somebody without a commit."""
    k, u = F.col("commit_id") % 4, (F.col("author") % 90).cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" User"), u, F.lit("@X.org"))).when(k == 1, F.concat(F.lit("user"), u, F.lit("@x.org"))).when(k == 2, "").otherwise(F.concat(F.lit("USER"), u, F.lit("@x.org ")))
    return A.author_ranking(commits(spark, sf).withColumn("raw_author", raw), "repos", "new@x.org")


@query("SELECT CAST(o_custkey AS VARCHAR) AS author, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def author_rank_commit(spark, sf):
    return A.author_ranking(commits(spark, sf), "commits", most=10)


@query(f"WITH {_CHANGES} SELECT repo, commit_id, CAST(sum(added) AS BIGINT) AS lines FROM c GROUP BY ALL HAVING sum(added) > 100")
def big_commits(spark, sf):
    return A.big_commits(changes(spark, sf))


@query("SELECT lower(trim('  ' || c_name || ' ')) AS author, CAST(c_custkey AS BIGINT) AS ts FROM customer")
def commit_log_parse(spark, sf):
    c = table(spark, sf, "customer")
    lines = c.select(F.concat_ws("\x01", F.concat(F.lit("\t "), "c_name", F.lit("  ")), F.col("c_custkey").cast("string"), F.sha1(F.col("c_name"))).alias("line"))
    return A.parse_commits(lines).select("author", "ts")


@query("""
    SELECT p_partkey AS k, regexp_replace('src/{old => ' || p_brand || '}/' || p_partkey || '.py', '(.*)\\{.* => (.*)\\}(.*)', '\\1\\2\\3') AS path, CAST(p_size AS BIGINT) AS added, CAST(p_partkey % 3 AS BIGINT) AS deleted, 'py' AS ext
    FROM part WHERE p_partkey % 5 <> 0""")
def numstat_rows(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(F.lit("src/{old => "), "p_brand", F.lit("}/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    added = F.when(F.col("p_partkey") % 5 == 0, "-").otherwise(F.col("p_size").cast("string"))
    rows = p.select(F.col("p_partkey").alias("k"), added.alias("added"), (F.col("p_partkey") % 3).cast("string").alias("deleted"), path.alias("path"))
    return A.supported_changes(A.valid_changes(rows)).select("k", "path", "added", "deleted", "ext")


# -- snippets ---------------------------------------------------------------------------------------------
@query("""
    WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents),
    p AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS g FROM u WHERE length(line) >= 40)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS snippet, count(*) AS n_lines FROM p GROUP BY doc_id, g HAVING count(*) >= 10""")
def added_runs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return SN.added_runs(docs, ["doc_id"], "text", 10, lambda x: F.length(x) >= 40).drop("run_id")


@query("""
    WITH u AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    p AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, ls FROM u),
    x AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_replace(ls[i + 1], '[^a-zA-Z]', '', 'g') AS a, regexp_replace(coalesce(ls[i + 2], ''), '[^a-zA-Z]', '', 'g') AS b FROM p)
    SELECT doc_id, line_no, levenshtein(a, b) AS changed, levenshtein(a, b) < 50 AS reformat FROM x""")
def changed_chars(spark, sf):
    """Every line of a whole text against the next (the last against nothing)."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    d = d.select("doc_id", F.posexplode(F.zip_with("lines", F.slice("lines", F.lit(2), F.size("lines")), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit("")).alias("b")))).alias("line_no", "p"))
    side = lambda c: F.regexp_replace(F.col(f"p.{c}"), "[^a-zA-Z]", "")
    d = d.select("doc_id", "line_no", side("a").alias("a"), side("b").alias("b"))
    diff = F.concat(F.lit("+"), "a", F.lit("\n context\n-"), "b")
    d = d.select("doc_id", "line_no", S.changed_chars(diff).cast("bigint").alias("changed"))
    return d.withColumn("reformat", F.col("changed") < 50)


@query("""
    WITH d AS (SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, 'license|License|LICENSE')
               AND length(text) - length(replace(text, ' ', '')) >= 5 * (length(text) - length(replace(text, chr(10), '')))),
    u AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(9), ' '), chr(13), ' '), chr(10))) AS x FROM d)
    SELECT doc_id, count(*) FILTER (NOT (starts_with(x, 'http') OR starts_with(x, 'www') OR contains(x, 'author ') OR contains(x, 'param '))) AS n FROM u GROUP BY doc_id""")
def doc_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.doc_lines("text").alias("kept"))
    return d.filter("kept is not null").select("doc_id", F.size("kept").cast("bigint").alias("n"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS is_labeled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def labeled_flag(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path"))
    marks = table(spark, sf, "labels").select(F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("file"))
    return SN.labelled(docs, marks).select("doc_id", "is_labeled")


# -- scores and skills ------------------------------------------------------------------------------------
def _scores(spark, sf):
    """Line items as scored chunks: an order's priority is the skill, its status names the model."""
    c = changes(spark, sf)
    model = F.when(F.col("l_linestatus") == "O", "c2s::m").otherwise("life_of_py::m")
    return c.select(
        F.lit("r").alias("repo"), "author", F.col("ext").alias("lang"), "ym", model.alias("model"), F.col("o_orderpriority").alias("skill"),
        F.col("l_discount").cast("double").alias("score"), F.col("l_tax").cast("double").alias("sm_score"), F.col("added").alias("line_count"), F.col("deleted").alias("doc_lines"), (F.col("file") % 2).cast("int").alias("is_labeled"),
    )


_SCORES = f"""
    WITH {_CHANGES}, s AS (SELECT 'r' AS repo, author, ext AS lang, ym, CASE WHEN l_linestatus = 'O' THEN 'c2s::m' ELSE 'life_of_py::m' END AS model,
        o_orderpriority AS skill, l_discount AS score, l_tax AS sm_score, added AS line_count, deleted AS doc_lines, CAST(file % 2 AS INTEGER) AS is_labeled FROM c),
    st AS (SELECT repo, author, lang, ym, model, skill, max(score) AS max_score, min(score) AS min_score, sum(score) AS sum_score, max(sm_score) AS max_sm,
        min(sm_score) AS min_sm, sum(sm_score) AS sum_sm, count(*) AS snippets, CAST(sum(line_count) AS BIGINT) AS code_lines, CAST(sum(doc_lines) AS BIGINT) AS doc_lines, max(is_labeled) AS is_labeled FROM s GROUP BY ALL),
    tot AS (SELECT repo, author, skill, CAST(sum(line_count) AS BIGINT) AS code_lines FROM s WHERE model LIKE 'c2s::%' GROUP BY ALL)"""
_FLAGS = (
    _SCORES
    + """,
    man AS (SELECT '5-LOW' AS skill),
    f AS (SELECT st.*, tot.skill IS NOT NULL AS has_total, st.skill IN (SELECT skill FROM man) AS manual, split_part(model, '::', 1) AS kind,
                 max_score <= 0.05 AS weak FROM st LEFT JOIN tot USING (repo, author, skill)),
    g AS (SELECT *, weak OR (kind <> 'life_of_py' AND (NOT has_total OR manual)) AS gone FROM f)"""
)


@query(_SCORES + " SELECT repo, author, lang, ym, model, skill, max_score, min_score, round(sum_score, 6) AS sum_score, max_sm, min_sm, round(sum_sm, 6) AS sum_sm, snippets, code_lines, doc_lines, is_labeled FROM st")
def skill_stats(spark, sf):
    return K.skill_months(_scores(spark, sf)).withColumns({"sum_score": F.round("sum_score", 6), "sum_sm": F.round("sum_sm", 6)})


@query(_SCORES + " SELECT * FROM tot")
def skill_totals(spark, sf):
    return K.skill_totals(_scores(spark, sf))


def _filtered(spark, sf):
    s = _scores(spark, sf)
    manual = spark.createDataFrame([("5-LOW",)], "skill string")
    return K.filter_skills(K.skill_months(s), K.skill_totals(s), {"c2s": 0.05, "life_of_py": 0.05}, manual)


@query(_FLAGS + " SELECT repo, author, lang, ym, model, skill, max_score, code_lines FROM g WHERE NOT gone")
def filter_skills(spark, sf):
    return _filtered(spark, sf)[0].select("repo", "author", "lang", "ym", "model", "skill", "max_score", "code_lines")


@query(
    _FLAGS
    + """, x AS (SELECT repo, author, skill, sum(CASE WHEN weak THEN code_lines ELSE 0 END) AS less, bool_or(NOT gone AND kind = 'c2s') AS good, bool_or(manual) AS cur FROM g GROUP BY ALL)
    SELECT tot.repo, tot.author, tot.skill, CAST(greatest(0, code_lines - coalesce(less, 0)) AS BIGINT) AS code_lines FROM tot LEFT JOIN x USING (repo, author, skill) WHERE good IS NULL OR (good AND NOT cur)"""
)
def filter_skills_totals(spark, sf):
    return _filtered(spark, sf)[1]


_CHOICE_TOTALS = f"WITH {_CHANGES}, t AS (SELECT CAST(file % 50 AS VARCHAR) || '-' || ext AS skill, CAST(sum(added * (file % 50)) AS BIGINT) AS lines FROM c GROUP BY ALL), m AS (SELECT avg(lines) AS mean FROM t)"


def _choice_totals(spark, sf):
    c = changes(spark, sf)
    return c.select(F.concat((F.col("file") % 50).cast("string"), F.lit("-"), "ext").alias("skill"), (F.col("added") * (F.col("file") % 50)).alias("code_lines"))


@query(_CHOICE_TOTALS + " SELECT skill, lines, CASE WHEN lines > 0.4 * mean THEN 'Relevant' ELSE 'Not Relevant' END AS choice FROM t, m WHERE lines >= 0.2 * mean")
def default_choices(spark, sf):
    return K.default_choices(_choice_totals(spark, sf))


@query(_CHOICE_TOTALS + " SELECT skill FROM t, m WHERE NOT lines >= 0.2 * mean")
def weak_skills(spark, sf):
    return K.weak_skills(_choice_totals(spark, sf))


@query(
    f"""
    WITH p AS (SELECT author, skill, CAST(n AS DOUBLE) + CAST(author % 7 AS DOUBLE) / 10 AS logit FROM (SELECT o_custkey AS author, o_orderpriority AS skill, count(*) AS n FROM orders GROUP BY 1, 2)),
    s AS (SELECT *, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY author) AS sm FROM (SELECT *, max(logit) OVER (PARTITION BY author) AS m FROM p)),
    r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY logit DESC, skill) AS rank, sum(sm) OVER (PARTITION BY author) - coalesce(sum(sm) OVER (PARTITION BY author ORDER BY logit DESC, skill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM s)
    SELECT author, skill, CAST(rank AS INTEGER) AS rank, round(sm, 6) AS sm_score, round(sm / lft, 6) AS score FROM r WHERE rank <= 3"""
)
def next_best_prob(spark, sf):
    p = commits(spark, sf).groupBy("author", F.col("o_orderpriority").alias("skill")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = p.select("author", "skill", (F.col("n") + (F.col("author") % 7).cast("double") / 10).alias("logit"))
    return SC.ranked(p, ["author"], k=3).select("author", "skill", "rank", F.round("sm_score", 6).alias("sm_score"), F.round("score", 6).alias("score"))


_STUB = [f"skill-{i}" for i in range(30)]


@query(
    """
    WITH v AS (SELECT unnest([{skills}]) AS skill), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    h AS (SELECT doc_id, skill, sha256(t || chr(0) || skill) AS h FROM d, v),
    l AS (SELECT doc_id, skill, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) / 4294967296.0 * 8 - 4 AS logit FROM h),
    s AS (SELECT *, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY doc_id) AS sm FROM (SELECT *, max(logit) OVER (PARTITION BY doc_id) AS m FROM l)),
    r AS (SELECT *, row_number() OVER w AS rank, sum(sm) OVER (PARTITION BY doc_id) - coalesce(sum(sm) OVER (PARTITION BY doc_id ORDER BY logit DESC, skill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY logit DESC, skill))
    SELECT doc_id, skill, CAST(rank AS INTEGER) AS rank, round(sm / lft, 4) AS score FROM r WHERE rank <= 10""".replace("{skills}", ", ".join(f"'{x}'" for x in _STUB))
)
def stub_scores(spark, sf):
    docs = texts(spark, sf).select("doc_id", F.col("text").alias("chunk"))
    return SC.ranked(SC.logits(docs, SC.stub_loader(_STUB), _STUB, ["doc_id"]), ["doc_id"], k=10).select("doc_id", "skill", "rank", F.round("score", 4).alias("score"))


# -- reports ----------------------------------------------------------------------------------------------
_FILES = f"WITH {_CHANGES}, f AS (SELECT repo, CAST(ym // 100 AS VARCHAR) || 'Q' || CAST(((ym % 100 - 1) // 3 + 1) AS VARCHAR) AS qtr, CAST(sum(added) AS BIGINT) AS lines FROM c GROUP BY ALL)"


def _files(spark, sf):
    return A.file_quarters(changes(spark, sf).withColumn("path", F.col("file").cast("string")))


@query(_FILES + " SELECT * FROM f")
def quarter_rollup(spark, sf):
    return R.repo_quarters(_files(spark, sf))


@query(f"WITH {_CHANGES} SELECT repo, CAST(ym // 100 AS VARCHAR) || 'H' || CAST(((ym % 100 - 1) // 6 + 1) AS VARCHAR) AS half, CAST(sum(added) AS BIGINT) AS lines FROM c GROUP BY ALL")
def half_rollup(spark, sf):
    return changes(spark, sf).groupBy("repo", S.half("ym").alias("half")).agg(F.sum("added").alias("lines"))


@query(
    _FILES
    + """, d AS (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-12-31', INTERVAL 3 MONTH)) AS d),
    q AS (SELECT repo, CAST(year(d) AS VARCHAR) || 'Q' || CAST(quarter(d) AS VARCHAR) AS qtr FROM d, (SELECT DISTINCT repo FROM f))
    SELECT q.repo, q.qtr, coalesce(f.lines, 0) AS lines FROM q LEFT JOIN f USING (repo, qtr)"""
)
def quarter_gapfill(spark, sf):
    return R.gap_filled(R.repo_quarters(_files(spark, sf)), ["repo"], "1994-01-01", "2002-12-31", ["lines"]).select("repo", "qtr", "lines")


@query(f"WITH {_CHANGES} SELECT ext AS lang, CAST(ym // 100 AS VARCHAR) || 'Q' || CAST(((ym % 100 - 1) // 3 + 1) AS VARCHAR) AS qtr, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM c GROUP BY ALL")
def language_quarters(spark, sf):
    return R.language_quarters(A.monthly(changes(spark, sf)))


@query(f"WITH {_CHANGES}, b AS (SELECT repo, commit_id, CAST(sum(added) AS BIGINT) AS lines FROM c GROUP BY ALL HAVING sum(added) > 100) SELECT repo, commit_id, lines, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, commit_id) AS r FROM b) WHERE r <= 10")
def top_commits(spark, sf):
    return R.top_commits(A.big_commits(changes(spark, sf)))


@query(f"WITH {_CHANGES} SELECT count(DISTINCT author) AS users, count(DISTINCT ym) AS months, count(DISTINCT ext) AS languages, CAST(sum(added) AS BIGINT) AS lines, count(DISTINCT repo) AS repos, (SELECT count(DISTINCT o_orderpriority) FROM c WHERE l_linestatus = 'O') AS skills FROM c")
def merge_summary(spark, sf):
    return R.merge_summary(A.monthly(changes(spark, sf)), K.skill_totals(_scores(spark, sf)))


@query(f"WITH {_CHANGES} SELECT o_orderpriority AS skill, CAST(sum(added) AS BIGINT) AS lines FROM c WHERE l_linestatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY ALL")
def relevant_totals(spark, sf):
    return R.relevant_totals(K.skill_totals(_scores(spark, sf)), spark.createDataFrame([("5-LOW",)], "skill string"))


@query(
    """
    WITH u AS (SELECT lower(replace(c_name, '#', '')) || '@' || lower(n_name) AS u, lower(n_name) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey),
    g AS (SELECT d, string_agg(u, ',' ORDER BY u) AS us, count(*) AS n FROM u GROUP BY d),
    l AS (SELECT string_agg(CASE WHEN n = 1 THEN us ELSE '(' || us || ')@' || d END, ',' ORDER BY d) AS label FROM g)
    SELECT CASE WHEN length(label) > 255 THEN left(label, 252) || '...' ELSE label END AS label FROM l"""
)
def user_group_label(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.user_label(c.select(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@"), F.lower("n_name")).alias("author")))


# -- scalars ----------------------------------------------------------------------------------------------
@query(
    """
    WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages), n AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS f FROM p),
    e AS (SELECT page_id, regexp_replace(regexp_extract(f, '^\\.*[^.].*(\\.[^.]*)$', 1), '[^a-zA-Z0-9]', '', 'g') AS e FROM n)
    SELECT page_id, CASE WHEN e = '' THEN 'unknown' ELSE e END AS ext, list_contains({supported}, e) AS supported FROM e""".replace("{supported}", str(list(S.LANGUAGES)))
)
def file_ext(spark, sf):
    p = table(spark, sf, "pages").select("page_id", S.file_extension(F.regexp_replace("url", "[?#].*$", "")).alias("ext"))
    return p.withColumn("supported", S.is_supported("ext"))


@query("SELECT doc_id, CAST(('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 15)) AS BIGINT) AS h, CAST(('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 15)) AS BIGINT) % 2 AS half, CAST(('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 15)) AS BIGINT) % 100 < 20 AS in_test FROM documents")
def hash_split(spark, sf):
    k = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select("doc_id", S.stable_hash(k).alias("h"), S.split_half(k).alias("half"), S.in_test_split(k).alias("in_test"))


@query("SELECT c_custkey, sha256(c_name || '@x.org') AS user_key, translate(c_name || '@x.org', '@.', '__') AS safe, sha256(sha256(CAST(c_custkey AS VARCHAR)) || sha256(c_name || '@x.org')) AS signed FROM customer")
def repo_keys(spark, sf):
    mail = F.concat("c_name", F.lit("@x.org"))
    return table(spark, sf, "customer").select("c_custkey", S.sha256(mail).alias("user_key"), S.safe_email(mail).alias("safe"), S.sha256(F.concat(S.sha256(F.col("c_custkey").cast("string")), S.sha256(mail))).alias("signed"))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, least(a.c_name, b.c_name) || ':' || greatest(a.c_name, b.c_name) AS pair FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey % 97 + 1")
def pair_key(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), F.col("c_name").alias("x"), (F.col("c_custkey") % 97 + 1).alias("b"))
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("b"), F.col("c_name").alias("y"))
    return c.join(d, "b").select("a", "b", S.pair_key("x", "y").alias("pair"))


@query("SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'Python' WHEN 1 THEN 'C/C++' ELSE n_name END AS language, CASE WHEN n_nationkey % 2 = 0 THEN 'shown ' || n_name ELSE list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ') END AS display_name FROM nation")
def display_names(spark, sf):
    n = table(spark, sf, "nation").withColumn("skill", F.col("n_name"))
    ext = F.when(F.col("n_nationkey") == 0, "py").when(F.col("n_nationkey") == 1, "h").otherwise(F.col("n_name"))
    vocabulary = n.filter("n_nationkey % 2 = 0").select("skill", F.concat(F.lit("shown "), "n_name").alias("display_name"))
    return R.skill_names(n.withColumn("language", S.language_name(ext)), vocabulary).select("n_nationkey", "language", "display_name")


@query(
    """
    SELECT p_partkey, CASE WHEN length(p_name) > 7 THEN left(p_name, 7) || '...' ELSE p_name END AS short, 'life_of_py_' || CAST(least(p_size // 20, 4) * 20 AS VARCHAR) AS bucket,
           split_part(p_type || '::x', '::', 1) AS kind, CASE p_partkey % 4 WHEN 0 THEN 'a,c' WHEN 1 THEN 'b' WHEN 2 THEN 'a,b,c' ELSE '' END AS flagged FROM part"""
)
def small_scalars(spark, sf):
    scores = F.array(*(F.array(*map(F.lit, x)) for x in ((0.7, 0.0, 2.0), (-1.0, 1e-9, -0.5), (1.0, 1.0, 1.0), (0.0, -2.0, 0.0))))
    flags = F.element_at(scores, (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", S.truncated("p_name", 10).alias("short"), S.quality_bucket("p_size").alias("bucket"), S.model_type(F.concat("p_type", F.lit("::x"))).alias("kind"), S.flagged_names(flags, F.array(*map(F.lit, "abc"))).alias("flagged"))


# -- order, lists and curation ----------------------------------------------------------------------------
@query("SELECT epoch_ms(o_orderdate) // 1000 AS ts, o_orderkey AS commit_id FROM orders ORDER BY 1, 2")
def commits_by_time(spark, sf):
    return A.by_time(commits(spark, sf).select(F.unix_timestamp(F.col("at").cast("timestamp")).alias("ts"), "commit_id"))


@query(_FILES + " SELECT qtr, repo, lines FROM f ORDER BY qtr DESC, repo")
def quarters_descending(spark, sf):
    return R.quarters_descending(R.repo_quarters(_files(spark, sf)), "repo").select("qtr", "repo", "lines")


def _snippets(spark, sf):
    """Line items of 30 or more lines as snippets of their commits."""
    c = changes(spark, sf).filter("added >= 30")
    return c.select("repo", "author", "ext", "ym", F.unix_timestamp(F.col("at").cast("timestamp")).alias("ts"), "commit_id", F.col("file").cast("string").alias("path"), F.col("deleted").alias("run_id"), F.concat(F.lit("s"), F.col("part").cast("string")).alias("snippet"), F.col("added").alias("n_lines"))


_SNIPPETS = """
    WITH s AS (SELECT o_orderstatus AS repo, o_custkey AS author, l_returnflag AS ext, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym, epoch_ms(o_orderdate) // 1000 AS ts,
        o_orderkey AS commit_id, CAST(l_suppkey AS VARCHAR) AS path, CAST(l_linenumber AS BIGINT) AS run_id, 's' || CAST(l_partkey AS VARCHAR) AS snippet, CAST(l_quantity AS BIGINT) AS n_lines
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 30)"""


@query(_SNIPPETS + " SELECT repo, CAST(sum(n_lines) AS BIGINT) AS snippet_lines FROM s GROUP BY repo")
def snippet_lines(spark, sf):
    return SN.snippet_lines(_snippets(spark, sf))


@query(_SNIPPETS + " SELECT repo, author, ext, ym, string_agg(snippet, ',' ORDER BY ts, commit_id, path, run_id, snippet) AS snippets FROM s GROUP BY ALL")
def snippet_lists(spark, sf):
    got = SN.snippet_lists(_snippets(spark, sf))
    return got.withColumn("snippets", F.array_join(F.transform("snippets", lambda x: x["snippet"]), ","))


@query(_SNIPPETS + " SELECT repo, author, ext, CASE WHEN n_lines >= 40 THEN 'added' ELSE 'deleted' END AS kind, ym, string_agg(snippet, ',' ORDER BY ts, commit_id, snippet) AS libs FROM s GROUP BY ALL")
def library_lists(spark, sf):
    rows = _snippets(spark, sf).withColumns({"kind": F.when(F.col("n_lines") >= 40, "added").otherwise("deleted"), "libs": F.col("snippet")})
    return SN.library_lists(rows).withColumn("libs", F.array_join("libs", ","))


@query(_SCORES + " SELECT repo, author, lang, model, skill, string_agg(CAST(ym AS VARCHAR), ',' ORDER BY ym) AS months FROM (SELECT DISTINCT repo, author, lang, model, skill, ym FROM st) GROUP BY ALL")
def months_as_arrays(spark, sf):
    return K.months_as_arrays(K.skill_months(_scores(spark, sf))).select("repo", "author", "lang", "model", "skill", F.array_join(F.transform("months", lambda x: x.cast("string")), ",").alias("months"))


@query(_CHOICE_TOTALS + ", r AS (SELECT skill, lines FROM t WHERE skill NOT LIKE '%-R') SELECT skill, lines FROM r ORDER BY lines DESC, skill LIMIT 20")
def top_skills(spark, sf):
    totals = _choice_totals(spark, sf)
    return R.top_skills(R.relevant_totals(totals, totals.filter("skill like '%-R'")))


@query(_CHOICE_TOTALS + ", ch AS (SELECT skill, CASE WHEN lines > 0.4 * mean THEN 'Relevant' ELSE 'Not Relevant' END AS choice FROM t, m WHERE lines >= 0.2 * mean) SELECT skill FROM ch WHERE choice = 'Not Relevant' UNION SELECT skill FROM t, m WHERE NOT lines >= 0.2 * mean")
def either_skill(spark, sf):
    totals = _choice_totals(spark, sf)
    return K.either(K.default_choices(totals).filter("choice = 'Not Relevant'"), K.weak_skills(totals))


@query(_CHOICE_TOTALS + " SELECT skill FROM t EXCEPT SELECT skill FROM t, m WHERE lines >= 0.2 * mean")
def missing_skill(spark, sf):
    totals = _choice_totals(spark, sf)
    return K.missing(totals, K.default_choices(totals))


@query(_CHOICE_TOTALS + ", s AS (SELECT DISTINCT skill, 'Top Secret' AS choice FROM t WHERE skill LIKE '%-A' UNION ALL SELECT 'gone', 'Relevant') SELECT s.skill, CASE WHEN t.lines >= 0.2 * mean THEN t.lines END AS lines, s.choice FROM s LEFT JOIN t USING (skill), m")
def saved_choices(spark, sf):
    totals = _choice_totals(spark, sf)
    saved = totals.filter("skill like '%-A'").select("skill").distinct().withColumn("choice", F.lit("Top Secret")).union(spark.createDataFrame([("gone", "Relevant")], "skill string, choice string"))
    return K.default_choices(totals, saved=saved)


@query(
    _FLAGS.replace("SELECT '5-LOW' AS skill", "SELECT '5-LOW' AS skill UNION ALL SELECT '1-URGENT'").replace("max_score <= 0.05", "max_score <= 0")
    + """, x AS (SELECT repo, author, skill, sum(CASE WHEN weak THEN code_lines ELSE 0 END) AS less, bool_or(NOT gone AND kind = 'c2s') AS good, bool_or(manual) AS cur FROM g GROUP BY ALL)
    SELECT 'total' AS what, tot.author, tot.skill, CAST(greatest(0, code_lines - coalesce(less, 0)) AS BIGINT) AS lines FROM tot LEFT JOIN x USING (repo, author, skill) WHERE good IS NULL OR (good AND NOT cur)
    UNION ALL SELECT 'hidden', NULL, '2-HIGH', NULL"""
)
def apply_choices(spark, sf):
    s = _scores(spark, sf)
    choices = spark.createDataFrame([("5-LOW", "Top Secret"), ("2-HIGH", "Not Relevant"), ("3-MEDIUM", "Relevant")], "skill string, choice string")
    weak = spark.createDataFrame([("1-URGENT",)], "skill string")
    _, totals, hidden = K.apply_choices(K.skill_months(s), K.skill_totals(s), choices, weak)
    out = totals.select(F.lit("total").alias("what"), "author", "skill", F.col("code_lines").alias("lines"))
    return out.unionByName(hidden.select(F.lit("hidden").alias("what"), F.lit(None).cast("bigint").alias("author"), "skill", F.lit(None).cast("bigint").alias("lines")))


@query(
    f"""WITH {_CHANGES}, o AS (SELECT *, CAST(ym // 100 AS VARCHAR) || 'Q' || CAST(((ym % 100 - 1) // 3 + 1) AS VARCHAR) AS qtr FROM c WHERE author % 10 = 1)
    SELECT repo, 'file' AS kind, qtr, CAST(file AS VARCHAR) AS name, CAST(sum(added) AS BIGINT) AS lines FROM o GROUP BY repo, qtr, file
    UNION ALL SELECT repo, 'big_commit', NULL, CAST(commit_id AS VARCHAR), CAST(sum(added) AS BIGINT) FROM o GROUP BY repo, commit_id HAVING sum(added) > 100"""
)
def report_facts(spark, sf):
    """The report of one person: customers whose numbers end alike stand for one."""
    rows = changes(spark, sf).withColumns({"path": F.col("file").cast("string"), "author": F.concat((F.col("author") % 10).cast("string"), F.lit("@x"))})
    return R.report_facts(rows, " 1@X")


# -- diffs and text ---------------------------------------------------------------------------------------
@query("""
    WITH f AS (SELECT p_partkey, unnest([1, 2]) AS file_no FROM part)
    SELECT p_partkey, CAST(file_no AS INTEGER) AS file_no, CASE file_no WHEN 1 THEN 'a b/' || p_partkey || '.py' ELSE 'new' || p_partkey || '.go' END AS path,
           CASE file_no WHEN 1 THEN '@@ -1 +1 @@' || chr(10) || '+diff --git a/x b/x ' || p_partkey || chr(10) ELSE '@@ -0,0 +1 @@' || chr(10) || '+' || p_partkey || chr(10) END AS body
    FROM f""")
def file_diffs(spark, sf):
    k = F.col("p_partkey").cast("string")
    show = F.concat(
        F.lit("\ndiff --git S1/a b/"), k, F.lit(".py D2/a b/"), k, F.lit(".py\nindex 1..2 100644\n--- S1/a b/x\n+++ D2/a b/x\n@@ -1 +1 @@\n+diff --git a/x b/x "), k, F.lit("\n"),
        F.lit("diff --git S1/old.go D2/new"), k, F.lit(".go\nold mode 1\nnew mode 2\nindex 1..2\n--- S1/n\n+++ D2/n\n@@ -0,0 +1 @@\n+"), k, F.lit("\n"),
    )
    return SN.file_diffs(table(spark, sf, "part").select("p_partkey", show.alias("show")), "S1", "D2").select("p_partkey", "file_no", "path", "body")


@query("""
    WITH d AS (SELECT p_partkey, p_size, repeat(replace(p_name, ' ', ''), p_partkey % 7) AS a, replace(p_type, ' ', '') AS b, 9990 + p_partkey % 21 AS n FROM part)
    SELECT p_partkey, CASE WHEN n > 10000 THEN '2big' WHEN p_size < 20 THEN 'small' WHEN levenshtein(a, b) < 50 THEN 'reformat' ELSE 'analysed' END AS verdict FROM d""")
def verdicts(spark, sf):
    k = F.col("p_partkey")
    body = F.concat(F.lit("@@ -1 +1 @@\n+"), F.call_function("repeat", F.col("p_name"), (k % 7).cast("int")), F.lit("\n same\n- "), F.col("p_type"))
    segment = F.call_function("repeat", F.lit("x"), (9990 + k % 21).cast("int"))
    return table(spark, sf, "part").select("p_partkey", SN.verdict(F.col("p_size"), segment, body).alias("verdict"))


@query("""
    WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, ls, 1 AS i, '' AS held, CAST(NULL AS VARCHAR) AS given FROM d WHERE length(text) > 1500
          UNION ALL
          SELECT doc_id, ls, i + 1,
                 CASE WHEN i > len(ls) THEN '' WHEN length(ls[i]) > 1500 THEN held WHEN length(held) + length(ls[i]) > 1500 THEN ls[i] || chr(10) ELSE held || ls[i] || chr(10) END,
                 CASE WHEN length(held) > 100 AND (i > len(ls) OR (length(ls[i]) <= 1500 AND length(held) + length(ls[i]) > 1500)) THEN held END
          FROM g WHERE i <= len(ls) + 1),
    c AS (SELECT doc_id, i, regexp_replace(given, '^\\s+|\\s+$', '', 'g') AS chunk FROM g WHERE given IS NOT NULL UNION ALL SELECT doc_id, 0, text FROM d WHERE length(text) <= 1500)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, chunk FROM c""")
def chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(TX.chunks_of("text", F.lit("\n"))).alias("chunk_no", "chunk"))


_MASKED = """
    WITH RECURSIVE n AS (SELECT c_custkey, c_name, length(c_name) AS n, sha256(c_name) AS h FROM customer),
    m AS (SELECT c_custkey, c_name, n, h, 0 AS i, range(3, n - 1) AS hidden FROM n
          UNION ALL
          SELECT c_custkey, c_name, n, h, i + 1, list_concat(hidden[:k], hidden[k + 2:])
          FROM (SELECT *, CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) % len(hidden) AS k FROM m) WHERE i < greatest(0, CAST(ceil(n * 0.5) AS INTEGER) - 4)),
    x AS (SELECT c_custkey, c_name, list_transform(range(1, n + 1), lambda j: CASE WHEN list_contains(hidden, j) THEN '*' ELSE c_name[j] END) AS l FROM m WHERE i = greatest(0, CAST(ceil(n * 0.5) AS INTEGER) - 4)),
    masked AS (SELECT c_custkey, c_name, array_to_string(l, '') AS masked FROM x)"""


@query(_MASKED + " SELECT c_custkey, masked FROM masked")
def anonymized_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", TX.mask_of("c_name").alias("masked"))


@query(
    _MASKED
    + """
    SELECT c_custkey, masked AS repo, sha256(CASE WHEN c_custkey % 3 = 0 THEN 'git@h:' || c_name || '.git' ELSE c_name END) AS repo_path,
           CASE WHEN c_custkey % 3 = 0 THEN 'git@h:' || c_name || '.git' ELSE '/src/' || c_name END AS kept_path FROM masked"""
)
def anonymous_repositories(spark, sf):
    """Repositories of which every third has a remote that holds its name, and every third one that doesn't."""
    k = F.col("c_custkey") % 3
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("repo"), F.concat(F.lit("/src/"), "c_name").alias("repo_path"), F.when(k == 0, F.concat(F.lit("git@h:"), "c_name", F.lit(".git"))).when(k == 1, "git@h:other.git").alias("remote"))
    kept = R.anonymous(c, True).select("c_custkey", F.col("repo_path").alias("kept_path"))
    return R.anonymous(c, False).join(kept, "c_custkey").select("c_custkey", "repo", "repo_path", "kept_path")


@query("""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    t AS (SELECT doc_id, array_to_string(list_prepend(regexp_replace(ls[1], '\\s+$', ''), list_transform(ls[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), chr(10)) AS t FROM d),
    u AS (SELECT doc_id, t, unnest(string_split(replace(replace(t, chr(9), ' '), chr(13), ' '), chr(10))) AS x FROM t)
    SELECT doc_id, CAST(count(*) FILTER (NOT regexp_matches(t, 'license|License|LICENSE') AND length(t) - length(replace(t, ' ', '')) >= 5 * (length(t) - length(replace(t, chr(10), '')))
           AND NOT (starts_with(x, 'http') OR starts_with(x, 'www') OR contains(x, 'author ') OR contains(x, 'param '))) AS INTEGER) AS n
    FROM u GROUP BY doc_id""")
def documentation_of_texts(spark, sf):
    return texts(spark, sf).select("doc_id", TX.documentation_lines_udf(F.concat(F.lit('"""'), F.coalesce("text", F.lit("")), F.lit('\n"""\nx = 1')), F.lit("py")).alias("n"))


_LONG = ("a line of prose that goes on for a while and then some more " * 3).strip()
#: Code, its language, and the documentation comments it has, joined by a bar.
_DOCUMENTED = [
    (1, "java", "/**\n * One @.\n * Two.\n */\nint x;", "One @.\n Two."),
    (2, "js", "/* begin\n  more @\n*/\nf()", "begin\nmore @"),
    (3, "c", "/* one line @ */\nint x;", ""),
    (4, "go", f"// {_LONG}\n// {_LONG}\nx := 1", f"{_LONG}\n {_LONG}"),
    (5, "go", "// short\nx := 1", ""),
    (6, "cs", f"/*\n{_LONG}\n{_LONG}", f"{_LONG}\n{_LONG}"),
    (7, "rs", "/* never closed", ""),
    (8, "rb", "=begin\nSays a lot of @.\n=end\ndef x\nend", "Says a lot of @."),
    (9, "rb", "# no block\ndef x\nend", ""),
    (10, "lua", "--[[ first\nsecond @ ]]\nlocal x", "first\nsecond @"),
    (11, "lua", f"-- {_LONG}\n-- {_LONG}\nlocal x", f"{_LONG}\n {_LONG}"),
    (12, "ex", '~moduledoc """\nWhat @ does.\nAnd how.\n"""\ndef f, do: 1', "What @ does.\nAnd how."),
    (13, "exs", "~doc false\ndef @, do: 1", ""),
    (14, "py", 'def f():\n    """Says @.\n\n    More.\n    """\n    return 1', "Says @.\n\nMore."),
    (15, "py", '"""One line."""\nx = 1', ""),
    (16, "py", "'''\nold @ marks\n'''", "\nold @ marks"),
    (17, "py", 'a = 1\nthe end of a text"""', "\nthe end of a text"),
    (18, "unknown", "/* a\n@ */", ""),
]


_BRAND = "replace(p_brand, '#', '')"


def _case(cases: list[tuple], i: int) -> str:
    """In SQL: a part's case by its key, with its brand in the place of each @, and of ~ the @ of a language."""
    quoted = ", ".join("'" + c[i].replace("'", "''") + "'" for c in cases)
    return f"replace(replace(list_extract([{quoted}], CAST(p_partkey % {len(cases)} + 1 AS INTEGER)), '@', {_BRAND}), '~', '@')"


def _of_part(cases: list[tuple], i: int):
    """The same as a column of ``part``."""
    text = F.element_at(F.array(*[F.lit(c[i]) for c in cases]), (F.col("p_partkey") % len(cases) + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("@"), F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("~"), F.lit("@"))


@query(f"SELECT p_partkey, {_case(_DOCUMENTED, 3)} AS docs FROM part")
def documentation_comments(spark, sf):
    """Every part has a piece of code, by its key, that names its brand."""
    p = table(spark, sf, "part").select("p_partkey", _of_part(_DOCUMENTED, 2).alias("code"), _of_part(_DOCUMENTED, 1).alias("ext"))
    return p.select("p_partkey", F.array_join(TX.documentation_of("code", "ext"), "|").alias("docs"))


#: Code, its language, and the libraries it imports.
_IMPORTING = [
    (1, "java", "import java.util.List;\nimport static x.Y;\nimport a.@.*;\n// import no.no;", "java.util.List,a.@.*"),
    (2, "js", "import React from '@';\nimport x from \"y\";\nconst z = 1", "@"),
    (3, "tsx", "import a from 'b-c'; import d from '@';", "b-c,@"),
    (4, "c", '#include <stdio.h>\n#include "own/@.h"', "stdio.h,own/@.h"),
    (5, "h", "  #include <@.h>", "@.h"),
    (6, "cs", "using System.@;\nusing (var x = 1) {}", "System.@"),
    (7, "php", "require_once 'a.php';\ninclude(\"b.php\");\ninclude \"@.php\";", "a.php,@.php"),
    (8, "rb", "require '@'\nrequire_relative 'x'", "@"),
    (9, "lua", "local x = require \"@\"\nrequire('no')", "@"),
    (10, "rs", "use std::@;\nuse a::{b, c};", "std::@"),
    (11, "swift", "import @\n  import No", "@"),
    (12, "dart", "import dart.@;\nimport 'package:x/x.dart';", "dart.@"),
    (13, "ex", "import a from '@';\nalias X.Y", "@"),
    (14, "py", "import os, sys as system\nfrom a.b import @\nx = 1", "a.b.@,os,sys"),
    (15, "go", 'import (\n"fmt"\n"net/@"\n)', "fmt,net/@"),
    (16, "scala", "import scala.@.Source", "scala.@.Source"),
    (17, "kt", "import kotlin.@.max\nval x = 1", "kotlin.@.max"),
    (18, "md", "import x", ""),
]


@query(f"SELECT p_partkey, {_case(_IMPORTING, 3)} AS libs FROM part")
def import_statements(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", _of_part(_IMPORTING, 2).alias("code"), _of_part(_IMPORTING, 1).alias("ext"))
    return p.select("p_partkey", F.array_join(TX.imports_of(F.col("code"), F.col("ext"), compat=True), ",").alias("libs"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'os,pkg.a,pkg.b' WHEN 1 THEN 'fmt,' || p_brand ELSE 'x.' || replace(p_brand, '#', '') END AS libs FROM part")
def imports_of_code(spark, sf):
    k, p = F.col("p_partkey") % 3, table(spark, sf, "part")
    code = (
        F.when(k == 0, F.lit("from pkg import (\n  a,\n  b\n)\nimport os"))
        .when(k == 1, F.concat(F.lit('import (\n"fmt"\n"'), "p_brand", F.lit('"\n)')))
        .otherwise(F.concat(F.lit("package y;\nimport x."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(";")))
    )
    ext = F.when(k == 0, "py").when(k == 1, "go").otherwise("java")
    return p.select("p_partkey", F.array_join(TX.imports_of(code, ext), ",").alias("libs"))


_FILES_OF_EXPERTS = [("a/@.py", "python"), ("@.tsx", "javascript"), ("@.JS", "others"), ("b.@.cs", "java_or_csharp"), ("@/c.go", "go"), ("@.rs", "others"), ("@", "others"), (".py", "others")]


@query(f"SELECT p_partkey, {_case(_FILES_OF_EXPERTS, 0)} AS path, {_case(_FILES_OF_EXPERTS, 1)} AS expert FROM part")
def experts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", _of_part(_FILES_OF_EXPERTS, 0).alias("path")).withColumn("expert", S.expert("path"))


#: What zeros become under a key of zeros, a published vector of the cipher.
_ZEROS = "66E94BD4EF8A2C3B884CFA59CA342B2EF795BD4A52E29ED713D313FA20E98DBC"


@query(f"""
    SELECT c_custkey, left('{_ZEROS}', CAST(2 * (c_custkey % 33) AS INTEGER)) AS zeros,
           hex(CAST(xor(CAST(encode(left(c_name, 16)) AS BIT), CAST(unhex('{_ZEROS[:32]}') AS BIT)) AS BLOB)) AS first, c_name AS plain, true AS other FROM customer""")
def cipher_feedback(spark, sf):
    """Of every customer as many zeros as its key says and its name, under a key of zeros; and its name there and back under a key of its own, of one of the three sizes."""
    key = "00" * 16
    c = spread(table(spark, sf, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("name")))
    own = F.substring(F.sha2("name", 256), F.lit(1), F.element_at(F.array(F.lit(32), F.lit(48), F.lit(64)), (F.col("c_custkey") % 3 + 1).cast("int")))
    zeros = F.unhex(F.call_function("repeat", F.lit("00"), (F.col("c_custkey") % 33).cast("int")))
    c = c.withColumns({"zeros": CR.encrypt(zeros, key), "first": CR.encrypt(F.col("name"), key), "own": own})
    c = c.withColumn("made", CR.encrypt(F.col("name"), F.col("own")))
    return c.select("c_custkey", F.hex("zeros").alias("zeros"), F.left(F.hex("first"), F.lit(32)).alias("first"), CR.decrypt(F.col("made"), F.col("own")).cast("string").alias("plain"), (F.col("made") != F.col("name")).alias("other"))


@query("SELECT lower(trim(c_name)) AS author, CAST(c_custkey AS BIGINT) AS ts FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0")
def blank_emails(spark, sf):
    """Lines of a log of which some have no e-mail, or nothing but white space there."""
    c = table(spark, sf, "customer")
    who = F.when(F.col("c_custkey") % 4 == 0, " \t ").when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    return A.parse_commits(c.select(F.concat_ws("\x01", who, F.col("c_custkey").cast("string"), F.lit("f00")).alias("line"))).select("author", "ts")


@query("SELECT c_mktsegment, count(*) AS n, true AS hex FROM customer GROUP BY c_mktsegment")
def salted_hashes(spark, sf):
    """A value that many rows have is another hash in each."""
    c = table(spark, sf, "customer").select("c_mktsegment", TX.salted_hash("c_mktsegment").alias("h"))
    return c.groupBy("c_mktsegment").agg(F.count_distinct("h").alias("n"), F.min(F.col("h").rlike("^[0-9a-f]{64}$") & (F.col("h") != F.sha2("c_mktsegment", 256))).alias("hex"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%b') || chr(10) || strftime(o_orderdate, '%Y') AS VARCHAR) AS short, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days FROM orders")
def dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.short_date(S.month_of("o_orderdate")).alias("short"), S.days_in_month(F.date_format("o_orderdate", "yyyy-MM")).alias("days"))


_PREFIXES = """
    WITH p AS (SELECT 'r' AS repo, 'q' AS qtr, CAST(length(html) AS BIGINT) AS lines, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '' AND x <> '.')[: 1 + page_id % 4] AS a FROM pages),
    l AS (SELECT repo, qtr, lines, 1 AS depth, a[1] AS p FROM p WHERE len(a) >= 1 UNION ALL SELECT repo, qtr, lines, 2, a[1] || '/' || a[2] FROM p WHERE len(a) >= 2),
    t AS (SELECT repo, qtr, depth, CASE WHEN length(p) > 27 THEN left(p, 27) || '...' ELSE p END AS prefix, CAST(sum(lines) AS BIGINT) AS lines FROM l GROUP BY ALL)"""


def _page_files(spark, sf):
    """Paths of pages, of one to four names each."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/"), lambda x: (x != "") & (x != "."))
    path = F.array_join(F.slice(parts, F.lit(1), (1 + F.col("page_id") % 4).cast("int")), "/")
    return table(spark, sf, "pages").select(F.lit("r").alias("repo"), F.lit("q").alias("qtr"), F.length("html").cast("bigint").alias("lines"), path.alias("path"))


@query(_PREFIXES + """,
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo, qtr, depth ORDER BY lines DESC, prefix) AS INTEGER) AS rank FROM t)
    SELECT depth, prefix, lines, rank FROM r WHERE rank <= 3 AND lines > 50""")
def path_prefix_topk(spark, sf):
    return R.top_prefixes(R.path_prefixes(_page_files(spark, sf))).select("depth", "prefix", "lines", "rank")


@query(_PREFIXES + " SELECT depth, prefix, lines FROM t")
def path_prefixes(spark, sf):
    """All prefixes of the pages' paths."""
    return R.path_prefixes(_page_files(spark, sf)).select("depth", "prefix", "lines")


@query("""
    SELECT p_partkey, list_aggregate(list_transform(list_filter([{'s': CAST(p_size % 7 - 2 AS DOUBLE), 'n': 'a'}, {'s': CAST(p_size % 5 - 1 AS DOUBLE), 'n': 'b'}, {'s': CAST(p_size % 3 AS DOUBLE), 'n': 'c'}, {'s': CAST(1 AS DOUBLE), 'n': 'd'}], lambda x: x.s > 0), lambda x: x.n), 'count') AS n,
           (SELECT string_agg(n, ',' ORDER BY s DESC, n) FROM (SELECT * FROM (SELECT unnest([p_size % 7 - 2, p_size % 5 - 1, p_size % 3, 1]) AS s, unnest(['a', 'b', 'c', 'd']) AS n) WHERE s > 0 ORDER BY s DESC, n LIMIT 2)) AS best
    FROM part""")
def top_labels(spark, sf):
    size = F.col("p_size")
    scores = F.array(*(x.cast("double") for x in (size % 7 - 2, size % 5 - 1, size % 3, F.lit(1))))
    names = F.array(*map(F.lit, "abcd"))
    best = lambda k: F.transform(S.top_labels(scores, names, k), lambda x: x["name"])
    return table(spark, sf, "part").select("p_partkey", F.size(best(10)).cast("bigint").alias("n"), F.array_join(best(2), ",").alias("best"))


@query(_CHOICE_TOTALS + """, ch AS (SELECT skill, lines, CASE WHEN lines > 0.4 * mean THEN 'Relevant' ELSE 'Not Relevant' END AS choice, row_number() OVER (ORDER BY lines DESC, skill) AS no FROM t, m WHERE lines >= 0.2 * mean)
    SELECT skill, lines, CASE no WHEN 1 THEN 'Top Secret' WHEN 3 THEN 'Not Relevant' ELSE choice END AS choice FROM ch""")
def update_choices(spark, sf):
    return K.update_choices(K.default_choices(_choice_totals(spark, sf)), {1: "Top Secret", 3: "Not Relevant"})


@query("SELECT c_custkey, c_name AS repo, 'x/' || c_name AS repo_path FROM customer")
def public_columns(spark, sf):
    """Without snippets and libraries; the repository's name is the last part of its path."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("x/"), "c_name").alias("repo_path"), F.lit("code").alias("sig_code_snippets"), F.array(F.lit("os")).alias("libs"))
    return R.public_only(c).select("c_custkey", S.repo_name("repo_path").alias("repo"), "repo_path")


@query("SELECT o_orderkey AS commit_id, o_custkey AS author FROM orders WHERE 'u' || o_custkey IN (SELECT 'u' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def requested_authors(spark, sf):
    """Only the authors of a table that writes them in other cases."""
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("mail"))
    rows = commits(spark, sf).select("commit_id", F.col("author").alias("k"), F.concat(F.lit("u"), F.col("author").cast("string")).alias("author"))
    return A.by_authors(rows, wanted).select("commit_id", F.col("k").alias("author"))
