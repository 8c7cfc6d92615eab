"""Operators against small cases and a sequential re-statement of their rules."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quern.config import Config, from_ini
from quern.operators import activity as A
from quern.operators import report as R
from quern.operators import scoring as SC
from quern.operators import skills as K
from quern.operators import snippets as SN
from quern.plans import profile as P
from quern.sources import files as FS
from quern.sources import git as G


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_gates_at_their_limits(spark):
    c = spark.createDataFrame([("r", 1, 10_000, 0), ("r", 2, 10_001, 0), ("r", 3, 0, 10_001), ("r", 4, 6_000, 1), ("r", 4, 6_000, 1)], "repo string, commit_id int, added int, deleted int")
    assert {r.commit_id for r in A.without_huge_commits(c).collect()} == {1}
    f = spark.createDataFrame([("r", 1, 10), ("r", 2, 11), ("r", 3, 4_999), ("r", 4, 2_500), ("r", 4, 2_500)], "repo string, commit_id int, added int")
    assert {r.commit_id for r in A.significant_files(f).collect()} == {2, 3, 4}
    assert {r.commit_id for r in A.analysed_files(f).collect()} == {2, 3}


def test_numstat_rows_that_count(spark):
    got = A.valid_changes(spark.createDataFrame([("-", "-", "a.bin"), ("0", "0", "b.py"), ("3", "0", "s/{x => y}/c.py"), ("1", "x", "d.py")], "added string, deleted string, path string"))
    assert [(r.added, r.path, r.ext) for r in got.collect()] == [(3, "s/y/c.py", "py")]


def test_allow_list_and_authors(spark):
    c = spark.createDataFrame([("r", "a@x", 0), ("s", "a@x", 0), ("r", "b@x", 40 * 86400)], "repo string, author string, ts long")
    allow = spark.createDataFrame([("r", "a@x")], "repo string, user string")
    assert A.allowed(c, allow).count() == 1 and A.allowed(c, allow.limit(0)).count() == 3 and A.allowed(c, None).count() == 3
    assert A.by_authors(c, ["A@X "]).count() == 2 and A.by_authors(c, None).count() == 3
    assert A.by_authors(c, spark.createDataFrame([("B@x",)], "u string")).count() == 1
    assert [r.author for r in A.author_ranking(c, "commits", "b@x").collect()] == ["b@x", "a@x"]


def test_retraction_keeps_the_month(spark):
    c = spark.createDataFrame([("r", "a", "py", 202401, 1, 30, 2, True), ("r", "a", "py", 202402, 2, 5, 1, False)], "repo string, author string, ext string, ym int, commit_id int, added int, deleted int, reformat boolean")
    assert [(r.ym, r.added, r.deleted) for r in A.monthly(c, F.col("reformat")).orderBy("ym").collect()] == [(202401, 0, 0), (202402, 5, 1)]


def diff(body, path="x.py", src="S", dst="D"):
    return f"diff --git {src}/{path} {dst}/{path}\nindex 1..2 100644\n--- {src}/{path}\n+++ {dst}/{path}\n@@ -1 +1 @@\n{body}\n"


def test_diffs_split_and_runs(spark):
    body = "\n".join([" c"] + ["+a"] * 9 + [" c"] + [f"+{i}" for i in range(10)] + ["-x"] + ["+z"] * 11)
    shows = spark.createDataFrame([("k", diff(body) + diff("+q", "y.py"))], "key string, show string")
    files = SN.file_diffs(shows, "S", "D")
    assert [r.path for r in files.orderBy("file_no").collect()] == ["x.py", "y.py"]
    runs = SN.added_runs(files, ["key", "path"]).orderBy("run_id").collect()
    assert [r.n_lines for r in runs] == [10, 11] and runs[0].snippet == "\n".join(map(str, range(10)))
    assert SN.file_diffs(shows, "S", "D", compat=True).first()["body"].startswith(" c")


def test_runs_equal_a_loop(spark):
    r = random.Random(3)
    texts = [(i, "\n".join(r.choice(["+a", "+b", " c", "-d"]) for _ in range(r.randrange(0, 60)))) for i in range(40)]
    want = []
    for i, t in texts:
        run = []
        for line in [*t.split("\n"), " "]:
            if line.startswith("+"):
                run.append(line[1:])
            else:
                if len(run) >= 3:
                    want.append((i, "\n".join(run), len(run)))
                run = []
    got = SN.added_runs(spark.createDataFrame(texts, "i int, body string"), ["i"], least=3).drop("run_id")
    assert rows(got) == sorted(want)


def test_verdicts(spark):
    v = SN.verdict(F.col("added"), F.col("segment"), F.col("body"))
    big, far = "x" * 10_001, "\n".join(["+" + "a" * 60, "-" + "b" * 60])
    cases = [(50, big, far, "2big"), (1, big, far, "2big"), (19, "s", far, "small"), (20, "x" * 10_000, "+a\n-a b", "reformat"), (20, "s", far, "analysed"), (20, "s", "+" + "a" * 49, "reformat"), (20, "s", "+" + "a" * 50, "analysed")]
    got = spark.createDataFrame([c[:3] for c in cases], "added int, segment string, body string").select(v.alias("v")).collect()
    assert [r.v for r in got] == [c[3] for c in cases]


def test_ranks_and_probabilities(spark):
    import math

    p = spark.createDataFrame([(1, "a", math.log(0.5)), (1, "b", math.log(0.3)), (1, "c", math.log(0.2)), (2, "z", 800.0), (2, "y", 800.0)], "k int, skill string, logit double")
    got = {(r.k, r.skill): (round(r.sm_score, 6), round(r.score, 6), r["rank"]) for r in SC.ranked(p, ["k"]).collect()}
    assert got == {(1, "a"): (0.5, 0.5, 1), (1, "b"): (0.3, 0.6, 2), (1, "c"): (0.2, 1.0, 3), (2, "y"): (0.5, 0.5, 1), (2, "z"): (0.5, 1.0, 2)}


def sequential(stats, totals, least, manual):
    totals, left, seen, good = dict(totals), [], set(), set()
    for key, model, skill, best, lines in stats:
        kind = model.split("::")[0]
        seen.add(skill)
        if best <= least.get(kind, 0):
            if skill in totals:
                totals[skill] = max(0, totals[skill] - lines)
        elif kind != "life_of_py" and (skill not in totals or skill in manual):
            pass
        else:
            left.append((key, model, skill))
            if kind == "c2s":
                good.add(skill)
    return sorted(left), {s: n for s, n in totals.items() if s not in seen or (s in good and s not in manual)}


@pytest.mark.parametrize("seed", range(4))
def test_filter_skills_equals_the_sequential_rules(spark, seed):
    r = random.Random(seed)
    stats = [(i, r.choice(["c2s::m", "i2s::m", "life_of_py::m"]), f"s{r.randrange(8)}", r.choice([0.1, 0.15, 0.1501, 0.4]), r.randrange(1, 50)) for i in range(60)]
    totals = [(f"s{i}", r.randrange(1, 200)) for i in range(0, 12, 2)]
    df = spark.createDataFrame([("r", "a", "py", k, m, s, b, n) for k, m, s, b, n in stats], "repo string, author string, lang string, ym int, model string, skill string, max_score double, code_lines long")
    tot = spark.createDataFrame([("r", "a", s, n) for s, n in totals], "repo string, author string, skill string, code_lines long")
    got, left = K.filter_skills(df, tot, {"c2s": 0.15, "i2s": 0.15, "life_of_py": 0.15}, spark.createDataFrame([("s2",)], "skill string"))
    want = sequential(stats, totals, {"c2s": 0.15, "i2s": 0.15, "life_of_py": 0.15}, {"s2"})
    assert sorted((x.ym, x.model, x.skill) for x in got.collect()) == want[0]
    assert {x.skill: x.code_lines for x in left.collect()} == want[1]


def test_curation(spark):
    tot = spark.createDataFrame([("r", "a", s, n) for s, n in (("x", 100), ("y", 30), ("z", 5), ("w", 65))], "repo string, author string, skill string, code_lines long")
    c = K.default_choices(tot)
    assert rows(c) == [("w", 65, "Relevant"), ("x", 100, "Relevant"), ("y", 30, "Relevant")]
    assert [r.skill for r in K.weak_skills(tot).collect()] == ["z"]
    assert rows(K.update_choices(c, {1: "Top Secret", 3: "Not Relevant"}).select("skill", "choice")) == [("w", "Relevant"), ("x", "Top Secret"), ("y", "Not Relevant")]
    assert K.default_choices(tot.limit(0)).collect() == []


def test_reports(spark):
    act = spark.createDataFrame([("py", 202401, 3, 1), ("py", 202403, 4, 0), ("go", 202404, 5, 5)], "lang string, ym int, added int, deleted int")
    assert rows(R.language_quarters(act)) == [("go", "2024Q2", 5, 5), ("py", "2024Q1", 7, 1)]
    assert rows(R.language_quarters(act, compat=True)) == [("go", "2024Q2", 5, 5), ("py", "2024Q1", 4, 0)]
    users = lambda *u: spark.createDataFrame([(x,) for x in u], "author string")
    assert R.user_label(users("a@x.org")).first()["label"] == "a@x.org"
    assert R.user_label(users("b@x.org", "c@a.org", "a@x.org")).first()["label"] == "c@a.org,(a@x.org,b@x.org)@x.org"
    long = R.user_label(users(*[f"{'u' * 20}{i}@d{i}.org" for i in range(30)])).first()["label"]
    assert len(long) == 255 and long.endswith("...")


def test_config(tmp_path):
    p = tmp_path / "c.ini"
    p.write_text("[any]\nmin_months = 3\nskill_min_score = 0.2\nlop_min_score = 0.3\n")
    c = from_ini(str(p))
    assert c.min_months == 3 and c.min_scores == {"c2s": 0.2, "i2s": 0.2, "life_of_py": 0.3} and Config().min_months == 1


def sh(cwd, *args, date="2024-03-05T12:00:00+0000"):
    import os

    env = os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "GIT_AUTHOR_NAME": "n", "GIT_AUTHOR_EMAIL": "Dev@X.org", "GIT_COMMITTER_NAME": "n", "GIT_COMMITTER_EMAIL": "dev@x.org"}
    subprocess.run(["git", *args], cwd=cwd, env=env, check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    path = root / "one"
    (path / "src").mkdir(parents=True)
    sh(path, "init", "-q", "-b", "main")
    (path / "src" / "a.py").write_text("\n".join(f"value_{i} = compute({i}) + offset[{i}]" for i in range(40)) + "\n")
    (path / "b.bin").write_bytes(bytes(range(256)))
    sh(path, "add", ".")
    sh(path, "commit", "-qm", "first")
    (path / "src" / "a.py").write_text((path / "src" / "a.py").read_text().replace("offset[3]", "offset[33]"))
    (path / "new file.go").write_text("package x\n" + "\n".join(f"func F{i}() int {{ return {i} * {i} }}" for i in range(30)) + "\n")
    sh(path, "add", ".")
    sh(path, "commit", "-qm", "second", date="2024-04-07T12:00:00+0000")
    (root / "list.txt").write_text(f"{path}\n\n")
    return root


def test_git_tables_and_the_whole_run(spark, repo, tmp_path):
    assert G.discover(str(repo)) == [str(repo / "one")]
    repos = G.repositories(spark, str(repo), str(repo / "list.txt"))
    assert rows(repos) == [(str(repo / "one"), "one")]
    f = P.facts(repos)
    assert rows(f.activity) == [("one", "dev@x.org", "go", 202404, 31, 0, 1, 0, 1), ("one", "dev@x.org", "py", 202403, 40, 0, 1, 0, 1), ("one", "dev@x.org", "py", 202404, 1, 1, 1, 0, 0)]
    assert sorted((r.path, r.n_lines) for r in f.snippets.collect()) == [("new file.go", 31), ("src/a.py", 40)]
    vocabulary = ["sql", "web", "math", "io"]
    tags = {"c2s::m": SC.stub_loader(vocabulary), "life_of_py::m": SC.stub_loader(vocabulary)}
    scores = P.scored(f, tags, dict.fromkeys(tags, vocabulary))
    assert scores.filter("model = 'life_of_py::m'").groupBy("path", "chunk_no").count().filter("count > 3").count() == 0
    out = P.profiles(f, scores, 1700000000)
    FS.write_profiles(out, str(tmp_path / "p"))
    back = FS.profiles(spark, str(tmp_path / "p"))
    (r,) = back.collect()
    assert (r.author, [x.lang for x in r.langs], r.langs[1].st, r.langs[1].et) == ("dev@x.org", ["go", "py"], 202403, 202403)
    FS.write_document(FS.merged(back.drop("part"), R.user_label(back), 5, "team"), str(tmp_path / "m"), compress=True)
    doc = json.loads("".join(x.value for x in spark.read.text(str(tmp_path / "m")).collect()))
    assert doc["user"] == "dev@x.org" and doc["team"] == "team" and doc["profiles"][0]["repo"] == "one"


def test_a_run_goes_on_from_its_folder(spark, repo, tmp_path, monkeypatch):
    repos = G.repositories(spark, str(repo))
    first = P.facts(repos, folder=str(tmp_path / "run"))
    want = rows(first.activity), sorted(r.path for r in first.snippets.collect())
    assert {x.name for x in (tmp_path / "run").iterdir()} == {"log", "numstat", "changes", "shows", "diffs"}
    gone = repos.withColumn("repo_path", F.concat("repo_path", F.lit("-moved")))  # git would find nothing any more
    again = P.facts(gone, folder=str(tmp_path / "run"))
    assert (rows(again.activity), sorted(r.path for r in again.snippets.collect())) == want and again.errors.count() == 0


def test_languages_of_few_months_are_not_scored(spark, repo):
    f = P.facts(G.repositories(spark, str(repo)))
    assert rows(P.active_languages(f)) == [("one", "dev@x.org", "go"), ("one", "dev@x.org", "py")]
    two = Config(min_months=2)  # py has two months of activity, go one
    assert rows(P.active_languages(f, two)) == [("one", "dev@x.org", "py")]
    tags = {"c2s::m": SC.stub_loader(["a", "b"]), "i2s::m": SC.stub_loader(["a", "b"])}
    libraries = spark.createDataFrame([("one", "src/a.py", "import os")], "repo string, path string, libs string")
    scores = P.scored(f, tags, dict.fromkeys(tags, ["a", "b"]), config=two, libraries=libraries)
    assert {r.lang for r in scores.select("lang").distinct().collect()} == {"py"}
    libs = {(r.skill, round(r.sm_score, 9)) for r in scores.filter("model = 'i2s::m'").collect()}
    score = SC.stub_loader(["a", "b"])()(["import os"])[0]
    import math

    total = sum(math.exp(x) for x in score)
    assert libs == {(k, round(math.exp(x) / total, 9)) for k, x in zip("ab", score, strict=True)}
    assert P.profiles(f, scores, 1, two).count() == 1 and P.profiles(f, scores, 1, Config(min_months=3)).count() == 0


def test_git_source_and_errors(spark, repo, tmp_path):
    G.register(spark)
    df = spark.read.format("git_log").option("paths", f"{repo / 'one'},{tmp_path}").load()
    assert {(r.repo, r.author) for r in df.filter("error is null").collect()} == {("one", "dev@x.org")} and df.filter("error is null").count() == 2
    (bad_row,) = df.filter("error is not null").collect()
    assert bad_row.repo_path == str(tmp_path) and bad_row.commit_id is None and "not a git repository" in bad_row.error
    bad = spark.createDataFrame([(str(tmp_path), "none")], "repo_path string, repo string")
    assert G.log(bad).filter("error is not null").count() == 1
    f = P.facts(bad.union(G.repositories(spark, str(repo))))
    assert {r.repo for r in f.activity.collect()} == {"one"} and [(r.repo, r.step) for r in f.errors.collect()] == [("none", "log")]
    assert G.with_remotes(bad).first()["remote"] is None


def test_one_commit_that_git_cannot_show_is_the_only_one_missed(spark, repo):
    path = str(repo / "one")
    commits = spark.createDataFrame([(path, "one", c) for c in [*G.git(path, "log", "--format=%H")[0].split(), "0" * 40]], "repo_path string, repo string, commit_id string")
    got = G.numstat(commits).collect()
    assert sorted(r.path for r in got if r.error is None) == ["b.bin", "new file.go", "src/a.py", "src/a.py"]
    (bad,) = [r for r in got if r.error]
    assert bad.commit_id == "0" * 40 and bad.path is None
    assert sorted(r.path for r in G.numstat(commits.filter("commit_id not like '000%'")).collect()) == ["b.bin", "new file.go", "src/a.py", "src/a.py"]
    wanted = commits.withColumn("path", F.lit("src/a.py"))
    shows = G.shows(wanted, "S", "D").collect()
    assert sum(r.error is None for r in shows) == 2 and [r.commit_id for r in shows if r.error] == ["0" * 40]


def test_small_files(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("ci/cd\tCI/CD\nsql\n")
    assert rows(FS.vocabulary(spark, str(tmp_path / "v.tsv"))) == [("ci/cd", "CI/CD"), ("sql", "Sql")]
    (tmp_path / "l.jsonl").write_text('{"repo": "r", "file": "f"}\n{"repo": "r"}\n')
    assert rows(FS.labels(spark, str(tmp_path / "l.jsonl"))) == [("r", "f")]
    (tmp_path / "a.tsv").write_text("r\ta@x\n")
    assert rows(FS.allow_list(spark, str(tmp_path / "a.tsv"))) == [("r", "a@x")]
    (tmp_path / "libs").mkdir()
    (tmp_path / "libs" / "py.txt").write_text("numpy\t4\npandas\t7\n")
    ids, following = FS.library_ids(spark, str(tmp_path / "libs"))
    assert rows(ids) == [("py", "numpy", 4), ("py", "pandas", 7)] and rows(following) == [("py", 8)]
    (tmp_path / "c.json").write_text('{"a": "Relevant", "b": "Top Secret"}')
    assert rows(FS.choices(spark, str(tmp_path / "c.json"))) == [("a", "Relevant"), ("b", "Top Secret")]
    FS.compress_file(str(tmp_path / "v.tsv"), str(tmp_path / "v.tsv.gz"))
    assert [r["value"] for r in FS.lines(spark, str(tmp_path / "v.tsv.gz")).orderBy("no").collect()] == ["ci/cd\tCI/CD", "sql"]
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    assert FS.code_file(spark, str(tmp_path / "bad.py")).first()["lines"] == []
    assert FS.decompress(FS.compress(b"x")) == b"x"
    import hashlib

    key = hashlib.sha256(b"a@x").hexdigest()
    code = hashlib.sha256((hashlib.sha256((tmp_path / "v.tsv").read_bytes()).hexdigest() + key).encode()).hexdigest()
    assert FS.sign(str(tmp_path / "v.tsv"), "a@x", str(tmp_path), "2024-03-05") == str(tmp_path / f"mt_stats_2024-03-05_{code}.json.gz")
    assert FS.merged_name("mt_profile.json", "2024-03-05") == "mt_profile.json_2024-03-05.gz"
    assert FS.file_hashes(spark, str(tmp_path / "v.tsv")).first()["sha256"] == FS.file_hash(str(tmp_path / "v.tsv"))


def test_documents_and_libraries(spark, tmp_path):
    libs = spark.createDataFrame([("/r", "r", "a.py", ["os", "sys"])], "repo_path string, repo string, file string, imports array<string>")
    FS.write_libraries(libs, str(tmp_path / "x_libs.jsonl"))
    assert rows(FS.libraries(spark, str(tmp_path / "x_libs.jsonl"))) == [("/r", "r", "a.py", ["os", "sys"])]
    facts = spark.createDataFrame([("r", "file", "2024Q1", 'a "b".py', 5), ("r", "file", "2024Q2", "c.py", 7), ("r", "big_commit", None, "f00", 900), ("s", "big_commit", None, "b0b", 101)], "repo string, kind string, qtr string, name string, lines bigint")
    assert json.loads(FS.report_document(facts).first()["value"]) == {"r": {"big_commits": {"f00": 900}, "files": {"2024Q1": {'a "b".py': 5}, "2024Q2": {"c.py": 7}}}, "s": {"big_commits": {"b0b": 101}, "files": {}}}
    assert FS.report_document(facts.limit(0)).first()["value"] == "{}"
    profiles = spark.createDataFrame([("r", "a@x", 1), ("s", "a@x", 1)], "repo string, author string, timestamp bigint")
    edited = FS.edited(profiles, spark.createDataFrame([("b",), ("a",)], "skill string"), 9).collect()
    assert [(r.repo, r.timestamp, r.nr_skills) for r in sorted(edited)] == [("r", 9, ["a", "b"]), ("s", 9, ["a", "b"])]
    doc = FS.merged(profiles, spark.createDataFrame([("l",)], "label string"), 3, program=__file__)
    FS.write_document(doc, str(tmp_path / "d"))
    text = "\n".join(x.value for x in spark.read.text(str(tmp_path / "d")).collect())
    assert [p["repo"] for p in json.loads(text)["profiles"]] == ["r", "s"] and json.loads(text)["hc"] == FS.file_hash(__file__)
    FS.write_document(FS.merged(profiles.limit(0), spark.createDataFrame([("l",)], "label string"), 3), str(tmp_path / "e"))
    assert json.loads("\n".join(x.value for x in spark.read.text(str(tmp_path / "e")).collect())) == {"user": "l", "timestamp": 3, "profiles": []}


def test_rankings_take_in_spellings_and_people_without_commits(spark):
    c = spark.createDataFrame([("r", " B@x"), ("r", "b@x"), ("r", ""), ("s", "b@x "), ("s", "a@x")], "repo string, raw_author string")
    assert [tuple(r) for r in A.author_ranking(c).collect()] == [("b@x", 3), ("a@x", 1)]
    assert [tuple(r) for r in A.author_ranking(c, first="me@x").collect()] == [("me@x", 0), ("b@x", 3), ("a@x", 1)]
    assert [r.author for r in A.author_ranking(c, first="a@x", most=1).collect()] == ["a@x"]


def test_labels_of_no_users_and_models_of_a_file(spark, tmp_path):
    none = spark.createDataFrame([], "author string")
    assert R.user_label(none, team="crew").first()["label"] == "crew" and R.user_label(none).first()["label"] is None
    (tmp_path / "c.ini").write_text("[run]\nversion = 2024.1\nskill_list = s.txt\n[c2s]\npath = a/b\nbeta.path = c\n[life_of_py]\npath = d\n")
    c = from_ini(str(tmp_path / "c.ini"))
    assert (c.version, c.skill_list, c.models) == ("2024.1", "s.txt", {"c2s": ["a/b", "c"], "life_of_py": ["d"]})


def test_a_language_can_be_registered(spark):
    from quern.functions import scalars as S
    from quern.functions import text as TX

    new = TX.Language("zig", "Zig", "}\n", "const ", r'@import\("([^"]+)"\)', TX.C_LIKE)
    df = spark.createDataFrame([("x.zig", 'const std = @import("std");\n/* about\nit all in a few words of prose here\n*/')], "path string, code string")
    before = [dict(d) for d in (S.LANGUAGES, S.SEPARATORS, S.IMPORT_PREFIXES, TX.IMPORTS, TX.COMMENTS)]
    try:
        TX.register(new)
        r = df.select(S.language_name(S.file_extension("path")).alias("l"), S.separator(F.lit("zig")).alias("s"), TX.imports_of(F.col("code"), F.lit("zig")).alias("i"), TX.documentation_lines_udf("code", F.lit("zig")).alias("n")).first()
        assert (r.l, r.s, r.i, r.n) == ("Zig", "}\n", ["std"], 2)
    finally:
        for d, old in zip((S.LANGUAGES, S.SEPARATORS, S.IMPORT_PREFIXES, TX.IMPORTS, TX.COMMENTS), before, strict=True):
            d.clear()
            d.update(old)


def test_user_label_gathers_no_more_than_it_shows(spark):
    names = [f"u{i:05d}@d{i % 600:03d}.org" for i in range(3000)] + ["@a.org", "z@zz.org"]
    df = R.user_label(spark.createDataFrame([(x,) for x in names], "author string"))
    groups = {}
    for x in sorted(names):
        groups.setdefault(x.split("@")[1], []).append(x)
    want = ",".join(g[0] if len(g) == 1 else f"({','.join(g)})@{d}" for d, g in sorted(groups.items()))
    assert df.first()["label"] == want[:252] + "..."
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
