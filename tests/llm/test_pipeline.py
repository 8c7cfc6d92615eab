"""The pipeline's stages: what each keeps, and the whole run against plain Python."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as leaks_of
from test_line_dedup import deduped as passages
from test_ngram_join import brute as links_of
from test_tokens import plain as ids_of

import corpus_pipeline
from quern.llm import ngram_join, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=5):
    """Documents with insults, copies, near copies, shared passages, benchmark items, nulls and repeated rows; their labels; the items."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randrange(3, 9))) for _ in range(900)]
    line = lambda n=12: " ".join(r.choice(words) for _ in range(n))
    items = [(i, line(25)) for i in range(12)]
    passage = "\n".join(line(20) for _ in range(3))
    rows, labels = [], []
    for i in range(150):
        lines = [line() for _ in range(r.randrange(4, 9))]
        toxic = i % 5 == 0
        if toxic:
            lines[1] += " blockhead numbskull"
        if i % 7 == 3:
            lines.insert(r.randrange(len(lines)), passage)
        if i % 11 == 4:
            lines.append(items[i % 12][1])
        text = "\n".join(lines)
        if i % 9 == 8 and rows:  # a near copy of one line, or an exact one
            text = rows[-1][1].replace("\n", " ") if i % 2 else rows[-1][1]
            toxic = rows[-1][2]
        rows.append((i, text, toxic))
        labels.append((i, int(toxic)))
    rows = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "one line")]
    return rows, labels, items


def table(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(at)


def run_plain(spark, rows, labels, items):
    """The pipeline in plain Python but for the learning, which has a test of its own."""
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id long, toxic int"))
    scores = toxicity.Scorer(model).probabilities([t for _, t in rows])
    steps = [[x for x, s in zip(rows, scores, strict=True) if s < 0.5]]
    steps.append([(d, t) for d, t, *_ in passages(steps[-1])])
    groups = {d: c for d, _, _, c in links_of(steps[-1], 5, 80)}
    steps.append([x for x in steps[-1] if groups[x[0]] == x[0]])
    held_by = {d for d, _ in leaks_of(steps[-1], items)}
    steps.append([x for x in steps[-1] if x[0] not in held_by])
    return steps


def test_whole_run_against_plain_python(spark, tmp_path):
    rows, labels, items = documents()
    sf = str(tmp_path / "sf")
    table(spark, [(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA, f"{sf}/documents.parquet")
    table(spark, [(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int", f"{sf}/labels.parquet")
    table(spark, items, "item_id long, text string", f"{sf}/benchmark.parquet")
    steps = run_plain(spark, rows, labels, items)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    now, before = spark.read.parquet(f"{sf}/documents.parquet"), rows
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps, strict=False):
        got = stage(spark, now, sf)
        assert got.columns == now.columns, name
        got.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(want), name
        assert sorted(want) != sorted(before), name  # every stage has something to do
        before = want
    want = Counter()
    for d, t in steps[-1]:
        for k, x in enumerate([*ids_of(t), 0]):
            want[d, k, x] += 1
    pieces = corpus_pipeline.run(spark, sf).collect()
    ids = {(d, k): x for d, k, x in want}
    for p in pieces:
        own = [ids[p.doc_id, p.start + k] for k in range(p.length)]
        assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and p.doc_tokens == sum(d == p.doc_id for d, _ in ids)
    assert Counter((p.doc_id, p.start + k) for p in pieces for k in range(p.length)) == Counter((d, k) for d, k in ids)


def test_nulls_and_repeated_identifiers_through_the_whole_run(spark, tmp_path):
    rows, labels, items = documents(8)
    sf = str(tmp_path / "sf")
    odd = [(None, rows[1][1], None, None, None), (None, rows[1][1], None, None, None), (None, rows[2][1], "x", None, 1), (3, rows[3][1], "en", "s", 5), (3, rows[3][1], "de", None, None), (3, "another text", None, "s", 0), (None, None, None, None, None)]
    table(spark, [(i, t, "en", "s", 1) for i, t in rows] + odd, SCHEMA, f"{sf}/documents.parquet")
    table(spark, [(i, 1, y) for i, y in labels] + [(None, None, None), (4, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int", f"{sf}/labels.parquet")
    table(spark, [*items, (None, None), (None, items[0][1])], "item_id long, text string", f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, now, sf)
        got.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    texts = Counter(r.text for r in now.collect() if r.text and " " in r.text)
    assert max(texts.values()) == 1 and "another text" in texts  # no text is there twice, with whatever identifier
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(ids_of(r.text)) + 1 for r in now.collect())


def test_recall_of_copies_and_near_copies(spark, tmp_path):
    """Copies with up to one word in eighty changed, after line_dedup, which is what the stage gets."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows, family = [], {}
    for g in range(40):
        base = [[r.choice(words) for _ in range(80)] for _ in range(3)]
        for copy in range(3):
            lines = [list(x) for x in base]
            if copy:
                for x in lines:
                    x[r.randrange(80)] = f"new{len(rows)}"
            family[len(rows)] = g
            rows.append((len(rows), "\n".join(" ".join(x) for x in lines), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [x.doc_id for x in ngram_join.one_of_each(docs, 5, 80).collect()]
    alone = 1 - (len(kept) - 40) / 80
    after = corpus_pipeline.lines_out(spark, docs, "")
    left = [x.doc_id for x in corpus_pipeline.near_copies_out(spark, after, "").collect()]
    assert alone >= 0.9 and len(left) >= 40 and {family[d] for d in left} == set(range(40))
    assert 1 - (len(left) - 40) / 80 >= 0.9  # no line repeats here as a whole, so line_dedup takes nothing away


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        left = {r.doc_id for r in now.select("doc_id").collect()}
        assert now.columns == docs.columns and left <= ids
        assert (left == ids) == (name == "line_dedup"), name
        ids = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in pieces.collect()} == ids


def test_one_document_of_each_group_stays(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    base = [[r.choice(words) for _ in range(80)] for _ in range(5)]
    rows = []
    for i in range(50):
        w = list(base[i % 5])
        if i % 3 == 0:
            w[r.randrange(80)] = "changed"
        rows.append((100 - i, " ".join(w), "en", "s", 1))
    rows += [(500, "", "en", "s", 0), (501, None, "en", "s", 0), (502, "tiny text", "en", "s", 9), (502, "tiny text", "en", "s", 9)]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA), 5, 80)
    groups = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()}
    assert sorted(r.doc_id for r in got.collect()) == sorted({d for d, c in groups.items() if d == c})
    assert {500, 501, 502} <= {r.doc_id for r in got.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_empty_documents(spark):
    now = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.collect() == []
        now = spark.createDataFrame([], now.schema)
