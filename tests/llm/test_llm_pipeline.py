from __future__ import annotations

import plain
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from linehaul.llm import toxicity
from linehaul.llm.stage import small_batches

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    small_batches(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    scores = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {s.row.doc_id: rows[s.row.doc_id] for s in scores if s.score < 0.3}
    want = [dict(rows)]
    before = dict(rows)
    rows = {i: None if rows[i] is None else kept for i, (_, kept) in plain.line_dedup(list(rows.items())).items()}
    rows = {i: t for i, t in rows.items() if (t or "").split() or not (before[i] or "").split()}
    assert len(rows) < len(before)
    want.append(dict(rows))
    groups = plain.near_components(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    want.append(dict(rows))
    rows = {i: rows[i] for i, (_, hit, _) in plain.benchmark_hits(list(rows.items()), items).items() if not hit}
    want.append(dict(rows))
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want[k], name
    assert all(r.n_chars == len(r.text or "") for r in docs.collect())
    final = pipeline.run(spark, SF).where("start = 0").collect()
    assert sorted(r.id for r in final) == sorted(rows)
    # Nothing that had words comes out as a bare end id.
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.doc_tokens > 1 or not (first[r.id] or "").split() for r in final)


def test_no_rows(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, empty, SF).write.parquet(f"{tmp_path}/{k}")
        assert spark.read.parquet(f"{tmp_path}/{k}").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    small_batches(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_rows_that_share_an_id_or_have_none(spark):
    words = [" ".join(f"w{k}x{n}" for k in range(50)) for n in range(4)]
    rows = [(1, words[0]), (1, words[0]), (2, words[0] + " more"), (None, words[0]), (3, ""), (3, None)]
    rows += [(1, words[1]), (5, words[1] + " more"), (None, words[2]), (None, words[2] + " more"), (None, words[3])]
    out = pipeline.drop_near_copies(spark, frame(spark, rows), SF).collect()
    got = sorted((str(r.doc_id), (r.text or "")[:4]) for r in out)
    assert got == [("1", "w0x0"), ("1", "w0x1"), ("3", ""), ("3", ""), ("None", "w0x2"), ("None", "w0x3")]
    again = pipeline.drop_near_copies(spark, frame(spark, rows[::-1]), SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_null_long_and_emptied_texts_and_more_columns(spark, tmp_path):
    line = "a line that several documents hold in common"
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, line), (2, line + "\n" + line), (3, line + "\nand a line of its own that stays"), (4, None), (5, ""), (6, " \n\t"), (7, long), (None, line)]
    docs = frame(spark, rows)
    for c in ("id", "kept_text", "n_dropped", "component", "row", "score", "hits"):
        docs = docs.withColumn(c, F.lit(7))
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "line_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "4", "5", "6", "7"]
        if name != "packing":
            assert docs.columns == columns
    got = {r.id: r.doc_tokens for r in docs.where("start = 0").collect()}
    assert sorted(got) == [1, 3, 4, 5, 6, 7] and got[7] > 60_000
