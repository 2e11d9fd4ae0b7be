"""The pipeline against a plain version of each stage, and the registered queries' shape."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quarrymill.llm import op2_mixing, op8_pieces, op9_quality
from quarrymill.llm.common import save as op_save
from quarrymill.llm.common import work_dir
from quarrymill.llm.op6_language import held_out

from .test_operators import brute_components, fold, prose


#: Columns that the operators use inside.
CLASH = ["copies", "_id", "_copy", "_row", "row", "_locator", "locator", "key", "size", "weight", "component_id", "kept", "n", "score", "_part", "a.b", "c`d"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, prose(i, 30 + i % 50) + ".", "en", f"s{i % 4}", 0) for i in range(200)]
    rows += [(300 + i, prose(i, 30 + i % 50).upper() + ".", "en", "s0", 0) for i in range(10)]  # copies but for case
    rows += [(400 + i, prose(i, 30 + i % 50) + f". w{i}", "en", "s1", 0) for i in range(10, 30)]  # near copies
    rows += [(500 + i, prose(i + 500, 40).replace(" ", "### "), "en", "s2", 0) for i in range(80)]  # junk
    rows += [(900, None, None, None, 0), (901, "", "en", "s3", 0)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(i, 0 if 500 <= i < 600 else 1, 0) for i, *_ in rows if i % 2 == 0 and i < 900]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_in_order_match_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pieces"]

    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out("doc_id"))
    score = op9_quality.scorer(spark, op9_quality.train(docs, labels))
    scores = {r.doc_id: r.s for r in docs.withColumn("s", score(op9_quality.whole())).collect()}
    step = corpus_pipeline.quality(spark, docs, folder)
    kept = {r.doc_id: r.text for r in step.collect()}
    assert step.columns == columns and set(kept) == {i for i, s in scores.items() if s >= 0.5}
    assert np.mean([i in kept for i in range(200)]) > 0.98 and not any(500 <= i < 600 for i in kept)

    step = corpus_pipeline.exact(spark, step, folder)
    by: dict[str, int] = {}
    for i, t in kept.items():
        by[fold(t)] = max(i, by.get(fold(t), i))
    kept = {i: kept[i] for i in by.values()}
    assert step.columns == columns and {r.doc_id for r in step.collect()} == set(kept)

    step = corpus_pipeline.near(spark, step, folder)
    parts = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if parts[i][1] == i}
    assert step.columns == columns and {r.doc_id for r in step.collect()} == set(kept)

    step = corpus_pipeline.mix(spark, step, folder)
    rows = step.collect()
    assert step.columns == columns and {r.doc_id for r in rows} <= set(kept)
    assert all(kept[r.doc_id] == r.text for r in rows)

    last = corpus_pipeline.pieces(spark, step, folder).collect()
    assert len(last) == len(rows)
    _, decode = op8_pieces.coder(spark)
    back = spark.createDataFrame([(r.doc_id, r.ids) for r in last], "doc_id long, ids array<int>").select("doc_id", decode("ids").alias("t")).collect()
    assert all((kept[r.doc_id] or "") == r.t for r in back)
    whole = corpus_pipeline.run(spark, folder)
    texts = lambda df: sorted((r.doc_id, r.t or "") for r in df.select("doc_id", decode("ids").alias("t")).collect())  # noqa: E731  merges go by row
    assert texts(whole) == sorted((r.doc_id, r.text or "") for r in rows)


def test_copies_of_a_row_have_merges_of_their_own(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 1")
    got = [tuple(r.ids) for r in corpus_pipeline.pieces(spark, docs.union(docs).union(docs), folder).collect()]
    assert len(set(got)) == 3


def test_every_stage_takes_an_empty_table_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0, name
    clash = docs.where("doc_id < 20").select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, folder)
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASH), name


def test_very_long_text_goes_through(spark, folder):
    long = prose(9000, 120_000, 5000) + "."
    rows = [(7000, long, "en", "s0", 0), (7001, long + " end", "en", "s0", 0)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    table = docs.where("doc_id < 40").union(spark.createDataFrame(rows, docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = op_save(stage(spark, table, folder), work_dir(spark, "long"))
    assert {r.doc_id for r in table.where("doc_id >= 7000").collect()} == {7000}


def test_null_and_repeated_ids_count_each_on_their_own(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None if i < 20 else 5 if i < 40 else i, prose(3000 + i, 40), "en", f"s{i % 3}", 0) for i in range(60)]
    table = spark.createDataFrame(rows, schema)
    times = defaultdict(int)
    for r in corpus_pipeline.mix(spark, table, folder).collect():
        times[r.text] += 1
    assert set(times) <= {t for _, t, *_ in rows} and max(times.values()) <= 3
    taken, target = defaultdict(int), {r.source: r.target for r in op2_mixing.mix(table).collect()}
    for _, t, _, s, _ in rows:
        taken[s] += 40 * times[t]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)

    # one doc_id with a text of its own, one that copies another's, and two null ids of near texts
    texts = [prose(4000, 60), prose(4001, 60), prose(4000, 60) + " w1", prose(4002, 60), prose(4002, 60) + " w2"]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip((1, 2, 2, None, None), texts)], schema)
    kept = [r.text for r in corpus_pipeline.near(spark, table, folder).collect()]
    assert len(kept) == 3 and set(texts[:2]) < set(kept) and len(set(kept) & set(texts[3:])) == 1


def test_every_number_is_registered_once():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
