"""The pipeline's stages on a small copy of the tables, each held against what the operators must keep."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_repeats
from zoneload.llm import decontaminate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).cache()
        out.append((docs, kept))
        docs = kept
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(results):
    for before, kept in results[:-1]:
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.dtypes == before.dtypes


def test_quality_keeps_good_documents(spark, results):
    before, kept = results[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = set(texts(kept))
    right = [(i in ids) == bool(labels[i]) for i in texts(before) if i in labels]
    assert sum(right) >= 0.85 * len(right)  # some sixty labels are learned here


def test_near_duplicates_keep_one_of_each_group(results):
    before, kept = results[1]
    want = {d for d, (_, _, first) in brute_components(list(texts(before).items()), 5).items() if first}
    assert set(texts(kept)) == want


def test_suffixes(results):
    before, kept = results[2]
    want = brute_repeats(list(texts(before).items()))
    got = texts(kept)
    old = texts(before)
    assert set(got) == set(want)
    assert all((got[d] == old[d]) == (want[d][1] == 0) and len((got[d]).encode()) <= want[d][0] - want[d][1] for d in want)


def test_decontamination(spark, results):
    before, kept = results[3]
    bad = {r.doc_id for r in decontaminate.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert set(texts(kept)) == set(texts(before)) - bad


def test_packing_has_every_token_once(results):
    before, pieces = results[4]
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m"))
    assert whole.where("n <> m").count() == 0 and whole.count() == before.count()


def test_run_equals_the_stages(spark, results):
    assert corpus_pipeline.run(spark, SF).exceptAll(results[-1][1]).count() == 0


@pytest.mark.parametrize("bare", [True, False])
def test_run_on_odd_tables(spark, tmp_path, bare):
    """Rows without id or text, repeated ids, clashing columns; without labels and benchmark, and with some."""
    long = "some plain words that stand here for a text of more than fifty bytes in all"
    rows = [(1, long, "en"), (1, "another text", "en"), (None, long, None), (None, None, "de"), (2, None, "en"), (3, "", "en"), (4, long, "en"), (5, f"A benchmark item of ten words stands here in full, yes {long}", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "__score": F.lit("x"), "contaminated": F.lit(1), "__gone": F.lit(2)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [] if bare else [(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0)]
    items = [] if bare else [(1, "a benchmark item of ten words stands here in full"), (None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # 4 is a copy of 1; 5 repeats no more than 1 has, and is dropped with the benchmark.
    assert sorted(got) == ["1", "1", "2", "3"] + (["5"] if bare else []) + ["None", "None"]


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
