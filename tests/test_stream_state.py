"""Series over a stream: any split into micro-batches equals the batch summary; starts from a batch; timers close series."""

import random

import pytest
from pyspark.sql import functions as F

from zoneload.streaming.metrics import series_summary
from zoneload.streaming.state import as_state, series_stream

SAMPLES = "name string, labels string, kind string, scrape_index long, value double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, kept)


def made_up(seed):
    r = random.Random(seed)
    rows = []
    for name, labels, kind in (("gauge", "a", "value"), ("gauge", "b", "value"), ("lat", "", "sum"), ("lat", "", "count"), ("up", "", "value")):
        value = 0.0
        for i in range(12):
            value = 0.0 if r.random() < 0.1 else value + r.random()
            if r.random() > 0.15:
                rows.append((name, labels, kind, i, None if r.random() < 0.05 else value))
    return rows


def streamed(spark, folder, parts, **options):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    writer = series_stream(stream, **options).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def plainly(spark, rows):
    got = series_summary(spark.createDataFrame(rows, SAMPLES), ["name", "labels", "kind"], 0, 11).collect()
    return {(r.name, r.labels, r.kind): tuple(None if v is None else pytest.approx(v) for v in (r.samples, r.mean, r.minimum, r.maximum, r.known_delta, r.resets, r.scrapes)) for r in got}


def latest(out):
    rows = out.groupBy("name", "labels", "kind").agg(F.max_by(F.struct("samples", "mean", "minimum", "maximum", "known_delta", "resets", "scrapes"), "batch").alias("s")).collect()
    return {(r.name, r.labels, r.kind): tuple(r.s) for r in rows}


@pytest.mark.parametrize("cuts", [(12,), (3, 7, 12)])
def test_any_split_equals_the_batch(rocks, tmp_path, cuts):
    rows = made_up(1)
    parts = [[x for x in rows if a <= x[3] < b] for a, b in zip((0, *cuts), cuts, strict=False)]
    assert latest(streamed(rocks, tmp_path, parts)) == plainly(rocks, rows)


def test_a_stream_goes_on_from_a_batch(rocks, tmp_path):
    rows = made_up(2)
    first = rocks.createDataFrame([x for x in rows if x[3] < 5], SAMPLES)
    got = latest(streamed(rocks, tmp_path, [[x for x in rows if x[3] >= 5]], initial=as_state(first)))
    want = plainly(rocks, rows)
    assert got and all(got[k] == want[k] for k in got)


def test_a_timer_closes_a_series(rocks, tmp_path):
    rows = [("up", "", "value", 0, 1.0), ("up", "", "value", 1, 2.0)]
    rocks.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = rocks.readStream.schema(SAMPLES).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = series_stream(stream, patience_ms=500).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second")
    query = query.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")).start()
    for _ in range(60):
        query.awaitTermination(1)
        try:
            if rocks.read.parquet(f"{tmp_path}/out").where("closed_at IS NOT NULL").count():
                break
        except Exception:  # nothing written yet
            continue
    query.stop()
    closed = rocks.read.parquet(f"{tmp_path}/out").where("closed_at IS NOT NULL").first()
    assert (closed.name, closed.samples, closed.delta) == ("up", 2, 1.0)
