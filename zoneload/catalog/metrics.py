"""Queries over metric series."""

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.metric_text import metric_lines
from ..registry import query
from ..session import shared_folder
from ..streaming import metrics as M
from ..streaming import state as ST

_C = F.col
_SUMMARY = """SELECT *, CASE WHEN scrapes = 720 AND resets = 0 THEN b - a END AS delta FROM (SELECT name, count(value) AS samples, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, sum(CASE WHEN adjacent AND step >= 0 THEN step END) AS known_delta, count(*) FILTER (step < 0) AS resets, count(DISTINCT scrape_index) AS scrapes, arg_min(value, scrape_index) AS a, arg_max(value, scrape_index) AS b
    FROM (SELECT *, scrape_index = lag(scrape_index) OVER w + 1 AS adjacent, value - lag(value) OVER w AS step FROM {0} WINDOW w AS (PARTITION BY name ORDER BY scrape_index)) GROUP BY name)"""


@query("met_series_summary", f"SELECT * EXCLUDE (a, b) FROM ({_SUMMARY.format('metric_samples')})", X.SCRAPES, "mean known_delta delta")
def series_summary(spark, d):
    return M.series_summary(X.metric_samples(spark, d), ["name"], 0, 719)


_UP = "(SELECT name, scrape_index, sum(v) OVER (PARTITION BY name ORDER BY scrape_index) AS value FROM (SELECT name, scrape_index, {0} AS v FROM metric_samples))"


@query("met_histogram_mean", f"SELECT name, CASE WHEN c.delta > 0 THEN s.delta / c.delta END AS mean FROM ({_SUMMARY.format(_UP.format('scrape_index % 7 + 1')).replace('scrapes = 720 AND ', '')}) s FULL JOIN ({_SUMMARY.format(_UP.format('1')).replace('scrapes = 720 AND ', '')}) c USING (name)", X.SCRAPES, "mean")
def histogram_mean(spark, d):
    """Sums and counts as counters over the scrapes that there are, numbered without gaps."""
    from pyspark.sql import Window

    rows = X.metric_samples(spark, d)
    w = Window.partitionBy("name").orderBy("scrape_index")
    dense = rows.withColumns({"s": F.sum(_C("scrape_index") % 7 + 1).over(w).cast("double"), "c": F.count("*").over(w).cast("double")})

    def deltas(column):
        got = M.series_summary(dense.select("name", "scrape_index", _C(column).alias("value")), ["name"], 0, 719)
        ends = dense.groupBy("name").agg((F.max(column) - F.min(column)).alias("d"))
        return got.drop("delta").join(ends, "name").select("name", F.when(_C("resets") == 0, _C("d")).alias("delta"))

    return M.histogram_means(deltas("s"), deltas("c"), ["name"])


@query("met_stream_state", f"SELECT * EXCLUDE (a, b) FROM ({_SUMMARY.format('metric_samples').replace('scrapes = 720', 'scrapes = last - first + 1').replace('arg_min(value, scrape_index) AS a', 'max(scrape_index) AS last, min(scrape_index) AS first, arg_min(value, scrape_index) AS a').replace('SELECT *, CASE', 'SELECT * EXCLUDE (first, last), CASE')})", X.SCRAPES, "mean known_delta delta")
def stream_state(spark, d):
    """The same state over a stream of files: all available ones, in micro-batches of one file each."""
    folder = shared_folder(spark)
    rows = X.metric_samples(spark, d)
    for part in range(3):  # files arrive in the scrapes' order
        rows.where(F.floor(_C("scrape_index") / 240) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = ST.series_stream(stream.select("name", F.lit("").alias("labels"), F.lit("value").alias("kind"), "scrape_index", "value"))
    writer = found.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    provider = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer.foreachBatch(lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    finally:
        spark.conf.set(provider, kept)
    out = spark.read.parquet(f"{folder}/out").drop("labels", "kind", "closed_at")
    return out.groupBy("name").agg(*[F.max_by(c, "batch").alias(c) for c in out.columns if c not in ("name", "batch")])


@query("src_metric_text", """SELECT name || x AS name, scrape_index, name AS kind, 'say "hi"' AS quoted, CASE WHEN x = '_created' THEN 'gauge' ELSE 'counter' END AS type, name AS family, substr(x, 2) AS component, CASE WHEN x = '_total' THEN value ELSE 1 END AS value
    FROM metric_samples, (SELECT unnest(['_total', '_created']) AS x)""", X.SCRAPES, "value")
def metric_text(spark, d):
    """Text of a counter family with an exemplar, a time stamp and a value that isn't a number, back to samples."""
    labels = F.concat(F.lit('{kind="'), "name", F.lit('", quoted="say \\"hi\\"",} '))
    line = F.concat(F.lit("# HELP x {\n# TYPE "), "name", F.lit(" counter\n"), "name", F.lit("_total"), labels, _C("value").cast("string"), F.lit(' 1700000000 # {id="7"} 1\n'), _C("name"), F.lit("_created"), labels, F.lit('1\nodd{x="1"} NaN\n'))
    rows = X.metric_samples(spark, d).select("scrape_index", line.alias("text"))
    got = metric_lines(rows).where("name <> 'odd'")
    return got.select("name", "scrape_index", _C("labels")["kind"].alias("kind"), _C("labels")["quoted"].alias("quoted"), "type", "family", "component", "value")
