"""Metric text by lines: labels with escapes, types, errors, a long scrape, and any line against a plain reading."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from zoneload.functions.metric_text import metric_lines


def lines_of(spark, *texts, **options):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return metric_lines(spark.createDataFrame(rows, "k int, text string, value string").repartition(2), **options)


def test_types_labels_and_values(spark):
    text = '# TYPE lat histogram\r\n  lat_bucket{le="+Inf",p="a\\"b\\\\n\\n}{,=", } 3 # {id="x"} 1\nlat_sum 2.5 1700000000\nlat_created 7\nup NaN\n# HELP x\n# TYPE req counter\n#TYPE other gauge\nreq_total{} +Inf\nother_total 1e3\n# TYPE req gauge\nlat -.5'
    got = {r.name: r for r in lines_of(spark, text).collect()}
    assert got["lat_bucket"].labels == {"le": "+Inf", "p": 'a"b\\n\n}{,='} and got["lat_bucket"].line == 1
    assert {n: (r.type, r.family, r.component, r.value) for n, r in got.items()} == {
        "lat_bucket": ("histogram", "lat", "bucket", 3.0), "lat_sum": ("histogram", "lat", "sum", 2.5), "lat_created": ("gauge", "lat", "created", 7.0), "up": ("untyped", "up", "", None),
        "req_total": ("gauge", "req", "total", None), "other_total": ("untyped", "other_total", "", 1000.0), "lat": ("histogram", "lat", "", -0.5),
    }
    assert got["up"].value_text == "NaN" and got["req_total"].value_text == "+Inf" and got["lat"].k == 0


@pytest.mark.parametrize("line", ["x", "x{a=\"1\" 2", "x{a=1} 2", 'x{a="1" b="2"} 3', 'x{a="\\t"} 1', 'x{1a="2"} 3', "9x 1", "x 1 2 3", "x 5d", "x 1_0", 'x{a="1",a="2"} 3', 'x{a="1",b="2"} 1\nx{b="2",a="1"} 2', "x 1\nx 1", 'x{a="1"}2'])
def test_errors(spark, line):
    text = f"fine 1\n{line}"
    with pytest.raises(PySparkException, match="invalid metric line|repeated"):
        lines_of(spark, text).collect()
    kept = lines_of(spark, text, "fine 2", None, "", strict=False).collect()
    assert [(r.k, r.name, r.value) for r in kept] == [(1, "fine", 2.0)]


def test_prefix_passes_other_lines_over(spark):
    assert [r.name for r in lines_of(spark, "other broken line here\nown:x 1", prefix="own:").collect()] == ["own:x"]


def test_a_long_scrape_is_spread(spark):
    text = "# TYPE m counter\n" + "\n".join(f'm_total{{i="{i}"}} {i}' for i in range(20_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lines_of(spark, text)
        assert got.where("type = 'counter' AND labels['i'] = value_text").count() == 20_000
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


label = st.text(alphabet='ab"\\\n{},= é', max_size=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "_c"]), label, max_size=3), min_size=1, max_size=5))
def test_any_labels_come_back(spark, found):
    escape = lambda v: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    text = "\n".join(f"m{i}{{{','.join(f'{k}=\"{escape(v)}\"' for k, v in labels.items())}}} {i}" for i, labels in enumerate(found))
    assert {r.name: r.labels for r in lines_of(spark, text).collect()} == {f"m{i}": labels for i, labels in enumerate(found)}


def test_no_python_in_the_plan(spark):
    plan = lines_of(spark, "x 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "python" not in plan.lower() and F is not None
