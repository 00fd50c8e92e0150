"""Canonical forms of nested decisions: what changes a signature and what doesn't."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zoneload.functions.canonical import EXPLANATIONS, decision_signatures, leaves

BASE = {"grid": {"level": "High", "windows": [{"start": "00:00", "load": 1.0}, {"start": "03:00", "load": 2.5}]}, "shift": -3, "ok": True, "none": None}


def signatures(spark, *values):
    rows = [("z", i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    got = decision_signatures(spark.createDataFrame(rows, "zone string, round int, text string").repartition(2), ["zone"], "text", "round").orderBy("round").collect()
    return [r.signature for r in got], [r.converged for r in got]


def test_what_does_not_matter(spark):
    turned = {"none": None, "ok": True, "shift": -3.0, "grid": {"windows": [{"load": 1, "start": " 00:00 "}, {"load": "2.5000000001", "start": "03:00"}], "level": "High"}}
    told = {**BASE, "Reasoning_Summary ": "x", "grid": {**BASE["grid"], "windows": [{**w, "message_to_other_agents": {"deep": [1, 2]}} for w in BASE["grid"]["windows"]]}, "agreements": ["y"]}
    found, converged = signatures(spark, BASE, turned, told)
    assert len(set(found)) == 1 and converged == [False, True, True]


def test_what_matters(spark):
    changes = [
        BASE, {**BASE, "shift": -4}, {**BASE, "shift": -3.00001}, {**BASE, "ok": False}, {**BASE, "ok": "true"}, {**BASE, "none": {}}, {**BASE, "none": []}, {k: v for k, v in BASE.items() if k != "none"},
        {**BASE, "grid": {**BASE["grid"], "windows": BASE["grid"]["windows"][::-1]}}, {**BASE, "grid": {"level": "High", "windows": {"0": {"start": "00:00", "load": 1.0}, "1": {"start": "03:00", "load": 2.5}}}}, {**BASE, "a/b": 1}, {**BASE, "a": {"b": 1}}, {**BASE, "none": {"agreements": 1, "x": None}},
    ]
    found, converged = signatures(spark, *changes)
    assert len(set(found)) == len(changes) and not any(converged)


def test_odd_texts(spark):
    found, converged = signatures(spark, "{broken", "{broken", "{other", None, None, "3", "[]", '"x"', "")
    assert converged == [False, True, False, False, False, False, False, False, False] and found[3] is None and len(set(found)) == 7


def canonical(value):
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in value.items() if k.strip().lower() not in EXPLANATIONS}
    return [canonical(v) for v in value] if isinstance(value, list) else value


nested = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["a", "b/c", "~"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "a/b", "agreements"]), x, max_size=3), max_leaves=8)


@settings(max_examples=8, deadline=None)
@given(st.lists(nested, min_size=2, max_size=12))
def test_equal_signatures_mean_equal_values(spark, values):
    found, _ = signatures(spark, *[json.dumps(v) for v in values])
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            same = json.dumps(canonical(a), sort_keys=True) == json.dumps(canonical(b), sort_keys=True)
            assert (found[i] == found[j]) == same


def test_no_python_in_the_plan(spark):
    df = leaves(spark.createDataFrame([(1, '{"a": [1]}')], "k int, t string"), ["k"], "t")
    assert sorted((r.path, r.value) for r in df.collect()) == [("", "{"), ("/a", "["), ("/a/0", "n:1.000000")]
    assert "python" not in df._jdf.queryExecution().optimizedPlan().toString().lower() and pytest
