"""Plan checks: position and running-max windows never run unpartitioned over data rows."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "AdaptiveSparkPlan" in plan:
        plan = df._jdf.queryExecution().executedPlan().inputPlan().toString()
    out = []
    for line in plan.splitlines():
        if "Window [" not in line:
            continue
        m = re.search(r"Window \[(.*)\], \[(.*?)\], \[(.*?)\]\s*$", line)
        if m:
            out.append((m.group(1), m.group(2)))
    return out


@pytest.mark.parametrize("name,marker", [("shuffle_rows", "row_number()"), ("eval_batches", "row_number()"),
                                         ("assign_batches", "row_number()"), ("detect_restarts", "max(boot_time")])
def test_data_windows_are_partitioned(spark, name, marker):
    wins = [(expr, part) for expr, part in _windows(E.queries()[name](spark, SF)) if marker in expr]
    assert wins, "expected a window over the data"
    for expr, part in wins:
        assert "_cf_bucket" in part, (name, expr, part)


def test_tail_uses_partial_group_limit(spark):
    df = E.queries()["tail_mean"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan + final and "Partial" in plan + final
