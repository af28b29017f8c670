"""The native operators run no Python: neither in their plans nor in their modules."""

import inspect
import re

import pytest

import __spark_entry__ as E
from prefloom.llm import licenses, linedup, shard

PYTHON = re.compile(r"MapIn(Pandas|Arrow)|ArrowEvalPython|BatchEvalPython|FlatMapGroupsIn|FlatMapCoGroupsIn")


@pytest.mark.parametrize("name", ["op3_license_scan", "op5_sharding", "op7_line_dedup"])
def test_no_python_in_the_plan(spark, sf, name):
    plan = E.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON.search(plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("module", [licenses, linedup, shard])
def test_no_python_in_the_module(module):
    code = inspect.getsource(module)
    assert not re.search(r"mapIn|applyIn|pandas_udf|\budf\b|\.rdd\b|import (numpy|pandas|pyarrow)", code)
