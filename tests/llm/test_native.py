"""Operators that are to be native run no Python on executors; what the driver sees of plans stays bounded."""

import contextlib
import inspect
import io
import re

import pytest

from lontar.llm import mixing, urls
from lontar.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize(("module", "name"), [(urls, "op7_rare_token"), (mixing, "op10_pivotal")])
def test_no_python_in_native_plans(spark, sf, module, name):
    source = inspect.getsource(module)
    assert not re.search(r"\budf\b|pandas|pyarrow|mapIn|applyIn|\.rdd\b|\.collect\(", source)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, sf).explain("formatted")
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", out.getvalue())


def test_pages_are_read_without_their_html(spark, sf):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES["op7_rare_token"](spark, sf).explain("formatted")
    assert "html" not in out.getvalue()


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_local_checkpoint_or_cross_join(name):
    module = inspect.getsource(inspect.getmodule(QUERIES[name]))
    assert "localCheckpoint" not in module and "crossJoin" not in module
