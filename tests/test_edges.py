"""Queries on tables with values that the supplied ones happen not to hold, against their SQL."""

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows_of

from lontar.functions import numbers
from lontar.plans import event_queries, file_queries, table_queries  # noqa: F401  add their queries to those
from lontar.plans.queries import ORACLES, QUERIES


@pytest.fixture
def tables(sf, tmp_path):
    """A folder of the smallest tables, of which a test may write some anew by DuckDB."""

    def made(**own):
        for path in Path(sf).iterdir():
            if path.name.split(".")[0] not in own:
                os.symlink(path, tmp_path / path.name)
        for name, sql in own.items():
            duckdb.connect().execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return made


def agrees(spark, folder, name):
    got = QUERIES[name](spark, folder)
    db = duckdb.connect()
    for path in Path(folder).iterdir():
        db.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    want = db.sql(ORACLES[name])
    rows = [tuple(r) for r in got.collect()]
    assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())
    return [dict(zip(got.columns, r, strict=True)) for r in rows]


def test_ages_of_hours_and_of_two_days(spark, tables):
    hours = (0, 1, -1, 25, -25, 47, -47, 48, -48, 30 * 24, -365 * 24, -9_000_000)
    rows = ", ".join(f"({i}, {h})" for i, h in enumerate(hours))
    sql = f"SELECT CAST(i AS BIGINT) AS o_orderkey, CAST(i AS BIGINT) AS o_custkey, TIMESTAMP '1998-12-31 00:00:00' + to_hours(h) AS o_orderdate FROM (VALUES {rows}) t(i, h)"
    found = {r["o_custkey"]: r for r in agrees(spark, tables(orders=sql), "order_ages")}
    assert [found[i]["en"] for i in (0, 1, 2, 8)] == ["now", "in 1 hour", "1 hour ago", "2 days ago"] and found[8]["th"] == "เมื่อวานซืน"


_BALANCES = "SELECT CAST(row_number() OVER () AS BIGINT) AS s_suppkey, 's' AS s_name, CAST(0 AS INTEGER) AS s_nationkey, CAST(v AS DOUBLE) AS s_acctbal FROM (VALUES {}) t(v)"


def test_percents_of_halves(spark, tables):
    balances = _BALANCES.format(", ".join(f"({v})" for v in (28.5, -14.5, -100.5, 101.5, 0.5, -0.49, 0)))
    assert {r["share"] for r in agrees(spark, tables(supplier=balances), "plain_numbers")} >= {"29%", "-15%", "-101%", "102%"}


def test_short_numbers_that_round_up_to_the_next_form(spark, tables):
    balances = _BALANCES.format(", ".join(f"({v})" for v in (999.49, 999.5, -999.99, 0.9994, 0.9996, 1150, 99.96, 0, 2850)))
    found = [r["compact"] for r in agrees(spark, tables(supplier=balances), "short_numbers") if r["locale"] == "en"]
    assert found == ["999K", "1M", "-1M", "999", "1K", "1.2M", "100K", "0", "2.9M"]
    row = spark.range(1).select(*(numbers.format_compact(spark, F.lit(v), "en").alias(str(i)) for i, v in enumerate((999.4, 999.5, 999_499.0, 999_500.0, 999_950_000.0, 1234.0)))).first()
    assert list(row) == ["999", "1K", "999K", "1M", "1B", "1.2K"]


def test_classes_of_many_ranges_are_parted_by_blocks():
    import regex

    from lontar.functions import scripts

    points = [c for c in range(0xC0, 0x30000) if c % 7 < 2 and not 0xD800 <= c < 0xE000]
    made = scripts._ranges(points)
    at_top = regex.sub(r"\[[^\[\]]*&&\[[^\[\]]*\]\]", "B", made)  # blocks, each behind one range
    assert len(regex.findall(r"B|\\x\{\w+\}(?:-\\x\{\w+\})?", at_top)) <= 2 * len(scripts.BLOCKS)
    own = regex.compile("[" + regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", made) + "]", regex.V1)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    assert [ord(c) for c in own.findall(every)] == points
    assert all(p.startswith("(?=") for p in (scripts._folding()[2], scripts._unsettled()))  # what is plain is asked one thing


def test_keys_and_grams_are_not_broadcast(spark, sf):
    plan = QUERIES["searched_parts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_requests_are_not_grouped_or_sorted(spark, sf):
    plan = QUERIES["resolved_messages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(request_id" not in plan and "Sort [request_id" not in plan


def test_long_texts_are_not_remembered():
    from lontar.functions import clusters as C

    before = C._remembered.cache_info().currsize
    assert len(C.clusters("กา" * 500, "Thai")) == 500 and C._remembered.cache_info().currsize == before


def test_a_bucket_holds_many_slots():
    import pandas as pd

    from lontar.streaming.revisions import _Slots

    class Held(list):
        def exists(self):
            return bool(self)

        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

    slots = _Slots()
    slots.held = Held()
    rows = lambda *r: pd.DataFrame([(i, k, c, "neutral", v, "u", "human", i) for i, k, c, v in r], columns=["id", "key", "locale", "register", "value", "user", "source", "at"])
    befores = lambda *frames: {r.id: r.before for out in slots.handleInputRows((0,), iter(frames), None) for r in out.itertuples()}
    assert befores(rows((2, "a", "th", "y"), (3, "b", "th", "p")), rows((1, "a", "th", "x"), (4, None, "th", None))) == {1: None, 2: "x", 3: None, 4: None}
    assert befores(rows((5, "b", "th", "q"), (6, "a", "vi", "z"), (7, "a", "th", None), (8, "a", "th", "w"), (9, None, "th", "n"))) == {5: "p", 6: None, 7: "y", 8: None, 9: None}
    assert sorted(slots.held, key=str) == sorted([("a", "th", "neutral", "w"), ("b", "th", "neutral", "q"), ("a", "vi", "neutral", "z"), (None, "th", "neutral", "n")], key=str)
