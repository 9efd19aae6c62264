"""The log of revisions as a keyed state of a stream: each edit with the value that it replaces. An addition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOT = ["key", "locale", "register"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Slots are dealt to so many keys of the state, so that a call of Python reads many slots and not one. A checkpoint keeps to it.
BUCKETS = 1024
_BUCKET = "__bucket"


def _tuples(rows) -> list[tuple]:
    """Rows of a frame as tuples, with None for what is missing."""
    return list(zip(*(column.astype(object).where(column.notna(), None).tolist() for _, column in rows.items()), strict=True))


class _Slots(StatefulProcessor):
    """Holds the values of a bucket's slots; the edits of one batch are put in order and read as a chain for each slot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "key string, locale string, register string, value string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.held.appendList(_tuples(initialState[[*SLOT, "value"]]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        edits = pd.concat(list(rows), ignore_index=True)
        edits["__slot"] = edits.groupby(SLOT, dropna=False, sort=False).ngroup()
        edits = edits.sort_values(["__slot", "at", "id"], kind="stable", ignore_index=True)
        held = {tuple(row[:3]): row[3] for row in self.held.get()} if self.held.exists() else {}
        opens = edits["__slot"].ne(edits["__slot"].shift(1))
        edits["before"] = edits["value"].shift(1).astype(object)
        edits.loc[opens, "before"] = pd.Series([held.get(slot) for slot in _tuples(edits.loc[opens, SLOT])], index=edits.index[opens], dtype=object)
        last = edits.loc[opens.shift(-1, fill_value=True), [*SLOT, "value"]]
        held.update({row[:3]: row[3] for row in _tuples(last)})
        self.held.put([(*slot, value) for slot, value in held.items()])
        edits = edits.rename(columns={"value": "after"})
        yield edits[["id", *SLOT, "before", "after", "user", "source", "at"]]

    def close(self) -> None:
        pass


def revision_stream(edits: DataFrame, values: DataFrame | None = None, regulated: DataFrame | None = None) -> DataFrame:
    """A stream of (id, key, locale, register, before, after, user, source, at), one row for each edit.

    edits: a stream of (id long, key, locale, register, value, user, source, at); id and at aren't null and order the
    edits of a slot within a batch, batches come as they do. values: what slots (key, locale, register, value) hold
    at the start. Edits of regulated keys (key) by ai are refused. The state is one value for each slot and lives in
    RocksDB, which the session must name (state_on_disk()), by BUCKETS of slots; a task holds the edits and the values of
    one bucket in one batch, so bound batches by the source's options. A restart from the same checkpoint goes on where the last batch ended.
    """
    if regulated is not None:
        marked = edits.join(regulated.select("key", F.lit(True).alias("__regulated")).distinct(), "key", "left")
        edits = marked.where("__regulated IS NULL OR source IS NULL OR source <> 'ai'")
    bucket = F.pmod(F.xxhash64(*SLOT), F.lit(BUCKETS)).cast("int").alias(_BUCKET)
    rows = edits.select("id", *SLOT, "value", "user", "source", "at", bucket)
    schema = f"id long, key string, locale string, register string, before string, after string, user string, source string, at {rows.schema['at'].dataType.simpleString()}"
    first = None if values is None else values.select(*SLOT, "value", bucket).groupBy(_BUCKET)
    return rows.groupBy(_BUCKET).transformWithStateInPandas(_Slots(), schema, "append", "none", initialState=first)


class state_on_disk:
    """Within it, streams that start keep their state in RocksDB; the session's own setting comes back after."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(PROVIDER, None)
        self.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        self.conf.set(PROVIDER, self.before) if self.before else self.conf.unset(PROVIDER)
