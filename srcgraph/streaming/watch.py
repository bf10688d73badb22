"""Watching a tree: a clock stream compares listings and publishes changes, which a source of its own streams."""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from srcgraph.operators.compare import changed_paths
from srcgraph.session import qualified, remove_path
from srcgraph.sources.log import TableLog
from srcgraph.sources.scan import open_root, snapshot


EVENTS = "tick long, ts timestamp, path string, change string"


class Watcher:
    """Publishes the changes of a tree as numbered versions below ``state``.

    Spark's streaming file source remembers files by path, so it sees neither
    changed nor deleted files; comparing listings does.  ``state`` is a folder
    all executors share.  A version is a listing and the table of changes that
    led to it; both are written first and count once the log names them, so a
    watch that dies half-way neither loses nor repeats a change.
    """

    def __init__(self, spark: SparkSession, root: str, state: str,
                 on_change: Callable[[DataFrame], None] | None = None,
                 list_tree: Callable[[SparkSession, str], DataFrame] = snapshot):
        self.spark, self.root, self.state = spark, root, state
        self.on_change, self.list_tree, self.log = on_change, list_tree, TableLog(spark, state)

    def _path(self, name: str) -> str:
        return os.path.join(self.state, name)

    def step(self, tick: int = 0) -> DataFrame | None:
        """One comparison: returns the changes, or None if there are none or no earlier listing."""
        old, version = self.log.names(), uuid.uuid4().hex
        self.list_tree(self.spark, self.root).write.parquet(self._path(version))
        if not old:
            self.log.append("add", version)
            return None
        changed_paths(self.log.read(old[-1:]), self.log.read([version])).select(
            F.lit(tick).cast("long").alias("tick"), F.current_timestamp().alias("ts"), "path", "change").write.parquet(
            self._path(changes_of(version)))
        changes = self.log.read([changes_of(version)])
        if changes.isEmpty():
            for name in (version, changes_of(version)):
                remove_path(self.spark, self._path(name))
            return None
        self.log.append("add", version)
        if self.on_change:
            try:
                self.on_change(changes)
            except Exception as error:  # a failed refresh must not end the watch
                print(f"refresh failed: {error}")
        remove_path(self.spark, self._path(old[-1]))
        return changes

    def start(self, interval: str = "1 second") -> StreamingQuery:
        """Run ``step`` at every tick until the query is stopped; missed ticks coalesce."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return (ticks.writeStream.trigger(processingTime=interval)
                .option("checkpointLocation", self._path("checkpoint"))
                .foreachBatch(lambda _, tick: self.step(tick)).start())

    def events(self) -> DataFrame:
        names = self.log.names()[1:]
        return self.log.read([changes_of(n) for n in names]) if names else self.spark.createDataFrame([], EVENTS)

    def stream(self) -> DataFrame:
        """The changes as a stream of their own, for any number of readers."""
        self.spark.dataSource.register(TreeChanges)
        return self.spark.readStream.format("tree_changes").option("state", qualified(self.spark, self.state)).load()


def changes_of(version: str) -> str:
    return f"changes-{version}"


@dataclass
class ChangeFile(InputPartition):
    path: str


class ChangeReader(DataSourceStreamReader):
    """An offset is a number of versions in the log.  Versions never change, so
    the same two offsets give the same rows again after a restart."""

    def __init__(self, state: str):
        self.store, base = open_root(state)
        self.state, self.base = state, base.rstrip("/")

    def _files(self, folder: str, ending: str) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.base}/{folder}", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.startswith("part-") and f.base_name.endswith(ending))

    def _versions(self) -> list[str]:
        entries = []
        for path in self._files("log", ".json"):
            with self.store.open_input_stream(path) as stream:
                entries += [json.loads(line) for line in stream.read().splitlines() if line]
        return [e["name"] for e in sorted(entries, key=lambda e: e["seq"])]

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": len(self._versions())}

    def partitions(self, start: dict, end: dict) -> list[ChangeFile]:
        """The files of the versions between the offsets; the first version has no changes."""
        names = self._versions()[max(1, start["version"]):end["version"]]
        return [ChangeFile(path) for name in names for path in self._files(changes_of(name), ".parquet")]

    def read(self, partition: ChangeFile):
        with open_root(self.state)[0].open_input_file(partition.path) as file:
            for batch in parquet.ParquetFile(file).iter_batches():
                ts = batch.column("ts").cast(pa.timestamp("us", "UTC"))
                yield pa.record_batch([batch.column("tick"), ts, batch.column("path"), batch.column("change")], ["tick", "ts", "path", "change"])

    def __getstate__(self) -> dict:
        return {"state": self.state}

    def __setstate__(self, kept: dict) -> None:
        self.__init__(kept["state"])


class TreeChanges(DataSource):
    """``readStream.format("tree_changes")`` with option ``state``, the folder of a ``Watcher``."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["state"])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_state(key, batches, state):
    """Changes of one path: its newest (mtime, size) against the one kept from earlier batches; no size means the file went."""
    newest = None
    for batch in batches:
        for mtime, size in zip(batch["mtime"], batch["size"]):
            row = (getattr(mtime, "value", mtime), -1 if pd.isna(size) else int(size))
            newest = row if newest is None or row > newest else newest
    if newest[1] < 0:
        kind = "removed" if state.exists else None
        if state.exists:
            state.remove()
    else:
        kind = "added" if not state.exists else "changed" if tuple(state.get) != newest else None
        state.update(newest)
    if kind:
        yield pd.DataFrame({"path": [key[0]], "change": [kind]})


def state_changes(stream: DataFrame, output: str) -> StreamingQuery:
    """Append the changes of a stream of file states (path, mtime, size) to ``<output>/changes``.

    A row without size says that the file is gone; its state goes with it.
    Spark keeps the last state of every path that exists in its state store,
    on disk, so a batch costs what its own rows cost, not the size of the tree.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    changes = stream.groupBy("path").applyInPandasWithState(
        newest_state, "path string, change string", "mtime long, size long", "append", GroupStateTimeout.NoTimeout)
    return (changes.writeStream.trigger(availableNow=True).outputMode("append").format("parquet")
            .option("checkpointLocation", os.path.join(output, "checkpoint"))
            .start(os.path.join(output, "changes")))
