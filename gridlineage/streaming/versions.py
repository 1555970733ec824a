"""A stream of workbook versions: each arriving file is read, and compared to the version before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlineage.sources.xlsx import SCHEMAS, Workbook


def arriving(spark: SparkSession, path: str, part: str = "cells") -> DataFrame:
    """Rows of workbooks as they arrive under path: (workbook, modified, part columns)."""
    schema = SCHEMAS[part]
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xls[xm]").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["workbook", "modified", *(c.split()[0] for c in schema.split(", "))]
        for b in batches:
            for p, m, content in zip(b["path"], b["modificationTime"], b["content"]):
                yield pd.DataFrame([(p, m, *r) for r in Workbook(content).part(part)], columns=names)

    return files.select("path", "modificationTime", "content").mapInPandas(run, "workbook string, modified timestamp, " + schema)


class LastValue(StatefulProcessor):
    """Emits (key, at, old, new) for each change of a key's value; state: the last value and its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, v string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        out = []
        for at, v in sorted((pd.concat(list(rows))[["at", "v"]]).itertuples(index=False, name=None), key=lambda r: (r[0], r[1] or "")):
            if held is None or (at >= held[0] and v != held[1]):
                out.append((key[0], at, None if held is None else held[1], v))
            if held is None or at >= held[0]:
                held = (at, v)
        self.last.update(held)
        yield pd.DataFrame(out, columns=["key", "at", "old", "new"])

    def close(self) -> None:
        pass


def changes(values: DataFrame, late: str = "1 hour") -> DataFrame:
    """Changes of a stream of values (key, at, v) by key; rows later than the watermark are dropped by Spark."""
    return values.withWatermark("at", late).groupBy("key").transformWithStateInPandas(LastValue(), "key string, at timestamp, old string, new string", "Append", "None")


def counts(values: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Values by key and tumbling window of their time, with a watermark for late ones."""
    return values.withWatermark("at", late).groupBy(F.window("at", window), "key").agg(F.count("*").alias("n"), F.max("v").alias("v")).select(F.col("window.start").alias("start"), "key", "n", "v")


def run_each(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the stream; each batch goes to f once it's complete, exactly once a checkpoint."""
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
