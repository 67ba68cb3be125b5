"""The folds of operators.state over streams of log files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def latest_stream(log: DataFrame, key: str, order: str) -> DataFrame:
    """Running latest row of each key: by order, not by arrival, so late rows change nothing that is newer."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def windowed_counts(log: DataFrame, time: str, every: str = "1 day", late: str = "2 days", *by: str) -> DataFrame:
    return log.withWatermark(time, late).groupBy(F.window(time, every), *by).count()


def append_once_stream(log: DataFrame, folder: str, checkpoint: str, key: list[str]):
    """Appends rows whose key did not come before. Keys are held in the stream's state; each micro-batch has a folder of its own, which a batch that is
    run again replaces, so nothing is read back. Give log a watermark to bound the state.
    """

    def of(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return log.dropDuplicates(key).writeStream.foreachBatch(of).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streak_stream(log: DataFrame, key: str, order: str, state: str, failed: list[str]) -> DataFrame:
    """(key, order, state, streak, failures) after each micro-batch, of the keys that it holds: how many rows up to the latest hold its state, and how many failed.
    A row that is not later than the last one of its key is left out, so a batch that comes again changes nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{state}` string, streak bigint, failures bigint"

    def fold(name, parts, held: GroupState):
        last, now, streak, failures = held.get if held.exists else (None, None, 0, 0)
        rows = pd.concat([p[[order, state]] for p in parts]).drop_duplicates(order).sort_values(order)
        for o, s in rows.itertuples(index=False):
            if last is not None and o <= last:
                continue
            streak = streak + 1 if s == now else 1
            failures = failures + 1 if s in failed else 0
            last, now = int(o), s
        held.update((last, now, streak, failures))
        yield pd.DataFrame({key: [name[0]], order: [last], state: [now], "streak": [streak], "failures": [failures]})

    rows = log.select(key, F.col(order).cast("bigint").alias(order), F.col(state).cast("string").alias(state))
    schema = schema.replace(f"`{order}` {kinds[order]}", f"`{order}` bigint")
    return rows.groupBy(key).applyInPandasWithState(fold, schema, "last bigint, now string, streak bigint, failures bigint", "update", GroupStateTimeout.NoTimeout)
