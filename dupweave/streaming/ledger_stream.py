"""The session ledger and the checks as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.index import DuplicateIndex


def first_seen_stream(warnings: DataFrame) -> DataFrame:
    """The ledger over a stream of (session, seq, is_clear, key): state is a session's epoch and the keys seen in it.

    Rows of a micro-batch count in order of seq. A clearing empties the state, as keys are only held within an epoch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, seen = state.get if state.exists else (0, [])
        rows = pd.concat(frames).sort_values("seq", kind="stable")
        rows["epoch"] = epoch + rows["is_clear"].astype("int64").cumsum()
        told = rows[~rows["is_clear"].astype(bool)].drop_duplicates(["epoch", "key"])
        new = told[~((told["epoch"] == epoch) & told["key"].isin(seen))]
        last = int(rows["epoch"].iloc[-1]) if len(rows) else epoch
        state.update((last, sorted({*new.loc[new["epoch"] == last, "key"], *(seen if last == epoch else [])})))
        yield new[["session", "seq", "key", "epoch"]]

    session = warnings.schema["session"].dataType.simpleString()
    return warnings.groupBy("session").applyInPandasWithState(step, f"session {session}, seq long, key string, epoch long", "epoch long, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def warning_stream(edits: DataFrame, index: DuplicateIndex, files: DataFrame, sink: str, checkpoint: str, told: str) -> StreamingQuery:
    """A stream of edits to what their sessions are told, as Parquet in `sink`, one folder for each batch.

    `told` is a folder of the keys that sessions were told, one part for each batch; a batch that runs again reads the parts
    of earlier batches only, and overwrites its own.
    """
    from ..plans import warnings

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        spark = batch.sparkSession
        session = batch.schema["session"].dataType.simpleString()
        schema = f"session {session}, key string, batch int"
        known = spark.read.schema(schema).parquet(told).filter(F.col("batch") < number) if number else spark.createDataFrame([], schema)
        found = warnings.new_matches(held, index.tokens, None, index.options.min_tokens, index.options.min_lines)
        new = found.join(known.select("session", "key").distinct(), ["session", "key"], "left_anti").persist()
        new.select("session", "key").write.mode("overwrite").parquet(f"{told}/batch={number}")
        warnings.reported(new, held, files, index.options.reminder_mode).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        new.unpersist()
        held.unpersist()

    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_stream(edits: DataFrame, index: DuplicateIndex, sink: str, checkpoint: str) -> StreamingQuery:
    """Check a stream of edits (plans.index.EDIT) in order; matches go to `sink` as Parquet, one folder for each batch.

    A batch that runs again after a failure overwrites its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        index.check_in_order(held).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        held.unpersist()

    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
