"""Structured Streaming forms of append-only jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def enrich_new_files(
    source: DataFrame, key: str, enrich: Callable[[DataFrame], tuple], good: str, bad: str, checkpoint: str, time: str | None = None, late: str = "7 days"
) -> StreamingQuery:
    """Each key of the stream once; successes and failures appended to two tables.

    With a ``time`` column keys are held for ``late`` only; without one the state holds every key there ever was.
    A batch that runs again after a failure writes under its own number, so nothing is doubled.
    """

    def both(batch: DataFrame, number: int) -> None:
        done, failed, *_ = enrich(batch)
        done.write.mode("overwrite").parquet(f"{good}/batch={number}")
        failed.write.mode("overwrite").parquet(f"{bad}/batch={number}")

    once = source.dropDuplicates([key]) if time is None else source.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str, late: str) -> DataFrame:
    """Start, the columns of ``by``, n: events of each window; on a stream, rows later than ``late`` are dropped."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, size).alias("_w"), *by).agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("start"), *by, "n")
    )


def latest(updates: DataFrame, keys: list[str], batch: str, values: list[str]) -> DataFrame:
    """The last update of each key."""
    return updates.groupBy(*keys).agg(*(F.max_by(v, batch).alias(v) for v in values))


def write_updates(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch's updates appended with its number; ``latest`` reads them."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return result.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after(left: int, goals: int) -> int:
    """One step of the open-goal count: see ``traces.open_goals``."""
    return left - (goals == 0) if left < 1 else left + goals - 1


def all_after(left: np.ndarray, who: np.ndarray, goals: np.ndarray) -> np.ndarray:
    """``after`` over all rows: ``left`` of each number in ``who``, whose rows stand together in rising order.

    Until a count first falls below one it is a running sum; from there on it loses one for each row without goals.
    """
    at = np.arange(len(left))
    first, end = np.searchsorted(who, at, "left"), np.searchsorted(who, at, "right")
    total, zeros = np.r_[0, np.cumsum(goals - 1)], np.r_[0, np.cumsum(goals == 0)]
    walk = left[who] + total[1:] - total[first][who]
    low = np.flatnonzero(walk < 1)
    fallen, where = np.unique(who[low], return_index=True)
    out = left + total[end] - total[first]
    out[fallen] = walk[low[where]] - (zeros[end[fallen]] - zeros[low[where] + 1])
    return np.where(left < 1, left - (zeros[end] - zeros[first]), out)


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def live_open_goals(events: DataFrame, key: str, order: str, goals: Column, time: str, late: str, buckets: int = 1024) -> DataFrame:
    """Key, left_open after each batch that has events of the key: the count over all its events so far, by ``order``.

    ``order`` rises with ``time``. Events may come in any order, up to ``late`` behind the latest: these are kept in the stream's state and
    counted again; what the watermark has passed is settled as one number. Without a watermark's progress nothing is lost, state only grows.
    Keys are counted a bucket of them at a time, ``buckets`` in all: a stream keeps to the number that it started with. A batch rewrites the
    state of the buckets that it has events of: take more for small batches over many keys.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches), ignore_index=True)
        kept, waiting = (_unpacked(x) for x in state.get) if state.exists else (pd.DataFrame({key: new[key].iloc[:0], "left": np.zeros(0, np.int64)}), None)
        who, keys = pd.factorize(pd.concat([kept[key], new[key]], ignore_index=True), use_na_sentinel=False)
        who = who[len(kept) :]
        rows = pd.DataFrame({"who": who, order: new[order].astype(np.int64), "ms": new["_ms"].astype(np.int64), "goals": new["goals"].astype(np.int64)})
        rows = pd.concat([waiting, rows], ignore_index=True).sort_values(["who", order, "ms", "goals"], ignore_index=True)
        left = np.r_[kept["left"].to_numpy(), np.ones(len(keys) - len(kept), np.int64)]
        # settled: what stands before the first row of its key that the watermark has not passed
        ends, open_ = rows["who"].to_numpy(), (rows["ms"] >= state.getCurrentWatermarkMs()).to_numpy()
        so_far = np.r_[0, np.cumsum(open_)]
        settled = so_far[1:] == so_far[np.searchsorted(ends, ends, "left")]
        left = all_after(left, ends[settled], rows["goals"].to_numpy()[settled])
        rows = rows[~settled]
        state.update((_packed(pd.DataFrame({key: keys, "left": left})), _packed(rows)))
        seen = np.unique(who)
        yield pd.DataFrame({key: keys[seen], "left_open": all_after(left, rows["who"].to_numpy(), rows["goals"].to_numpy())[seen]})

    kind = dict(events.dtypes)[key]
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))  # keys of a bucket are all null or none
    rows = events.withWatermark(time, late).select(bucket.alias("_bucket"), key, F.col(order).cast("long").alias(order), F.col(time), F.unix_millis(time).alias("_ms"), goals.cast("long").alias("goals"))
    return rows.groupBy("_bucket").applyInPandasWithState(step, f"{key} {kind}, left_open long", "kept binary, waiting binary", "update", "EventTimeTimeout")
