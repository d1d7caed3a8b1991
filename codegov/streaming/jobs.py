"""Streaming forms of the ledger fold and of churn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def fold_stream(events: DataFrame, key: str = "fingerprint", order: str = "ord") -> DataFrame:
    """The latest event of each key, as files arrive; an event that comes late but was earlier loses to max_by."""
    rest = [c for c in events.columns if c != key]
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("latest"))


def churn_stream(changes: DataFrame, window: str = "90 days", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Counts per path in tumbling or sliding windows; changes later than the watermark are dropped."""
    span = F.window("date", window, slide) if slide else F.window("date", window)
    return changes.withWatermark("date", late).groupBy(span.alias("w"), "path").agg(F.count(F.lit(1)).alias("count"))


def _packed(**columns) -> bytes:
    """Columns as one compressed value of state."""
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value) -> dict[str, np.ndarray]:
    with pa.ipc.open_stream(pa.py_buffer(bytes(value))) as found:
        table = found.read_all()
    return {c: table[c].to_numpy() for c in table.column_names}


class _Latest(StatefulProcessor):
    """The places of the latest events of a bucket's findings, their open baselines, and a timer at the end of the first of these."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "rows binary")  # fingerprint, ord
        self.open = handle.getValueState("open", "rows binary, timer long")  # fingerprint, ord, until; -1 without a timer

    def _rows(self, what: str, fingerprint, ord_, type_) -> pd.DataFrame:
        return pd.DataFrame({"fingerprint": fingerprint, "what": what, "ord": ord_, "type": type_})

    def _open(self) -> tuple[dict[str, np.ndarray], int]:
        held = self.open.get()
        return (_unpacked(held[0]), held[1]) if held is not None else ({"fingerprint": np.array([], object), "ord": np.array([], "int64"), "until": np.array([], "int64")}, -1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:  # of equal places the first row counts
            part = part[["fingerprint", "ord", "type", "until"]]
            part = part if best is None else pd.concat([best, part], ignore_index=True)
            best = part.loc[part.groupby("fingerprint", sort=False)["ord"].idxmax()].reset_index(drop=True)
        if best is None:
            return
        found = self.latest.get()
        held = _unpacked(found[0]) if found is not None else {"fingerprint": np.array([], object), "ord": np.array([], "int64")}
        at = pd.Index(held["fingerprint"], dtype=object).get_indexer(best["fingerprint"])
        ords = np.append(held["ord"], np.int64(0)).astype("int64")  # the last one is for findings that aren't held
        moved = (at < 0) | (best["ord"].to_numpy("int64") > ords[at])
        best, at = best[moved], at[moved]
        if best.empty:
            return
        ords[at[at >= 0]] = best["ord"].to_numpy("int64")[at >= 0]
        new = best[at < 0]
        self.latest.update((_packed(fingerprint=pa.array(np.concatenate([held["fingerprint"], new["fingerprint"]]), pa.string()), ord=np.concatenate([ords[:-1], new["ord"].to_numpy("int64")])),))
        yield self._rows("latest", best["fingerprint"], best["ord"], best["type"])
        ends = best[(best["type"] == "baselined") & (best["until"] >= 0)]
        past = ends["until"] <= timerValues.getCurrentWatermarkInMs()
        self._wait(best["fingerprint"], ends[~past])
        if past.any():
            yield self._rows("expired", ends["fingerprint"][past], ends["ord"][past], ends["type"][past])

    def _wait(self, gone, more: pd.DataFrame) -> None:
        """Open baselines without those of the findings ``gone`` and with ``more``; the timer only moves to an earlier end, since one that comes too early finds nothing."""
        held, timer = self._open()
        keep = ~pd.Index(held["fingerprint"], dtype=object).isin(gone)
        if keep.all() and more.empty:
            return
        if not more.empty and (timer < 0 or more["until"].min() < timer):
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = int(more["until"].min())
            self.handle.registerTimer(timer)
        self._hold({c: np.concatenate([held[c][keep], more[c].to_numpy(held[c].dtype)]) for c in held}, timer)

    def _hold(self, rows: dict[str, np.ndarray], timer: int) -> None:
        self.open.update((_packed(fingerprint=pa.array(rows["fingerprint"], pa.string()), ord=rows["ord"], until=rows["until"]), timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._open()
        past = held["until"] <= timerValues.getCurrentWatermarkInMs()
        left = {c: v[~past] for c, v in held.items()}
        timer = int(left["until"].min()) if len(left["until"]) else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        self._hold(left, timer)
        if past.any():
            yield self._rows("expired", held["fingerprint"][past], held["ord"][past], "baselined")

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, late: str = "30 days", buckets: int = 1024) -> DataFrame:
    """(fingerprint, what, ord, type) in update mode: a row when a finding's latest event changes, and one when a baseline ends.

    ``events``: (fingerprint, ord, type, expires_at, timestamp), in any order within the watermark. Findings are dealt to
    ``buckets``, whose rows are read and written together, since a call of Python for each finding takes longer than all
    else; a batch touches the buckets and reports the findings that it changes. A checkpoint keeps its number of buckets.
    Needs a state store that keeps columns, such as RocksDB.
    """
    rows = events.where(F.col("fingerprint").isNotNull()).withWatermark("timestamp", late)
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select(bucket, "fingerprint", "ord", "type", F.coalesce(F.unix_millis("expires_at"), F.lit(-1)).alias("until"), "timestamp")
    return rows.groupBy("bucket").transformWithStateInPandas(_Latest(), "fingerprint string, what string, ord long, type string", "Update", "EventTime")
