"""Detection on the stream: the batch detector's windows, followed with state by shards of keys.

Rows wait in their shard's state until the watermark has passed them, so they are taken in time order
whatever the order of files; a timer wakes the shard then. What stays is the last few times of a key,
and goes when no further row could join them in a window. A restart goes on from the checkpoint.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import network as net
from tidewatch.functions.clock import MICROS, from_micros, micros, window_micros

_KEY = "src_ip STRING, dst_ip STRING, dst_port INT"
_HITS = "key STRING, start BIGINT, last BIGINT, attempts BIGINT"
_STATE = "rows BINARY"
# A call of Python takes milliseconds, whatever it gets: keys are followed by shards, at most so many.
SHARDS = 1 << 14
# What a row in a shard's state tells: a time of a recent row, of one that waits, or only that its key has fired.
RECENT, WAITING, FIRED = 0, 1, 2


def brute_force(flows: DataFrame, failed_attempts: int = 5, window_s: float = 300, delay_s: float = 3600, shards: int = SHARDS) -> DataFrame:
    """A stream of what ``detectors.brute_force`` finds (without event ids) in a stream of flows.

    An alert comes once rows ``delay_s`` later have been seen. Rows that are later than that are not
    looked at; ``late_rows`` sets them aside. A key fires once, as in a batch. A shard's state is
    rewritten when one of its keys has new rows, so more ``shards`` suit many small batches.
    """
    width, least = window_micros(window_s), failed_attempts
    recent_kind, waiting_kind, fired_kind = RECENT, WAITING, FIRED

    def packed(keys: np.ndarray, t: np.ndarray, kind: np.ndarray) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(t, pa.int64()), pa.array(kind, pa.int8())], ["key", "t", "kind"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def follow(shard: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The watermark is 0 until a batch has set it.
        passed = state.getCurrentWatermarkMs() * 1000 or -(1 << 62)
        texts, t, kind = [np.array([], object)], [np.array([], np.int64)], [np.array([], np.int8)]
        if state.exists:
            stored = pa.ipc.open_stream(state.get[0]).read_all()
            texts, t, kind = ([stored.column(i).to_numpy()] for i in range(3))
        if not state.hasTimedOut:
            for frame in frames:
                came = frame["t"].to_numpy()
                texts.append(frame["key"].to_numpy(object)[came > passed])
                t.append(came[came > passed])
                kind.append(np.full(len(t[-1]), waiting_kind, np.int8))
        t, kind = np.concatenate(t), np.concatenate(kind)
        code, keys = pd.factorize(np.concatenate(texts))
        fired = np.zeros(len(keys), bool)
        fired[code[kind == fired_kind]] = True
        # Rows by key and time; the recent ones come before those that wait.
        live = np.flatnonzero(~fired[code])
        live = live[np.lexsort((t[live], code[live]))]
        code, t = code[live], t[live]
        due = t <= passed
        own, times = code[due], t[due]
        # The row that is the last of ``least`` of its key within the window; a key's first counts.
        most = max(0, len(times) - least + 1)
        hits = np.flatnonzero((own[least - 1 :][:most] == own[:most]) & (times[least - 1 :][:most] - times[:most] <= width))
        hits = hits[np.unique(own[hits], return_index=True)[1]]
        if len(hits):
            fired[own[hits]] = True
            yield pd.DataFrame({"key": keys[own[hits]], "start": times[hits], "last": times[hits + least - 1], "attempts": least})
        behind = np.searchsorted(own, own, side="right") - 1 - np.arange(len(own))
        recent = (behind < least - 1) & (times >= passed - width) & ~fired[own]
        waiting = ~due & ~fired[code]
        codes = np.concatenate((np.flatnonzero(fired), own[recent], code[waiting]))
        if not len(codes):
            state.remove()
            return
        counts = int(fired.sum()), int(recent.sum()), int(waiting.sum())
        moments = np.concatenate((np.zeros(counts[0], np.int64), times[recent], t[waiting]))
        state.update((packed(keys[codes], moments, np.repeat([fired_kind, recent_kind, waiting_kind], counts)),))
        # The first row that waits, or the end of the last window that a new row could join.
        last = recent & (behind == 0) & ~np.isin(own, code[waiting])
        wakes = np.concatenate((t[waiting], times[last] + width))
        if len(wakes):
            state.setTimeoutTimestamp(max(int(wakes.min()), passed, 0) // 1000 + 1)

    timed = flows.withColumn("t", micros(F.col("ts"))).withColumn("_time", F.timestamp_micros("t"))
    # All rows move the watermark, not only those of failed logins: a filter that names the time is not pushed below it.
    failed = timed.withWatermark("_time", f"{round(delay_s * 1000)} milliseconds").where(F.when(F.col("_time").isNotNull(), net.is_login_failure()))
    # The key as text, in which a null is left out.
    keyed = failed.select(F.to_json(F.struct("src_ip", "dst_ip", "dst_port")).alias("key"), "t", "_time")
    hits = keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandasWithState(
        follow, _HITS, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return hits.withColumn("_key", F.from_json("key", _KEY)).select("_key.*", "start", "last", "attempts").select(
        from_micros("start").alias("ts"), "src_ip", "dst_ip", "dst_port", "attempts", from_micros("last").alias("last_ts"),
        ((F.col("last") - F.col("start")) / MICROS).alias("span_seconds"), net.login_service(F.col("dst_port")).alias("service"),
    )


def late_rows(output: str, delay_s: float):
    """A function for ``foreachBatch`` that writes rows more than ``delay_s`` older than the latest of the batches
    before to ``output``/late. Each batch leaves its latest time, so a repeated batch gives the same rows.
    """
    delay = window_micros(delay_s)

    def write(batch: DataFrame, number: int) -> None:
        spark, t = batch.sparkSession, micros(F.col("ts"))
        newest = None
        if number:
            newest = spark.read.schema("t BIGINT, batch BIGINT").parquet(f"{output}/latest").where(F.col("batch") < number).agg(F.max("t")).first()[0]
        late = F.lit(False) if newest is None else t <= F.lit(newest // 1000 * 1000 - delay)
        batch.where(late).write.mode("overwrite").parquet(f"{output}/late/batch={number}")
        batch.agg(F.max(t).alias("t")).write.mode("overwrite").parquet(f"{output}/latest/batch={number}")

    return write
