"""Change streams: debounce, coalescing, rate limits, sessions. Each function serves batch and stream alike unless it says so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, begin, end, n): events of a key closer than `gap` to each other. In a stream, give a watermark first."""
    grouped = events.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def debounced(events: DataFrame, key: str, at: str, quiet: str = "2 seconds", most_seconds: float = 5) -> DataFrame:
    """(key, flush, n): a flush when a key is quiet, and every `most_seconds` from the first event of a burst on."""
    burst = sessions(events, key, at, quiet)
    length = (F.unix_micros("end") - F.unix_micros("begin")) / 1_000_000
    return burst.select(key, "begin", "n", F.greatest(F.lit(1), F.ceil(length / most_seconds)).cast("int").alias("flushes"))


def last_operation(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The newest operation of each key; a partial maximum on each side of the exchange."""
    best = events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return best.select(key, *(F.col(f"v.{c}").alias(c) for c in values))


def allowed(events: DataFrame, key: str, at: str, event: str, most: int, seconds: int) -> DataFrame:
    """(event, allowed): whether fewer than `most` events of the key were let in during the last `seconds`. Refused events
    don't count, and neither does one exactly `seconds` ago. Batch: a fold over each key in order of time, which holds
    `most` times of one key, however many events it has."""
    dealt = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(at).alias("t"), event).repartition("key").sortWithinPartitions("key", "t", event)

    def fold(batches):
        last, taken = object(), []
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["t"], strict=True):
                if k != last:
                    last, taken = k, []
                taken = [x for x in taken if x > t - seconds * 1_000_000]
                out.append(len(taken) < most)
                if out[-1]:
                    taken.append(t)
            yield batch[[event]].assign(allowed=out)

    return dealt.mapInPandas(fold, f"{event} {dict(events.dtypes)[event]}, allowed boolean")


def apply_changes(current: DataFrame, batch: DataFrame, key: str, order: list[str], operation: str) -> DataFrame:
    """Current rows after a batch: deletes first, then upserts; of several operations on a key the newest counts."""
    columns = current.columns
    newest = last_operation(batch, key, order, [c for c in columns if c != key] + [operation])
    kept = current.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest.where(F.col(operation) != "delete").select(columns))


def run_upserts(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, order: list[str], operation: str, checkpoint: str):
    """A stream that keeps a table current: each micro-batch is coalesced and applied; batch ids make a redo harmless."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        write(apply_changes(read(), batch, key, order, operation), batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_or_dead_letter(failed: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows (…, attempts) to try again with one attempt more, and those that go to the dead letters."""
    tried = failed.withColumn("attempts", F.col("attempts") + 1)
    return tried.where(F.col("attempts") < most), tried.where(F.col("attempts") >= most)


def windowed_counts(stream: DataFrame, at: str, key: str, size: str, late: str) -> DataFrame:
    """Event-time windows with a watermark; zone-less timestamps become timestamps first."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), key, "n")
