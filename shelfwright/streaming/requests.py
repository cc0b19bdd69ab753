"""Structured Streaming forms of the request operators."""

from __future__ import annotations

import bisect
import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import Catalog

def windowed_counts(log: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests by ip, endpoint and sliding window; late rows are taken up to the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "ip", "endpoint").agg(F.count("*").alias("requests"))


def collapse_duplicates(log: DataFrame, gap: str = "10 seconds") -> DataFrame:
    """The first of equal queries within the gap."""
    keyed = log.withColumn("query_key", F.lower(F.trim("query")))
    return keyed.withWatermark("ts", gap).dropDuplicatesWithinWatermark(["query_key"])


def errors_only(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") >= 400)


def apply_blocks(log: DataFrame, blocks: DataFrame, hold: str = "3600 seconds", late: str = "2 minutes") -> DataFrame:
    """The requests of log(ip, ts, ...) that come while a block of their ip (ts) holds; both sides' state goes with the watermark."""
    left = log.withWatermark("ts", late)
    right = blocks.select(F.col("ip").alias("_ip"), F.col("ts").alias("_from")).withWatermark("_from", late)
    held = F.expr(f"ip = _ip AND ts >= _from AND ts <= _from + INTERVAL {hold}")
    return left.join(right, held, "left_semi")


STREAK = "source string, page long, streak long, dead boolean"


def empty_streaks(crawl: DataFrame, limit: int = 5, most: int = 3600) -> DataFrame:
    """Each page of crawl(source, page, items, more) with how many empty ones precede and include it, and whether its source's chain is dead.

    Pages of a source come in order of page within a batch; the streak lives in state between batches. Dead:
    `limit` empty pages in a row, no more pages told of, or the last page allowed.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(parts).sort_values("page")
        out = []
        for page, items, more in zip(rows["page"], rows["items"], rows["more"], strict=True):
            streak = 0 if items else streak + 1
            out.append((key[0], page, streak, bool(streak >= limit or not more or page >= most)))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["source", "page", "streak", "dead"])

    return crawl.groupBy("source").applyInPandasWithState(step, STREAK, "streak long", "append", GroupStateTimeout.NoTimeout)


def query_sessions(log: DataFrame, gap: str = "30 days", late: str = "2 minutes") -> DataFrame:
    """Each lower-cased, trimmed query's hits until it went unasked for the gap; given, and forgotten, once the gap has passed."""
    keyed = log.select(F.lower(F.trim("query")).alias("query"), "ts").withWatermark("ts", late)
    found = keyed.groupBy("query", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.drop("w")


class Held(StatefulProcessor):
    """Rows of a key are held until the watermark has passed their time, then taken in order: a late one still comes at its place.

    The subclass says what is held beside a row's time in microseconds (`columns`), what stays between turns
    (`memory`), and what rows that are due give: due(key, rows, memory) -> (rows out, memory, time to forget at).
    """

    columns: list[tuple[str, str]] = []
    memory = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["at long", *(f"{c} {t}" for c, t in self.columns)]))
        self.kept = handle.getValueState("kept", self.memory)

    def due(self, key: tuple, rows: list[tuple], memory: tuple | None) -> tuple[pd.DataFrame, tuple | None, int | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [x for part in rows for x in part[["at", *(c for c, _ in self.columns)]].itertuples(index=False, name=None)]
        came = [tuple(None if v != v else v for v in map(_plain, x)) for x in came]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(x[0] for x in came) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready, later = [x for x in held if x[0] // 1000 < now], [x for x in held if x[0] // 1000 >= now]
        out, memory, forget = self.due(key, sorted(ready, key=_order), tuple(self.kept.get()) if self.kept.exists() else None)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(x[0] for x in later) // 1000 + 1)
        else:
            self.waiting.clear()
        if memory is None or (forget is not None and forget <= now and not later):
            self.kept.clear()
        else:
            self.kept.update(memory)
            if forget is not None and forget > now:
                self.handle.registerTimer(forget)
        return iter([out] if len(out) else [])

    def close(self) -> None:
        pass


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def _order(row: tuple) -> tuple:
    return tuple((v is not None, v) for v in row)


class _Limits(Held):
    columns, memory = [("request", "long")], "times array<long>"

    def __init__(self, most: int, seconds: int):
        self.most, self.window = most, seconds * 1_000_000

    def due(self, key, rows, memory):
        times = list(memory[0]) if memory else []
        mine = times + [x[0] for x in rows]  # in order: what was due before is earlier
        found, low = [], 0
        for at, request in rows:
            while mine[low] < at - self.window:
                low += 1
            n = bisect.bisect_right(mine, at) - low
            found.append((*key, request, n, n > self.most))
        last = mine[-1] if mine else 0
        left = [t for t in mine if t >= last - self.window]
        return pd.DataFrame(found, columns=["ip", "endpoint", "request", "in_window", "limited"]), (left,), (last + self.window) // 1000 + 1


def _stateful(rows: DataFrame, late: str, keys: list[str], processor: Held, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def rate_limits(log: DataFrame, most: int, seconds: int, late: str = "2 minutes") -> DataFrame:
    """An answer for each request of log(request, ip, endpoint, ts): how many its ip made on its endpoint in the window that ends with it, and whether that is too many.

    A request is answered once the watermark has passed it, so late ones count as in rate_limit_audit. The state
    of an ip is the times of one window, and goes when it has made none for that long.
    """
    return _stateful(log, late, ["ip", "endpoint"], _Limits(most, seconds), "ip string, endpoint string, request long, in_window long, limited boolean")


class _Streaks(Held):
    columns, memory = [("page", "long"), ("items", "long"), ("more", "boolean")], "streak long"

    def __init__(self, limit: int, most: int, hold_ms: int):
        self.limit, self.most, self.hold = limit, most, hold_ms

    def due(self, key, rows, memory):
        streak, found = memory[0] if memory else 0, []
        for _, page, items, more in rows:
            streak = 0 if items else streak + 1
            found.append((key[0], page, streak, bool(streak >= self.limit or more is False or page >= self.most)))
        forget = rows[-1][0] // 1000 + self.hold if rows else 0
        return pd.DataFrame(found, columns=["source", "page", "streak", "dead"]), (streak,), forget


def ordered_streaks(crawl: DataFrame, limit: int = 5, most: int = 3600, late: str = "10 minutes", hold_hours: int = 24) -> DataFrame:
    """empty_streaks of crawl(source, page, ts, items, more) in order of time, whatever the order of files: a page waits until the watermark has passed it. A source that tells of no page for hold_hours begins anew."""
    return _stateful(crawl, late, ["source"], _Streaks(limit, most, hold_hours * 3_600_000), STREAK)


def catalog_merge(catalog: Catalog, now: datetime.datetime) -> Callable[[DataFrame, int], None]:
    """merge(batch, id) for run_sync_stream: upserts a batch into the stored catalog, of which only the buckets that it touches are written.

    A batch that is run again changes nothing that it has committed before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        catalog.upsert(batch, now, number)

    return merge


def run_sync_stream(records: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Feeds each micro-batch of records to merge(batch, id); the batch id makes the merge repeatable."""
    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
