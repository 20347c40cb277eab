"""State of one's own with event-time timers: what became of each click.

A click waits WAIT for a purchase of its user. Once the watermark has passed the
end of the minute in which the wait is over, it is told once: with the first
purchase in that time, or none. Rows may come in any order within the
watermark's delay; nothing is decided before all that could matter has come.

Users are dealt into shards by a hash, which are the keys of the state, so that a
call to the state store or a timer serves many users at once. A shard's state is
kept by hours: clicks by the hour in which their wait ends, purchases by their
own. A timer at the first such end reads the hours that are over, and removes what
is decided and what can't matter any more, so a shard without rows for an hour, WAIT
and the delay has no state, and a busy one's is never read as a whole. A user that
is null is nobody's: such clicks are told without a purchase.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.plans.registry import query

from .events import DELAY, appended, events

#: Microseconds.
MINUTE = 60_000_000
#: Minutes that a click waits, and those of a part of the state.
WAIT, HOUR = 30, 60
#: Keys of the state, and so the most tasks; a stream that goes on from its checkpoint must keep it.
SHARDS = 128
#: Rows that are gathered before they go to the state.
GATHERED = 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "user_id long, click_id long, purchase_id long"


def first_purchases(clicks: np.ndarray, bought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first purchase of each click's user within WAIT, and whether there is one; rows are user, id, time."""
    if not len(bought):
        return np.zeros(len(clicks), np.int64), np.zeros(len(clicks), bool)
    bought = bought[np.lexsort((bought[:, 1], bought[:, 2], bought[:, 0]))]
    begins = np.searchsorted(bought[:, 0], clicks[:, 0], "left")
    ends = np.searchsorted(bought[:, 0], clicks[:, 0], "right")
    while (some := begins < ends).any():  # all clicks are looked up at once, each among its user's purchases
        middle = (begins + ends) // 2
        before = some & (bought[np.minimum(middle, len(bought) - 1), 2] < clicks[:, 2])
        begins, ends = np.where(before, middle + 1, begins), np.where(some & ~before, middle, ends)
    at = np.minimum(begins, len(bought) - 1)
    met = (bought[at, 0] == clicks[:, 0]) & (bought[at, 2] >= clicks[:, 2]) & (bought[at, 2] <= clicks[:, 2] + WAIT * MINUTE)
    return bought[at, 1], met


class Outcomes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clicks, self.purchases = (handle.getMapState(name, "hour long", "rows binary") for name in ("clicks", "purchases"))

    def _read(self, state: Any, hour: int) -> np.ndarray:
        return np.frombuffer(bytes(state.getValue((hour,))[0]), np.int64).reshape(-1, 3)

    def _add(self, rows: np.ndarray, bought: bool) -> None:
        state, ends = self.purchases if bought else self.clicks, rows[:, 2] // MINUTE + (0 if bought else WAIT + 1)
        there, hours = {h for (h,) in state.keys()}, ends // HOUR
        order = np.argsort(hours, kind="stable")
        some, starts = np.unique(hours[order], return_index=True)
        for hour, own in zip(some.tolist(), np.split(rows[order], starts[1:]), strict=True):
            state.updateValue((hour,), ((self._read(state, hour).tobytes() if hour in there else b"") + own.tobytes(),))
        self._wake((some[0] + 1) * HOUR + WAIT if bought else ends.min())

    def _wake(self, minute: int) -> None:
        self.handle.registerTimer(int(minute) * MINUTE // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: dict[bool, list[np.ndarray]] = {False: [], True: []}
        for batch in rows:
            own, bought = batch[["user_id", "event_id", "micros"]].to_numpy(np.int64), (batch["event_type"] == "purchase").to_numpy()
            for kind, some in new.items():
                some.append(own[bought == kind])
                if sum(map(len, some)) > GATHERED:
                    self._add(np.concatenate(some), kind)
                    some.clear()
        for kind, some in new.items():
            if sum(map(len, some)):
                self._add(np.concatenate(some), kind)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000 // MINUTE
        clicks, purchases = (sorted(h for (h,) in state.keys()) for state in (self.clicks, self.purchases))
        bought: dict[int, np.ndarray] = {}
        for hour in clicks:
            if hour * HOUR > now:
                self._wake(hour * HOUR)
                break
            rows = self._read(self.clicks, hour)
            ends = rows[:, 2] // MINUTE + WAIT + 1
            over = ends <= now
            if over.any():
                some = rows[over]
                bought = {h: bought[h] if h in bought else self._read(self.purchases, h) for h in (hour - 1, hour) if h in purchases}
                ids, met = first_purchases(some, np.concatenate([np.zeros((0, 3), np.int64), *bought.values()]))
                users = some[:, 0] if key[0] >= 0 else pd.array([None] * len(some), "Int64")
                yield pd.DataFrame({"user_id": users, "click_id": some[:, 1], "purchase_id": pd.arrays.IntegerArray(ids, ~met)})
            if over.all():
                self.clicks.removeKey((hour,))
            else:
                if over.any():
                    self.clicks.updateValue((hour,), (rows[~over].tobytes(),))
                self._wake(ends[~over].min())
                break
        for hour in purchases:
            if (hour + 1) * HOUR + WAIT > now:
                self._wake((hour + 1) * HOUR + WAIT)
                break
            self.purchases.removeKey((hour,))


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Own state needs the state store on RocksDB; the session's choice is put back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def outcomes(stream: DataFrame) -> DataFrame:
    """event_id, at (a timestamp), user_id, event_type -> user_id, click_id, purchase_id (null if none came), in append mode."""
    some = stream.where("at is not null and (event_type = 'click' or event_type = 'purchase' and user_id is not null)").withWatermark("at", DELAY)
    shard = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(SHARDS))).cast("int")
    some = some.select("event_id", "at", F.unix_micros("at").alias("micros"), F.coalesce("user_id", F.lit(0)).alias("user_id"), "event_type", shard.alias("shard"))
    return some.groupBy("shard").transformWithStateInPandas(Outcomes(), SCHEMA, "append", "eventTime")


@query("""SELECT c.user_id, c.event_id AS click_id, (SELECT arg_min(p.event_id, (p.ts, p.event_id)) FROM events p
  WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 30 MINUTE) AS purchase_id
FROM events c WHERE c.event_type = 'click'
AND date_trunc('minute', c.ts + INTERVAL 30 MINUTE) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events WHERE event_type IN ('click', 'purchase')) - INTERVAL 10 MINUTE""")
def stream_click_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own state with timers and expiry: each click with the first purchase within half an hour, told when that is over."""
    with state_store(spark):
        return appended(outcomes(events(spark, sf_dir)), "outcomes")
