"""Open carts as the state of a stream: an event-time fold that takes late and out-of-order actions, and lets go.

State per customer, in RocksDB: the open lines as they are settled, the actions that the watermark has not passed, and
a counter. A batch folds the waiting actions in the order of (ts, event_id) onto the settled lines, once without
and once with its new ones, and emits what differs, so an action that comes late but before the watermark corrects what
was emitted. A timer at the newest waiting action settles when the watermark passes it: closed lines leave the state, and
a customer without open lines and waiting actions leaves it whole. With ``idle`` a line without actions
for so long is closed as expired by the same timers. Actions older than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE = "cust_id long, item_id long, cart_item_id long, quantity int, status string, version int"
CART = "event_id long, cust_id long, item_id long, ts timestamp, cart array<long>"
CLOSING = ("sold", "not_sold", "delete")
_ROW = ["item_id", "at", "event_id", "action", "quantity"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class rocksdb:
    """Streams started inside keep their state in RocksDB; the session's own setting returns afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_PROVIDER)
        self.spark.conf.set(_PROVIDER, _ROCKSDB)

    def __exit__(self, *error) -> None:
        self.spark.conf.set(_PROVIDER, self.before)


def fold(lines: dict[int, tuple[int, int, int]], actions: list[tuple]) -> Iterator[tuple]:
    """Applies actions to ``lines`` (item -> line id, quantity, time of the last action) and yields, for each that
    counts, the action and the line as it leaves it: id, quantity, status."""
    for item, at, event, action, n in actions:
        line, quantity, _ = lines.get(item, (None, 0, 0))
        if action == "add":
            line, quantity = (event, n) if line is None else (line, quantity + n)
        elif line is None:
            continue
        elif action == "set_quantity":
            quantity = n
        if action in CLOSING:
            del lines[item]
        else:
            lines[item] = (line, quantity, at)
        yield (item, at, event, action, n), line, quantity, action if action in CLOSING else "in_cart"


class OpenCarts(StatefulProcessor):
    def __init__(self, emit_carts: bool, idle_ms: int | None):
        self.emit_carts, self.idle_ms = emit_carts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "item_id long", "line long, quantity int, last long")
        self.waiting = handle.getListState("waiting", "item_id long, at long, event_id long, action string, quantity int")
        self.counter = handle.getValueState("counter", "n int")

    def _settled(self) -> dict[int, tuple[int, int, int]]:
        return {int(k[0]): (int(v[0]), int(v[1]), int(v[2])) for k, v in self.lines.iterator()} if self.lines.exists() else {}

    def _pending(self) -> list[tuple]:
        return [(int(r[0]), int(r[1]), int(r[2]), r[3], int(r[4])) for r in self.waiting.get()] if self.waiting.exists() else []

    def _changes(self, key: tuple, before: dict, after: dict) -> pd.DataFrame:
        """The lines that differ, under a number above all that this state has given."""
        n = int(self.counter.get()[0]) if self.counter.exists() else 0
        gone = {line: (item, 0, "delete") for line, (item, _, status) in before.items() if line not in after}
        changed = {line: now for line, now in after.items() if before.get(line) != now} | gone
        if changed:
            n += 1
            self.counter.update((n,))
        return pd.DataFrame([(key[0], item, line, quantity, status, n) for line, (item, quantity, status) in changed.items()],
                            columns=["cust_id", "item_id", "cart_item_id", "quantity", "status", "version"]).astype(
            {"cust_id": "int64", "item_id": "int64", "cart_item_id": "int64", "quantity": "int32", "version": "int32"})

    def _settle(self, settled: dict, pending: list[tuple], passed: int, changed: bool) -> None:
        """Folds what the watermark has passed into the settled lines, stores the rest, and sets the next timer."""
        done = [a for a in pending if a[1] < passed * 1000]
        for _ in fold(settled, done):
            pass
        rest = pending[len(done):]
        if done or changed:
            self.lines.clear()
            for item, line in settled.items():
                self.lines.updateValue((item,), line)
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if not settled and not rest:
            self.counter.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [rest[-1][1] // 1000 + 1] if rest else []
        if self.idle_ms is not None:
            due += [last // 1000 + self.idle_ms for _, _, last in settled.values()]
        if due:
            self.handle.registerTimer(max(min(due), passed + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new["at"] = new["ts"].astype("datetime64[us]").astype("int64")
        fresh = [tuple(r) for r in new[_ROW].itertuples(index=False)]
        settled, old = self._settled(), self._pending()
        pending = sorted(old + fresh, key=lambda a: (a[1], a[2]))
        shape = lambda actions: {line: (a[0], quantity, status) for a, line, quantity, status in fold(dict(settled), actions)}
        if self.emit_carts:
            added, carts, lines = {a[2] for a in fresh if a[3] == "add"}, [], dict(settled)
            for a, _, _, _ in fold(lines, pending):
                if a[2] in added:
                    carts.append((a[2], key[0], a[0], pd.Timestamp(a[1], unit="us"), [i for i, x in lines.items() if x[1] > 0]))
            yield pd.DataFrame(carts, columns=["event_id", "cust_id", "item_id", "ts", "cart"])
        else:
            # a line as it is settled counts as emitted
            known = {line: (item, quantity, "in_cart") for item, (line, quantity, _) in settled.items()}
            yield self._changes(key, known | shape(old), known | shape(pending))
        self._settle(settled, pending, timerValues.getCurrentWatermarkInMs(), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        settled, pending = self._settled(), self._pending()
        changed = False
        if self.idle_ms is not None:
            due = [a for a in pending if a[1] < passed * 1000]
            for _ in fold(settled, due):
                pass
            pending = pending[len(due):]
            idle = {item for item, (_, _, last) in settled.items() if last // 1000 + self.idle_ms <= passed}
            changed = bool(idle or due)
            if idle and not self.emit_carts:
                open_lines = {line: (item, quantity, "in_cart") for item, (line, quantity, _) in settled.items()}
                closed = {line: (item, quantity, "expired" if item in idle else status) for line, (item, quantity, status) in open_lines.items()}
                yield self._changes(key, open_lines, closed)
            for item in idle:
                del settled[item]
        self._settle(settled, pending, passed, changed)

    def close(self) -> None:
        pass


def _run(log: DataFrame, late: str, idle: str | None, emit_carts: bool, schema: str) -> DataFrame:
    """Actions without a customer or an item belong to no cart and are left out."""
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = log.filter("cust_id IS NOT NULL AND item_id IS NOT NULL").select(
        "cust_id", F.col("item_id").cast("long"), F.col("ts").cast("timestamp"), F.col("event_id").cast("long"), "action",
        F.coalesce(F.col("quantity"), F.lit(0)).cast("int").alias("quantity")).filter(F.col("action").isin("add", "set_quantity", *CLOSING))
    return rows.withWatermark("ts", late).groupBy("cust_id").transformWithStateInPandas(
        statefulProcessor=OpenCarts(emit_carts, idle_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def live_cart_changes(log: DataFrame, late: str = "2 hours", idle: str | None = None) -> DataFrame:
    """Every change of every cart line; the highest version of a line is the line."""
    return _run(log, late, idle, False, CHANGE)


def live_open_carts(log: DataFrame, late: str = "2 hours", idle: str | None = None) -> DataFrame:
    """For every add, the items of the customer's open cart right after it."""
    return _run(log, late, idle, True, CART)
