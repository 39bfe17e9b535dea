"""Outcome of runs in a stream: a run without a success message within its time has failed."""

from __future__ import annotations

import datetime
import json
import zlib
from collections import defaultdict, namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME_SCHEMA = "run string, outcome string, messages long, started timestamp, decided timestamp"
#: the same with times as microseconds since 1970, as the processor works on them
_GATE_SCHEMA = "run string, outcome string, messages long, started long, decided long"
#: keys of state that runs are spread over (fixed for a checkpoint), and runs in a page on average before a key's pages are doubled
SLOTS, PAGE_RUNS = 256, 256
#: a page or a slot without an open run
NEVER = (1 << 63) - 1
#: a row as the processor takes it; ``KINDS`` numbers what it needs to know of a state
Timed = namedtuple("Timed", "micros state")
KINDS = (None, "running", "success")


class RunGate(StatefulProcessor):
    """Per run: its start, the messages so far, and whether it is decided.

    A run starts with its first row and is given ``within`` of event time. A success in time decides it at once. Otherwise the
    timer does: ``failed`` with messages, ``silent`` if only the announcement came. Rows after the
    deadline or the decision change nothing, and cost one look at the state. The rows of a run in one micro-batch are held
    together. Times are numbers, ``micros``. Rows without a time are no part of a run.
    """

    def __init__(self, within: datetime.timedelta) -> None:
        self.within = within // datetime.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "started long, messages long, decided boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        if held and held[2]:
            return
        timed = sorted(((r.micros, r.state) for r in rows if r.micros is not None), key=lambda x: x[0])
        if not timed:
            return
        before, messages, _ = held or (None, 0, False)
        started = timed[0][0] if before is None else min(before, timed[0][0])
        inside = [x for x in timed if x[0] <= started + self.within]
        until = next((at for at, state in inside if state == "success"), None)
        messages += sum(state is not None and (until is None or at <= until) for at, state in inside)
        if before is not None and (until is not None or started != before):
            self.handle.deleteTimer(self._due(before))
        if until is None and started != before:
            self.handle.registerTimer(self._due(started))
        now = (started, messages, until is not None)
        if now != held:
            self.state.update(now)
        if until is not None:
            yield Row(run=key[0], outcome="success", messages=messages, started=started, decided=until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, messages, decided = self.state.get()
        if not decided:
            self.state.update((started, messages, True))
            outcome = "failed" if messages else "silent"
            yield Row(run=key[0], outcome=outcome, messages=messages, started=started, decided=started + self.within)

    def close(self) -> None:
        pass

    def _due(self, started: int) -> int:
        return (started + self.within) // 1000


class Desk:
    """State and timer of the run at hand, in memory: the handle of a ``RunGate`` whose runs are kept elsewhere."""

    held = None

    def getValueState(self, *_) -> Desk:
        return self

    def get(self) -> tuple | None:
        return self.held

    def update(self, value: tuple) -> None:
        self.held = value

    def registerTimer(self, at: int) -> None:
        pass

    def deleteTimer(self, at: int) -> None:
        pass


class SlotGate(StatefulProcessor):
    """``RunGate`` for all runs of a slot: a micro-batch costs one call per slot and looks at its pages, not one of each per run.

    A slot's runs lie in pages by their hash, as JSON: the names of decided runs, and start and messages of open ones. The pages are doubled
    as runs come, so what a row costs doesn't grow with them. ``head`` has the number of runs, the slot's only timer, and when the first open
    run of every page is due. Rows come in frames with a name, a kind and a time that are never NULL (see ``run_outcomes``). Those of a slot in
    one micro-batch are held together, so the source should bound its pulls.
    """

    def __init__(self, within: datetime.timedelta) -> None:
        self.gate, self.desk = RunGate(within), Desk()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "head string")
        self.pages = handle.getMapState("pages", "page int", "runs string")
        self.gate.init(self.desk)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        by_run = defaultdict(list)
        for frame in rows:
            for name, kind, micros in zip(frame["name"].tolist(), frame["kind"].tolist(), frame["micros"].tolist()):
                by_run[name].append(Timed(micros, KINDS[kind]))
        head = runs, timer, due = self._head()
        due, pages, changed, out = list(due), {}, set(), []
        for name, timed in by_run.items():
            at = _page(name, len(due))
            if at not in pages:
                pages[at] = self._load(at)
            decided, still = pages[at]
            if name in decided:
                continue
            before = still.get(name)
            self.desk.held = before and (*before, False)
            out += self.gate.handleInputRows((name,), iter(timed), timerValues)
            *now, over = self.desk.held
            if before is None or over or now != before:
                changed.add(at)
                runs += before is None
                self._keep(pages[at], name, now, over)
        if runs > PAGE_RUNS * len(due):
            pages = self._doubled(pages, len(due))
            due, changed = [NEVER] * len(pages), set(pages)
        for at in changed:
            due[at] = self._store(at, pages[at])
        first = min(due)
        if first != timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            if first != NEVER:
                self.handle.registerTimer(first)
        if (runs, first, due) != head:
            self.head.update((json.dumps((runs, first, due)),))
        if out:
            yield pd.DataFrame([r.asDict() for r in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, _, due = self._head()
        passed, out = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1), []
        for at in [i for i, first in enumerate(due) if first < passed]:
            page = self._load(at)
            for name, (started, messages) in list(page[1].items()):
                if self.gate._due(started) < passed:
                    self.desk.held = (started, messages, False)
                    out += self.gate.handleExpiredTimer((name,), timerValues, expiredTimerInfo)
                    self._keep(page, name, None, True)
            due[at] = self._store(at, page)
        first = min(due)
        if first != NEVER:
            self.handle.registerTimer(first)  # the one that fired is deleted by Spark
        self.head.update((json.dumps((runs, first, due)),))
        if out:
            yield pd.DataFrame([r.asDict() for r in out])

    def close(self) -> None:
        pass

    def _head(self) -> tuple[int, int, list[int]]:
        held = self.head.get()
        return tuple(json.loads(held[0])) if held else (0, NEVER, [NEVER])

    def _load(self, at: int) -> tuple[set, dict]:
        held = self.pages.getValue((at,))
        decided, still = json.loads(held[0]) if held else ((), {})
        return set(decided), still

    def _store(self, at: int, page: tuple[set, dict]) -> int:
        """When the page's first open run is due."""
        self.pages.updateValue((at,), (json.dumps((sorted(page[0]), page[1])),))
        return min((self.gate._due(started) for started, _ in page[1].values()), default=NEVER)

    @staticmethod
    def _keep(page: tuple[set, dict], name: str, now: list | None, over: bool) -> None:
        decided, still = page
        if over:
            decided.add(name)
            still.pop(name, None)
        else:
            still[name] = now

    def _doubled(self, pages: dict, count: int) -> dict:
        """All runs in twice as many pages, or more if many came at once."""
        pages = [pages[i] if i in pages else self._load(i) for i in range(count)]
        runs = sum(len(decided) + len(still) for decided, still in pages)
        while runs > PAGE_RUNS * count:
            count *= 2
        out = {i: (set(), {}) for i in range(count)}
        for decided, still in pages:
            for name in decided:
                out[_page(name, count)][0].add(name)
            for name, now in still.items():
                out[_page(name, count)][1][name] = now
        return out


def _page(name: str, count: int) -> int:
    return zlib.crc32(name.encode()) % count


def _named(run: str) -> Column:
    """The run as text that is never NULL: empty for NULL, else with a mark before it."""
    return F.when(F.col(run).isNull(), "").otherwise(F.concat(F.lit("="), F.col(run)))


def run_outcomes(rows: DataFrame, within: datetime.timedelta, late: str = "0 seconds") -> DataFrame:
    """One row per run when it is decided, from a stream of (run, time, state); ``state`` is NULL in announcements.

    Streams run with the RocksDB state store (see ``decide_available``).
    """
    kind = F.when(F.col("state").isNull(), 0).when(F.col("state") == "success", 2).otherwise(1)
    decided = (
        rows.where(F.col("time").isNotNull())
        .select(_named("run").alias("name"), "time", kind.alias("kind"), F.unix_micros("time").alias("micros"))
        .select(F.pmod(F.xxhash64("name"), F.lit(SLOTS)).cast("int").alias("slot"), "*")
        .withWatermark("time", late)
        .groupBy("slot")
        .transformWithStateInPandas(statefulProcessor=SlotGate(within), outputStructType=_GATE_SCHEMA, outputMode="Append", timeMode="EventTime")
    )
    run = F.when(F.col("run") != "", F.substring("run", 2, (1 << 31) - 1)).alias("run")
    return decided.select(run, "outcome", "messages", *[F.timestamp_micros(c).alias(c) for c in ("started", "decided")])


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: a commit stores what changed, instead of the whole state
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def decide_available(outcomes: DataFrame, output: str, checkpoint: str) -> None:
    """Append the outcomes of all rows that are there to parquet, then stop."""
    spark = outcomes.sparkSession
    wanted = {STORE: ROCKSDB, CHANGELOG: "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = outcomes.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()  # with the batch that moves the watermark on and fires timers
        finally:
            query.stop()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
