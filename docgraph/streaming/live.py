"""The live loop as a stream: edits gather into compiles, and questions wait for the compile that has their edits.

A compile of a key is due once its edits pause for `quiet`, but no later than `cap` after the first of them:
due = min(last + quiet, first + cap); an edit at or after the due time opens the next one. Each edit is a generation. A
question asked at some time wants all edits up to it: it is answered at once if they are compiled, else when they are, and
after `wait` at the latest, then marked stale.

Keys are dealt to GROUPS groups by hash. The state of a group is one value, a row for each key (edits not compiled yet,
questions not answered yet, the generations done, when its next thing is due), which is read and written once a visit, as
each call goes out of the Python worker and back; a group's timer of event time says when the first of its keys is due. Nothing is decided before the watermark has passed it, so rows may come in any order within
the watermark's delay, and a stream that is stopped and started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

GROUPS = 1024
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, kind string, at long, started long, ended long, n long, generation long, stale boolean"


class Debounce(StatefulProcessor):
    """Rows (key, ts, edit) as compiles and answers; times in milliseconds."""

    def __init__(self, quiet: int, cap: int, wait: int):
        self.quiet, self.cap, self.wait = quiet, cap, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "wake long, keys array<struct<key: string, edits: array<long>, asked: array<long>, generation: long, wake: long>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        more: dict[str | None, tuple[list[int], list[int]]] = {}
        for r in rows:
            more.setdefault(r.key, ([], []))[0 if r.edit else 1].append(r.at)
        return self._go(timerValues.getCurrentWatermarkInMs(), more, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._go(timerValues.getCurrentWatermarkInMs(), {}, expiredTimerInfo.getExpiryTimeInMs())

    def _go(self, now: int, more: dict, expired: int | None) -> Iterator[Row]:
        """What is decided by `now` of a group's keys, with more edits and questions. An expired timer is gone."""
        wake, known = self.state.get() or (None, ())
        keys = {k: own for k, *own in known}
        out = []
        for key in [*more, *(k for k, own in keys.items() if k not in more and own[3] is not None and own[3] < now)]:
            edits, asked, generation, _ = keys.get(key, ((), (), 0, None))
            new = more.get(key, ((), ()))
            keys[key] = self._decide(key, now, sorted([*edits, *new[0]]), sorted([*asked, *new[1]]), generation, out)
        first = min((own[3] for own in keys.values() if own[3] is not None), default=None)
        then = None if first is None else max(first, now) + 1
        self.state.update((then, [(k, *own) for k, own in keys.items() if own[2] or own[3] is not None]))
        if then != wake:
            if wake is not None and wake != expired:
                self.handle.deleteTimer(wake)
            if then is not None:
                self.handle.registerTimer(then)
        return iter([Row(key=k, kind=kind, at=at_, started=a, ended=b, n=n_, generation=g, stale=s) for k, kind, at_, a, b, n_, g, s in out])

    def _decide(self, key, now: int, edits: list[int], asked: list[int], generation: int, out: list[tuple]) -> tuple[list[int], list[int], int, int | None]:
        """What a key keeps; what is decided goes to out. All that happened before `now` is known."""
        due = None
        while True:
            at, n, due = 0, 0, None
            while n < len(edits) and (due is None or edits[n] < due):
                due = min(edits[n] + self.quiet, edits[0] + self.cap)
                n += 1
            # questions asked before the open compile's first edit, or of no edits at all, have what they want
            while at < len(asked) and asked[at] < now and (n == 0 or asked[at] < edits[0]):
                out.append((key, "answer", asked[at], asked[at], None, None, generation, False))
                at += 1
            asked = asked[at:]
            if due is None or due >= now:
                break
            generation += n
            out.append((key, "compile", due, edits[0], edits[n - 1], n, generation, False))
            inside = [t for t in asked if t < due]
            for t in inside:
                # the edits up to t are compiled now
                late = due > t + self.wait
                out.append((key, "answer", t + self.wait if late else due, t, None, None, generation - n if late else generation, late))
            asked, edits = asked[len(inside) :], edits[n:]
        return edits, asked, generation, min([t for t in (due, asked[0] if asked else None) if t is not None], default=None)

    def close(self) -> None:
        pass


def live(changes: DataFrame, quiet_ms: int, cap_ms: int, wait_ms: int, late: str = "10 seconds") -> DataFrame:
    """A stream of rows (key string, ts timestamp, edit boolean) as compiles and answers.

    compile: at = due time, started and ended (first and last edit), n, generation; answer: at, started = when it was
    asked, generation it was answered from, stale. Times are milliseconds since 1970."""
    rows = changes.select("key", "ts", F.unix_millis("ts").alias("at"), "edit").withWatermark("ts", late)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    return rows.groupBy("group").transformWithState(statefulProcessor=Debounce(quiet_ms, cap_ms, wait_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run_live(spark: SparkSession, folder: str, out: str, checkpoint: str, quiet_ms: int, cap_ms: int, wait_ms: int, late: str = "10 seconds", files: int = 4) -> StreamingQuery:
    """Follow the files of changes in a folder, `files` at a time, until none is left; rows go to Parquet in `out`."""
    spark.conf.set(PROVIDER, ROCKS)  # timers need it
    stream = spark.readStream.schema("key string, ts timestamp, edit boolean").option("maxFilesPerTrigger", files).parquet(folder)
    query = live(stream, quiet_ms, cap_ms, wait_ms, late)
    return query.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
