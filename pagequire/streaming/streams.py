"""The batch operators on growing input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import cut, nav, panels, reviews
from ..sources.logs import REVIEW


def stream_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Classified reviews of a folder to which JSON lines are added; stateless, so any sink and mode will do."""
    return reviews.classify(spark.readStream.schema(REVIEW).json(folder))


class _Positions(StatefulProcessor):
    def __init__(self, n: int, hold: float):
        self.n, self.hold = n, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "position int, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        steps = pd.concat(rows).sort_values(["ts", "event_id"])
        position, last = self.state.get() if self.state.exists() else (1, -1e18)
        at = []
        for ts, d in zip(steps["ts"], steps["d"], strict=True):
            if ts - last >= self.hold:
                position, last = max(1, min(self.n, position + int(d))), ts
            at.append(position)
        self.state.update((int(position), float(last)))
        yield pd.DataFrame({"user_id": key[0], "event_id": steps["event_id"], "position": at})

    def close(self) -> None:
        pass


def stream_positions(steps: DataFrame, n: int, hold: float = 0.0) -> DataFrame:
    """(user_id, event_id, position) after each of the streamed steps(user_id, ts, event_id, d): held within 1 and n, and throttled.

    One small state for each user; steps are put in order within a batch. Needs the RocksDB state store.
    """
    return steps.groupBy("user_id").transformWithStateInPandas(statefulProcessor=_Positions(n, hold), outputStructType="user_id long, event_id long, position int", outputMode="append", timeMode="none")


def stream_reading(events: DataFrame, n: int, hold: float = 0.4, sw: float = 480.0) -> DataFrame:
    """As stream_positions, from streamed events as `nav.gestures` takes them, with user_id, ts in seconds and event_id; only those that turn a panel count."""
    steps = nav.gestures(events, sw).filter("action = 'step'")
    return stream_positions(steps.select("user_id", F.col("ts").cast("double").alias("ts"), "event_id", F.col("delta").cast("int").alias("d")), n, hold)


class _Held(StatefulProcessor):
    """Keeps a key's rows, the time in milliseconds first, until the watermark has passed; one timer a key, for the first that is due."""

    def keep(self, handle: StatefulProcessorHandle, schema: str) -> None:
        self.handle, self.rows, self.due = handle, handle.getListState("rows", schema), handle.getValueState("due", "at long")

    def remind(self, at: int) -> None:
        old = self.due.get()[0] if self.due.exists() else None
        if old is None or at < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def taken(self, timerValues, expiredTimerInfo) -> tuple[int, list[tuple]]:  # noqa: N803
        """(the time up to which all rows have come, all rows that are kept)."""
        self.due.clear()
        return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), [tuple(r) for r in self.rows.get()]

    def leave(self, rows: list[tuple]) -> None:
        if rows:
            self.rows.put(rows)
        else:
            self.rows.clear()

    def close(self) -> None:
        pass


class _InOrder(_Held):
    def __init__(self, n: int, hold: float, ttl: float):
        self.n, self.hold, self.ttl = n, hold, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keep(handle, "at long, ts double, event_id long, d int")
        self.user = handle.getValueState("user", "position int, last double, seen double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for part in rows:
            new = [(int(a), float(t), int(i), int(d)) for a, t, i, d in zip(part["at"], part["seconds"], part["event_id"], part["d"], strict=True)]
            if new:
                self.rows.appendList(new)
                self.remind(min(new)[0])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, rows = self.taken(timerValues, expiredTimerInfo)
        fresh = (1, float("-inf"), float("-inf"))
        position, last, seen = self.user.get() if self.user.exists() else fresh
        out = []
        for _, ts, event, d in sorted(r for r in rows if r[0] <= now):
            if ts - seen > self.ttl:
                position, last, _ = fresh
            if ts - last >= self.hold:
                position, last = max(1, min(self.n, position + d)), ts
            seen = ts
            out.append((key[0], event, position))
        left = sorted(r for r in rows if r[0] > now)
        self.leave(left)
        forget = int((seen + self.ttl) * 1000) + 1
        if forget <= now:
            self.user.clear()
        else:
            self.user.update((int(position), float(last), float(seen)))
            self.remind(forget)
        if left:
            self.remind(left[0][0])
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "position"])


def stream_positions_in_order(steps: DataFrame, n: int, hold: float = 0.0, delay: str = "10 seconds", ttl: float = 86_400.0) -> DataFrame:
    """As stream_positions, of steps(user_id, ts in seconds, event_id, d) that may come in any order within `delay`.

    A user's steps are held until the watermark has passed them, so the result does not depend on how they are split into
    batches; later ones are dropped, as are those with nulls or at or before the epoch. A user who takes no step for `ttl` seconds of event time is
    forgotten, and begins at 1 again; of others a row is kept. Needs the RocksDB state store.
    """
    timed = steps.dropna(subset=["user_id", "ts", "event_id", "d"]).select("user_id", F.col("ts").cast("double").alias("seconds"), "event_id", "d", F.timestamp_millis(F.floor(F.col("ts") * 1000)).alias("when"))
    keyed = timed.withWatermark("when", delay).withColumn("at", F.unix_millis("when")).groupBy("user_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_InOrder(n, hold, ttl), outputStructType="user_id long, event_id long, position int", outputMode="append", timeMode="eventTime")


class _Pending(_Held):
    """Keeps a user's rows until the watermark makes it sure what came next after each look-up."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keep(handle, "at long, kind int, lookup_id long, verdict string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for part in rows:
            new = [(int(a), int(k), int(i), v) for a, k, i, v in zip(part["at"], part["kind"], part["lookup_id"], part["verdict"], strict=True)]
            if new:
                self.rows.appendList(new)
                self.remind(min(r[0] for r in new) + self.within)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        # all rows up to `now` have come; look-ups that are `within` older are decided, and what is as old goes
        now, rows = self.taken(timerValues, expiredTimerInfo)
        now -= self.within
        rows.sort(key=lambda r: (r[0], r[1], r[2], r[3] or ""))
        out = []
        for (at, kind, lookup, _), after in zip(rows, [*rows[1:], None], strict=True):
            if kind == 0 and at <= now:
                soon = after is not None and after[0] - at <= self.within
                out.append((key[0], lookup, "abandoned" if not soon else "resolved" if after[1] else "superseded", after[3] if soon else None))
        left = [r for r in rows if r[0] > now]
        self.leave(left)
        if left:
            self.remind(left[0][0] + self.within)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "lookup_id", "outcome", "verdict"])


def stream_verdicts(lookups: DataFrame, verdicts: DataFrame, within: float = 120.0, delay: str = "10 seconds") -> DataFrame:
    """`reviews.match_verdicts` of streamed lookups(user_id long, ts timestamp, lookup_id long) and verdicts(user_id, ts, verdict).

    Rows may come in any order, and either stream may lag, by `delay` of event time; later ones are dropped. A look-up's
    row comes once the watermark is `within` past it. State: a user's rows of that long. Times count in milliseconds.
    Needs the RocksDB state store.
    """
    asked = lookups.selectExpr("user_id", "ts", "0 AS kind", "lookup_id", "cast(null AS string) AS verdict")
    told = verdicts.selectExpr("user_id", "ts", "1 AS kind", "0L AS lookup_id", "verdict")
    rows = asked.unionByName(told).filter("user_id IS NOT NULL AND (kind = 1 OR lookup_id IS NOT NULL)").withWatermark("ts", delay)
    keyed = rows.withColumn("at", F.unix_millis("ts")).groupBy("user_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_Pending(int(within * 1000)), outputStructType="user_id long, lookup_id long, outcome string, verdict string", outputMode="append", timeMode="eventTime")


def _there(session: SparkSession, path: str) -> bool:
    at = session._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(session._jsc.hadoopConfiguration()).exists(at)


def stream_segments(spark: SparkSession, runs: str, out: str, checkpoint: str, w: int = 480, h: int = 720, register: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Cut the pages whose runs(page_id, y, x0, x1) are added to a folder, each page once; a file holds whole pages.

    Panels go to `out`, by epoch; the pages that were cut, those without panels too, go to `register` (`out`-pages if not
    given), by epoch and bucket of the page. A batch reads the register's page ids in the buckets of its own pages only,
    and not what its own epoch left there: a batch that is run again after a failure replaces what it wrote.
    """
    register = register or f"{out.rstrip('/')}-pages"

    def one(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int"))
        fresh = batch
        if _there(session, register):
            own = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
            known = session.read.parquet(register).filter(F.col("bucket").isin(own) & (F.col("epoch") != epoch))
            fresh = batch.join(known.select("page_id").distinct(), "page_id", "left_anti")
        fresh = cut.kept(fresh)
        if fresh.isEmpty():
            return
        pages = fresh.select("page_id", "bucket").distinct()
        maps = pages.selectExpr("page_id", f"{w} AS w", f"{h} AS h")
        found = panels.reading_order(cut.to_panels(cut.leaf_filter(cut.xy_cut(fresh.drop("bucket"), maps), maps), maps))
        found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/epoch={epoch}")
        pages.write.mode("overwrite").partitionBy("bucket").parquet(f"{register.rstrip('/')}/epoch={epoch}")

    source = spark.readStream.schema("page_id long, y int, x0 int, x1 int").parquet(runs)
    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
