"""Reading events: gestures, positions, and what counts as a view or a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import kept
from .ordered import LAST, SUM, Fold, laid, neighbours, running, starts


def gestures(events: DataFrame, sw: float = 480.0) -> DataFrame:
    """Adds action, delta, pan_x and pan_y to events(kind, x, direction, distance, diff, mode, invert, pannable).

    A swipe along the left quarter zooms, on a picture larger than the screen it pans (diagonals by the root of a half),
    else west and east turn the panel, by mode and inversion. A tap on an outer third, ends included, turns it by mode
    alone; elsewhere it toggles the bars. A page turn counts by its sign; nothing, by nothing.
    """
    left, right = F.col("x") <= sw / 3, F.col("x") >= sw * 2 / 3
    fore = F.when(F.col("mode") == "manga", -1).otherwise(1)
    swipe, tap = F.col("kind") == "swipe", F.col("kind") == "tap"
    edge = swipe & (F.col("x") <= 0.25 * sw) & F.col("direction").isin("north", "south")
    pan = swipe & ~edge & F.col("pannable")
    turn = swipe & ~edge & ~pan & F.col("direction").isin("west", "east")
    step = F.when(F.col("direction") == "west", 1).otherwise(-1) * F.when(F.col("mode") == "manga", -1).otherwise(1) * F.when(F.col("invert"), -1).otherwise(1)
    page = (F.col("kind") == "page_turn") & (F.coalesce("diff", F.lit(0)) != 0)
    action = F.when(edge, "zoom").when(pan, "pan").when(turn | tap & (left | right) | page, "step").when(tap, "toggle").otherwise("noop")
    delta = F.when(edge, F.when(F.col("direction") == "north", 0.2).otherwise(-0.2)).when(turn, step).when(tap & left, -fore).when(tap & right, fore).when(page, F.signum("diff"))
    part = F.col("distance") * F.when(F.length("direction") > 5, 0.5**0.5).otherwise(1.0)
    x = F.when(F.col("direction").endswith("east"), -part).when(F.col("direction").endswith("west"), part).otherwise(0.0)
    y = F.when(F.col("direction").startswith("south"), -part).when(F.col("direction").startswith("north"), part).otherwise(0.0)
    return events.withColumn("action", action).withColumn("delta", delta.cast("double")).withColumn("pan_x", F.when(pan, x)).withColumn("pan_y", F.when(pan, y))


def final_positions(events: DataFrame, n: int) -> DataFrame:
    """(user_id, position): where each user's steps(user_id, ts, event_id, d) end, from 1, held within 1 and n.

    A step moves by d and is then clamped; a run of such steps is again max(lo, min(hi, p + sum)). Events are dealt by
    ranges of user and time, which also split a single user's; each task reduces its part of a user to (lo, hi, sum),
    and only these are gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, far = TaskContext.get().partitionId(), 1 << 60
        state: list[tuple] = []  # the open run: (user, lo, hi, sum)
        for b in batches:
            kind = b.schema.field(0).type
            done = []
            for user, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state and state[0][0] == user:
                    _, lo, hi, total = state[0]
                else:
                    done += state
                    lo, hi, total = -far, far, 0
                if d is None:  # ends at 1 from anywhere, as least and greatest skip nulls
                    lo, hi, total = min(n, 1), min(n, 1), 0
                else:
                    lo, hi, total = min(n, max(1, lo + d)), min(n, max(1, hi + d)), total + d
                state = [(user, lo, hi, total)]
            yield batch(done, kind, part)
        if state:
            yield batch(state, kind, part)

    def batch(done: list[tuple], kind: pa.DataType, part: int) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        values = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array([part] * len(done), pa.int64())]
        return pa.RecordBatch.from_arrays(values, names=["user_id", "lo", "hi", "sum", "part"])

    order = ["user_id", "ts", "event_id", "d"]
    steps = events.select("user_id", "ts", "event_id", F.col("d").cast("int").alias("d")).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = steps.select("user_id", "d").mapInArrow(run, T.StructType([events.schema["user_id"], *[T.StructField(c, T.LongType()) for c in ("lo", "hi", "sum", "part")]]))
    # a user has a row for each range at most
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "lo", "hi", "sum"))), F.lit(1).cast("long"), lambda p, r: F.greatest(r.lo, F.least(r.hi, p + r.sum)))
    return parts.groupBy("user_id").agg(fold.cast("int").alias("position"))


def positions(events: DataFrame, n: int) -> DataFrame:
    """Steps(user_id, ts, event_id, d, ...) with position: where the user stands after each, from 1, held within 1 and n.

    Runs of steps are max(lo, min(hi, p + sum)), which compose, so each event's run is a running value over ranges of user
    and time, and no task holds a user. A null d leads to 1, as in `final_positions`.
    """
    d, low, none = F.col("d").cast("long"), min(n, 1), F.col("d").isNull()
    steps = events.withColumns({"lo_": F.lit(low).cast("long"), "hi_": F.when(none, low).otherwise(n).cast("long"), "sum_": F.coalesce(d, F.lit(0)).cast("long")})
    clamped = Fold(lambda a, b: (np.maximum(b[0], np.minimum(b[1], a[0] + b[2])), np.maximum(b[0], np.minimum(b[1], a[1] + b[2])), a[2] + b[2]))
    got = running(laid(steps, ["user_id"], ["ts", "event_id", "d"]), ["user_id"], ["lo_", "hi_", "sum_"], clamped, ["lo_to", "hi_to", "sum_to"])
    position = F.greatest("lo_to", F.least("hi_to", F.lit(1) + F.col("sum_to"))).cast("int")
    return got.select(*events.columns, position.alias("position"))


def _next(ts: np.ndarray, last: np.ndarray, hold: float) -> np.ndarray:
    """For each of `last` the place of the first of the sorted times that is not within `hold` after it."""
    at = np.searchsorted(ts, last + hold)
    # by the difference, as in `throttle`, which rounding may put a place aside
    while (less := (at > 0) & (ts[np.maximum(at - 1, 0)] - last >= hold)).any():
        at -= less
    while (more := (at < ts.size) & (ts[np.minimum(at, ts.size - 1)] - last < hold)).any():
        at += more
    return at


def _accepting(ts: np.ndarray, hold: float) -> tuple[list, list, list]:
    """(entries, exits, counts): if the first step accepted of the sorted times is an entry, the last one accepted and how many are.

    What was accepted before lies at the first time at the latest, so only times within `hold` of it, and the one after
    these, can be first.
    """
    follow = np.maximum(_next(ts, ts, hold), np.arange(1, ts.size + 1)).tolist()
    exits, counts = ts.tolist(), [1] * ts.size
    for i in range(ts.size - 1, -1, -1):
        if (j := follow[i]) < ts.size:
            exits[i], counts[i] = exits[j], counts[j] + 1
    k = (int(_next(ts, ts[:1], hold)[0]) if ts.size else 0) + 1
    return ts[:k].tolist(), exits[:k], counts[:k]


def _throttled(events: DataFrame, hold: float) -> tuple[DataFrame, DataFrame]:
    """(laid steps with second_, (user_id, parts<part, entries, exits, counts>): a row a user, with an entry for each range that has some of its steps."""
    steps = laid(events.withColumn("second_", F.col("ts").cast("double")), ["user_id"], ["second_", "event_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, kind, part, held = None, None, None, None

        def told() -> pa.RecordBatch:
            ts = np.concatenate(held)
            entries, exits, counts = _accepting(ts[~np.isnan(ts)], hold)
            return pa.RecordBatch.from_arrays([pa.array([user], kind), pa.array([part], pa.int32()), pa.array([entries], pa.list_(pa.float64())), pa.array([exits], pa.list_(pa.float64())), pa.array([counts], pa.list_(pa.int64()))], names=["user_id", "part", "entries", "exits", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            new = starts([b.column(0)])
            at = np.flatnonzero(new)
            times = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            for i, j in zip(at, np.append(at[1:], b.num_rows), strict=True):
                own = b.column(0)[int(i)].as_py()
                if held is not None and own == user:
                    held.append(times[i:j])
                    continue
                if held is not None:
                    yield told()
                user, kind, part, held = own, b.schema.field(0).type, b.column(1)[0].as_py(), [times[i:j]]
        if held is not None:
            yield told()

    schema = T.StructType([events.schema["user_id"], T.StructField("part", T.IntegerType()), *[T.StructField(n, T.ArrayType(t)) for n, t in (("entries", T.DoubleType()), ("exits", T.DoubleType()), ("counts", T.LongType()))]])
    tables = steps.select("user_id", "part_", "second_").mapInArrow(run, schema)
    return steps, tables.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("part", "entries", "exits", "counts"))).alias("parts"))


def _entered(last: Column, part: Column, hold: float) -> Column:
    """Which entry of a part is taken after the last accepted step, from 1; 0 if none is."""
    return F.array_position(F.transform(part.entries, lambda e: ~(e - last < F.lit(hold))), F.lit(True)).cast("int")


def throttle(events: DataFrame, hold: float = 0.4) -> DataFrame:
    """(user_id, n_accepted): steps(user_id, ts in seconds, event_id) that are not within `hold` seconds after an accepted one.

    Steps are dealt by ranges of user and time. A task reduces its part of a user to a table from the first step that it
    accepts to the last one, for all that may be first, and tables of successive parts compose. Null times are never accepted.
    """

    def on(s: Column, p: Column) -> Column:
        at = _entered(s.last, p, hold)
        return F.when(at > 0, F.struct(F.element_at(p.exits, at).alias("last"), (s.n + F.element_at(p.counts, at)).alias("n"))).otherwise(s)

    began = F.struct(F.lit(float("-inf")).alias("last"), F.lit(0).cast("long").alias("n"))
    return _throttled(events, hold)[1].select("user_id", F.aggregate("parts", began, on, lambda s: s.n).cast("int").alias("n_accepted"))


def accepted_steps(events: DataFrame, hold: float = 0.4) -> DataFrame:
    """Steps(user_id, ts in seconds, event_id, ...) with accepted, as `throttle` counts them; no task holds a user."""
    steps, tables = _throttled(events, hold)

    def on(s: Column, p: Column) -> Column:
        at = _entered(s.last, p, hold)
        known = F.concat(s.known, F.array(F.struct(p.part.alias("part"), s.last.alias("last"))))
        return F.struct(F.when(at > 0, F.element_at(p.exits, at)).otherwise(s.last).alias("last"), known.alias("known"))

    began = F.struct(F.lit(float("-inf")).alias("last"), F.expr("cast(array() as array<struct<part: int, last: double>>)").alias("known"))
    # only a range's first user can have begun before it, so this is a row a range at most
    far = tables.filter(F.size("parts") > 1).select(F.explode(F.aggregate("parts", began, on, lambda s: F.slice(s.known, 2, F.size("parts")))).alias("k"))
    carry = {r["part"]: r["last"] for r in far.select("k.part", "k.last").collect()}
    every = steps.columns
    schema = T.StructType([*steps.schema.fields, T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last, begun = None, 0.0, False
        for b in batches:
            out = []
            users, times = (b.column(every.index(c)).to_pylist() for c in ("user_id", "second_"))
            for i, (own, ts) in enumerate(zip(users, times, strict=True)):
                if not begun:
                    user, last, begun = own, carry.get(b.column(every.index("part_"))[i].as_py(), float("-inf")), True
                elif own != user:
                    user, last = own, float("-inf")
                out.append(ts is not None and ts == ts and not ts - last < hold)
                last = ts if out[-1] else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=schema.names)

    return steps.mapInArrow(run, schema).select(*events.columns, "accepted")


def idle_views(views: DataFrame, idle: float = 0.25) -> DataFrame:
    """Views(user_id, ts in seconds, event_id) after which the user stayed at least `idle` seconds, or that were the last."""
    rows = neighbours(laid(views, ["user_id"], ["ts", "event_id"]), ["user_id"], after={"after_": "ts"})
    return rows.filter(F.col("after_").isNull() | (F.col("after_") - F.col("ts") >= idle)).select(*views.columns)


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mid, n): the median of each key's values, and how many there are; nulls do not count.

    Equal values are counted first; the middle ranks are then found among running counts, so no task holds a key's values.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c_"))
    upto = kept(running(laid(counts, [key], [value]), [key], ["c_"], SUM, ["upto_"]))
    total = upto.groupBy(key).agg(F.max("upto_").alias("n"))
    at = lambda k: F.max(F.when((F.col("upto_") - F.col("c_") < k) & (F.col("upto_") >= k), F.col(value)))
    met = upto.withColumnRenamed(key, "key_").join(total, F.col("key_").eqNullSafe(F.col(key)))
    return met.groupBy(key, "n").agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("mid")).select(key, "mid", "n")


def sessions(events: DataFrame, scale: int) -> DataFrame:
    """(user_id, session, begin, end, n): events(user_id, ts long, event_id) split where a gap reaches the user's own threshold.

    The threshold is that of words on a line: from the user's median gap, within bounds that follow `scale`. Gaps, medians
    and sessions come from ranges of user and time; a user's threshold goes ahead of the events as a row of its own.
    """
    rows = laid(events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    gaps = neighbours(rows, ["user_id"], {"before_": "ts"}).select("user_id", "ts", "event_id", (F.col("ts") - F.col("before_")).alias("gap"))
    h, own = F.lit(float(scale)), medians(gaps, "user_id", "gap")
    wide = F.least(F.greatest(F.floor(h * 0.15), F.floor(F.col("mid") * 1.6)), F.ceil(h * 1.5))
    t = F.greatest(F.lit(2), F.when(F.col("n") >= 2, wide).otherwise(F.floor(h * 0.5))).cast("double")
    ahead = own.select("user_id", t.alias("t"), F.lit(0).alias("kind"))
    every = gaps.withColumns({"t": F.lit(float("nan")), "kind": F.lit(1)}).unionByName(ahead, allowMissingColumns=True)
    told = running(laid(every, ["user_id"], ["kind", "ts", "event_id"]), ["user_id"], ["t"], LAST, ["own"])
    told = told.withColumn("new", F.coalesce((F.col("gap") >= F.col("own")) & ~F.isnan("own"), F.lit(False)).cast("long"))
    cut = running(told, ["user_id"], ["new"], SUM, ["session"]).filter("kind = 1")
    return cut.groupBy("user_id", "session").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("n"))
