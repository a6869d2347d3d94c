"""Repair of a conversation's structure by the cheapest edits, found from both ends.

Roles are to read `(s?(ua)+)?` by their initials. A lattice has a node for each row and each state of that pattern; keeping,
reroling and deleting a row lead to the next row, inserting one stays before it. Two Dijkstra searches, one from each end,
meet; all crossings of equal cost are finished, and of their edit sequences the least one wins. Long conversations are cut into
blocks, for which each way from state to state is searched; blocks are then joined like matrices, in rounds.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import laid, neighbours, numbered
from .store import cut

#: What has been put out so far: nothing, a system row, a user's, an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (NONE, ASSISTANT)
#: What edits cost, and what a truncated row that is not deleted adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _moves(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(state, state after, cost, edit) for a row: fault is b(lank), d(uplicate), t(runcated) or k(ept as it is)."""
    out = [(q, q, DELETE, "D") for q in STATES]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        out += [(q, _NEXT[q], REROLE + more, "R") for q in STATES]
        out += [(q, _NEXT[q], more, "K") for q in STATES if initial == "?ua"[_NEXT[q] - 1]]
        out += [(NONE, SYSTEM, more, "K")] * (initial == "s")
    return out


_AHEAD = {(c, f): [[(r, w, e) for p, r, w, e in _moves(c, f) if p == q] for q in STATES] for c in "sua?" for f in "bdtk"}
_BACK = {k: [[(p, w, e) for p in STATES for r, w, e in moves[p] if r == q] for q in STATES] for k, moves in _AHEAD.items()}
_INSERTED = {q: [p for p in STATES if _NEXT[p] == q] for q in STATES}


def search(initials: str, faults: str, entry: int, exits: Sequence[int]) -> tuple[int, str] | None:
    """The least (cost, edits) from a state before the rows to one of `exits` after them; None where there is no way.

    initials and faults have a letter for each row. Edits that cost nothing lead on by a row, so of nodes of equal cost
    those further on are settled later, and what a settled node says of its best edits is final.
    """
    rows, n = [*zip(initials, faults, strict=True)], len(initials)
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, q): (0, "") for q in exits}
    forward, reverse = [(0, 0, entry)], [(0, 0, q) for q in exits]
    heapq.heapify(reverse)
    settled: tuple[set, set] = (set(), set())
    best = min((back[k][0] + v[0] for k, v in ahead.items() if k in back), default=None)
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        onward = forward[0][0] <= reverse[0][0]
        cost, far, q = heapq.heappop(forward if onward else reverse)
        i = far if onward else n - far
        if (i, q) in settled[not onward]:
            continue
        settled[not onward].add((i, q))
        own, other = (ahead, back) if onward else (back, ahead)
        said = own[i, q][1]
        if onward:
            steps = [((i, _NEXT[q]), INSERT, "I"), *(((i + 1, r), w, e) for r, w, e in (_AHEAD[rows[i]][q] if i < n else ()))]
        else:
            steps = [*(((i, p), INSERT, "I") for p in _INSERTED[q]), *(((i - 1, p), w, e) for p, w, e in (_BACK[rows[i - 1]][q] if i else ()))]
        for node, w, e in steps:
            label = (cost + w, said + e if onward else e + said)
            if node not in own or label < own[node]:
                if node not in own or label[0] < own[node][0]:
                    heapq.heappush(forward if onward else reverse, (label[0], node[0] if onward else n - node[0], node[1]))
                own[node] = label
                if node in other and (best is None or label[0] + other[node][0] < best):
                    best = label[0] + other[node][0]
    if best is None:
        return None
    return best, min(v[1] + back[k][1] for k, v in ahead.items() if k in back and v[0] + back[k][0] == best)


Ways = dict[tuple[int, int], tuple[int, str]]


def _joined(first: Ways, second: Ways) -> Ways:
    """The least ways through two blocks in turn; edits that lead from one node to another at equal cost are never prefixes of each other."""
    out: Ways = {}
    for (a, b), (c, x) in first.items():
        for (p, d), (e, y) in second.items():
            if p == b and ((a, d) not in out or (c + e, x + y) < out[a, d]):
                out[a, d] = (c + e, x + y)
    return out


_WAYS = "g string, block long, ways array<struct<entry: int, exit: int, cost: long, edits: string>>"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    way = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    ways = [[{"entry": a, "exit": b, "cost": c, "edits": e} for (a, b), (c, e) in w.items()] for _, _, w in out]
    return pa.record_batch({"g": pa.array([g for g, *_ in out], pa.string()), "block": pa.array([b for _, b, _ in out], pa.int64()), "ways": pa.array(ways, pa.list_(way))})


def audits(faults: DataFrame, block: int = 512, fan: int = 32) -> DataFrame:
    """(g, cost, audit) of each conversation g of faults(g, seq, initial, fault), with rows numbered from 0.

    block: rows that are searched together; fan: blocks that a task joins at a time. The audit is one string, so it
    grows with its conversation; no task holds more than `fan` blocks' ways beside it.
    """
    letters = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "initial", "fault"))), lambda x: x[c]), "")
    blocks = faults.groupBy("g", F.floor(F.col("seq") / block).cast("long").alias("block")).agg(letters("initial").alias("initials"), letters("fault").alias("faults"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, at, initials, wrong in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ways: Ways = {}
                if at == 0 and len(initials) < block:  # the whole conversation
                    ways[NONE, ASSISTANT] = search(initials, wrong, NONE, ENDS)
                else:
                    for entry in [NONE] if at == 0 else STATES:
                        ways |= {(entry, q): way for q in STATES if (way := search(initials, wrong, entry, [q]))}
                out.append((g, at, ways))
            yield _batch(out)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, at, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got: Ways | None = None
                for p in parts:
                    ways = {(w["entry"], w["exit"]): (w["cost"], w["edits"]) for w in p["ways"]}
                    got = ways if got is None else _joined(got, ways)
                out.append((g, at, got))
            yield _batch(out)

    ways = cut(blocks.mapInArrow(within, _WAYS))
    most = ways.agg(F.max("block")).first()[0] or 0
    while most:
        parts = ways.groupBy("g", F.floor(F.col("block") / fan).cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("parts"))
        ways, most = cut(parts.mapInArrow(across, _WAYS)), most // fan
    ends = F.filter("ways", lambda w: (w.entry == NONE) & w.exit.isin(*ENDS))
    least = F.array_min(F.transform(ends, lambda w: F.struct(w.cost, w.edits)))
    return ways.select("g", least.alias("w")).select("g", F.col("w.cost").alias("cost"), F.col("w.edits").alias("audit"))


_EDITS = "g string, seq long, edits string, place long, offset int"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a conversation, and for the place after the last, what the audit does there, how much has been put out before and whether that began with a system row (then an odd number is put out)."""
    for b in batches:
        for g, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            offset = (len(audit) - audit.count("D")) % 2
            seq = place = begin = 0
            out: list[list] = [[], [], []]
            for i, e in enumerate([*audit, "$"]):
                if e != "I":
                    told = audit[begin : i + 1]
                    if told:
                        for column, v in zip(out, (seq, told, place), strict=True):
                            column.append(v)
                    place += sum(x != "D" for x in told)
                    seq, begin = seq + 1, i + 1
                    if len(out[0]) >= 10_000 or e == "$":
                        n = len(out[0])
                        yield pa.record_batch({"g": pa.array([g] * n, pa.string()), "seq": pa.array(out[0], pa.int64()), "edits": pa.array(out[1], pa.string()), "place": pa.array(out[2], pa.int64()), "offset": pa.array([offset] * n, pa.int32())})
                        out = [[], [], []]


def examine(turns: DataFrame) -> DataFrame:
    """Rows (g, seq, conv_id, turn, role, text, initial, fault, illegal) of turns(conv_id, turn, role, text) in order.

    Nulls in role and text are one space; a null conv_id is a conversation of its own. A conversation's rows go by turn,
    nulls first, then by role and the SHA-256 of the text. fault: b(lank), without anything but ASCII white space; else
    d(uplicate), of an earlier row's role and text; else t(runcated), if the last character that is no white space is none of
    `.!?`; else k. illegal: the row's initial may not follow that of the row before.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    g = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("g")
    last = F.substring(F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1), 1, 1)
    initial = F.substring(role, 1, 1)
    rows = turns.select(g, "conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("sha"), F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("k").alias("own"))
    at = numbered(laid(cut(rows), ["g"], ["turn", "role", "sha"]), ["g"], "seq")
    at = cut(neighbours(at, ["g"], {"before": "initial"}).drop("part_"))
    # rows meet the first one of their kind by its place, of which there is one, and not by what may be in a third of all rows
    first = at.groupBy("g", "role", "sha").agg(F.min("seq").alias("seq")).select("g", "seq", F.lit(True).alias("first"))
    fault = F.when(F.col("own") == "b", "b").when(F.col("first").isNull(), "d").otherwise(F.col("own"))
    illegal = F.coalesce(~F.concat("before", "initial").isin("su", "ua", "au"), F.lit(False))
    return at.join(first, ["g", "seq"], "left").select("g", "seq", "conv_id", "turn", "role", "text", "initial", fault.alias("fault"), illegal.alias("illegal"))


def repair(turns: DataFrame, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) of turns(conv_id, turn, role, text), read as `examine` says.

    conversations(g, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): gaps counts the turns missing
    between the smallest and the largest, 0 if all are null; audit has a letter for each edit in order. Keeping costs
    nothing, reroling to user or assistant 1, deleting 2, inserting an empty row of either 5, and not deleting a truncated
    row 5 more; blank and duplicate rows are deleted. Of equal costs the least audit wins.
    rows(g, place, conv_id, turn, role, text, edit): what is left, numbered from 0; inserted rows have no turn. Empty tables give empty ones; other columns are left out. A conversation's rows are
    spread over all tasks by number, whatever their count.
    """
    seen = cut(examine(turns))
    plan = cut(audits(seen.select("g", "seq", "initial", "fault"), block))
    wrong = lambda f: F.count_if(F.col("fault") == f)
    counts = seen.groupBy("g").agg(F.first("conv_id").alias("conv_id"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), wrong("b").alias("blank"), wrong("d").alias("duplicate"), wrong("t").alias("truncated"), F.count_if("illegal").alias("illegal"))
    distinct = seen.select("g", "turn").distinct().groupBy("g").agg(F.count("turn").alias("turns"))
    wide = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1 - F.col("turns")
    told = counts.join(distinct, "g").join(plan, "g").select("g", "conv_id", F.coalesce(wide, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    each = plan.select("g", "audit").mapInArrow(_edits, _EDITS).join(seen.select("g", "seq", "turn", "role", "text"), ["g", "seq"], "left")
    each = each.select("g", "place", "offset", "turn", "role", "text", F.posexplode(F.split("edits", "")).alias("k", "edit")).filter("edit IN ('I', 'K', 'R')")
    place, own = F.col("place") + F.col("k"), F.col("edit") != "I"
    role = F.when(F.col("edit") == "K", F.col("role")).when((F.col("place") + F.col("k") - F.col("offset")) % 2 == 0, "user").otherwise("assistant")
    conv = F.when(F.col("g") != "", F.expr("substring(g, 2)")).cast(turns.schema["conv_id"].dataType)
    rows = each.select("g", place.alias("place"), conv.alias("conv_id"), F.when(own, F.col("turn")).alias("turn"), role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"), "edit")
    return told, rows


def digests(rows: DataFrame) -> DataFrame:
    """(g, sha256) of the lines `role:text` of each conversation's rows(g, place, role, text), joined by newlines.

    A digest needs its rows one after another: they are sorted, on disk if need be, and streamed, so that a task keeps no
    more than a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, None
        row = lambda: pa.record_batch({"g": pa.array([known], pa.string()), "sha256": pa.array([state.hexdigest()], pa.string())})
        for b in batches:
            for g, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g == known:
                    state.update(b"\n")
                else:
                    if state:
                        yield row()
                    known, state = g, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
        if state:
            yield row()

    return rows.repartition("g").sortWithinPartitions("g", "place").select("g", "role", "text").mapInArrow(run, "g string, sha256 string")
