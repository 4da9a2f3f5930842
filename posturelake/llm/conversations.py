"""Conversations with missing, repeated or misplaced turns, repaired by the cheapest edits.

A repaired conversation's roles are ``(s?(ua)+)?`` by their initials. Its rows are read in order by an automaton; a row is deleted, kept or given another role, and
empty turns are inserted. The cheapest edits are searched by iterative-deepening A*: depth first in ASCII order of the edits, under a cost bound that rises to the least
cost that broke it, with a table of states that failed under the bound. The first accepting path is the cheapest and, among those, ASCII-least.

A conversation is searched in segments of SEGMENT rows, so that one that holds a third of all rows is no single task's work. What a segment costs from each state of the automaton to
each is a matrix of 4 x 4; products of these give what the rest of a conversation costs from each state at a segment's end, which is all that its search
needs to know of the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.numbering import number_rows
from .common import SPACE_CLASS, map_batches

SEGMENT = 32  # rows that are searched at a time; bounds rise as often as they are missed, so that long segments cost with their square
FAN = 256  # segments whose matrices are multiplied at a time
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 50
#: States: nothing yet, after system, after user, after assistant. The role that may come next in each, and where the roles lead.
NEXT = ("u", "u", "a", "u")
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
STATES = range(4)
ACCEPT = (0, NEVER, NEVER, 0)
ROLES = {"u": "user", "a": "assistant"}


def _legal(codes: str, k: int) -> bool:
    return codes[2 * k] + codes[2 * k + 2] in ("su", "ua", "au")


def _moves(codes: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edits at row ``i`` in ASCII order: letter, cost, next row, next state. A row's code is its role's initial and its fault: b(lank), d(uplicate), t(runcated) or - for none."""
    moves, more = [], 2 * i < len(codes)
    if more:
        moves.append(("D", DELETE, i + 1, state))
    moves.append(("I", INSERT, i, STEPS[state][NEXT[state]]))
    if more and codes[2 * i + 1] in "t-":
        extra = TRUNCATED if codes[2 * i + 1] == "t" else 0
        if codes[2 * i] in STEPS[state]:
            moves.append(("K", extra, i + 1, STEPS[state][codes[2 * i]]))
        moves.append(("R", REROLE + extra, i + 1, STEPS[state][NEXT[state]]))
    return moves


def _least(initial: str, fault: str) -> int:
    """What a row costs at least, whatever the state."""
    if fault in "bd":
        return DELETE
    other = 0 if initial in "sua" else REROLE
    return min(DELETE, other + (TRUNCATED if fault == "t" else 0))


@lru_cache(1 << 14)
def cheapest(codes: str, state: int = 0, end: tuple[int, ...] = ACCEPT) -> tuple[str, int, int]:
    """(edits, cost, state after them) for the rows ``codes``, entered in ``state``; ``end`` is what follows costs from each state."""
    n, rest = len(codes) // 2, [min(end)]
    for k in range(n - 1, -1, -1):
        rest.append(rest[-1] + _least(codes[2 * k], codes[2 * k + 1]))
    rest.reverse()  # of row i and all that follows
    if min(end) >= NEVER:
        return "", NEVER, state
    bound = rest[0]
    while True:
        above, failed = NEVER, {}
        path: list[tuple[str, int, int, int, Iterator]] = [("", 0, 0, state, iter(()))]
        push = True
        while path:
            _, cost, i, at, _ = path[-1]
            if push:
                if i == n and cost + end[at] <= bound:
                    return "".join(p[0] for p in path), cost, at
                total = cost + rest[i]
                if total > bound or failed.get((i, at), NEVER) <= cost:
                    above = min(above, total) if total > bound else above
                    path.pop()
                    push = False
                    continue
                failed[i, at] = cost  # while it is open no cheaper way leads back to it
                path[-1] = (*path[-1][:4], iter(_moves(codes, i, at)))
                if i == n and end[at] < NEVER:
                    above = min(above, cost + end[at])
            move = next(path[-1][4], None)
            if move is None:
                path.pop()
                push = False
            else:
                letter, more, i, to = move
                path.append((letter, cost + more, i, to, iter(())))
                push = True
        bound = above


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


_STAY = np.where(np.eye(4, dtype=bool), 0, NEVER)


def matrix(codes: str) -> np.ndarray:
    """What the rows cost at least from each state to each; insertions before a row count with it."""
    insert = _STAY.copy()
    for q in STATES:
        insert[q, STEPS[q][NEXT[q]]] = INSERT
    insert = _product(insert, insert)
    out = _STAY
    for k in range(len(codes) // 2):
        row = np.full((4, 4), NEVER)
        for q in STATES:
            for letter, cost, i, to in _moves(codes, k, q):
                if i > k:
                    row[q, to] = min(row[q, to], cost)
        out = _product(_product(out, insert), row)
    return out


def _map_rows(df: DataFrame, f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in b.to_pylist() for x in f(row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(arrow), arrow.types)], schema=arrow)

    return map_batches(df, each, schema)


def _scan(parts: DataFrame, kind: str, back: bool) -> DataFrame:
    """(conv, seg, v) of (conv, seg, m): the vector that the matrices before a segment make of the start, or (``back``) those behind it of the accepting states.

    FAN matrices are multiplied at a time, then the products in the same way, so that no row or task grows with a conversation.
    """
    schema = f"conv {kind}, seg long"
    groups = parts.groupBy("conv", F.expr(f"seg div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("seg", "m"))).alias("parts"))
    groups = cut(groups)
    start = F.array(*[F.lit(x).cast("long") for x in (ACCEPT if back else (0, NEVER, NEVER, NEVER))])
    if groups.where("up > 0").isEmpty():
        groups = groups.withColumn("v", start)
    else:

        def multiply(row: dict) -> list[tuple]:
            out = _STAY
            for p in row["parts"]:
                out = _product(out, np.array(p["m"]).reshape(4, 4))
            return [(row["conv"], row["up"], out.ravel().tolist())]

        upper = _scan(_map_rows(groups.select("conv", "up", "parts"), multiply, f"{schema}, m array<long>"), kind, back)
        upper = upper.select(F.col("conv").alias("same"), F.col("seg").alias("above"), "v")
        groups = groups.join(upper, F.col("conv").eqNullSafe(F.col("same")) & (F.col("up") == F.col("above"))).select("conv", "up", "parts", "v")

    def walk(row: dict) -> list[tuple]:
        v, out = np.array(row["v"]), []
        for p in reversed(row["parts"]) if back else row["parts"]:
            out.append((row["conv"], p["seg"], v.tolist()))
            m = np.array(p["m"]).reshape(4, 4)
            v = np.minimum((m + v).min(axis=1) if back else (m + v[:, None]).min(axis=0), NEVER)
        return out

    return _map_rows(groups.select("conv", "parts", "v"), walk, f"{schema}, v array<long>")


def damage(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with planted faults by CRC-32 of ``conv_id:turn``: a twentieth each goes, loses its text, loses its sentence ends, is repeated, or is the user's. Nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    held = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return held.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, pos, fault) of (conv, turn, role, text): places by turn, nulls first; rows of one turn by role and text. Fault: b, d, t or -."""
    rows = number_rows(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], within=["conv"], out="pos")
    what = [F.col("conv"), F.col("role"), F.md5("text")]
    first = rows.groupBy(*[x.alias(c) for x, c in zip(what, ("same", "own", "digest"))]).agg(F.min("pos").alias("first"))
    joined = rows.join(first, F.col("conv").eqNullSafe(F.col("same")) & (F.col("role") == F.col("own")) & (F.md5("text") == F.col("digest")))
    last = F.right(F.regexp_replace("text", f"{SPACE_CLASS}+$", ""), F.lit(1))
    fault = F.when(last == "", "b").when(F.col("pos") > F.col("first"), "d").when(last.isin(".", "!", "?"), "-").otherwise("t")
    return joined.select("conv", "turn", "role", "text", "pos", fault.alias("fault"))


def _initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def audits(rows: DataFrame) -> DataFrame:
    """(conv, seg, codes, audit, cost, illegal, entry): each segment of ``numbered`` rows, its cheapest edits, and the state that it is entered in."""
    kind = rows.schema["conv"].dataType.simpleString()
    # a segment's first row is also handed to the segment before, which counts illegal neighbours across the edge
    segs = F.when((F.col("pos") % SEGMENT == 0) & (F.col("pos") > 0), F.array(F.expr(f"pos div {SEGMENT}"), F.expr(f"pos div {SEGMENT} - 1"))).otherwise(F.array(F.expr(f"pos div {SEGMENT}")))
    segs = rows.select("conv", "pos", F.concat(_initial(F.col("role")), F.col("fault")).alias("code"), F.explode(segs).alias("seg"))
    segs = segs.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    segs = cut(segs.select("conv", "seg", F.array_join(F.transform("rows", lambda x: x["code"]), "").alias("codes")))
    whole, parts = segs.where(f"seg = 0 AND length(codes) <= {2 * SEGMENT}"), segs.where(f"seg > 0 OR length(codes) > {2 * SEGMENT}")

    def count(codes: str) -> int:
        return sum(not _legal(codes, k) for k in range(len(codes) // 2 - 1))

    def search(row: dict) -> list[tuple]:
        codes = row["codes"][: 2 * SEGMENT]
        found = [cheapest(codes, q, tuple(row["end"])) for q in (STATES if row["seg"] or len(row["codes"]) > len(codes) else (0,))]
        return [(row["conv"], row["seg"], codes, [a for a, _, _ in found], [c for _, c, _ in found], [q for _, _, q in found], count(row["codes"]))]

    schema = f"conv {kind}, seg long, codes string, audits array<string>, costs array<long>, exits array<int>, illegal long"
    accept = F.array(*[F.lit(x).cast("long") for x in ACCEPT])
    one = _map_rows(whole.withColumn("end", accept), search, schema).withColumn("entry", F.lit(0))
    if not parts.isEmpty():
        matrices = _map_rows(parts, lambda r: [(r["conv"], r["seg"], matrix(r["codes"][: 2 * SEGMENT]).ravel().tolist())], f"conv {kind}, seg long, m array<long>")
        on = F.col("conv").eqNullSafe(F.col("same")) & (F.col("seg") == F.col("at"))
        ends = _scan(matrices, kind, back=True).select(F.col("conv").alias("same"), F.col("seg").alias("at"), F.col("v").alias("end"))
        many = cut(_map_rows(parts.join(ends, on).select("conv", "seg", "codes", "end"), search, schema))
        lead = many.select("conv", "seg", F.flatten(F.transform("exits", lambda q: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k == q, F.lit(0)).otherwise(F.lit(NEVER)).cast("long")))).alias("m"))
        entries = _scan(lead, kind, back=False).select(F.col("conv").alias("same"), F.col("seg").alias("at"), (F.array_position("v", F.lit(0).cast("long")) - 1).cast("int").alias("entry"))
        one = one.union(many.join(entries, on).drop("same", "at"))
    return cut(one.select("conv", "seg", "codes", F.col("audits")[F.col("entry")].alias("audit"), F.col("costs")[F.col("entry")].alias("cost"), "illegal", "entry"))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, seg, line, role, text): the lines of each repaired conversation, by segment and line. Inserted ones have empty texts."""
    kind = rows.schema["conv"].dataType.simpleString()

    def lines(row: dict) -> list[tuple]:
        out, state, i = [], row["entry"], 0
        for letter in row["audit"]:
            if letter != "D":
                role = row["codes"][2 * i] if letter == "K" else NEXT[state]
                state = STEPS[state][role]
                out.append((row["conv"], row["seg"], len(out), None if letter == "I" else row["seg"] * SEGMENT + i, None if letter == "K" else ROLES[role]))
            i += letter != "I"
        return out

    lined = _map_rows(found.select("conv", "seg", "codes", "audit", "entry"), lines, f"conv {kind}, seg long, line long, pos long, role string")
    own = rows.select(F.col("conv").alias("same"), F.col("pos").alias("at"), F.col("role").alias("was"), "text")
    joined = lined.join(own, F.col("conv").eqNullSafe(F.col("same")) & (F.col("pos") == F.col("at")), "left")
    return joined.select("conv", "seg", "line", F.coalesce("role", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """(conv, sha): SHA-256 of ``role:text`` of a conversation's lines, joined by newlines. The hash takes its bytes in order, so one task reads a conversation's lines, but as a stream that holds none of them."""
    kind = lines.schema["conv"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run, out = None, None, []
        for b in batches:
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if run is None or conv != at:
                    out += [(at, run.hexdigest())] if run else []
                    at, run = conv, hashlib.sha256(line.encode())
                else:
                    run.update(b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.column(0).type), pa.array([o[1] for o in out], pa.string())], ["conv", "sha"])
                out = []
        if run:
            yield pa.RecordBatch.from_arrays([pa.array([at], b.column(0).type), pa.array([run.hexdigest()], pa.string())], ["conv", "sha"])

    dealt = lines.repartition("conv").sortWithinPartitions("conv", "seg", "line")
    return map_batches(dealt.select("conv", F.concat("role", F.lit(":"), "text").alias("text")), each, f"conv {kind}, sha string")


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of (conv_id, turn, role, text), after ``damage``.

    Each row's first fault counts: blank (no other than ASCII white space), duplicate (role and text seen earlier), truncated (its last such character ends no sentence).
    ``gaps`` are the turns missing between the least and the largest, ``illegal`` the neighbours whose role initials are not su, ua or au. ``audit`` has an edit's initial for each row and
    insertion: Delete, Insert, Keep, Rerole.

    Null conv_ids are one conversation, null turns come first, null roles and texts are one space. Rows that share a turn stand by role and text, so that equal rows are neighbours. An
    empty table gives no rows; a conversation that lost all rows has zeros. Further columns are not read. Texts of any length are streamed, a text must fit a task.
    """
    rows = cut(numbered(damage(conversations)))
    found = audits(rows)
    count = lambda fault, name: F.count_if(F.col("fault") == fault).alias(name)
    stats = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), count("b", "blank"), count("d", "duplicate"), count("t", "truncated"))
    edits = found.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    out = conversations.select("conv_id").distinct()
    for k, part in enumerate((stats, edits, digests(repaired(rows, found)))):
        out = out.join(part.withColumnRenamed("conv", f"same{k}"), F.col("conv_id").eqNullSafe(F.col(f"same{k}")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
