"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Rows of a conversation, by turn (nulls first; rows of one turn by role, then text), are kept (0), given another role (1) or deleted (2),
and empty user or assistant rows may be inserted anywhere (5); a blank row or one whose role and text occurred earlier must go, and a
truncated one that stays adds 5. The result's role initials are `(s?(ua)+)?`. Dijkstra's search runs on the implicit lattice of nodes
(rows read, grammar state); its priority key is (cost, audit), the audit being the initials of the edits, so the first accepting end node
that is popped has the least cost, and of equal costs the audit least in ASCII order. No two audits of one node have equal cost and
one as the other's beginning (the longer would hold an insertion more), so comparing beginnings is enough.

Conversations of more than SEGMENT rows are searched segment by segment, from every grammar state to every other, and segments are
joined in order; those with more rows or bytes than a task should hold are cut into segments across tasks, numbered and searched apart,
and only the results of segments, and for the digest the repaired texts in order, stream through one task each. Rows of one key never
meet in one task: a repeated text is found by the least position of each (conversation, role, text), aggregated before the shuffle.

Null ids are one conversation. A null role or text counts as one space; a role's initial is its first character, one that is empty or not
`s`, `u` or `a` must be changed or deleted. Conversations without rows have zeros, an empty audit and the digest of the empty text.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merkle import numbered
from .shared import grouped, saved

#: Edit costs: a new role, a deletion, an insertion, and what a truncated row adds that stays.
RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row; the state after each initial, and the one after a made row.
STATES = range(4)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (2, 2, 3, 2)
ACCEPTING = (0, 3)
#: Rows of one search.
SEGMENT = 1024
#: A conversation is cut across tasks beyond this many rows or bytes, or beyond one part in SHARE of all rows or bytes; so at most 2 SHARE are.
ROWS, BYTES, SHARE = 20_000, 32 << 20, 500_000
SPACES = " \t\n\x0b\x0c\r"

Row = tuple[str, bool, bool]  # initial, must go, truncated
Best = dict[int, tuple[int, str]]  # cost and audit for each end state


def cheapest(rows: list[Row], start: int, accepting: tuple[int, ...] | None = None) -> Best:
    """The least (cost, audit) from `start` over all rows: to the first accepting end state, or to each of them if none are named."""
    heap, done, found, n = [(0, "", 0, start)], set(), {}, len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        made = MADE[state]
        if i == n:
            if accepting is None or state in accepting:
                found[state] = (cost, audit)
                if accepting is not None:
                    break
        else:
            initial, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not must_go:
                more = cost + TRUNCATED * truncated
                if (kept := NEXT[state].get(initial)) is not None:
                    heapq.heappush(heap, (more, audit + "K", i + 1, kept))
                heapq.heappush(heap, (more + RETAG, audit + "R", i + 1, made))
        if (i, made) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, made))
    return found


class Joined:
    """Results of segments, joined in order. Audits that all surviving ways share are set aside, so ways are compared by what differs."""

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}

    def add(self, segment: dict[int, Best]) -> None:
        """`segment` has the results from each start state."""
        after: dict[int, tuple[int, str, tuple]] = {}
        for start, (cost, tail, way) in self.ways.items():
            for end, (more, audit) in segment[start].items():
                key = (cost + more, tail + audit)
                if end not in after or key < after[end][:2]:
                    after[end] = (*key, (way, start, audit))
        shared = len(commonprefix([tail for _, tail, _ in after.values()]))
        self.ways = {end: (cost, tail[shared:], way) for end, (cost, tail, way) in after.items()}

    def best(self) -> tuple[int, list[tuple[int, str]]]:
        """The least cost to an accepting state, and (start state, audit) of each segment."""
        cost, _, way = min(self.ways[s] for s in ACCEPTING if s in self.ways)
        parts = []
        while way:
            way, start, audit = way
            parts.append((start, audit))
        return cost, parts[::-1]


def repair(rows: list[Row]) -> tuple[int, str]:
    """The least cost and its audit for a whole conversation."""
    if len(rows) <= SEGMENT:
        return next(iter(cheapest(rows, 0, ACCEPTING).values()))
    joined = Joined()
    for at in range(0, len(rows), SEGMENT):
        part = rows[at : at + SEGMENT]
        joined.add({s: cheapest(part, s) for s in joined.ways})
    cost, parts = joined.best()
    return cost, "".join(audit for _, audit in parts)


def applied(rows: Iterator[tuple[str, str]], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """The (role, text) rows that an audit makes of given ones, read from grammar state `state` on."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if MADE[state] == 3 else "user"
        state = NEXT[state][role[:1]]
        yield role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of `conversations` as damage leaves them, by crc32("conv_id:turn") % 20: (conv_id, turn, role, text, copies), dropped rows with
    copies 0. Nulls count as one space, in ids and turns only for the damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    out = conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), kind.alias("__kind"))
    copies = F.when(F.col("__kind") == 0, 0).when(F.col("__kind") == 3, 2).otherwise(1)
    return out.select("conv_id", "turn", "role", F.when(copies == 0, F.lit("")).otherwise(F.col("text")).alias("text"), copies.alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with what Spark sees of their faults."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    return rows.withColumn("blank", end == "").withColumn("cut", ~F.right(end, F.lit(1)).isin(".", "!", "?"))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _digest(rows: Iterator[tuple[str, str]]) -> str:
    sha, between = hashlib.sha256(), b""
    for role, text in rows:
        sha.update(between + role.encode() + b":" + text.encode())
        between = b"\n"
    return sha.hexdigest()


def _small(rows: DataFrame) -> DataFrame:
    """Whole conversations, each in the task of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["__id"]):
            kept = group.filter(pc.greater(group["copies"], 0))
            turns, roles, texts = (kept[c].to_pylist() for c in ("turn", "role", "text"))
            counts, edits, seen = [0, 0, 0], [], set()
            for role, text, blank, cut in zip(roles, texts, kept["blank"].to_pylist(), kept["cut"].to_pylist(), strict=True):
                again = (role, text) in seen
                seen.add((role, text))
                edits.append((role[:1], blank or again, cut))
                if blank or again or cut:
                    counts[0 if blank else 1 if again else 2] += 1
            cost, audit = repair(edits)
            known = {t for t in turns if t is not None}
            gaps = max(known) - min(known) + 1 - len(known) if known else 0
            out = [gaps, *counts, _illegal([e[0] for e in edits]), cost, audit, _digest(applied(zip(roles, texts, strict=True), audit))]
            yield pa.RecordBatch.from_arrays([group["__id"].combine_chunks()[:1], *(pa.array([v]) for v in out)], ["__id", *(f.split()[0] for f in RESULT.split(", "))])

    every = rows.withColumn("__c", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).drop("__c")
    placed = _marked(every).repartition("__id").sortWithinPartitions("__id", F.col("turn").asc_nulls_first(), "role", "text")
    return placed.mapInArrow(run, f"__id string, {RESULT}")


def _large(rows: DataFrame) -> DataFrame:
    """Conversations cut into segments across tasks."""
    every = rows.withColumn("__c", F.explode(F.sequence(F.lit(1), "copies"))).drop("__c", "copies")
    placed = numbered(_marked(every), "__id", ["turn", "role", "text"], "conversations").withColumn("s", F.floor(F.col("pos") / SEGMENT).cast("long"))
    first = placed.groupBy("__id", "role", F.sha2("text", 256).alias("h")).agg(F.min("pos").alias("pos")).select("__id", "pos", F.lit(True).alias("first"))
    facts = placed.select("__id", "pos", "s", F.substring("role", 1, 1).alias("initial"), "blank", "cut").join(first, ["__id", "pos"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    facts = facts.select("__id", "s", "pos", "initial", fault.alias("fault"), "cut")
    names = ["__id", "s", "costs", "audits", "blank", "duplicate", "truncated", "illegal", "initials"]

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        initials, faults = table["initial"].to_pylist(), table["fault"].to_pylist()
        edits = [(i, f in (1, 2), c) for i, f, c in zip(initials, faults, table["cut"].to_pylist(), strict=True)]
        found = [cheapest(edits, s) for s in STATES]
        costs = [[best[e][0] if e in best else None for e in STATES] for best in found]
        audits = [[best[e][1] if e in best else None for e in STATES] for best in found]
        row = [table["__id"][0].as_py(), table["s"][0].as_py(), costs, audits, *(faults.count(f) for f in (1, 2, 3)), _illegal(initials), [initials[0], initials[-1]]]
        return pa.Table.from_pydict({n: [v] for n, v in zip(names, row, strict=True)})

    counts = "blank long, duplicate long, truncated long, illegal long"
    segments = facts.groupBy("__id", "s").applyInArrow(search, f"__id string, s long, costs array<array<long>>, audits array<array<string>>, {counts}, initials array<string>")

    ways = pa.schema([("__id", pa.string()), ("s", pa.int64()), ("start", pa.int32()), ("audit", pa.string()), *((c, pa.int64()) for c in (*COUNTS, "cost"))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each segment with its way, and one (s null) for the conversation."""
        for parts, key, counts, cost in _joined(batches):
            rows = [{"__id": key, "s": s, "start": start, "audit": audit} for s, (start, audit) in enumerate(parts)]
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema=ways)
            yield pa.RecordBatch.from_pylist([{"__id": key, "audit": "".join(a for _, a in parts), **counts, "cost": cost}], schema=ways)

    joined = saved(segments.repartition("__id").sortWithinPartitions("__id", "s").mapInArrow(join, f"__id string, s long, start int, audit string, {counts}, cost long"), "conversation-ways")

    def text(key: tuple, rows: pa.Table, way: pa.Table) -> pa.Table:
        """The repaired rows of a segment as one text."""
        rows = rows.sort_by("pos")
        made = [f"{r}:{t}" for r, t in applied(zip(rows["role"].to_pylist(), rows["text"].to_pylist(), strict=True), way["audit"][0].as_py(), way["start"][0].as_py())]
        return pa.Table.from_pydict({"__id": [key[0].as_py()], "s": [key[1].as_py()], "rows": [len(made)], "made": ["\n".join(made)]})

    way = joined.filter("s is not null").select("__id", "s", "start", "audit")
    texts = placed.select("__id", "s", "pos", "role", "text").groupBy("__id", "s").cogroup(way.groupBy("__id", "s")).applyInArrow(text, "__id string, s long, rows long, made string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams the texts of segments; only those of one batch are held."""
        last, sha, between = None, None, b""
        for batch in batches:
            for key, rows, made in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if key != last:
                    if last is not None:
                        yield pa.RecordBatch.from_pydict({"__id": [last], "repaired_sha256": [sha.hexdigest()]})
                    last, sha, between = key, hashlib.sha256(), b""
                if rows:
                    sha.update(between + made.encode())
                    between = b"\n"
        if last is not None:
            yield pa.RecordBatch.from_pydict({"__id": [last], "repaired_sha256": [sha.hexdigest()]})

    digests = texts.repartition("__id").sortWithinPartitions("__id", "s").mapInArrow(digest, "__id string, repaired_sha256 string")
    turns = placed.groupBy("__id", "turn").agg(F.lit(1).alias("one")).groupBy("__id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    whole = joined.filter("s is null").drop("s", "start")
    return whole.join(turns, "__id").join(digests, "__id").select("__id", *(f.split()[0] for f in RESULT.split(", ")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, str]], str, dict[str, int], int]]:
    """(start and audit of each segment, id, counts, cost) of conversations whose segments come in order."""
    joined, last, totals, end = Joined(), None, dict.fromkeys(COUNTS, 0), None

    def done():
        cost, parts = joined.best()
        return parts, last, totals, cost

    for batch in batches:
        for r in batch.to_pylist():
            if r["__id"] != last:
                if last is not None:
                    yield done()
                joined, last, totals, end = Joined(), r["__id"], dict.fromkeys(COUNTS, 0), None
            joined.add({s: {e: (c, a) for e, (c, a) in enumerate(zip(r["costs"][s], r["audits"][s], strict=True)) if c is not None} for s in STATES})
            for c in COUNTS:
                totals[c] += r[c]
            totals["illegal"] += 0 if end is None else _illegal([end, r["initials"][0]])
            end = r["initials"][1]
    if last is not None:
        yield done()


def repaired(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of rows (conv_id, turn,
    role, text, copies: how often a row stands, 0 for one that only names its conversation)."""
    kind = rows.schema["conv_id"].dataType
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = rows.withColumn("__id", key).drop("conv_id")
    sizes = rows.groupBy("__id").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.octet_length("text")).alias("bytes"))
    total = sizes.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    over = (F.col("rows") > max(most_rows, (total["rows"] or 0) // SHARE)) | (F.col("bytes") > max(most_bytes, (total["bytes"] or 0) // SHARE))
    large = saved(sizes.filter(over).select("__id"), "large-conversations")
    if large.isEmpty():
        out = _small(rows)
    else:
        # At most 2 SHARE ids.
        ids = F.broadcast(large)
        out = _small(rows.join(ids, "__id", "left_anti")).unionByName(_large(rows.join(ids, "__id", "left_semi").filter("copies > 0")))
    conv = F.when(F.col("__id") == "n", F.lit(None)).otherwise(F.expr("substring(__id, 2)")).cast(kind)
    return out.select(conv.alias("conv_id"), *(f.split()[0] for f in RESULT.split(", ")))
