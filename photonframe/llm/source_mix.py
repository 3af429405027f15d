"""Mixing sources to target weights by min-cost flow.

A document belongs to one source or to several that overlap. Documents are aggregated by membership pattern (the set of their
sources). A flow routes each pattern's words to its sources' quotas: the first use of a word costs nothing, and each further
use costs more (convex), so that repetition is spent only where a quota needs it. Each pattern's flow is then a whole number of uses of
all its documents and one more of some, drawn in the order of a seeded hash: the cut is found in two rounds of 256 buckets a
pattern, counted with map-side combining, and in the last bucket by groups of equal id and size, of which as many rows are taken as
bring the sum nearest. No source's rows are gathered in one task.

Sources weigh `weights` in turn, in code point order, null last. Targets share `share` of all words by weight; none is above
`cap` times its source's words, the excess being shared again by weight. Empty and null texts have size 0 and are taken 0 times.
Patterns go to the driver and are bounded by `max_patterns`; more raise an error. Repeated rows count each, rows of
null id as well; which of the rows equal in id and size are taken is left open, how many is not.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], total: Fraction, cap: int) -> list[Fraction]:
    """Shares of `total` by weight, none above `cap` times its size."""
    out, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), total
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > cap * sizes[i] * whole]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            free.discard(i)
        left = total - sum(out)
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], cap: int) -> list[int]:
    """Words taken of each pattern (its sources, its size): a maximal flow to the quotas of least cost, use k of a pattern costing k - 1.

    Successive shortest paths. Only uses cost, so all paths of one cost are exhausted before the next: rounds of uses, in each of
    which paths may reroute what earlier ones sent.
    """
    sent = [dict.fromkeys(members, 0) for members, _ in patterns]
    taken, got = [0] * len(patterns), [0] * len(quotas)
    # Patterns that send words to a source: only these can be rerouted away from it.
    senders: list[set[int]] = [set() for _ in quotas]
    # What a failed search has seen leads to no free quota, then or later: no path enters it again.
    dead: set[tuple[str, int]] = set()
    for use in range(1, cap + 1):
        for p, (members, size) in enumerate(patterns):
            while (room := use * size - taken[p]) > 0 and members and ("p", p) not in dead:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                queue, end = deque([("p", p)]), None
                while queue and end is None:
                    kind, i = at = queue.popleft()
                    for to in [("s", s) for s in patterns[i][0]] if kind == "p" else [("p", q) for q in senders[i]]:
                        if to not in came and to not in dead:
                            came[to] = at
                            queue.append(to)
                            if to[0] == "s" and got[to[1]] < quotas[to[1]]:
                                end = to
                                break
                if end is None:
                    dead.update(came)
                    break
                path, at = [end], came[end]
                while at is not None:
                    path.append(at)
                    at = came[at]
                path.reverse()
                back = [sent[path[k + 1][1]][path[k][1]] for k in range(1, len(path) - 1, 2)]
                flow = min(room, quotas[end[1]] - got[end[1]], *back)
                for k in range(0, len(path) - 1, 2):
                    sent[path[k][1]][path[k + 1][1]] += flow
                    senders[path[k + 1][1]].add(path[k][1])
                for k in range(1, len(path) - 1, 2):
                    sent[path[k + 1][1]][path[k][1]] -= flow
                    if not sent[path[k + 1][1]][path[k][1]]:
                        senders[path[k][1]].discard(path[k + 1][1])
                taken[p] += flow
                got[end[1]] += flow
    return taken


def _cut(rows: DataFrame, column: Column) -> DataFrame:
    """Per pattern (p, left) of rows: the bucket in which the running size passes `left`, and what is left at its start."""
    sums = rows.groupBy("p", "left", column.alias("bucket")).agg(F.sum("size").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).filter("before <= left and left < before + b")
    return sums.select("p", F.col("bucket").alias("cut"), (F.col("left") - F.col("before")).alias("rest"))


def _uses(docs: DataFrame, keep: tuple[str, ...], id_col: str, text_col: str, sources: Column | None, weights: tuple[int, ...], share: Fraction, cap: int, seed: int, max_patterns: int) -> DataFrame:
    """(id, keep as __0..., members, size, source_size, target, uses) of every row."""
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce(sources if sources is not None else F.array(F.col("source").cast("string")), F.array(F.lit(None).cast("string")))))
    rows = docs.select(
        F.col(id_col).alias("id"), *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)), members.alias("members"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("r"),
    )
    light = saved(rows.select("id", "members", "size", "r"), "sizes")
    if not keep:
        rows = light
    found = light.groupBy("members").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found = sorted(found, key=lambda x: [(s is None, s or "") for s in x.members])
    names = sorted({s for x in found for s in x.members}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [sum(x.size for x in found if s in x.members) for s in names]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(x.size for x in found), cap)
    taken = route([(tuple(number[s] for s in x.members), x.size) for x in found], [int(t) for t in wanted], cap)
    plan = []
    for x, t in zip(found, taken, strict=True):
        first = number[x.members[0]] if x.members else None
        uses = t // x.size if x.size else 0
        plan.append((x.members, len(plan), uses, t - uses * x.size, sizes[first] if x.members else 0, float(wanted[first]) if x.members else 0.0))
    plan = F.broadcast(spark.createDataFrame(plan, "members array<string>, p int, uses long, left long, source_size long, target double"))
    high, low = F.shiftright("r", 56), F.shiftright("r", 48)
    light = light.join(plan, "members")
    first = saved(_cut(light, high), "cut")
    inner = light.join(F.broadcast(first), "p").filter(high == F.col("cut")).withColumn("left", F.col("rest")).drop("cut", "rest")
    second = saved(_cut(inner, low), "cut")
    # In the last bucket rows equal in id and size are one group, null ids too; so many of the group at the cut are taken that the sum is nearest.
    groups = inner.drop("left").join(F.broadcast(second), "p").filter(low == F.col("cut")).groupBy("p", "rest", "r", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    mine = F.struct("r", "id", "size")
    window = Window.partitionBy("p").orderBy("r", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(window), F.lit(0))).filter("size > 0 and before <= rest")
    last = groups.groupBy("p").agg(F.max(F.struct(mine.alias("mark"), "n", F.round((F.col("rest") - F.col("before")) / F.col("size")).cast("long").alias("fit"))).alias("e"))
    last = last.select("p", F.col("e.mark").alias("mark"), F.least("e.fit", "e.n").alias("fit"), (F.col("e.fit") < F.col("e.n")).alias("parted"))
    marks = first.select("p", F.col("cut").alias("c1")).join(F.broadcast(second.select("p", F.col("cut").alias("c2"))), "p", "left").join(F.broadcast(last), "p", "left")
    out = rows.join(plan, "members").join(F.broadcast(saved(marks, "marks")), "p", "left")
    at_cut = F.coalesce((high == F.col("c1")) & (low == F.col("c2")) & F.col("mark").isNotNull(), F.lit(False))
    below = (high < F.col("c1")) | ((high == F.col("c1")) & (low < F.col("c2"))) | (at_cut & (mine < F.col("mark")))
    out = out.withColumn("more", F.coalesce(below, F.lit(False))).withColumn("tied", at_cut & (mine == F.col("mark")))
    out = out.withColumn("more", F.col("more") | (F.col("tied") & (F.col("fit") > 0)))
    # Most often the group at the cut is one row. Where it is taken in part, its rows are numbered file by file, whatever their number.
    if not saved(last.filter("parted and fit > 0"), "parted").isEmpty():
        tied = saved(out.filter("tied and parted").withColumn("row", F.monotonically_increasing_id()), "tied")
        file = F.shiftright("row", 33)
        counts = tied.groupBy("p", file.alias("file")).agg(F.count(F.lit(1)).alias("c"))
        ahead = F.coalesce(F.sum("c").over(Window.partitionBy("p").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("p", "file", ahead.alias("ahead"))
        number = F.row_number().over(Window.partitionBy("p", "file").orderBy("row"))
        tied = tied.withColumn("file", file).join(F.broadcast(counts), ["p", "file"]).withColumn("more", F.col("ahead") + number <= F.col("fit"))
        out = out.filter("not (tied and coalesce(parted, false))").unionByName(tied.select(*out.columns))
    return out.withColumn("uses", F.col("uses") + F.col("more").cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 1, max_patterns: int = 20_000) -> DataFrame:
    """(id_col, members, size, source_size, target, taken) of every row. `sources` is an array of strings, null elements allowed;
    source_size and target are those of the first of a document's sources."""
    out = _uses(docs, (), id_col, text_col, sources, weights, share, cap, seed, max_patterns)
    return out.select(F.col("id").alias(id_col), "members", "size", "source_size", "target", (F.col("size") * F.col("uses")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2, seed: int = 1, max_patterns: int = 20_000) -> DataFrame:
    """Every row of `docs` as often as the mix takes it; a row without words stays once."""
    keep = tuple(docs.columns)
    out = _uses(docs, keep, id_col, text_col, sources, weights, share, cap, seed, max_patterns)
    uses = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("uses")).cast("int")
    out = out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), F.explode(F.array_repeat(F.lit(0), uses)).alias("__use"))
    return out.drop("__use")
