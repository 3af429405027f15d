"""Exact n-gram Jaccard self-join: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Each text becomes the sorted set of 64-bit hashes of its n-word shingles. Equal sets are one class, numbered by one of its
   rows (aggregated with map-side combining, so groups of copies cost one row each). All later steps work on class numbers, never on ids.
2. Bands of set sizes: two linked sets lie in one band, or the larger lies at most 1/t above the band of the smaller.
   The hash space is cut into K parts. Linked sets differ in at most k elements, so at least K - k parts are
   equal; K leaves room for empty ones. Sets with too many empty parts repeat under another seed, and after the
   last seed share tiles by prefix elements. So every linked pair shares a key, whatever the data; no key is capped.
3. Keys are reduced to (set, one set with that key: the smallest, or for hot keys one found on a sample). The sets around one such
   pivot form a tile; large tiles are split into blocks that meet pairwise. In a tile bitmaps bound each overlap from above: elements hashed to
   bits that the other lacks cannot be shared. What passes gives a forest of candidates, whose components are families.
4. Families (blocked alike) intersect the sorted arrays of the pairs that pass the bound and are not yet joined.

Null and empty texts have no shingles and link with nothing; their component is their own id. Every row is a node of its own: rows that repeat an id
with different texts are not joined by it, and a row of null id links like any other. A component's id is the smallest id in it, null if
all are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, grouped, saved
from .textscan import U64, buffers, chunks, grams, mix, word_hashes, words

BLOCK = 384
BROADCAST_ROWS = 1_000_000
SEEDS = 3
#: A key is hot if it has more than 1 / HOT_SHARE of the sampled rows of repeated keys, so that there are fewer than HOT_SHARE hot keys.
SAMPLE, HOT_SHARE = 64, 20_000
#: Rows (key, set) that a task sorts at once, about; more of them are dealt over more tasks than the session's number of partitions.
TASK_KEYS = 500_000


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    data, offsets = buffers(column)
    starts, ends, word_offsets = words(data, offsets)
    hashes, at = grams(word_hashes(data, starts, ends, True), word_offsets, n)
    return [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def bands(num: int, den: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest size of each band, from the smallest size at which different sets can link."""
    low, lows, highs = -(-num // (den - num)), [], []
    while low < top:
        high = max(low, low * 13 // 10)
        lows.append(low)
        highs.append(high)
        low = high + 1
    return np.array(lows), np.array(highs)


def keys_of(items: np.ndarray, num: int, den: int, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The tile keys of a set; see the module's step 2."""
    size = len(items)
    if size < lows[0]:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(lows, size, side="right")) - 1
    levels = [own] + [b for b in (own - 1, own - 2, own - 3, own - 4, own - 5) if b >= 0 and size <= highs[b] * den // num]
    out = []
    for level in levels:
        high = int(highs[level])
        k = (den - num) * (high + high * den // num) // (den + num)
        spare = 1 + (k + 1) * 3 // 100
        parts = k + 1 + spare
        for seed in range(SEEDS + 1):
            tag = U64(level * 8 + seed)
            if seed == SEEDS:
                prefix = size - (-(-num * size // den)) + 1
                out.append(mix(items[:prefix] ^ mix(np.array([tag + U64(7 << 32)]))))
                break
            spread = items if seed == 0 else np.sort(mix(items + U64(seed * 0x51ED270B)))
            part = ((spread >> U64(32)) * U64(parts)) >> U64(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            total = np.add.reduceat(mix(spread ^ U64(0x5851F42D4C957F2D)), first)
            out.append(mix(total ^ mix(part[first] * U64(64 * 1024) + tag)))
            if parts - len(first) <= spare:
                break
    return np.concatenate(out)


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of `bits` (a multiple of 64) bits in which each element sets one bit."""
    at = (((items * U64(0xD6E8FEB86659FD93)) >> U64(32)) * U64(bits)) >> U64(32)
    flags = np.zeros(bits, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def width(size: int, factor: int) -> int:
    """Bits of a bitmap for sets about as large: a power of two, so near sizes mostly agree."""
    return max(64, 1 << int(size * factor - 1).bit_length())


def fold_to(bits: np.ndarray, words_: int) -> np.ndarray:
    """A power-of-two bitmap made narrower; the bound stays valid."""
    step = len(bits) // words_
    flags = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(words_ * 64, step).any(axis=1)
    return np.packbits(flags, bitorder="little").view(np.uint64)


class Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)
            self.edges.append((a, b))


def tile_forest(sizes: np.ndarray, maps: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None, halves: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning edges of the rows (sorted by size) whose overlap bound, and with `sets` whose overlap, reaches t.

    `halves` (0, 1 per row) leaves pairs within one half to other tiles.
    """
    forest = Forest(len(sizes))
    for i in range(len(sizes) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        later = np.arange(i + 1, end)
        later = later[forest.label[later] != forest.label[i]]
        if halves is not None:
            later = later[halves[later] != halves[i]]
        if not len(later):
            continue
        mine, others = maps[i], maps[later]
        bound = np.minimum(sizes[i] - np.bitwise_count(mine & ~others).sum(axis=1, dtype=np.int64), sizes[later] - np.bitwise_count(others & ~mine).sum(axis=1, dtype=np.int64))
        for j in later[(den + num) * bound >= num * (sizes[i] + sizes[later])]:
            if forest.label[j] == forest.label[i]:
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both < num * (sizes[i] + sizes[j] - both):
                    continue
            forest.join(i, int(j))
    return forest.edges


def _features(n: int, num: int, den: int):
    """Size, two sums that name the set, bitmap, packed tile keys and their number, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = bands(num, den)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column(part.schema.get_field_index("text")), n)
                sums = np.array([(np.sum(mix(s), dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ U64(0xA5A5A5A5)))) if len(s) else (0, 0) for s in sets], np.uint64).reshape(-1, 2)
                links = [len(s) >= lows[0] for s in sets]
                bits = [bitmap(s, width(len(s), 4)).tobytes() if ok else None for s, ok in zip(sets, links, strict=True)]
                keys = [keys_of(s, num, den, lows, highs).tobytes() if ok else None for s, ok in zip(sets, links, strict=True)]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(bits, pa.binary()), pa.array(keys, pa.binary()), pa.array([len(k) // 8 if k else 0 for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), part.column(part.schema.get_field_index("h")), *columns], ["id", "h", "n", "s1", "s2", "bits", "keys", "count"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (id, key) for each tile key of each class."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            packed = part.column(part.schema.get_field_index("keys"))
            lengths = np.array([len(k) // 8 for k in packed.to_pylist()], np.int64)
            ids = part.column(part.schema.get_field_index("id")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, lengths)), pa.array(np.frombuffer(b"".join(packed.to_pylist()), np.int64))], ["id", "key"])


def _tiles(num: int, den: int, exact: bool):
    """Forests of tiles (g, i, j); exact: of families, from sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int]] = []
        for tile in grouped(batches, ["g", "i", "j"]):
            tile = tile.sort_by([("n", "ascending"), ("id", "ascending")])
            if tile.num_rows < 2:
                continue
            sizes, ids = tile["n"].to_numpy(), tile["id"].to_numpy()
            raw = [np.frombuffer(x, np.uint64) for x in tile["bits"].to_pylist()]
            sets = raw if exact else None
            if exact:
                bits = width(int(sizes[-1]), 8)
                maps = np.stack([bitmap(x, bits) for x in raw])
            else:
                least = min(map(len, raw))
                maps = np.stack([x if len(x) == least else fold_to(x, least) for x in raw])
            halves = tile["half"].to_numpy() if tile["i"][0].as_py() != tile["j"][0].as_py() else None
            made += [(int(ids[a]), int(ids[b])) for a, b in tile_forest(sizes, maps, num, den, sets, halves)]
            if len(made) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], ["a", "b"])
                made = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _tiled(members: DataFrame, rows: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """Edges (a, b) of all tiles of rows (g, id, n, bits); members has their (g, id). A g of more than BLOCK rows is dealt into blocks by
    id hash; each pair of blocks is one tile, so a tile holds about two blocks whatever the group's size."""
    # Few g are large; their counts meet the rows where these lie, so that no task holds a whole g.
    large = saved(members.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK), "large")
    blocks = F.coalesce(F.ceil(F.col("c") / BLOCK), F.lit(1)).cast("int")
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "g", "left")
    rows = rows.withColumn("k", blocks).withColumn("o", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    rows = rows.select("g", "id", "n", "bits", "o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("p"))
    rows = rows.select("g", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), "id", "n", "bits", (F.col("o") > F.col("p")).cast("int").alias("half"))
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return rows.mapInArrow(_tiles(num, den, exact), "a long, b long")


def _dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """`rows`, of which there are `count`, by `keys` over as many tasks as give each TASK_KEYS; a session of enough partitions deals them itself."""
    tasks = -(-count // TASK_KEYS)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def ngram_classes(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: set size, and smallest id reachable by links of Jaccard
    similarity at least similarity[0] / similarity[1]."""
    rows = _groups(docs, n, similarity, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay when each group of linked texts keeps one row: that of the smallest id, null ids last; then of the smallest text hash.
    Of rows equal in id and text one stays. Rows without words are in no group and stay all."""
    rows = saved(_groups(docs, n, similarity, id_col, text_col).filter("n > 0").select("id", "h", "least", "group"), "groups")
    # In most groups the id alone decides. Where rows of the smallest id differ in text, or no row has an id, the hash does.
    first = rows.filter("id <=> least")
    tied = saved(first.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("best")).filter("n > 1").select("group", "best"), "tied")
    repeats = first.join(F.broadcast(tied) if tied.count() <= BROADCAST_ROWS else tied, "group")
    gone = saved(rows.filter("not (id <=> least)").select("id", "h").unionAll(repeats.filter("h <> best").select("id", "h")).distinct(), "gone")
    twice = saved(repeats.filter("h = best").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "h"), "twice")
    named = lambda keys: (F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys).withColumnsRenamed({"id": "__id", "h": "__gone"})
    same = F.expr(f"`{id_col}` <=> __id and __h = __gone")
    kept = docs.withColumn("__h", F.xxhash64(F.col(f"`{text_col}`").cast("string"))).join(named(gone), same, "left_anti")
    if not twice.isEmpty():
        some = named(twice)
        kept = kept.join(some, same, "left_anti").unionByName(kept.join(some, same, "left_semi").dropDuplicates([id_col, "__h"]))
    return kept.drop("__h")


def _groups(docs: DataFrame, n: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, least, group) of every row: the hash of its text, set size, least id and number of its group."""
    num, den = similarity
    if not 0 < num <= den:
        raise ValueError("similarity is a fraction above 0, at most 1")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    feats = base.mapInArrow(_features(n, num, den), "id long, h long, n long, s1 long, s2 long, bits binary, keys binary, count long")
    feats = saved(feats.withColumn("row", F.monotonically_increasing_id()), "shingles")
    classes = saved(feats.groupBy("n", "s1", "s2").agg(F.min("row").alias("class"), F.min("id").alias("low"), F.max("count").alias("count")), "classes")
    # Rows that do not stand for their class leave before any key is spread out.
    copies = saved(feats.filter("count > 0").select("row").join(classes.select(F.col("class").alias("row")), "row", "left_anti"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    unique = feats.filter("count > 0").join(copies, "row", "left_anti")
    make = lambda rows: rows.select(F.col("row").alias("id"), "keys").mapInArrow(_keys, "id long, key long")
    # Keys that more than one in HOT_SHARE rows has are found on every SAMPLE-th class by hash. Any set with the key can be its
    # pivot, so theirs is fixed beforehand and their rows are spread over tasks; no window gathers them. Others take the smallest set.
    counted = make(unique.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("pivot")).filter("c > 7")
    counted = saved(counted, "counts")
    total = counted.agg(F.sum("c").alias("total"))
    hot = saved(counted.crossJoin(F.broadcast(total)).filter(F.col("c") * HOT_SHARE > F.col("total")).select("key", "pivot"), "hot", (counted,))
    keyed = make(unique).join(F.broadcast(hot), "key", "left")
    salt = F.when(F.col("pivot").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(4096)).cast("int") + 1)
    keyed = _dealt(keyed.withColumn("salt", salt), classes.agg(F.sum("count")).first()[0] or 0, "key", "salt")
    keyed = keyed.withColumn("g", F.coalesce("pivot", F.min("id").over(Window.partitionBy("key", "salt")))).filter("g <> id")
    stars = saved(keyed.select("g", "id").distinct(), "stars", (hot,))
    stars = stars.unionAll(stars.select("g", F.col("g").alias("id")).distinct())
    maps = unique.select(F.col("row").alias("id"), "n", "bits").join(stars.select("id").distinct(), "id", "left_semi")
    families = saved(components(saved(_tiled(stars, stars.join(maps, "id"), num, den, False), "candidates")), "families")
    members = saved(unique.select(F.col("row").alias("class"), "id", "h").join(families.select(F.col("node").alias("class"), F.col("component").alias("g")), "class"), "members")
    small = members.count() <= BROADCAST_ROWS
    named = members.select("g", "class", F.col("id").alias("own"), F.col("h").alias("own_h"))
    texts = base.join(F.broadcast(named) if small else named, F.expr("id <=> own and h = own_h")).select("g", F.col("class").alias("id"), "text")
    # Rows equal in id and text stand for one class: one of them is enough.
    arrays = texts.mapInArrow(_arrays(n), "g long, id long, n long, bits binary").groupBy("g", "id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    arrays = saved(arrays, "arrays")
    links = saved(components(saved(_tiled(arrays.select("g", "id"), arrays, num, den, True), "links")), "linked")
    # The smallest id of every component of several classes; any other class keeps its own.
    low = links.join(classes.select(F.col("class").alias("node"), "low"), "node")
    low = low.select("node", "component").join(low.groupBy("component").agg(F.min("low").alias("least")), "component")
    linked = F.col("component").isNotNull()
    owner = classes.join(low.select(F.col("node").alias("class"), "component", "least"), "class", "left")
    owner = owner.select("n", "s1", "s2", F.when(linked, F.col("least")).otherwise(F.col("low")).alias("least"), F.coalesce("component", "class").alias("group"))
    return feats.select("id", "h", "n", "s1", "s2").join(owner, ["n", "s1", "s2"], "left").select("id", "h", "n", "least", "group")


def _arrays(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column(part.schema.get_field_index("text")), n)
                ids, groups = (part.column(part.schema.get_field_index(c)) for c in ("id", "g"))
                yield pa.RecordBatch.from_arrays([groups, ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["g", "id", "n", "bits"])

    return run
