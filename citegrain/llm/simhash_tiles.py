"""SimHash near-duplicates by exact comparison of tiles.

A text's fingerprint has a bit set where over half of the hashes of its three-word shingles, repeats
included, have it set. Equal fingerprints are one class, by map-side aggregation. Classes are dealt
into tiles: first by the population counts of the four quarters of their bits, then, where such a
cell holds more than TILE classes, by hash. Two fingerprints within three bits of each other differ
by at most three in the sum over their quarters' counts, so a pair of tiles beyond that radius is
skipped unseen, and no pair within it is lost. The other tile pairs are compared exactly, by
exclusive-or and bit counts of whole blocks.

A tile pair tells its links as a spanning forest, never as all pairs, so a group of near copies costs
a few edges a member. Classes join to components by shuffled rounds. Cells are at most 17^4, whatever
the input; a cell of any size is cut into tiles of bounded size, and each tile is compared by a task
of its own with those of its neighbourhood, read one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import Scratch, arrow_pass, bounded_batches, components, stored

WORDS = 3
SEED = 42
RADIUS = 3
QUARTERS = 4
TILE = 1 << 14
# Comparisons at once in a task, and those that one task is meant to do.
BLOCK = 1 << 21
TASK = 1 << 32
ROWS = 1 << 15
LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
# Fingerprints of more than 1 / HOT of all rows are joined apart: at most HOT of them.
HOT = 1000


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each run of WORDS words joined by single blanks; of all words where they are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    plain, hashed = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(WORDS, len(words)) - WORDS + 1
    spans = zip(starts[:last].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(plain[s:e], SEED) for s, e in spans), np.uint64, last)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat, cuts = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(sizes)))
    counts = np.zeros((len(hashes), 64), np.int64)
    for low in range(0, len(flat), ROWS):
        high = min(len(flat), low + ROWS)
        bits = np.unpackbits(flat[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owners = np.flatnonzero((cuts[:-1] < high) & (cuts[1:] > low) & (sizes > 0))
        heads = np.maximum(cuts[owners], low) - low
        counts[owners] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, print) of every row; zero where the text has no word."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = majority([shingle_hashes((t or "").encode()) for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return arrow_pass(slim, step, f"doc_id {dict(slim.dtypes)['doc_id']}, print long")


def cell_of(fingerprint: Column) -> Column:
    """Population counts of the four quarters as one number of four base-17 digits."""
    size = 64 // QUARTERS
    counts = [F.bit_count(F.shiftright(fingerprint, k * size).bitwiseAND((1 << size) - 1)) for k in range(QUARTERS)]
    return sum(((c * 17**k) for k, c in enumerate(counts)), F.lit(0)).cast("int")


def offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of cells within the radius, of each and its opposite only one."""
    found = [()]
    for _ in range(QUARTERS):
        found = [(*f, k) for f in found for k in range(-radius, radius + 1) if sum(map(abs, f)) + abs(k) <= radius]
    return [f for f in found if f >= (0,) * QUARTERS]


def tile_pairs(cells: DataFrame, radius: int) -> DataFrame:
    """(cell, tile, cell2, tile2): the tile pairs within the radius, the larger list of columns second."""
    digit = lambda k: (F.floor(F.col("cell") / 17**k) % 17).cast("int")
    steps = F.array(*(F.array(*map(F.lit, step)) for step in offsets(radius)))
    stepped = cells.select(
        "cell", "tiles", "classes", F.array(*map(digit, range(QUARTERS))).alias("counts"), F.explode(steps).alias("step")
    ).withColumn("counts", F.zip_with("counts", "step", lambda c, d: c + d))
    number = sum((F.col("counts")[k] * 17**k for k in range(QUARTERS)), F.lit(0))
    near = stepped.where(F.forall("counts", lambda c: c.between(0, 16))).select(
        "cell", "tiles", "classes", number.cast("int").alias("cell2")
    )
    return (
        near.join(F.broadcast(cells.toDF("cell2", "tiles2", "classes2")), "cell2")
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
        .where((F.col("cell") != F.col("cell2")) | (F.col("tile") <= F.col("tile2")))
    )


def near(one: np.ndarray, two: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the radius, in blocks of BLOCK comparisons."""
    rows = max(1, BLOCK // max(1, len(two)))
    for low in range(0, len(one), rows):
        a, b = np.nonzero(np.bitwise_count(one[low : low + rows, None] ^ two) <= radius)
        yield a + low, b


def forest(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[i] and b[i] in the forest `up`, in which every node points to a root, the smallest."""
    while True:
        ra, rb = up[a], up[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up[up] != up).any():
            up[:] = up[up]


def links_of(base: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between `others` and `base`."""
    up = np.arange(len(base) + len(others))
    for a, b in near(others, base, radius):
        if len(a):
            forest(up, a + len(base), b)
    both = np.concatenate([base, others])
    moved = np.flatnonzero(up != np.arange(len(up)))
    return both[moved], both[up[moved]]


def links(classes: DataFrame, radius: int, tables: Scratch, tile: int = TILE) -> DataFrame:
    """(a, b): links that join all fingerprints within the radius of each other, stored."""
    celled = classes.select("print", cell_of(F.col("print")).alias("cell"))
    cells = tables.keep(
        celled.groupBy("cell").agg(F.count("*").alias("classes"))
        .select("cell", F.ceil(F.col("classes") / tile).cast("int").alias("tiles"), "classes")
    )
    place = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    tiled = tables.keep(
        celled.join(F.broadcast(cells), "cell").withColumn("tile", place)
        .groupBy("cell", "tile").agg(F.collect_list("print").alias("prints"))
    )
    pairs = tile_pairs(cells, radius)
    work = pairs.agg(F.sum(F.col("classes") / F.col("tiles") * F.col("classes2") / F.col("tiles2"))).first()[0] or 0
    lefts = pairs.select("cell", "tile", "cell2", "tile2").join(tiled, ["cell", "tile"]).select(
        F.col("cell2").alias("cell"), F.col("tile2").alias("tile"),
        ((F.col("cell") == F.col("cell2")) & (F.col("tile") == F.col("tile2"))).cast("int").alias("own"), "prints",
    )
    # the tile itself comes first, as the pair of it with itself
    parts = int(work / TASK) + 2 * classes.sparkSession.sparkContext.defaultParallelism
    dealt = lefts.repartition(parts, "cell", "tile").sortWithinPartitions("cell", "tile", F.desc("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, waiting = None, np.zeros(0, np.uint64), []

        def told() -> Iterator[pa.RecordBatch]:
            if waiting:
                a, b = links_of(base, np.concatenate(waiting), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (a, b)], ["a", "b"])
                waiting.clear()

        for batch in batches:
            lists = batch.column("prints")
            flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy().cumsum()
            keys = zip(*(batch.column(c).to_pylist() for c in ("cell", "tile", "own")), strict=True)
            low = 0
            for (cell, number, own), high in zip(keys, ends.tolist(), strict=True):
                prints, low = flat[low:high], high
                if own:
                    yield from told()
                    base = prints.copy()
                waiting.append(prints.copy())
                if sum(map(len, waiting)) >= tile:
                    yield from told()
        yield from told()

    bounded_batches(classes.sparkSession)
    return tables.keep(dealt.mapInArrow(run, "a long, b long"))


def near_duplicates(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    component_id is the smallest doc_id reachable by links, the row's own included. A text that is
    null, empty or without words has fingerprint zero and is linked like any other. Rows alike in
    doc_id come out as often as they occur; a row without doc_id links others, and its component_id
    is null where no row it reaches has one. No rows give no rows. Other columns are ignored.
    """
    with Scratch(documents.sparkSession) as tables:
        printed = tables.keep(fingerprints(documents, text, doc_id))
        classes = tables.keep(
            printed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        )
        roots = components(links(classes, radius, tables))
        rooted = classes.join(roots.toDF("print", "root"), "print", "left").withColumn("root", F.coalesce("root", "print"))
        whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = tables.keep(rooted.join(whole, "root").select("print", "n", "component_id"))
        total = named.agg(F.sum("n")).first()[0] or 0
        hot = F.col("n") * HOT > total
        few = F.broadcast(named.where(hot).select("print", "component_id", F.lit(True).alias("hot")))
        marked = printed.join(few, "print", "left")
        rest = marked.where("hot is null").drop("component_id", "hot").join(named.where(~hot).drop("n"), "print")
        both = marked.where("hot").select("doc_id", "print", "component_id").unionByName(rest.select("doc_id", "print", "component_id"))
        return stored(both.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"))
