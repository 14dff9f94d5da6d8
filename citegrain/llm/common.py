"""Helpers that several operators share: Arrow passes, bitmaps, components, hashed words."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 18
PART = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_pass(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """One Arrow pass over the rows, in parts of bounded size."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                yield step(part)

    return df.mapInArrow(run, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to PART bytes: texts may be long, and a batch lies in
    memory twice on either side."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not known or not 0 < int(known[1]) <= PART:
        spark.conf.set(key, f"{PART}b")


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about PART bytes, so that work on it needs bounded memory."""
    rows = max(1, batch.num_rows * PART // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; a null counts as an empty text."""
    return [t or "" for t in column.to_pylist()]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes."""
    h = np.array(h, np.uint64)
    h ^= h >> np.uint64(30)
    h *= MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def _from_one(size: int, factor: int) -> np.ndarray:
    found = np.full(size + 1, factor, np.uint64)
    found[0] = 1
    return found


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            self.up = np.cumprod(_from_one(size, BASE))
            self.down = np.cumprod(_from_one(size, pow(BASE, -1, 1 << 64)))
        return self.up, self.down


POWERS = _Powers()
# Maps bytes for word comparison: A-Z to lower case, ASCII signs to blanks, the rest to itself.
PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _slices(data: bytes) -> Iterator[tuple[int, int]]:
    """Slices of about SLICE bytes, cut at blanks."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        while end < n and data[end] not in b" \n":
            end += 1
        yield at, end
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each blank-separated word of UTF-8 bytes."""
    starts, ends, hashes = [], [], []
    raw = np.frombuffer(data, np.uint8)
    for at, end in _slices(data):
        part = raw[at:end]
        word = np.concatenate(([False], ~SPACE[part], [False]))
        s, e = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
        up, down = POWERS.upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts in one buffer, a line break after each, and where each starts (plus the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return b"\n".join([*texts, b""]), np.concatenate(([0], np.cumsum(sizes)))


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words of one owner, and the index of its first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = total * np.uint64(BASE) + hashes[k : k + count]
    at = np.flatnonzero(owner[:count] == owner[n - 1 :])
    return mix(total[at]), at


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a session on one machine that names none gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None and not context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="citegrain-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/citegrain-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read back.

    A written table cuts the lineage, survives lost executors and tells the planner its true size,
    which checkpoint() does not: its estimates multiply from join to join. The table goes when the
    session ends.
    """
    return _written(df)[0]


class Scratch:
    """Stored tables of one piece of work, deleted as soon as their last reader is written.

    What is handed on must be written (`stored`) before the scope ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.free(*(df for df, _ in self.paths.values()))

    def keep(self, df: DataFrame) -> DataFrame:
        found, path = _written(df)
        self.paths[id(found)] = (found, path)
        return found

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that no plan still to be run reads, and let the shuffle files of finished
        jobs go: Spark removes them once the JVM has collected their handles."""
        for df in tables:
            _, path = self.paths.pop(id(df))
            delete(self.spark, path)
        gc.collect()
        self.spark._jvm.java.lang.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def narrow(df: DataFrame, most: int = 1 << 22) -> DataFrame:
    """Rows of two longs, hinted for broadcast where a count shows at most `most` of them (64 MB).

    Beyond, the join shuffles as any other.
    """
    return F.broadcast(df) if df.count() <= most else df


def bitmap(df: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """2**bits bits, of which those of the column's values are set.

    Its size is fixed, whatever the rows: at most 2**(bits - 6) rows of two longs reach the driver.
    """
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    words = (
        df.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))
    ).toArrow()
    found = np.zeros(1 << (bits - 6), np.int64)
    found[words["at"].to_numpy()] = words["word"].to_numpy()
    del words
    free_arrow()
    return found.view(np.uint64)


def free_arrow() -> None:
    """Give memory of collected tables that are gone back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = (len(words) * 64 - 1).bit_length()
    slot = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node of its component.

    Each round maps every root to its smallest neighbour, follows the map twice and contracts the
    edges, so chains shrink geometrically and a hub of any size is settled in one round. All rounds
    are shuffled aggregations and joins.
    """
    with Scratch(edges.sparkSession) as tables:
        live = tables.keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
        roots: DataFrame | None = None
        while not live.isEmpty():
            both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            nearest = tables.keep(best)
            best = nearest
            for _ in range(2):
                jump = best.select(F.col("a").alias("m"), F.col("m").alias("m2"))
                best = best.join(jump, "m", "left").select("a", F.coalesce("m2", "m").alias("m"))
            best = tables.keep(best)
            tables.free(nearest)
            if roots is None:
                roots = tables.keep(best.select(F.col("a").alias("node"), F.col("m").alias("root")))
            else:
                step = best.select(F.col("a").alias("root"), "m")
                before, roots = roots, tables.keep(
                    roots.join(step, "root", "left").select("node", F.coalesce("m", "root").alias("root"))
                )
                tables.free(before)
            to_a, to_b = best.toDF("a", "na"), best.toDF("b", "nb")
            before, live = live, tables.keep(
                live.join(to_a, "a").join(to_b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
                .where("a <> b").distinct()
            )
            tables.free(before, best)
        if roots is None:
            return stored(live.toDF("node", "root"))
        return stored(roots)


def document_key(text: Column, doc_id: Column) -> Column:
    """Identity of a row that is the same in every scan: its id with its text."""
    return F.xxhash64(text, doc_id, doc_id.isNull())
