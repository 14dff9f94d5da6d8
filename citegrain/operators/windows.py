"""Ranking and carry helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.session import checkpoint

ASK = ("query_id", "paper_id")


def top_k(
    df: DataFrame, keys: tuple[str, ...], order: list[Column], k: int | None, rank: str = "rank"
) -> DataFrame:
    """Unique 1-based ranks per group; with ``k`` Spark prunes before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def by_score(score: str = "score", tie: str = "chunk_id") -> list[Column]:
    """Descending score, ids break ties; nine places keep summation order out of it."""
    return [F.round(F.col(score), 9).desc(), F.col(tie).asc()]


def settled(df: DataFrame, *keys: str) -> DataFrame:
    """Compute every column once before anything below filters on it.

    A filter on a computed column is otherwise pushed beneath its projection and the
    expression, with all it refers to, is evaluated again; filters do not pass a generator.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.explode(F.array(F.struct(*rest))).alias("_row")
    return df.select(*keys, packed).select(*keys, "_row.*").select(*df.columns)


def gathered(order: str, *fields: str) -> Column:
    """The rows of a bounded group as an array of structs in ascending ``order``.

    Compared by that field alone, since other fields may be maps.
    """
    rows = F.collect_list(F.struct(order, *fields))
    return F.array_sort(rows, lambda a, b: (a[order] - b[order]).cast("int"))


def carry_forward(
    df: DataFrame, key: str, order: str, value: str, out: str, span: int = 4096
) -> DataFrame:
    """Last non-null ``value`` of the rows before each row of a key, in ``order``.

    Each key is cut into blocks of ``span`` positions, so no task holds a whole key: one
    window runs inside the blocks, a second over one row per block.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / span))
    inner = Window.partitionBy(key, "_block").orderBy(order)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # both reads of ``seen`` share one exchange, so ``df`` is computed once
    seen = blocks.withColumn(
        "_before",
        F.last(value, ignorenulls=True).over(
            inner.rowsBetween(Window.unboundedPreceding, -1)
        ),
    ).withColumn("_tail", F.last(value, ignorenulls=True).over(whole))
    outer = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        seen.select(key, "_block", "_tail")
        .distinct()
        .select(key, "_block", F.last("_tail", ignorenulls=True).over(outer).alias("_carried"))
    )
    return (
        seen.join(carried, [key, "_block"])
        .withColumn(out, F.coalesce("_before", "_carried"))
        .drop("_block", "_before", "_tail", "_carried")
    )


def running_totals(df: DataFrame, keys: list[str], value: str, totals: list[str]) -> DataFrame:
    """Running sums of ``totals`` up to and including each distinct ``value`` of a key,
    the key's totals, and the next larger value.

    Rows are added up per value first, then range-partitioned; one short row per (key,
    range) carries the sums between ranges. No task holds a whole key, so this serves
    exact percentiles and threshold scans of one huge group.
    """
    summed = df.groupBy(*keys, value).agg(*[F.sum(t).alias(t) for t in totals])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(
        summed.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns(
        {f"upto_{t}": F.sum(t).over(upto) for t in totals} | {"_next": F.lead(value).over(inside)}
    )
    across = Window.partitionBy(*keys).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = (
        ranged.groupBy(*keys, "_part")
        .agg(F.min(value).alias("_first"), *[F.sum(t).alias(t) for t in totals])
        .select(
            *keys,
            "_part",
            F.lead("_first").over(across).alias("_next_first"),
            *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_before_{t}") for t in totals],
            *[F.sum(t).over(every).alias(f"all_{t}") for t in totals],
        )
    )
    return local.join(heads, [*keys, "_part"]).select(
        *keys,
        value,
        *totals,
        *[(F.col(f"upto_{t}") + F.col(f"_before_{t}")).alias(f"upto_{t}") for t in totals],
        *[f"all_{t}" for t in totals],
        F.coalesce("_next", "_next_first").alias("next_value"),
    )
