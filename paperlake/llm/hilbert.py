"""Sharding along a Hilbert curve over several metadata dimensions; DataFrame operations only.

Rows are ordered by the curve index of their cell and a digest within it; runs of that
order are the shards, so that a file covers a small box of every dimension. The order is
made without a global sort: rows are numbered inside buckets of a bounded size, cut by
digest out of each cell, and counts of buckets and cells give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paperlake.llm.common import COPIES, checkpoint

MAX_CELL_BITS = 16  # so the curve table has at most 65,536 entries
BUCKET_ROWS = 500
MAX_BUCKETS = 1 << 16


def hilbert_index(point: list[int], bits: int) -> int:
    """The place of a point on the Hilbert curve (Skilling's transposed form)."""
    x, dims = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[d] >> b) & 1) << (b * dims + dims - 1 - d) for b in range(bits) for d in range(dims))


def curve(dims: int, bits: int) -> list[int]:
    """The curve index of every cell; a cell's number has the first dimension in its highest bits."""
    if dims * bits > MAX_CELL_BITS:
        raise ValueError(f"{dims} dimensions of {bits} bits are over {MAX_CELL_BITS} bits")
    mask = (1 << bits) - 1
    return [hilbert_index([c >> (bits * (dims - 1 - d)) & mask for d in range(dims)], bits) for c in range(1 << dims * bits)]


def category(col: Column, bits: int) -> Column:
    """A category's place on an axis: the top bits of its MD5; null is 0."""
    return F.coalesce(F.conv(F.substring(F.md5(col.cast("string")), 1, 4), 16, 10).cast("int"), F.lit(0)).bitwiseAND((1 << bits) - 1)


def magnitude(col: Column, bits: int) -> Column:
    """A count's place on an axis: its length in binary digits; null is 0."""
    return F.least(F.length(F.bin(F.coalesce(col.cast("long"), F.lit(0)))), F.lit((1 << bits) - 1))


def curve_table(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """Rows (__cell, __curve) of every cell, at most 65,536."""
    index = F.split(F.lit(",".join(map(str, curve(dims, bits)))), ",")
    return spark.range(1).select(F.posexplode(index).alias("__cell", "c")).select("__cell", F.col("c").cast("int").alias("__curve"))


def shard_rows(df: DataFrame, axes: list[Column], tie: Column, shards: int = 8, bits: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows with curve (index), shard and slot added; shard sizes differ by one row at most.

    axes give integers of `bits` bits; `tie` is a hexadecimal digest of at least eight digits that
    orders the rows of a cell. Equal rows are counted together, so that no task sorts them, and get
    neighbouring places. The rows are made once, in the shared folder. Nulls in other columns are values
    like any other; an empty table gives none.
    """
    cell = None
    for a in axes:
        cell = a.cast("int") if cell is None else cell * (1 << bits) + a.cast("int")
    cols, spark = df.columns, df.sparkSession
    keyed = df.withColumn("__cell", cell).withColumn("__tie", tie).join(F.broadcast(curve_table(spark, len(axes), bits)), "__cell").drop("__cell")
    rows = checkpoint(keyed.groupBy(*cols, "__curve", "__tie").agg(F.count("*").alias("__n")))
    # at most 65,536 cells, so one task may add them up; the buckets of a cell cut its digests into even ranges
    every = Window.orderBy("__curve")
    upto = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = rows.groupBy("__curve").agg(F.count("*").alias("__distinct"), F.sum("__n").alias("__rows")).select(
        "__curve", "__distinct", F.coalesce(F.sum("__rows").over(upto), F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("__total"), F.sum("__distinct").over(whole).alias("__all"))
    size = F.greatest(F.lit(bucket_rows), F.ceil(F.col("__all") / MAX_BUCKETS))
    cells = checkpoint(cells.select("__curve", "__before", "__total", F.ceil(F.col("__distinct") / size).alias("__cuts")))
    place = F.conv(F.substring("__tie", 1, 8), 16, 10).cast("long")
    rows = rows.join(F.broadcast(cells.select("__curve", "__cuts")), "__curve").withColumn("__bucket", F.shiftright(place * F.col("__cuts"), 32).cast("int")).drop("__cuts")
    earlier = Window.partitionBy("__curve").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("__curve", "__bucket").agg(F.sum("__n").alias("__rows")).withColumn("__inside", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    buckets = buckets.join(F.broadcast(cells), "__curve").select("__curve", "__bucket", (F.col("__before") + F.col("__inside")).alias("__from"), "__total")
    order = Window.partitionBy("__curve", "__bucket").orderBy("__tie", *cols).rowsBetween(Window.unboundedPreceding, -1)
    # buckets: MAX_BUCKETS and a cell's one each at most
    numbered = rows.withColumn("__seen", F.coalesce(F.sum("__n").over(order), F.lit(0))).join(F.broadcast(buckets), ["__curve", "__bucket"])
    # equal rows: one row for every COPIES of them, dealt out over all tasks, and from each that many
    numbered = numbered.select(*cols, F.col("__curve").alias("curve"), (F.col("__from") + F.col("__seen")).alias("__first"), "__n", "__total",
                               F.explode(F.expr(f"sequence(0L, (__n - 1) div {COPIES})")).alias("__part")).hint("rebalance")
    start = f"__first + __part * {COPIES}"
    ranked = numbered.select(*cols, "curve", "__total", F.explode(F.expr(f"sequence({start}, least({start} + {COPIES}, __first + __n) - 1)")).alias("__rank"))
    ranked = ranked.withColumn("shard", F.expr(f"CAST(__rank * {shards} div __total AS int)"))
    return ranked.withColumn("slot", F.expr(f"__rank - (shard * __total + {shards - 1}) div {shards}")).drop("__rank", "__total")


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard; files hold runs of the curve, so that their footers' ranges stay narrow in every dimension. An empty table writes no shard."""
    n = 1 + (sharded.agg(F.max("shard")).first()[0] or 0)
    sharded.repartitionByRange(n * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
