"""Reproducible sampling and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom import storage

ROWS_PER_SLICE = 100_000


def stratified_sample(df: DataFrame, stratum: str, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Keep ``max(1, floor(n * ratio))`` rows of every stratum, without replacement.

    Rows are drawn in the order of a digest of key and seed, so a rerun or a
    lost executor gives the same sample. ``key`` must be unique.

    A stratum may hold a large part of all rows, so no task ranks a whole one.
    The digest is cut into slices; the slice sizes, one small row each, say
    which slices are wholly in and in which single slice the cut falls, and
    only the rows of that slice are ranked.
    """
    slices = _slices(df)
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    marked = df.withColumn("__digest", digest).withColumn(
        "__slice", F.floor(F.conv(F.substring("__digest", 1, 8), 16, 10).cast("bigint") * slices / (1 << 32)).cast("int")
    )
    sizes = marked.groupBy(stratum, "__slice").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(stratum).orderBy("__slice")
    whole = Window.partitionBy(stratum)
    wanted = F.greatest(F.lit(1), F.floor(F.sum("__n").over(whole) * F.lit(ratio))).cast("bigint")
    before = F.sum("__n").over(upto) - F.col("__n")
    cuts = (
        sizes.select(F.col(stratum).alias("__stratum"), F.col("__slice").alias("__s"), "__n", (wanted - before).alias("__left"))
        .filter("__left > 0")
    )
    joined = marked.join(
        cuts, F.col(stratum).eqNullSafe(F.col("__stratum")) & (F.col("__slice") == F.col("__s"))
    )
    entire = joined.filter("__left >= __n").select(df.columns)
    rank = F.row_number().over(Window.partitionBy(stratum, "__slice").orderBy("__digest", key))
    partial = joined.filter("__left < __n").withColumn("__rank", rank).filter("__rank <= __left").select(df.columns)
    return entire.unionByName(partial)


def _slices(df: DataFrame) -> int:
    """Enough slices that each holds a bounded number of rows, whatever the stratum."""
    return max(1, -(-df.count() // ROWS_PER_SLICE))


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in an explicit order; all rows when ``n`` is None.

    No task gets ``n`` rows. The order columns alone are dealt into ranges and
    counted by range; the row where the cut falls is looked for in its own range,
    and the input is filtered by that row. ``order`` should tell rows apart: of rows that
    tie at the cut, any may be kept. Nulls come first. The input is read twice, so it has to be deterministic.
    """
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    spark, key = df.sparkSession, F.struct(*order)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(key.alias("key")).repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id())
    keys = storage.save(dealt, "limit-keys")
    before = 0
    for row in keys.groupBy("range").count().orderBy("range").collect():
        if before + row["count"] > n:
            break
        before += row["count"]
    else:
        return df.orderBy(*order)
    own = keys.filter(F.col("range") == row["range"])
    # The first row that is out: whatever sorts before it is in.
    out = own.orderBy("key").offset(n - before).limit(1).select("key").first()["key"]
    cut = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(out, keys.schema["key"].dataType, strict=True)])
    missing = n - before - own.filter(F.col("key") < cut).count()
    first = df.filter(key < cut)
    if missing:
        first = first.unionByName(df.filter(key == cut).limit(missing))
    return first.orderBy(*order)
