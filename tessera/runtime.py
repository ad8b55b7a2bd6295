"""Sessions, shared working folders, and the few distributed helpers that several operators need."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A key with more than one row in HOT_SHARE of all rows is hot. At most HOT_SHARE keys can be, whatever the data,
#: so the hot side of ``lookup`` is always small enough to broadcast.
HOT_SHARE = 1024
#: Copies of one row that a task makes in a row.
CHUNK = 1024


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A session with the settings the library is tested with."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset and the master is local, a temporary folder takes its place. On a cluster an unset folder is an
    error, since no machine-local folder could stand in for it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = getattr(spark, "_tessera_root", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_root = known
    return known


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` gave and that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing needs any more.

    Spark deletes them when the driver's garbage is collected, which a driver with memory to spare hardly ever does by
    itself. Call it between the rounds of a long computation whose state is in written tables.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, dealt out to all of them; others as they are.

    For scans only, such as of a small table in one file: counting the parts of anything else may run it.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which ``condition`` holds, which Spark finds where they are: after what ``df`` computes, and once.

    Spark moves a plain filter below that, with a copy of all that its columns are made from, also below a shuffle or a
    semi join that is there to leave few rows. For conditions on columns that cost much.
    """
    return df.select(F.inline(F.array_compact(F.array(F.when(condition, F.struct("*"))))))


def fitting(spark: SparkSession, amount: int, of_task: int) -> Callable[[DataFrame], DataFrame]:
    """A function that lets as many tasks make a table as its amount of work needs, where a shuffle has more parts.

    So a shuffle of little data costs few tasks, also where Spark may not join its parts by itself. Never below two tasks a core.
    """
    n = max(2 * spark.sparkContext.defaultParallelism, -(-int(amount) // of_task))
    return (lambda df: df.coalesce(n)) if n < int(spark.conf.get("spark.sql.shuffle.partitions")) else lambda df: df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` rows at once to Python workers, for operators that send whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def free_name(taken, name: str) -> str:
    """``name``, with underscores put before it until no column has it (names are compared as Spark does, without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_key(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two 64-bit hashes of a row's content, the same wherever and however often the row is read.

    Rows with equal keys are taken as equal in every one of ``columns`` (all, if not given).
    """
    parts = []
    for c in columns or df.columns:
        col = F.col(f"`{c}`")
        parts += [col.isNull(), col if _hashable(df.schema[c].dataType) else F.to_json(F.struct(col))]
    return [F.xxhash64(F.lit(salt), *parts) for salt in ("first", "second")]


def pick(rows: DataFrame, plan: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``plan`` that takes one row for each of the plan's keys.

    Rows that agree in ``keys`` must be equal, so it doesn't matter which one is taken, and no row needs a number. The
    plan holds each key once, with the number of its rows in ``times``, and should be materialised. Where rows repeat,
    those of hot keys are reduced in each task before they are shuffled, and all others meet in bounded groups.
    """
    many = plan.where(F.col(times) > 1)
    if many.isEmpty():
        return rows.join(plan, keys)
    hot = plan.where(F.col(times) * HOT_SHARE > F.greatest(F.lit(total), F.lit(HOT_SHARE)))
    cold = plan.where(F.col(times) * HOT_SHARE <= F.greatest(F.lit(total), F.lit(HOT_SHARE)))
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    single = rest.join(cold.where(F.col(times) == 1), keys)
    repeated = rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold.where(F.col(times) > 1), keys))
    others = [c for c in repeated.columns if c not in keys]
    one = repeated.groupBy(*keys).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_one"))
    return single.unionByName(one.select(*keys, *[F.col("_one").getField(c).alias(c) for c in others]))


def without(rows: DataFrame, plan: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """The rows whose keys the plan lacks. Keys of many rows are broadcast, all others meet in bounded groups; see ``pick``."""
    bound = F.greatest(F.lit(total), F.lit(HOT_SHARE))
    hot, cold = plan.where(F.col(times) * HOT_SHARE > bound), plan.where(F.col(times) * HOT_SHARE <= bound)
    return rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold.select(keys), keys, "left_anti")


def in_chunks(rows: DataFrame, times: str, out: str, most: int, chunk: int = CHUNK) -> DataFrame:
    """Each row once for every ``chunk`` of its ``times`` copies, with the first copy's number in ``out``.

    ``most`` is the largest of all times. Only if it exceeds the chunk are rows dealt out anew, so that the copies of
    one row are made by many tasks. Rows with no copies go.
    """
    rows = rows.where(F.col(times) > 0)
    if most <= chunk:
        return rows.withColumn(out, F.lit(0).cast("long"))
    few = rows.where(F.col(times) <= chunk).withColumn(out, F.lit(0).cast("long"))
    many = rows.where(F.col(times) > chunk).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1, F.lit(chunk).cast("long"))))
    return few.unionByName(many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), out))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many ``rows`` with one row per key of ``groups``, safe against hot keys.

    ``groups`` must hold each key once, with its number of rows in ``size``, and should be materialised, as it is read
    more than once. Keys with more than ``total / HOT_SHARE`` rows, at most HOT_SHARE of them, are broadcast; the rows
    of all others meet in a shuffled join whose groups are thereby bounded to that share.
    """
    hot = groups.where(F.col(size) * HOT_SHARE > total)
    cold = groups.where(F.col(size) * HOT_SHARE <= total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def lookup_left(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Like ``lookup``, but every row stays, with nulls where its key has no group.

    Rows of hot keys, once served by the broadcast, take part in the shuffled join under a key made from ``spread``
    that matches nothing, so they are dealt evenly. ``rows`` is read once; its key must be a string.
    """
    new = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_SHARE > total).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in new])
    cold = groups.where(F.col(size) * HOT_SHARE <= total).select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in new])
    served = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    free = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    served = served.withColumn("_key", F.when(free, F.concat(F.lit("\u0000"), spread.cast("string"))).otherwise(F.col(key)))
    joined = served.join(cold, F.col("_key") == F.col("_cold_key"), "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in new])


def running_total(df: DataFrame, order: list[Column], value: Column, out: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows that come earlier in ``order``, over the whole table.

    Rows are range-partitioned and written once, so that numbering and offsets see the same partitions. Only one row
    for each partition meets in a single task. ``order`` should be a total order, up to rows that are equal.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_value", value).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, name)
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_offset"))
        .drop("_part", "_value", "_before", "_offset")
    )
