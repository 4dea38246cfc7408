"""Reading tables and choosing the rows in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(docs: DataFrame, *columns: str, key: str = "id", version: str = "mtime_ns", ties: tuple[str, ...] = ("hash", "seen_at", "size")) -> DataFrame:
    """One row per key: that with the greatest version; null versions come last.

    Rows with a null key belong to no document and are dropped.  Different rows with the same key and
    version are told apart by the greatest of the `ties` that the table has (without any, by the greatest
    hash over the chosen columns), whatever the input's order; the chosen columns themselves aren't
    compared, so that those a query doesn't need aren't read.  Catalyst limits each key to one row in every
    task before the shuffle, so that a key with many versions never meets in one task.
    """
    cols = list(dict.fromkeys([key, *columns]))
    rank = "__rank_of_version"
    own = [c for c in ties if c in docs.columns]
    last = [F.col(c).desc_nulls_last() for c in own] or [F.xxhash64(*[c for c in cols if c != key] or [key]).desc()]
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), *last)
    slim = docs.select(*dict.fromkeys([*cols, version, *own])).filter(F.col(key).isNotNull())
    return slim.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*cols)


def filled(text: Column) -> Column:
    """Whether a text is neither null nor blank (Unicode white space)."""
    return text.isNotNull() & text.rlike(r"[^\p{IsWhite_Space}]")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 3, enough: int = 64 << 20) -> DataFrame:
    """Even partitions for work that is heavy per row, if the input is small.

    A small input arrives in few partitions and would leave cores idle, so its rows are moved once.  An
    input of more than `enough` bytes a core already has a partition for every core, and stays as it is.
    """
    cores = parallelism(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * enough else df.repartition(cores * per_core)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's spark.checkpoint.dir, or, where that is unset and everything runs on this
    machine, an own one.  On a cluster without the setting there is no folder that all executors share: an error."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="marginalia-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there, so that later stages neither repeat the
    work nor lose it with an executor.

    A table is written rather than a checkpoint, which would compute its last stage twice.  It is deleted
    when the application ends.
    """
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/marginalia-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def run_sql(text: str, **frames: DataFrame) -> DataFrame:
    """A query over DataFrames, named <<name>> in its text.  The views exist only while it is analysed."""
    import uuid

    spark, names = next(iter(frames.values())).sparkSession, []
    try:
        for name, df in frames.items():
            view = f"q_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(view)
            names.append(view)
            text = text.replace(f"<<{name}>>", view)
        return spark.sql(text)
    finally:
        for view in names:
            spark.catalog.dropTempView(view)
