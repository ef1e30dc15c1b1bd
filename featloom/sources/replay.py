"""A given table told again as a stream: ordered slices, a few of them in each micro-batch.

One job writes every slice as files of its own; then the files get times in the order of their slices, which the
file source follows. A large slice is written by several tasks; empty files make up the number where a slice has
fewer than another one, so that a limit in files is one in slices. So the limit cuts the table into micro-batches, offsets
are those of the file source's log, and a stream that is started again goes on behind the last slice it took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIRST_MILLIS = 946_684_800_000  # the time of the first slice's file; later ones follow second by second
#: Bytes of a row group, about: a file of several is read by several tasks.
ROW_GROUP = 8 << 20


def prepare(df: DataFrame, slice_number: Column, path: str) -> int:
    """Write the rows of `df` by slice; gives the number of slices. Rows without a number come first."""
    spark = df.sparkSession
    numbered = df.withColumn("replay_slice", F.coalesce(slice_number.cast("bigint"), F.lit(-1)))
    # partitions of the advisory size, so that no task holds a large slice
    numbered.hint("rebalance", "replay_slice").write.partitionBy("replay_slice").option("parquet.block.size", ROW_GROUP).parquet(path)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    slices = _slices(spark, path)
    most = max(map(len, slices), default=0)
    if any(len(files) < most for files in slices):
        none = path.rstrip("/") + "-none"
        df.limit(0).write.parquet(none)
        empty = next(s.getPath() for s in fs.listStatus(hadoop.Path(none)) if s.getPath().getName().startswith("part-"))
        for files in slices:
            for i in range(len(files), most):
                files.append(hadoop.Path(files[0].getParent(), f"none-{i:05d}.parquet"))
                hadoop.FileUtil.copy(fs, empty, fs, files[-1], False, conf)
    for place, files in enumerate(slices):
        for file in files:
            fs.setTimes(file, FIRST_MILLIS + 1000 * place, -1)
    return len(slices)


def _slices(spark: SparkSession, path: str) -> list[list]:
    """The files of each slice, in the order of the slices."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(root) if s.isDirectory())
    return [[s.getPath() for s in fs.listStatus(folder)] for _, folder in folders]


def stream(spark: SparkSession, path: str, slices_per_batch: int = 1) -> DataFrame:
    """The slices that `prepare` wrote, in order; column `replay_slice` tells a row's slice."""
    schema = spark.read.parquet(path).schema
    files = max(map(len, _slices(spark, path)), default=1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(slices_per_batch * files)).parquet(path)
