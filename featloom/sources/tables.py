"""Static tables: files, JDBC tables and queries, SQL over registered views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T


def files(spark: SparkSession, path: str, fmt: str = "parquet",
          schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table of files. CSV needs a schema: it is never inferred."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV source needs a schema")
        options = {"header": "true", **options}
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
         partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 32,
         **options: str) -> DataFrame:
    """A database table, or a whole query sent to the database.

    A table is read in parallel ranges of `partition_column`; a large table without one
    would come through a single task.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    source = table if table is not None else f"({query}) AS source"
    reader = reader.option("dbtable", source)
    if partition_column:
        low, high = bounds
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(low))
                  .option("upperBound", str(high)).option("numPartitions", str(partitions)))
    return reader.load()


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make frames visible to SQL text under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
