"""Customer features of a lookback that move on day by day.

Two keyed tables hold the purchases of the lookback: one row per day and customer, and one row per customer. A
new day reads its own purchases, the partial sums of the day that leaves the lookback, and the rows of customers
that either of them names; no purchase is read twice. The newest day holds a customer's latest purchase, so
the latest one needs no queue of days. Expired days leave their table without being read again.

A customer whose purchases are all older than the lookback keeps a row with count 0, which tells them from one who
never bought. Purchases without a time count for ever, as they do in a recomputation. A day that is repeated changes
nothing, also if its first run broke between the two tables; a day that comes before its turn is an error.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featloom.plans.batch_features import customer_rows
from featloom.sinks.keyed import KeyedTable

SUMS = ("_kept", "_n", "_amounts", "_total")
JOB = "day"


def _partials(purchases: DataFrame, *keys: str) -> DataFrame:
    """Purchases reduced to what adds up, by `keys`."""
    dated = purchases.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return dated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_kept"), F.count("purchase_id").alias("_n"), F.count("amount").alias("_amounts"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("_total"), F.max("created_at").alias("_last"))


def _midnight(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


class RollingCustomers:
    """The purchases of a lookback of `days`, up to the end of a last day."""

    def __init__(self, spark: SparkSession, path: str, days: int = 30):
        self.lookback = days
        self.by_day, self.state = KeyedTable(spark, f"{path}/days"), KeyedTable(spark, f"{path}/state")

    @classmethod
    def start(cls, purchases: DataFrame, path: str, last: dt.date, days: int = 30, buckets: int = 16) -> RollingCustomers:
        """From all purchases up to the end of the day `last`, by one pass for each table."""
        spark = purchases.sparkSession
        customer = purchases.schema["customer_id"].dataType
        scale = purchases.schema["amount"].dataType.scale
        fields = [T.StructField("customer_id", customer), *[T.StructField(c, T.LongType()) for c in SUMS[:3]],
                  T.StructField("_total", T.DecimalType(38, scale)), T.StructField("_last", T.TimestampNTZType())]
        KeyedTable.create(spark, f"{path}/days", T.StructType([T.StructField("day", T.StringType()), *fields]),
                          ["day", "customer_id"], max(1, buckets // 4), leading="day")
        KeyedTable.create(spark, f"{path}/state", T.StructType(fields), ["customer_id"], buckets)
        rolling = cls(spark, path, days)
        arrived = purchases.where((F.col("created_at") < _midnight(last + dt.timedelta(1))) | F.col("created_at").isNull())
        counts = (F.col("created_at") >= _midnight(rolling._first(last))) | F.col("created_at").isNull()
        recent = arrived.where(counts)
        rolling.by_day.write(_partials(recent, "day", "customer_id"), job=JOB, batch=last.toordinal())
        # customers whose purchases are all too old have a row as well
        old = arrived.where(~counts).groupBy("customer_id").agg(*[F.lit(0).alias(c) for c in SUMS], F.max("created_at").alias("_last"))
        both = _partials(recent, "customer_id").unionByName(old)
        rolling.state.write(both.groupBy("customer_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("_last").alias("_last")),
                            job=JOB, batch=last.toordinal())
        return rolling

    def _first(self, last: dt.date) -> dt.date:
        """The first day of the lookback that ends with the day `last`."""
        return last + dt.timedelta(1 - self.lookback)

    def last_day(self) -> dt.date:
        return dt.date.fromordinal(self.state.version().batches[JOB])

    def advance(self, purchases: DataFrame, day: dt.date) -> None:
        """Take in the purchases of `day` and leave out the day that is now too old."""
        last = self.last_day()
        if day <= last:
            return
        if day != last + dt.timedelta(1):
            raise ValueError(f"{day} does not follow {last}")
        self.by_day.write(_partials(purchases, "day", "customer_id"), job=JOB, batch=day.toordinal())
        come = _partials(purchases, "customer_id")
        leave = self.by_day.scan((self._first(day) - dt.timedelta(1)).isoformat())
        change = (come.unionByName(leave.select("customer_id", *[(-F.col(c)).alias(c) for c in SUMS], F.lit(None).cast("timestamp_ntz").alias("_last")))
                  .groupBy("customer_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("_last").alias("_last")))
        held = self.state.lookup(change.select("customer_id"))
        moved = (held.unionByName(change).groupBy("customer_id")
                 .agg(*[F.sum(c).alias(c) for c in SUMS], F.max("_last").alias("_last")))
        self.state.write(moved, job=JOB, batch=day.toordinal())
        self.by_day.drop_before(self._first(day).isoformat())

    def features(self, customers: DataFrame) -> DataFrame:
        """The customer features as of the end of the last day."""
        last = self.last_day()
        as_of = last + dt.timedelta(1)
        spent = self.state.scan().withColumns({
            "_total": F.when(F.col("_amounts") > 0, F.col("_total")),
            "_last": F.when(F.col("_last") >= _midnight(self._first(last)), F.col("_last"))})
        return customer_rows(customers, spent, f"{as_of} 00:00:00", self.lookback)
