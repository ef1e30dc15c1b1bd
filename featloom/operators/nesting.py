"""Child rows nested into pages of a bounded size; rows repeated in pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def page_children(children: DataFrame, key: str, fields: Sequence[str], out: str = "items",
                  page: str = "part", max_items: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """((key, item_count, parts), (key, page, out)): children counted, and told in pages.

    Every key goes the same way. Its equal children are counted first and cut into pieces
    of at most `max_items`; pieces go to one of the key's pages by hash, so a page holds
    about `max_items` children and neither a task nor a row holds an unbounded group. A
    page is a sorted array of structs; one that no piece falls on is left out.
    """
    child = F.struct(*fields)
    counted = children.groupBy(key, *fields).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counted.groupBy(key).agg(F.sum("_n").alias("item_count")).withColumn(
        "parts", F.ceil(F.col("item_count") / F.lit(max_items)).cast("int"))
    last_piece = F.floor((F.col("_n") - 1) / F.lit(max_items)).cast("int")
    pieces = counted.join(sizes.select(key, "parts"), key).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), last_piece)))
    copies = F.least(F.lit(max_items), F.col("_n") - F.col("_piece") * max_items).cast("int")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in fields], F.col("_piece")), F.col("parts")).cast("int")
    pages = (pieces.withColumn(page, spread).groupBy(key, page)
             .agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat(child, copies)))).alias(out)))
    return sizes, pages


def repeated(counted: DataFrame, times: str, piece: int = 10_000) -> DataFrame:
    """Every row as often as its column `times` says, which leaves; not at all for 0.

    A row that is repeated more than `piece` times is cut into pieces, which are spread over the tasks.
    """
    n = F.col(times).cast("bigint")
    few = counted.filter(n <= piece).withColumn("_times", n)
    pieces = counted.filter(n > piece).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(piece)).cast("bigint"))))
    many = (pieces.withColumn("_times", F.least(F.lit(piece), n - F.col("_piece") * piece))
            # by a given number, since pieces are small rows that would be put together again
            .repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), *counted.columns, "_piece").drop("_piece"))
    return (few.unionByName(many).filter("_times > 0")
            .withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).drop("_times", times))
