"""Mix sources to target shares of the words of a corpus.

Every source gets a target number of words: its weight's share of all words, but at most `most` times its
own words; what it cannot take is shared among the others by weight until no target is above its bound.
Documents get hash-random keys. A source takes all its documents as often as its target allows in whole
epochs; in the last, partial epoch it takes documents in the order of their keys up to the exact budget,
so that the document at the cut gives only its first words.

The order is that of range-sorted keys. Keys fall into equal ranges; the words of each range are summed
where the rows are, a running sum over the ranges of a source (never over its rows) tells the range of the
cut, and only the rows of that range are put in order. What reaches the documents is one row per source.

Null text has no words. Null is a source of its own, the last one. Documents of one id have one key: if the
cut falls on them they share it in proportion to their words. Null ids are one id. A corpus without words
has targets of 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featloom.llm.common import staged

WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of a key that name its range: 4,096 ranges for each source.
RANGE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(id_: Column) -> Column:
    return F.md5(F.coalesce(id_.cast("string"), F.lit("")))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, key and size of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       key_of(F.col(id_col)).alias("key"), words(F.col(text_col)).alias("size"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target, budget (whole words) from rows of source and size.

    The sources are a few labels, one row each. In the order of bound over weight, the sources that end at
    their bound come first; the others share what is left.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    each = each.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
    tight = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    each = (each
            .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
            .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("at_bound", F.expr("bound * left_weight <= weight * left")))
    # the first source that is not at its bound fixes the share of all that follow
    free = F.min(F.when(~F.col("at_bound"), F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source",
                                                     "left", "left_weight"))).over(everything)
    each = each.withColumn("free", free)
    share = "weight * free.left"
    return each.select(
        "source", "source_size",
        F.expr(f"CASE WHEN at_bound THEN cast(bound AS double) ELSE cast({share} AS double) / free.left_weight END").alias("target"),
        F.expr(f"CASE WHEN at_bound THEN bound ELSE ({share}) div free.left_weight END").alias("budget"))


def cuts(sizes: DataFrame, plan: DataFrame, digits: int = RANGE_DIGITS) -> DataFrame:
    """`plan` with epochs (whole ones) and the cut of the partial one: cut_key, cut_words of cut_total."""
    plan = plan.select("*", F.expr("CASE WHEN source_size = 0 THEN 0 ELSE budget div source_size END").alias("epochs"),
                       F.expr("CASE WHEN source_size = 0 THEN 0 ELSE budget % source_size END").alias("rest"))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    ranged = sizes.select("source", "key", "size", F.substring("key", 1, digits).alias("range"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
              .withColumn("upto", F.sum("range_size").over(running)))
    # the range in which the budget runs out, and what is left of it there
    of_cut = (ranges.alias("a").join(plan.alias("b"), same)
              .where("b.rest > 0 AND a.upto >= b.rest AND a.upto - a.range_size < b.rest")
              .select("a.source", "a.range", F.expr("b.rest - (a.upto - a.range_size)").alias("wanted")))
    in_range = (ranged.alias("a").join(of_cut.alias("b"), same & (F.col("a.range") == F.col("b.range")))
                .groupBy("a.source", "a.key").agg(F.sum("a.size").alias("cut_total"), F.first("b.wanted").alias("wanted")))
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut = (in_range.withColumn("upto", F.sum("cut_total").over(inside))
           .where("upto >= wanted AND upto - cut_total < wanted")
           .select("source", F.col("key").alias("cut_key"), "cut_total",
                   F.expr("wanted - (upto - cut_total)").alias("cut_words")))
    return plan.alias("a").join(cut.alias("b"), same, "left").select("a.*", "b.cut_key", "b.cut_total", "b.cut_words")


#: Words that the mix takes of a document of `size` words, repeats counted.
TAKEN = """epochs * size + CASE WHEN cut_key IS NULL OR key > cut_key THEN 0 WHEN key < cut_key THEN size
           ELSE size * cut_words div cut_total END"""


def written_plan(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """`cuts` of `targets` with `plan_source`, written, so that its size is known: one row for each source goes to the
    rows of documents, not they to it."""
    return staged(cuts(sizes, targets(sizes, weights, most)), "plan").withColumnRenamed("source", "plan_source")


def mix_sizes(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = staged(sized(docs, **columns), "sizes")
    plan = written_plan(sizes, weights, most)
    return (sizes.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
            .select("doc_id", "size", "source_size", "target", F.expr(TAKEN).alias("taken")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: rows of `docs`, each as often as it is taken; a cut document ends after its last word.

    Documents without words are kept once. Of other columns `n_chars`, if there is one, follows a text that is cut.
    """
    sizes = staged(sized(docs, id_col, text_col, source_col), "sizes")
    plan = written_plan(sizes, weights, most)
    rows = docs.select(F.struct("*").alias("doc"), F.col(source_col).cast("string").alias("mix_source"),
                       key_of(F.col(id_col)).alias("key"), words(F.col(text_col)).alias("size"))
    rows = rows.join(plan, F.col("mix_source").eqNullSafe(F.col("plan_source"))).withColumn("taken", F.expr(TAKEN))
    whole = F.when(F.col("size") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.expr("concat(array_repeat(size, cast(taken div size as int)), filter(array(taken % size), x -> x > 0))"))
    rows = rows.select("doc", "size", F.explode(whole).alias("part"))
    text = F.col("doc")[text_col]
    # blanks and words up to the last word that is taken; lengths of matches never exceed the document
    cut = F.when(F.col("part") == F.col("size"), text).otherwise(_first_words(text, F.col("part")))
    out = {c: F.col("doc")[c] for c in docs.columns} | {text_col: cut}
    if "n_chars" in docs.columns:
        own = F.col("doc")["n_chars"]
        out["n_chars"] = F.when(F.col("part") == F.col("size"), own).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[v.alias(c) for c, v in out.items()])


def _first_words(text: Column, n: Column) -> Column:
    """`text` up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS bound,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS left_size,
    sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w,
    row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS i
    FROM s WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT left_size AS fl, left_w AS fw FROM r WHERE bound * left_w > w * left_size ORDER BY i LIMIT 1),
t AS (SELECT r.source, source_size,
    CASE WHEN bound * left_w <= w * left_size THEN CAST(bound AS DOUBLE)
         ELSE CAST(w * fl AS DOUBLE) / CAST(fw AS DOUBLE) END AS target,
    CASE WHEN bound * left_w <= w * left_size THEN bound ELSE (w * fl) // fw END AS budget
    FROM r LEFT JOIN f ON true),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs,
    CASE WHEN source_size = 0 THEN 0 ELSE budget % source_size END AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""
