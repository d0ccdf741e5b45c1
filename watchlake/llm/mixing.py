"""Mixing sources to target weights by systematic sampling.

Only DataFrame functions. A document's place in its source is the place of its group plus its place
in the group; groups hold documents of like size and are split by a hash into parts of bounded
length, so no task orders a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchlake.llm.common import WORD, Masked

#: The weights of the sources in code point order, again and again; null comes last.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MAX_REPEATS = 3
#: Documents of one source and size class that one task orders, about.
PART = 200_000


def uniform(*parts: Column) -> Column:
    """A number from [0, 1) with 52 random bits, made from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """For rows (source, source_size): the words each source is to give.

    All sizes together are shared by weight; what a source can't give within `max_repeats` of its
    size goes to the others, again by weight. That is `min(max_repeats * size, level * weight)` for
    the level at which the targets add up: sources are taken by the level at which they are full,
    and the level holds for all beyond the first that isn't full at it. One row per source, so
    windows over all of them are small.
    """
    n = len(weights)
    cap, weight = F.col("source_size") * max_repeats, F.col("weight")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy((cap / weight).asc(), F.col("source").asc_nulls_last())
    before, all_rows = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum(weight).over(all_rows) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    )
    return (
        sizes.withColumn(
            "weight",
            F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n + 1),
        )
        .withColumn("at", level)
        .withColumn("level", F.max(F.when(cap / weight >= F.col("at"), F.col("at"))).over(all_rows))
        .withColumn("target", F.least(cap.cast("double"), F.col("level") * weight))
        .select("source", "source_size", "target")
    )


def systematic_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 42,
    part: int = PART,
) -> DataFrame:
    """`docs` with a struct `mix`: size, source_size, target and copies of each row.

    Each row of a source is expected `target / source_size` times; the running total of that, plus
    one offset for the source from [0, 1), crosses so many whole numbers within the row, and so
    many copies it gets. Rows run by size class, then by a hash of the key, so that the words taken
    come near the target also where sizes differ much.

    A null text has size 0; null is a source of its own, the last by name; a null key counts as "".
    Equal rows can't be told apart and get their copies together. A column `mix` is replaced. An
    empty table stays empty.
    """
    digits = max(0, math.ceil(math.log(max(docs.count(), 1) / part, 16)))
    table = Masked(docs, replaced=("mix",))
    body, own_key = F.col(table.at(text)), F.col(table.at(key))
    binary = F.bin("__size")
    df = table.df.select(
        "*",
        F.col(table.at(source)).alias("__source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("bigint").alias("__size"),
        F.md5(
            F.concat(F.lit(f"{seed}:"), F.coalesce(own_key.cast("string"), F.lit(""))).cast("binary")
        ).alias("__hash"),
        F.xxhash64(body).alias("__tie"),
    ).select(
        "*",
        # size classes: the length of the binary number and its first four digits
        (F.length(binary) * 16 + F.conv(F.substring(binary, 1, 4), 2, 10).cast("int")).alias("__class"),
        F.substring("__hash", 1, digits).alias("__part"),
    )
    parts = df.groupBy("__source", "__class", "__part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__size").alias("words")
    )
    earlier = (
        Window.partitionBy("__source")
        .orderBy("__class", "__part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = parts.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats)
    places = parts.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        targets, F.col("__source").eqNullSafe(F.col("source"))
    )
    places = places.select(
        F.col("__source").alias("__s"),
        F.col("__class").alias("__c"),
        F.col("__part").alias("__p"),
        "__before",
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)).alias("__expected"),
        uniform(F.lit(str(seed)), F.coalesce("source", F.lit(""))).alias("__offset"),
    )
    inside = Window.partitionBy("__source", "__class", "__part").orderBy("__hash", "__size", "__tie")
    df = df.join(
        places,
        F.col("__source").eqNullSafe(F.col("__s"))
        & (F.col("__class") == F.col("__c"))
        & (F.col("__part") == F.col("__p")),
    ).withColumn("__place", F.col("__before") + F.row_number().over(inside))
    place, expected, offset = F.col("__place"), F.col("__expected"), F.col("__offset")
    copies = F.floor(place * expected + offset) - F.floor((place - 1) * expected + offset)
    return table.back(
        df,
        F.struct(
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            copies.cast("bigint").alias("copies"),
        ).alias("mix"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken."""
    table = Masked(systematic_mix(docs, **options))
    # a list of as many entries as copies, none for a row not taken
    times = F.array_repeat(F.lit(0), F.col(table.at("mix"))["copies"].cast("int"))
    table.kept.pop()
    return table.back(table.df.withColumn("__copy", F.explode(times)))
