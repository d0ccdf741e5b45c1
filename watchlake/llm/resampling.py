"""Importance resampling towards a target: documents whose hashed n-grams look like the target's.

Texts are cut into lines at newlines, which no word contains. Each distinct line's features are made
once, however often it occurs: the corpus counts take them times its occurrences, the documents take
its length and gain by a join on its digest. What runs across lines is made per document and added.

A line that makes up a thousandth of all lines is looked up in a broadcast table, which so has at most
a thousand rows; the others are joined, so no key holds more than a thousandth of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import Masked, column, numbered, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters and digits of ASCII, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A line is hot if it makes up more than one in so many of all lines.
HOT_SHARE = 1000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram), F.lit(buckets)).cast("int")


def _grams(words: Column, starts: Column, k: int, buckets: int) -> Column:
    """The buckets of the runs of k words that begin at `starts`."""
    return F.transform(starts, lambda i: _bucket(F.array_join(F.slice(words, i + 1, k), " "), buckets))


def _between(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _line_buckets(words: Column, n: int, buckets: int) -> Column:
    """The buckets of all runs of 1 to n words."""
    found = [F.transform(words, lambda w: _bucket(w, buckets))]
    for k in range(2, n + 1):
        found.append(_grams(words, _between(F.lit(0), F.size(words) - k), k, buckets))
    return F.concat(*found) if n > 1 else found[0]


def _cross_buckets(words: Column, ends: Column, n: int, buckets: int) -> Column:
    """The buckets of runs of 2 to n words that go over a line's end.

    `ends` has the number of words up to each line's end; runs over several ends count once.
    """
    found = []
    for k in range(2, n + 1):
        before, last = k - 1, F.size(words) - k
        starts = F.transform(
            ends, lambda end: _between(F.greatest(end - before, F.lit(0)), F.least(end - 1, last))
        )
        found.append(_grams(words, F.array_distinct(F.flatten(starts)), k, buckets))
    return F.concat(*found)


def _lines(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, "\n"), lambda line: F.length(line) > 0)


def _cut(docs: DataFrame, text: str, n: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Documents with a row number, the digests of their lines and `cross`; distinct lines.

    A distinct line has its digest, occurrences, number of words, and buckets with repeats.
    """
    names = [name for name in docs.columns if name != text]
    lines = _lines(F.col(text))
    own = docs.select(*names, F.monotonically_increasing_id().alias("__row"), lines.alias("__lines"))
    cross = F.array().cast("array<int>")
    if n > 1:
        own = own.withColumn("__words", F.transform("__lines", _words)).select("*", F.flatten("__words").alias("__all"))
        counts = F.transform(F.slice("__words", 1, F.greatest(F.size("__words") - 1, F.lit(0))), lambda w: F.size(w))
        # running totals: words up to the end of each line but the last
        ends = F.aggregate(
            counts,
            F.array().cast("array<int>"),
            lambda done, size: F.array_append(done, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + size),
        )
        own = own.withColumn("__ends", F.array_distinct(ends))
        cross = _cross_buckets(F.col("__all"), F.col("__ends"), n, buckets)
    own = own.select(*names, "__row", F.transform("__lines", lambda line: F.unhex(F.md5(line))).alias("__lines"), cross.alias("__cross"))
    distinct = (
        docs.select(F.explode(lines).alias("__line"))
        .groupBy("__line")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("__words", _words(F.col("__line")))
        .select(
            F.unhex(F.md5("__line")).alias("line"),
            "times",
            F.size("__words").cast("bigint").alias("words"),
            _line_buckets(F.col("__words"), n, buckets).alias("buckets"),
        )
    )
    return stored(own, "cut"), stored(distinct, "lines")


def _counts(own: DataFrame, lines: DataFrame, n: int) -> dict[int, int]:
    """How many features lie in each bucket; at most as many rows as there are buckets."""
    features = lines.select("times", F.explode("buckets").alias("bucket"))
    if n > 1:
        across = own.select(F.lit(1).cast("bigint").alias("times"), F.explode("__cross").alias("bucket"))
        features = features.unionByName(across)
    counted = features.groupBy("bucket").agg(F.sum("times").alias("n"))
    return {row["bucket"]: row["n"] for row in counted.collect()}


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Of each bucket 1000 times the log of its likelier share in the target, floored; add-one smoothed."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)

    def gain(b: int) -> int:
        return math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((raw.get(b, 0) + 1) * t_all)))

    return [gain(b) for b in range(buckets)]


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    n: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of `docs`: the columns `keep` (all by default) and a struct `resampling`.

    Features are all runs of 1 to `n` words, A-Z in lower case, hashed into `buckets`, repeats counted.
    A document's weight is the floored mean gain of its features (none: 0), its score adds 1000 times
    the Gumbel noise of `seed` and its key. Of the documents with at least `min_words` words, `percent`
    percent with the highest scores are drawn and ranked from 1; ties go to the smaller key, null first.

    `resampling` has n_words, n_features, weight, score, rank (null: not drawn), all long. A null text
    has no words; a null key stands as an empty text in the noise. Repeated rows are documents of their
    own and may all be drawn. With an empty target, or without documents, gains come from the smoothing
    alone. A column `resampling` is replaced.
    """
    table = Masked(docs, replaced=("resampling",))
    table.kept = [i for i in table.kept if keep is None or table.names[i] in keep]
    names = table.columns()
    slim = table.df.select(*names, F.col(table.at(key)).alias("__key"), F.col(table.at(text)).alias("__text"))
    own, lines = _cut(slim, "__text", n, buckets)
    goal = _cut(target.select(column(target_text).alias("__text")), "__text", n, buckets)
    gains = bucket_gains(_counts(own, lines, n), _counts(*goal, n), buckets)
    # one literal: a table as long as there are buckets
    of_bucket = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")

    def total(found: Column) -> Column:
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.get(of_bucket, b))

    lines = lines.select("line", "times", "words", F.size("buckets").cast("bigint").alias("features"), total(F.col("buckets")).alias("gain"))
    every = lines.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(lines.where(F.col("times") * HOT_SHARE > every).drop("times"))
    rest = lines.where(F.col("times") * HOT_SHARE <= every).drop("times")
    placed = own.select("__row", F.explode("__lines").alias("line"))
    looked_up = placed.join(hot, "line").unionByName(
        placed.join(hot.select("line"), "line", "left_anti").join(rest, "line")
    )
    sums = looked_up.groupBy("__row").agg(*(F.sum(name).alias(name) for name in ("words", "features", "gain")))
    sums = own.drop("__lines").join(sums.withColumnRenamed("__row", "__of"), F.col("__row") == F.col("__of"), "left")
    zero = F.lit(0).cast("bigint")
    gain = F.coalesce("gain", zero) + total(F.col("__cross"))
    sums = sums.select(
        *names,
        "__key",
        "__row",
        F.coalesce("words", zero).alias("__words"),
        (F.coalesce("features", zero) + F.size("__cross")).alias("__features"),
        gain.alias("__gain"),
    )
    down = F.expr("(__gain - pmod(__gain, __features)) div __features")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = sums.withColumn("__weight", F.when(F.col("__features") > 0, down).otherwise(zero)).select(
        *names, "__key", "__row", "__words", "__features", "__weight", (F.col("__weight") + noise).alias("__score"),
        (F.col("__words") >= min_words).alias("__fit"),
    )
    order = [F.desc("__fit"), F.desc("__score"), F.asc_nulls_first("__key"), F.asc("__row")]
    ranked = numbered(scored, order, "__number")
    most = percent * ranked.where("__fit").count() // 100
    return table.back(
        ranked,
        F.struct(
            F.col("__words").alias("n_words"),
            F.col("__features").alias("n_features"),
            F.col("__weight").alias("weight"),
            F.col("__score").alias("score"),
            F.when(F.col("__fit") & (F.col("__number") < most), F.col("__number") + 1).alias("rank"),
        ).alias("resampling"),
    )
