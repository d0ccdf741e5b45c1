"""Document fingerprints by consistent weighted sampling of words.

A text is a set of terms weighted by how often they occur. For each of the samples every term draws, from
its hash alone, two gamma numbers r and c and a uniform number b; with weight S it stands at the level
t = floor(ln S / r + b) and has the value ln a = ln c - r (t - b + 1). The sample is the term and level of
the smallest value. Two texts agree in a sample with a probability that is the generalised Jaccard similarity
of their weights, the sum of the smaller over the sum of the larger ones.

Only DataFrame functions. A text's terms are rows of one task; smallest values are taken before anything is
shuffled, so a shuffle moves a fixed number of bytes for each text, and none if `docs` is already dealt by
columns in `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import WORD, Masked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLES = 32
#: Steps of one in the value of a term.
STEPS = 1 << 23
_LOW32 = (1 << 32) - 1


def _bits(number: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(number, shift) if shift else number
    return part.bitwiseAND(F.lit((1 << width) - 1)) if shift + width < 64 else part


def _uniform(number: Column, shift: int, width: int) -> Column:
    """A number between 0 and 1, neither included, from `width` bits of `number`."""
    return (_bits(number, shift, width) + F.lit(0.5)) * F.lit(2.0**-width)


def sampled(term: Column, log_weight: Column, j: int) -> Column:
    """Value and identity of a term in sample j, in one long: the smallest one is the sample.

    Values lie between -128 and 4, so they fill 31 bits in steps of 2**-23; the identity fills the rest.
    """
    first = F.xxhash64(term, F.lit(j))
    second = F.xxhash64(first)
    r = -F.ln(_uniform(first, 0, 24) * _uniform(first, 24, 24))
    b = _uniform(first, 48, 16)
    log_c = F.ln(-F.ln(_uniform(second, 0, 32) * _uniform(second, 32, 32)))
    level = F.floor(log_weight / r + b)
    value = log_c - r * (level - b + F.lit(1.0))
    steps = F.floor((value + F.lit(128.0)) * F.lit(float(STEPS)))
    return steps * F.lit(1 << 32) + F.xxhash64(first, level).bitwiseAND(F.lit(_LOW32))


def weighted_terms(df: DataFrame, text: str, out: str, width: int) -> DataFrame:
    """`df` without `text`, with `out`: an array of (h, n), hash and count of each term of a text."""
    names = [name for name in df.columns if name != text]
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    words = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    df = df.select(*names, words.alias("__words"))
    words = F.col("__words")
    if width == 1:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
    else:
        starts = F.when(
            F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
        ).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " ")))
    df = df.select(*names, F.sort_array(hashes).alias("__hashes"))
    hashes = F.col("__hashes")
    lasts = F.filter(
        F.transform(hashes, lambda h, i: F.when(~h.eqNullSafe(F.get(hashes, i + 1)), i)), lambda i: i.isNotNull()
    )
    df = df.select(*names, "__hashes", lasts.alias("__lasts"))
    lasts = F.col("__lasts")
    terms = F.transform(
        lasts, lambda last, k: F.struct(F.get(hashes, last).alias("h"), (last - F.coalesce(F.get(lasts, k - 1), F.lit(-1))).alias("n"))
    )
    return df.select(*names, terms.alias(out))


def fingerprint(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 1, samples: int = SAMPLES
) -> DataFrame:
    """One row per row of `docs`: the columns `keep` (all but the text by default) and a struct `fingerprint`.

    Terms are runs of `width` words, which white space parts, A-Z in lower case; fewer words make one term.
    `fingerprint` has `samples`, a number below 2**32 for each sample, and `code`, the same as hex digits, 8 for
    each. Equal texts have equal fingerprints.

    A text that is null or without words has -1 for all samples and an empty code. Keys may be null or
    repeated; repeated rows have a fingerprint each. Kept columns must be of types that Spark can group by. A
    column `fingerprint` is replaced.
    """
    table = Masked(docs, replaced=("fingerprint",))
    wanted = [name for name in docs.columns if name != text] if keep is None else keep
    table.kept = [i for i in table.kept if table.names[i] in wanted]
    names = table.columns()
    slim = table.df.select(*names, F.monotonically_increasing_id().alias("__row"), F.col(table.at(text)).alias("__text"))
    terms = weighted_terms(slim, "__text", "__terms", width)
    terms = terms.select(*names, "__row", F.explode_outer("__terms").alias("__term"))
    terms = terms.select(*names, "__row", F.col("__term.h").alias("__h"), F.ln(F.col("__term.n").cast("double")).alias("__log"))
    smallest = [F.min(sampled(F.col("__h"), F.col("__log"), j)).alias(f"__s{j}") for j in range(samples)]
    found = terms.groupBy(*names, "__row").agg(*smallest)
    numbers = F.array(*(F.coalesce(F.col(f"__s{j}").bitwiseAND(F.lit(_LOW32)), F.lit(-1).cast("bigint")) for j in range(samples)))
    found = found.select(*names, numbers.alias("__samples"))
    both = F.struct(F.col("__samples").alias("samples"), code_of(F.col("__samples")).alias("code"))
    return table.back(found, both.alias("fingerprint"))


def code_of(samples: Column) -> Column:
    """Samples as hex digits; empty for a text without words."""
    digits = F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.when(F.get(samples, F.lit(0)) < 0, F.lit("")).otherwise(digits)


def likeness(left: Column, right: Column) -> Column:
    """Share of samples in which two fingerprints' `samples` agree; two texts without words are alike."""
    same = F.zip_with(left, right, lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x).cast("double") / F.size(left)
