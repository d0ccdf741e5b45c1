"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Each document's shingle set is hashed once per permutation, and both the smallest and the largest
value are kept, so half as many permutations give a signature of the same length; smallest and
largest of one permutation rarely err together, which lowers the variance. Bands of the signature
bring candidates together.

Documents with the same set are one class from the start. In each bucket of a band all classes are
compared with one of them, the leader, not with each other. Links found that way join classes to
components. Of each leader's classes most then are in one component; the others are compared with
all of them, in cells of bounded size, and only links between components leave a cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from watchlake.llm.common import WORD, Masked, column, release, small_batches, stored, text_digest
from watchlake.llm.tokens import mix, runs, slices, words

#: 32 bands of 4 values, the smallest and largest of 2 permutations each. Two large
#: sets of similarity 0.8 share no band with a chance of 0.59 ** 32, 5e-8. Smallest and largest of one
#: permutation are two members, so m of n shingles agree on both with m (m - 1) / (n (n - 1)): at worst,
#: for 4 of 5, the chance is 0.64 ** 32, 6.3e-7.
BANDS, ROWS = 32, 4
#: Shingles of the two sides of a cell.
MEMBER_SHINGLES, REST_SHINGLES = 4_000_000, 1_000_000
_PERMUTATIONS = BANDS * ROWS // 2
_numbers = mix(np.arange(1, 4 * _PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FACTORS = _numbers[:_PERMUTATIONS] | np.uint64(1)
_SHIFTS = _numbers[_PERMUTATIONS : 2 * _PERMUTATIONS]
_COMBINE = (_numbers[2 * _PERMUTATIONS :] | np.uint64(1)).reshape(BANDS, ROWS)


def shingle_sets(texts: pa.ChunkedArray, shingle: int) -> Iterator[np.ndarray]:
    """For each text its sorted set of shingle hashes; fewer words than that make one shingle."""
    for _, data, ends in slices(texts):
        w = words(data, ends)
        for doc in range(len(ends)):
            own = w.hashes[w.of(doc)]
            yield np.unique(runs(own, min(shingle, len(own)))) if len(own) else own


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a set under each permutation."""
    low = np.full(_PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(_PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 2048):
        values = shingles[i : i + 2048, None] * _FACTORS + _SHIFTS
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return low, high


def bands(shingles: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band."""
    signature = np.stack(min_max(shingles), axis=1).reshape(BANDS, ROWS)
    keys = (signature * _COMBINE).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None


def with_class(docs: DataFrame, text: str, shingle: int, name: str, also: str | None = None) -> DataFrame:
    """`docs` and the class of each row's set; `also` "bands" or "set" adds a column of that name."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            classes, sizes, extra = [], [], []
            for shingles in shingle_sets(table[at], shingle):
                classes.append(_class(shingles))
                sizes.append(len(shingles))
                if also == "bands":
                    extra.append(bands(shingles) if len(shingles) else None)
                elif also == "set":
                    extra.append(shingles.tobytes())
            table = table.drop_columns([text]) if also else table
            table = table.append_column(name, pa.array(classes, pa.binary()))
            if also:
                kind = pa.list_(pa.int64()) if also == "bands" else pa.binary()
                table = table.append_column("size", pa.array(sizes, pa.int64()))
                table = table.append_column(also, pa.array(extra, kind))
            yield from table.to_batches()

    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    fields = [f for f in docs.schema if not also or f.name != text]
    more = {"bands": ", size bigint, bands array<bigint>", "set": ", size bigint, `set` binary"}.get(also, "")
    return docs.mapInArrow(run, StructType(fields + StructType.fromDDL(f"{name} binary{more}").fields))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): the root is the smallest node reachable.

    Large-star and small-star in turn: each hangs a node's neighbours on its smallest one, until
    nothing changes. Every step is stored in the shared folder.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u"))
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hung = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        spent = [edges, large]
        edges = stored(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        release(*spent)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _overlaps(batches):
    for batch in batches:
        shared = [
            len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), True))
            for x, y in zip(batch["x"], batch["y"])
        ]
        both = pa.array(shared, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["a"], batch["b"], batch["m"], batch["n"], both], ["a", "b", "m", "n", "shared"]
        )


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (a, b) of classes: sizes m and n, and how many shingles they share."""
    own = pairs.join(
        sets.select(F.col("class").alias("b"), F.col("size").alias("n"), F.col("set").alias("y")), "b"
    )
    other = sets.select(F.col("class").alias("a"), F.col("size").alias("m"), F.col("set").alias("x"))
    return own.join(other, "a").mapInArrow(_overlaps, "a binary, b binary, m bigint, n bigint, shared bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of `docs`: key, digest (of the text), n_shingles, class, component,
    component_id, kept.

    Words are what white space parts, A-Z in lower case; a text's set has all runs of `shingle`
    words, or all of its words as one run if they are fewer. Rows are linked if `percent` of the
    union of their sets is shared, component_id is the smallest key reachable, and kept tells the
    rows whose key that is. Texts that are null or without words have no class and no links, and
    are kept under their own key. A null key never is the smallest; a component of null keys only
    has a null component_id, and its rows are kept. Other columns are left out, as their names may
    clash. Rows with equal sets are compared once for all of them.
    """
    spark = docs.sparkSession
    text = column(text).cast("string")
    plain = docs.select(column(key).alias("key"), text_digest(text).alias("digest"), text.alias("text"))
    marked = stored(with_class(plain, "text", shingle, "class", "bands"), "classes")
    classes = stored(
        marked.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest")).alias("one"),
            F.first("size").alias("size"),
            F.first("bands").alias("bands"),
        )
        .select("class", "one.key", "one.digest", "size", "bands"),
        "sets",
    )
    buckets = classes.select("class", "size", F.explode("bands").alias("bucket"))
    leaders = (
        buckets.groupBy("bucket")
        .agg(F.min(F.struct("class", "size")).alias("leader"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .select("bucket", F.col("leader.class").alias("leader"), F.col("leader.size").alias("leader_size"))
    )
    members = stored(buckets.join(leaders, "bucket"), "members")

    def alike(m, n):
        return (F.col(m) * 100 >= F.col(n) * percent) & (F.col(n) * 100 >= F.col(m) * percent)

    stars = members.where((F.col("class") != F.col("leader")) & alike("size", "leader_size"))
    stars = stored(stars.select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct(), "stars")

    wanted = stars.select(F.col("a").alias("class")).union(stars.select("b")).distinct()
    first = stored(_sets(plain, classes, wanted, shingle), "firstsets")
    found = stored(compared(stars, first), "found")
    union = F.col("m") + F.col("n") - F.col("shared")
    link = F.col("shared") * 100 >= union * percent
    roots = stored(components(found.where(link).select("a", "b")), "roots")

    late = stored(_left_over(plain, classes, members, roots, first, shingle, percent), "late")
    release(members, stars, first)
    if not late.isEmpty():
        spent, roots = roots, stored(components(found.where(link).select("a", "b").unionByName(late)), "allroots")
        release(spent)
    release(found, late)
    smallest = roots.join(classes, roots["node"] == classes["class"]).groupBy("root").agg(
        F.min("key").alias("component_id")
    )
    of_class = roots.join(smallest, "root").select(F.col("node").alias("class"), "root", "component_id")
    of_class = classes.join(of_class, "class", "left").select(
        F.col("class").alias("c"),
        F.coalesce("root", "class").alias("component"),
        F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return marked.join(of_class, marked["class"] == of_class["c"], "left").select(
        F.col("key").alias(key),
        F.col("digest"),
        F.col("size").alias("n_shingles"),
        "class",
        "component",
        F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", column(key).eqNullSafe(F.col("component_id")))


def _left_over(plain, classes, members, roots, known, shingle, percent) -> DataFrame:
    """Links (a, b) between classes that share a bucket but no component yet.

    All classes of a bucket are in the group of its leader, whatever the band, so groups are taken
    by leader. Most of a group are in one component, its main one; the rest of it is compared with
    the whole group, in cells of a bounded number of shingles on both sides. Of a class's links one
    to each component is returned.
    """
    placed = (
        members.select("leader", "class", "size")
        .distinct()
        .join(roots, F.col("class") == F.col("node"), "left")
        .select("leader", "class", "size", F.coalesce("root", "class").alias("root"))
    )
    placed = stored(placed, "placed")
    per_root = placed.groupBy("leader", "root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )
    groups = (
        per_root.groupBy(F.col("leader").alias("of"))
        .agg(
            F.max(F.struct("n", "root")).alias("main"),
            F.count(F.lit(1)).alias("roots"),
            F.sum("size").alias("all"),
            F.max(F.struct("n", "size")).alias("most"),
        )
        .where("roots > 1")
        .select(
            "of",
            F.col("main.root").alias("main"),
            F.ceil(F.col("all") / MEMBER_SHINGLES).cast("int").alias("columns"),
            # one row of cells at least; sizes of the others are bounded by those of all
            F.greatest(F.ceil((F.col("all") - F.col("most.size")) / REST_SHINGLES), F.lit(1))
            .cast("int")
            .alias("rows"),
        )
    )
    mixed = stored(placed.join(groups, F.col("leader") == F.col("of")).drop("of"), "mixed")
    wanted = mixed.select("class").distinct().join(known.select("class"), "class", "left_anti")
    sets = known.unionByName(_sets(plain, classes, wanted, shingle)).select("class", "set")
    mixed = mixed.join(sets, "class")

    def block(count):
        return F.pmod(F.xxhash64("class"), F.col(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    rest = mixed.where(F.col("root") != F.col("main")).withColumn("i", block("rows"))
    cells = mixed.withColumn("j", block("columns")).select(
        "leader", every("rows").alias("i"), "j", F.lit(0).alias("side"), "class", "root", "set"
    ).unionByName(
        rest.select("leader", "i", every("columns").alias("j"), F.lit(1).alias("side"), "class", "root", "set")
    )
    order = ["leader", "i", "j", "side"]
    return (
        cells.repartition(*order[:3])
        .sortWithinPartitions(*order)
        .mapInArrow(_cell_links(percent), "a binary, b binary")
        .distinct()
    )


def _cell_links(percent: int):
    """Rows come cell by cell, in each all members (side 0) before the rest (side 1)."""

    def links(held: list, asking: list) -> Iterator[tuple[bytes, bytes]]:
        sets = [np.frombuffer(x, np.uint64) for _, _, x in held]
        sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
        roots, root_of = np.unique([r for _, r, _ in held], return_inverse=True)
        for name, root, raw in asking:
            own = np.frombuffer(raw, np.uint64)
            first = np.searchsorted(values, own, "left")
            counts = np.searchsorted(values, own, "right") - first
            at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            shared = np.bincount(owner[at], minlength=len(sets))
            near = np.flatnonzero(shared * 100 >= (sizes + len(own) - shared) * percent)
            for r in np.unique(root_of[near], return_index=True)[1]:
                other, its_root, _ = held[near[r]]
                if its_root != root:
                    yield min(name, other), max(name, other)

    def run(batches):
        cell, held, asking, out = None, [], [], []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("leader", "i", "j", "side", "class", "root", "set")]
            for leader, i, j, side, *row in zip(*columns, strict=True):
                if (leader, i, j) != cell:
                    if held and asking:
                        out += links(held, asking)
                    cell, held, asking = (leader, i, j), [], []
                (asking if side else held).append(row)
            if out:
                yield _pairs(out)
                out = []
        if held and asking:
            yield _pairs(list(links(held, asking)))

    return run


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["a", "b"])


def _sets(plain: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The full sets of the classes `wanted`, made again from the texts of their first rows."""
    firsts = classes.join(wanted, "class", "left_semi").select("key", "digest")
    sets = with_class(_rows_of(plain, "key", "digest", firsts).select("text"), "text", shingle, "class", "set")
    return sets.select("class", "size", "set")


def _rows_of(rows: DataFrame, key: str, digest: str, wanted: DataFrame) -> DataFrame:
    """Of `rows` one for each of the different `wanted` (key, digest); each row's text is moved once.

    Keys may be null, and rows repeated. Rows equal in key and digest have equal texts.
    """

    def dealt(df: DataFrame, key: str, digest: str, names: list[str]) -> DataFrame:
        at = [F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(digest)]
        return df.select(*df.columns, *(c.alias(n) for c, n in zip(at, names, strict=True)))

    own, met = ["__none", "__key", "__dig"], ["__none2", "__key2", "__dig2"]
    left, right = dealt(rows, key, digest, own), dealt(wanted, "key", "digest", met).select(*met)
    same = [F.col(a) == F.col(b) for a, b in zip(own, met, strict=True)]
    # dealt by the same columns, so rows that stand repeatedly fall without another shuffle
    return left.join(right, same, "left_semi").dropDuplicates(own).select(*rows.columns)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without all but one row of each group of near duplicates: that of the smallest key.

    Of rows with that key one stays; rows without words all stay.
    """
    table = Masked(docs)
    own_key, own_text = table.at(key), table.at(text)
    marks = near_duplicates(docs, key, text, shingle, percent)
    chosen = (
        marks.where("kept AND class IS NOT NULL")
        .groupBy("component")
        .agg(F.min(F.struct(column(key).alias("key"), "digest")).alias("one"))
        .select("one.key", "one.digest")
    )
    worded = F.coalesce(F.col(own_text).cast("string").rlike(WORD), F.lit(False))
    rows = table.df.where(worded).withColumn("__digest", text_digest(F.col(own_text).cast("string")))
    kept = _rows_of(rows, own_key, "__digest", stored(chosen, "chosen")).drop("__digest")
    return table.back(kept.unionByName(table.df.where(~worded)))
