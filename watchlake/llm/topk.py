"""Exact search for the largest inner products.

Vectors are stored once in order of their length, in blocks of bounded bytes, and stay there.
Queries come to them: as many as a bound in bytes allows are broadcast in one pass. A rotation fitted
to the whole table by singular values gathers most of a vector in its first components. A partial
product over these plus the product of the lengths of the rests is a bound (Cauchy-Schwarz) for the
whole product; it is made sharper cut by cut, and only what no cut rules out is computed in full, as
whole numbers. The block of the longest vectors gives each query a score to beat. After that, passes
take queries in the order of the length a vector must have to beat it, so row groups of shorter
vectors are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchlake.llm.common import column, run_folder, stored

#: Bytes of a block's vectors, and of the queries that are broadcast in a pass, about.
BLOCK_BYTES, PASS_BYTES = 64 << 20, 32 << 20
#: Vectors and queries multiplied at a time, and numbers gathered at a time for single pairs.
STEP, GROUP, PAIRS = 2048, 512, 1 << 22
#: The rotation is fitted up to this many components; longer vectors are not rotated.
MAX_FIT = 1024
_EXACT = float(2**52)


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, norm) of rows with a key and a vector without null or non-finite components."""
    x = column(vector).cast("array<double>")
    finite = F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    )
    rows = vectors.where(column(key).isNotNull() & x.isNotNull() & finite).select(
        column(key).alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v")
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return rows.withColumn("norm", F.sqrt(square))


def _matrix(values: pa.Array, d: int, kind=np.int64) -> np.ndarray:
    """Lists as the rows of a matrix; shorter ones end in zeros."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(values), d), kind)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(values)), sizes), np.arange(len(flat)) - first] = flat
    return out


def fitted_rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of the whole table, from the sum of each task's products."""
    if not d or d > MAX_FIT:
        return np.eye(d)

    def table(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "products"]
        )

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch["v"], d).astype(float)
            total += m.T @ m
        yield table(dict(enumerate(total)))

    def add(batches):
        sums = {}
        for batch in batches:
            for i, row in zip(batch["i"].to_pylist(), _matrix(batch["products"], d, float), strict=True):
                sums[i] = sums[i] + row if i in sums else row
        yield table(sums)

    schema = "i bigint, products array<double>"
    sums = rows.select("v").mapInArrow(run, schema).repartition("i").mapInArrow(add, schema)
    found = sums.orderBy("i").toArrow()  # as many rows as components, whatever the data
    gram = _matrix(found["products"], d, float)
    if gram.shape != (d, d) or not np.isfinite(gram).all():
        return np.eye(d)
    return np.linalg.svd(gram + gram.T)[0]


def _scores(q: np.ndarray, v: np.ndarray, top: float) -> np.ndarray:
    """Products of the rows of `q` with those of `v`, as whole numbers."""
    if top < _EXACT:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q @ v.T


def _pair_scores(q: np.ndarray, i: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of row `i` of `q` with row `j` of `v`, pair by pair."""
    step = max(1, PAIRS // max(1, q.shape[1]))
    parts = [(q[i[a : a + step]] * v[j[a : a + step]]).sum(1) for a in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0, q.dtype)


def _best(q, score, uid, ids, k):
    """The k best entries of each query: by score, then id, then row."""
    order = np.lexsort((uid, ids, -score, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = order[rank < k]
    return keep, rank[rank < k]


def _cuts(d: int) -> list[int]:
    """Numbers of leading components after which the rest is bounded."""
    return sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2)}) if d else [0]


def _rests(rotated: np.ndarray) -> list[np.ndarray]:
    """For each cut the length of what lies behind it."""
    return [np.sqrt((rotated[:, cut:] ** 2).sum(1)) for cut in _cuts(rotated.shape[1])]


class _Rows:
    """Vectors to be met by the queries."""

    def __init__(self, batch: pa.RecordBatch, rotation: np.ndarray):
        self.v = _matrix(batch["v"], len(rotation))
        self.uid, self.ids = batch["uid"].to_numpy(), batch["id"].to_numpy()
        self.rotated = self.v @ rotation
        self.norm = np.sqrt((self.rotated**2).sum(1))
        self.rests = _rests(self.rotated)


class _Group:
    """Some queries with the best they have met; `limit` is a score that others reach k times already."""

    SLACK = 1e-9

    def __init__(self, q: np.ndarray, uid: np.ndarray, beat: np.ndarray, rotation: np.ndarray, k: int):
        self.q, self.uid, self.k = q, uid, k
        self.rotated = q @ rotation
        self.norm = np.sqrt((self.rotated**2).sum(1))
        self.rests = _rests(self.rotated)
        self.limit = beat.astype(float)
        none = np.empty(0, np.int64)
        #: query (row of `q`), row, id and score of the best so far
        self.best = (none, none, none, none)

    def meet(self, rows: _Rows) -> None:
        slack, limit, d = self.SLACK, self.limit, self.q.shape[1]
        reach = self.norm * rows.norm.max(initial=0) * (1 + slack) + slack
        near = np.flatnonzero(reach >= limit)
        if not len(near):
            return
        cuts = _cuts(d)
        partial = self.rotated[near, : cuts[0]] @ rows.rotated[:, : cuts[0]].T
        bound = partial + np.outer(self.rests[0][near], rows.rests[0])
        bound += slack * np.outer(self.norm[near], rows.norm) + slack
        open_ = (bound >= limit[near, None]) & (self.uid[near, None] != rows.uid)
        at, cols = np.nonzero(open_)
        if not len(at):
            return
        top = float(self.norm[near].max() * rows.norm.max()) * max(1, d)
        if len(at) * 8 > open_.size or top >= _EXACT:
            queries = near[at]
            score = _scores(self.q[near], rows.v, top)[at, cols]
        else:
            queries, sums = near[at], partial[at, cols]
            for number in range(1, len(cuts)):
                a, b = cuts[number - 1], cuts[number]
                sums = sums + _pair_scores(self.rotated[:, a:b], queries, rows.rotated[:, a:b], cols)
                most = sums + self.rests[number][queries] * rows.rests[number][cols]
                most += slack * self.norm[queries] * rows.norm[cols] + slack
                left = most >= limit[queries]
                queries, cols, sums = queries[left], cols[left], sums[left]
            score = _pair_scores(self.q, queries, rows.v, cols)
        good = score >= limit[queries]
        new = (queries[good], rows.uid[cols[good]], rows.ids[cols[good]], score[good])
        every = [np.concatenate(pair) for pair in zip(self.best, new, strict=True)]
        keep, rank = _best(every[0], every[3], every[1], every[2], self.k)
        self.best = tuple(x[keep] for x in every)
        full = rank == self.k - 1
        reached = self.best[0][full]
        limit[reached] = np.maximum(limit[reached], self.best[3][full])


_FOUND = "query_uid bigint, uid bigint, vec_id bigint, score bigint"


def search_pass(vectors: DataFrame, asked: pa.Table, rotation: np.ndarray, k: int, to: str) -> None:
    """Write to `to` the `k` best of each task's rows for each query (uid, v, beat) of `asked`.

    `asked` is broadcast; rows are scored where they are read.
    """
    d = len(rotation)
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast((_matrix(asked["v"], d), asked["uid"].to_numpy(), asked["beat"].to_numpy()))

    def run(batches):
        q, uid, beat = sent.value
        groups = [
            _Group(q[i : i + GROUP], uid[i : i + GROUP], beat[i : i + GROUP], rotation, k) for i in range(0, len(q), GROUP)
        ]
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                rows = _Rows(batch.slice(first, STEP), rotation)
                for group in groups:
                    group.meet(rows)
        for group in groups:
            own, *others = group.best
            columns = [pa.array(x, pa.int64()) for x in (group.uid[own], *others)]
            yield pa.RecordBatch.from_arrays(columns, ["query_uid", "uid", "vec_id", "score"])

    vectors.select("uid", "id", "v").mapInArrow(run, _FOUND).write.parquet(to)
    sent.destroy()


def _passes(queries: DataFrame, parts: int, *order: str) -> DataFrame:
    """Queries with `part`, stored in as many folders: ranges of `order` of about equal size."""
    path = run_folder(queries.sparkSession, "queries")
    ranged = queries.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged.write.partitionBy("part").parquet(path)
    return queries.sparkSession.read.schema(ranged.schema).parquet(path)


def top_products(
    vectors: DataFrame,
    every: int = 50,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    k: int = 5,
    block: int | None = None,
    group: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `k` best rows by inner product.

    Components become `floor(scale * x)`. Queries are the rows whose key `every` divides, candidates
    all rows but the query's own row; ties go to the smaller key. Rows with a null key, a null
    vector, or a component that is null or not finite take no part; shorter vectors end in zeros.
    Repeated rows are rows of their own. Scores are exact while they fit 64 bits. Keys are numbers.
    Other columns are left out. With fewer than `k` candidates a query has them all. `block` vectors are
    stored together and `group` queries make a pass, by default what `BLOCK_BYTES` and `PASS_BYTES` hold.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, key, vector, scale).withColumn("is_query", F.col("id") % every == 0)
    total, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    d = d or 0
    block = block or max(1, BLOCK_BYTES // (8 * max(d, 1)))
    group = group or max(1, PASS_BYTES // (8 * max(d, 1)))
    ordered = rows.repartitionByRange(max(1, math.ceil(total / block)), F.desc("norm"), "id")
    # sorted, so that the statistics of row groups tell lengths apart
    ordered = ordered.sortWithinPartitions(F.desc("norm"), "id").withColumns(
        {"block": F.spark_partition_id(), "uid": F.monotonically_increasing_id()}
    )
    ordered = stored(ordered, "vectors")
    rotation = fitted_rotation(ordered, d)
    first_block, blocks = ordered.agg(F.min("block"), F.count_distinct("block")).first()
    queries = ordered.where("is_query").select("uid", "id", "norm", "v")
    parts = max(1, math.ceil(queries.count() / group))
    found_at = run_folder(spark, "found")

    def search(asking: DataFrame, order: list[str], name: str, candidates: DataFrame) -> None:
        table = _passes(asking, parts, *order)
        for part in range(parts):
            own = table.where(F.col("part") == part).select("uid", "v", "beat", "needed")
            asked = own.toArrow()  # of bounded size, see `group`
            needed = float(asked["needed"].to_numpy().min(initial=math.inf))
            long_enough = candidates.where(F.col("norm") >= needed - 1e-6)
            search_pass(long_enough, asked, rotation, k, f"{found_at}/{name}-{part}")

    def found() -> DataFrame:
        return spark.read.schema(_FOUND).parquet(f"{found_at}/*")

    start = queries.withColumns({"beat": F.lit(-(2**63)).cast("bigint"), "needed": F.lit(0.0)})
    search(start, ["uid"], "first", ordered.where(F.col("block").eqNullSafe(first_block)))
    if blocks > 1:
        kth = found().groupBy("query_uid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        reached = F.coalesce(F.col("n") >= k, F.lit(False))
        asking = (
            queries.join(kth, queries["uid"] == kth["query_uid"], "left")
            .withColumn("beat", F.when(reached, F.col("low")).otherwise(F.lit(-(2**63)).cast("bigint")))
            # a vector must be as long as this to reach the k-th score so far
            .withColumn(
                "needed",
                F.when((F.col("beat") > 0) & (F.col("norm") > 0), F.col("beat") / F.col("norm") * (1 - 1e-8)).otherwise(0.0),
            )
            .select(*start.columns)
        )
        others = ordered.where(F.col("block") != first_block)
        search(asking, ["needed", "uid"], "others", others)
    names = queries.select(F.col("uid").alias("query_uid"), F.col("id").alias("query_id"))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(names, "query_uid").select(
        F.col("query_id").cast("bigint").alias("query_id"), "rank", "vec_id", "score"
    )
