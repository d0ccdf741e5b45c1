"""Exact cosine top-k by an index of blocks around pivots, most of which need not be read.

The vectors are stored next to their nearest pivot, by angle to it, and cut into blocks. A block knows
the smallest and largest angle of its vectors to the pivot. Angles between vectors obey the triangle
inequality, so a question at angle q to the pivot is no nearer to any vector of the block than
max(q - largest, smallest - q, 0). The nearest blocks of a question are scored first; then only those
that could hold a vector as good as the k-th best so far. Where bounds don't help all blocks are read.

Of few questions and blocks each pair is a row, which tells what to read. Of many none is: a question's nearest blocks
give it a score to beat, and then vectors pass by held questions as in `search`, and each block is scored
for the questions it may be good for.

Vectors are stored in one folder per range of their order, so folders without a wanted block are not opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchlake.functions import fixed
from watchlake.operators.ranking import top_per_key
from watchlake.operators.search import (
    BROADCAST_BLOCKS,
    QUESTIONS_PER_BLOCK,
    VECTORS_PER_BLOCK,
    _candidate_schema,
    _meta,
    _search_cells,
    _vector,
    cell_scorer,
)
from watchlake.session import cut_lineage, is_small, spread_rows

#: Vectors that others are laid round; they are a fixed number, whatever the table's size.
PIVOTS = 64
#: Far above the error of an angle, which is largest near 0.
SLACK = 1e-6
#: Most pairs of a question and a block of its user that become rows.
ROW_CELLS = 200_000
_BLOCK = ("part", "block", "user_id", "pivot")


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    matrix = np.stack(vectors)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]


def _usable(vector: np.ndarray, dim: int) -> bool:
    norm = float(np.sqrt((vector * vector).sum())) if len(vector) == dim else 0.0
    return math.isfinite(norm) and norm > 1e-150


def _angles(vectors: list[np.ndarray], pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(vectors) @ pivots.T, -1.0, 1.0))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors of up to `count` rows, those with the smallest hash: the same for each run.

    Only these rows come to the driver. Rows of another length than the first one's are left out.
    """
    order = F.md5(F.concat("user_id", F.lit(":"), F.col("idx").cast("string")))
    rows = vectors.where(F.size("embedding") > 0).orderBy(order).limit(count).select("embedding").toArrow()
    found = [_vector(value) for value in rows.column("embedding")]
    found = [v for v in found if _usable(v, len(found[0]))]
    return _units(found) if found else np.empty((0, 0))


def write_index(
    vectors: DataFrame, path: str, pivots: int = PIVOTS, block_rows: int = VECTORS_PER_BLOCK
) -> None:
    """Store vectors (user_id, idx, embedding, and further columns) as an index below `path`.

    `block_rows` is a power of two. Vectors that are zero, not finite, or of another length than the
    pivots have no angle; their blocks are always read.
    """
    if block_rows & (block_rows - 1):
        raise ValueError("block_rows must be a power of two")
    centres = choose_pivots(vectors, pivots)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_vector(value) for value in batch.column("embedding")]
            pivot, angle = np.full(len(own), -1, "i4"), np.zeros(len(own))
            usable = [i for i, v in enumerate(own) if _usable(v, shared.value.shape[1])]
            for at in range(0, len(usable), 1024):
                rows = usable[at : at + 1024]
                angles = _angles([own[i] for i in rows], shared.value)
                nearest = angles.argmin(axis=1)
                pivot[rows], angle[rows] = nearest, angles[np.arange(len(rows)), nearest]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot), pa.array(angle)], [*batch.schema.names, "pivot", "angle"]
            )

    names = [c for c in vectors.columns if c not in ("pivot", "angle", "part", "block")]
    plain = vectors.select(*names)
    placed = plain.mapInArrow(place, T.StructType([*plain.schema, *T.StructType.fromDDL("pivot int, angle double")]))
    order = ["user_id", "pivot", "angle", "idx"]
    number = F.monotonically_increasing_id()
    numbered = T.StructType([*placed.schema, *T.StructType.fromDDL("block long, part int")])
    spark = vectors.sparkSession
    # an index of no vectors has no file that could tell its columns
    spark.createDataFrame([], numbered).write.mode("overwrite").parquet(f"{path}/columns")
    (
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", number)
        .withColumn("part", F.shiftright("_at", 33).cast("int"))
        .withColumn("block", F.shiftright("_at", block_rows.bit_length() - 1))
        .drop("_at")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(f"{path}/rows")
    )
    blocks = stored_vectors(spark, path).groupBy(*_BLOCK).agg(
        F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    centre_rows = [(i, row.tolist()) for i, row in enumerate(centres)]
    spark.createDataFrame(centre_rows, "pivot int, centre array<double>").write.mode("overwrite").parquet(f"{path}/pivots")


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


@dataclass
class IndexHits:
    """The hits, and which (question_id, block) were read to find them out of how many."""

    hits: DataFrame
    cells: DataFrame

    def share_read(self) -> float:
        """Share of the cells of a question and a block of its user whose vectors were scored."""
        read, every = self.cells.agg(F.count_if("read"), F.count(F.lit(1))).first()
        return read / every if every else 0.0


def _bounded(questions: DataFrame, blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(question_id, block columns, rows, best): the best score a block of the user may hold."""
    dim = centres.shape[1]
    shared = questions.sparkSession.sparkContext.broadcast(centres)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_vector(value) for value in batch.column("embedding")]
            angles = [_angles([v], shared.value)[0].tolist() if _usable(v, dim) else None for v in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("question_id"), batch.column("user_id"), pa.array(angles, pa.list_(pa.float64()))],
                ["question_id", "user_id", "angles"],
            )

    asked = questions.select("question_id", "user_id", "embedding").mapInArrow(
        ask, "question_id long, user_id string, angles array<double>"
    )
    if is_small(blocks, BROADCAST_BLOCKS):
        blocks = F.broadcast(blocks)
    to_pivot = F.get("angles", F.col("pivot"))
    gap = F.greatest(to_pivot - F.col("high"), F.col("low") - to_pivot, F.lit(0.0)) - SLACK
    best = (
        F.when(F.col("pivot") < 0, 1.0)
        # a question without a direction, or of another length, has 0 with all vectors that have an angle
        .when(F.col("angles").isNull(), 0.0)
        .otherwise(F.cos(F.greatest(gap, F.lit(0.0))))
    )
    return asked.join(blocks, "user_id").select("question_id", *_BLOCK, "rows", best.alias("best"))


def _scored(vectors: DataFrame, questions: DataFrame, cells: DataFrame, k: int, questions_per_block: int) -> DataFrame:
    """Candidates of the cells (question_id, block columns); only their blocks are read."""
    counts = cells.groupBy(*_BLOCK).agg(F.ceil(F.count(F.lit(1)) / questions_per_block).alias("parts"))
    counts = cut_lineage(counts)
    # as many folders at most as there were ranges; others are not opened
    folders = [row["part"] for row in counts.select("part").distinct().collect()]
    vectors = vectors.where(F.col("part").isin(folders))
    wanted = F.broadcast(counts) if is_small(counts, BROADCAST_BLOCKS) else counts
    turn = "turn"
    left = vectors.join(wanted, list(_BLOCK)).withColumn(
        turn, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )
    own = questions.select(F.col("question_id").alias("asked"), F.col("embedding").alias("vector"))
    right = (
        cells.join(counts, list(_BLOCK))
        .withColumn(turn, F.pmod(F.xxhash64("question_id"), F.col("parts")))
        .join(own, F.col("question_id") == F.col("asked"))
        .select(*_BLOCK, turn, "question_id", F.col("vector").alias("embedding"))
    )
    keys = [*_BLOCK, turn]
    others = [c for c in vectors.columns if c not in ("part", "block", "pivot", "angle")]
    plain = vectors.select(*others)
    return (
        left.select(*keys, F.col("idx").cast("long").alias("idx"), "embedding", _meta(plain))
        .groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(cell_scorer(k), _candidate_schema(plain))
    )


class _Bounds:
    """Which questions may find one of their k best in a block of vectors around one pivot."""

    columns = ("pivot", "angle", "part", "block")
    order = ("pivot", "angle")
    blocks = ("pivot",)
    #: From this share of the questions on all are scored, which saves a copy of theirs.
    MOST = 0.7

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def angles(self, queries: list[np.ndarray]) -> np.ndarray:
        """Angles to the pivots, not a number for a question without a direction."""
        found = np.full((len(queries), max(1, len(self.centres))), np.nan)
        usable = [i for i, query in enumerate(queries) if _usable(query, self.centres.shape[1])]
        if usable and len(self.centres):
            found[usable] = _angles([queries[i] for i in usable], self.centres)
        return found

    def wanted(self, vectors: pa.RecordBatch, angles: np.ndarray, bar: np.ndarray) -> np.ndarray | None:
        pivot = vectors.column("pivot")[0].as_py()
        if pivot < 0:
            return None
        own = vectors.column("angle").to_numpy()
        best = best_scores(angles[:, pivot], own.min(), own.max())
        some = np.flatnonzero(best >= bar - SLACK)
        return some if len(some) < self.MOST * len(bar) else None


def best_scores(to_pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The best score a block may hold, as in `_bounded`; 0 for a question without a direction."""
    gap = np.maximum(np.maximum(to_pivot - high, low - to_pivot) - SLACK, 0.0)
    return np.nan_to_num(np.cos(gap), nan=0.0)


def _nearest_blocks(questions: DataFrame, blocks: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """(question_id, block columns) of the nearest blocks of each question, until there are k vectors.

    Of blocks, at most BROADCAST_BLOCKS as checked by the caller, each task holds the list.
    """
    listed = blocks.select(*_BLOCK, "rows", "low", "high").orderBy(*_BLOCK).toPandas()
    by_user = {user: own.reset_index(drop=True) for user, own in listed.groupby("user_id")}
    shared, bounds = questions.sparkSession.sparkContext.broadcast(by_user), _Bounds(centres)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_user = shared.value
        for batch in batches:
            angles = bounds.angles([_vector(value) for value in batch.column("embedding")])
            asked, places = [], []
            for at, user in enumerate(batch.column("user_id").to_pylist()):
                own = of_user.get(user)
                if own is None:
                    continue
                pivot = own["pivot"].to_numpy()
                best = best_scores(angles[at][np.maximum(pivot, 0)], own["low"].to_numpy(), own["high"].to_numpy())
                order = np.argsort(-np.where(pivot < 0, 1.0, best), kind="stable")
                rows = np.cumsum(own["rows"].to_numpy()[order])
                first = order[: np.searchsorted(rows, k) + 1]
                asked.append(np.full(len(first), at))
                places.append((user, first))
            if not asked:
                continue
            found = [of_user[user].iloc[first] for user, first in places]
            columns = [batch.column("question_id").take(pa.array(np.concatenate(asked)))]
            for name, kind in (("part", "i4"), ("block", "i8"), ("user_id", None), ("pivot", "i4")):
                values = np.concatenate([own[name].to_numpy() for own in found])
                columns.append(pa.array(values if kind is None else values.astype(kind)))
            yield pa.RecordBatch.from_arrays(columns, ["question_id", *_BLOCK])

    asked = questions.select("question_id", "user_id", "embedding")
    return spread_rows(asked, "question_id").mapInArrow(
        ask, "question_id long, part int, block long, user_id string, pivot int"
    )


def _bars(found: DataFrame, k: int) -> DataFrame:
    """(of, bar): the k-th best score found for a question so far, NULL for less than k."""
    best = top_per_key(found, ["question_id"], [F.desc("score"), F.asc("idx")], k)
    bar = F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar")
    return best.groupBy(F.col("question_id").alias("of")).agg(bar)


def _search_many(
    vectors: DataFrame, blocks: DataFrame, centres: np.ndarray, questions: DataFrame, k: int, questions_per_block: int
) -> IndexHits:
    """Hits without a row per question and block; `cells` are made when they are asked for."""
    if is_small(blocks, BROADCAST_BLOCKS):
        first = cut_lineage(_nearest_blocks(questions, blocks, centres, k))
        kth = cut_lineage(_bars(_scored(vectors, questions, first, k, questions_per_block), k))
    else:
        # bars come up as vectors pass by
        kth = questions.sparkSession.createDataFrame([], "of long, bar double")
    asked = questions.select(F.col("question_id").alias("question_id"), F.col("user_id").alias("user_id"), F.col("embedding").alias("embedding"))
    asked = asked.join(kth, F.col("question_id") == F.col("of"), "left").drop("of")
    block_rows = blocks.agg(F.max("rows")).first()[0] or 1
    found = _search_cells(vectors, asked, k, block_rows, questions_per_block, _Bounds(centres))
    others = [c for c in vectors.columns if c not in ("user_id", "idx", "embedding", *_Bounds.columns)]
    hits = top_per_key(found, ["question_id"], [F.desc("score"), F.asc("idx")], k).select(
        "question_id", "user_id", "rank", "idx", "score", *(f"meta.{c}" for c in others)
    )
    read = F.col("bar").isNull() | (F.col("best") >= F.col("bar") - SLACK)
    cells = _bounded(questions, blocks, centres).join(kth, F.col("question_id") == F.col("of"), "left")
    return IndexHits(hits, cells.select("question_id", *_BLOCK, read.alias("read")))


def search_index(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int = fixed.SEARCH_DEFAULT_K,
    questions_per_block: int = QUESTIONS_PER_BLOCK,
    row_cells: int = ROW_CELLS,
) -> IndexHits:
    """The hits of `search_ranked` for the vectors stored below `path`, the same rows in the same order.

    questions: question_id (unique), user_id, embedding; they are read several times, so they should
    be stored. Questions of a user without vectors have no hits.
    """
    vectors = stored_vectors(spark, path)
    centres = spark.read.parquet(f"{path}/pivots").orderBy("pivot").toArrow()
    centres = [_vector(value) for value in centres.column("centre")]
    centres = np.stack(centres) if centres else np.empty((0, 0))
    blocks = spark.read.parquet(f"{path}/blocks")
    of_user = blocks.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    by_user = questions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_questions"))
    pairs = of_user.join(by_user, "user_id").agg(F.sum(F.col("n_blocks").cast("double") * F.col("n_questions"))).first()[0]
    if (pairs or 0.0) > row_cells:
        return _search_many(vectors, blocks, centres, questions, k, questions_per_block)
    cells = cut_lineage(_bounded(questions, blocks, centres))
    # the nearest blocks, until there are k vectors
    nearest = Window.partitionBy("question_id").orderBy(F.desc("best"), *_BLOCK)
    before = nearest.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)) < k)
    cells = cut_lineage(cells)
    order = [F.desc("score"), F.asc("idx")]
    found = cut_lineage(_scored(vectors, questions, cells.where("first"), k, questions_per_block))
    kth = _bars(found, k)
    read = F.col("first") | F.col("bar").isNull() | (F.col("best") >= F.col("bar") - SLACK)
    cells = cut_lineage(cells.join(kth, F.col("question_id") == F.col("of"), "left").withColumn("read", read))
    more = _scored(vectors, questions, cells.where("read AND NOT first"), k, questions_per_block)
    others = [c for c in vectors.columns if c not in ("user_id", "idx", "embedding", "pivot", "angle", "part", "block")]
    hits = top_per_key(found.unionByName(more), ["question_id"], order, k).select(
        "question_id", "user_id", "rank", "idx", "score", *(f"meta.{c}" for c in others)
    )
    return IndexHits(hits, cells.select("question_id", *_BLOCK, "read"))
