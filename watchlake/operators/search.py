"""Exact cosine top-k search of many questions over the vectors of their own users.

No pair of question and vector ever becomes a row. Tasks score blocks with numpy and hand on
at most k candidates per question, which a final ranking merges. Two ways to bring blocks
together, chosen by a check of the number of questions:

* few questions: they are broadcast and every vector is scored where it was read, without a
  shuffle of the vectors, so it does not matter how many vectors one user has;
* many questions: a user's questions are cut into parts, and the user's vectors go to each part,
  a fixed number of times whatever the size of the table. A task holds one part and keeps its best
  while the vectors pass by in blocks, so it hands on k candidates per question. Users with very
  many questions or vectors are cut further, so neither makes a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.functions import fixed
from watchlake.operators.ranking import top_per_key
from watchlake.session import cut_lineage, is_small

# Most questions that are broadcast: 2,000 x 1,024 floats are 8 MB.
BROADCAST_QUESTIONS = 2_000
# Scored at once: 4,096 x 1,024 floats are 16 MB, 512 questions 2 MB.
VECTORS_PER_BLOCK = 4_096
QUESTIONS_PER_BLOCK = 512
# Bounds of one cell: 16,384 x 1,024 doubles are 128 MB; vectors pass by and are not held.
QUESTIONS_PER_CELL = 16_384
VECTORS_PER_CELL = 262_144
# A user with fewer pairs of question and vector has one cell.
LEAST_PAIRS = 1_000_000
# Pairs, or values of single pairs, that are multiplied at once, about.
_PAIR_VALUES = 1 << 22
# Longest list of users or vector blocks that is broadcast; some 50 bytes each.
BROADCAST_BLOCKS = 200_000
_KEYS = ("user_id", "idx", "embedding")


def _candidate_schema(vectors: DataFrame) -> str:
    """Question, user, position, score, and the other columns of the vector table as `meta`."""
    return (
        "question_id long, user_id string, idx long, score double, meta "
        + vectors.select(_meta(vectors)).schema["meta"].dataType.simpleString()
    )


def _meta(vectors: DataFrame):
    others = [F.col(c) for c in vectors.columns if c not in _KEYS]
    return F.struct(*others or [F.lit(None).cast("string").alias("_none")]).alias("meta")


class _Block:
    """Vectors of one user, ready to be scored against many queries.

    A matrix product finds the rows that can be among the best; only these get their exact
    score. That score is a sum along the own row, so equal vectors get equal scores wherever
    they stand, and ties can be broken by position. Matrix products do not promise that.
    """

    # Far above the rounding error of a product of unit vectors.
    MARGIN = 1e-9
    # Queries multiplied at once; bounds the size of the product.
    QUERIES = 64

    def __init__(self, idx: np.ndarray, embeddings: pa.ListArray):
        self.idx = idx
        lengths = pc.fill_null(pc.list_value_length(embeddings), 0).to_numpy(zero_copy_only=False)
        self.by_length = {}
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            values = embeddings.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            matrix = values.astype("f8").reshape(len(rows), int(length))
            self.by_length[int(length)] = (rows, matrix, np.sqrt((matrix * matrix).sum(axis=1)))

    def best(self, queries: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, scores) of the k best rows of each query, best first."""
        for start in range(0, len(queries), self.QUERIES):
            some = queries[start : start + self.QUERIES]
            for query, likely in zip(some, self._likely(some, k)):
                scores = self._exact(query, likely)
                order = np.lexsort((self.idx[likely], -scores))[:k]
                yield likely[order], scores[order]

    def _likely(self, queries: list[np.ndarray], k: int) -> Iterator[np.ndarray]:
        """Row numbers that include the k best of each query."""
        count = len(self.idx)
        if count <= k:
            yield from (np.arange(count) for _ in queries)
            return
        near = np.zeros((len(queries), count))
        for length, (rows, matrix, norms) in self.by_length.items():
            same = [i for i, query in enumerate(queries) if len(query) == length]
            if same and length:
                asked = np.stack([queries[i] for i in same])
                units = _divide(asked, np.sqrt((asked * asked).sum(axis=1))[:, None])
                near[np.ix_(same, rows)] = _divide(units @ matrix.T, norms)
        for row in near:
            bar = np.partition(row, count - k)[count - k]
            yield np.flatnonzero(row >= bar - self.MARGIN)

    def _exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosine; 0.0 for vectors of another length and for zero vectors."""
        scores = np.zeros(len(rows))
        if len(query) not in self.by_length:
            return scores
        own, matrix, norms = self.by_length[len(query)]
        if len(own) == len(self.idx):
            at, known = rows, slice(None)
        else:
            at = np.searchsorted(own, rows)
            known = np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == rows))
            at = at[known]
        dots = (matrix[at] * query).sum(axis=1)
        scores[known] = _divide(dots, norms[at] * np.sqrt((query * query).sum()))
        return scores


def _divide(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Quotient, 0.0 where the divisor is zero or a value is not a number."""
    shape = np.broadcast_shapes(left.shape, right.shape)
    quotient = np.divide(left, right, out=np.zeros(shape), where=right != 0.0)
    return np.nan_to_num(quotient, copy=False, nan=0.0)


class _Hits:
    """The best candidates found so far, per question."""

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, tuple[str, np.ndarray, np.ndarray, pa.Array]] = {}

    def add(
        self, block: _Block, meta: pa.Array, user: str, questions: list[tuple[int, np.ndarray]]
    ) -> None:
        queries = [query for _, query in questions]
        for (question_id, _), (top, scores) in zip(questions, block.best(queries, self.k)):
            found = (user, block.idx[top], scores, meta.take(pa.array(top)))
            if question_id in self.best:
                found = self._merge(self.best[question_id], found)
            self.best[question_id] = found

    def _merge(self, old: tuple, new: tuple) -> tuple:
        idx, scores = np.concatenate([old[1], new[1]]), np.concatenate([old[2], new[2]])
        top = np.lexsort((idx, -scores))[: self.k]
        meta = pa.concat_arrays([old[3], new[3]]).take(pa.array(top))
        return old[0], idx[top], scores[top], meta

    def batches(self) -> Iterator[pa.RecordBatch]:
        for question_id, (user, idx, scores, meta) in self.best.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(idx), question_id, "i8")),
                    pa.array([user] * len(idx), pa.string()),
                    pa.array(idx.astype("i8")),
                    pa.array(scores),
                    meta,
                ],
                names=["question_id", "user_id", "idx", "score", "meta"],
            )


def _one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _nullable(meta: pa.StructArray) -> pa.StructArray:
    """The same structs with every field nullable, as the declared result has them."""
    fields = [pa.field(f.name, f.type) for f in meta.type]
    return pa.StructArray.from_arrays(meta.flatten(), fields=fields)


def _vector(value: pa.Scalar) -> np.ndarray:
    if not value.is_valid:
        return np.empty(0)
    return value.values.to_numpy(zero_copy_only=False).astype("f8")


def _search_broadcast(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    # At most BROADCAST_QUESTIONS rows, as checked by the caller.
    asked = questions.select("question_id", "user_id", "embedding").toArrow()
    by_user: dict[str, list[tuple[int, np.ndarray]]] = {}
    for question_id, user, embedding in zip(*asked.columns):
        by_user.setdefault(user.as_py(), []).append((question_id.as_py(), _vector(embedding)))
    shared = vectors.sparkSession.sparkContext.broadcast(by_user)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(k)
        for batch in batches:
            users = batch.column("user_id").dictionary_encode()
            codes = users.indices.to_numpy(zero_copy_only=False)
            for code, user in enumerate(users.dictionary.to_pylist()):
                own = batch.take(pa.array(np.flatnonzero(codes == code)))
                idx = own.column("idx").to_numpy(zero_copy_only=False)
                block = _Block(idx, own.column("embedding"))
                hits.add(block, _nullable(own.column("meta")), user, shared.value.get(user, []))
        yield from hits.batches()

    # A filter on the user prunes the partitions of a stored vector table.
    asking = F.col("user_id").isin(list(by_user))
    return (
        vectors.where(asking if by_user else F.lit(False))
        .select("user_id", F.col("idx").cast("long").alias("idx"), "embedding", _meta(vectors))
        .mapInArrow(score, _candidate_schema(vectors))
    )


def cell_scorer(k: int):
    """Scores the vectors of a cell against its questions, all of one user: k candidates per question."""

    def score(cell_vectors: pa.Table, cell_questions: pa.Table) -> pa.Table:
        meta = _nullable(_one_array(cell_vectors.column("meta")))
        idx = cell_vectors.column("idx").to_numpy()
        block = _Block(idx, _one_array(cell_vectors.column("embedding")))
        asked = [
            (question_id.as_py(), _vector(embedding))
            for question_id, embedding in zip(
                cell_questions.column("question_id"), cell_questions.column("embedding")
            )
        ]
        hits = _Hits(k)
        if asked:
            hits.add(block, meta, cell_questions.column("user_id")[0].as_py(), asked)
        empty = pa.schema(
            [
                ("question_id", pa.int64()),
                ("user_id", pa.string()),
                ("idx", pa.int64()),
                ("score", pa.float64()),
                ("meta", meta.type),
            ]
        )
        return pa.Table.from_batches(hits.batches(), empty)

    return score


class _Asked:
    """Some questions of one user with the best vectors they have met."""

    def __init__(self, ids: np.ndarray, queries: list[np.ndarray], k: int, meta: pa.DataType):
        self.ids, self.k = ids, k
        lengths = np.array([len(query) for query in queries])
        self.by_length = {}
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            matrix = np.stack([queries[i] for i in rows])
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            self.by_length[int(length)] = (rows, matrix, norms, _divide(matrix, norms[:, None]))
        # a score that k vectors reach already
        self.bar = np.full(len(ids), -np.inf)
        # question (its place), idx and score of the best so far, and their metadata
        self.best = (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))
        self.meta = pa.array([], meta)
        # the same of those met since; at most as many as can be best, and those of one more block
        self.new: list[tuple] = []
        self.new_rows = 0

    def meet(self, block: _Block, meta: pa.Array, wanted: np.ndarray | None = None) -> None:
        """Score the vectors of a block, for `wanted` questions only (their places, ascending) if given."""
        rows, cols = self._likely(block, np.arange(len(self.ids)) if wanted is None else wanted)
        if not len(rows):
            return
        scores = self._exact(block, rows, cols)
        good = scores >= self.bar[rows]
        rows, cols, scores = rows[good], cols[good], scores[good]
        self.new.append((rows, block.idx[cols], scores, meta.take(pa.array(cols))))
        self.new_rows += len(rows)
        if self.new_rows >= len(self.ids) * self.k:
            self._merge()

    def _merge(self) -> None:
        *new, metas = zip(*self.new)
        best = tuple(np.concatenate([old, *some]) for old, some in zip(self.best, new, strict=True))
        order = np.lexsort((best[1], -best[2], best[0]))
        question = best[0][order]
        rank = np.arange(len(order)) - np.searchsorted(question, question, "left")
        keep = order[rank < self.k]
        self.best = tuple(values[keep] for values in best)
        self.meta = pa.concat_arrays([self.meta, *metas]).take(pa.array(keep))
        self.new, self.new_rows = [], 0
        full = rank[rank < self.k] == self.k - 1
        some = self.best[0][full]
        self.bar[some] = np.maximum(self.bar[some], self.best[2][full])

    def _likely(self, block: _Block, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (question, row of the block) that include those among the k best."""
        count = len(block.idx)
        near = np.zeros((len(asking), count))
        place = np.full(len(self.ids), -1)
        place[asking] = np.arange(len(asking))
        for length, (rows, matrix, norms) in block.by_length.items():
            if length and length in self.by_length:
                same, _, _, units = self.by_length[length]
                if len(asking) < len(self.ids):
                    mine = place[same] >= 0
                    same, units = place[same[mine]], units[mine]
                scores = _divide(units @ matrix.T, norms)
                if len(same) == len(near) and len(rows) == count:
                    near = scores
                else:
                    near[np.ix_(same, rows)] = scores
        likely = near >= self.bar[asking, None] - _Block.MARGIN
        many = np.flatnonzero(likely.sum(axis=1) > self.k)
        if len(many):
            some = near[many]
            bars = np.partition(some, count - self.k, axis=1)[:, count - self.k]
            likely[many] &= some >= bars[:, None] - _Block.MARGIN
        asked, cols = np.nonzero(likely)
        return asking[asked], cols

    def _exact(self, block: _Block, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Cosine of pairs, by sums along the own row as in `_Block`; 0.0 for vectors of different lengths."""
        scores = np.zeros(len(rows))
        for length, (own, matrix, norms) in block.by_length.items():
            if length not in self.by_length:
                continue
            asking, queries, lengths, _ = self.by_length[length]
            place, at = np.full(len(self.ids), -1), np.full(len(block.idx), -1)
            place[asking], at[own] = np.arange(len(asking)), np.arange(len(own))
            known = np.flatnonzero((place[rows] >= 0) & (at[cols] >= 0))
            step = max(1, _PAIR_VALUES // max(1, length))
            for start in range(0, len(known), step):
                some = known[start : start + step]
                q, v = place[rows[some]], at[cols[some]]
                dots = (matrix[v] * queries[q]).sum(axis=1)
                scores[some] = _divide(dots, norms[v] * lengths[q])
        return scores

    def batch(self, user: str) -> pa.RecordBatch:
        if self.new:
            self._merge()
        question, idx, scores = self.best
        columns = [
            pa.array(self.ids[question], pa.int64()),
            pa.array([user] * len(idx), pa.string()),
            pa.array(idx, pa.int64()),
            pa.array(scores),
            self.meta,
        ]
        return pa.RecordBatch.from_arrays(columns, ["question_id", "user_id", "idx", "score", "meta"])


_CELL = ("user_id", "part", "share")


def _score_cells(k: int, vectors_per_block: int, questions_per_block: int, bounds=None):
    """Rows sorted by cell, in each the questions before the vectors, to the k best of every cell's questions.

    Held are the questions of one cell and a block of vectors; the vectors of a cell pass by. With `bounds`
    questions may start with a score that k vectors reach, and meet only blocks that may hold a better one.
    """
    cut_at = (*_CELL, "is_vector", *(bounds.blocks if bounds else ()))

    # With small blocks more questions are multiplied at once, and fewer with a large `k`.
    group_rows = max(questions_per_block, min(_PAIR_VALUES // vectors_per_block, _PAIR_VALUES // k) // 2)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """The batch cut where a cell, or in it the vectors, begin."""
        changes = np.zeros(batch.num_rows, bool)
        for name in cut_at:
            values = batch.column(name)
            changes[1:] |= pc.fill_null(pc.not_equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for start, end in zip(starts[:-1], starts[1:]):
            some = batch.slice(start, end - start)
            yield tuple(some.column(name)[0].as_py() for name in _CELL), some

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, groups = None, [], []

        def group(meta: pa.DataType) -> list[_Asked]:
            ids = np.concatenate([some.column("id").to_numpy() for some in waiting])
            queries = [_vector(value) for some in waiting for value in some.column("embedding")]
            starts = range(0, len(ids), group_rows)
            made = [_Asked(ids[at : at + group_rows], queries[at : at + group_rows], k, meta) for at in starts]
            if bounds:
                bars = np.concatenate([pc.fill_null(some.column("bar"), -np.inf).to_numpy() for some in waiting])
                for own, at in zip(made, starts, strict=True):
                    own.bar = bars[at : at + group_rows] - _Block.MARGIN
                    own.angles = bounds.angles(queries[at : at + group_rows])
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            for key, some in parts(batch):
                if key != cell:
                    yield from (own.batch(cell[0]) for own in groups)
                    cell, waiting, groups = key, [], []
                if not some.column("is_vector")[0].as_py():
                    waiting.append(some)
                    continue
                if waiting:
                    groups, waiting = group(_nullable(some.column("meta")).type), []
                for start in range(0, some.num_rows if groups else 0, vectors_per_block):
                    own = some.slice(start, vectors_per_block)
                    meta = _nullable(own.column("meta"))
                    block = _Block(own.column("id").to_numpy(), own.column("embedding"))
                    for asked in groups:
                        asked.meet(block, meta, bounds.wanted(own, asked.angles, asked.bar) if bounds else None)
        yield from (own.batch(cell[0]) for own in groups)

    return score


def _search_cells(
    vectors: DataFrame,
    questions: DataFrame,
    k: int,
    vectors_per_block: int,
    questions_per_block: int,
    bounds=None,
) -> DataFrame:
    """Candidates of many questions. With `bounds` vectors have its columns, which are no metadata, and questions `bar`."""
    plain = vectors.drop(*bounds.columns) if bounds else vectors
    schema = _candidate_schema(plain)
    spark = vectors.sparkSession
    cells = 4 * spark.sparkContext.defaultParallelism
    counts = vectors.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    asked = questions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_questions"))
    sizes = cut_lineage(counts.join(asked, "user_id"))
    pairs = sizes.agg(F.sum(F.col("n_vectors").cast("double") * F.col("n_questions"))).first()[0] or 0.0
    # A user has as many cells as their share of all pairs asks for. Questions are cut first: then each
    # has its candidates from one cell.
    own = F.ceil(F.col("n_vectors").cast("double") * F.col("n_questions") / F.lit(max(pairs / cells, LEAST_PAIRS)))
    parts = F.greatest(
        F.least(own, F.ceil(F.col("n_questions") / questions_per_block)), F.ceil(F.col("n_questions") / QUESTIONS_PER_CELL)
    )
    shares = F.greatest(F.ceil(own / F.col("parts")), F.ceil(F.col("n_vectors") / VECTORS_PER_CELL))
    sizes = sizes.withColumn("parts", parts).withColumn("shares", shares).select("user_id", "parts", "shares")
    # At most twice `cells` users and those with very many rows have more than one cell.
    cut = F.broadcast(sizes.where("parts > 1 OR shares > 1"))
    asking = sizes.select("user_id")
    asking = F.broadcast(asking) if is_small(asking, BROADCAST_BLOCKS) else asking
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def with_cells(rows: DataFrame) -> DataFrame:
        rows = rows.join(cut, "user_id", "left")
        return rows.withColumns({"parts": F.coalesce("parts", one), "shares": F.coalesce("shares", one)})

    def every(count: str) -> Column:
        return F.explode(F.sequence(zero, F.col(count) - 1))

    def one_of(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count))

    meta = _meta(plain)
    more = [*bounds.order, "bar"] if bounds else []
    kinds = {c: vectors.schema[c].dataType for c in more[:-1]}
    left = with_cells(
        vectors.join(asking, "user_id", "left_semi").select(
            "user_id", F.col("idx").cast("long").alias("id"), "embedding", meta, F.lit(True).alias("is_vector"),
            *kinds, *[F.lit(None).cast("double").alias(c) for c in more[-1:]],
        )
    )
    left = left.withColumn("share", one_of("id", "shares")).withColumn("part", every("parts"))
    # Own column instances, so that both sides may come from the same table.
    right = with_cells(
        questions.select(
            F.col("user_id").alias("user_id"),
            F.col("question_id").cast("long").alias("id"),
            F.col("embedding").alias("embedding"),
            F.lit(None).cast(vectors.select(meta).schema["meta"].dataType).alias("meta"),
            F.lit(False).alias("is_vector"),
            *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()],
            *more[-1:],
        )
    )
    right = right.withColumn("part", one_of("id", "parts")).withColumn("share", every("shares"))
    # cells of a user go to tasks of their own
    first = F.pmod(F.xxhash64("user_id"), F.lit(cells))
    number = F.pmod(first + F.col("part") * F.col("shares") + F.col("share"), F.lit(cells))
    return (
        left.unionByName(right)
        .withColumn("_cell", number.cast("int"))
        .repartitionById(cells, "_cell")
        .sortWithinPartitions(*_CELL, "is_vector", *kinds)
        .select(*_CELL, "is_vector", "id", "embedding", "meta", *more)
        .mapInArrow(_score_cells(k, vectors_per_block, questions_per_block, bounds), schema)
    )


def search_ranked(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = fixed.SEARCH_DEFAULT_K,
    broadcast_limit: int = BROADCAST_QUESTIONS,
    vectors_per_block: int = VECTORS_PER_BLOCK,
    questions_per_block: int = QUESTIONS_PER_BLOCK,
) -> DataFrame:
    """The k best vectors of each question's user: question_id, user_id, rank, idx, score, ...

    vectors: user_id, idx (unique per user, from 0, best without large gaps), embedding, and
    any further columns, which the result carries along; so hits need no join.
    questions: question_id (unique), user_id, embedding.
    The score is not rounded here: the order depends on it.
    """
    if is_small(questions.select("question_id"), broadcast_limit):
        candidates = _search_broadcast(vectors, questions, k)
    else:
        candidates = _search_cells(
            vectors, questions, k, vectors_per_block, questions_per_block
        )
    order = [F.desc("score"), F.asc("idx")]
    others = [f"meta.{c}" for c in vectors.columns if c not in _KEYS]
    return top_per_key(candidates, ["question_id"], order, k).select(
        "question_id", "user_id", "rank", "idx", "score", *others
    )


def search(
    vectors: DataFrame, questions: DataFrame, k: int = fixed.SEARCH_DEFAULT_K
) -> DataFrame:
    """Search hits with the score as it is reported, rounded to four digits."""
    return search_ranked(vectors, questions, k).withColumn("score", F.round("score", 4))
