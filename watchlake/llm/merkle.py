"""A Merkle tree over the rows of a dataset, one per group, with a tree over the groups' roots above.

Leaves are numbered in their group by ranges of the key, and every eight consecutive nodes are a run whose
digest is a node of the next level. All eight of a run have the same ancestors, so runs are the nodes
that proofs are made of: each holds the digests of its members, which are the siblings of one another,
and points to the run that its own digest is a member of, and to the place there.

Proofs are made by pointer jumping: a run holds a segment, the members of itself and of the runs up to where it
points. A self-join of the runs on that pointer puts the segment found there behind its own and takes
over the pointer from there, so the distance doubles, and after log2 of the height every run has reached
the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import Masked, numbered, stored

FANOUT = 8
#: The tree over the groups' roots; those of groups are numbered from 0.
TOP = -1
#: A run that more runs than this may point to is met under several keys.
SHARED = 512
_PATH = "array<struct<place:bigint,members:array<binary>,top:boolean>>"


def sha256_hex(parts: Column) -> Column:
    """The digest of a string, in lower-case hex."""
    return F.sha2(parts.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields: `-` for null, else the number of UTF-8 bytes, a colon, and the value."""

    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        )

    return sha256_hex(F.concat(*(one(field) for field in fields)))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, _hex), "")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the way to the root, level by level, left to right."""
    level = F.transform(
        path, lambda step: F.transform(F.filter(step["members"], lambda m, i: i != step["place"]), _hex)
    )
    return sha256_hex(F.array_join(F.flatten(level), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf, in hex, and its path lead to."""
    return F.aggregate(
        path,
        leaf,
        lambda node, step: sha256_hex(
            F.array_join(
                F.transform(step["members"], lambda m, i: F.when(i == step["place"], node).otherwise(_hex(m))), ""
            )
        ),
    )


def _grow(nodes: DataFrame, largest: int) -> tuple[DataFrame | None, DataFrame]:
    """All runs above the nodes (tree, idx, n, digest, height), and the last node of each tree."""
    runs, roots, level = None, None, 0
    while True:
        done = nodes.where("n = 1").select("tree", "digest", "height")
        roots = done if roots is None else roots.unionByName(done)
        if largest <= 1:
            return runs, roots
        member = F.struct((F.col("idx") % FANOUT).alias("place"), "digest")
        grouped = (
            nodes.where("n > 1")
            .groupBy("tree", F.expr(f"idx div {FANOUT}").alias("run"))
            .agg(
                F.sort_array(F.collect_list(member)).alias("found"),
                F.first("n").alias("n"),
                (F.max("height") + 1).alias("height"),
            )
            .select(
                "tree", F.lit(level).alias("level"), "run", "n", "height",
                F.transform("found", lambda m: m["digest"]).alias("members"),
            )
        )
        grouped = stored(grouped, "runs")
        runs = grouped if runs is None else runs.unionByName(grouped)
        nodes = grouped.select(
            "tree",
            F.col("run").alias("idx"),
            F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
            F.unhex(sha256_hex(_joined(F.col("members")))).alias("digest"),
            "height",
        )
        largest = -(-largest // FANOUT)
        level += 1


def _jumped(runs: DataFrame) -> DataFrame:
    """Runs (tree, level, run, path): the path has all members from the run itself up to the root."""
    step = F.struct(F.lit(None).cast("bigint").alias("place"), "members", (F.col("tree") == TOP).alias("top"))
    state = stored(
        runs.select("tree", "level", "run", "height", F.array(step).cast(_PATH).alias("path"), "up", "place"), "jump"
    )
    facts = state.agg(F.max("height"), F.count(F.lit(1))).first()
    height, every = facts[0] or 0, facts[1]
    distance = 1
    while distance <= height:
        # at most FANOUT ** distance runs point to one; only those at that height are pointed to
        salts = max(1, min(FANOUT ** min(distance, 30), every) // SHARED)
        pointing = state.where("up IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("tree", "level", "run"), F.lit(salts)))
        targets = state.where(F.col("height") >= distance).select(
            F.struct("tree", "level", "run").alias("at"),
            F.col("path").alias("further"),
            F.col("up").alias("next"),
            F.col("place").alias("next_place"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salted"),
        )
        here = F.get("further", F.lit(0))
        first = F.struct(F.col("place").alias("place"), here["members"].alias("members"), here["top"].alias("top"))
        rest = F.slice("further", 2, F.greatest(F.size("further") - 1, F.lit(0)))
        met = pointing.join(targets, (F.col("up") == F.col("at")) & (F.col("salt") == F.col("salted"))).select(
            "tree", "level", "run", "height",
            F.concat("path", F.array(first), rest).cast(_PATH).alias("path"),
            F.col("next").alias("up"), F.col("next_place").alias("place"),
        )
        state = stored(met.unionByName(state.where("up IS NULL")), "jump")
        distance *= 2
    return state.select("tree", "level", "run", "path")


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "lang",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of `docs`: the columns `keep` (all by default) and a struct `merkle`.

    `merkle` has leaf (the digest of the `fields`), subroot, root, and path: for each run up to the root the
    place in it, the digests of its members, and whether it belongs to the tree over the groups. `proof_digest` and
    `fold` read a path.

    Leaves ascend by key in each group, null first; of equal keys by leaf. Groups ascend, null first, and
    a null group is a group like others. Rows that are equal in all fields have equal leaves, each with a place
    of its own. An empty or null text is a field like others. Without rows there is no row. A column `merkle` is replaced.
    """
    table = Masked(docs, replaced=("merkle",))
    table.kept = [i for i in table.kept if keep is None or table.names[i] in keep]
    names = table.columns()
    leaf = F.unhex(leaf_digest(*(F.col(table.at(field)) for field in fields))).alias("__leaf")
    leaves = table.df.select(*names, F.col(table.at(group)).alias("__group"), F.col(table.at(key)).alias("__key"), leaf)
    order = [F.asc_nulls_first("__group"), F.asc_nulls_first("__key"), F.asc("__leaf")]
    placed = numbered(leaves, order, "__number", part="__part")
    # a group has one row per range of the order it is in
    shares = placed.groupBy(F.col("__group").alias("group"), F.col("__part").alias("part")).agg(
        F.min("__number").alias("low"), F.count(F.lit(1)).alias("n")
    )
    shares = stored(shares, "shares")
    groups = numbered(shares.groupBy("group").agg(F.min("low").alias("start"), F.sum("n").alias("n")), [F.col("start")], "tree")
    groups = stored(groups.select(F.col("group").alias("of"), "start", "n", "tree"), "groups")
    many, largest = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    known = shares.select("group", "part").join(groups, F.col("group").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.join(
        known, F.col("__group").eqNullSafe(F.col("group")) & (F.col("__part") == F.col("part"))
    ).select(*names, "__leaf", "tree", "n", (F.col("__number") - F.col("start")).alias("idx"))
    placed = stored(placed, "leaves")

    nodes = placed.select("tree", "idx", "n", F.col("__leaf").alias("digest"), F.lit(-1).alias("height"))
    runs, roots = _grow(nodes, largest or 0)
    tops, tip = _grow(
        roots.select(
            F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(many).alias("n"), "digest", "height"
        ),
        many,
    )
    tip = tip.first()
    root = tip["digest"].hex() if tip else None
    up_to = F.struct(F.col("tree"), (F.col("level") + 1).alias("level"), F.expr(f"run div {FANOUT}").alias("run"))
    over = F.struct(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.expr(f"tree div {FANOUT}").alias("run")
    )
    in_tree = F.col("n") > FANOUT  # the run's digest is not yet the last node
    above = (F.col("tree") != TOP) & F.lit(many > 1)

    def pointed(found: DataFrame) -> DataFrame:
        return found.select(
            "*",
            F.when(in_tree, up_to).when(above, over).alias("up"),
            F.when(in_tree, F.col("run") % FANOUT).when(above, F.col("tree") % FANOUT).alias("place"),
        )

    every = [found for found in (runs, tops) if found is not None]
    leaf_run = F.struct("tree", F.lit(0).alias("level"), F.expr(f"idx div {FANOUT}").alias("run"))
    own = placed.select(
        *names, "__leaf",
        F.when(F.col("n") > 1, leaf_run).when(F.lit(many > 1), over).alias("at"),
        F.when(F.col("n") > 1, F.col("idx") % FANOUT).when(F.lit(many > 1), F.col("tree") % FANOUT).alias("place"),
    )
    empty = F.array().cast(_PATH)
    if every:
        all_runs = every[0] if len(every) == 1 else every[0].unionByName(every[1])
        paths = _jumped(pointed(all_runs)).where("level = 0")
        paths = paths.select(F.struct("tree", "level", "run").alias("met"), "path")
        first = F.get("path", F.lit(0))
        first = F.struct(F.col("place"), first["members"].alias("members"), first["top"].alias("top"))
        path = F.concat(F.array(first), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))).cast(_PATH)
        found = own.join(paths, F.col("at") == F.col("met")).select(*names, "__leaf", path.alias("path"))
    else:  # one leaf, or none, is all there is
        found = own.select(*names, "__leaf", empty.alias("path"))
    leaf_hex = _hex(F.col("__leaf"))
    subroot = fold(leaf_hex, F.filter("path", lambda step: ~step["top"]))
    return table.back(
        found,
        F.struct(leaf_hex.alias("leaf"), subroot.alias("subroot"), F.lit(root).cast("string").alias("root"), F.col("path")).alias("merkle"),
    )
