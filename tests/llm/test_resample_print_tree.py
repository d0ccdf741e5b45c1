"""Resampling, fingerprints and Merkle trees against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from watchlake.llm import fingerprints, merkle, queries, resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# resampling ---------------------------------------------------------------------------------


def grams(text, n):
    words = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resampled(rows, target, n, buckets, percent, min_words, seed):
    def code(gram):
        return zlib.crc32(gram.encode()) % buckets

    raw = Counter(code(g) for _, text in rows for g in grams(text, n))
    goal = Counter(code(g) for text in target for g in grams(text, n))
    s, t = raw.total() + buckets, goal.total() + buckets
    found = []
    for key, text in rows:
        own = grams(text, n)
        gain = sum(math.floor(1000 * math.log((goal[code(g)] + 1) * s / ((raw[code(g)] + 1) * t))) for g in own)
        weight = gain // len(own) if own else 0
        h = int(sha(f"{seed}:{'' if key is None else key}")[:8], 16)
        found.append([key, len(grams(text, 1)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in found if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for rank, row in enumerate(fit, 1):
        row.append(rank if rank <= percent * len(fit) // 100 else None)
    return sorted((tuple(r + [None] * (6 - len(r))) for r in found), key=repr)


TEXTS = [
    None, "", "\n\n", "one", "Über die STRASSE ging\n\n\nein Mann.\nDer Hund bellt", "a b\nc\nd e f\n", "x-y_z 12\r\n12",
    "common line\n" * 40 + "a tail", "common line\nand another one", " ".join(f"w{i}" for i in range(30_000)), "the end\n" * 3,
]


@pytest.mark.parametrize("n, buckets", [(1, 10_000), (2, 500), (4, 97)])
def test_resampling(spark, n, buckets):
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, "no key here"), (None, None)] + [(100 + i, TEXTS[7]) for i in range(5)]
    df = spark.createDataFrame([(k, t, "x", i) for i, (k, t) in enumerate(rows)], "doc_id bigint, text string, resampling string, __row int")
    target = ["Der Mann ging\nnach Hause", None, "common line", ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(df.repartition(3), goal, n=n, buckets=buckets, percent=50, min_words=2, seed=7)
    assert found.columns == ["doc_id", "text", "__row", "resampling"]
    got = sorted(((r["doc_id"], *r["resampling"]) for r in found.drop("text").collect()), key=repr)
    assert got == resampled(rows, target, n, buckets, 50, 2, 7)
    if n == 1:
        assert resampling.resample(df.limit(0), goal).count() == 0
        none = resampling.resample(df, goal.limit(0), percent=0).collect()
        assert len(none) == len(rows) and not any(r["resampling"]["rank"] for r in none)


# fingerprints -------------------------------------------------------------------------------


def xx(value, seed):
    return xxhash.xxh64_intdigest(value, seed)


def signed(number):
    return number - (1 << 64) if number >> 63 else number


def samples(text, count, width=1):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))] if words else []
    terms = Counter(xx(run.encode(), 42) for run in runs)
    if not terms:
        return [-1] * count
    found = []
    for j in range(count):
        best = None
        for term, weight in terms.items():
            first = xx((j % 2**32).to_bytes(4, "little"), xx(term.to_bytes(8, "little"), 42))
            second = xx(first.to_bytes(8, "little"), 42)
            part = [((first & 0xFFFFFF) + 0.5) / 2**24, ((first >> 24 & 0xFFFFFF) + 0.5) / 2**24]
            r, b = -math.log(part[0] * part[1]), ((first >> 48) + 0.5) / 2**16
            c = -math.log((((second & 0xFFFFFFFF) + 0.5) / 2**32) * (((second >> 32) + 0.5) / 2**32))
            level = math.floor(math.log(weight) / r + b)
            value = math.log(c) - r * (level - b + 1)
            name = xx((level % 2**64).to_bytes(8, "little"), xx(first.to_bytes(8, "little"), 42)) & 0xFFFFFFFF
            best = min(best, (math.floor((value + 128) * 2**23), name)) if best else (math.floor((value + 128) * 2**23), name)
        found.append(best[1])
    return found


def test_hash_chain(spark):
    """Of several columns the hash of one seeds that of the next."""
    row = spark.range(1).select(F.xxhash64(F.lit(-5).cast("bigint"), F.lit(3)).alias("h"), F.xxhash64(F.lit("ä")).alias("s")).first()
    assert row["h"] == signed(xx((3).to_bytes(4, "little"), xx((-5 % 2**64).to_bytes(8, "little"), 42)))
    assert row["s"] == signed(xx("ä".encode(), 42))


@pytest.mark.parametrize("width", [1, 3])
def test_fingerprints(spark, width):
    texts = [None, "", " \n", "one", "One  one\tONE two", "a b c d e " * 20, "ü€😀 x y", " ".join(f"w{i % 700}" for i in range(3000))]
    rows = list(enumerate(texts)) + [(None, "one"), (None, None), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(*r, "q", i) for i, r in enumerate(rows)], "doc_id bigint, text string, fingerprint string, __row int")
    found = fingerprints.fingerprint(df.repartition(3), width=width, samples=8)
    assert found.columns == ["doc_id", "__row", "fingerprint"]
    found = {r["__row"]: r["fingerprint"] for r in found.collect()}
    assert len(found) == len(rows)
    for i, (_, text) in enumerate(rows):
        assert found[i]["samples"] == samples(text, 8, width), text
        assert found[i]["code"] == "".join(f"{x:08x}" for x in found[i]["samples"] if x >= 0)
    assert fingerprints.fingerprint(df.limit(0)).count() == 0


def test_collisions_tell_generalised_jaccard(spark):
    left, right = Counter(), Counter()
    for i in range(120):
        left[f"t{i}"], right[f"t{i + 30}"] = 1 + i % 7, 1 + (i * i) % 9
    true = sum((left & right).values()) / sum((left | right).values())
    rows = [(0, " ".join(left.elements())), (1, " ".join(right.elements()))]
    df = spark.createDataFrame(rows, "k int, text string")
    pair = fingerprints.fingerprint(df, samples=512).groupBy().pivot("k", [0, 1]).agg(F.first("fingerprint.samples"))
    near = pair.select(fingerprints.likeness(F.col("0"), F.col("1"))).first()[0]
    assert abs(near - true) < 4 * math.sqrt(true * (1 - true) / 512)


def test_edited_texts(spark, tmp_path):
    rows = [(5, "abcdefghi"), (9, None), (None, "x y z"), (7, "ÄÖÜäöü€😀x"), (7, "two sevens"), (1, ""), (2, "w " * 50)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_fingerprints(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    # of the two sevens any may come first
    for sevens in ((3, 4), (4, 3)):
        order = [rows[i] for i in (1, *sevens, 0, 6, 5, 2)]
        expected = []
        for i, (key, text) in enumerate(order):
            text, after = text or "", order[(i + 1) % len(order)][1] or ""
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            own, new, then = (samples(x, fingerprints.SAMPLES) for x in (text, edited, after))
            near = [sum(a == b for a, b in zip(own, x)) / len(own) for x in (new, then)]
            code = ["".join(f"{y:08x}" for y in x if y >= 0) for x in (own, new)]
            expected.append((key, len(text), sha(edited), *code, *near))
        if sorted(map(tuple, found), key=repr) == sorted(expected, key=repr):
            return
    pytest.fail("edited texts differ")


# Merkle trees -------------------------------------------------------------------------------


def tree_ways(digests):
    """The root, and for each digest its sibling lists and the places in them."""
    ways, nodes, members = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for place, i in enumerate(run):
                for leaf in members[i]:
                    ways[leaf].append((place, [nodes[k] for k in run]))
        members = [[leaf for i in run for leaf in members[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], ways


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def merkled(rows):
    """For (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, siblings' digest."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], sha("".join(map(field, row)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    own = [tree_ways([h for _, h in groups[name]]) for name in names]
    root, above = tree_ways([r for r, _ in own])
    found = []
    for name, (subroot, ways), over in zip(names, own, above, strict=True):
        for (key, leaf), way in zip(groups[name], ways, strict=True):
            siblings = "".join(h for place, run in way + over for i, h in enumerate(run) if i != place)
            found.append((key, leaf, subroot, root, sha(siblings)))
    return sorted(found, key=repr)


def _rows(sizes):
    key, rows = 0, []
    for lang, size in sizes.items():
        for i in range(size):
            rows.append((key, f"s{i % 3}" if i % 5 else None, lang, i if i % 7 else None, f"Text é {i}" if i % 11 else None))
            key += 3
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1}, {"a": 8}, {"a": 9}, {None: 1, "b": 1}, {"a": 1, "B": 700, None: 65, "é": 8, "": 3},
        {f"l{i}": 1 + i % 2 for i in range(75)},
    ],
)
def test_merkle(spark, sizes):
    rows = _rows(sizes)
    if len(rows) > 20:
        rows += [rows[5], rows[5], (None, *rows[7][1:]), (None, *rows[8][1:]), (3, "q", *rows[9][2:])]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, merkle int, __part string"
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], schema).repartition(5)
    found = merkle.manifest(df, keep=["doc_id", "__part"])
    assert found.columns == ["doc_id", "__part", "merkle"]
    found = found.select(
        "doc_id", "merkle.leaf", "merkle.subroot", "merkle.root", merkle.proof_digest(F.col("merkle.path")).alias("proof"),
        merkle.fold(F.col("merkle.leaf"), F.col("merkle.path")).alias("folded"),
        merkle.fold(F.sha2(F.lit("x").cast("binary"), 256), F.col("merkle.path")).alias("wrong"),
    ).collect()
    assert sorted((tuple(r[:5]) for r in found), key=repr) == merkled(rows)
    assert all(r["folded"] == r["root"] != r["wrong"] for r in found)


def test_merkle_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(df).count() == 0


def test_merkle_under_shared_ancestors(spark, monkeypatch):
    """Runs that many point to are met under several keys."""
    monkeypatch.setattr(merkle, "SHARED", 4)
    rows = _rows({"a": 600, "b": 2})
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    found = merkle.manifest(df, keep=["doc_id"]).select(
        "doc_id", "merkle.leaf", "merkle.subroot", "merkle.root", merkle.proof_digest(F.col("merkle.path"))
    )
    assert sorted(map(tuple, found.collect()), key=repr) == merkled(rows)
