from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from watchlake.llm import neardup, repeats


def groups_by_brute_force(rows, shingle, percent=80):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in text or "").encode().split()
        n = min(shingle, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    members: dict[int, list] = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    smallest = {r: min((k for k in own if k is not None), default=None) for r, own in members.items()}
    return [(rows[i][0], len(sets[i]), smallest[find(i)], rows[i][0] == smallest[find(i)]) for i in range(len(rows))]


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 9)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) + 100, " ".join(own)))
    # a chain: neighbours are near, its ends are not
    words = rng.choices(vocabulary, k=120)
    for i in range(25):
        rows.append((len(rows) + 100, " ".join(words)))
        words[i * 4 : i * 4 + 2] = ["new", f"n{i}"]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "ünï ÜNÏ"), (8, "ÜNÏ ünï")]
    rows += [(9, "Some TEXT, that is there twice"), (9, "some text, that\tis there twice"), (None, "some text, that is there twice")]
    rows += [(None, "null keys only here"), (None, "null keys only here"), (10, " ".join(f"x{i}" for i in range(30_000)))]
    rows += [(11, " ".join(f"x{i}" for i in range(29_000))), (0, rows[0][1])]
    return rows


@pytest.mark.parametrize("shingle", [4])
def test_near_duplicates(spark, shingle):
    rows = near_rows()
    df = spark.createDataFrame([(k, t, "x", b"c") for k, t in rows], "doc_id bigint, text string, size string, class binary")
    found = neardup.near_duplicates(df, shingle=shingle)
    expected = groups_by_brute_force(rows, shingle)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()]
    # a key that is null never equals the smallest, but is kept where there is none
    expected = [(k, n, c, c is None if k is None else kept) for k, n, c, kept in expected]
    assert Counter(got) == Counter(expected)


def test_keep_one(spark):
    rows = near_rows()
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, k int, __class int")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = groups_by_brute_force(rows, 5)
    wanted = {(c, ) for (_, n, c, _) in expected if n}
    assert Counter(k for k, t in kept if (t or "").split()) == Counter(c for (c,) in wanted)
    assert sum(not (t or "").split() for _, t in kept) == 3
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_min_max_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    (low, high), (low2, high2) = neardup.min_max(np.unique(a)), neardup.min_max(np.unique(b))
    share = ((low == low2).mean() + (high == high2).mean()) / 2
    assert abs(share - 800 / 1200) < 0.15


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    links += [(500, 501), (500, 502), (1000, 500)]
    links = [(a, b) for a, b in links if a != b]
    found = neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    root = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {r["node"]: r["root"] for r in found} == root and len(found) == len(root)


def cut_by_brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(gone, prepend=0) == 1).sum())
        out.append((len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(7)

    def prose(n):
        return "".join(rng.choices("abcdé 漢", k=n))

    passage, line = prose(120), prose(70)
    texts = [None, "", "short", "short", prose(500), "a" * 900, "ab" * 300, "x" * 63, "x" * 64, "x" * 65]
    texts += [prose(rng.randint(0, 300)) + passage[rng.randint(0, 9) :] + prose(rng.randint(0, 300)) for _ in range(60)]
    texts += [prose(rng.randint(0, 50)) + line + line + prose(20) for _ in range(10)]
    texts += [texts[4], texts[4][:200], texts[12], prose(300_000) + passage, texts[12]]
    return texts


@pytest.mark.parametrize("length", [64, 100])
def test_blocks_of_strings(length):
    texts = [(t or "").encode()[:20_000] for t in repeat_texts()]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    strings = []
    for of, key, th, start, off, n in repeats.strings(texts, length):
        strings += list(zip(key.tolist(), of.tolist(), start.tolist(), off.tolist(), n.tolist(), strict=True))
    assert sum(s[4] for s in strings) == sum(max(len(b) - length + 1, 0) for b in texts)
    strings.sort()
    cut = [texts[of][start : start + n - 1 + length] for _, of, start, _, n in strings]
    groups = np.unique([s[0] for s in strings], return_inverse=True)[1]
    string, window = repeats.block_repeats(cut, groups, np.array([s[3] for s in strings]), length)
    found = {(strings[s][1], strings[s][2] + w) for s, w in zip(string, window, strict=True) if w < strings[s][4]}
    expected = {(d, i) for d, b in enumerate(texts) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1}
    assert found == expected


def test_remove_repeats(spark, monkeypatch):
    texts = repeat_texts()
    rows = [(i if i % 7 else None, t, "r", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, removal string, id int")
    expected = Counter(zip([r[3] for r in rows], cut_by_brute_force(texts, 64), strict=True))

    def found():
        out = repeats.remove_repeats(df, length=64)
        assert out.columns == ["doc_id", "text", "id", "removal"]
        rows = out.collect()
        assert all((r["text"] is None) == (texts[r["id"]] is None) for r in rows)
        return Counter((r["id"], tuple(r["removal"])) for r in rows)

    assert found() == expected
    # groups of many different strings are cut twice
    monkeypatch.setattr(repeats, "repeated_windows", lambda s, n, cuts=(8, 1), group=3, f=repeats.repeated_windows: f(s, n, cuts, group))
    assert found() == expected
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, length=63)


def test_null_keys_do_not_meet_each_other(spark, monkeypatch):
    """A class's text is found by key and digest: as many rows as classes, whatever the keys are."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(150)]
    texts += [t + " more" for t in texts] + texts[:50]
    for keys in (lambda i: None, lambda i: i % 2):
        sets, asked = neardup._sets, []

        def counted(plain, classes, wanted, shingle, sets=sets):
            found = sets(plain, classes, wanted, shingle)
            asked.append((wanted.count(), found.count()))
            return found

        monkeypatch.setattr(neardup, "_sets", counted)
        df = spark.createDataFrame([(keys(i), t) for i, t in enumerate(texts)], "doc_id bigint, text string")
        found = neardup.near_duplicates(df).collect()
        monkeypatch.setattr(neardup, "_sets", sets)
        assert len(found) == len(texts) and len({r["component"] for r in found}) == 150
        assert asked[0] == (300, 300) and all(n == m for n, m in asked)
        assert neardup.keep_one(df).count() == 150


def test_texts_of_equal_hash_are_told_apart(spark):
    """Two texts with the same 32-bit hash, the same key, and one of them standing elsewhere too."""
    made = spark.range(400_000).select(F.repeat(F.sha2(F.col("id").cast("string").cast("binary"), 256), 4).alias("text"))
    pairs = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts"), F.count(F.lit(1)).alias("n"))
    first, second = pairs.where("n > 1").first()["texts"][:2]
    rng = random.Random(2)
    elsewhere = "".join(rng.choices("ghijkl", k=300))
    for key in (None, 2):
        rows = [(key, first), (1, first), (key, second), (key, elsewhere)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        cut = repeats.remove_repeats(df, length=256).collect()
        removed = {(r["doc_id"], r["removal"]["n_bytes"]): r["removal"]["n_removed"] for r in cut if r["removal"]["n_bytes"] == 300}
        assert removed == {(key, 300): 0}
        assert sorted(r["removal"]["n_removed"] for r in cut) == [0, 0, 256, 256]
