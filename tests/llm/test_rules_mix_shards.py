from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from watchlake.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


GOOD = "The first line of this text has quite some words.\nThe second one of it has some more."


def test_quality_rules(spark):
    texts = [
        None, "", " \n\t", GOOD, GOOD + "\n\nHome\nAbout us\nA | B | C | D\nWe use cookies to track you.",
        GOOD + "\nno end here but many words are in it", "a b c d e " * 30, "x y z w v u. " * 3, GOOD + "\r\n" + GOOD,
        "one| two| three|\n" * 5, "ü€😀 ### $$$ | <a> " * 4, " ".join(f"w{i}" for i in range(60_000)) + ".",
        "Heading here\n" + GOOD, "a b c d e f g h i a b c d e.",
    ]
    rows = [(i, t, "q", "body") for i, t in enumerate(texts)] + [(3, GOOD, "q", "body")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality string, __body string")
    found = quality.line_first(df)
    assert found.columns == ["doc_id", "text", "__body", "quality"]
    found = found.collect()
    assert len(found) == len(rows)
    for row in found:
        q = row["quality"]
        measures = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"])
        assert measures == base_measures(row["text"]), row["doc_id"]
        assert q["base_failed"] == (measures[0] < 10 or 100 * measures[4] > 20 * measures[0])
        assert not (q["kept"] and q["base_failed"])
    by = {r["doc_id"]: r["quality"] for r in found}
    assert by[3]["kept"] and by[3]["text"] == GOOD and by[3]["n_lines_removed"] == 0
    assert by[4]["text"] == GOOD + "\n" and by[4]["n_lines_removed"] == 4
    assert by[5]["text"] == GOOD
    assert not by[9]["kept"] and by[11]["kept"] and by[12]["text"].startswith("Heading here")
    assert quality.line_first(df.limit(0)).count() == 0
    assert quality.line_first(df).where("quality.kept").count() < len(rows)


def test_targets(spark):
    def targets(sizes, weights=(5, 2, 1), most=3):
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: weights[i % 3] for i, s in enumerate(names)}
        left, target, open_ = float(sum(sizes.values())), {}, set(names)
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            full = {s for s in open_ if share[s] > most * sizes[s]}
            if not full:
                return target | share
            for s in full:
                target[s] = float(most * sizes[s])
                left -= target[s]
            open_ -= full
        return target

    for sizes in (
        {"a": 10, "b": 1000, "c": 500, None: 7}, {"b": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 100, "Z": 3, "é": 0},
    ):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        expected = targets(sizes)
        assert found.keys() == expected.keys()
        assert all(math.isclose(found[s], expected[s], abs_tol=1e-9) for s in found), (found, expected)


@pytest.mark.parametrize("part", [200_000, 40])
def test_systematic_mix(spark, part):
    rows = []
    for i in range(1500):
        source = [None, "a", "a", "a", "b", "c"][i % 6]
        rows.append((i, "w " * (i % 37 + 1) if i % 50 else None, source, "m", 1))
    rows += [(7, "w w w", "a", "m", 1)] * 3 + [(None, "w", "z", "m", 1), (9, "x " * 50_000, "b", "m", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix string, __copy int")
    found = mixing.systematic_mix(df, part=part)
    assert found.columns == ["doc_id", "text", "source", "__copy", "mix"]
    found = found.collect()
    assert len(found) == len(rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in found:
        m = r["mix"]
        assert m["size"] == len((r["text"] or "").split()) and 0 <= m["copies"] <= 3
        taken[r["source"]] += m["copies"] * m["size"]
        target[r["source"]] = m["target"]
        largest[r["source"]] = max(largest[r["source"]], m["size"])
    for s in target:
        # the last rows have little company in their size class
        assert abs(taken[s] - target[s]) <= 1 * largest[s] + 0.02 * target[s] + 40, s
    again = {(r["doc_id"], r["text"], r["source"]): r["mix"]["copies"] for r in mixing.systematic_mix(df.repartition(3), part=part).collect()}
    once = {(r["doc_id"], r["text"], r["source"]): r["mix"]["copies"] for r in found if r["doc_id"] != 7}
    assert all(again[k] == n for k, n in once.items())
    out = mixing.mixed(df, part=part)
    assert out.columns == ["doc_id", "text", "source", "__copy"]
    assert out.count() == sum(r["mix"]["copies"] for r in found)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_lookup_table():
    shards = [f"s{i}" for i in range(13)]
    table = sharding.lookup_table(shards, 251)

    # brute force: write out each permutation, then claim in turns
    lists = []
    for name in shards:
        start, step = sharding._number(f"offset:{name}") % 251, sharding._number(f"step:{name}") % 250 + 1
        order = [(start + step * j) % 251 for j in range(251)]
        assert sorted(order) == list(range(251))
        lists.append(order)
    taken: dict[int, int] = {}
    while len(taken) < 251:
        for i, order in enumerate(lists):
            free = next((s for s in order if s not in taken), None)
            if free is not None:
                taken[free] = i
    assert [taken[s] for s in range(251)] == table.tolist()
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 251)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 12)
    assert moved < 251 / 4
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 251)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 250)


def test_place(spark, tmp_path):
    rows = [(i % 90, "x", "s", i) for i in range(200)] + [(None, "y" * 100_000, None, 1)] * 2
    df = spark.createDataFrame(rows, "id bigint, Shard string, `own.slot` string, __slot int")
    placed = sharding.place(df, "id", ["p", "q", "r"], 251)
    assert placed.columns == ["id", "own.slot", "__slot", "slot", "shard"]
    found = placed.collect()
    assert len(found) == 202 and len({(r["id"], r["shard"]) for r in found}) == 91
    table = sharding.lookup_table(["p", "q", "r"], 251)
    assert all(r["shard"] == "pqr"[table[r["slot"]]] for r in found)
    assert sharding.place(df.limit(0), "id", ["p"], 251).count() == 0
    sharding.write_shards(df, "id", ["p", "q", "r"], str(tmp_path / "out"), 251)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("shard") == "q").count() == sum(
        r["shard"] == "q" for r in found
    )
