"""The pipeline against plain Python over the smallest documents, stage by stage and as a whole."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from watchlake.llm import quality
from watchlake.llm.queries import MODEL

from .test_dedup import cut_by_brute_force, groups_by_brute_force
from .test_rules_mix_shards import base_measures

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def python_regex(pattern):
    return re.compile(pattern.replace(r"|(?i)", "|").replace(r"\z", r"\Z"), re.IGNORECASE if "(?i)" in pattern else 0)


def cleaned(text):
    """The text without failing lines, or None if the document is rejected."""
    end, menu = python_regex(quality.END_PUNCTUATION), python_regex(quality.NAVIGATION)
    phrases = python_regex(quality.BOILERPLATE)

    def fails(line):
        return (
            (not end.search(line) and len(WORD.findall(line)) > 4)
            or menu.search(line)
            or phrases.search(line)
            or sum(c in quality.SYMBOLS for c in line) > 0.2 * len(line)
        )

    n, chars, _, _, repeats = base_measures(text)
    left = "\n".join(x for x in (text or "").split("\n") if not WORD.search(x) or not fails(x))
    lost = chars - sum(map(len, WORD.findall(left)))
    return None if n < 10 or 100 * repeats > 20 * n or lost > 0.5 * chars else left


def mixed(rows):
    """(doc_id, text, source) as often as systematic sampling takes them."""

    def uniform(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52

    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, target, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    out = []
    for source in sizes:
        own = [r for r in rows if r[2] == source]

        def place(row):
            size = bin(len(WORD.findall(row[1])))[2:]
            return len(size) * 16 + int(size[:4], 2), hashlib.md5(f"42:{row[0]}".encode()).hexdigest()

        expected, offset = target[source] / sizes[source], uniform(f"42:{source}")
        for k, row in enumerate(sorted(own, key=place), 1):
            out += [row] * (math.floor(k * expected + offset) - math.floor((k - 1) * expected + offset))
    return out


@pytest.fixture(scope="module")
def by_hand():
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{FOLDER}/documents.parquet'").fetchall()
    stages = [rows := [(d, t, s) for d, text, s in rows if (t := cleaned(text)) is not None]]
    groups = groups_by_brute_force([r[:2] for r in rows], 5)
    stages.append(rows := [r for r, g in zip(rows, groups, strict=True) if g[3]])
    raw = [t.encode() for _, t, _ in rows]
    cut = cut_by_brute_force([t for _, t, _ in rows], 200)
    assert len(raw) == len(cut)
    stages.append((rows, cut))
    return stages


def test_stages(spark, by_hand):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for position, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        if position < 4:
            assert docs.columns == names
            found = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if position < 2:
            assert sorted(found) == sorted(by_hand[position])
        elif position == 2:
            rows, cut = by_hand[2]
            kept = {r[0]: c for r, c in zip(rows, cut, strict=True)}
            assert {d for d, _, _ in found} == set(kept)
            for d, text, _ in found:
                # parts of characters are left out of the text
                assert 0 <= kept[d][0] - kept[d][1] - len(text.encode()) <= 6 * (kept[d][2] + 1)
                assert kept[d][1] or hashlib.sha256(text.encode()).hexdigest() == kept[d][3]
            before = found
        elif position == 3:
            assert sorted(found) == sorted(mixed(before))
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
            tokens = Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect())
            assert tokens == Counter((d, tuple(model.encode(t))) for d, t, _ in found)
            assert docs.where("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.count() == docs.count() and whole.columns == docs.columns
