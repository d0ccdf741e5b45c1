from __future__ import annotations

import random
import re

import numpy as np
import pytest

from watchlake.llm import licences, pieces, topk
from watchlake.llm.queries import MODEL


@pytest.mark.parametrize(("block", "group", "spread"), [(65_536, 512, 0.1), (60, 4, 0.1), (60, 4, 3.0)])
def test_top_products(spark, block, group, spread):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(400, 9)) * np.exp(rng.normal(size=(400, 1)) * spread)).astype(np.float32)
    vectors[100:180] = vectors[100]
    vectors[:, 3:] *= 0.2
    rows = [(i, v.tolist(), "s") for i, v in enumerate(vectors)]
    rows += [(500, None, "s"), (550, [1.0, None], "s"), (600, [1.0, float("nan")], "s"), (650, [float("inf")], "s")]
    rows += [(None, [9.0] * 9, "s"), (700, [], "s"), (750, [2.0, 1.0], "s"), (50, vectors[50].tolist(), "s"), (-50, [1.0] * 9, "s")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, uid string")
    kept = [
        (i, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64), (0, 9 - len(v))))
        for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    expected = []
    for a, (i, v) in enumerate(kept):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(kept) if b != a)[:5]
            expected += [(i, rank + 1, j, -score) for rank, (score, j) in enumerate(best)]
    found = topk.top_products(df, block=block, group=group).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_top_products_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (100, [1e30])], "vec_id bigint, embedding array<double>")
    found = topk.top_products(df.limit(2)).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 256 * 512)]
    assert topk.top_products(df.limit(0)).count() == 0
    assert topk.top_products(df).count() == 4


SCANNER = licences.Scanner(licences.TEMPLATES, licences.PHRASES)
WORDS = [licences.template_words(t) for _, t in licences.TEMPLATES] + [p.split() for p in licences.PHRASES]


def random_files(n):
    rng = random.Random(4)
    known = sorted({w for t in WORDS for w in t})
    for _ in range(n):
        file = []
        for _ in range(rng.randint(0, 12)):
            t = rng.choice(WORDS)
            a = rng.randrange(len(t))
            file += t[a : rng.randint(a, len(t))] + rng.choices([*known, "zz", "Ünï"], k=rng.randint(0, 3))
        yield file


def test_matching_statistics():
    runs = {tuple(t[i:j]) for t in WORDS for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    number = {w: i for i, w in enumerate(sorted({w for t in WORDS for w in t}))}
    for file in random_files(150):
        longest = []
        for i in range(len(file)):
            n = 0
            while n <= i and tuple(file[i - n : i + 1]) in runs:
                n += 1
            longest.append(n)
        stream = SCANNER.automaton.stream([number.get(w, -1) for w in file])
        assert [n for _, n in stream] == longest


def test_scan_licences(spark):
    files = [" ".join(f) for f in random_files(120)]
    mit, apache = licences.TEMPLATES[0][1], licences.TEMPLATES[4][1]
    files += [None, "", "   ", mit, "x " + mit.replace("without restriction", "without any restriction") + ". " + apache,
              "Licensed under CC BY-NC 4.0.", "under THE\nMIT-License under the mit license", "ünder the mit license",
              "of the and to " * 30_000 + apache, " ".join(mit.split()[:10])]
    rows = [(i, t, "l") for i, t in enumerate(files)] + [(0, files[0], "l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Licences string")
    found = licences.scan_licences(df)
    assert found.columns == ["doc_id", "licences"]
    by = {}
    for row in found.collect():
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in files[row[0]] or ""))
        places = [
            (label, i) for p, label in licences.PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()
        ]
        r = row["licences"]
        at = [i for _, i in places]
        base = ",".join(sorted({x for x, _ in places}))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(own), len(places), min(at, default=None), max(at, default=None), base,
        )
        assert set(base.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        by[row[0]] = r
    n = 120
    assert by[n]["labels"] == by[n + 1]["labels"] == by[n + 2]["labels"] == "" and by[n]["score"] == 0
    assert by[n + 3]["labels"] == "mit" and by[n + 3]["score"] == 1
    assert [(s["label"], s["first"]) for s in by[n + 3]["spans"]] == [("mit", 0)]
    assert by[n + 4]["labels"] == "apache-2,mit" and by[n + 4]["spans"][0]["cover"] > 0.9
    assert by[n + 5]["labels"] == "cc-by-nc" and by[n + 6]["n_base"] == 2 and by[n + 7]["n_base"] == 0
    assert by[n + 8]["labels"] == "apache-2" and by[n + 9]["labels"] == "" and by[n + 9]["score"] > 0
    assert len(found.collect()) == len(rows)
    assert licences.scan_licences(df.limit(0)).count() == 0


def odd_texts():
    rng = random.Random(1)
    names = pieces.Vocabulary.load(MODEL).pieces[259:]
    texts = ["Hello  world, Öung\n\tx 日本", "", "a", " ", "   ", "  a  b ", "a\0b", "\0", "a" * 5000, "日本語🙂🙂 x　y", " " * 40 + "x"]
    texts += ["".join(rng.choices("abcdeth  ▁ 🙂é\n0123=.()", k=rng.randint(0, 60))) for _ in range(500)]
    return texts + ["".join(rng.choices(names, k=rng.randint(1, 12))).replace("▁", " ") for _ in range(1500)]


def test_pieces_like_the_library(spark):
    import sentencepiece

    texts = odd_texts()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "e") for i, t in enumerate(texts)] + [(None, None, "e"), (3, texts[3], "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Encoding string")
    coded = pieces.encode(df, MODEL)
    assert coded.columns == ["doc_id", "text", "encoding"]
    found = coded.collect()
    assert len(found) == len(rows)
    for r in found:
        e = r["encoding"]
        if r["text"] is None:
            assert e["ids"] is None and e["n_tokens"] == 0 and e["round_trip"] is None
        else:
            assert e["ids"] == model.encode(r["text"]) and e["n_tokens"] == len(e["ids"])
            assert e["round_trip"] or "▁" in r["text"], r["text"]
    back = pieces.decode(coded.select("doc_id", "text", "encoding.ids"), MODEL)
    assert back.columns == ["doc_id", "ids", "text"]
    assert all(r["text"] == (None if r["ids"] is None else model.decode(r["ids"])) for r in back.collect())
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_best_scores_by_brute_force():
    names = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba", "bb", "▁ab"]
    rng = random.Random(8)
    scores = [0.0] + [-rng.random() * 5 for _ in names[1:]]
    coder = pieces.Coder(pieces.Vocabulary(names, scores, "x" + "n" * 9, 0, bpe=False))
    price = dict(zip(names, scores, strict=True))

    def best(text):
        value = {0: 0.0}
        for e in range(1, len(text) + 1):
            value[e] = max(
                value[s] + (price[text[s:e]] if text[s:e] in names[1:] else min(scores) - 10)
                for s in range(e)
                if text[s:e] in names[1:] or e == s + 1
            )
        return value[len(text)]

    for _ in range(200):
        text = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        ids = coder.encode([text])[0]
        total = sum(scores[i] if i else min(scores) - 10 for i in ids)
        assert abs(total - best("▁" + text)) < 1e-9


def test_vocabularies_are_not_mixed_up(spark, monkeypatch):
    """Two that differ only in early pieces, one after the other in the same workers."""
    tail = [f"q{i}" for i in range(60)]
    letters = ["<unk>", "▁", "a", "b", "q", *"0123456789", "ab", "▁a"]
    both = {
        "one": pieces.Vocabulary(letters + tail, [0.0] + [-float(i) for i in range(1, len(letters) + 60)], "x" + "n" * (len(letters) + 59), 0, False),
        "two": pieces.Vocabulary(letters + tail, [0.0] + [-float(i % 15) for i in range(1, 17)] + [-float(i) for i in range(17, len(letters) + 60)], "x" + "n" * (len(letters) + 59), 0, False),
    }
    monkeypatch.setattr(pieces.Vocabulary, "load", lambda path, bpe: both[path])
    df = spark.createDataFrame([(i, "ab aab b ab") for i in range(40)], "doc_id int, text string").repartition(8)
    for name in ("one", "two", "one"):
        expected = pieces.Coder(both[name]).encode(["ab aab b ab"])[0].tolist()
        found = {tuple(r["ids"]) for r in pieces.encode(df, name, bpe=False).select("encoding.ids").collect()}
        assert found == {tuple(expected)}
    assert len({tuple(pieces.Coder(v).encode(["ab aab b ab"])[0].tolist()) for v in both.values()}) == 2


def test_models_that_change_texts_are_refused():
    def message(*fields):
        out = b""
        for number, value in fields:
            if isinstance(value, bytes):
                out += bytes([number << 3 & 127 | 2 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([len(value)]) + value
            else:
                out += bytes([number << 3 & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
        return out

    plain = (3, message((3, 1), (4, 0), (5, 1)))
    pieces._check_plain(message((1, message((1, b"a"), (3, 1))), plain))
    for bad in (
        (plain, (1, message((1, b"a"), (3, 4)))),
        ((3, message((2, b"rules"), (3, 1), (4, 0))),),
        ((3, message((3, 0), (4, 0))),),
        ((3, message((3, 1))),),
        ((3, message((3, 1), (4, 0), (5, 0))),),
        (plain, (2, message((24, 1)))),
    ):
        with pytest.raises(ValueError):
            pieces._check_plain(message(*bad))
