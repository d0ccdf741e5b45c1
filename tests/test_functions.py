from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchlake.functions import fixed, text, timestamps, vectors

S = "を視聴しました"


def test_video_title(one_row):
    cases = [
        ("A " + S, "A"),
        ("A　" + S, "A"),
        ("  A " + S, "A"),
        (S, S),
        (" " + S, ""),
        ("foo", "foo"),
        (" untouched ", " untouched "),
        ("l1\nl2 " + S, "l2"),
        ("A\rB " + S, "A\rB"),
        ("A B " + S, "A B"),
        ("x " + S + " y " + S, "x"),
        ("\x1cA\x1f" + S, "A"),
        (None, ""),
        ("", ""),
    ]
    found = one_row([c[0] for c in cases], text.video_title(F.col("value")))
    assert found == [c[1] for c in cases]


def test_video_id(one_row):
    cases = [
        ("https://x/watch?v=abcdefghijk", "abcdefghijk"),
        ("https://x/watch?t=5&v=abcdefghijkXYZ", "abcdefghijk"),
        ("https://youtu.be/abcdefghijk", "abcdefghijk"),
        ("https://youtu.be/aaaaaaaaaaa?v=abcdefghijk", "abcdefghijk"),
        ("https://x/watch?v=short", ""),
        (None, ""),
        ("", ""),
    ]
    assert one_row([c[0] for c in cases], text.video_id(F.col("value"))) == [c[1] for c in cases]


def test_channel_id(one_row):
    cases = [
        ("https://x/channel/UC_a-1", "UC_a-1"),
        ("https://x/channel/UC1/videos", "UC1"),
        ("https://x/@handle", ""),
        ("https://x/c/name", ""),
        (None, ""),
    ]
    assert one_row([c[0] for c in cases], text.channel_id(F.col("value"))) == [c[1] for c in cases]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2025-12-27T10:26:59.596Z", datetime(2025, 12, 27, 10, 26, 59, 596000)),
        ("2025-12-27T10:26:59.596123Z", datetime(2025, 12, 27, 10, 26, 59, 596123)),
        ("2025-12-27T10:26:59+09:00", datetime(2025, 12, 27, 1, 26, 59)),
        ("2025-12-27T10:26:59-05:30", datetime(2025, 12, 27, 15, 56, 59)),
        ("2025-12-27T10:26:59-23:59", datetime(2025, 12, 28, 10, 25, 59)),
        ("2025-12-27T10:26:59+09:00:30", datetime(2025, 12, 27, 1, 26, 29)),
        ("2025-12-27", datetime(2025, 12, 27)),
        ("2025-12-27T10:26", datetime(2025, 12, 27, 10, 26)),
        ("2025-12-27T10", datetime(2025, 12, 27, 10)),
        ("2025-12-27 10:26", datetime(2025, 12, 27, 10, 26)),
        ("2025-12-27日10:26", datetime(2025, 12, 27, 10, 26)),
        ("2024-02-29", datetime(2024, 2, 29)),
        ("2025-02-29", None),
        ("2025-12-27T10:26:59+24:00", None),
        ("2025-12-27T", None),
        ("2025-12-27T24:00", None),
        ("2025-12-27T10:60", None),
        ("2025-12-27T10:26:60", None),
        ("2025-12-27T10:26:59.5Z", None),
        # Any single character separates, so this is nine o'clock.
        ("2025-12-27+09:00", datetime(2025, 12, 27, 9, 0)),
        ("2025-12-27Z", datetime(2025, 12, 27)),
        ("0000-01-01", None),
        ("", None),
        ("bad", None),
        (None, None),
        ("2025", None),
        ("2025-12", None),
        ("10:00", None),
        ("2025-1-2T3:4:5Z", None),
        ("2025-13-27T00:00:00Z", None),
        (" 2025-12-27T10:26:59Z", None),
        ("2025-12-27T10:26:59Z ", None),
        ("2025-12-27T10:26:59Z\n", None),
        ("２０２５-12-27", None),
    ],
)
def test_parse_iso(one_row, value, expected):
    assert one_row([value], timestamps.parse_iso(F.col("value"))) == [expected]


def test_timestamp_text(one_row):
    values = [datetime(2025, 12, 27, 10, 26, 59, 596000), datetime(2025, 1, 2), None]
    found = one_row(values, timestamps.timestamp_text(F.col("value")), "value timestamp")
    assert found == ["2025-12-27 10:26:59.596000+00:00", "2025-01-02 00:00:00+00:00", None]


def test_blank_and_truncate(one_row):
    values = [None, "", " \t　\n", "a", "\x1c"]
    assert one_row(values, text.is_blank(F.col("value"))) == [True, True, True, False, True]
    long = "動😀" * 5000
    assert one_row([long], text.truncate_text(F.col("value"))) == [long[:8000]]


def test_embedding_text_prints_null(one_row):
    assert one_row([None], text.embedding_text(F.lit("t"), F.col("value"))) == ["t - None"]


def test_keys(one_row):
    value = F.col("value")
    assert one_row(["u"], text.raw_key(value, F.lit("a.json"))) == ["raw/u/a.json"]
    assert one_row(["u"], text.processed_key(value)) == ["processed/u/data.parquet"]
    assert one_row(["u"], text.vectors_key(value)) == ["vectors/u/embeddings.json"]


def test_fill_template(one_row):
    template = "{a} と {b}{a}!"
    found = one_row(["x"], text.fill_template(template, a=F.col("value"), b=F.lit(3)))
    assert found == ["x と 3x!"]


@pytest.mark.parametrize(
    "left, right, expected",
    [
        ([1.0, 2.0], [1.0, 2.0], 1.0),
        ([1.0, 2.0], [-1.0, -2.0], -1.0),
        ([1.0, 0.0], [0.0, 1.0], 0.0),
        ([1.0, 2.0], [1.0, 2.0, 3.0], 0.0),
        ([0.0, 0.0], [1.0, 2.0], 0.0),
        ([3.0, 4.0], [4.0, 3.0], 0.96),
    ],
)
def test_cosine(one_row, left, right, expected):
    other = F.array(*[F.lit(x).cast("float") for x in right])
    found = one_row([left], vectors.cosine_similarity(F.col("value"), other), "value array<float>")
    assert round(found[0], 4) == expected


def test_hash_embedding_is_a_unit_vector(one_row):
    values = ["Spark 入門 - Channel 1", "spark 入門 - channel 1", "料理レシピ", "!!!", ""]
    found = one_row(values, vectors.hash_embedding(F.col("value"), 64))
    assert all(len(vector) == 64 for vector in found)
    norms = [math.sqrt(sum(x * x for x in vector)) for vector in found]
    assert norms == pytest.approx([1, 1, 1, 0, 0], abs=1e-6)
    assert found[0] == found[1]
    assert fixed.EMBEDDING_DIM == 1024


def test_hash_embedding_against_plain_python(one_row):
    import hashlib
    import re

    def plain(value: str, dim: int) -> list[float]:
        words = [w for w in re.split(r"[\W_]+", value.lower()) if w]
        tokens = set(words)
        for word in words:
            if len(word) > 2:
                tokens.update(word[i : i + 2] for i in range(len(word) - 1))
        codes = {int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % (2 * dim) for t in tokens}
        kept = [c for c in codes if c ^ 1 not in codes]
        vector = [0.0] * dim
        for code in kept:
            vector[code // 2] = (1.0 if code % 2 else -1.0) / math.sqrt(len(kept))
        return vector

    values = ["alpha beta gamma", "a", "プログラミング学習に関する動画", "x" * 50 + " y z"]
    found = one_row(values, vectors.hash_embedding(F.col("value"), 16))
    for value, vector in zip(values, found):
        assert vector == pytest.approx(plain(value, 16), abs=1e-6)
