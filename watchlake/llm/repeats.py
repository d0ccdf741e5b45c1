"""Removal of every passage that occurs twice, by a column-wise built index of many documents.

A passage of `length` bytes is found where it starts. Each such window holds a smallest gram, its
anchor, which depends on the window's bytes alone; successive windows with the same anchor are one
string, so equal windows lie in strings with equal anchors, at the same distance from them. Strings
whose anchor occurs once in all documents are dropped without having been moved.

The others are grouped by anchor, equal ones counted once, and laid out with the anchors below each
other. The index of a block of strings is built from the last column to the first: each round puts
one symbol before the suffix of every string, which moves the suffixes by a stable sort of that
column, the Burrows-Wheeler transform of the suffixes so far, and updates the common prefixes of
neighbours. A window is repeated if its suffix has `length` bytes in common with a neighbour, or if
its string was counted twice. Suffixes of earlier rounds needn't be kept: they start elsewhere
relative to the anchor and have no equal among the new ones. Spark's sorted shuffle files take the
place of the files a single machine would pass over.

A group of very many different strings is not given to one task: its strings are cut into shorter
ones, which agree in nearly all bytes of a window and are grouped by those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import Masked, small_batches, stored, text_digest
from watchlake.llm.tokens import BASE, mix, powers

#: Bytes of a gram; a window has length - GRAM + 1 of them.
GRAM = 32
#: Bytes of a document that are looked at together.
PIECE = 1 << 18
#: A group of more different strings than this is cut; a block has about as many.
GROUP = 2048
#: Windows in a string, as strings of large groups are cut.
CUTS = (16, 1)

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_INVERSE = pow(BASE, -1, 1 << 64)
_STRING = "key bigint, th bigint, weight bigint, members bigint, off int, n int, text binary"


def _grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (a power of two) from each place on."""
    h, step, factor = values, 1, BASE
    while step < size:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), step * 2
    return mix(h)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` successive numbers."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :])


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    sizes = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts] + sizes)


def strings(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts, in blocks: text, anchor hash, string hash, first window, anchor's place in it, windows.

    Long texts are looked at in pieces; a string that goes on behind a piece becomes two, which
    changes nothing.
    """
    pieces, size = [], 0
    for i, raw in enumerate(texts):
        for first in range(0, len(raw) - length + 1, PIECE):
            pieces.append((i, first, raw[first : first + PIECE + length - 1]))
            size += len(pieces[-1][2])
            if size >= PIECE:
                yield _block(pieces, length)
                pieces, size = [], 0
    if pieces:
        yield _block(pieces, length)


def _block(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    window = np.arange(len(piece)) + np.repeat(begins - (np.cumsum(windows) - windows), windows)
    h = _grams(_VALUES[data], GRAM)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 20) - 1)
    anchor = (_smallest((h & ~low) | place, length - GRAM + 1) & low).astype(np.int64)[window]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(first, append=len(anchor))
    at, start, of = anchor[first], window[first], piece[first]
    th = _hashes(data, start, start + counts + length - 1)
    doc, base = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    return doc[of], h[at].view(np.int64), th.view(np.int64), start - begins[of] + base[of], at - start, counts


def _raw(text) -> bytes:
    return b"" if text is None else text.encode() if isinstance(text, str) else text


def _anchor_counts(length: int):
    def run(batches):
        for batch in batches:
            texts = [_raw(text) for text in batch["text"].to_pylist()]
            keys = [key for _, key, *_ in strings(texts, length)]
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _all_strings(length: int):
    def run(batches):
        for batch in batches:
            found = list(strings([_raw(text) for text in batch["text"].to_pylist()], length))
            if not found:
                continue
            of, key, th, start, off, n = (np.concatenate(x) for x in zip(*found, strict=True))
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key),
                    pa.array(th),
                    batch["id"].take(of),
                    batch["dh"].take(of),
                    pa.array(start.astype(np.int64)),
                    pa.array(off.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["key", "th", "id", "dh", "start", "off", "n"],
            )

    return run


def block_repeats(
    texts: list[bytes], groups: np.ndarray, offs: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Index strings column by column: (string, window) of those equal to another's of its group.

    `offs` has the place of the anchor in each string, `groups` an ascending number for its group.
    """
    shift = length - GRAM - offs
    sizes = np.array([len(t) for t in texts])
    width = int((shift + sizes).max())
    table = np.zeros((width, len(texts)), np.int64)  # 0: no symbol here
    for i, text in enumerate(texts):
        table[shift[i] : shift[i] + sizes[i], i] = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    order = np.arange(len(texts))
    common = np.zeros(len(texts) + 1, np.int64)  # with the suffix before; the last is a guard
    found_string, found_window = [], []
    for c in range(width - 1, -1, -1):
        symbols = table[c][order]
        moved = np.argsort(groups[order] * 257 + symbols, kind="stable")
        symbols, order_now = symbols[moved], order[moved]
        same = np.zeros(len(moved), bool)
        same[1:] = (symbols[1:] == symbols[:-1]) & (symbols[1:] > 0)
        same[1:] &= groups[order_now[1:]] == groups[order_now[:-1]]
        fresh = np.zeros(len(moved) + 1, np.int64)
        at = np.flatnonzero(same)
        if len(at):
            # the smallest of what lay between the two before the symbol was put there
            bounds = np.empty(2 * len(at), np.int64)
            bounds[0::2], bounds[1::2] = moved[at - 1] + 1, moved[at] + 1
            fresh[at] = np.minimum.reduceat(common, bounds)[0::2] + 1
        order, common = order_now, fresh
        if c <= width - length:
            long = common[:-1] >= length
            long[:-1] |= long[1:]
            hits = order[long]
            found_string.append(hits)
            found_window.append(c - shift[hits])
    if not found_string:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_string), np.concatenate(found_window)


def _intervals(string: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successive windows of a string as (string, first, last)."""
    if not len(string):
        return string, window, window
    order = np.lexsort((window, string))
    string, window = string[order], window[order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (window[1:] > window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    return string[first], window[first], window[last]


def _indexed(length: int):
    """Whole groups, which come one after the other, are taken together until a block is full."""

    def solve(rows):
        keys = np.array([r[0] for r in rows])
        groups = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
        counts = np.array([r[4] for r in rows])
        string, window = block_repeats(
            [r[5] for r in rows], groups, np.array([r[3] for r in rows]), length
        )
        inside = window < counts[string] if len(string) else np.empty(0, bool)
        twice = np.flatnonzero(np.array([r[2] for r in rows]) > 1)
        string = np.concatenate([string[inside], np.repeat(twice, counts[twice])])
        ramp = np.concatenate([np.arange(counts[i]) for i in twice]) if len(twice) else np.empty(0, np.int64)
        string, low, high = _intervals(string, np.concatenate([window[inside], ramp]))
        th = np.array([r[1] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[string]), pa.array(th[string]), pa.array(low), pa.array(high)],
            ["key", "th", "low", "high"],
        )

    def run(batches):
        rows = []
        for batch in batches:
            for row in zip(*(batch[name].to_pylist() for name in ("key", "th", "weight", "off", "n", "text")), strict=True):
                if rows and rows[-1][:2] == row[:2]:
                    continue  # a repeated row
                if len(rows) >= GROUP and rows[-1][0] != row[0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def _cut(length: int, windows: int):
    """Strings cut where the anchor's place in the window passes a multiple of `windows`."""

    def run(batches):
        for batch in batches:
            out = []
            for key, th, weight, off, n, text in zip(
                *(batch[name].to_pylist() for name in ("key", "th", "weight", "off", "n", "text")), strict=True
            ):
                low = 0
                while low < n:
                    block = (off - low) // windows
                    high = min(n, off - block * windows + 1)
                    part = text[low : high - 1 + length]
                    # bytes that all windows of this block have, wherever the string begins
                    first = off - block * windows - low
                    shared = text[low + first : low + first - windows + 1 + length]
                    name = hashlib.blake2b(shared + block.to_bytes(4, "little") + key.to_bytes(8, "little", signed=True), digest_size=8)
                    own = hashlib.blake2b(part + (off - low).to_bytes(4, "little"), digest_size=8)
                    out.append(
                        (key, th, low, int.from_bytes(name.digest(), "little", signed=True),
                         int.from_bytes(own.digest(), "little", signed=True), weight, off - low, high - low, part)
                    )
                    low = high
            if out:
                names = ["key", "th", "at", "key2", "th2", "weight", "off", "n", "text"]
                kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names
                )

    return run


def repeated_windows(found: DataFrame, length: int, cuts=CUTS, group: int = GROUP) -> DataFrame:
    """For strings (key, th, weight, members, off, n, text): (key, th, low, high), repeated windows.

    `members` says how many different strings have the key.
    """
    result = "key bigint, th bigint, low bigint, high bigint"
    large = found.where(F.col("members") > group)
    whole = not cuts or large.isEmpty()
    small = found if whole else found.where(F.col("members") <= group)
    index = small.repartition("key").sortWithinPartitions("key", "th").mapInArrow(_indexed(length), result)
    if whole:
        return index
    # repeated rows have given their strings repeatedly
    parts = large.dropDuplicates(["key", "th"]).mapInArrow(
        _cut(length, cuts[0]),
        "key bigint, th bigint, at int, key2 bigint, th2 bigint, weight bigint, off int, n int, text binary",
    )
    parts = stored(parts, "parts")
    single = (
        parts.groupBy(F.col("key2").alias("key"), F.col("th2").alias("th"))
        .agg(F.sum("weight").alias("weight"), F.first("off").alias("off"), F.first("n").alias("n"), F.first("text").alias("text"))
    )
    single = stored(single, "cut")
    members = single.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("members"))
    single = stored(single.join(members, F.col("key") == F.col("of")).drop("of"), "groups")
    inner = repeated_windows(single, length, cuts[1:], group)
    inner = inner.select(F.col("key").alias("key2"), F.col("th").alias("th2"), "low", "high")
    back = parts.select("key", "th", "at", "key2", "th2").join(inner, ["key2", "th2"])
    return index.unionByName(back.select("key", "th", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")))


def _texts_of(length: int):
    def run(batches):
        for batch in batches:
            raw = [
                _raw(text)[start : start + n - 1 + length]
                for text, start, n in zip(batch["text"].to_pylist(), batch["start"].to_pylist(), batch["n"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch[name] for name in ("key", "th", "weight", "members", "off", "n")]
                + [pa.array(raw, pa.binary())],
                ["key", "th", "weight", "members", "off", "n", "text"],
            )

    return run


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """For rows (id, dh, text): (id, dh, spans), the spans of bytes to be removed, not yet merged."""
    if not 2 * GRAM <= length <= 1 << 15:
        raise ValueError("a passage must have from 64 to 32768 bytes")
    small_batches(rows.sparkSession)
    texts = rows.select("text")
    counts = texts.mapInArrow(_anchor_counts(length), "key bigint, n bigint")
    known = stored(counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "anchors")
    kind = f"`id` {rows.schema['id'].dataType.simpleString()}"
    places = rows.mapInArrow(
        _all_strings(length), f"key bigint, th bigint, {kind}, dh binary, start bigint, off int, n int"
    )
    places = stored(places.join(known, "key", "left_semi"), "places")
    distinct = stored(
        places.groupBy("key", "th").agg(
            F.count(F.lit(1)).alias("weight"), F.min(F.struct("id", "dh", "start", "off", "n")).alias("one")
        ),
        "strings",
    )
    sizes = distinct.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("members"))
    sized = distinct.join(sizes, F.col("key") == F.col("of"))
    wanted = sized.where("members > 1").select(
        "key", "th", "weight", "members", F.col("one.id").alias("one_id"), F.col("one.dh").alias("one_dh"), "one.start", "one.off", "one.n"
    )
    found = rows.join(
        wanted, rows["id"].eqNullSafe(wanted["one_id"]) & (rows["dh"] == wanted["one_dh"])
    ).select("key", "th", "weight", "members", "off", "n", "start", "text")
    found = stored(found.mapInArrow(_texts_of(length), _STRING), "found")
    partly = repeated_windows(found, length)
    alone = sized.where("members = 1 AND weight > 1")
    wholly = alone.select("key", "th", F.lit(0).cast("bigint").alias("low"), (F.col("one.n") - 1).cast("bigint").alias("high"))
    windows = partly.unionByName(wholly)
    spans = places.join(windows, ["key", "th"]).select(
        "id",
        "dh",
        F.struct((F.col("start") + F.col("low")).alias("a"), (F.col("start") + F.col("high") + length).alias("b")).alias("span"),
    )
    return spans.groupBy("id", "dh").agg(F.collect_set("span").alias("spans"))


def without(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal runs cut out."""
    left, at, cuts = [], 0, 0
    end = -1
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if a > end:
            left.append(raw[at:a])
            cuts += 1
        end = max(end, b)
        at = end
    left.append(raw[at:])
    return b"".join(left), cuts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """`docs` with `text` as it is after removal, and a struct `removal`.

    Each byte of a text in UTF-8 goes that is covered by `length` bytes that also start anywhere
    else, in any row, the same one included; all places are judged on the texts as they come, and
    all copies go. `removal` has n_bytes, n_removed, n_spans (maximal runs), kept_sha256 of the bytes
    left. Where these are no whole characters any more, their parts are left out of `text`.

    A null text is empty, has no bytes, and stays null. Texts shorter than `length` stay as they are.
    Repeated rows are copies of each other. Keys may be null or repeated: rows of one key are told apart by
    128 bits of their texts' SHA-256. A column `removal` is
    replaced.
    """
    table = Masked(docs, replaced=("removal",))
    names = table.columns()
    own_key, body = F.col(table.at(key)), F.col(table.at(text))
    rows = table.df.select(own_key.alias("id"), text_digest(body).alias("dh"), body.cast("string").alias("text"))
    spans = repeated_spans(rows, length).select(F.col("id").alias("__id"), F.col("dh").alias("__dh"), "spans")
    joined = (
        table.df.withColumn("__own", text_digest(body))
        .join(spans, own_key.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__dh")), "left")
        .select(*names, "spans")
    )
    place = names.index(table.at(text))

    def run(batches):
        for batch in batches:
            texts, facts = [], []
            for value, cut in zip(batch[place].to_pylist(), batch[-1].to_pylist(), strict=True):
                raw = _raw(value)
                left, n = without(raw, cut)
                texts.append(None if value is None else left.decode("utf-8", "ignore"))
                facts.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
            columns = [batch[i] for i in range(len(names))]
            columns[place] = pa.array(texts, pa.string())
            removal = pa.StructArray.from_arrays(
                [pa.array([f[i] for f in facts], pa.int64() if i < 3 else pa.string()) for i in range(4)],
                ["n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )
            yield pa.RecordBatch.from_arrays([*columns, removal], [*names, "__removal"])

    result = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>"
    done = joined.mapInArrow(run, table.fields(f"__removal {result}"))
    return table.back(done, F.col("__removal").alias("removal"))
