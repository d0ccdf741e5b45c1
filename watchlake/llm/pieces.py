"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into units before each white space that follows other characters, which no piece
spans. The units of a batch that are not known yet are joined to one text with gaps, all its
suffixes are sorted, and each piece of the vocabulary is found in them by binary search: a range of
the suffix array is all its occurrences. The occurrences become edges, sorted by where they end, and
are relaxed from the left to the right over all units at once.

For a BPE model an edge is taken if its piece and the one before it are what merging makes of the
two together; exactly one edge into each place is, as each beginning of an encoding is the encoding
of a beginning. For a unigram model the edge with the best sum of scores is taken.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm.common import Masked, small_batches

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units of a generation that a worker remembers, and the longest that it does. When one is full,
#: it becomes the old one, from which units that are met again are taken over.
REMEMBERED, LONGEST = 400_000, 64


@dataclass
class Vocabulary:
    """Pieces with their scores; `kinds` has for each n (normal), b (byte), or x (never matched)."""

    pieces: list[str]
    scores: list[float]
    kinds: str
    unknown: int
    bpe: bool = True

    @classmethod
    def load(cls, path: str, bpe: bool = True) -> Vocabulary:
        """Read a model file on the driver; its size is that of the vocabulary.

        Models that change texts before they cut them, or have pieces set by their user, are refused.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _check_plain(model.serialized_model_proto())
        ids = range(model.get_piece_size())
        kinds = "".join(
            "b" if model.is_byte(i) else "x" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "n"
            for i in ids
        )
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds, model.unk_id(), bpe)


    @cached_property
    def name(self) -> str:
        """A digest of all of it; made on the driver, it goes with the vocabulary."""
        whole = (self.bpe, self.unknown, self.kinds, self.pieces, self.scores)
        return hashlib.sha256(repr(whole).encode("utf-8", "surrogatepass")).hexdigest()


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = number() if size is None else size
        yield tag >> 3, raw[at : at + size]
        at += size


#: Fixed numbers of the public model format: fields of the model, of a piece, of the normaliser, of the trainer.
_PIECE, _TRAINER, _NORMALIZER, _KIND, _USER_DEFINED = 1, 2, 3, 3, 4
_RULES, _DUMMY_PREFIX, _FEWER_BLANKS, _ESCAPED_BLANKS, _BLANK_BEHIND = 2, 3, 4, 5, 24


def _check_plain(model: bytes) -> None:
    """Raise for a model whose ids depend on more than its pieces and scores."""
    normal, behind, defined = {}, False, False
    for field, value in _fields(model):
        if field == _NORMALIZER:
            normal = dict(_fields(value))
        elif field == _TRAINER:
            behind = bool(dict(_fields(value)).get(_BLANK_BEHIND, 0))
        elif field == _PIECE:
            defined |= dict(_fields(value)).get(_KIND) == _USER_DEFINED
    refused = {
        "rules that change characters": bool(normal.get(_RULES)),
        "no blank put before a text": not normal.get(_DUMMY_PREFIX, 1),
        "blanks left out": bool(normal.get(_FEWER_BLANKS, 1)),
        "blanks not escaped": not normal.get(_ESCAPED_BLANKS, 1),
        "blanks as ends of pieces": behind,
        "pieces set by the user": defined,
    }
    if any(refused.values()):
        raise ValueError("not built for a model with " + ", ".join(name for name, found in refused.items() if found))


class Coder:
    """Encodes and decodes with one vocabulary; lives in a Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.n = len(vocabulary.pieces)
        self.normal = [i for i, kind in enumerate(vocabulary.kinds) if kind == "n" and vocabulary.pieces[i]]
        self.depth = max((len(vocabulary.pieces[i]) for i in self.normal), default=1)
        letters = sorted({c for i in self.normal for c in vocabulary.pieces[i]})
        self.letter = np.zeros(0x110000, ">u2")  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        names = [vocabulary.pieces[i] for i in self.normal]
        self.lengths = np.array([len(p) for p in names], np.int64)
        low = np.zeros((len(names), self.depth), ">u2")
        high = np.full((len(names), self.depth), 0xFFFF, ">u2")
        for k, name in enumerate(names):
            low[k, : len(name)] = high[k, : len(name)] = self.letter[[ord(c) for c in name]]
        self.low, self.high = self._keys(low), self._keys(high)
        self.ids = np.array(self.normal, np.int64)
        self.bytes = {
            int(vocabulary.pieces[i][3:5], 16): i for i, kind in enumerate(vocabulary.kinds) if kind == "b"
        }
        if vocabulary.bpe:
            self._learn_merges()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()  # units that decoding does not give back
        self.plain = [
            bytes([int(p[3:5], 16)]) if kind == "b" else p.replace(SPACE, " ").encode() if kind == "n" else b""
            for p, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
        ]
        self.plain[vocabulary.unknown] = " ⁇ ".encode()

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        """Rows of letters as byte strings, which sort as the letters do."""
        return np.ascontiguousarray(rows).view(f"S{2 * rows.shape[1]}").ravel()

    # merging --------------------------------------------------------------------------------

    def _learn_merges(self) -> None:
        """Which two pieces merge to which, in what order, and into what two each piece parts."""
        number = {self.v.pieces[i]: i for i in self.normal}
        turns = {score: turn for turn, score in enumerate(sorted(set(self.v.scores), reverse=True))}
        self.turn = np.full(self.n + 1, -1, np.int64)  # -1: a single character, made by no merge
        for i in self.normal:
            if len(self.v.pieces[i]) > 1:
                self.turn[i] = turns[self.v.scores[i]]
            elif self.v.pieces[i] not in number:
                raise ValueError("a character of a piece is no piece")
        left, right, whole = [], [], []
        for piece, i in number.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i)
        keys = np.array(left, np.int64) * self.n + np.array(right, np.int64)
        by_key = np.argsort(keys)
        self.merge_keys, self.merge_to = keys[by_key], np.array(whole, np.int64)[by_key]
        self.left = np.full(self.n + 1, -1, np.int64)
        self.right = np.full(self.n + 1, -1, np.int64)
        self.made = np.zeros(self.n + 1, bool)  # pieces that merging makes of their own characters
        for piece, i in sorted(number.items(), key=lambda x: len(x[0])):
            parts = self._merged(piece, number)
            self.made[i] = len(parts) == 1
            if len(piece) > 1 and self.made[i]:
                self.left[i], self.right[i] = self._last

    def _merged(self, text: str, number: dict[str, int]) -> list[str]:
        """Merge a text as the model does: best pair first, of equal ones the left one."""
        parts = list(text)
        self._last = (-1, -1)
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = number.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.turn[i] < best[0]):
                    best = (self.turn[i], k)
            if best is None:
                break
            k = best[1]
            self._last = (number.get(parts[k], -1), number.get(parts[k + 1], -1))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _turn_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """When x and y would merge; a large number if never."""
        never = np.full(len(x), np.iinfo(np.int64).max)
        if not len(self.merge_keys):
            return never
        keys = x * self.n + y
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == keys, self.turn[self.merge_to[at]], never)

    def fit_together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging the characters of x and y gives just x and y.

        Merging is looked at backwards: the piece made later is parted into the two it was made of;
        what lies at the border before must not have merged across it earlier than that.
        """
        good = self.made[x] & self.made[y]
        open_ = np.flatnonzero(good)
        x, y = x[open_].copy(), y[open_].copy()
        limit = np.full(len(x), np.iinfo(np.int64).max - 1)
        while len(open_):
            across = self._turn_of(x, y)
            crossed = across < limit
            good[open_[crossed]] = False
            stay = ~crossed & ((self.turn[x] >= 0) | (self.turn[y] >= 0))
            open_, x, y = open_[stay], x[stay], y[stay]
            tx, ty = self.turn[x], self.turn[y]
            part_left = tx > ty
            # of equal merges the left one comes first: one across beats one in the right piece
            limit = np.where(part_left, tx, ty + 1)
            x, y = np.where(part_left, self.right[x], x), np.where(part_left, y, self.left[y])
        return good

    # matching -------------------------------------------------------------------------------

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces in a text of code points (gaps: 0), as start, end, piece."""
        letters = np.zeros(len(text) + self.depth, ">u2")
        letters[: len(text)] = self.letter[text]
        suffixes = self._keys(np.lib.stride_tricks.sliding_window_view(letters, self.depth)[: len(text)])
        array = np.argsort(suffixes, kind="stable")
        ordered = suffixes[array]
        first = np.searchsorted(ordered, self.low, "left")
        counts = np.searchsorted(ordered, self.high, "right") - first
        which = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = array[first[which] + inside]
        return start, start + self.lengths[which], self.ids[which]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, which must not be empty, as 32-bit numbers."""
        text = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le"), np.uint32)
        sizes = np.array([len(u) for u in units])
        begin = np.cumsum(sizes + 1) - sizes - 1
        start, end, piece = self.edges(text)
        unit_of = np.repeat(np.arange(len(units)), sizes + 1)
        # characters that no piece has stand for themselves
        lone = np.flatnonzero(self.letter[text] == 0)
        lone = lone[lone < begin[unit_of[lone]] + sizes[unit_of[lone]]]
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), self.n)])
        step = end - begin[unit_of[start]]
        order = np.argsort(step.astype(np.uint16) if step.max() < 1 << 16 else step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        through = np.full(len(text) + 1, -1, np.int64)  # the piece on the path into each place
        source = np.full(len(text) + 1, -1, np.int64)
        value = np.full(len(text) + 1, -np.inf)
        value[begin] = 0
        bounds = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(step))
        scores = np.array([*self.v.scores, min(self.v.scores, default=0) - 10])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            if self.v.bpe:
                before = through[s]
                free = (p == self.n) | (before == self.n)
                first = s == begin[unit_of[s]]
                ok = np.where(p == self.n, True, self.made[p]) & (first | free)
                test = np.flatnonzero(~first & ~free & (before >= 0))
                ok[test] = self.fit_together(before[test], p[test])
                ok &= first | (before >= 0)
            else:
                total = value[s] + scores[p]
                best = np.lexsort((-s, total, e))
                ok = np.zeros(len(s), bool)
                ok[best[np.append(np.diff(e[best]) > 0, True)]] = True
                ok &= np.isfinite(total)
                value[e[ok]] = total[ok]
            through[e[ok]], source[e[ok]] = p[ok], s[ok]
        return self._paths(text, through, source, begin, begin + sizes)

    def _paths(self, text, through, source, begin, end) -> list[bytes]:
        """Follow all paths back from the ends of the units at once."""
        unit, at = np.arange(len(begin)), end
        units, places = [], []
        while len(unit):
            if (through[at] < 0).any():
                raise ValueError("a unit without a way through it")
            units.append(unit)
            places.append(at)
            at = source[at]
            more = at > begin[unit]
            unit, at = unit[more], at[more]
        place = np.sort(np.concatenate(places))  # units lie one behind the other
        piece = through[place]
        lone = np.flatnonzero(piece == self.n)
        if len(lone):
            # characters that no piece has, as their bytes
            parts = [
                [self.bytes[x] for x in chr(c).encode("utf-8", "surrogatepass")] if self.bytes else [self.v.unknown]
                for c in text[place[lone] - 1].tolist()
            ]
            times = np.ones(len(piece), np.int64)
            times[lone] = [len(p) for p in parts]
            place, piece = np.repeat(place, times), np.repeat(piece, times)
            piece[piece == self.n] = [x for p in parts for x in p]
        ids = piece.astype("<i4").tobytes()
        bounds = np.searchsorted(place, np.append(begin, len(text)), "right") * 4
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    # texts ----------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the same as the model's own; null gives none."""
        return [ids for ids, _ in self.code(texts)]

    def code(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool]]:
        """The ids of each text, and whether decoding them gives the text again.

        Decoding goes piece by piece, so a text comes back if each of its units does; units are decoded when they
        are encoded, and only texts with one that does not come back are decoded as a whole.
        """
        units = [
            _UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts
        ]
        # a gap's character is a unit of its own, so that it can't be taken for a gap
        for i, text in enumerate(texts):
            if text and "\0" in text:
                units[i] = [p for u in units[i] for p in re.split("(\0)", u) if p]
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
            self.odd &= self.old.keys()
        met = set().union(*units) - self.known.keys()
        for unit in met & self.old.keys():
            self.known[unit] = self.old[unit]
        new = sorted(met - self.known.keys() - {"\0"})
        local = {"\0": np.array([self.bytes[0]] if self.bytes else [self.v.unknown], np.int32).tobytes()}
        for first, last in _parts(new):
            for unit, ids in zip(new[first:last], self.encode_units(new[first:last]), strict=True):
                (self.known if len(unit) <= LONGEST else local)[unit] = ids
                if self._bytes_of(np.frombuffer(ids, np.int32)) != unit.replace(SPACE, " ").encode():
                    self.odd.add(unit)
        coded = []
        for text, own in zip(texts, units, strict=True):
            try:
                raw = b"".join(map(self.known.__getitem__, own))
            except KeyError:
                raw = b"".join([self.known.get(u) or local[u] for u in own])
            ids = np.frombuffer(raw, np.int32)
            if text is None:
                same = True
            elif SPACE in text or "\0" in text or not self.odd.isdisjoint(own):
                same = self.decode(ids) == text.encode()
            else:
                same = True
            coded.append((ids, same))
        return coded

    def _bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.plain.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text from its ids, without the blank put before it."""
        plain = self._bytes_of(ids)
        return plain[1:] if plain[:1] == b" " else plain


def _parts(units: list[str], chars: int = 1 << 20):
    """Runs of units of about so many characters."""
    first = size = 0
    for i, unit in enumerate(units):
        if i > first and size + len(unit) > chars:
            yield first, i
            first, size = i, 0
        size += len(unit)
    if len(units) > first:
        yield first, len(units)


_coders: dict[str, Coder] = {}


def _coder(shared) -> Coder:
    """The coder of this worker for a vocabulary, made once."""
    vocabulary = shared.value
    if vocabulary.name not in _coders:
        _coders.clear()
        _coders[vocabulary.name] = Coder(vocabulary)
    return _coders[vocabulary.name]


def _shared(spark: SparkSession, model: str, bpe: bool):
    """The vocabulary of a model file for all workers, with its name."""
    vocabulary = Vocabulary.load(model, bpe)
    assert vocabulary.name
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, bpe: bool = True) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and a struct `encoding` for each row.

    `model` is a SentencePiece file the driver can read. `encoding` has ids (as the model itself
    gives them), n_tokens, ids_sha256 over the ids as 32-bit little-endian numbers, and round_trip:
    whether decoding the ids gives the text again. A model with a normaliser, without the blank before a text, or
    with pieces set by its user is refused. That is so for all texts without U+2581, which
    stands for a blank in pieces and comes back as one.

    A null text has null ids, no tokens, and a null round_trip; an empty text has none. Rows stand
    each for itself. A column `encoding` is replaced.
    """
    small_batches(docs.sparkSession)
    table = Masked(docs, replaced=("encoding",))
    table.kept = [i for i in table.kept if keep is None or table.names[i] in keep]
    names = table.columns()
    shared = _shared(docs.sparkSession, model, bpe)
    kind = pa.struct(
        [("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())]
    )

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            texts = batch[-1].to_pylist()
            done = coder.code(texts)
            coded = [ids for ids, _ in done]
            facts = [hashlib.sha256(ids.tobytes()).hexdigest() for ids in coded]
            same = [None if t is None else good for t, (_, good) in zip(texts, done, strict=True)]
            sizes = np.array([len(ids) for ids in coded])
            missing = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                pa.array(np.concatenate([np.empty(0, np.int32), *coded])),
                mask=pa.array(missing),
            )
            encoding = pa.StructArray.from_arrays(
                [lists, pa.array(sizes), pa.array(facts), pa.array(same, pa.bool_())], fields=list(kind)
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch[i] for i in range(len(names))), encoding], [*names, "__encoding"]
            )

    plain = table.df.select(*names, F.col(table.at(text)).cast("string").alias("__text"))
    result = "struct<ids: array<int>, n_tokens: bigint, ids_sha256: string, round_trip: boolean>"
    coded = plain.mapInArrow(run, table.fields(f"__encoding {result}"))
    return table.back(coded, F.col("__encoding").alias("encoding"))


def decode(rows: DataFrame, model: str, ids: str = "ids", bpe: bool = True) -> DataFrame:
    """`rows` with `text` decoded from the column `ids`; null ids give null, bytes that are no UTF-8 U+FFFD."""
    small_batches(rows.sparkSession)
    table = Masked(rows, replaced=("text",))
    names = table.columns()
    shared = _shared(rows.sparkSession, model, bpe)

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            texts = [
                None if own is None else coder.decode(np.array(own, np.int64)).decode("utf-8", "replace")
                for own in batch[-1].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[i] for i in range(len(names))), pa.array(texts, pa.string())], [*names, "__text"]
            )

    plain = table.df.select(*names, F.col(table.at(ids)).alias("__ids"))
    return table.back(plain.mapInArrow(run, table.fields("__text string")), F.col("__text").alias("text"))
