"""Encoding into pieces of a unigram model by Viterbi over a double-array trie, and decoding.

A model file gives pieces with log scores; the path with the largest sum of scores wins, among equal paths the
one whose last piece starts earliest. A character that no piece covers falls back to byte pieces. White space
is marked: every blank becomes the marker, and one is put before the text; decoding takes both back.

No piece of a usual model has a marker after another character. Then every best path is made of the best paths
of the units between, a run of markers with what follows up to the next one, so each unit is solved once and
remembered; new units are solved together, in step, by array operations. A model with other pieces is treated
as one unit per text.

Defined results: a null text counts as the empty one, which has no pieces; repeated rows are encoded one by
one; the marker character itself decodes as a blank, as in any such model; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Units up to this many bytes are solved in step, this many at a time; remembered units; characters taken at a time.
STEP_BYTES, STEP_UNITS, MEMORY, TAKE_CHARS = 48, 20_000, 400_000, 4_000_000
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type by id of a model file's bytes."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: _NORMAL} | dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
    return out


class DoubleArray:
    """A trie of byte strings: the child of `state` by `byte` is base[state] + byte, if check there names the state."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key, value in keys.items():
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        size = 1 << 18
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        # single children fill the first hole; larger groups are looked for from a place that moves on as cells fill
        todo, free, ahead = [(0, root)], 257, 257
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            children = sorted(b for b in node if b >= 0)
            if not children:
                continue
            while check[free] != -1:
                free += 1
            at = begin = free if len(children) == 1 else max(free, ahead)
            while True:
                if at + 512 > len(check):
                    for array, fill in ((base, 0), (check, -1), (value, -1)):
                        array.extend([fill] * size)
                if all(check[at - children[0] + b] == -1 for b in children):
                    break
                at += 1
            if len(children) > 1 and at - begin > 50:
                ahead = at
            base[state] = at - children[0]
            for byte in children:
                check[base[state] + byte] = state
                todo.append((base[state] + byte, node[byte]))
        # a missing child leads to a cell that names another state; the end is padded for that
        self.base, self.check, self.value = (np.array(x + [f] * 256, np.int32) for x, f in ((base, 0), (check, -1), (value, -1)))


@dataclass
class Pieces:
    """A model ready for use: trie, score of each id, bytes of each id, ids of the byte pieces."""

    trie: DoubleArray
    scores: np.ndarray
    bytes_of: list[bytes]
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    separable: bool

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]]) -> Pieces:
        normal = [s for _, s, kind in pieces if kind == _NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        keys, scores, bytes_of, byte_ids, unknown = {}, np.zeros(len(pieces)), [], np.full(256, -1), 0
        for i, (text, score, kind) in enumerate(pieces):
            bytes_of.append(text.replace(MARK, " ").encode() if kind in (_NORMAL, _USER) else b"")
            scores[i] = len(text.encode()) * high - 0.1 if kind == _USER else score
            if kind in (_NORMAL, _USER):
                keys[text.replace(MARK, " ").encode()] = i
            elif kind == _BYTE:
                byte_ids[int(text[3:5], 16)] = i
                bytes_of[-1] = bytes([int(text[3:5], 16)])
            elif kind == _UNKNOWN:
                unknown = i
        separable = not any(re.search(r"[^ ] ", b.decode()) for b in keys)
        return cls(DoubleArray(keys), scores, bytes_of, byte_ids, unknown, low - UNKNOWN_PENALTY, separable)

    def _fallback(self, char: bytes) -> list[int]:
        ids = self.byte_ids[list(char)].tolist()
        return ids if min(ids) >= 0 else [self.unknown]

    def solve_one(self, unit: bytes) -> list[int]:
        """The best path of one unit of any length, position by position."""
        base, check, value, scores = self._lists
        n = len(unit)
        best, start, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            width = 1 if unit[at] < 0xC0 else 2 if unit[at] < 0xE0 else 3 if unit[at] < 0xF0 else 4
            state, end, single = 0, at, False
            while end < n:
                child = base[state] + unit[end]
                if check[child] != state:
                    break
                state, end = child, end + 1
                if value[state] >= 0:
                    single |= end - at == width
                    score = best[at] + scores[value[state]]
                    if score > best[end]:
                        best[end], start[end], piece[end] = score, at, value[state]
            end = min(at + width, n)
            if not single and best[at] + self.unknown_score > best[end]:
                best[end], start[end], piece[end] = best[at] + self.unknown_score, at, -1
            at += width
        path, end = [], n
        while end:
            path.append(self._fallback(unit[start[end] : end]) if piece[end] < 0 else [piece[end]])
            end = start[end]
        return [i for ids in reversed(path) for i in ids]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cells"}

    @property
    def _lists(self):
        if "_cells" not in self.__dict__:
            self._cells = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores)]
        return self._cells

    def solve(self, units: list[bytes]) -> list[list[int]]:
        """The best path of each unit; short ones in step."""
        out: list = [None] * len(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        for i in np.flatnonzero(lengths > STEP_BYTES).tolist():
            out[i] = self.solve_one(units[i])
        short = np.flatnonzero(lengths <= STEP_BYTES)
        short = short[np.argsort(lengths[short], kind="stable")]
        for low in range(0, len(short), STEP_UNITS):
            which = short[low : low + STEP_UNITS]
            for i, path in zip(which.tolist(), self._in_step([units[i] for i in which.tolist()], lengths[which]), strict=True):
                out[i] = path
        return out

    def _in_step(self, units: list[bytes], lengths: np.ndarray):
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        m, longest = len(units), int(lengths.max(initial=0))
        cells = np.zeros((longest + 1, m), np.uint8)  # by position, then unit
        for_all = np.frombuffer(b"".join(u.ljust(longest, b"\0") for u in units), np.uint8).reshape(m, longest) if longest else cells[:0].T
        cells[:longest] = for_all.T
        best = np.full((longest + 5, m), -np.inf)
        start, piece = np.zeros((longest + 5, m), np.int16), np.full((longest + 5, m), -1, np.int32)
        best[0] = 0.0
        for at in range(longest):
            rows = np.flatnonzero((best[at] > -np.inf) & (lengths > at))
            if not len(rows):
                continue
            lead = cells[at, rows]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(m, bool)
            every, widths, state, end = rows, width, np.zeros(len(rows), np.int32), at
            while len(rows) and end < longest:
                child = base[state] + cells[end, rows]
                found = (check[child] == state) & (lengths[rows] > end)
                rows, state, widths, end = rows[found], child[found], widths[found], end + 1
                ids = value[state]
                ends = ids >= 0
                r, ids = rows[ends], ids[ends]
                single[r[widths[ends] == end - at]] = True
                score = best[at, r] + self.scores[ids]
                better = score > best[end, r]
                r = r[better]
                best[end, r], start[end, r], piece[end, r] = score[better], at, ids[better]
            alone = ~single[every]
            r, to = every[alone], at + width[alone]
            score = best[at, r] + self.unknown_score
            better = score > best[to, r]
            r, to = r[better], to[better]
            best[to, r], start[to, r], piece[to, r] = score[better], at, -1
        starts, pieces = start.T.tolist(), piece.T.tolist()
        for unit, n, s, p in zip(units, lengths.tolist(), starts, pieces, strict=True):
            path = []
            while n:
                if p[n] >= 0:
                    path.append(p[n])
                else:
                    path += self._fallback(unit[s[n] : n])[::-1]
                n = s[n]
            yield path[::-1]


def load(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        return Pieces.of(read_pieces(f.read()))


_UNIT = re.compile(r" +[^ ]*")


def _units(text: str, separable: bool) -> list[str]:
    """The units of a nonempty text, without the first blank of each."""
    text = text.replace(MARK, " ")
    if not separable:
        return [text]
    if "  " in text or text[0] == " ":
        return [u[1:] for u in _UNIT.findall(" " + text)]
    return text.split(" ")


class Encoder:
    """Encodes texts in bulk; remembers the paths of units."""

    def __init__(self, model: Pieces):
        self.model = model
        self.forget()

    def forget(self):
        self.codes: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each."""
        if len(self.codes) > MEMORY:
            self.forget()
        units: list[str] = []
        ends = np.empty(len(batch), np.int64)
        for i, text in enumerate(batch):
            if text:
                units += _units(text, self.model.separable)
            ends[i] = len(units)
        new = list(set(units).difference(self.codes))
        if new:
            new.sort()
            paths = self.model.solve([b" " + u.encode("utf-8", "surrogatepass") for u in new])
            counts = np.fromiter(map(len, paths), np.int64, len(paths))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
            self.counts = np.append(self.counts, counts)
            self.flat = np.append(self.flat, np.fromiter((i for p in paths for i in p), np.int32, int(counts.sum())))
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        codes = np.fromiter(map(self.codes.__getitem__, units), np.int64, len(units))
        counts = self.counts[codes]
        total = np.append(0, np.cumsum(counts))
        ids = self.flat[np.repeat(self.starts[codes] - total[:-1], counts) + np.arange(total[-1])]
        return ids, np.diff(total[np.append(0, ends)])


def decode_ids(model: Pieces, ids: list[int]) -> str:
    """The text of a sequence of ids: byte pieces are joined before they are read as UTF-8."""
    text = b"".join(map(model.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode(docs: DataFrame, model: Pieces) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            doc_ids, all_texts, low, size = batch.column("doc_id"), batch.column("text").to_pylist(), 0, 0
            for high, text in enumerate(all_texts, 1):
                size += len(text)
                if size >= TAKE_CHARS or high == len(all_texts):
                    ids, counts = encoder.encode(all_texts[low:high])
                    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(low, high - low), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                        names=["doc_id", "n_tokens", "ids"],
                    )
                    low, size = high, 0

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, model: Pieces) -> DataFrame:
    """doc_id, n_tokens, ids, text of rows with ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            out = [None if row is None else decode_ids(shared.value, row) for row in (ids[i].as_py() for i in range(len(ids)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")


def contract(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to."""
    model = load(path)
    return decode(encode(docs, model), model).select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))
