"""SentencePiece encoding that remembers which source bytes every piece came from, and decoding.

Normalisation follows the model's own compiled character map: at each position the longest prefix that the
map's double-array trie holds is replaced, any other character stands for itself, and each
normalised byte records the source byte it stems from. Piece lengths then give each piece's span in the
normalised text, and the record projects it to the source bytes. Ids are the library's: the model is run on
white-space delimited parts and each worker remembers the ids of parts it has met. That is exact when no piece of the
vocabulary has a space mark behind another character, which is checked; else whole texts are encoded.

Defined results: null is the empty text, which encodes to the begin and end ids alone; very long texts are
encoded whole; nothing depends on other rows, so repeated rows get equal results and there are no ties; an empty table gives no rows; input
columns named ids, spans or decoded give way to the operator's.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import per_text
from ._shared import make_room

MARK = "▁"
#: Bytes of parts that a worker remembers at most; beyond that it starts afresh.
MOST_PARTS = 16 << 20


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a double-array trie of source strings over a table of replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.strings = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest entry that ``data`` holds at ``at``."""
        if not self.units:
            return None
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, best = jump(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        start = best[1]
        return best[0], self.strings[start : self.strings.index(b"\0", start)]


@lru_cache(8)
def character_map(blob: bytes) -> CharacterMap:
    """The map of a model, unpacked once in each worker."""
    return CharacterMap(blob)


@dataclass(frozen=True)
class Model:
    """What the codec needs of a SentencePiece model file."""

    proto: bytes
    pieces: tuple[str, ...]
    kinds: tuple[int, ...]
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @staticmethod
    def parse(proto: bytes) -> Model:
        pieces, kinds, norm = [], [], {}
        for field, value in wire_fields(proto):
            if field == 1:
                p = dict(wire_fields(value))
                pieces.append(p[1].decode())
                kinds.append(p.get(3, 1))
            elif field == 3:
                norm |= dict(wire_fields(value))  # a repeated message adds to the first
        return Model(proto, tuple(pieces), tuple(kinds), norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))

    @property
    def separable(self) -> bool:
        """No piece reaches over the start of a run of space marks, and no piece is matched before the others."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces) and 4 not in self.kinds and self.dummy_prefix and self.escape


def normalise(source: bytes, model: Model) -> tuple[bytes, np.ndarray]:
    """(normalised text, for each of its bytes and its end the source byte it stems from)."""
    mark = MARK.encode()
    if not model.charsmap and not model.squeeze and model.escape:
        body = np.frombuffer(source, np.uint8)
        wide = np.where(body == 32, 3, 1)
        lead = len(mark) if model.dummy_prefix and source else 0
        origin = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(body)), wide), [len(body)]])
        return mark * bool(lead) + source.replace(b" ", mark), origin
    chars, out, origin, at = character_map(model.charsmap), bytearray(), [], 0
    chunks: list[tuple[bytes, int]] = []
    while at < len(source):
        hit = chars.longest(source, at)
        if hit is None:
            b = source[at]
            n = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
            hit = n, source[at : at + n]
        chunks.append((hit[1], at))
        at += hit[0]
    if model.squeeze:
        while chunks and chunks[0][0] == b" ":
            chunks.pop(0)
    space = mark if model.escape else b" "
    if model.dummy_prefix and chunks:
        out += space
        origin += [chunks[0][1]] * len(space)
    blank = model.squeeze  # the last that was written is a space
    for piece, start in chunks:
        if blank and model.squeeze:
            piece = piece.lstrip(b" ")
        if not piece:
            continue
        for b in piece:
            got = space if b == 32 else bytes([b])
            out += got
            origin += [start] * len(got)
        blank = piece.endswith(b" ")
    while model.squeeze and out.endswith(space) and out:
        del out[-len(space) :]
        at = origin[-len(space)]
        del origin[-len(space) :]
    return bytes(out), np.array([*origin, at], np.int64)


class Codec:
    """A model loaded in a worker."""

    def __init__(self, model: Model):
        import sentencepiece

        self.model = model
        self.run = sentencepiece.SentencePieceProcessor(model_proto=model.proto)
        self.ends = np.array([self.run.bos_id()], "<u4").tobytes(), np.array([self.run.eos_id()], "<u4").tobytes()
        # bytes of the normalised text that a piece stands for
        self.widths = np.array([1 if k == 6 else 0 if k == 3 else len(p.encode()) for p, k in zip(model.pieces, model.kinds, strict=True)], np.int64)
        self.by_parts = model.separable and not model.charsmap and not model.squeeze
        self.parts: dict[str, bytes] = {}
        self.held = 0
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def ids(self, source: str) -> bytes:
        """Little-endian unsigned 32-bit ids, begin and end included."""
        if not self.by_parts:
            return np.array(self.run.encode(source, add_bos=True, add_eos=True), "<u4").tobytes()
        found = self.cut(MARK + source.replace(" ", MARK)) if source else []
        known = self.parts
        if new := [p for p in set(found) if p not in known]:
            if self.held > MOST_PARTS:
                known.clear()
                self.held, new = 0, list(set(found))
            self.held += sum(map(len, new))
            known[MARK] = np.array([self.run.piece_to_id(MARK)], "<u4").tobytes()  # a last single space
            new = [p for p in new if p != MARK]
            # the model puts a space mark of its own before each part
            for p, ids in zip(new, self.run.encode([p[1:] for p in new], num_threads=1), strict=True):
                known[p] = np.array(ids, "<u4").tobytes()
        return b"".join([self.ends[0], *[known[p] for p in found], self.ends[1]])

    def spans(self, source: bytes, ids: bytes) -> bytes:
        """Little-endian 32-bit (begin, end) source bytes of each id."""
        normal, origin = normalise(source, self.model)
        at = np.concatenate([[0], np.cumsum(self.widths[np.frombuffer(ids, "<u4")])])
        if at[-1] != len(normal):  # an unknown piece stands for any number of bytes: ask the library
            got = self.run.encode(source.decode("utf-8", "replace"), return_type="proto")
            spans = [(0, 0), *((p.begin, p.end) for p in got.pieces), (len(source), len(source))]
            return np.array(spans, "<i4").tobytes()
        return np.stack([origin[at[:-1]], origin[at[1:]]], 1).astype("<i4").tobytes()

    def decode(self, ids: bytes) -> str:
        return self.run.decode(np.frombuffer(ids, "<u4").tolist())


def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model.parse(f.read())


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, then ids, spans and decoded text of each row.

    ``ids`` are unsigned, ``spans`` signed 32-bit little-endian integers in binary columns. The model's bytes
    (half a megabyte) travel with the function, so executors need no file.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StringType, StructType

    docs = make_room(docs, "ids", "spans", "decoded")
    model = load(path)
    out = StructType([f for f in docs.schema if f.name != text]).add("ids", BinaryType()).add("spans", BinaryType()).add("decoded", StringType())

    def run(batches):
        codec = Codec(model)

        def use(value: bytes | None) -> tuple:
            source = (value or b"").decode("utf-8", "replace")
            ids = codec.ids(source)
            return ids, codec.spans(value or b"", ids), codec.decode(ids)

        yield from per_text(batches, to_arrow_schema(out), use, text)

    return docs.mapInArrow(run, out)
