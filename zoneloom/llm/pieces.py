"""Piece encoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a unit's UTF-8 bytes once. At each byte its output links name every piece that ends there, and each
relaxes the best score of that position. All new units of a batch advance together, one numpy step per byte position.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneloom.llm.tables import byte_chunks, held
from zoneloom.llm.units import UnitEncoder, gather

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CHUNK_BYTES = 1 << 20
UNITS_KEPT = 150_000  # of a worker, some 25 MB
CELLS = 1 << 19  # byte positions of units that advance together


class Automaton:
    """Goto table with failure links resolved, and for each node the piece that ends there and the next output link."""

    def __init__(self, pieces: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        levels: list[list[tuple[int, int, int]]] = []
        piece_at = [-1]
        for piece, number in pieces.items():
            node = 0
            for depth, byte in enumerate(piece):
                if byte not in children[node]:
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((node, byte, len(children)))
                    children[node][byte] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = children[node][byte]
            piece_at[node] = number
        n = len(children)
        self.goto = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)
        self.piece = np.array(piece_at, np.int32)
        fail, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for depth, level in enumerate(levels):
            parents, codes, nodes = np.array(level, np.int64).T
            if depth:
                fail[nodes] = self.goto[fail[parents], codes]
            self.goto[parents, codes] = nodes
            # A node starts from its failure node's moves; its own children replace them one level further down.
            self.goto[nodes] = self.goto[fail[nodes]]
            self.link[nodes] = np.where(self.piece[fail[nodes]] >= 0, fail[nodes], self.link[fail[nodes]])


class PieceModel:
    """Pieces with scores. Characters that no piece covers become byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        self.byte_id = np.full(256, -1, np.int32)
        self.content: list[bytes] = []
        normal: dict[bytes, int] = {}
        for i in numbers:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.content.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.content.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece goes on behind a space: units cannot be cut at spaces")
                normal[piece.encode()] = i
                self.content.append(piece.replace(SPACE, " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        if model.normalize(" a  b ") not in (f"{SPACE * 2}a{SPACE * 2}b{SPACE}", " a  b "):
            raise ValueError("only models that keep white space and put a space in front are supported")
        self.score = np.array([model.get_score(i) for i in numbers])
        self.unknown = float(self.score[list(normal.values())].min()) - UNKNOWN_PENALTY
        self.size = np.array([len(model.id_to_piece(i).encode()) for i in numbers], np.int64)
        self.automaton = Automaton(normal)
        self.content_size = np.array([len(b) for b in self.content], np.int64)
        self.content_start = np.cumsum(self.content_size) - self.content_size
        self.content_bytes = np.frombuffer(b"".join(self.content), np.uint8)

    def viterbi(self, units: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row and the number of ids per unit; the path of the greatest summed score.

        Of equal scores the longest last piece wins, at every position.
        """
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-lengths, kind="stable")
        counts = np.zeros(len(units), np.int64)
        found: list[np.ndarray] = []
        first = 0
        while first < len(units):
            many = max(1, CELLS // int(lengths[order[first]] + 1))
            some = order[first : first + many]
            ids, per_unit = self._together([units[i] for i in some], lengths[some])
            counts[some] = per_unit
            found.append(ids)
            first += many
        ids = np.concatenate(found) if found else np.empty(0, np.int32)
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gather(ids, starts, counts), counts

    def _together(self, units: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units by falling length."""
        n, longest = len(units), int(lengths[0])
        text = np.zeros((longest, n), np.uint8)  # a row per byte position
        inside = np.arange(longest)[:, None] < lengths
        text.T[inside.T] = np.frombuffer(b"".join(units), np.uint8)
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        back = np.full((longest + 1, n), -1, np.int32)  # last piece; -1: a character as bytes
        step = np.zeros((longest + 1, n), np.int64)  # its bytes
        node = np.zeros(n, np.int32)
        auto = self.automaton
        char_start = np.zeros(n, np.int64)
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        for t in range(longest):
            k = int(active[t])
            byte = text[t, :k]
            starts = (byte & 0xC0) != 0x80
            char_start[:k][starts] = t
            node[:k] = auto.goto[node[:k], byte]
            at = node[:k]
            at = np.where(auto.piece[at] >= 0, at, auto.link[at])
            rows = np.flatnonzero(at)
            at = at[rows]
            covered = np.zeros(k, bool)  # a piece of just the last character ends here
            while len(rows):
                piece = auto.piece[at]
                size = self.size[piece]
                score = best[t + 1 - size, rows] + self.score[piece]
                covered[rows[t + 1 - size == char_start[rows]]] = True
                better = score > best[t + 1, rows]
                won = rows[better]
                best[t + 1, won], back[t + 1, won], step[t + 1, won] = score[better], piece[better], size[better]
                at = auto.link[at]
                rows, at = rows[at > 0], at[at > 0]
            # A character ends here if the unit ends or the next byte starts another.
            ends = np.ones(k, bool)
            if t + 1 < longest:
                ends = ((text[t + 1, :k] & 0xC0) != 0x80) | (lengths[:k] == t + 1)
            rows = np.flatnonzero(ends & ~covered)
            score = best[char_start[rows], rows] + self.unknown
            better = score > best[t + 1, rows]
            won = rows[better]
            best[t + 1, won], back[t + 1, won], step[t + 1, won] = score[better], -1, t + 1 - char_start[won]
        ids = np.full((n, longest), -1, np.int32)
        rows, at = np.arange(n), lengths.copy()
        while len(rows):
            piece, size = back[at, rows], step[at, rows]
            start = at - size
            whole = piece >= 0
            ids[rows[whole], start[whole]] = piece[whole]
            for b in range(4):
                more = ~whole & (size > b)
                ids[rows[more], start[more] + b] = self.byte_id[text[start[more] + b, rows[more]]]
            rows, at = rows[start > 0], start[start > 0]
        used = ids >= 0
        return ids[used], used.sum(1)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each text, without the space put in front."""
        out = gather(self.content_bytes, self.content_start[ids], self.content_size[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.content_size[ids])))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [out[a + 1 : b] if b > a else b"" for a, b in zip(ends, ends[1:])]


def _model(path: str) -> tuple[PieceModel, UnitEncoder]:
    """A worker's model and encoder, kept between its tasks."""
    return held(f"pieces {path}", lambda: _make_model(path))


def _make_model(path: str) -> tuple[PieceModel, UnitEncoder]:
    model = PieceModel(path)
    space = SPACE.encode()

    def encode_new(units: Sequence) -> tuple[np.ndarray, np.ndarray]:
        return model.viterbi([space + (u[0] if isinstance(u, tuple) else u).replace(" ", SPACE).encode() for u in units])

    return model, UnitEncoder(encode_new, np.int32, UNITS_KEPT)


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``(key, pieces)`` per row: piece ids of the whole text, one space put in front of it.

    Null and empty texts have an empty array. Rows are handled one by one, so nothing is shuffled. With ``decoded`` the
    same pass adds what ``decode_pieces`` makes of the ids.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, encoder = _model(model)
        for batch in batches:
            for first, last in byte_chunks(batch.column(1), CHUNK_BYTES):
                some = batch.slice(first, last - first)
                ids, sizes = encoder.encode(some.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                columns = {"k": some.column(0), "pieces": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}
                yield pa.RecordBatch.from_pydict(columns | (_decoded(codec, ids, offsets) if decoded else {}))

    kind = rows.schema["k"].dataType.simpleString()
    more = ", decoded string, pieces_crc32 bigint" if decoded else ""
    return rows.mapInArrow(run, f"k {kind}, pieces array<int>{more}").withColumnRenamed("k", key)


def _decoded(codec: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    """Texts and checksums of the ids between consecutive offsets, which start at 0."""
    texts = [x.decode(errors="replace") for x in codec.decode(ids, np.diff(offsets))]
    view = memoryview(ids.astype("<u4").tobytes())
    sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    return {"decoded": pa.array(texts, pa.string()), "pieces_crc32": pa.array(sums, pa.int64())}


def decode_pieces(encoded: DataFrame, model: str, pieces: str = "pieces") -> DataFrame:
    """Adds ``decoded`` (the text; what is not UTF-8 comes back as replacement characters) and ``pieces_crc32``.

    Decoding an encoded text gives it back, but for U+2581, which the pieces use for the space.
    """
    kept = [c for c in encoded.columns if c not in ("decoded", "pieces_crc32")]
    rows = encoded.select(F.struct(*kept).alias("row"), F.coalesce(F.col(pieces), F.expr("array()")).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _model(model)[0]
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            yield pa.RecordBatch.from_pydict({"row": batch.column(0)} | _decoded(codec, ids, offsets - offsets[0]))

    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(run, f"row {kind}, decoded string, pieces_crc32 bigint")
    return made.select("row.*", "decoded", "pieces_crc32")
