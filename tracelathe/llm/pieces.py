"""SentencePiece encoding and decoding by backtracking over compatible neighbours.

A sequence of pieces is the merge encoding of its text exactly if every piece is the encoding of
its own string and every two neighbours are the encoding of their joined string: the first merge
that would cross a border would also cross it when only the two pieces beside it are there.  So
the encoder walks the text with the longest piece that starts at each position (found for all
positions by one Aho-Corasick pass over the reversed text), takes it if it fits its left neighbour,
else the next shorter piece, and steps back where none fits.  A bitfield keeps the positions from
which nothing went on, so the walk stays linear.  Whether two pieces fit is decided by merging
their joined string anew, and kept.

Where a text has two neighbouring bytes that no piece holds next to each other (a blank after a
letter, say), the encoding always has a border: texts are cut there, and each distinct unit is
encoded once per worker.
"""

from __future__ import annotations

import codecs
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.byte_units import Slice, UnitTable, between_strangers, gather, never_inside
from tracelathe.llm.common import by_bytes, plain, small_batches, texts_of

MARK = "▁"  # fixed value: stands for a blank
_MODELS: dict = {}
codecs.register_error("byte-by-byte", lambda e: ("�", e.start + 1))


class PieceEncoder:
    """Exact merge encoding over the pieces of a model file."""

    def __init__(self, path: str, pairs_kept: int = 250_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.id_of = {p: i for i, p in enumerate(names) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i)
                         else " ⁇ ".encode() if model.is_unknown(i) else p.replace(MARK, " ").encode()
                         for i, p in enumerate(names)]
        self.marked = [not special[i] and p.startswith(MARK) for i, p in enumerate(names)]
        self.pairs_kept, self.pairs = pairs_kept, {}
        reachable = [p for p in self.id_of if len(self.merged(p)) == 1]
        self.reversed = ahocorasick.Automaton()
        for p in reachable:
            self.reversed.add_word(p[::-1], len(p))
        self.reversed.make_automaton()
        # The next shorter piece with which a piece begins; a lone character always is one.
        known = set(reachable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in known), None) for p in reachable}
        self.strangers = never_inside(p.replace(MARK, " ").encode() for p in reachable)
        self.table = UnitTable(lambda units: [self.ids(u.replace(" ", MARK)) for u in units], limit=300_000, slots=1 << 19)
        self.byte_ends = np.cumsum([0, *map(len, self.bytes_of)])
        self.bytes_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Merge the pair of the best score, leftmost first, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.pairs_kept:
                self.pairs.clear()
            # Interned: pairs share the strings of their pieces.
            found = self.pairs[sys.intern(left), sys.intern(right)] = self.merged(left + right) == [left, right]
        return found

    def tokens(self, text: str) -> list[str]:
        n = len(text)
        longest = [1] * (n + 1)
        for end, size in self.reversed.iter(text[::-1]):
            start = n - 1 - end
            if size > longest[start]:
                longest[start] = size
        failed = 0  # bit p: nothing that begins at position p leads to the end
        out: list[str] = []
        pairs, shorter, last, pos = self.pairs, self.shorter, "", 0
        piece = text[:longest[0]]
        while pos < n:
            while piece is not None:
                end = pos + len(piece)
                if not failed >> end & 1:
                    if not last:
                        break
                    fits = pairs.get((last, piece))
                    if fits is None:
                        fits = self.fits(last, piece)
                    if fits:
                        break
                piece = shorter.get(piece)
            if piece is not None:
                out.append(piece)
                last, pos = piece, end
                piece = text[pos:pos + longest[pos]]
            else:
                failed |= 1 << pos
                piece = out.pop()
                pos -= len(piece)
                piece, last = shorter.get(piece), out[-1] if out else ""
        return out

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.tokens(text):
            i = self.id_of.get(piece)
            if i is None:
                out += [self.byte_id[b] for b in piece.encode()]
            else:
                out.append(i)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the borders of the texts among them."""
        usual = ["\0" not in t for t in texts]  # zero bytes can't be looked up: such texts are walked whole
        # A blank stands before each text, and a mark in the text is a blank to the library.
        part = Slice([t.replace(MARK, " ") if u else "" for t, u in zip(texts, usual)], prefix=b" ")
        at, ends = between_strangers(part, self.strangers)
        flat, borders = self.table.expand(self.table.lookup(part, at, ends))
        borders = borders[part.per_text(at)]
        if all(usual):
            return flat, borders
        rows = [flat[a:b] if u else np.array(self.ids(MARK + t.replace(" ", MARK)), np.int32)
                for t, u, a, b in zip(texts, usual, borders, borders[1:])]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> list[str]:
        """The texts of ids between the borders."""
        raw, ends = gather(self.bytes_flat, self.byte_ends, ids)
        raw, cut = raw.tobytes(), ends[borders].tolist()
        skip = [a < b and self.marked[ids[a]] for a, b in zip(borders, borders[1:])]  # the blank put before the first word
        return [raw[a + s:b].decode("utf-8", "byte-by-byte") for a, b, s in zip(cut, cut[1:], skip)]


def encoder(path: str) -> PieceEncoder:
    """The encoder of a worker process, built once."""
    if path not in _MODELS:
        _MODELS[path] = PieceEncoder(path)
    return _MODELS[path]


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    sizes = [np.zeros(1, np.int64), *(np.diff(borders) for _, borders in parts)]
    flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in parts)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(flat, pa.int32()))


def encode(text: Column, path: str, slice_bytes: int = 1 << 20) -> Column:
    """Ids of each text (ARRAY<INT>), as the library gives them without begin, end or sampling.
    A null text counts as empty: no ids."""
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder(path)
        for batch in batches:
            yield _lists([model.encode(texts_of(part)) for part in by_bytes(batch, slice_bytes)])

    return ids(text)


def encode_and_decode(text: Column, path: str, slice_bytes: int = 1 << 20) -> Column:
    """STRUCT<ids ARRAY<INT>, decoded STRING>: ids, and the text they decode to, from one worker that
    holds the vocabulary once."""
    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder(path)
        for batch in batches:
            parts, decoded = [], []
            for part in by_bytes(batch, slice_bytes):
                parts.append(model.encode(texts_of(part)))
                decoded += model.decode(*parts[-1])
            yield pa.StructArray.from_arrays([_lists(parts), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return both(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each list of ids; null for null."""
    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder(path)
        for batch in batches:
            flat, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            yield pa.array(model.decode(flat, ends), pa.string(), mask=np.asarray(batch.is_null()))

    return texts(ids)


def with_pieces(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ids (ARRAY<INT>) and decoded (STRING), ids decoded again.

    Null and empty texts: no ids and an empty string.  Every row is kept; an empty table gives an
    empty table; input columns named ids or decoded give way.
    """
    # Ids and decoded texts take some three times a batch's bytes, in the worker and again in the JVM.
    df = plain(small_batches(df, 1 << 21), "ids", "decoded")
    return df.withColumn("__both", encode_and_decode(F.col(text), path)).select(*df.columns, "__both.ids", "__both.decoded")
