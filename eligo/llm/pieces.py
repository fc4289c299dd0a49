"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks (a chunk is a run of space marks and the text up to the next one; no
piece crosses it, nor a line feed) are laid end to end and indexed by a suffix array, sorted as
deep as the longest piece: keys of as many code points as fit a machine word are sorted, then doubled. Every piece is binary-searched for its range of occurrences; the
occurrences are the edges of the chunks' lattices. Edges are sorted by position and length by counting, into a table of one place for each, and
then relaxed, chunks of like length together: for a model of merges, each chunk again and again takes the edge of best score that
spans two neighbouring symbols, the leftmost of equals, until none is left, which is the encoding
that the model defines. Code points without a piece fall back to their UTF-8 bytes.
A task holds about BATCH_BYTES of its texts as strings, and about SLICE code points of new chunks in tables, at once.

Models are read, never trained; their path is a parameter. The vocabulary is sent to the tasks (its
size is that of the model). Defined cases: a null text has no tokens, like an empty one; a text
that holds the space mark itself decodes to a space; texts of any length are encoded whole;
repeated rows give equal rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
LONG = 200
CLASSES = np.array([4, 6, 8, 10, 12, 16, 24, 48, 96, LONG])  # chunks up to these lengths are relaxed together
NONE = np.iinfo(np.int32).max
BATCH_BYTES = 1_000_000  # of texts that are held as Python's strings at once
SLICE = 1 << 17  # code points of chunks that are learned at once
KEEP = 200_000


def load_model(path: str) -> dict:
    """Pieces, scores and byte ids of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
    raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else sp.id_to_piece(i).encode() for i in range(n)]
    return {
        "pieces": [(sp.id_to_piece(i), i, -sp.get_score(i)) for i in range(n) if not special[i]],
        "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "raw": raw,
    }


class Numbers(dict):
    """Keys numbered as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def split(text: str) -> list[str]:
    """The chunks of a text that is not empty."""
    if "  " in text or text[0] == " " or MARK in text or "\0" in text:
        return CHUNK.findall(MARK + text.replace(" ", MARK))
    # single spaces only: a chunk begins at each, and at both sides of a line feed
    return list(filter(None, (MARK + text.replace(" ", "\0" + MARK)).replace("\n", "\0\n\0").split("\0")))


def runs(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every run, `many` each, end to end."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


class Suffixes:
    """The suffixes of a text of symbols (from 1; 0 ends a chunk), sorted as deep as `depth`, with the keys by which they were sorted."""

    def __init__(self, text: np.ndarray, top: int, depth: int):
        self.bits = max(1, int(top).bit_length())
        self.span, n = min(depth, 64 // self.bits), len(text)
        key = np.zeros(n, dtype=np.uint64)
        for j in range(self.span):
            key <<= np.uint64(self.bits)
            key[: max(0, n - j)] |= text[j:].astype(np.uint64)
        self.levels, spans = [], self.span  # of each: the distinct keys in order
        while True:
            self.order = np.argsort(key)
            ordered = key[self.order]
            first = np.append(True, ordered[1:] != ordered[:-1])
            self.levels.append(ordered[first])
            if spans >= depth:
                self.begin = np.append(np.flatnonzero(first), n)  # where each distinct key's suffixes begin
                return
            rank = np.empty(n, dtype=np.int64)
            rank[self.order] = np.cumsum(first) - 1
            key = rank * (len(self.levels[-1]) + 1)
            key[: max(0, n - spans)] += rank[spans:] + 1
            spans *= 2

    def _ranks(self, level: int, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From which to which rank at a level keys begin with the pieces."""
        keys = self.levels[level]
        if not level:
            low = np.zeros(len(pieces), dtype=np.uint64)
            for j in range(self.span):
                low = low << np.uint64(self.bits) | (pieces[:, j] if j < pieces.shape[1] else np.zeros(len(pieces), dtype=np.uint64))
            free = (np.uint64(self.bits) * (self.span - np.minimum(lengths, self.span)).astype(np.uint64)).astype(np.uint64)
            high = low | np.where(free > 0, (np.uint64(1) << np.minimum(free, 63)) - np.uint64(1), np.uint64(0))
            return np.searchsorted(keys, low), np.searchsorted(keys, high, side="right")
        half, base = self.span << (level - 1), len(self.levels[level - 1]) + 1
        lo, hi = self._ranks(level - 1, pieces[:, :half], np.minimum(lengths, half))
        more = np.flatnonzero((lengths > half) & (lo < hi))
        from_, to = lo * base, hi * base
        low, high = self._ranks(level - 1, pieces[more, half:], lengths[more] - half)
        from_[more], to[more] = lo[more] * base + low + 1, lo[more] * base + high + 1
        return np.searchsorted(keys, from_), np.searchsorted(keys, to)

    def occurrences(self, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which the pieces (rows of symbols, filled with zeros) occur, piece by piece, and how many of each."""
        lo, hi = self._ranks(len(self.levels) - 1, pieces, lengths)
        lo, hi = self.begin[lo], self.begin[np.maximum(lo, hi)]
        return self.order[runs(lo, hi - lo)], hi - lo


class Encoder:
    """Holds a model's pieces and the chunks encoded lately."""

    def __init__(self, model: dict):
        pieces = sorted(model["pieces"])  # by code points, so that neighbours are searched near each other
        self.ids = np.array([p[1] for p in pieces], dtype=np.int32)
        self.cost = np.append(np.unique([p[2] for p in pieces], return_inverse=True)[1], NONE).astype(np.int32)  # in order; the last is that of no piece
        self.lengths = np.array([len(p[0]) for p in pieces])
        self.depth = int(self.lengths.max())
        self.codes = np.zeros((len(pieces), self.depth), dtype=np.int32)
        for k, (text, *_) in enumerate(pieces):
            self.codes[k, : len(text)] = [ord(c) for c in text]
        self.inside = np.arange(self.depth) < self.lengths[:, None]
        self.bytes, self.raw = model["bytes"], model["raw"]
        self.raw_lengths = np.array([len(x) for x in self.raw])
        self.reset()

    def reset(self) -> None:
        self.known = Numbers()
        self.sizes, self.flat, self.sure = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)

    def edges(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the pieces that occur, at position * depth + length - 1; -1 for none."""
        there = np.zeros(max(int(text.max()), int(self.codes.max())) + 1, dtype=bool)
        there[text] = True
        number = np.where(there, np.cumsum(there), 0)
        symbols = number[text]
        symbols[ends] = 0
        rows = np.flatnonzero((there[self.codes] | ~self.inside).all(axis=1))
        wanted = np.where(self.inside[rows], number[self.codes[rows]], 0).astype(np.uint64)
        at, many = Suffixes(symbols, int(number.max()), self.depth).occurrences(wanted, self.lengths[rows])
        table = np.full(len(text) * self.depth, -1, dtype=np.int32)
        table[at * self.depth + np.repeat(self.lengths[rows] - 1, many)] = np.repeat(rows, many)
        return table

    def relax(self, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Symbol length by position (0 inside a symbol and at the ends of chunks) once no edge spans two neighbours."""
        lengths = np.diff(starts) - 1  # each chunk ends with a separator
        size = np.zeros(starts[-1], dtype=np.int64)
        for c in np.flatnonzero(lengths > LONG):
            self._relax_long(int(starts[c]), int(starts[c] + lengths[c]), size, table)
        kind = np.searchsorted(CLASSES, lengths)
        for c in range(len(CLASSES)):
            some = np.flatnonzero(kind == c)
            if len(some):
                self._relax_like(starts[:-1][some], lengths[some], size, table)
        return size

    def _relax_like(self, start: np.ndarray, length: np.ndarray, size: np.ndarray, table: np.ndarray) -> None:
        """Chunks of like length, a column each: keys (cost, position) of the edges over two neighbours, symbols' ends and the symbols before them."""
        width, depth = int(length.max()), self.depth
        place = np.arange(width, dtype=np.int32)[:, None]
        ends = np.full((width + 1, len(length)), NONE // 2, dtype=np.int32)  # none goes on from a chunk's end
        np.copyto(ends[:-1], place + 1, where=place < length)
        before = np.repeat(np.arange(-1, width, dtype=np.int32)[:, None], len(length), axis=1)
        pairs = np.minimum((start + place) * depth + 1, len(table) - 1)
        cost = self.cost[table[pairs]] if depth > 1 else np.full(pairs.shape, NONE, dtype=np.int32)
        key = np.where((place + 1 < length) & (cost < NONE), cost << 8 | place, NONE)
        held = place < length

        def edge(s, i, end):
            fits = end - i <= depth
            cost = self.cost[table[(s + i) * depth + np.where(fits, end - i, 1) - 1]]
            return np.where(fits & (cost < NONE), cost << 8 | i, NONE)

        while True:
            best = key.min(axis=0)
            c = np.flatnonzero(best < NONE)
            if 2 * len(c) <= len(best):
                done = best == NONE
                row, col = np.nonzero(held & done)
                size[start[col] + row] = ends[row, col] - row
                if not len(c):
                    return
                start, key, ends, before, held, best = start[c], key[:, c], ends[:, c], before[:, c], held[:, c], best[c]
                c = np.arange(len(c))
            s, i = start[c], best[c] & 255
            j = ends[i, c]
            k = ends[j, c]
            ends[i, c], key[j, c], held[j, c] = k, NONE, False
            before[k, c] = i
            key[i, c] = edge(s, i, ends[k, c])
            some = np.flatnonzero(i)
            c, p = c[some], before[i[some], c[some]]
            key[p, c] = edge(s[some], p, k[some])

    def _relax_long(self, a: int, b: int, size: np.ndarray, table: np.ndarray) -> None:
        """The same for one long chunk, with a heap."""
        cost = self.cost
        right, left = {i: i + 1 for i in range(a, b)}, {i: i - 1 for i in range(a, b)}
        heap: list = []

        def push(i):
            j = right.get(i, b)
            if a <= i and j < b:
                length = right[j] - i
                if length <= self.depth and (at := table[i * self.depth + length - 1]) >= 0:
                    heapq.heappush(heap, (int(cost[at]), i, j, right[j]))

        for i in range(a, b):
            push(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if right.get(i) != j or right.get(j) != k:
                continue
            right[i] = k
            del right[j], left[j]
            if k < b:
                left[k] = i
            push(i)
            if (h := left[i]) >= a:
                push(h)
        for i, k in right.items():
            size[i] = k - i

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks not seen before and keep their ids, and whether these are sure to decode to the chunk."""
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        of = np.cumsum(lengths + 1) // SLICE
        for some in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(of)) + 1) if chunks else []:
            self._learn(chunks[some[0] : some[-1] + 1], lengths[some])

    def _learn(self, chunks: list[str], lengths: np.ndarray) -> None:
        joined = "\0".join([*chunks, ""])
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        table = self.edges(text, starts[1:] - 1)
        size = self.relax(starts, table)
        at = np.flatnonzero(size)
        place = table[at * self.depth + size[at] - 1]
        out, many = self.ids[place], np.ones(len(at), dtype=np.int64)
        lost = np.flatnonzero(place < 0)
        if len(lost):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in text[at[lost]]]
            many[lost] = [len(x) for x in spelled]
            out = np.repeat(out, many)
            out[runs((np.cumsum(many) - many)[lost], many[lost])] = [self.bytes[v] for x in spelled for v in x]
        chunk = np.repeat(np.arange(len(chunks)), lengths + 1)
        sizes = np.bincount(chunk[at], weights=many, minlength=len(chunks)).astype(np.int64)
        # sure where the tokens' bytes are those of the chunks, and as many in each chunk
        own = 1 + (text >= 0x80) + (text >= 0x800) + (text >= 0x10000)
        own[starts[1:] - 1] = 0
        spoken = np.bincount(np.repeat(np.arange(len(chunks)), sizes), weights=self.raw_lengths[out], minlength=len(chunks))
        alike = spoken == np.bincount(chunk, weights=own, minlength=len(chunks))
        whole = alike.all() and b"".join(map(self.raw.__getitem__, out.tolist())) == "".join(chunks).encode("utf-8", "replace")
        self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, out.astype(np.int32))
        self.sure = np.append(self.sure, np.full(len(chunks), whole))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's ids."""
        return self.encoded(texts)[:2]

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and whether a text's ids are sure to decode to it: where that is false they may or may not."""
        if len(self.known) > KEEP:
            self.reset()
        chunks, rows, seen = [], [], len(self.known)
        for t in texts:
            before = len(chunks)
            if t:
                chunks += split(t)
            rows.append(len(chunks) - before)
        at = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        self.learn(list(islice(self.known, seen, None)))
        many = self.sizes[at]
        flat = self.flat[runs((np.cumsum(self.sizes) - self.sizes)[at], many)]
        cuts = np.concatenate([[0], np.cumsum(rows)]).astype(np.int64)
        unsure = np.concatenate([[0], np.cumsum(~self.sure[at])])
        clean = np.array([MARK not in (t or "") for t in texts], dtype=bool)
        return flat, np.diff(np.concatenate([[0], np.cumsum(many)])[cuts]), (np.diff(unsure[cuts]) == 0) & clean


def decode_ids(ids, raw: list[bytes]) -> str:
    """Text of ids: pieces and bytes joined, marks as spaces, less the one space put in front."""
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encoded_rows(enc: Encoder, part) -> Iterator:
    """A record batch of (doc_id, text) -> record batches of doc_id, n_tokens, tokens, round_trip, each of about BATCH_BYTES of text or one row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    of = np.cumsum(pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        doc_id, texts = part.column("doc_id").slice(a, b - a), part.column("text").slice(a, b - a).to_pylist()
        flat, sizes, sure = enc.encoded(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        same = [bool(z) or decode_ids(flat[x:y].tolist(), enc.raw) == (t or "") for x, y, t, z in zip(ends[:-1], ends[1:], texts, sure, strict=True)]
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(sizes, pa.int64()), lists, pa.array(same)], names=["doc_id", "n_tokens", "tokens", "round_trip"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip (do the tokens decode to the text?) for each document."""
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def run(parts):
        enc = Encoder(model.value)
        for part in parts:
            yield from encoded_rows(enc, part)
            del part  # before the next is read

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>, round_trip boolean")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, tokens); null tokens give a null text."""
    raw = tokens.sparkSession.sparkContext.broadcast(load_model(path)["raw"])

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_ids(x.tolist(), raw.value) for x in s], dtype=object)

    return tokens.select("doc_id", text("tokens").alias("text"))
