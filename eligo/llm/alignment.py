"""Alignment of two tokenizers' tokens over the same bytes, with an identity map for tokens that both have.

A text, with a space before it, is encoded by A (a byte-level model of merges, JSON) and by B (a piece model of merges, which adds the space
itself). Where tokens of both end at one byte, a group ends; the last tokens of a group are linked, and a pair of ids counts as often as it
is linked in all documents.

Identity map: an array gives, for each id of A, the id of B whose bytes are the same. Groups of one token of each that the map foretells, most of
them, are counted by A's id alone, in one vector of the length of the vocabulary for each task, and the sum of these vectors goes to all tasks. Only the
pairs of the other groups are shuffled to be counted. Of those, the most frequent (at most HOT, so their size is bounded) are
sent to all tasks too; the rest are joined back by pair, none of which is frequent.

Neither model has a token that goes on over a space between two other characters, so a text is cut there into parts that are encoded and aligned alone; parts lately
met are kept (at most KEEP). That the parts' ends are ends of tokens is checked for every part that is encoded.

Defined cases: texts that are null, empty, or whose joined bytes of either model differ from space and text have no tokens; special tokens' strings are
plain text; texts of any length are encoded whole; each of equal rows is a document; an empty table gives no rows; other columns are not read. Models are read, never
trained; their paths are parameters. A model B that joins words over a space or squeezes white space is refused.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import cut

CUT = re.compile(r"(?<=\S) (?=\S)")
HOT = 1 << 18  # pairs of ids
KEEP = 300_000  # parts of texts
LONG = 64  # code points of a part that is kept
STEP = 1_000_000  # code points of texts that are taken together
RUN = 20_000  # code points of parts that a model encodes together
TOKENS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, other array<long>, other_n array<int>"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level models write for bytes: printable ones as they are, the others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Models:
    """Both models, their tokens' bytes, the identity map, and the parts met lately."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in text)
        n = self.b.get_piece_size()
        piece = [self.b.id_to_piece(i) for i in range(n)]
        kind = [self.b.is_byte(i) for i in range(n)], [self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else b"" if no else p.replace("▁", " ").encode() for p, byte, no in zip(piece, *kind, strict=True)]
        probe = "  a  b\n c "
        if any(re.search("[^▁]▁", p) for p in piece) or b"".join(self.bytes_b[i] for i in self.b.encode(probe)) != b" " + probe.encode():
            raise ValueError("model B joins words over spaces or changes white space")
        first = {}
        for i in sorted(range(n), key=lambda i: kind[0][i]):  # pieces before single bytes
            if self.bytes_b[i]:
                first.setdefault(self.bytes_b[i], i)
        self.same = np.array([first.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)
        self.size = [np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.bytes_a, self.bytes_b)]
        # an id with what follows it: the next of its side, or the end of its side
        self.told = [np.array([f"{i}{end}" for i in range(len(xs))], dtype=object) for xs, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends]
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = np.zeros((4, 0), dtype=np.int64)  # fine, n_a, n_b, n_groups
        self.lists = [(np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in range(2)]  # starts and values: tokens of the map, other pairs

    def _ids(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Token ids of A and B and their byte ends, over all parts laid end to end; parts that begin and end with other than white space are encoded in runs."""
        runs, now, length = [], [], 0
        for p in parts:
            if p[0].isspace() or p[-1].isspace():
                runs += [now, [p]] if now else [[p]]
                now, length = [], 0
            else:
                now.append(p)
                length += len(p)
                if length > RUN:
                    runs.append(now)
                    now, length = [], 0
        runs += [now] if now else []
        joined = [" ".join(r) for r in runs]
        ids = [e.ids for e in self.a.encode_batch([" " + j for j in joined], add_special_tokens=False)], self.b.encode(joined, num_threads=1)
        flat = [np.array([i for x in side for i in x], dtype=np.int64) for side in ids]
        return flat, [np.cumsum(size[f]) for size, f in zip(self.size, flat, strict=True)]

    def add(self, parts: list[str]) -> None:
        """Encode and align parts that are not known, none of which is empty."""
        raw = [b" " + p.encode() for p in parts]
        cuts = np.cumsum([len(r) for r in raw])
        ids, ends = self._ids(parts)
        whole = b"".join(raw)
        if len(parts) > 1 and not all(b"".join(map(table.__getitem__, i.tolist())) == whole and np.isin(cuts, e).all() for table, i, e in zip((self.bytes_a, self.bytes_b), ids, ends, strict=True)):
            for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
                self.add(half)
            return
        fine = all(b"".join(map(table.__getitem__, i.tolist())) == whole for table, i in zip((self.bytes_a, self.bytes_b), ids, strict=True))
        if not fine:  # one part alone
            ids, ends, owner, n_groups = [np.zeros(0, dtype=np.int64)] * 2, [np.zeros(0, dtype=np.int64)] * 2, np.zeros(0, dtype=np.int64), 0
            last = [np.zeros(0, dtype=bool)] * 2
        else:
            last = [np.isin(e, o) for e, o in zip(ends, ends[::-1], strict=True)]
            owner = np.searchsorted(cuts, ends[0][last[0]])  # part of each group
        n_groups = int(last[0].sum())
        group = [np.cumsum(x) - x for x in last]
        heads = [i[x] for i, x in zip(ids, last, strict=True)]  # linked tokens
        single = np.ones(n_groups, dtype=bool)
        for g in group:
            single &= np.bincount(g, minlength=n_groups) == 1
        mapped = single & (self.same[heads[0]] == heads[1])
        # both sides' tokens by group, A's first
        told = np.concatenate([np.where(x, self.told[2 * s + 1][i], self.told[2 * s][i]) for s, (i, x) in enumerate(zip(ids, last, strict=True))])
        by = np.lexsort((np.repeat([0, 1], [len(ids[0]), len(ids[1])]), np.concatenate(group)))
        tokens = told[by].tolist()
        per_part = [np.bincount(owner[g], minlength=len(parts)) for g in group]
        at = np.concatenate([[0], np.cumsum(per_part[0] + per_part[1])])
        start = len(self.texts)
        self.texts += ["".join(tokens[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        counts = np.stack([np.full(len(parts), int(fine)), *per_part, np.bincount(owner, minlength=len(parts))])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        for k, (values, some) in enumerate(((heads[0], mapped), (heads[0] * len(self.bytes_b) + heads[1], ~mapped))):
            starts, old = self.lists[k]
            self.lists[k] = np.concatenate([starts, starts[-1] + np.cumsum(np.bincount(owner[some], minlength=len(parts)))]), np.concatenate([old, values[some]])
        self.known.update(zip(parts, range(start, start + len(parts)), strict=True))

    def texts_of(self, texts: list[str]) -> Iterator[tuple]:
        """By text (none is empty): n_a, n_b, n_groups, digest, distinct mapped ids and how often, distinct other pairs and how often."""
        split = [CUT.split(t) for t in texts]
        new = list({p for parts in split for p in parts} - self.known.keys())
        if new:
            self.add(new)
        for parts in split:
            at = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
            fine, n_a, n_b, n_groups = self.counts[:, at].sum(axis=1).tolist()
            if fine < len(at):
                yield 0, 0, 0, "", *[np.zeros(0, dtype=np.int64)] * 4
                continue
            told = "".join([self.texts[k] for k in at.tolist()])[:-1]
            found = []
            for starts, values in self.lists:
                first, many = starts[at], starts[at + 1] - starts[at]
                spots = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                found += np.unique(values[spots], return_counts=True)
            yield n_a, n_b, n_groups, hashlib.sha256(told.encode()).hexdigest(), *found
        if len(self.known) > KEEP or any(len(p) > LONG for p in new):
            self.forget()

    def forget(self) -> None:
        """Drop long parts, and all where there are too many."""
        if len(self.known) > KEEP:
            self.reset()
        else:  # their arrays stay until then; a long part's text is what takes room
            for p in [p for p in self.known if len(p) > LONG]:
                self.texts[self.known.pop(p)] = ""


_models: dict[tuple[str, str], Models] = {}


def models(path_a: str, path_b: str) -> Models:
    """The models of a Python worker, read once."""
    if (path_a, path_b) not in _models:
        _models[path_a, path_b] = Models(path_a, path_b)
    return _models[path_a, path_b]


def _lists(columns: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*columns, np.zeros(0, dtype=np.int64)]), kind))


def tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document row: counts, digest of its groups, and its links as distinct mapped ids and distinct other pairs with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models(path_a, path_b)
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < len(ids):
                some, length, end = [], 0, at
                while end < len(ids) and length < STEP:
                    some.append(texts[end].as_py() or "")
                    length += len(some[-1])
                    end += 1
                found = own.texts_of([t for t in some if t])
                none = (0, 0, 0, "", *[np.zeros(0, dtype=np.int64)] * 4)
                rows = [next(found) if t else none for t in some]
                next(found, None)  # lets it forget
                n_a, n_b, n_groups, digest, same, same_n, other, other_n = zip(*rows, strict=True)
                numbers = [pa.array(c, pa.int64()) for c in (ids[at:end], n_a, n_b, n_groups, n_groups)]
                lists = [_lists(list(c), k) for c, k in ((same, pa.int32()), (same_n, pa.int32()), (other, pa.int64()), (other_n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(digest), *lists], [c.split()[0] for c in TOKENS.split(", ")])
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def mapped_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id of A is linked by the identity map: a vector for each task, of which the entries are summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            total += np.bincount(ids, weights=n, minlength=size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["a", "n"])

    got = rows.select("same", "same_n").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each id of A
    out = np.zeros(size, dtype=np.int64)
    out[got["a"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how often the other pairs are linked."""
    each = rows.select(F.explode(F.arrays_zip("other", "other_n")).alias("x")).select(F.col("x.other").alias("pair"), F.col("x.other_n").alias("n"))
    return each.groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The pairs of at least a number of links, which is set so that they are at most `most`, in the order of pairs; their counts; and that number."""
    sizes = pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()  # at most 64 rows
    least, held = 64, 0
    for bits, n in sorted(map(tuple, sizes), reverse=True):
        if held + n > most:
            break
        least, held = bits, held + n
    low = min(1 << (least - 1), 2**63 - 1)
    got = pairs.where(F.col("n") >= low).toPandas().sort_values("pair")
    return got["pair"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.int64), low


def align(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document row."""
    spark, own = docs.sparkSession, models(path_a, path_b)
    width = len(own.bytes_b)
    rows = cut(tokens(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "tokens")  # numbers are fixed once they are written
    mapped, pairs = mapped_counts(rows, len(own.same)), cut(pair_counts(rows), "pairs")
    # the highest count of each id of B
    top = np.zeros(width, dtype=np.int64)
    at = np.flatnonzero(mapped)
    np.maximum.at(top, own.same[at], mapped[at])
    others = pairs.groupBy((F.col("pair") % width).cast("int").alias("b")).agg(F.max("n").alias("n")).toPandas()  # at most a row for each id of B
    np.maximum.at(top, others["b"].to_numpy(dtype=np.int64), others["n"].to_numpy(dtype=np.int64))
    hot_pairs, hot_n, low = frequent(pairs, hot)
    known = spark.sparkContext.broadcast((mapped, mapped == top[own.same], hot_pairs, hot_n, hot_n == top[hot_pairs % width]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By row: what mapped ids and frequent pairs give, and the pairs that are left."""
        mapped, best, hot_pairs, hot_n, hot_best = known.value
        for batch in batches:
            n_rows, sums, bests, left = batch.num_rows, 0, 0, []
            for k, (ids, many) in enumerate(((1, 2), (3, 4))):
                column = batch.column(ids)
                owner = np.repeat(np.arange(n_rows), np.diff(column.offsets.to_numpy()))
                value, n = column.flatten().to_numpy(zero_copy_only=False), batch.column(many).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if k:
                    spot = np.minimum(np.searchsorted(hot_pairs, value), max(len(hot_pairs) - 1, 0))
                    here = hot_pairs[spot] == value if len(hot_pairs) else np.zeros(len(value), dtype=bool)
                    left = [[x[s:e] for s, e in zip(*_spans(owner[~here], n_rows), strict=True)] for x in (value[~here], n[~here])]
                    owner, n, value = owner[here], n[here], spot[here]
                count, is_best = (hot_n, hot_best) if k else (mapped, best)
                sums = sums + _sums(owner, n * count[value], n_rows)
                bests = bests + _sums(owner, n * is_best[value], n_rows)
            columns = [batch.column(0), pa.array(bests), pa.array(sums), _lists(left[0], pa.int64()), _lists(left[1], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "best", "total", "pair", "n"])

    # what is left is counted with pairs under `low` links only, so no pair is frequent
    some = cut(rows.select("row", "same", "same_n", "other", "other_n").mapInArrow(total, "row long, best long, total long, pair array<long>, n array<int>"), "totals")
    tops = spark.createDataFrame(list(enumerate(top.tolist())), "b int, top long")
    rare = pairs.where(F.col("n") < low).withColumn("b", (F.col("pair") % width).cast("int")).join(F.broadcast(tops), "b").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    each = some.select("row", F.explode(F.arrays_zip("pair", "n")).alias("x")).select("row", "x.pair", "x.n").join(rare, "pair")
    more = each.groupBy("row").agg(F.sum(F.col("n") * F.col("count")).alias("more"), F.sum(F.col("n") * F.col("is_best")).alias("more_best"))
    both = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(some.select("row", "best", "total"), "row").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("best", "more_best").alias("n_best"), plus("total", "more").alias("count_sum"), "groups_sha256")


def _sums(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by owner."""
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, owner, value)
    return out


def _spans(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each owner's entries begin and end."""
    return np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), side="right")
