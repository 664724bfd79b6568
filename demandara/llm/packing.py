"""Best-fit-decreasing packing of documents into sequences of a fixed length.

Which sequence a piece goes to depends on its length alone, so the packing is planned on the
counts per length (at most ``capacity`` numbers) and carried out by rank: the n-th piece of a
length goes where the plan puts the n-th piece of that length. The plan is exactly best-fit
decreasing over the whole table; a segment tree over remaining capacities finds the tightest
open bin in logarithmic time, and a run of equal pieces that meets a run of equal bins is one
step. The plan's size depends on ``capacity``, not on the number of rows.

Contract: one row per piece. Null text is an empty document: the end id alone. Null or repeated
ids and repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import map_arrow, ragged, slices, split_words, text_rows
from .token_counts import byte_letters

#: Distinct words whose ids a worker remembers before it starts anew.
MEMO = 400_000
#: The pattern that cuts a word before the merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordIds:
    """Ids of texts from the ids of their words.

    No token of a vocabulary that drops white space crosses it, so a text's ids are those of
    its white-space-separated words. Words of printable Latin-1 letters, where normalising is
    lower-casing, go straight to the library's merges; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def plain(self, word: str) -> bytes | None:
        """Packed ids of a word of printable Latin-1 characters without special strings."""
        if not (word.isascii() or max(word) < "\u0100") or not word.isprintable():
            return None
        if "<" in word and any(s in word for s in self.special):
            return None
        word = word.lower()
        pieces = (word,) if word.isalpha() else PIECES.findall(word)
        if not word.isascii():
            letters = self.letters
            pieces = ["".join([letters[b] for b in p.encode()]) for p in pieces]
        ids = [t.id for p in pieces for t in self.model.tokenize(p)]
        return array("I", ids).tobytes()

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, packed as little-endian unsigned 32-bit numbers."""
        known = self.known
        if len(known) > MEMO:
            known.clear()
        rest = []
        for w in words:
            if w not in known:
                ids = self.plain(w)
                if ids is None:
                    rest.append(w)
                else:
                    known[w] = ids
        for k in range(0, len(rest), 1000):
            part = rest[k:k + 1000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        return [known[w] for w in words]

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text and all ids, ``end_id`` after each text."""
        offsets, codes, words = split_words(texts)
        ids = self.of(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        each = sizes[codes] if len(codes) else np.empty(0, np.int64)
        before = np.concatenate([[0], np.cumsum(each)])
        flat = pool[ragged(starts[codes], each)] if len(codes) else pool[:0]
        lengths = before[offsets[1:]] - before[offsets[:-1]]
        ends = np.cumsum(lengths)
        return (np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]),
                np.insert(flat, ends, np.uint32(end_id)).astype("<u4", copy=False))


@functools.lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class OpenBins:
    """Open bins by remaining capacity, as runs of neighbouring bin numbers."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = bytearray(2 * self.size)  # the segment tree: is any bin open below a node
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]

    def _mark(self, remaining: int, flag: int) -> None:
        node = self.size + remaining
        self.any[node] = flag
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def put(self, remaining: int, first: int, n: int) -> None:
        if not self.runs[remaining]:
            self._mark(remaining, 1)
        self.runs[remaining].append((first, n))

    def take(self, remaining: int, n: int) -> tuple[int, int]:
        """Up to ``n`` neighbouring bins with that remaining capacity."""
        first, there = self.runs[remaining].popleft()
        if there > n:
            self.runs[remaining].appendleft((first + n, there - n))
        if not self.runs[remaining]:
            self._mark(remaining, 0)
        return first, min(n, there)

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of an open bin that holds ``length``."""
        node = self.size + length
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None

    def room(self, remaining: int) -> int:
        return self.runs[remaining][0][1]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` pieces per length.

    Steps (length, first rank, pieces per bin, first bin, offset): from that rank on (to the next
    step's of the same length) pieces fill bins one after another, so many to a bin.
    """
    bins, steps, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = bins.tightest(length)
            # The bin just used stays the tightest while it holds another piece of this length.
            each = (remaining or capacity) // length
            if left < each:
                each, want = left, 1
            else:
                want = left // each
            if remaining is None:
                remaining, first, n = capacity, opened, want
                opened += want
            else:
                first, n = bins.take(remaining, want)
            steps.append((length, rank, each, first, capacity - remaining))
            rank += n * each
            left -= n * each
            if remaining > each * length:
                bins.put(remaining - each * length, first, n)
    return steps


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str,
              text_col: str) -> DataFrame:
    """Pieces with the task that cut them and their rank among its pieces of the same length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(vocabulary)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for part in slices(batches):
            offsets, ids = table.texts(part["_text"], end_id)
            total = np.diff(offsets)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = ragged(np.zeros(len(n), np.int64), n)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            at = offsets[row] + start
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at + length)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            first = np.searchsorted(by, by, side="left")
            rank = np.empty(len(by), np.int64)
            rank[order] = np.arange(len(by)) - first + seen[by]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [part["_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)),
                 pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                ["_id", "piece", "start", "length", "ids_crc32", "_task", "_rank"])

    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    return map_arrow(rows, work, f"_id {kind}, piece int, start long, length long, "
                                 "ids_crc32 long, _task int, _rank long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: sequence_id and the offset in it.

    The vocabulary must drop white space. Pieces are written once to the shared folder, as
    their ranks and the counts per length must come from the same run.
    """
    pieces = materialise(pieces_of(docs, vocabulary, capacity, end_id, id_col, text_col))
    by_task = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    # A window over one row per task and length: ranks of earlier tasks' pieces come first.
    before = by_task.select("length", "_task", (F.sum("_n").over(
        W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, 0))
        - F.col("_n")).alias("_before"))
    # At most ``capacity`` rows reach the driver.
    counts = {r["length"]: r["n"] for r in
              by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    steps = sorted(plan_bins(counts, capacity))
    at = {name: np.array([s[k] for s in steps], dtype=np.int64)
          for k, name in enumerate(("length", "rank", "each", "bin", "offset"))}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = (at["length"] << 48) + at["rank"]  # a table has fewer than 2**48 pieces
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["_rank"].to_numpy() + batch["_before"].to_numpy()
            step = np.searchsorted(order, (length << 48) + rank, side="right") - 1
            inside, each = rank - at["rank"][step], at["each"][step]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(at["bin"][step] + inside // each),
                 pa.array(at["offset"][step] + inside % each * length)],
                ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["_id"].dataType.simpleString()
    placed = pieces.join(before, ["length", "_task"]).mapInArrow(
        place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, "
               "sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)
