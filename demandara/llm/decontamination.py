"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles. An item's signature is its smallest
shingle hashes, as many as its partition needs: an item with at least ``share`` of its shingles
in a document can miss at most floor((1 - share) n) of them, so one of any floor((1 - share) n) + 1
is there and no contaminated document is lost, however long it is. Of a document only hashes up to
a partition's largest signature hash are looked up. Every candidate is verified by counting the
item's shingles themselves in the document.

Contract: words are runs of letters and digits, lower-cased; shingles are five words. An item of
fewer words is one shingle of all its words and must stand in the document as such; an item without words
(null: empty) matches nothing. Repeated rows and null ids on either side give rows of their own.
Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow, slices, split_words, text_rows
from .sketches import WORDS, hashes_of

SHARE = 0.8
#: Words of the items that one pass over the documents looks for. A larger set of items takes
#: several passes, so what a task holds does not grow with it.
BLOCK_WORDS = 1_000_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-case runs of letters and digits."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")),
                                       r"[^\pL\pN]+", " ")
    return split_words(plain)


class Index:
    """Signatures of one block of items."""

    def __init__(self, texts: list[str], share: float):
        self.share = share
        offsets, codes, distinct = words_of(pa.array(texts, pa.string()))
        n = np.diff(offsets)
        words = [[distinct[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
        self.width = np.minimum(n, WORDS)
        self.shingles = [shingles(w, int(k)) for w, k in zip(words, self.width)]
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for width in range(1, WORDS + 1):
            at, h = hashes_of(offsets, codes, distinct, width)
            for i in np.flatnonzero(self.width == width):
                own = np.unique(h[at[i]:at[i + 1]])
                parts.setdefault((width, len(own).bit_length()), []).append((own, int(i)))
        #: (shingle width, sorted signature hashes, item of each)
        self.parts = []
        for (width, size), members in sorted(parts.items()):
            largest = max(len(own) for own, _ in members)
            keep = math.floor((1 - share) * largest + 1e-9) + 1
            h = np.concatenate([own[:keep] for own, _ in members])
            item = np.concatenate([np.full(len(own[:keep]), i) for own, i in members])
            order = np.argsort(h, kind="stable")
            self.parts.append((width, h[order], item[order]))

    def candidates(self, offsets, codes, distinct) -> set[tuple[int, int]]:
        """(text, item) pairs that share a signature hash."""
        found: set[tuple[int, int]] = set()
        hashed = {w: hashes_of(offsets, codes, distinct, w) for w in {p[0] for p in self.parts}}
        for width, signature, item in self.parts:
            at, h = hashed[width]
            small = np.flatnonzero(h <= signature[-1])
            first = np.searchsorted(signature, h[small], side="left")
            hit = signature[np.minimum(first, len(signature) - 1)] == h[small]
            small, first = small[hit], first[hit]
            last = np.searchsorted(signature, h[small], side="right")
            text = np.searchsorted(at, small, side="right") - 1
            for t, a, b in zip(text.tolist(), first.tolist(), last.tolist()):
                found.update((t, i) for i in item[a:b].tolist())
        return found

    def search(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, shingles of the item in the text), verified."""
        offsets, codes, distinct = words_of(texts)
        found, last, own = [], None, {}
        for t, i in sorted(self.candidates(offsets, codes, distinct)):
            if t != last:
                last, own = t, {}
                words = [distinct[c] for c in codes[offsets[t]:offsets[t + 1]]]
            width = int(self.width[i])
            if width not in own:
                own[width] = shingles(words, width)
            shared = len(self.shingles[i] & own[width])
            if shared >= self.share * len(self.shingles[i]) - 1e-9:
                found.append((t, i, shared))
        return found


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    """Distinct shingles; none of no words."""
    return set(zip(*(words[k:] for k in range(width)))) if width else set()


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    """Items in blocks of bounded size: lists of (id, text). Items without words are left out."""
    rows = text_rows(items, id_col, text_col)
    words = F.greatest(F.size(F.split("_text", " ")), F.length("_text") / 20)
    total = rows.agg(F.sum(words)).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    block = F.pmod(F.xxhash64("_id", "_text"), F.lit(n))
    for k in range(n):
        found = rows.filter(block == k).collect()
        if found:
            yield [r["_id"] for r in found], [r["_text"] for r in found]


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc id, item id, n_shared, n_item, containment) of every contaminated document and item."""
    rows = text_rows(docs, id_col, text_col)
    kinds = (rows.schema["_id"].dataType.simpleString(),
             items.schema[item_id_col].dataType.simpleString())
    shape = f"_id {kinds[0]}, _item {kinds[1]}, n_shared long, n_item long, containment double"
    answer = docs.sparkSession.createDataFrame([], shape)
    for ids, texts in _blocks(items, item_id_col, item_text_col, block_words):
        def work(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts):
            index = Index(texts, share)
            kind = None
            for part in slices(batches):
                found = index.search(part["_text"])
                kind = kind or pa.array(ids)
                n = [len(index.shingles[i]) for _, i, _ in found]
                shared = [s for _, _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [part["_id"].take(pa.array([t for t, _, _ in found], pa.int64())),
                     kind.take(pa.array([i for _, i, _ in found], pa.int64())),
                     pa.array(shared, pa.int64()), pa.array(n, pa.int64()),
                     pa.array([a / b for a, b in zip(shared, n)], pa.float64())],
                    ["_id", "_item", "n_shared", "n_item", "containment"])

        answer = answer.union(map_arrow(rows, work, shape))
    return answer.withColumnsRenamed({"_id": id_col, "_item": item_id_col})


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE,
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at = docs.columns.index(text_col)
    clean = docs
    for _, texts in _blocks(items, item_id_col, item_text_col, block_words):
        def work(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            index = Index(texts, share)
            for part in slices(batches, at):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[t for t, _, _ in index.search(part.column(at))]] = False
                yield part.filter(pa.array(keep))

        clean = map_arrow(clean, work, docs.schema)
    return clean
