"""Token counts by the whole-token shortcut.

A byte-level BPE vocabulary holds most pieces that the pre-tokenizer cuts from a text. Which of
its strings really encode alone as one token is proved once, offline, by merging each of them;
such a string then counts one wherever it stands as a piece of its own. Only the other pieces
go through the merges.

Contract: one row per input row. Null text counts as empty (0 bytes, 0 tokens). Repeated rows
and repeated or null ids give one row each. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_arrow, slices, text_rows

#: The pattern that cuts texts into pieces before the merges.
PIECES = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Merged pieces that a worker remembers before it starts anew.
MEMO = 200_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for 256, 257, ... in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Shortcut:
    """Token counts of texts for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.whole: dict[str, int] = {}
        for string in tokenizer.get_vocab(with_added_tokens=False):
            try:
                piece = bytes(byte_of[c] for c in string).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # not the bytes of a text
            if PIECES.findall(piece) == [piece] and len(self.model.tokenize(string)) == 1:
                self.whole[piece] = 1
        self.cut = regex.compile("|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        self.memo = _Merged(self.merge)

    def merge(self, piece: str) -> int:
        """Tokens of one piece by the merges."""
        letters = self.letters
        return len(self.model.tokenize("".join([letters[b] for b in piece.encode()])))

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of ``text``, and how many of them are whole pieces by the shortcut."""
        parts, special = [text], 0
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            special = len(parts) - 1
        whole, rest = 0, 0
        one, merged = self.whole, self.memo
        for part in parts:
            pieces = PIECES.findall(part)
            left = [p for p in pieces if p not in one]
            whole += len(pieces) - len(left)
            rest += sum(map(merged.__getitem__, left))
        return whole + rest + special, whole


class _Merged(dict):
    """Counts of merged pieces, bounded."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.merge(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


@functools.lru_cache(maxsize=4)
def shortcut(path: str) -> Shortcut:
    """The proved table of a vocabulary file, once per worker process."""
    return Shortcut(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc id, n_bytes, n_tokens, n_whole (pieces counted by the shortcut), over_limit."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shortcut(vocabulary)
        for part in slices(batches):
            counts = [table.count(t) for t in part["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["_bytes"], pa.array([c[0] for c in counts], pa.int64()),
                 pa.array([c[1] for c in counts], pa.int64())],
                ["_id", "n_bytes", "n_tokens", "n_whole"])

    rows = text_rows(docs, id_col, text_col).withColumn(
        "_bytes", F.octet_length("_text").cast("long"))
    kind = rows.schema["_id"].dataType.simpleString()
    counted = map_arrow(rows, work, f"_id {kind}, n_bytes long, n_tokens long, n_whole long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", "n_whole",
                          (F.col("n_tokens") > limit).alias("over_limit"))
