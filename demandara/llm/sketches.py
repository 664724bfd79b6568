"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's word shingles. The sketch of a
union is the k smallest of both sketches, so sketches of parts merge into that of the whole, and
two of them estimate resemblance, containment and the number of distinct shingles. Sketches
with fewer than k hashes are complete, and what they say is exact.

Contract: words are lower-cased and stand between white space; a text of fewer words than the
shingle is one shingle, a text without words (null: empty) has the empty sketch. Two empty
sketches resemble each other fully, an empty and another one not at all. Equal texts have equal
sketches. Repeated rows give one row each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import groups, map_arrow, mix, slices, split_words, text_rows

K = 128
WORDS = 5


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text and the hashes of all word shingles, in order, repeats included."""
    return hashes_of(*split_words(pc.utf8_lower(texts)), words)


def hashes_of(offsets: np.ndarray, codes: np.ndarray, distinct: list[str], words: int
              ) -> tuple[np.ndarray, np.ndarray]:
    """The same from words that are split already."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    h = each[codes] if len(codes) else np.empty(0, np.uint64)
    n = np.diff(offsets)
    size = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    # Terms by place; a term past its text's end counts nothing (texts shorter than a shingle).
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    place = np.arange(len(h))
    ends = np.repeat(offsets[1:], n)
    total = np.zeros(len(h), np.uint64)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(words):
        total += np.where(place + k < ends, padded[k:k + len(h)], np.uint64(0)) * factors[k]
    first = place - np.repeat(offsets[:-1], n) < np.repeat(size, n)
    return np.concatenate([[0], np.cumsum(size)]), mix(total[first])


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b), both)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    if len(b) >= k:
        a = a[a <= b[-1]]
    if not len(a):
        return 1.0 if not len(b) else 0.0
    return len(np.intersect1d(a, b)) / len(a)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) * 2.0 ** 64 / float(int(a[-1]) + 1)


def pack(a: np.ndarray) -> str:
    """Text form: base64 of the hashes as big-endian numbers."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def sketches(texts: pa.Array, words: int, k: int) -> list[np.ndarray]:
    offsets, h = shingle_hashes(texts, words)
    return [sketch(h[a:b], k) for a, b in zip(offsets, offsets[1:])]


def fingerprint(docs: DataFrame, words: int = WORDS, k: int = K, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc id, fingerprint and n_distinct (estimated) per row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = sketches(part["_text"], words, k)
            yield pa.RecordBatch.from_arrays(
                [part["_id"], pa.array([pack(s) for s in made]),
                 pa.array([distinct_count(s, k) for s in made])],
                ["_id", "fingerprint", "n_distinct"])

    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    return map_arrow(rows, work, f"_id {kind}, fingerprint string, n_distinct double"
                     ).withColumnRenamed("_id", id_col)


def merged(prints: DataFrame, key: Column, k: int = K) -> DataFrame:
    """(key, fingerprint, n_distinct) of the union of all rows' fingerprints with the same key.

    ``key`` becomes text; null keys form a group of their own. Tasks merge what they read before
    the shuffle, and a group then gets a row or so from each task.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch["_key"].to_pylist(), batch["fingerprint"].to_pylist()):
                new = unpack(text or "")
                held[name] = merge(held[name], new, k) if name in held else new
                if len(held) >= 10_000:
                    yield _rows(held)
                    held = {}
        yield _rows(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["_key"]):
            total = np.empty(0, np.uint64)
            for text in group["fingerprint"].to_pylist():
                total = merge(total, unpack(text), k)
            yield _rows({group["_key"][0].as_py(): total})

    def _rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([pack(s) for s in held.values()], pa.string()),
             pa.array([distinct_count(s, k) for s in held.values()], pa.float64())],
            ["_key", "fingerprint", "n_distinct"])

    shape = "_key string, fingerprint string, n_distinct double"
    rows = prints.select(F.concat(F.when(key.isNull(), "0").otherwise("1"),
                                  F.coalesce(key.cast("string"), F.lit(""))).alias("_key"),
                         "fingerprint")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = map_arrow(rows, partial, shape).repartition(n, "_key").sortWithinPartitions("_key")
    done = parts.mapInArrow(whole, shape)
    return done.select(F.when(F.col("_key") != "0", F.expr("substring(_key, 2)")).alias("key"),
                       "fingerprint", "n_distinct")


def next_documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows dealt so that a bucket holds neighbouring ids and, as guest, what follows its last.

    The bucket borders are ids of the table, found by one approximate-quantile aggregate, so
    the document after a bucket's last is known without looking at it, and whole texts move once.
    Repeated ids are ordered by text, null ids come first. The id must be an integer.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / n for k in range(1, n)] or [0.5]
    found = rows.agg(F.percentile_approx("_id", F.lit(cuts), 10_000).alias("cuts"),
                     F.min("_id").alias("least"), F.count_if(F.isnull("_id")).alias("nulls")).first()
    # At most one border per shuffle partition reaches the driver.
    borders = sorted(set(found["cuts"] or []) - ({found["least"]} if not found["nulls"] else set()))
    last = len(borders)
    if borders:
        at = F.lit(borders)
        powers = [2 ** p for p in range(last.bit_length() - 1, -1, -1)]
        # Binary search: how many borders are no larger than the id.
        bucket = F.aggregate(F.lit(powers), F.lit(0), lambda pos, p: F.when(
            (pos + p <= last) & (F.get(at, pos + p - 1) <= F.col("_id")), pos + p).otherwise(pos))
        starts = F.col("_id").isin(borders)
    else:
        bucket, starts = F.lit(0), F.lit(False)
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    first = F.isnull("_id") if found["nulls"] else F.col("_id") == F.lit(found["least"])
    spots = F.array_compact(F.array(
        F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest")),
        F.when(F.coalesce(starts, F.lit(False)),
               F.struct((F.col("_bucket") - 1).alias("b"), F.lit(True).alias("guest"))),
        F.when(first, F.struct(F.lit(last).alias("b"), F.lit(True).alias("guest")))))
    dealt = rows.select("_id", "_text", F.explode(spots).alias("_s")).select(
        "_id", "_text", F.col("_s.b").alias("_bucket"), F.col("_s.guest").alias("_guest"))
    return (dealt.repartition(n, "_bucket")
            .sortWithinPartitions("_bucket", "_guest", "_id", "_text")), last


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, words: int = WORDS, k: int = K, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    doc id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    (the following document), in_next (share of its shingles there) and n_distinct. After the
    last document comes the first; a single document follows itself.
    """
    dealt, _ = next_documents(docs, id_col, text_col)
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next", "in_next", "n_distinct"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        """Ids, texts and following texts; only the row before is held over a slice's end."""
        held = None
        for part in slices(batches):
            ids, texts, follow = [], [], []
            for row in zip(*(part[c].to_pylist() for c in ("_bucket", "_guest", "_id", "_text"))):
                if held is not None and held[0] == row[0] and not held[1]:
                    ids.append(held[2])
                    texts.append(held[3])
                    follow.append(row[3])
                held = row
            if ids:
                yield ids, texts, follow

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, follow in pairs(batches):
            # A document's follower is mostly the next row: its sketch is made once.
            new = [edited(t, f) for t, f in zip(texts, follow)]
            chain = [*texts]
            at = []
            for j, f in enumerate(follow):
                if j + 1 < len(texts) and f is texts[j + 1]:
                    at.append(j + 1)
                else:
                    at.append(len(chain))
                    chain.append(f)
            own = sketches(pa.array(chain, pa.string()), words, k)
            made = sketches(pa.array(new, pa.string()), words, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                 pa.array([pack(own[j]) for j in range(len(texts))]),
                 pa.array([pack(s) for s in made]),
                 pa.array([resemblance(own[j], made[j], k) for j in range(len(texts))]),
                 pa.array([resemblance(own[j], own[at[j]], k) for j in range(len(texts))]),
                 pa.array([containment(own[j], own[at[j]], k) for j in range(len(texts))]),
                 pa.array([distinct_count(own[j], k) for j in range(len(texts))])], names)

    done = map_arrow(dealt, work, "_id long, n_chars long, edited_sha256 string, "
                     "fingerprint string, edited_fingerprint string, near_edited double, "
                     "near_next double, in_next double, n_distinct double")
    return done.withColumnRenamed("_id", id_col)
