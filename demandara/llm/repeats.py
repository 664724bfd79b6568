"""Removal of long repeated byte strings with a logarithmic family of sampled suffix arrays.

Any string of ``length`` bytes holds a chosen anchor, the leftmost smallest hash among its grams, and equal
strings choose it at the same place. Only suffixes that start at an anchor are indexed (about
two in every 170 bytes), ordered by the hash of their first bytes, which brings equal ones together
just as alphabetical order does. A batch's sorted array is merge-scanned against every existing level
for anchors that both have, then becomes a level of its own; two levels of the same size merge
into one of the next, so a family of n batches has about log n levels.

This is done twice. The first family (``SuffixFamily``) holds the hashes alone: anchors that occur once in the whole table
can't be in a repeated string and are done with. For the others, the stretch of all windows that
choose the anchor is compared: stretches that are equal as a whole are repeated as a whole, which settles
copies at once. What is left goes through the second family (``SuffixArrays``), whose levels
hold the suffixes with their bytes: they are put in byte order, and the lengths of the matches
of neighbours, from the anchor on and back from it, say which strings of ``length`` bytes two of them
share. Anchors with very many distinct stretches are resolved by grouped counts of window hashes over
the cluster instead of in one task.

Contract: texts are UTF-8 bytes, null is empty; matches never cross documents; overlapping matches count,
also within a document; everything is judged on the input. Copies repeat each other, also rows
repeated whole. One row per input row; null ids stay. Whole texts and whole stretches are equal if their
hashes of 128 bits are (a stretch: 64 of its anchor's first bytes, 64 of all), windows of crowded anchors if those
of 64 bits are; other windows are compared byte by byte.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release
from .arrow import map_arrow, mix, ragged, slices, text_rows, whole_groups
from .bloom import maybe_in

LENGTH = 200
GRAM = 32
BATCHES = 4
#: Bytes hashed at a time; longer texts are cut into overlapping parts.
PART = 1 << 20
#: Distinct stretches of one anchor above which the cluster counts its windows; as many take some
#: tens of megabytes in a task.
CROWDED = 20_000
BASE = 0xD1342543DE82EF95  # odd
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of the base and of its inverse."""
    n = PART + 4 * LENGTH + 1

    def powers(base: int) -> np.ndarray:
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        return np.cumprod(p)

    return mix(np.arange(1, 257, dtype=np.uint64)), powers(BASE), powers(INVERSE)


class Hashes:
    """Hashes of any stretch of a buffer of at most a part's size."""

    def __init__(self, data: bytes):
        values, up, self.down = _tables()
        b = np.frombuffer(data, dtype=np.uint8)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(values[b] * up[:len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start]
                   ^ mix((end - start).astype(np.uint64)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` neighbours."""
    m = len(x) - w + 1
    rows = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows[:len(x)] = x
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[w - 1:w - 1 + m])


def stretches(data: bytes, ends: np.ndarray, length: int, gram: int):
    """Stretches of windows of a buffer that choose the same anchor.

    ``ends`` holds each window start's document end. Returns first and last window start,
    the anchor's hash and the hash of the bytes of all its windows.
    """
    first, last, _, key, whole = anchored(data, ends, length, gram)
    return first, last, key, whole


def anchored(data: bytes, ends: np.ndarray, length: int, gram: int):
    """As ``stretches``, with the anchor's place after the first window starts."""
    nothing = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if len(data) < length:
        return nothing
    h = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = h.of(at, at + gram)
    low = np.uint64((1 << 24) - 1)
    anchor = (sliding_min(grams & ~low | at.astype(np.uint64), length - gram + 1) & low
              ).astype(np.int64)
    start = np.arange(len(anchor))
    good = start + length <= ends[:len(anchor)]
    start, anchor, end = start[good], anchor[good], ends[:len(good)][good]
    if not len(start):
        return nothing
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(end) != 0)) + 1
    first = start[np.concatenate([[0], cut])]
    last = start[np.concatenate([cut - 1, [len(start) - 1]])]
    chosen = anchor[np.concatenate([[0], cut])]
    whole = mix(h.of(first, last + length) ^ (chosen - first).astype(np.uint64))
    return first, last, chosen, grams[chosen], whole


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of a bounded size: bytes, end of the document at each place, row and shift there."""
    held, rows, shifts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 0), PART):
            piece = text[a:a + PART + length - 1]
            if held and size + len(piece) > PART:
                yield _joined(held, rows, shifts)
                held, rows, shifts, size = [], [], [], 0
            held.append(piece)
            rows.append(row)
            shifts.append(a)
            size += len(piece)
    if held:
        yield _joined(held, rows, shifts)


def _joined(held, rows, shifts):
    sizes = np.array([len(x) for x in held])
    ends = np.cumsum(sizes)
    return (b"".join(held), np.repeat(ends, sizes), np.repeat(rows, sizes),
            np.repeat(np.array(shifts) - (ends - sizes), sizes))


def suffixes(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, whole, tid, p0, p1, at): stretches of every text of ``texts`` (tid, _bytes).

    ``at`` is the anchor's place in the stretch.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_bytes"):
            for data, ends, rows, shifts in _parts(part["_bytes"].to_pylist(), length):
                first, last, chosen, key, whole = anchored(data, ends, length, gram)
                shift = shifts[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)),
                     part["tid"].take(pa.array(rows[first])),
                     pa.array((first + shift).astype(np.int32)),
                     pa.array((last + shift).astype(np.int32)),
                     pa.array((chosen - first).astype(np.int32))],
                    ["key", "whole", "tid", "p0", "p1", "at"])

    return map_arrow(texts, work, "key long, whole long, tid binary, p0 int, p1 int, at int")


class SuffixFamily:
    """Levels of sorted anchor keys with their counts."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (doublings, level), largest first
        self.written: list[DataFrame] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Index the keys of a batch's suffixes and return those that occur at least twice so far.

        Equal-sized levels left by earlier batches merge first, so that one scan reads each.
        """
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + 1, _sorted(a.union(b).groupBy("key").agg(
                F.sum("n").alias("n")))))
            self.written.append(self.levels[-1][1])
        run = _sorted(batch.groupBy("key").agg(F.count("*").alias("n")))
        found = run.filter("n > 1").select("key")
        for _, level in self.levels:
            found = found.union(run.join(level, "key", "left_semi").select("key"))
        self.levels.append((0, run))
        self.written.append(run)
        return found


def _sorted(level: DataFrame) -> DataFrame:
    return materialise(level.sortWithinPartitions("key"))


def _windows(batch: pa.RecordBatch | pa.Table, length: int):
    """Row, place in the row's bytes and hash of every window of rows of bytes."""
    held = batch["bytes"].to_pylist()
    row, place, h, a = [], [], [], 0
    while a < len(held):
        b, size = a, 0
        while b < len(held) and (b == a or size + len(held[b]) <= PART):
            size += len(held[b])
            b += 1
        sizes = np.array([len(x) for x in held[a:b]])
        starts = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        at = ragged(starts, n)
        own = np.repeat(np.arange(a, b), n)
        row.append(own)
        place.append(at - np.repeat(starts, n))
        h.append(Hashes(b"".join(held[a:b])).of(at, at + length))
        a = b
    return np.concatenate(row), np.concatenate(place), np.concatenate(h)


def _sides(table: pa.Table, length: int, gram: int):
    """Bytes from the anchor on and, backwards, before it, one row per stretch, padded with zeros."""
    held = table["bytes"].to_pylist()
    sizes = np.array([len(x) for x in held])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(held), dtype=np.uint8)
    anchor = (ends - sizes + table["at"].to_numpy())[:, None]
    on = anchor + np.arange(length)
    back = anchor - 1 - np.arange(max(length - gram, 1))
    return (np.where(on < ends[:, None], data[np.minimum(on, len(data) - 1)], np.uint8(0)),
            np.where(back >= (ends - sizes)[:, None], data[np.maximum(back, 0)], np.uint8(0)), sizes)


def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte order of ``rows`` and how many bytes each has in common with the one before."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], common])


def _classes(order: np.ndarray, common: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Per row and least match length: a number that rows with so long a match share."""
    place = np.arange(len(order))[:, None]
    run = np.maximum.accumulate(np.where(common[:, None] < least, place, 0), axis=0)
    out = np.empty_like(run)
    out[order] = run
    return out


def matches(table: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte order of a table's suffixes, and which windows of each are repeated.

    The table has bytes, at (the anchor's place in them) and fresh. Windows are told apart by how many bytes
    they begin before the anchor; one is marked where an equal one, or it itself, is fresh.
    """
    on, back, sizes = _sides(table, length, gram)
    order, common = in_order(on)
    back_order, back_common = in_order(back)
    at, fresh = table["at"].to_numpy(), table["fresh"].to_numpy()
    n = len(at)
    marked = np.zeros((n, length - gram + 1), dtype=bool)
    step = max(1, (1 << 20) // n)
    for a in range(0, marked.shape[1], step):
        before = np.arange(a, min(a + step, marked.shape[1]))
        inside = (before <= at[:, None]) & (before >= (at - sizes + length)[:, None])
        code = (_classes(order, common, length - before) * n
                + _classes(back_order, back_common, before)) * len(before) + before - a
        _, which, counts = np.unique(code[inside], return_inverse=True, return_counts=True)
        row = np.nonzero(inside)[0]
        new = np.bincount(which, weights=fresh[row], minlength=len(counts)) > 0
        marked[:, a:a + len(before)][inside] = ((counts > 1) & new)[which]
    return order, marked


class SuffixArrays:
    """Levels of suffixes in byte order, with the bytes of their stretches.

    Rows have key, tid, p0, at, single (occurs once) and bytes.
    """

    ROW = "key long, tid binary, p0 int, at int, single boolean, bytes binary"

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self.levels: list[tuple[int, DataFrame]] = []  # (doublings, level), largest first
        self.written: list[DataFrame] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch and return (tid, s, e): windows of single stretches that are repeated so far,
        as far as the batch has a part in it.

        One scan reads the batch and all levels, in byte order. Equal-sized levels left by earlier batches
        come out of it as one.
        """
        columns = [c.split()[0] for c in self.ROW.split(", ")]
        merges = len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]
        read = batch.select(*columns, F.lit(True).alias("fresh"), F.lit(2).alias("kind"))
        for k, (_, level) in enumerate(self.levels):
            kind = 1 if merges and k >= len(self.levels) - 2 else -1  # not written again
            read = read.union(level.select(*columns, F.lit(False), F.lit(kind)))
        n = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        swept = materialise(map_arrow(read.repartition(n, "key").sortWithinPartitions("key"),
                                      self._scan(), f"{self.ROW}, s int, e int, kind int"), ["kind"])
        self.written.append(swept)
        if merges:
            doublings = self.levels[-1][0] + 1
            self.levels[-2:] = [(doublings, swept.filter("kind = 1").select(*columns))]
        self.levels.append((0, swept.filter("kind = 2").select(*columns)))
        return swept.filter("kind = 0").select("tid", "s", "e")

    def _scan(self):
        length, gram = self.length, self.gram

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, "key"):
                table = table.combine_chunks()
                # Rows of equal texts bring the same stretch.
                once = {x: k for k, x in enumerate(zip(
                    table["key"].to_pylist(), table["tid"].to_pylist(), table["p0"].to_pylist()))}
                if len(once) < table.num_rows:
                    table = table.take(pa.array(sorted(once.values()))).combine_chunks()
                order, marked = matches(table, length, gram)
                n, kind = table.num_rows, table["kind"].to_numpy()[order]
                none = pa.nulls(n, pa.int32())
                rows = table.select(["key", "tid", "p0", "at", "single", "bytes"]).take(pa.array(order))
                yield from (rows.append_column("s", none).append_column("e", none)
                            .append_column("kind", pa.array(kind, pa.int32()))
                            .filter(pa.array(kind > 0)).to_batches())
                # Runs of neighbouring windows make one span.
                marked &= table["single"].to_numpy()[:, None]
                edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                row, low = np.nonzero(edge == 1)
                high = np.nonzero(edge == -1)[1] - 1
                anchor = (table["p0"].to_numpy() + table["at"].to_numpy())[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(row), pa.int64()), table["tid"].combine_chunks().take(pa.array(row)),
                     *[pa.nulls(len(row), t) for t in (pa.int32(), pa.int32(), pa.bool_(), pa.binary())],
                     pa.array((anchor - high).astype(np.int32)),
                     pa.array((anchor - low + length).astype(np.int32)),
                     pa.array(np.zeros(len(row), np.int32))],
                    ["key", "tid", "p0", "at", "single", "bytes", "s", "e", "kind"])

        return scan


def _resolve(cut: DataFrame, length: int, gram: int, batches: int) -> DataFrame:
    """(tid, s, e): repeated windows among the distinct stretches of the same anchor.

    ``cut`` has key, tid, p0, at, single (occurs once), crowded and the stretch's bytes.
    """
    family, found = SuffixArrays(length, gram), None
    few = cut.filter("not crowded")
    for k in range(batches):
        spans = family.add(few.filter(F.pmod(F.xxhash64("tid"), F.lit(batches)) == k))
        found = spans if found is None else found.union(spans)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "bytes"):
            row, place, h = _windows(part, length)
            h ^= mix(part["key"].to_numpy().view(np.uint64))[row]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), part["tid"].take(rows), part["single"].take(rows),
                 pa.array((part["p0"].to_numpy()[row] + place).astype(np.int32))],
                ["h", "tid", "single", "s"])

    windows = materialise(map_arrow(cut.filter("crowded").dropDuplicates(["key", "tid", "p0"]), apart,
                                    "h long, tid binary, single boolean, s int"))
    twice = windows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    large = (windows.filter("single").join(twice, "h", "left_semi")
             .select("tid", "s", (F.col("s") + length).cast("int").alias("e")))
    spans = materialise(found.union(large).distinct())
    for table in family.written:
        release(table)
    return spans


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one each, in order."""
    found: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if found and s <= found[-1][1]:
            found[-1] = (found[-1][0], max(e, found[-1][1]))
        else:
            found.append((s, e))
    return found


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   batches: int = BATCHES, hashed: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc id, n_bytes, spans (removed: array of s, e) and kept (the remaining bytes) per row.

    With ``hashed``, kept is the SHA-256 of the remaining bytes, so that they are not written.
    """
    give = (lambda b: hashlib.sha256(b).digest()) if hashed else (lambda b: b)
    rows = text_rows(docs, id_col, text_col)
    binary = F.col("_text").cast("binary")
    texts = rows.select("_id", F.unhex(F.md5(binary)).alias("tid"), binary.alias("_bytes"))
    found = materialise(suffixes(texts.select("tid", "_bytes"), length, gram).withColumn(
        "_batch", F.pmod(F.xxhash64("tid"), F.lit(batches)).cast("int")))
    family, keys = SuffixFamily(), None
    for k in range(batches):
        again = family.add(found.filter(F.col("_batch") == k))
        keys = again if keys is None else keys.union(again)
    keys = materialise(keys.distinct())
    for table in family.written:
        release(table)
    # Most anchors occur once: they are kept out of the shuffle.
    repeated = materialise(maybe_in(found.drop("_batch"), "key", keys)
                           .join(keys, "key", "left_semi"))
    release(found)
    release(keys)

    stats = materialise(repeated.groupBy("key", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("tid", "p0", "p1", "at")).alias("one")))
    several = stats.groupBy("key").agg(F.count("*").alias("d")).filter("d > 1")
    open_ = stats.join(several, "key").select(
        "one.*", "key", F.when(F.col("n") > 1, "partner").otherwise("single").alias("role"),
        (F.col("d") > CROWDED).alias("crowded"))
    full = repeated.join(stats.filter("n > 1").select("key", "whole"), ["key", "whole"],
                         "left_semi").select(
        "tid", "p0", "p1", F.lit(0).alias("at"), F.lit(0).cast("long").alias("key"), F.lit("full").alias("role"),
        F.lit(False).alias("crowded"))
    by_text = open_.union(full).groupBy("tid").agg(F.collect_set(F.struct(
        "p0", "p1", "at", "key", "role", "crowded")).alias("marks"))

    kind = rows.schema["_id"].dataType.simpleString()
    span, done = "array<struct<s:int,e:int>>", "n_bytes long, kept binary"

    def settle(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without open stretches get their result, the others keep their bytes."""
        for part in slices(batches_, "_bytes"):
            out = []
            for text, marks in zip(part["_bytes"].to_pylist(), part["marks"].to_pylist()):
                marks = marks or []
                spans = merged_spans([(m["p0"], m["p1"] + length) for m in marks
                                      if m["role"] == "full"])
                cut = [{"key": m["key"], "p0": m["p0"], "at": m["at"], "single": m["role"] == "single",
                        "crowded": m["crowded"], "bytes": text[m["p0"]:m["p1"] + length]}
                       for m in marks if m["role"] != "full"]
                waits = any(c["single"] for c in cut)
                out.append((len(text), [{"s": s, "e": e} for s, e in spans], cut, waits,
                            text if waits else give(_rest(text, spans))))
            n, spans, cut, waits, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["tid"], pa.array(n, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                 pa.array(cut, pa.list_(pa.struct([
                     ("key", pa.int64()), ("p0", pa.int32()), ("at", pa.int32()), ("single", pa.bool_()),
                     ("crowded", pa.bool_()), ("bytes", pa.binary())]))),
                 pa.array(waits, pa.bool_())],
                ["_id", "tid", "n_bytes", "kept", "spans", "cut", "waits"])

    settled = map_arrow(
        texts.join(by_text, "tid", "left").select("_id", "tid", "_bytes", "marks"), settle,
        f"_id {kind}, tid binary, {done}, spans {span}, cut array<struct<key:long,p0:int,at:int,"
        "single:boolean,crowded:boolean,bytes:binary>>, waits boolean")
    settled = materialise(settled)
    release(repeated)
    release(stats)
    cut = (settled.filter(F.size("cut") > 0).select("tid", F.explode("cut").alias("c"))
           .select("tid", "c.*"))
    return _finish(settled, _resolve(cut, length, gram, batches), id_col, kind, give)


def _finish(settled: DataFrame, found: DataFrame, id_col: str, kind: str, give) -> DataFrame:
    more = found.groupBy("tid").agg(F.collect_set(F.struct("s", "e")).alias("more"))
    waiting = settled.filter("waits").select("_id", "tid", "n_bytes", "kept", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for part in slices(batches, "kept"):
            spans, kept = [], []
            for text, a, b in zip(*(part[c].to_pylist() for c in ("kept", "spans", "more"))):
                both = merged_spans([(x["s"], x["e"]) for x in [*a, *(b or [])]])
                spans.append([{"s": s, "e": e} for s, e in both])
                kept.append(give(_rest(text, both)))
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["n_bytes"], pa.array(kept, pa.binary()),
                 pa.array(spans, shape)], ["_id", "n_bytes", "kept", "spans"])

    ended = map_arrow(waiting.join(more, "tid", "left").select(
        "_id", "n_bytes", "kept", "spans", "more"), finish,
        f"_id {kind}, n_bytes long, kept binary, spans array<struct<s:int,e:int>>")
    ready = settled.filter("not waits").select("_id", "n_bytes", "kept", "spans")
    return ready.union(ended).withColumnRenamed("_id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Removed bytes, number of spans and the hash of what is kept, from hashed rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select(id_col, "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"),
                        F.lower(F.hex("kept")).alias("kept_sha256"))
