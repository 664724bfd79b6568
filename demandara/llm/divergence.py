"""Source divergence audit: how the terms of each source differ from its language and its siblings.

Chunk factorization. A task cuts its documents into blocks, counts the white-space chunks of every
document and keeps, per block, the distinct chunks and packed counts (document, chunk, times).
Distinct chunks of all blocks then meet by hash and each globally distinct chunk is tokenized
once, as rows come sorted; its terms go back to the blocks that hold it, unless the chunk is its own
only term. A block joins them to its counts, which gives exact distinct documents and occurrences per (language, source, term). What
moves is a row per block and distinct chunk or term, not one per word, and no key occurs more
often than there are blocks, so frequent words and large sources make no hot task.

Contract: null text, language and source are ''. A term is a maximal run of characters that are
ASCII letters or not ASCII; only A to Z are lower-cased. Every row is a document of its own, also
repeated ids. A language keeps the terms in at least ``min_docs`` of its documents. Empty and
blank texts have no terms but their group occurs. An empty table gives no rows. Extra columns are
not read, so their names cannot clash. A text is never cut: one longer than a block is a block.

The pairwise part costs terms times squared sources of a language, and its result has a row for
each ordered pair of sources.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import groups, map_arrow, ragged, split_words

MIN_DOCS = 30
TOP = 50
#: Bytes of text in one block (one text at least). Larger blocks repeat fewer chunks.
BLOCK_BYTES = 16 << 20
#: What separates terms, but for the line feed, which here separates chunks.
SEPARATORS = re.compile(r"[\x00-\x09\x0B-\x40\x5B-\x60\x7B-\x7F]+")
#: A group's place in its language, its documents and its occurrences, within one block.
ENTRY = np.dtype([("i", "<i4"), ("docs", "<i4"), ("n", "<i4")])
TOTAL = np.dtype([("i", "<i8"), ("docs", "<i8"), ("n", "<i8")])


def terms_of(chunks: list[str]) -> list[str]:
    """The terms of every chunk, joined by NUL, which no term holds."""
    text = "\n".join(chunks).encode().lower().decode()  # A-Z only
    return [t.strip("\x00") for t in SEPARATORS.sub("\x00", text).split("\n")]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows gathered to about ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch["_text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        part, done = (size + sizes) // BLOCK_BYTES, 0
        for cut in (np.flatnonzero(np.diff(part, prepend=0)) if batch.num_rows else []):
            # The row that passes the bound opens the next block, unless it would be alone before it.
            if held or cut > done:
                held.append(batch.slice(done, cut - done))
                yield pa.Table.from_batches(held)
            held, done = [], int(cut)
        held.append(batch.slice(done))
        size = int(size + sizes[-1]) % BLOCK_BYTES if batch.num_rows else size
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _planes(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 32 with equal bytes side by side, which compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, n).T).view("<u4")[:, 0].astype(np.int64)


def _zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(l: np.ndarray, i: np.ndarray, sizes: np.ndarray, codes: np.ndarray, times: np.ndarray) -> bytes:
    """Counts of a block: per document its language, group and number of distinct chunks, then
    ascending chunk numbers as steps within the document, and how often each stands there."""
    steps = np.diff(codes, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = codes[starts]
    return _zipped(b"".join([np.array([len(l), len(codes)], "<i8").tobytes(), l.astype("<i8").tobytes(),
                             i.astype("<i8").tobytes(), _planes(sizes), _planes(steps), _planes(times)]))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    """Language and group of every document, then document, chunk and times of every count."""
    raw = memoryview(_unzipped(data))
    docs, n = np.frombuffer(raw[:16], "<i8").tolist()
    at = 16
    l, i = np.frombuffer(raw[at:at + 16 * docs], "<i8").reshape(2, docs)
    at += 16 * docs
    sizes = _numbers(raw[at:at + 4 * docs], docs)
    at += 4 * docs
    steps, times = _numbers(raw[at:at + 4 * n], n), _numbers(raw[at + 4 * n:], n)
    total = np.cumsum(steps)
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], total])[starts]  # what the documents before add up to
    return l, i, np.repeat(np.arange(docs), sizes), total - np.repeat(before, sizes), times


def _reduce(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys ascending and the sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.empty(0, np.int64)
    return [key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)]


def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its number, distinct chunks in order and packed counts."""
    number = TaskContext.get().partitionId() << 32
    for rows in blocks(batches):
        offsets, codes, chunks = split_words(pa.concat_arrays(rows["_text"].chunks))
        order = sorted(range(len(chunks)), key=chunks.__getitem__)
        place = np.empty(len(chunks), np.int64)
        place[order] = np.arange(len(chunks))
        doc = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
        width = max(len(chunks), 1)
        key, times = _reduce(doc * width + place[codes], np.ones(len(codes), np.int64))
        sizes = np.bincount(key // width, minlength=rows.num_rows)
        data = packed(rows["_l"].to_numpy(), rows["_i"].to_numpy(), sizes, key % width, times)
        text = "\n".join(chunks[k] for k in order).encode()
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([_zipped(text)], pa.binary()), pa.array([data], pa.binary())],
            ["block", "chunks", "counts"])
        number += 1


def chunks_of(data: bytes) -> pa.Array:
    text = _unzipped(data).decode()
    return pa.array(text.split("\n") if text else [], pa.string())


def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pos, chunk) for every distinct chunk of every block."""
    for batch in batches:
        for block, data in zip(batch["block"].to_pylist(), batch["chunks"].to_pylist()):
            chunks = chunks_of(data)
            pos = np.arange(len(chunks), dtype=np.int32)
            for a in range(0, len(chunks), 50_000):
                some = chunks[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block, np.int64)), pa.array(pos[a:a + 50_000]), some],
                    ["block", "pos", "chunk"])


def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk in, (block, pos, terms) out; each distinct chunk is tokenized once.

    A chunk that is its own only term gives no row."""
    last, last_terms = None, ""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch["chunk"], run_end_type=pa.int64())
        ends, values = runs.run_ends.to_numpy(), runs.values.to_pylist()
        known = values[0] == last
        terms = ([last_terms] if known else []) + (terms_of(values[known:]) if len(values) > known else [])
        last, last_terms = values[-1], terms[-1]
        which = np.repeat(np.arange(len(terms)), np.diff(ends, prepend=0))
        out = pa.array(terms, pa.string()).take(pa.array(which))
        yield pa.RecordBatch.from_arrays(
            [batch["block"], batch["pos"], out], ["block", "pos", "terms"]).filter(
                pc.not_equal(out, batch["chunk"]))


def join_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks in: counts, and terms by chunk number. (l, term, entries) out."""
    for rows in groups(batches, ["block"]):
        here = pc.is_valid(rows["counts"])
        own = rows.filter(here)
        other = rows.filter(pc.invert(here)).select(["pos", "terms"]).sort_by("pos").combine_chunks()
        del rows, here
        terms = chunks_of(own["chunks"][0].as_py())
        l, i, doc, code, times = unpacked(own["counts"][0].as_py())
        if other.num_rows:
            given = np.zeros(len(terms), bool)
            given[other["pos"].to_numpy()] = True
            terms = pc.replace_with_mask(terms, pa.array(given), pa.concat_arrays(other["terms"].chunks))
        lists = pc.split_pattern(terms, "\x00")
        empty = pc.equal(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)
        n_of = np.where(empty, 0, pc.list_value_length(lists).to_numpy()).astype(np.int64)
        flat = lists.flatten()
        coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
        term_of, names = coded.indices.to_numpy(), coded.dictionary
        if not len(term_of):
            continue
        each = n_of[code]
        term = term_of[ragged((np.cumsum(n_of) - n_of)[code], each)].astype(np.int64)
        t = len(names)
        # Chunks of one document with a common term count it as one document.
        key, n = _reduce(np.repeat(doc, each) * t + term, np.repeat(times, each))
        del terms, lists, flat, coded, term, each, doc, code, times
        groups_, gi = np.unique(np.stack([l, i]), axis=1, return_inverse=True)
        gi = gi.ravel()
        langs, li = np.unique(groups_[0], return_inverse=True)
        group, term = gi[key // t], key % t
        width = groups_.shape[1]
        key, docs, n = _reduce((li.ravel()[group] * t + term) * width + group, np.ones(len(n), np.int64), n)
        yield from _entry_rows(langs, names, key // width, t, groups_[1][key % width], docs, n)


def _entry_rows(li, names, key, t, i, docs, n) -> Iterator[pa.RecordBatch]:
    """Rows (l, term, entries) of sorted (language, term) keys; entries hold the groups."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    entries = np.empty(len(key), ENTRY)
    entries["i"], entries["docs"], entries["n"] = i, docs, n
    for a in range(0, len(first), 50_000):
        some = first[a:a + 50_000]
        end = first[a + 50_000] if a + 50_000 < len(first) else len(key)
        offsets = (np.append(some, end) - some[0]) * ENTRY.itemsize
        data = pa.Array.from_buffers(pa.large_binary(), len(some), [
            None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(entries[some[0]:end].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(li[key[some] // t]), names.take(pa.array(key[some] % t)), data.cast(pa.binary())],
            ["l", "term", "entries"])


def add_up(min_docs: int):
    """Rows sorted by (l, term) in; out, for terms in ``min_docs`` documents, a row per group."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open term's language, name and summed entries
        for batch in batches:
            if not batch.num_rows:
                continue
            l, names = batch["l"].to_numpy(), batch["term"]
            sizes = pc.binary_length(batch["entries"]).to_numpy().astype(np.int64) // ENTRY.itemsize
            entries = np.frombuffer(b"".join(batch["entries"].to_pylist()), ENTRY).astype(TOTAL)
            if held:
                l = np.append(held[0], l)
                names = pa.concat_arrays([pa.array([held[1]], pa.string()), names])
                sizes, entries = np.append(len(held[2]), sizes), np.concatenate([held[2], entries])
            new = np.ones(len(l), bool)
            new[1:] = (l[1:] != l[:-1]) | pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            done, summed = _sum(np.repeat(np.cumsum(new) - 1, sizes), entries)
            place = np.flatnonzero(new)
            open_ = done == len(place) - 1
            held = (l[-1], names[-1].as_py(), summed[open_])
            yield from _kept(l[place], names.take(pa.array(place)), done[~open_], summed[~open_], min_docs)
        if held:
            yield from _kept(np.array([held[0]]), pa.array([held[1]], pa.string()),
                             np.zeros(len(held[2]), np.int64), held[2], min_docs)
    return work


def _sum(term: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = int(entries["i"].max(initial=0)) + 1
    key, docs, n = _reduce(term * width + entries["i"], entries["docs"].astype(np.int64),
                           entries["n"].astype(np.int64))
    out = np.empty(len(key), TOTAL)
    out["i"], out["docs"], out["n"] = key % width, docs, n
    return key // width, out


def _kept(l, names, term, entries, min_docs) -> Iterator[pa.RecordBatch]:
    all_docs = np.bincount(term, entries["docs"], len(l)).astype(np.int64)
    all_n = np.zeros(len(l), np.int64)
    np.add.at(all_n, term, entries["n"])
    ok = all_docs[term] >= min_docs
    term, entries = term[ok], entries[ok]
    if len(term):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (l[term], entries["i"], entries["docs"], entries["n"], all_docs[term],
                                   all_n[term], np.diff(term, prepend=-1) != 0)]
            + [names.take(pa.array(term))],
            ["l", "i", "docs", "n", "lang_docs", "lang_n", "first", "term"])


def _named(docs: DataFrame, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang_col, "lang"), (source_col, "source"))), *more)


def group_numbers(docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, l, i): a language's number and a group's place in its language."""
    found = materialise(_named(docs, lang_col, source_col).distinct()
                        .withColumn("g", F.monotonically_increasing_id()))
    by = W.partitionBy("lang")
    return materialise(found.withColumn("l", F.min("g").over(by)).withColumn(
        "i", F.row_number().over(by.orderBy("source")).cast("long") - 1).drop("g"))


def term_counts(docs: DataFrame, numbers: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang",
                source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Documents and occurrences of every term in at least ``min_docs`` documents of its language.

    (l, i, term, docs, n, lang_docs, lang_n, first) per group that has the term; first marks one
    row of each (language, term). ``numbers`` comes from ``group_numbers``.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")
    rows = _named(docs, lang_col, source_col, text).join(numbers, ["lang", "source"]).select(
        F.col("l").alias("_l"), F.col("i").alias("_i"), "_text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialise(map_arrow(rows, count_chunks, "block long, chunks binary, counts binary"))
    chunks = map_arrow(held.select("block", "chunks"), list_chunks, "block long, pos int, chunk string")
    terms = chunks.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(
        tokenize, "block long, pos int, terms string")
    none = F.lit(None).cast("binary")
    both = held.select("block", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("terms"),
                       "chunks", "counts").union(terms.select("*", none.alias("chunks"), none.alias("counts")))
    entries = both.repartition(n, "block").sortWithinPartitions("block").mapInArrow(
        join_terms, "l long, term string, entries binary")
    return entries.repartition(n, "l", "term").sortWithinPartitions("l", "term").mapInArrow(
        add_up(min_docs), "l long, i long, docs long, n long, lang_docs long, lang_n long, "
        "first boolean, term string")


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(1000000000 * (n + 5) / (total + 5 * kept)) in whole numbers."""
    return (1 + F.expr(f"(cast({n} as decimal(19,0)) + 5) * 1000000000 div "
                       f"(cast({total} as decimal(19,0)) + 5 * {kept})")).cast("long")


def pair_sums(rows: DataFrame) -> DataFrame:
    """(l, i, j, value), i < j: sums of absolute differences over the terms in the rows.

    ``rows`` has, per (language, term), the shares ``base`` of its sources without the term, and
    places ``at`` and shares ``p`` of those with it.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch["l"].to_numpy()
            for l in np.unique(langs).tolist():
                some = batch.filter(pa.array(langs == l))
                base = np.array(some["base"][0].as_py(), np.int64)
                share = np.tile(base, (some.num_rows, 1))
                row = np.repeat(np.arange(some.num_rows), pc.list_value_length(some["at"]).to_numpy())
                share[row, some["at"].flatten().to_numpy()] = some["p"].flatten().to_numpy()
                total = sums.setdefault(l, np.zeros((len(base), len(base)), np.int64))
                for i in range(len(base) - 1):
                    total[i, i + 1:] += np.abs(share[:, i + 1:] - share[:, i:i + 1]).sum(axis=0)
        for l, total in sums.items():
            i, j = np.triu_indices(len(total), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), l, np.int64)), pa.array(i), pa.array(j), pa.array(total[i, j])],
                ["l", "i", "j", "value"])

    return map_arrow(rows, work, "l long, i long, j long, value long").groupBy("l", "i", "j").agg(
        F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang",
               source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each group differs.

    Shares are p = 1 + floor(1e9 (n + 5) / (N + 5 V)), V the terms the language keeps and N the
    group's occurrences of them. Part ``pair`` sums the absolute differences of shares to every
    other source of the language; part ``term`` holds the ``top`` terms with the largest excess
    over the language's own share. Ties go by item. A language that keeps no term has pair
    values of 0 and no terms.
    """
    numbers = group_numbers(docs, lang_col, source_col)
    kept = materialise(term_counts(docs, numbers, min_docs, lang_col, source_col, text_col))
    langs = kept.groupBy("l").agg(F.count_if("first").alias("kept"),
                                  F.sum(F.when(F.col("first"), F.col("lang_n"))).alias("lang_total"))
    info = materialise(
        numbers.join(kept.groupBy("l", "i").agg(F.sum("n").alias("total")), ["l", "i"], "left")
        .join(langs, "l", "left").na.fill(0, ["total", "kept", "lang_total"])
        .withColumn("base", F.when(F.col("kept") > 0, _share("0", "total", "greatest(kept, 1)")).otherwise(0)))
    shares = kept.join(info, ["l", "i"]).select(
        "l", "i", "lang", "source", "term", _share("n", "total", "kept").alias("p"),
        _share("lang_n", "lang_total", "kept").alias("q"))

    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = shares.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by)).filter(
        F.col("rank") <= top)

    bases = info.groupBy("l").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))),
                                              lambda x: x["base"]).alias("base"))
    rows = shares.groupBy("l", "term").agg(F.collect_list(F.struct("i", "p")).alias("e")).select(
        "l", F.col("e.i").alias("at"), F.col("e.p").alias("p")).join(bases, "l")
    sums = pair_sums(rows)
    ends = info.select("l", F.col("source").alias("item"), F.col("i").alias("j"))
    pairs = (info.select("l", "lang", "source", "i").join(ends, "l").filter("i <> j")
             .withColumn("a", F.least("i", "j")).withColumn("b", F.greatest("i", "j"))
             .join(sums.withColumnsRenamed({"i": "a", "j": "b"}), ["l", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce("value", F.lit(0)).alias("value"))
             .withColumn("rank", F.row_number().over(by)))
    return pairs.unionByName(terms)
