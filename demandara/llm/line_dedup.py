"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit exactly if they are equal, if one is the other without one
character, or if both without the character at the same place are equal. So every line emits its own
hash and the hash of each of its one-character deletions with the place; lines that meet in a
hash are joined, the edit distance is verified on their texts, and the earliest stays.

Only lines that can have such a partner emit deletions: an edit leaves one half of a line
intact, so the partner has the same first or last half and about the same length. This loses no
pair and keeps the neighbourhoods far smaller than the corpus.

Contract: lines end at line feeds and are compared without the spaces around them. A line goes if
an equal line or one within the edit bound stands earlier, by document id (null ids last), then
by line number; the earlier line need not stay itself. Lines of fewer than ``min_chars`` characters
have no edit bound: they go if an equal line stands earlier and they have ``exact_chars`` characters
at least, else they stay, as blank lines do. Rows with the same id and text are one document given twice and get the same
result. Null text stays null and has no lines. An empty table gives no rows. Extra columns are kept,
whatever their names. A text of any length is compared line by line as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import fresh, map_arrow, mix, slices, text_rows, whole_groups
from .bloom import maybe_in

MIN_CHARS = 20
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def variants(line: str) -> np.ndarray:
    """Hash of ``line``, then of the line without its first, second, ... character."""
    c = mix(np.frombuffer(line.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1))
    n = len(c)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), BASE, np.uint64)]))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(c * powers[:n])])
    without = prefix[:-1] + (prefix[-1] - prefix[1:]) * np.uint64(INVERSE)
    length = np.concatenate([[n], np.full(n, n - 1)]).astype(np.uint64)
    return mix(np.concatenate([prefix[-1:], without]) ^ mix(length))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Lines long enough, with document, number and two hashes of the text."""
    rows = text_rows(docs, id_col, text_col).withColumn("_t", F.xxhash64("_text"))
    line = F.trim("line")
    return (rows.select("_id", "_t", F.posexplode(F.split("_text", "\n")).alias("no", "line"))
            .select("_id", "_t", "no", line.alias("line"))
            .filter(F.length("line") >= min_chars)
            .withColumns({"h1": F.xxhash64("line"),
                          "h2": F.xxhash64(F.concat(F.lit("\n"), F.col("line")))}))


def _halves(line: Column) -> Column:
    """Keys that two lines within one edit share at least one of.

    With m the shorter line's length, common prefix and suffix hold m - 1 characters at least
    together, so one of them holds half; a line may be the shorter one or one longer.
    """
    n = F.length(line)
    keys = []
    for m in (n, n - 1):
        h = F.floor((m - 1) / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), h)),
                 F.xxhash64(F.lit(1), m, F.substring(line, n - h + 1, h))]
    return F.array(*keys)


def _place() -> Column:
    """Order of lines: documents by id, null last, equal ids by text, then line numbers."""
    return F.struct(F.isnull("_id").alias("nul"), F.col("_id").alias("id"),
                    F.col("_t").alias("t"), F.col("no").alias("no"))


def _partners(texts: DataFrame) -> DataFrame:
    """(x1, x2, y1, y2): lines x that share a variant with an earlier line y, by their hashes."""
    kind = texts.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "line"):
            found = [variants(t) for t in part["line"].to_pylist()]
            size = np.array([len(v) for v in found])
            row = pa.array(np.repeat(np.arange(len(found)), size))
            place = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), pa.array(place),
                 *[part[c].take(row) for c in ("h1", "h2", "nul", "id", "t", "no")]],
                ["vh", "p", "h1", "h2", "nul", "id", "t", "no"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "vh"):
            table = table.combine_chunks()
            vh, h1 = table["vh"].to_numpy(), table["h1"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(vh)) + 1])
            ends = np.append(starts[1:], len(vh))
            shared = np.minimum.reduceat(h1, starts) != np.maximum.reduceat(h1, starts)
            pairs = []
            for a, b in zip(starts[shared].tolist(), ends[shared].tolist()):
                rows = table.slice(a, b - a).to_pylist()
                rows.sort(key=lambda r: (r["nul"], 0 if r["nul"] else r["id"], r["t"], r["no"]))
                first: dict[int, dict] = {}  # earliest line without the character at a place
                own = next((k for k, r in enumerate(rows) if r["p"] < 0), None)
                for k, r in enumerate(rows):
                    # Lines without the same place are all within one edit of each other.
                    y = first.setdefault(r["p"], r)
                    if y is not r:
                        pairs.append((r, y))
                    if own is not None and r["p"] >= 0:  # the whole line and one character more
                        pairs.append((r, rows[own]) if own < k else (rows[own], r))
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k][h] for p in pairs], pa.int64())
                     for k in (0, 1) for h in ("h1", "h2")], ["x1", "x2", "y1", "y2"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = map_arrow(texts, emit, "vh long, p int, h1 long, h2 long, nul boolean, "
                                     f"id {kind}, t long, no int")
    dealt = emitted.repartition(n, "vh").sortWithinPartitions("vh")
    return dealt.mapInArrow(meet, "x1 long, x2 long, y1 long, y2 long").filter(
        "x1 <> y1 or x2 <> y2").distinct()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                   text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """(_id, _t, _gone): per document (id and hash of the text) the numbers of lines that go."""
    least = min_chars if exact_chars is None else max(1, min(exact_chars, min_chars))
    # A line without keys meets no line but its equals.
    keys = F.when(F.length("line") >= min_chars, _halves(F.col("line")))
    lines = materialise(_lines(docs, id_col, text_col, least).withColumn("keys", keys).drop("line"))
    first = materialise(lines.groupBy("h1", "h2").agg(F.min(_place()).alias("place"),
                                                      F.first("keys").alias("keys")))
    keyed = first.select("h1", "h2", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    alike = keyed.join(met, "key", "left_semi").select("h1", "h2").distinct()
    maybe = materialise(first.join(alike, ["h1", "h2"], "left_semi").select(
        "h1", "h2", "place.*"))
    # A candidate's text is fetched from its first place, which is one row. Few lines are
    # candidates: the others are kept out of the shuffle.
    whole = maybe_in(_lines(docs, id_col, text_col, min_chars).drop("h2"), "h1",
                     maybe.select("h1")).drop("h1")
    texts = materialise(maybe.join(
        whole, maybe["id"].eqNullSafe(whole["_id"]) & (maybe["t"] == whole["_t"])
        & (maybe["no"] == whole["no"])).select(maybe["*"], "line").distinct())
    x = texts.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("line").alias("xl"))
    y = texts.select(F.col("h1").alias("y1"), F.col("h2").alias("y2"), F.col("line").alias("yl"))
    near = (_partners(texts).join(x, ["x1", "x2"]).join(y, ["y1", "y2"])
            .filter(F.levenshtein("xl", "yl") <= 1)
            .select(F.col("x1").alias("h1"), F.col("x2").alias("h2")).distinct()
            .withColumn("near", F.lit(True)))
    judged = first.select("h1", "h2", "place").join(near, ["h1", "h2"], "left")
    gone = lines.join(judged, ["h1", "h2"]).filter(
        F.col("near") | ~_place().eqNullSafe(F.col("place")))
    return gone.groupBy("_id", "_t").agg(F.collect_set("no").alias("_gone"))


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                    text_col: str = "text", counts: bool = False,
                    exact_chars: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; all columns and rows stay.

    ``counts`` adds n_lines and n_removed, with underscores after names that are taken. ``exact_chars`` is the floor of exact repeats
    (``min_chars`` where not given).
    """
    gone = repeated_lines(docs, min_chars, id_col, text_col, exact_chars)
    text, hashed = F.col(f"`{text_col}`").cast("string"), fresh(docs, "_key")
    joined = docs.withColumn(hashed, F.xxhash64(F.coalesce(text, F.lit("")))).join(
        gone, docs[f"`{id_col}`"].eqNullSafe(gone["_id"]) & (F.col(hashed) == gone["_t"]), "left")
    text = docs[f"`{text_col}`"].cast("string")
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone["_gone"])
    shorter = F.array_join(F.transform(stay, lambda k: F.get(parts, k)), "\n")
    result = F.when(gone["_gone"].isNull(), text).otherwise(shorter)
    columns = [result.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns]
    if counts:
        columns += [F.coalesce(F.size(parts), F.lit(0)).cast("long").alias(fresh(docs, "n_lines")),
                    F.coalesce(F.size(gone["_gone"]), F.lit(0)).cast("long").alias(fresh(docs, "n_removed"))]
    return joined.select(*columns)
