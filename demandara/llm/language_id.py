"""Language identification by rank-order profiles.

A language's profile is the order of its most frequent n-grams (one to three characters of
letters, with word ends). A document's own order is compared with each profile: an n-gram's
out-of-place distance is how many ranks it is off, or the profile's size where it is missing; the
language with the smallest sum wins.

Contract: one row per row. Null texts and texts without a letter are ``und`` with score zero, as
is every text where nothing was learned. Rows with null language teach nothing. The score is
the margin to the second language (with one language learned: the likeness to it). Ties go
to the language first in order. Null ids are never held out. Repeated rows give one row each.

``identified`` rejects by the distance itself: a text whose mean out-of-place distance to its
nearest profile is over that language's limit (``limits``) is foreign or no language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import map_arrow, slices, text_rows

#: N-grams in a profile, and about how many labelled documents of a language teach it (chosen by
#: a hash of the id; all of them where there are fewer).
PROFILE = 400
TEACHERS = 10_000
UNKNOWN = "und"
SPACE = 32
#: Share of a language's own documents that its limit is drawn from, steps of the distance, and how many
#: documents the limit of all languages together counts in the limit of one.
OWN = 0.999
STEPS = 1000
OWN_LIMIT = 1000


def held_out(id_col: str) -> Column:
    """Documents that never teach."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one cleaned text (single spaces around words) and their counts.

    An n-gram is its code points in 21 bits each; a space stands at its ends only.
    """
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = c[:-1] | c[1:] << 21
    triples = pairs[:-1] | c[2:] << 42
    return np.unique(np.concatenate([c[c != SPACE], pairs, triples[c[1:-1] != SPACE]]),
                     return_counts=True)


def clean(texts: pa.Array) -> list[str]:
    """Lower-case letters with a space around every word; empty without letters."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    return [f" {t.strip(' ')} " if t.strip(" ") else "" for t in plain.to_pylist()]


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Most frequent n-grams first, ties by code."""
    if len(grams) > size:
        least = -np.partition(-counts, size - 1)[size - 1]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


def learn(docs: DataFrame, teachers: int = TEACHERS, size: int = PROFILE, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles by language from the labelled documents that aren't held out.

    Counts are summed in Spark; one count and ``size`` rows per language reach the driver. Texts
    are counted where they are read: only n-gram counts move.
    """
    taught = docs.filter(F.col(f"`{lang_col}`").isNotNull() & ~held_out(id_col)).select(
        F.col(f"`{id_col}`").alias("_key"), F.col(f"`{lang_col}`").cast("string").alias("_lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    there = {r["_lang"]: r["_n"] for r in
             taught.groupBy("_lang").agg(F.count("*").alias("_n")).collect()}
    if not there:
        return {}
    n = F.element_at(F.create_map(*[F.lit(x) for kv in there.items() for x in kv]), F.col("_lang"))
    draw = F.pmod(F.xxhash64("_key"), F.lit(1_000_000))
    chosen = taught.filter(draw * n < 1_000_000 * teachers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lang = np.array(part["_lang"].to_pylist(), dtype=object)
            texts = clean(part["_text"])
            for one in sorted(set(lang)):
                found = [ngrams(texts[k]) for k in np.flatnonzero(lang == one)]
                grams, where = np.unique(np.concatenate([f[0] for f in found]),
                                         return_inverse=True)
                n = np.bincount(where, np.concatenate([f[1] for f in found]), len(grams))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(grams), pa.string()), pa.array(grams),
                     pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = map_arrow(chosen.select("_lang", "_text"), work, "lang string, gram long, n long")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = (counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            .withColumn("rank", rank).filter(F.col("rank") <= size)
            .select("lang", "rank", "gram").collect())
    profiles: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, dtype=np.int64) for lang, grams in profiles.items()}


class Profiles:
    """Profiles ready for comparison."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(profiles), size
        self.sorted = []
        for lang in self.langs:
            order = np.argsort(profiles[lang])
            self.sorted.append((profiles[lang][order], order))

    def distances(self, ranked: np.ndarray) -> list[int]:
        """Sum of out-of-place distances to each profile."""
        place, found = np.arange(len(ranked)), []
        for grams, rank in self.sorted:
            at = np.minimum(np.searchsorted(grams, ranked), len(grams) - 1)
            off = np.where(grams[at] == ranked, np.abs(rank[at] - place), self.size)
            found.append(int(off.sum()))
        return found

    def nearest(self, text: str) -> tuple[str, float, float]:
        """Language, score, and the mean distance of an n-gram as a share of the largest one."""
        if not text or not self.langs:
            return UNKNOWN, 0.0, 1.0
        ranked = top(*ngrams(text), self.size)
        d = self.distances(ranked)
        first = int(np.argmin(d))
        most = len(ranked) * self.size
        rest = [x for k, x in enumerate(d) if k != first]
        second = min(rest) if rest else most
        return self.langs[first], (second - d[first]) / second if second else 0.0, d[first] / most

    def best(self, text: str) -> tuple[str, float]:
        return self.nearest(text)[:2]


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, held_out, lang_pred and score per row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for part in slices(batches):
            found = [model.best(t) for t in clean(part["_text"])]
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["_held"], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                ["_id", "held_out", "lang_pred", "score"])

    rows = text_rows(docs, id_col, text_col).withColumn("_held", held_out("_id"))
    kind = rows.schema["_id"].dataType.simpleString()
    done = map_arrow(rows, work, f"_id {kind}, held_out boolean, lang_pred string, score double")
    return done.withColumnRenamed("_id", id_col)


def limits(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
           ) -> dict[str, float]:
    """Largest distance by language that still counts as that language.

    Of all labelled documents that aren't held out and whose nearest profile is their label, the
    quantile ``OWN`` and half of its way from the median beyond it. How far that lies from the median is
    averaged with the same of all languages together (each about its own median), which counts as
    ``OWN_LIMIT`` documents; the language's own quantile always stays within. A language without such a
    document has the limit 1, which no text with a shared n-gram reaches. Counts per step of the
    distance reach the driver.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for part in slices(batches):
            found = [model.nearest(t) for t in clean(part["_text"])]
            own = [(f[0], int(f[2] * STEPS)) for f, lang in zip(found, part["_lang"].to_pylist())
                   if f[0] == lang and f[2] < 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in own], pa.string()),
                 pa.array([o[1] for o in own], pa.int32())], ["lang", "step"])

    taught = docs.filter(F.col(f"`{lang_col}`").isNotNull() & ~held_out(id_col)).select(
        F.col(f"`{lang_col}`").cast("string").alias("_lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    steps: dict[str, list[int]] = {}
    for r in map_arrow(taught, work, "lang string, step int").groupBy("lang", "step").agg(
            F.count("*").alias("n")).collect():
        steps.setdefault(r["lang"], [0] * STEPS)[r["step"]] = r["n"]
    def place(counts: np.ndarray, share: float) -> int:
        total = np.cumsum(counts)
        return int(np.searchsorted(total, share * total[-1])) + 1

    # Counts by distance from the language's median, -STEPS to STEPS.
    centred, own = np.zeros(2 * STEPS + 2, dtype=np.int64), {}
    for lang, n in steps.items():
        middle, high = place(n, 0.5), place(n, OWN)
        own[lang] = sum(n), middle, high
        centred[STEPS - middle + 1:2 * STEPS - middle + 1] += np.array(n)
    if not own:
        return {lang: 1.0 for lang in profiles}
    pooled = max(0, place(centred, OWN) - 1 - STEPS) * 1.5
    found = {lang: max(high, middle + ((high - middle) * 1.5 * n + pooled * OWN_LIMIT)
                       / (n + OWN_LIMIT)) / STEPS for lang, (n, middle, high) in own.items()}
    return {lang: 1.0 for lang in profiles} | found


def identified(docs: DataFrame, profiles: dict[str, np.ndarray], least: float = 0.0,
               size: int = PROFILE, text_col: str = "text",
               furthest: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` with a language, at least that score and, with ``furthest`` (by language,
    of ``limits``), no larger distance, with all their columns; all rows where nothing was learned.

    A text that shares no n-gram with any profile has no language.
    """
    if not profiles:
        return docs
    at, furthest = docs.columns.index(text_col), furthest or {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for part in slices(batches, at):
            found = [model.nearest(t) for t in clean(part.column(at))]
            yield part.filter(pa.array(
                [lang != UNKNOWN and score >= least and far < 1 and far <= furthest.get(lang, 1.0)
                 for lang, score, far in found], pa.bool_()))

    return map_arrow(docs, work, docs.schema)
