"""Secret scans with DataFrame expressions alone.

Three base patterns (assignments, access ids, long hex) find secrets by their form. The method
adds strings that look random: every long run of encoding characters gets its smallest fitting
alphabet and goes through a battery of tests of uniform randomness (chi-squared of the symbol
counts, runs above and below the alphabet's middle, lag-one serial correlation), combined by
the Cauchy rule into one p-value. Ordinary words and identifiers fail the battery. Which
failures count is decided by Benjamini-Hochberg over all runs of the same alphabet and length
band, as the battery's power grows with the length: at most ``q`` of the runs put aside as not
random are expected to be random. What is left is reported as kind ``random`` unless it overlaps
a base match.

Contract: one row per input row; null text is empty. Repeated rows give one row each, null ids
stay. Spans count code points, end exclusive. Other columns are ignored, whatever their names; an
empty table gives none. The work on a text grows with its length and its matches, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import text_rows

#: The base kinds in their order, patterns with an opening and a judged part, and
#: the fewest characters of the judged part.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)"""
               r"""([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"()(AKIA[A-Z0-9]+)", 20),
    ("hex", r"()((?<![0-9a-f])[0-9a-f]{24,})", 24),
)
RANDOM = "random"
RUNS = r"()((?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2})"
RUN_CHARS = 20
#: Alphabets from the smallest to the largest: name, what a run must match, symbols.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", LOWER.upper() + "234567"),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("upper36", "^[A-Z0-9]+$", DIGITS + LOWER.upper()),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + LOWER + LOWER.upper()),
    ("base64", "", DIGITS + LOWER + LOWER.upper() + "+/"),
)
#: Lower ends of the length bands.
BANDS = (20, 32, 48, 80)
#: p-values are kept as hundredths of their negative decimal logarithm, up to 1e-12.
TOP_BIN = 1200
#: Matches per block when positions are added up, so that the work grows with the matches.
BLOCK = 256


def spans_of(text: Column, kind: str, order: int, pattern: str, least: int) -> Column:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose second group is long enough.

    Array of (start, rank of the kind, end, kind, value). The matches are marked in the text
    with control characters, which stand for others of the same length if the text has them.
    """
    plain = F.translate(text, "\x01\x02\x03", "\x04\x04\x04")
    marked = F.split(F.regexp_replace(plain, pattern, "\x01$1\x02$2\x03"), "\x01")
    spans = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
    add = lambda values: F.aggregate(values, F.lit(0), lambda acc, v: acc + v)

    def before(lengths: Column) -> Column:
        """Sum of the lengths before each one and, last, of all."""
        return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, v: F.concat(
            acc, F.array(F.element_at(acc, -1) + v)))

    def span(part: Column, pos: Column) -> Column:
        opening = F.length(F.substring_index(part, "\x02", 1))
        value = F.substring_index(F.substring_index(part, "\x03", 1), "\x02", -1)
        return F.struct(pos.alias("start"), F.lit(order).alias("rank"),
                        (pos + opening + F.length(value)).alias("end"), F.lit(kind).alias("kind"),
                        value.alias("value"))

    def block(parts: Column, start: Column) -> Column:
        """Spans of the matches of one block, whose first one starts at ``start``."""
        at = before(F.transform(parts, lambda p: F.length(p) - 2))
        return F.transform(F.array(F.struct(at.alias("at"))), lambda v: F.zip_with(
            parts, F.slice(v["at"], 1, F.size(parts)), lambda p, x: span(p, start + x)))[0]

    def located(found: Column) -> Column:
        """``found`` are the text before the first match and one part per match.

        Positions are added up within blocks of ``BLOCK`` matches and over the blocks.
        """
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 2) / BLOCK).cast("int")),
                             lambda k: F.slice(found, k * BLOCK + 2, F.lit(BLOCK)))
        return F.transform(F.array(blocks), lambda b: F.transform(
            F.array(before(F.transform(b, lambda parts: add(F.transform(
                parts, lambda p: F.length(p) - 2))))),
            lambda at: F.flatten(F.zip_with(
                b, F.slice(at, 1, F.size(b)),
                lambda parts, x: block(parts, F.length(found[0]) + x)))))[0][0]

    # Arrays of one element hold what inner functions use more than once, so it is computed once.
    spotted = F.filter(F.transform(F.array(marked), located)[0],
                       lambda v: F.length(v["value"]) >= least)
    return F.when(text.rlike(pattern), spotted.cast(spans)).otherwise(F.array().cast(spans))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (rational approximation of Abramowitz and Stegun)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (
        1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(value: Column) -> Column:
    """(alphabet, p) of one run: p is small if the run isn't uniformly random."""
    body = F.translate(F.rtrim(F.translate(value, "=", " ")), "-_", "+/")
    name, symbols = F.lit(ALPHABETS[-1][0]), F.lit(ALPHABETS[-1][2])
    for alphabet, fits, letters in reversed(ALPHABETS[:-1]):
        name = F.when(body.rlike(fits), alphabet).otherwise(name)
        symbols = F.when(body.rlike(fits), letters).otherwise(symbols)

    def tests(s: Column, a: Column) -> Column:
        n = F.length(s).cast("double")
        size = F.length(a).cast("double")
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        index = F.transform(chars, lambda c: F.instr(a, c).cast("double") - 1)
        squares = F.aggregate(
            F.filter(F.split(a, ""), lambda c: c != ""), F.lit(0.0),
            lambda acc, c: acc + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2)))
        chi = (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)

        def sequence_tests(x: Column) -> Column:
            later = F.slice(x, F.lit(2), F.size(x) - 1)
            earlier = F.slice(x, F.lit(1), F.size(x) - 1)
            add = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y)
            high = add(F.transform(x, lambda y: (y >= size / 2).cast("double")))
            low = n - high
            runs = 1 + add(F.zip_with(earlier, later, lambda y, z: (
                (y >= size / 2) != (z >= size / 2)).cast("double")))
            both = 2 * high * low
            spread = both * (both - n) / (n * n * (n - 1))
            run_p = F.when(spread > 0, 2 * _tail(F.abs(
                (runs - 1 - both / n) / F.sqrt(F.greatest(spread, F.lit(1e-9)))))
            ).otherwise(F.pow(F.lit(2.0), 1 - n))
            # Sums over the whole run only: a mean inside a lambda is worked out once per symbol.
            total = add(x)
            spread_n = n * add(F.transform(x, lambda y: y * y)) - total * total
            mean, power = total / n, spread_n / n
            lagged = (add(F.zip_with(earlier, later, lambda y, z: y * z))
                      - mean * (2 * total - x[0] - F.element_at(x, -1)) + (n - 1) * mean * mean)
            serial_p = F.when(spread_n > 0, 2 * _tail(F.abs(
                (lagged / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))).otherwise(0.0)
            odds = sum(F.tan((0.5 - F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-6)))
                             * F.lit(3.141592653589793))
                       for p in (_tail(chi), run_p, serial_p)) / 3
            return 0.5 - F.atan(odds) / F.lit(3.141592653589793)

        # Held as the one element of an array, so that the indices are computed once.
        return F.transform(F.array(index), sequence_tests)[0]

    p = F.transform(F.array(F.struct(body.alias("s"), symbols.alias("a"))),
                    lambda v: tests(v["s"], v["a"]))[0]
    return F.struct(name.alias("alphabet"), p.alias("p"))


def scan(docs: DataFrame, q: float = 0.01, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc id, base spans and random spans per row, as arrays of (start, rank, end, kind, value).

    What the patterns find is written once to the shared folder; the texts are read once.
    """
    text = F.col("_text")
    rows = text_rows(docs, id_col, text_col).select(
        "_id", F.concat(*[spans_of(text, kind, k, pattern, least)
                          for k, (kind, pattern, least) in enumerate(KINDS)]).alias("base"),
        spans_of(text, RANDOM, len(KINDS), RUNS, RUN_CHARS).alias("runs"))
    tested = F.transform("runs", lambda v: F.struct(v.alias("span"), battery(v["value"]).alias("t")))
    found = materialise(rows.select("_id", F.array_sort("base").alias("base"),
                                    tested.alias("runs")))
    stratum = lambda v: F.concat_ws("/", v["t"]["alphabet"], sum(
        (F.length(v["span"]["value"]) >= b).cast("int") for b in BANDS[1:]).cast("string"))
    level = lambda v: F.least(F.floor(-100 * F.log10(F.greatest(
        v["t"]["p"], F.lit(1e-13)))), F.lit(TOP_BIN)).cast("int")
    bins = (found.select(F.explode("runs").alias("v"))
            .groupBy(stratum(F.col("v")).alias("stratum"), level(F.col("v")).alias("bin"))
            .agg(F.count("*").alias("n")))
    # Windows over at most TOP_BIN rows per stratum.
    by = W.partitionBy("stratum")
    passed = bins.select(
        "stratum", "bin", F.sum("n").over(by.orderBy(F.desc("bin"))).alias("cum"),
        F.sum("n").over(by).alias("m")).filter(
        F.pow(F.lit(10.0), -F.col("bin") / 100) <= q * F.col("cum") / F.col("m"))
    # At most one row per alphabet and length band reaches the driver.
    cut = {r["stratum"]: r["bin"] for r in
           passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}
    cuts = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]) if cut else None
    limit = lambda v: (F.coalesce(F.element_at(cuts, stratum(v)), F.lit(TOP_BIN + 1))
                       if cut else F.lit(TOP_BIN + 1))
    def base_before(run_at: str, base_at: str, run_first: bool) -> Column:
        """Per run: how many base spans have ``base_at`` before the run's ``run_at``.

        One sort of both; of the runs, whose order stays, place minus rank is the count.
        """
        both = F.array_sort(F.concat(
            F.transform("runs", lambda v: F.struct(
                v["span"][run_at].alias("at"), F.lit(0 if run_first else 1).alias("of"))),
            F.transform("base", lambda b: F.struct(
                b[base_at].alias("at"), F.lit(1 if run_first else 0).alias("of")))))
        placed = F.transform(both, lambda e, k: F.struct(e["of"].alias("of"), k.alias("k")))
        runs = F.filter(placed, lambda e: e["of"] == (0 if run_first else 1))
        return F.transform(runs, lambda e, j: e["k"] - j)

    # Base spans that start before a run's end but don't end by its start overlap it.
    alone = F.zip_with(base_before("end", "start", True), base_before("start", "end", False),
                       lambda begun, ended: begun == ended)
    judged = F.zip_with("runs", alone, lambda v, a: F.struct(v.alias("v"), a.alias("alone")))
    random = F.transform(F.filter(judged, lambda r: r["alone"] & (level(r["v"]) < limit(r["v"]))),
                         lambda r: r["v"]["span"])
    return found.select(F.col("_id").alias(id_col), "base", random.alias(RANDOM))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of the base spans and the text of all spans."""
    def spell(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col, *[count(kind).alias(f"n_{kind}") for kind, _, _ in KINDS],
        F.sha2(spell(F.col("base")), 256).alias("base_sha256"),
        spell(F.array_sort(F.concat("base", RANDOM))).alias("spans"))
