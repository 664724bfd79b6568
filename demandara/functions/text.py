"""Text clean-up and checks as column expressions (JVM side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters removed from text; allowed material-code characters.
CONTROL_CHARS = r"[\x00-\x1f\x7f-\x9f]"
MATERIAL_CODE = r"^[A-Za-z0-9\-_]+$"
# Characters dropped from a search term.
SEARCH_DROPPED = "[;'\"\\\\]"


def zero_pad(c: Column, width: int = 4) -> Column:
    """Left-pad with zeros to ``width``; longer text is kept whole."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def cleaned(c: Column) -> Column:
    """Trim and drop control characters; null becomes ''."""
    text = F.regexp_replace(F.trim(c.cast("string")), CONTROL_CHARS, "")
    return F.coalesce(text, F.lit(""))


def sanitize(c: Column, max_length: int = 255) -> Column:
    """Clean-up, cut to ``max_length``."""
    return F.substring(cleaned(c), 1, max_length)


def valid_material_code(c: Column, max_length: int = 50) -> Column:
    """The whole cleaned text is a code of allowed characters, not longer than ``max_length``."""
    text = cleaned(c)
    return text.rlike(MATERIAL_CODE) & (F.length(text) <= max_length)


def valid_place(c: Column, max_length: int = 10) -> Column:
    """Plant or warehouse code: something is left after clean-up, not longer than ``max_length``."""
    return F.length(cleaned(c)).between(1, max_length)


def search_term(term: str, max_length: int = 100) -> str:
    """Clean one search term on the driver (a scalar, so no job)."""
    cleaned = re.sub(CONTROL_CHARS, "", (term or "").strip())[:max_length]
    return re.sub(SEARCH_DROPPED, "", cleaned)


def like_pattern(term: str, escape: bool = True) -> str:
    """``%term%`` with LIKE's own characters escaped unless told not to."""
    if escape:
        for ch in ("\\", "%", "_"):
            term = term.replace(ch, "\\" + ch)
    return f"%{term}%"


def number_problems(c: Column, *, minimum: float | None = None,
                    maximum: float | None = None,
                    strictly_positive: bool = False) -> Column:
    """Array of reasons why a text value is not an acceptable number (empty = fine)."""
    text = F.trim(c.cast("string"))
    num = text.try_cast("double")
    rules = [
        (c.isNull(), "nulo"),
        (c.isNotNull() & (F.length(text) == 0), "vacio"),
        ((F.length(text) > 0) & num.isNull(), "no_numerico"),
        (F.isnan(num), "nan"),
        (F.abs(num) == float("inf"), "infinito"),
    ]
    if minimum is not None:
        rules.append((num < minimum, "bajo_minimo"))
    if maximum is not None:
        rules.append((~F.isnan(num) & (num > maximum), "sobre_maximo"))
    if strictly_positive:
        rules.append((num < 0.0001, "no_positivo"))
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def integer_value(c: Column) -> Column:
    """Text as a whole number, decimals cut off; null when it is not a finite number."""
    num = F.trim(c.cast("string")).try_cast("double")
    whole = F.when(num >= 0, F.floor(num)).otherwise(F.ceil(num))
    return F.when(F.abs(num) < float("inf"), whole).cast("long")
