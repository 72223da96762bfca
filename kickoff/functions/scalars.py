"""Scalar column functions (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Spark's ``trim`` only strips spaces)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def parse_score(c) -> Column:
    """First two digit runs of the score text -> struct(home_goals, away_goals) as ints.

    Dash variants need no unification: only digit runs are read. Fewer than two
    runs, empty or null text -> both null.
    """
    runs = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(\d+)"), 1)
    ok = F.size(runs) >= 2
    home = F.when(ok, runs.getItem(0).try_cast("int"))
    away = F.when(ok, runs.getItem(1).try_cast("int"))
    return F.struct(home.alias("home_goals"), away.alias("away_goals"))


def parse_date_text(c) -> Column:
    """Lenient date text -> ISO ``yyyy-MM-dd``; unparsable -> the rewritten text.

    Lower-cases, rewrites Spanish month abbreviations by substring, then tries the
    fixed formats in order. Null or empty input -> ''. A format is only tried on text with the
    character between its parts: a failed try costs an exception.
    """
    x = F.lower(strip_ws(col(c)))
    for es, en in C.SPANISH_MONTHS:
        if es != en:
            x = F.replace(x, F.lit(es), F.lit(en))
    between = {f: next(s for s in "-/ " if s in f) for f in C.DATE_TEXT_FORMATS}
    parsed = lambda x: F.coalesce(*[F.when(x.contains(s), F.try_to_timestamp(x, F.lit(f))) for f, s in between.items()])
    out = once(x, lambda x: F.coalesce(F.date_format(parsed(x), "yyyy-MM-dd"), x))
    return F.when(col(c).isNull() | (col(c) == ""), F.lit("")).otherwise(out)


def result_label(home_goals, away_goals) -> Column:
    h, a = col(home_goals), col(away_goals)
    return (F.when(h.isNull() | a.isNull(), F.lit(C.UNKNOWN_RESULT))
            .when(h > a, F.lit(C.RESULT_LABELS[1]))
            .when(a > h, F.lit(C.RESULT_LABELS[-1]))
            .otherwise(F.lit(C.RESULT_LABELS[0])))


def result_to_name(result) -> Column:
    r = col(result)
    return (F.when(r == 1, F.lit(C.RESULT_LABELS[1]))
            .when(r == 0, F.lit(C.RESULT_LABELS[0]))
            .when(r == -1, F.lit(C.RESULT_LABELS[-1])))


def encode_result(home_goals, away_goals) -> Column:
    """1 / -1 / 0 from goals; null when either side is null."""
    return F.signum(col(home_goals) - col(away_goals)).cast("int")


def slugify(c) -> Column:
    """Lower case, spaces -> '-', keep Unicode letters/digits and '-'."""
    return F.regexp_replace(F.replace(F.lower(col(c)), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", "")


def initials(c) -> Column:
    """One word -> its first two letters; else first letters of the first two words; none -> 'X'."""
    words = F.filter(F.split(F.replace(col(c), F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
    n = F.size(words)
    first = F.element_at(words, 1)
    second = F.element_at(words, 2)
    return F.upper(
        F.when(n == 0, F.lit("X"))
        .when(n == 1, F.substring(first, 1, 2))
        .otherwise(F.concat(F.substring(first, 1, 1), F.substring(second, 1, 1))))


def palette_colour(rn) -> Column:
    """Colour by 1-based row number, cycling through the fixed palette."""
    palette = F.array(*[F.lit(p) for p in C.PALETTE])
    return F.element_at(palette, ((col(rn) - 1) % len(C.PALETTE) + 1).cast("int"))


def elo_expected(home_rating, away_rating) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (col(away_rating) - col(home_rating)) / 400.0))


def season_label(season_year) -> Column:
    s = col(season_year)
    return F.concat_ws("-", s.cast("string"), (s + 1).cast("string"))


def season_of(match_date) -> Column:
    d = col(match_date)
    return F.when(F.month(d) >= 8, F.year(d)).otherwise(F.year(d) - 1)


def month_category(month) -> Column:
    m = col(month)
    expr = None
    for k, v in C.MONTH_CATEGORY.items():
        expr = F.when(m == k, F.lit(v)) if expr is None else expr.when(m == k, F.lit(v))
    return expr


def clean_goals(c) -> Column:
    """Text/number -> double; outside [0, 10] or unreadable -> null."""
    x = col(c).cast("string").try_cast("double")
    return F.when(x.between(C.MIN_GOALS, C.MAX_GOALS), x)


def clean_attendance(c) -> Column:
    """Drop ',' and '.', read as a number; outside [0, 100000] -> null."""
    x = F.translate(col(c).cast("string"), ",.", "").try_cast("double")
    return F.when(x.between(0, C.MAX_ATTENDANCE), x)


def round_half_even_nonneg(c) -> Column:
    """Round half to even, then clamp at 0 (predicted goals)."""
    return F.greatest(F.lit(0), F.bround(col(c), 0).cast("bigint"))
