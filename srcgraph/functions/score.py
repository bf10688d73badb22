"""Complexity scores and heat labels as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from srcgraph.functions.fixed import (
    AVG_SHARE, BOOSTS, HEAT_BANDS, HEAT_FLOOR, HEAT_RANK, HEAT_SIGNS, MAX_BRANCHES, MAX_CALLS, MAX_LINES,
    MAX_NESTING, MAX_SHARE, NO_SYMBOL_SCALE, WEIGHT_BRANCHES, WEIGHT_CALLS, WEIGHT_LINES,
    WEIGHT_NESTING,
)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def saturation(value: Column, cap: int) -> Column:
    return F.least(value / F.lit(float(cap)), F.lit(1.0)) * F.lit(100.0)


def symbol_score(line_count: Column, nesting: Column, branches: Column, calls: Column) -> Column:
    return clamp(
        F.lit(WEIGHT_LINES) * saturation(line_count, MAX_LINES)
        + F.lit(WEIGHT_NESTING) * saturation(nesting, MAX_NESTING)
        + F.lit(WEIGHT_BRANCHES) * saturation(branches, MAX_BRANCHES)
        + F.lit(WEIGHT_CALLS) * saturation(calls, MAX_CALLS)
    )


def file_score(avg: Column, top: Column, n_symbols: Column, line_count: Column) -> Column:
    """Score of a file from the aggregate of its symbols of depth 0 and 1."""
    blended = F.lit(AVG_SHARE) * avg + F.lit(MAX_SHARE) * top
    score = F
    for more_than, factor in BOOSTS:
        score = score.when(n_symbols > more_than, F.least(blended * F.lit(factor), F.lit(100.0)))
    without = F.least(line_count / F.lit(float(MAX_LINES)), F.lit(1.0)) * F.lit(float(NO_SYMBOL_SCALE))
    return clamp(F.when(F.coalesce(n_symbols, F.lit(0)) == 0, without)
                 .otherwise(score.otherwise(blended)))


def heat_label(score: Column) -> Column:
    label = F
    for threshold, name in HEAT_BANDS:
        label = label.when(score >= threshold, F.lit(name))
    return label.otherwise(F.lit(HEAT_FLOOR))


def heat_rank(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(h) for h in HEAT_RANK]), label) - 1


def badge(score: Column) -> Column:
    """Sign of the heat band and the score without decimals."""
    sign = F
    for threshold, name in HEAT_BANDS:
        sign = sign.when(score >= threshold, F.lit(HEAT_SIGNS[name]))
    return F.concat(sign.otherwise(F.lit(HEAT_SIGNS[HEAT_FLOOR])), F.lit(" "), F.rint(score).cast("long").cast("string"))


def one_decimal(score: Column) -> Column:
    """The number with one decimal nearest to the double itself, null as 0; scores are from 0 to 100.

    ``round`` goes by the shortest decimal form, in which 0.35 is a tie.  Here the
    leading bits and the rest are multiplied by ten apart, without an error.
    """
    leading = F.floor(score * F.lit(float(1 << 20))) / F.lit(float(1 << 20))
    tenths = F.floor(leading * 10)
    over = (leading * 10 - tenths - 0.5) + (score - leading) * 10
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(tenths % 2)
    return F.coalesce((tenths + up) / F.lit(10.0), F.lit(0.0))
