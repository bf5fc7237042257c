"""SQL expressions that summarise a numeric series: by rank, or held as a short ascending array.

Only arrays of a few values are folded inside a row (NAT has one for each kind of activity). Pass
column names, not long expressions: names occur repeatedly.
"""

from __future__ import annotations


QUARTILES = (0.25, 0.5, 0.75)


def below(size: str, q: float) -> str:
    """Index, from 0, of the value at or below a quantile of `size` ascending values."""
    return f"floor(({size} - 1) * {q}D)"


def part(size: str, q: float) -> str:
    """How far a quantile lies between that value and the next one."""
    return f"(({size} - 1) * {q}D - {below(size, q)})"


def interpolated(low: str, high: str, part: str) -> str:
    """The upper half of an interval is interpolated downwards, as numerical Python libraries do, so
    that values on a rounding boundary come out the same.
    """
    return (
        f"CASE WHEN {part} < 0.5D THEN {low} + ({high} - {low}) * {part} "
        f"ELSE {high} - ({high} - {low}) * (1 - {part}) END"
    )


def quantile(ordered: str, q: float) -> str:
    """Quantile with linear interpolation; NULL for an empty array."""
    size = f"size({ordered})"
    index = f"CAST({below(size, q)} AS int)"
    low = f"get({ordered}, {index})"
    return interpolated(low, f"coalesce(get({ordered}, {index} + 1), {low})", part(size, q))


def iqr(ordered: str) -> str:
    return f"(({quantile(ordered, 0.75)}) - ({quantile(ordered, 0.25)}))"


def gini(ordered: str, nonzero: str) -> str:
    """Gini coefficient of the non-zero values of a non-negative array; 0 when there are none.

    Summing the running totals weights each value by its rank from the top, so one fold yields
    both sums of the rank formula. Zeros come first and add nothing to either.
    """
    fold = f"""aggregate({ordered}, struct(0D AS total, 0D AS ranked),
        (acc, x) -> struct(acc.total + x AS total, acc.ranked + acc.total + x AS ranked),
        acc -> (({nonzero} + 1) * acc.total - 2 * acc.ranked) / ({nonzero} * acc.total))"""
    return f"CASE WHEN {nonzero} = 0 THEN 0D ELSE {fold} END"


def array_mean(values: str) -> str:
    return f"try_divide(aggregate({values}, 0D, (acc, x) -> acc + x), size({values}))"


def array_std(values: str, mean: str) -> str:
    """Sample standard deviation; 0 when fewer than two values leave it undefined."""
    squares = f"aggregate({values}, 0D, (acc, x) -> acc + (x - {mean}) * (x - {mean}))"
    return f"CASE WHEN size({values}) > 1 THEN sqrt({squares} / (size({values}) - 1)) ELSE 0D END"


def rounded(value: str) -> str:
    """Three digits, ties to even on the scaled value, as numerical Python libraries round."""
    return f"rint(({value}) * 1000D) / 1000D"
