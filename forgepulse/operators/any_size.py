"""Runs and features of accounts of any size: ranges of an account's activities, stitched at their edges.

`features` and `runs` of the module beside this one need all activities of an account in one task.
Here they are stored in ranges of (account, time), each held by one task, and windows work inside the
part of an account that lies in a range. What reaches over the edge of a range comes from one small
row per account and range: its first and last activity, its size, its last edge of a run. These rows
are put in order by account, of which there are no more than ranges, and joined back.

The values of the series are counted by (account, series, value), stored in ranges of that order and
ranked there; the sizes of earlier ranges give the ranks in the whole series. Sums are of whole
microseconds, so they don't depend on the order of rows. No window is by account alone, except those
over the rows of ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from forgepulse import schema as S
from forgepulse.functions import stats
from forgepulse.functions.times import epoch_micros, hours
from forgepulse.operators.features import changed, with_kinds
from forgepulse.operators.numbering import PART, ranged

_SEEN = "struct(at, repository, activity_ord)"  # what an activity shows to its neighbours
_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_SO_FAR = "(PARTITION BY contributor, part ORDER BY __at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_IN_HOURS = ("DCA", "DCAR", "DAAR", "DCAT")
_RANKED = [s for s in S.SERIES if s != "NAT"]


def time_ranges(activities: DataFrame) -> DataFrame:
    """Activities stored in ranges of account and time; those without a time come last."""
    rows = activities.selectExpr(
        "contributor", "repository", "activity", "activity_ord", "date", "event_id",
        f"{epoch_micros('date')} AS at", "date IS NULL AS undated",
    )
    order = ["contributor", "undated", "date", "activity_ord", "event_id"]
    return ranged(rows, order, "activities").selectExpr("*", f"{PART} AS part")


def _joined(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what `edges` says of their range. Accounts without a name are an account."""
    named = edges.withColumnsRenamed({k: f"edge_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"edge_{k}")) for k in keys]
    return rows.join(named, same).drop(*[f"edge_{k}" for k in keys])


def stitched(ranges: DataFrame, column: str = "repository") -> DataFrame:
    """Each activity with its neighbours in the account, its place, and the start of its run.

    `before` and `after` are the neighbours (`at`, `repository`, `activity_ord`), `run_start` has
    the place and time at which the run of `column` began, `run_no` its number in the account, and
    `last_at` the last known time so far.
    """
    here = "(PARTITION BY contributor, part ORDER BY __at)"
    rows = ranges.selectExpr(
        "*",
        f"CAST(row_number() OVER {here} AS bigint) AS place_here",
        f"lag({_SEEN}) OVER {here} AS before_here",
        f"lead({_SEEN}) OVER {here} AS after_here",
    )
    starts = changed(column, f"before_here.{column}")
    edges = rows.groupBy("contributor", "part").agg(
        F.expr("count(1) AS size"),
        F.expr("max(at) AS part_at"),
        F.expr(f"max(CASE WHEN before_here IS NULL THEN {_SEEN} END) AS head"),
        F.expr(f"max(CASE WHEN after_here IS NULL THEN {_SEEN} END) AS tail"),
        F.expr(
            f"max(CASE WHEN before_here IS NOT NULL AND {starts} "
            "THEN struct(place_here AS place, at) END) AS inner_edge"
        ),
        F.expr(f"count_if(before_here IS NOT NULL AND {starts}) AS inner_runs"),
    )
    by_range = "PARTITION BY contributor ORDER BY part"
    edges = (
        edges.selectExpr(
            "*",
            f"lag(tail) OVER ({by_range}) AS before_part",
            f"lead(head) OVER ({by_range}) AS after_part",
            f"coalesce(sum(size) OVER ({by_range} {_EARLIER}), 0L) AS places_before",
            f"max(part_at) OVER ({by_range} {_EARLIER}) AS at_before",
        )
        .selectExpr("*", f"{changed(f'head.{column}', f'before_part.{column}')} AS head_starts")
        .selectExpr(
            "*",
            "coalesce(inner_edge, CASE WHEN head_starts THEN struct(1L AS place, head.at AS at) END)"
            " AS edge",
            "inner_runs + CAST(head_starts AS bigint) AS part_runs",
        )
        .selectExpr(
            "*",
            f"""last(CASE WHEN edge IS NOT NULL
                     THEN struct(places_before + edge.place AS place, edge.at AS at) END, true)
                OVER ({by_range} {_EARLIER}) AS open_run""",
            f"coalesce(sum(part_runs) OVER ({by_range} {_EARLIER}), 0L) AS runs_before",
        )
        .select(
            "contributor", "part", "before_part", "after_part", "places_before", "at_before",
            "open_run", "runs_before",
        )
    )
    return (
        _joined(rows, edges, ("contributor", "part"))
        .selectExpr(
            "* EXCEPT (before_here, after_here, before_part, after_part)",
            "coalesce(before_here, before_part) AS before",
            "coalesce(after_here, after_part) AS after",
            "places_before + place_here AS place",
            f"greatest(at_before, max(at) OVER {_SO_FAR}) AS last_at",
        )
        .selectExpr(
            "*", f"CASE WHEN {changed(column, f'before.{column}')} THEN struct(place, at) END AS edge"
        )
        .selectExpr(
            "*",
            f"coalesce(last(edge, true) OVER {_SO_FAR}, open_run) AS run_start",
            f"runs_before + count(edge) OVER {_SO_FAR} AS run_no",
        )
    )


def runs(activities: DataFrame, column: str, counted: str) -> DataFrame:
    """Maximal blocks of consecutive activities with equal `column`, `repository` or `activity`.

    One row per block, as `features.runs` gives it, without the time at which the next one begins.
    """
    compared = "activity_ord" if column == "activity" else column
    run_ends = changed(compared, f"after.{compared}")
    return (
        stitched(time_ranges(activities), compared)
        .groupBy("contributor", F.col("run_no").alias("run_id"))
        .agg(
            F.max(column).alias(column),
            F.count(counted).alias("activities"),
            F.min("date").alias("first_time"),
            F.max("date").alias("last_time"),
            F.expr(f"{hours('max(at) - min(at)')} AS time_spent"),
            F.expr(f"{hours(f'max(CASE WHEN {run_ends} THEN after.at - at END)')} AS time_to_switch"),
        )
    )


def repository_runs(activities: DataFrame) -> DataFrame:
    return runs(activities, "repository", "activity")


def type_runs(activities: DataFrame) -> DataFrame:
    return runs(activities, "activity", "repository")


def _amounts(ranges: DataFrame, by_kind: DataFrame) -> DataFrame:
    """Every value of every series but NAT as a whole number: microseconds or a count."""
    run_ends = changed("repository", "after.repository")
    type_ends = changed("activity_ord", "after.activity_ord")
    gap = "after.at - at"
    of_time = {
        "DCA": gap,
        "NCAR": f"CASE WHEN {run_ends} THEN place - run_start.place + 1 END",
        "DCAR": f"CASE WHEN {run_ends} THEN last_at - run_start.at END",
        "DAAR": f"CASE WHEN {run_ends} THEN {gap} END",
        "DCAT": f"CASE WHEN {type_ends} THEN {gap} END",
    }
    by_repository = (
        by_kind.filter("repository IS NOT NULL")
        .groupBy("contributor", "repository")
        .agg(F.sum("times").alias("NAR"), F.count(F.lit(1)).alias("NTR"))
    )

    def unpivoted(rows: DataFrame, amounts: dict[str, str]) -> DataFrame:
        pairs = ", ".join(f"{_RANKED.index(s) + 1}, {amount}" for s, amount in amounts.items())
        stacked = f"stack({len(amounts)}, {pairs}) AS (s_no, amount)"
        return rows.selectExpr("contributor", stacked).filter("amount IS NOT NULL")

    return unpivoted(stitched(ranges), of_time).unionByName(
        unpivoted(by_repository, {"NAR": "NAR", "NTR": "NTR"})
    )


def _series_statistics(amounts: DataFrame) -> DataFrame:
    """The five statistics of each account and series."""
    keys = ("contributor", "s_no", "part")
    counted = amounts.groupBy("contributor", "s_no", "amount").agg(F.count(F.lit(1)).alias("times"))
    ranges = ranged(counted, ["contributor", "s_no", "amount"], "series").selectExpr(
        "*", f"{PART} AS part"
    )
    series = "PARTITION BY contributor, s_no"
    in_hours = ", ".join(str(_RANKED.index(s) + 1) for s in _IN_HOURS)
    totals = (
        ranges.groupBy(*keys)
        .agg(
            F.sum("times").alias("part_times"),
            F.expr("sum(CAST(amount AS decimal(19)) * CAST(times AS decimal(18))) AS part_amount"),
        )
        .selectExpr(
            "*",
            f"sum(part_times) OVER ({series}) AS s_size",
            f"sum(part_amount) OVER ({series}) AS s_amount",
            f"coalesce(sum(part_times) OVER ({series} ORDER BY part {_EARLIER}), 0L) AS ranks_before",
        )
        .selectExpr(
            "*", f"CASE WHEN s_no IN ({in_hours}) THEN CAST({hours('s_amount')} AS double) "
            "ELSE CAST(s_amount AS double) END AS s_total",
        )
        .selectExpr(*keys, "s_size", "ranks_before", "s_total", "s_total / s_size AS s_mean")
    )
    ranked = (
        _joined(ranges, totals, keys)
        .selectExpr(
            "*",
            f"CASE WHEN s_no IN ({in_hours}) THEN {hours('amount')} ELSE CAST(amount AS double) END"
            " AS s_value",
            # How many values of the series come before the first of these equal ones.
            "ranks_before + sum(times) OVER (PARTITION BY contributor, s_no, part ORDER BY __at "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - times AS below",
        )
    )
    index = [(n, up, f"{stats.below('s_size', q)} + {up}") for n, q in enumerate(stats.QUARTILES) for up in (0, 1)]
    by_series = ranked.groupBy("contributor", "s_no").agg(
        *[F.expr(f"max({c}) AS {c}") for c in ("s_size", "s_total", "s_mean")],
        F.expr("sum(CASE WHEN amount <> 0 THEN times ELSE 0L END) AS s_nonzero"),
        F.expr("sum(times * (s_value - s_mean) * (s_value - s_mean)) AS s_squares"),
        # Each of the equal values weighs as much as values from it upwards there are.
        F.expr("sum(s_value * (times * (s_size - below) - times * (times - 1) / 2)) AS s_ranked"),
        *[
            F.expr(f"max(CASE WHEN {i} >= below AND {i} < below + times THEN s_value END) AS s_at_{n}_{up}")
            for n, up, i in index
        ],
    )
    first, median, third = (
        stats.interpolated(f"s_at_{n}_0", f"coalesce(s_at_{n}_1, s_at_{n}_0)", stats.part("s_size", q))
        for n, q in enumerate(stats.QUARTILES)
    )
    return by_series.selectExpr(
        "contributor",
        "s_no",
        "s_mean",
        "CASE WHEN s_size > 1 THEN sqrt(s_squares / (s_size - 1)) ELSE 0D END AS s_std",
        f"{median} AS s_median",
        f"({third}) - ({first}) AS s_IQR",
        "CASE WHEN s_nonzero = 0 THEN 0D "
        "ELSE ((s_nonzero + 1) * s_total - 2 * s_ranked) / (s_nonzero * s_total) END AS s_gini",
    )


def extract_features(activities: DataFrame) -> DataFrame:
    """The 38 features of each account, in model order, whatever the size of an account."""
    ranges = time_ranges(activities)
    by_kind = ranges.groupBy("contributor", "repository", "activity_ord").agg(
        F.count(F.lit(1)).alias("times")
    )
    kinds = range(1, len(S.ACTIVITY_NAMES) + 1)
    # NULL where the account has no activity of the kind; only those with a repository count.
    counts = by_kind.groupBy("contributor").agg(
        F.sum("times").alias("NA"),
        F.expr("count(DISTINCT substring_index(repository, '/', 1)) AS NOR"),
        F.expr("count(DISTINCT repository) AS repositories"),
        *[
            F.expr(
                f"sum(CASE WHEN activity_ord = {n} THEN CASE WHEN repository IS NULL THEN 0D "
                f"ELSE CAST(times AS double) END END) AS kind_{n}"
            )
            for n in kinds
        ],
    )
    statistics = _series_statistics(_amounts(ranges, by_kind))
    # An account without any value in a series has no row for it.
    absent = {"std": "0D", "gini": "0D"}
    wide = (
        statistics.unionByName(counts, allowMissingColumns=True)
        .groupBy("contributor")
        .agg(
            *[F.expr(f"max({c}) AS {c}") for c in ("NA", "NOR", "repositories")],
            *[F.expr(f"max(kind_{n}) AS kind_{n}") for n in kinds],
            *[
                F.expr(
                    f"coalesce(max(CASE WHEN s_no = {n} THEN s_{stat} END), {absent.get(stat, 'NULL')})"
                    f" AS {s}_{stat}"
                )
                for n, s in enumerate(_RANKED, start=1)
                for stat in S.STATISTICS
            ],
        )
    )
    rounded = [f"{stats.rounded(c)} AS {c}" for c in S.FEATURES if c not in ("NA", "NT", "NOR")]
    return with_kinds(wide).selectExpr("contributor", "NA", "NT", "NOR", *rounded)
