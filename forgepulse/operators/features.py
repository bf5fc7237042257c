"""Series, runs and the behavioural features of each account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forgepulse import schema as S
from forgepulse.functions import stats
from forgepulse.functions.times import epoch_micros, hours

# Total order of an account's activities: time, then precedence, then event id.
TIME_ORDER = "date ASC NULLS LAST, activity_ord, event_id"


def changed(column: str, neighbour: str) -> str:
    """True at the edge of a run; a missing value on either side always ends the run."""
    return f"NOT coalesce({column} = {neighbour}, false)"


def _aggregates(*expressions: str) -> list[Column]:
    return [F.expr(expression) for expression in expressions]


def runs(
    activities: DataFrame, column: str, counted: str, keys: Sequence[str] = ("contributor",)
) -> DataFrame:
    """Maximal blocks of consecutive activities with equal `column`, one row per block."""
    account = ", ".join(keys)
    by_time = f"(PARTITION BY {account} ORDER BY {TIME_ORDER})"
    blocks = (
        activities.selectExpr("*", f"lag({column}) OVER {by_time} AS before")
        .selectExpr("*", f"CAST({changed(column, 'before')} AS bigint) AS starts")
        .selectExpr(
            "*",
            f"sum(starts) OVER (PARTITION BY {account} ORDER BY {TIME_ORDER} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id",
        )
        .groupBy(*keys, "run_id")
        .agg(
            *_aggregates(
                f"first({column}) AS {column}",
                f"count({counted}) AS activities",
                "min(date) AS first_time",
                "max(date) AS last_time",
            )
        )
    )
    first, last, after = (epoch_micros(c) for c in ("first_time", "last_time", "next_first_time"))
    return blocks.selectExpr(
        "*", f"lead(first_time) OVER (PARTITION BY {account} ORDER BY run_id) AS next_first_time"
    ).selectExpr(
        "*",
        f"{hours(f'({last}) - ({first})')} AS time_spent",
        f"{hours(f'({after}) - ({last})')} AS time_to_switch",
    )


def repository_runs(activities: DataFrame, keys: Sequence[str] = ("contributor",)) -> DataFrame:
    return runs(activities, "repository", "activity", keys)


def type_runs(activities: DataFrame, keys: Sequence[str] = ("contributor",)) -> DataFrame:
    return runs(activities, "activity", "repository", keys)


def series_rows(activities: DataFrame, keys: Sequence[str] = ("contributor",)) -> DataFrame:
    """Attach every series value to the activity row that completes it, NULL elsewhere.

    The last row of a repository carries NAR and NTR, the last row of a run NCAR, DCAR and DAAR,
    and so on. Everything stays in the partitioning by account, without joins between series.
    """
    account = ", ".join(keys)
    in_repository = f"(PARTITION BY {account}, repository ORDER BY activity_ord)"
    by_time = f"(PARTITION BY {account} ORDER BY {TIME_ORDER})"
    of_owner = f"(PARTITION BY {account}, owner ORDER BY activity_ord)"
    so_far = by_time[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    gap = hours("next_at - at")
    return (
        activities.selectExpr(
            "*",
            f"row_number() OVER {in_repository} AS in_repo",
            f"dense_rank() OVER {in_repository} AS types_in_repo",
            f"lead(activity_ord) OVER {in_repository} IS NULL AND repository IS NOT NULL AS repo_ends",
        )
        .selectExpr("*", f"{epoch_micros('date')} AS at", "substring_index(repository, '/', 1) AS owner")
        .selectExpr(
            "*",
            f"row_number() OVER {by_time} AS position",
            f"lead(at) OVER {by_time} AS next_at",
            f"owner IS NOT NULL AND row_number() OVER {of_owner} = 1 AS new_owner",
            f"lag(repository) OVER {by_time} AS repo_before",
            f"lead(repository) OVER {by_time} AS repo_after",
            f"lead(activity_ord) OVER {by_time} AS ord_after",
            # Rows without a time come last; their run ends at its last known time.
            f"max(at) OVER {so_far} AS last_at",
        )
        .selectExpr(
            "*",
            f"CASE WHEN {changed('repository', 'repo_before')} "
            "THEN struct(position, at) END AS run_edge",
            f"{changed('repository', 'repo_after')} AS run_ends",
            f"{changed('activity_ord', 'ord_after')} AS type_ends",
        )
        .selectExpr("*", f"last(run_edge, true) OVER {so_far} AS run_start")
        .selectExpr(
            "*",
            f"{gap} AS DCA",
            "CASE WHEN repo_ends THEN CAST(in_repo AS double) END AS NAR",
            "CASE WHEN repo_ends THEN CAST(types_in_repo AS double) END AS NTR",
            "CASE WHEN run_ends THEN CAST(position - run_start.position + 1 AS double) END AS NCAR",
            f"CASE WHEN run_ends THEN {hours('last_at - run_start.at')} END AS DCAR",
            f"CASE WHEN run_ends THEN {gap} END AS DAAR",
            f"CASE WHEN type_ends THEN {gap} END AS DCAT",
        )
    )


def with_kinds(wide: DataFrame) -> DataFrame:
    """Add NAT with its statistics, NT and ORR to a row per account that has the counts by kind."""
    per_kind = ", ".join(f"kind_{n}" for n in range(1, len(S.ACTIVITY_NAMES) + 1))
    return (
        wide.selectExpr("*", f"sort_array(array_compact(array({per_kind}))) AS NAT")
        .selectExpr(
            "*",
            f"{stats.array_mean('NAT')} AS NAT_mean",
            "CAST(size(filter(NAT, x -> x <> 0)) AS bigint) AS NAT_nonzero",
        )
        .selectExpr(
            "*",
            f"{stats.array_std('NAT', 'NAT_mean')} AS NAT_std",
            f"{stats.quantile('NAT', 0.5)} AS NAT_median",
            f"{stats.gini('NAT', 'NAT_nonzero')} AS NAT_gini",
            f"{stats.iqr('NAT')} AS NAT_IQR",
            "CAST(size(NAT) AS bigint) AS NT",
            "try_divide(NOR, repositories) AS ORR",
        )
    )


def account_series(
    activities: DataFrame,
    keys: Sequence[str] = ("contributor",),
    carry: Sequence[str] = (),
    series: Sequence[str] = tuple(S.SERIES),
) -> DataFrame:
    """One row per account: the four counts, NAT as an ascending array, five statistics of the others.

    Each value of a series is a row, ranked within its account and series; sums and the values at
    the ranks around a quantile give the statistics. Nothing is collected, so rows stay small and
    what an account needs beyond memory is spilled. Account and series lie within the partitioning by
    account, so there is no further shuffle. The windows that feed series not asked for are pruned.
    """
    kinds = range(1, len(S.ACTIVITY_NAMES) + 1)
    ranked = [s for s in series if s != "NAT"]
    account = ", ".join(keys)
    # Series 0 stands for the activity itself.
    no = "CAST(NULL AS double)"
    values = [f"struct(0 AS s_no, {no} AS s_value, {no} AS s_mean, {no} AS s_std)"] + [
        f"CASE WHEN {s} IS NOT NULL THEN struct({n} AS s_no, {s} AS s_value, "
        f"{s}_mean AS s_mean, {s}_std AS s_std) END"
        for n, s in enumerate(ranked, start=1)
    ]
    rows = (
        series_rows(activities, keys)
        # Summed by time, before values are sorted: rounding of a mean on a tie depends on the order.
        .selectExpr(
            "*",
            *[f"avg({s}) OVER (PARTITION BY {account}) AS {s}_mean" for s in ranked],
            *[f"stddev_samp({s}) OVER (PARTITION BY {account}) AS {s}_std" for s in ranked],
        )
        .selectExpr(
            *keys,
            *carry,
            "activity_ord",
            "repository IS NOT NULL AS placed",
            "new_owner",
            "repo_ends",
            f"array_compact(array({', '.join(values)})) AS in_series",
        )
        .selectExpr("* EXCEPT (in_series)", "inline(in_series)")
        .selectExpr(
            "*",
            f"row_number() OVER (PARTITION BY {account}, s_no ORDER BY s_value) AS s_rank",
            f"count(1) OVER (PARTITION BY {account}, s_no) AS s_size",
        )
    )
    # NULL where the account has no activity of the kind; only rows with a repository count.
    counted = "CASE WHEN placed THEN 1D ELSE 0D END"
    by_series = rows.groupBy(*keys, "s_no").agg(
        *_aggregates(
            "count_if(s_no = 0) AS NA",
            "count_if(s_no = 0 AND new_owner) AS NOR",
            "count_if(s_no = 0 AND repo_ends) AS repositories",
            *[
                f"sum(CASE WHEN s_no = 0 AND activity_ord = {n} THEN {counted} END) AS kind_{n}"
                for n in kinds
            ],
            "max(s_size) AS s_size",
            "count_if(s_value <> 0) AS s_nonzero",
            "max(s_mean) AS s_mean",
            "max(s_std) AS s_std",
            "sum(s_value) AS s_total",
            "sum(s_value * (s_size - s_rank + 1)) AS s_ranked",
            *[
                f"max(CASE WHEN s_rank = {stats.below('s_size', q)} + {1 + up} THEN s_value END) AS s_at_{n}_{up}"
                for n, q in enumerate(stats.QUARTILES)
                for up in (0, 1)
            ],
            *[f"max({c}) AS {c}" for c in carry],
        )
    )
    first, median, third = (
        stats.interpolated(f"s_at_{n}_0", f"coalesce(s_at_{n}_1, s_at_{n}_0)", stats.part("s_size", q))
        for n, q in enumerate(stats.QUARTILES)
    )
    each = by_series.selectExpr(
        "*",
        f"{median} AS s_median",
        f"({third}) - ({first}) AS s_IQR",
        "CASE WHEN s_nonzero = 0 THEN 0D "
        "ELSE ((s_nonzero + 1) * s_total - 2 * s_ranked) / (s_nonzero * s_total) END AS s_gini",
    )
    # An account without any value in a series has no row for it.
    absent = {"std": "0D", "gini": "0D"}
    wide = each.groupBy(*keys).agg(
        *_aggregates(
            *[f"max({c}) AS {c}" for c in ("NA", "NOR", "repositories", *carry)],
            *[f"max(kind_{n}) AS kind_{n}" for n in kinds],
            *[
                f"coalesce(max(CASE WHEN s_no = {n} THEN s_{stat} END), {absent.get(stat, 'NULL')}) "
                f"AS {s}_{stat}"
                for n, s in enumerate(ranked, start=1)
                for stat in S.STATISTICS
            ],
        )
    )
    return with_kinds(wide)


def all_statistics(
    activities: DataFrame,
    keys: Sequence[str] = ("contributor",),
    carry: Sequence[str] = (),
    series: Sequence[str] = tuple(S.SERIES),
) -> DataFrame:
    """The four counts and all five statistics of the series, rounded to 3 digits."""
    columns = ["NA", "NT", "NOR", f"{stats.rounded('ORR')} AS ORR"]
    columns += [
        f"{stats.rounded(f'{name}_{stat}')} AS {name}_{stat}"
        for name in series
        for stat in S.STATISTICS
    ]
    return account_series(activities, keys, carry, series).selectExpr(*keys, *columns, *carry)


def extract_features(
    activities: DataFrame, keys: Sequence[str] = ("contributor",), carry: Sequence[str] = ()
) -> DataFrame:
    """The 38 features of each account, in model order."""
    return all_statistics(activities, keys, carry).select(*keys, *S.FEATURES, *carry)
