"""How an event sees others of its account: the next ones of its group, and flags of the account.

`InAccount` answers by windows that hold an account in one task, without a shuffle of its own.
`InRanges` answers for accounts of any size: events are stored once in ranges of (account, repository, time),
which serve both rounds, windows work inside the part of a group that lies in a range, and what reaches
over the edge of a range comes from one small row per group and range, as in `any_size`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from forgepulse.functions.times import PAIR_TOLERANCE
from forgepulse.operators.numbering import PART, ranged, written

# Frames grow from the start of the order only. One that shrinks towards the end is computed anew for every
# row, which is quadratic; what follows a row is looked up in descending order instead.
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


class InAccount:
    """Windows within one partitioning by account; `keys` identify one account's event set."""

    def __init__(self, keys: Sequence[str] = ("login",)) -> None:
        self.account = ", ".join(keys)

    def begin(self, rows: DataFrame, needed: Sequence[str]) -> DataFrame:
        return rows

    def settled(self, rows: DataFrame) -> DataFrame:
        """What a round has found, for the next one."""
        return rows

    def anywhere(self, rows: DataFrame, flags: Sequence[str]) -> DataFrame:
        """Each flag becomes true where it is true for any event of the account."""
        seen = [f"max({f}) OVER (PARTITION BY {self.account}) AS {f}" for f in flags]
        return rows.selectExpr(f"* EXCEPT ({', '.join(flags)})", *seen)

    def beside(self, rows: DataFrame, n: int) -> DataFrame:
        """Add p_n and n_n, the links of the neighbours in group_n by time, and n2_n in round 1."""
        by = f"OVER (PARTITION BY {self.account}, repository, group_{n} ORDER BY sort_time, event_id)"
        looks = [f"lag(link_{n}) {by} AS p_{n}", f"lead(link_{n}) {by} AS n_{n}"]
        if n == 1:
            looks.append(f"lead(link_{n}, 2) {by} AS n2_{n}")
        return rows.selectExpr("*", *looks)

    def nearby(self, rows: DataFrame, roles: dict[str, int]) -> DataFrame:
        """Whether events of a role lie in the group within the tolerance, by name of the answer."""
        frame = (
            f"OVER (PARTITION BY {self.account}, repository, group_1 ORDER BY sort_time "
            f"RANGE BETWEEN {PAIR_TOLERANCE} PRECEDING AND {PAIR_TOLERANCE} FOLLOWING)"
        )
        return rows.selectExpr("*", *[f"max(role = {r}) {frame} AS {name}" for name, r in roles.items()])


class InRanges:
    """The same over stored ranges; accounts are told apart by login.

    A repository lies in neighbouring ranges, and so does each of its groups: there are no more rows of
    groups and ranges than groups and ranges, times the few groups of a repository. No window holds more
    than a range of events, or the rows of ranges of a group. What round 1 found is stored as well, so that
    the several looks of round 2 read it instead of finding it again.
    """

    account = "login"

    def begin(self, rows: DataFrame, needed: Sequence[str]) -> DataFrame:
        """The columns needed, in ranges of account, repository and time."""
        # Many events without id may share a time, so a draw spreads them over ranges.
        drawn = rows.select(*needed).withColumn("__tie", F.rand(7))
        held = ranged(drawn, ["login", "repository", "sort_time", "event_id", "__tie"], "resolving")
        return held.selectExpr("* EXCEPT (__tie)", f"{PART} AS part")

    def settled(self, rows: DataFrame) -> DataFrame:
        return written(rows, "paired")

    def _joined(
        self, rows: DataFrame, edges: DataFrame, keys: Sequence[str], how: str = "inner"
    ) -> DataFrame:
        named = edges.withColumnsRenamed({k: f"edge_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"edge_{k}")) for k in keys]
        return rows.join(named, same, how).drop(*[f"edge_{k}" for k in keys])

    def anywhere(self, rows: DataFrame, flags: Sequence[str]) -> DataFrame:
        seen = rows.groupBy("login", "part").agg(*[F.max(f).alias(f) for f in flags])
        seen = seen.select(
            "login", "part", *[F.expr(f"max({f}) OVER (PARTITION BY login)").alias(f) for f in flags]
        )
        return self._joined(rows.drop(*flags), seen, ("login", "part"))

    def beside(self, rows: DataFrame, n: int) -> DataFrame:
        group, link = f"group_{n}", f"link_{n}"
        by = ["login", "repository", group]
        within = f"OVER (PARTITION BY {', '.join(by)}, part ORDER BY __at)"
        kept = rows.selectExpr(
            "*",
            f"lag({link}) {within} AS p_here",
            f"lead({link}) {within} AS n_here",
            f"lead({link}, 2) {within} AS n2_here",
            f"row_number() {within} AS place_here",
        )
        parts = f"OVER (PARTITION BY {', '.join(by)} ORDER BY part)"
        # Events of no group have no links, hence no neighbours.
        edges = (
            kept.filter(f"{group} > 0")
            .groupBy(*by, "part")
            .agg(
                F.expr(f"max(CASE WHEN place_here = 1 THEN {link} END) AS head"),
                F.expr(f"max(CASE WHEN place_here = 2 THEN {link} END) AS second"),
                F.expr(f"max(CASE WHEN n_here IS NULL THEN {link} END) AS tail"),
            )
            .selectExpr(
                *by,
                "part",
                f"lag(tail) {parts} AS p_part",
                f"lead(head) {parts} AS n_part",
                f"coalesce(lead(second) {parts}, lead(head, 2) {parts}) AS n2_part",
            )
        )
        looks = [f"coalesce(p_here, p_part) AS p_{n}", f"coalesce(n_here, n_part) AS n_{n}"]
        if n == 1:
            looks.append(
                "coalesce(n2_here, CASE WHEN n_here IS NULL THEN n2_part ELSE n_part END) AS n2_1"
            )
        inner = "p_here, n_here, n2_here, place_here, p_part, n_part, n2_part"
        return self._joined(kept, edges, [*by, "part"], "left").selectExpr(f"* EXCEPT ({inner})", *looks)

    def nearby(self, rows: DataFrame, roles: dict[str, int]) -> DataFrame:
        """The nearest event of a role on either side decides; it may lie in another range."""
        by = ["login", "repository", "group_1"]
        chosen = f"role IN ({', '.join(map(str, roles.values()))})"
        within = f"OVER (PARTITION BY {', '.join(by)}, part ORDER BY __at"
        back = f"{within} DESC {_UP_TO})"
        own = {name: f"CASE WHEN role = {r} THEN sort_time END" for name, r in roles.items()}
        edges = rows.filter(chosen).groupBy(*by, "part").agg(
            *[F.expr(f"max({t}) AS last_{name}") for name, t in own.items()],
            *[F.expr(f"min({t}) AS first_{name}") for name, t in own.items()],
        )
        parts = f"OVER (PARTITION BY {', '.join(by)} ORDER BY part"
        edges = edges.selectExpr(
            *by,
            "part",
            *[f"max(last_{name}) {parts} {_BEFORE}) AS last_{name}" for name in own],
            *[f"min(first_{name}) {parts} DESC {_BEFORE}) AS first_{name}" for name in own],
        )
        return self._joined(rows, edges, [*by, "part"], "left").selectExpr(
            f"* EXCEPT ({', '.join(f'last_{name}, first_{name}' for name in own)})",
            *[
                f"coalesce(sort_time <= greatest(last_{name}, max({t}) {within} {_UP_TO})) + {PAIR_TOLERANCE}"
                f" OR sort_time >= least(first_{name}, min({t}) {back}) - {PAIR_TOLERANCE}, false)"
                f" AS {name}"
                for name, t in own.items()
            ],
        )
