"""From a bot probability and the account declaration to a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame

from forgepulse import schema as S
from forgepulse.functions.stats import rounded

TYPE_OF_SCORE = "CASE WHEN p_bot <= 0.5 THEN 'Human' WHEN p_bot > 0.5 THEN 'Bot' END"
CONFIDENCE_OF_SCORE = rounded("abs(p_bot - 0.5) * 2")

_UNDECLARED = "(lookup_failed OR declared_type IS NULL)"
_DECLARED_OTHER = "declared_type != 'User'"


def verdicts(scored: DataFrame) -> DataFrame:
    """`type` and `confidence` of each row from its `p_bot`."""
    return scored.selectExpr(
        "*", f"{TYPE_OF_SCORE} AS type", f"{CONFIDENCE_OF_SCORE} AS confidence"
    )


def gated_verdicts(scored: DataFrame, min_events: int) -> DataFrame:
    """Like `verdicts`, but an account with fewer than `min_events` events stays `Unknown`."""
    return scored.selectExpr(
        "*",
        f"CASE WHEN events < {min_events} THEN 'Unknown' ELSE {TYPE_OF_SCORE} END AS type",
        f"CASE WHEN events >= {min_events} THEN {CONFIDENCE_OF_SCORE} END AS confidence",
    )


def declared_verdicts(accounts: DataFrame, judged: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One result per account row; `judged` has the verdicts of accounts declared `User`.

    Accounts that could not be looked up are `Invalid`; any other declared type is taken over with
    full confidence; users without any activity are `Unknown` with 0 events. Absent is NULL.
    """
    joined = accounts.join(judged.withColumnRenamed("contributor", "login"), "login", "left")
    is_user = f"NOT {_UNDECLARED} AND NOT {_DECLARED_OTHER}"
    return joined.selectExpr(
        "login AS contributor",
        f"""CASE WHEN {_UNDECLARED} THEN 'Invalid' WHEN {_DECLARED_OTHER} THEN declared_type
                 ELSE coalesce(type, 'Unknown') END AS type""",
        f"""CASE WHEN {_UNDECLARED} THEN NULL WHEN {_DECLARED_OTHER} THEN 1.0D
                 ELSE confidence END AS confidence""",
        f"CASE WHEN {is_user} THEN coalesce(events, 0L) END AS events",
        *S.FEATURES,
        *carry,
    )


def result_columns(results: DataFrame, verbose: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """The short result (type, confidence) or, if `verbose`, events and all features too."""
    columns = ["contributor", "type", "confidence"]
    if verbose:
        columns += ["events", *S.FEATURES]
    return results.select(*columns, *carry)
