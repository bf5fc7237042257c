"""One call from event archive and login list to the result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from forgepulse import schema as S
from forgepulse.operators.extract import flatten_events
from forgepulse.operators.verdict import result_columns
from forgepulse.plans.pipeline import Scorer, accounts_for, progressive_classify
from forgepulse.sources.events import combine_logins, read_accounts, read_events, read_logins
from forgepulse.sources.results import in_input_order


def report(
    spark: SparkSession,
    events_path: str,
    accounts_path: str,
    score: Scorer,
    logins: Sequence[str] = (),
    logins_file: str | None = None,
    min_events: int = 5,
    min_confidence: float = 1.0,
    max_queries: int = S.MAX_PAGES,
    verbose: bool = False,
    file_format: str = "json",
    accounts_format: str | None = None,
) -> DataFrame:
    """Type and confidence of each asked login, in the order asked.

    Pages of the newest events are added, up to `max_queries`, until the confidence exceeds
    `min_confidence`. `verbose` adds the event count and the 38 features. `accounts_format` is
    the format of the account table where it differs from that of the events.
    """
    if not 1 <= min_events <= S.PAGE_SIZE * S.MAX_PAGES:
        raise ValueError(f"min_events must lie between 1 and {S.PAGE_SIZE * S.MAX_PAGES}")
    if not 0.0 <= min_confidence <= 1.0:
        raise ValueError("min_confidence must lie between 0 and 1")
    if max_queries not in range(1, S.MAX_PAGES + 1):
        raise ValueError(f"max_queries must lie between 1 and {S.MAX_PAGES}")
    if not logins and logins_file is None:
        raise ValueError("no logins given")
    listed = None if logins_file is None else read_logins(spark, logins_file)
    asked = combine_logins(spark, logins, listed)
    accounts = accounts_for(asked, read_accounts(spark, accounts_path, accounts_format or file_format))
    flat = flatten_events(read_events(spark, events_path, file_format))
    results = progressive_classify(
        accounts, flat, score, min_events, min_confidence, max_queries
    )
    return in_input_order(result_columns(results, verbose, ("input_pos",)))
