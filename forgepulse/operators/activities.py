"""Turn resolved events into activities of 24 kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from forgepulse import schema as S
from forgepulse.operators.pairing import (
    COMMENTED_REVIEW,
    ISSUE_COMMENT,
    MERGE,
    PR_COMMENT,
    PUSH,
    TAG,
    resolve_pairs,
)

# Number of the activity that swallowed the event as a companion.
CONSUMED_BY = f"""
CASE WHEN role = {TAG} AND taken_1 THEN 3
     WHEN role = {ISSUE_COMMENT} AND taken_1 THEN 14
     WHEN role = {ISSUE_COMMENT} AND taken_2 THEN 15
     WHEN role = {PR_COMMENT} AND taken_1 THEN 18
     WHEN role = {PR_COMMENT} AND taken_2 THEN 19
     WHEN role = {PUSH} AND merge_push THEN 19
     -- where review comments are reported, they stand for the commented reviews
     WHEN review_comments_known AND candidate = {COMMENTED_REVIEW} THEN 21 END
"""

_FREE = "NOT taken_1 AND NOT taken_2"

# Condition of each activity by number; on one event at most one of them holds.
RULES = {number: f"candidate = {number}" for number in range(1, 25)}
RULES |= {
    4: "candidate = 4 AND NOT taken_1",
    12: "candidate = 12 AND transfer_open",
    13: "candidate = 13 OR candidate = 12 AND NOT transfer_open",
    14: "candidate = 14 AND close_open",
    15: "candidate = 15 AND reopen_open",
    16: f"candidate = 16 AND {_FREE}",
    18: "candidate = 18 AND pr_reopen_open",
    19: "candidate = 19 AND pr_close_open",
    20: f"candidate = 20 AND {_FREE}",
    21: f"""candidate = 21 AND reviews_known
            OR candidate = {COMMENTED_REVIEW} AND NOT review_comments_known""",
    24: "candidate = 24 AND NOT merge_push",
}


def _key(label: str, extra: str = "CAST(NULL AS string)") -> str:
    return f"struct(activity_ord AS kind, {label} AS label, subject, {extra} AS extra)"


# For activities that collapse by content: the keys an event emits. Two emissions at the same
# time in the same repository with equal keys are one activity. A rejected pull request emits
# one key per adjacent comment, hence possibly two.
EMISSION_KEYS = {
    3: f"array({_key('taken_1')})",
    14: "array("
    + _key("taken_1", "CASE WHEN NOT taken_1 THEN CAST(issue_closed_at AS string) END")
    + ")",
    15: f"array({_key('taken_2')})",
    18: f"CASE WHEN taken_1 THEN array({_key('true')}) END",
    19: f"""CASE WHEN role = {MERGE} THEN array({_key('merge_push', "'merge'")})
                 WHEN prev_2 AND next_2 THEN array_distinct(array(
                      {_key('true', "concat('comment ', prev_2_node)")},
                      {_key('true', "concat('comment ', next_2_node)")}))
                 WHEN taken_2 THEN array({_key(
                      'true', "concat('comment ', if(prev_2, prev_2_node, next_2_node))")})
                 ELSE array({_key('false', "'reject'")}) END""",
    22: f"array({_key('false')})",
}


def _choice(branches: dict[int, str], test: str = "{condition}", result: str = "{number}") -> str:
    parts = " ".join(
        "WHEN " + test.format(number=n, condition=c) + " THEN " + result.format(number=n, condition=c)
        for n, c in branches.items()
    )
    return f"CASE {parts} END"


def _name_of(number: str) -> str:
    names = ", ".join(f"'{name}'" for name in S.ACTIVITY_NAMES)
    return f"element_at(array({names}), {number})"


def emit_activities(
    resolved: DataFrame,
    keys: Sequence[str] = ("login",),
    only: Sequence[int] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Activities of resolved events: contributor, repository, activity, date, event_id, order.

    `only` restricts the kinds; the plan then drops every pairing window they do not need.
    `carry` names account-level columns to keep.
    """
    wanted = set(only or RULES)
    rules = {n: rule for n, rule in RULES.items() if n in wanted}
    collapsing = {n: key for n, key in EMISSION_KEYS.items() if n in wanted}

    emitted = resolved.selectExpr("*", f"{_choice(rules)} AS activity_ord").filter(
        "activity_ord IS NOT NULL"
    )
    if collapsing:
        own = _choice(collapsing, test="activity_ord = {number}", result="{condition}")
        # Rows of one second in one repository and pairing group lie together already. Events that
        # don't collapse have no key and stay.
        same_time = f"{', '.join(keys)}, repository, group_2, sort_time"
        emitted = (
            emitted.selectExpr("*", f"explode_outer({own}) AS emission_key")
            .selectExpr(
                "*",
                f"row_number() OVER (PARTITION BY {same_time}, emission_key ORDER BY event_id) "
                "AS emission",
            )
            .filter("emission_key IS NULL OR emission = 1")
        )
    extra_keys = [k for k in keys if k != "login"]
    return emitted.selectExpr(
        "login AS contributor",
        *extra_keys,
        "repository",
        f"{_name_of('activity_ord')} AS activity",
        "created_at AS date",
        "event_id",
        "activity_ord",
        *carry,
    )


def event_fates(resolved: DataFrame) -> DataFrame:
    """What became of each event: `emitted`, `consumed` (and by which activity) or `dropped`."""
    numbered = resolved.selectExpr("*", f"{CONSUMED_BY} AS by", f"{_choice(RULES)} AS number")
    return numbered.selectExpr(
        "event_id",
        "login",
        "repository",
        "event_type",
        "created_at",
        """CASE WHEN by IS NOT NULL THEN 'consumed' WHEN number IS NOT NULL THEN 'emitted'
                ELSE 'dropped' END AS fate""",
        f"{_name_of('by')} AS consumed_by",
        f"{_name_of('number')} AS activity",
    )


def identify_activities(
    events: DataFrame, keys: Sequence[str] = ("login",), only: Sequence[int] | None = None
) -> DataFrame:
    """Activities of deduplicated flat events, all of them."""
    return emit_activities(resolve_pairs(events, keys), keys, only)
