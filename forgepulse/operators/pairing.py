"""Find events that merely accompany another event, so that nothing is counted twice.

A companion and its main event are neighbours within a group of events of one account and
repository: releases with tags, issue closings with issue comments, and so on. An event belongs
to at most one group per round, so `lag` and `lead` within the group answer a whole round of
pairings at once. The look is symmetric: a companion sees its main event and thereby knows that
it is consumed, without any list of ids, join or shuffle beyond the one by account.

Round 1: release with tag, issue closing with comment, pull request reopening with comment, and
merges with pushes. Round 2, among the comments left over: issue reopening, rejected pull request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from forgepulse.functions.times import END_OF_TIME, close_in_time
from forgepulse.operators.looks import InAccount, InRanges

# Parts an event can play in a pairing; 0 is none. Small numbers keep the rows narrow.
RELEASE, TAG, ISSUE_CLOSED, ISSUE_REOPENED, ISSUE_COMMENT = 1, 2, 3, 4, 5
PR_REOPENED, MERGE, REJECT, PR_COMMENT, PUSH, OTHER_COMMENT = 6, 7, 8, 9, 10, 11
ROLE = f"""
CASE event_type
  WHEN 'ReleaseEvent' THEN {RELEASE}
  WHEN 'PushEvent' THEN {PUSH}
  WHEN 'CreateEvent' THEN CASE WHEN ref_type = 'tag' THEN {TAG} ELSE 0 END
  WHEN 'IssuesEvent' THEN CASE action WHEN 'closed' THEN {ISSUE_CLOSED}
                                      WHEN 'reopened' THEN {ISSUE_REOPENED} ELSE 0 END
  WHEN 'IssueCommentEvent' THEN CASE WHEN issue_number IS NOT NULL THEN {ISSUE_COMMENT}
                                     WHEN PR_number IS NOT NULL THEN {PR_COMMENT}
                                     ELSE {OTHER_COMMENT} END
  WHEN 'PullRequestEvent' THEN CASE WHEN action = 'reopened' THEN {PR_REOPENED}
                                    WHEN action = 'closed' AND merged THEN {MERGE}
                                    WHEN action = 'closed' AND NOT merged THEN {REJECT}
                                    ELSE 0 END
  ELSE 0
END
"""

# The activity an event would be if no gate or companion spoke against it. A commented review
# counts as 25 here, because it only stands in for missing review comments (21).
COMMENTED_REVIEW = 25
CANDIDATE = f"""
CASE event_type
  WHEN 'CreateEvent' THEN CASE ref_type WHEN 'repository' THEN 1 WHEN 'branch' THEN 2
                                        WHEN 'tag' THEN 4 END
  WHEN 'ReleaseEvent' THEN 3
  WHEN 'DeleteEvent' THEN CASE ref_type WHEN 'tag' THEN 5 WHEN 'branch' THEN 6 END
  WHEN 'PublicEvent' THEN 7
  WHEN 'MemberEvent' THEN 8
  WHEN 'ForkEvent' THEN 9
  WHEN 'WatchEvent' THEN 10
  WHEN 'GollumEvent' THEN 11
  WHEN 'IssuesEvent' THEN
    CASE action WHEN 'opened' THEN CASE WHEN num_comments > 0 OR issue_closed_at IS NOT NULL
                                        THEN 12 ELSE 13 END
                WHEN 'closed' THEN 14 WHEN 'reopened' THEN 15 END
  WHEN 'IssueCommentEvent' THEN CASE WHEN issue_number IS NOT NULL THEN 16
                                     WHEN PR_number IS NOT NULL THEN 20 END
  WHEN 'PullRequestEvent' THEN
    CASE action WHEN 'opened' THEN 17 WHEN 'reopened' THEN 18
                WHEN 'closed' THEN CASE WHEN merged IS NOT NULL THEN 19 END END
  WHEN 'PullRequestReviewCommentEvent' THEN 21
  WHEN 'PullRequestReviewEvent' THEN
    CASE WHEN review_state = 'commented' THEN {COMMENTED_REVIEW} ELSE 22 END
  WHEN 'CommitCommentEvent' THEN 23
  WHEN 'PushEvent' THEN 24
END
"""
# The object a collapsing activity is about, see `EMISSION_KEYS` of the activities.
SUBJECT = """
CASE WHEN candidate = 3 THEN release_node_id
     WHEN candidate IN (14, 15) THEN issue_node_id
     WHEN candidate IN (18, 19) THEN PR_node_id
     WHEN candidate = 22 THEN review_node_id END
"""
_COMMENT = f"role IN ({ISSUE_COMMENT}, {PR_COMMENT}, {OTHER_COMMENT})"
_PR_CLOSING = "event_type = 'PullRequestEvent' AND action = 'closed'"

# Groups of each round; 0 takes part in nothing.
GROUP_1 = f"""
CASE WHEN role IN ({MERGE}, {PUSH}) THEN 4
     WHEN repository IS NULL THEN 0
     WHEN role IN ({RELEASE}, {TAG}) THEN 1
     WHEN item_number IS NULL THEN 0
     WHEN role IN ({ISSUE_CLOSED}, {ISSUE_COMMENT}) THEN 2
     WHEN role IN ({PR_REOPENED}, {PR_COMMENT}) THEN 3
     ELSE 0 END
"""
GROUP_2 = f"""
CASE WHEN repository IS NULL OR item_number IS NULL OR taken_1 THEN 0
     WHEN role IN ({ISSUE_REOPENED}, {ISSUE_COMMENT}) THEN 5
     WHEN role IN ({REJECT}, {PR_COMMENT}) THEN 6
     ELSE 0 END
"""
# Pull requests and issues are numbered together, but an issue event that reports on a pull
# request takes no part in issue pairings.
ITEM_NUMBER = f"""
CASE WHEN role IN ({ISSUE_CLOSED}, {ISSUE_REOPENED}, {ISSUE_COMMENT}) THEN issue_number
     WHEN role > 0 THEN PR_number END
"""
_MAIN = f"role NOT IN ({TAG}, {ISSUE_COMMENT}, {PR_COMMENT})"


def _link(group: str, stated: int, extra: str = "") -> str:
    """What a neighbour has to know; `stated` is the group that also compares the state."""
    text = f"CASE WHEN {group} = 1 THEN tag WHEN {group} = {stated} THEN state ELSE '' END"
    return (
        f"CASE WHEN {group} > 0 THEN struct({_MAIN} AS main, coalesce(item_number, 0) AS number, "
        f"{text} AS text, created_at AS at, event_id AS id{extra}) END"
    )


def _pair(left: str, right: str, timed: str = "true") -> str:
    """Are these two neighbours main event and companion of the same thing?"""
    return (
        f"coalesce({left}.main != {right}.main AND {left}.number = {right}.number "
        f"AND {left}.text = {right}.text AND ({timed}), false)"
    )


# What an account has anywhere opens whole steps; flags are true for an event that shows it.
GATES = {
    "transfer_open": "event_type IN ('IssuesEvent', 'IssueCommentEvent') "
    "AND PR_number IS NULL AND PR_node_id IS NULL",
    "close_named": f"(role = {ISSUE_CLOSED} OR {_COMMENT}) AND issue_node_id IS NOT NULL",
    "close_dated": f"(role = {ISSUE_CLOSED} OR {_COMMENT}) AND issue_closed_at IS NOT NULL",
    "pr_reopen_open": f"(role = {PR_REOPENED} OR {_COMMENT}) AND PR_node_id IS NOT NULL",
    "merged_known": f"{_PR_CLOSING} AND merged IS NOT NULL",
    "reviews_known": "event_type = 'PullRequestReviewEvent'",
    "review_comments_known": "event_type = 'PullRequestReviewCommentEvent'",
}
GATES_2 = {
    "reopen_open": "names_issue AND NOT taken_1",
    "names_pr_left": "names_pr AND NOT taken_1",
}
# What is still needed of an event once its flags are known.
_NEEDED = [
    "event_id", "login", "repository", "event_type", "created_at", "comment_node_id", "state",
    "issue_closed_at", "role", "candidate", "subject", "item_number", "tag", "sort_time",
    "names_issue", "names_pr", *GATES,
]


def _flags(conditions: dict[str, str]) -> list[str]:
    return [f"coalesce({condition}, false) AS {name}" for name, condition in conditions.items()]


def resolve_pairs(
    events: DataFrame, keys: Sequence[str] = ("login",), look: InAccount | InRanges | None = None
) -> DataFrame:
    """Add pairing results and account-level gates to deduplicated flat events.

    `keys` identify one account's event set. For round N in 1, 2: `prev_N` and `next_N` tell
    whether the neighbour is the other half of a pair, `prev_N_id` and `next_N_id` name it. All
    are false where an account-level gate closes the whole step. `look` decides how events see
    others; with `InRanges` accounts may have any size, and only the columns needed remain.
    """
    look = look or InAccount(keys)
    prepared = (
        events.selectExpr("*", f"{ROLE} AS role", f"{CANDIDATE} AS candidate")
        .selectExpr(
            "*",
            f"{SUBJECT} AS subject",
            f"{ITEM_NUMBER} AS item_number",
            "coalesce(tag_name, ref) AS tag",
            f"coalesce(created_at, {END_OF_TIME}) AS sort_time",
            f"(role = {ISSUE_REOPENED} OR {_COMMENT}) AND issue_node_id IS NOT NULL AS names_issue",
            f"coalesce({_PR_CLOSING} OR {_COMMENT}, false) AND PR_node_id IS NOT NULL AS names_pr",
        )
        .selectExpr("*", *_flags(GATES))
    )
    # Account-level gates first: most flat columns are needed for nothing beyond them.
    gated = look.anywhere(look.begin(prepared, _NEEDED), list(GATES)).selectExpr(
        "* EXCEPT (close_named, close_dated)", "close_named AND close_dated AS close_open"
    )
    round_1 = look.beside(
        gated.selectExpr("*", f"{GROUP_1} AS group_1").selectExpr("*", f"{_link('group_1', 2)} AS link_1"),
        1,
    )
    # Merges and pushes pair many to many.
    round_1 = look.nearby(round_1, {"push_near": PUSH, "merge_near": MERGE})
    # A release takes the tag after it if the names agree, however late, and only otherwise the
    # one before it; a tag has to see that choice from its side.
    gate_1 = """CASE group_1 WHEN 1 THEN true WHEN 2 THEN close_open
                             WHEN 3 THEN pr_reopen_open ELSE false END"""
    rival_of_next = f"group_1 = 1 AND role = {TAG} AND {_pair('n_1', 'n2_1')}"
    rival_of_prev = f"group_1 = 1 AND role = {RELEASE} AND {_pair('link_1', 'n_1')}"
    near_next = close_in_time("link_1.at", "n_1.at")
    near_prev = close_in_time("link_1.at", "p_1.at")
    taken_1 = (
        round_1.selectExpr(
            "*",
            f"{gate_1} AND {_pair('link_1', 'n_1', near_next)} AND NOT ({rival_of_next}) AS next_1",
            f"{gate_1} AND {_pair('link_1', 'p_1', near_prev)} AND NOT ({rival_of_prev}) AS prev_1",
        )
        .selectExpr(
            "* EXCEPT (link_1, p_1, n_1, n2_1)",
            "prev_1 OR next_1 AS taken_1",
            "p_1.id AS prev_1_id",
            "n_1.id AS next_1_id",
        )
    )
    settled = look.settled(taken_1).selectExpr("*", *_flags(GATES_2))
    gated_2 = look.anywhere(settled, list(GATES_2)).selectExpr(
        "* EXCEPT (names_pr_left)", "merged_known AND names_pr_left AS pr_close_open"
    )
    round_2 = look.beside(
        gated_2.selectExpr("*", f"{GROUP_2} AS group_2").selectExpr(
            "*", f"{_link('group_2', 6, ', comment_node_id AS node')} AS link_2"
        ),
        2,
    )
    gate_2 = "CASE group_2 WHEN 5 THEN reopen_open WHEN 6 THEN pr_close_open ELSE false END"

    def timed_2(other: str) -> str:
        return f"group_2 = 6 OR {close_in_time('link_2.at', f'{other}.at')}"

    return (
        round_2.selectExpr(
            "*",
            f"{gate_2} AND {_pair('link_2', 'n_2', timed_2('n_2'))} AS next_2",
            f"{gate_2} AND {_pair('link_2', 'p_2', timed_2('p_2'))} AS prev_2",
            f"""coalesce(pr_close_open AND created_at IS NOT NULL
                        AND CASE role WHEN {MERGE} THEN push_near
                                      WHEN {PUSH} THEN merge_near END, false) AS merge_push""",
        )
        .selectExpr(
            "* EXCEPT (link_2, p_2, n_2, push_near, merge_near, merged_known, names_issue, names_pr)",
            "prev_2 OR next_2 AS taken_2",
            "p_2.id AS prev_2_id",
            "n_2.id AS next_2_id",
            "p_2.node AS prev_2_node",
            "n_2.node AS next_2_node",
        )
    )
