"""Flatten nested event JSON into the fixed 23-column event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forgepulse.functions.times import parsed_time

_ISSUE_FAMILY = "type IN ('IssuesEvent', 'IssueCommentEvent')"
_PR_FAMILY = (
    "type IN ('PullRequestEvent', 'PullRequestReviewEvent', 'PullRequestReviewCommentEvent')"
)
_REFS = "type IN ('CreateEvent', 'DeleteEvent')"
# Issue events also report on pull requests; only the page address tells which.
_ON_PR = "coalesce(contains(payload.issue.html_url, '/pull/'), false)"
_PR_BY_ISSUE = f"{_ISSUE_FAMILY} AND {_ON_PR}"
_PLAIN_ISSUE = f"{_ISSUE_FAMILY} AND NOT {_ON_PR}"


def _routed(*routes: tuple[str, str]) -> str:
    """First path whose condition holds, else NULL."""
    return "CASE " + " ".join(f"WHEN {test} THEN {path}" for test, path in routes) + " END"


def flatten_events(raw: DataFrame) -> DataFrame:
    """`raw` has the RAW_EVENT shape. A path that is missing gives NULL."""
    pr, issue = "payload.pull_request", "payload.issue"
    review, release = "type = 'PullRequestReviewEvent'", "type = 'ReleaseEvent'"
    commenting = (
        "type IN ('PullRequestReviewCommentEvent', 'IssueCommentEvent', 'CommitCommentEvent')"
    )
    columns = {
        "event_id": "try_cast(id AS bigint)",
        "event_type": "type",
        "login": "actor.login",
        "repository": "repo.name",
        "created_at": parsed_time("created_at"),
        "push_id": _routed(("type = 'PushEvent'", "payload.push_id")),
        "action": _routed((f"{_PR_FAMILY} OR {_ISSUE_FAMILY}", "payload.action")),
        "PR_number": _routed((_PR_FAMILY, f"{pr}.number"), (_PR_BY_ISSUE, f"{issue}.number")),
        "state": _routed((_PR_FAMILY, f"{pr}.state"), (_ISSUE_FAMILY, f"{issue}.state")),
        "PR_node_id": _routed((_PR_FAMILY, f"{pr}.node_id"), (_PR_BY_ISSUE, f"{issue}.node_id")),
        "merged": _routed(("type = 'PullRequestEvent'", f"{pr}.merged")),
        "comment_node_id": _routed((commenting, "payload.comment.node_id")),
        "review_state": _routed((review, "payload.review.state")),
        "review_node_id": _routed((review, "payload.review.node_id")),
        "PR_closed_at": _routed((_PR_BY_ISSUE, f"{issue}.closed_at")),
        "issue_number": _routed((_PLAIN_ISSUE, f"{issue}.number")),
        "issue_node_id": _routed((_PLAIN_ISSUE, f"{issue}.node_id")),
        "issue_closed_at": _routed((_PLAIN_ISSUE, parsed_time(f"{issue}.closed_at"))),
        "num_comments": _routed((_ISSUE_FAMILY, f"{issue}.comments")),
        "ref": _routed((_REFS, "payload.ref")),
        "ref_type": _routed((_REFS, "payload.ref_type")),
        "tag_name": _routed((release, "payload.release.tag_name")),
        "release_node_id": _routed((release, "payload.release.node_id")),
    }
    return raw.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def split_repository(df: DataFrame) -> DataFrame:
    """Add `owner` and `repo`, the two parts of `repository`; a missing part is NULL."""
    parts = F.split("repository", "/", -1)
    return df.withColumns({"owner": F.get(parts, F.lit(0)), "repo": F.get(parts, F.lit(1))})
