"""Schemas and the names that are part of the result contract."""

from __future__ import annotations

from pyspark.sql import types as T

_text, _long, _bool, _time = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One event as archived: nested JSON, only the paths the jobs read.
RAW_EVENT = _struct(
    id=_text,
    type=_text,
    created_at=_text,
    actor=_struct(login=_text),
    repo=_struct(name=_text),
    payload=_struct(
        push_id=_long,
        action=_text,
        ref=_text,
        ref_type=_text,
        pull_request=_struct(number=_long, state=_text, node_id=_text, merged=_bool),
        issue=_struct(
            number=_long, state=_text, node_id=_text, html_url=_text, closed_at=_text, comments=_long
        ),
        comment=_struct(node_id=_text),
        review=_struct(state=_text, node_id=_text),
        release=_struct(tag_name=_text, node_id=_text),
    ),
)

# The same event flattened: always these 23 nullable columns.
FLAT_EVENT = _struct(
    event_id=_long,
    event_type=_text,
    login=_text,
    repository=_text,
    created_at=_time,
    push_id=_long,
    action=_text,
    PR_number=_long,
    state=_text,
    PR_node_id=_text,
    merged=_bool,
    comment_node_id=_text,
    review_state=_text,
    review_node_id=_text,
    PR_closed_at=_text,
    issue_number=_long,
    issue_node_id=_text,
    issue_closed_at=_time,
    num_comments=_long,
    ref=_text,
    ref_type=_text,
    tag_name=_text,
    release_node_id=_text,
)

ACCOUNT = _struct(login=_text, declared_type=_text, lookup_failed=_bool)

# Event type names of the source data that code refers to by name.
PUSH = "PushEvent"
PULL_REQUEST = "PullRequestEvent"
REVIEW = "PullRequestReviewEvent"
REVIEW_COMMENT = "PullRequestReviewCommentEvent"
ISSUES = "IssuesEvent"
ISSUE_COMMENT = "IssueCommentEvent"
CREATE = "CreateEvent"
RELEASE = "ReleaseEvent"
FORK = "ForkEvent"
WATCH = "WatchEvent"

# Activity names, numbered 1..24 in order of precedence.
ACTIVITY_NAMES = [
    "Creating repository",
    "Creating branch",
    "Publishing a release",
    "Creating tag",
    "Deleting tag",
    "Deleting branch",
    "Making repository public",
    "Adding collaborator to repository",
    "Forking repository",
    "Starring repository",
    "Editing wiki page",
    "Transferring issue",
    "Opening issue",
    "Closing issue",
    "Reopening issue",
    "Commenting issue",
    "Opening pull request",
    "Reopening pull request",
    "Closing pull request",
    "Commenting pull request",
    "Commenting pull request changes",
    "Reviewing code",
    "Commenting commit",
    "Pushing commits",
]

# The statistics kept of each series, in the order a model expects.
KEPT_STATISTICS = {
    "DCA": ["mean", "median", "std", "gini"],
    "NAR": ["mean", "median", "gini", "IQR"],
    "NTR": ["mean", "median", "std", "gini"],
    "NCAR": ["mean", "std", "IQR"],
    "DCAR": ["mean", "median", "std", "IQR"],
    "DAAR": ["mean", "median", "std", "gini", "IQR"],
    "DCAT": ["mean", "median", "std", "gini", "IQR"],
    "NAT": ["mean", "median", "std", "gini", "IQR"],
}
COUNT_FEATURES = ["NA", "NT", "NOR", "ORR"]
SERIES = list(KEPT_STATISTICS)
STATISTICS = ["mean", "median", "std", "gini", "IQR"]
FEATURES = COUNT_FEATURES + [f"{s}_{stat}" for s in SERIES for stat in KEPT_STATISTICS[s]]

PAGE_SIZE = 100
MAX_PAGES = 3
