"""Golden activities of small hand-written event sequences."""

import pytest
from helpers import (
    event, flat, issue, issue_comment, pr_comment, pull, push, release, review, review_comment, tag,
)

from forgepulse import schema as S
from forgepulse.plans import pipeline

CASES = {
    "far next tag beats near previous tag": (
        [tag(1, 0), release(2, 1), tag(3, 10)],
        ["Creating tag", "Creating tag", "Publishing a release"],
    ),
    "previous tag is taken when the next one has another name": (
        [tag(1, 0), release(2, 1), tag(3, 2, name="v2")],
        ["Creating tag", "Publishing a release"],
    ),
    "tag between two releases": (
        [release(1, 0), tag(2, 1), release(3, 2)],
        ["Publishing a release"] * 2,
    ),
    "same release node at the same second": (
        [release(1, 0, release_node="x"), release(2, 0)],
        ["Publishing a release"],
    ),
    "close with comments on both sides": (
        [issue_comment(1, 0, state="closed"), issue(2, 1, "closed"), issue_comment(3, 2, state="closed")],
        ["Closing issue"],
    ),
    "comment of another state stays": (
        [issue(1, 0, "closed"), issue_comment(2, 1, state="open")],
        ["Closing issue", "Commenting issue"],
    ),
    "comment just outside": (
        [issue(1, 0, "closed"), issue_comment(2, 3, state="closed")],
        ["Closing issue", "Commenting issue"],
    ),
    "close takes the comment before reopen can": (
        [issue(1, 0, "closed"), issue_comment(2, 1, state="closed"), issue(3, 2, "reopened")],
        ["Closing issue", "Reopening issue"],
    ),
    "reopening takes a comment": (
        [issue(1, 0, "reopened"), issue_comment(2, 2)],
        ["Reopening issue"],
    ),
    "pull request reopening takes a comment": (
        [pr_comment(1, 0), pull(2, 1, "reopened"), pr_comment(3, 40)],
        ["Commenting pull request", "Reopening pull request"],
    ),
    "rejection counts once per adjacent comment, at any distance": (
        [pr_comment(1, 0, state="closed"), pull(2, 500, "closed"), pr_comment(3, 900, state="closed")],
        ["Closing pull request"] * 2,
    ),
    "rejection without comment": ([pull(1, 0, "closed")], ["Closing pull request"]),
    "push shared by two merges": (
        [pull(1, 0, "closed", pr=1, merged=True), push(2, 1), pull(3, 2, "closed", pr=2, merged=True)],
        ["Closing pull request"] * 2,
    ),
    "push in another repository stays": (
        [pull(1, 0, "closed", merged=True), push(2, 1, repository="org/other")],
        ["Closing pull request", "Pushing commits"],
    ),
    "closed with unknown merge state is never reported": (
        [pull(1, 0, "closed", merged=None), push(2, 1)],
        ["Pushing commits"],
    ),
    "review comment without any review": ([review_comment(1, 0)], []),
    "review comments stand for all commented reviews": (
        [review_comment(1, 0, pr=1), review(2, 5, "commented", pr=2)],
        ["Commenting pull request changes"],
    ),
    "commented review alone": ([review(1, 0, "commented")], ["Commenting pull request changes"]),
    "missing review state counts as review": ([review(1, 0, None)], ["Reviewing code"]),
    "closings vanish when no closing time is known": (
        [issue(1, 0, "closed", issue_closed_at=None)],
        [],
    ),
    "other events in between do not separate a pair": (
        [issue(1, 0, "closed"), pr_comment(2, 1), push(3, 1), issue_comment(4, 2, state="closed")],
        ["Closing issue", "Commenting pull request", "Pushing commits"],
    ),
    "transferred or opened": (
        [issue(1, 0, "opened", num_comments=2), issue(2, 5, "opened", issue=8)],
        ["Opening issue", "Transferring issue"],
    ),
    "unknown types only": ([event(1, "SponsorshipEvent")], []),
    "repeated event counts once": ([push(1, 0), push(1, 0)], ["Pushing commits"]),
    "no pairing across accounts": (
        [issue(1, 0, "closed"), issue_comment(2, 1, state="closed", login="bob"),
         issue(3, 50, "closed", login="bob", issue=8)],
        ["Closing issue", "Closing issue", "Commenting issue"],
    ),
    "events without time are not close to anything": (
        [pull(1, None, "closed", merged=True), push(2, None)],
        ["Closing pull request", "Pushing commits"],
    ),
}
# the helper names nodes by event number; this case needs one shared node
for row in CASES["same release node at the same second"][0]:
    row["release_node_id"] = "REL"
    row.pop("release_node", None)


@pytest.fixture(scope="module")
def found(spark):
    """All cases in one job: each case becomes accounts of its own."""
    rows = []
    for index, (events, _) in enumerate(CASES.values()):
        rows += [{**e, "login": f"{index}-{e['login']}"} for e in events]
    table = pipeline.activities_of(flat(spark, rows)).select("contributor", "activity").collect()
    by_case = {}
    for row in table:
        by_case.setdefault(int(row.contributor.split("-")[0]), []).append(row.activity)
    return by_case


@pytest.mark.parametrize("name", list(CASES))
def test_case(found, name):
    index = list(CASES).index(name)
    assert sorted(found.get(index, [])) == sorted(CASES[name][1])


def test_single_activities_equal_the_whole(spark):
    rows = []
    for index, (events, _) in enumerate(CASES.values()):
        rows += [{**e, "login": f"{index}-{e['login']}"} for e in events]
    events = flat(spark, rows)
    whole = {}
    for row in pipeline.activities_of(events).groupBy("activity").count().collect():
        whole[row["activity"]] = row["count"]
    for number in (3, 14, 19, 21):
        alone = pipeline.activities_of(events, only=[number]).count()
        assert alone == whole.get(S.ACTIVITY_NAMES[number - 1], 0)
