"""Builders of flat events for small cases."""

from __future__ import annotations

import datetime as dt

from forgepulse import schema as S

START = dt.datetime(2024, 3, 1, 12, 0, 0)


def event(number, kind, second=0, login="ann", repository="org/app", **fields):
    row = dict.fromkeys(S.FLAT_EVENT.fieldNames())
    row.update(
        event_id=number,
        event_type=kind,
        login=login,
        repository=repository,
        created_at=None if second is None else START + dt.timedelta(seconds=second),
    )
    row.update(fields)
    return row


def release(number, second, name="v1", **fields):
    return event(number, S.RELEASE, second, tag_name=name, release_node_id=f"REL_{number}", **fields)


def tag(number, second, name="v1", **fields):
    return event(number, S.CREATE, second, ref=name, ref_type="tag", **fields)


def issue(number, second, action, issue=7, **fields):
    closed = action == "closed"
    row = dict(
        action=action,
        issue_number=issue,
        issue_node_id=f"I_{issue}",
        state="closed" if closed else "open",
        issue_closed_at=START if closed else None,
        num_comments=0,
    )
    row.update(fields)
    return event(number, S.ISSUES, second, **row)


def issue_comment(number, second, issue=7, state="open", **fields):
    row = dict(
        action="created", issue_number=issue, issue_node_id=f"I_{issue}", state=state,
        num_comments=1, comment_node_id=f"C_{number}",
    )
    row.update(fields)
    return event(number, S.ISSUE_COMMENT, second, **row)


def pull(number, second, action, pr=9, merged=False, **fields):
    row = dict(
        action=action, PR_number=pr, PR_node_id=f"PR_{pr}", merged=merged,
        state="closed" if action == "closed" else "open",
    )
    row.update(fields)
    return event(number, S.PULL_REQUEST, second, **row)


def pr_comment(number, second, pr=9, state="open", **fields):
    row = dict(
        action="created", PR_number=pr, PR_node_id=f"PR_{pr}", state=state, num_comments=1,
        comment_node_id=f"C_{number}",
    )
    row.update(fields)
    return event(number, S.ISSUE_COMMENT, second, **row)


def review(number, second, state, pr=9, **fields):
    return event(
        number, S.REVIEW, second, action="created", PR_number=pr, PR_node_id=f"PR_{pr}",
        review_state=state, review_node_id=f"R_{number}", state="open", **fields,
    )


def review_comment(number, second, pr=9, **fields):
    return event(
        number, S.REVIEW_COMMENT, second, action="created", PR_number=pr, PR_node_id=f"PR_{pr}",
        comment_node_id=f"C_{number}", state="open", **fields,
    )


def push(number, second, **fields):
    return event(number, S.PUSH, second, push_id=number, **fields)


def flat(spark, rows):
    names = S.FLAT_EVENT.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], S.FLAT_EVENT)
