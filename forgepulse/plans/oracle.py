"""The registered queries once more as plain SQL, for comparison in another engine.

Written the long way round (filtered subsets, id lists, unions, anti joins) so that it shares
nothing with the window formulation it checks.
"""

from __future__ import annotations

from forgepulse import schema as S
from forgepulse.plans.testbed import FIXED_SCORE_SQL

FLAT = """
src AS (
  SELECT event_id AS i, user_id AS u,
         CASE WHEN user_id % 50 = 7 THEN 39 ELSE event_id % 40 END AS m, (event_id // 40) % 7 - 3 AS d,
         date_trunc('second', ts) AS t
  FROM events),
roles AS (
  SELECT *, unnest(CASE WHEN m IN (2,15,16,18,22,24,26) THEN [0, 1] ELSE [0] END) AS c FROM src),
twice AS (
  SELECT *, unnest(CASE WHEN i % 97 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM roles),
typed AS (
  SELECT *, 2 * i + c AS event_id, 'user' || u AS login,
    'org' || ((u + i) % 5) || '/repo' || (i % 3) AS repository,
    CASE WHEN c = 0 THEN t WHEN m = 26 THEN t + 1000 * d * INTERVAL 1 SECOND
         ELSE t + d * INTERVAL 1 SECOND END AS created_at,
    CASE WHEN c = 1 AND m = 2 THEN 'CreateEvent'
         WHEN c = 1 AND m = 24 THEN 'PushEvent'
         WHEN c = 1 THEN 'IssueCommentEvent'
         WHEN m IN (0, 1, 4) THEN 'CreateEvent'
         WHEN m IN (2, 3) THEN 'ReleaseEvent'
         WHEN m IN (5, 6) THEN 'DeleteEvent'
         WHEN m = 7 THEN 'PublicEvent'
         WHEN m = 8 THEN 'MemberEvent'
         WHEN m = 9 THEN 'ForkEvent'
         WHEN m = 10 THEN 'WatchEvent'
         WHEN m = 11 THEN 'GollumEvent'
         WHEN m IN (12, 13, 14, 15, 16, 17, 18, 19, 39) THEN 'IssuesEvent'
         WHEN m IN (20, 29) THEN 'IssueCommentEvent'
         WHEN m IN (21, 22, 23, 24, 25, 26, 27, 28) THEN 'PullRequestEvent'
         WHEN m = 30 THEN 'PullRequestReviewCommentEvent'
         WHEN m IN (31, 32, 33) AND u % 10 <> 0 THEN 'PullRequestReviewEvent'
         WHEN m = 34 THEN 'CommitCommentEvent'
         ELSE 'PushEvent' END AS event_type
  FROM twice),
flat AS (
  SELECT event_id, event_type, login, repository, created_at,
    CASE WHEN event_type = 'PushEvent' THEN event_id END AS push_id,
    CASE WHEN event_type = 'IssuesEvent' THEN
           CASE WHEN m IN (12, 13, 14) THEN 'opened' WHEN m IN (15, 16, 17) THEN 'closed'
                WHEN m IN (18, 19) THEN 'reopened' ELSE 'labeled' END
         WHEN event_type = 'PullRequestEvent' THEN
           CASE WHEN m = 21 THEN 'opened' WHEN m IN (22, 23) THEN 'reopened' ELSE 'closed' END
         WHEN event_type IN ('IssueCommentEvent', 'PullRequestReviewEvent',
                             'PullRequestReviewCommentEvent') THEN 'created' END AS action,
    CASE WHEN event_type IN ('PullRequestEvent', 'PullRequestReviewEvent',
                             'PullRequestReviewCommentEvent')
           OR (event_type = 'IssueCommentEvent' AND m IN (22, 26, 29)) THEN i END AS PR_number,
    CASE WHEN event_type IN ('PullRequestEvent', 'PullRequestReviewEvent',
                             'PullRequestReviewCommentEvent') THEN
           CASE WHEN m IN (24, 25, 26, 27, 28) THEN 'closed' ELSE 'open' END
         WHEN event_type IN ('IssuesEvent', 'IssueCommentEvent') THEN
           CASE WHEN m IN (15, 17, 26) OR (m = 16 AND c = 0) THEN 'closed' ELSE 'open' END
    END AS state,
    CASE WHEN event_type IN ('PullRequestEvent', 'PullRequestReviewEvent',
                             'PullRequestReviewCommentEvent')
           OR (event_type = 'IssueCommentEvent' AND m IN (22, 26, 29))
         THEN 'PR_' || i END AS PR_node_id,
    CASE WHEN event_type = 'PullRequestEvent' THEN
           CASE WHEN m IN (24, 25) THEN true WHEN m <> 28 THEN false END END AS merged,
    CASE WHEN event_type IN ('IssueCommentEvent', 'PullRequestReviewCommentEvent',
                             'CommitCommentEvent') THEN 'C_' || event_id END AS comment_node_id,
    CASE WHEN event_type = 'PullRequestReviewEvent' THEN
           CASE m WHEN 31 THEN 'commented' WHEN 32 THEN 'approved' ELSE 'changes_requested' END
    END AS review_state,
    CASE WHEN event_type = 'PullRequestReviewEvent' THEN 'R_' || i END AS review_node_id,
    CASE WHEN event_type = 'IssueCommentEvent' AND m = 26
         THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') END AS PR_closed_at,
    CASE WHEN event_type = 'IssuesEvent' OR (event_type = 'IssueCommentEvent'
              AND m NOT IN (22, 26, 29)) THEN i END AS issue_number,
    CASE WHEN event_type = 'IssuesEvent' OR (event_type = 'IssueCommentEvent'
              AND m NOT IN (22, 26, 29)) THEN 'I_' || i END AS issue_node_id,
    CASE WHEN event_type IN ('IssuesEvent', 'IssueCommentEvent')
           AND (m IN (13, 15, 17) OR (m = 16 AND c = 0)) THEN t END AS issue_closed_at,
    CAST(CASE WHEN event_type IN ('IssuesEvent', 'IssueCommentEvent') THEN
           CASE WHEN m = 12 THEN 2 WHEN m IN (13, 14) THEN 0 ELSE 1 END END AS BIGINT)
      AS num_comments,
    CASE WHEN event_type IN ('CreateEvent', 'DeleteEvent') THEN
           CASE WHEN c = 1 OR m IN (4, 5) THEN 'v' || i WHEN m IN (1, 6) THEN 'b' || i END
    END AS ref,
    CASE WHEN event_type IN ('CreateEvent', 'DeleteEvent') THEN
           CASE WHEN c = 1 OR m IN (4, 5) THEN 'tag' WHEN m IN (1, 6) THEN 'branch'
                WHEN m = 0 THEN 'repository' END END AS ref_type,
    CASE WHEN event_type = 'ReleaseEvent' THEN 'v' || i END AS tag_name,
    CASE WHEN event_type = 'ReleaseEvent' THEN 'REL_' || i END AS release_node_id
  FROM typed)
"""

ACCOUNTS = """
accounts AS (
  SELECT DISTINCT 'user' || user_id AS login,
    CASE user_id % 15 WHEN 1 THEN 'Bot' WHEN 2 THEN 'Organization' WHEN 3 THEN NULL
                      ELSE 'User' END AS declared_type,
    user_id % 15 = 3 AS lookup_failed
  FROM events)
"""


ONE_ACCOUNT = FLAT.replace("\nflat AS (", "\nflat_given AS (") + """,
flat AS (SELECT * REPLACE ('everyone' AS login) FROM flat_given)
"""
ONE_REPOSITORY = FLAT.replace("\nflat AS (", "\nflat_given AS (") + """,
flat AS (SELECT * REPLACE ('everyone' AS login, 'all/together' AS repository) FROM flat_given)
"""


def limited(max_events: int | None) -> str:
    cut = "" if max_events is None else f" WHERE event_rank <= {max_events}"
    return f"""
ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY login
                                 ORDER BY created_at DESC NULLS LAST, event_id DESC) AS event_rank
    FROM flat){cut}),
ev AS (
  SELECT * FROM ranked
  QUALIFY row_number() OVER (PARTITION BY login, event_id, created_at ORDER BY event_rank) = 1)
"""


def _prefixed(page_size: int, pages: int) -> str:
    """Each account once per prefix of pages, under the name `login#pages`."""
    return f"""
newest AS (
  SELECT *, row_number() OVER (PARTITION BY login
                               ORDER BY created_at DESC NULLS LAST, event_id DESC) AS event_rank
  FROM flat),
totals AS (
  SELECT login, least(count(*), {page_size * pages}) AS total FROM flat GROUP BY login),
ranked AS (
  SELECT n.* REPLACE (n.login || '#' || p AS login)
  FROM newest n JOIN totals USING (login), range(1, {pages + 1}) r(p)
  WHERE event_rank <= p * {page_size} AND (p - 1) * {page_size} < total),
ev AS (
  SELECT * FROM ranked
  QUALIFY row_number() OVER (PARTITION BY login, event_id, created_at ORDER BY event_rank) = 1)
"""


def _neighbours(name: str, subset: str, main: str, companion: str, equal: list[str], timed: bool) -> str:
    """Main events with an adjacent companion, on either side, in the given subset."""
    fields = ["event_id", "event_type", "created_at", "comment_node_id", *equal]
    shifted = ", ".join(
        f"{how}({f}) OVER w AS {side}_{f}" for how, side in (("lead", "n"), ("lag", "p")) for f in fields
    )

    def half(side: str) -> str:
        tests = [f"event_type = '{main}'", f"{side}_event_type = '{companion}'"]
        tests += [f"{f} = {side}_{f}" for f in equal]
        if timed:
            tests.append(f"abs(date_diff('second', created_at, {side}_created_at)) <= 2")
        return (
            f"SELECT login, repository, created_at, event_id AS main_id, "
            f"{side}_event_id AS companion_id, {side}_comment_node_id AS node "
            f"FROM {name}_seq WHERE repository IS NOT NULL AND {' AND '.join(tests)}"
        )

    return f"""
{name}_seq AS (
  SELECT *, {shifted} FROM ({subset}) WINDOW w AS
    (PARTITION BY login, repository ORDER BY created_at NULLS LAST, event_id)),
{name} AS ({half('n')} UNION ALL {half('p')})"""


PAIRS = ",".join(
    [
        """
rt AS (
  SELECT *, lead(event_id) OVER w AS n_id, lead(event_type) OVER w AS n_type,
    lead(ref) OVER w AS n_ref, lead(created_at) OVER w AS n_at,
    lag(event_id) OVER w AS p_id, lag(event_type) OVER w AS p_type,
    lag(ref) OVER w AS p_ref, lag(created_at) OVER w AS p_at
  FROM ev WHERE event_type = 'ReleaseEvent' OR (event_type = 'CreateEvent' AND ref_type = 'tag')
  WINDOW w AS (PARTITION BY login, repository ORDER BY created_at NULLS LAST, event_id)),
chosen AS (
  SELECT login, repository, event_id AS main_id, created_at, n_id AS companion_id, n_at AS partner_at
  FROM rt WHERE event_type = 'ReleaseEvent' AND n_type = 'CreateEvent' AND tag_name = n_ref
    AND repository IS NOT NULL
  UNION ALL
  SELECT login, repository, event_id, created_at, p_id, p_at
  FROM rt WHERE event_type = 'ReleaseEvent' AND p_type = 'CreateEvent' AND tag_name = p_ref
    AND repository IS NOT NULL
    AND NOT coalesce(n_type = 'CreateEvent' AND tag_name = n_ref, false)),
pair_release AS (
  SELECT * FROM chosen WHERE abs(date_diff('second', created_at, partner_at)) <= 2),
close_gate AS (
  SELECT login FROM ev
  WHERE (event_type = 'IssuesEvent' AND action = 'closed') OR event_type = 'IssueCommentEvent'
  GROUP BY login HAVING count(issue_node_id) > 0 AND count(issue_closed_at) > 0)""",
        _neighbours(
            "pair_close",
            """SELECT * FROM ev SEMI JOIN close_gate USING (login)
               WHERE issue_number IS NOT NULL AND (event_type = 'IssueCommentEvent'
                     OR (event_type = 'IssuesEvent' AND action = 'closed'))""",
            "IssuesEvent", "IssueCommentEvent", ["issue_number", "state"], True,
        ),
        """
free_1 AS (
  SELECT * FROM ev WHERE event_type = 'IssueCommentEvent'
    AND (login, event_id) NOT IN (SELECT (login, companion_id) FROM pair_close)),
reopen_pool AS (
  SELECT * FROM free_1 UNION ALL
  SELECT * FROM ev WHERE event_type = 'IssuesEvent' AND action = 'reopened'),
reopen_gate AS (SELECT login FROM reopen_pool GROUP BY login HAVING count(issue_node_id) > 0)""",
        _neighbours(
            "pair_reopen",
            """SELECT * FROM reopen_pool SEMI JOIN reopen_gate USING (login)
               WHERE issue_number IS NOT NULL""",
            "IssuesEvent", "IssueCommentEvent", ["issue_number"], True,
        ),
        """
free_2 AS (
  SELECT * FROM free_1 WHERE issue_number IS NULL
    AND (login, event_id) NOT IN (SELECT (login, companion_id) FROM pair_reopen)),
pr_reopen_pool AS (
  SELECT * FROM free_2 UNION ALL
  SELECT * FROM ev WHERE event_type = 'PullRequestEvent' AND action = 'reopened'),
pr_reopen_gate AS (SELECT login FROM pr_reopen_pool GROUP BY login HAVING count(PR_node_id) > 0)""",
        _neighbours(
            "pair_pr_reopen",
            """SELECT * FROM pr_reopen_pool SEMI JOIN pr_reopen_gate USING (login)
               WHERE PR_number IS NOT NULL""",
            "PullRequestEvent", "IssueCommentEvent", ["PR_number"], True,
        ),
        """
free_3 AS (
  SELECT * FROM free_2
  WHERE (login, event_id) NOT IN (SELECT (login, companion_id) FROM pair_pr_reopen)),
pr_closed AS (SELECT * FROM ev WHERE event_type = 'PullRequestEvent' AND action = 'closed'),
pr_close_gate AS (
  SELECT login FROM (SELECT * FROM free_3 UNION ALL SELECT * FROM pr_closed)
  GROUP BY login HAVING count(PR_node_id) > 0 AND count(merged) > 0)""",
        _neighbours(
            "pair_reject",
            """SELECT * FROM (SELECT * FROM free_3 UNION ALL SELECT * FROM pr_closed WHERE NOT merged)
               SEMI JOIN pr_close_gate USING (login) WHERE PR_number IS NOT NULL""",
            "PullRequestEvent", "IssueCommentEvent", ["PR_number", "state"], False,
        ),
        """
band AS (
  SELECT a.login, a.repository, a.event_id AS main_id, b.event_id AS companion_id
  FROM pr_closed a SEMI JOIN pr_close_gate g ON a.login = g.login
  JOIN ev b ON a.login = b.login AND a.repository IS NOT DISTINCT FROM b.repository
    AND b.event_type = 'PushEvent' AND abs(date_diff('second', a.created_at, b.created_at)) <= 2
  WHERE a.merged),
free_4 AS (
  SELECT * FROM free_3
  WHERE (login, event_id) NOT IN (SELECT (login, companion_id) FROM pair_reject))""",
    ]
)


def _plain(number: int, source: str) -> str:
    name = S.ACTIVITY_NAMES[number - 1]
    return (
        f"SELECT login AS contributor, repository, '{name}' AS activity, created_at AS date, "
        f"event_id, {number} AS activity_ord FROM {source}"
    )


def _grouped(number: int, source: str, *key: str) -> str:
    name = S.ACTIVITY_NAMES[number - 1]
    keys = ", ".join(["login", "repository", "created_at", *key])
    return (
        f"SELECT login AS contributor, repository, '{name}' AS activity, created_at AS date, "
        f"min(event_id) AS event_id, {number} AS activity_ord FROM {source} GROUP BY {keys}"
    )


def _mains(pairs: str, negate: bool = False) -> str:
    return f"(login, event_id) {'NOT ' if negate else ''}IN (SELECT (login, main_id) FROM {pairs})"


def _emissions() -> list[str]:
    ev = "ev WHERE event_type = "
    closes = "event_type = 'IssuesEvent' AND action = 'closed'"
    reopens = "event_type = 'IssuesEvent' AND action = 'reopened'"
    pr_reopens = "event_type = 'PullRequestEvent' AND action = 'reopened'"
    transfer = """transfer_gate AND (num_comments > 0 OR issue_closed_at IS NOT NULL)"""
    opened = f"""(SELECT ev.*, coalesce({transfer}, false) AS moved FROM ev JOIN (
        SELECT login, coalesce(bool_or(event_type IN ('IssuesEvent', 'IssueCommentEvent')
               AND PR_number IS NULL AND PR_node_id IS NULL), false) AS transfer_gate
        FROM ev GROUP BY login) USING (login)
        WHERE event_type = 'IssuesEvent' AND action = 'opened')"""
    reviewed = "(SELECT DISTINCT login FROM ev WHERE event_type = 'PullRequestReviewEvent')"
    commented = (
        "(SELECT DISTINCT login FROM ev WHERE event_type = 'PullRequestReviewCommentEvent')"
    )
    merges = "pr_closed SEMI JOIN pr_close_gate USING (login) WHERE merged"
    rejects = "pr_closed SEMI JOIN pr_close_gate USING (login) WHERE NOT merged"
    return [
        _plain(1, f"{ev}'CreateEvent' AND ref_type = 'repository'"),
        _plain(2, f"{ev}'CreateEvent' AND ref_type = 'branch'"),
        _grouped(3, f"{ev}'ReleaseEvent' AND {_mains('pair_release')}", "release_node_id"),
        _grouped(3, f"{ev}'ReleaseEvent' AND {_mains('pair_release', True)}", "release_node_id"),
        _plain(4, f"{ev}'CreateEvent' AND ref_type = 'tag' AND (login, event_id) NOT IN "
                  "(SELECT (login, companion_id) FROM pair_release)"),
        _plain(5, f"{ev}'DeleteEvent' AND ref_type = 'tag'"),
        _plain(6, f"{ev}'DeleteEvent' AND ref_type = 'branch'"),
        _plain(7, f"{ev}'PublicEvent'"),
        _plain(8, f"{ev}'MemberEvent'"),
        _plain(9, f"{ev}'ForkEvent'"),
        _plain(10, f"{ev}'WatchEvent'"),
        _plain(11, f"{ev}'GollumEvent'"),
        _plain(12, f"{opened} WHERE moved"),
        _plain(13, f"{opened} WHERE NOT moved"),
        _grouped(14, f"ev WHERE {closes} AND {_mains('pair_close')}", "issue_node_id"),
        _grouped(14, f"ev SEMI JOIN close_gate USING (login) WHERE {closes} AND "
                     f"{_mains('pair_close', True)}", "issue_node_id", "issue_closed_at"),
        _grouped(15, f"ev WHERE {reopens} AND {_mains('pair_reopen')}", "issue_node_id"),
        _grouped(15, f"ev SEMI JOIN reopen_gate USING (login) WHERE {reopens} AND "
                     f"{_mains('pair_reopen', True)}", "issue_node_id"),
        _plain(16, "free_1 WHERE issue_number IS NOT NULL AND (login, event_id) NOT IN "
                   "(SELECT (login, companion_id) FROM pair_reopen)"),
        _plain(17, f"{ev}'PullRequestEvent' AND action = 'opened'"),
        _grouped(18, f"ev WHERE {pr_reopens} AND {_mains('pair_pr_reopen')}", "PR_node_id"),
        _plain(18, f"ev SEMI JOIN pr_reopen_gate USING (login) WHERE {pr_reopens} AND "
                   f"{_mains('pair_pr_reopen', True)}"),
        _grouped(19, f"{merges} AND {_mains('band')}", "PR_node_id"),
        _grouped(19, f"{merges} AND {_mains('band', True)}", "PR_node_id"),
        _grouped(19, "(SELECT c.*, r.node FROM pair_reject r JOIN pr_closed c "
                     "ON c.login = r.login AND c.event_id = r.main_id)", "PR_node_id", "node"),
        _grouped(19, f"{rejects} AND {_mains('pair_reject', True)}", "PR_node_id"),
        _plain(20, "free_4 WHERE PR_number IS NOT NULL"),
        _plain(21, f"ev SEMI JOIN {reviewed} USING (login) "
                   "WHERE event_type = 'PullRequestReviewCommentEvent'"),
        _plain(21, f"ev ANTI JOIN {commented} USING (login) "
                   "WHERE event_type = 'PullRequestReviewEvent' AND review_state = 'commented'"),
        _grouped(22, f"{ev}'PullRequestReviewEvent' AND review_state IS DISTINCT FROM 'commented'",
                 "review_node_id"),
        _plain(23, f"{ev}'CommitCommentEvent'"),
        _plain(24, f"{ev}'PushEvent' AND (login, event_id) NOT IN "
                   "(SELECT (login, companion_id) FROM band)"),
    ]


ACTIVITIES = "\nactivities AS (\n" + "\nUNION ALL\n".join(_emissions()) + ")"

_HOURS = "(epoch_us({0}) - epoch_us({1})) / 3.6e9"


def _runs(name: str, column: str, counted: str) -> str:
    order = "ORDER BY date NULLS LAST, activity_ord, event_id"
    return f"""
{name}_marked AS (
  SELECT *, CASE WHEN {column} = lag({column}) OVER (PARTITION BY contributor {order})
                 THEN 0 ELSE 1 END AS starts FROM activities),
{name}_numbered AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY contributor {order}
                 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM {name}_marked),
{name}_blocks AS (
  SELECT contributor, run_id, min({column}) AS {column}, count({counted}) AS activities,
         min(date) AS first_time, max(date) AS last_time
  FROM {name}_numbered GROUP BY contributor, run_id),
{name} AS (
  SELECT *, {_HOURS.format('last_time', 'first_time')} AS time_spent,
         {_HOURS.format('next_first_time', 'last_time')} AS time_to_switch
  FROM (SELECT *, lead(first_time) OVER (PARTITION BY contributor ORDER BY run_id)
               AS next_first_time FROM {name}_blocks))"""



def _quantile(q: float) -> str:
    """Linear interpolation, from the nearer end of the interval."""
    position = f"((n - 1) * CAST({q} AS DOUBLE))"
    below = f"CAST(floor({position}) AS BIGINT)"
    low, high = f"xs[{below} + 1]", f"xs[least({below} + 2, n)]"
    part = f"({position} - {below})"
    return (
        f"CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part} "
        f"ELSE {high} - ({high} - {low}) * (1 - {part}) END"
    )


_SERIES = f"""
series AS (
  SELECT contributor, 'DCA' AS metric, {_HOURS.format(
      'lead(date) OVER (PARTITION BY contributor ORDER BY date NULLS LAST)', 'date')} AS x
  FROM activities
  UNION ALL SELECT contributor, 'NAR', count(activity) FROM activities
    WHERE repository IS NOT NULL GROUP BY contributor, repository
  UNION ALL SELECT contributor, 'NTR', count(DISTINCT activity) FROM activities
    WHERE repository IS NOT NULL GROUP BY contributor, repository
  UNION ALL SELECT contributor, 'NCAR', activities FROM repo_runs
  UNION ALL SELECT contributor, 'DCAR', time_spent FROM repo_runs
  UNION ALL SELECT contributor, 'DAAR', time_to_switch FROM repo_runs
  UNION ALL SELECT contributor, 'DCAT', time_to_switch FROM type_runs
  UNION ALL SELECT contributor, 'NAT', count(repository) FROM activities
    GROUP BY contributor, activity),
gini_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY contributor, metric ORDER BY x) AS i,
         count(*) OVER (PARTITION BY contributor, metric) AS n
  FROM series WHERE x <> 0),
ginis AS (
  SELECT contributor, metric, sum((2 * i - n - 1) * x) / (max(n) * sum(x)) AS gini
  FROM gini_ranked GROUP BY contributor, metric),
collected AS (
  SELECT contributor, metric, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std,
         list(CAST(x AS DOUBLE) ORDER BY x) FILTER (x IS NOT NULL) AS xs, count(x) AS n
  FROM series GROUP BY contributor, metric),
summaries AS (
  SELECT contributor, metric, mean, std, {_quantile(0.5)} AS median,
         ({_quantile(0.75)}) - ({_quantile(0.25)}) AS IQR
  FROM collected),
basics AS (
  SELECT contributor, count(activity) AS NA, count(DISTINCT activity) AS NT,
         count(DISTINCT split_part(repository, '/', 1)) AS NOR,
         count(DISTINCT split_part(repository, '/', 1)) / nullif(count(DISTINCT repository), 0)
           AS ORR
  FROM activities GROUP BY contributor)
"""


def _rounded(value: str) -> str:
    return f"round_even(({value}) * 1000, 0) / 1000"


def _statistic(series: str, stat: str) -> str:
    value = f"max(CASE WHEN metric = '{series}' THEN {stat} END)"
    if stat in ("gini", "std"):
        value = f"coalesce({value}, 0)"
    return f"{_rounded(value)} AS {series}_{stat}"


_ALL_STATISTICS = f"""
wide AS (
  SELECT contributor, {', '.join(_statistic(s, stat) for s in S.SERIES for stat in S.STATISTICS)}
  FROM summaries LEFT JOIN ginis USING (contributor, metric) GROUP BY contributor),
statistics AS (
  SELECT b.contributor, b.NA, b.NT, b.NOR, {_rounded('b.ORR')} AS ORR, w.* EXCLUDE (contributor)
  FROM basics b JOIN wide w USING (contributor))
"""

RUNS = _runs("repo_runs", "repository", "activity") + "," + _runs("type_runs", "activity", "repository")


def with_tables(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def activity_parts(max_events: int | None = None, flat: str = FLAT) -> list[str]:
    return [flat, limited(max_events), PAIRS, ACTIVITIES]


def feature_parts(max_events: int | None = None, flat: str = FLAT) -> list[str]:
    return [*activity_parts(max_events, flat), RUNS, _SERIES, _ALL_STATISTICS]


_VERDICT = """
CASE WHEN p_bot <= 0.5 THEN 'Human' ELSE 'Bot' END"""
_CONFIDENCE = _rounded("abs(p_bot - 0.5) * 2")


def fixed_verdicts() -> str:
    return with_tables(
        f"SELECT contributor, {_VERDICT} AS type, {_CONFIDENCE} AS confidence "
        f"FROM (SELECT *, {FIXED_SCORE_SQL} AS p_bot FROM statistics)",
        *feature_parts(),
    )


def fixed_classification(min_events: int) -> str:
    kept = ", ".join(f"s.{f}" for f in S.FEATURES)
    features = ", ".join(
        f"CASE WHEN declared_type = 'User' AND NOT lookup_failed THEN {f} END AS {f}"
        for f in S.FEATURES
    )
    return with_tables(
        f"""SELECT login AS contributor,
          CASE WHEN lookup_failed OR declared_type IS NULL THEN 'Invalid'
               WHEN declared_type <> 'User' THEN declared_type
               WHEN events IS NULL OR events < {min_events} OR p_bot IS NULL THEN 'Unknown'
               ELSE {_VERDICT} END AS type,
          CASE WHEN lookup_failed OR declared_type IS NULL THEN NULL
               WHEN declared_type <> 'User' THEN 1.0
               WHEN events >= {min_events} THEN {_CONFIDENCE} END AS confidence,
          CASE WHEN declared_type = 'User' AND NOT lookup_failed
               THEN coalesce(events, 0) END AS events, {features}
        FROM accounts
        LEFT JOIN (SELECT login, count(*) AS events FROM ranked GROUP BY login) USING (login)
        LEFT JOIN (
          SELECT s.contributor AS login, {kept}, {FIXED_SCORE_SQL} AS p_bot
          FROM statistics s) USING (login)""",
        ACCOUNTS,
        *feature_parts(300),
    )


def fixed_progressive(min_events: int, min_confidence: float, page_size: int, pages: int) -> str:
    return with_tables(
        f"""SELECT login AS contributor, type, confidence, events, pages FROM (
          SELECT a.login, coalesce(type, 'Unknown') AS type, confidence,
            coalesce(events, t.total, 0) AS events, pages,
            row_number() OVER (PARTITION BY a.login
                               ORDER BY coalesce(stops, true) DESC, pages) AS choice
          FROM (SELECT login FROM accounts WHERE declared_type = 'User' AND NOT lookup_failed) a
          LEFT JOIN (
            SELECT *, p.events < {min_events} OR confidence > {min_confidence}
                   OR p.events < pages * {page_size} OR pages = {pages}
                   OR pages * {page_size} >= total AS stops
            FROM (
              SELECT split_part(contributor, '#', 1) AS login,
                CAST(split_part(contributor, '#', 2) AS BIGINT) AS pages, n.events,
                CASE WHEN n.events < {min_events} THEN 'Unknown' ELSE {_VERDICT} END AS type,
                CASE WHEN n.events >= {min_events} THEN {_CONFIDENCE} END AS confidence
              FROM (SELECT *, {FIXED_SCORE_SQL} AS p_bot FROM statistics) s
              JOIN (SELECT login, count(*) AS events FROM ranked GROUP BY login) n
                ON n.login = s.contributor) p
            JOIN totals USING (login)) v USING (login)
          LEFT JOIN totals t USING (login))
        WHERE choice = 1""",
        ACCOUNTS,
        FLAT,
        _prefixed(page_size, pages),
        PAIRS,
        ACTIVITIES,
        RUNS,
        _SERIES,
        _ALL_STATISTICS,
    )
