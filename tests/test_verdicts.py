"""Decision cascade, page-wise classification, model, sources and sinks."""

import json

import pytest
from helpers import event, flat, push

from forgepulse import schema as S
from forgepulse.operators.verdict import gated_verdicts, result_columns, verdicts
from forgepulse.plans import model, pipeline, testbed
from forgepulse.plans.report import report
from forgepulse.sources import events as sources
from forgepulse.sources import results as sinks


def declare(spark, rows):
    return spark.createDataFrame(rows, S.ACCOUNT)


def constant(p):
    return lambda features: features.selectExpr("*", f"{p}D AS p_bot")


def by_count(features):
    """More activities, more certain: 10 activities give 0.6, 40 give 0.9."""
    return features.selectExpr("*", "0.5D + NA / 100D AS p_bot")


def test_threshold_and_confidence(spark):
    scored = spark.createDataFrame([(0.5,), (0.51,), (0.0,), (0.87654,)], "p_bot double")
    found = {r.p_bot: (r.type, r.confidence) for r in verdicts(scored).collect()}
    assert found == {
        0.5: ("Human", 0.0), 0.51: ("Bot", 0.02), 0.0: ("Human", 1.0), 0.87654: ("Bot", 0.753),
    }


def test_too_few_events_stay_unknown(spark):
    scored = spark.createDataFrame([(4, 0.9), (5, 0.9)], "events bigint, p_bot double")
    found = {r.events: (r.type, r.confidence) for r in gated_verdicts(scored, 5).collect()}
    assert found == {4: ("Unknown", None), 5: ("Bot", 0.8)}


def test_cascade(spark):
    accounts = declare(
        spark,
        [("ann", "User", False), ("few", "User", False), ("none", "User", False),
         ("odd", "User", False), ("robot", "Bot", False), ("club", "Organization", False),
         ("gone", None, True)],
    )
    rows = [push(n, n * 60, login="ann") for n in range(6)]
    rows += [push(n, n * 60, login="few") for n in range(10, 13)]
    rows += [event(20, "SponsorshipEvent", login="odd")]
    rows += [push(n, n, login="robot") for n in range(30, 40)]
    found = {
        r.contributor: (r.type, r.confidence, r.events, r.NA)
        for r in pipeline.classify_accounts(accounts, flat(spark, rows), constant(0.9)).collect()
    }
    assert found == {
        "ann": ("Bot", 0.8, 6, 6),
        "few": ("Unknown", None, 3, 3),
        "none": ("Unknown", None, 0, None),
        "odd": ("Unknown", None, 1, None),
        "robot": ("Bot", 1.0, None, None),
        "club": ("Organization", 1.0, None, None),
        "gone": ("Invalid", None, None, None),
    }


@pytest.mark.parametrize(
    "min_confidence, max_queries, pages, events",
    [
        (0.1, 3, 1, 10),  # the first page is certain enough
        (0.2, 3, 2, 20),  # a confidence just reached is not enough
        (0.3, 3, 2, 20),
        (1.0, 3, 3, 25),  # the third page is short
        (1.0, 2, 2, 20),  # no more pages allowed
    ],
)
def test_pages_are_added_until_certain(spark, min_confidence, max_queries, pages, events):
    rows = [push(n, n * 60) for n in range(25)]
    result = pipeline.progressive_classify(
        declare(spark, [("ann", "User", False)]), flat(spark, rows), by_count,
        min_confidence=min_confidence, max_queries=max_queries, page_size=10,
    ).first()
    assert (result.pages, result.events, result.NA) == (pages, events, events)


def test_full_last_page_ends_the_search(spark):
    rows = [push(n, n * 60) for n in range(20)]
    result = pipeline.progressive_classify(
        declare(spark, [("ann", "User", False)]), flat(spark, rows), by_count, page_size=10
    ).first()
    assert (result.type, result.pages, result.events) == ("Bot", 2, 20)


def test_unknown_first_page_ends_the_search(spark):
    rows = [push(n, n * 60) for n in range(25)]
    result = pipeline.progressive_classify(
        declare(spark, [("ann", "User", False)]), flat(spark, rows), by_count,
        min_events=15, page_size=10,
    ).first()
    assert (result.type, result.confidence, result.pages, result.events) == ("Unknown", None, 1, 10)


def test_model_round_trip(spark, tmp_path):
    features = pipeline.features_of(testbed.flat_events(spark, "/root/testdata/sf0.001"))
    labelled = features.selectExpr("*", "NA % 2 = 1 AS is_bot").cache()
    fitted = model.train(labelled, rounds=3)
    scored = model.scorer(fitted)(labelled.drop("is_bot"))
    assert scored.columns == [*features.columns, "p_bot"]
    probabilities = {r.contributor: r.p_bot for r in scored.collect()}
    assert all(0.0 <= p <= 1.0 for p in probabilities.values())
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = model.scorer(model.load(str(tmp_path / "model")))(labelled.drop("is_bot"))
    assert {r.contributor: r.p_bot for r in again.collect()} == probabilities


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    testbed.raw_events(spark, "/root/testdata/sf0.001").write.json(str(root / "events"))
    testbed.accounts(spark, "/root/testdata/sf0.001").write.json(str(root / "accounts"))
    (root / "logins.txt").write_text("user4 x\nuser1\n\nuser4\nnobody\n007\n")
    return root


def test_json_archive_equals_the_derived_events(spark, archive):
    from forgepulse.operators.extract import flatten_events

    read = flatten_events(sources.read_events(spark, str(archive / "events")))
    assert read.schema.fieldNames() == S.FLAT_EVENT.fieldNames()
    assert [f.dataType for f in read.schema] == [f.dataType for f in S.FLAT_EVENT]
    derived = testbed.flat_events(spark, "/root/testdata/sf0.001")
    assert read.exceptAll(derived).count() == 0 and derived.exceptAll(read).count() == 0


def test_odd_json(spark, tmp_path):
    from forgepulse.operators.extract import flatten_events

    odd = [
        {"id": "x", "type": "IssuesEvent", "created_at": "yesterday", "payload": {"issue": {"number": 3}}},
        {"id": "2", "type": "PullRequestEvent", "created_at": "2024-02-30T00:00:00Z"},
        {"id": "3", "type": "WatchEvent", "actor": {"login": "a"}, "repo": {"name": "solo"},
         "created_at": "2024-02-03T04:05:06Z", "payload": {"push_id": 5}},
    ]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, odd)))
    rows = flatten_events(sources.read_events(spark, str(tmp_path))).collect()
    assert rows[0].event_id is None and rows[0].issue_number == 3 and rows[0].created_at is None
    assert rows[1].created_at is None and rows[1].merged is None
    assert str(rows[2].created_at) == "2024-02-03 04:05:06" and rows[2].push_id is None


def test_report(spark, archive):
    found = report(
        spark, str(archive / "events"), str(archive / "accounts"), constant(0.1),
        logins=["user2", "user5"], logins_file=str(archive / "logins.txt"),
    )
    assert found.columns == ["contributor", "type", "confidence"]
    assert [(r.contributor, r.type) for r in found.collect()] == [
        ("user2", "Organization"), ("user5", "Human"), ("user4", "Human"), ("user1", "Bot"),
        ("user4", "Human"), ("nobody", "Invalid"), ("007", "Invalid"),
    ]
    wide = report(
        spark, str(archive / "events"), str(archive / "accounts"), constant(0.1),
        logins=["user5"], verbose=True,
    )
    assert wide.columns == ["contributor", "type", "confidence", "events", *S.FEATURES]


@pytest.mark.parametrize(
    "wrong", [{"min_events": 0}, {"min_events": 301}, {"min_confidence": 1.5}, {"max_queries": 4}, {"logins": []}]
)
def test_report_rejects(spark, wrong):
    with pytest.raises(ValueError):
        report(spark, "e", "a", constant(0.1), **{"logins": ["x"], **wrong})


def test_sinks(spark, tmp_path, capsys):
    results = spark.createDataFrame(
        [("a", "Bot", 0.8), ("b", "Unknown", None)],
        "contributor string, type string, confidence double",
    )
    sinks.write_results(results, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == [("a", "Bot", "0.8"), ("b", "Unknown", None)]
    sinks.write_results(results, str(tmp_path / "j"), "json")
    lines = spark.read.text(str(tmp_path / "j")).collect()
    assert {"contributor": "b", "type": "Unknown", "confidence": None} in [json.loads(r.value) for r in lines]
    sinks.write_results(results, str(tmp_path / "t"), "text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == [
        "a\tBot\t0.8", "b\tUnknown\t-"
    ]
    many = spark.range(25).selectExpr("CAST(id AS string) AS contributor")
    assert sinks.text_lines(many).count() == 25
    sinks.preview_results(results, rows=2)
    assert "|b          |Unknown|-         |" in capsys.readouterr().out
    with pytest.raises(ValueError):
        sinks.write_results(results, str(tmp_path / "x"), "xml")


def test_result_columns(spark):
    accounts = declare(spark, [("robot", "Bot", False)])
    everything = pipeline.classify_accounts(accounts, flat(spark, [push(1, 0)]), constant(0.2))
    assert result_columns(everything, False).columns == ["contributor", "type", "confidence"]


def test_date_text(spark):
    activities = pipeline.activities_of(flat(spark, [push(1, 5)]))
    assert sinks.with_date_text(activities).first().date == "2024-03-01T12:00:05+00:00"


def test_users_of_unknown_events_keep_their_count(spark):
    """Six events of no known kind: no features, no verdict, but six events."""
    rows = [event(n, "SponsorshipEvent", n, login="odd") for n in range(6)]
    events = flat(spark, [*rows, push(90, 0, login="ann")])
    accounts = declare(spark, [("odd", "User", False), ("ann", "User", False), ("none", "User", False)])
    for results in (
        pipeline.classify_accounts(accounts, events, constant(0.2), min_events=1),
        pipeline.progressive_classify(accounts, events, constant(0.2), min_events=1),
    ):
        found = {r.contributor: (r.type, r.events) for r in results.collect()}
        assert found == {"odd": ("Unknown", 6), "ann": ("Human", 1), "none": ("Unknown", 0)}


def test_repeated_declarations_count_once(spark):
    accounts = declare(spark, [("ann", "Bot", False), ("ann", "Bot", False)])
    asked = spark.createDataFrame([("ann",), ("bob",)], "login string")
    found = pipeline.accounts_for(asked, accounts).collect()
    assert sorted((r.login, r.lookup_failed) for r in found) == [("ann", False), ("bob", True)]


def test_logins_keep_the_order_of_lines_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a0 x\n\na1\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(50)))
    listed = sources.read_logins(spark, str(tmp_path))
    asked = sources.combine_logins(spark, ["n0", "n1"], listed).orderBy("input_pos")
    assert [r.login for r in asked.collect()] == ["n0", "n1", "a0", "a1", *[f"b{i}" for i in range(50)]]


def test_all_events_count_unless_a_limit_is_given(spark):
    rows = [push(n, n) for n in range(400)]
    assert pipeline.features_of(flat(spark, rows)).first().NA == 400
    assert pipeline.features_of(flat(spark, rows), 300).first().NA == 300
    assert pipeline.activities_of(flat(spark, rows)).count() == 400
