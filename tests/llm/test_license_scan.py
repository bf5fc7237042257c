"""The license scan against a plain scan with Python's regular expressions."""

import os
import random
import re
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import awkward_texts, documents, prose  # noqa: E402

from forgepulse.llm import license_scan  # noqa: E402
from forgepulse.llm.license_rules import GRANT, HINT, RULES, TITLE, Rule  # noqa: E402

UPPER = str.maketrans(license_scan._UPPER, license_scan._LOWER)


BOUNDED = [re.compile(f"(?<= )(?:{rule.regex})(?= )") for rule in RULES]


def plain(text, rules=RULES):
    """(n_words, all spans, surviving spans); spans are (start, past, tier, rule)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    norm = " " + "".join(w + " " for w in words)
    spans = []
    for i, rule in enumerate(rules):
        for m in BOUNDED[i].finditer(norm):
            start = norm.count(" ", 0, m.start()) - 1
            spans.append((start, start + m.group().count(" ") + 1, rule.tier, i))

    def inside(d, e):
        larger = (e[1] - e[0]) - (d[1] - d[0])
        stronger = e[2] < d[2] or e[2] == d[2] and (larger > 0 or larger == 0 and e[3] < d[3])
        return e[0] <= d[0] and e[1] >= d[1] and stronger

    return len(words), spans, [d for d in spans if not any(inside(d, e) for e in spans)]


NOTICES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "under the terms of the GNU General Public License, version 3 or later.",
    "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-License-Identifier: MIT",
    "Released under the MIT License. MIT License! mit/license mit license",
    "CC BY-NC-SA 4.0 and Creative Commons Attribution-ShareAlike 3.0 Unported",
    "This file may be used under the BSD 3-Clause License or the Mozilla Public License 1.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "http://www.gnu.org/licenses/gpl-3.0 GNU Lesser General Public License v2.1",
    "all rights reserved. ALL RIGHTS RESERVED; public domain, released into the public domain",
    "mit licenseé, xmit license, mit-license, éapache license",
    "apache license version 2 0 apache license general public license",
]


def mixed_texts():
    rng = random.Random(11)
    out = [*awkward_texts(), *NOTICES, "", None, "MIT License"]
    for _ in range(40):
        parts = [rng.choice(NOTICES) if rng.random() < 0.5 else prose(rng, 9) for _ in range(6)]
        out.append(" ".join(parts))
    return out


def spans(held):
    return sorted((s["start"], s["past"], s["tier"], s["rule"]) for s in held)


def test_scan_equals_the_plain_scan(spark):
    texts = mixed_texts()
    df = documents(spark, texts).withColumn("licenses", F.lit("old")).withColumn("norm", F.lit("own"))
    rows = license_scan.scan(df).collect()
    assert len(rows) == len(texts) and {r["norm"] for r in rows} == {"own"}
    for r in rows:
        n_words, found, kept = plain(texts[r["doc_id"]])
        assert (r["n_words"], spans(r["detections"]), spans(r["licenses"])) == (
            n_words, sorted(found), sorted(kept),
        )
    assert license_scan.scan(df.limit(0)).count() == 0


def test_query_columns(spark, tmp_path):
    texts = mixed_texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    base = {i for i, r in enumerate(RULES) if r.base}
    for r in license_scan.op12_license_scan(spark, str(tmp_path)).collect():
        n_words, found, kept = plain(texts[r["doc_id"]])
        places = [d[0] for d in found if d[3] in base]
        own = {RULES[d[3]].label for d in found if d[3] in base}
        every = own | {RULES[d[3]].label for d in kept}
        assert r["n_words"] == n_words and r["n_base"] == len(places)
        assert r["first_word"] == min(places, default=None)
        assert r["last_word"] == max(places, default=None)
        assert r["base_labels"] == ",".join(sorted(own)) and r["labels"] == ",".join(sorted(every))
        best = min((d[2] for d in kept), default=None)
        assert r["score"] == (0.0 if best is None else license_scan.CONFIDENCE[best])


def test_suppression_by_interval_and_tier(spark):
    rules = (
        Rule("short", TITLE, "b", "b"),
        Rule("long", TITLE, "a", "a b c"),
        Rule("strong", GRANT, "c", "c d"),
        Rule("same", TITLE, "c", "c d"),
        Rule("weak", HINT, "x", "a b c d x"),
    )
    df = spark.createDataFrame([("a b c d x",), ("b",), ("c d c d",), ("z",)], "text string")
    got = {
        r["text"]: [rules[s["rule"]].label for s in r["licenses"]]
        for r in license_scan.scan(df, rules=rules).collect()
    }
    # A weak rule hides nothing stronger; a partial overlap ("long", "strong") stays.
    assert got["a b c d x"] == ["weak", "long", "strong"]
    assert got["b"] == ["short"] and got["c d c d"] == ["strong", "strong"] and got["z"] == []


def test_very_many_detections_in_one_text(spark):
    text = "mit license " * 30_000
    df = spark.createDataFrame([(text,)], "text string")
    row = license_scan.scan(df).first()
    assert row["n_words"] == 60_000 and len(row["licenses"]) == 30_000
    mixed = " ".join(NOTICES * 60)
    row = license_scan.scan(spark.createDataFrame([(mixed,)], "text string")).first()
    _, found, kept = plain(mixed)
    assert spans(row["detections"]) == sorted(found) and spans(row["licenses"]) == sorted(kept)
    assert len(found) > 2 * license_scan.SLICE


def test_no_python_workers(spark):
    plan = license_scan.scan(documents(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange hash"))


def test_rules_have_words_at_both_ends_and_need_their_keyword():
    assert len(set(RULES)) == len(RULES) > 300
    for rule in RULES:
        assert rule.regex == rule.regex.strip() and not re.fullmatch(rule.regex, "")
        assert rule.keyword == rule.keyword.strip() and rule.keyword
