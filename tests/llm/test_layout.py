"""Mixing, sharding, fingerprints and exact top-k."""

import math
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import awkward_texts, documents, prose, sha  # noqa: E402

from forgepulse.llm import fingerprints, mixing, sharding, topk  # noqa: E402


def test_poisson_counts_invert_the_distribution(spark):
    rates = [0.0, 0.3, 1.0, 5.5, 15.9]
    df = spark.createDataFrame([(r, u / 97) for r in rates for u in range(97)], "r double, u double")
    got = df.select("r", "u", mixing.invert(mixing.poisson_table(F.col("r")), F.col("u")).alias("k"))
    for row in got.collect():
        below, term, k = math.exp(-row["r"]), math.exp(-row["r"]), 0
        while below < row["u"]:
            k += 1
            term *= row["r"] / k
            below += term
        assert row["k"] == k


def test_mixture_has_the_weights_and_is_repeatable(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 20), "a" if i % 3 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, {"a": 1.0, "b": 3.0}, total=200_000_000 / 500).cache()
    size = dict(mixed.groupBy("source").agg(F.sum(F.length("text"))).collect())
    assert abs(size["b"] / sum(size.values()) - 0.75) < 0.02
    assert abs(sum(size.values()) / 400_000 - 1) < 0.05
    again = mixing.mix(df.repartition(7), {"a": 1.0, "b": 3.0}, total=400_000)
    key = ("doc_id", "copy_no", "shuffle_key")
    assert Counter(mixed.select(*key).collect()) == Counter(again.select(*key).collect())
    assert mixed.count() == mixed.select("doc_id", "copy_no").distinct().count()


def test_large_rates_are_sums_of_draws(spark):
    rows = [(i, "x" * 10, "a") for i in range(400)] + [(1000 + i, "y" * 10, "b") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, {"a": 1.0, "b": 1.0}).groupBy("doc_id").count()
    counts = [r["count"] for r in mixed.where("doc_id >= 1000").collect()]
    assert len(counts) == 4 and all(20 < c < 90 for c in counts)  # mean 50.5


def test_mixing_awkward_rows(spark):
    rows = [(1, "text", None), (None, "text", "a"), (2, None, "n"), (3, "", "n"), (4, "more", "c")]
    df = spark.createDataFrame(rows * 30, "doc_id long, text string, source string")
    mixed = mixing.mix(df.withColumn("copy_no", F.lit("old")), {}, total=100_000.0)
    seen = {(r["source"], r["doc_id"]) for r in mixed.collect()}
    assert seen == {(None, 1), ("a", None), ("c", 4)}  # a source without bytes has rate 0
    assert mixing.mix(df.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1.0})


def test_shards_follow_weights_and_growth_moves_rows_only_to_the_new_one(spark):
    df = spark.range(8000).withColumnRenamed("id", "doc_id")
    tree = sharding.even_tree(16)
    placed = sharding.assign(sharding.assign(df, tree), sharding.grown(tree, 16), shard="next")
    rows = placed.collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and min(counts.values()) > 400 and max(counts.values()) < 600
    moved = [r for r in rows if r["shard"] != r["next"]]
    assert all(r["next"] == 16 for r in moved) and 350 < len(moved) < 600


def test_a_changed_weight_moves_rows_between_its_subtree_and_others_only(spark):
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    tree = {"x": {"x1": {0: 1.0, 1: 2.0}, "x2": {2: 1.0}}, "y": {"y1": {3: 4.0, 4: 0.0}}}
    heavier = {**tree, "y": {"y1": {3: 6.0}}}
    rows = sharding.assign(sharding.assign(df, tree), heavier, shard="next").collect()
    counts = Counter(r["shard"] for r in rows)
    assert abs(counts[3] / 6000 - 0.5) < 0.03 and abs(counts[1] / 6000 - 0.25) < 0.03
    assert 4 not in counts
    assert all(r["next"] == 3 for r in rows if r["next"] != r["shard"])
    with pytest.raises(ValueError):
        sharding.assign(df, {"x": {"x1": {0: 0.0}}})


def test_slots_are_gapless_with_nulls_ties_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(sharding, "range_edges", lambda *a: [10, 20, 700])
    ids = [None, None, 5, 5, 5, *range(1000)]
    df = spark.createDataFrame([(i, "s") for i in ids], "doc_id long, slot string").repartition(5)
    rows = sharding.with_slots(sharding.assign(df, sharding.even_tree(4, 2, 1))).collect()
    assert len(rows) == len(ids)
    for shard in range(4):
        own = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in rows if r["shard"] == shard)
        assert [slot for slot, _ in own] == list(range(len(own)))
        assert [i for _, i in own] == sorted(i for _, i in own)
    empty = sharding.with_slots(sharding.assign(df.limit(0), sharding.even_tree(4)))
    assert empty.count() == 0


def test_written_shards_hold_their_rows(spark, tmp_path):
    df = sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), sharding.even_tree(4))
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(back.select("doc_id", "shard").collect()) == Counter(df.collect())


def test_fingerprints_add_up_and_ignore_order():
    mark, rng = fingerprints.fingerprint, random.Random(2)
    parts = [prose(rng, 6) for _ in range(30)]
    whole = mark("\n".join(parts))
    shuffled = rng.sample(parts, len(parts))
    assert mark("\n\n".join(shuffled)) == whole
    assert fingerprints.combine(mark("\n".join(parts[:11])), mark("\n".join(parts[11:]))) == whole
    assert fingerprints.without(whole, mark(parts[4])) == mark("\n".join(parts[:4] + parts[5:]))
    assert mark("\n".join(parts[:-1] + ["other"])) != whole
    assert mark("a\na") != mark("a") and mark(None) == mark("") == mark(" \n ")


def test_likeness_follows_the_common_share():
    rng = random.Random(2)
    parts = [prose(rng, 6) for _ in range(400)]
    whole = fingerprints.fingerprint("\n".join(parts))
    for common in (400, 300, 200, 0):
        other = parts[:common] + [prose(rng, 7) for _ in range(400 - common)]
        near = fingerprints.likeness(whole, fingerprints.fingerprint("\n".join(other)))
        assert abs(near - common / (800 - common)) < 0.15
    assert fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint(None)) == 1


@pytest.mark.parametrize("times", [1, 5, 40, 226, 40_000])
def test_likeness_counts_repeated_paragraphs(times):
    rng = random.Random(times)
    lines = [prose(rng, 6) for _ in range(60)] + ["same line"] * times + ["other line"] * (times // 3)
    for cut in (0.1, 0.3, 0.5, 0.9):
        edited = lines[int(cut * len(lines)) :] + [prose(rng, 5) for _ in range(8)]
        a, b = Counter(lines), Counter(edited)
        true = (a & b).total() / (a | b).total()
        marks = (fingerprints.fingerprint("\n".join(rows)) for rows in (lines, edited))
        assert abs(fingerprints.likeness(*marks) - true) < 0.12


def test_likeness_has_the_stated_error():
    rng, off = random.Random(8), []
    for _ in range(200):
        lines = [prose(rng, 4) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 6)
        edited = lines[len(lines) // 2 :] + [prose(rng, 5) for _ in range(rng.randrange(20))] * 3
        a, b = Counter(lines), Counter(edited)
        apart = (a - b).total() + (b - a).total()
        x, y = (
            np.frombuffer(fingerprints.fingerprint("\n".join(rows))[8:], np.int64)
            for rows in (lines, edited)
        )
        off.append(fingerprints._scale((x - y) / fingerprints.UNIT) / apart - 1)
    assert abs(np.mean(off)) < 0.03 and 0.10 < np.std(off) < 0.15


@pytest.mark.parametrize("edges", [None, [4, 30, 31, 60]])
def test_neighbours_and_edits_as_by_brute_force(spark, edges, monkeypatch):
    if edges:
        monkeypatch.setattr(fingerprints, "range_edges", lambda *a: edges)
    texts = awkward_texts()
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(documents(spark)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        own, after = text or "", texts[i - 1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        row = rows[i]
        assert row["n_chars"] == len(own) and sha(row["edited"].encode()) == sha(edited.encode())
        marks = [fingerprints.fingerprint(t) for t in (own, edited, after)]
        assert [bytes(row[c]) for c in ("own_mark", "edited_mark", "next_mark")] == marks
        assert row["near_edited"] == fingerprints.likeness(*marks[:2])
        assert row["near_next"] == fingerprints.likeness(marks[0], marks[2])


def test_neighbours_of_few_rows_nulls_and_ties(spark):
    schema = "doc_id long, text string"
    assert fingerprints.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert [(r["edited"], r["near_next"]) for r in one] == [("abab", 1.0)]
    rows = [(None, "nnnn"), (2, "bbbb"), (2, "aaaa"), (9, "zzzz")]
    got = fingerprints.compare_with_next(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["edited"] for r in got) == ["aabb", "bbnn", "nnzz", "zzaa"]
    added = fingerprints.with_fingerprint(spark.createDataFrame(rows, schema), name="text_mark")
    near = fingerprints.with_likeness(added, "text_mark", "text_mark")
    assert {r["likeness"] for r in near.collect()} == {1.0}


def _best(rows: list[tuple[int, list]], queries: list[int], k: int) -> set[tuple]:
    usable = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q in queries:
        for _, query in [r for r in usable if r[0] == q]:
            scores = sorted(
                (-sum(a * b for a, b in zip(query, v)), i)
                for i, v in usable
                if i != q and len(v) == len(query)
            )
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block", [3, 64, 1000])
def test_topk_as_by_brute_force(spark, block):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(230)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8),
             (403, [float("inf")] * 8), (450, [0.5] * 3), (451, [0.25] * 3), (350, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "score", F.lit("clash")
    )
    got = topk.search(df, df.where("vec_id % 50 = 0"), k=4, block=block, n_pivots=6)
    expected = _best(rows, [i for i, _ in rows if i % 50 == 0], 4)
    found = [tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_topk_keeps_large_components_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-3.0, 2.5, 700.0]) for _ in range(4)]) for i in range(40)]
    rows += [(50, [1e9, 1.0, 0.0, 0.0]), (51, [-1e9, 0.5, 0.0, 0.0]), (100, [0.0, 0.0, 1e11, 2.0]),
             (101, [0.0, 3.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 50 = 0"), k=4, n_pivots=6)
    expected = _best(rows, [0, 50, 100], 4)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == expected


@pytest.mark.parametrize("large", [1e9, 1e200])
def test_topk_fails_where_64_bits_do_not_hold_a_score(spark, large):
    df = spark.createDataFrame([(0, [large] * 3), (1, [large] * 3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):
        topk.search(df, df, k=1).collect()


def test_topk_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).count() == 0


def test_pivots_spare_evaluations():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3000, (20, 16))
    vectors = (centres[np.arange(2000) % 20] + rng.normal(0, 20, (2000, 16))).astype(np.int32)
    pivots = vectors[:24].astype(float)
    distances = np.sqrt(((vectors[:, None].astype(float) - pivots[None]) ** 2).sum(axis=2))
    ids, evaluated = np.arange(2000), []
    side = (ids[:10], vectors[:10], distances[:10])
    found = list(topk.best_of_block(side, (ids, vectors, distances), 5, evaluated))
    for q in range(10):
        scores = vectors.astype(np.int64) @ vectors[q].astype(np.int64)
        scores[q] = -(1 << 60)
        order = np.lexsort((ids, -scores))[:5]
        assert [(i, s) for a, i, s in found if a == q] == [(i, scores[i]) for i in order]
    assert sum(evaluated) < 0.8 * 10 * 2000
