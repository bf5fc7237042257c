"""Substring dedup, Jaccard groups and components against brute force."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import (  # noqa: E402
    awkward_texts,
    documents,
    linked_groups,
    prose,
    removed_words,
    words_of,
)

from forgepulse.llm import components, jaccard_join, substring_dedup  # noqa: E402
from forgepulse.llm.common import word_hashes, words_of  # noqa: E402


@pytest.mark.parametrize("length, anchor", [(20, None), (7, 3), (50, None), (1, None)])
def test_repeats_are_removed_as_by_brute_force(spark, length, anchor, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 4000)
    texts = awkward_texts()
    expected = removed_words(texts, length)
    rows = substring_dedup.remove_repeats(documents(spark), length, anchor=anchor).collect()
    assert len(rows) == len(texts)
    for row in rows:
        drop = expected[row["doc_id"]]
        words = words_of(texts[row["doc_id"]])
        assert (row["n_words"], row["n_removed"]) == (len(words), sum(drop)), row["doc_id"]
        assert row["kept_text"].encode() == b" ".join(w for w, d in zip(words, drop) if not d)
        marked = np.zeros(len(words), bool)
        for lo, n in np.reshape(row["removed"], (-1, 2)).astype(int):
            marked[lo : lo + n] = True
            assert n >= length
        assert marked.tolist() == drop


def test_random_texts_of_few_words(spark):
    """Few different words make anchors meet in many surroundings."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(150)]
    expected = removed_words(texts, 8)
    rows = substring_dedup.remove_repeats(documents(spark, texts), 8).collect()
    assert [r["n_removed"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [
        sum(drop) for drop in expected
    ]


def test_repeated_rows_null_ids_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame(
        [(5, text, 1), (5, text, 1), (None, text, 2), (9, text, 3)],
        "doc_id long, text string, id long",
    ).selectExpr("*", "'x' AS tie", "'y' AS removed", "0 AS lo")
    rows = substring_dedup.remove_repeats(df).collect()
    assert sorted((r["id"], r["n_removed"], r["tie"], r["lo"]) for r in rows) == [
        (1, 0, "x", 0), (1, 0, "x", 0), (2, 30, "x", 0), (3, 30, "x", 0)
    ]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("shingle, percent", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_groups_are_those_of_brute_force(spark, shingle, percent):
    texts = awkward_texts()
    expected = linked_groups(texts, shingle, percent)
    rows = jaccard_join.groups(documents(spark), shingle, percent).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row["n_shingles"], row["component_id"]) == expected[row["doc_id"]], row["doc_id"]
        assert (row["group_id"] is None) == (row["n_shingles"] == 0)


def test_no_link_is_lost_in_a_crowd(spark):
    """Near copies around the threshold: buckets hold sets that are not linked to their least one."""
    rng = random.Random(4)
    base = prose(rng, 80).split(" ")
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(80)] = rng.choice("uvw") + str(rng.randrange(3))
        texts.append(" ".join(words))
    for shingle, percent in ((1, 90), (3, 80)):
        expected = linked_groups(texts, shingle, percent)
        assert len({root for _, root in expected}) > 1
        rows = jaccard_join.groups(documents(spark, texts), shingle, percent).collect()
        got = [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])]
        assert got == [root for _, root in expected]


@pytest.mark.parametrize("paired, room", [(0, 1e9), (64, 16), (512, 16)])
def test_no_link_is_lost_whether_buckets_go_as_pairs_or_in_blocks(spark, monkeypatch, paired, room):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "PAIR_BYTES", room)
    rng = random.Random(9)
    base, other = (prose(rng, 70).split(" ") for _ in range(2))
    texts = []
    for i in range(120):
        words = list(base if i % 3 else other)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(70)] = rng.choice("uvw") + str(rng.randrange(4))
        texts += [" ".join(words)] * rng.choice([1, 1, 3])
    expected = linked_groups(texts, 2, 80)
    assert len({root for _, root in expected}) > 5
    rows = jaccard_join.groups(documents(spark, texts).repartition(7), 2, 80).collect()
    got = [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert got == [root for _, root in expected]


def test_copies_of_a_set_take_no_place_in_buckets(spark, monkeypatch):
    """Copies come from many tasks. Alone they meet nobody; with others their set counts once or twice."""
    rows_of, whole = {}, jaccard_join.stored

    def stored(df, what):
        rows_of[what] = whole(df, what)
        return rows_of[what]

    monkeypatch.setattr(jaccard_join, "stored", stored)
    rng, plan = random.Random(2), jaccard_join.plan_for()
    alone, text = prose(rng, 120), prose(rng, 120)
    for texts, expected in (([alone] * 24, 0), ([text, text + " and more"] * 24, None)):
        signed = jaccard_join._signed(documents(spark, texts).repartition(8), plan, "text")
        jaccard_join._links(signed, plan)
        buckets = rows_of["jaccard-buckets"]
        most = buckets.groupBy("key", "sig").count().agg({"count": "max"}).first()[0]
        assert (buckets.count() == expected) if expected is not None else 0 < most <= 2


def test_pairs_of_a_bucket_leave_out_what_is_settled():
    key, band = [1] * 5, [3] * 5
    sig, lead, root = [10, 11, 12, 13, 14], [10, 10, 10, 12, 10], [10, 10, 12, 13, 14]
    found = jaccard_join.bucket_pairs(np.array([key, sig, lead, root, band])).T.tolist()
    # 10 and 11 are linked; 12 and 14 have been verified against 10, 13 against 12.
    assert found == [[10, 13, 3], [11, 12, 3], [11, 13, 3], [11, 14, 3], [12, 14, 3], [13, 14, 3]]
    twice = np.array([[5, 4, 5, 5], [7, 7, 7, 8], [0, 0, 0, 0]])
    assert jaccard_join._distinct(twice).T.tolist() == [[4, 7, 0], [5, 7, 0], [5, 8, 0]]
    assert jaccard_join._distinct(twice[:, :0]).shape == (3, 0)


def test_groups_of_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(7, "A b c d e"), (3, "a B c d e"), (None, "a b c d e"), (3, "a b c d e"),
            (None, "q r s t"), (None, "q r s t"), (8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS sig", "2 AS component_id", "3 AS size", "4 AS key"
    )
    got = jaccard_join.groups(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted(
        [("7", "3"), ("3", "3"), ("None", "3"), ("3", "3"), ("None", "None"), ("None", "None"),
         ("8", "8"), ("8", "8")]
    )
    assert all((r["sig"], r["size"], r["key"]) == (1, 3, 4) for r in got)
    assert jaccard_join.groups(df.limit(0)).count() == 0


def test_near_pairs_connect_what_all_pairs_connect():
    plan, rng = jaccard_join.plan_for(1, 80), random.Random(3)
    for _ in range(30):
        n = rng.randrange(3, 30)
        words = np.array([[rng.randrange(2) for _ in range(40)] for _ in range(n)], np.uint8)
        for i in range(1, n):
            if rng.random() < 0.6:
                words[i] = words[rng.randrange(i)]
                words[i, rng.randrange(40)] ^= 1
        sizes = [40] * n
        first = rng.choice([n, n // 2 or 1])
        every, some = (
            jaccard_join.near_pairs(list(range(n)), list(range(n)), sizes, words, first, plan, e)
            for e in (True, False)
        )
        lows = [range(x + 1, n) if first == n else range(first, n) for x in range(first)]
        near = {
            (x, y) for x in range(first) for y in lows[x] if (words[x] != words[y]).sum() <= 8
        }
        assert set(every) == near and set(some) <= near and len(some) < n
        for pairs in (every, some):
            label = list(range(n))
            for x, y in pairs:
                label = [label[x] if v == label[y] else v for v in label]
            groups = {v: [i for i in range(n) if label[i] == v] for v in label}
            assert all(label[x] == label[y] for x, y in near), groups


def test_word_hashes_tell_words_apart(monkeypatch):
    from forgepulse.llm import common

    texts = ["", " ", "a", " a\tb\x0bab ba  a ", "é e\u0301 \x1c\x85 x", "x" * 70_000 + " " + "x" * 70_001]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab \n") for _ in range(60)) for _ in range(50)]
    by_hash = {}
    for size in (1 << 20, 7):
        monkeypatch.setattr(common, "WORDS_SLICE", size)
        for text in texts:
            words, hashes = words_of(text), word_hashes(text.encode()).tolist()
            assert len(words) == len(hashes)
            for word, value in zip(words, hashes):
                assert by_hash.setdefault(word, value) == value
    assert len(set(by_hash.values())) == len(by_hash) > 50


def test_sketch_equals_the_plain_one():
    members = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    for words in (1, 7, 64):
        values, counts = jaccard_join.Spread(members, 1).sketch(words)
        whole, _ = jaccard_join.Spread(members, 1).sketch(1)
        assert np.bitwise_xor.reduce(values) == whole[0] and counts.sum() == len(members)
        # Taking one member out changes one word.
        less, fewer = jaccard_join.Spread(members[1:], 1).sketch(words)
        assert (less != values).sum() == 1 == (fewer != counts).sum()


def test_sketch_distance_bounds_the_difference():
    rng = random.Random(2)
    for _ in range(60):
        one = prose(rng, 40).split(" ")
        other = one[: rng.randrange(41)] + prose(rng, rng.randrange(1, 20)).split(" ")
        a, b = (jaccard_join.shingle_set(" ".join(x), 2) for x in (one, other))
        apart = len(np.setxor1d(a, b))
        for words in (5, 16, 60):
            for level in (0, 2):
                x, y = (jaccard_join.Spread(s, level).sketch(words)[0] for s in (a, b))
                assert (x != y).sum() <= apart


def test_linked_pairs_share_a_bucket():
    """The pigeonhole promise, on pairs at the threshold."""
    plan, rng = jaccard_join.plan_for(1, 80), random.Random(9)
    met = 0
    for n in (5, 9, 10, 16, 17, 40, 64, 65, 130, 300):
        for _ in range(40):
            one = {f"t{rng.random()}" for _ in range(n)}
            drop = rng.randrange(n // 5 + 1)
            other = set(rng.sample(sorted(one), n - drop)) | {
                f"u{rng.random()}" for _ in range(rng.randrange(n // 9 + 1))
            }
            a, b = (jaccard_join.shingle_set(" ".join(s), 1) for s in (one, other))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                keys = [
                    {(band, k) for band, ks in jaccard_join.bucket_keys(s, plan) for k in ks.tolist()}
                    for s in (a, b)
                ]
                assert keys[0] & keys[1], (len(a), len(b), common)
                met += 1
    assert met > 100


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    edges = chain + star + [(5, 5), (160, 159), (300, 301), (301, 302), (302, 300)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(df).collect()}
    expected = {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 260)}
    assert got == expected | {301: 300, 302: 300}
    assert components.connected(df.limit(0)).count() == 0
