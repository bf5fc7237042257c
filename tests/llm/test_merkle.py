"""The Merkle manifest against a plain recomputation."""

import hashlib
import os
import sys
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import awkward_texts  # noqa: E402

from forgepulse.llm import merkle  # noqa: E402

LOWER = str.maketrans(merkle._UPPER, merkle._LOWER)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(level):
    """All levels of a tree, lowest first."""
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        levels.append(level)
    return levels


def climb(levels, at):
    steps = []
    for level in levels[:-1]:
        lo = at // 16 * 16
        steps.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + 16])))
        at //= 16
    return steps


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (_, _, own, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = climb(trees[s], at) + climb(top, place)
            cur, doc_id, text = own, row[0], row[4]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                cur = leaf((*row[:4], None if text is None else text.translate(LOWER)))
            for left, right in path:
                cur = h(left, cur, right)
            proof = h(*[left + right for left, right in path])
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def run(spark, rows, tmp_path, parts=3):
    folder = str(tmp_path)
    with_more = [(*r, "a clashing column") for r in rows]
    df = spark.createDataFrame(with_more, SCHEMA).repartition(parts)
    df.write.parquet(f"{folder}/documents.parquet")
    got = merkle.op13_merkle(spark, folder).select(*COLUMNS).collect()
    return sorted(map(tuple, got), key=str)


def test_awkward_rows(spark, tmp_path):
    texts = ["MiXed Case", *[t and t.capitalize() for t in awkward_texts()]]
    rows = [
        (i, [None, "z", "é", "Z", ""][i % 5], [None, "en"][i % 2], [None, len(t or "")][i % 2], t)
        for i, t in enumerate(texts)
    ]
    rows += rows[:4] + [(None, "z", None, None, "x"), (None, "alone", None, None, "X")]
    got = run(spark, rows, tmp_path)
    assert got == sorted(plain(rows), key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_source_of_many_blocks_and_runs_of_one(spark, tmp_path):
    rows = [(i, "hot", "en", 3, f"T{i}") for i in range(256 * 16 + 1)]
    rows += [(i, f"s{i:03}", "en", 3, f"T{i}") for i in range(40)]
    assert run(spark, rows, tmp_path, 5) == sorted(plain(rows), key=str)


def test_three_rounds_of_blocks(spark):
    n = 256 * 256 + 17
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.lit("one").alias("source"),
        F.sha2(F.col("id").cast("string"), 256).alias("leaf"),
    )
    proved = merkle.manifest(rows)
    levels = grow([h(str(i)) for i in range(n)])
    assert proved.count() == n
    assert [r[0] for r in proved.select("root").distinct().collect()] == [levels[-1][0]]
    wrong = proved.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root"))
    assert wrong.count() == 0
    for r in proved.where(F.col("doc_id").isin(0, 70, n - 1)).collect():
        assert [(s["left"], s["right"]) for s in r["path"]] == climb(levels, r["doc_id"])


def test_empty_and_single(spark, tmp_path):
    assert run(spark, [], tmp_path / "empty") == []
    rows = [(5, None, None, None, None)]
    assert run(spark, rows, tmp_path / "one") == plain(rows)


def test_a_row_repeated_very_often(spark, tmp_path):
    rows = [(7, "a", "en", 1, "Same")] * 700 + [(8, "a", "en", 1, "other")] * 3
    got = run(spark, rows, tmp_path)
    # Equal rows are interchangeable: what they get as a whole is fixed.
    assert got == sorted(plain(rows), key=str)
