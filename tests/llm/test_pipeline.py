"""The pipeline's stages against brute force, and its queries and their SQL on the given tables."""

import importlib
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import DOCUMENTS, linked_groups, prose, removed_words, words_of  # noqa: E402

import corpus_pipeline  # noqa: E402
from forgepulse.llm import catalog  # noqa: E402
from forgepulse.llm.common import shared_folder  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _docs(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENTS
    )


def _corpus() -> list[tuple]:
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(40, 160)), f"src{i % 3}") for i in range(40)]
    rows += [(40 + i, rows[i][1], "src1") for i in range(5)]
    rows += [(50 + i, rows[i][1] + " tail", "src2") for i in range(5, 9)]
    passage = prose(rng, 70)
    rows += [(60 + i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}", "src0") for i in range(4)]
    return rows + [(70, None, "src0"), (71, "", "src0"), (72, "short text", None)]


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = sorted(_corpus())
    roots = linked_groups([t for _, t, _ in rows], 5, 80)
    expected = [rows[i][0] for i, (n, root) in enumerate(roots) if n == 0 or root == i]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, _docs(spark, rows), SF)
    assert kept.columns == COLUMNS
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_near_duplicates_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "y"), (None, "g h i j k l", "x"),
            (4, "m n o p q r", "x"), (4, "m n o p q r", "x"), (5, None, "x"), (5, None, "x")]
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, _docs(spark, rows), SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [
        ("4", "m n o p q r"), ("5", "None"), ("5", "None"),
        ("None", "a b c d e f"), ("None", "g h i j k l"),
    ]


def test_repeated_passages_are_cut_and_clean_texts_stay(spark):
    rows = sorted(_corpus())
    drops = removed_words([t for _, t, _ in rows], 50)
    done = corpus_pipeline.drop_repeats(spark, _docs(spark, rows), SF)
    assert done.columns == COLUMNS
    got = {r["doc_id"]: r for r in done.collect()}
    for (i, text, _), drop in zip(rows, drops):
        expected = text
        if any(drop):
            kept = [w for w, d in zip(words_of(text), drop) if not d]
            expected = b" ".join(kept).decode()
        assert got[i]["text"] == expected
        assert got[i]["n_chars"] == (None if expected is None else len(expected))


def test_mixing_and_tokens(spark):
    docs = _docs(spark, _corpus())
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == COLUMNS
    assert mixed.exceptAll(mixed.join(docs.select("doc_id"), "doc_id", "left_semi").select(COLUMNS)).count() == 0
    coded = corpus_pipeline.tokenize(spark, docs, SF)
    assert coded.count() == docs.count() and coded.where(~F.col("exact")).count() == 0


def test_toxic_documents_go_and_others_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == COLUMNS
    assert kept.exceptAll(docs).count() == 0 and kept.count() > 0.7 * docs.count()
    empty = _docs(spark, [(70, None, "src0"), (71, "", "src0")])
    assert corpus_pipeline.drop_toxic(spark, empty, SF).count() == 2


def test_the_whole_pipeline_runs(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "substring_dedup", "mixing", "byte_bpe"
    ]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 100 and all(r["exact"] for r in rows)


def test_empty_tables_pass(spark):
    docs = _docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    duckdb = importlib.import_module("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(
        map(repr, expected.select(*columns).fetchall())
    )


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_columns_named_like_the_operators_own_keep_their_values(spark):
    names = ("n_removed", "group_id", "copy_no", "kept_text", "shuffle_key", "component_id", "score")
    docs = _docs(spark, sorted(_corpus()))
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(77 + i))
    for stage in (
        corpus_pipeline.drop_toxic,
        corpus_pipeline.keep_one_of_near_duplicates,
        corpus_pipeline.drop_repeats,
        corpus_pipeline.mix_sources,
    ):
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns
        assert [tuple(r) for r in done.select(*names).distinct().collect()] == [tuple(range(77, 84))]
