"""Cases that every operator and every stage has to take: awkward columns, very long texts, ties, repeats, nothing at all."""

import random

import corpus_pipeline
import pytest
from symgrove.llm import decontam, langid, mixing, oddsketch, packing, quality, repeats, tokencount
from tests.llm.test_operators import prose

ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c``d` int, copies long, __row string, __doc string, shingle int, fp int, sketch int"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with the tables that the stages read beside the documents."""
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one of the passages that no document should hold at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 2, 3, "r", "d", 4, 5, 6) for i, t, s in rows], ODD)


def test_stages_carry_columns_of_any_name(spark, sf):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randrange(20, 80), bad=i % 3 == 0), f"s{i % 2}") for i in range(120)]
    rows += [(None, "no id", None), (200, None, None), (201, "", "s0"), (7, rows[7][1], "s1"), (8, rows[11][1], "s0"), (202, "one of the passages that no document should hold at all", "s1")]
    docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert got and {tuple(r)[4:] for r in got} == {(1, "x", 2, 3, "r", "d", 4, 5, 6)}
        docs = spark.createDataFrame(got, docs.schema)
        ids = {r["doc_id"] for r in got}
        assert (None in ids and {200, 201} <= ids) != (name == "mixing") and (202 in ids) == (name in ("quality", "near_duplicates"))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(got)


def test_very_long_texts(spark):
    rnd = random.Random(6)
    words = [f"{rnd.choice(['river', 'stone', 'light', 'garden'])}{rnd.randrange(400)}" for _ in range(160_000)]
    long = " ".join(words)  # over 1 MB
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, long + " end", "en", "b"), (3, "x" * (1 << 20), "en", "a"), (4, "short text", "en", "b")], "doc_id long, text string, lang string, source string")
    groups = {r["doc_id"]: r["rep_id"] for r in oddsketch.near_duplicates(docs).collect()}
    assert groups == {2: 1}
    item = spark.createDataFrame([(9, " ".join(words[100_000:100_040]))], "item_id long, text string")
    assert sorted(tuple(r)[:2] for r in decontam.contained_items(docs, item).collect()) == [(1, 9), (2, 9)]
    found = repeats.occurrences(repeats.repeated_passages(docs)).collect()
    assert {(r["n_words"], r["doc_id"], r["position"]) for r in found} >= {(160_000, 1, 0), (160_000, 2, 0)}
    ids = {r["doc_id"]: r["ids"] for r in packing.decoded(packing.token_blocks(docs)).collect()}
    # every edit of a text without a space encodes all of it again, so that one gets a single edit
    edits = tokencount.edit_log(docs.filter("doc_id <> 3")).unionByName(tokencount.edit_log(docs.filter("doc_id = 3"), every=1 << 22))
    counts = {r["doc_id"]: r for r in tokencount.edited_counts(edits).collect()}
    assert all(counts[i]["n_tokens"] == len(ids[i]) for i in ids) and len(ids[2]) == len(ids[1]) + 1
    assert counts[1]["chars_encoded"] < 0.7 * len(long)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep(docs, labels).count() == 4
    assert sum(r["copies"] for r in mixing.sample_copies(docs).collect()) == 4
    assert langid.identify(docs).count() == 4


def test_languages_that_tie(spark):
    # both have the same ids, and so the same held-out ones and equal counts
    rows = [(i, "the same words in each of them", lang) for i in range(40) for lang in ("bb", "aa")] + [(100, "the same words", None), (100, "the same words", None), (101, "", "aa"), (None, "the", "aa")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 83 and {r["closest"] for r in got if r["entropy"] is not None} == {"aa"}
    assert [r["closest"] for r in got if r["doc_id"] == 101] == [None] and sum(r["doc_id"] == 100 for r in got) == 2
