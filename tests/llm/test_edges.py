"""Every operator on odd rows and on no rows."""

import numpy as np
import pytest

import corpus_pipeline
from folkmoot.llm import decontam, fertility, gumbel, linededup, neardup, pii, preference, sharding, tokencount, toxicity
from tests.llm.conftest import TEXTS

CRF = None


@pytest.fixture(scope="module")
def crf():
    return pii.fit(sentences=120, epochs=8)


@pytest.fixture(scope="module")
def model():
    return toxicity.train(["you idiot and fool"] * 20 + ["a nice day out"] * 20, np.array([1] * 20 + [0] * 20), rounds=20, passes=1)


@pytest.fixture(scope="module")
def index(spark):
    items = spark.createDataFrame([(1, "same words here again and again in this text. of ours"), (2, None), (3, ""), (4, "!!!")], "item_id long, text string")
    return decontam.Benchmark(items)


def texts(df):
    return sorted((r["text"] or "\0", r["doc_id"] or 0) for r in df.select("doc_id", "text").collect())


def test_line_dedup(odd, none):
    got = linededup.line_dedup(odd, min_sites=2)
    assert got.columns == odd.columns and got.count() == len(TEXTS)
    assert linededup.line_dedup(none).count() == 0
    out = {r["doc_id"]: r for r in linededup.line_dedup(odd, min_sites=2, counts=True).collect()}
    assert out[2]["text"] is None and out[2]["n_removed"] is None and out[3]["text"] == "" and out[4]["text"] == " \n\n\t"


def test_samples(odd, none):
    got = gumbel.encode_samples(odd, k=2).collect()
    assert gumbel.encode_samples(none).count() == 0
    assert all(r["exact"] for r in got if r["ids"] is not None)
    assert [r["rank"] for r in got if r["doc_id"] == 2] == [0] and [r["ids"] for r in got if r["doc_id"] == 3] == [[]]
    again = [tuple(r["ids"]) for r in got if r["doc_id"] == 8]
    assert len(again) == 4 and len(set(again)) == 2


def test_preference(spark, none):
    schema = "conv_id long, turn long, role string, text string, pair string, TEXT string"
    a = spark.createDataFrame([(1, 0, "user", "hi", "", ""), (1, 1, None, None, "", ""), (1, 1, None, None, "", ""), (None, 0, "user", "x", "", ""), (2, None, "user", "x", "", ""), (3, 0, "user", "only", "", "")], schema)
    b = spark.createDataFrame([(1, 0, "user", "hi", "", "")], schema)
    got = preference.preference_format(a, b).collect()
    assert len(got) == 1 and got[0]["n_prompt"] == 1 and got[0]["rejected"] == "" and got[0]["rejected_mask"] == []
    assert preference.preference_format(a.limit(0), b).count() == 0
    # Nobody replies in 1 and 3, so both sides are equal there.
    got = {r["pair_id"]: r for r in preference.preference_format(*preference.rejected_sides(a)).collect()}
    assert set(got) == {1, 3} and all(r["chosen"] == r["rejected"] == "" for r in got.values()) and got[1]["n_prompt"] == 3
    one = a.limit(0).union(spark.createDataFrame([(4, 0, "user", "q", "", ""), (4, 1, "assistant", "r", "", ""), (4, 2, "user", "thanks", "", "")], schema))
    r = preference.preference_format(*preference.rejected_sides(one)).first()
    assert r["n_prompt"] == 1 and r["rejected"].startswith("<|im_start|>assistant\n<|im_end|>") and r["chosen"].endswith("thanks<|im_end|>\n")
    assert preference.preference_format(*preference.rejected_sides(a.limit(0))).count() == 0


def test_token_counts(odd, none):
    got = {r["doc_id"]: r for r in tokencount.token_counts(odd).collect()}
    assert got[2]["n_tokens"] is None and got[3]["n_tokens"] == 0 and got[6]["n_bytes"] == 50_000
    assert tokencount.token_counts(none).count() == 0


def test_near_duplicates(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS)
    assert {r["group_id"] for r in got if r["doc_id"] in (7, 8)} == {7}
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 9]


def test_private(odd, none, crf):
    got = pii.mask_private(odd, crf).collect()
    assert len(got) == len(TEXTS) and pii.mask_private(none, crf).count() == 0
    assert any(r["doc_id"] is None and r["text"] and "[email]" in r["text"] for r in got)
    assert all(r["spans"] == [] for r in got if r["text"] is None)


def test_sharding(odd, none):
    got = sharding.shard_plan(odd, shards=3).collect()
    assert sorted(r["position"] for r in got) == list(range(len(TEXTS)))
    assert sharding.shard_plan(none).count() == 0


def test_decontamination(odd, none, index):
    got = sorted(r["doc_id"] for r in decontam.find_leaks(odd, index).collect())
    assert got == [7, 8, 8]
    assert decontam.find_leaks(none, index).count() == 0
    kept = decontam.drop_leaked(odd, index)
    assert kept.columns == odd.columns and kept.count() == len(TEXTS) - 3


def test_decontamination_without_items_and_with_ties(spark, odd):
    schema = "item_id long, text string"
    for rows in ([], [(1, None), (2, ""), (3, "?!")]):
        empty = decontam.Benchmark(spark.createDataFrame(rows, schema))
        assert decontam.find_leaks(odd, empty).count() == 0 and decontam.drop_leaked(odd, empty).count() == len(TEXTS)
    item = "one odd question of many words. its answer stands here"
    twice = decontam.Benchmark(spark.createDataFrame([(1, item), (1, item), (2, item)], schema))
    text = " ".join([item] + [f"w{n}" for n in range(200)] + [item])
    got = decontam.find_leaks(spark.createDataFrame([(5, text)], "doc_id long, text string"), twice).collect()
    # Repeated items give a row each; of passages that tie the first is named.
    assert sorted((r["item_id"], r["first_word"]) for r in got) == [(1, 0), (1, 0), (2, 0)]


def test_fertility(odd, none):
    got = {r["doc_id"]: r for r in fertility.fertility_rules(odd).collect()}
    assert got[2]["reason"] == got[3]["reason"] == "empty" and got[7]["keep"]
    assert fertility.fertility_rules(none).count() == 0


def test_toxicity(odd, none, model):
    got = {r["doc_id"]: r for r in toxicity.toxicity(odd, model).collect()}
    assert got[2]["score"] is None and got[4]["score"] is None and not got[3]["toxic"]
    assert toxicity.toxicity(none, model).count() == 0 and toxicity.drop_toxic(none, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_columns_are_named_in_errors(odd):
    with pytest.raises(ValueError, match="missing"):
        tokencount.token_counts(odd, text_col="missing")


def test_pipeline(spark, odd, none, tmp_path):
    """Odd rows, no rows, and no labels or test items: every stage gives the columns of its input, and no row is lost for being odd."""
    few = odd.toDF(*[f"c{n}" for n in range(len(odd.columns))]).selectExpr("c0 AS doc_id", "c1 AS text", "c2 AS lang", "c3 AS source", "CAST(length(c1) AS BIGINT) AS n_chars")
    for name, docs in (("odd", few), ("none", few.limit(0))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        at = spark.read.parquet(str(folder / "documents.parquet"))
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(folder))
            if n < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(folder / f"stage{n}"))
            at = spark.read.parquet(str(folder / f"stage{n}"))
        got = [r["doc_id"] for r in at.where("rank = 0").select("doc_id").collect()]
        assert sorted(x or 0 for x in got) == ([0, 0, 1, 2, 3, 4, 5, 6, 7, 9] if name == "odd" else [])
        assert corpus_pipeline.run(spark, str(folder)).count() == at.count()


def test_toxicity_without_labels_or_texts(spark, odd, none):
    labels = "doc_id long, toxic long"
    for docs, rows in ((odd, []), (none, [(1, 1), (2, 0)]), (odd, [(1, 1), (5, 1)]), (odd, [(None, 1), (1, None)])):
        m = toxicity.fit(docs, spark.createDataFrame(rows, labels))
        assert toxicity.drop_toxic(odd, m).count() == len(TEXTS)
