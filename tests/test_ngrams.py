"""Models over integer ids against those over words, heavy n-grams, and sums of probabilities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxtable.operators import joins, ngrams, packed_ngrams


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(4)
    words = "a b c d e f".split()
    rows = [(i, rnd.choices(words, weights=[6, 2, 1, 1, 1, 1], k=rnd.randint(0, 9))) for i in range(90)] + [(900, []), (901, None), (902, ["a"] * 300)]
    return spark.createDataFrame(rows, "sent_id int, words array<string>")


def whole(texts, order, prune):
    words, seed = packed_ngrams.vocabulary(texts)
    model = packed_ngrams.kneser_ney(packed_ngrams.counts(texts, order, seed), order, seed, prune)
    return model, words, seed


@pytest.mark.parametrize("order,prune,hot", [(3, 0, None), (4, 4, None), (4, 4, 5)])
def test_model_and_scores_are_those_of_words(spark, texts, monkeypatch, order, prune, hot):
    if hot:
        monkeypatch.setattr(joins.spread_join, "__defaults__", (hot,))
    model, words, seed = whole(texts, order, prune)
    got = {(r.n, r.gram): (r.p, r.backoff) for r in packed_ngrams.decoded(model, words).collect()}
    known = texts.filter("words is not null")
    old = ngrams.kneser_ney(ngrams.ngram_counts(known, order), order, prune).persist()
    want = {(r.n, " ".join(r.gram)): (r.p, r.backoff) for r in old.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][i], want[k][i], rel_tol=1e-9, abs_tol=1e-15) for k in want for i in (0, 1))
    asked = known.unionByName(spark.createDataFrame([(950, ["a", "new", "b", "new"]), (951, ["new"])], texts.schema))
    a = {r.sent_id: (round(r.log10, 6), r.n) for r in packed_ngrams.score(asked, model, seed).collect()}
    b = {r.sent_id: (round(r.log10, 6), r.n) for r in ngrams.score_sentences(asked, old, order).collect()}
    assert a == b and len(a) == 94


def test_no_task_gets_a_heavy_word(spark):
    rows = spark.range(200_000).select((F.col("id") % 7 * F.when(F.col("id") % 10 < 3, 0).otherwise(1) * F.col("id")).alias("w1"), "id")
    right = rows.select("w1").distinct().withColumn("p", F.col("w1") + 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.spread_join(rows.repartition(8), right, ["w1"], ["id"], hot=5_000)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200_000 and out.filter("p <> w1 + 1 or p is null").isEmpty()
        assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_table(spark):
    model, words, _ = whole(spark.createDataFrame([], "sent_id int, words array<string>"), 3, 0)
    assert sorted(r.gram for r in packed_ngrams.decoded(model, words).collect()) == ["<s>", "<unk>"]
