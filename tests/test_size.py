"""Results and scratch files of jobs on tables that are larger than a small test's, as far as a small test can tell."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxtable.operators import batching, graphs, ngrams, splits
from voxtable.plans import storage
from voxtable.sources import readers, writers


def _shuffle_files(spark):
    return {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*") if p.is_file()}


def test_stored_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    held = storage.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert not _shuffle_files(spark) - before
    assert held.count() == 7


@pytest.mark.parametrize("hub", [1_000, 5])
def test_components_by_ties_to_the_least_recording(spark, monkeypatch, hub):
    monkeypatch.setattr(graphs, "HUB", hub)
    rnd = random.Random(hub)
    rows = [(rnd.randrange(200), str(rnd.randrange(150))) for _ in range(170)] + [(r, "hub") for r in range(300, 330)] + [(500, None), (None, "7"), (501, "alone"), (501, "alone")]
    mentions = spark.createDataFrame(rows, "rec_id long, speaker string")
    ties, _ = graphs.star_ties(mentions, "speaker", "rec_id")
    speakers = {}
    for r, s in rows:
        if r is not None and s is not None:
            speakers.setdefault(s, set()).add(r)
    # n recordings of a speaker take n - 1 ties, where edges to the speaker were n
    assert ties.distinct().count() == len({(v, min(x)) for x in speakers.values() for v in x if v != min(x)})
    root = {str(r): str(r) for x in speakers.values() for r in x}
    for _ in root:
        for x in speakers.values():
            least = min(root[str(r)] for r in x)
            root |= {str(r): least for r in x}
    assert {r.rec_id: r.component for r in splits.recording_components(mentions).collect()} == root


def test_exact_bounds_of_many_lengths(spark):
    """Beyond 10 000 rows a sketch is off by a rank or more."""
    rnd = random.Random(1)
    values = [int(rnd.lognormvariate(12, 3)) for _ in range(60_000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "n long")
    held, n = sorted(values), len(values)
    ranks = [-(-i * n // 30) for i in range(1, 31)]
    assert batching.length_boundaries(rows, "n") == sorted({float(held[r - 1]) for r in ranks})


def test_named_files_are_written_and_named_by_tasks(spark, tmp_path, monkeypatch):
    calls = []
    gateway = type(spark._jvm.org.apache.hadoop.fs.Path)
    monkeypatch.setattr(gateway, "__call__", lambda self, *a, old=gateway.__call__: (calls.append(a) if self._fqn.endswith("fs.Path") else None) or old(self, *a))
    rows = spark.createDataFrame([(f"a b/é {k}+%", i, None if i == 1 else f"{k} {i}") for k in range(40) for i in range(3)], "key string, at int, value string").repartition(5)
    path = str(tmp_path / "out x")
    for _ in range(2):
        writers.write_named(rows, path, "key", ["at"], ".txt")
    assert len(calls) < 10  # the driver's calls don't grow with the files
    assert sorted(p.name for p in Path(path).rglob("*") if p.is_file()) == sorted(f"é {k}+%.txt" for k in range(40))
    assert Path(path, "a b", "é 7+%.txt").read_text() == "7 0\n\n7 2\n"
    assert not [p for p in Path(path).iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="a file needs a name"):
        writers.write_named(rows.union(spark.createDataFrame([(None, 1, "x")], rows.schema)), str(tmp_path / "failed"), "key", ["at"], ".txt")
    assert not [p for p in (tmp_path / "failed").rglob("*") if p.is_file()]
    assert readers.whole_files(spark, path, "*.txt").count() == 40


def test_recordings_of_three_figures_keep_their_folder(spark, tmp_path):
    turns = spark.createDataFrame([(c, 0, "user", f"some words of {c}") for c in (7, 12, 123, 124, 1240)], "conv_id long, turn int, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    import __spark_entry__

    found = __spark_entry__.queries()["q_trs_folders"](spark, str(tmp_path))
    assert sorted((r.rec_id, r.text) for r in found.collect()) == sorted((f"record-{c:03d}", f"some words of {c} fin") for c in (7, 12, 123, 124, 1240))


def test_scores_by_a_broadcast_model_and_by_joins(spark):
    rnd = random.Random(2)
    text = lambda n: [rnd.choice("abcdef") for _ in range(n)]
    learned = spark.createDataFrame([(text(12),) for _ in range(15)], "words array<string>")
    model = storage.materialize(ngrams.kneser_ney(storage.materialize(ngrams.ngram_counts(learned, 3), "counts"), 3), "model")
    asked = spark.createDataFrame([(i, text(i % 9) + ["x y", "zz", ""][: i % 4]) for i in range(40)] + [(99, None)], "sent_id int, words array<string>")
    of = lambda most: {r.sent_id: (round(r.log10, 9), r.n) for r in ngrams.score_sentences(asked, model, 3, most=most).collect()}
    assert of(10_000) == of(0) and len(of(10_000)) == 40
    plan = ngrams.score_sentences(asked, model, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") <= 1


def test_calibration_takes_every_row(spark):
    """One odd row among 8000 sets the bound of rejection, wherever it stands."""
    from voxtable.llm import language_id

    texts = [(f"the quick brown fox {'jumps ' * (i % 5)}", "en") for i in range(4000)] + [(f"le renard brun {'saute ' * (i % 5)}", "fr") for i in range(4000)]
    odd = [("zyxwv " * 3, "en")]
    rows = spark.createDataFrame(texts + odd, "text string, lang string")
    model = language_id.train(rows)
    least = [min(r.entropies) for r in language_id.score(spark.createDataFrame(odd, "text string, lang string"), model, "lang", "text").collect()]
    known = language_id.score(rows, model, "lang", "text").collect()
    right = [min(r.entropies) for r in known if model.languages[r.entropies.index(min(r.entropies))] == r.doc_id]
    assert max(right) == least[0]
    mean = sum(right) / len(right)
    spread = (sum((x - mean) ** 2 for x in right) / len(right)) ** 0.5
    assert abs(model.reject - (max(right) + max(10 * spread, 1.0))) < 1e-6


def test_a_stratified_split_leaves_no_shuffle_files_before_its_last_join(spark):
    mentions = spark.createDataFrame([(r, s) for r in range(95, 130) for s in (r // 3, 100 + r % 7 if r > 120 else 1000 + r)], "rec_id long, speaker long")
    before = _shuffle_files(spark)
    components = storage.materialize(splits.recording_components(mentions), "components")
    assert "SortAggregate" not in splits.recording_components(mentions)._jdf.queryExecution().executedPlan().toString()  # ids stay numbers
    recordings = spark.createDataFrame([(str(r), "ab"[r % 2]) for r in range(95, 130)], "rec_id string, category string")
    split = splits.stratified_split(recordings, components)
    assert not _shuffle_files(spark) - before
    named = {r.rec_id: r.component for r in split.collect()}
    assert len(named) == 35 and named["99"] == named["101"] == "100"  # the least as text


def test_small_named_files_are_written_by_many_tasks_and_read_by_few(spark, tmp_path, monkeypatch):
    folders = []

    def stored(df, name):
        held = storage.materialize(df, name)
        folders.append(held.select(F.regexp_extract("part", "(.*)/", 1)).distinct().count())
        return held

    monkeypatch.setattr(writers, "materialize", stored)
    rows = spark.createDataFrame([(f"f{k}", f"{k}") for k in range(60)], "key string, value string")
    writers.write_named(rows, str(tmp_path / "out"), "key", ["value"], ".txt")
    assert folders == [4]  # bytes are few, but files many
    found = readers.whole_files(spark, str(tmp_path / "out"), "*.txt", tasks=2)
    assert found.rdd.getNumPartitions() == 2
    assert sorted((r.name, r.value) for r in found.collect()) == sorted((f"f{k}", f"{k}\n") for k in range(60))


def test_intervals_come_from_one_sweep_without_joins(spark):
    from voxtable.operators import diarization

    turns = lambda rows: spark.createDataFrame(rows, "rec_id string, speaker string, start double, end double")
    ref = turns([("a", "x", 0.0, 4.0), ("a", "y", 3.0, 6.0), ("a", "x", 3.5, 5.0), ("a", None, 8.0, 9.0), ("b", "x", 1.0, 2.0), ("b", "x", 1.0, 2.0), (None, "x", 0.0, 1.0), ("c", "x", None, 1.0), ("d", "x", 2.0, 2.0)])
    hyp = turns([("a", "h", 1.0, 5.5), ("b", "h", 1.5, 3.0)])
    cut = diarization.intervals(ref, hyp)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1
    got = sorted((r.rec_id, r.duration, *map(tuple, (r.refs, r.hyps))) for r in cut.collect())
    assert got == sorted([("a", 1.0, ("x",), ()), ("a", 2.0, ("x",), ("h",)), ("a", 0.5, ("x", "y"), ("h",)), ("a", 0.5, ("x", "y"), ("h",)), ("a", 1.0, ("x", "y"), ("h",)), ("a", 0.5, ("y",), ("h",)), ("a", 0.5, ("y",), ()), ("b", 0.5, ("x",), ()), ("b", 0.5, ("x",), ("h",)), ("b", 1.0, (), ("h",))])
    uem = spark.createDataFrame([("a", 0.0, 3.0)], "rec_id string, start double, end double")
    assert sorted(r.duration for r in diarization.intervals(ref, hyp, 0.5, True, uem).collect()) == [0.75, 1.75]


def test_pruned_ngrams_are_counted_without_storing_them(spark, tmp_path):
    import __spark_entry__

    rnd = random.Random(17)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(400))) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1).groupBy("id").count().collect()
    folder = Path(storage.work_folder(spark))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before, files = size(), _shuffle_files(spark)
    got = __spark_entry__.queries()["q_ngram_pruned"](spark, str(tmp_path)).collect()
    assert [r.total for r in sorted(got)[:2]] == [40_200, 40_100]
    assert size() - before < 20_000  # tables of the n-grams take 240 KB
    assert not _shuffle_files(spark) - files


@pytest.mark.parametrize("order,prune_from,most,bucket", [(3, 3, 32 << 20, 8 << 20), (4, 2, 300, 100), (1, 0, 1, 1 << 20)])
def test_totals_of_ngrams_are_those_of_their_table(spark, monkeypatch, order, prune_from, most, bucket):
    from voxtable.operators import ngram_totals

    monkeypatch.setattr(ngram_totals, "SLICE", most)
    monkeypatch.setattr(ngram_totals, "BUCKET", bucket)
    rnd = random.Random(order)
    text = lambda n: "".join(rnd.choice(["a", "b", "é", "<s>", "</s>", "c d"]) + rnd.choice(" \n") for _ in range(n))
    texts = spark.createDataFrame([(text(rnd.randrange(12)),) for _ in range(150)] + [(None,), ("",), (" ",), ("hot " * 500,)], "text string").repartition(3)
    words = texts.filter("text is not null").select(F.split(F.translate("text", "\n", " "), " ", -1).alias("words"))
    want = ngrams.prune(ngrams.ngram_counts(words, order), order, prune_from).groupBy("n").agg(F.count("*"), F.sum("raw")).collect()
    got = ngram_totals.totals(texts, order, prune_from)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == order
    assert ngram_totals.totals(texts.limit(0), order, prune_from).collect() == []


def test_ngrams_with_equal_first_bits_are_told_apart():
    import numpy as np
    import pyarrow as pa

    from voxtable.operators import ngram_totals

    back = pow(int(ngram_totals.MIX), -1, 1 << 64)
    of = [(7 << 40) + k for k in (0, 1, 0, 2, 1, 0)]  # after mixing they differ in their last bits only
    high, low = np.array([k * back % (1 << 64) for k in of], np.uint64), np.array([5, 5, 5, 5, 5, 6], np.uint32)
    columns = {"high": high, "low": low, "raw": np.array([1, 1, 2, 1, 1, 9], np.uint32)}
    table = pa.table({"n": pa.array([2, 2], pa.int32()), "bucket": [0, 0]} | {k: pa.array([v[:2].tobytes(), v[2:].tobytes()], pa.binary()) for k, v in columns.items()})
    assert ngram_totals._left([0, 1])(table).to_pylist() == [{"n": 2, "grams": 3, "total": 14}]
