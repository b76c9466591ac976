import random

from pyspark.sql import functions as F

from voxtable.operators import batching, diarization, errors, graphs, joins, ngrams, segments, splits
from voxtable.sources import readers

HEAD = '<Trans><Speakers><Speaker id="spk1" name="AB1"/><Speaker id="spk2" name="CD2"/></Speakers>'


def rebuilt(spark, body, merged=True):
    tokens, names = segments.trs_tokens(spark.createDataFrame([("r", HEAD + body + "</Trans>")], "rec_id string, value string"))
    out = segments.rebuild(tokens, names)
    out = segments.merge(out) if merged else out
    return [(r.speaker, r.start, r.end, r.text, r.overlap) for r in out.orderBy("turn", "pos", "speaker").collect()]


def test_segments(spark):
    body = '<Turn speaker="spk1" startTime="0" endTime="9"><Sync time="0"/>a\n<Sync time="4"/>b<Event desc="x"/>c</Turn>'
    body += '<Turn speaker="spk1 spk2" startTime="9" endTime="10"><Sync time="9"/><Who nb="1"/>d<Who nb="2"/>e &amp; f</Turn>'
    assert rebuilt(spark, body) == [("AB1", 0.0, 9.0, "a b c", False), ("AB1", 9.0, 10.0, "d", True), ("CD2", 9.0, 10.0, "e & f", True)]
    assert rebuilt(spark, '<Turn speaker="spk1" startTime="0" endTime="5.5">early<Sync time="5.5"/></Turn>') == [("AB1", 0.0, 5.5, "early", False)]
    assert rebuilt(spark, '<Turn startTime="0" endTime="5">none</Turn><Turn speaker="spk1" startTime="5" endTime="6"><Who nb="3"/>bad</Turn>') == []


def test_merge_cap_and_violations(spark):
    rows = [("r", i, 0, "s", float(4 * i), float(4 * i + 4), "x", False) for i in range(5)]
    df = spark.createDataFrame(rows, "rec_id string, turn int, pos int, speaker string, start double, end double, text string, overlap boolean")
    out = segments.merge(df)
    assert sorted((r.start, r.end) for r in out.collect()) == [(0.0, 8.0), (8.0, 16.0), (16.0, 20.0)]
    assert segments.violations(out).count() == 0 and segments.violations(df).count() > 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    rnd = random.Random(3)
    pairs = [(" ".join(rnd.choices("A BB CÉ D".split(), k=rnd.randint(0, 9))), " ".join(rnd.choices("A BB CÉ D".split(), k=rnd.randint(0, 9)))) for _ in range(60)]
    out = errors.pair_errors(spark.createDataFrame(pairs, "ref string, hyp string")).collect()
    for r in out:
        assert r.word_errors == distance(r.hyp.split(" "), r.ref.split(" ")) and r.char_errors == distance(r.hyp.replace(" ", "_"), r.ref.replace(" ", "_"))
    same = spark.createDataFrame([("X Y", "X Y")], "ref string, hyp string")
    assert errors.error_rates(same, []).first().wer == 0.0


def test_diarization(spark):
    kind = "rec_id string, speaker string, start double, end double"
    ref = spark.createDataFrame([("r", "a", 0.0, 10.0), ("r", "b", 10.0, 20.0)], kind)
    hyp = spark.createDataFrame([("r", "x", 0.0, 12.0), ("r", "y", 12.0, 18.0), ("r", "z", 25.0, 26.0)], kind)
    r = diarization.error_rate(diarization.diarization_errors(ref, hyp)).first()
    assert (r.total, r.miss, r.false_alarm, r.confusion) == (20.0, 2.0, 1.0, 2.0)
    assert diarization.error_rate(diarization.diarization_errors(ref, ref)).first().der == 0.0
    lax = diarization.error_rate(diarization.diarization_errors(ref, hyp, 1.0, True)).first()
    assert (lax.total, lax.miss, lax.false_alarm, lax.confusion) == (18.0, 1.5, 1.0, 1.5)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = graphs.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    got = {r.node: r.component for r in out.collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_first_overlap_matches_plain_search(spark):
    rnd = random.Random(7)
    turns = [("r", i, s := round(rnd.uniform(0, 200), 1), s + rnd.choice([0.5, 5.0, 70.0]), rnd.choice("ab")) for i in range(40)]
    utts = [("r", i, s := round(rnd.uniform(0, 220), 1), s + 3.0) for i in range(40)]
    out = joins.first_overlap(spark.createDataFrame(utts, "rec_id string, utt_id int, start double, end double"), spark.createDataFrame(turns, "rec_id string, turn_no int, start double, end double, speaker string"))
    for r in out.collect():
        want = next((t[4] for t in turns if t[2] <= r.end and t[3] >= r.start), None)
        assert r.speaker == want


def test_folds_and_splits(spark):
    rows = spark.range(23).withColumnRenamed("id", "k")
    folds = splits.kfold(rows, "k", 5).filter("role = 'test'").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [4, 4, 5, 5, 5]
    parts = {r["split"]: r["count"] for r in splits.ratio_split(rows, "k").groupBy("split").count().collect()}
    assert parts == {"train": 18, "dev": 2, "test": 3}


def test_ngram_probabilities_sum_to_one(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choices("a b c d e".split(), k=rnd.randint(1, 6))) for i in range(80)]
    counts = ngrams.ngram_counts(spark.createDataFrame(rows, "i int, words array<string>"), 3)
    model = ngrams.kneser_ney(counts, 3).collect()
    p = {tuple(r.gram): r.p for r in model}
    bow = {tuple(r.gram): r.backoff for r in model}

    def prob(h, w):
        if h + (w,) in p:
            return p[h + (w,)]
        return bow.get(h, 1.0) * prob(h[1:], w)

    words = ["a", "b", "c", "d", "e", "</s>", "<unk>"]
    for h in [(), ("a",), ("<s>",), ("<s>", "b"), ("c", "d")]:
        assert abs(sum(prob(h, w) for w in words) - 1) < 1e-6, h
    scored = ngrams.score_sentences(spark.createDataFrame([(1, ["a", "c"])], "sent_id int, words array<string>"), spark.createDataFrame(model), 3).first()
    import math

    want = math.log10(prob(("<s>",), "a")) + math.log10(prob(("<s>", "a"), "c")) + math.log10(prob(("a", "c"), "</s>"))
    assert abs(scored.log10 - want) < 1e-6 and scored.n == 3


def test_readers(spark, tmp_path):
    (tmp_path / "x.srt").write_text("1\n0:0:1,5 --> 0:0:2,250\nbonjour\n\n2\n00:01:00,000 --> 00:01:01,000\nà\nbientôt\n")
    items = readers.srt_items(readers.whole_files(spark, str(tmp_path), "*.srt")).orderBy("pos").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in items] == [(1005, 2250, "bonjour"), (60000, 61000, "à\nbientôt")]
    (tmp_path / "s.xml").write_text('<d><s id="1"><w>Bon</w><time id="T"/><w>jour</w><w>.</w></s><s><w>a</w></s></d>')
    out = readers.subtitle_sentences(readers.whole_files(spark, str(tmp_path), "*.xml")).orderBy("sent_no").collect()
    assert [r.text for r in out] == ["Bon jour", ""]
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0" * 16000)
    r = readers.wave_headers(spark, str(tmp_path / "a.wav")).first()
    assert (r.rate, r.frames, r.duration) == (8000, 8000, 1.0)


def test_padding_round_trip(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3],)], "t array<int>")
    padded = df.select("t", batching.pad(F.col("t"), F.lit(3)).alias("p"))
    assert all(r.t == r.u for r in padded.select("t", batching.unpad(F.col("p"), F.size("t") / 3).alias("u")).collect())
