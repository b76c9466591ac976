import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from voxtable.functions.text import hash_order, unescape
from voxtable.operators import batching, diarization, errors, ranking, sampling, segments, splits
from test_operators import HEAD, distance, rebuilt


def test_unescape(spark):
    df = spark.createDataFrame([("a &lt;b&gt; &#233;&#x1F600; &amp;lt; &amp;#65;",)], "t string")
    assert df.select(unescape(F.col("t"))).first()[0] == "a <b> é😀 &lt; &#65;"


def test_edit_distance():
    rnd = random.Random(5)
    for size in (0, 1, 2, 7, 30, 90):
        for letters in ("ab", "abcdefgh"):
            for _ in range(40):
                a, b = ("".join(rnd.choices(letters, k=rnd.randint(0, size))) for _ in range(2))
                for block in (1, 3, 8, 64, errors.BLOCK):
                    assert errors.edit_distance(a, b, block) == distance(a, b), (a, b, block)


def test_word_errors_of_long_texts(spark):
    n = 50_000  # distinct words; one word in 50 goes, another changes
    ref = [f"W{i}" for i in range(n)]
    hyp = [f"X{i}" if i % 50 == 7 else w for i, w in enumerate(ref) if i % 50 != 30]
    assert errors.edit_distance(ref, hyp) == 2 * n // 50
    letters = [f"W{chr(65 + i % 26)}{chr(65 + i // 26 % 26)}{chr(65 + i // 676)}" for i in range(3000)]
    rows = [(1, " ".join(letters), " ".join(letters[5:2000] + ["NEW"] + letters[2000:])), (2, None, "A B"), (3, "", ""), (4, None, None)]
    got = {r.id: (r.word_errors, r.char_errors) for r in errors.pair_errors(spark.createDataFrame(rows, "id int, ref string, hyp string")).collect()}
    assert got[1] == (6, 29) and got[2][0] == 2 and got[3] == got[4] == (0, 0)


def test_global_rank(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 5)) for i in range(500)]
    out = ranking.global_rank(spark.createDataFrame(rows, "i int, k int"), [F.col("k"), F.col("i")]).collect()
    want = {i: n + 1 for n, (k, i) in enumerate(sorted((k, i) for i, k in rows))}
    assert {r.i: r.rn for r in out} == want


def test_merge_of_a_long_run(spark):
    n = 1_000_000
    run = spark.range(n).select(F.lit("r").alias("rec_id"), F.col("id").cast("int").alias("turn"), F.lit(0).alias("pos"), F.lit("s").alias("speaker"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.0).alias("end"), F.lit("t").alias("text"), F.lit(False).alias("overlap"))
    out = segments.merge(run, 999.5)
    assert sorted((r.start, r.end) for r in out.select("start", "end").collect()) == [(float(a), float(min(a + 999, n))) for a in range(0, n, 999)]


def test_merge_with_nulls(spark):
    kind = "rec_id string, turn int, pos int, speaker string, start double, end double, text string, overlap boolean"
    rows = [("r", 0, 0, None, 0.0, 1.0, "a", None), ("r", 1, 0, None, 1.0, 2.0, None, None), ("r", 2, 0, None, 2.0, None, "c", None), ("r", 3, 0, None, None, 4.0, "d", None)]
    out = segments.merge(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.turn, r.end, r.text) for r in out if r.end) == [(0, 2.0, "a"), (3, 4.0, "d")] and len(out) == 3
    assert segments.merge(spark.createDataFrame([], kind)).count() == 0


def test_batch_order(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 7, 100 - i) for i in range(60)], "i int, bucket int, batch long, n int")
    out = batching.batch_order(rows, "n", False).orderBy("place").collect()
    assert [r.place for r in out] == list(range(1, 22)) and [r.longest for r in out] == sorted(r.longest for r in out)


def merged(rows, cap, across):
    """Plain merging: each segment joins the one of its speaker (and flag) that ends where it begins."""
    out = []
    for speaker in {r[3] for r in rows}:
        for flag in {r[6] for r in rows} if not across else [None]:
            last = None
            for r in sorted((r for r in rows if r[3] == speaker and (across or r[6] == flag)), key=lambda r: (r[4], r[1], r[2])):
                if last and last[1] == r[4] and r[5] - last[0] <= cap:
                    last = (last[0], r[5], f"{last[2]} {r[7]}", True if across else flag)
                    out[-1] = (speaker, *last)
                else:
                    last = (r[4], r[5], r[7], r[6])
                    out.append((speaker, *last))
    return sorted(out)


def test_merge_against_plain_search(spark):
    rnd = random.Random(2)
    rows, at = [], 0.0
    for i in range(200):
        at += rnd.choice([0, 0, 0, 1])
        end = at + rnd.choice([1, 2, 3])
        rows.append(("r", i, 0, rnd.choice("aab"), at, end, rnd.random() < 0.3, f"t{i}"))
        at = end
    df = spark.createDataFrame(rows, "rec_id string, turn int, pos int, speaker string, start double, end double, overlap boolean, text string")
    for across in (False, True):
        got = sorted((r.speaker, r.start, r.end, r.text, r.overlap) for r in segments.merge(df, 5.0, across).collect())
        assert got == merged(rows, 5.0, across)


def test_markup_errors(spark):
    body = '<Turn speaker="spk1" startTime="0" endTime="9"><Sync time="0"/>a<Odd/>b</Turn><Turn speaker="spk1 spk2" startTime="9" endTime="10"><Sync time="9"/>early<Who nb="1"/>d</Turn>'
    body += '<Turn speaker="spk1" startTime="10" endTime="11"><Sync time="10"/>fine</Turn>'
    tokens, _ = segments.trs_tokens(spark.createDataFrame([("r", HEAD + body + "</Trans>")], "rec_id string, value string"))
    assert {(r.turn, r.reason) for r in segments.markup_errors(tokens).collect()} == {(0, "unknown tag Odd"), (1, "text before Who")}
    assert rebuilt(spark, body) == [("AB1", 10.0, 11.0, "fine", False)]


def test_diarization_in_bins(spark):
    kind = "rec_id string, speaker string, start double, end double"
    ref = spark.createDataFrame([("r", "a", 0.0, 100.0), ("r", "b", 90.0, 130.0)], kind)
    hyp = spark.createDataFrame([("r", "x", 0.0, 95.0), ("r", "y", 95.0, 130.0)], kind)
    uem = spark.createDataFrame([("r", 0.0, 120.0)], "rec_id string, start double, end double")
    r = diarization.error_rate(diarization.diarization_errors(ref, hyp, uem=uem)).first()
    assert (r.total, r.miss, r.false_alarm, r.confusion) == (130.0, 10.0, 0.0, 0.0)
    lines = [x.value for x in diarization.report_lines(diarization.diarization_errors(ref, hyp, uem=uem)).orderBy("rank").collect()]
    assert lines == ["TOTAL DER 7.69%", "r DER 7.69%"]


def test_small_clusters_with_and_without_broadcast(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [("g", i, i % 4, [rnd.gauss(c, 0.1) for c in ([1, 0], [0, 1], [-1, 0], [0, -1])[i % 4]]) for i in range(200)] + [("g", 900 + i, 9, [1.0, 0.1]) for i in range(5)]
    df = spark.createDataFrame(rows, "rec_id string, vec_id int, cluster int, embedding array<double>")
    a = sorted(map(tuple, diarization.reassign_small_clusters(df).collect()))
    monkeypatch.setattr(diarization, "BROADCAST_NUMBERS", 0)
    assert sorted(map(tuple, diarization.reassign_small_clusters(df).collect())) == a
    assert all(r[-1] == 0 for r in a if r[1] >= 900)


def test_weighted_sample_is_the_smallest_keys(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "k int, s string")
    out = sampling.weighted_sample(rows, "k", "s", {"a": 0.2, "b": 0.6}, 1, 0).collect()
    assert len(out) == 120 and sum(r.s == "b" for r in out) > 70


def test_example_errors(spark):
    pairs = spark.createDataFrame([(1, "A B C", "A C"), (2, "A", "A"), (3, "X", "Y")], "id int, ref string, hyp string")
    out = errors.example_errors(pairs, spark.createDataFrame([(1,), (2,)], "id int"), "id").collect()
    assert {(r.id, round(r.wer, 3)) for r in out} == {(1, 33.333), (2, 0.0)} and distance("abc", "ac") == 1


def test_components_with_a_hub(spark, monkeypatch):
    from voxtable.operators import graphs

    monkeypatch.setattr(graphs, "HUB", 10)
    edges = [(0, i) for i in range(1, 60)] + [(i, 1000 + i) for i in range(1, 60)] + [(5000, 5001)]
    out = graphs.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in out} == {n: 5000 if n >= 5000 else 0 for e in edges for n in e}


def one_by_one(room, size, items):
    room, out = list(room), [0] * len(room)
    for _ in range(items):
        k = max(range(len(room)), key=lambda k: (room[k], -k))
        room[k] -= size
        out[k] += 1
    return out


def test_deal_is_the_greedy_choice():
    from voxtable.operators.splits import deal, plan_bins

    rnd = random.Random(8)
    for _ in range(500):
        room, size, items = [rnd.randint(-5, 40) for _ in range(3)], rnd.randint(1, 6), rnd.randint(1, 40)
        assert deal(room, size, items) == one_by_one(room, size, items)
    assert plan_bins([(9, 1), (1, 2)], [8, 1, 1])[0] == [(9, 0, 1, 0), (1, 0, 1, 1), (1, 1, 2, 2)]


def test_stratified_split(spark):
    from voxtable.operators import splits

    recs = spark.createDataFrame([(f"r{i}", "xy"[i % 2]) for i in range(100)], "rec_id string, category string")
    comps = spark.createDataFrame([(f"r{i}", f"c{i // 4 if i < 40 else i}") for i in range(100)], "rec_id string, component string")
    out = splits.stratified_split(recs, comps)
    assert out.count() == 100 and splits.leaks(out, "component").count() == 0
    per = {(r.category, r.split): r["count"] for r in out.groupBy("category", "split").count().collect()}
    assert len(per) == 6 and all(n >= 3 for n in per.values())


def test_filters_and_joins(spark):
    import pytest

    from voxtable.operators import corpus, joins, splits

    rows = spark.createDataFrame([("<NA>", 1.0), (" <NA> ", 0.005), ("\n", None), (None, 0.01), ("bon", 5.0)], "t string, d double")
    assert [r.t for r in rows.filter(corpus.has_text(F.col("t"))).collect()] == ["bon"]
    assert [r.t for r in rows.filter(corpus.has_text(F.col("t"), True)).collect()] == [" <NA> ", "\n", "bon"]
    assert [r.d for r in rows.filter(corpus.long_enough(F.col("d"))).collect()] == [1.0, 0.01, 5.0]
    names = joins.role_speakers(spark.createDataFrame([("r", "Dr", "Ann-Bob")], "rec_id string, doctor string, patients string"))
    assert {r.role: r.speaker for r in names.collect()} == {"medecin": "Dr", "patient_1": "Ann", "patient_2": "Bob", "patient": "Ann", "appelant": "Ann"}
    turns = spark.createDataFrame([("r", "patient_2", 0.0, 2.0), ("r", "inintelligible", 2.0, 3.0), ("r", "medecin", 3.0, 9.0)], "rec_id string, role string, start double, end double")
    known = corpus.known_roles(turns, "role")
    named = joins.named_turns(known, names).withColumn("turn_no", F.monotonically_increasing_id())
    assert sorted(r.speaker for r in named.collect()) == ["Bob", "Dr"]
    with pytest.raises(Exception, match="no speaker for role"):
        joins.named_turns(turns, names).collect()
    utts = spark.createDataFrame([("r", "u1", 0.5, 1.0), ("r", "u2", 4.0, 5.0), ("r", "u3", 5.0, 6.0)], "rec_id string, utt_id string, start double, end double")
    found = joins.first_overlap(utts, named)
    assert {r.speaker: r.ids for r in splits.ids_by_speaker(joins.must_overlap(found)).collect()} == {"Bob": ["u1"], "Dr": ["u2", "u3"]}
    with pytest.raises(Exception, match="no speaker overlaps"):
        joins.must_overlap(joins.first_overlap(utts.limit(1), named.filter("speaker = 'Dr'"))).collect()
    lists = spark.createDataFrame([("u1", "train"), ("u3", "dev")], "utt_id string, split string")
    assert [r.utt_id for r in splits.of_split(utts, lists, "utt_id", "dev").collect()] == ["u3"]
    assert {(r.utt_id, r.split) for r in splits.of_split(utts, lists, "utt_id").collect()} == {("u1", "train"), ("u3", "dev")}
    assert splits.attach_split(utts, spark.createDataFrame([("r", "dev")], "rec_id string, split string")).filter("split = 'dev'").count() == 3
    assert [r.rec_id for r in corpus.least_speakers(known.withColumnRenamed("role", "speaker"), 3).collect()] == ["r"]
    docs = spark.range(200).select(F.col("id").alias("k"))
    parts = {r["split"]: r["count"] for r in splits.document_split(docs, "k", 0.5).groupBy("split").count().collect()}
    assert parts == {"train": 90, "dev": 5, "test": 5}


def test_trial_store_resumes(spark, tmp_path):
    from voxtable.operators import trials

    ran = []
    tried = trials.grid({"a": trials.steps(0.1, 0.3, 0.1), "b": [1.0]}, {"a": 0.5, "b": 1.5})
    assert len(tried) == 4 and tried[0] == {"a": 0.5, "b": 1.5}
    run = lambda p: ran.append(p) or abs(p["a"] - 0.2)
    trials.resume(spark, str(tmp_path / "store"), "s", tried[:2], run)
    out = trials.resume(spark, str(tmp_path / "store"), "s", tried, run)
    assert len(ran) == 4 and out.count() == 4
    best = trials.best_trial(out).first()
    assert best.params == {"a": 0.2, "b": 1.0} and best.trial == 2


def test_wave_with_other_chunks(spark, tmp_path):
    import struct

    from voxtable.sources import readers

    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 64000, 4, 16)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + fmt + b"data" + struct.pack("<I", 400) + b"\0" * 400
    (tmp_path / "b.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    r = readers.wave_headers(spark, str(tmp_path / "b.wav")).first()
    assert (r.rate, r.frames, r.duration) == (16000, 100, 100 / 16000)
    (tmp_path / "c.wav").write_bytes(b"RIFF" + struct.pack("<I", 12) + b"WAVE" + b"LIST" + struct.pack("<I", 0))
    import pytest

    with pytest.raises(Exception, match="no format or data"):
        readers.wave_headers(spark, str(tmp_path / "c.wav")).collect()


def test_wave_kinds(spark, tmp_path):
    import struct

    from voxtable.sources import readers, writers

    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 16000, 64000, 4, 16)
    data = lambda n, m: b"data" + struct.pack("<I", n) + b"\0" * m
    late = fmt + b"".join(b"junk" + struct.pack("<I", 3) + b"abc\0" for _ in range(200)) + data(400, 400)
    wide = b"ds64" + struct.pack("<IQQQI", 28, 0, 800, 200, 0) + fmt + data(0xFFFFFFFF, 800) + b"LIST" + struct.pack("<I", 2) + b"xx"
    files = {
        "plain é.wav": b"RIFF\0\0\0\0WAVE" + fmt + data(4000, 4000), "a b/late.wav": b"RIFF\0\0\0\0WAVE" + late, "wide.wav": b"RF64\xff\xff\xff\xffWAVE" + wide,
        "open.wav": b"RIFF\0\0\0\0WAVE" + fmt + data(0xFFFFFFFF, 40), "text.wav": b"not a wave file", "none.wav": b"", "cut.wav": b"RIFF\0\0\0\0WAVE" + fmt[:20],
    }
    given = spark.createDataFrame(list(files.items()), "name string, value binary")
    for _ in range(2):
        assert writers.write_bytes(given, str(tmp_path / "w"), "name", "value") == len(files)
    out = {r.path.rsplit("/", 1)[1]: r for r in readers.wave_headers(spark, str(tmp_path / "w"), problems=True).collect()}
    got = {k: (r.format, r.frames) for k, r in out.items()}
    assert got == {
        "plain é.wav": ("RIFF", 1000), "late.wav": ("RIFF", 100), "wide.wav": ("RF64", 200), "open.wav": ("RIFF", 10),
        "text.wav": ("other", None), "cut.wav": ("no format or data", None),
    }
    assert out["plain é.wav"].bytes_read < 100 and (out["late.wav"].duration, out["late.wav"].channels) == (100 / 16000, 2)
    assert out["wide.wav"].bytes_read < 100 and out["late.wav"].bytes_read < 2000


def test_two_drivers_share_a_study(spark, tmp_path):
    import threading
    import time

    from voxtable.operators import trials

    ran, grid, path = [], trials.grid({"a": [1.0, 2.0, 3.0, 4.0]}), str(tmp_path / "my store")

    def run(params):
        ran.append(params["a"])
        time.sleep(0.3)
        return params["a"] ** 2

    drivers = [threading.Thread(target=trials.resume, args=(spark, path, "a study", grid, run)) for _ in range(2)]
    for d in drivers:
        d.start()
    for d in drivers:
        d.join()
    assert sorted(ran) == [1.0, 2.0, 3.0, 4.0]
    assert sorted((r.trial, r.value) for r in trials.read_store(spark, path).collect()) == [(i, (i + 1.0) ** 2) for i in range(4)]


def test_trials_of_lost_drivers_and_failures(spark, tmp_path):
    import pytest

    from voxtable.operators import trials

    path, grid = str(tmp_path / "store"), trials.grid({"a": [1.0, 2.0]})
    assert trials.claim(spark, path, "s", 0, 3600.0) and not trials.claim(spark, path, "s", 0, 3600.0)
    assert [r.trial for r in trials.resume(spark, path, "s", grid, lambda p: p["a"], lease=3600.0).collect()] == [1]
    assert sorted(r.trial for r in trials.resume(spark, path, "s", grid, lambda p: p["a"], lease=0.0).collect()) == [0, 1]
    with pytest.raises(ZeroDivisionError):
        trials.resume(spark, path, "t", grid, lambda p: 1 / 0)
    assert trials.resume(spark, path, "t", grid, lambda p: p["a"]).count() == 2


def test_boundaries_and_limits(spark):
    rows = spark.createDataFrame([(i, float(i % 100)) for i in range(1000)] + [(1000, None)], "k int, n double")
    assert batching.length_boundaries(rows, "n", 10) == [9.0, 19.0, 29.0, 39.0, 49.0, 59.0, 69.0, 79.0, 89.0, 99.0]
    assert batching.length_boundaries(rows.limit(0), "n") == []
    out = batching.bucket_batches(rows.filter("n is not null"), "k", "n", [50.0, 99.0], 1000.0, 1, 0, max_examples=4)
    assert {r["count"] for r in out.groupBy("bucket", "batch").count().collect()} <= {2, 4} and out.count() == 1000


def test_film_files(spark):
    from voxtable.operators import subtitles

    rows = [("x/fr/1934/7/a.xml",), ("x/fr/1935/7/a.xml",), ("x/fr/1935/7/b.xml",), ("x/fr/2001/9/c.xml",), ("odd",)]
    assert sorted(r.path for r in subtitles.film_files(spark.createDataFrame(rows, "path string")).collect()) == ["x/fr/1935/7/b.xml", "x/fr/2001/9/c.xml"]


def test_leave_one_out_in_blocks(spark):
    rows = spark.createDataFrame([(i, f"s{i % 7}" if i < 40 else None) for i in range(45)], "id long, who string")
    one = sorted(map(str, splits.leave_one_out(rows, "id", "who").collect()))
    assert len(one) == 45 * 8 and sorted(map(str, splits.leave_one_out(rows, "id", "who", most=3).collect())) == one
    assert splits.leave_one_out(rows.filter("id < 0"), "id", "who").count() == 0


def test_objective_lies_between_its_bound_and_the_plan():
    rnd = random.Random(6)
    reached = 0
    for _ in range(60):
        parts = [rnd.choice([1, 1, 2, 3, 9]) for _ in range(rnd.randint(1, 7))]
        total = sum(parts)
        targets = [math.ceil(total * r) for r in (0.8, 0.1, 0.1)]
        sums = ([sum(p for p, b in zip(parts, to) if b == k) for k in range(3)] for to in itertools.product(range(3), repeat=len(parts)))
        least = min(sum((t - u) ** 2 for t, u in zip(targets, used)) for used in sums)
        bound, greedy = splits.least_objective(targets, total, max(parts)), splits.plan_bins(sorted(Counter(parts).items()), targets)[1]
        assert bound <= least <= greedy
        reached += bound == greedy
    assert reached > 10


def test_ranges_of_ranks_are_even(spark):
    rows = spark.range(400_000).select(F.col("id").cast("string").alias("k"))
    out = splits.ranked(rows, "k", 1, buckets=64).agg(F.countDistinct("rn").alias("n"), F.max("rn").alias("most")).first()
    assert (out.n, out.most) == (400_000, 400_000)
    per = [r[0] for r in rows.groupBy(F.floor(F.conv(F.substring(hash_order(1, F.col("k")), 1, 3), 16, 10).cast("int") * 64 / 4096)).count().select("count").collect()]
    assert len(per) == 64 and max(per) < 2 * 400_000 / 64
