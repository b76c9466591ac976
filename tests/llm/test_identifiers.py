"""Rates of flagged identifiers and found random strings."""

import os
import random
import string

import pytest

from voxtable.llm import secrets

DATA = "/root/testdata/sf0.01/documents.parquet"
IDENTIFIERS = """getUserNameFromDatabase ThreadPoolExecutorService XMLHttpRequest MAX_BUFFER_SIZE_BYTES org/apache/spark/sql/catalyst src/main/java/com/example
application/x-www-form-urlencoded kubernetes-cluster-autoscaler 2024-11-28T15 https://example.com/a/b/c donaudampfschifffahrtsgesellschaft connection_pool_timeout_seconds
AbstractSingletonProxyFactoryBean DEFAULT_RETRY_COUNT_LIMIT content-security-policy-report-only user_profile_image_url_v2 node_modules/react-dom/server
HTMLElementPrototype convertToUnsignedInteger test_reader_returns_all_rows 2023/07/14/archive/index README_FIRST_PLEASE on_message_received_callback internationalization""".split()
ALPHABETS = {"mixed": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "lower": string.ascii_lowercase + string.digits, "hex": "0123456789abcdef"}


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given table")
def test_identifiers_stay_and_random_strings_go(spark):
    docs = spark.read.parquet(DATA)
    ratios = secrets.train(docs)
    threshold = secrets.calibrate(docs, ratios)
    rnd = random.Random(5)
    planted = [(kind, n, "".join(rnd.choices(x, k=n))) for kind, x in ALPHABETS.items() for n in (16, 20, 24, 32) for _ in range(100)]
    rows = [(i, f"see {w} there") for i, w in enumerate(IDENTIFIERS)] + [(1000 + i, f"see {w} there") for i, (*_, w) in enumerate(planted)]
    out = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratios, threshold)).collect()}
    flagged = [w for i, w in enumerate(IDENTIFIERS) if out[i]]
    rates = {}
    for i, (kind, n, _) in enumerate(planted):
        rates.setdefault((kind, n), []).append(bool(out[1000 + i]))
    rates = {k: sum(v) / len(v) for k, v in rates.items()}
    print(threshold, flagged, rates)
    assert len(flagged) <= 1, (threshold, flagged)
    every = [bool(out[1000 + i]) for i in range(len(planted))]
    assert sum(every) / len(every) >= 0.95, rates


def test_toxicity_scores_are_those_of_all_counts(spark):
    import math
    import zlib
    from collections import Counter

    from pyspark.sql import functions as F

    from voxtable.llm import toxicity

    rnd = random.Random(7)
    rows = [(f"{' '.join(rnd.choices(['chat', 'chats', 'table', 'tabler', 'nuit'], k=30))} w{chr(97 + i % 26)}x once{'abcdefghij'[i % 10] * (i % 7 + 1)}" + (" zutebal zuteb" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, toxic int")
    model = toxicity.train(docs)
    parts = {r.text: r.part for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(3)).alias("part")).collect()}
    seen = set()
    for text, label in set(rows):
        if parts[text] < 2:
            words = toxicity.WORD.findall(text.lower())
            seen |= {(w, label, zlib.crc32(p.encode())) for p, w in zip(["", *words], words)}
    counts, total = Counter(), [0, 0]
    for w, label, _ in seen:
        total[label] += 1
        for node in ["=" + w, *(w[:k] for k in toxicity.PREFIXES if k < len(w))]:
            counts[node, label] += 1
    share = (total[1] + 1) / (sum(total) + 2)
    assert math.isclose(model.share, share)
    for w in {x for x, *_ in seen} | {"unknown", "zutebxx", "chatte"}:
        p = share
        for node in [*(w[:k] for k in toxicity.PREFIXES if k < len(w)), "=" + w]:
            toxic, other = counts[node, 1], counts[node, 0]
            p = (toxic + toxicity.PRIOR * p) / (toxic + other + toxicity.PRIOR)
        value = math.log(p / (1 - p)) - math.log(share / (1 - share))
        assert math.isclose(model.odds(w), min(max(value, toxicity.LOWEST), toxicity.HIGHEST) - toxicity.DRIFT, abs_tol=1e-9)
    out = [r.score for r in toxicity.score(docs.withColumn("doc_id", F.lit(1)), model).collect()]
    scorer = toxicity.Scorer(model)
    want = []
    for text, _ in rows:
        scores = [model.odds(w) for w in toxicity.WORD.findall(text.lower())]
        best, kept = 0.0, toxicity.segments(__import__("numpy").array(scores))
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
        chance = model.log_k + math.log(len(scores))
        want.append(scorer.probability(model.rate * best - chance if best > 0 else -chance, sum(model.rate * x - chance >= toxicity.SIGNIFICANT for *_, x in kept)))
    assert sorted(round(x, 9) for x in out) == sorted(round(x, 9) for x in want)


def test_counts_and_threshold_come_from_every_row(spark, monkeypatch):
    """One odd row among 2000 gives its identifiers, and calibration counts each identifier."""
    rows = [(i, f"some plain words about {'abcdefgh'[i % 8] * 3} here") for i in range(2000)] + [(2000, "Qzxvk Wqjxz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {w for _, t in rows for w in t.split()}
    known = secrets.identifiers(docs, parts=1).collect()
    assert len(known) == len(words)
    assert sum("qzxvk" in r.word.lower() or "qzx" in r.word.lower() for r in known) >= 1
    odd, plain = spark.createDataFrame(rows[-1:], docs.schema), docs.filter("doc_id < 2000")
    assert secrets.train(docs) != secrets.train(plain) and odd.count() == 1
    ratios = [1.0] * len(secrets.ALPHABET) ** 2  # a word's ratio is its length less one
    some = spark.createDataFrame([("a" * n, 1) for n in range(2, 41)], "word string, part int")
    monkeypatch.setattr(secrets, "THRESHOLD", 5.0)
    threshold = secrets.calibrate(docs, ratios, rate=0.1, known=some)
    assert sum(n - 1 > threshold for n in range(2, 41)) == 3 and 36 <= threshold < 37
    assert secrets.calibrate(docs, ratios, rate=1.0, known=some) == 5.0
