"""Brute-force comparisons of spelling variants, filter scores and token alignment."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtable.llm import alignment, bloom_lm, spelling
from voxtable.llm.queries import pieces, tokenizer

SHAPE = "doc_id long, text string, word string, n string, row string, pair string, segment string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SHAPE)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_variants(rows, every=199):
    import re

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in words:
        others = [x for x in words if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], near[w], words[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def spelled():
    rnd = random.Random(11)
    stems = ["".join(rnd.choices("abcé", k=rnd.randint(6, 9))) for _ in range(40)]
    rows = [(None, None), (1, ""), (2, "!!! 12"), (None, "Stràße " * 9)]
    for i in range(120):
        text = []
        for s in rnd.choices(stems, weights=[1 / (k + 1) for k in range(40)], k=120):
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(s))
                s = s[:at] + rnd.choice(["", "a", "b", "É", s[at] + "c"]) + s[at + 1 :]
            text.append(s.capitalize() if rnd.random() < 0.1 else s)
        rows.append((i % 50, rnd.choice([" ", ", ", "\n"]).join(text)))
    return rows + rows[-3:] + [(77, "abcabcabca" * 3000 + " " + "x" * 70_000)]


@pytest.mark.parametrize("tile", [1024, 8])
def test_variants_are_those_of_all_pairs(spark, spelled, tile):
    got = {tuple(r) for r in spelling.variants(frame(spark, spelled), tile=tile, every=23).collect()}
    want = brute_variants(spelled, 23)
    assert got == want
    assert sum(f is not None for _, f, *_ in want) > 10 and any(r != f for _, f, r, *_ in want if f)


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "")])).count() == 0


def test_tiles_meet_equal_words_never():
    words = ["aaaaaa", "aaaaab", "aaaaaab", "zzzzzz"]
    a, b = spelling.near_pairs(words, np.zeros(4, int), np.zeros(4, int), np.zeros(4, bool), np.full(4, 6), np.zeros(4, bool))
    assert {frozenset((words[i], words[j])) for i, j in zip(a, b)} == {frozenset(("aaaaaa", "aaaaab")), frozenset(("aaaaaa", "aaaaaab")), frozenset(("aaaaab", "aaaaaab"))}


def lm_rows():
    rnd = random.Random(12)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rnd.randint(1, 80)))) for i in range(150)]
    return rows + [(None, "w1 w2"), (900, None), (901, ""), (902, "\t\n"), (903, "w1 w1 " * 20_000), (3, "W0\x0bw1 w2")] + rows[:4]


def brute_scores(rows, order, strength=4.0):
    train = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    grams = [Counter() for _ in range(order + 1)]

    def walk(text):
        words = [*bytes((text or "").encode()).lower().split(), None]
        line = ["begin", *words]
        for i in range(1, len(line)):
            yield [tuple(line[i - k + 1 : i + 1]) if i - k + 1 >= 0 else None for k in range(1, order + 1)]

    for t in train:
        grams[0][("begin",)] += 1
        for g in walk(t):
            for k, x in enumerate(g, 1):
                if x:
                    grams[k][x] += 1
    least = bloom_lm.thresholds()
    means = []
    for k in range(order + 1):
        by = {}
        for c in grams[k].values():
            by.setdefault(int(np.searchsorted(least, c, "right")), []).append(c)
        means.append({q: sum(v) / len(v) for q, v in by.items()} | {0: 0.0})
    count = lambda k, x: means[k][int(np.searchsorted(least, grams[k][x], "right"))] if grams[k][x] else 0.0
    n, v = sum(grams[1].values()), len(grams[1])
    out = []
    for d, t in rows:
        base = score = 0.0
        known = tokens = 0
        for g in walk(t):
            tokens += 1
            c = grams[1][g[0]]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            p = (count(1, g[0]) + 1) / (n + v + 1)
            for k in range(2, order + 1):
                if g[k - 1]:
                    h = g[k - 1][:-1]
                    ch = count(0, h) if h == ("begin",) else count(k - 1, h)
                    p = (min(count(k, g[k - 1]), ch) + strength * p) / (ch + strength)
            score += math.log10(p)
        out.append((-1 if d is None else d, tokens, known, n, round(base, 6), score))
    return sorted(out)


@pytest.mark.parametrize("order,max_bytes", [(2, 256_000_000), (2, 0), (3, 256_000_000), (3, 0)])
def test_scores_are_those_of_exact_counts(spark, order, max_bytes):
    rows = lm_rows()
    got = bloom_lm.scores(frame(spark, rows), order, max_bytes=max_bytes).collect()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got)
    want = brute_scores(rows, order)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in got], [x[4] for x in want], rtol=1e-6)
    # a few probes of the filter are wrong by a level
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=0.05, atol=0.5)
    assert abs(sum(x[5] for x in got) / sum(x[5] for x in want) - 1) < 0.01


def test_scores_by_joins_are_those_of_the_broadcast(spark):
    docs = frame(spark, lm_rows())
    model = bloom_lm.build(docs.filter(bloom_lm.in_training()), 3)
    a, b = (sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in bloom_lm.score(docs, model, 3, max_bytes=m).collect()) for m in (256_000_000, 0))
    assert a == b


def test_probes_find_every_level():
    rnd = np.random.default_rng(1)
    h, level = rnd.integers(1, 1 << 63, 5000).astype(np.uint64), rnd.integers(1, 9, 5000)
    bits = bloom_lm._entered(h, level)
    found = bloom_lm.levels(bits, np.zeros(1, np.int64), np.array([8 * len(bits)], np.uint64), h, 1)
    assert (found >= level).all() and (found > level).mean() < 0.01
    other = rnd.integers(1, 1 << 63, 5000).astype(np.uint64)
    assert (bloom_lm.levels(bits, np.zeros(1, np.int64), np.array([8 * len(bits)], np.uint64), other, 1) > 0).mean() < 0.01


def test_scores_without_training_or_rows(spark):
    assert bloom_lm.scores(frame(spark, [])).count() == 0
    out = bloom_lm.scores(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in out) == [(1, 0, 0, 0.0, 0.0, False), (3, 0, 0, 0.0, 0.0, False)]


def aligned_rows():
    rnd = random.Random(13)
    words = ["the", "été", "don't", "<|endoftext|>", "<s>", "<0x41>", "naïve", "12345", "日本語", "a\nb", "x" * 100, "🙂🙂", "​", "tab\tin", "é", "\x00"]
    rows = [(i, rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "  ", " \n "]).join(rnd.choices(words, k=rnd.randint(1, 30))) + rnd.choice(["", " ", " "])) for i in range(80)]
    return rows + rows[:5] + [(None, None), (None, "the the"), (901, ""), (902, " "), (903, "has ▁ in it"), (904, "word " * 30_000)]


def brute_links(rows):
    a_of, b_of = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json")), alignment.Pair(*tokenizer(), pieces())
    a_of.encode_special_tokens = True
    each, holds = [], Counter()
    for d, text in rows:
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.second.encode(text) if text else []
        parts = [b"".join(t[i] for i in x) for t, x in zip(b_of.bytes, (a, b))]
        if not text or parts[0] != b" " + text.encode() or parts[1] != parts[0]:
            each.append((d, [], [], [], []))
            continue
        spans = []
        for ids, lengths in ((a, b_of.lengths[0]), (b, b_of.lengths[1])):
            at, out = 0, []
            for i in ids:
                out.append((at, at + int(lengths[i])))
                at += int(lengths[i])
            spans.append(out)
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            ends = spans[0][i][1], spans[1][j][1]
            i, j = i + (ends[0] <= ends[1]), j + (ends[1] <= ends[0])
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text_groups, i, j = [], 0, 0
        for e in ends:
            x, y = i, j
            while i < len(a) and spans[0][i][1] <= e:
                i += 1
            while j < len(b) and spans[1][j][1] <= e:
                j += 1
            text_groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        each.append((d, a, b, text_groups, links))
        holds.update(set(links))
    most = Counter()
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    return sorted((str(d), len(a), len(b), len(g), len(links), sum(holds[x] == most[x[0]] for x in links), sum(holds[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, links in each)


@pytest.mark.parametrize("max_pairs", [4_000_000, 0])
def test_alignment_is_that_of_byte_ranges(spark, max_pairs):
    rows = aligned_rows()
    out = alignment.link_digests(frame(spark, rows), *tokenizer(), pieces(), max_pairs=max_pairs).collect()
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out)
    assert got == brute_links(rows)
    assert any(n and g < n for _, n, _, g, *_ in got)


def test_alignment_of_nothing(spark):
    assert alignment.link_digests(frame(spark, []), *tokenizer(), pieces()).count() == 0
    out = alignment.link_digests(frame(spark, [(1, None)]), *tokenizer(), pieces()).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_groups_by_doubling():
    rnd = random.Random(5)
    for _ in range(100):
        total = rnd.randint(1, 60)
        a, b = (np.array(sorted({*rnd.sample(range(1, total + 1), rnd.randint(1, total)), total})) for _ in (0, 1))
        both = sorted(set(a) & set(b))
        assert alignment.groups(a, b).tolist() == [int(np.searchsorted(both, e)) for e in [*a, *b]]
