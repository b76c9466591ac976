"""Secret scans: fixed base patterns, and character Markov models of random strings and identifiers.

Everything runs as Spark SQL expressions. A pattern's matches come from regexp_extract_all, their
places from the lengths of the gaps that split leaves between them. The models are first-order
character chains trained from all texts: strings that the base rules label as secrets, and as ordinary
ones the runs of token characters of the same texts, with identifiers that are composed of the texts' words in
the usual shapes (camel and snake case, constants, paths, dates, numbered names). Every distinct word of all texts
takes part in two of them. The threshold is
calibrated on other identifiers, so that at most one in a thousand is flagged. A run of token characters whose log-likelihood ratio passes the
threshold becomes a span of kind ``random``, unless a base span overlaps it. In other runs the segments
whose ratio passes it do, each drawn out to the ends of its parts between + / _ = and -: words glued to
a secret neither hide it nor go with it. Only the ratio decides, so short strings count too.

Defined results: null text counts as empty; without training rows both chains are uniform, so no
span is added; very long texts are scanned whole; of base spans that start together the kind listed first
comes first; rows with a null id are scanned like others; repeated rows get a row each; an empty table gives no
rows; other columns, whatever their names, are kept (scan, redact) or ignored (digests).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.llm.names import fresh
from voxtable.plans.storage import forget, materialize

#: Base kinds in their listed order, with pattern, value group and least value length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
KINDS = [*BASE, "random"]
#: Equal results for runs that a longer least length can't cut differently, found in one pass.
_FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
RUN = "[A-Za-z0-9+/_=-]"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_BLOCK = 256
#: Nats by which the chain of random strings must lead: prior odds of about 1 to 22 000 against it.
THRESHOLD = 10.0
#: Shares of a transition's probability that don't follow the counted pairs: of ordinary and of random strings.
UNSEEN = (0.1, 0.9)


def running_starts(lengths: Column) -> Column:
    """Sum of the elements before each one; blocks keep the work near linear in the array's size."""

    def running(xs: Column) -> Column:
        first = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, first, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))["out"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    bases = running(F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.zip_with(blocks, bases, lambda xs, base: F.transform(running(xs), lambda s: s + base)))


def matches(text: Column, pattern: str, found: Column, values: Column | None = None) -> Column:
    """array<struct<start, end, value>> of all matches; ``found`` and ``values`` are columns that hold
    the pattern's whole matches and its value group. Places count code points, the end is exclusive."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    lengths = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))
    starts = F.zip_with(running_starts(lengths), gaps, lambda s, g: s + F.length(g))
    whole = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end")))
    spans = F.zip_with(whole, found if values is None else values, lambda w, v: F.struct(w["start"].alias("start"), w["end"].alias("end"), v.alias("value")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, assign, access, hex): each row of docs as a struct, so that no name can clash, its text, and
    for each base kind the array of its spans."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumns({f"{k}_found": F.regexp_extract_all("text", F.lit(_FAST.get(k, p)), F.lit(0)) for k, (p, _, _) in BASE.items()})
    out = out.withColumn("assign_values", F.when(F.size("assign_found") > 0, F.regexp_extract_all("text", F.lit(BASE["assign"][0]), F.lit(2))).otherwise(F.array().cast("array<string>")))
    for kind, (pattern, group, least) in BASE.items():
        spans = matches(F.col("text"), _FAST.get(kind, pattern), F.col(f"{kind}_found"), F.col("assign_values") if group else None)
        out = out.withColumn(kind, _long_enough(spans, least))
    return out.drop(*[f"{k}_found" for k in BASE], "assign_values")


def identifiers(docs: DataFrame, text_col: str = "text", parts: int = 4096) -> DataFrame:
    """(word, part): identifiers composed of the words of all texts; one in four has part 1 and is kept from training.

    Each distinct word meets the next one in the order of their hashes, which goes round in each of ``parts`` ranges;
    a word that is alone in its range meets itself. Each pair of words takes one of the shapes, by its hash."""
    words = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("a")).distinct()
    ranged = words.withColumn("_h", F.xxhash64("a")).withColumn("_range", F.pmod("_h", F.lit(parts)))
    inside = Window.partitionBy("_range").orderBy("_h", "a")
    pair = ranged.select("a", F.coalesce(F.lead("a").over(inside), F.first("a").over(inside)).alias("b"))
    h = F.abs(F.xxhash64("a", "b") % 1_000_003)
    a, b = F.lower("a"), F.lower("b")
    name = F.concat(F.initcap(a), F.initcap(b))
    day = F.date_add(F.lit("1990-01-01").cast("date"), (h % 18_000).cast("int"))
    shapes = [
        F.concat(a, F.initcap(b)), name, F.concat(a, F.initcap(b), name), F.concat_ws("_", a, b), F.concat_ws("_", F.upper("a"), F.upper("b")), F.concat_ws("/", a, b, a), F.concat_ws("-", a, b),
        F.concat(F.upper(F.substring("a", 1, 3)), name), F.concat_ws("_", F.upper("b"), F.upper("a"), (h % 64).cast("string")), F.concat(a, (h % 1000).cast("string")),
        F.date_format(day, "yyyy-MM-dd'T'12"), F.concat_ws("/", a, F.date_format(day, "yyyy/MM/dd"), b), F.concat_ws("-", F.concat(F.lit("x"), b), a, (h % 10).cast("string")), F.concat_ws("_", F.date_format(day, "yyyyMMdd"), b),
    ]
    shape = F.lit(None).cast("string")
    for k, value in enumerate(shapes):
        shape = F.when(h % len(shapes) == k, value).otherwise(shape)
    return pair.select(shape.alias("word"), F.when(F.xxhash64("b", "a") % 4 == 0, 1).otherwise(0).alias("part"))


def calibrate(docs: DataFrame, ratios: list[float], text_col: str = "text", rate: float = 0.001, known: DataFrame | None = None) -> float:
    """The least threshold that at most ``rate`` of the identifiers kept from training pass, and THRESHOLD at least.

    ``known`` is the result of identifiers, if it is stored. Where too many pass THRESHOLD, those are counted by whole
    nats, and those of the one nat that decides by the ratios' five decimals; only these counts come to the driver.
    """
    known = identifiers(docs, text_col) if known is None else known
    best = known.filter("part = 1").select(F.round(best_segment(F.col("word"), _table(ratios)), 5).alias("best"))
    over = F.col("best") > THRESHOLD
    rows, above = best.agg(F.count("*"), F.count(F.when(over, 1))).first()
    allowed = int(rate * rows)
    if above <= allowed:
        return THRESHOLD
    high = materialize(best.filter(over).groupBy("best").agg(F.count("*").alias("n")), "scores")

    def deciding(table: DataFrame, value: Column, left: int) -> tuple[float, int]:
        for r in sorted(table.groupBy(value.alias("v")).agg(F.sum("n").alias("n")).collect(), reverse=True):
            if r["n"] > left:
                return r["v"], left
            left -= r["n"]

    nat, left = deciding(high, F.floor("best"), allowed)
    value, _ = deciding(high.filter(F.floor("best") == nat), F.col("best"), left)
    return value + 5e-6  # between two sums of ratios, whatever their order of addition


def learn(docs: DataFrame, text_col: str = "text") -> tuple[list[float], float]:
    """The ratios that train gives and the threshold that calibrate gives, from identifiers that are composed once."""
    known = materialize(identifiers(docs, text_col), "identifiers")
    ratios = train(docs, text_col, known=known)
    threshold = calibrate(docs, ratios, text_col, known=known)
    forget(known)
    return ratios, threshold


def _words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, label) of each occurrence in one pass: 1 for the strings that the base rules find, 0 for the other
    texts' runs of token characters."""
    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = found.withColumns({k: F.regexp_extract_all("text", F.lit(_FAST.get(k, p)), F.lit(group)) for k, (p, group, _) in BASE.items()})
    secret = F.concat(*[F.filter(k, lambda w, least=least: F.length(w) >= least) for k, (*_, least) in BASE.items()])
    base = "|".join([BASE["assign"][0].replace("([A", "(?:[A"), _FAST["access"], _FAST["hex"]])
    none = F.size(F.concat(*BASE)) == 0
    found = found.select(secret.alias("secret"), F.when(none, F.col("text")).otherwise(F.regexp_replace("text", base, " ")).alias("plain"))
    found = found.select(F.size("secret").alias("secrets"), F.posexplode(F.concat("secret", F.regexp_extract_all("plain", F.lit(RUN + "{2,}"), F.lit(0)))).alias("at", "word"))
    found = found.select("word", (F.col("at") < F.col("secrets")).cast("int").alias("label"))
    return found.filter((F.col("label") == 0) | F.col("word").rlike("[A-Za-z]"))


def train(docs: DataFrame, text_col: str = "text", smoothing: float = 0.5, known: DataFrame | None = None) -> list[float]:
    """Log-likelihood ratios random : identifier for each pair of ALPHABET's characters, row by row.

    All documents are used. Only one count for each pair of characters and class comes to the driver. ``known`` is
    the result of identifiers, if it is stored.
    """
    known = identifiers(docs, text_col) if known is None else known
    words = _words(docs, text_col).unionByName(known.filter("part = 0").select("word", F.lit(0).alias("label"))).groupBy("word", "label").agg(F.count("*").alias("n"))
    words = words.select("word", "label", F.when(F.col("label") == 1, 1).otherwise(F.ceil(F.log2(F.col("n") + 1)).cast("int")).alias("n"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counts = words.filter(F.length("word") > 1).select("label", "n", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    size = len(ALPHABET)
    tables = [[0.0] * size * size for _ in (0, 1)]
    for r in counts:
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            tables[r["label"]][a * size + b] += r["n"]
    logs = [_chain(t, size, smoothing, u) for t, u in zip(tables, UNSEEN)]
    return [r - p for p, r in zip(*logs)]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _chain(pairs: list[float], size: int, smoothing: float, unseen: float) -> list[float]:
    """Log transition probabilities: a share ``unseen`` of each goes by kinds of characters (small and capital letters,
    digits, signs) and by the frequency of characters within their kind, so that pairs a class hasn't shown
    differ by how it mixes kinds."""
    kinds = [_kind(c) for c in ALPHABET]
    steps = [[smoothing] * 4 for _ in range(4)]
    single = [smoothing + sum(pairs[b::size]) for b in range(size)]
    for a in range(size):
        for b in range(size):
            steps[kinds[a]][kinds[b]] += pairs[a * size + b]
    of_kind = [sum(x for x, k in zip(single, kinds) if k == kind) for kind in range(4)]
    letters = [(x / of_kind[k] + 1 / kinds.count(k)) / 2 for x, k in zip(single, kinds)]
    out = []
    for a in range(size):
        row, step = pairs[a * size : (a + 1) * size], steps[kinds[a]]
        total, known = sum(row), sum(step)
        own = 1 - unseen if total else 0.0
        out += [math.log(own * n / max(total, 1) + (1 - own) * step[kinds[b]] / known * letters[b]) for b, n in enumerate(row)]
    return out


def let(value: Column, use) -> Column:
    """use(value), with the value taken once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _table(ratios: list[float]) -> Column:
    """The ratios by (place, place) in ALPHABET from 1 on; 0 beside characters that it lacks, at place 0."""
    size = len(ALPHABET)
    rows = [[0.0] * (size + 1), *([0.0, *ratios[a * size : (a + 1) * size]] for a in range(size))]
    return F.split(F.lit(",".join(f"{x:.5f}" for row in rows for x in row)), ",").cast("array<double>")


def _ratio(table: Column, a: Column, b: Column) -> Column:
    return F.get(table, a * (len(ALPHABET) + 1) + b)


def _places(word: Column) -> Column:
    return F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pair_ratios(word: Column, table: Column) -> Column:
    """The ratio of each of the word's pairs of characters."""
    return let(_places(word), lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: _ratio(table, a, b)))


def best_segment(word: Column, table: Column) -> Column:
    """The greatest sum of the ratios over any part of the word."""
    first = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))

    def step(a: Column, p: Column) -> Column:
        now = F.greatest(a["sum"] + _ratio(table, a["last"], p), F.lit(0.0))
        return F.struct(p.alias("last"), now.alias("sum"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(_places(word), first, step, lambda a: a["most"])


def llr(word: Column, table: Column) -> Column:
    """Sum of the ratios over the word's pairs of characters."""
    first = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(_places(word), first, lambda a, p: F.struct(p.alias("last"), (a["sum"] + _ratio(table, a["last"], p)).alias("sum")), lambda a: a["sum"])


def segments(pairs: Column, threshold: float) -> Column:
    """array<struct<start, end>> of characters: disjoint segments whose sum is over the threshold. A segment
    ends at its greatest sum, once the sum has fallen to nothing or by the threshold from there."""
    kind = "array<struct<start:int,end:int>>"
    zero, none = F.lit(0.0), F.lit(0)
    first = F.struct(none.alias("at"), none.alias("start"), none.alias("end"), zero.alias("sum"), zero.alias("most"), F.array().cast(kind).alias("out"))

    def out(a: Column) -> Column:
        return F.when(a["most"] > threshold, F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        now = a["sum"] + x
        over = (now <= 0) | (now <= a["most"] - threshold)
        best = now >= a["most"]
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(over, a["at"] + 1).otherwise(a["start"]).alias("start"),
            F.when(best, a["at"] + 2).otherwise(a["end"]).alias("end"),
            F.when(over, zero).otherwise(now).alias("sum"),
            F.when(over, zero).when(best, now).otherwise(a["most"]).alias("most"),
            F.when(over, out(a)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(pairs, first, step, out)


def random_parts(word: Column, table: Column, threshold: float) -> Column:
    """array<struct<start, end>> of characters: the whole word if its ratio passes the threshold, else its
    segments that do, drawn out to the ends of their parts; those that then overlap are one."""
    kind = "array<struct<start:int,end:int>>"
    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))

    def drawn_out(s: Column) -> Column:
        own = F.substring(word, s["start"] + 1, s["end"] - s["start"])
        lead, trail = F.length(F.regexp_extract(own, "^[^A-Za-z0-9]*", 0)), F.length(F.regexp_extract(F.reverse(own), "^[^A-Za-z0-9]*", 0))
        before = F.regexp_extract(F.reverse(F.substring(word, F.lit(1), s["start"])), "^[A-Za-z0-9]*", 0)
        after = F.regexp_extract(F.substring(word, s["end"] + 1, F.length(word)), "^[A-Za-z0-9]*", 0)
        start = F.when(lead > 0, s["start"] + lead).otherwise(s["start"] - F.length(before))
        end = F.when(trail > 0, s["end"] - trail).otherwise(s["end"] + F.length(after))
        return F.when(lead == F.length(own), span(s["start"], s["end"])).otherwise(span(start, end))

    def joined(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        return F.when(F.size(a) == 0, F.array(s)).when(s["start"] < last["end"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(span(last["start"], F.greatest(last["end"], s["end"]))))).otherwise(F.concat(a, F.array(s)))

    parts = F.aggregate(F.transform(segments(pair_ratios(word, table), threshold), drawn_out), F.array().cast(kind), joined)
    return F.when(llr(word, table) > threshold, F.array(span(F.lit(0), F.length(word)))).otherwise(parts)


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with one more, last column: a struct with an array of spans for each kind: assign, access, hex, random.

    threshold: nats by which the random-string model must lead, as calibrate gives it.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    out = base_spans(docs, text_col)
    name = fresh(docs.columns, "secrets")

    def unpacked(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.struct(*KINDS).alias(name))

    most = max(ratios)
    if most <= 0:
        return unpacked(out.withColumn("random", F.array().cast(kind)))
    # shorter runs can't pass the threshold even if each pair has the greatest ratio
    candidate = f"{RUN}{{{int(threshold / most) + 2},}}"
    table = _table(ratios)
    found = F.regexp_extract_all("text", F.lit(candidate), F.lit(0))
    # so do words of small letters behind a first one, by the greatest ratio that their pairs can have
    small = [k for k, c in enumerate(ALPHABET) if c.islower()]
    most_plain = max(ratios[a * len(ALPHABET) + b] for a, c in enumerate(ALPHABET) if c.isalpha() for b in small)
    plain = int(threshold / most_plain) + 2 if most_plain > 0 else 1 << 30
    able = lambda w: (F.length(w) >= plain) | ~w.rlike("^[A-Za-z][a-z]*$")
    out = out.withColumn("likely", F.filter(F.array_distinct(found), lambda w: able(w) & (best_segment(w, table) > threshold)))

    def placed(known: Column) -> Column:
        return F.filter(matches(F.col("text"), candidate, found), lambda s: F.array_contains(known, s["value"]))

    def parts(s: Column) -> Column:
        return F.transform(random_parts(s["value"], table, threshold), lambda p: F.struct((s["start"] + p["start"]).alias("start"), (s["start"] + p["end"]).alias("end"), F.substring(s["value"], p["start"] + 1, p["end"] - p["start"]).alias("value")))

    spans = F.flatten(F.transform(let(F.col("likely"), placed), parts))
    free = F.filter(spans, lambda s: ~F.exists(F.concat(*BASE), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return unpacked(out.withColumn("random", F.when(F.size("likely") > 0, free).otherwise(F.array().cast(kind))))


def _listed(found: Column, kinds: list[str]) -> Column:
    def keyed_spans(kind: str) -> Column:
        return F.transform(found.getField(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("i"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    keyed = F.concat(*map(keyed_spans, kinds))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, checksum of the base spans, and the list of all spans for each row of scan's result."""
    spans = F.col(found.columns[-1])
    return found.select(F.col(id_col).alias("doc_id"), *[F.size(spans.getField(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_listed(spans, [*BASE]), 256).alias("base_sha256"), _listed(spans, KINDS).alias("spans"))


def redact(found: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows that scan was given, with ``mask`` for every span; overlapping spans are replaced once. Text
    without spans is kept as it is."""
    kinds = [F.col(found.columns[-1]).getField(k) for k in KINDS]
    spans = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in kinds]))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        more = F.when(s["start"] >= a["at"], F.array(gap, F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], more).alias("out"))

    def finish(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))

    any_span = F.size(F.concat(*kinds)) > 0
    return found.withColumn(text_col, F.when(any_span, F.aggregate(spans, first, step, finish)).otherwise(text)).drop(found.columns[-1])
