"""Further queries over the given tables: filters, joins of splits, numbers, clusters, diarization, and corpus
files that are written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtable.functions import text as X
from voxtable.operators import batching, corpus, diarization, errors, joins, segments, splits, trials
from voxtable.plans.queries import SEGMENTS, SQL, TURNS, _der, _pairs, _turns, query, table
from voxtable.plans.storage import materialize, work_folder
from voxtable.sources import readers, writers


def folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.from_turns(table(spark, sf_dir, "conversations"))


SPOKEN = """(SELECT CAST(conv_id AS VARCHAR) AS rec_id, CAST(turn AS INTEGER) AS turn, role AS speaker, text, turn % 3 = 1 AS overlap,
  (sum(length(text)) OVER w - length(text)) / 10.0 + 5.0 * (turn // 8) AS "start", sum(length(text)) OVER w / 10.0 + 5.0 * (turn // 8) AS "end" FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn))"""


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of several speakers, each with times of their own; every third overlaps, and a gap follows each eighth turn."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end, gap = F.sum(F.length("text")).over(w), 5.0 * F.floor(F.col("turn") / 8)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("rec_id"), F.col("turn").cast("int").alias("turn"), F.lit(0).alias("pos"), F.col("role").alias("speaker"),
        ((end - F.length("text")) / 10.0 + gap).alias("start"), (end / 10.0 + gap).alias("end"), "text", (F.col("turn") % 3 == 1).alias("overlap"),
    )


def _merge_sql(flag: str, overlap: str, cap: float) -> str:
    """SQL for merging: flag is what keeps segments apart beside the speaker, overlap the flag of a merged one."""
    return f"""WITH RECURSIVE s AS (SELECT *, {flag} AS flag, row_number() OVER (PARTITION BY rec_id, speaker, {flag} ORDER BY turn) AS r FROM {SPOKEN}),
m AS (SELECT *, "start" AS b, r AS g FROM s WHERE r = 1 UNION ALL
 SELECT s.*, CASE WHEN m."end" = s."start" AND s."end" - m.b <= {cap} THEN m.b ELSE s."start" END, CASE WHEN m."end" = s."start" AND s."end" - m.b <= {cap} THEN m.g ELSE s.r END
 FROM m JOIN s ON s.rec_id = m.rec_id AND s.speaker = m.speaker AND s.flag = m.flag AND s.r = m.r + 1)
SELECT rec_id, speaker, min(turn) AS turn, min(b) AS "start", max("end") AS "end", string_agg(text, ' ' ORDER BY turn) AS text, {overlap} AS overlap FROM m GROUP BY rec_id, speaker, flag, g"""


@query(_merge_sql("overlap", "bool_or(overlap)", 150.0))
def q_merge_speakers(spark, sf_dir):
    """Segments of several speakers, joined within a speaker and an overlap flag."""
    return segments.merge(_spoken(spark, sf_dir), 150.0).drop("pos")


@query(_merge_sql("true", "CASE WHEN count(*) > 1 THEN true ELSE bool_or(overlap) END", 150.0))
def q_merge_across(spark, sf_dir):
    """The same across overlap flags: joined segments count as overlapping."""
    return segments.merge(_spoken(spark, sf_dir), 150.0, across_overlap=True).drop("pos")


@query("""SELECT conv_id, count(*) AS turns, sum(CAST(trim(text, ' ' || chr(10) || chr(9) || chr(13)) NOT IN ('<NA>', '') AS BIGINT)) AS with_text, sum(CAST(text <> '<NA>' AS BIGINT)) AS with_exact_text, sum(CAST(length(text) / 100.0 >= 1.5 AS BIGINT)) AS long_enough
FROM (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN '<NA>' WHEN turn % 5 = 0 THEN ' <NA> ' ELSE text END AS text FROM conversations) GROUP BY conv_id""")
def q_missing_texts(spark, sf_dir):
    """Turns that have a text, and that last long enough."""
    turn = F.when(F.col("turn") % 3 == 0, "<NA>").when(F.col("turn") % 5 == 0, " <NA> ").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", turn.alias("text"))
    total = lambda c: F.sum(c.cast("long")).cast("decimal(38,0)")
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), total(corpus.has_text(F.col("text"))).alias("with_text"), total(corpus.has_text(F.col("text"), True)).alias("with_exact_text"),
        total(corpus.long_enough(F.length("text") / 100, 1.5)).alias("long_enough"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A doctor and two patients for each conversation."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select(F.col("conv_id").cast("string").alias("rec_id"), F.concat(F.lit("D"), F.col("conv_id") % 7).alias("doctor"), F.concat(F.lit("P"), F.col("conv_id") % 11, F.lit("-P"), F.col("conv_id") % 13).alias("patients"))


ROLES = """(SELECT CAST(conv_id AS VARCHAR) AS rec_id, unnest(['medecin', 'patient_1', 'patient_2', 'patient', 'appelant']) AS role, unnest(['D' || conv_id % 7, 'P' || conv_id % 11, 'P' || conv_id % 13, 'P' || conv_id % 11, 'P' || conv_id % 11]) AS speaker FROM (SELECT DISTINCT conv_id FROM conversations))"""


@query(f"SELECT rec_id, role, speaker FROM {ROLES}")
def q_role_speakers(spark, sf_dir):
    """Speakers by role, with numbered patients and aliases, from a metadata file."""
    path = folder(spark, "metadata")
    metadata(spark, sf_dir).write.csv(path, header=True)
    return joins.role_speakers(readers.speaker_metadata(spark, path))


ROLE = "CASE role WHEN 'user' THEN 'medecin' WHEN 'assistant' THEN 'patient_2' ELSE 'inintelligible' END"


@query(f"""SELECT r.speaker, list('simsamu_' || c.conv_id || '_' || c.turn ORDER BY 'simsamu_' || c.conv_id || '_' || c.turn) AS ids FROM
(SELECT conv_id, turn, {ROLE} AS role FROM conversations) c JOIN {ROLES} r ON r.rec_id = CAST(c.conv_id AS VARCHAR) AND r.role = c.role GROUP BY r.speaker""")
def q_ids_by_speaker(spark, sf_dir):
    """Ids of utterances by speaker: turns of unknown roles go, roles get their speakers, utterances the first turn that overlaps."""
    s = conversation_segments(spark, sf_dir)
    role = F.when(F.col("speaker") == "user", "medecin").when(F.col("speaker") == "assistant", "patient_2").otherwise("inintelligible")
    turns = corpus.known_roles(s.select("rec_id", F.col("turn").alias("turn_no"), "start", "end", role.alias("role")), "role")
    named = joins.named_turns(turns, joins.role_speakers(metadata(spark, sf_dir)))
    inside = (F.col("start") + F.col("end")) / 2
    utterances = s.filter("speaker <> 'system'").select("rec_id", corpus.utterance_id("simsamu", "rec_id", "turn").alias("utt_id"), inside.alias("start"), inside.alias("end"))
    return splits.ids_by_speaker(joins.must_overlap(joins.first_overlap(utterances, named)))


DOC_SPLIT = """(SELECT doc_id, source, CASE WHEN rn <= floor(n * 0.9) THEN 'train' WHEN rn <= floor(n * 0.9) + floor(n * 0.05) THEN 'dev' ELSE 'test' END AS split FROM
(SELECT *, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM
(SELECT * FROM documents QUALIFY row_number() OVER (ORDER BY md5('0|subset|' || doc_id), doc_id) <= floor(count(*) OVER () * 0.5))))"""


@query(f"SELECT doc_id, split FROM {DOC_SPLIT}")
def q_document_split(spark, sf_dir):
    """A split of half of the documents."""
    return splits.document_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.5)


@query(f"SELECT e.split, count(*) AS n_rows, CAST(sum(length(d.text)) AS HUGEINT) AS chars FROM documents d JOIN {DOC_SPLIT} e USING (doc_id) WHERE e.split <> 'train' GROUP BY e.split")
def q_of_split(spark, sf_dir):
    """Documents that a split lists, with its name, and those of one split alone."""
    docs = table(spark, sf_dir, "documents")
    parts = materialize(splits.document_split(docs.select("doc_id"), "doc_id", 0.5), "split")
    dev = splits.of_split(docs, parts, "doc_id", "dev").withColumn("split", F.lit("dev"))
    test = splits.attach_split(docs, parts, "doc_id").filter("split = 'test'")
    return dev.select("split", "text").unionByName(test.select("split", "text")).groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).cast("decimal(38,0)").alias("chars"))


@query("SELECT user_id || '_' || strftime(ts, '%Y-%m-%d') AS rec_id, count(DISTINCT event_type) AS speakers FROM events WHERE event_id % 3 <> 0 GROUP BY ALL HAVING count(DISTINCT event_type) < 3")
def q_few_speakers(spark, sf_dir):
    """Recordings (a user's days) with fewer than three speakers, where listed events are excluded first."""
    e = table(spark, sf_dir, "events")
    kept = corpus.without(e, e.filter("event_id % 3 = 0").select("event_id"), "event_id")
    return corpus.least_speakers(kept.select(F.concat_ws("_", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("rec_id"), F.col("event_type").alias("speaker")), 3)


@query("SELECT doc_id, CAST(trunc(n_chars / 1000.0 * 16000) AS BIGINT) AS \"start\", CAST(trunc((n_chars + 37) / 1000.0 * 16000) AS BIGINT) AS stop, (trunc((n_chars + 37) / 1000.0 * 16000) - trunc(n_chars / 1000.0 * 16000)) / 16000 AS duration FROM documents")
def q_sample_offsets(spark, sf_dir):
    """Sample offsets and durations from milliseconds."""
    return table(spark, sf_dir, "documents").select("doc_id", *corpus.sample_offsets(F.col("n_chars"), F.col("n_chars") + 37, 16000))


@query("SELECT doc_id, 'cv_' || doc_id AS \"ID\", string_split('clip_' || source || '_' || doc_id, '_')[2] AS category, replace(replace('a b.é ' || doc_id, ' ', '_'), '.', '_') AS raw, 'a_b_e_' || doc_id AS rec_id FROM documents")
def q_names(spark, sf_dir):
    """Ids and categories from file names."""
    name = F.concat(F.lit("clip_"), "source", F.lit("_"), "doc_id")
    odd = F.concat(F.lit("a b.é "), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", corpus.utterance_id("cv", corpus.clip_id(F.concat(F.lit("x/"), name, F.lit(".mp3")))).alias("ID"), corpus.category_of(name).alias("category"), F.translate(odd, " .", "__").alias("raw"), X.recording_id(odd).alias("rec_id"))


@query("SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) || list_transform(range(200 - len(string_split(text, ' '))), lambda i: 0) AS tokens FROM conversations WHERE len(string_split(text, ' ')) BETWEEN 2 AND 200")
def q_padded(spark, sf_dir):
    """Sequences within token limits, padded, and the same after unpad and pad."""
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.transform(F.split("text", " ", -1), lambda w: F.length(w)))
    padded = batching.within_tokens(rows, "t", 2, 200).withColumn("p", batching.pad(F.col("t"), F.lit(200)))
    return padded.select("conv_id", "turn", batching.pad(batching.unpad(F.col("p"), F.size("t") / 200), F.lit(200)).alias("tokens"))


@query("""WITH b AS (SELECT bucket, batch, max(n_chars) AS longest FROM """ + SQL["q_bucket_batches"].split("FROM", 1)[1] + """ GROUP BY ALL)
SELECT bucket, batch, longest, row_number() OVER (ORDER BY longest, bucket, batch) AS place FROM b""")
def q_batch_order(spark, sf_dir):
    """Batches from short to long."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return batching.batch_order(batching.bucket_batches(docs, "doc_id", "n_chars", [500.0, 1000.0, 2000.0, 4000.0, 8000.0], 16000.0, 5, 0), "n_chars", False).select("bucket", "batch", "longest", "place")


# ---- numbers

_UNIT = "['zéro','un','deux','trois','quatre','cinq','six','sept','huit','neuf','dix','onze','douze','treize','quatorze','quinze','seize','dix-sept','dix-huit','dix-neuf']"
_TEN = "['','','vingt','trente','quarante','cinquante','soixante','soixante','quatre-vingt','quatre-vingt']"
#: Words of 0 to 999, with and without the plural marks of a number's end, by rule.
WORDS = f"""small AS (SELECT n, CASE WHEN n < 20 THEN {_UNIT}[n + 1] ELSE {_TEN}[n // 10 + 1] || CASE WHEN n = 80 THEN 's' WHEN n % 10 = 0 AND n NOT IN (70, 90) THEN ''
 WHEN n IN (21, 31, 41, 51, 61, 71) THEN ' et ' || {_UNIT}[n % 20 * CAST(n = 71 AS INT) + CAST(n <> 71 AS INT) + 1] ELSE '-' || {_UNIT}[n % 10 + 10 * CAST(n // 10 IN (7, 9) AS INT) + 1] END END AS w FROM range(100) r(n)),
full_words AS (SELECT h * 100 + n AS n, CASE WHEN h = 0 THEN w ELSE CASE WHEN h = 1 THEN 'cent' ELSE {_UNIT}[h + 1] || ' cent' || CASE WHEN n = 0 THEN 's' ELSE '' END END || CASE WHEN n = 0 THEN '' ELSE ' ' || w END END AS w FROM small, range(10) q(h)),
said AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 1000 THEN u.w ELSE CASE WHEN n_chars < 2000 THEN 'mille' ELSE CASE WHEN regexp_matches(t.w, '(cents|vingts)$') THEN left(t.w, -1) ELSE t.w END || ' mille' END || CASE WHEN n_chars % 1000 = 0 THEN '' ELSE ' ' || u.w END END AS cardinal
 FROM documents JOIN full_words u ON u.n = n_chars % 1000 JOIN full_words t ON t.n = n_chars // 1000)"""
SQL["q_number_words"] = f"""WITH {WORDS} SELECT doc_id, n_chars, cardinal, CASE WHEN cardinal = 'un' THEN 'premier' WHEN cardinal LIKE '%cinq' THEN cardinal || 'u' WHEN cardinal LIKE '%neuf' THEN left(cardinal, -1) || 'v'
 WHEN cardinal LIKE '%e' THEN left(cardinal, -1) WHEN cardinal LIKE '%cents' OR cardinal LIKE '%vingts' THEN left(cardinal, -1) ELSE cardinal END || CASE WHEN cardinal = 'un' THEN '' ELSE 'ième' END AS ordinal FROM said"""


# ---- clusters

SQL["q_small_clusters"] = """WITH n AS (SELECT label, count(*) AS members FROM embeddings GROUP BY label),
x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM x JOIN n USING (label) WHERE members >= 30 GROUP BY label, i),
d AS (SELECT x.vec_id, x.label, c.label AS target, round(1 - sum(CAST(x.x AS DOUBLE) * c.x) / sqrt(sum(CAST(x.x AS DOUBLE) * x.x) * sum(c.x * c.x)), 9) AS d FROM x JOIN n ON n.label = x.label AND n.members < 30 JOIN c USING (i) GROUP BY ALL)
SELECT e.vec_id, e.label AS cluster, coalesce(b.target, e.label) AS new_cluster FROM embeddings e LEFT JOIN (SELECT vec_id, arg_min(target, {'d': d, 't': target}) AS target FROM d GROUP BY vec_id) b USING (vec_id)"""


# ---- diarization

def der_sql(collar: float, skip: bool) -> str:
    zone = f"""AND NOT EXISTS (SELECT 1 FROM ref r WHERE r.rec_id = i.rec_id AND ((r."start" - {collar / 2} <= i.t AND r."start" + {collar / 2} >= i.u) OR (r."end" - {collar / 2} <= i.t AND r."end" + {collar / 2} >= i.u)))""" if collar else ""
    edges = f"""UNION SELECT rec_id, unnest(["start" - {collar / 2}, "start" + {collar / 2}, "end" - {collar / 2}, "end" + {collar / 2}]) FROM ref""" if collar else ""
    return f"""WITH RECURSIVE ref AS (SELECT rec_id, speaker, "start", "end" FROM {TURNS}), hyp AS (SELECT rec_id, 'h' || speaker AS speaker, "start" + 0.1 AS "start", "end" + 0.1 AS "end" FROM ref),
    p AS (SELECT rec_id, unnest(["start", "end"]) AS t FROM ref UNION SELECT rec_id, unnest(["start", "end"]) FROM hyp {edges}),
    i AS (SELECT rec_id, t, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS u FROM p),
    a AS (SELECT i.rec_id, i.t, i.u, coalesce(list_sort(list(DISTINCT s.speaker) FILTER (WHERE s.side = 'r')), []) AS refs, coalesce(list_sort(list(DISTINCT s.speaker) FILTER (WHERE s.side = 'h')), []) AS hyps
      FROM i JOIN (SELECT 'r' AS side, * FROM ref UNION ALL SELECT 'h', * FROM hyp) s ON s.rec_id = i.rec_id AND s."start" <= i.t AND s."end" >= i.u WHERE i.u IS NOT NULL {zone} GROUP BY i.rec_id, i.t, i.u),
    k AS (SELECT *, u - t AS d FROM a {"WHERE len(refs) < 2" if skip else ""}),
    m AS (SELECT rec_id, r, h, round(sum(d), 9) AS d FROM (SELECT rec_id, d, r, unnest(hyps) AS h FROM (SELECT rec_id, d, hyps, unnest(refs) AS r FROM k)) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY d DESC, r, h) AS n FROM m),
    g AS (SELECT rec_id, 0 AS n, CAST([] AS VARCHAR[]) AS rs, CAST([] AS VARCHAR[]) AS hs FROM (SELECT DISTINCT rec_id FROM o) UNION ALL
      SELECT g.rec_id, o.n, CASE WHEN list_contains(rs, r) OR list_contains(hs, h) THEN rs ELSE rs || [r] END, CASE WHEN list_contains(rs, r) OR list_contains(hs, h) THEN hs ELSE hs || [h] END FROM g JOIN o ON o.rec_id = g.rec_id AND o.n = g.n + 1),
    f AS (SELECT rec_id, arg_max(rs, n) AS rs, arg_max(hs, n) AS hs FROM g GROUP BY rec_id),
    z AS (SELECT d, len(refs) AS nr, len(hyps) AS nh, coalesce(len(list_filter(list_zip(rs, hs), lambda x: list_contains(refs, x[1]) AND list_contains(hyps, x[2]))), 0) AS ok FROM k LEFT JOIN f USING (rec_id)),
    s AS (SELECT sum(d * nr) AS total, sum(d * greatest(nr - nh, 0)) AS miss, sum(d * greatest(nh - nr, 0)) AS false_alarm, sum(d * (least(nr, nh) - ok)) AS confusion FROM z)
    SELECT round(total, 4) AS total, round(miss, 4) AS miss, round(false_alarm, 4) AS false_alarm, round(confusion, 4) AS confusion, round((miss + false_alarm + confusion) / total, 6) AS der FROM s"""


def _rounded(rates: DataFrame) -> DataFrame:
    return rates.select(*[F.round(c, 4).alias(c) for c in ("total", "miss", "false_alarm", "confusion")], F.round("der", 6).alias("der"))


@query(der_sql(0.0, False))
def q_der_strict(spark, sf_dir):
    """The diarization error rate over all time."""
    return _rounded(_der(spark, sf_dir, 0.0, False))


@query(der_sql(0.5, True))
def q_der_lax(spark, sf_dir):
    """The same with a collar and without overlapping speech."""
    return _rounded(_der(spark, sf_dir, 0.5, True))


# ---- files

@query(f"SELECT rec_id, speaker, round(\"start\", 6) AS \"start\", round(\"start\" + CAST(printf('%.6f', \"end\" - \"start\") AS DOUBLE), 6) AS \"end\" FROM {SEGMENTS}")
def q_rttm_files(spark, sf_dir):
    """Turns written as one file for each recording and read again in file order."""
    path = folder(spark, "rttm")
    s = conversation_segments(spark, sf_dir).select("rec_id", "turn", "pos", "start", "end", "speaker")
    writers.write_by_recording(s.withColumn("value", writers.rttm_line()).withColumn("rec", F.col("rec_id")), path, ["rec"], ["turn", "pos"])
    return readers.rttm_turns(readers.whole_files(spark, path), "path").select("rec_id", "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""SELECT rec_id, '1' AS channel, CASE WHEN CAST(rec_id AS INT) % 4 = 0 THEN 1.5 ELSE 0 END AS "start", CASE WHEN CAST(rec_id AS INT) % 4 = 0 THEN 99.25 ELSE max("end") END AS "end" FROM {SEGMENTS} GROUP BY rec_id""")
def q_uem_files(spark, sf_dir):
    """Extents, of which some are replaced, written and read again."""
    path = folder(spark, "uem")
    recs = conversation_segments(spark, sf_dir).groupBy("rec_id").agg(F.max("end").alias("duration"))
    given = recs.filter(F.col("rec_id").cast("int") % 4 == 0).select("rec_id", F.lit(1.5).alias("start"), F.lit(99.25).alias("end"))
    writers.write_lines(writers.uem_extents(recs, given).select("rec_id", writers.uem_line().alias("value")), path, order=["rec_id"])
    return readers.uem_extents(spark, path)


@query("SELECT 'eslo2_' || doc_id AS \"ID\", CAST(n_chars AS DOUBLE) / 10 AS duration, CAST(-1 AS BIGINT) AS \"start\", CAST(-1 AS BIGINT) AS stop, 'NA' AS wav_file, replace(text, chr(13), '') AS text, source FROM documents")
def q_manifest_files(spark, sf_dir):
    """Manifests by split, written once, left alone by a second run, and read again."""
    path = folder(spark, "manifest")
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))
    rows = corpus.manifest(docs, F.col("source"), F.col("text"), corpus.utterance_id("eslo2", "doc_id"), duration=F.col("n_chars") / 10, wav_file=F.lit("NA"))
    rows = rows.withColumn("split", F.when(F.xxhash64("ID") % 2 == 0, "train").otherwise("dev"))
    columns = ["ID", "duration", "start", "stop", "wav_file", "text", "source"]
    writers.write_manifest(rows, path, columns)
    writers.write_manifest(rows.limit(1), path, columns)
    return readers.manifest(spark, f"{path}/split=*").select(*columns)


@query("SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS value FROM documents")
def q_language_model_corpus(spark, sf_dir):
    """All lines of all documents, a line each, as a language model's corpus, written and read."""
    path = folder(spark, "lm")
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("text"))
    writers.write_lines(writers.language_model_lines(rows), path)
    return spark.read.text(path)


@query("SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn_no AS INTEGER) AS line, replace(text, chr(10), ' ') AS \"left\", CAST(turn AS VARCHAR) AS \"right\" FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM conversations)")
def q_parallel_lines(spark, sf_dir):
    """Texts and turn numbers as two parallel files for each conversation, zipped by position."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("a"), F.col("turn").cast("string").alias("b"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c]), "\n")
    files = rows.groupBy("file").agg(joined("a").alias("a"), joined("b").alias("b"))
    return joins.zip_lines(files.select("file", F.col("a").alias("value")), files.select("file", F.col("b").alias("value")))


@query("SELECT 'clip/' || doc_id || '_' || (i - 1) || '.mp3' AS path, sentence FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS sentence, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(sentence) > 0")
def q_clip_table(spark, sf_dir):
    """Clips and sentences (every line of every document) as a tab-separated file, written and read by position."""
    path = folder(spark, "clips")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("line", "sentence"))
    name = F.concat(F.lit("clip/"), "doc_id", F.lit("_"), "line", F.lit(".mp3"))
    rows = lines.select(F.lit("c").alias("client"), name.alias("path"), "sentence", F.lit("0").alias("votes")).filter("length(sentence) > 0")
    rows.write.csv(path, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.clip_table(spark, path)


@query("""WITH s AS (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS r FROM """ + DOC_SPLIT + """) SELECT split, CAST(doc_id AS VARCHAR) AS value FROM s WHERE r <= 5""")
def q_debug_lists(spark, sf_dir):
    """The first recordings of each split."""
    parts = splits.document_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.5)
    return writers.list_lines(parts, "doc_id", 5).select("split", F.col("value").cast("string").alias("value"))


@query("SELECT 'cut' AS study, '{\"cut\":' || CAST(cut AS DOUBLE) || '}' AS value FROM (" + SQL["q_best_trial"] + ")")
def q_trial_store(spark, sf_dir):
    """Trials of a cut-off over all labelled documents, kept in a store: a second run resumes and adds none."""
    scored = materialize(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality"), "scored")
    path, cuts = folder(spark, "trials"), trials.grid({"cut": trials.steps(250.0, 3000.0, 250.0)})
    values = {r["cut"]: r["value"] for r in trials.sweep(scored, "cut", [c["cut"] for c in cuts], "n_chars", "quality").collect()}
    trials.resume(spark, path, "cut", cuts[:5], lambda p: values[p["cut"]])
    return writers.best_parameters(trials.best_trial(trials.resume(spark, path, "cut", cuts, lambda p: values[p["cut"]])))


@query("SELECT doc_id, 'u' || i AS year_rank, path FROM (SELECT doc_id, row_number() OVER (PARTITION BY year, film ORDER BY path DESC) AS i, path FROM (SELECT doc_id, 1930 + doc_id % 20 AS year, source AS film, 'xml/fr/' || (1930 + doc_id % 20) || '/' || source || '/' || doc_id || '.xml' AS path FROM documents) WHERE year >= 1935) WHERE i = 1")
def q_film_files(spark, sf_dir):
    """The last file of each film from 1935 on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("xml/fr"), (F.col("doc_id") % 20 + 1930).cast("string"), "source", F.concat("doc_id", F.lit(".xml"))).alias("path"))
    from voxtable.operators.subtitles import film_files

    return film_files(docs).select("doc_id", F.lit("u1").alias("year_rank"), "path")
