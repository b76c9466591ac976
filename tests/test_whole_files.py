"""Files that hold all that was written: odd values of manifests, and named files of very many lines."""

from pathlib import Path

from voxtable.sources import writers


def test_a_manifest_keeps_every_value(spark, tmp_path):
    import __spark_entry__

    texts = [None, "", " ", " a", "a ", "\ta\n", '"', '""a', "a\0", '\0"b', ' "a, b" ', "a,b", "\\", '\\"', "NA", "\0", "#", "é ", "﻿"]
    rows = [(i, t, source, 3) for i, t in enumerate(texts) for source in ("web", "", None, " x,")] + [(None, "no id", "web", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["q_manifest_files"](spark, str(tmp_path)).collect()
    want = [(i if i is None else f"eslo2_{i}", n and n / 10, -1, -1, "NA", t, s) for i, t, s, n in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_named_file_of_several_batches(spark, tmp_path):
    rows = spark.range(25_000).selectExpr("'all' as key", "id as at", "concat('line ', id) as value")
    writers.write_named(rows, str(tmp_path), "key", ["at"], ".txt")
    assert Path(tmp_path, "all.txt").read_text() == "".join(f"line {i}\n" for i in range(25_000))
