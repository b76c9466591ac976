import pytest
from pyspark.sql import functions as F

from voxtable.functions import french, text

CASES = [
    ("Mme Dupont et le Dr. Martin", "MADAME DUPONT ET LE DOCTEUR MARTIN"),
    ("M. Durand, M Petit et M.", "MONSIEUR DURAND MONSIEUR PETIT ET MONSIEUR"),
    ("Mlle Pr Mr. MmeX", "MADEMOISELLE PROFESSEUR MONSIEUR MMEX"),
    ("n° 5 + 3 & 2", "NUMÉRO CINQ PLUS TROIS ET DEUX"),
    ("il a 1 h et 3 min", "IL A UNE HEURE ET TROIS MINUTES"),
    ("1 km, 2 km, 1kg 20 sec 38°5", "UN KILOMÈTRE DEUX KILOMÈTRES UN KILO VINGT SECONDES TRENTE HUIT DEGRÉS CINQ"),
    ("100 000 km/h", "CENT MILLE KILOMÈTRES"),
    ("des km / h", "DES KILOMÈTRES HEURE"),
    ("100.000 et 1.500", "CENT MILLE ET UN VIRGULE CINQ"),
    ("le 1er, la 1ère, la 2de et la 2ème", "LE PREMIER LA PREMIÈRE LA SECONDE ET LA DEUXIÈME"),
    ("le 21e et le 100 è", "LE VINGT ET UNIÈME ET LE CENTIÈME"),
    ("euh bah 3,5 %", "BEN TROIS VIRGULE CINQ POURCENT"),
    ("HMM hmmm Heu bon", "BON"),
    ("3,50 et 4,0 et 7.", "TROIS VIRGULE CINQ ET QUATRE ET SEPT"),
    ("007 ou ٣", "SEPT OU TROIS"),
    ("m² café", "M² CAFE"),
    ("rue/ /part mot", "MOT"),
    ("t'es", "T ES"),
    ("a_b", None),
    ("...", None),
    ("日本", None),
    ("", None),
    (None, None),
]


def test_normalize(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", text.normalize_text(F.col("t"), True).alias("n")).collect()
    assert {CASES[r.i][0]: r.n for r in rows} == dict(CASES)


def test_normalizer_plan_is_small(spark):
    plan = spark.createDataFrame([("",)], "t string").select(text.normalize_text(F.col("t"), True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 110  # the plan names each rule twice


def test_slashes_are_kept_by_default(spark):
    rows = spark.createDataFrame([("rue/ mot",), ("100 000 km/h",)], "t string").select(text.normalize_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["RUE MOT", "CENT MILLE KILOMÈTRES H"]


def test_hypothesis_text(spark):
    rows = spark.createDataFrame([("bon 2",), ("日a",)], "t string").select(text.hypothesis_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["BON DEUX", "日A"]


def test_numbers(spark):
    want = {0: "zéro", 21: "vingt et un", 71: "soixante et onze", 80: "quatre-vingts", 81: "quatre-vingt-un", 99: "quatre-vingt-dix-neuf", 200: "deux cents", 201: "deux cent un", 1000: "mille", 80000: "quatre-vingt mille", 200000: "deux cent mille", 2000001: "deux millions un", 10**9: "un milliard", 3 * 10**15 + 10**12 + 5: "trois billiards un billion cinq"}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", french.spell_integer(F.col("n"))).collect()
    assert dict(map(tuple, rows)) == want
    ordinals = {"1": "premier", "2": "deuxième", "3": "troisième", "4": "quatrième", "5": "cinquième", "9": "neuvième", "21": "vingt et unième", "80": "quatre-vingtième", "200": "deux centième", "2000000": "deux millionième"}
    rows = spark.createDataFrame([(n,) for n in ordinals], "n string").select("n", french.spell_ordinal(F.col("n"))).collect()
    assert dict(map(tuple, rows)) == ordinals


def test_numbers_of_any_length(spark):
    big = {"2" + "0" * 12: "deux billions", "1" + "0" * 13: "dix billions", "1" + "0" * 605: "cent centilliards", "1" + "0" * 606: None}
    rows = spark.createDataFrame([(n,) for n in big], "n string").select("n", french.spell_cardinal(F.col("n"))).collect()
    assert dict(map(tuple, rows)) == big


def test_wer_words(spark):
    assert spark.createDataFrame([("ah t'as œuf",)], "t string").select(text.wer_words(F.col("t"))).first()[0] == ["HA", "T", "AS", "OEUF"]


def test_srt_time(spark):
    assert spark.createDataFrame([(3661.0019,)], "s double").select(text.srt_time(F.col("s"))).first()[0] == "1:1:1,1"


@pytest.mark.parametrize("name,want", [("a b.c é", "a_b_c_e"), ("x", "x")])
def test_recording_id(spark, name, want):
    assert spark.createDataFrame([(name,)], "t string").select(text.recording_id(F.col("t"))).first()[0] == want


def test_has_words(spark):
    rows = spark.createDataFrame([("",), (" ",), ("A",)], "t string").select(text.has_words(F.col("t"))).collect()
    assert [r[0] for r in rows] == [False, False, True]
