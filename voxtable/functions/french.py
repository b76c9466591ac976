"""French number words as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable.functions.binding import bind

#: French number words.
UNITS = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
TENS = {2: "vingt", 3: "trente", 4: "quarante", 5: "cinquante", 6: "soixante", 8: "quatre-vingt"}


def below_hundred(n: int, last: bool) -> str:
    if n < 20:
        return UNITS[n]
    ten, one = divmod(n, 10)
    if ten in (7, 9):
        ten, one = ten - 1, one + 10
    if not one:
        return TENS[ten] + ("s" if ten == 8 and last else "")
    return TENS[ten] + (" et " if one in (1, 11) and ten != 8 else "-") + UNITS[one]


def below_thousand(n: int, last: bool = True) -> str:
    """Words for 0 to 999; ``last`` adds the plural marks that only the end of a number carries."""
    hundred, rest = divmod(n, 100)
    if not hundred:
        return below_hundred(rest, last)
    head = "cent" if hundred == 1 else f"{UNITS[hundred]} cent" + ("s" if not rest and last else "")
    return f"{head} {below_hundred(rest, last)}" if rest else head


def _list(words: list[str]) -> Column:
    return F.split(F.lit(";".join(words)), ";")


#: Beginnings of the names of large numbers (long scale), from 10^6 on; each has a form for 1000 times as much.
LARGE = "m b tr quadr quint sext sept oct non".split()
LARGE_UNITS = ["", *"un duo tre quattuor quin sex sept octo novem".split()]
LARGE_TENS = "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint".split()
LARGE_SUFFIXES = ("illion", "illiard")
#: Digits of the largest number that has a name.
MOST_DIGITS = 606


def large_names() -> list[str]:
    """Names of 1000^0 to 1000^201; the first two stand for nothing and for mille."""
    stems = LARGE + [u + t for t in LARGE_TENS for u in LARGE_UNITS] + ["cent"]
    return ["", "mille"] + [stem + suffix for stem in stems for suffix in LARGE_SUFFIXES]


#: Digits of other scripts and their values.
_DIGITS = [(chr(c), unicodedata.digit(chr(c))) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]


def ascii_digits(number: Column) -> Column:
    return F.translate(number, "".join(c for c, _ in _DIGITS), "".join(str(n) for _, n in _DIGITS))


def spell_digits(digits: Column) -> Column:
    """Words for a string of ASCII digits, in groups of three; null beyond MOST_DIGITS."""
    kind = F.struct(digits.alias("digits"), F.ceil(F.length(digits) / 3).cast("int").alias("n"), _list([below_thousand(n) for n in range(1000)]).alias("full"), _list([below_thousand(n, False) for n in range(1000)]).alias("bare"), _list(large_names()).alias("names"))

    def groups(x: Column) -> Column:
        padded = F.lpad(x["digits"], x["n"] * 3, F.lit("0"))
        return F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.struct(F.substring(padded, i * 3 + 1, F.lit(3)).cast("int").alias("value"), (x["n"] - 1 - i).alias("power")))

    def words(x: Column) -> Column:
        def one(g: Column) -> Column:
            value, name = g["value"], F.get(x["names"], g["power"])
            thousand = F.when(value == 1, name).otherwise(F.concat(F.get(x["bare"], value), F.lit(" "), name))
            large = F.concat(F.get(x["full"], value), F.lit(" "), name, F.when(value > 1, F.lit("s")).otherwise(F.lit("")))
            return F.when(g["power"] == 0, F.get(x["full"], value)).when(g["power"] == 1, thousand).otherwise(large)

        said = F.array_join(F.transform(F.filter(groups(x), lambda g: g["value"] > 0), one), " ")
        return F.when(x["n"] <= MOST_DIGITS // 3, F.when(said == "", F.get(x["full"], F.lit(0))).otherwise(said))

    return bind(kind, words)


def spell_integer(n: Column) -> Column:
    """Words for a number that isn't negative."""
    return spell_digits(n.cast("string"))


def spell_cardinal(number: Column) -> Column:
    """Words for digits with an optional decimal part after a comma or point: its digits, without zeros at
    the end, are said one by one. Null for numbers of more than MOST_DIGITS digits."""
    def words(x: Column) -> Column:
        whole, part = F.regexp_extract(x, r"^(\d+)", 1), F.regexp_replace(F.regexp_extract(x, r"[.,](\d+)$", 1), "0+$", "")
        said = F.array_join(F.transform(F.split(part, ""), lambda d: F.get(_list(UNITS), d.cast("int"))), " ")
        return F.when(part == "", spell_digits(whole)).otherwise(F.concat(spell_digits(whole), F.lit(" virgule "), said))

    return bind(ascii_digits(number), words)


def spell_ordinal(number: Column) -> Column:
    """Ordinal words for digits."""
    def ordinal(words: Column) -> Column:
        stem = F.when(words.endswith("trois"), words).otherwise(F.regexp_replace(words, "(?<=cent|vingt|illion|illiard)s$", ""))
        stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "cinq$", "cinqu"), "neuf$", "neuv"), "e$", "")
        return F.when(words == "un", F.lit("premier")).otherwise(F.concat(stem, F.lit("ième")))

    return bind(spell_digits(ascii_digits(number)), ordinal)
