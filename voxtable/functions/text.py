"""French transcript normalisation and word lists for error rates, as column expressions.

Regular expressions carry (?U), so that letters beyond ASCII count as word characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable.functions.binding import bind
from voxtable.functions.french import spell_cardinal, spell_ordinal

#: Titles (abbreviation, whether a dot may follow, full form).
TITLES = [("Mme", False, "Madame"), ("Mlle", False, "Mademoiselle"), ("Mr", True, "Monsieur"), ("Pr", True, "Professeur"), ("Dr", True, "Docteur")]
#: Units (abbreviation, singular, feminine).
UNITS = [("h", "heure", True), ("min", "minute", True), ("sec", "seconde", True), ("km", "kilomètre", False), ("kg", "kilo", False), ("°", "degré", False)]
#: Patterns around the units, in order.
BEFORE_UNITS = [
    (r"(?U)( M\. |^M\. | M\.$)", " Monsieur "),
    (r"(?U)(^| )M[\. ](?=[a-zA-Z]{3})", " Monsieur "),
    (r"\+", " plus "),
    (r"&", " et "),
    (r"%", " pourcent "),
    (r"(?iuU)(?<=\b)n ?°(?=[^a-zA-Z])", " numéro "),
    (r"(?iuU)(?<=\b)1 ?er(?=\b)", " premier "),
    (r"(?iuU)(?<=\b)1 ?[eè]re(?=\b)", " première "),
    (r"(?iuU)(?<=\b)2de(?=\b)", " seconde "),
    (r"(?iuU)(?<=\b)2d(?=\b)", " second "),
    (r"(?U)(?<=\d) (?=\d\d\d)", ""),
    (r"(?<=0)\.(?=000)", ""),
]
AFTER_UNITS = [(r"km [/ ]{0,3}h", "kilomètres heure")] + [(rf"(?iuU)\b{w}\b", " ") for w in ("euh", "heu", "hm", "hmm", "hmmm")] + [(r"(?iuU)\bbah\b", " ben ")]
#: Numbers, words with a slash, characters of other scripts.
ORDINAL, CARDINAL = r"(?U)(\d+) ?[eè](me)?\b", r"(?U)\d+([\.,]\d*)?"
PARTIAL = r"(?U)(/\w+)|(\w+/)"
NON_LATIN = "[^\\x{0000}-\\x{024F}\\x{1E00}-\\x{1EFF}]"
#: Characters that reject a text.
REJECTED = "ŌŠĆŁČÑŪØÃĀŃŽĂÅȘŞŘÝŚÐŻĘĐĪĄĚ_ĞŸĖŐĒÕÌÞṢoẢƯỄĻŮĨƏĽḤẠṬṆẦỘĎǍĊŨǸɄỊỒỜŰỬĶỀƠỆŤŢŎŇŅŹİĠǪẒ12ĜĦĹŬŲŴƗƲǃǓḌṄẬẮẴẾỐỔỚỢỤỦỨỲ⁄ĢȚ"
#: Equivalent forms for error rates.
WER_FORMS = [(r"(?U)\bAH\b", "HA"), (r"(?U)\bOH\b", "HO"), (r"(?U)\bEH\b", "HE"), (r"(?U)\bT ES\b", "TU ES"), (r"(?U)\bT AS\b", "TU AS"), (r"(?U)\bY A\b", "IL Y A"), ("Œ", "OE"), ("Æ", "AE")]


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def expand_titles(text: Column) -> Column:
    return replace_all(text, [(rf"(?U)\b{short}{'[.]?' if dot else ''}\b", f" {full} ") for short, dot, full in TITLES])


def expand_units(text: Column) -> Column:
    rules = []
    for short, full, feminine in UNITS:
        one = "une" if feminine else "un"
        rules += [(rf"(?iuU)(?<=\b)1 *{short}(?=(\d|\b))", f" {one} {full} "), (rf"(?iuU)(?<=\d) *{short}s?(?=(\d|\b))", f" {full}s ")]
    return replace_all(text, rules)


def map_matches(text: Column, pattern: str, group: int, change: Callable[[Column], Column]) -> Column:
    """Replace every match by the changed group between spaces: the gaps and the changed matches are joined again."""
    def mapped(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        changed = F.transform(found, lambda m: F.concat(F.lit(" "), change(m), F.lit(" ")))
        return _interleave(F.split(t, pattern, -1), changed)

    return bind(text, mapped)


def _interleave(gaps: Column, between: Column) -> Column:
    """The gaps with what stands between them; null if a change gave null."""
    joined = F.array_join(F.zip_with(gaps, between, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(~F.exists(between, lambda m: m.isNull()), joined)


def spell_numbers(text: Column) -> Column:
    """Ordinals, then other numbers, as words; null if a number is too large to have a name."""
    return map_matches(map_matches(text, ORDINAL, 1, spell_ordinal), CARDINAL, 0, spell_cardinal)


def clean_characters(text: Column) -> Column:
    """Other characters than letters, digits and _ become single spaces; trimmed, in capitals."""
    return F.upper(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")))


def reject_odd(text: Column) -> Column:
    """Null for empty texts and texts with characters that a French tokenizer shouldn't see."""
    # the long class is tried on what plain capitals and digits leave of a text, which is little
    return bind(text, lambda t: F.when((t != "") & ~F.regexp_replace(t, "[ A-Z03-9]+", "").rlike(f"{NON_LATIN}|[{REJECTED}]"), t))


#: What a text has at least if rules of a kind can change it; a cheap look spares most texts the rules.
_MAY_HAVE = {
    "titles": "M(?:me|lle|r)|[PD]r",
    "symbols": r"(?U)[\d+&%°]|M[. ]",
    "units": r"(?U)\d",
    "oral": r"(?iu)euh|heu|hm|bah|km ",
    "slashes": "/",
    "numbers": r"(?U)\d",
}


def _where(text: Column, kind: str, change: Callable[[Column], Column]) -> Column:
    return bind(text, lambda t: F.when(t.rlike(_MAY_HAVE[kind]), change(t)).otherwise(t))


def normalize_text(text: Column, drop_slashes: bool = False) -> Column:
    """The whole normaliser: titles, symbols, units, fillers, partial words, numbers, characters; null if nothing is left."""
    text = _where(text, "titles", expand_titles)
    text = _where(text, "symbols", lambda t: replace_all(t, BEFORE_UNITS))
    text = _where(text, "units", expand_units)
    text = _where(text, "oral", lambda t: replace_all(t, AFTER_UNITS))
    if drop_slashes:
        text = _where(text, "slashes", lambda t: F.regexp_replace(t, PARTIAL, ""))
    return reject_odd(clean_characters(_where(text, "numbers", spell_numbers)))


def wer_words(text: Column) -> Column:
    """Words for error rates; the empty text is one empty word."""
    return F.split(F.replace(replace_all(F.upper(text), WER_FORMS), F.lit("'"), F.lit(" ")), " ", -1)


def hypothesis_text(text: Column) -> Column:
    """Normalised text, or the raw text in capitals where normalisation rejects it."""
    return bind(text, lambda t: F.coalesce(normalize_text(t), F.upper(t)))


def enough_characters(text: Column, least: int = 2) -> Column:
    """Whether a text has ``least`` characters besides spaces; false for null."""
    return F.coalesce(F.length(F.replace(text, F.lit(" "), F.lit(""))) >= least, F.lit(False))


def has_words(text: Column) -> Column:
    return F.size(F.filter(wer_words(text), lambda w: w != "")) > 0


def srt_time(seconds: Column) -> Column:
    """h:m:s,ms without zero padding; milliseconds are cut off and days dropped."""
    ms = F.floor(F.round(seconds * 1_000_000) / 1000).cast("long")
    return F.format_string("%d:%d:%d,%d", F.pmod(F.floor(ms / 3_600_000), F.lit(24)), F.pmod(F.floor(ms / 60_000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def hash_order(seed: object, *ids: Column) -> Column:
    """A pseudo-random but reproducible sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_uniform(seed: object, *ids: Column) -> Column:
    """A reproducible uniform number in [0, 1) from 52 bits."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def recording_id(name: Column) -> Column:
    """Spaces and dots become underscores, é and è become e."""
    return F.translate(name, " .éè", "__ee")


def unescape(text: Column) -> Column:
    """Markup entities, and decimal and hexadecimal character references, as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))

    def referenced(t: Column) -> Column:
        pattern = "&#(x[0-9a-fA-F]+|[0-9]+);"
        code = lambda m: F.when(m.startswith("x"), F.conv(F.substring(m, 2, 8), 16, 10)).otherwise(m).cast("int")
        chars = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda m: F.decode(F.unhex(F.lpad(F.hex(code(m)), 8, "0")), "UTF-32"))
        return F.when(t.contains("&#"), F.array_join(F.zip_with(F.split(t, pattern, -1), chars, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")).otherwise(t)

    return F.replace(bind(text, referenced), F.lit("&amp;"), F.lit("&"))
