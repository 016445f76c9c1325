"""Text expressions: trimming, tokens, numerals, evidence of numbers, garbage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import constants as K


def strip(text: Column) -> Column:
    """Without white space of any script at both ends; the SQL trim takes spaces only."""
    # the pattern looks at every character, so it is left to texts that have white space at an end
    return F.when(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def strip_dashes(text: Column) -> Column:
    return strip(F.regexp_replace(strip(text), "^-+", ""))


def tokens(text: Column) -> Column:
    """Split at single spaces; empty tokens stay."""
    return F.split(text, " ", -1)


def words(text: Column) -> Column:
    """Split at white space; empty tokens go."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")


def has_number(text: Column) -> Column:
    """Whether a digit of any script or a numeral syllable occurs."""
    syllables = "".join([*K.DIGITS, *K.UNITS, *K.BIG_UNIT])
    return text.rlike(rf"[\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨{syllables}]")


def is_garbage(text: Column, speech_ms: Column) -> Column:
    """Too little speech or text, no word characters, a foreign script, or a phrase that recognisers make up."""
    cleaned = strip_dashes(text)
    phrase = F.lit(False)
    for p in K.GARBAGE_PHRASES:
        phrase = phrase | cleaned.contains(p)
    return (speech_ms < K.MIN_SPEECH_MS) | (F.length(cleaned) <= 1) | cleaned.rlike(r"(?U)^[\W_]+$") | cleaned.rlike(K.FOREIGN_SCRIPT) | phrase


def numeral_value(run: Column) -> Column:
    """Value of a numeral in syllables; null where two digits meet, or for any other character."""
    table = F.create_map(*[F.lit(x) for pair in {**K.DIGITS, **K.UNITS, **K.BIG_UNIT}.items() for x in pair])
    state = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(None).cast("long").alias("digit"), F.lit(True).alias("ok"))

    def step(acc, ch):
        v = table[ch].cast("long")
        digit, unit, big = v < 10, v.isin(10, 100, 1000), v == 10000
        none = F.lit(None).cast("long")
        held = acc["section"] + F.coalesce(acc["digit"], F.lit(0))
        return F.struct(
            F.when(big, acc["total"] + F.when(held == 0, 1).otherwise(held) * 10000).otherwise(acc["total"]).cast("long").alias("total"),
            F.when(unit, acc["section"] + F.coalesce(acc["digit"], F.lit(1)) * v).when(big, 0).otherwise(acc["section"]).cast("long").alias("section"),
            F.when(digit, v).otherwise(none).alias("digit"),
            (acc["ok"] & v.isNotNull() & ~F.coalesce(digit & acc["digit"].isNotNull(), F.lit(False))).alias("ok"),
        )

    chars = F.filter(F.split(run, ""), lambda c: c != "")
    done = lambda acc: F.when(acc["ok"], acc["total"] + acc["section"] + F.coalesce(acc["digit"], F.lit(0)))
    return F.aggregate(chars, state, step, done)


def normalize_numerals(text: Column) -> Column:
    """Numerals before a unit word become digits; everything else stays as it is."""
    toks = tokens(text)
    syllables = "".join([*K.DIGITS, *K.UNITS, *K.BIG_UNIT])
    units = "|".join(K.UNIT_WORDS)

    def one(t, i):
        following = F.lower(F.get(toks, i + 1))
        numeral = t.rlike(f"^[{syllables}]+$") & following.rlike(f"^(?:{units})")
        return F.when(numeral, F.coalesce(numeral_value(t).cast("string"), t)).otherwise(t)

    return F.array_join(F.transform(toks, one), " ")


def similarity(name: Column, span: Column) -> Column:
    """1 - edit distance by the name's length, 0 at least; spaces don't count."""
    a, b = F.replace(name, F.lit(" "), F.lit("")), F.replace(span, F.lit(" "), F.lit(""))
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.length(a))
