"""Strict checks of the numbers of a rewrite against its source, beyond whether each number stands there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import parse_amounts
from .verify import occurrences

# Wordings of signs and inclusion, and how near to a number they count.
BARE = r"(?<![\w.])\d[\d,]*(?:\.\d+)?(?![\w])"
SENTENCE_GAP = r"(?<=[.!?])\s+|\n+"
CALLED_NEGATIVE = r"(?i)\bnegative\b"
NEGATIVE_NEAR = r"negative|loss(?:es)?|deficit|decline|decrease|outflow|shortfall"
NOT_INCLUDED = r"(?i)\b(?:not|nor|never)\s+(?:been\s+)?(?:included|includ\w+|part)\b|\bexclud\w+|\bexclusive of\b|\bdoes not include\b|\bdo not include\b|\bother than\b"
INCLUDED = r"(?i)\b(?:includ(?:ed|es|ing|e)|part of|within)\b"
HAS_UNIT = r"₹|\bRs\b|\bINR\b|\bUS\$|\$"
NEAR = 140
DROPS, FLAGS = ("unit_dropped", "sign_flip"), ("inclusion_polarity",)


def _digits(number: Column) -> Column:
    return F.regexp_replace(F.replace(number, F.lit(","), F.lit("")), r"\.$", "")


def _numbers(text: Column) -> Column:
    """Numbers of a text as (printed, digits, start, end)."""
    return F.transform(occurrences(text, BARE), lambda m: F.struct(m["text"].alias("printed"), _digits(m["text"]).alias("digits"), m["start"].alias("start"), m["end"].alias("end")))


def _sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: F.trim(s) != "")


def _is_figure(digits: Column) -> Column:
    """A decimal, or three digits and more that are no year."""
    return F.contains(digits, F.lit(".")) | ((F.length(digits) >= 3) & ~((F.length(digits) == 4) & digits.try_cast("int").between(1900, 2100)))


def _negative_in(source: Column, digits: Column) -> Column:
    """The source has the number in brackets, with a minus, or soon after a word for a loss; with its commas or without."""
    number = F.replace(digits, F.lit("."), F.lit(r"\."))
    money = r"\s*[₹`]?\s*(?:Rs\.?|INR)?\s*"
    shapes = F.concat(F.lit(rf"\({money}"), number, F.lit(rf"\s*\)|[-−–]{money}"), number, F.lit(rf"(?!\d)|(?is:(?=.{{0,{NEAR}}}(?<![\d.])"), number, F.lit(rf"(?!\d))(?:{NEGATIVE_NEAR}))"))
    return F.regexp_like(source, shapes) | F.regexp_like(F.replace(source, F.lit(","), F.lit("")), shapes)


def strict_findings(pairs: DataFrame, key: str, original: str, simple: str) -> DataFrame:
    """key, reason, detail of each finding in a rewrite: unit_dropped (a bare number that has a currency or a scale in the
    source), sign_flip (a figure that the rewrite calls negative and the source doesn't), inclusion_polarity (what the source leaves
    out is said to be included; a flag only). Null texts have no findings."""
    rows = pairs.where(F.col(original).isNotNull() & F.col(simple).isNotNull()).select(key, F.col(original).alias("o"), F.col(simple).alias("s"))
    rows = rows.withColumn("o_amounts", parse_amounts("o")).withColumn("s_amounts", parse_amounts("s"))
    told = F.transform(F.filter("o_amounts", lambda a: (a["kind"] == "money") & (a["scale"].isNotNull() | a["raw"].rlike(HAS_UNIT))), lambda a: F.struct(F.regexp_replace(_digits(F.regexp_replace(a["raw"], r"[^\d.,]", "")), r"^\.+|\.+$", "").alias("digits"), a["raw"].alias("raw")))
    rows = rows.withColumn("units", told).withColumn("numbers", _numbers(F.col("s")))
    bare = F.filter("numbers", lambda n: ~F.exists("s_amounts", lambda a: (a["start"] <= n["start"]) & (n["start"] < a["end"])) & (F.contains(n["digits"], F.lit(".")) | (F.length(n["digits"]) >= 3)))
    of_unit = lambda n: F.get(F.filter("units", lambda u: u["digits"] == n["digits"]), F.lit(0))["raw"]
    dropped = F.transform(F.filter(bare, lambda n: of_unit(n).isNotNull()), lambda n: F.concat(n["printed"], F.lit(" (source: "), of_unit(n), F.lit(")")))
    units = rows.select(key, F.lit("unit_dropped").alias("reason"), F.explode(dropped).alias("detail"))

    said = rows.select(key, "o", F.explode(_sentences(F.col("s"))).alias("sentence")).withColumn("numbers", _numbers(F.col("sentence")))
    negative = said.where(F.col("sentence").rlike(CALLED_NEGATIVE)).select(key, "o", "sentence", F.explode("numbers").alias("n"))
    flips = negative.where(_is_figure(F.col("n.digits")) & ~_negative_in(F.col("o"), F.col("n.digits")))
    flips = flips.select(key, F.lit("sign_flip").alias("reason"), F.concat(F.col("n.printed"), F.lit(" called negative: "), F.substring("sentence", 1, 90)).alias("detail"))

    left_out = F.transform(F.filter(_sentences(F.col("o")), lambda x: x.rlike(NOT_INCLUDED)), lambda x: F.transform(_numbers(x), lambda n: n["digits"]))
    within = said.where(F.col("sentence").rlike(INCLUDED) & ~F.col("sentence").rlike(NOT_INCLUDED)).withColumn("out", F.flatten(left_out))
    within = within.where(F.arrays_overlap("out", F.transform("numbers", lambda n: n["digits"])))
    flags = within.select(key, F.lit("inclusion_polarity").alias("reason"), F.substring("sentence", 1, 90).alias("detail"))
    return units.unionByName(flips).unionByName(flags)
