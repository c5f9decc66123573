"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a condition over features of the text. ``estimate`` times every rule by itself on a bounded
sample and counts what it rejects; ``ordered`` puts the rules with the most rejections per second first;
``cascade`` applies them in that order and computes a rule's features only for rows that no earlier rule
has rejected. (``judged`` reports five counts of every row, so there only the other features are saved.) The order changes the work, never which rows are kept. Everything is built-in functions on
arrays within a row: no shuffle, no Python, and a long text costs n log n.

Null and empty texts have no words and fail ``too_few_words``. Rows that repeat are judged alike; other
columns pass through, and input columns named like the results are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import Scratch

WINDOW = 5
SAMPLE_ROWS = 2000
_SPACE = " \t\n\x0b\f\r"
_P = "__quality_"


def _c(name: str) -> Column:
    return F.col(_P + name)


def _words() -> Column:
    trimmed = F.btrim(F.coalesce(_c("text"), F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _windows() -> Column:
    h = _c("word_hashes")
    first = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))


def _sorted_places() -> Column:
    w = _c("windows")
    repeats = F.size(F.array_distinct(w)) < F.size(w)
    return F.when(repeats, F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))


def _repeated_places() -> Column:
    s = _c("sorted_places")
    equal = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))


def _repeat_words() -> Column:
    p = _c("repeated_places")
    steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long")


#: Features by name: what each needs first, and its expression.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "words": ((), _words),
    "n_words": (("words",), lambda: F.size(_c("words")).cast("long")),
    "word_chars": (("words",), lambda: F.length(F.array_join(_c("words"), "")).cast("long")),
    "n_symbols": ((), lambda: F.regexp_count(F.coalesce(_c("text"), F.lit("")), F.lit("[#*$%&|<>]")).cast("long")),
    "lines": ((), lambda: F.filter(F.split(F.coalesce(_c("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    "n_lines": (("lines",), lambda: F.size(_c("lines")).cast("long")),
    "n_dup_lines": (("lines",), lambda: (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long")),
    "n_letters": ((), lambda: F.length(F.regexp_replace(F.coalesce(_c("text"), F.lit("")), r"[^\p{L}]+", "")).cast("long")),
    "word_hashes": (("words",), lambda: F.transform(_c("words"), lambda x: F.xxhash64(x))),
    "windows": (("word_hashes",), _windows),
    "sorted_places": (("windows",), _sorted_places),
    "repeated_places": (("sorted_places",), _repeated_places),
    "n_repeat_words": (("repeated_places",), _repeat_words),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a row where ``fails`` holds; ``needs`` are the features that it reads."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[], Column]


BASE_RULES = [
    Rule("too_few_words", ("n_words",), lambda: _c("n_words") < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words")),
]
RULES = [
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda: 100 * _c("n_symbols") > 30 * _c("n_words")),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda: 100 * _c("n_dup_lines") > 30 * _c("n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 20 * _c("n_words"))),
    Rule("few_letters", ("word_chars", "n_letters"), lambda: 2 * _c("n_letters") < _c("word_chars")),
]


def with_features(df: DataFrame, names: tuple[str, ...], only: Column | None = None) -> DataFrame:
    """df with the features and what they need, each once; null where ``only`` doesn't hold."""
    for name in names:
        if _P + name not in df.columns:
            needs, make = FEATURES[name]
            df = with_features(df, needs, only)
            df = df.withColumn(_P + name, make() if only is None else F.when(only, make()))
    return df


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(_P + "text", F.col(f"`{text}`").cast("string"))


def estimate(df: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds and share rejected of each rule by itself, on about ``rows`` rows drawn at random. Each rule runs twice and
    the second time counts, so that compiling isn't charged to whichever rule comes first."""
    total = df.count()
    if not total:
        return {r.name: (0.0, 0.0) for r in rules}
    share = min(1.0, rows / total)
    chosen = df.select(F.col(f"`{text}`").cast("string").alias(_P + "text"))
    chosen = chosen.where((F.rand(17) if share < 1 else F.lit(0.0)) < share)
    scratch = Scratch(df.sparkSession, "quality")
    sample = scratch.save(chosen, "sample")
    found = {}
    for rule in rules:
        query = with_features(sample, rule.needs).agg(F.avg(F.coalesce(rule.fails(), F.lit(False)).cast("double")))
        query.first()
        began = time.perf_counter()
        rejected = query.first()[0]
        found[rule.name] = time.perf_counter() - began, rejected or 0.0
    scratch.drop("sample")
    return found


def ordered(rules: list[Rule], costs: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per second first."""
    return sorted(rules, key=lambda r: -costs[r.name][1] / max(costs[r.name][0], 1e-6))


def cascade(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """df with ``failed_rule``: the first rule, in the given order, that rejects the row, or null."""
    out = _with_text(df, text) if _P + "text" not in df.columns else df
    out = out.withColumn(_P + "failed", F.lit(None).cast("string"))
    for rule in rules:
        out = with_features(out, rule.needs, _c("failed").isNull())
        out = out.withColumn(_P + "failed", F.coalesce(_c("failed"), F.when(rule.fails(), rule.name)))
    kept = [F.col(f"`{c}`") for c in df.columns if not c.startswith(_P) and c != "failed_rule"]
    return out.select(*kept, _c("failed").alias("failed_rule"))


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(df: DataFrame, rules: list[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with the reported counts of every row, base_failed and kept; the rules run in estimated order."""
    order = ordered(rules, estimate(df, rules, text, sample_rows))
    full = with_features(_with_text(df, text), REPORTED)
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.fails()
    names = [*REPORTED, "base_failed", "kept"]
    full = full.select(*[F.col(f"`{c}`") for c in full.columns if c not in names], *[_c(n).alias(n) for n in REPORTED], base.alias("base_failed"))
    return cascade(full, order, text).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("failed_rule")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: per document the counts, the base verdict and the cascade's verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", *REPORTED, "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r
), f AS (
  SELECT w.doc_id,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM w LEFT JOIN cov ON w.r = cov.r
), v AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_letters < word_chars) AS kept
FROM v
"""
