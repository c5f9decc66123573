"""Operators over pages and long documents: repeated lines, sections, passages, redaction, segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import line_key

TARGET_CHARS, HARD_MAX_CHARS, MIN_CHARS = 1500, 2100, 15
ADDRESS = r"(?is)\b(residing at|residential address(?: is)?:?|r/o)\s+(.{8,220}?)(?=[.;\n]|$)"


def boilerplate(lines: DataFrame, doc: str, page: str, line: str, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """Keys of lines that stand on more than `share` of a document's pages, of documents with enough pages."""
    keyed = lines.select(doc, page, line_key(line).alias("key")).where("key <> ''").distinct()
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    counts = keyed.groupBy(doc, "key").agg(F.count("*").alias("n"))
    return counts.join(pages, doc).where((F.col("pages") >= least_pages) & (F.col("n") > share * F.col("pages")))


def without_boilerplate(lines: DataFrame, doc: str, page: str, line: str) -> DataFrame:
    bad = boilerplate(lines, doc, page, line).select(doc, "key")
    return lines.withColumn("key", line_key(line)).join(bad, [doc, "key"], "left_anti").drop("key")


def passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Passages of about TARGET_CHARS that end with a sentence, never longer than HARD_MAX_CHARS and never
    shorter than MIN_CHARS, in order. A fold over sentences, so it streams rows through Python."""

    def cut(text: str) -> list[str]:
        out, now = [], ""
        for s in re.split(r"(?<=[.!?])\s+", text.strip()):
            while len(s) > HARD_MAX_CHARS:
                if now:
                    out.append(now)
                    now = ""
                out.append(s[:HARD_MAX_CHARS])
                s = s[HARD_MAX_CHARS:]
            if now and (len(now) >= TARGET_CHARS or len(now) + 1 + len(s) > HARD_MAX_CHARS):
                out.append(now)
                now = ""
            now = f"{now} {s}" if now else s
        return [p for p in [*out, now] if len(p) >= MIN_CHARS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, p) for k, t in zip(b[key], b[text], strict=True) if t for i, p in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=[key, "k", "passage"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, k int, passage string")


def redacted(text: Column) -> Column:
    """Home addresses after their cue, up to the sentence's end, replaced; the cue stays."""
    return F.regexp_replace(text, ADDRESS, "$1 [address removed]")


def numbered_risks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Risks of a text numbered "1. ", "2. " ...: an item is accepted when its number is the next expected,
    so numbers inside paragraphs don't start one; text before the first is dropped."""

    def split(text: str) -> list[tuple[int, str]]:
        out: list[tuple[int, str]] = []
        at = 0
        for m in re.finditer(r"(?m)^\s*(\d{1,3})\.\s+", text):
            if int(m[1]) == len(out) + 1:
                if out:
                    out[-1] = out[-1][0], text[at : m.start()].strip()
                out.append((int(m[1]), ""))
                at = m.end()
        if out:
            out[-1] = out[-1][0], text[at:].strip()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, r) for k, t in zip(b[key], b[text], strict=True) if t for n, r in split(t)]
            yield pd.DataFrame(rows, columns=[key, "number", "risk"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, number int, risk string")


def contents(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Entries of a table of contents: titles that end in dot leaders or spaces and a page number; a line
    without a number is the beginning of the next title."""
    number = F.regexp_extract(F.col(line), r"^(.*?)[\s.]{2,}(\d{1,4})\s*$", 2)
    title = F.regexp_extract(F.col(line), r"^(.*?)[\s.]{2,}(\d{1,4})\s*$", 1)
    w = Window.partitionBy(doc).orderBy(order)
    rows = lines.select(doc, order, F.col(line).alias("__l"), number.alias("__n"), title.alias("__t"))
    before = F.when((F.lag("__n").over(w) == "") & (F.length(F.trim(F.lag("__l").over(w))) > 0), F.trim(F.lag("__l").over(w)))
    rows = rows.withColumn("title", F.trim(F.concat_ws(" ", before, F.trim("__t"))))
    return rows.where("__n <> ''").select(doc, order, "title", F.col("__n").cast("int").alias("page"))


def listing(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows of a listing page: date, link and title of each table row that has all three."""
    row = pages.select(key, F.explode(F.slice(F.split(html, r"(?i)<tr\b"), 2, 1 << 20)).alias("r"))
    date = F.regexp_extract("r", r"([A-Z][a-z]{2} \d{2}, \d{4})", 1)
    link = F.regexp_extract("r", r"(?i)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract("r", r"(?is)<a[^>]*>(.*?)</a>", 1), "<[^>]+>", ""))
    rows = row.select(key, F.try_to_timestamp(date, F.lit("MMM dd, yyyy")).cast("date").alias("day"), link.alias("link"), title.alias("title"))
    return rows.where("day is not null and link <> '' and title <> ''")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Link targets of a page in order, each once."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]+href\s*=\s*[\"']([^\"']+)[\"']"), 1))
    return pages.select(key, F.posexplode(found).alias("i", "link"))
