"""Small tables with every awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import random

SPACE = " \t\n\x0b\f\r"


def words(text):
    out, now = [], ""
    for ch in text or "":
        if ch in SPACE:
            if now:
                out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now] if now else out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared passages, repeats, nulls, empties, ties and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows = [(i, sentence(rng, rng.randint(30, 160), vocabulary)) for i in range(n)]
    base = rows[5][1].split()
    for k in range(12):  # near copies at all distances
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(near)))
    rows += [(200 + k, rows[7][1]) for k in range(9)]  # exact copies
    passage = sentence(rng, 55, vocabulary)
    for k in range(4):  # a passage in the middle of other text
        rows.append((300 + k, f"{sentence(rng, 20 + k, vocabulary)} {passage} {sentence(rng, 25, vocabulary)}"))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One two"), (404, "one TWO"), (405, "la " * 400), (406, "la " * 380), (407, "Über straße!\nline\nline\n\nline"), (408, sentence(rng, 6000, vocabulary))]
    rows += [rows[7], rows[5]]  # repeated rows
    return rows, passage, vocabulary


def frame(spark, rows, extra=True):
    """The rows as documents; with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as score", "1 as n_tokens", "2L as text_hash", "3L as node", "'k' as key") if extra else df
