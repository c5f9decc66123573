"""Banks of risk rows, their labels and what reviewers make of them: look-ups, selections and summaries.

Everything is an equality join, a window within one key or an aggregate with map-side combine; sides are broadcast by
Spark's own size estimates only. Null keys match nothing unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import compact

# Bounds of plausible metrics, headings that are no risk titles, words that risks are told in.
BOUNDS = {"issue_size_inr": (1e8, 1e12), "ofs_share": (0.0, 1.0), "insider_price_gap": (0.1, 1000.0), "pe": (0.0, 500.0)}
HEADING = (
    r"(?i)^(currency of (financial )?presentation|presentation of financial|financial (year|data)|"
    r"fiscal (year|\d)|(industry|market) (and market )?data|forward[- ]looking|certain conventions|"
    r"definitions|use of market|summary of|table of contents|general information|"
    r"notice to (prospective )?investors)"
)
RISK_WORDS = (
    r"(?i)\b(may|might|could|can|will|would|are|is|was|were|have|has|had|not|any|our|we|us|no|"
    r"depend\w*|subject|risk|adverse\w*|affect\w*|fail\w*|unable|inability)\b"
)
RED_FLAG = r"(?i)\bred[- ]?flags?\b|रेड\s*फ्?लैग"
SPAN_TOKEN = r"\d+(?:,\d+)*(?:\.\d+)?|\w+|[^\w\s]"
MIN_GOLD_CHARS, MOST_WORDS, SEVERE_BAND = 4, 6, 4


def labelled(labels: DataFrame, rows: DataFrame, key: str, category: str, known: list[str]) -> DataFrame:
    """Labels with their rows, of known categories; labels of unknown rows and of other categories go."""
    return labels.where(F.col(category).isin(known)).join(rows, key)


def merged_bank(bank: DataFrame, scored: DataFrame, taught: DataFrame, told: DataFrame, excluded: DataFrame, key: str, document: str, fields: list[str]) -> DataFrame:
    """Bank rows with scores and the fields of the teacher, else of the model; rows of excluded documents go. Each
    of the looked-up tables has one row a key."""
    out = bank.join(excluded.select(document).distinct(), document, "left_anti").join(scored, key, "left")
    for source, mark in ((taught, "taught"), (told, "told")):
        out = out.join(source.select(key, *[F.col(f).alias(f"{mark}_{f}") for f in fields], F.lit(True).alias(mark)), key, "left")
    label = F.when(F.col("taught"), "teacher").when(F.col("told"), "model")
    chosen = [F.coalesce(F.col(f"taught_{f}"), F.col(f"told_{f}")).alias(f) for f in fields]
    return out.select(*bank.columns, *[c for c in scored.columns if c != key], *chosen, label.alias("label_source"))


def subset(bank: DataFrame, wanted: DataFrame, document: str) -> DataFrame:
    """The bank rows of the wanted documents."""
    return bank.join(wanted.select(document), document, "left_semi")


def scores_in_window(scores: DataFrame, window: DataFrame, key: str, by: str) -> DataFrame:
    """Per asked key (`by`) the scores of the rows in its window; rows without a score go."""
    return window.select(by, key).distinct().join(scores.where(F.col("score").isNotNull()), key)


def concatenated(*banks: DataFrame) -> DataFrame:
    """All rows of all banks, columns by name."""
    out = banks[0]
    for more in banks[1:]:
        out = out.unionByName(more)
    return out


def changed(recorded: DataFrame, found: DataFrame, name: str, digest: str) -> DataFrame:
    """Names whose digests differ between a record and what is found: changed, missing or unlisted."""
    both = recorded.select(name, F.col(digest).alias("a")).join(found.select(name, F.col(digest).alias("b")), name, "full")
    state = F.when(F.col("a").isNull(), "unlisted").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return both.select(name, state.alias("state")).where("state is not null")


def already_there(uploads: DataFrame, stored: DataFrame, digest: str, document: str) -> DataFrame:
    """Uploads with the least stored document of the same content, or null."""
    first = stored.groupBy(digest).agg(F.min(document).alias("existing"))
    return uploads.join(first, digest, "left")


def counts_by_year(bank: DataFrame, year: Column) -> DataFrame:
    return bank.groupBy(year.alias("year")).agg(F.count("*").alias("n")).where("year is not null")


def segmentation(documents: DataFrame, source: str, risks: str) -> DataFrame:
    """Per source: documents, those without a risk, risks, and the median of risks a document."""
    n = F.col(risks)
    return documents.groupBy(source).agg(F.count("*").alias("documents"), F.count_if(n == 0).alias("without"), F.sum(n).alias("risks"), F.median(n).alias("median"))


def status_summary(rows: DataFrame, check: str, gold: str, told: str) -> DataFrame:
    """Per check and over all (null): rows, those told right, and the accuracy."""
    right = F.count_if(F.col(gold) == F.col(told))
    return rows.groupingSets([[F.col(check)], []], check).agg(F.count("*").alias("n"), right.alias("right"), (right / F.count("*")).alias("accuracy"))


def status_confusion(rows: DataFrame, gold: str, told: str, statuses: list[str]) -> DataFrame:
    """Rows per gold status with a column for each status told."""
    return rows.groupBy(gold).pivot(told, statuses).agg(F.count(F.lit(1))).na.fill(0)


def decided(flags: DataFrame, check: str, status: str, undecided: tuple[str, ...] = ("not_available", "not_applicable")) -> DataFrame:
    """Per check how many documents it decides."""
    return flags.groupBy(check).agg(F.count_if(~F.col(status).isin(*undecided)).alias("decided"), F.count("*").alias("n"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], check: str, status: str, undecided: tuple[str, ...] = ("not_available", "not_applicable")) -> DataFrame:
    """Per check over the keys that both runs have: decided before and after, gained, lost, and decided otherwise."""
    both = before.select(*keys, F.col(status).alias("was")).join(after.select(*keys, F.col(status).alias("now")), keys)
    was, now = ~F.col("was").isin(*undecided), ~F.col("now").isin(*undecided)
    return both.groupBy(check).agg(
        F.count("*").alias("n"), F.count_if(was).alias("before"), F.count_if(now).alias("after"), F.count_if(~was & now).alias("gained"), F.count_if(was & ~now).alias("lost"),
        F.count_if(was & now & (F.col("was") != F.col("now"))).alias("otherwise"),
    )


def answer_score(checks: DataFrame, by: str, status: str) -> DataFrame:
    """Per answer the share of its numbers that are verified; null without numbers (a null status)."""
    return checks.groupBy(by).agg(F.avg(F.when(F.col(status).isNotNull(), (F.col(status) == "verified").cast("double"))).alias("score"))


def answer_run(rows: DataFrame, outcome: str, verdict: str, cited: Column) -> DataFrame:
    """Per outcome: answers, the verdicts' counts, and how many cite a passage."""
    v = F.col(verdict)
    return rows.groupBy(outcome).agg(F.count("*").alias("n"), F.count_if(v == "verified").alias("verified"), F.count_if(v == "contradicted").alias("contradicted"), F.count_if(v == "unverifiable").alias("unverifiable"), F.count_if(cited).alias("cited"))


def seed_summary(runs: DataFrame, model: str, seed: str, metric: str, baseline: float) -> DataFrame:
    """Per model over its seeds: mean, spread, the best seed (the least of equals), and whether the mean beats the
    baseline."""
    best = F.max_by(seed, F.struct(F.col(metric), -F.col(seed)))
    return runs.groupBy(model).agg(F.count("*").alias("seeds"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("spread"), best.alias("best_seed"), (F.avg(metric) > baseline).alias("passes"))


def quality_gate(rated: DataFrame, by: str, gates: dict[str, float]) -> DataFrame:
    """Per group the share of yes among the ratings given of each column, and whether every share reaches its gate."""
    share = {c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) == "yes").cast("double"))) for c in gates}
    go = F.lit(True)
    for c, least in gates.items():
        go = go & F.coalesce(share[c] >= least, F.lit(False))
    return rated.groupBy(by).agg(*[s.alias(c) for c, s in share.items()], go.alias("go"))


def first_preferred(mentions: DataFrame, by: list[str], who: str, place: str, preferred: str = "issuer") -> DataFrame:
    """Per key the first mention about the preferred one, else the first of all; and how many mentions there are."""
    return mentions.groupBy(*by).agg(F.min_by(F.struct(F.col(place), F.col(who)), F.struct(F.col(who) != preferred, F.col(place))).alias("m"), F.count("*").alias("mentions")).select(*by, F.col(f"m.{place}").alias(place), F.col(f"m.{who}").alias(who), "mentions")


def moved_to_front(queue: DataFrame, by: str, key: str, priority: str, wanted: Column) -> DataFrame:
    """Queue rows with the wanted ones before all others of their queue."""
    first = F.min(priority).over(Window.partitionBy(by))
    return queue.withColumn(priority, F.when(wanted, first - 1).otherwise(F.col(priority)))


def newest(documents: DataFrame, group: str, day: str, key: str, n: int = 3) -> DataFrame:
    """The n newest documents of each group; of one day the larger key comes first. Undated ones don't count."""
    w = Window.partitionBy(group).orderBy(F.desc(day), F.desc(key))
    return documents.where(F.col(day).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def queued(queue: DataFrame, document: str, status: str = "status") -> DataFrame:
    """The documents with queued work."""
    return queue.where(F.col(status) == "queued").select(document).distinct()


def shuffled_split(documents: DataFrame, key: str, share: float, seed: int = 13) -> DataFrame:
    """A share of the documents as dev, the others as train: in the order of digests, so in any run alike. A digest
    places a document by itself, so no document waits for the others."""
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return documents.select(key, F.when(place < share, "dev").otherwise("train").alias("part"))


def all_or_nothing(*parts: Column) -> Column:
    """The sum of printed parts; null unless all of them are there."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def plausible(metric: Column, value: Column) -> Column:
    """Whether a value lies within its metric's bounds; never for null, and not for a price-earnings ratio of zero."""
    inside = F.coalesce(*[F.when(metric == m, value.between(low, high)) for m, (low, high) in BOUNDS.items()])
    return F.coalesce(inside & ~((metric == "pe") & (value == 0)), F.lit(False))


def severity_band(level: Column) -> Column:
    return F.least(level, F.lit(SEVERE_BAND))


def is_nonrisk_title(title: Column) -> Column:
    """Whether a title is a page's heading: a known one, or a short one without a word that risks are told in."""
    t = F.trim(title)
    return (t != "") & (t.rlike(HEADING) | ((F.size(F.split(t, r"\s+")) <= MOST_WORDS) & ~t.rlike(RISK_WORDS)))


def asks_for_red_flags(question: Column) -> Column:
    return question.rlike(RED_FLAG)


def is_hit(passage_doc: Column, first: Column, last: Column, passage: Column, doc: Column, page: Column, gold: Column) -> Column:
    """Whether a passage of the right document covers the page asked for, or says the expected answer of
    MIN_GOLD_CHARS letters or more."""
    told = compact(gold)
    covers = F.coalesce(page.between(first, last), F.lit(False))
    says = F.coalesce((F.length(told) >= MIN_GOLD_CHARS) & F.contains(compact(passage), told), F.lit(False))
    return (passage_doc == doc) & (covers | says)


def span_tokens(text: Column) -> Column:
    """Tokens in order: numbers with their commas and decimals, words, single marks."""
    return F.regexp_extract_all(text, F.lit(f"({SPAN_TOKEN})"), 1)


def tolerant_difference(numbers: Column, source: Column, tolerance: float) -> Column:
    """The numbers that no number of the source equals to within the tolerance."""
    return F.filter(numbers, lambda a: ~F.exists(source, lambda b: F.abs(a - b) <= tolerance))


def file_digests(spark, path: str) -> DataFrame:
    """The SHA-256 of each file under a path, read by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
