"""What a text states, as Column expressions: subjects of titles, opinions, dates, units and a company's kind.

Texts are squeezed first where line breaks may stand inside a statement. Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import squeeze

# Wordings that results depend on.
CONSEQUENCE = (
    r",?\s*\b(?:which|this|that)\s+(?:in turn\s+)?(?:may|could|might|would|will|can)\b"
    r"|\b(?:may|could|might|would|will|can)\s+(?:\w+\s+){0,3}?"
    r"(?:adversely|materially|negatively|significantly|adverse|affect|impact|harm|hurt|damage|"
    r"lead|result|cause|expose)\w*"
    r"|\b(?:affecting|impacting|harming|resulting in|leading to)\b"
    r"|,?\s*\b(?:have|has|had|having)\b,?\s+(?:\w+\s+){0,3}?(?:an?\s+)?(?:material\s+)?adverse"
    r"|\.\s+(?=[A-Z])"
)
CONDITIONAL = r"^(?:if|in (?:the )?(?:event|case)|should|unless|where)\b[^,]*,"
PASSIVE_EFFECT = r"^(?:our|the company.s|its)\s+(?:business|operations|results|financial|growth|profitab)"
PASSIVE_CAUSE = r"\b(?:by|due to|because of|as a result of|from)\b"
OPINION = (
    r"\b(?:investors?|readers?|you|users?)\s+(?:should|must|need to|ought to|may want to|are advised|"
    r"are encouraged|are cautioned)\b|"
    r"\b(?:recommend(?:ed|ation)?|advisable|i advise|we advise|be careful|be cautious|exercise caution|"
    r"worth (?:investing|considering|applying)|good (?:investment|ipo|opportunity)|bad (?:investment|ipo)|"
    r"attractive|overvalued|undervalued|risky|consult (?:a |an |your )?(?:financial|investment|advis[eo]r))\b|"
    r"सावधान|सतर्क|सलाह|अनुशंसा|सिफ़ारिश|सिफारिश|जोखिम भरा|अच्छा निवेश|बेहतर विकल्प|"
    r"ध्यान (?:रखें|रखना|दें)|निवेशकों को [^।]{0,60}चाहिए"
)
MONTHS = "January February March April May June July August September October November December".split()
PURE_SALE = r"will not receive any (of the )?proceeds (from|of) the Offer(?!\s+for\s+Sale)"
NO_PROMOTER = (
    r"\b(?:our company|the company|we)\s+(?:does not have|do not have|has no|have no)\s+"
    r"(?:an?y?\s+)?identifiable\s+promoters?"
)
FINANCIAL = (
    r"\b(?:our company|the company|we)\b[^.]{0,160}?\b(?:is|are)\s+"
    r"(?:registered\s+with\s+the\s+(?:RBI|Reserve Bank of India)\s+as\s+)?"
    r"an?\s+(?:[\w-]+\s+){0,6}?(?:non[\s-]*banking\s+"
    r"financ\w+\s+compan|NBFC|housing\s+finance\s+compan|core\s+investment\s+compan)",
    r"\b(?:our company|the company|we)\s+(?:is|are)\s+(?:an?|the|one of (?:the|india['’]s))\s+"
    r"(?:[\w’'-]+\s+){0,6}?(?:life|general|health|non-life)\s+insur(?:ance\s+compan|er\b)",
    r"\b(?:our company|the company|we)\b[^.]{0,120}?\bregistered\s+with\s+(?:the\s+)?(?:IRDAI|"
    r"Insurance Regulatory and Development Authority)",
    r"\b(?:our bank|we are an?\s+(?:[\w-]+\s+){0,3}bank\b|small\s+finance\s+bank\s+licen)",
)
UNIT_SENTENCE = (
    r"(?:₹|\brs\.?|\binr\b|\brupees\b)\s*(?:in\s+)?(lakhs?|lacs?|crores?|millions?|billions?)\b"
    r"|\bin\s+(?:₹|rs\.?|inr|rupees)\s*(lakhs?|lacs?|crores?|millions?|billions?)\b"
    r"|\b(lakhs?|lacs?|crores?|millions?|billions?)\s+of\s+(?:₹|inr|rupees)\b"
)
MIN_SUBJECT_WORDS = 4
_MONTH = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
_DAY_MONTH = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\.?,?\s+(\d{{4}})"
_MONTH_DAY = rf"({_MONTH})\.?,?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
CLOSED = (
    r"(?:(?:BID\s*/\s*)?(?:OFFER|ISSUE)\s+)?CLOSE+D?(?:\s+ON)?\s*(?:\(\d\)|\*|#|\^)*\s*:?\s*"
    r"(?:(?:Mon|Tues?|Wednes|Thurs?|Fri|Satur|Sun)[a-z]*\s*,?\s*)?"
)


def subject_clause(title: Column) -> Column:
    """The part of a risk's title before its consequence. A conditional title gives its condition, one that begins with
    what is hurt gives the cause (empty if it names none), and a subject of fewer than MIN_SUBJECT_WORDS words says
    nothing, so the whole title stands for it."""
    before = F.regexp_extract(title, rf"(?is)^(.*?)(?:{CONSEQUENCE})", 1)
    after = F.regexp_extract(title, rf"(?is)^.*?(?:{CONSEQUENCE})(.*)$", 1)
    told = title.rlike(f"(?i){CONSEQUENCE}")
    subject = F.when(told, before).otherwise(title)
    return (
        F.when(title.rlike(f"(?i){CONDITIONAL}"), F.regexp_extract(title, f"(?i){CONDITIONAL}", 0))
        .when(told & title.rlike(f"(?i){PASSIVE_EFFECT}"), F.regexp_extract(after, rf"(?is){PASSIVE_CAUSE}.*$", 0))
        .when(F.regexp_count(subject, F.lit(r"\S+")) >= MIN_SUBJECT_WORDS, subject).otherwise(title)
    )


def has_opinion(answer: Column) -> Column:
    """Whether an answer gives an opinion; its citations are no part of it."""
    return F.regexp_replace(answer, r"\[\d+\]", " ").rlike(f"(?i){OPINION}")


def closed_date(text: Column) -> Column:
    """The first date on which a text says that an offer closed; what is no date is passed over."""
    said = F.regexp_extract_all(squeeze(text), F.lit(f"(?i)({CLOSED}(?:{_DAY_MONTH}|{_MONTH_DAY}))"), 1)
    places = F.array(*[F.lit(m[:3].lower()) for m in MONTHS])

    def read(rx: str, day: int, month: int):
        def one(m: Column) -> Column:
            part = lambda i: F.regexp_extract(m, f"(?i){rx}$", i)
            number = F.array_position(places, F.lower(F.substring(part(month), 1, 3)))
            return F.try_to_date(F.concat_ws("-", part(3), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(day), 2, "0")), "yyyy-MM-dd")

        return one

    dates = F.transform(said, lambda m: F.coalesce(read(_DAY_MONTH, 1, 2)(m), read(_MONTH_DAY, 2, 1)(m)))
    return F.get(F.array_compact(dates), F.lit(0))


def is_pure_sale(objects: Column) -> Column:
    """Whether the company gets nothing of the offer."""
    return squeeze(objects).rlike(f"(?i){PURE_SALE}")


def names_no_promoter(text: Column) -> Column:
    return squeeze(text).rlike(f"(?i){NO_PROMOTER}")


def is_financial_company(text: Column) -> Column:
    """Whether a text says that its company is a lender, a bank or an insurer."""
    return squeeze(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in FINANCIAL))


def stated_unit(text: Column) -> Column:
    """The unit that a sentence states for a table's amounts, such as ₹ in million; null if none does."""
    words = [F.nullif(F.regexp_extract(text, f"(?i){UNIT_SENTENCE}", i), F.lit("")) for i in (1, 2, 3)]
    word = F.regexp_replace(F.lower(F.coalesce(*words)), "s$", "")
    return F.concat(F.lit("₹ in "), F.when(word == "lac", "lakh").otherwise(word))
