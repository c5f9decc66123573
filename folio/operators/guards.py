"""Guards on questions and answers: personal data in English, Hindi and Hinglish."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Who is a person, what is asked of them, and the wordings that ask, in order of precedence.
PERSON = (
    r"(?:ceo|cfo|coo|cto|founder|co-founder|promoter|director|chairman|chairperson|managing director|md|kmp|key managerial|executive|owner|his|her|their|mr|mrs|ms|shri|smt|"
    r"सीईओ|संस्थापक|प्रमोटर|निदेशक|चेयरमैन|मालिक|श्री|श्रीमती|ceo ka|founder ka|promoter ka|director ka)"
)
CONTACT = r"(?:address|residence|residential|phone|mobile|cell|telephone|contact number|number|e-?mail|email|whatsapp|house|home|पता|फोन|मोबाइल|नंबर|ईमेल|घर|निवास|pata|ghar)"
ASKS = [
    ("home_address", r"\b(?:home|house|residential|residence|private|personal|current|permanent)\b.{0,15}\b(?:address|phone|mobile|number|e-?mail|contact)\b"),
    ("home_address", r"\bwhere (?:does|do|is)\b.{0,40}\b(?:live|stay|reside)s?\b|\blives? (?:at|in)\b.{0,20}\?"),
    ("home_address", r"घर (?:का|की|के) (?:पता|पते|फोन|नंबर|ईमेल)|निजी|व्यक्तिगत (?:पता|फोन|मोबाइल|नंबर|ईमेल)|कहां रहते|कहाँ रहते|रहता है|रहती है|ghar ka (?:pata|address|number)|kahan rehte"),
    ("personal_contact", rf"\b{PERSON}\b.{{0,30}}\b{CONTACT}\b|\b{CONTACT}\b.{{0,20}}\b(?:of|for) (?:the |our |its )?{PERSON}\b"),
    ("personal_contact", rf"{PERSON}.{{0,30}}(?:पता|फोन|मोबाइल|नंबर|ईमेल)|(?:पता|फोन|मोबाइल|नंबर|ईमेल).{{0,20}}{PERSON}"),
    (
        "identity_number",
        r"\b(?:aadhaar|aadhar|passport|driving licen[cs]e|voter id|pan (?:number|card|no))\b.{0,25}\b(?:of|for|number)\b|\b(?:his|her|their|promoter'?s?|director'?s?|ceo'?s?) (?:aadhaar|aadhar|passport|pan)\b|आधार|पासपोर्ट|पैन (?:नंबर|कार्ड)",
    ),
]
BUSINESS = (
    r"\b(?:registered|corporate|head|principal|branch) office\b|\bregistrar\b|\blead managers?\b|\bbrlms?\b|\bcompliance officer\b|\binvestor grievance|\bcompany secretary\b|\bcin\b|"
    r"रजिस्टर्ड ऑफिस|पंजीकृत कार्यालय|रजिस्ट्रार|कंपनी सचिव|अनुपालन अधिकारी"
)
PERSON_CUE = r"(?:ceo|cfo|coo|cto|founder|promoter|director|chairman|chairperson|kmp|his|her|their|him|mr|mrs|ms|shri|smt|सीईओ|संस्थापक|प्रमोटर|निदेशक|चेयरमैन|उनका|उनके|उनकी|इनका|इनके|श्री|श्रीमती)"
HINDI_ADDRESS = r"(?:पता|पते|निवास|रहते|रहता|रहती|ठिकाना)"
ADDRESS_CUE = r"(?:address|residen\w*|lives?|resides?|home|house|पता|पते|निवास|रहते|रहता|रहती|ठिकाना|घर)"
TELLS = [
    ("personal_address", rf"(?i)\b{PERSON_CUE}\b.{{0,60}}{ADDRESS_CUE}|{ADDRESS_CUE}.{{0,60}}\b{PERSON_CUE}\b|{PERSON_CUE}.{{0,60}}{HINDI_ADDRESS}|{HINDI_ADDRESS}.{{0,60}}{PERSON_CUE}"),
    (
        "address_detail",
        r"(?i)\b(?:house|flat|plot|door|villa)\s*(?:no\.?|number|#)\s*\w+|\b(?:apartments?|residency|enclave|society)\b|\bsector[\s-]*[\d०-९]+|हा[ऊउ]स\s*नंबर|फ्लैट|अपार्टमेंट|सेक्टर[\s-]*[\d०-९]+|मकान\s*नंबर|"
        r"\b\d{1,4}\s+[A-Z][a-z]+\s+(?:Ct|Court|St|Street|Ave|Avenue|Dr|Drive|Ln|Lane|Rd|Road)\b|\bresidential address\b|\bhome address\b",
    ),
    ("identity_number", r"\b[A-Z]{5}\d{4}[A-Z]\b|\b\d{4}\s\d{4}\s\d{4}\b"),
    ("phone_or_email", r"(?:\+91[\s-]?)?\b[6-9]\d{9}\b|\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
]
_NUKTA = ("\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f", "\u0915\u0916\u0917\u091c\u0921\u0922\u092b\u092f")  # letters with a dot, and without


def normal_question(text: Column) -> Column:
    """Small letters, one spelling of Hindi nasal and dotted letters, straight apostrophes, single spaces."""
    plain = F.translate(F.translate(F.lower(text), *_NUKTA), "’‘\u0901\u093c", "''\u0902")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def _first(text: Column, rules: list[tuple[str, str]], allowed: Column) -> Column:
    """The first rule that a text fits: category and what matched; null if none does."""
    hits = [F.when(allowed(name) & text.rlike(rx), F.struct(F.lit(name).alias("category"), F.trim(F.regexp_substr(text, F.lit(rx))).alias("matched"))) for name, rx in rules]
    return F.coalesce(*hits)


def private_question(question: Column) -> Column:
    """The category and the wording by which a question asks for a person's address, contact or identity number; null if it
    doesn't, or asks for a business contact."""
    q = normal_question(question)
    return _first(q, ASKS, lambda _: ~q.rlike(BUSINESS))


def private_answer(answer: Column, question: Column | None = None) -> Column:
    """The category and the words by which an answer gives a person's address, contact or identity number. A business contact
    in the answer or its question lets all but identity numbers through."""
    asked = normal_question(answer) if question is None else F.concat_ws(" ", normal_question(answer), normal_question(question))
    return _first(F.trim(answer), TELLS, lambda name: F.lit(name == "identity_number") | ~asked.rlike(BUSINESS))
