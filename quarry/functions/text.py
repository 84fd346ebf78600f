"""Text functions as Column expressions: tokens, folding, normal forms, signatures, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what they fold to; decomposed marks are dropped as well.
MARKED = "áàâäãåāăąçćčďèéêëēęěìíîïīłñńňòóôöõøōřśšťùúûüūůýÿžźżÁÀÂÄÃÅĀĂĄÇĆČĎÈÉÊËĒĘĚÌÍÎÏĪŁÑŃŇÒÓÔÖÕØŌŘŚŠŤÙÚÛÜŪŮÝŸŽŹŻ"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzzAAAAAAAAACCCDEEEEEEEIIIIILNNNOOOOOOORSSTUUUUUUYYZZZ"

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def fold(text: Column) -> Column:
    """Text without diacritics."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}", "")


def squeezed(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def question_key(text: Column) -> Column:
    """What two askings of one question share: letter case and white space aside."""
    return squeezed(F.lower(text))


def nullable(text: Column) -> Column:
    """Null for the words that models write for nothing."""
    return F.when(~F.coalesce(F.lower(F.trim(text)).isin("", "null", "none", "n/a", "unknown"), F.lit(True)), F.trim(text))


def token_estimate(text: Column) -> Column:
    """Words or a quarter of the characters, whichever is more."""
    text = F.coalesce(text, F.lit(""))
    return F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), F.floor(F.length(text) / 4).cast("int"))


def head_and_tail(text: Column, most: int, marker: str = " ... ") -> Column:
    """A text cut in its middle to ``most`` characters besides the marker."""
    head = most - most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(most // 2))))


#: Symbols that carry a claim's meaning and the words they become, in order.
SYMBOL_WORDS = (
    (r">=", " gte "),
    (r"<=", " lte "),
    (r"!=|≠", " ne "),
    (r">", " gt "),
    (r"<", " lt "),
    (r"=", " eq "),
    (r"%", " pct "),
    (r"(?<![\w.])-(?=\d)", " neg "),
    (r"(?<=\d)\.(?=\d)", "dot"),
    (r"(?<=\d)-(?=\d)", "dash"),
    (r"(?<=\d)/(?=\d)", "slash"),
    (r"(?<=\d):(?=\d)", "colon"),
    (r"(?<=\d),(?=\d)", "comma"),
)


def claim_key(text: Column) -> Column:
    """The form in which two phrasings of one claim are equal; numbers, signs and comparisons stay."""
    worded = text
    for pattern, word in SYMBOL_WORDS:
        worded = F.regexp_replace(worded, pattern, word)
    text = F.when(text.rlike("[<>=≠%]|[0-9]"), worded).otherwise(text)  # most texts have none
    return F.trim(F.regexp_replace(fold(F.lower(text)), "[^0-9a-z]+", " "))


#: Quantities and negations of a claim.
QUANTITY = r"(?:>=|<=|!=|>|<)?\s*-?\d+(?:[.,:/-]\d+)*\s*(?:%|[a-zA-Z]{1,4}\b)?"
NEGATIONS = ("not ", "no ", "never ", "sin ", "nunca ", "n't ", "cannot ", "without ")


def numeric_signature(text: Column) -> Column:
    """Sorted quantities (comparison, sign, number, unit) and negations; claims that differ here differ."""
    low = F.lower(text)
    found = F.transform(F.regexp_extract_all(low, F.lit(QUANTITY), F.lit(0)), lambda q: F.regexp_replace(F.regexp_replace(q, r"\s+", ""), ",", "."))
    marks = F.filter(F.array(*(F.when(F.contains(low, F.lit(n)), F.lit(f"neg:{n.strip()}")) for n in NEGATIONS)), lambda m: m.isNotNull())
    return F.array_sort(F.concat(found, marks))


def excerpt_start(text: Column, query: Column, budget: int) -> Column:
    """0-based start of the window of ``budget`` characters around the first match of the query, or of
    its first word that occurs, clamped to the text; 0 for short texts."""
    low, terms = F.lower(fold(text)), F.concat(F.array(F.trim(query)), F.split(F.trim(query), r"\s+"))
    spots = F.transform(terms, lambda t: F.struct(F.instr(low, F.lower(fold(t))).alias("at"), F.length(t).alias("n")))
    hit = F.get(F.filter(spots, lambda s: (s["at"] > 0) & (s["n"] > 0)), F.lit(0))
    around = F.greatest(F.lit(0), hit["at"] - 1 - F.greatest(F.lit(0), F.floor((F.lit(budget) - hit["n"]) / 2)))
    start = F.least(F.coalesce(around, F.lit(0)), F.length(text) - budget)
    return F.when(F.length(text) <= budget, F.lit(0)).otherwise(start).cast("int")


def excerpt(text: Column, query: Column, budget: int) -> Column:
    """The window of a text around its first match."""
    return F.substr(text, excerpt_start(text, query, budget) + 1, F.lit(budget))


def first_heading(text: Column) -> Column:
    """The first markdown heading, without its marks; null if there is none or it is empty."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^(#.*)$", 1), "^#+", "")), F.lit(""))
