"""Text expressions: folding, number tokens, period labels, two-digit years."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Every lower-case Latin letter that decomposes into a plain one and marks, and that plain one.
_FOLDED = {
    chr(i): plain
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    for plain in unicodedata.normalize("NFD", chr(i))[:1]
    if plain != chr(i) and plain.isascii() and chr(i).islower()
}

# French month abbreviations as printed, without the dot, to month number.
FRENCH_MONTHS = {
    "janv": 1,
    "fevr": 2,
    "mars": 3,
    "avr": 4,
    "avril": 4,
    "mai": 5,
    "juin": 6,
    "juil": 7,
    "aout": 8,
    "sept": 9,
    "oct": 10,
    "nov": 11,
    "dec": 12,
}

# Cell texts that mean "no observation".
MISSING_TOKENS = ("", ".", "..", "...", "-", "x", "n/a", "na", "nan")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c) -> Column:
    """Lower case without marks, whether a mark is part of its letter or follows it."""
    bare = F.regexp_replace(F.lower(_c(c)), r"\p{Mn}", "")
    return F.translate(bare, "".join(_FOLDED), "".join(_FOLDED.values()))


def fold(c) -> Column:
    """Accents off, lower case, currency spelled out, single spaces."""
    c = F.replace(F.replace(strip_accents(c), F.lit("€"), F.lit("eur")), F.lit("$"), F.lit("usd"))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def label_key(c) -> Column:
    """All white space removed and case folded; every other sign of the label counts."""
    return F.lower(F.regexp_replace(_c(c), r"\s+", ""))


def is_missing_token(c) -> Column:
    return F.lower(F.trim(_c(c))).isin(*MISSING_TOKENS)


def parse_number(c, decimal_comma: bool = False) -> Column:
    """A printed cell to DOUBLE. Missing tokens and unreadable text are NULL."""
    t = F.regexp_replace(F.trim(_c(c)), "[   ]", "")
    t = F.replace(t, F.lit(","), F.lit(".") if decimal_comma else F.lit(""))
    number = F.when(t.rlike(r"^[+-]?[0-9]*\.?[0-9]+$"), t)
    return F.when(~is_missing_token(c), number.try_cast("double"))


def number_rejected(c, decimal_comma: bool = False) -> Column:
    """True for a cell that is neither a number nor a declared missing token."""
    return _c(c).isNotNull() & ~is_missing_token(c) & parse_number(c, decimal_comma).isNull()


def month_number(c) -> Column:
    pairs = [F.lit(v) for kv in FRENCH_MONTHS.items() for v in kv]
    return F.create_map(*pairs)[c]


def french_date(c) -> Column:
    """Day, French month name and two-digit year, joined by hyphens, to a DATE; anything else is NULL."""
    t = F.regexp_replace(strip_accents(c), r"\s+", "")
    pattern = r"^(\d{1,2})-([a-z]+)\.?-(\d{2})$"
    month = month_number(F.regexp_extract(t, pattern, 2))
    year = 2000 + F.regexp_extract(t, pattern, 3).try_cast("int")
    day = F.regexp_extract(t, pattern, 1).try_cast("int")
    # a day the month does not have is no date
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), iso.try_cast("date"))


def french_month(c) -> Column:
    """French month name and two-digit year, joined by a hyphen, to the first of that month."""
    t = F.regexp_replace(strip_accents(c), r"\s+", "")
    pattern = r"^([a-z]+)\.?-(\d{2})$"
    month = month_number(F.regexp_extract(t, pattern, 1))
    year = 2000 + F.regexp_extract(t, pattern, 2).try_cast("int")
    return F.when(year.isNotNull() & month.isNotNull(), F.make_date(year, month, F.lit(1)))


def expand_year(two_digits, reference_date) -> Column:
    """A two-digit year read against the year it was printed in.

    A print names its own year or the one before. If the digits are one of these two, that is the
    year; else they belong to the century of the print.
    """
    yy = _c(two_digits).cast("int")
    ref = F.year(_c(reference_date))
    back = F.pmod(ref - yy, F.lit(100))
    return F.when(back <= 1, ref - back).otherwise(ref - F.pmod(ref, F.lit(100)) + yy).cast("int")


# Fixed value: a printed number, signed by a plus or by one of the dashes, with R where it was revised.
NUMBER_TOKEN = r"^[+\-\u2010-\u2015\u2212]?[0-9]+(\.[0-9]+)?R?$"


def row_tokens(line) -> Column:
    """The white-space separated tokens of a printed row."""
    return F.filter(F.split(_c(line), r"\s+"), lambda t: t != "")


def is_number_token(token: Column) -> Column:
    """Whether a token is a printed number; the pattern is only tried where its first sign can begin one."""
    begins = ((token >= "+") & (token < ":")) | ((token >= "\u2010") & (token < "\u2213"))
    return begins & token.rlike(NUMBER_TOKEN)


def label_length(tokens: Column) -> Column:
    """How many leading tokens belong to the label: all up to the last one that is no number."""
    marks = F.transform(tokens, lambda t, i: F.when(is_number_token(t), 0).otherwise(i + 1))
    return F.coalesce(F.array_max(marks), F.lit(0))


def split_row(line) -> tuple[Column, Column]:
    """(label, tail) of a printed row: numeric tokens are taken off the end."""
    tokens = row_tokens(line)
    cut = label_length(tokens)
    rest = F.greatest(F.size(tokens) - cut, F.lit(0))
    return F.array_join(F.slice(tokens, 1, cut), " "), F.array_join(F.slice(tokens, cut + 1, rest), " ")


def token_value(token) -> Column:
    """The number a token prints, its sign made a plain one and its revision mark taken off."""
    t = _c(token)
    t = F.when(t.endswith("R"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    first, rest = F.substring(t, 1, 1), F.substring(t, 2, 1 << 30)
    return F.when(first.isin(*"‐‑‒–—―−"), F.concat(F.lit("-"), rest)).when(first == "+", rest).otherwise(t).try_cast("double")


def series_name(*parts) -> Column:
    """Canonical column name from area, flow, product and unit codes."""
    return F.lower(F.concat_ws("_", *[_c(p) for p in parts]))


def href_pairs(html) -> Column:
    """Every anchor of a page as an array of struct(href, title)."""
    pattern = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
    hrefs = F.regexp_extract_all(_c(html), F.lit(pattern), F.lit(1))
    titles = F.regexp_extract_all(_c(html), F.lit(pattern), F.lit(2))
    return F.arrays_zip(hrefs.alias("href"), titles.alias("title"))


def longest_prefix(c, labels: dict[str, str]) -> Column:
    """The slot of the longest printed label the text starts with."""
    c = _c(c)
    out = F.lit(None).cast("string")
    for label in sorted(labels, key=len):
        out = F.when(c.startswith(label), labels[label]).otherwise(out)
    return out
