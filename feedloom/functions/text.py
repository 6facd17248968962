"""Text expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------
# Whitespace as JavaScript regular expressions define it.
WHITESPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
LATIN_DIGITS = "0123456789"
HTTP_URL = r"(?i)^https?://"
ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
LIMITATION_PHRASES = (
    "only found|couldn'?t find|limited results|not enough|fewer than|unable to (find|retrieve|locate)|"
    "no (search )?results|could not find"
)
PLACEHOLDER_TITLE = r"(?i)(no recent|no data|not available)"
APOLOGY_TITLE = r"(?i)(no .*(reports?|results?|data) available|unable to retrieve|couldn'?t find)"
MIN_SUMMARY_CHARS = 20
MIN_TITLE_WORD_CHARS = 3
# -----------------------------------------------------------------------------

# The same class, shaped so that an ordinary letter fails on two range tests.
_SPACE = rf"[\t-\r [\u00A0-\uFEFF&&{WHITESPACE}]]"
_SPACE_CHARS = "".join(chr(c) for c in range(0x10000) if re.match(WHITESPACE, chr(c)))

_PAGE_CHROME = (
    r"(?is)<!--.*?-->"
    r"|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>"
    r"|<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>"
    r"|<div class=\"ad\">.*?</div>"
)


def trimmed(text: Column) -> Column:
    """Trim every kind of whitespace; Spark's own trim removes spaces only."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def squeezed(text: Column) -> Column:
    """Trim, lower and collapse inner whitespace to one space."""
    return F.regexp_replace(F.lower(trimmed(text)), f"{_SPACE}+", " ")


def latin_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_INDIC_DIGITS + PERSIAN_DIGITS, LATIN_DIGITS * 2)


def is_http_url(url: Column) -> Column:
    return F.coalesce(trimmed(url).rlike(HTTP_URL), F.lit(False))


def http_url_or_null(url: Column) -> Column:
    return F.when(is_http_url(url), trimmed(url))


def main_text(html: Column) -> Column:
    """Visible body text of a landed page: chrome and tags out, entities decoded."""
    text = F.regexp_replace(html, _PAGE_CHROME, " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return trimmed(F.regexp_replace(text, f"{_SPACE}+", " "))


def head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def title_words(title: Column) -> Column:
    """Distinct words longer than three characters, ASCII letters and digits only."""
    # One cut at runs of anything else: replacing such characters first took nine tenths of the time.
    words = F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > MIN_TITLE_WORD_CHARS))


def mentions_limits(text: Column) -> Column:
    return F.rlike(text, F.lit(f"(?i){LIMITATION_PHRASES}"))


def clean_summary(summary: Column) -> Column:
    """Drop sentences that apologise for the search, unless too little is left."""
    sentences = F.split(summary, f"(?<=[.!?]){_SPACE}+")
    kept = trimmed(F.array_join(F.filter(sentences, lambda s: ~mentions_limits(s)), " "))
    return F.when(mentions_limits(summary) & (F.length(kept) > MIN_SUMMARY_CHARS), kept).otherwise(summary)


def is_translatable(value: Column) -> Column:
    """Worth sending to a translator: not a URL, not date-led, has a Latin letter."""
    return F.coalesce(
        (F.length(value) > 0)
        & ~value.rlike(HTTP_URL)
        & ~value.rlike(ISO_DATE_PREFIX)
        & value.rlike("[A-Za-z]"),
        F.lit(False),
    )


@F.pandas_udf(StringType())
def _decompose(names: pd.Series) -> pd.Series:
    """Unicode NFKD, the only step without a Spark built-in."""
    return names.map(lambda s: unicodedata.normalize("NFKD", s), na_action="ignore")


def letters_only(decomposed: Column, strip_marks: bool = False) -> Column:
    """Lower-case a-z words.  A combining mark becomes a space, which splits the
    word ("Antonio" with an accent reads "anto nio") unless ``strip_marks``."""
    text = F.regexp_replace(decomposed, r"\p{M}+", "") if strip_marks else decomposed
    text = F.regexp_replace(text, r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def with_norm_name(df: DataFrame, name: str, out: str = "norm", strip_marks: bool = False) -> DataFrame:
    """Add the normalised form of ``name``; call it on distinct names.

    Plain ASCII names skip the Python worker: only rows with a non-ASCII
    character need the Unicode decomposition, and the UDF sees nulls otherwise.
    """
    lowered = F.lower(F.col(name))
    needs_unicode = lowered.rlike(r"[^\x00-\x7F]")
    decomposed = F.coalesce(_decompose(F.when(needs_unicode, lowered)), lowered)
    return df.withColumn(out, letters_only(decomposed, strip_marks))
