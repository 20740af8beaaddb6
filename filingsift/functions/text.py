"""Text expressions. Everything is native except entity decoding and NFKC, which run in Arrow
batches and only receive the texts that need them."""
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space and word characters as Unicode text handling defines them. SPACE_CHARS
# spells the class out for RE2 as well; the (?U) forms mean the same and are several times faster in Java.
SPACE_CHARS = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
GAPS = r"(?U)[\s\x1c-\x1f]+"
WORDS = r"(?U)[^\s\x1c-\x1f]+"
WORD_CHARS = r"\p{L}\p{N}_"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
URL = f"https?://{NON_SPACE}+"
# What may start a character reference, and characters NFKC may change. ASCII and the rest of
# Latin-1 are stable, also next to each other.
REFERENCE = "&[#A-Za-z]"
UNSTABLE = r"[^\x00-\x7F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\xFF]"
COMMENT = r"(?s)<!--.*?-->"
SILENT_ELEMENT = r"(?is)<(script|style|template)\b[^>]*+>.*?</\1\s*+>"
UNSEEN_ELEMENT = r"(?is)<(script|style|noscript)\b[^>]*+>.*?</\1\s*+>"
TAG = r"""<[A-Za-z/!?](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None else None)


@F.pandas_udf(StringType())
def _unescape_nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)) if t is not None else None)


def decode_entities(c) -> Column:
    """Character references to characters. Texts without any never leave the JVM."""
    c = _c(c)
    return F.coalesce(_unescape(F.when(c.rlike(REFERENCE), c)), c)


def collapse(c) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(c), GAPS, " "))


def word_count(c) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(WORDS)), F.lit(0))


def char_count(c) -> Column:
    return F.coalesce(F.length(_c(c)), F.lit(0))


def word_density(c) -> Column:
    words = word_count(c)
    return F.when(words > 0, char_count(c) / words).otherwise(F.lit(0.0))


def strip_markup(c) -> Column:
    """Visible text of a markup document; null becomes the empty text."""
    bare = F.regexp_replace(F.regexp_replace(_c(c), COMMENT, ""), SILENT_ELEMENT, "")
    return F.coalesce(decode_entities(F.regexp_replace(bare, TAG, "")), F.lit(""))


def remove_urls(c) -> Column:
    return F.regexp_replace(_c(c), URL, "")


def normalize_mda(c, fixed_order=False) -> Column:
    """Lower, strip markup, quotes and line ends to spaces, punctuation to spaces, collapse.

    By default addresses are removed after the punctuation, where none can match any more;
    ``fixed_order`` removes them first.
    """
    text = strip_markup(F.lower(_c(c)))
    if fixed_order:
        text = remove_urls(text)
    text = F.regexp_replace(text, r"[\n\t\\'\"]+", " ")
    text = F.regexp_replace(text, rf"(?U)[^{WORD_CHARS}\s\x1c-\x1f]", " ")
    if not fixed_order:
        text = remove_urls(text)
    return F.regexp_replace(text, GAPS, " ")


def normalize_for_duplicates(c) -> Column:
    """Entities decoded, NFKC, lower case, white space collapsed; null becomes the empty text."""
    c = _c(c)
    special = F.when(c.rlike(f"{REFERENCE}|{UNSTABLE}"), c)
    return F.coalesce(collapse(F.lower(F.coalesce(_unescape_nfkc(special), c))), F.lit(""))


def preview(c, length=1000) -> Column:
    return F.substring(_c(c), 1, length)


def collapsed_preview(c, length=300) -> Column:
    return F.coalesce(F.substring(collapse(c), 1, length), F.lit(""))


def non_ascii_ratio(c) -> Column:
    c = _c(c)
    odd = F.length(F.regexp_replace(c, r"[\x00-\x7F]+", ""))
    return F.when(F.length(c) > 0, odd / F.length(c)).otherwise(F.lit(0.0))


def uppercase_ratio(c) -> Column:
    c = _c(c)
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, r"\P{Lu}+", "")) / letters).otherwise(F.lit(0.0))


# Frequent words of English filings.
ENGLISH_MARKERS = ["the", "and", "of", "to", "in", "for", "our", "we", "company", "year", "financial",
                   "business", "operations", "management"]


def english_indicator(c, markers=ENGLISH_MARKERS, max_words=None) -> Column:
    """Share of marker words among the ASCII words; over the first ``max_words`` only if given."""
    kept = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z]+"), F.lit(0))
    if max_words is not None:
        kept = F.slice(kept, 1, max_words)
    words = F.size(kept)
    return F.when(words > 0, F.size(F.filter(kept, lambda w: w.isin(list(markers)))) / words).otherwise(F.lit(0.0))


def split_sentences(c) -> Column:
    """Sentences of a text: cut after ``.!?`` where white space and a capital follow."""
    parts = F.split(collapse(c), r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def topic_tokens(c, shortest=2, longest=15) -> Column:
    """Lower-case runs of letters (digits excluded) within a length range."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{Nl}\p{No}_]+"), F.lit(0))
    return F.filter(runs, lambda t: F.length(t).between(shortest, longest) & ~t.startswith("_"))


def term_tokens(c, stop_words=()) -> Column:
    """Lower-case words of two or more characters, stop words removed."""
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit(f"[{WORD_CHARS}]{{2,}}"), F.lit(0))
    if stop_words:
        stops = list(stop_words)
        words = F.filter(words, lambda w: ~w.isin(stops))
    return words


def unigrams_and_bigrams(tokens) -> Column:
    t = _c(tokens)
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))),
                       F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, pairs)


def token_windows(tokens, width=1024, most=None) -> Column:
    """Consecutive fixed-size windows over a token array; all of them unless ``most`` is given."""
    t = _c(tokens)
    count = F.ceil(F.size(t) / F.lit(width)).cast("int")
    if most is not None:
        count = F.least(count, F.lit(most))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(t, i * width + 1, F.lit(width)))
