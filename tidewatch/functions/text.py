"""Text as column expressions, Python only where the JVM has no function for it."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EVENT_ROOTS, lookup

# Letters that canonical decomposition leaves alone, and their plain forms.
_PLAIN_FROM, _PLAIN_TO = "øđłħıŧ", "odlhit"
# Words that carry no meaning of their own.
STOPWORDS = (
    "a about after against all also am an and any are as at be because been before being between both but by can could did do does down during each few for from further had has have he her here hers him his how i if in into is it its "
    "just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with would you your"
).split()


def _fold_table() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with accents, and the same letters without; made from Unicode."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        letter = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(letter) == 1 and len(base) == 1 and base != letter and letter not in accented:
            accented.append(letter)
            plain.append(base)
    return "".join(accented) + _PLAIN_FROM, "".join(plain) + _PLAIN_TO


_ACCENTED, _UNACCENTED = _fold_table()


def clean_text(text: Column) -> Column:
    """Without tags and CDATA marks, entities decoded, white space collapsed; '' for null."""

    @F.pandas_udf("string")
    def unescape(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t if t is None or "&" not in t else re.sub("[\ud800-\udfff]", "�", html.unescape(t)))

    bare = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->|</?[A-Za-z!?][^<>]*>", " ")
    decoded = F.when(bare.contains("&"), unescape(bare)).otherwise(bare)
    return F.coalesce(F.trim(F.regexp_replace(decoded, r"[\s ]+", " ")), F.lit(""))


def normalize_key(text: Column) -> Column:
    """Lower case without accents and punctuation, words apart by one blank."""
    folded = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _UNACCENTED), r"\p{M}+", "")
    folded = F.regexp_replace(folded, "ß", "ss")
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the cleaned and normalised parts; null counts as empty, parts don't run together."""
    return F.sha2(F.concat_ws("\u001f", *[normalize_key(clean_text(p)) for p in parts]), 256)


def truncate(text: Column, n: int) -> Column:
    """Cut at a word boundary to at most n characters, with an ellipsis."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.regexp_replace(F.substring(text, 1, n), r"\s+\S*$", "")), F.lit("…")))


def embedding_text(title: Column, body: Column, place: Column | None = None) -> Column:
    """Title, place and body in one text of at most 2000 characters."""
    parts = [title, *([place] if place is not None else []), body]
    return F.substring(F.concat_ws(". ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts]), 1, 2000)


def sentences(text: Column) -> Column:
    """Array of sentences: a full stop, exclamation or question mark before a capital ends one."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Normalised words without stop words and words of one or two letters."""
    return F.filter(F.split(normalize_key(text), " "), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def cased_tokens(text: Column) -> Column:
    """Array of struct(raw, norm): words with apostrophes and hyphens, case kept in ``raw``."""
    raw = F.filter(F.split(text, r"[^\p{L}\p{N}'’-]+"), lambda w: w != "")
    return F.transform(raw, lambda w: F.struct(w.alias("raw"), normalize_key(w).alias("norm")))


def is_capitalised(word: Column) -> Column:
    """Whether the first character is upper case and has a lower case."""
    return word.rlike(r"^\p{Lu}")


def title_case(text: Column) -> Column:
    """Every word with a capital first letter, the rest lower."""
    return F.initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))


def short_count(n: Column) -> Column:
    """1.2M, 12k, 1.2k or the number itself."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 10_000, F.concat(F.round(n / 1e3).cast("bigint").cast("string"), F.lit("k")))
        .when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def coordinates(lat: Column, lon: Column) -> Column:
    """``12.345°N 67.890°W``."""
    side = lambda x, plus, minus: F.concat(F.format_string("%.3f", F.abs(x)), F.lit("°"), F.when(x >= 0, plus).otherwise(minus))
    return F.concat_ws(" ", side(lat, "N", "S"), side(lon, "E", "W"))


def _root(code: Column) -> Column:
    # Two digits at least; longer codes stay what they are and match nothing.
    return F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)


def root_category(code: Column) -> Column:
    """Category of an event root code, ``other`` if unknown or null."""
    return lookup(_root(code), {k: v[1] for k, v in EVENT_ROOTS.items()}, "other")


def root_label(code: Column) -> Column:
    """Label of an event root code, null if unknown."""
    return lookup(_root(code), {k: v[0] for k, v in EVENT_ROOTS.items()})


def safe_url(text: Column) -> Column:
    """An http(s) address, or null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^https?://[^\s/?#]+") & F.try_parse_url(t, F.lit("HOST")).isNotNull(), t)
