"""Text normalisation, cleaning and identifiers as built-in string expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ligatures and typographic signs, and what they become.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'",
    "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " ",
}


def slugify(s: Column) -> Column:
    """Lower case, one underscore for each other sign, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def dash_slug(s: Column, default: str = "item") -> Column:
    t = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(t == "", default).otherwise(t)


def normal_label(s: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(s)), r"\s+", " ")


def normal_doi(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", ""))


def normal_arxiv(s: Column) -> Column:
    t = F.lower(F.trim(s))
    t = F.regexp_replace(F.regexp_replace(t, r"^https?://(www\.)?arxiv\.org/(abs|pdf)/", ""), r"^arxiv:\s*", "")
    return F.regexp_replace(F.regexp_replace(t, r"\.pdf$", ""), r"v[0-9]+$", "")


def normal_url(s: Column) -> Column:
    """Without query, fragment and trailing slashes; scheme and host lower."""
    t = F.regexp_replace(F.trim(s), r"[?#].*$", "")
    head = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(t, F.length(head) + 1, F.lit(2**31 - 1))), "/+$", "")


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, "<[^>]*>", "")


def normal_signs(s: Column) -> Column:
    """Ligatures and typographic signs spelled out, control characters dropped."""
    t = s
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def _compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normal_unicode(s: Column) -> Column:
    """NFKC, then `normal_signs`; null becomes empty. Spark has no function for NFKC, so
    texts go through Python in Arrow batches."""
    t = F.coalesce(s, F.lit(""))
    nfkc = F.pandas_udf(_compatible, StringType())
    return normal_signs(nfkc(t))


def json_keys(s: Column) -> Column:
    """All different keys of a JSON text, at any depth, sorted: the string tokens that a colon follows. Null: none."""
    tokens = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r'("(?:[^"\\]|\\.)*+"\s*:?)'), 1)
    keys = F.filter(tokens, lambda x: F.endswith(x, F.lit(":")))
    return F.array_sort(F.array_distinct(F.transform(keys, lambda x: F.regexp_extract(x, r'(?s)^"(.*)"\s*:$', 1))))


def forbidden_keys(s: Column, keys: list[str]) -> Column:
    """Those of keys that a JSON text has at any depth."""
    return F.array_intersect(json_keys(s), F.array(*map(F.lit, keys)).cast("array<string>"))


def collapse_space(s: Column) -> Column:
    """Runs of blanks to one, three or more line ends to two, no blanks at line ends, none around the text."""
    t = F.regexp_replace(F.regexp_replace(s, r"[ \t\f\x0b]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(t, r" +\n", "\n"), F.lit(" \n\t"))


def drop_repeated_lines(s: Column) -> Column:
    """A line equal to the one before it (blanks at the ends aside) goes; a blank line starts anew."""
    lines = F.split(s, "\n", -1)

    def stays(x: Column, i: Column) -> Column:
        return (i == 0) | (F.trim(x) == "") | (F.trim(x) != F.trim(F.get(lines, i - 1)))

    return F.array_join(F.filter(lines, stays), "\n")


def clean_body(s: Column) -> Column:
    return drop_repeated_lines(collapse_space(normal_signs(s)))


def fingerprint(s: Column) -> Column:
    return F.struct(F.sha2(F.coalesce(s, F.lit("")), 256).alias("sha256"), F.length(F.coalesce(s, F.lit(""))).alias("char_count"))


def vid(kind: str, *parts: Column) -> Column:
    """A stable identifier: the hash of a canonical key."""
    return F.concat(F.lit(f"vid:{kind}:"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32))


def title_key(title: Column, author: Column, year: Column) -> Column:
    return F.sha2(F.concat_ws("|", normal_label(title), normal_label(author), year.cast("string")), 256)


def cut_bytes(s: Column, n: int = 10_000) -> Column:
    """The first n characters. (By bytes, a text that is cut inside a character would stay whole.)"""
    return F.substring(s, 1, n)


def words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("([A-Za-z0-9À-ɏ]+(?:['’-][A-Za-z0-9À-ɏ]+)*)"), 1)
