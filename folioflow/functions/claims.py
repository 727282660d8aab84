"""Whether a claim follows its span, and where a surface stands in a body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tokens(s: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda x: F.length(x) > 2))


def token_overlap(claim: Column, span: Column) -> Column:
    """Share of the claim's different words of over two signs that the span has too; 0 where either has none."""
    a = _tokens(F.coalesce(claim, F.lit("")))
    both = F.array_intersect(a, _tokens(F.coalesce(span, F.lit(""))))
    return F.when(F.size(a) > 0, F.size(both) / F.size(a)).otherwise(F.lit(0.0))


def faithfulness(claim: Column, span: Column, resolvable: Column, min_overlap: float = 0.25) -> Column:
    """Why a claim can't be promoted: empty_claim, missing_span_text, span_not_resolvable or low_token_overlap; else token_overlap."""
    blank = lambda c: ~F.coalesce(c.rlike(r"\S"), F.lit(False))
    return (
        F.when(blank(claim), "empty_claim").when(blank(span), "missing_span_text").when(~F.coalesce(resolvable, F.lit(False)), "span_not_resolvable")
        .when(token_overlap(claim, span) < min_overlap, "low_token_overlap").otherwise("token_overlap")
    )


def locate(surface: Column, body: Column) -> Column:
    """(char_start, char_end) of the surface's first place in the body, half open, case apart; if it isn't there as it stands, with
    any white space between its words. Null where it isn't found, or either is blank. Case is that of `lower`."""
    s = F.regexp_replace(surface, r"^\s+|\s+$", "")
    at = F.instr(F.lower(body), F.lower(s))
    words = F.split(F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), r"\s+")
    pattern = F.concat(F.lit("(?iu)\\Q"), F.array_join(words, "\\E\\s+\\Q"), F.lit("\\E"))
    loose = F.regexp_instr(body, pattern)
    span = lambda start, n: F.struct((start - 1).cast("long").alias("char_start"), (start - 1 + n).cast("long").alias("char_end"))
    return F.when(s == "", None).when(at > 0, span(at, F.length(s))).when(loose > 0, span(loose, F.length(F.regexp_substr(body, pattern))))
