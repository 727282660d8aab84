"""Body quality, language and outline signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of function words by language, in the order in which ties are decided.
FUNCTION_WORDS = {
    "en": "the and of to in a is that for on with as by this are from be or an".split(),
    "de": "der die und das ist von zu den mit nicht ein eine auf für".split(),
    "fr": "le de et la les des un une est du en dans que qui pour".split(),
    "ru": "и в не на что с по это как а то все она они из за для".split(),
}
#: Least numbers of words by profile.
MIN_WORDS = {"web": 50, "scholarly": 15}


def body_measures(text: Column, w: Column) -> Column:
    """word_count, mean_word_len and symbol_ratio of a text and its words (a column, so they are split once)."""
    n, letters, signs = F.size(w), F.length(F.array_join(w, "")), F.regexp_count(text, F.lit("[#….!?$%*@]+"))
    return F.struct(
        n.alias("word_count"), F.when(n > 0, letters / n).otherwise(0.0).alias("mean_word_len"),
        F.when(n > 0, signs / n).otherwise(F.when(F.trim(text) == "", 0.0).otherwise(1.0)).alias("symbol_ratio"),
    )


def body_status(words_: Column, mean_len: Column, symbols: Column, top_share: Column, profile: str = "web") -> Column:
    """empty, ok, too_short, low_quality or soft_signal. A text without words is empty if it has no signs either (symbols is 0)."""
    short = words_ < MIN_WORDS[profile]
    odd = (mean_len < 2.5) | (mean_len > 12.0) | (symbols > 0.12)
    repeats = top_share > 0.22
    if profile == "web":
        return F.when((words_ == 0) & (symbols == 0), "empty").when(short, "too_short").when(odd | repeats, "low_quality").otherwise("ok")
    return F.when((words_ == 0) & (symbols == 0), "empty").when(short | odd | repeats, "soft_signal").otherwise("ok")


def with_language(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with language and confidence: by the share of Cyrillic letters, else by shares of function words.

    Tokens and shares are columns of their own on the way, so each text is split once.
    """
    own = [c for c in df.columns if c not in ("language", "confidence")]
    t = F.trim(F.col(text_col))
    tokens = F.regexp_extract_all(F.lower(t), F.lit("([a-zЀ-ӿÀ-ɏ]+)"), 1)
    # one pass over the tokens keeps the function words; each language then counts its own
    every = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    a = df.select(*own, (t.isNull() | (t == "")).alias("__none"), tokens.alias("__t"), F.regexp_count(t, F.lit(r"\p{L}")).alias("__letters"), F.regexp_count(t, F.lit("[Ѐ-ӿ]")).alias("__cyr"))
    a = a.select(*own, "__none", "__letters", "__cyr", F.size("__t").alias("__n"), F.filter("__t", lambda x: x.isin(every)).alias("__f"))

    def share(ws: list[str]) -> Column:
        return F.when(F.col("__n") > 0, F.size(F.filter("__f", lambda x: x.isin(ws))) / F.col("__n")).otherwise(0.0)

    s = a.select("*", *[share(ws).alias(f"__{k}") for k, ws in FUNCTION_WORDS.items()], F.when(F.col("__letters") > 0, F.col("__cyr") / F.col("__letters")).otherwise(0.0).alias("__share"))
    s = s.withColumn("__best", F.greatest("__en", "__de", "__fr"))
    n, best, cyrillic = F.col("__n"), F.col("__best"), F.col("__share")
    name = F.when(F.col("__en") == best, "en").when(F.col("__de") == best, "de").otherwise("fr")

    def first(*cases: tuple[Column, str | Column, float | Column]) -> tuple[Column, Column]:
        lang, sure = name, F.least(F.lit(0.95), 0.35 + best * 4.0)
        for holds, x, y in reversed(cases):
            lang, sure = F.when(holds, x).otherwise(lang), F.when(holds, y).otherwise(sure)
        return lang, sure

    lang, sure = first(
        (F.col("__none"), "unknown", 0.0), (cyrillic >= 0.35, "ru", F.least(F.lit(0.99), 0.55 + cyrillic * 0.35 + F.col("__ru"))), (n < 3, "unknown", 0.1),
        ((best <= 0) & (n >= 8), "en", 0.35), (best < 0.02, "unknown", best),
    )
    return s.select(*own, lang.alias("language"), F.round(sure, 4).alias("confidence"))


def heading(line: Column) -> Column:
    """(text, level, source) of an ATX or numbered heading, else null."""
    t = F.trim(line, F.lit(" \t\r"))
    atx, numbered = r"^(#{1,6})\s+(\S.*)$", r"^([0-9]+(?:\.[0-9]+)*)[.)]?\s+(\S.+)$"
    number, title = F.regexp_extract(t, numbered, 1), F.trim(F.regexp_extract(t, numbered, 2))
    level = F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    fits = t.rlike(numbered) & (F.length(title) <= 120) & (F.size(F.split(title, r"\s+")) <= 20)

    def result(text: Column, level: Column, source: str) -> Column:
        return F.struct(text.alias("text"), level.cast("int").alias("level"), F.lit(source).alias("source"))

    return F.when(t.rlike(atx), result(F.trim(F.regexp_extract(t, atx, 2)), F.length(F.regexp_extract(t, atx, 1)), "atx")).when(fits, result(F.concat(number, F.lit(" "), title), level, "numbered"))


def full_text_status(text: Column) -> Column:
    """empty_source, no_substantive_body or ok: whether some line is neither blank nor a heading."""
    t = F.coalesce(text, F.lit(""))
    body = F.exists(F.split(t, r"\r\n|[\n\r]"), lambda x: x.rlike(r"^\s*[^\s#]"))
    return F.when(~t.rlike(r"\S"), "empty_source").when(body, "ok").otherwise("no_substantive_body")
