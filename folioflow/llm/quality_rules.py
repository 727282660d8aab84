"""Quality rules: a threshold table compiled into one projection over each document.

DataFrame functions only, no shuffle: words, their hashes and the hashes of five-word windows are
arrays of the row. Windows that occur twice are found by sorting (hash, position), and only in rows
where the count of different hashes says that some repeat.

Defined results: a null or blank text has no words, all counts 0, and fails; repeated rows give
repeated results; very long texts are measured whole; an empty table gives an empty table; text_col and lang_col
alone are read (lang_col may be missing), and other columns pass through, whatever their names. A column with an output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Own, words

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that it for with as on be by this are from at an was or he".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec il ne se plus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
}
#: (measure, comparison, bound): a document is kept if every line holds.
THRESHOLDS = [
    ("n_words", ">=", 10),
    ("chars_per_word", ">=", 2.0),
    ("chars_per_word", "<=", 20.0),
    ("symbols_per_word", "<=", 0.1),
    ("dup_line_ratio", "<=", 0.5),
    ("repeat_ratio", "<=", 0.2),
    ("stop_ratio", ">=", 0.05),
]
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]


def _forms(language: str) -> list[str]:
    """The language's stop words in lower case, with a capital, and in capitals."""
    return sorted({v for w in STOP_WORDS[language] for v in (w, w.capitalize(), w.upper())})


def measures(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", window: int = WINDOW) -> DataFrame:
    """docs, whose columns have no name used here, with the counts the thresholds are made of. Stop words are those of the
    text's own language; where that is null, of the listed language that has most of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select("*", words(F.col(text_col)).alias("w"), solid.alias("l"))
    b = a.select(
        *docs.columns, "w", F.size("w").alias("n"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
    )
    hashed = F.transform(F.sequence(F.lit(0), F.col("n") - window), lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(window)]))
    c = b.withColumn("g", F.when(F.col("n") >= window, hashed).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.arrays_zip(F.col("g").alias("g"), F.sequence(F.lit(0), F.size("g") - 1).alias("p")))
    d = c.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), pairs))

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("s", i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["g"] == x["g"], F.lit(False))

    at = F.sort_array(F.transform(F.filter("s", twice), lambda x: x["p"]))
    covered = F.aggregate(
        at, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")), lambda acc: acc["n"],
    )

    def stops(language: str) -> Column:
        return F.size(F.filter("w", lambda w: w.isin(_forms(language))))

    most = F.greatest(*map(stops, STOP_WORDS))
    stop = most
    if lang_col is not None:
        stop = F.when(F.col(lang_col).isNull(), most)
        for language in STOP_WORDS:
            stop = stop.when(F.col(lang_col) == language, stops(language))
    return d.select(
        *docs.columns, F.col("n").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long"),
        F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"), stop.cast("long").alias("n_stop_words"),
    )


def apply_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", thresholds=THRESHOLDS) -> DataFrame:
    """docs with the measures, base_failed and kept. Texts of a language without a list aren't held to the stop-word rule."""
    own = Own(docs)
    text = own.at(text_col)
    m = measures(own.df, text, own.at(lang_col) if own.has(lang_col) else None)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)), F.lit(1)).cast("double")
    value = {
        "n_words": F.col("n_words"), "chars_per_word": F.col("word_chars") / n, "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines, "repeat_ratio": F.col("n_repeat_words") / n, "stop_ratio": F.col("n_stop_words") / n,
    }
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~base
    for name, sign, bound in thresholds:
        holds = value[name] >= bound if sign == ">=" else value[name] <= bound
        kept = kept & F.coalesce(holds, F.lit(True))  # no measure, no rule
    return own.back(m.select("*", base.alias("base_failed"), kept.alias("kept")), *OUT)


def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = apply_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def stops(language: str) -> str:
        return "len([x for x in w if x IN (" + ", ".join(f"'{v}'" for v in _forms(language)) + ")])"

    stop = "CASE " + " ".join(f"WHEN lang = '{g}' THEN {stops(g)}" for g in STOP_WORDS) + f" WHEN lang IS NULL THEN greatest({', '.join(map(stops, STOP_WORDS))}) END"
    col = {
        "n_words": "n_words", "chars_per_word": "word_chars / n", "symbols_per_word": "n_symbols / n", "dup_line_ratio": "n_dup_lines / lines",
        "repeat_ratio": "n_repeat_words / n", "stop_ratio": "stop / n",
    }
    tests = [f"coalesce({col[m]} {s} {b}, true)" for m, s, b in THRESHOLDS]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l,
         len(string_split(t, chr(10))) AS lines FROM d
), g AS (
  SELECT r, i, array_to_string(w[i:i + 4], chr(1)) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c >= 2
), cover AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, ({stop})::DOUBLE AS stop,
    greatest(len(w), 1)::DOUBLE AS n, greatest(lines, 1)::DOUBLE AS lines
  FROM w LEFT JOIN cover ON w.r = cover.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {" AND ".join(tests)}) AS kept
FROM m
"""


OP7_SQL = _sql()
