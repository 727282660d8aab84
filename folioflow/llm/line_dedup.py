"""Line dedup: lines whose normalised key stands in many documents lose all their copies.

DataFrame functions only. Lines are hashed (md5 of the normalised key), documents are counted per
hash, and each text is put together again from the slices between its dropped positions.

Defined results: a null or empty text is one empty line; keys shorter than min_chars are never
dropped; rows that share a doc_id (null included) are one document for the count, yet each row is
cleaned by itself; repeated rows give repeated results; an empty table gives an empty table. Only
the columns named id_col and text_col are read, and other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Own, ascii_lower, staged

_ID, _TH, _POS, _AT, _H = "id", "text_hash", "dropped", "at", "key"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def dropped_positions(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text hash) of every text that loses lines, with the 0-based positions of those lines."""

    def key(line: Column) -> Column:
        k = F.trim(line, F.lit(SPACE))
        return F.when(F.char_length(k) >= min_chars, F.md5(ascii_lower(k)))

    # one row per different text of an id: repeated rows count and are explained once
    texts = (
        docs.select(F.col(id_col).alias(_ID), _text_key(F.col(text_col)).alias(_TH), F.transform(_lines(F.col(text_col)), key).alias(_H))
        .groupBy(_ID, _TH)
        .agg(F.first(_H).alias(_H))
    )
    texts = staged(texts, "line-keys")
    lines = texts.select(_ID, _TH, F.posexplode(_H).alias(_AT, _H)).where(F.col(_H).isNotNull())
    frequent = lines.groupBy(_H, _ID).agg(F.lit(1).alias("one")).groupBy(_H).agg(F.count("one").alias("n")).where(F.col("n") >= min_docs).select(_H)
    frequent = staged(frequent, "frequent-lines")  # so both sides of the join are dealt out anew and a hot line's rows can be split
    return lines.join(frequent, _H).groupBy(_ID, _TH).agg(F.sort_array(F.collect_list(_AT)).alias(_POS))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the cleaned text in place, and the columns n_lines and n_dropped (long) added or replaced."""
    own = Own(docs)
    id_, text_ = own.at(id_col), own.at(text_col)
    drops = dropped_positions(own.df, min_docs, min_chars, id_, text_).alias("x")
    left = own.df.withColumn(_TH, _text_key(F.col(text_))).alias("d")
    joined = left.join(drops, F.col(f"d.{id_}").eqNullSafe(F.col(f"x.{_ID}")) & (F.col(f"d.{_TH}") == F.col(f"x.{_TH}")), "left")
    cut = joined.select(*[f"d.{c}" for c in own.columns], _POS, _lines(F.col(f"d.{text_}")).alias("lines"))
    ends = cut.withColumn("ends", F.when(F.col(_POS).isNotNull(), F.concat(F.array(F.lit(-1)), F.col(_POS), F.array(F.size("lines")))))

    def part(k: Column) -> Column:
        before, here = F.get("ends", k - 1), F.get("ends", k)
        return F.slice(F.col("lines"), before + 2, here - before - 1)

    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), part))
    text = F.when(F.col(_POS).isNull(), F.col(text_)).otherwise(F.array_join(kept, "\n"))
    out = ends.select(
        *[text.alias(c) if c == text_ else F.col(c) for c in own.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col(_POS).isNull(), F.lit(0)).otherwise(F.size(_POS)).cast("long").alias("n_dropped"),
    )
    return own.back(out, "n_lines", "n_dropped")


def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, r, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key
  HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
       count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r
"""
