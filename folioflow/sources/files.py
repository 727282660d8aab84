"""File sources and sinks: strict JSON lines, hashed binaries, graph snapshots, GraphML and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines: blank lines are passed over, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, content) of files; the content column is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def verify_hashes(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status) for expected(path, sha256): ok, changed or missing."""
    f, e = files.alias("f"), expected.alias("e")
    status = F.when(F.col("f.path").isNull(), "missing").when(F.col("f.sha256") == F.col("e.sha256"), "ok").otherwise("changed")
    return e.join(f, F.col("e.path") == F.col("f.path"), "left").select("e.path", status.alias("status"))


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by type, so scans of one label or type read only that."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML as text part files, head first: ids and edge types, escaped."""

    def esc(c):
        return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">')], "o int, value string")
    tail = spark.createDataFrame([(3, "</graph></graphml>")], "o int, value string")
    n = nodes.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), esc(F.col("node_id")), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(2).alias("o"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('" label="'), esc(F.col("edge_type")), F.lit('"/>')).alias("value"))
    head.union(n).union(e).union(tail).repartitionByRange("o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, lines: bool = True) -> None:
    """A report as JSON lines, or as one Markdown table (a report's few rows are gathered for it)."""
    if lines:
        rows.write.mode("overwrite").json(path)
    else:
        rows.sparkSession.createDataFrame([(markdown(rows),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """One Markdown table of all rows; more than limit rows are an error, as a report is gathered on the driver."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a Markdown report of more than {limit} rows: write it as JSON lines")
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)])


WORK = """id string, title string, doi string, publication_date string, cited_by_count int,
primary_topic struct<id: string, display_name: string, domain: string, field: string, subfield: string>,
concepts array<struct<id: string, display_name: string, level: int, score: double>>,
authorships array<struct<author: struct<id: string, display_name: string, orcid: string>,
  institutions: array<struct<id: string, display_name: string, country_code: string, ror: string>>>>,
referenced_works array<string>"""


def parse_works(raw: DataFrame, col: str = "value") -> DataFrame:
    """Bibliographic works from nested JSON text, one row each; text that isn't an object is passed over."""
    return raw.select(F.from_json(col, WORK).alias("w")).select("w.*").where("id IS NOT NULL")


def authorships(works: DataFrame) -> DataFrame:
    """(work_id, author_id, author, institution_id, institution): every authorship with each of its institutions."""
    a = works.select(F.col("id").alias("work_id"), F.explode("authorships").alias("a"))
    return a.select("work_id", F.col("a.author.id").alias("author_id"), F.col("a.author.display_name").alias("author"), F.explode_outer("a.institutions").alias("i")).select("work_id", "author_id", "author", F.col("i.id").alias("institution_id"), F.col("i.display_name").alias("institution"))
