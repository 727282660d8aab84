"""Ordered rules that give a label to a title, path, relation or block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAUSAL_AND_COMPARISON = ["CAUSES", "ENABLES", "PREVENTS", "IMPROVES", "OUTPERFORMS", "COMPARES_WITH", "BETTER_THAN", "WORSE_THAN"]
CITATION = ["CITES", "SUPPORTS", "CONTRASTS", "EXTENDS"]
NUMERIC_MARKERS = ["%", "pp.", "percentage", "outperform", "state-of-the-art", "sota", "significantly", "p<", "p <"]


def _any(t: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | t.contains(n)
    return out


def section_type(title: Column) -> Column:
    """The entity type a section's title announces; null if none."""
    t = F.lower(title)
    return (
        F.when(_any(t, ["dataset", "corpus", "benchmark"]), "Dataset")
        .when(_any(t, ["method", "approach", "algorithm"]), "Method")
        .when((t.contains("model") & ~t.contains("world model")) | t.contains("inference"), "Model")
        .when(_any(t, ["metric", "evaluation", "result", "experiment"]), "Metric")
        .when(_any(t, ["task", "problem"]), "Task")
    )


def cluster_type(entity_type: Column) -> Column:
    return F.when(entity_type == "Method", "method_family").when(entity_type == "Dataset", "benchmark_suite").otherwise("concept_cluster")


def source_of_path(path: Column) -> Column:
    p = F.lower(path)
    return F.when(_any(p, ["arxiv", "article_catalog"]), "arxiv").when(p.contains("textbook"), "textbook").when(p.contains("stanford"), "stanford").when(p.contains("openalex"), "openalex")


def domain_of_path(path: Column, multi_dash: tuple[str, ...] = ("cond-mat", "astro-ph", "q-bio", "q-fin")) -> Column:
    """The category named by the segment after arxiv/: a-b becomes a.B, known prefixes with a dash keep their suffix's case."""
    seg = F.regexp_extract(path, "(?:^|/)arxiv/([^/]+)", 1)
    known = F.coalesce(*[F.when(seg == p, F.lit(p)).when(seg.startswith(p + "-"), F.concat(F.lit(p + "."), F.substring(seg, len(p) + 2, 2**31 - 1))) for p in multi_dash])
    plain = F.when(seg.rlike("^[^-]+-[^-]+$"), F.concat(F.regexp_extract(seg, "^([^-]+)-", 1), F.lit("."), F.upper(F.regexp_extract(seg, "-([^-]+)$", 1)))).otherwise(seg)
    return F.when(seg != "", F.coalesce(known, plain))


def risk_tier(relation: Column, claim: Column) -> Column:
    r, t = F.trim(F.coalesce(relation, F.lit(""))), F.lower(F.coalesce(claim, F.lit("")))
    return (
        F.when(r.isin(CAUSAL_AND_COMPARISON), "high").when(r == "CITES", "medium").when(r.isin(CITATION), "high")
        .when(_any(t, NUMERIC_MARKERS) | _any(t, ["conclusion", "we show", "we prove"]), "high").when(r != "", "medium").otherwise("low")
    )


def problem_type(abstract: Column) -> Column:
    t = F.lower(abstract)
    return F.when(_any(t, ["we propose", "we improve", "we introduce"]), "improvement").when(_any(t, ["we investigate", "we study", "we address"]), "explanation")


def section_role(path: Column) -> Column:
    """The role of a section by its joined headings."""
    t = F.lower(path)
    rules = [("abstract", ["abstract"]), ("introduction", ["introduction"]), ("related_work", ["related work", "background"]), ("method", ["method", "approach", "model"]), ("experiment", ["experiment", "evaluation", "result"]), ("conclusion", ["conclusion", "discussion"]), ("references", ["reference", "bibliography"])]
    out = F.lit("body")
    for role, needles in reversed(rules):
        out = F.when(_any(t, needles), role).otherwise(out)
    return out


def block_type(block: Column) -> Column:
    """reference, table, figure, equation, administrative or paragraph."""
    t = F.trim(block)
    low = F.lower(t)
    return (
        F.when(t.rlike(r"^\[[0-9]+\]") | low.startswith("references"), "reference").when(t.rlike(r"^\|.*\|") | low.startswith("table "), "table")
        .when(t.startswith("![") | low.rlike(r"^fig(ure|\.) ?[0-9]"), "figure").when(t.startswith("$$") | t.startswith("\\begin{equation"), "equation")
        .when(_any(low, ["all rights reserved", "acknowledg", "copyright"]), "administrative").otherwise("paragraph")
    )


def chunk_route(kind: Column, role: Column) -> Column:
    """(route, state, refusal) of a block."""
    refused = kind.isin("reference", "administrative")
    return F.struct(
        F.when(kind == "table", "table").when(kind == "figure", "figure").when(kind == "equation", "formula").when(refused, "none").otherwise("text").alias("route"),
        F.when(refused, "refused").when(role == "references", "refused").otherwise("ready").alias("state"),
        F.when(kind == "reference", "reference_block").when(kind == "administrative", "administrative_block").when(role == "references", "reference_section").alias("refusal"),
    )


def metric_value(metric: Column, surface: Column) -> Column:
    """The number after a metric's name, its blanks, =, :, o and f."""
    at = F.instr(F.lower(surface), F.lower(metric))
    tail = F.substring(surface, at + F.length(metric), F.lit(2**31 - 1))
    return F.when((at > 0) & tail.rlike(r"^[\s=:of]*[0-9]"), F.regexp_extract(tail, r"^[\s=:of]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))
