"""Scores, rates and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a category for the preference score.
TOPIC_WEIGHTS = {"cs.SI": 1.5, "cs.KG": 1.5, "cs.IR": 1.3, "cs.CL": 1.3, "cs.AI": 1.2, "cs.LG": 1.0, "cs.CV": 1.0, "cs.NE": 1.0, "cs.ML": 0.9, "cs.DB": 0.9, "cs.DS": 0.9}
#: Weights of a paper's score.
WEIGHTS = {"citations": 0.0, "recency": 0.30, "novelty": 0.30, "preference": 0.25, "graph_bridge": 0.15}


def bounded(x: Column) -> Column:
    """Within 0 and 1; what is no number counts as 1."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 1.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def recency(published: Column, as_of: Column) -> Column:
    d = F.datediff(as_of, published)
    return F.when(d <= 0, 10.0).when(d == 1, 8.0).when(d <= 3, 5.0).when(d <= 7, 2.0).otherwise(0.5)


def citations(count: Column) -> Column:
    return F.coalesce(F.least(count / 100.0, F.lit(1.0)) * 10.0, F.lit(0.0))


def novelty(n_keywords: Column) -> Column:
    return F.least(n_keywords, F.lit(10)) * 0.5


def preference(categories: Column) -> Column:
    weight = F.create_map(*[x for k, v in TOPIC_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.array_max(F.transform(categories, lambda c: F.coalesce(F.try_element_at(weight, c), F.lit(0.5)))), F.lit(0.5))


def total(recency_: Column, novelty_: Column, preference_: Column, citations_: Column | None = None) -> Column:
    c = citations_ if citations_ is not None else F.lit(0.0)
    return c * WEIGHTS["citations"] + recency_ * WEIGHTS["recency"] + novelty_ * WEIGHTS["novelty"] + preference_ * WEIGHTS["preference"]


def fused(vector: Column, graph: Column, vector_weight: float = 0.7) -> Column:
    return vector_weight * F.coalesce(vector, F.lit(0.0)) + (1 - vector_weight) * F.coalesce(graph, F.lit(0.0))


def recommended(similarity: Column, rank: Column) -> Column:
    return 0.8 * similarity + 0.2 * F.least(F.coalesce(rank, F.lit(0.0)), F.lit(5.0)) / 5.0


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, and `empty` where the whole is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) within 0 and 1, both 0 where n is not positive."""
    p, zz = hits / n, z * z
    mid, half, d = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    low, high = F.greatest((mid - half) / d, F.lit(0.0)), F.least((mid + half) / d, F.lit(1.0))
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def gate(metrics: dict[str, tuple[Column, float, float]], limits: dict[str, tuple[Column, float]]) -> Column:
    """proceed, repair or stop: metrics have (value, proceed at, repair at); limits (value, at most)."""
    within = repair = F.lit(True)
    for value, high, low in metrics.values():
        within, repair = within & (value >= high), repair & (value >= low)
    for value, most in limits.values():
        within = within & (value <= most)
    return F.when(within, "proceed").when(repair, "repair").otherwise("stop")
