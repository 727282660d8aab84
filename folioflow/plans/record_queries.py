"""Vectors and hybrid retrieval, evaluation, bi-temporal facts, validation, repair, scheduling and scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, temporal
from ..operators import evaluation as E
from ..operators import lifecycle as L
from ..operators import retrieval as R
from .base import GRAPH_SQL, STRIDE, edges, nodes, query, table

WITH = f"WITH {GRAPH_SQL}"
QUERY = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {_V} SELECT vec_id AS id, round(list_cosine_similarity(e, {_Q}), 6) AS score FROM v ORDER BY list_cosine_similarity(e, {_Q}) DESC, vec_id LIMIT 10")
def vector_top_k_cosine(spark, d):
    return _rounded(R.top_k(table(spark, d, "embeddings"), QUERY, 10))


@query(f"WITH {_V} SELECT vec_id AS id, round(-list_distance(e, {_Q}), 6) AS score FROM v ORDER BY list_distance(e, {_Q}), vec_id LIMIT 10")
def vector_top_k_l2(spark, d):
    return _rounded(R.top_k(table(spark, d, "embeddings"), QUERY, 10, "l2"))


@query(f"WITH {_V} SELECT vec_id AS id, round(list_inner_product(e, {_Q}), 6) AS score FROM v ORDER BY list_inner_product(e, {_Q}) DESC, vec_id LIMIT 10")
def vector_top_k_dot(spark, d):
    return _rounded(R.top_k(table(spark, d, "embeddings"), QUERY, 10, "dot"))


@query(f"""WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.e, q.e) AS score FROM v, v q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def vector_search_many(spark, d):
    v = table(spark, d, "embeddings")
    return _rounded(R.top_k_join(v.where("vec_id % 50 = 0"), v, 5))


_HYBRID = f"""WITH {_V}, a AS (SELECT vec_id AS id, list_cosine_similarity(e, {_Q}) AS vs FROM v WHERE list_cosine_similarity(e, {_Q}) > 0 ORDER BY vs DESC, vec_id LIMIT 50),
g AS (SELECT doc_id AS id, max(quality::DOUBLE) AS gs FROM labels GROUP BY 1)
SELECT id, round(vs, 6) AS vector_score, round(gs, 6) AS graph_score, round(0.7 * coalesce(vs, 0) + 0.3 * coalesce(gs, 0), 6) AS fusion,
  CASE WHEN vs IS NOT NULL AND gs IS NOT NULL THEN 'both' WHEN vs IS NOT NULL THEN 'vector' ELSE 'graph' END AS candidate_source
FROM a {{}} JOIN g USING (id) ORDER BY 0.7 * coalesce(vs, 0) + 0.3 * coalesce(gs, 0) DESC, id LIMIT 20"""


def _hybrid(spark, d, mode):
    v = R.top_k(table(spark, d, "embeddings"), QUERY, 50, positive=True)
    g = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    out = R.hybrid(v, g, mode, 20)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("vector_score", "graph_score", "fusion")], "candidate_source")


@query(_HYBRID.format("FULL"))
def hybrid_retrieval(spark, d):
    return _hybrid(spark, d, "hybrid")


@query(f"""WITH {_V}, a AS (SELECT vec_id AS id, list_cosine_similarity(e, {_Q}) AS vs FROM v WHERE list_cosine_similarity(e, {_Q}) > 0 ORDER BY vs DESC, vec_id LIMIT 50)
SELECT id, round(vs, 6) AS vector_score, NULL::DOUBLE AS graph_score, round(0.7 * vs, 6) AS fusion, 'vector' AS candidate_source FROM a ORDER BY 0.7 * vs DESC, id LIMIT 20""")
def hybrid_vector_only(spark, d):
    return _hybrid(spark, d, "vector_only")


@query(f"""WITH {_V}, r AS (SELECT doc_id, max(quality) * 5.0 + max(toxic) AS pr FROM labels GROUP BY 1)
SELECT vec_id AS id, round(0.8 * list_cosine_similarity(e, {_Q}) + 0.2 * least(coalesce(pr, 0), 5) / 5, 6) AS score FROM v LEFT JOIN r ON vec_id = doc_id
ORDER BY 0.8 * list_cosine_similarity(e, {_Q}) + 0.2 * least(coalesce(pr, 0), 5) / 5 DESC, vec_id LIMIT 15""")
def paper_recommendation(spark, d):
    r = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") * 5.0 + F.max("toxic")).alias("rank"))
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(r, "id", "left")
    return _rounded(R.recommend(p, QUERY, 15))


@query("""WITH a AS (SELECT c_nationkey AS vid, max(c_acctbal) / 10000 * 0.3 AS s FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS vid, max(s_acctbal) / 10000 * 0.4 AS s FROM supplier GROUP BY 1),
c AS (SELECT n_nationkey AS vid, max(n_regionkey / 4.0) * 0.3 AS s FROM nation GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT vid, round(sum(s), 6) AS score FROM u GROUP BY vid ORDER BY sum(s) DESC, vid LIMIT 10""")
def tri_source_fusion(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("vid"), (F.col("c_acctbal") / 10000).alias("score"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("vid"), (F.col("s_acctbal") / 10000).alias("score"))
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("vid"), (F.col("n_regionkey") / 4.0).alias("score"))
    return _rounded(R.tri_source(a, b, c))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::BIGINT AS rank FROM part")
def rank_records(spark, d):
    return R.ranked(table(spark, d, "part"), "p_partkey", "p_retailprice").select("p_partkey", F.col("rank").cast("long").alias("rank"))


def _gold_pred(spark, d):
    gold = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("good").alias("label"), F.lit("Quality").alias("entity_type"))
    pred = table(spark, d, "documents").where("n_chars >= 300").select("doc_id", F.lit("good").alias("label"), F.lit("Quality").alias("entity_type"))
    return gold, pred


_EXACT = """g AS (SELECT doc_id, count(*) AS gold FROM labels WHERE quality = 1 GROUP BY 1), p AS (SELECT doc_id, count(*) AS predicted FROM documents WHERE n_chars >= 300 GROUP BY 1),
t AS (SELECT p.doc_id, p.predicted AS tp FROM p JOIN g USING (doc_id)),
j AS (SELECT doc_id, coalesce(predicted, 0) AS predicted, coalesce(gold, 0) AS gold, coalesce(tp, 0) AS tp FROM p FULL JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS pr, CASE WHEN gold > 0 THEN tp / gold::DOUBLE ELSE 1 END AS rc FROM j),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)"""


@query(f"WITH {_EXACT} SELECT doc_id, tp::BIGINT AS tp, predicted::BIGINT AS predicted, gold::BIGINT AS gold, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM f")
def exact_evaluation(spark, d):
    out = E.exact(*_gold_pred(spark, d))
    return out.select("doc_id", "tp", "predicted", "gold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_EXACT}, s AS (SELECT sum(tp) AS tp, sum(predicted) AS predicted, sum(gold) AS gold, avg(pr) AS mp, avg(rc) AS mr, avg(f1) AS mf FROM f)
SELECT tp::BIGINT AS tp, predicted::BIGINT AS predicted, gold::BIGINT AS gold, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1,
  round(tp / predicted, 6) AS micro_precision, round(tp / gold, 6) AS micro_recall, round(2 * (tp / predicted) * (tp / gold) / (tp / predicted + tp / gold), 6) AS micro_f1 FROM s""")
def corpus_summary(spark, d):
    s = E.corpus_summary(E.exact(*_gold_pred(spark, d)))
    return s.select("tp", "predicted", "gold", *[F.round(c, 6).alias(c) for c in s.columns if c.startswith(("macro", "micro"))])


@query()
def fuzzy_evaluation(spark, d):
    p = table(spark, d, "part")
    gold = p.select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("label"), F.col("p_brand").alias("entity_type"))
    pred = p.where("p_size > 20").select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_partkey").alias("ord"), F.upper("p_type").alias("label"), F.col("p_brand").alias("entity_type"))
    return E.fuzzy(gold, pred)


@query("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), p AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 300),
s AS (SELECT count(CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN g.doc_id IS NULL THEN 1 END) AS fp, count(CASE WHEN p.doc_id IS NULL THEN 1 END) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM s""")
def count_metrics(spark, d):
    g, p = _gold_pred(spark, d)
    return E.counted(g, p, ["doc_id"]).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH s AS (SELECT lang, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round(greatest((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 0), 6) AS low,
  round(least((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 1), 6) AS high FROM s""")
def wilson_interval(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    return s.select("lang", scores.wilson(F.col("k"), F.col("n")).alias("w")).select("lang", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def _question(spark, d):
    o = table(spark, d, "orders")
    e = o.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 20).alias("question"), F.col("o_orderkey").alias("id"))
    return e, o.where("o_totalprice > 150000").select((F.col("o_custkey") % 20).alias("question"), F.col("o_orderkey").alias("id"))


@query("""WITH e AS (SELECT DISTINCT o_custkey % 20 AS q, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey % 20 AS q, o_orderkey AS id FROM orders WHERE o_totalprice > 150000),
j AS (SELECT coalesce(e.q, r.q) AS q, e.id AS ei, r.id AS ri FROM e FULL JOIN r ON e.q = r.q AND e.id = r.id)
SELECT q AS question, count(CASE WHEN ei IS NOT NULL AND ri IS NOT NULL THEN 1 END)::INT AS hits, count(CASE WHEN ri IS NULL THEN 1 END)::INT AS missing, count(CASE WHEN ei IS NULL THEN 1 END)::INT AS unexpected, 0::BIGINT AS duplicates,
  round(CASE WHEN count(ei) > 0 THEN count(CASE WHEN ei IS NOT NULL AND ri IS NOT NULL THEN 1 END) / count(ei)::DOUBLE ELSE CASE WHEN count(ri) = 0 THEN 1 ELSE 0 END END, 6) AS recall FROM j GROUP BY q""")
def retrieval_recall(spark, d):
    return E.retrieval(*_question(spark, d)).withColumn("recall", F.round("recall", 6))


@query("""SELECT 'missing' AS side, count(*)::BIGINT AS rows FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 150000)
UNION ALL SELECT 'extra', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 EXCEPT ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def projection_parity(spark, d):
    o = table(spark, d, "orders")
    return E.parity(o.where("o_orderstatus = 'F'").select("o_orderkey"), o.where("o_totalprice > 150000").select("o_orderkey"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events), p(point) AS (VALUES (0.5), (0.95), (0.99))
SELECT event_type, point::DOUBLE AS point, value FROM r, p WHERE r = greatest(ceil(n * point::DOUBLE), 1)""")
def nearest_rank_percentiles(spark, d):
    return E.nearest_rank(table(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS ties FROM (SELECT count(*) AS n FROM part GROUP BY p_retailprice)")
def ranking_ties(spark, d):
    return E.ties(table(spark, d, "part"), "p_retailprice")


@query("""WITH b AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), t AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT metric, round(t.v - b.v, 4) AS delta FROM b JOIN t USING (metric)""")
def metric_deltas(spark, d):
    o = table(spark, d, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    return E.metric_deltas(side("F"), side("O")).withColumn("delta", F.round("delta", 4))


@query("""SELECT lang, CASE WHEN avg(quality) >= 0.5 AND avg(toxic) <= 0.3 THEN 'proceed' WHEN avg(quality) >= 0.2 THEN 'repair' ELSE 'stop' END AS verdict FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def retrieval_gate(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    return s.select("lang", scores.gate({"recall": (F.col("q"), 0.5, 0.2)}, {"failure": (F.col("t"), 0.3)}).alias("verdict"))


_FACT_SQL = "f AS (SELECT event_id, user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"


def _facts(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


@query(f"WITH {_FACT_SQL} SELECT event_id FROM f WHERE (valid_from <= TIMESTAMP '2024-01-15') AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)")
def bitemporal_active_at(spark, d):
    at = F.lit("2024-01-15").cast("timestamp_ntz") if dict(table(spark, d, "events").dtypes)["ts"] == "timestamp_ntz" else F.lit("2024-01-15").cast("timestamp")
    return _facts(spark, d).where(temporal.is_active_at(F.col("valid_from"), F.col("valid_to"), at)).select("event_id")


@query(f"""WITH {_FACT_SQL} SELECT event_type, count(CASE WHEN valid_from >= valid_to THEN 1 END)::BIGINT AS inverted, count(CASE WHEN valid_to IS NULL THEN 1 END)::BIGINT AS open FROM f GROUP BY event_type""")
def bitemporal_validate(spark, d):
    none = F.lit(None).cast("timestamp")
    issues = temporal.bitemporal_issues(F.col("valid_from"), F.col("valid_to"), none, none)
    return _facts(spark, d).withColumn("i", issues).groupBy("event_type").agg(F.count(F.when(F.array_contains("i", "valid_range_inverted"), 1)).alias("inverted"), F.count(F.when(F.col("valid_to").isNull(), 1)).alias("open"))


@query(f"""WITH {_FACT_SQL}, p AS (SELECT event_type, valid_from AS ov, valid_to AS oi, lead(valid_from) OVER w AS nv, lead(valid_to) OVER w AS ni FROM f WINDOW w AS (PARTITION BY user_id ORDER BY valid_from, event_id))
SELECT CASE WHEN oi <= nv THEN 'skip_old_already_invalid' WHEN ni <= ov THEN 'skip_new_was_invalid' WHEN ov < nv THEN 'supersede' ELSE 'retain_both' END AS rule, count(*)::BIGINT AS n FROM p WHERE nv IS NOT NULL GROUP BY 1""")
def temporal_edge_resolution(spark, d):
    w = Window.partitionBy("user_id").orderBy("valid_from", "event_id")
    p = _facts(spark, d).select("valid_from", "valid_to", F.lead("valid_from").over(w).alias("nv"), F.lead("valid_to").over(w).alias("ni")).where("nv IS NOT NULL")
    return p.groupBy(temporal.edge_resolution(F.col("valid_from"), F.col("valid_to"), F.col("nv"), F.col("ni")).alias("rule")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(least(86400 * pow(3, p_size % 8), 2592000) AS BIGINT) AS delay, p_size % 12 >= 10 AS given_up FROM part")
def retry_backoff(spark, d):
    return table(spark, d, "part").select("p_partkey", temporal.backoff_seconds(F.col("p_size") % 8).alias("delay"), (F.col("p_size") % 12 >= temporal.MAX_RETRIES).alias("given_up"))


@query("SELECT event_id FROM events WHERE event_type = 'error' AND epoch(ts)::BIGINT + 86400 <= epoch(TIMESTAMP '2024-01-20')::BIGINT")
def scheduler_due(spark, d):
    t = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.lit("pending").alias("status"), (temporal.epoch_seconds(F.col("ts")) + temporal.DAY).alias("next_retry"))
    return L.due(t, temporal.epoch_seconds(F.lit("2024-01-20 00:00:00"))).select("event_id")


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 25")
def queue_claim(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "ready").otherwise("done").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("long").alias("retry_after"), F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("long").alias("lease_until"), F.lit(0).alias("attempt_count"))
    return L.claim(o, "worker-1", F.lit(1_700_000_000).cast("long"), 600, 25).where("status = 'leased'").select("job_id")


@query("""SELECT o_orderkey, round(0.30 * CASE WHEN dd <= 0 THEN 10 WHEN dd = 1 THEN 8 WHEN dd <= 3 THEN 5 WHEN dd <= 7 THEN 2 ELSE 0.5 END + 0.30 * least(o_orderkey % 15, 10) * 0.5 + 0.25 * 0.5, 6) AS score
FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1995-06-17') AS dd FROM orders)""")
def paper_scores(spark, d):
    r = scores.recency(F.col("o_orderdate").cast("date"), F.lit("1995-06-17").cast("date"))
    s = scores.total(r, scores.novelty(F.col("o_orderkey") % 15), scores.preference(F.array(F.lit("other"))))
    return table(spark, d, "orders").select("o_orderkey", F.round(s, 6).alias("score"))


@query("SELECT o_orderkey, round(10 * least(o_totalprice / 1000 / 100, 1), 6) AS score FROM orders")
def citation_scores(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(scores.citations(F.col("o_totalprice") / 1000), 6).alias("score"))


def _contracts(spark):
    return spark.createDataFrame([("PLACED", "Customer", ["Order"]), ("CONTAINS", "Order", ["Part", "Document"]), ("SUPPLIED_BY", "Supplier", ["Part"])], "edge_type string, source string, targets array<string>")


@query(f"{WITH} SELECT edge_type, 'wrong_source' AS code, count(*)::BIGINT AS n FROM edges WHERE edge_type = 'SUPPLIED_BY' GROUP BY 1 HAVING count(*) > 0")
def edge_contracts(spark, d):
    """SUPPLIED_BY is declared the wrong way round here, so all its edges break their contract."""
    return L.edge_violations(nodes(spark, d), edges(spark, d), _contracts(spark)).groupBy("edge_type", "code").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT node_id FROM nodes WHERE label = 'Order' AND node_id % 3 = 0")
def cross_references(spark, d):
    """Every third order names a problem that isn't there."""
    n = nodes(spark, d).where("label = 'Order'").select("node_id", F.lit("Claim").alias("label"), "vid", F.when(F.col("node_id") % 3 == 0, F.create_map(F.lit("source_span_id"), F.lit("gone"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))).alias("props"))
    return L.broken_references(n, [r for r in L.REFERENCES if r[0] == "Claim"]).select("node_id")


@query("""SELECT node_id, severity, code, field FROM (
  SELECT c_custkey AS node_id, 'critical' AS severity, 'missing_required' AS code, 'title' AS field FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT c_custkey, 'warning', 'type_mismatch', 'level' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 'warning', 'undeclared_field', 'extra' FROM customer
  UNION ALL SELECT c_custkey, 'critical', 'invariant', unnest(['import_eligible', 'retrieval_eligible', 'schema_version']) FROM customer)""")
def validate_nodes(spark, d):
    p = F.create_map(F.lit("vid"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")), F.lit("extra"), F.lit("1"), F.lit("level"), F.when(F.col("c_custkey") % 5 == 0, "high").otherwise("1"))
    p = F.when(F.col("c_custkey") % 4 == 0, p).otherwise(F.map_concat(p, F.create_map(F.lit("title"), F.col("c_name"))))
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.lit("Section").alias("label"), p.alias("props"))
    schema = spark.createDataFrame([("Section", "vid", "string", True), ("Section", "title", "string", True), ("Section", "level", "int", True)], "label string, field string, kind string, required boolean")
    return L.validate_nodes(n, schema)


def _healable(spark, d):
    return nodes(spark, d).where("label = 'Part'").withColumn("deprecated_reason", F.lit(None).cast("string")).withColumn("superseded_by", F.lit(None).cast("string"))


@query(f"{WITH} SELECT vid, node_id > {3 * STRIDE + 10} AS retrieval_eligible, CASE WHEN node_id <= {3 * STRIDE + 10} THEN 'noise' END AS deprecated_reason FROM nodes WHERE label = 'Part'")
def heal_silence(spark, d):
    n = _healable(spark, d)
    out, _ = L.silence(n, n.where(F.col("node_id") <= 3 * STRIDE + 10).select("vid"), "noise", "user:editor", "2024-01-01")
    return out.select("vid", "retrieval_eligible", "deprecated_reason")


@query(f"{WITH} SELECT edge_type, count(*)::BIGINT + CASE WHEN edge_type = 'CONTAINS' THEN (SELECT count(*) FROM edges WHERE edge_type = 'CONTAINS' AND dst = {3 * STRIDE + 2}) ELSE 0 END AS n FROM edges GROUP BY 1 UNION ALL SELECT 'SUPERSEDES', 1")
def heal_merge(spark, d):
    pairs = spark.createDataFrame([("Part:2", "Part:3")], "merged string, keep string")
    _, e = L.merge(_healable(spark, d), edges(spark, d), pairs)
    return e.groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT vid, CASE WHEN vid = 'Part:1' THEN 'fixed' END AS deprecated_reason FROM nodes WHERE label = 'Part'")
def heal_correct(spark, d):
    out, _ = L.correct(_healable(spark, d), "Part:1", "deprecated_reason", "fixed", "wrong", "user:editor", "2024-01-01")
    return out.select("vid", "deprecated_reason")


@query("SELECT c_nationkey AS key, min(c_custkey) AS first_id FROM customer WHERE c_nationkey >= 5 GROUP BY 1 UNION ALL SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey < 5 AND c_custkey <= 30")
def upsert_by_key(spark, d):
    from ..operators.extraction import upsert

    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("first_id"))
    old = rows.where("key < 5 AND first_id <= 30")
    missing = rows.where("key >= 5")
    return upsert(old, missing, "key", ["first_id"])
