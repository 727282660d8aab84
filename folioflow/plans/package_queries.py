"""Record evaluation, evidence and navigation, catalogs, summaries and spans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.text import slugify
from ..operators import graph as G
from ..operators import packages as P
from ..operators import retrieval as R
from .base import GRAPH_SQL, STRIDE, edges, nodes, query, table

WITH = f"WITH {GRAPH_SQL}"

# Orders are cases; their parts are gold entities and their suppliers gold relations. Predicted are the lines of more than
# five pieces, and 900000 + quantity where the line is returned.
_RECORDS = """gold AS (SELECT DISTINCT l_orderkey AS case_id, 'entity' AS kind, l_partkey AS key FROM lineitem UNION SELECT DISTINCT l_orderkey, 'relation', l_suppkey FROM lineitem),
pred AS (SELECT l_orderkey AS case_id, 'entity' AS kind, CASE WHEN l_returnflag = 'R' THEN 900000 + l_linenumber ELSE l_partkey END AS key, l_tax > 0 AS evidence FROM lineitem WHERE l_quantity > 5
  UNION ALL SELECT l_orderkey, 'relation', l_suppkey, l_discount > 0 FROM lineitem WHERE l_quantity > 25),
made AS (SELECT o_orderkey AS case_id, o_orderstatus <> 'P' AS schema_valid, o_totalprice > 1000 AS json_valid, o_totalprice AS cost, o_custkey::DOUBLE AS latency, o_custkey % 3 AS retries FROM orders WHERE o_orderkey % 7 <> 0),
known AS (SELECT DISTINCT case_id FROM gold), p AS (SELECT DISTINCT case_id, kind, key FROM pred WHERE case_id IN (SELECT case_id FROM known)),
c AS (SELECT kind, (SELECT count(*) FROM p WHERE p.kind = k.kind) AS np, (SELECT count(*) FROM gold g WHERE g.kind = k.kind) AS ng, (SELECT count(*) FROM p JOIN gold g USING (case_id, kind, key) WHERE p.kind = k.kind) AS tp FROM (VALUES ('entity'), ('relation')) k(kind)),
s AS (SELECT kind, tp / np::DOUBLE AS pr, tp / ng::DOUBLE AS rc FROM c)"""


def _records(spark, d):
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    gold = line.select(F.col("l_orderkey").alias("case_id"), F.lit("entity").alias("kind"), F.col("l_partkey").alias("key")).union(line.select("l_orderkey", F.lit("relation"), "l_suppkey"))
    key = F.when(F.col("l_returnflag") == "R", 900000 + F.col("l_linenumber")).otherwise(F.col("l_partkey"))
    pred = line.where("l_quantity > 5").select(F.col("l_orderkey").alias("case_id"), F.lit("entity").alias("kind"), key.alias("key"), (F.col("l_tax") > 0).alias("evidence"))
    pred = pred.union(line.where("l_quantity > 25").select("l_orderkey", F.lit("relation"), "l_suppkey", F.col("l_discount") > 0))
    none = F.lit(None)
    cases = gold.select("case_id", F.lit("gold").alias("role"), none.cast("boolean").alias("schema_valid"), none.cast("boolean").alias("json_valid"), none.cast("double").alias("cost"), none.cast("double").alias("latency"), none.cast("long").alias("retries")).distinct()
    made = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.lit("predicted"), F.col("o_orderstatus") != "P", F.col("o_totalprice") > 1000, "o_totalprice", F.col("o_custkey").cast("double"), F.col("o_custkey") % 3)
    return gold, pred, cases.union(made)


@query(f"""WITH {_RECORDS} SELECT round(e.pr, 6) AS entity_precision, round(e.rc, 6) AS entity_recall, round(2 * e.pr * e.rc / (e.pr + e.rc), 6) AS entity_f1,
round(r.pr, 6) AS relation_precision, round(r.rc, 6) AS relation_recall, round(2 * r.pr * r.rc / (r.pr + r.rc), 6) AS relation_f1,
(SELECT round(avg(evidence::INT), 6) FROM pred WHERE case_id IN (SELECT case_id FROM known)) AS evidence_validity, m.*,
(SELECT count(*) FROM known WHERE case_id NOT IN (SELECT case_id FROM made))::BIGINT AS missing, (SELECT count(*) FROM made WHERE case_id NOT IN (SELECT case_id FROM known))::BIGINT AS extra
FROM (SELECT * FROM s WHERE kind = 'entity') e, (SELECT * FROM s WHERE kind = 'relation') r,
(SELECT round(avg(schema_valid::INT), 6) AS schema_valid_rate, round(avg(json_valid::INT), 6) AS json_valid_rate, round(avg(cost), 3) AS mean_cost, round(avg(latency), 3) AS mean_latency, sum(retries)::BIGINT AS retries FROM made WHERE case_id IN (SELECT case_id FROM known)) m""")
def evaluate_records(spark, d):
    out = P.evaluate_records(*_records(spark, d))
    return out.select(*[F.round(c, 3 if c.startswith("mean") else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("""WITH r AS (SELECT user_id AS question, event_type AS mode, event_id % 40 AS id FROM events GROUP BY ALL), e AS (SELECT user_id AS question, event_id % 40 AS id FROM events WHERE value > 50 GROUP BY ALL),
m AS (SELECT DISTINCT mode FROM r), j AS (SELECT * FROM (SELECT question, mode, id, 1 AS e FROM e, m) FULL JOIN (SELECT *, 1 AS r FROM r) USING (question, mode, id)), g AS (SELECT question, mode, count(r) AS returned, count(CASE WHEN r = 1 AND e = 1 THEN 1 END) AS hits, count(e) AS n FROM j GROUP BY 1, 2)
SELECT question, mode, returned::BIGINT AS returned, hits::BIGINT AS hits, (n - hits)::BIGINT AS missing, round(CASE WHEN n > 0 THEN hits / n::DOUBLE WHEN returned = 0 THEN 1 ELSE 0 END, 6) AS recall FROM g""")
def retrieval_ablations(spark, d):
    e = table(spark, d, "events")
    returned, expected = e.select(F.col("user_id").alias("question"), F.col("event_type").alias("mode"), (F.col("event_id") % 40).alias("id")), e.where("value > 50").select(F.col("user_id").alias("question"), (F.col("event_id") % 40).alias("id"))
    return P.retrieval_ablations(returned, expected).withColumn("recall", F.round("recall", 6))


@query("""SELECT event_type AS policy, count(*)::BIGINT AS runs, round(sum(event_id % 3) / sum(event_id % 3 + 1)::DOUBLE, 6) AS recall, round(avg((value > 20)::INT), 6) AS evidence_correctness, round(avg((value > 90)::INT), 6) AS failure_rate FROM events GROUP BY 1""")
def policy_scores(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("policy"), (F.col("event_id") % 3).alias("hits"), (F.col("event_id") % 3 + 1).alias("expected"), (F.col("value") > 20).alias("evidence_ok"), (F.col("value") > 90).alias("failed"))
    return P.policy_scores(e).select("policy", "runs", *[F.round(c, 6).alias(c) for c in ("recall", "evidence_correctness", "failure_rate")])


# Chunks are parts, evidence paths are lines (some of their pages, the orders, are left out as broken), pages are orders.
_EVIDENCE = "e AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS chunk_id, CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS page_id FROM lineitem)"


def _evidence(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_partkey").alias("chunk_id"), F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("page_id"))


@query(f"WITH {_EVIDENCE} SELECT chunk_id, max(evidence_id) AS evidence_id, arg_max(page_id, evidence_id) AS page_id FROM e GROUP BY chunk_id")
def evidence_paths_by_chunk(spark, d):
    return P.evidence_paths_by_chunk(_evidence(spark, d))


@query(f"""WITH {_EVIDENCE}, c AS (SELECT p_partkey AS chunk_id FROM part UNION ALL SELECT -1 - n_nationkey FROM nation) SELECT count(*)::BIGINT AS evidence_paths, (SELECT count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM e))::BIGINT AS orphan_chunks,
(SELECT count(*) FROM e WHERE page_id NOT IN (SELECT o_orderkey FROM orders) OR chunk_id NOT IN (SELECT chunk_id FROM c))::BIGINT AS broken_paths, (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY evidence_id HAVING count(*) > 1))::BIGINT AS duplicate_ids FROM e""")
def integrity_scan(spark, d):
    """Chunks are the parts and, without evidence, the nations."""
    chunks = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id")).union(table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long")))
    return P.integrity_scan(_evidence(spark, d), chunks, table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id")))


@query("""WITH x AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer), j AS (SELECT a.c_custkey AS chunk_id, b.c_custkey AS neighbour, row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_custkey) AS rank
  FROM customer a JOIN x b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey WHERE a.c_custkey % 50 = 0 AND b.k <= 6) SELECT chunk_id, neighbour, rank::INT AS rank FROM j WHERE rank <= 5""")
def same_paper_neighbours(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("paper_id"))
    return P.same_paper_neighbours(c, c.where("chunk_id % 50 = 0").select("chunk_id"))


@query("""SELECT o_custkey AS candidate, kind, count(DISTINCT value)::BIGINT AS n FROM (SELECT o_custkey, 'status' AS kind, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, 'priority', o_orderpriority FROM orders) GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def conflicting_signals(spark, d):
    o = table(spark, d, "orders")
    return P.conflicting_signals(o.select(F.col("o_custkey").alias("candidate"), F.lit("status").alias("kind"), F.col("o_orderstatus").alias("value")).union(o.select("o_custkey", F.lit("priority"), "o_orderpriority")))


@query("SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'blocked' ELSE 'matched' END AS state FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def catalog_reconciliation(spark, d):
    catalog = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("blocked"))
    chosen = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    c = P.catalog_reconciliation(chosen.select("id").distinct(), catalog)
    return chosen.join(c, "id").select(F.col("o_orderkey").alias("id"), "state")


def _graph_parts(spark, d):
    """Suppliers as claims, parts as entities, lines as relations between their part and supplier, each with an evidence path."""
    s, p, line = (table(spark, d, t) for t in ("supplier", "part", "lineitem"))
    claims = s.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("text"), (F.col("s_acctbal") / 5000).alias("confidence"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("evidence_id"))
    entities = p.select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), (F.col("p_size") / 40).alias("confidence"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("evidence_id"))
    ref = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    relations = line.select(F.concat_ws("-", F.lit("r"), "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("relation_type"), ref("e", "l_partkey").alias("source_id"), ref("c", "l_suppkey").alias("target_id"), (F.col("l_quantity") / 40).alias("confidence"), ref("p", "l_partkey").alias("evidence_id"))
    evidence = p.select(ref("p", "p_partkey").alias("id"), ref("chunk", "p_partkey").alias("semantic_chunk_id"))
    return claims, entities, relations, evidence


_PARTS = """claims AS (SELECT 'c' || s_suppkey AS id, s_name AS text, s_acctbal / 5000 AS confidence, 'p' || s_suppkey AS ev FROM supplier), entities AS (SELECT 'e' || p_partkey AS id, p_name AS text, p_size / 40 AS confidence, 'p' || p_partkey AS ev FROM part),
relations AS (SELECT 'r-' || l_orderkey || '-' || l_linenumber AS id, l_returnflag AS text, 'e' || l_partkey AS s, 'c' || l_suppkey AS t, l_quantity / 40 AS confidence, 'p' || l_partkey AS ev FROM lineitem), seeds AS (
SELECT 'chunk' || p_partkey AS chunk_id, id AS ref_id, kind, round(least(greatest(confidence, 0), 1), 6) AS score FROM (SELECT id, text, confidence, ev, 'claim' AS kind FROM claims UNION ALL SELECT *, 'entity' FROM entities UNION ALL SELECT id, text, confidence, ev, 'relation' FROM relations) x JOIN part ON ev = 'p' || p_partkey
WHERE contains(lower(text), 'r') ORDER BY least(greatest(confidence, 0), 1) DESC, id LIMIT 40), lineage AS (
SELECT r.id AS ref_id, e.id AS end_id, round(least(greatest(r.confidence, 0), 1) * 0.9, 6) AS score FROM relations r JOIN (SELECT id, text FROM claims UNION ALL SELECT id, text FROM entities) e ON e.id IN (r.s, r.t) WHERE contains(lower(e.text), '1') ORDER BY least(greatest(r.confidence, 0), 1) DESC, r.id, e.id LIMIT 40)"""


@query(f"WITH {_PARTS} SELECT * FROM seeds")
def seed_match(spark, d):
    return R.seed_match(*_graph_parts(spark, d), "R", 40).withColumn("score", F.round("score", 6))


def _lineage(spark, d):
    claims, entities, relations, _ = _graph_parts(spark, d)
    return R.lineage_expand(relations, claims.select("id", "text").union(entities.select("id", F.col("label"))), "1", 40).withColumn("score", F.round("score", 6))


@query(f"WITH {_PARTS} SELECT * FROM lineage")
def lineage_expand(spark, d):
    """Relations with an end whose name holds a 1 (O2, the lineage of a seed)."""
    return _lineage(spark, d)


@query(f"""WITH {_PARTS}, x AS (SELECT ref_id, score, 0 AS part FROM seeds WHERE kind = 'claim' UNION ALL SELECT ref_id, score, 1 FROM seeds WHERE kind <> 'claim'), t AS (SELECT * FROM x ORDER BY part, score DESC, ref_id LIMIT 5)
SELECT ref_id, score, 'multi_match:' || (SELECT count(*) FROM t) AS ambiguity FROM t""")
def resolve_seed(spark, d):
    """O1: claims first, then what else the seed finds."""
    m = seed_match(spark, d)
    return P.resolve_seed(m.where("kind = 'claim'"), m.where("kind <> 'claim'"), 5)


@query(f"""WITH {_PARTS}, x AS (SELECT ref_id, 0 AS part, score FROM seeds UNION ALL SELECT ref_id, 1, max(score) FROM lineage GROUP BY 1) SELECT ref_id, min(part)::INT AS part, arg_min(score, part) AS score FROM x GROUP BY ref_id""")
def topic_neighbourhood(spark, d):
    """O4: what the seed finds and its lineage, each reference once."""
    return P.first_per_ref([seed_match(spark, d).select("ref_id", "score"), _lineage(spark, d).select("ref_id", "score")])


@query(f"""WITH {_EVIDENCE}, c AS (SELECT p_partkey AS chunk_id FROM part UNION ALL SELECT -1 - n_nationkey FROM nation), refs AS (SELECT o_orderkey AS ref_id, o_custkey AS chunk_id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS ev FROM orders)
SELECT 'gap:missing_chunk:' || c_custkey AS ref_id FROM customer WHERE c_custkey NOT IN (SELECT chunk_id FROM refs)
UNION ALL SELECT 'gap:broken_evidence:' || n FROM (SELECT count(*) AS n FROM e WHERE page_id NOT IN (SELECT o_orderkey FROM orders) OR chunk_id NOT IN (SELECT chunk_id FROM c)) WHERE n > 0
UNION ALL SELECT 'gap:orphan_chunks:' || n FROM (SELECT count(*) AS n FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM e)) WHERE n > 0
UNION ALL SELECT 'gap:unsupported:' || ref_id FROM (SELECT ref_id FROM refs WHERE ev IS NULL ORDER BY ref_id LIMIT 3)""")
def detect_gaps(spark, d):
    """O5: customers without an order are missing; orders that aren't final have no evidence."""
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("chunk_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("evidence_id"))
    return P.detect_gaps(refs, table(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id")), integrity_scan(spark, d))


@query("""WITH a AS (SELECT l_orderkey AS source, l_partkey AS target, l_quantity AS score, 'contains' AS layer, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_quantity) AS k FROM lineitem), b AS (SELECT o_custkey, o_orderkey, o_totalprice, 'placed', row_number() OVER (ORDER BY o_custkey, o_orderkey) FROM orders)
SELECT source, target, score, layer, layer || '-' || k AS evidence_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def layered_manifest(spark, d):
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return P.layered_manifest({"contains": line.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_quantity").alias("score")), "placed": o.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.col("o_totalprice").alias("score"))})


@query("""WITH m AS (SELECT DISTINCT p_brand AS label, l_orderkey AS paper_id FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT label, count(*) AS papers FROM m GROUP BY label),
c AS (SELECT label || ' mentions' AS label, [label] AS members FROM n WHERE papers >= 5 UNION ALL SELECT a.label || ' + ' || b.label, [a.label, b.label] FROM m a JOIN m b ON a.paper_id = b.paper_id AND a.label < b.label GROUP BY a.label, b.label HAVING count(*) >= 3),
k AS (SELECT *, len([x FOR x IN members IF x <> 'Brand#11']) AS found FROM c) SELECT 'vid:hyper:' || trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS vid, label, found::BIGINT AS member_edges, (len(members) - found)::BIGINT AS skipped FROM k""")
def materialise_clusters(spark, d):
    """Clusters of brands; Brand#11 is no node of the graph."""
    from .graph_queries import _mentions

    c = G.clusters(_mentions(spark, d), 5, 3)
    name = F.regexp_replace("label", " mentions$", "")
    members = c.select("label", F.explode(F.split(name, r" \+ ")).alias("member"))
    out = P.materialise_clusters(c.select("label", "members"), members, table(spark, d, "part").where("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("label")).distinct())
    return out.select("vid", "label", "member_edges", F.col("skipped").cast("long").alias("skipped"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, w AS MATERIALIZED (SELECT src, dst, min(CASE WHEN weight > 0 THEN weight ELSE 1 END) AS w FROM edges GROUP BY 1, 2), r(source, node_id, distance) AS (
SELECT node_id, node_id, 0.0::DOUBLE FROM nodes WHERE label = 'Customer' AND node_id % 50 = 0 UNION SELECT r.source, w.dst, r.distance + w.w FROM r JOIN w ON w.src = r.node_id) SELECT source, node_id, min(distance) AS distance FROM r GROUP BY 1, 2""")
def shortest_paths(spark, d):
    """From every customer whose key can be divided by 50."""
    return P.shortest_paths(edges(spark, d), nodes(spark, d).where(F.col("label") == "Customer").where((F.col("node_id") - STRIDE) % 50 == 0).select("node_id"))


@query("""SELECT count(CASE WHEN ok THEN 1 END)::BIGINT AS done, count(CASE WHEN NOT ok THEN 1 END)::BIGINT AS failed, sum(CASE WHEN ok THEN chars END)::BIGINT AS chars, sum(CASE WHEN ok THEN sections END)::BIGINT AS sections, sum(CASE WHEN ok THEN citations END)::BIGINT AS citations
FROM (SELECT n_chars >= 100 AS ok, length(text) AS chars, len(string_split(text, chr(10))) AS sections, doc_id % 5 AS citations FROM documents)""")
def ingest_rollup(spark, d):
    t = F.col("text")
    return P.ingest_rollup(table(spark, d, "documents").select((F.col("n_chars") >= 100).alias("ok"), F.length(t).alias("chars"), F.size(F.split(t, "\n", -1)).alias("sections"), (F.col("doc_id") % 5).alias("citations")))


@query("""SELECT entity_type, count(*)::BIGINT AS labels, count(hit)::BIGINT AS covered FROM (SELECT DISTINCT lower(p_name) AS l, p_brand AS entity_type FROM part) LEFT JOIN (SELECT DISTINCT lower(p_name) AS l, p_brand AS entity_type, 1 AS hit FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49) USING (l, entity_type) GROUP BY 1""")
def whitelist_coverage(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_brand").alias("entity_type"))
    seen = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return P.whitelist_coverage(p, p.join(seen, "p_partkey", "left_semi"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS artifact, l_partkey AS id FROM lineitem WHERE l_tax > 0.02), p AS (SELECT DISTINCT l_suppkey AS artifact, l_partkey AS id FROM lineitem WHERE l_discount > 0.02),
j AS (SELECT artifact, count(e) AS ne, count(p) AS np, count(CASE WHEN e = 1 AND p = 1 THEN 1 END) AS tp FROM (SELECT *, 1 AS e FROM e) FULL JOIN (SELECT *, 1 AS p FROM p) USING (artifact, id) GROUP BY 1)
SELECT artifact, round(CASE WHEN np > 0 THEN tp / np::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN ne > 0 THEN tp / ne::DOUBLE ELSE 0 END, 6) AS recall FROM j""")
def artifact_metrics(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("artifact"), F.col("l_partkey").alias("id"), "l_tax", "l_discount")
    out = P.set_metrics(line.where("l_tax > 0.02").select("artifact", "id"), line.where("l_discount > 0.02").select("artifact", "id"), "artifact")
    return out.select("artifact", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""SELECT source, sum(n)::BIGINT AS total, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""")
def chunk_method_counts(spark, d):
    out = P.counts_map(table(spark, d, "documents").select("source", "lang"), ["source"], "lang")
    return out.select("source", "total", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("""WITH x AS (SELECT event_type AS kind, user_id % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT k, sum(n) AS n FROM x WHERE kind IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1) SELECT string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM t""")
def merged_counts(spark, d):
    """Counters of the first two event types, added key by key."""
    e = table(spark, d, "events")
    kinds = e.select("event_type").distinct().orderBy("event_type").limit(2)
    m = P.counts_map(e.join(F.broadcast(kinds), "event_type").select("event_type", (F.col("user_id") % 10).alias("k")), ["event_type"], "k")  # two rows
    both = m.groupBy().agg(F.min_by("counts", "event_type").alias("a"), F.max_by("counts", "event_type").alias("b")).select(P.merge_counts(F.col("a"), F.col("b")).alias("m"))
    return both.select(F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string"))), ",").alias("counts"))


@query("SELECT event_type, count(*)::BIGINT AS calls, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg((user_id % 2 = 0)::INT), 6) AS cache_rate FROM events GROUP BY 1")
def latency_summary(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("ms"), (F.col("user_id") % 2 == 0).alias("cached"))
    return P.latency_summary(e, "event_type").withColumn("cache_rate", F.round("cache_rate", 6))


@query("""SELECT o_custkey AS id, max(o_orderkey) AS patch, arg_max(o_orderpriority, (CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey)) AS step FROM orders o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
AND (o_orderpriority = '2-HIGH' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')) GROUP BY 1""")
def latest_patches(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("step"), F.col("o_orderkey").alias("patch"))
    return P.latest_patch(o, ["1-URGENT", "2-HIGH"])


@query("""WITH x AS (SELECT l_partkey AS id, l_quantity AS score, l_linenumber AS part FROM lineitem) SELECT id, max(score) AS score, min(part) FILTER (WHERE score = m)::INT AS part FROM (SELECT *, max(score) OVER (PARTITION BY id) AS m FROM x) GROUP BY id""")
def merge_scored(spark, d):
    return P.merge_scored(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("part")))


_NAV = """n AS (SELECT o_orderkey AS id, o_custkey AS doc, o_orderkey // 3 AS ord, CASE WHEN o_orderstatus <> 'P' THEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS next_id,
CASE o_orderpriority WHEN '1-URGENT' THEN min(o_orderkey) OVER (PARTITION BY o_custkey) WHEN '2-HIGH' THEN -o_orderkey WHEN '5-LOW' THEN o_orderkey + 1 END AS parent_id FROM orders)"""


def _nav(spark, d):
    """A customer's orders as the nodes of a document, some with a wrong next node, parent or place."""
    from pyspark.sql import Window

    w, key = Window.partitionBy("o_custkey"), F.col("o_orderkey")
    parent = F.when(F.col("o_orderpriority") == "1-URGENT", F.min(key).over(w)).when(F.col("o_orderpriority") == "2-HIGH", -key).when(F.col("o_orderpriority") == "5-LOW", key + 1)
    return table(spark, d, "orders").select(key.alias("id"), F.col("o_custkey").alias("doc"), F.expr("o_orderkey div 3").alias("ord"), F.when(F.col("o_orderstatus") != "P", F.lead(key).over(w.orderBy(key))).alias("next_id"), parent.alias("parent_id"))


@query(f"""WITH {_NAV}, w AS (SELECT *, lead(id) OVER (PARTITION BY doc ORDER BY ord, id) AS want, count(*) OVER (PARTITION BY doc, ord) AS c FROM n), j AS (SELECT w.*, p.doc AS p_doc, p.ord AS p_ord FROM w LEFT JOIN n p ON w.parent_id = p.id)
SELECT id, 'next' AS issue FROM j WHERE next_id IS DISTINCT FROM want UNION ALL SELECT id, 'parent_missing' FROM j WHERE parent_id IS NOT NULL AND (p_doc IS NULL OR p_doc <> doc) UNION ALL SELECT id, 'parent_order' FROM j WHERE p_ord >= ord UNION ALL SELECT id, 'ord' FROM j WHERE c > 1""")
def validate_navigation(spark, d):
    return P.navigation_issues(_nav(spark, d))


@query(f"""WITH RECURSIVE {_NAV}, r(start, step, id) AS (SELECT id, 0, id FROM n WHERE id % 50 = 0 UNION ALL SELECT r.start, r.step + 1, n.next_id FROM r JOIN n ON n.id = r.id WHERE r.step < 8 AND n.next_id IS NOT NULL) SELECT start, step::INT AS step, id FROM r""")
def walk_next(spark, d):
    n = _nav(spark, d)
    return P.walk_next(n, n.where("id % 50 = 0").select("id"), 8)


_WORD = "the"


@query(f"""WITH s AS (SELECT doc_id, text, [length(x) FOR x IN string_split(lower(text), '{_WORD}')] AS l FROM documents), k AS (SELECT doc_id, unnest(range(1, len(l))) AS i, l FROM s)
SELECT doc_id, (list_sum(l[1:i]) + 3 * (i - 1))::INT AS start, (list_sum(l[1:i]) + 3 * i)::INT AS "end" FROM k""")
def keyword_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(P.keyword_spans(F.col("text"), _WORD)).alias("s")).select("doc_id", "s.start", "s.end")


@query(f"""WITH s AS (SELECT doc_id, length(text) AS n, [length(x) FOR x IN string_split(lower(text), '{_WORD}')] AS l FROM documents), k AS (SELECT doc_id, n, (list_sum(l[1:i]) + 3 * (i - 1)) AS a, (list_sum(l[1:i]) + 3 * i) AS b FROM (SELECT *, unnest(range(1, len(l))) AS i FROM s)),
w AS (SELECT doc_id, n, least(320, n) AS w FROM s), c AS (SELECT doc_id, w, 0 AS start FROM w UNION SELECT k.doc_id, w, greatest(0, least(k.n - w, (a + b) // 2 - w // 2)) FROM k JOIN w USING (doc_id)),
h AS (SELECT c.doc_id, start, w, count(a) AS hits FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND a >= start AND b <= start + w GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, start) AS r FROM h)
SELECT doc_id, start::INT AS start, (start + w)::INT AS "end", hits::INT AS hits FROM b WHERE r = 1""")
def term_dense_window(spark, d):
    s = table(spark, d, "documents").select("doc_id", "text", P.keyword_spans(F.col("text"), _WORD).alias("s"))
    return P.term_dense_window(s, "text", "s").select("doc_id", "window.start", "window.end", "window.hits")


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0)
SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.s = b.s THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id)""")
def batch_delta(spark, d):
    o = table(spark, d, "orders")
    after = F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus"))
    return P.batch_delta(o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")), o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), after.alias("state")))


@query("""SELECT count(*)::BIGINT AS written, count(CASE WHEN o_orderkey % 11 <> 0 THEN 1 END)::BIGINT AS found, count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END)::BIGINT AS lost, count(CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 THEN 1 END)::BIGINT AS altered, 0::BIGINT AS duplicated FROM orders""")
def read_back_check(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    there = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "?").otherwise(F.col("o_orderstatus")))
    return P.read_back(o, there, "o_orderkey")


@query("""SELECT event_id, CASE WHEN s <= p AND (e IS NULL OR p < e) THEN true ELSE false END AS active FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN ts - INTERVAL 30 DAY ELSE ts END AS s, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 10 DAY END AS e, TIMESTAMP '2024-01-10 00:00:00' AS p FROM events)""")
def retroactive_activity(spark, d):
    """Whether an edge was active on a day, from its valid start or an earlier one it was extended to."""
    ts = F.col("ts").cast("timestamp_ntz")
    retro = F.when(F.col("user_id") % 4 == 0, ts - F.expr("INTERVAL 30 DAYS"))
    ends = F.when(F.col("user_id") % 3 == 0, ts + F.expr("INTERVAL 10 DAYS"))
    return table(spark, d, "events").select("event_id", temporal.edge_active(F.lit("2024-01-10").cast("timestamp_ntz"), ts, ends, retro).alias("active"))


@query("SELECT p_partkey, 'work:' || trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS work_id FROM part")
def work_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("work:"), slugify(F.concat_ws(" ", "p_brand", "p_name"))).alias("work_id"))
