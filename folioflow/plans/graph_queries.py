"""Point lookups, patterns, traversals, graph statistics and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .base import GRAPH_SQL, STRIDE, edges, nodes, query, table

WITH = f"WITH {GRAPH_SQL}"
REC = f"WITH RECURSIVE {GRAPH_SQL}"


def _seeds(spark, d):
    return nodes(spark, d).where((F.col("label") == "Customer") & ((F.col("node_id") - STRIDE) % 50 == 0)).select("node_id")


@query(f"{WITH} SELECT node_id, vid, retrieval_eligible FROM nodes WHERE label = 'Customer' AND vid = 'Customer:7'")
def find_by_vid(spark, d):
    return nodes(spark, d).where("label = 'Customer' AND vid = 'Customer:7'").select("node_id", "vid", "retrieval_eligible")


@query(f"{WITH} SELECT min(node_id) AS node_id, any_value(label) AS label FROM nodes WHERE label = 'Part'")
def find_first_by_label(spark, d):
    return nodes(spark, d).where("label = 'Part'").orderBy("node_id").limit(1).select("node_id", "label")


@query(f"{WITH} SELECT count(*)::BIGINT AS n FROM nodes WHERE retrieval_eligible")
def count_eligible(spark, d):
    return G.eligible(nodes(spark, d)).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM edges)::BIGINT AS edges")
def node_edge_counts(spark, d):
    return nodes(spark, d).agg(F.count("*").alias("nodes")).crossJoin(edges(spark, d).agg(F.count("*").alias("edges")))


@query(f"{WITH} SELECT label, count(*)::BIGINT AS n, count(CASE WHEN retrieval_eligible THEN 1 END)::BIGINT AS eligible FROM nodes GROUP BY label")
def nodes_by_label(spark, d):
    return nodes(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("retrieval_eligible"), 1)).alias("eligible"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def without_embedding(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def stale_schema(spark, d):
    return table(spark, d, "part").where("p_size < 10").select("p_partkey", "p_size")


@query(f"{WITH} SELECT a.vid AS src_vid, b.vid AS dst_vid, weight FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE edge_type = 'CONTAINS'")
def one_hop_pattern(spark, d):
    return G.one_hop(nodes(spark, d), edges(spark, d), "CONTAINS")


@query(f"{WITH} SELECT a.vid AS src_vid, count(*)::BIGINT AS n FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE edge_type = 'PLACED' AND a.retrieval_eligible GROUP BY a.vid")
def cited_by_eligible(spark, d):
    return G.one_hop(G.eligible(nodes(spark, d)), edges(spark, d), "PLACED").groupBy("src_vid").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT edge_type, dst FROM edges WHERE src = {3 * STRIDE + 5}")
def from_entity(spark, d):
    return edges(spark, d).where(F.col("src") == 3 * STRIDE + 5).select("edge_type", "dst")


@query(f"""{WITH}, every AS (SELECT node_id, label FROM nodes UNION ALL SELECT {5 * STRIDE} + n_nationkey, 'Nation' FROM nation), ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT node_id, label FROM every LEFT JOIN ends ON id = node_id WHERE id IS NULL""")
def orphans(spark, d):
    """Among the graph's nodes and the nations, which no edge touches."""
    nations = table(spark, d, "nation").select((F.lit(5 * STRIDE) + F.col("n_nationkey")).alias("node_id"), F.lit("Nation").alias("label"))
    return G.orphans(nodes(spark, d).select("node_id", "label").union(nations), edges(spark, d)).select("node_id", "label")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def without_evidence(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT s_suppkey, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_orderkey)::BIGINT AS orders FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def author_profile(spark, d):
    line = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    return table(spark, d, "supplier").join(line, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20")
def topic_survey(spark, d):
    j = table(spark, d, "part").select("p_partkey", "p_brand").join(table(spark, d, "lineitem").select("l_partkey"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(20)


@query("SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) = 2")
def cross_source_entities(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_partkey").agg(F.count_distinct("o_orderstatus").alias("n")).where("n = 2").select("l_partkey")


@query(f"""{REC}, r(seed, node_id, depth) AS (
  SELECT node_id, node_id, 0 FROM nodes WHERE label = 'Customer' AND node_id % 50 = 0
  UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node_id WHERE r.depth < 3
) SELECT seed, node_id, min(depth)::INT AS depth FROM r GROUP BY seed, node_id""")
def k_hop_neighbourhood(spark, d):
    """From every customer whose key can be divided by 50."""
    return G.reach(edges(spark, d), _seeds(spark, d), 3)


@query(f"""{WITH}, r AS (
  SELECT DISTINCT e2.dst FROM edges e1 JOIN edges e2 ON e2.src = e1.dst WHERE e1.src = {STRIDE + 10} UNION SELECT dst FROM edges WHERE src = {STRIDE + 10}
) SELECT vid FROM r JOIN nodes ON node_id = dst WHERE retrieval_eligible ORDER BY vid LIMIT 100""")
def citation_neighbourhood(spark, d):
    n = nodes(spark, d)
    out = G.reach(edges(spark, d), n.where(F.col("node_id") == STRIDE + 10).select("node_id"), 2).where("depth > 0")
    return out.select("node_id").join(G.eligible(n), "node_id").select("vid").orderBy("vid").limit(100)


@query(f"""{WITH}, a AS (SELECT node_id AS anchor FROM nodes WHERE label = 'Customer' AND node_id % 50 = 0),
one AS (SELECT DISTINCT anchor, src AS s, dst AS d, edge_type FROM a JOIN edges ON src = anchor WHERE dst <> anchor),
two AS (SELECT DISTINCT one.anchor, e.src AS s, e.dst AS d, e.edge_type FROM (SELECT DISTINCT anchor, d FROM one) one JOIN edges e ON e.src = one.d)
SELECT a.anchor, (SELECT count(DISTINCT d) FROM one WHERE one.anchor = a.anchor)::BIGINT AS first_hop,
  (SELECT count(DISTINCT d) FROM two WHERE two.anchor = a.anchor AND two.d <> a.anchor AND NOT EXISTS (SELECT 1 FROM one WHERE one.anchor = two.anchor AND one.d = two.d))::BIGINT AS second_hop,
  (SELECT count(*) FROM (SELECT * FROM one WHERE one.anchor = a.anchor UNION SELECT * FROM two WHERE two.anchor = a.anchor))::BIGINT AS edges FROM a""")
def two_hop_preview(spark, d):
    """For every customer whose key can be divided by 50."""
    return G.two_hop_preview(edges(spark, d), _seeds(spark, d))


@query(f"""{WITH} SELECT node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o + i)::BIGINT AS degree FROM (
  SELECT src AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node_id ORDER BY degree DESC, node_id LIMIT 10""")
def degree_top10(spark, d):
    return G.degrees(edges(spark, d)).orderBy(F.desc("degree"), "node_id").limit(10)


@query(f"""{WITH}, n AS (SELECT count(*) AS nodes FROM nodes), e AS (SELECT count(*) AS edges, count(CASE WHEN src = dst THEN 1 END) AS self_loops FROM edges),
o AS (SELECT count(*) AS orphans FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = x.node_id) AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = x.node_id)),
m AS (SELECT count(*) AS multi FROM (SELECT 1 FROM edges GROUP BY src, dst HAVING count(*) > 1))
SELECT nodes::BIGINT AS nodes, edges::BIGINT AS edges, self_loops::BIGINT AS self_loops, orphans::BIGINT AS orphans, multi::BIGINT AS multi_edge_pairs, round(edges / (nodes * (nodes - 1.0)), 9) AS density FROM n, e, o, m""")
def graph_stats(spark, d):
    return G.graph_stats(nodes(spark, d), edges(spark, d)).withColumn("density", F.round("density", 9))


@query(f"{WITH} SELECT edge_type, count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources, round(avg(weight), 6) AS mean_weight FROM edges GROUP BY edge_type")
def layer_stats(spark, d):
    return edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query(f"{WITH} SELECT dst, count(*)::BIGINT AS n FROM edges WHERE edge_type = 'SUPPLIED_BY' GROUP BY dst ORDER BY n DESC, dst LIMIT 10")
def top_targets(spark, d):
    return edges(spark, d).where("edge_type = 'SUPPLIED_BY'").groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(10)


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) > 0.4""")
def similarity_edges(spark, d):
    return G.similar_pairs(table(spark, d, "embeddings"), 0.4, "label").withColumn("similarity", F.round("similarity", 6))


def _step(i: int) -> str:
    return f"""r{i} AS MATERIALIZED (SELECT n.node_id, (1.0 / (SELECT count(*) FROM n)) * (0.15 + 0.85 * coalesce((SELECT sum(rank) FROM r{i - 1} LEFT JOIN outs ON outs.src = node_id WHERE outs.src IS NULL), 0)) + 0.85 * coalesce(g.got, 0) AS rank
  FROM n LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{i - 1} JOIN sh ON node_id = src GROUP BY dst) g ON g.dst = n.node_id)"""


@query(f"""{WITH}, e AS MATERIALIZED (SELECT src, dst, sum(CASE WHEN weight > 0 THEN weight ELSE 1 END) AS w FROM edges GROUP BY src, dst),
sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM e), outs AS MATERIALIZED (SELECT DISTINCT src FROM e),
n AS MATERIALIZED (SELECT src AS node_id FROM e UNION SELECT dst FROM e), r0 AS MATERIALIZED (SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n),
{', '.join(_step(i) for i in range(1, 21))} SELECT node_id, round(rank, 9) AS rank FROM r20""")
def pagerank(spark, d):
    return G.pagerank(edges(spark, d)).withColumn("rank", F.round("rank", 9))


@query(f"{WITH} SELECT node_id, round((sum(c) * 0.1)::DOUBLE, 6) AS rank FROM (SELECT src AS node_id, count(*) AS c FROM edges GROUP BY 1 UNION ALL SELECT dst, count(*) FROM edges GROUP BY 1) GROUP BY node_id")
def degree_rank_fallback(spark, d):
    return G.degree_rank(edges(spark, d)).withColumn("rank", F.round("rank", 6))


@query()
def weak_components(spark, d):
    return G.components(edges(spark, d))


@query()
def strong_components(spark, d):
    """Nations that supply each other, in both directions; the least key names a component."""
    line, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return G.strong_components(j.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")))


def _mentions(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("p_brand").alias("label"), F.lit("Method").alias("entity_type"), F.col("l_orderkey").alias("paper_id"))


@query("""WITH m AS (SELECT DISTINCT p_brand AS label, l_orderkey AS paper_id FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT label, count(*) AS papers FROM m GROUP BY label)
SELECT label || ' mentions' AS label, 'method_family' AS cluster_type, 1 AS members, papers::BIGINT AS papers FROM n WHERE papers >= 5
UNION ALL SELECT a.label || ' + ' || b.label, 'method_family', 2, count(*)::BIGINT FROM m a JOIN m b ON a.paper_id = b.paper_id AND a.label < b.label GROUP BY a.label, b.label HAVING count(*) >= 3""")
def entity_clusters(spark, d):
    return G.clusters(_mentions(spark, d), 5, 3)


@query("SELECT n_name AS a, m_name AS b FROM (SELECT n_name, n_regionkey FROM nation) JOIN (SELECT n_name AS m_name, n_regionkey AS k FROM nation) ON n_regionkey = k AND n_name < m_name")
def coarse_category_pairs(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")
