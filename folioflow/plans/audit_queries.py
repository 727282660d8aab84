"""Audits between two states, sets or sources of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .base import query, table


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice <> 0 THEN 'o_totalprice' END, CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus' END) AS changed
FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_totalprice <> 0) OR o_orderstatus = 'P'""")
def silent_changes(spark, d):
    """Urgent orders doubled in price and pending ones closed, without a note."""
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    new = old.withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))).replace({"P": "F"}, subset=["o_orderstatus"])
    return A.silent_changes(old, new, "o_orderkey", ["o_totalprice", "o_orderstatus"]).select("o_orderkey", F.concat_ws(",", "changed_fields").alias("changed"))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice <= 1000 THEN 'not_resolvable' END, CASE WHEN o_orderstatus <> 'F' THEN 'epistemic:' || o_orderstatus END,
CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 'high_impact_audit_pending' END) AS reasons FROM orders""")
def promotion_block_reasons(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "supported").otherwise(F.col("o_orderstatus"))
    risk, audit = F.when(F.col("o_orderpriority").startswith("1"), "high").otherwise("low"), F.when(F.col("o_orderstatus") == "O", "required").otherwise("passed")
    reasons = A.block_reasons(F.col("o_totalprice") > 1000, status, audit, risk, F.lit(0.9))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", reasons).alias("reasons"))


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey)::BIGINT AS roots, CASE WHEN count(DISTINCT l_returnflag || l_linestatus) = 1 THEN 'identical' ELSE 'divergent' END AS content
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def body_copies(spark, d):
    bodies = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("body"))
    return A.body_copies(bodies, "l_orderkey", "l_suppkey", "body")


@query("""SELECT conv_id, role, turn FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END, turn, role) = 1""")
def first_body(spark, d):
    return A.first_body(table(spark, d, "conversations"), "conv_id", "role", ["assistant", "user"], "turn")


@query("SELECT lang, count(*)::BIGINT AS wanted, count(l.doc_id)::BIGINT AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def body_coverage(spark, d):
    return A.coverage(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", "lang")


@query("""WITH s AS (SELECT source, count(quality) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n::BIGINT AS sampled, CASE WHEN n = 0 THEN 'blocked' WHEN n < 10 THEN 'partial' WHEN round(k / n, 4) >= 0.55::DOUBLE THEN 'pass' WHEN round(k / n, 4) >= 0.55::DOUBLE * 0.7::DOUBLE THEN 'partial' ELSE 'blocked' END AS signal FROM s""")
def sample_signal(spark, d):
    both = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    by = both.groupBy("source").agg(F.count("quality").alias("sampled"), F.count(F.when(F.col("quality") == 1, 1)).alias("passed"))
    return by.select("source", "sampled", A.sample_signal(F.col("sampled"), F.col("passed")).alias("signal"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS e, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS g FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'TRANSPORT_FAILURE' WHEN o_orderpriority LIKE '2%' THEN 'QUOTA_OR_AUTH' ELSE 'UNKNOWN' END WHEN 'P' THEN 'PARTIAL_PAPER'
ELSE CASE WHEN coalesce(e, 0) = 0 THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'TRANSPORT_FAILURE' WHEN o_orderpriority LIKE '2%' THEN 'QUOTA_OR_AUTH' ELSE 'EMPTY_CANDIDATES' END
WHEN coalesce(g, 0) = 0 THEN 'MISSING_EVIDENCE' END END AS code FROM orders LEFT JOIN l ON k = o_orderkey""")
def failure_codes(spark, d):
    def n(flag):
        return F.count(F.when(F.col("l_returnflag") == flag, 1))

    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n("R").alias("e"), n("A").alias("g"))
    said = F.when(F.col("o_orderpriority").startswith("1"), "transport_error").when(F.col("o_orderpriority").startswith("2"), "missing_api_key")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "empty").otherwise("done")
    code = A.failure_code(status, F.coalesce("e", F.lit(0)), F.lit(0), F.coalesce("g", F.lit(0)), said)
    return table(spark, d, "orders").join(found, "o_orderkey", "left").select("o_orderkey", code.alias("code"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i, l_returnflag AS t, 1 AS a FROM lineitem WHERE l_quantity > 10),
b AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i, l_returnflag AS t, 1 AS b FROM lineitem WHERE l_quantity < 40)
SELECT k AS l_orderkey, count(CASE WHEN b IS NULL THEN 1 END)::BIGINT AS only_primary, count(CASE WHEN a IS NULL THEN 1 END)::BIGINT AS only_secondary,
bool_or((a IS NULL OR b IS NULL) AND t = 'R') AS high_impact FROM a FULL JOIN b USING (k, i, t) GROUP BY 1 HAVING count(a) > 0 AND count(b) > 0""")
def second_judge(spark, d):
    line = table(spark, d, "lineitem")
    return A.second_judge(line.where("l_quantity > 10"), line.where("l_quantity < 40"), "l_orderkey", "l_partkey", "l_returnflag", ["R"])


@query(r"""WITH g AS (SELECT doc_id + 1 AS doc_id, regexp_extract(text, '[A-Za-z]{4,}') AS label FROM documents)
SELECT g.doc_id, label, contains(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), lower(label)) AS in_body FROM g LEFT JOIN documents d ON d.doc_id = g.doc_id WHERE coalesce(label, '') <> ''""")
def gold_grounding(spark, d):
    """Is the first longer word of a document also in the next one?"""
    docs = table(spark, d, "documents").select("doc_id", "text")
    gold = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("label"))
    return A.grounding(gold, docs, "doc_id", "label", "text")


@query("""WITH n AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'P') AS bad FROM orders GROUP BY 1), j AS (SELECT c_custkey, k, bad FROM (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) FULL JOIN n ON k = c_custkey),
s AS (SELECT count(CASE WHEN k IS NULL THEN 1 END)::BIGINT AS missing, count(CASE WHEN c_custkey IS NULL THEN 1 END)::BIGINT AS extra, count(CASE WHEN bad AND c_custkey IS NOT NULL THEN 1 END)::BIGINT AS failed FROM j)
SELECT *, CASE WHEN missing + extra + failed = 0 THEN 'match' ELSE 'mismatch' END AS status FROM s""")
def shadow_parity(spark, d):
    old = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done").alias("status"))
    return A.parity(old, new, "id", "status")


@query("""SELECT p.p_partkey, CASE WHEN p.p_size > 45 THEN 'missing' WHEN p.p_size < 5 THEN 'changed' ELSE 'fresh' END AS state FROM part p""")
def input_freshness(spark, d):
    """Large parts are gone since they were recorded, and small ones renamed."""
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    now = part.where("p_size <= 45").withColumn("p_name", F.when(F.col("p_size") < 5, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return A.freshness(part.withColumn("sha", F.sha2("p_name", 256)), now.select("p_partkey", F.sha2("p_name", 256).alias("sha")), "p_partkey", "sha")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
ORDER BY c_acctbal DESC, c_custkey LIMIT 20""")
def next_rung(spark, d):
    c = table(spark, d, "customer")
    served = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return A.next_rung(c, [served, c.where("c_acctbal < 0")], "c_custkey", [F.desc("c_acctbal")], 20)


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS slot, (SELECT count(DISTINCT p_partkey) FROM part) AS n FROM part),
s AS (SELECT unnest(range(1, 63)) AS slot)
SELECT format('c{:03d}', slot) AS slot_id, CASE WHEN slot <= 16 THEN 'heavy_tables' WHEN slot <= 32 THEN 'two_column' WHEN slot <= 47 THEN 'plain' ELSE 'slides' END AS stratum,
CASE WHEN slot <= 32 THEN 1 ELSE 2 END AS priority, p_partkey, coalesce(slot > least(n, 62) - 12, false) AS held_out FROM s LEFT JOIN p USING (slot)""")
def stratified_slots(spark, d):
    return A.slots(table(spark, d, "part"), "p_partkey", ["heavy_tables", "two_column", "plain", "slides"], 62)
