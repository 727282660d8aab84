"""The queue's steps, claims against spans, places of surfaces and the rollup of a validation, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import claims, classify
from ..operators import jobs as J
from ..operators import lifecycle as L
from .base import query, table

NOW = 1_700_000_000
# Orders are jobs in five states. Odd orders wait for the order before them; every third one for a customer's artifact, whose
# hash is the market segment.
_JOBS = f"""jobs AS (SELECT o_orderkey AS job_id, ['pending', 'done', 'leased', 'retry', 'ready'][1 + o_orderkey % 5] AS status, o_orderkey % 4 AS attempt_count, 3 AS max_attempts,
  CASE WHEN o_orderkey % 7 = 0 THEN {NOW} + o_custkey - 50 END AS retry_after, 'w' || o_custkey % 3 AS lease_owner, {NOW} AS lease_until FROM orders),
needs AS (SELECT o_orderkey AS job_id, o_orderkey - 1 AS needs_job, NULL AS needs_ref, NULL AS expected_hash FROM orders WHERE o_orderkey % 2 = 1
  UNION ALL SELECT o_orderkey, NULL, o_custkey, 'BUILDING' FROM orders WHERE o_orderkey % 3 = 0)"""


def _jobs(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    states = F.array(*map(F.lit, ["pending", "done", "leased", "retry", "ready"]))
    return o.select(
        k.alias("job_id"), F.element_at(states, (1 + k % 5).cast("int")).alias("status"), (k % 4).alias("attempt_count"), F.lit(3).alias("max_attempts"),
        F.when(k % 7 == 0, NOW + F.col("o_custkey") - 50).alias("retry_after"), F.concat(F.lit("w"), (F.col("o_custkey") % 3).cast("string")).alias("lease_owner"), F.lit(NOW).cast("long").alias("lease_until"),
    )


@query(f"""WITH {_JOBS}, unmet AS (SELECT DISTINCT n.job_id FROM needs n LEFT JOIN jobs u ON u.job_id = n.needs_job LEFT JOIN customer a ON a.c_custkey = n.needs_ref
  WHERE (n.needs_job IS NOT NULL AND u.status IS DISTINCT FROM 'done') OR (n.needs_ref IS NOT NULL AND a.c_mktsegment IS DISTINCT FROM n.expected_hash)),
s AS (SELECT j.*, CASE WHEN m.job_id IS NOT NULL AND status IN ('pending', 'ready') THEN 'blocked'
  WHEN m.job_id IS NULL AND status IN ('pending', 'blocked', 'retry') AND (retry_after IS NULL OR retry_after <= {NOW}) THEN 'ready' ELSE status END AS now_ FROM jobs j LEFT JOIN unmet m USING (job_id))
SELECT job_id, 'settle' AS event, status AS from_status, now_ AS to_status, {NOW}::BIGINT AS at FROM s WHERE now_ <> status""")
def queue_settle(spark, d):
    o, jobs, now = table(spark, d, "orders"), _jobs(spark, d), F.lit(NOW).cast("long")
    k, none = F.col("o_orderkey"), F.lit(None)
    needs = o.where("o_orderkey % 2 = 1").select(k.alias("job_id"), (k - 1).alias("needs_job"), none.cast("long").alias("needs_ref"), none.cast("string").alias("expected_hash"), none.cast("string").alias("required_status"))
    needs = needs.union(o.where("o_orderkey % 3 = 0").select(k, none.cast("long"), "o_custkey", F.lit("BUILDING"), none.cast("string")))
    artifacts = table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_mktsegment").alias("hash"))
    return J.log(jobs, J.settle(jobs, needs, artifacts, now), "settle", now)


@query(f"""WITH {_JOBS}, r AS (SELECT o_orderkey AS job_id, ['heartbeat', 'complete', 'retry', 'fail'][1 + o_custkey % 4] AS outcome FROM orders WHERE o_orderkey % 6 <> 0),
k AS (SELECT j.*, CASE WHEN status = 'leased' AND lease_owner = 'w1' THEN outcome END AS kind FROM jobs j LEFT JOIN r USING (job_id))
SELECT job_id, CASE WHEN kind = 'complete' THEN 'done' WHEN kind = 'fail' OR kind = 'retry' AND attempt_count >= 3 THEN 'failed' WHEN kind = 'retry' THEN 'retry' ELSE status END AS status,
CASE WHEN kind = 'retry' THEN {NOW + 60} ELSE retry_after END::BIGINT AS retry_after, CASE WHEN kind IN ('complete', 'retry', 'fail') THEN NULL ELSE lease_owner END AS lease_owner,
CASE WHEN kind IN ('complete', 'retry', 'fail') THEN NULL WHEN kind = 'heartbeat' THEN {NOW + 600} ELSE lease_until END::BIGINT AS lease_until FROM k""")
def queue_report(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 6 <> 0")
    outcome = F.element_at(F.array(*map(F.lit, ["heartbeat", "complete", "retry", "fail"])), (1 + F.col("o_custkey") % 4).cast("int"))
    results = o.select(F.col("o_orderkey").alias("job_id"), F.lit("w1").alias("worker"), outcome.alias("outcome"), F.lit(NOW + 60).cast("long").alias("retry_after"), F.lit(600).alias("lease_seconds"))
    return J.report(_jobs(spark, d), results, F.lit(NOW).cast("long")).drop("attempt_count", "max_attempts")


_TOKENS = r"list_distinct(list_filter(string_split(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: length(x) > 2))"


@query(rf"""WITH s AS (SELECT conv_id, turn, text AS claim, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM conversations),
o AS (SELECT *, {_TOKENS.format("coalesce(claim, '')")} AS a, {_TOKENS.format("coalesce(span, '')")} AS b FROM s), v AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END AS share FROM o)
SELECT conv_id, turn, round(share, 6) AS overlap, CASE WHEN NOT coalesce(regexp_matches(claim, '\S'), false) THEN 'empty_claim' WHEN NOT coalesce(regexp_matches(span, '\S'), false) THEN 'missing_span_text'
  WHEN turn % 5 = 4 THEN 'span_not_resolvable' WHEN share < 0.25 THEN 'low_token_overlap' ELSE 'token_overlap' END AS reason, CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'medium' END AS tier FROM v""")
def claim_faithfulness(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("claim"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("span"))
    claim, span = F.col("claim"), F.col("span")
    tier = classify.risk_tier(F.when(F.col("turn") % 2 == 0, "SUPPORTS").otherwise("CITES"), claim)
    return c.select("conv_id", "turn", F.round(claims.token_overlap(claim, span), 6).alias("overlap"), claims.faithfulness(claim, span, F.col("turn") % 5 != 4).alias("reason"), tier.alias("tier"))


# The surface is four words of the text, in small letters and one space apart, so line ends between them take the loose way.
@query(r"""WITH s AS (SELECT doc_id, text, list_slice(regexp_split_to_array(text, '\s+'), 9, 12) AS w FROM documents),
p AS (SELECT *, lower(array_to_string(w, ' ')) AS surface FROM s WHERE len(w) = 4),
h AS (SELECT *, strpos(lower(text), surface) AS place, regexp_extract(text, array_to_string(list_transform(w, lambda x: regexp_escape(lower(x))), '\s+'), 0, 'i') AS hit FROM p)
SELECT doc_id, (CASE WHEN place > 0 THEN place ELSE strpos(text, hit) END - 1)::BIGINT AS char_start, (CASE WHEN place > 0 THEN place + length(surface) ELSE strpos(text, hit) + length(hit) END - 1)::BIGINT AS char_end FROM h WHERE surface <> ''""")
def surface_spans(spark, d):
    w = table(spark, d, "documents").select("doc_id", "text", F.slice(F.split("text", r"\s+"), 9, 4).alias("w")).where("size(w) = 4")
    return w.select("doc_id", claims.locate(F.lower(F.array_join("w", " ")), F.col("text")).alias("s")).select("doc_id", "s.char_start", "s.char_end")


@query("""WITH n AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 'Odd' ELSE 'Section' END AS label FROM customer)
SELECT label, count(*)::BIGINT AS nodes, count(CASE WHEN label = 'Odd' OR c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 1 END)::BIGINT AS broken,
sum(CASE WHEN label = 'Odd' THEN 1 ELSE (c_custkey % 4 = 0)::INT END)::BIGINT AS critical, sum(CASE WHEN label = 'Odd' THEN 0 ELSE (c_custkey % 5 = 0)::INT END)::BIGINT AS warning FROM n GROUP BY label""")
def validation_rollup(spark, d):
    k = F.col("c_custkey")
    p = F.create_map(F.lit("vid"), k.cast("string"), F.lit("import_eligible"), F.lit("true"), F.lit("retrieval_eligible"), F.lit("true"), F.lit("schema_version"), F.lit("1"), F.lit("level"), F.when(k % 5 == 0, "high").otherwise("1"))
    p = F.when(k % 4 == 0, p).otherwise(F.map_concat(p, F.create_map(F.lit("title"), F.col("c_name"))))
    n = table(spark, d, "customer").select(k.alias("node_id"), F.when(k % 10 == 0, "Odd").otherwise("Section").alias("label"), p.alias("props"))
    fields = [("vid", "string"), ("title", "string"), ("level", "int"), ("import_eligible", "bool"), ("retrieval_eligible", "bool"), ("schema_version", "int")]
    schema = spark.createDataFrame([("Section", f, t, True) for f, t in fields], "label string, field string, kind string, required boolean")
    return L.validation_rollup(n, L.validate_nodes(n, schema))
