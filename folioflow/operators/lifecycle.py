"""Validation against the schema, repair with provenance, scheduling and leased jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import MAX_RETRIES, backoff_seconds

#: Edge type, label of its source, labels its target may have.
CONTRACTS = [
    ("AFFILIATED_WITH", "Author", ["Institution"]),
    ("CITES", "Paper", ["Citation"]),
    ("FOUND_IN", "Entity", ["Section"]),
    ("FROM_SOURCE", "Paper", ["Source"]),
    ("MEMBER_OF_CLUSTER", "Entity", ["ConceptCluster"]),
    ("MENTIONS", "Paper", ["Entity", "ResearchProblem", "MetricObservation"]),
    ("PARTICIPATES_IN", "Entity", ["EvidenceBundle"]),
    ("SUPERSEDES", "Entity", ["Entity"]),
    ("SUPPORTS", "EvidenceBundle", ["Claim"]),
    ("authoredBy", "Author", ["Paper"]),
    ("hasPart", "Paper", ["Section", "Reference"]),
    ("hasTopic", "Paper", ["Topic"]),
    ("inCategory", "Paper", ["Category"]),
]
#: Fields that name another node: label, field, label of the other, whether it must be there.
REFERENCES = [
    ("ResearchProblem", "parent_problem_id", "ResearchProblem", False),
    ("ResearchProblem", "evidence_bundle_id", "EvidenceBundle", False),
    ("Claim", "source_span_id", "EvidenceBundle", False),
    ("ResearchEnvironment", "research_problem_id", "ResearchProblem", True),
    ("MetricObservation", "metric_definition_id", "MetricDefinition", True),
    ("MetricObservation", "run_id", "ExperimentRun", True),
    ("ResultComparison", "candidate_observation_id", "MetricObservation", True),
    ("ResultComparison", "baseline_observation_id", "MetricObservation", True),
    ("ResultComparison", "environment_id", "ResearchEnvironment", True),
    ("Decision", "policy_id", "Decision", False),
]


def validate_nodes(nodes: DataFrame, schema: DataFrame) -> DataFrame:
    """(node_id, severity, code, field): all violations of nodes(node_id, label, props) against schema(label, field, kind, required).

    An unknown label is the only finding of its node. kind is string, int, float, bool or any.
    """
    known = schema.select("label").distinct()
    unknown = nodes.join(known, "label", "left_anti").select("node_id", F.lit("critical").alias("severity"), F.lit("unknown_label").alias("code"), F.col("label").alias("field"))
    good = nodes.join(known, "label", "left_semi")
    want = good.join(schema, "label").withColumn("value", F.try_element_at("props", F.col("field")))
    missing = want.where("required AND value IS NULL").select("node_id", F.lit("critical").alias("severity"), F.lit("missing_required").alias("code"), "field")
    v = F.col("value")
    fits = F.when(F.col("kind") == "int", v.try_cast("bigint").isNotNull()).when(F.col("kind") == "float", v.try_cast("double").isNotNull()).when(F.col("kind") == "bool", v.isin("true", "false")).otherwise(True)
    wrong = want.where(v.isNotNull() & ~fits).select("node_id", F.lit("warning").alias("severity"), F.lit("type_mismatch").alias("code"), "field")
    extra = good.select("node_id", "label", F.explode(F.map_keys("props")).alias("field")).join(schema.select("label", "field"), ["label", "field"], "left_anti").select("node_id", F.lit("warning").alias("severity"), F.lit("undeclared_field").alias("code"), "field")
    p = lambda k: F.try_element_at("props", F.lit(k))
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(p("import_eligible").isin("true", "false"), F.lit(False)), "import_eligible"),
        F.when(~F.coalesce(p("retrieval_eligible").isin("true", "false"), F.lit(False)), "retrieval_eligible"),
        F.when(F.coalesce(p("schema_version").try_cast("bigint"), F.lit(0)) < 1, "schema_version"),
        F.when(F.coalesce(p("vid"), F.lit("")) == "", "vid"),
    ))
    broken = good.select("node_id", F.lit("critical").alias("severity"), F.lit("invariant").alias("code"), F.explode(rules).alias("field"))
    return unknown.union(missing).union(wrong).union(extra).union(broken)


def edge_violations(nodes: DataFrame, edges: DataFrame, contracts: DataFrame) -> DataFrame:
    """(src, dst, edge_type, code): unknown types, wrong sources, wrong targets; contracts(edge_type, source, targets)."""
    a, b = nodes.select(F.col("node_id").alias("src"), F.col("label").alias("src_label")), nodes.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label"))
    j = edges.join(a, "src", "left").join(b, "dst", "left").join(F.broadcast(contracts), "edge_type", "left")  # one row per edge type
    code = F.when(F.col("source").isNull(), "unknown_type").when(~F.col("src_label").eqNullSafe(F.col("source")), "wrong_source").when(~F.coalesce(F.array_contains("targets", F.col("dst_label")), F.lit(False)), "wrong_target")
    return j.withColumn("code", code).where("code IS NOT NULL").select("src", "dst", "edge_type", "code")


def broken_references(nodes: DataFrame, references: list[tuple[str, str, str, bool]]) -> DataFrame:
    """(node_id, field, code): dangling references, and required ones that are missing; nodes(node_id, label, vid, props)."""
    out = None
    for label, field, target, required in references:
        mine = nodes.where(F.col("label") == label).select("node_id", F.try_element_at("props", F.lit(field)).alias("ref"))
        there = nodes.where(F.col("label") == target).select(F.col("vid").alias("ref"))
        bad = mine.where("ref IS NOT NULL AND ref <> ''").join(there, "ref", "left_anti").select("node_id", F.lit(field).alias("field"), F.lit("dangling").alias("code"))
        if required:
            bad = bad.union(mine.where("ref IS NULL OR ref = ''").select("node_id", F.lit(field).alias("field"), F.lit("missing").alias("code")))
        out = bad if out is None else out.union(bad)
    return out


def _event(df: DataFrame, op: str, actor: str, at: str, reason: str) -> DataFrame:
    return df.select(F.lit(op).alias("op"), F.lit(actor).alias("actor"), F.lit(at).cast("timestamp").alias("at"), "vid", F.lit(reason).alias("reason"), "change")


def silence(nodes: DataFrame, vids: DataFrame, reason: str, actor: str, at: str, silent: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, events): the nodes named by vids become ineligible, or eligible again."""
    hit = nodes.join(vids.select("vid").distinct().withColumn("__hit", F.lit(True)), "vid", "left")
    new = hit.withColumn("retrieval_eligible", F.when(F.col("__hit"), F.lit(not silent)).otherwise(F.col("retrieval_eligible")))
    new = new.withColumn("deprecated_reason", F.when(F.col("__hit"), F.lit(reason if silent else None)).otherwise(F.col("deprecated_reason")))
    events = _event(hit.where("__hit").withColumn("change", F.concat(F.lit("retrieval_eligible: "), F.coalesce(F.col("retrieval_eligible").cast("string"), F.lit("(null)")), F.lit(f" -> {str(not silent).lower()}"))), "silence" if silent else "unsilence", actor, at, reason)
    return new.drop("__hit"), events


def correct(nodes: DataFrame, vid: str, field: str, value, reason: str, actor: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, events): one property of one node set; an absent old value is written (null)."""
    old = F.coalesce(F.col(field).cast("string"), F.lit("(null)"))
    events = _event(nodes.where(F.col("vid") == vid).withColumn("change", F.concat(F.lit(f"{field}: "), old, F.lit(f" -> {value}"))), "correct", actor, at, reason)
    return nodes.withColumn(field, F.when(F.col("vid") == vid, F.lit(value)).otherwise(F.col(field))), events


def merge(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): pairs(merged, keep) of vids. The merged become ineligible and superseded; a SUPERSEDES edge leads
    from each to the kept, and the edges that come in are copied to it, but for SUPERSEDES.
    """
    p = pairs.select(F.col("merged").alias("vid"), F.col("keep").alias("__keep")).dropDuplicates(["vid"])
    j = nodes.join(p, "vid", "left")
    new = j.withColumn("retrieval_eligible", F.when(F.col("__keep").isNotNull(), F.lit(False)).otherwise(F.col("retrieval_eligible"))).withColumn("superseded_by", F.coalesce("__keep", "superseded_by")).drop("__keep")
    ids = nodes.select("vid", "node_id")
    of = pairs.join(ids.select(F.col("vid").alias("merged"), F.col("node_id").alias("m")), "merged").join(ids.select(F.col("vid").alias("keep"), F.col("node_id").alias("k")), "keep").select("m", "k")
    supersedes = of.select(F.col("m").alias("src"), F.col("k").alias("dst"), F.lit("SUPERSEDES").alias("edge_type"), F.lit(1.0).alias("weight"))
    copied = edges.where("edge_type <> 'SUPERSEDES'").join(of, edges["dst"] == of["m"]).select("src", F.col("k").alias("dst"), "edge_type", "weight")
    return new, edges.select("src", "dst", "edge_type", "weight").unionByName(supersedes).unionByName(copied)


def add_pending(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """tasks with the new ones that aren't pending yet; key: arxiv_id, task_type."""
    pending = tasks.where("status = 'pending'").select("arxiv_id", "task_type")
    return tasks.unionByName(new.dropDuplicates(["arxiv_id", "task_type"]).join(pending, ["arxiv_id", "task_type"], "left_anti").select(tasks.columns))


def due(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.where((F.col("status") == "pending") & (F.col("next_retry") <= now))


def after_failure(tasks: DataFrame, failed: Column, now: Column) -> DataFrame:
    """A failed task waits a day, three, nine ... at most thirty; at MAX_RETRIES it is given up."""
    n = F.col("retry_count") + 1
    gone = n >= MAX_RETRIES
    return tasks.select(*[c for c in tasks.columns if c not in ("retry_count", "status", "next_retry", "last_retry")],
        F.when(failed, n).otherwise(F.col("retry_count")).alias("retry_count"), F.when(failed & gone, "failed").otherwise(F.col("status")).alias("status"),
        F.when(failed, F.when(gone, F.lit(2**63 - 1)).otherwise(now + backoff_seconds(F.col("retry_count")))).otherwise(F.col("next_retry")).alias("next_retry"),
        F.when(failed, now).otherwise(F.col("last_retry")).alias("last_retry"))


def claim(jobs: DataFrame, owner: str, now: Column, lease_seconds: int, n: int = 1) -> DataFrame:
    """jobs after `owner` took the first n that are ready: highest priority, then oldest, then id."""
    ready = jobs.where((F.col("status") == "ready") & (F.col("retry_after").isNull() | (F.col("retry_after") <= now)))
    taken = ready.orderBy(F.desc("priority"), "created_at", "job_id").limit(n).select("job_id", F.lit(True).alias("__taken"))
    j = jobs.join(F.broadcast(taken), "job_id", "left")
    t = F.col("__taken")
    return j.withColumn("status", F.when(t, "leased").otherwise(F.col("status"))).withColumn("lease_owner", F.when(t, owner).otherwise(F.col("lease_owner"))).withColumn("lease_until", F.when(t, now + lease_seconds).otherwise(F.col("lease_until"))).withColumn("attempt_count", F.when(t, F.col("attempt_count") + 1).otherwise(F.col("attempt_count"))).drop("__taken")


def reclaim(jobs: DataFrame, now: Column) -> DataFrame:
    """Leases that ran out: back to ready, or failed for good once all attempts are used."""
    out = (F.col("status") == "leased") & (F.col("lease_until") < now)
    state = F.when(out & (F.col("attempt_count") >= F.col("max_attempts")), "failed").when(out, "ready").otherwise(F.col("status"))
    return jobs.withColumn("lease_owner", F.when(out, None).otherwise(F.col("lease_owner"))).withColumn("status", state)


def mark_stale(jobs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Jobs done on other inputs or versions than inputs(job_id, input_hash, tool_version) say become stale."""
    i = inputs.select("job_id", F.col("input_hash").alias("__h"), F.col("tool_version").alias("__v"))
    j = jobs.join(i, "job_id", "left")
    return j.withColumn("status", F.when((F.col("status") == "done") & ((F.col("input_hash") != F.col("__h")) | (F.col("tool_version") != F.col("__v"))), "stale").otherwise(F.col("status"))).drop("__h", "__v")


def run_stages(stages: list[tuple[str, list[str], object]], policy: str = "abort", retries: int = 1) -> dict[str, str]:
    """Runs (name, needs, callable) in the order given; needs must come before. policy: abort, continue or retry."""
    seen: set[str] = set()
    for name, needs, _ in stages:
        if name in seen or any(n not in seen for n in needs):
            raise ValueError(f"{name}: names must differ and what a stage needs must come before it")
        seen.add(name)
    state: dict[str, str] = {}
    for name, needs, call in stages:
        if any(state[n] != "ok" for n in needs):
            state[name] = "skipped"
            continue
        for attempt in range(1 + (retries if policy == "retry" else 0)):
            try:
                call()
                state[name] = "ok"
                break
            except Exception as e:
                state[name] = f"failed: {e}"
                if policy == "abort":
                    raise
    return state


def validation_rollup(nodes: DataFrame, violations: DataFrame) -> DataFrame:
    """(label, nodes, broken, critical, warning): nodes of each label, those with a violation, and violations by severity."""
    per = violations.groupBy("node_id").agg(F.count(F.when(F.col("severity") == "critical", 1)).alias("c"), F.count(F.when(F.col("severity") == "warning", 1)).alias("w"))
    j = nodes.select("node_id", "label").join(per, "node_id", "left")
    return j.groupBy("label").agg(F.count("*").alias("nodes"), F.count("c").alias("broken"), F.coalesce(F.sum("c"), F.lit(0)).alias("critical"), F.coalesce(F.sum("w"), F.lit(0)).alias("warning"))
