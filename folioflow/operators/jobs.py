"""The leased queue around `lifecycle.claim`: intake, dependencies, heartbeat, results, and the log of what changed.

A job table has job_id, status, priority, attempt_count, max_attempts, retry_after, lease_owner, lease_until, created_at;
other columns pass. States: pending, blocked, ready, leased, done, retry, failed, stale. Each step gives the whole table anew,
by joins on job_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enqueue(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """jobs with the new ones as pending; a known job_id stays as it is, of rows that share a new one the least counts.

    new: job_id, priority, max_attempts and any other columns of jobs; columns it lacks are null.
    """
    rest = [c for c in new.columns if c != "job_id"]
    first = new.where("job_id IS NOT NULL").groupBy("job_id").agg(F.min(F.struct(*rest)).alias("r")).join(jobs.select("job_id"), "job_id", "left_anti")
    made = {"status": F.lit("pending"), "attempt_count": F.lit(0), "created_at": now}
    cast = dict(jobs.dtypes)
    row = [made.get(c, F.col("job_id") if c == "job_id" else F.col(f"r.{c}") if c in rest else F.lit(None)).cast(cast[c]).alias(c) for c in jobs.columns]
    return jobs.unionByName(first.select(row))


def _unmet(jobs: DataFrame, needs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job_id): jobs with a need that isn't met; a null part of a need asks for nothing, an artifact without a hash is never met."""
    n = needs.join(jobs.select(F.col("job_id").alias("needs_job"), F.col("status").alias("__state")), "needs_job", "left")
    n = n.join(artifacts.select(F.col("ref").alias("needs_ref"), F.col("hash").alias("__hash")), "needs_ref", "left")
    job = F.col("needs_job").isNotNull() & ~F.col("__state").eqNullSafe(F.coalesce("required_status", F.lit("done")))
    ref = F.col("needs_ref").isNotNull() & ~F.coalesce((F.col("__hash") == F.col("expected_hash")) & (F.col("expected_hash") != ""), F.lit(False))
    return n.where(job | ref).select("job_id").distinct()


def settle(jobs: DataFrame, needs: DataFrame, artifacts: DataFrame, now: Column) -> DataFrame:
    """jobs after needs were looked at: waiting ones whose retry time has come are ready if all needs are met, and pending
    or ready ones with an open need are blocked.

    needs: job_id, needs_job, needs_ref, expected_hash, required_status (null: done); artifacts: ref, hash.
    """
    j = jobs.join(_unmet(jobs, needs, artifacts).withColumn("__open", F.lit(True)), "job_id", "left")
    due = F.col("retry_after").isNull() | (F.col("retry_after") <= now)
    state = F.when(F.col("__open") & F.col("status").isin("pending", "ready"), "blocked").when(F.col("__open").isNull() & F.col("status").isin("pending", "blocked", "retry") & due, "ready")
    return j.withColumn("status", F.coalesce(state, "status")).select(jobs.columns)


def report(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """jobs after the results of their workers; only the owner of a job that is leased is heard.

    results: job_id, worker, outcome, retry_after, lease_seconds, at most one of a job. heartbeat lengthens the lease, complete ends the
    job, retry puts it off, or fails it once its attempts are used, fail ends it without success.
    """
    r = results.select("job_id", F.col("worker").alias("__worker"), F.col("outcome").alias("__outcome"), F.col("retry_after").alias("__after"), F.col("lease_seconds").alias("__lease"))
    j = jobs.join(r, "job_id", "left")
    heard = (F.col("status") == "leased") & (F.col("lease_owner") == F.col("__worker"))
    kind = F.when(heard, F.col("__outcome"))
    spent = F.col("attempt_count") >= F.col("max_attempts")
    state = F.when(kind == "complete", "done").when((kind == "fail") | ((kind == "retry") & spent), "failed").when(kind == "retry", "retry")
    left = kind.isin("complete", "retry", "fail")
    return j.select(*[
        {
            "status": F.coalesce(state, "status"),
            "retry_after": F.when(kind == "retry", F.col("__after")).otherwise(F.col("retry_after")),
            "lease_owner": F.when(left, None).otherwise(F.col("lease_owner")),
            "lease_until": F.when(left, None).when(kind == "heartbeat", now + F.col("__lease")).otherwise(F.col("lease_until")),
        }.get(c, F.col(c)).alias(c)
        for c in jobs.columns
    ])


def log(before: DataFrame, after: DataFrame, event: str, now: Column) -> DataFrame:
    """(job_id, event, from_status, to_status, at) of the jobs whose state a step changed, or that it added."""
    b = before.select("job_id", F.col("status").alias("from_status"))
    j = after.select("job_id", F.col("status").alias("to_status")).join(b, "job_id", "left")
    return j.where(~F.col("from_status").eqNullSafe(F.col("to_status"))).select("job_id", F.lit(event).alias("event"), "from_status", "to_status", now.alias("at"))
