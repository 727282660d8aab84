"""Audits between states of a corpus: silent changes, copies of bodies, coverage, disagreement, parity, freshness, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strata whose slots are filled first.
HARD_STRATA = ["ocr_or_scanned", "heavy_tables", "formulas_equations", "two_column"]


def silent_changes(previous: DataFrame, current: DataFrame, key: str, watch: list[str]) -> DataFrame:
    """(key, changed_fields) of the rows in both states that differ in a watched column; nulls are equal to nulls."""
    p, c = previous.alias("p"), current.alias("c")
    changed = F.filter(F.array(*[F.when(~F.col(f"p.{w}").eqNullSafe(F.col(f"c.{w}")), F.lit(w)) for w in watch]), lambda x: x.isNotNull())
    return p.join(c, key).select(key, changed.alias("changed_fields")).where(F.size("changed_fields") > 0)


def block_reasons(resolvable: Column, status: Column, audit: Column, risk: Column, precision: Column, at_least: float = 0.85) -> Column:
    """Why a claim may not be promoted; empty if nothing but a person's consent is missing."""
    reasons = F.array(
        F.when(~F.coalesce(resolvable, F.lit(False)), "not_resolvable"),
        F.when(F.coalesce(status, F.lit("")) != "supported", F.concat(F.lit("epistemic:"), F.coalesce(status, F.lit("none")))),
        F.when(audit == "failed", "audit_failed"),
        F.when((risk == "high") & (audit == "required"), "high_impact_audit_pending"),
        F.when(precision < at_least, "precision_below"),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


def body_copies(bodies: DataFrame, key: str, root: str, text: str) -> DataFrame:
    """Keys with bodies in several roots: the number of roots, and whether all hold the same text."""
    return (
        bodies.groupBy(key).agg(F.countDistinct(root).alias("roots"), F.countDistinct(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("texts"))
        .where("roots > 1").select(key, "roots", F.when(F.col("texts") == 1, "identical").otherwise("divergent").alias("content"))
    )


def first_body(bodies: DataFrame, key: str, root: str, order: list[str], tie: str) -> DataFrame:
    """(key, root, tie) of each key's body from the first root in the order; other roots come last, then the least tie."""
    place = F.coalesce(F.array_position(F.lit(order), F.col(root)), F.lit(0))
    rank = F.struct(F.when(place > 0, place).otherwise(len(order) + 1).alias("place"), F.col(tie), F.col(root))
    return bodies.groupBy(key).agg(F.min(rank).alias("b")).select(key, F.col(f"b.{root}"), F.col(f"b.{tie}"))


def coverage(wanted: DataFrame, bodies: DataFrame, key: str, group: str) -> DataFrame:
    """By group: keys wanted, and how many of them have a body."""
    have = bodies.select(key, F.lit(True).alias("found")).distinct()
    return wanted.join(have, key, "left").groupBy(group).agg(F.count("*").alias("wanted"), F.count("found").alias("found"))


def sample_signal(sampled: Column, passed: Column, least: int = 10, rate: float = 0.55) -> Column:
    """pass, partial or blocked by the share that passed; too small a sample is partial, none is blocked."""
    share = F.round(passed / F.nullif(sampled, F.lit(0)), 4)
    return (
        F.when(F.coalesce(sampled, F.lit(0)) == 0, "blocked").when(sampled < least, "partial")
        .when(share >= rate, "pass").when(share >= rate * 0.7, "partial").otherwise("blocked")
    )


def failure_code(status: Column, entities: Column, relations: Column, linked: Column, codes: Column) -> Column:
    """The kind of failure of an extraction with its diagnostic codes (as one text); null where it succeeded."""
    said = F.coalesce(codes, F.lit(""))
    auth, transport = said.contains("missing_api_key") | F.lower(said).contains("auth"), said.contains("transport")
    malformed = said.contains("missing_tool_use") | said.contains("schema_") | said.contains("malformed")
    none = F.when(malformed, "MALFORMED_OUTPUT").when(auth, "QUOTA_OR_AUTH").when(transport, "TRANSPORT_FAILURE").otherwise("EMPTY_CANDIDATES")
    failed = F.when(transport, "TRANSPORT_FAILURE").when(auth, "QUOTA_OR_AUTH").otherwise("UNKNOWN")
    found = entities + relations
    return (
        F.when(status == "failed", failed).when(status == "empty", "PARTIAL_PAPER").when((status == "done") & (found == 0), none)
        .when((status == "done") & (linked == 0), "MISSING_EVIDENCE")
    )


def second_judge(primary: DataFrame, secondary: DataFrame, case: str, item: str, kind: str, high_impact: list[str]) -> DataFrame:
    """Cases that both sets hold: items of either alone, and whether one of a kind of high impact is among them."""
    a, b = (df.select(case, item, kind).distinct().withColumn(s, F.lit(1)) for df, s in ((primary, "a"), (secondary, "b")))
    both = a.join(b, [case, item, kind], "full").groupBy(case).agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("only_primary"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_secondary"),
        F.coalesce(F.max((F.col("a").isNull() | F.col("b").isNull()) & F.col(kind).isin(high_impact)), F.lit(False)).alias("high_impact"),
    )
    return both.where("n_a > 0 AND n_b > 0").drop("n_a", "n_b")


def grounding(gold: DataFrame, bodies: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """Gold labels with whether the body holds them, case and spacing apart; blank labels are left out."""

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))

    named = gold.select(key, label).where(plain(F.col(label)) != "")
    return named.join(bodies.select(key, text), key, "left").select(key, label, F.contains(plain(F.col(text)), plain(F.col(label))).alias("in_body"))


def parity(old: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """One row: keys that the new run lacks, adds, or failed on, and match where there are none."""
    o, n = old.select(key).distinct().withColumn("o", F.lit(1)), new.groupBy(key).agg(F.max(F.col(status) == "failed").alias("bad"), F.count("*").alias("n"))
    one = o.join(n, key, "full").agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("o").isNull(), 1)).alias("extra"),
        F.count(F.when(F.col("bad") & F.col("o").isNotNull(), 1)).alias("failed"),
    )
    return one.withColumn("status", F.when(F.col("missing") + F.col("extra") + F.col("failed") == 0, "match").otherwise("mismatch"))


def freshness(recorded: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """Each recorded input as fresh, changed or missing."""
    there = now.select(key, F.col(digest).alias("__now"), F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "missing").when(F.col(digest).eqNullSafe(F.col("__now")), "fresh").otherwise("changed")
    return recorded.select(key, digest).join(there, key, "left").select(key, state.alias("state"))


def next_rung(pool: DataFrame, taken: list[DataFrame], key: str, order: list, size: int) -> DataFrame:
    """The first `size` keys of the pool, in the order, that no table of `taken` holds."""
    for t in taken:
        pool = pool.join(t.select(key).distinct(), key, "left_anti")
    return pool.orderBy(*order, key).select(key).limit(size)


def slots(pool: DataFrame, key: str, strata: list[str], size: int = 60, held_out: int = 12) -> DataFrame:
    """`size` numbered slots dealt evenly over the strata, the first of which take what is left over, filled by the least
    keys of the pool; the last filled ones are held out. Slots beyond the pool have a null key."""
    if size < 60 or not strata:
        raise ValueError("at least 60 slots and one stratum")
    each, over = divmod(size, len(strata))
    plan = [(i, s) for i, s in enumerate((s for n, s in enumerate(strata) for _ in range(each + (n < over))), 1)]
    spark = pool.sparkSession
    # `size` rows at most reach the windows
    least = pool.select(key).distinct().orderBy(key).limit(size)
    least = least.withColumn("slot", F.row_number().over(Window.orderBy(key))).withColumn("__tail", F.row_number().over(Window.orderBy(F.desc(key))) <= held_out)
    return spark.createDataFrame(plan, "slot int, stratum string").join(least, "slot", "left").select(
        F.format_string("c%03d", "slot").alias("slot_id"), "stratum", F.when(F.col("stratum").isin(HARD_STRATA), 1).otherwise(2).alias("priority"), key,
        F.coalesce("__tail", F.lit(False)).alias("held_out"),
    )
