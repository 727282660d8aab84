"""Reports over packages of documents: record evaluation, evidence, navigation, catalogs and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._tables import staged


def _ratio(a: Column, b: Column, none: float) -> Column:
    return F.when(b > 0, a / b).otherwise(none)


def evaluate_records(gold: DataFrame, predicted: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 of entities and relations, evidence and schema rates, mean cost and latency, and cases missing or extra.

    gold: case_id, kind (entity or relation), key; predicted: the same with evidence (whether it names valid evidence);
    cases: case_id, role (gold or predicted), schema_valid, json_valid, cost, latency, retries. Keys are sets. Predictions of cases
    that gold doesn't have count only as extra cases; nothing expected and nothing predicted is a full score.
    """
    known = cases.where("role = 'gold'").select("case_id").distinct()
    made = cases.where("role = 'predicted'")
    shared = made.join(known, "case_id", "left_semi")
    mine = predicted.join(known, "case_id", "left_semi")
    g = gold.select("case_id", "kind", "key").distinct().withColumn("g", F.lit(1))
    p = mine.select("case_id", "kind", "key").distinct().withColumn("p", F.lit(1))
    both = g.join(p, ["case_id", "kind", "key"], "full")
    out = None
    for kind in ("entity", "relation"):
        here = F.col("kind") == kind
        n = both.agg(F.count(F.when(here & F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(here, F.col("p"))).alias("np"), F.count(F.when(here, F.col("g"))).alias("ng"))
        empty = F.when((F.col("np") == 0) & (F.col("ng") == 0), 1.0).otherwise(0.0)
        pr, rc = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(empty), F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(empty)
        s = n.select(pr.alias(f"{kind}_precision"), rc.alias(f"{kind}_recall")).withColumn(f"{kind}_f1", _ratio(2 * F.col(f"{kind}_precision") * F.col(f"{kind}_recall"), F.col(f"{kind}_precision") + F.col(f"{kind}_recall"), 0.0))
        out = s if out is None else out.crossJoin(s)
    evidence = mine.agg(_ratio(F.count(F.when(F.col("evidence"), 1)), F.count("*"), 1.0).alias("evidence_validity"))
    rates = shared.agg(*[_ratio(F.count(F.when(F.col(c), 1)), F.count("*"), 0.0).alias(f"{c}_rate") for c in ("schema_valid", "json_valid")], F.avg("cost").alias("mean_cost"), F.avg("latency").alias("mean_latency"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"))
    missing = known.join(made, "case_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = made.join(known, "case_id", "left_anti").agg(F.count("*").alias("extra"))
    return out.crossJoin(evidence).crossJoin(rates).crossJoin(missing).crossJoin(extra)


def retrieval_ablations(returned: DataFrame, expected: DataFrame) -> DataFrame:
    """(question, mode, returned, hits, missing, recall): sets of returned ids against the expected ones, for every mode."""
    modes = returned.select("mode").distinct()
    want = expected.distinct().crossJoin(F.broadcast(modes)).withColumn("e", F.lit(1))  # a handful of modes
    got = returned.select("question", "mode", "id").distinct().withColumn("r", F.lit(1))
    j = want.join(got, ["question", "mode", "id"], "full").groupBy("question", "mode").agg(F.count("r").alias("returned"), F.count(F.when(F.col("r").isNotNull() & F.col("e").isNotNull(), 1)).alias("hits"), F.count("e").alias("n"))
    return j.select("question", "mode", "returned", "hits", (F.col("n") - F.col("hits")).alias("missing"), F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.when(F.col("returned") == 0, 1.0).otherwise(0.0)).alias("recall"))


def policy_scores(runs: DataFrame) -> DataFrame:
    """(policy, runs, recall, evidence_correctness, failure_rate) of runs(policy, hits, expected, evidence_ok, failed)."""
    return runs.groupBy("policy").agg(F.count("*").alias("runs"), _ratio(F.sum("hits"), F.sum("expected"), 1.0).alias("recall"), F.avg(F.col("evidence_ok").cast("double")).alias("evidence_correctness"), F.avg(F.col("failed").cast("double")).alias("failure_rate"))


def evidence_paths_by_chunk(evidence: DataFrame) -> DataFrame:
    """(chunk_id, evidence_id, page_id): the last evidence, by id, of each chunk."""
    return evidence.groupBy("chunk_id").agg(F.max(F.struct("evidence_id", "page_id")).alias("b")).select("chunk_id", "b.evidence_id", "b.page_id")


def same_paper_neighbours(chunks: DataFrame, seeds: DataFrame, limit: int = 5) -> DataFrame:
    """(chunk_id, neighbour, rank): the first other chunks of a seed's paper, in order of id."""
    s = seeds.select(F.col("chunk_id").alias("seed")).join(chunks.select(F.col("chunk_id").alias("seed"), "paper_id"), "seed")
    # limit + 1 of each paper are enough, whichever of them is the seed
    w = Window.partitionBy("paper_id").orderBy("chunk_id")
    first = chunks.select("paper_id", "chunk_id", F.row_number().over(w).alias("k")).where(F.col("k") <= limit + 1)
    j = s.join(first, "paper_id").where("seed <> chunk_id").select(F.col("seed").alias("chunk_id"), F.col("chunk_id").alias("neighbour"), F.row_number().over(Window.partitionBy("seed").orderBy("chunk_id")).alias("rank"))
    return j.where(F.col("rank") <= limit)


def conflicting_signals(signals: DataFrame) -> DataFrame:
    """(candidate, kind, n): candidates with two or more different values of one kind of signal."""
    return signals.where("value IS NOT NULL").groupBy("candidate", "kind").agg(F.count_distinct("value").alias("n")).where("n > 1")


def catalog_reconciliation(selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, state): matched, missing from the catalog, or blocked there. catalog: id, blocked."""
    c = catalog.select(F.col("id").alias("c"), "blocked")
    return selection.join(c, F.col("id") == F.col("c"), "left").select("id", F.when(F.col("c").isNull(), "missing").when(F.col("blocked"), "blocked").otherwise("matched").alias("state"))


def integrity_scan(evidence: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: evidence paths, chunks without evidence, paths with an end that isn't there, and ids that stand more than once."""
    e = evidence.select("evidence_id", "chunk_id", "page_id")
    n = e.agg(F.count("*").alias("evidence_paths"))
    orphan = chunks.join(e, "chunk_id", "left_anti").agg(F.count("*").alias("orphan_chunks"))
    c, p = chunks.select("chunk_id", F.lit(1).alias("c")).distinct(), pages.select("page_id", F.lit(1).alias("p")).distinct()
    broken = e.join(c, "chunk_id", "left").join(p, "page_id", "left").where("c IS NULL OR p IS NULL").agg(F.count("*").alias("broken_paths"))
    twice = e.groupBy("evidence_id").count().where("count > 1").agg(F.count("*").alias("duplicate_ids"))
    return n.crossJoin(orphan).crossJoin(broken).crossJoin(twice)


def first_per_ref(parts: list[DataFrame]) -> DataFrame:
    """(ref_id, part, score): refs of all parts, each once, from the first part that has it and there at its best score."""
    all_ = None
    for k, p in enumerate(parts):
        one = p.select("ref_id", F.lit(k).alias("part"), "score")
        all_ = one if all_ is None else all_.union(one)
    return all_.groupBy("ref_id").agg(F.min(F.struct("part", (-F.col("score")).alias("s"))).alias("b")).select("ref_id", "b.part", (-F.col("b.s")).alias("score"))


def resolve_seed(matches: DataFrame, more: DataFrame, limit: int = 5) -> DataFrame:
    """(ref_id, score, ambiguity): the best matches and, where they are fewer than limit, further ones; multi_match:n or no_match."""
    order = [F.desc("score"), F.asc("ref_id")]
    best = matches.select("ref_id", "score").orderBy(*order).limit(limit).withColumn("part", F.lit(0))
    rest = more.select("ref_id", "score").join(best, "ref_id", "left_anti").orderBy(*order).limit(limit).withColumn("part", F.lit(1))
    out = best.union(rest).orderBy("part", *order).limit(limit)
    n = out.agg(F.count("*").alias("n"))
    what = F.when(F.col("n") == 0, "no_match").when(F.col("n") > 1, F.concat(F.lit("multi_match:"), F.col("n").cast("string")))
    return n.join(out, F.lit(True), "left").select("ref_id", "score", what.alias("ambiguity"))  # limit rows beside one


def detect_gaps(refs: DataFrame, expected: DataFrame, integrity: DataFrame, unsupported: int = 3) -> DataFrame:
    """(ref_id): expected chunks that refs lack, broken paths, chunks without evidence, and the first refs without evidence.

    refs: ref_id, chunk_id, evidence_id; expected: chunk_id; integrity: the row of integrity_scan.
    """
    gap = lambda kind, col: F.concat(F.lit(f"gap:{kind}:"), F.col(col).cast("string")).alias("ref_id")
    missing = expected.distinct().join(refs.where("chunk_id IS NOT NULL"), "chunk_id", "left_anti").select(gap("missing_chunk", "chunk_id"))
    broken = integrity.where("broken_paths > 0").select(gap("broken_evidence", "broken_paths"))
    orphan = integrity.where("orphan_chunks > 0").select(gap("orphan_chunks", "orphan_chunks"))
    bare = refs.where("evidence_id IS NULL").orderBy("ref_id").limit(unsupported).select(gap("unsupported", "ref_id"))
    return missing.union(broken).union(orphan).union(bare)


def layered_manifest(layers: dict[str, DataFrame]) -> DataFrame:
    """(source, target, score, layer, evidence_id): edges of all layers in one shape. The ordinal of an edge in its layer
    goes by source and target; layers are numbered apart and by range, so no task sees a whole one."""
    out = None
    for name in sorted(layers):
        e = layers[name].select("source", "target", F.col("score").cast("double").alias("score"))
        ranged = staged(e.repartitionByRange("source", "target").sortWithinPartitions("source", "target", "score").withColumn("at", F.monotonically_increasing_id()), "manifest")
        part = F.shiftright("at", 33)
        starts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
        one = ranged.withColumn("part", part).join(F.broadcast(starts), "part").select("source", "target", "score", F.lit(name).alias("layer"), F.concat(F.lit(name + "-"), (F.col("start") + F.col("at").bitwiseAND(2**33 - 1) + 1).cast("string")).alias("evidence_id"))
        out = one if out is None else out.union(one)
    return out


def materialise_clusters(clusters: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """(vid, label, member_edges, skipped): a node for each cluster, and edges from those members that are nodes.

    clusters: label, members (number); members: label, member; entities: label.
    """
    from ..functions.text import slugify

    found = members.join(entities.select(F.col("label").alias("member")).distinct(), "member", "left_semi").groupBy("label").agg(F.count("*").alias("member_edges"))
    j = clusters.join(found, "label", "left").fillna(0, ["member_edges"])
    return j.select(F.concat(F.lit("vid:hyper:"), slugify(F.col("label"))).alias("vid"), "label", "member_edges", (F.col("members") - F.col("member_edges")).alias("skipped"))


def shortest_paths(edges: DataFrame, source: DataFrame) -> DataFrame:
    """(source, node_id, distance): least sums of edge weights (1 where not above 0) by relaxing what got closer, round after round."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    e = staged(edges.groupBy("src", "dst").agg(F.min(w).alias("w")), "paths-edges")
    best = staged(source.select(F.col("node_id").alias("source"), "node_id", F.lit(0.0).alias("distance")).distinct(), "paths")
    front = best
    while not front.isEmpty():
        step = front.join(e, front["node_id"] == e["src"]).groupBy("source", F.col("dst").alias("node_id")).agg(F.min(F.col("distance") + F.col("w")).alias("d"))
        closer = step.join(best, ["source", "node_id"], "left").where("distance IS NULL OR d < distance").select("source", "node_id", F.col("d").alias("distance"))
        front = staged(closer, "paths-front")
        best = staged(best.join(front, ["source", "node_id"], "left_anti").unionByName(front), "paths")
    return best


def ingest_rollup(results: DataFrame) -> DataFrame:
    """One row of results(id, ok, chars, sections, citations): done and failed, sums over those done, and the failed ids in order."""
    ok = F.col("ok")
    return results.agg(F.count(F.when(ok, 1)).alias("done"), F.count(F.when(~ok, 1)).alias("failed"), *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("chars", "sections", "citations")])


def whitelist_coverage(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """(entity_type, labels, covered): different gold labels, and how many of them were extracted with their type."""
    e = extracted.select(F.lower("label").alias("l"), "entity_type").distinct().withColumn("hit", F.lit(1))
    return gold.select(F.lower("label").alias("l"), "entity_type").distinct().join(e, ["l", "entity_type"], "left").groupBy("entity_type").agg(F.count("*").alias("labels"), F.count("hit").alias("covered"))


def set_metrics(expected: DataFrame, produced: DataFrame, by: str) -> DataFrame:
    """(by, precision, recall) of produced(by, id) against expected(by, id); nothing asked and nothing given is full."""
    e, p = expected.distinct().withColumn("e", F.lit(1)), produced.distinct().withColumn("p", F.lit(1))
    j = e.join(p, [by, "id"], "full").groupBy(by).agg(F.count("e").alias("ne"), F.count("p").alias("np"), F.count(F.when(F.col("e").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"))
    return j.select(by, _ratio(F.col("tp"), F.col("np"), 0.0).alias("precision"), _ratio(F.col("tp"), F.col("ne"), 0.0).alias("recall"))


def counts_map(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, total, counts): rows and, as a map in order of key, rows by kind; a null kind isn't in the map."""
    n = df.groupBy(*by, kind).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(kind).isNotNull(), F.struct(F.col(kind), "n"))))).alias("counts"))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counters added key by key, in order of key; keys that add up to null go."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x + y, x, y))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(both, lambda k, v: v.isNotNull()))))


def latency_summary(calls: DataFrame, by: str) -> DataFrame:
    """(by, calls, p50, p95, cache_rate) of calls(by, ms, cached); percentiles by nearest rank, from counts of equal values, which Spark keeps and merges."""
    p = {k: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)").alias(k) for k, q in (("p50", 0.5), ("p95", 0.95))}
    return calls.groupBy(by).agg(F.count("*").alias("calls"), p["p50"], p["p95"], (F.count(F.when(F.col("cached"), 1)) / F.count("*")).alias("cache_rate"))


def latest_patch(patches: DataFrame, steps: list[str]) -> DataFrame:
    """(id, step, patch): of the named steps the last, in order of their list, that made a patch."""
    rank = F.array_position(F.array(*map(F.lit, steps)), F.col("step"))
    return patches.where("patch IS NOT NULL").withColumn("k", rank).where("k > 0").groupBy("id").agg(F.max(F.struct("k", "step", "patch")).alias("b")).select("id", "b.step", "b.patch")


def merge_scored(rows: DataFrame) -> DataFrame:
    """(id, score, part): the highest score of an id; of equals the earliest part."""
    return rows.groupBy("id").agg(F.max(F.struct("score", (-F.col("part")).alias("p"))).alias("b")).select("id", "b.score", (-F.col("b.p")).alias("part"))


def navigation_issues(nodes: DataFrame) -> DataFrame:
    """(id, issue) of nodes(id, doc, ord, next_id, parent_id): a next that isn't the following node, a parent that isn't there or comes later, an ord that stands twice."""
    w = Window.partitionBy("doc").orderBy("ord", "id")
    n = nodes.withColumn("want", F.lead("id").over(w)).withColumn("twice", F.count("*").over(Window.partitionBy("doc", "ord")) > 1)
    p = nodes.select(F.col("id").alias("parent_id"), F.col("doc").alias("p_doc"), F.col("ord").alias("p_ord"))
    j = n.join(p, "parent_id", "left")
    issues = F.array_compact(F.array(
        F.when(~F.col("next_id").eqNullSafe(F.col("want")), "next"), F.when(F.col("parent_id").isNotNull() & (F.col("p_doc").isNull() | (F.col("p_doc") != F.col("doc"))), "parent_missing"),
        F.when(F.col("p_ord") >= F.col("ord"), "parent_order"), F.when(F.col("twice"), "ord"),
    ))
    return j.select("id", F.explode(issues).alias("issue"))


def walk_next(nodes: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(start, step, id): the nodes that following next_id meets, at most steps of them, until the end or a node met before."""
    now = starts.select(F.col("id").alias("start"), F.lit(0).alias("step"), "id", F.array("id").alias("met"))
    out = now
    to = nodes.select(F.col("id").alias("from"), "next_id")
    for k in range(1, steps + 1):
        now = now.join(to, now["id"] == to["from"]).where("next_id IS NOT NULL AND NOT array_contains(met, next_id)").select("start", F.lit(k).alias("step"), F.col("next_id").alias("id"), F.array_append("met", F.col("next_id")).alias("met"))
        out = out.union(now)
    return out.select("start", "step", "id")


def keyword_spans(text: Column, keyword: str) -> Column:
    """(start, end) of every place of a keyword, whatever its case, places not overlapping."""
    parts = F.split(F.lower(text), "\\Q" + keyword.lower() + "\\E", -1)
    n = len(keyword)
    places = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out")), lambda a, x: F.struct((a["at"] + F.length(x) + n).alias("at"), F.array_append(a["out"], F.struct((a["at"] + F.length(x)).alias("start"), (a["at"] + F.length(x) + n).alias("end"))).alias("out")), lambda a: a["out"])
    return F.when(F.size(parts) > 1, places).otherwise(F.array().cast("array<struct<start: int, end: int>>"))


def _densest(max_chars: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, starts, ends in batches:
            out = []
            for n, a, b in zip(lengths.tolist(), starts, ends, strict=True):
                a, b, window = np.asarray(a, np.int64), np.asarray(b, np.int64), min(max_chars, n)
                at = np.unique(np.append(np.maximum(0, np.minimum(n - window, (a + b) // 2 - window // 2)), 0))
                fits = b - a <= window  # of these, one that starts before a window ends before its end
                hits = np.searchsorted(np.sort(b[fits]), at + window, "right") - np.searchsorted(np.sort(a[fits]), at, "left")
                k = int(np.argmax(hits))
                out.append((int(at[k]), int(at[k]) + window, int(hits[k])))
            yield pd.DataFrame(out, columns=["start", "end", "hits"])

    return run


def term_dense_window(docs: DataFrame, text_col: str, spans_col: str, max_chars: int = 320) -> DataFrame:
    """docs with window (start, end, hits): of the start of the text and windows centred on spans, the earliest that holds most
    whole spans. Counted by two searches in sorted ends, in Arrow batches, as comparing all spans with all windows is quadratic."""
    ship(docs.sparkSession)
    udf = F.pandas_udf(_densest(max_chars), "start int, end int, hits int")
    return docs.withColumn("window", udf(F.coalesce(F.length(text_col), F.lit(0)), F.col(f"{spans_col}.start"), F.col(f"{spans_col}.end")))


def batch_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): added, removed, changed or same, by id and state."""
    a, b = before.select("id", F.col("state").alias("a")), after.select("id", F.col("state").alias("b"))
    return a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "id", "full").select("id", F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed").alias("change"))


def read_back(written: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """One row: rows written, found again, lost, altered and duplicated, by key and content."""
    own = lambda df: df.select(F.col(key).alias("k"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    w, r = own(written).distinct(), own(read)
    once = r.groupBy("k").agg(F.count("*").alias("n"), F.max("h").alias("rh"))
    j = w.join(once, "k", "left")
    return j.agg(F.count("*").alias("written"), F.count("n").alias("found"), F.count(F.when(F.col("n").isNull(), 1)).alias("lost"), F.count(F.when(F.col("rh") != F.col("h"), 1)).alias("altered"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicated"))
