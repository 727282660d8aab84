"""A property graph as two DataFrames: nodes(node_id, label, vid, ...) and edges(src, dst, edge_type, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import staged


def eligible(nodes: DataFrame) -> DataFrame:
    """Nodes that may be retrieved; a missing flag is no."""
    return nodes.where("retrieval_eligible")


def one_hop(nodes: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """(src_vid, dst_vid, weight) of one type."""
    a, b = nodes.select(F.col("node_id").alias("src"), F.col("vid").alias("src_vid")), nodes.select(F.col("node_id").alias("dst"), F.col("vid").alias("dst_vid"))
    return edges.where(F.col("edge_type") == edge_type).join(a, "src").join(b, "dst").select("src_vid", "dst_vid", "weight")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at neither end of any edge."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    return nodes.join(ends, "node_id", "left_anti")


def without_edge(nodes: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    out = edges.where(F.col("edge_type") == edge_type).select(F.col("src").alias("node_id"))
    return nodes.join(out, "node_id", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node_id, depth): nodes within `hops` steps of each seed, at the least depth, the seed itself at 0.

    A step joins only the frontier; what was reached before is taken out of it. The join of a step is by src, so
    edges should be laid out by src when many steps are taken.
    """
    seen = seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, hops + 1):
        step = frontier.join(edges, frontier["node_id"] == edges["src"]).select("seed", F.col("dst").alias("node_id")).distinct()
        frontier = step.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti").withColumn("depth", F.lit(d))
        if d % 3 == 0:
            frontier = staged(frontier, "reach")
        seen = seen.unionByName(frontier)
    return seen


def two_hop_preview(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, first_hop, second_hop, edges): different nodes at one and two steps, and different edges walked."""
    a = anchors.select(F.col("node_id").alias("anchor")).distinct()
    one = a.join(edges, a["anchor"] == edges["src"]).select("anchor", F.col("src").alias("s"), F.col("dst").alias("d"), "edge_type").where("d <> anchor").distinct()
    first = one.select("anchor", F.col("d").alias("n")).distinct()
    two = first.join(edges, first["n"] == edges["src"]).select("anchor", F.col("src").alias("s"), F.col("dst").alias("d"), "edge_type").distinct()
    second = two.where("d <> anchor").select("anchor", F.col("d").alias("n")).distinct().join(first, ["anchor", "n"], "left_anti")
    walked = one.union(two).distinct()
    n = lambda df, name: df.groupBy("anchor").agg(F.count("*").alias(name))
    out = a.join(n(first, "first_hop"), "anchor", "left").join(n(second, "second_hop"), "anchor", "left").join(n(walked, "edges"), "anchor", "left")
    return out.fillna(0)


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree, degree), counted in one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, self_loops, orphans, pairs with several edges."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"))
    o = orphans(nodes, edges).agg(F.count("*").alias("orphans"))
    m = edges.groupBy("src", "dst").count().where("count > 1").agg(F.count("*").alias("multi_edge_pairs"))
    return n.crossJoin(e).crossJoin(o).crossJoin(m).withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0))).otherwise(0.0))


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node id that is connected with it, edges taken both ways."""
    now = staged(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct(), "components")
    sign = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        now = staged(small, "components")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == sign:
            break
        sign = new
    return now.select(F.col("b").alias("node_id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node_id"), F.col("a").alias("component")).distinct())


def pagerank(edges: DataFrame, iterations: int = 20, alpha: float = 0.15, seeds: DataFrame | None = None) -> DataFrame:
    """(node_id, rank): a walk that jumps with probability alpha, to the seeds if given, else anywhere.

    Ranks sum to 1; what reaches nodes without out-edges jumps too. Edges are weighted by `weight` where it is
    above 0, else by 1. Every second iteration is written to the shared folder to cut the lineage.
    """
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0) if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = staged(e.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share"), "rank-edges")
    all_ = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()
    if seeds is None:
        jump = all_.withColumn("jump", F.lit(1.0))
    else:
        jump = all_.join(seeds.select("node_id", F.lit(1.0).alias("jump")).distinct(), "node_id", "left").fillna(0.0)
    size = jump.agg(F.sum("jump")).first()[0] or 1.0
    sinks = all_.join(out.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti").withColumn("sink", F.lit(True))
    base = staged(jump.withColumn("jump", F.col("jump") / size).join(sinks, "node_id", "left"), "rank-nodes")
    rank = base.select("node_id", F.col("jump").alias("rank"))
    for i in range(iterations):
        moved = rank.join(out, rank["node_id"] == out["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        stuck = rank.join(base.where("sink").select("node_id"), "node_id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("stuck"))
        rank = base.join(moved, base["node_id"] == moved["dst"], "left").crossJoin(F.broadcast(stuck)).select("node_id", (F.col("jump") * (alpha + (1 - alpha) * F.col("stuck")) + (1 - alpha) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 2:
            rank = staged(rank, "rank")
    return rank


def degree_rank(edges: DataFrame) -> DataFrame:
    """The fallback where no rank can be computed: a tenth of the degree."""
    return degrees(edges).select("node_id", (F.col("degree") * 0.1).alias("rank"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node_id, component) of strongly connected nodes, the least id naming each. For graphs of modest diameter.

    In each round the greatest id that reaches a node colours it; nodes that their colour's node is reached from by
    walking back within the colour are that node's component, and leave the graph.
    """
    left = staged(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    nodes = staged(edges.select(F.col("src").alias("n")).union(edges.select(F.col("dst").alias("n"))).distinct(), "scc-nodes")
    done = None
    while not nodes.isEmpty():
        colour = staged(nodes.withColumn("c", F.col("n")), "scc-colour")
        while True:
            push = left.join(colour, left["src"] == colour["n"]).select(F.col("dst").alias("n"), "c")
            new = staged(colour.union(push).groupBy("n").agg(F.max("c").alias("c")), "scc-colour")
            same = new.exceptAll(colour).isEmpty()
            colour = new
            if same:
                break
        s, d = colour.select(F.col("n").alias("src"), F.col("c").alias("cs")), colour.select(F.col("n").alias("dst"), F.col("c").alias("cd"))
        inside = staged(left.join(s, "src").join(d, "dst").where("cs = cd").select("src", "dst", "cs"), "scc-inside")
        back = staged(colour.where("n = c"), "scc-back")
        while True:
            pull = inside.join(back, (inside["dst"] == back["n"]) & (inside["cs"] == back["c"])).select(F.col("src").alias("n"), F.col("cs").alias("c"))
            new = staged(back.union(pull).distinct(), "scc-back")
            same = new.count() == back.count()
            back = new
            if same:
                break
        done = back if done is None else done.union(back)
        gone = back.select("n")
        nodes = staged(nodes.join(gone, "n", "left_anti"), "scc-nodes")
        left = staged(left.join(gone, left["src"] == gone["n"], "left_anti").join(gone, F.col("dst") == gone["n"], "left_anti"), "scc-edges")
    if done is None:
        return nodes.select(F.col("n").alias("node_id"), F.col("n").alias("component"))
    least = done.groupBy("c").agg(F.min("n").alias("component"))
    return done.join(least, "c").select(F.col("n").alias("node_id"), "component")


def similar_pairs(vectors: DataFrame, threshold: float, block: str) -> DataFrame:
    """(a, b, similarity) with a < b of one block whose cosine is above the threshold; a vector of no length is an error.

    vectors: vec_id, embedding and the blocking column. Norms are computed once per vector, before the join.
    """
    from ..functions.vectors import dot, norm

    n = norm(F.col("embedding"))
    v = vectors.select("vec_id", "embedding", block, F.when(n > 0, n).otherwise(F.raise_error(F.lit("a vector has no length"))).alias("n"))
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), F.col("n").alias("na"), block), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), F.col("n").alias("nb"), block)
    return a.join(b, block).where("a < b").withColumn("similarity", dot(F.col("ea"), F.col("eb")) / (F.col("na") * F.col("nb"))).where(F.col("similarity") > threshold).select("a", "b", "similarity")


def clusters(mentions: DataFrame, min_papers: int = 5, min_shared: int = 3) -> DataFrame:
    """(label, cluster_type, members, papers): single entities of enough papers, and pairs that share enough.

    mentions: label, entity_type, paper_id. Pairs are built within a paper, from entities that can reach min_shared.
    """
    from ..functions.classify import cluster_type

    m = mentions.select("label", "entity_type", "paper_id").distinct()
    n = m.groupBy("label", "entity_type").agg(F.count("*").alias("papers"))
    single = n.where(F.col("papers") >= min_papers).select(F.concat("label", F.lit(" mentions")).alias("label"), cluster_type(F.col("entity_type")).alias("cluster_type"), F.lit(1).alias("members"), "papers")
    often = m.join(n.where(F.col("papers") >= min_shared).select("label", "entity_type"), ["label", "entity_type"])
    a, b = often.select("paper_id", F.col("label").alias("a"), F.col("entity_type").alias("ta")), often.select("paper_id", F.col("label").alias("b"), F.col("entity_type").alias("tb"))
    pairs = a.join(b, "paper_id").where("a < b").groupBy("a", "b", "ta", "tb").agg(F.count("*").alias("papers")).where(F.col("papers") >= min_shared)
    kind = F.when(F.col("ta") == F.col("tb"), cluster_type(F.col("ta"))).otherwise("concept_cluster")
    return single.union(pairs.select(F.concat_ws(" + ", "a", "b").alias("label"), kind.alias("cluster_type"), F.lit(2).alias("members"), "papers"))
