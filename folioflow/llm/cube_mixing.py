"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's rate (target / size) is split into whole copies and a fraction. The fractions of its
documents are inclusion probabilities; the flight phase moves them along null vectors of the two
balancing constraints (documents, tokens) until each is 0 or 1. It runs in blocks of bounded size, the
at most two open documents of each block meet in the next level's blocks, and the last level's landing
settles the few that stay open per source. Blocks run from long to short documents, so
what stays open is short.

Defined results: a null text has size 0; a null source is the last of the sources; a source without
words takes none; a document is taken floor(rate) or floor(rate) + 1 times, never more than the cap;
rows equal in id, source and text are interchangeable and numbered, so many of them spread over blocks too; very long
texts count whole; an empty table gives an empty table; `take` keeps other columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Own, mix64, ship, staged, words

BLOCK = 4096
LANDING = 10
WEIGHTS = (3, 1, 2)


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) with target: sources by code point, null last, weigh `weights` in turn; no target
    is above cap times its size, and the excess goes to the others by weight. One row per source, so the
    two global windows are small: sources are first summed.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", weight).withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    capped, left = F.sum(F.lit(cap) * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    # sources in order of cap per weight: the first k are capped, and the level shared by the others must not reach their cap
    t = t.withColumn("level", (total - F.coalesce(capped, F.lit(0.0))) / left)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    return t.select("source", "source_size", F.least(F.lit(cap) * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def fly(prob: np.ndarray, size: np.ndarray, rand: np.ndarray, land: bool) -> np.ndarray:
    """The flight over documents in the given order: sums of prob and of prob * size stay the same.

    With equal starting probabilities the balancing columns are (1, size), so the null vector of three open
    documents is a cross product. At most two stay open; to land, LANDING more that were spared the
    flight, spread over the sizes, are settled with them by the best of all choices.
    """
    eps = 1e-9
    sizes, draws, opened, k = size.astype(float).tolist(), rand.tolist(), [], 0
    p = [float(round(x)) if x <= eps or x >= 1 - eps else float(x) for x in prob]
    loose = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    spared = {loose[i * len(loose) // LANDING] for i in range(LANDING)} if land and len(loose) > LANDING else set(loose) if land else set()
    for i in loose:
        if i in spared:
            continue
        opened.append(i)
        while len(opened) == 3:
            a, b, c = opened
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[j]) / v if v > 0 else -p[j] / v for j, v in zip(opened, u, strict=True) if v)
            down = min(p[j] / v if v > 0 else (p[j] - 1) / v for j, v in zip(opened, u, strict=True) if v)
            step = up if draws[k % len(draws)] * (up + down) < down else -down
            k += 1
            for j, v in zip(opened, u, strict=True):
                q = p[j] + step * v
                p[j] = 0.0 if q <= eps else 1.0 if q >= 1 - eps else q
            opened = [j for j in opened if 0.0 < p[j] < 1.0]
    if land and (last := sorted(set(opened) | spared)):
        open_sizes, open_p = np.array([sizes[j] for j in last]), np.array([p[j] for j in last])
        choices = np.arange(2 ** len(last))[:, None] >> np.arange(len(last)) & 1
        cost = np.abs(choices @ open_sizes - open_p @ open_sizes) + 0.02 * open_sizes.mean() * np.abs(choices.sum(1) - open_p.sum())
        for j, on in zip(last, choices[int(np.argmin(cost))], strict=True):
            p[j] = float(on)
    return np.array(p)


def _flight(seed: int, level: int, land: bool):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("tie", "ascending")]).combine_chunks()
        with np.errstate(over="ignore"):
            draws = mix64(block.column("tie").to_numpy().astype(np.uint64) + np.arange(len(block), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + level))
        flown = fly(block.column("prob").to_numpy(), block.column("size").to_numpy(), (draws >> np.uint64(11)) / 2.0**53, land)
        return block.set_column(block.schema.get_field_index("prob"), "prob", pa.array(flown, pa.float64()))

    return run


def mix(docs: DataFrame, size: Column | None = None, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, text_key (md5 of the text), size, source_size, target, copies (int).
    size is an expression over docs' own columns; without one, the number of words."""
    ship(docs.sparkSession)
    own = Own(docs if size is None else docs.withColumn("size of the mix", size))
    text = F.col(own.at(text_col))
    measured = own.df.select(
        F.col(own.at(id_col)).alias("doc_id"), F.col(own.at(source_col)).alias("source"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"),
        (size_of(text) if size is None else F.coalesce(F.col(own.at("size of the mix")), F.lit(0)).cast("long")).alias("size"),
    )
    # equal rows are numbered, so that they are dealt to blocks like others
    small = staged(measured.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    small = small.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")
    per = small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = staged(targets(per, share, cap, weights).alias("t").join(per.select(F.col("source").alias("s"), "n"), F.col("t.source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-targets")
    most = aims.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    flat = small.alias("d").join(aims.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")), "left").select("d.*", "source_size", "target", "n", rate.alias("rate"))
    # blocks of a source: a hash of the row deals them out, as many as its rows need
    tie = F.xxhash64("doc_id", "text_key", "k", F.lit(seed))
    flat = flat.select(
        "doc_id", "source", "text_key", "size", "source_size", "target", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("prob"), tie.alias("tie"),
        F.pmod(F.xxhash64(tie, F.lit("block")), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")).alias("block"),
    )
    schema, level, blocks = flat.schema, 0, -(-most // BLOCK)
    done = []
    while True:
        flown = flat.groupBy("source", "block").applyInArrow(_flight(seed, level, blocks <= 1), schema)
        if blocks <= 1:
            done.append(flown)
            break
        flown = staged(flown, f"mix-level{level}")
        settled = (F.col("prob") == 0) | (F.col("prob") == 1)
        done.append(flown.where(settled))
        # the next level: at most two rows of each block are open, so BLOCK // 2 blocks meet in one
        flat = flown.where(~settled).withColumn("block", F.floor(F.col("block") / (BLOCK // 2)).cast("long"))
        level, blocks = level + 1, -(-blocks // (BLOCK // 2))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", (F.col("whole") + F.col("prob").cast("int")).alias("copies"))


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs as the mix has them: each row as many times as it is taken, with its own columns, whatever their names."""
    own = Own(docs)
    id_, source, text = (own.at(c) for c in (id_col, source_col, text_col))
    # rows that share id, source and text are interchangeable: their copies are summed and shared out again
    key = mixed.groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("all_copies"), F.count("*").alias("rows")).alias("m")
    left = own.df.withColumn("key", F.md5(F.coalesce(F.col(text), F.lit("")))).alias("d")
    on = F.col(f"d.{id_}").eqNullSafe(F.col("m.doc_id")) & F.col(f"d.{source}").eqNullSafe(F.col("m.source")) & (F.col("d.key") == F.col("m.text_key"))
    j = left.join(key, on).select(*[f"d.{c}" for c in own.columns], "m.all_copies", "m.rows", "d.key")

    def copied(df: DataFrame) -> DataFrame:
        return df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("all_copies").cast("int")))).select(*own.columns)

    # equal rows are counted, and the odd copies of a key go to its different rows in order of their hash
    same = j.where("rows > 1").groupBy(*own.columns, "key", "all_copies", "rows").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(id_, source, "key").orderBy(F.xxhash64(*own.columns)).rowsBetween(Window.unboundedPreceding, -1))
    odd = F.col("all_copies") % F.col("rows") - F.coalesce(before, F.lit(0))
    same = same.withColumn("all_copies", F.col("n") * F.expr("all_copies div rows") + F.greatest(F.lit(0), F.least(F.col("n"), odd))).where("all_copies > 0")
    return own.back(copied(j.where("rows = 1 AND all_copies > 0")).unionByName(copied(same)))


def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
