"""Near-dedup: fast similarity sketches, banding, exact verification and connected components.

A sketch has T coordinates. In round i < T each shingle falls into a hashed coordinate with a hashed
value; in round T + j all fall into coordinate j. Rounds stop as soon as every coordinate is
filled, so a set of n shingles costs about n + T log T steps and no coordinate stays empty.

Links are exact: texts with the same shingle set are one class, and pairs of classes that share a
band are compared on their full sets. Pairs within a band aren't all emitted: all members meet the first, then the last,
then others of their band in turn, as long as that still joins many; what is linked is one component, and members of one component don't
meet again. Bands that still hold several components are dealt into blocks of bounded size, and pairs of blocks count
the common shingles of their members of different components through an index, giving at most a link for each two components. No
cap is set on bands or partners. With bands of R rows a pair at similarity s is
met with probability 1 - (1 - s^R)^B: at 0.8, R = 4 and B = 24, all but 3e-6.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts of fewer
words than a shingle are one shingle; rows that share a doc_id are judged each by its own text; a null doc_id is passed over when the smallest id is taken (a component of such rows
only has a null id); texts at the very similarity are linked; very long texts are read whole;
an empty table gives an empty table; other columns are not read, and `keep_representatives` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Own, discard, mix64, ship, staged

BANDS, ROWS = 24, 4
T = BANDS * ROWS
#: Shingles in a block of a crowded band.
BLOCK = 1 << 16
#: At most so many rounds of heads; from the third on, one goes on if it gave a link for each LEAST_LINKS-th open band.
HEADS, LEAST_LINKS = 8, 5
#: Beyond so many edges, minima are written as tables before they are joined, so that the join can split a hub's rows.
MANY_EDGES = 1_000_000
_MEMO_LIMIT = 500_000


class _WordHash(dict):
    """64-bit hashes of words; a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, seed=11)
        if len(self) < _MEMO_LIMIT:
            self[word] = h
        return h


_memo = _WordHash()


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the k-word shingles; A-Z lowered, words apart at ASCII space."""
    ws = text.lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_memo.__getitem__, ws), np.uint64, len(ws))
    n = max(len(h) - k + 1, 1)
    with np.errstate(over="ignore"):
        out = np.full(n, len(ws) if len(ws) < k else k, np.uint64)
        for i in range(min(k, len(h))):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


_SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set, as round * 2^48 + value."""
    s = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * T):
        h = mix64(shingles ^ _SEEDS[i])
        value = (h >> np.uint64(16)) | (np.uint64(i) << np.uint64(48))
        if i < T:
            np.minimum.at(s, ((h & np.uint64(0xFFFF)) * np.uint64(T) >> np.uint64(16)).astype(np.intp), value)
        else:
            s[i - T] = min(s[i - T], value.min())
        if s.max() != np.iinfo(np.uint64).max:
            break
    return s


_B = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def bands(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((mix64(s.reshape(BANDS, ROWS)) * (_B | np.uint64(1))).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _sketch_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, f1, f2, out = [], [], [], []
            for text in batch.column(1).to_pylist():
                a = shingle_hashes(text, k)
                sizes.append(len(a))
                with np.errstate(over="ignore"):  # a fingerprint of the set: two independent sums of mixed hashes
                    f1.append(mix64(a ^ np.uint64(0x1234567)).sum(dtype=np.uint64))
                    f2.append(mix64(mix64(a) + np.uint64(0x89ABCDE)).sum(dtype=np.uint64))
                out.append(bands(sketch(a)).view(np.int64) if len(a) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate([*out, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x, k).view(np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))], names=["class", "shingles"])

    return run


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersections of the sorted sets in columns 2 and 3."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        av, bv, ao, bo = np.asarray(a.values), np.asarray(b.values), np.asarray(a.offsets), np.asarray(b.offsets)
        n = [len(np.intersect1d(av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]], assume_unique=True)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["a", "b", "both"])


def _links_of_blocks(percent: int):
    """Links between different components of two blocks of a band (or within one), as few as join the same."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, comp, side = (table.column(c).to_numpy() for c in ("class", "component", "side"))
        one_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sets = table.column("shingles").chunk(0) if table.num_rows else None
        offsets, values = np.asarray(sets.offsets), np.asarray(sets.values)
        sizes = np.diff(offsets)
        values = values[offsets[0] : offsets[-1]]
        owner = np.repeat(np.arange(len(cls)), sizes)
        order = np.argsort(values, kind="stable")
        by_value, by_owner = values[order], owner[order]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                x = y
            return x

        out_a, out_b = [], []
        starts = offsets - offsets[0]
        for x in range(len(cls)):
            if not one_block and side[x] == 1:
                continue
            mine = values[starts[x] : starts[x + 1]]
            lo, hi = np.searchsorted(by_value, mine, "left"), np.searchsorted(by_value, mine, "right")
            n = hi - lo
            hits = by_owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            both = np.bincount(hits, minlength=len(cls))
            near = (100 * both >= percent * (sizes[x] + sizes - both)) & (comp != comp[x])
            near &= np.arange(len(cls)) > x if one_block else side == 1
            for y in np.flatnonzero(near).tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out_a.append(int(cls[x]))
                    out_b.append(int(cls[y]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the least id that each end of edges(a, b) reaches, by alternating large and small stars.

    Each round writes the shrinking edges to the shared folder; groups are only ever summed to their minimum.
    """
    now = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    before, n = None, now.count()
    while True:
        last, apart = now, n > MANY_EDGES
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = staged(least, f"{name}-least") if apart else least
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        large = staged(large, f"{name}-large") if apart else large
        # small star: every end points down to the least of its lower neighbours
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        low = staged(low, f"{name}-low") if apart else low
        small = large.join(low, "b").select("m", F.col("a").alias("x")).union(low.select("m", F.col("b").alias("x"))).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        now = staged(small, name)
        discard(last, *([least, large, low] if apart else []))
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(2**31)))).first()
        n = sign[0]
        if sign == before:
            break
        before = sign
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, text_key (md5 of the text), and group, a number
    of the component that differs even where components share their least doc_id (null without words)."""
    ship(docs.sparkSession)
    own = Own(docs)
    docs, id_col, text_col = own.df, own.at(id_col), own.at(text_col)
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    sketched = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), key.alias("key")).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id struct<id bigint, key string>, n_shingles long, f1 long, f2 long, bands array<long>"
    rows = staged(sketched.mapInArrow(_sketch_batches(shingle), schema), "sketches").select("doc_id.*", "n_shingles", "f1", "f2", "bands")
    # texts with one shingle set are one class, numbered as the table is written; its text is looked up by one text key of it
    full = rows.where("n_shingles > 0")
    classes = staged(
        full.groupBy("n_shingles", "f1", "f2").agg(F.min("id").alias("least"), F.min("key").alias("class_key"), F.first("bands").alias("bands"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    banded = classes.select("class", "n_shingles", F.posexplode("bands").alias("at", "h")).select("class", "n_shingles", F.xxhash64("at", "h").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = staged(banded.join(crowded, "band"), "bands")
    label = _labels(docs, met, classes, shingle, percent, text_col)
    joined = classes.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = staged(joined.join(least, "component").select("n_shingles", "f1", "f2", "component", "component_id"), "class-components")
    out = rows.alias("r").join(ids.alias("c"), (F.col("r.f1") == F.col("c.f1")) & (F.col("r.f2") == F.col("c.f2")) & (F.col("r.n_shingles") == F.col("c.n_shingles")), "left")
    component = F.when(F.col("r.n_shingles") > 0, F.col("c.component_id")).otherwise(F.col("r.id"))
    return out.select(F.col("r.id").alias("doc_id"), "r.n_shingles", component.alias("component_id"), F.col("r.id").eqNullSafe(component).alias("kept"), F.col("r.key").alias("text_key"), F.col("c.component").alias("group"))


def _labels(docs: DataFrame, met: DataFrame, classes: DataFrame, shingle: int, percent: int, text_col: str) -> DataFrame:
    """(class, component) of the classes that share a band with another; met: (band, class, n_shingles, members)."""
    # the full sets of these classes, from their texts
    wanted = met.select("class").distinct().join(classes.select("class", "class_key"), "class")
    keyed = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).cast("binary").alias("text"))
    texts = keyed.join(wanted, F.col("key") == F.col("class_key")).groupBy("class").agg(F.first("text").alias("text"))
    sets = staged(texts.mapInArrow(_set_batches(shingle), "class long, shingles array<long>"), "sets")
    label = staged(met.select("class", F.col("class").alias("component")).distinct(), "labels")

    def merged(links: DataFrame) -> DataFrame:
        """The labels, with the components that links (a, b) join made one."""
        la, lb = label.select(F.col("class").alias("a"), F.col("component").alias("x")), label.select(F.col("class").alias("b"), F.col("component").alias("y"))
        of = components(links.join(la, "a").join(lb, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), "component-edges")
        of = of.select(F.col("id").alias("component"), F.col("component").alias("to"))
        return staged(label.join(of, "component", "left").select("class", F.coalesce("to", "component").alias("component")), "labels")

    # the members of a band meet its first, then its last member: bands of up to three are done then; larger ones go on with others
    for turn in range(HEADS):
        now = met.join(label, "class") if turn < 2 else met.where("members > 3").join(label, "class")
        order = F.col("class") if turn < 2 else F.xxhash64("class", F.lit(turn))
        pick = F.max if turn == 1 else F.min
        ends = now.groupBy("band").agg(pick(F.struct(order.alias("o"), "class", "n_shingles", "component")).alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        heads = staged(ends.where("lo <> hi").select("band", F.col("h.class").alias("head"), F.col("h.n_shingles").alias("n_head"), F.col("h.component").alias("c_head")), "heads")
        n_heads = heads.count()
        if not n_heads:
            if turn < 2:
                continue
            return label
        ordered = F.col("class") < F.col("head")
        pairs = now.join(heads, "band").where(f"component <> c_head AND 100 * least(n_shingles, n_head) >= {percent} * greatest(n_shingles, n_head)").select(
            F.least("class", "head").alias("a"), F.greatest("class", "head").alias("b"),
            F.when(ordered, F.col("n_shingles")).otherwise(F.col("n_head")).alias("na"), F.when(ordered, F.col("n_head")).otherwise(F.col("n_shingles")).alias("nb"),
        )
        pairs = staged(pairs.distinct(), "pairs")
        sa, sb = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
        both = pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "set_a", "set_b").mapInArrow(_intersections, "a long, b long, both long")
        links = staged(both.join(pairs, ["a", "b"]).where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b"), "links")
        n_links = links.count()
        label = merged(links) if n_links else label
        discard(heads, pairs, links)
        if turn >= 2 and n_links * LEAST_LINKS < n_heads:
            break
    # the rest: bands of several components, in blocks of bounded size; blocks of one and the same component don't meet
    now = staged(met.where("members > 3").join(label, "class").drop("members"), "open-members")
    open_ = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    parts = staged(now.join(open_, "band").groupBy("band", "component").agg(F.sum("n_shingles").alias("size")), "open-parts")
    if parts.isEmpty():
        return label
    rest = parts.where(F.col("size") < BLOCK).groupBy("band").agg(F.ceil(F.sum("size") / BLOCK).alias("rest_blocks"))
    # a large component has blocks of its own; small ones share the band's remaining blocks
    plan = parts.join(rest, "band", "left").select(
        "band", "component", (F.col("size") >= BLOCK).alias("own"),
        F.when(F.col("size") >= BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(F.col("rest_blocks")).alias("blocks"),
    )
    deal = F.pmod(F.xxhash64("class", F.lit("block")), F.col("blocks"))
    name = F.when(F.col("own"), F.concat_ws("/", F.col("component").cast("string"), deal.cast("string"))).otherwise(F.concat(F.lit("/"), deal.cast("string")))
    tagged = staged(now.join(plan, ["band", "component"]).select("band", "class", "component", "own", name.alias("block")), "open-blocks")
    blocks = tagged.groupBy("band", "block").agg(F.max(F.when(F.col("own"), F.col("component"))).alias("only"))
    left, right = blocks.select("band", F.col("block").alias("i"), F.col("only").alias("only_i")), blocks.select("band", F.col("block").alias("j"), F.col("only").alias("only_j"))
    meet = staged(left.join(right, "band").where("i <= j AND (only_i IS NULL OR only_j IS NULL OR only_i <> only_j)").select("band", "i", "j"), "block-pairs")
    mine = tagged.select("band", "class", "component", "block")
    rows = mine.join(meet, (mine["band"] == meet["band"]) & (mine["block"] == meet["i"])).select(meet["band"], "i", "j", "class", "component", F.lit(0).alias("side")).union(
        mine.join(meet, (mine["band"] == meet["band"]) & (mine["block"] == meet["j"]) & (meet["i"] < meet["j"])).select(meet["band"], "i", "j", "class", "component", F.lit(1).alias("side"))
    )
    links = rows.join(sets, "class").groupBy("band", "i", "j").applyInArrow(_links_of_blocks(percent), "a long, b long")
    return merged(staged(links.distinct(), "links"))


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with its own columns: the least id, and of equal rows one.

    Rows without words are no group and all stay.
    """
    judged = near_duplicates(docs, shingle, percent, id_col, text_col).where("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_key").alias("key"))
    first = staged(judged.groupBy("group").agg(F.min(rank).alias("first")), "firsts")  # a table, so a large group can be split in the join
    rows = staged(judged.join(first, "group").select("doc_id", "text_key", (rank == F.col("first")).alias("stays")), "representatives")
    own = Own(docs)
    id_ = own.at(id_col)
    left = own.df.withColumn("key", F.md5(F.coalesce(F.col(own.at(text_col)), F.lit(""))))

    def of(df: DataFrame):
        return df.select("doc_id", "text_key").distinct(), F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))

    stay = left.join(*of(rows.where("NOT stays")), "left_anti")
    # rows that repeat an id and its text
    again = rows.where("stays").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return own.back(stay)
    once, same = stay.join(*of(again), "left_anti"), stay.join(*of(again), "left_semi")
    return own.back(once.unionByName(same.dropDuplicates([id_, "key"])))


def op9(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).drop("text_key", "group")
