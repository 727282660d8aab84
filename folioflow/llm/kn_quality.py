"""Quality classifier: an interpolated modified Kneser-Ney word trigram model of trusted text.

Fitting uses three quarters of the trusted texts, each different one once, and thresholds the other quarter; a caller may bound the former by max_docs a language. N-grams are counted by group-bys on their hashes, trigrams by how often they stand and the lower orders by
how many different words precede them; discounts, probabilities and back-off weights are derived by joins of the counts.
Trigrams and bigrams counted less than CUTOFF times are left out, as is usual, and their mass goes to the lower order. A word that
repeats the one before it is written as one symbol that the model never learns: a row of one word is a row of unknown words.

Scoring looks each word position of every document up in the tables of the three orders and of the two
contexts, by 64-bit hash, and sums log probabilities per document. Tables of up to MODEL_BYTES together are
read from the shared folder by each process that scores; larger ones are joined by shuffle, sharded by hash. A document is rejected if its perplexity is above the
threshold of its language: a quantile over trusted documents that weren't fitted on.

Defined results: null and blank texts have no words, a null perplexity, and are rejected; a language with
fewer than LEAST such trusted documents (null is a language) takes the quantile over all; with no trusted documents at all, all
documents that have words are kept; documents at the threshold are kept; very long texts are scored whole; repeated rows give repeated results; an empty table gives
an empty table; labels of null or unknown documents count for nothing; columns other than those named pass through `keep_good`
unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Own, discard, ship, staged, words

#: None: all of them are fitted on.
MAX_DOCS = None
#: A row of a table takes about so many bytes on an executor, if it is broadcast, or in a process that scores.
BROADCAST_BYTES, ID_BYTES = 200_000_000, 48
MODEL_BYTES, ROW_BYTES = 400_000_000, 16
#: Training text above PASS_BYTES is counted in PASSES passes; a process scores TEXTS texts at a time.
PASS_BYTES, PASSES, TEXTS = 64_000_000, 8, 256
QUANTILE = 0.995
CUTOFF = 2
#: Fewer trusted documents than this give no quantile of their own.
LEAST = 20
#: Fixed hashes: the start and the end of a text, and a word that repeats the one before it.
START, END, AGAIN = 1, 2, 3
#: Factors of xxhash64, by their usual numbers; the model that this process has read.
_P = np.array([0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_model: dict = {}
#: Parts of a language's trusted documents that are cut to max_docs before they meet.
_PARTS = 64


def _laid(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep's columns with h: hashes of two starts, the words and the end."""
    fixed = lambda *x: F.array(*[F.lit(k).cast("long") for k in x])
    laid = docs.select(*keep, F.transform(words(text), lambda w: F.xxhash64(w)).alias("h"))
    marked = F.transform("h", lambda x, i: F.when(x == F.get("h", i - 1), F.lit(AGAIN).cast("long")).otherwise(x))
    return laid.select(*[c for c in laid.columns if c != "h"], F.concat(fixed(START, START), marked, fixed(END)).alias("h"))


def _positions(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """A row for each word and the end of each document, with hashes u, v, w of the trigram that ends there."""
    laid = _laid(docs, text, keep)
    rest = [c for c in laid.columns if c != "h"]
    n = F.size("h") - 2
    grams = F.arrays_zip(F.slice("h", F.lit(1), n).alias("u"), F.slice("h", F.lit(2), n).alias("v"), F.slice("h", F.lit(3), n).alias("w"))
    return laid.select(*rest, F.inline(grams))


def _times(counts: DataFrame) -> Counter:
    """How many n-grams are counted 1, 2, 3 and 4 times."""
    return Counter({r["c"]: r["count"] for r in counts.where("c <= 4").groupBy("c").count().collect()})


def _discounts(n: Counter) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (n[k] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(x, 0.1), k) for x, k in zip(d, (0.95, 1.9, 2.9), strict=True))


def _alpha(col: str, total: str, d: tuple[float, float, float]) -> Column:
    c = F.col(col)
    return (c - F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])) / F.col(total)


def fit(train: DataFrame, text: Column, cutoff: int = CUTOFF) -> dict:
    """Tables (k, x) of the model: a3, b3, a2, b2, p1, their sizes, and the probability of an unknown word.

    Large texts are counted in PASSES passes, each over the n-grams whose middle word falls to it, so that the disk holds a share of them at a time.
    """
    spark = train.sparkSession
    train = staged(train.select(text.alias("text")), "kn-train")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 if size <= PASS_BYTES else PASSES
    n3, n2, raw3, raw2, ones = Counter(), Counter(), [], [], []

    def raw(counts: DataFrame, context: list[str], ctx_key: Column, key: Column, name: str) -> DataFrame:
        totals = counts.groupBy(*context).agg(F.sum("c").alias("total"))
        return staged(counts.where(F.col("c") >= cutoff).join(totals, context).select(key.alias("k"), ctx_key.alias("ctx"), "c", "total"), f"kn-r{name}")

    for p in range(passes):
        seen = _positions(train, F.col("text"), []).where(f"u <> {AGAIN} AND v <> {AGAIN} AND w <> {AGAIN}")
        if passes > 1:
            seen = seen.where(F.pmod(F.xxhash64("v", F.lit("pass")), F.lit(passes)) == p)
        c3 = staged(seen.groupBy("u", "v", "w").agg(F.count("*").alias("c")), "kn-c3")
        c2 = staged(c3.groupBy("v", "w").agg(F.count("*").alias("c")), "kn-c2")
        n3, n2 = n3 + _times(c3), n2 + _times(c2)
        raw3.append(raw(c3, ["u", "v"], F.xxhash64("u", "v"), F.xxhash64("u", "v", "w"), "3"))
        raw2.append(raw(c2, ["v"], F.col("v"), F.xxhash64("v", "w"), "2"))
        ones.append(staged(c2.groupBy("w").agg(F.count("*").alias("c")), "kn-o1"))
        discard(c3, c2)
        del seen, c3, c2
        if passes > 1:
            spark._jvm.System.gc()  # Spark deletes the shuffle files of what is collected
    discard(train)
    all_of = lambda tables: reduce(DataFrame.unionByName, tables)
    c1 = staged(all_of(ones).groupBy("w").agg(F.sum("c").alias("c")), "kn-c1")
    d3, d2, d1 = _discounts(n3), _discounts(n2), _discounts(_times(c1))

    def order(raws: list[DataFrame], d: tuple, name: str) -> tuple[DataFrame, DataFrame]:
        kept = staged(all_of(raws).select("k", "ctx", _alpha("c", "total", d).alias("x")), f"kn-a{name}")
        return kept, staged(kept.groupBy("ctx").agg((1 - F.sum("x")).alias("x")).select(F.col("ctx").alias("k"), "x"), f"kn-b{name}")

    a3, b3 = order(raw3, d3, "3")
    a2, b2 = order(raw2, d2, "2")
    s = c1.agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    total, types = s[0] or 0, s[1]
    free = (d1[0] * s[2] + d1[1] * s[3] + d1[2] * (types - s[2] - s[3])) / total if total else 1.0
    unknown = free / (types + 1)
    p1 = staged(c1.withColumn("total", F.lit(float(max(total, 1)))).select(F.col("w").alias("k"), (F.greatest(_alpha("c", "total", d1), F.lit(0.0)) + unknown).alias("x")), "kn-p1")
    tables = {"a3": a3, "b3": b3, "a2": a2, "b2": b2, "p1": p1}
    discard(c1, *raw3, *raw2, *ones)
    return tables | {"rows": {k: t.count() for k, t in tables.items()}, "unknown": unknown}


def _xxhash64(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long values x after the columns that gave the seed."""
    turn = lambda h, k: h << np.uint64(k) | h >> np.uint64(64 - k)
    h = (seed + _P[5] + np.uint64(8)) ^ (turn(x * _P[2], 31) * _P[1])
    h = turn(h, 27) * _P[1] + _P[4]
    h = (h ^ h >> np.uint64(33)) * _P[2]
    h = (h ^ h >> np.uint64(29)) * _P[3]
    return h ^ h >> np.uint64(32)


def _loaded(paths: dict[str, str]) -> dict[str, tuple]:
    """The model's tables as sorted keys, their values and an index of the keys, read from the shared folder once a process."""
    if paths != _model.get("paths"):
        import pyarrow.fs
        import pyarrow.parquet as pq

        _model.clear()
        tables = {}
        for name, path in paths.items():
            fs, root = pyarrow.fs.FileSystem.from_uri(path)
            t = pq.read_table(root, filesystem=fs, columns=["k", "x"])
            k, x = t.column("k").to_numpy().view(np.uint64), t.column("x").to_numpy()
            by = np.argsort(k)
            k = np.append(k[by], np.uint64(2**64 - 1))  # a last key, so a search ends
            # where the keys with each first bits start
            shift = np.uint64(64 - max(len(by).bit_length(), 1))
            firsts = np.arange(1 << (64 - int(shift)), dtype=np.uint64) << shift
            tables[name] = k, np.append(x[by], np.nan), np.searchsorted(k[:-1], firsts), shift
        _model.update(paths=paths, tables=tables)
    return _model["tables"]


def _scorer(paths: dict[str, str], unknown: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _loaded(paths)

        def x(name: str, key: np.ndarray, other: float) -> np.ndarray:
            keys, values, starts, shift = tables[name]
            at = starts[key >> shift]
            less = np.flatnonzero(keys[at] < key)
            while len(less):
                at[less] += 1
                less = less[keys[at[less]] < key[less]]
            return np.where((keys[at] == key) & (at < len(keys) - 1), values[at], other)

        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS):  # a few texts at a time
                batch = whole.slice(a, TEXTS)
                h = batch.column(batch.num_columns - 1)
                n = np.diff(h.offsets.to_numpy()) - 2
                flat = h.flatten().to_numpy().view(np.uint64)
                pair = _xxhash64(flat[1:], _xxhash64(flat[:-1], np.full(1, 42, np.uint64)))
                starts = np.cumsum(n) - n
                i = np.arange(int(n.sum())) + np.repeat(2 * np.arange(len(n)), n)  # all but a text's last two
                v, w = flat[i + 1], flat[i + 2]
                two = x("a2", pair[i + 1], 0.0) + x("b2", v, 1.0) * x("p1", w, unknown)
                p = x("a3", _xxhash64(w, pair[i]), 0.0) + x("b3", pair[i], 1.0) * two
                out = [*batch.columns[:-1], pa.array(n.astype(np.int64) - 1), pa.array(np.add.reduceat(np.log10(p), starts))]
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "n_words", "log10"])

    return run


def score(docs: DataFrame, model: dict, text: Column, keep: list[Column]) -> DataFrame:
    """keep's columns with n_words and log10 (the sum over words and end), a row for each row of docs."""
    names = ["a3", "b3", "a2", "b2", "p1"]
    if sum(model["rows"].values()) * ROW_BYTES <= MODEL_BYTES:
        ship(docs.sparkSession)
        laid = _laid(docs, text, keep)
        schema = T.StructType([*laid.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("log10", T.DoubleType())])
        return laid.mapInArrow(_scorer({k: model[k].staged_at for k in names}, model["unknown"]), schema)
    rows = _positions(docs, text, [F.monotonically_increasing_id().alias("row"), *keep])
    keys = dict(zip(names, (F.xxhash64("u", "v", "w"), F.xxhash64("u", "v"), F.xxhash64("v", "w"), F.col("v"), F.col("w")), strict=True))
    names = [c for c in rows.columns if c not in ("u", "v", "w")]
    for k, key in keys.items():
        rows = rows.withColumn(f"k_{k}", key)
    for k in keys:
        rows = rows.join(model[k].select(F.col("k").alias(f"k_{k}"), F.col("x").alias(f"x_{k}")), f"k_{k}", "left")
    x = lambda k, other: F.coalesce(F.col(f"x_{k}"), F.lit(other))
    p = x("a3", 0.0) + x("b3", 1.0) * (x("a2", 0.0) + x("b2", 1.0) * x("p1", model["unknown"]))
    return rows.groupBy(*names).agg((F.count("*") - 1).alias("n_words"), F.sum(F.log10(p)).alias("log10")).drop("row")


def fitted_on(ids: DataFrame, max_docs: int | None = MAX_DOCS) -> DataFrame:
    """(doc_id) of those to fit on: three quarters of all by a hash, as the rest sets the thresholds; with max_docs the first so many of a language."""
    h = F.xxhash64("doc_id", F.lit("fit"))
    some = ids.where(F.pmod(h, F.lit(4)) != 0).withColumn("h", h)
    if max_docs is None:
        return some.select("doc_id").distinct()
    # each of a language's parts is cut first, so no task gets more than _PARTS * max_docs of them
    for by in ([F.col("lang"), F.pmod(F.xxhash64("h"), F.lit(_PARTS))], [F.col("lang")]):
        some = some.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("k") <= max_docs).drop("k")
    return some.select("doc_id").distinct()


def judge(docs: DataFrame, labels: DataFrame, max_docs: int | None = MAX_DOCS, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each row of docs: doc_id, lang, text_key (md5 of the text), n_words, perplexity, threshold, kept."""
    trusted = staged(labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct(), "kn-trusted")
    trusted = F.broadcast(trusted) if trusted.count() * ID_BYTES <= BROADCAST_BYTES // 4 else trusted
    own = Own(docs)
    d = own.df.select(F.col(own.at(id_col)).alias("doc_id"), F.col(own.at(lang_col)).alias("lang"), F.col(own.at(text_col)).alias("text"))
    ids = d.select("doc_id", "lang").join(trusted, F.col("doc_id") == F.col("id"), "left_semi").distinct()
    chosen = staged(fitted_on(ids, max_docs).select(F.col("doc_id").alias("id")), "kn-fitted")
    few = F.broadcast(chosen) if chosen.count() * ID_BYTES <= BROADCAST_BYTES // 4 else chosen
    train = d.join(few, F.col("doc_id") == F.col("id"), "left_semi").select("text").distinct()
    model = fit(train, F.col("text"))
    scored = staged(score(d, model, F.col("text"), [F.col("doc_id"), F.col("lang"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key")]), "kn-scores")
    discard(*[model[k] for k in model["rows"]])
    scored = scored.withColumn("perplexity", F.when(F.col("n_words") > 0, F.pow(F.lit(10.0), -F.col("log10") / (F.col("n_words") + 1))))
    calm = scored.where("n_words > 0").join(trusted, F.col("doc_id") == F.col("id"), "left_semi").join(few, F.col("doc_id") == F.col("id"), "left_anti")
    cut = calm.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"), F.count("*").alias("n"))
    cut = staged(cut.where(F.col("n") >= LEAST), "kn-thresholds")  # one row a language
    total = calm.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("t")).first()["t"]
    over_all = math.inf if total is None else total
    out = scored.join(cut, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("own", F.lit(over_all)))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select("doc_id", "lang", "text_key", "n_words", "perplexity", "threshold", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    judged = judge(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, **how)
    bad = judged.where("NOT kept").select("doc_id", "lang", "text_key").distinct()
    own = Own(docs)
    left = own.df.withColumn("key", F.md5(F.coalesce(F.col(own.at(text_col)), F.lit(""))))
    on = F.col(own.at(id_col)).eqNullSafe(F.col("doc_id")) & F.col(own.at(lang_col)).eqNullSafe(F.col("lang")) & (F.col("key") == F.col("text_key"))
    return own.back(left.join(bad, on, "left_anti"))


def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).drop("text_key")
