"""Benchmark decontamination by template: texts that hold a benchmark item, perhaps with other numbers or names.

DataFrame functions only. Texts are canonicalised: numbers, units after numbers and capitalised words inside
sentences become typed placeholders (names side by side become one), the rest is lowered, punctuation goes. Windows of WINDOW
template words of the items are hash-joined with those of all documents. Hits of an item on one alignment (document position
less item position) are counted together, and so are those of a chain of alignments with steps of SLACK words at most, which
inserted and deleted words cause; slot values of both sides must map one to one within an alignment or chain. A document is
contaminated if the hits of one alignment or chain make up `coverage` of an item's windows, each window counted once. The
item windows are broadcast up to BROADCAST_BYTES, else joined by shuffle.

Defined results: null, empty and blank texts hold nothing; items of fewer words than a window are one window;
an item that begins with a capitalised word is also looked for with it as a name, as it is after a letter, comma or line break;
windows with fewer literal words than half of theirs say too little and aren't used, so an item without any other, or of
one window, is also looked for by its plain words, and values other than its own aren't found if it has no usable window; values that could map to several others take the one that most places have, of equals the greatest, and the lowest of equally
well matched items is named by `op10`; repeated rows give repeated results; very long texts are read whole; empty tables give no matches; text_col
and id_col alone are read, and `drop_contaminated` keeps other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACES, Own, staged

WINDOW = 8
COVERAGE = 0.5
#: The most words by which neighbouring alignments of a chain differ.
SLACK = 8
#: Item windows are broadcast up to this size, taken as ITEM_BYTES a row besides their values.
BROADCAST_BYTES, ITEM_BYTES = 100_000_000, 160
#: Units that follow a number.
UNITS = "km m cm mm mi miles mile ft feet in inches kg g mg lb lbs pounds oz l ml liters litres s sec seconds min minutes h hours hour days day weeks week months month years year usd eur dollars dollar euros euro cents percent pct mph kmh degrees"
#: Forms of an item: its template, that with its first word as a name, and its plain words.
TEMPLATE, NAMED, EXACT = 0, 1, 2
LINE = ["doc_id", "text_key", "item", "form", "line"]
NAME, NUMBER, UNIT = "\u0001n", "\u0001d", "\u0001u"


def _template(df: DataFrame, text_col: str) -> DataFrame:
    """df with __t, the template words of a text, and place by place __v, the values they stand for.

    The steps are columns of their own, each used more than once by the next, so that each is computed once a row.
    """
    t = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\u0001-\u0003]", " ")
    # a capitalised word right after a word that ends no sentence is a name
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;][\x20\x09-\x0D])(?=\p{Lu}\p{Ll})", "\u0001")
    # names with nothing but space between them are one word
    t = F.regexp_replace(t, "(\u0001[^\\x20\\x09-\\x0D,;\u0001]*)[\\x20\\x09-\\x0D]+(?=\u0001)", "$1\u0003")
    df = df.withColumn("__a", t)
    digits = F.regexp_replace(F.regexp_replace("__a", r"(?<=\p{N})[.,:](?=\p{N})", "\u0002"), r"(?<=\p{N})(?=\p{L})|(?<=\p{N})(?=%)", " ")
    df = df.withColumn("__b", F.when(F.col("__a").rlike(r"\p{N}"), digits).otherwise(F.col("__a")))
    bare = F.lower(F.regexp_replace("__b", "[^\\p{L}\\p{N}\\p{M}\\x20\\x09-\\x0D\u0001-\u0003%]+", ""))
    df = df.withColumn("__p", F.trim(bare, F.lit(SPACE)))
    df = df.withColumn("__q", F.regexp_replace("__p", "\u0001[^\\x20\\x09-\\x0D]*", NAME))
    units = "|".join([*UNITS.split(), "%"])
    numbers = F.regexp_replace("__q", "(?<![^\\x20\\x09-\\x0D])\\p{N}[\\p{N}\u0002]*(?![^\\x20\\x09-\\x0D])", NUMBER)
    marked = F.regexp_replace(numbers, f"(?<={NUMBER}[\\x20\\x09-\\x0D])(?:{units})(?![^\\x20\\x09-\\x0D])", UNIT)
    df = df.withColumn("__s", F.when(F.col("__q").rlike(r"\p{N}"), marked).otherwise(F.col("__q")))
    none = F.array().cast("array<string>")
    df = df.withColumn("__v", F.when(F.col("__p") == "", none).otherwise(F.split("__p", SPACES))).withColumn("__t", F.when(F.col("__p") == "", none).otherwise(F.split("__s", SPACES)))
    return df.drop("__a", "__b", "__p", "__q", "__s")


def _windows(hashes: str, width: int, kind: int) -> Column:
    """(pos, hash) of each window of an array column of word hashes; kind is 1 for template words and -1 for plain ones."""
    n = F.size(hashes)
    w = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(width)], F.lit(kind * width)).alias("hash")))
    return F.when(n >= width, w).otherwise(F.array().cast("array<struct<pos: int, hash: bigint>>"))


def _laid(df: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    laid = _template(df.select(*keep, F.col(text_col).alias("__x")), "__x").drop("__x")
    return laid.withColumn("__h", F.transform("__t", lambda w: F.xxhash64(w))).withColumn("__n", F.size("__t"))


def _exact_words(values: Column) -> Column:
    """The lowered words of a text without placeholders, from the values of its template words."""
    return F.filter(F.split(F.translate(F.array_join(values, " "), "\u0003\u0001", " "), " "), lambda w: w != "")


def _item_forms(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items laid out as they are and, if they begin with a capitalised word, with it as a name, as it is inside a sentence."""
    bare = F.trim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE))
    rows = benchmark.select(F.col(item_col).alias("item"), bare.alias("text"))
    inside = rows.where(F.col("text").rlike(r"^\p{Lu}\p{Ll}")).withColumn("text", F.concat(F.lit("x "), "text"))
    own = _laid(rows, "text", [F.col("item"), F.lit(TEMPLATE).alias("form")])
    named = _laid(inside, "text", [F.col("item"), F.lit(NAMED).alias("form")])
    for c in ("__t", "__v", "__h"):
        named = named.withColumn(c, F.slice(c, 2, F.col("__n")))
    return own.unionByName(named.withColumn("__n", F.col("__n") - 1)).where("__n > 0")


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, form, at, width, hash, slots, values): the usable windows of each form of the items."""
    laid = _item_forms(benchmark, item_col, text_col).withColumn("width", F.least(F.lit(window), F.col("__n")))

    def placeholders(at: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.get(F.col("__t"), at + k).startswith("\u0001"))

    def starts() -> Column:
        return F.sequence(F.lit(0), F.col("__n") - F.col("width"))

    def hashed(at: Column, kind: int) -> Column:
        # hashing a slice gives what hashing its words one by one gives, as _windows does for a fixed width
        return F.xxhash64(F.slice(F.col("__h"), at + 1, F.col("width")), F.col("width") * kind)

    laid = staged(laid.withColumn("__use", F.filter(starts(), lambda at: F.size(placeholders(at)) * 2 <= F.col("width"))), "bench-forms")
    out = laid.select("item", "form", "width", "__t", "__v", "__h", F.explode("__use").alias("at"))
    out = out.withColumn("slots", placeholders(F.col("at"))).withColumn("hash", hashed(F.col("at"), 1))
    out = out.withColumn("values", F.transform("slots", lambda k: F.concat_ws(" ", F.get(F.col("__t"), F.col("at") + k), F.get(F.col("__v"), F.col("at") + k))))
    cols = ["item", "form", "at", "width", "hash", "slots", "values"]
    # what has no usable window, or is one window that its surroundings may change, is looked for word by word too
    bare = laid.where((F.size("__use") == 0) | (F.col("__n") <= window)).select("item", F.lit(EXACT).alias("form"), _exact_words(F.col("__v")).alias("__t")).distinct()
    bare = bare.withColumn("__h", F.transform("__t", lambda w: F.xxhash64(w))).withColumn("__n", F.size("__t")).withColumn("width", F.least(F.lit(window), F.col("__n")))
    bare = bare.select("item", "form", "width", "__h", F.explode(starts()).alias("at")).withColumn("hash", hashed(F.col("at"), -1))
    bare = bare.withColumn("slots", F.array().cast("array<int>")).withColumn("values", F.array().cast("array<string>"))
    return out.select(*cols).unionByName(bare.select(*cols)).distinct()


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, windows, of): the items that a text holds to the coverage or more; text_key is its md5."""
    bench, own = Own(benchmark), Own(docs)
    id_, text = own.at(id_col), own.at(text_col)
    items = staged(benchmark_windows(bench.df, window, bench.at(item_col), bench.at(item_text_col)), "bench-windows")
    size = items.agg(F.count("*").alias("n"), F.sum(F.char_length(F.array_join("values", " "))).alias("chars")).first()
    kinds = sorted((r[0], r[1]) for r in items.select("width", F.when(F.col("form") == EXACT, -1).otherwise(1)).distinct().collect())  # at most two of each width up to window
    of = items.groupBy("item", "form").agg(F.count_distinct("at").alias("of"))
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    laid = _laid(own.df, text, [F.col(id_).alias("doc_id"), key.alias("text_key")])
    laid = laid.withColumn("__e", F.transform(_exact_words(F.col("__v")), lambda w: F.xxhash64(w))) if any(kind < 0 for _, kind in kinds) else laid
    # one pass over the texts: windows of all widths and both kinds, told apart by what is hashed
    windows = F.concat(*[_windows("__h" if kind > 0 else "__e", w, kind) for w, kind in kinds or [(window, 1)]])
    side = F.broadcast(items) if size["n"] * ITEM_BYTES + 2 * (size["chars"] or 0) <= BROADCAST_BYTES else items
    hits = laid.select("doc_id", "text_key", F.inline(windows)).join(side, "hash").select("doc_id", "text_key", "pos", "item", "form", "at", "slots", "values")
    hits = staged(hits.distinct(), "bench-hits")
    hits = _lines(hits)
    open_ = hits.where(F.size("slots") > 0)
    wrong = _inconsistent(own.df, open_, id_, text) if not open_.isEmpty() else None
    if wrong is not None:
        hits = hits.alias("h").join(wrong.alias("w"), _same("h", "w", [*LINE, "at", "pos"]), "left_anti")
    runs = hits.groupBy(*LINE).agg(F.count_distinct("at").alias("windows"))
    best = runs.groupBy("doc_id", "text_key", "item", "form").agg(F.max("windows").alias("windows"))
    of = of.select(F.col("item").alias("__item"), F.col("form").alias("__form"), "of")
    found = best.join(of, F.col("item").eqNullSafe(F.col("__item")) & (F.col("form") == F.col("__form"))).where(F.col("windows") >= F.col("of") * coverage)
    most = found.groupBy("doc_id", "text_key", "item").agg(F.max(F.struct((F.col("windows") / F.col("of")).alias("x"), "windows", "of")).alias("b"))
    return most.select("doc_id", "text_key", F.col("item").alias("item_id"), "b.windows", "b.of")


def _same(a: str, b: str, cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _lines(hits: DataFrame) -> DataFrame:
    """hits with `line`: each once for its alignment, and once more for its chain where that has several alignments."""
    at = Window.partitionBy("doc_id", "text_key", "item", "form")
    hits = hits.withColumn("shift", F.col("pos") - F.col("at"))
    hits = hits.withColumn("step", F.when(F.col("shift") - F.lag("shift").over(at.orderBy("shift")) > SLACK, 1).otherwise(0))
    hits = hits.withColumn("chain", F.sum("step").over(at.orderBy("shift").rangeBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("doc_id", "text_key", "item", "form", "chain")
    several = F.max("shift").over(chain) > F.min("shift").over(chain)
    alone, chained = F.concat(F.lit("a"), F.col("shift").cast("string")), F.concat(F.lit("c"), F.col("chain").cast("string"))
    lines = F.when(several, F.array(alone, chained)).otherwise(F.array(alone))
    return hits.withColumn("lines", lines).withColumn("line", F.explode("lines")).drop("shift", "step", "chain", "lines")


def _inconsistent(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hits (doc_id, text_key, item, form, line, at, pos) with a slot whose value maps otherwise than most of the line's."""
    wanted = hits.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    few = wanted.count() * ITEM_BYTES <= BROADCAST_BYTES
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    laid = _laid(texts, "text", [F.col("doc_id"), F.col("text_key")]).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
        F.posexplode(F.transform(F.arrays_zip("__t", "__v"), lambda x: F.when(x["__t"].startswith("\u0001"), F.concat_ws(" ", x["__t"], x["__v"])))).alias("__at", "__value"),
    ).where("__value IS NOT NULL")
    slots = hits.select(*LINE, "at", "pos", F.explode(F.arrays_zip("slots", "values")).alias("s")).select("*", (F.col("pos") + F.col("s.slots")).alias("where"), F.col("s.values").alias("value")).drop("s")
    pairs = staged(slots.join(laid, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")) & (F.col("where") == F.col("__at"))).drop("__id", "__key", "__at"), "bench-slots")
    votes = pairs.groupBy(*LINE, "value", "__value").agg(F.count_distinct("where").alias("n"))
    to = votes.groupBy(*LINE, "value").agg(F.max(F.struct("n", "__value"))["__value"].alias("to"))
    back = votes.groupBy(*LINE, "__value").agg(F.max(F.struct("n", "value"))["value"].alias("back"))
    j = pairs.alias("p").join(to.alias("t"), _same("p", "t", [*LINE, "value"])).join(back.alias("b"), _same("p", "b", [*LINE, "__value"]))
    return j.where("p.__value <> t.to OR p.value <> b.back").select(*[f"p.{c}" for c in [*LINE, "at", "pos"]]).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no item, with their own columns."""
    bad = find(docs, benchmark, id_col=id_col, text_col=text_col, **how).select("doc_id", "text_key").distinct()
    own = Own(docs)
    left = own.df.withColumn("key", F.md5(F.coalesce(F.col(own.at(text_col)), F.lit(""))))
    return own.back(left.join(bad, F.col(own.at(id_col)).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_anti"))


def op10(spark, sf_dir):
    """Per document: kept, and the item it holds most of (the lowest of equals), with its matched and all windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.min(F.struct((-F.col("windows") / F.col("of")).alias("x"), "item_id", "windows", "of")).alias("b"))
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    j = keyed.join(best, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    return j.select("doc_id", F.col("b").isNull().alias("kept"), F.col("b.item_id").alias("item_id"), F.col("b.windows").alias("matched_windows"), F.col("b.of").alias("item_windows"))
