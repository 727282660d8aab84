"""Text cleaning, quality, language, markup, identity and extraction over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, quality, text
from ..operators import extraction as X
from ..operators import retrieval as R
from ..sources import markup
from ..shipping import ship
from .base import query, table


@query("SELECT doc_id, sha256(text) AS sha256, length(text)::INT AS char_count FROM documents")
def content_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("SELECT sha256(text) AS sha256, count(*)::BIGINT AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1), '/+$', '') AS url
FROM (SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS u FROM pages)""")
def normalise_urls(spark, d):
    return table(spark, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_title(F.col("html")).alias("title"))


@query()
def html_sections(spark, d):
    return markup.html_sections(table(spark, d, "pages"), "page_id", "html")


@query()
def html_main_content(spark, d):
    ship(spark)
    return table(spark, d, "pages").select("page_id", markup.html_main(F.col("html")).alias("m")).select("page_id", "m.main", F.round("m.ratio", 6).alias("ratio"))


@query()
def html_document_hash(spark, d):
    ship(spark)
    return table(spark, d, "pages").select("page_id", markup.djb2_hex(F.col("html")).alias("hash"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +\n', chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text FROM documents""")
def collapse_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse_space(F.col("text")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM p WHERE pos = 0 OR trim(line) = '' OR trim(line) <> trim(before) GROUP BY doc_id""")
def dedupe_consecutive_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.drop_repeated_lines(F.col("text")).alias("text"))


_TOKENS = "regexp_extract_all(lower(text), '([A-Za-z0-9À-ɏ]+(?:[''’-][A-Za-z0-9À-ɏ]+)*)', 1)"


@query(f"""WITH w AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 6)),
t AS (SELECT doc_id, max(c) / sum(c)::DOUBLE AS share FROM (SELECT doc_id, g, count(*) AS c FROM g GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT w.doc_id, len(w) AS n, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w)::DOUBLE ELSE 0 END AS ml, CASE WHEN len(w) > 0 THEN len(regexp_extract_all(text, '[#….!?$%*@]+')) / len(w)::DOUBLE ELSE CASE WHEN trim(text) = '' THEN 0 ELSE 1 END END AS sr, coalesce(share, 0) AS ts FROM w LEFT JOIN t USING (doc_id))
SELECT doc_id, n::INT AS word_count, round(ml, 4) AS mean_word_len, round(sr, 4) AS symbol_ratio, round(ts, 4) AS ngram_repetition,
  CASE WHEN n = 0 AND sr = 0 THEN 'empty' WHEN n < 50 THEN 'too_short' WHEN ml < 2.5 OR ml > 12 OR sr > 0.12 OR ts > 0.22 THEN 'low_quality' ELSE 'ok' END AS status FROM m""")
def body_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", text.words(F.col("text")).alias("w"))
    n = F.size("w")
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    # equal trigrams are neighbours once their hashes are sorted, so the longest run is the highest count: no shuffle
    docs = docs.withColumn("g", F.when(n >= 6, F.sort_array(grams)))
    run = F.aggregate(
        "g", F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("top")),
        lambda a, x: F.struct(x.alias("last"), F.when((a["n"] > 0) & (a["last"] == x), a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["top"], F.when((a["n"] > 0) & (a["last"] == x), a["n"] + 1).otherwise(1)).alias("top")),
        lambda a: a["top"],
    )
    m = docs.select("doc_id", quality.body_measures(F.col("text"), F.col("w")).alias("m"), F.coalesce(run / F.size("g"), F.lit(0.0)).alias("share")).select("doc_id", "m.*", "share")
    return m.select("doc_id", "word_count", F.round("mean_word_len", 4).alias("mean_word_len"), F.round("symbol_ratio", 4).alias("symbol_ratio"), F.round("share", 4).alias("ngram_repetition"), quality.body_status(F.col("word_count"), F.col("mean_word_len"), F.col("symbol_ratio"), F.col("share")).alias("status"))


def _share(lang: str) -> str:
    ws = ", ".join(f"'{w}'" for w in quality.FUNCTION_WORDS[lang])
    return f"CASE WHEN len(w) > 0 THEN len([x for x in w if x IN ({ws})]) / len(w)::DOUBLE ELSE 0 END AS {lang}"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(trim(text)), '([a-zЀ-ӿÀ-ɏ]+)', 1) AS w, trim(text) AS t FROM documents),
s AS (SELECT doc_id, t, len(w) AS n, {_share('en')}, {_share('de')}, {_share('fr')} FROM w), b AS (SELECT *, greatest(en, de, fr) AS best FROM s)
SELECT doc_id, CASE WHEN t = '' OR n < 3 THEN 'unknown' WHEN best <= 0 AND n >= 8 THEN 'en' WHEN best < 0.02 THEN 'unknown' WHEN en = best THEN 'en' WHEN de = best THEN 'de' ELSE 'fr' END AS language,
  round(CASE WHEN t = '' THEN 0 WHEN n < 3 THEN 0.1 WHEN best <= 0 AND n >= 8 THEN 0.35 WHEN best < 0.02 THEN best ELSE least(0.95, 0.35 + best * 4) END, 4) AS confidence FROM b""")
def language_detect(spark, d):
    return quality.with_language(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS line_index FROM documents)
SELECT doc_id, line_index, CASE WHEN regexp_matches(t, '^(#{1,6})\s+(\S.*)$') THEN 'atx' ELSE 'numbered' END AS source FROM l
WHERE regexp_matches(t, '^(#{1,6})\s+(\S.*)$') OR (regexp_matches(t, '^([0-9]+(?:\.[0-9]+)*)[.)]?\s+(\S.+)$') AND length(trim(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)*)[.)]?\s+(\S.+)$', 2))) <= 120
  AND len(regexp_split_to_array(trim(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)*)[.)]?\s+(\S.+)$', 2)), '\s+')) <= 20)""")
def outline_signals(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "line"))
    return lines.withColumn("h", quality.heading(F.col("line"))).where("h IS NOT NULL").select("doc_id", "line_index", "h.source")


@query(r"""WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -1 - n_nationkey, '# ' || n_name || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '## ' || n_name ELSE 'of region ' || n_regionkey END FROM nation)
SELECT id, CASE WHEN NOT regexp_matches(t, '\S') THEN 'empty_source' WHEN len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '^\s*[^\s#]')]) > 0 THEN 'ok' ELSE 'no_substantive_body' END AS status FROM t""")
def full_text_quality(spark, d):
    """Of documents, and of short pages that are headings alone, or a heading with one line."""
    n = table(spark, d, "nation")
    page = F.concat(F.lit("# "), F.col("n_name"), F.lit("\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("## "), F.col("n_name"))).otherwise(F.concat(F.lit("of region "), F.col("n_regionkey").cast("string"))))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").union(n.select((-1 - F.col("n_nationkey")).cast("long"), page))
    return rows.select("id", quality.full_text_status(F.col("text")).alias("status"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g'), '_') AS slug, CASE WHEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'item' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS dash_slug,
  regexp_replace(trim(lower(p_name)), '\s+', ' ', 'g') AS label FROM part""")
def slugs_and_labels(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", text.slugify(n).alias("slug"), text.dash_slug(n).alias("dash_slug"), text.normal_label(n).alias("label"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%dataset%' OR lower(p_type) LIKE '%corpus%' OR lower(p_type) LIKE '%benchmark%' THEN 'Dataset' WHEN lower(p_type) LIKE '%method%' OR lower(p_type) LIKE '%approach%' OR lower(p_type) LIKE '%algorithm%' THEN 'Method'
  WHEN (lower(p_type) LIKE '%model%' AND lower(p_type) NOT LIKE '%world model%') OR lower(p_type) LIKE '%inference%' THEN 'Model' WHEN lower(p_type) LIKE '%metric%' OR lower(p_type) LIKE '%evaluation%' OR lower(p_type) LIKE '%result%' OR lower(p_type) LIKE '%experiment%' THEN 'Metric'
  WHEN lower(p_type) LIKE '%task%' OR lower(p_type) LIKE '%problem%' THEN 'Task' END AS entity_type FROM part""")
def classify_sections(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.section_type(F.col("p_type")).alias("entity_type"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%1%' THEN 'high' WHEN o_orderpriority LIKE '%2%' THEN 'medium' ELSE 'low' END AS tier FROM orders""")
def risk_tiers(spark, d):
    rel = F.when(F.col("o_orderpriority").contains("1"), "SUPPORTS").when(F.col("o_orderpriority").contains("2"), "CITES")
    return table(spark, d, "orders").select("o_orderkey", classify.risk_tier(rel, F.lit("")).alias("tier"))


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def next_pointer(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("SELECT conv_id * 1000 + turn AS chunk_id, next_id FROM (SELECT conv_id, turn, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_id FROM conversations) WHERE next_id IS NOT NULL")
def page_neighbours(spark, d):
    c = table(spark, d, "conversations").withColumn("chunk", F.col("conv_id") * 1000 + F.col("turn"))
    return R.page_neighbours(c, "conv_id", "turn", "chunk")


@query("""WITH t AS (SELECT DISTINCT conv_id * 1000 + turn AS part_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM conversations WHERE role = 'user')
SELECT a.token AS a, b.token AS b, count(*)::BIGINT AS n FROM t a JOIN t b ON a.part_id = b.part_id AND a.token < b.token GROUP BY 1, 2 HAVING count(*) >= 2""")
def keyword_cooccurrence(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    tokens = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("part_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("token"))
    return X.keyword_pairs(tokens, 2)


@query("""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents), n AS (SELECT lang, token, count(*) AS n FROM t GROUP BY 1, 2)
SELECT lang, token, n::BIGINT AS n, k::INT AS rank, round(1.0 / k, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS k FROM n) WHERE k <= 16""")
def keyword_frequency(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))
    return t.withColumn("rank", k).where("rank <= 16").withColumn("score", F.round(1.0 / F.col("rank"), 6))


def _held(docs, items):
    """(doc_id, item_id) of the documents (doc_id, text) that hold the text of an item (item_id, item)."""
    w = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    # an item of six words or more can only stand where its second to fifth word do (the first and last may be cut): join on these, then look at the text
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(1, 5)])))
    asked = docs.withColumn("w", w).select("doc_id", F.explode(grams).alias("g"))
    laid = items.withColumn("w", F.regexp_extract_all("item", F.lit(r"(\S+)"), 1))
    heads = laid.where("size(w) >= 6").select("item_id", "item", F.xxhash64(*[F.get("w", F.lit(k)) for k in range(1, 5)]).alias("g"))
    hits = asked.join(F.broadcast(heads) if heads.count() <= 100_000 else heads, "g").select("doc_id", "item_id", "item").distinct()
    found = hits.join(docs, "doc_id").where(F.expr("contains(text, item)")).select("doc_id", "item_id")
    # shorter ones may be cut at both ends, so each text is looked through for each of them
    short = laid.where("size(w) < 6").select("item_id", "item")
    if short.isEmpty():
        return found
    short = F.broadcast(short) if short.count() <= 100_000 else short
    return found.unionByName(docs.join(short, F.expr("contains(text, item)")).select("doc_id", "item_id"))


@query("""SELECT item_id, count(*)::BIGINT AS documents, min(doc_id) AS first_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def ground_truth_isolation(spark, d):
    """Items whose text stands in a document."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _held(docs, b).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


def _entities(spark, d):
    docs = table(spark, d, "documents")
    sections = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).withColumn("title", F.lit(""))
    names = {"Method": ["the", "que"], "Dataset": ["with", "para"], "Model": ["ing", "tion"], "Metric": ["and"]}
    return X.extract(sections, X.dictionary(spark, names))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n(kind, label, bounded) AS (VALUES ('Method', 'the', true), ('Method', 'que', true), ('Dataset', 'with', true), ('Dataset', 'para', true), ('Model', 'ing', false), ('Model', 'tion', false), ('Metric', 'and', false))
SELECT DISTINCT doc_id AS paper_id, label, kind AS entity_type FROM l JOIN n ON CASE WHEN bounded THEN regexp_matches(lower(' ' || line), '(^|[^\\p{L}\\p{N}])' || label || '([^\\p{L}\\p{N}]|$)') ELSE contains(lower(line), label) END""".replace("\\\\", "\\"))
def rule_extraction(spark, d):
    return _entities(spark, d).select("paper_id", "label", "entity_type")


@query()
def evidence_bundles(spark, d):
    return X.bundles(_entities(spark, d)).select("bundle_vid", "paper_id", "section_ord", F.concat_ws("|", "members").alias("members"))


@query()
def semantic_blocks(spark, d):
    """Blank-line blocks of documents with their type, route and state."""
    b = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("ord", "block"))
    kind = classify.block_type(F.col("block"))
    return b.select("doc_id", "ord", kind.alias("kind"), classify.chunk_route(kind, F.lit("body")).alias("r")).select("doc_id", "ord", "kind", "r.route", "r.state")


@query()
def normalise_unicode(spark, d):
    ship(spark)
    return table(spark, d, "documents").select("doc_id", text.normal_unicode(F.col("text")).alias("text"))
