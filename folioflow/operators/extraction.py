"""Rule-based extraction from sections, evidence bundles, keywords and identity signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_arxiv, normal_doi, normal_url, title_key, vid

#: Names by entity type, in the order in which they are looked for.
DICTIONARY = {
    "Method": "GEPA GRPO RLVR PPO DPO KTO GSEM PEM OPRO EoT CoT ToT GCN GAT GIN MPNN GNN".split() + ["self-evolving memory", "chain-of-thought reasoning", "in-context learning", "GraphSAGE"],
    "Dataset": "HotpotQA LiveBench MATH GSM8K MBPP HumanEval SQuAD WMT ImageNet CIFAR MNIST AGNews TriviaQA NaturalQuestions DROP BoolQ MMLU MMLU-Pro BBH ARC HellaSwag TruthfulQA AGIEval WinoGrande PIQA OpenBookQA".split(),
    "Model": "GPT-4 GPT-3.5 GPT-4o LLaMA Claude Gemini Mistral Qwen DeepSeek GLM BERT T5 BLOOM".split(),
    "Metric": "accuracy precision recall F1 BLEU ROUGE AUC MSE RMSE MAE".split(),
    "Task": ["prompt optimization", "preference optimization", "RLHF", "RAG"],
}
BOUNDED = {"Method", "Dataset", "Task"}


def dictionary(spark, names: dict[str, list[str]] = DICTIONARY) -> DataFrame:
    """(pass, ord, entity_type, label, needle, bounded) of a dictionary of names."""
    rows = [(p, i, kind, n, n.lower(), kind in BOUNDED) for p, (kind, ns) in enumerate(names.items()) for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "pass int, ord int, entity_type string, label string, needle string, bounded boolean")


def extract(sections: DataFrame, names: DataFrame) -> DataFrame:
    """(paper_id, label, entity_type, section_ord, char_start, char_end): the first find of each (label, type) of a paper.

    sections: paper_id, ord, title, text. The dictionary is a few rows by design and is broadcast. A bounded name
    counts only between signs that are no letters or digits.
    """
    text = sections.select("paper_id", F.col("ord").alias("section_ord"), F.lower(F.concat_ws(" ", "title", "text")).alias("t"))
    j = text.join(F.broadcast(names), F.expr("contains(t, needle)"))
    quoted = F.concat(F.lit("\\Q"), F.col("needle"), F.lit("\\E"))
    pattern = F.when(F.col("bounded"), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))).otherwise(quoted)
    found = j.withColumn("char_start", F.regexp_instr("t", pattern) - 1).where("char_start >= 0")
    first = F.row_number().over(Window.partitionBy("paper_id", "label", "entity_type").orderBy("pass", "section_ord", "ord", "char_start"))
    return found.withColumn("k", first).where("k = 1").select("paper_id", "label", "entity_type", "section_ord", "char_start", (F.col("char_start") + F.length("needle")).alias("char_end"))


def proposed(sections: DataFrame) -> DataFrame:
    """(paper_id, label): capitalised names after `we propose`, `present`, `introduce` or `use`."""
    found = F.regexp_extract_all("text", F.lit(r"(?i:we (?:propose|present|introduce|use)) ([^\s,.]+)"), 1)
    return sections.select("paper_id", F.explode(found).alias("label")).where("length(label) > 2 AND label rlike '^[A-Z]'").distinct()


def bundles(entities: DataFrame) -> DataFrame:
    """(bundle_vid, paper_id, section_ord, members): sections with two or more entities, named by their place."""
    g = entities.groupBy("paper_id", "section_ord").agg(F.sort_array(F.collect_set("label")).alias("members")).where("size(members) >= 2")
    return g.select(vid("bundle", F.col("paper_id").cast("string"), F.col("section_ord").cast("string")).alias("bundle_vid"), "paper_id", "section_ord", "members")


def signals(records: DataFrame) -> DataFrame:
    """(id, kind, value): normalised identity signals of records(id, doi, arxiv_id, url, sha256, title, author, year)."""
    kinds = {"doi": normal_doi(F.col("doi")), "arxiv": normal_arxiv(F.col("arxiv_id")), "url": normal_url(F.col("url")), "hash": F.lower(F.trim("sha256")), "title": F.when(F.col("title").isNotNull(), title_key(F.col("title"), F.col("author"), F.col("year")))}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    return records.select("id", F.explode(pairs).alias("s")).select("id", "s.kind", "s.value").where("value IS NOT NULL AND value <> ''")


def duplicate_candidates(signal_rows: DataFrame) -> DataFrame:
    """(kind, value, members, first_id) of signals that several records share."""
    return signal_rows.groupBy("kind", "value").agg(F.count_distinct("id").alias("members"), F.min("id").alias("first_id")).where("members > 1")


def keyword_pairs(parts: DataFrame, min_count: int = 2) -> DataFrame:
    """(a, b, n): unordered pairs of different tokens of (part_id, token) rows that share at least min_count parts."""
    t = parts.select("part_id", "token").distinct()
    a, b = t.select("part_id", F.col("token").alias("a")), t.select("part_id", F.col("token").alias("b"))
    return a.join(b, "part_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def windows_of(tokens: DataFrame, width: int = 40, step: int = 20) -> DataFrame:
    """(id, start, token): every token in each of the overlapping windows it stands in; tokens: id, pos, token."""
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("pos") - width + 1) / step)).cast("int"), F.floor(F.col("pos") / step).cast("int"))
    return tokens.select("id", F.explode(starts).alias("k"), "token").select("id", (F.col("k") * step).alias("start"), "token")


def overlaps(spans: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """(source, a, b) of half-open spans(id, source, start, stop) that overlap: joined by bins, each pair in the later start's bin."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("stop") - 1) / bin_size)))
    s = spans.where("stop > start").select("*", bins.alias("bin"))
    a, b = s.select("source", "bin", F.col("id").alias("a"), F.col("start").alias("sa"), F.col("stop").alias("ea")), s.select("source", "bin", F.col("id").alias("b"), F.col("start").alias("sb"), F.col("stop").alias("eb"))
    return a.join(b, ["source", "bin"]).where(f"a < b AND sa < eb AND sb < ea AND floor(greatest(sa, sb) / {bin_size}) = bin").select("source", "a", "b")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """existing with the incoming rows of new keys, the first of each key in the given order."""
    first = incoming.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(existing.columns))
