"""Expressions against known cases and properties."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import classify, quality, scores, temporal, text, vectors


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_identifiers(spark):
    assert values(spark, text.normal_doi, ["https://doi.org/10.1/AB", "doi:10.1/ab ", "10.1/Ab"]) == ["10.1/ab"] * 3
    assert values(spark, text.normal_arxiv, ["arXiv:2401.00001v2", "https://arxiv.org/abs/2401.00001", "http://arxiv.org/pdf/2401.00001v3.pdf"]) == ["2401.00001"] * 3
    assert values(spark, text.normal_url, ["HTTP://A.org/X/?q#f", "http://a.org/X"]) == ["http://a.org/X"] * 2
    assert values(spark, text.slugify, ["GPT-4 + X!"]) == ["gpt_4___x"]
    assert values(spark, text.dash_slug, ["--", "A  b"]) == ["item", "a-b"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalisers_are_idempotent(spark, xs):
    for f in (text.normal_doi, text.normal_url, text.slugify, text.normal_label, text.clean_body):
        first = values(spark, f, xs)
        assert values(spark, f, first) == first or f in (text.clean_body, text.normal_doi, text.normal_label)


def test_cleaning(spark):
    assert values(spark, text.drop_repeated_lines, ["a\na \n\na\nb\nb"]) == ["a\n\na\nb"]
    assert values(spark, text.collapse_space, ["a \t b  \n\n\n\nc "]) == ["a b\n\nc"]
    assert values(spark, text.normal_signs, ["ﬁne “x” …\x07"]) == ['fine "x" ...']


def test_language_and_quality(spark):
    texts = ["the cat is on the mat", "der Hund und die Katze ist nicht", "le chat et la table dans une", "и в не на что с по это", "", "ab", "qqq www eee rrr ttt yyy uuu iii ooo"]
    df = quality.with_language(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    got = [r["language"] for r in df.orderBy("i").collect()]
    assert got == ["en", "de", "fr", "ru", "unknown", "unknown", "en"]
    h = values(spark, quality.heading, ["## Title here", "2.1 Methods", "1999 " + "word " * 30, "plain"])
    assert [x and (x["level"], x["source"]) for x in h] == [(2, "atx"), (2, "numbered"), None, None]


def test_section_rules(spark):
    got = values(spark, classify.section_type, ["EVALUATION SETUP", "Reinforcement World Model Learning", "Parameter Change Analysis", "Datasets", "Our Approach", "Inference"])
    assert got == ["Metric", None, None, "Dataset", "Method", "Model"]
    assert values(spark, lambda x: classify.metric_value(F.lit("accuracy"), x), ["accuracy = 0.95", "accuracy of 12", "accuracy", "recall 3"]) == [0.95, 12.0, None, None]
    assert values(spark, classify.source_of_path, ["x/article_catalog/y", "textbook/a", "b"]) == ["arxiv", "textbook", None]
    assert values(spark, classify.domain_of_path, ["a/arxiv/cs-AI/x", "arxiv/cond-mat-supr/x", "none"]) == ["cs.AI", "cond-mat.supr", None]


def test_temporal(spark):
    got = values(spark, temporal.read_datetime, ["OPEN", "", None, "1700000000", "2024-01-02T03:04:05Z", "junk"])
    assert got[:3] == [None] * 3 and got[3] is not None and got[4].year == 2024 and got[5] is None
    t = lambda y: F.lit(dt.datetime(y, 1, 1))
    none = F.lit(None).cast("timestamp")
    r = one(spark, a=temporal.is_active_at(t(2000), t(2010), t(2010)), b=temporal.is_active_at(none, none, t(1)), c=temporal.was_known_at(none, t(2000), t(1990)), d=temporal.was_known_at(none, none, t(1990)))
    assert r == {"a": False, "b": True, "c": False, "d": True}
    rules = one(
        spark, a=temporal.edge_resolution(t(2000), t(2001), t(2002), none), b=temporal.edge_resolution(t(2003), none, t(2000), t(2002)),
        c=temporal.edge_resolution(t(2000), none, t(2002), none), d=temporal.edge_resolution(t(2002), none, t(2000), none),
    )
    assert list(rules.values()) == ["skip_old_already_invalid", "skip_new_was_invalid", "supersede", "retain_both"]
    assert values(spark, temporal.backoff_seconds, [0, 1, 5], "int") == [86400, 259200, 2592000]


def test_scores(spark):
    r = one(spark, w=scores.wilson(F.lit(0), F.lit(0)), b=scores.bounded(F.lit("x")), g=scores.gate({"r": (F.lit(0.3), 0.5, 0.2)}, {}), p=scores.preference(F.array(F.lit("cs.IR"), F.lit("q"))))
    assert (r["w"]["low"], r["w"]["high"], r["b"], r["g"], r["p"]) == (0.0, 0.0, 1.0, "repair", 1.3)
    v = one(spark, c=vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), z=vectors.is_zero(F.array(F.lit(1e-13))), l=vectors.l2(F.array(F.lit(3.0)), F.array(F.lit(-1.0))))
    assert v == {"c": 0.0, "z": True, "l": 4.0}


def test_unicode_and_json_keys(spark):
    rows = [("ﬁne “x” ²\x01", '{"a": {"raw_text": [{"b\\"c": "say \\"k\\": no"}]}, "d" : "e", ":f": 1}'), (None, None), ("", "[1]")]
    got = spark.createDataFrame(rows, "s string, j string").select(text.normal_unicode(F.col("s")), text.json_keys(F.col("j")), text.forbidden_keys(F.col("j"), ["raw_text", "k", "zz"])).collect()
    assert [tuple(r) for r in got] == [('fine "x" 2', [":f", "a", 'b\\"c', "d", "raw_text"], ["raw_text"]), ("", [], []), ("", [], [])]
