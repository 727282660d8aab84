"""Operators on small hand-made tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (it registers the queries)
from folioflow.functions import claims, quality
from folioflow.operators import evaluation, extraction, graph, jobs, lifecycle, packages, retrieval
from folioflow.plans.base import QUERIES, SQL
from folioflow.sources import files, markup
from folioflow.streaming import ingest


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "T", 1.0) for a, b in pairs], "src long, dst long, edge_type string, weight double")


def test_traversal(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)])
    got = {(r["node_id"], r["depth"]) for r in graph.reach(e, spark.createDataFrame([(1,)], "node_id long"), 5).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r["node_id"]: r["component"] for r in graph.components(edges(spark, chain)).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100
    scc = {r["node_id"]: r["component"] for r in graph.strong_components(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)])).collect()}
    assert scc == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_pagerank_sums_to_one_and_follows_seeds(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1)])
    assert abs(sum(r["rank"] for r in graph.pagerank(e, 10).collect()) - 1) < 1e-9
    r = {x["node_id"]: x["rank"] for x in graph.pagerank(e, 30, seeds=spark.createDataFrame([(2,)], "node_id long")).collect()}
    assert r[4] == 0.0 and r[2] > r[3] > r[1]


def test_clusters(spark):
    rows = [("GPT-4", "Model", p) for p in range(6)] + [("PPO", "Method", p) for p in range(4)] + [("GRPO", "Method", p) for p in range(4)] + [("rare", "Task", 1)]
    got = {r["label"]: (r["cluster_type"], r["members"]) for r in graph.clusters(spark.createDataFrame(rows, "label string, entity_type string, paper_id int")).collect()}
    assert got["GPT-4 mentions"] == ("concept_cluster", 1) and got["GRPO + PPO"] == ("method_family", 2) and "rare mentions" not in got


def test_zero_vectors_are_an_error(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="no length"):
        graph.similar_pairs(v, 0.5, "label").collect()
    with pytest.raises(Exception, match="dimension"):
        retrieval.top_k(v, [1.0], 1).collect()


def test_hybrid(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, score double")
    g = spark.createDataFrame([("b", 1.0), ("c", 0.4), ("c", 0.2)], "id string, score double")
    got = [(r["id"], round(r["fusion"], 3), r["candidate_source"]) for r in retrieval.hybrid(v, g).collect()]
    assert got == [("b", 0.65, "both"), ("a", 0.63, "vector"), ("c", 0.12, "graph")]
    assert [r["id"] for r in retrieval.hybrid(v, g, "graph_only").collect()] == ["b", "c"]


def test_bounded_traversal():
    near = {"a": ["b", "c", "d", "e"], "b": ["f"], "c": [], "d": []}
    route = retrieval.bounded_traversal(["a"], lambda ids: [(i, n) for i in ids for n in near.get(i, [])], {"e": 0.9, "b": 0.5}, max_steps=2, per_step=2)
    assert [(r["id"], r["depth"]) for r in route] == [("a", 0), ("e", 1), ("b", 1), ("f", 2)]


def test_evaluation(spark):
    schema = "doc_id string, ord int, label string, entity_type string"
    gold = spark.createDataFrame([("d", 0, "GPT-4", "Model"), ("d", 1, "PPO", "Method"), ("e", 0, "x", "T")], schema)
    pred = spark.createDataFrame([("d", 0, "gpt-4", "Model"), ("d", 1, "GPT-4 turbo", "Model"), ("d", 2, "ppo", "Task")], schema)
    got = {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.fuzzy(gold, pred).collect()}
    assert got == {"d": (1, 2, 1), "e": (0, 0, 1)}
    same = {r["doc_id"]: (r["precision"], r["recall"]) for r in evaluation.exact(gold, gold.union(gold.limit(1))).collect()}
    assert same["d"] == (1.0, 1.5)
    none = evaluation.counted(gold.where("false"), gold.where("false"), ["label"]).first()
    assert (none["precision"], none["recall"], none["f1"]) == (1.0, 1.0, 1.0)
    e, r = spark.createDataFrame([("q", "1"), ("q", "2")], "question string, id string"), spark.createDataFrame([("q", "2"), ("q", "2"), ("z", "9")], "question string, id string")
    got = {x["question"]: (x["hits"], x["missing"], x["unexpected"], x["duplicates"], x["recall"]) for x in evaluation.retrieval(e, r).collect()}
    assert got == {"q": (1, 1, 0, 1, 0.5), "z": (0, 0, 1, 0, 0.0)}


def test_extraction(spark):
    s = spark.createDataFrame([("p", 0, "Related Work", "We compare GPT-4, LLaMA-3, Claude-3, and Gemini across tasks."), ("p", 1, "Experiment Setup Benchmarks", "We compare GRPO, PPO, and DPO baselines; support architecture."), ("p", 2, "Results", "F1 and accuracy; F1 again. We propose FooNet, here.")], "paper_id string, ord int, title string, text string")
    got = {(r["label"], r["entity_type"]) for r in extraction.extract(s, extraction.dictionary(spark)).collect()}
    assert {("GPT-4", "Model"), ("LLaMA", "Model"), ("Claude", "Model"), ("Gemini", "Model"), ("GRPO", "Method"), ("PPO", "Method"), ("DPO", "Method"), ("F1", "Metric"), ("accuracy", "Metric")} <= got
    assert not {x for x in got if x[1] == "Dataset"}
    assert [r["label"] for r in extraction.proposed(s).collect()] == ["FooNet"]


def test_spans_and_windows(spark):
    spans = spark.createDataFrame([(1, "s", 0, 10), (2, "s", 9, 12), (3, "s", 10, 30000), (4, "t", 0, 99)], "id int, source string, start long, stop long")
    assert {(r["a"], r["b"]) for r in extraction.overlaps(spans).collect()} == {(1, 2), (2, 3)}
    tokens = spark.createDataFrame([(1, i, f"t{i}") for i in range(50)], "id int, pos int, token string")
    got = extraction.windows_of(tokens).groupBy("start").count().collect()
    assert {(r["start"], r["count"]) for r in got} == {(0, 40), (20, 30), (40, 10)}


def test_signals(spark):
    cols = "id int, doi string, arxiv_id string, url string, sha256 string, title string, author string, year int"
    r = spark.createDataFrame([(1, "doi:10.1/A", None, None, None, "T", "a", 2020), (2, "https://doi.org/10.1/a", "arXiv:1.1v2", None, None, " t ", "A", 2020), (3, None, "1.1", None, None, None, None, None)], cols)
    got = {(x["kind"], x["members"]) for x in extraction.duplicate_candidates(extraction.signals(r)).collect()}
    assert got == {("doi", 2), ("arxiv", 2), ("title", 2)}


def test_contracts_and_references(spark):
    n = spark.createDataFrame([(1, "Paper", "p", {"vid": "p"}), (2, "Entity", "e", {}), (3, "Claim", "c", {"source_span_id": "gone"}), (4, "MetricObservation", "m", {})], "node_id long, label string, vid string, props map<string,string>")
    c = spark.createDataFrame(lifecycle.CONTRACTS, "edge_type string, source string, targets array<string>")
    e = spark.createDataFrame([(1, 2, "MENTIONS"), (2, 1, "MENTIONS"), (1, 3, "MENTIONS"), (1, 2, "ODD")], "src long, dst long, edge_type string")
    got = {(r["src"], r["dst"], r["code"]) for r in lifecycle.edge_violations(n, e, c).collect()}
    assert got == {(2, 1, "wrong_source"), (1, 3, "wrong_target"), (1, 2, "unknown_type")}
    refs = {(r["node_id"], r["field"], r["code"]) for r in lifecycle.broken_references(n, lifecycle.REFERENCES).collect()}
    assert refs == {(3, "source_span_id", "dangling"), (4, "metric_definition_id", "missing"), (4, "run_id", "missing")}


def test_queue_and_scheduler(spark):
    jobs = spark.createDataFrame([("a", "ready", 1, 5, None, None, None, 0, 2), ("b", "ready", 9, 7, None, None, None, 0, 2), ("c", "leased", 1, 1, None, "w", 10, 2, 2), ("d", "leased", 1, 1, None, "w", 10, 1, 2)], "job_id string, status string, priority int, created_at long, retry_after long, lease_owner string, lease_until long, attempt_count int, max_attempts int")
    now = F.lit(100).cast("long")
    assert {r["job_id"] for r in lifecycle.claim(jobs, "me", now, 60).where("lease_owner = 'me'").collect()} == {"b"}
    assert {r["job_id"]: r["status"] for r in lifecycle.reclaim(jobs, now).collect()} == {"a": "ready", "b": "ready", "c": "failed", "d": "ready"}
    tasks = spark.createDataFrame([("1", "x", "pending", 9, 0, 0), ("2", "x", "pending", 0, 0, 0)], "arxiv_id string, task_type string, status string, retry_count int, last_retry long, next_retry long")
    got = {r["arxiv_id"]: (r["status"], r["next_retry"]) for r in lifecycle.after_failure(tasks, F.lit(True), now).collect()}
    assert got == {"1": ("failed", 2**63 - 1), "2": ("pending", 100 + 86400)}
    again = lifecycle.add_pending(tasks, tasks.limit(1).union(spark.createDataFrame([("3", "x", "pending", 0, 0, 0)], tasks.schema)))
    assert again.count() == 3


def test_stage_order():
    assert lifecycle.run_stages([("a", [], lambda: None), ("b", ["a"], lambda: 1 / 0), ("c", ["b"], lambda: None)], "continue") == {"a": "ok", "b": "failed: division by zero", "c": "skipped"}
    with pytest.raises(ValueError):
        lifecycle.run_stages([("a", ["b"], lambda: None), ("b", [], lambda: None)])


TEI = """<TEI><titleStmt><title level="a">A <i>B</i></title></titleStmt><abstract><p>Abs</p></abstract><body><div><head n="1">Intro</head><p>x</p></div><div><head>Next</head><p>y <ref>z</ref></p></div></body>
<back><listBibl><biblStruct><analytic><title>Cited</title></analytic><idno type="DOI">10.1/x</idno><idno type="arXiv">arXiv:2401.1v3</idno></biblStruct></listBibl></back></TEI>"""


def test_tei(spark):
    d = spark.createDataFrame([(1, TEI), (2, "")], "id int, xml string")
    f = {r["id"]: r["f"] for r in d.select("id", markup.tei_fields(F.col("xml")).alias("f")).collect()}
    assert f[1]["title"] == "A B" and f[1]["abstract"] == "Abs" and f[2]["body"] == ""
    assert [(r["title"], r["level"], r["text"]) for r in markup.tei_sections(d, "id", "xml").orderBy("ord").collect()] == [("Intro", 1, "x"), ("Next", 1, "y z")]
    c = markup.tei_citations(d, "id", "xml").first()
    assert (c["title"], c["doi"], c["arxiv_id"]) == ("Cited", "10.1/x", "2401.1")


def test_html_and_markdown(spark):
    html = '<html><body><nav>menu</nav><article><h1>T</h1><p>Text &amp; more</p></article><script>var t="</p>";</script><footer>f</footer></body></html>'
    h = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    m = {r["id"]: r["m"]["main"] for r in h.select("id", markup.html_main(F.col("html")).alias("m")).collect()}
    assert m == {1: "# T\nText & more", 2: ""}
    assert markup.djb2(b"a") == 5381 * 33 + 97
    md = spark.createDataFrame([(1, "---\nk: v\n---\n# A\n## B\n### C\n## B\ntext\n# D")], "id int, t string")
    got = [(r["heading_id"], r["parent_id"]) for r in markup.markdown_headings(md, "id", "t").orderBy("ord").collect()]
    assert got == [("a", None), ("b", "a"), ("c", "b"), ("b-2", "a"), ("d", None)]


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    n = spark.createDataFrame([(1, "Paper"), (2, "A<b")], "node_id long, label string")
    e = edges(spark, [(1, 2)])
    files.write_snapshot(n, e, str(tmp_path / "snap"))
    n2, e2 = files.read_snapshot(spark, str(tmp_path / "snap"))
    assert n2.count() == 2 and e2.first()["dst"] == 2
    files.write_graphml(n, e, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() == 5


def test_stream_upsert_equals_batch(spark, tmp_path):
    src = spark.range(0, 50).select((F.col("id") % 20).alias("vid"), F.col("id").alias("x"))
    src.repartition(4).write.parquet(str(tmp_path / "in"))
    s = ingest.stream_table(spark, str(tmp_path / "in"), src.schema, files_per_batch=1)
    ingest.upsert_stream(s, str(tmp_path / "out"), "vid", str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 20 and got.select("vid").distinct().count() == 20


def test_audits_of_nulls_ties_and_empty_tables(spark):
    from folioflow.operators import audit as A

    old = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "c", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "c", 2)], "id int, s string, n int")
    assert [tuple(r) for r in A.silent_changes(old, new, "id", ["s", "n"]).collect()] == [(2, ["s", "n"])]
    bodies = spark.createDataFrame([("p", "x", "t", 2), ("p", "y", "t", 1), ("q", "y", "t", 1), ("q", "z", None, 1), ("r", None, "t", 5)], "k string, root string, text string, at int")
    assert {tuple(r) for r in A.body_copies(bodies, "k", "root", "text").collect()} == {("p", 2, "identical"), ("q", 2, "divergent")}
    assert {tuple(r) for r in A.first_body(bodies, "k", "root", ["x", "z"], "at").collect()} == {("p", "x", 2), ("q", "z", 1), ("r", None, 5)}
    counts = spark.createDataFrame([(0, 0), (9, 9), (20, 11), (20, 8), (20, 7)], "n int, k int")
    assert [r[0] for r in counts.select(A.sample_signal(F.col("n"), F.col("k"))).collect()] == ["blocked", "partial", "pass", "partial", "blocked"]
    gold = spark.createDataFrame([(1, "Big  Cat"), (1, " "), (2, "dog"), (3, None)], "id int, label string")
    texts = spark.createDataFrame([(1, "a BIG\ncat sat"), (2, None)], "id int, text string")
    assert {tuple(r) for r in A.grounding(gold, texts, "id", "label", "text").collect()} == {(1, "Big  Cat", True), (2, "dog", False)}
    case = spark.createDataFrame([("c", "x", "USES"), ("c", "y", "USES"), ("d", "x", "USES")], "k string, i string, t string")
    other = spark.createDataFrame([("c", "x", "USES"), ("c", "z", "IMPROVES"), ("e", "x", "USES")], "k string, i string, t string")
    assert [tuple(r) for r in A.second_judge(case, other, "k", "i", "t", ["IMPROVES"]).collect()] == [("c", 1, 1, True)]
    assert tuple(A.parity(old.limit(0), new.limit(0).withColumn("status", F.lit("done")), "id", "status").first()) == (0, 0, 0, "match")
    rows = A.slots(spark.range(50), "id", ["plain", "two_column"], 61).orderBy("slot_id").collect()
    assert [r.stratum for r in rows].count("plain") == 31 and sum(r.held_out for r in rows) == 12
    assert [r.id for r in rows if r.held_out] == list(range(38, 50)) and rows[-1].id is None and not rows[-1].held_out


def test_failure_codes_of_an_extraction(spark):
    from folioflow.operators import audit as A

    rows = [("failed", 0, 0, 0, "transport_error"), ("failed", 0, 0, 0, None), ("empty", 0, 0, 0, None), ("done", 0, 0, 0, "schema_bad"), ("done", 0, 0, 0, None), ("done", 2, 0, 0, None), ("done", 2, 1, 1, None)]
    df = spark.createDataFrame(rows, "s string, e int, r int, l int, c string")
    got = [x[0] for x in df.select(A.failure_code(*(F.col(c) for c in "serlc"))).collect()]
    assert got == ["TRANSPORT_FAILURE", "UNKNOWN", "PARTIAL_PAPER", "MALFORMED_OUTPUT", "EMPTY_CANDIDATES", "MISSING_EVIDENCE", None]


def test_whole_graph_queries(spark):
    from folioflow.plans.base import QUERIES, edges

    d = "/root/testdata/sf0.001"
    e = [(r["src"], r["dst"], r["weight"]) for r in edges(spark, d).collect()]
    top = {n: n for a, b, _ in e for n in (a, b)}

    def find(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for a, b, _ in e:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = QUERIES["weak_components"](spark, d).collect()
    assert len(got) == len(top) and {r["node_id"]: r["component"] for r in got} == {n: find(n) for n in top}

    out = {}
    for a, b, w in e:
        out.setdefault(a, {}).setdefault(b, 0.0)
        out[a][b] += float(w) if w > 0 else 1.0
    rank = dict.fromkeys(top, 1 / len(top))
    for _ in range(20):
        stuck = sum(r for n, r in rank.items() if n not in out)
        new = dict.fromkeys(top, (0.15 + 0.85 * stuck) / len(top))
        for a, to in out.items():
            total = sum(to.values())
            for b, w in to.items():
                new[b] += 0.85 * rank[a] * w / total
        rank = new
    got = {r["node_id"]: r["rank"] for r in QUERIES["pagerank"](spark, d).collect()}
    assert set(got) == set(rank) and all(abs(got[n] - rank[n]) < 1e-9 for n in rank)


def test_whole_seed_queries(spark):
    from folioflow.plans.base import QUERIES, STRIDE, edges

    d = "/root/testdata/sf0.001"
    to = {}
    for r in edges(spark, d).collect():
        to.setdefault(r["src"], set()).add(r["dst"])
    keys = [r[0] for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect()]
    want, first = set(), {}
    for s in (STRIDE + k for k in keys if k % 50 == 0):
        seen, now = {s: 0}, {s}
        for depth in range(1, 4):
            now = {b for a in now for b in to.get(a, ())} - set(seen)
            seen |= dict.fromkeys(now, depth)
        want |= {(s, n, k) for n, k in seen.items()}
        first[s] = sum(k == 1 for k in seen.values()), sum(k == 2 for k in seen.values())
    assert first and {(r["seed"], r["node_id"], r["depth"]) for r in QUERIES["k_hop_neighbourhood"](spark, d).collect()} == want
    assert {r["anchor"]: (r["first_hop"], r["second_hop"]) for r in QUERIES["two_hop_preview"](spark, d).collect()} == first


def test_all_records_are_ranked(spark):
    from folioflow.plans.base import QUERIES

    d = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice").collect()
    order = sorted(parts, key=lambda r: (-r["p_retailprice"], r["p_partkey"]))
    assert {(r["p_partkey"], r["rank"]) for r in QUERIES["rank_records"](spark, d).collect()} == {(r["p_partkey"], i) for i, r in enumerate(order, 1)}
    odd = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, None), (4, 0.5), (5, -1.0)], "id long, s double")
    assert {r["id"]: r["rank"] for r in retrieval.ranked(odd, "id", "s").collect()} == {1: 1, 4: 2, 2: 3, 3: 4, 5: 5}
    assert retrieval.ranked(odd.where("false"), "id", "s").count() == 0


def test_short_items_are_held(spark):
    from folioflow.plans.text_queries import _held

    items = [(1, "two words"), (2, "here are five short words"), (3, "one two three four five six"), (4, "word"), (5, "not there at all"), (6, None)]
    texts = ["so two words.", "there are five short words", "here are five short words, and swords", "one two three four five sixty", "bone two three four five six.", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in _held(docs, spark.createDataFrame(items, "item_id long, item string")).collect()]
    assert sorted(got) == sorted((i, k) for i, t in enumerate(texts) for k, x in items if t is not None and x is not None and x in t)


def test_shortest_paths_and_components_of_nothing(spark):
    rows = [(1, 2, "T", 5.0), (1, 3, "T", 1.0), (3, 2, "T", 1.5), (2, 4, "T", 0.0), (4, 1, "T", 1.0)]
    e = spark.createDataFrame(rows, "src long, dst long, edge_type string, weight double")
    got = {(r["source"], r["node_id"]): r["distance"] for r in packages.shortest_paths(e, spark.createDataFrame([(1,), (9,)], "node_id long")).collect()}
    assert got == {(1, 1): 0.0, (1, 3): 1.0, (1, 2): 2.5, (1, 4): 3.5, (9, 9): 0.0}
    assert graph.strong_components(e.where("false")).count() == 0


def test_full_text_status(spark):
    rows = [("# T\nshort body here", "ok"), ("# T\n  ## U\n", "no_substantive_body"), (" \n\t", "empty_source"), (None, "empty_source"), ("x", "ok"), ("#\n\n  text", "ok")]
    got = spark.createDataFrame(rows, "t string, want string").select(quality.full_text_status(F.col("t")).alias("s"), "want").collect()
    assert all(r["s"] == r["want"] for r in got)


def test_html_parts_and_hash(spark):
    def plain(data):
        h = 5381
        for b in data:
            h = (h * 33 + b) % 2**64
        return h

    for data in (b"", b"a", "straße und mehr".encode() * 50):
        assert markup.djb2(data) == plain(data)
    page = "<html><body><nav>menu<br><img src=x><article><h1>Title</h1><p>Text<br>more</p></article><aside>ads</aside></body></html>"
    got = spark.createDataFrame([(page,)], "h string").select(markup.html_main(F.col("h")).alias("m")).first()["m"]
    assert "Text" in got["main"] and "Title" in got["main"] and "ads" not in got["main"] and "menu" not in got["main"]


def test_reports_have_all_rows(spark):
    assert files.markdown(spark.range(5)).count("\n") == 6
    with pytest.raises(ValueError, match="more than"):
        files.markdown(spark.range(5), limit=4)


def test_queue(spark):
    now = F.lit(100).cast("long")
    schema = "job_id string, status string, priority int, attempt_count int, max_attempts int, retry_after long, lease_owner string, lease_until long, created_at long, extra string"
    none = spark.createDataFrame([], schema)
    new = spark.createDataFrame([("a", 1, 3), ("a", 0, 3), ("b", 2, 1), ("c", 5, 2), (None, 1, 1)], "job_id string, priority int, max_attempts int")
    queued = jobs.enqueue(none, new, now)
    assert {(r["job_id"], r["status"], r["priority"], r["created_at"]) for r in queued.collect()} == {("a", "pending", 0, 100), ("b", "pending", 2, 100), ("c", "pending", 5, 100)}
    assert jobs.enqueue(queued, new, now).count() == 3
    needs = spark.createDataFrame([("b", "a", None, None, None), ("c", None, "r", "h", None), ("c", None, "s", None, None)], "job_id string, needs_job string, needs_ref string, expected_hash string, required_status string")
    artifacts = spark.createDataFrame([("r", "h"), ("s", "x")], "ref string, hash string")

    def states(df):
        return {r["job_id"]: r["status"] for r in df.collect()}

    ready = jobs.settle(queued, needs, artifacts, now)
    assert states(ready) == {"a": "ready", "b": "blocked", "c": "blocked"}
    leased = lifecycle.claim(ready, "w", now, 10)
    results = spark.createDataFrame([("a", "w", "complete", None, None), ("b", "w", "fail", None, None)], "job_id string, worker string, outcome string, retry_after long, lease_seconds int")
    done = jobs.report(leased, results, now)
    assert states(done) == {"a": "done", "b": "blocked", "c": "blocked"}
    assert states(jobs.report(leased, results.withColumn("worker", F.lit("other")), now))["a"] == "leased"
    after = jobs.settle(done, needs, artifacts, now)
    assert states(after) == {"a": "done", "b": "ready", "c": "blocked"}
    again = jobs.report(lifecycle.claim(after, "w", now, 10), results.withColumn("outcome", F.lit("retry")), now)
    assert states(again)["b"] == "failed"
    assert [(r["job_id"], r["from_status"], r["to_status"]) for r in jobs.log(done, after, "settle", now).collect()] == [("b", "blocked", "ready")]


def test_claims(spark):
    rows = [("The cat sat", "a cat; the DOG", True), (" ", "x", True), ("cat", None, True), ("cat", "cat", None), ("one two three four five", "one", True), ("a b", "a b", True)]
    df = spark.createDataFrame(rows, "c string, s string, ok boolean")
    got = [r[0] for r in df.select(claims.faithfulness(F.col("c"), F.col("s"), F.col("ok"))).collect()]
    assert got == ["token_overlap", "empty_claim", "missing_span_text", "span_not_resolvable", "low_token_overlap", "low_token_overlap"]
    places = [(" B C ", "a b c", (2, 5)), ("b c", "a B \n c.", (2, 7)), ("x", "abc", None), ("", "abc", None), (None, "abc", None), ("b", None, None), ("a.\\E c", "..a.\\E\tc", (2, 8))]
    df = spark.createDataFrame([p[:2] for p in places], "s string, b string")
    assert [r[0] and tuple(r[0]) for r in df.select(claims.locate(F.col("s"), F.col("b"))).collect()] == [p[2] for p in places]


def test_due_rounds_seconds_as_its_sql(spark, tmp_path):
    # a cast rounds, halves to the even second: half a second past the limit is still due, a microsecond more isn't
    at = ["2024-01-18 23:59:59.999999", "2024-01-19 00:00:00.000000", "2024-01-19 00:00:00.499999", "2024-01-19 00:00:00.500000", "2024-01-19 00:00:00.500001", "2024-01-19 00:00:00.999999", "2024-01-19 00:00:01.000000", "1969-12-31 23:59:59.500000"]
    rows = [(i, t, "error") for i, t in enumerate(at)] + [(100, at[0], "view"), (101, None, "error"), (102, at[0], None)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(r[0] for r in db.execute(SQL["scheduler_due"]).fetchall())
    assert sorted(r["event_id"] for r in QUERIES["scheduler_due"](spark, str(tmp_path)).collect()) == want == [0, 1, 2, 3, 7]


def test_top_k_join_is_exact(spark, monkeypatch):
    # copies, scaled copies (one score, so ties by id), nulls and vectors without length; more queries than go at once
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (400, 4)).astype(float).tolist()
    rows = [*enumerate(v), *[(1000 + i, v[7]) for i in range(300)], (2000, [0.0] * 4), (2001, None), (None, v[7]), *[(3000 + i, [2 * x for x in v[9]]) for i in range(20)]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        for wave in (7, 1 << 16):
            monkeypatch.setattr(retrieval, "WAVE", wave)
            got = retrieval.top_k_join(vectors.where("vec_id % 50 = 0"), vectors, 6).collect()
            want = []
            for i, q in ((i, x or [0.0] * 4) for i, x in rows if i is not None and i % 50 == 0):
                score = lambda x, q=q: (sum(a * b for a, b in zip(x, q, strict=True)) / math.sqrt(n)) if (n := sum(a * a for a in x) * sum(b * b for b in q)) else 0.0
                best = sorted(((min(max(score(x or [0.0] * 4), -1.0), 1.0), j) for j, x in rows), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:6]
                want += [(i, j, s, k) for k, (s, j) in enumerate(best, 1)]
            assert sorted((x["query_id"], x["rank"], x["id"], x["score"]) for x in got) == sorted((i, k, j, s) for i, j, s, k in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert retrieval.top_k_join(vectors.limit(0), vectors, 3).count() == 0 == retrieval.top_k_join(vectors.limit(3), vectors.limit(0), 3).count()
    with pytest.raises(Exception, match="another dimension"):
        retrieval.top_k_join(vectors.limit(3), spark.createDataFrame([(1, [1.0])], vectors.schema), 1).collect()
    # no lambda over the places of a pair of vectors, which took longest
    plan = retrieval.top_k_join(vectors.limit(3), vectors, 3)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "lambda" not in plan
