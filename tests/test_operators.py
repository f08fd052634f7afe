"""Retrieval, graph, chunk, flow and maintenance operators on small relations, and the registered queries against DuckDB."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunks as C
from codeloom.operators import flow, graph, maintenance, search
from codeloom.plans import catalog, source_queries  # noqa: F401 (registers its queries)

CHUNKS = "id string, file_path string, chunk_type string, symbol_name string, signature string, start_line int, end_line int, content string, reachability string, context_weight double, semantic_role string, fold_reason string"


def chunk(i, path, symbol, content, kind="4", start=1, end=9, reach="reachable", weight=1.0, role="", fold="", signature=""):
    return (i, path, kind, symbol, signature, start, end, content, reach, weight, role, fold)


def terms(spark, text, f=T.terms):
    return set(spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0])


def test_tokenizer(spark):
    assert {"getcontextpack", "get", "context", "pack", "http", "server", "id"} <= terms(spark, "func GetContextPack() { return HTTPServerID }")
    assert {"pkg", "engine", "context", "go", "handle", "get", "pack", "engine.new", "new"} <= terms(spark, "pkg/engine/context.go handle_get-context.pack engine.New")
    asked = terms(spark, "find the get_context_pack handler in pkg/engine/context.go", T.query_terms)
    assert {"find", "get_context_pack", "handler", "pkg"} <= asked and not {"the", "in"} & asked


def ranked(spark, rows, text, **options):
    docs = spark.createDataFrame(rows, CHUNKS)
    post = search.postings(docs)
    return search.search(docs, post, search.doc_lengths(docs, post), [text], **options).orderBy("rank").collect()


def test_exact_symbol_and_ties(spark):
    rows = [chunk("u", "a.go", "Use", "TargetSymbol TargetSymbol TargetSymbol"), chunk("d", "b.go", "TargetSymbol", "func TargetSymbol"), chunk("x", "c.go", "Other", "nothing here"), chunk("y", "d.go", "More", "nothing there")]
    got = ranked(spark, rows, "TargetSymbol")
    assert got[0].id == "d" and "boost exact_symbol=2.0000" in got[0].explanation
    same = [chunk(f"{p}:{a}", p, "Same", "shared body words", start=a) for p, a in (("beta", 1), ("alpha", 20), ("alpha", 10))] + [chunk("z1", "z", "Z", "other"), chunk("z2", "z", "Z", "else thing")]
    assert [r.id for r in ranked(spark, same, "shared body")] == ["alpha:10", "alpha:20", "beta:1"]
    assert ranked(spark, same, "zzzzqqqq") == []


def test_pruning_penalty(spark):
    rows = [chunk("live", "a.go", "A", "payment risk"), chunk("dead", "b.go", "B", "payment risk", reach="unreachable", weight=0.55), chunk("o", "c.go", "C", "nothing")]
    got = ranked(spark, rows, "payment risk", pruning="soft")
    assert [r.id for r in got] == ["live", "dead"] and "penalty reachability=unreachable weight=0.5500" in got[1].explanation
    spared = ranked(spark, rows, "payment risk", pruning="soft", reachable=spark.createDataFrame([(0, "dead")], "query int, id string"))
    assert "skip_unreachable_penalty" in {r.id: r for r in spared}["dead"].explanation
    assert [C.pruning_mode(m) for m in ("", "soft", "off", " HARD ")] == ["soft", "soft", "off", "hard"]
    with pytest.raises(ValueError):
        C.pruning_mode("no")


def test_folding(spark):
    fields = "\n".join(f"F{i} string `json:\"f{i}\"`" for i in range(8))
    rows = [
        chunk("1", "a.go", "UserResponse", f"type UserResponse struct {{\n{fields}\n}}", kind="5"), chunk("2", "a.go", "ErrNotFound", 'const ErrNotFound = "x"'),
        chunk("3", "a.go", "NewUser", "func NewUser() *User {\n return &User{}\n}"), chunk("4", "a.go", "GetName", "func (u User) GetName() string {\n return u.name\n}"),
        chunk("5", "a.go", "SaveUser", "func SaveUser(u User) error {\n return store.Save(u)\n}"), chunk("6", "a.go", "logic", "func logic() {\n a := 1\n b := 2\n c(a, b)\n d()\n}"),
        chunk("7", "a.go", "gen", "// Code generated by x. DO NOT EDIT."),
    ]
    got = {r.id: (r.fold_reason, r.context_weight) for r in C.fold(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got == {"1": ("large_dto", 0.65), "2": ("error_const_block", 0.65), "3": ("trivial_constructor", 0.65), "4": ("getter_setter", 0.65), "5": ("simple_wrapper", 0.65), "6": ("", 1.0), "7": ("generated_code", 0.40)}


def test_graph(spark):
    e = spark.createDataFrame([("main.main", "engine.New"), ("engine.New", "storage.Open"), ("storage.Open", "main.main")], "src string, dst string")
    got = {(r.id, r.depth, r.direction) for r in graph.impact(e, "engine.New", 1).collect()}
    assert got == {("storage.Open", 1, "downstream"), ("main.main", 1, "upstream")}
    assert graph.reach(e, e.select(F.lit("main.main").alias("id"))).count() == 3
    nodes = spark.createDataFrame([("p.A", "p", "A", "", "a.go", 1), ("p.(T).run", "p", "run", "T", "a.go", 5), ("p.dead", "p", "dead", "", "a.go", 9)], "id string, pkg string, name string, recv string, file string, line int")
    calls = spark.createDataFrame([("p.A", "t.run"), ("p.A", "fmt.Print")], "src string, dst string")
    assert graph.resolve(nodes, calls).collect() == [("p.A", "p.(T).run")]
    assert {r.id for r in graph.closure(nodes, calls).collect()} == {"p.A", "p.(T).run"}
    label = {r.id: r.reachability for r in C.label(spark.createDataFrame([chunk("1", "a.go", "A", "x", start=1), chunk("9", "a.go", "dead", "x", start=9)], CHUNKS), nodes, graph.closure(nodes, calls)).collect()}
    assert label == {"1": "reachable", "9": "unreachable"}


def test_query_roots(spark):
    nodes = spark.createDataFrame([("p.open", "p", "open", "", "a.go", 1), ("p.read", "p", "read", "", "a.go", 5), ("p.lost", "p", "lost", "", "a.go", 9), ("main.main", "main", "main", "", "m.go", 1)], "id string, pkg string, name string, recv string, file string, line int")
    calls = spark.createDataFrame([("p.open", "read"), ("p.read", "open")], "src string, dst string")
    chunks = spark.createDataFrame([("c1", "a.go", 1), ("c5", "a.go", 5), ("c9", "a.go", 9), ("m1", "m.go", 1), ("m1b", "m.go", 1)], "id string, file_path string, start_line int")
    asked = search.asked_lists(spark, ["P.Open", "lost", "lost open", "elsewhere", "p"])
    assert {tuple(r) for r in graph.query_roots(nodes, asked).collect()} == {(0, "p.open"), (1, "p.lost")}
    got = {tuple(r) for r in graph.reachable_chunks(chunks, nodes, calls, asked).collect()}
    assert got == {(0, "c1"), (0, "c5"), (0, "m1"), (0, "m1b"), (1, "c9"), (1, "m1"), (1, "m1b")}


def test_context_and_snippet(spark):
    rows = spark.createDataFrame([("p", 0, "a" * 300), ("p", 1, "b")], "pack string, prio long, text string")
    got = C.context_pack(rows, 220).first()
    assert len(got.context) == 220 and got.context.endswith("...[truncated]") and C.context_pack(rows, 0).first().n_sections == 2
    lines = spark.createDataFrame([chunk(str(i), "f", "s", f"line {i}", start=i, end=i) for i in (1, 10, 2)], CHUNKS)
    assert [r.text for r in C.snippet(lines, "f:1-10").orderBy("line").collect()] == ["line 1", "line 2", "line 10"]


def test_maintenance_and_flow(spark):
    ev = spark.createDataFrame([(i, "f", "v") for i in range(10)], "seq long, func_id string, var_name string")
    assert [r.seq for r in maintenance.ring_buffer(ev, 5).orderBy("seq").collect()] == [5, 6, 7, 8, 9]
    defs = spark.createDataFrame([("d0", "x", "f", 1, 1, 9, 0), ("d1", "x", "f", 3, 3, 5, 1)], "def_id string, name string, scope string, at int, start int, end int, depth int")
    uses = spark.createDataFrame([("u4", "x", "f", 4), ("u7", "x", "f", 7)], "use_id string, name string, scope string, at int")
    assert {tuple(r) for r in flow.innermost(defs, uses).collect()} == {("u4", "d1"), ("u7", "d0")}


@pytest.mark.parametrize("name", ["bm25_topk", "search_ranked", "hybrid_rrf", "resolve_callees", "impact_full", "reachability", "context_pack", "innermost_def", "query_roots", "type_backward", "latency_percentiles", "source_declarations", "source_call_graph", "source_chunks", "source_def_use"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split():
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, d).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    shape = lambda f: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert shape(ours) == shape(theirs)


def test_whole_in_edges_and_dependencies(spark):
    import __spark_entry__
    from codeloom.operators import graph

    edges = spark.createDataFrame([(f"f{i}", "hot") for i in range(5)] + [("f1", "hot"), ("hot", "f1")], "src string, dst string")
    assert sorted(map(tuple, graph.in_edges(edges).collect())) == [("f1", "hot"), *(("hot", f"f{i}") for i in range(5))]
    queries, d = __spark_entry__.queries(), "/root/testdata/sf0.001"
    for whole, summary, key, n in (("caller_pairs", "reverse_adjacency", "id", "n_callers"), ("dependency_pairs", "dependencies", "pkg", "n_deps")):
        counts = {r[key]: r["count"] for r in queries[whole](spark, d).groupBy(key).count().collect()}
        assert counts == {r[key]: r[n] for r in queries[summary](spark, d).collect()} and max(counts.values()) > 1


def test_formats_and_lookups(spark):
    micros = {0: "< 1µs", 7: "7µs", 999: "999µs", 1499: "1ms", 999_600: "1s", 1_230_000: "1.23s", 65_000_000: "1m5s", 3_600_000_000: "1h0m0s"}
    assert {r.us: r.shown for r in spark.createDataFrame([(u,) for u in micros], "us long").select("us", T.duration(F.col("us")).alias("shown")).collect()} == micros
    folders = {"a.go": "main", "x/a.go": "x", "x/y/a.go": "y", "./a.go": "main", "/a.go": "/"}
    assert {r.p: r.pkg for r in spark.createDataFrame([(p,) for p in folders], "p string").select("p", T.package_of(F.col("p")).alias("pkg")).collect()} == folders
    v = spark.createDataFrame([("1", "p", "Total", "int", "p.f", "a.go", 9), ("2", "p", "Total", "int", "p.g", "a.go", 4), ("3", "p", "other", None, "p.f", "b.go", 1)], "def_id string, pkg string, name string, type string, func_id string, file string, def_line int")
    assert [r.def_id for r in flow.variables_named(v, "tot").collect()] == ["2"]
    index = flow.lookup_index(v)
    assert index.count() == 11 and {r.def_id for r in flow.lookup(index, "func", "p.f").collect()} == {"1", "3"}
    sparse = search.sparse_postings(spark.createDataFrame([("d", {"a": 0.5, "b": 0.0})], "id string, weights map<string,double>"))
    assert [tuple(r) for r in sparse.collect()] == [("d", "a", 0.5)]


def test_resolve_repeated_nodes(spark, tmp_path):
    node = [("p.A", "p", "A"), ("p.run", "p", "run")]
    rows = [(*n, "", "a.go", i) for i in range(1000) for n in node]
    spark.createDataFrame(rows, "id string, pkg string, name string, recv string, file string, line int").write.parquet(f"{tmp_path}/nodes")
    calls = spark.createDataFrame([("p.A", "run"), ("p.A", "t.run"), ("p.run", "p.A")] * 5, "src string, dst string")
    found = graph.resolve(spark.read.parquet(f"{tmp_path}/nodes"), calls)
    assert sorted(map(tuple, found.collect())) == [("p.A", "p.run"), ("p.run", "p.A")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # files of repeated nodes are small, whatever the number of nodes


def test_cosine_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ASKED", 3)
    monkeypatch.setattr(search, "MET", 7)
    words = [[f"t{k % 5}", f"u{i % (k + 2)}", *([f"rare{i // 2}"] if k % 3 else [])] for k in range(6) for i in range(8)]
    rows = [(i, t, 1.0 + (i * 7 + len(t)) % 4) for i, ts in enumerate(words) for t in ts] + [(None, "t1", 1.0), (99, "alone", 2.0)]
    weights = spark.createDataFrame(rows, "id long, term string, w double")
    found = search.cosine_to(weights, F.col("id") % 5 == 0)
    got = {(r.id_a, r.id_b): r.cosine for r in found.collect()}
    vector = {}
    for i, t, w in rows:
        vector.setdefault(i, {})[t] = w
    size = lambda v: sum(w * w for w in v.values()) ** 0.5
    want = {(a, b): sum(w * y[t] for t, w in x.items() if t in y) / (size(x) * size(y)) for a, x in vector.items() for b, y in vector.items() if a is not None and b is not None and a != b and a % 5 == 0 and x.keys() & y.keys()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(got) == found.count()
    # the terms that two documents share make no rows: no join, whose output would grow with them
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_cosine_pairs_shuffle_no_vectors(spark, monkeypatch, tmp_path):
    import duckdb

    monkeypatch.setattr(search, "ASKED", 2)
    monkeypatch.setattr(search, "LISTED", 5, raising=False)  # lists of terms are closed early
    texts = [f"w{i % 4} shared{i // 9} w{i % 4} getUser{i % 7} only{i} word" for i in range(40)]
    rows = [(i * 25, t) for i, t in enumerate(texts)] + [(100, "shared0 again, w1"), (None, "shared1 w2"), (None, "w2"), (7, None), (9, ""), (200, None)]
    for k, name in enumerate(("repeated", "distinct")):  # ids; a text without terms is in both
        at = f"{tmp_path}/{name}"
        those = rows if not k else [*{i: (i, t) for i, t in reversed(rows)}.values()]
        spark.createDataFrame(those, "doc_id long, text string").selectExpr("*", "'en' as lang", "'web' as source").repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(100, 1, 0), (300, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
        found = catalog.tfidf_cosine_pairs(spark, at)
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{at}/documents.parquet/*.parquet')")
        want = {(a, b): c for a, b, c in con.execute(catalog.ORACLES["tfidf_cosine_pairs"]).fetchall() if a is not None and b is not None}
        got = {(r.id_a, r.id_b): r.cosine for r in found.collect()}
        assert got.keys() == want.keys() and len(want) > 300 and all(abs(got[p] - want[p]) < 2e-6 for p in want) and len(got) == found.count()
        # vectors, of which each block of asked ones meets all, stay where they are
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
