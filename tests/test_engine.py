"""The store, the engine over a small source tree, and the streaming variants."""

import pytest
from pyspark.sql import functions as F

from codeloom.plans.engine import Engine
from codeloom.sources.store import Store
from codeloom.streaming import live

MAIN = """package main

func main() {
\tlive()
}

func live() {
\thelper()
}

func helper() int {
\tsession := 1
\treturn session
}

func dead() {
\thelper()
}
"""


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    assert s.table("t") is None
    assert s.commit(puts={"t": (rows(("a", 1), ("ab", 2), ("c", 3)), ["k"])}) == 1
    assert s.commit(puts={"t": (rows(("a", 9), ("d", 4)), ["k"])}, deletes={"t": (rows(("c", 0)), ["k"])}) == 2
    assert {tuple(r) for r in s.table("t").collect()} == {("a", 9), ("ab", 2), ("d", 4)} and s.table("t", 1).count() == 3
    assert s.has_prefix("t", "k", "a") and s.get("t", "k", "d").first().v == 4
    s.commit(prefixes={"t": ("k", ["a"])})
    assert [r.k for r in s.table("t").collect()] == ["d"]
    stale = Store(spark, str(tmp_path))
    stale.manifest = lambda version=None: (2, {})
    with pytest.raises(RuntimeError):
        stale.commit(replace={"t": rows(("x", 1))})
    assert [r.k for r in s.table("t").collect()] == ["d"]


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "main.go").write_text(MAIN)
    (src / "pkg" / "user.ts").write_text("export class UserService { load() { return fetchUser(); } }\n")
    (src / "bad.go").write_text("nonsense {")
    e = Engine(Store(spark, str(tmp_path / "store")))
    assert e.sync(str(src)) == {"indexed": 3, "deleted": 0, "failed": 1}
    assert e.sync(str(src)) == {"indexed": 0, "deleted": 0, "failed": 0}
    assert e.query("search_code", "helper session").orderBy("rank").first().symbol_name == "helper"
    spared = {r.symbol_name: r for r in e.query("search_code", "dead").collect()}["dead"]
    assert "skip_unreachable_penalty" in spared.explanation and e.query("reachable_chunks", "nobody").count() == 0
    assert {r.id for r in e.query("reachable_chunks", "dead").collect()} == {r.id for r in e.store.table("chunks").where("file_path = 'main.go'").collect()}
    assert "boost variable=0.5000" in {r.symbol_name: r.explanation for r in e.query("search_code", "session").collect()}["helper"]
    assert [r.id for r in e.query("get_callers", "helper").orderBy("id").collect()] == ["main.dead", "main.live"]
    assert {r.symbol_name: r.reachability for r in e.store.table("chunks").where("file_path = 'main.go'").collect()} == {"main": "reachable", "live": "reachable", "helper": "reachable", "dead": "unreachable"}
    assert e.text("get_callers", "nobody") == "no callers found" and "[class] UserService" in e.text("find_definition", "UserService")
    assert e.text("impact_analysis", "main.live").count("downstream") == 1
    assert [r.text for r in e.query("read_snippet", "main.go:7-8").orderBy("line").collect()] == ["func live() {", "\thelper()"]
    pack = e.query("get_context_pack", "main.go:7-9").first().context
    assert pack.startswith("## primary") and "## nearby" in pack and "callee: helper" in pack
    assert {(r.section, r.name) for r in e.query("function_dataflow", "main.helper").collect()} == {("internal", "session"), ("output", "session")}
    assert e.query("variable_search", "session").first().def_line == 12 and e.query("trace_variable", "session", location="main.go:12").first().name == "session"
    assert e.query("trace_variable", "session", location="main.go:13").count() == 0
    assert e.query("rag_status").first().ready
    with pytest.raises(ValueError):
        e.query("sync", "x")
    (src / "main.go").write_text(MAIN.replace("func dead", "func Fresh"))
    (src / "pkg" / "user.ts").unlink()
    assert e.sync(str(src)) == {"indexed": 1, "deleted": 1, "failed": 0}
    assert {r.id for r in e.store.table("nodes").collect()} == {"main.main", "main.live", "main.helper", "main.Fresh"}
    assert e.store.table("files").count() == 2


def test_streams(spark, tmp_path):
    events = spark.range(12).select(F.col("id").alias("seq"), F.lit("main.foo").alias("func_id"), F.lit("entry").alias("event_type"), F.timestamp_seconds(F.col("id") * 300).alias("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    schema = "seq long, func_id string, event_type string, timestamp timestamp"
    s = Store(spark, str(tmp_path / "store"))
    live.into_store(live.source(spark, str(tmp_path / "in"), schema), s, "ring", ["seq"], str(tmp_path / "c1"), capacity=5).awaitTermination(90)
    assert sorted(r.seq for r in s.table("ring").collect()) == [7, 8, 9, 10, 11]
    live.into_store(live.event_windows(live.source(spark, str(tmp_path / "in"), schema)), s, "windows", ["start", "func_id", "event_type"], str(tmp_path / "c2")).awaitTermination(90)
    assert {r.n for r in s.table("windows").collect()} == {2} and s.table("windows").count() == 6
    docs = spark.createDataFrame([("1", "alpha beta alpha"), ("2", "beta")], "id string, content string")
    docs.write.parquet(str(tmp_path / "docs"))
    live.into_store(live.postings(live.source(spark, str(tmp_path / "docs"), "id string, content string")), s, "df", ["term"], str(tmp_path / "c3")).awaitTermination(90)
    assert {(r.term, r.df) for r in s.table("df").collect()} == {("alpha", 1), ("beta", 2)}


def test_text_gives_every_row(spark, monkeypatch):
    from codeloom.plans.engine import Engine

    engine = Engine.__new__(Engine)
    monkeypatch.setattr(engine, "query", lambda kind, text, **options: spark.range(1500).selectExpr("cast(id as string) id"), raising=False)
    assert len(engine.text("get_callers", "hot").split("\n")) == 1500


def test_meta_lookup_and_command_line(spark, tmp_path, capsys):
    from codeloom.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "main.go").write_text(MAIN)
    store = Store(spark, str(tmp_path / "store"))
    e = Engine(store)
    assert e.query("rag_status").first().last_index == "unavailable"
    assert tuple(e.query("reindex", str(tmp_path / "src")).first()) == (1, 0, 0)
    assert e.query("rag_status").first().last_index.startswith("full: indexed=1 deleted=0 updated_at=20")
    assert e.query("variable_lookup", "session").count() == 1 and e.query("variable_lookup", "main.helper", by="func").count() == 1
    with pytest.raises(ValueError):
        e.query("variable_lookup", "x", by="colour")
    assert e.query("trace_runtime", "main.live").count() == 0
    store.commit(replace={"trace_events": spark.createDataFrame([(2, "main.live", "exit", ""), (1, "main.live", "enter", ""), (3, "main.dead", "assign", "x")], "seq long, func_id string, event_type string, var_name string")})
    assert [r.seq for r in e.query("trace_runtime", "main.live").collect()] == [1, 2] and [r.seq for r in e.query("trace_runtime", "x").collect()] == [3]
    assert main(["--repo", str(tmp_path / "src"), "--db", str(tmp_path / "cli"), "get_callers", "helper"]) == 0
    shown = capsys.readouterr()
    assert "indexed=1" in shown.err and shown.out == "1. main.dead\n2. main.live\n"
    assert main(["no_such_kind"]) == 2
