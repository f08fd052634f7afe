"""Parsers, source relations, chunks and AST search on small sources."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import flow
from codeloom.sources import code, defuse, golang, script

GO = """package svc

import (
\t"fmt"
\tx "example.com/a/b"
)

type Engine struct {
\tchunker *Chunker `json:"c"`
\tBase
}

var a, b = load(inner()), 2

func (e *Engine) Run(ctx context.Context, a, b int, f func(int) error) (map[string][]*User, error) {
\te.chunker.Chunk(g())
\th := func() { shown() }
\tx.Y().Z()
\treturn nil, fmt.Errorf("{ %d", 1)
}

func TestRun_Twice() *User { return New(1) }
"""
TS = """import { Injectable } from '@angular/core';
export * from "./x";
export const add = (a: number, b: number) => a + b;
export type UserId = string | number;
export enum Status { A, B }
export class UserService extends Base {
  constructor() { super(); super.run(); }
  async getUser(id: string) { return this.users.find(x => x.replace(/["'{]/g, '')); }
  listUsers() { if (a) { this.getUser("1"); } return format(new Foo(bar())); }
}
const format = function (x) { return x.trim() };
namespace Http { export class Client { post() { return get(); } } export function get() {} }
"""


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame([("pkg/a.go", GO), ("src/user.ts", TS), ("bad.go", "func {"), ("empty.js", None)], "path string, content string")
    return files, code.parsed(files).cache()


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_go_declarations():
    found = golang.parse("a.go", GO)
    assert [(d[0], d[1], d[4], d[5]) for d in found["decls"]] == [(3, "Engine", 8, 11), (5, "a", 13, 13), (5, "b", 13, 13), (1, "Run", 15, 20), (1, "TestRun_Twice", 22, 22)]
    assert found["decls"][3][2] == "func (*Engine) Run(context.Context, int, (int) error) (map[string][]*User, error)"
    assert {c[:2] for c in found["calls"]} == {(":<package-init>", "load"), (":<package-init>", "inner"), ("svc.(Engine).Run", "e.chunker.Chunk"), ("svc.(Engine).Run", "shown"), ("svc.(Engine).Run", "Z"), ("svc.(Engine).Run", "fmt.Errorf"), ("svc.TestRun_Twice", "New")}
    assert ("svc.(Engine).Run", "g") in {c[:2] for c in golang.parse("a.go", GO, True)["calls"]}
    assert {u[:3] for u in found["usage"]} >= {("Chunker", "field", "Engine"), ("Base", "field", "Engine"), ("User", "return", "Run"), ("context.Context", "param", "Run")}


def test_ts_declarations():
    found = script.parse("src/user.ts", TS)
    assert found["imports"] == ["@angular/core", "./x"] and found["package"] == "user" and script.parse("a.test.js", "")["is_test"]
    assert [(d[0], d[1]) for d in found["decls"]] == [(1, "add"), (2, "UserId"), (8, "Status"), (7, "UserService"), (1, "format"), (7, "Client"), (1, "get")]
    got = {c[:2] for c in found["calls"]}
    assert {("user.(UserService).listUsers", "user.(UserService).getUser"), ("user.(UserService).listUsers", "user.format"), ("user.(Client).post", "user.get")} <= got
    assert not any("super" in c[1] for c in got)


def test_relations(rows):
    files, found = rows
    assert {r.path for r in found.where("error is not null").collect()} == {"bad.go"}
    assert pairs(code.imports(found), "pkg", "dep") == {("svc", "example.com/a/b"), ("user", "@angular/core"), ("user", "./x")}
    assert {"svc.(Engine).Run", "user.(UserService).getUser", "user.add", "user.(Client).post"} <= {r.id for r in code.nodes(found).collect()}
    assert pairs(code.tested(found), "symbol") == {("Run",), ("Run.Twice",)}
    assert ("svc.(Engine).Run", "fmt.Errorf") in pairs(code.edges(found), "src", "dst")


def test_chunks(rows, spark):
    files, found = rows
    got = {r.id: r for r in code.chunks(files, found).collect()}
    assert got["pkg/a.go:13-13"].symbol_name == "b" and got["empty.js"].chunk_type == "0" and "bad.go" not in got
    assert got["pkg/a.go:8-11"].chunk_type == "5" and got["pkg/a.go:8-11"].content.splitlines() == GO.splitlines()[7:11]
    body = "func big() {\n" + "\tcall(1, 2)\n" * 200 + "}"
    long = spark.createDataFrame([("l.go", "package l\n" + body)], "path string, content string")
    cut = code.chunks(long, code.parsed(long)).orderBy("start_line").collect()
    assert [(r.chunk_type, r.symbol_name, r.start_line, r.end_line) for r in cut] == [("7", "big", 2, 203), ("7", "", 203, 203)]
    assert "\n".join(r.content for r in cut) == body


def test_walk(spark, tmp_path):
    for name in ("a.go", "x/b.ts", "vendor/c.go", ".hid/d.go", "e.txt", "x/testdata/f.go"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("package p\n")
    assert pairs(code.walk(spark, str(tmp_path)), "path") == {("a.go",), ("x/b.ts",)}
    assert code.walk(spark, str(tmp_path), max_files=1).count() == 1


def test_syntax_search(rows):
    files, found = rows
    assert pairs(code.find_functions(files, found, "func (Engine).Run"), "name", "line") == {("(Engine).Run", 15)}
    assert code.find_functions(files, found, "*").count() == 5
    assert pairs(code.find_types(files, found, "Eng"), "name", "snippet") == {("Engine", "type Engine struct {")}
    assert ("UserService", 6) in pairs(code.find_identifiers(files, "user").where(F.col("path") == "src/user.ts"), "name", "line")


GO_FLOW = """package p
var cfg = 1
func f(x int, names []string) (out int) {
\ty := x + 1
\tif z := y; z > 0 {
\t\ty := 5
\t\tuse(y)
\t}
\tfor i := 0; i < x; i++ {
\t\tlog(i, cfg)
\t}
\tx = 3
\ta, err := g(x)
\tb, err := g(a)
\tfn := func(k int) int { return k + y }
\treturn fn(b) + out
}
"""
JS_FLOW = """const limit = 3;
export function f(a, {b, c: d}) {
  let e = a + limit;
  const g = (h) => h + e;
  for (const k of b) { use(k, d); }
  e = 4;
  return g(e);
}
class A { run(p) { const {q} = p; return q; } }
"""


def flows(walk):
    return {(d[0], d[4]): (d[2], [(u[1], u[2]) for u in walk.uses if u[4] == i]) for i, d in enumerate(walk.defs)}


def test_go_def_use():
    got = flows(defuse.go(GO_FLOW))
    assert got == {
        ("cfg", 2): (2, [(10, 2)]), ("x", 3): (1, [(4, 0), (9, 0), (12, 1), (13, 2)]), ("names", 3): (1, []), ("out", 3): (0, [(16, 3)]),
        ("y", 4): (0, [(5, 0), (15, 3), ]), ("z", 5): (0, [(5, 0)]), ("y", 6): (0, [(7, 2)]), ("i", 9): (0, [(9, 0), (9, 1), (10, 2)]),
        ("a", 13): (0, [(14, 2)]), ("err", 13): (0, [(14, 1)]), ("b", 14): (0, [(16, 2)]), ("fn", 15): (0, [(16, 3)]), ("k", 15): (1, [(15, 3)]),
    }


def test_js_def_use():
    got = flows(defuse.js("m.js", JS_FLOW))
    assert got == {
        ("limit", 1): (2, [(3, 0)]), ("a", 2): (1, [(3, 0)]), ("b", 2): (1, [(5, 0)]), ("d", 2): (1, [(5, 2)]), ("e", 3): (0, [(4, 0), (6, 1), (7, 2)]),
        ("g", 4): (0, [(7, 3)]), ("h", 4): (1, [(4, 0)]), ("k", 5): (0, [(5, 2)]), ("p", 9): (1, [(9, 0)]), ("q", 9): (0, [(9, 3)]),
    }


def test_chains_from_sources(spark):
    files = spark.createDataFrame([("p.go", GO_FLOW), ("m.js", JS_FLOW)], "path string, content string")
    found = code.parsed(files)
    used = code.uses(found)
    got = {r.def_id: (r.n_uses, r.n_returns) for r in flow.chains(code.variables(found), used.select("use_id", "def_id"), used.drop("def_id")).collect()}
    assert got["p.go#1"] == (4, 0) and got["p.go#4"] == (2, 1) and got["m.js#0"] == (1, 0)
