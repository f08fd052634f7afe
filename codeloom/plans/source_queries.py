"""Registered queries of the source operators: every customer gives a source file, whose relations SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import flow, maintenance
from codeloom.plans.catalog import query
from codeloom.sources import code
from codeloom.tables import read, written

GO = "package p%1$d\n\nimport (\n\t\"fmt\"\n\t\"example.com/dep%1$d\"\n)\n\ntype T%2$d struct {\n\tnext *Base%1$d\n}\n\nfunc (t *T%2$d) Run%2$d(x int, names []string) (int, error) {\n\ty := x\n\tcall%1$d(y)\n\treturn y, fmt.Errorf(\"%2$d\")\n}\n"
TS = "import { A } from './lib%1$d';\nexport class C%2$d extends A {\n  run(x) {\n    const y = x;\n    this.go(y);\n    return y;\n  }\n}\nexport const f%2$d = (a) => g%1$d(a);\n"
#: The same files in SQL: go and ts rows with n (nation) and k (customer).
SQL = "go as (select c_custkey as k, c_nationkey as n, 'src/c' || c_custkey || '.go' as path from customer where c_custkey % 2 = 0), ts as (select c_custkey as k, c_nationkey as n, 'src/c' || c_custkey || '.ts' as path from customer where c_custkey % 2 = 1)"


def files(spark: SparkSession, d: str) -> DataFrame:
    go = F.col("c_custkey") % 2 == 0
    text = F.when(go, F.format_string(GO, "c_nationkey", "c_custkey")).otherwise(F.format_string(TS, "c_nationkey", "c_custkey"))
    return read(spark, d, "customer").select(F.concat(F.lit("src/c"), "c_custkey", F.when(go, ".go").otherwise(".ts")).alias("path"), text.alias("content"))


@query(f"""with {SQL} select path, 3 as kind, 'T' || k as name, '?' as signature, 8 as start_line, 10 as end_line from go
    union all select path, 1, 'Run' || k, 'func (*T' || k || ') Run' || k || '(int, []string) (int, error)', 12, 16 from go
    union all select path, 7, 'C' || k, 'class C' || k || ' extends A', 2, 8 from ts
    union all select path, 1, 'f' || k, 'const f' || k || ' = (a) => g' || n || '(a);', 9, 9 from ts""")
def source_declarations(spark, d):
    return code.decls(code.parsed(files(spark, d))).select("path", "kind", "name", "signature", "start_line", "end_line")


@query(f"""with {SQL} select 'p' || n || '.(T' || k || ').Run' || k as id, path as file, 12 as line from go
    union all select 'c' || k || '.(C' || k || ').run', path, 3 from ts union all select 'c' || k || '.f' || k, path, 9 from ts""")
def source_nodes(spark, d):
    return code.nodes(code.parsed(files(spark, d))).select("id", "file", "line")


@query(f"""with {SQL} select 'p' || n || '.(T' || k || ').Run' || k as src, 'call' || n as dst from go union select 'p' || n || '.(T' || k || ').Run' || k, 'fmt.Errorf' from go
    union select 'c' || k || '.(C' || k || ').run', 'c' || k || '.(C' || k || ').go' from ts union select 'c' || k || '.f' || k, 'c' || k || '.g' || n from ts""")
def source_call_graph(spark, d):
    return code.edges(code.parsed(files(spark, d)))


@query(f"with {SQL} select 'p' || n as pkg, 'example.com/dep' || n as dep from go union select 'c' || k, './lib' || n from ts")
def source_imports(spark, d):
    return code.imports(code.parsed(files(spark, d)))


@query(f"with {SQL} select 'Base' || n as type, cast(0 as bigint) as params, cast(0 as bigint) as returns, count(*) as fields from go group by n union all select 'int', count(*), count(*), 0 from go union all select 'string', count(*), 0, 0 from go union all select 'error', 0, count(*), 0 from go")
def source_type_usage(spark, d):
    nodes = flow.type_nodes(code.usage(code.parsed(files(spark, d))))
    return nodes.select("type", *[F.size(f"used_as_{r}").cast("long").alias(f"{r}s") for r in ("param", "return", "field")])


@query(f"""with {SQL} select path || ':8-10' as id, '5' as chunk_type, 'T' || k as symbol_name, 'type T' || k || ' struct {{' as first_line from go
    union all select path || ':12-16', '4', 'Run' || k, 'func (t *T' || k || ') Run' || k || '(x int, names []string) (int, error) {{' from go
    union all select path || ':2-8', '8', 'C' || k, 'export class C' || k || ' extends A {{' from ts
    union all select path || ':9-9', '4', 'f' || k, 'export const f' || k || ' = (a) => g' || n || '(a);' from ts""")
def source_chunks(spark, d):
    sources = files(spark, d)
    return code.chunks(sources, code.parsed(sources)).select("id", "chunk_type", "symbol_name", F.substring_index("content", "\n", 1).alias("first_line"))


@query(f"""with {SQL} select path as file, 't' as name, 1 as scope, 12 as def_line, cast(0 as bigint) as n_uses, cast(0 as bigint) as n_returns from go
    union all select path, 'x', 1, 12, 1, 0 from go union all select path, 'names', 1, 12, 0, 0 from go union all select path, 'y', 0, 13, 2, 1 from go
    union all select path, 'x', 1, 3, 1, 0 from ts union all select path, 'y', 0, 4, 2, 1 from ts union all select path, 'f' || k, 2, 9, 0, 0 from ts union all select path, 'a', 1, 9, 1, 0 from ts""")
def source_def_use(spark, d):
    found = written(code.parsed(files(spark, d)), "parsed")
    variables, used = code.variables(found), code.uses(found)
    counted = flow.chains(variables, used.select("use_id", "def_id"), used.drop("def_id"))
    return variables.join(counted, "def_id").select("file", "name", "scope", "def_line", "n_uses", "n_returns")


@query(f"with {SQL} select path, 12 as line, '(T' || k || ').Run' || k as name from go union all select path, 9, 'f' || k from ts")
def source_find_functions(spark, d):
    sources = files(spark, d)
    return code.find_functions(sources, code.parsed(sources), "*").select("path", "line", "name")


@query(f"with {SQL} select path, 9 as line, 'Base' || n as name from go")
def source_find_identifiers(spark, d):
    return code.find_identifiers(files(spark, d), "base").select("path", "line", "name")


@query(f"with {SQL} select (select count(*) from customer) as files, (select count(*) * 16 from go) + (select count(*) * 9 from ts) as lines")
def source_line_stats(spark, d):
    return maintenance.line_stats(files(spark, d))
