"""Registered queries of lookups, counters, formats and added vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunks as C
from codeloom.operators import flow, graph, maintenance, search
from codeloom.plans import bindings as B
from codeloom.plans.catalog import _COS, _SPARSE, _TOP, TEXTS, _rrf, query
from codeloom.tables import read

#: part as variables, lineitem as their uses.
VARIABLES = "vars as (select 'd' || p_partkey as def_id, p_brand as pkg, p_name as name, p_type as type, p_brand as func_id, p_type || '.go' as file, p_partkey as def_line from part)"
USES = "uses as (select l_orderkey as use_id, cast(l_suppkey as varchar) as func_id, cast(l_partkey % 50 as varchar) as name, l_linenumber % 4 as kind, l_orderkey as line from lineitem)"


def variables(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("def_id"), F.col("p_brand").alias("pkg"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("func_id"), F.concat("p_type", F.lit(".go")).alias("file"), F.col("p_partkey").alias("def_line"))


def uses(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("use_id"), F.col("l_suppkey").cast("string").alias("func_id"), (F.col("l_partkey") % 50).cast("string").alias("name"), (F.col("l_linenumber") % 4).alias("kind"), F.col("l_orderkey").alias("line"))


query(f"with {VARIABLES} select def_id, pkg, name, type, func_id, file, def_line from (select *, row_number() over (partition by pkg, name, file order by def_line) as r from vars where contains(lower(name), 're')) where r = 1", "variables_named")(lambda s, d: flow.variables_named(variables(s, d), "RE"))
_INDEX = "idx as (select distinct kind, key, def_id from (select 'name' as kind, name as key, def_id from vars union all select 'type', type, def_id from vars union all select 'func', func_id, def_id from vars union all select 'file', file, def_id from vars) where key is not null)"
query(f"with {VARIABLES}, {_INDEX} select kind, key, def_id from idx", "variable_index")(lambda s, d: flow.lookup_index(variables(s, d)))
query(f"with {VARIABLES}, {_INDEX} select def_id from idx where kind = 'func' and key = 'Brand#11'", "variable_lookup")(lambda s, d: flow.lookup(flow.lookup_index(variables(s, d)), "func", "Brand#11"))
query(f"with {USES} select func_id, name, count(*) as n_uses, min(line) filter (where kind = 3) as first_return from uses group by func_id, name", "usage_counts")(lambda s, d: flow.usage_counts(uses(s, d)))
query("select (select count(*) from part) as variable_count, (select count(*) from lineitem) as use_count, (select count(distinct l_suppkey) from lineitem) as type_node_count", "flow_counters")(lambda s, d: flow.counters(variable=variables(s, d), use=uses(s, d), type_node=uses(s, d).select("func_id").distinct()))
query("select event_type, user_id, event_id, ts from (select *, row_number() over (partition by event_type, user_id order by ts, event_id) as r from events) where r = 1", "first_seen")(lambda s, d: flow.first_seen(read(s, d, "events").select("event_type", "user_id", "event_id", "ts"), ["event_type", "user_id"], ["ts", "event_id"]))
query(f"with {B.SYMBOLS} select p_type as src, p_brand || '.' || p_name || '.param_' || p_size as dst, 'call_arg' as kind from part where p_brand || '.' || p_name in (select id from nodes where line % 2 = 0)", "argument_edges")(lambda s, d: flow.argument_edges(read(s, d, "part").select(F.col("p_brand").alias("pkg"), F.col("p_name").alias("callee"), F.col("p_size").alias("position"), F.col("p_type").alias("arg")), B.symbols(s, d).where("line % 2 = 0")))
query(f"with {B.SYMBOLS} select id, file, line from nodes order by id, file, line", "sorted_nodes")(lambda s, d: graph.sorted_nodes(B.symbols(s, d)).select("id", "file", "line"))
query(f"with {B.TURNS} select id, start_line, content from turns where file_path = 'conv/3' order by start_line, end_line, id", "chunks_by_file")(lambda s, d: C.by_file(B.turns(s, d), "conv/3").select("id", "start_line", "content"))


def _runtime(spark: SparkSession, d: str) -> DataFrame:
    return B.trace_events(spark, d).drop("ts").withColumn("func_id", F.concat(F.lit("app.u"), "func_id"))


_RUNTIME = "e as (select event_id as seq, 'app.u' || user_id as func_id, event_type as var_name, value from events)"
query(f"with {_RUNTIME} select * from e where func_id = 'app.u5' order by seq", "trace_runtime")(lambda s, d: maintenance.trace_runtime(_runtime(s, d), "app.u5"))
query(f"with {_RUNTIME} select * from e where var_name = 'error' order by seq", "trace_runtime_variable")(lambda s, d: maintenance.trace_runtime(_runtime(s, d), "error"))

query("select page_id, case when regexp_extract(url, '([^/]+)/+[^/]*$', 1) in ('', '.', '..') then 'main' else regexp_extract(url, '([^/]+)/+[^/]*$', 1) end as pkg from pages", "package_of")(lambda s, d: read(s, d, "pages").select("page_id", T.package_of(F.col("url")).alias("pkg")))
query("select p_brand || '.' || p_type || ':' || p_size || ':' || p_name || ':' || case p_size % 5 when 0 then 'read' when 1 then 'write' when 2 then 'call_arg' when 3 then 'return' else 'unknown' end as use_id from part", "use_ids")(lambda s, d: read(s, d, "part").select(T.use_id(T.def_id(F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.col("p_name")), F.col("p_size") % 5).alias("use_id")))
_MICROS = "case when o_orderkey % 5 = 0 then o_orderkey % 2000 else o_orderkey * 7919 * (o_orderkey % 1009) % 8000000000 end"
_MS = "cast(floor(us / 1000.0 + 0.5) as bigint)"
query(f"with u as (select o_orderkey, cast({_MICROS} as bigint) as us from orders), m as (select *, {_MS} as ms, rtrim(lpad(cast({_MS} % 1000 as varchar), 3, '0'), '0') as frac from u) select o_orderkey, case when us < 1 then '< 1µs' when us < 1000 then us || 'µs' when ms < 1000 then ms || 'ms' else case when ms >= 3600000 then (ms // 3600000) || 'h' else '' end || case when ms >= 60000 then (ms % 3600000 // 60000) || 'm' else '' end || (ms % 60000 // 1000) || case when frac <> '' then '.' || frac else '' end || 's' end as shown from m", "duration_labels")(lambda s, d: read(s, d, "orders").select("o_orderkey", T.duration(F.expr(_MICROS).cast("long")).alias("shown")))
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'"
query(f"select event_id, case event_type when 'click' then 'unknown' else event_type end || ': indexed=' || user_id || ' deleted=0 updated_at=' || {_STAMP} as summary from events", "index_summaries")(lambda s, d: read(s, d, "events").select("event_id", T.index_summary(F.nullif("event_type", F.lit("click")), F.col("user_id"), F.lit(0), F.col("ts")).alias("summary")))
query("select s_suppkey, cast(to_json({'id': s_suppkey, 'name': s_name, 'pkg': s_nationkey}) as varchar) as entity, s_name as name from supplier", "json_entities")(lambda s, d: read(s, d, "supplier").select("s_suppkey", "s_name", F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("pkg"))).alias("entity")).select("s_suppkey", "entity", F.from_json("entity", "id long, name string, pkg long")["name"].alias("name")))


@query(f"with {B.POSTINGS}, {B.asked(TEXTS)}, nn as (select id, sqrt(sum(cast(tf as double) * tf)) as norm from post group by id), qn as (select query, sqrt(count(*)) as norm from q group by query), sp as (select q.query, p.id, round(sum(cast(p.tf as double)) / (any_value(nn.norm) * any_value(qn.norm)), 6) as score from q join post p on q.term = p.term join nn on nn.id = p.id join qn on qn.query = q.query group by q.query, p.id) {_TOP.format('sp')}")
def sparse_weighted_topk(spark, d):
    vectors = search.postings(B.corpus(spark, d)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("tf").cast("double")))).alias("weights"))
    return search.top(search.sparse_search(search.sparse_postings(vectors), search.queries(spark, TEXTS)), 10)


@query("select vec_id, label from embeddings where vec_id % 3 <> 0 union all select vec_id, cast(9 as integer) from embeddings where vec_id % 3 = 0 union all select vec_id + 10000000, cast(9 as integer) from embeddings where vec_id % 3 = 0")
def vector_add(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    new = v.where("vec_id % 3 = 0").withColumn("label", F.lit(9))
    return search.add_vectors(v, new.unionByName(new.withColumn("vec_id", F.col("vec_id") + 10_000_000))).select("vec_id", "label")


@query(f"with {B.POSTINGS}, {B.asked(TEXTS)}, {B.BM25}, sp as (select cast(b.vec_id // 100 as integer) as query, a.vec_id as id, {_COS} as score from embeddings a, embeddings b where b.vec_id in (0, 100, 200)){_rrf(0.5)[len(_SPARSE):]}")
def vector_hybrid(spark, d):
    v = read(spark, d, "embeddings")
    asked = v.where("vec_id in (0, 100, 200)").select((F.col("vec_id") / 100).cast("int").alias("query"), F.col("embedding").alias("vector"))
    near = search.knn(v, asked, 100).select("query", "id", "score")
    return search.hybrid(B.stored_index(spark, d).bm25(TEXTS), near, 0.5)
