"""The registered queries over the driver tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunks as C
from codeloom.operators import flow, graph, maintenance, search
from codeloom.plans import bindings as B
from codeloom.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TEXTS = ["idiot clown thing", "worthless moron erlich", "the pathetic station"]
ONE = TEXTS[:1]


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) as a query, with its SQL if there is any."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def _post(spark, d):
    return search.postings(B.corpus(spark, d))


def _bm25(spark, d, texts):
    return B.stored_index(spark, d).bm25(texts)


@query(f"with {B.POSTINGS} select id, term, tf from post")
def tokenize_tf(spark, d):
    return _post(spark, d)


@query(f"with {B.POSTINGS} select id, len from lens")
def doc_len_stats(spark, d):
    docs = B.corpus(spark, d)
    return search.doc_lengths(docs, search.postings(docs))


@query(f"with {B.POSTINGS} select term, df, round(idf, 6) as idf, stop from idf")
def df_idf(spark, d):
    docs = B.corpus(spark, d)
    post = search.postings(docs)
    return search.term_stats(post, search.doc_stats(search.doc_lengths(docs, post))).select("term", "df", F.round("idf", 6).alias("idf"), "stop")


_EVERYWHERE = B.POSTINGS.replace("from documents", "from marked")


@query(f"with marked as (select doc_id, case when doc_id % 10 < 9 then text || ' everywhere' else text end as text from documents), {_EVERYWHERE} select term, df from idf where stop")
def stop_terms(spark, d):
    docs = B.corpus(spark, d).withColumn("content", F.when(F.col("id") % 10 < 9, F.concat("content", F.lit(" everywhere"))).otherwise(F.col("content")))
    post = search.postings(docs)
    return search.term_stats(post, search.doc_stats(search.doc_lengths(docs, post))).where("stop").select("term", "df")


_TOP = "select query, id, score, rank from (select *, row_number() over (partition by query order by score desc, id) as rank from {0}) where rank <= 10"


@query(f"with {B.POSTINGS}, {B.asked(ONE)}, {B.BM25} {_TOP.format('bm')}")
def bm25_topk(spark, d):
    return search.top(_bm25(spark, d, ONE), 10)


@query(f"with {B.POSTINGS}, {B.asked(TEXTS)}, {B.BM25} {_TOP.format('bm')}")
def bm25_multi_query(spark, d):
    return search.top(_bm25(spark, d, TEXTS), 10)


@query(f"with {B.POSTINGS} select id, term, tf from post")
def bm25_partial_merge(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    return search.merge_postings(search.partial_postings(docs, "source"))


def _ranked(keep: str = "true", language: str = "", path: str = "", weight: str = "", named: str = "") -> str:
    plus = (" + 0.03" if language else "") + (" + 0.05" if path else "")
    final = f"({{0}}) * case when {weight} < 1 then {weight} else 1 end".format if weight else "{0}".format
    boosts = "b.score + case when symbol_name <> '' and regexp_replace(lower(any_value(q)), '[^a-z0-9]', '', 'g') = regexp_replace(lower(symbol_name), '[^a-z0-9]', '', 'g') then 2.0 else 0.0 end + least(0.05 * count(*) filter (where symbol_name <> '' and contains(lower(symbol_name), term)), 0.15) + least(0.04 * count(*) filter (where contains(lower(file_path), term)), 0.12)" + plus
    extra = f" + {named}" if named else ""
    return f"""with {B.CORPUS}, {B.POSTINGS}, {B.asked(TEXTS)}, {B.BM25},
    f as (select * from (select *, row_number() over (partition by query order by score desc, id) as r from bm) where r <= 50),
    s as (select b.query, b.id, file_path, symbol_name, b.score as bm25, round({final(boosts)}{extra}, 6) as score
     from f b join chunks c on b.id = c.id join q on q.query = b.query where {keep} group by b.query, b.id, file_path, symbol_name, b.score, context_weight, end_line)
    select query, rank, id, file_path, symbol_name, bm25, score from (select *, row_number() over (partition by query order by score desc, file_path, symbol_name, id) as rank from s) where rank <= 10"""


def _search(spark, d, docs=None, **options):
    if docs is None:
        return search.search(B.corpus(spark, d), None, None, TEXTS, hits=B.stored_index(spark, d).bm25(TEXTS), **options).drop("explanation")
    post = search.postings(docs)
    return search.search(docs, post, search.doc_lengths(docs, post), TEXTS, **options).drop("explanation")


query(_ranked(), "search_ranked")(lambda s, d: _search(s, d))
query(_ranked("file_path like '%.en'", language="en"), "search_lang_filter")(lambda s, d: _search(s, d, language="en"))
query(_ranked("contains(file_path, 'src1')", path="src1"), "search_path_filter")(lambda s, d: _search(s, d, path="src1"))
query(_ranked("file_path like '%.en' and contains(file_path, 'src1')", "en", "src1"), "search_both_filters")(lambda s, d: _search(s, d, language="en", path="src1"))
query(_ranked(weight="context_weight"), "search_pruned_soft")(lambda s, d: _search(s, d, pruning="soft"))
query(_ranked(), "search_pruned_off")(lambda s, d: _search(s, d, pruning="off"))


@query(_ranked().replace("from documents d left join (", "from documents d left join (").replace(B.CORPUS, B.CORPUS + ", kept as (select * from documents where doc_id in (select id from chunks where reachability <> 'unreachable' and semantic_role <> 'boilerplate'))").replace(B.POSTINGS, B.POSTINGS.replace("from documents", "from kept")))
def search_pruned_hard(spark, d):
    return _search(spark, d, docs=C.hard_prune(B.corpus(spark, d)))


_NAMED = "0.5 * coalesce((select count(distinct v.name) from vars v where v.file = file_path and v.def_line between 1 and end_line and v.name in (select term from q q2 where q2.query = b.query)), 0)"


@query(_ranked(named=_NAMED).replace(f"with {B.CORPUS}", f"with {B.CORPUS}, vars as (select file_path as file, 1 as def_line, 'thing' as name from chunks where id % 2 = 0 union all select file_path, 1, 'clown' from chunks where id % 3 = 0)"))
def search_var_boost(spark, d):
    docs = B.corpus(spark, d)
    v = docs.where("id % 2 = 0").select(F.col("file_path").alias("file"), F.lit(1).alias("def_line"), F.lit("thing").alias("name")).unionByName(docs.where("id % 3 = 0").select(F.col("file_path").alias("file"), F.lit(1).alias("def_line"), F.lit("clown").alias("name")))
    return _search(spark, d, variables=v)


_TFIDF = f"with {B.POSTINGS}, v as (select count(distinct term) as v from post), w as (select p.id, p.term, tf * ln(1 + v / df) as w from post p join idf i on p.term = i.term, v)"


@query(_TFIDF.replace("tf * ln(1 + v / df)", "tf * ln(1 + cast(v as double) / df)") + " select id, term, round(w, 6) as w from w")
def tfidf_vectors(spark, d):
    return search.tfidf(_post(spark, d)).select("id", "term", F.round("w", 6).alias("w"))


@query(_TFIDF.replace("tf * ln(1 + v / df)", "round(tf * ln(1 + cast(v as double) / df), 6)") + " select * from (select id, term, w, row_number() over (partition by id order by w desc, term) as rank from w) where rank <= 5")
def tfidf_topn(spark, d):
    return search.top_terms(search.tfidf(_post(spark, d)), 5)


@query(_TFIDF.replace("tf * ln(1 + v / df)", "tf * ln(1 + cast(v as double) / df)") + ", n as (select id, sqrt(sum(w * w)) as norm from w group by id) select a.id as id_a, b.id as id_b, round(sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)), 6) as cosine from w a join w b on a.term = b.term and a.id <> b.id join n na on na.id = a.id join n nb on nb.id = b.id where a.id % 100 = 0 group by a.id, b.id")
def tfidf_cosine_pairs(spark, d):
    return search.tfidf_cosines(read(spark, d, "documents"), F.col("id") % 100 == 0, "doc_id", "text")


_SPARSE = f"with {B.POSTINGS}, {B.asked(TEXTS)}, {B.BM25}, w as (select p.id, p.term, tf * ln(1 + cast(n as double) / df) as w from post p join idf i on p.term = i.term, stats), nn as (select id, sqrt(sum(w * w)) as norm from w group by id), qn as (select query, sqrt(count(*)) as norm from q group by query), sp as (select q.query, w.id, round(sum(w) / (any_value(nn.norm) * any_value(qn.norm)), 6) as score from q join w on q.term = w.term join nn on nn.id = w.id join qn on qn.query = q.query group by q.query, w.id having round(sum(w) / (any_value(nn.norm) * any_value(qn.norm)), 6) > 0)"


def _sparse(spark, d):
    return B.stored_index(spark, d).sparse(TEXTS)


@query(f"{_SPARSE} {_TOP.format('sp')}")
def sparse_topk(spark, d):
    return search.top(_sparse(spark, d), 10)


def _rrf(a: float) -> str:
    return f"""{_SPARSE}, a as (select * from (select *, row_number() over (partition by query order by score desc, id) as r from bm) where r <= 100),
    s as (select * from (select *, row_number() over (partition by query order by score desc, id) as r from sp) where r <= 100),
    h as (select coalesce(a.query, s.query) as query, coalesce(a.id, s.id) as id, coalesce(a.score, 0) as bm25, coalesce(s.score, 0) as sparse,
     round({a} * coalesce(1.0 / (60 + a.r), 0) + {1 - a} * coalesce(1.0 / (60 + s.r), 0) + 0.01 * {a} * coalesce(a.score, 0) + 0.1 * {1 - a} * coalesce(s.score, 0), 8) as score
     from a full join s on a.query = s.query and a.id = s.id)
    select query, rank, id, bm25, sparse, score from (select *, row_number() over (partition by query order by score desc, id) as rank from h) where rank <= 10"""


for _name, _alpha in (("hybrid_rrf", 0.5), ("hybrid_alpha0", 0.0), ("hybrid_alpha1", 1.0)):
    query(_rrf(_alpha), _name)(lambda s, d, a=_alpha: search.hybrid(_bm25(s, d, TEXTS), _sparse(s, d), a))

_COS = "round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[])) * list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))), 5)"


@query(f"with s as (select b.vec_id as query, a.vec_id as id, {_COS} as score from embeddings a, embeddings b where b.vec_id % 100 = 0) select * from (select query, id, score, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10")
def vector_knn(spark, d):
    v = read(spark, d, "embeddings")
    return search.knn(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 10)


@query(f"with s as (select b.vec_id as query, a.vec_id as id, {_COS} as score from embeddings a, embeddings b where b.vec_id % 100 = 0 and a.label = 3) select * from (select query, id, score, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10")
def vector_knn_by_label(spark, d):
    v = read(spark, d, "embeddings")
    return search.knn(v.where("label = 3"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 10)


query(f"with {B.OWNERSHIP} select src as id from edges where dst = 's:5'", "callers")(lambda s, d: graph.callers(B.ownership(s, d), "s:5"))
query(f"with {B.OWNERSHIP} select dst as id from edges where src = 'c:7'", "callees")(lambda s, d: graph.callees(B.ownership(s, d), "c:7"))
query(f"with {B.IMPORTS} select pkg as id from imports where dep = '/the'", "importers")(lambda s, d: B.imports(s, d).where("dep = '/the'").select(F.col("pkg").alias("id")))
query(f"with {B.IMPORTS} select pkg, count(*) as n_deps, min(dep) as first_dep from imports group by pkg", "dependencies")(lambda s, d: B.imports(s, d).groupBy("pkg").agg(F.count("*").alias("n_deps"), F.min("dep").alias("first_dep")))
query(f"with {B.OWNERSHIP} select dst as id, count(*) as n_callers, min(src) as first_caller, max(src) as last_caller from edges group by dst", "reverse_adjacency")(lambda s, d: graph.reverse_adjacency(B.ownership(s, d)))
query(f"with {B.IMPORTS} select distinct pkg, dep from imports", "dependency_pairs")(lambda s, d: B.imports(s, d).select("pkg", "dep").distinct())
query(f"with {B.OWNERSHIP} select distinct dst as id, src as caller from edges", "caller_pairs")(lambda s, d: graph.in_edges(B.ownership(s, d)))
query(f"with {B.OWNERSHIP} select (select count(*) from (select src as id from edges union select dst from edges)) as nodes, (select count(*) from edges) as edges", "graph_stats")(lambda s, d: graph.stats((e := B.ownership(s, d)).select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e))


def _reach(cte: str, table: str, start: str, a: str, b: str, depth: int, direction: str) -> str:
    return f"select id, min(depth) as depth, '{direction}' as direction from (with recursive {cte}, r(id, depth) as (select '{start}', 0 union select {b}, depth + 1 from r join {table} on {a} = r.id where depth < {depth}) select id, cast(depth as bigint) as depth from r) where depth > 0 group by id"


_DOWN, _UP = _reach(B.OWNERSHIP, "edges", "c:7", "src", "dst", 3, "downstream"), _reach(B.OWNERSHIP, "edges", "s:5", "dst", "src", 2, "upstream")
query(_DOWN, "impact_forward")(lambda s, d: graph.impact(B.ownership(s, d), "c:7", 3, "downstream"))
query(_UP, "impact_backward")(lambda s, d: graph.impact(B.ownership(s, d), "s:5", 2, "upstream"))
query(f"{_reach(B.OWNERSHIP, 'edges', 's:5', 'src', 'dst', 2, 'downstream')} union all {_UP}", "impact_full")(lambda s, d: graph.impact(B.ownership(s, d), "s:5", 2, "full"))
query(_reach(B.IMPORTS, "imports", "/the", "dep", "pkg", 3, "downstream"), "package_impact")(lambda s, d: graph.package_impact(B.imports(s, d), "/the", 3))
_CLOSED = f"with recursive {B.STEPS}, r(id) as (select distinct src from steps where src like '%.signup' union select dst from r join steps on src = r.id)"
query(f"{_CLOSED} select id from r", "reachability")(lambda s, d: graph.reach(e := B.steps(s, d), e.where("src like '%.signup'").select(F.col("src").alias("id"))).select("id"))
_EVEN = _CLOSED.replace("like '%.signup'", "like '%.signup' and cast(split_part(src, '.', 1) as bigint) % 2 = 0")
query(f"{_EVEN} select distinct src as id from steps where src not in (select id from r)", "unreachable")(lambda s, d: (e := B.steps(s, d)).select(F.col("src").alias("id")).distinct().join(graph.reach(e, e.where("src like '%.signup' and cast(split_part(src, '.', 1) as bigint) % 2 = 0").select(F.col("src").alias("id"))), "id", "left_anti"))
_CALLS = "calls as (select a.id as src, split_part(b.id, '.', 2) as dst from nodes a join nodes b on b.line = a.line + 1)"


@query(f"with {B.SYMBOLS}, {_CALLS}, t as (select distinct src, dst from calls), x as (select src, dst from t where dst in (select id from nodes)), y as (select t.src, t.dst, n.pkg from t join nodes n on n.id = t.src where t.dst not in (select id from nodes)) select src, dst from x union select src, pkg || '.' || dst from y where pkg || '.' || dst in (select id from nodes) union select y.src, n.id from y join nodes n on n.pkg = y.pkg and n.name = case when y.dst like '%.' then y.dst else list_last(string_split(y.dst, '.')) end")
def resolve_callees(spark, d):
    n = B.symbols(spark, d)
    calls = n.alias("a").join(n.alias("b").hint("merge"), F.expr("b.line = a.line + 1")).select(F.col("a.id").alias("src"), F.element_at(F.split("b.id", r"\."), 2).alias("dst"))
    return graph.resolve(n, calls)


_NAMES = ["red", "Brand#11 a"]
query(f"with {B.SYMBOLS}, {B.asked(_NAMES)}, p as (select query, any_value(regexp_replace(lower(q), '[^a-z0-9]', '', 'g')) as plain, count(*) as n from q group by query) select distinct p.query, id from nodes, p where regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = plain or regexp_replace(lower(id), '[^a-z0-9]', '', 'g') = plain or n = (select count(*) from q where q.query = p.query and (contains(lower(name), term) or contains(lower(id), term)))", "query_roots")(lambda s, d: graph.query_roots(B.symbols(s, d), search.asked_lists(s, _NAMES)))
query(f"with {B.SYMBOLS} select id, name, pkg from nodes where contains(lower(name), 'red') or contains(lower(pkg), 'red') or contains(lower(id), 'red')", "symbol_search")(lambda s, d: graph.symbol_search(B.symbols(s, d), "Red").select("id", "name", "pkg"))
query(f"with {B.SYMBOLS}, {B.OWNERSHIP}, {B.IMPORTS} select 'caller' as kind, src as id from edges where dst = 's:5' union all select 'callee', dst from edges where src = 's:5' union all select 'imported_by', pkg from imports where dep = 's:5' union all select 'reference', src from edges where dst = 's:5' union all select 'reference', pkg from imports where dep = 's:5' union all select 'definition', id from nodes where id = 's:5' or (not exists (select 1 from nodes where id = 's:5') and (name = 's:5' or contains(id, 's:5')))", "xref")(lambda s, d: graph.xref(B.symbols(s, d), B.ownership(s, d), B.imports(s, d), "s:5"))
query(f"with {B.OWNERSHIP} select cast(0 as bigint) as section, src as result from edges where dst = 's:5'", "find_references")(lambda s, d: graph.references(B.symbols(s, d), B.ownership(s, d), B.imports(s, d), "s:5"))
_PARTS = "parts as (select p_partkey as id, p_name as symbol_name, case p_size % 4 when 0 then '5' when 1 then '6' when 2 then '4' else '3' end as chunk_type, p_type as file_path, cast(p_size as integer) as start_line, cast(p_size + 3 as integer) as end_line from part)"


def _parts(spark, d):
    kind = F.expr("case p_size % 4 when 0 then '5' when 1 then '6' when 2 then '4' else '3' end")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol_name"), kind.alias("chunk_type"), F.col("p_type").alias("file_path"), F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + 3).cast("int").alias("end_line"))


@query(f"with {_PARTS}, {B.SYMBOLS} select cast(0 as bigint) as section, '[' || case chunk_type when '5' then 'struct' when '6' then 'interface' else 'type' end || '] ' || symbol_name || ' (' || file_path || ':' || start_line || '-' || end_line || ')' as result from parts where chunk_type in ('3', '5', '6', '8', '9') and contains(lower(symbol_name), 'a') union all select 1, '[func] ' || name || ' (' || file || ':' || line || ')' from nodes where contains(lower(id), 'a')")
def find_definition(spark, d):
    return graph.definitions(_parts(spark, d), B.symbols(spark, d), "a")


_MEANING = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12))), lambda x: x <> '' and not starts_with(x, '//'))"
_FIELDS = f"list_filter({_MEANING}, lambda x: x not in ('{{', '}}') and not starts_with(x, 'type ') and not starts_with(x, 'struct'))"
query(f"select doc_id, cast(len({_MEANING}) as bigint) as n_lines from documents", "meaningful_lines")(lambda s, d: read(s, d, "documents").select("doc_id", F.size(T.meaningful(F.col("text"))).cast("long").alias("n_lines")))
query(f"select doc_id, doc_id % 2 = 0 and len({_FIELDS}) >= 8 and (len(list_filter({_FIELDS}, lambda x: contains(x, '`json:') or contains(x, '`db:') or contains(x, '`yaml:'))) >= floor(len({_FIELDS}) / 2) or doc_id % 3 = 0) as large from documents", "large_dto")(lambda s, d: read(s, d, "documents").select("doc_id", C.is_large_dto(F.when(F.col("doc_id") % 2 == 0, "5").otherwise("4"), F.when(F.col("doc_id") % 3 == 0, "UserDTO").otherwise("User"), F.col("text")).alias("large")))
query("select page_id, contains(lower(html), 'code generated') and contains(lower(html), 'do not edit') as generated from pages", "generated_detect")(lambda s, d: read(s, d, "pages").select("page_id", C.is_generated(F.col("html")).alias("generated")))
query(f"select doc_id, case when trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' then '' when contains(lower(text), 'code generated') and contains(lower(text), 'do not edit') then 'generated_code' when len({_MEANING}) <= 3 then 'trivial_declaration' else '' end as fold_reason from documents", "fold_classify")(lambda s, d: read(s, d, "documents").select("doc_id", F.col("text").alias("content"), F.lit("x").alias("symbol_name"), F.lit("3").alias("chunk_type"), F.lit("").alias("signature"), F.lit("a.go").alias("file_path")).select("doc_id", C.fold_reason().alias("fold_reason")))
query(f"with {B.TURNS} select id, lag(id) over w as previous, lead(id) over w as next from turns window w as (partition by file_path order by start_line, end_line, id)", "neighbors_lag_lead")(lambda s, d: C.neighbours(B.turns(s, d)))
_PACK = f"with {B.TURNS}, s as (select file_path as pack, start_line as prio, content as text, sum(strlen(content) + case when start_line > 0 then 2 else 0 end) over (partition by file_path order by start_line) as used from turns where content <> '')"
query(f"{_PACK} select pack, string_agg(text, chr(10) || chr(10) order by prio) as context, count(*) as n_sections from s group by pack", "context_pack")(lambda s, d: C.context_pack(B.turns(s, d).select(F.col("file_path").alias("pack"), F.col("start_line").cast("long").alias("prio"), F.col("content").alias("text")), 0))
_BUDGET = 300
query(f"{_PACK} select pack, string_agg(case when used > {_BUDGET} then substring(text, 1, {_BUDGET - len(C.MARKER)}) || '{C.MARKER}' else text end, chr(10) || chr(10) order by prio) as context, count(*) as n_sections from s where used <= {_BUDGET} or prio = 0 group by pack", "context_budget")(lambda s, d: C.context_pack(B.turns(s, d).select(F.col("file_path").alias("pack"), F.col("start_line").cast("long").alias("prio"), F.col("content").alias("text")), _BUDGET))
query(f"with {B.OWNERSHIP} select src, array_to_string(list_slice(list_sort(list(dst)), 1, 12), ',') as related from edges group by src", "related_top12")(lambda s, d: B.ownership(s, d).groupBy("src").agg(F.array_join(F.slice(F.sort_array(F.collect_set("dst")), 1, 12), ",").alias("related")))
query(f"with {B.TURNS} select cast(start_line as bigint) as line, string_split(content, chr(10))[1] as text from turns where file_path = 'conv/3' and start_line between 1 and 4 and len(string_split(content, chr(10))) >= 1", "read_snippet_first_lines")(lambda s, d: B.turns(s, d).where("file_path = 'conv/3' and start_line between 1 and 4").select(F.col("start_line").cast("long").alias("line"), F.element_at(F.split("content", "\n"), 1).alias("text")))
query("select cast(i.i as bigint) as line, string_split(text, chr(10))[i.i] as text from documents, range(2, 5) i(i) where doc_id = 0 and len(string_split(text, chr(10))) >= i.i", "read_snippet")(lambda s, d: C.snippet(read(s, d, "documents").where("doc_id = 0").select(F.col("doc_id").alias("id"), F.lit("doc0").alias("file_path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("content")), "doc0:2-4"))

_GROUPS = "g as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, case when event_type = 'signup' then 0 else 1 end, event_id rows unbounded preceding) as grp from events), defs as (select user_id, grp, event_id as def_id from g where event_type = 'signup'), uses as (select g.user_id, g.grp, event_id as use_id, case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 else 3 end as kind from g where event_type <> 'signup' and grp > 0), res as (select use_id, def_id, kind from uses join defs using (user_id, grp))"


def _defs_uses(spark, d):
    e = read(spark, d, "events")
    defs = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    uses = e.where("event_type <> 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), F.expr("case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 else 3 end").alias("kind"))
    return defs, uses, flow.latest_before(defs, uses, "user_id")


query(f"with {_GROUPS} select use_id, def_id from res", "innermost_def")(lambda s, d: _defs_uses(s, d)[2])


@query(f"with {_GROUPS} select d.def_id, count(use_id) as n_uses, coalesce(sum(case when kind = 3 then 1 else 0 end), 0)::bigint as n_returns, min(use_id) as first_use, max(use_id) as last_use from defs d left join res r on d.def_id = r.def_id group by d.def_id")
def defuse_chains(spark, d):
    defs, uses, resolved = _defs_uses(spark, d)
    return flow.chains(defs.select(F.col("id").alias("def_id")), resolved, uses.select(F.col("id").alias("use_id"), "kind"))


@query(f"with {_GROUPS} select def_id as src, use_id as dst, case kind when 2 then 'call_arg' when 3 then 'return_assign' else 'def_use' end as kind from res")
def flow_edges(spark, d):
    _, uses, resolved = _defs_uses(spark, d)
    return flow.flow_edges(resolved, uses.select(F.col("id").alias("use_id"), "kind"))


@query("with v as (select event_type as name, case when event_type in ('click', 'view') then 1 when event_type = 'signup' then 2 else 0 end as scope from events where user_id = 5 group by event_type), u as (select event_type as name, count(*) as n_uses, max(case when value > 90 then 1 else 0 end) as returned from events where user_id = 5 group by event_type) select case scope when 1 then 'input' when 2 then 'side_effect' else 'internal' end as section, v.name, n_uses from v join u using (name) union all select 'output', name, n_uses from u where returned = 1")
def function_flow(spark, d):
    e = B.trace_events(spark, d)
    v = e.select(F.col("var_name").alias("name"), F.expr("case when var_name in ('click', 'view') then 1 when var_name = 'signup' then 2 else 0 end").alias("scope"), "func_id")
    return flow.function_flow(v, e.select(F.col("var_name").alias("name"), "func_id", F.expr("case when value > 90 then 3 else 0 end").alias("kind")), "5")


query("select step, name, depth from (select row_number() over (order by depth, name) as step, name, depth from (select name, min(depth) as depth from (with recursive " + B.STEPS + ", r(name, depth) as (select '5.signup', 0 union select dst, depth + 1 from r join steps on src = r.name where depth < 5) select name, cast(depth as bigint) as depth from r) group by name)) where step <= 100", "trace_variable")(lambda s, d: flow.trace(B.steps(s, d), "5.signup", 5).select("step", "name", "depth"))


def _usage(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_brand").alias("type"), F.expr("case p_size % 3 when 0 then 'param' when 1 then 'return' else 'field' end").alias("role"), F.col("p_type").alias("user"))


_USAGE = "usage as (select p_brand as type, case p_size % 3 when 0 then 'param' when 1 then 'return' else 'field' end as role, p_type as \"user\" from part)"
query(f"with {_USAGE} select distinct role, \"user\" from usage where type = (select min(p_brand) from part)", "type_flow_forward")(lambda s, d: flow.type_forward(_usage(s, d), read(s, d, "part").agg(F.min("p_brand")).first()[0]))
query(f"with {_USAGE} select type, array_to_string(list_sort(list(distinct \"user\") filter (where role = 'field')), ',') as fields from usage group by type", "type_flow_backward")(lambda s, d: flow.type_nodes(_usage(s, d)).select("type", F.nullif(F.array_join("used_as_field", ","), F.lit("")).alias("fields")))
_BACK = "select p_type as type, 'field' as role, 'g' || p_size as \"user\" from part where p_size % 2 = 0"
query(f"with {_USAGE}, u as (select * from usage union all {_BACK}), one as (select distinct \"user\" as parent from u where role = 'field' and type = (select min(p_brand) from part)) select distinct parent, f.\"user\" as grandparent from one left join (select * from u where role = 'field') f on f.type = parent", "type_backward")(lambda s, d: flow.type_backward(_usage(s, d).unionByName(read(s, d, "part").where("p_size % 2 = 0").select(F.col("p_type").alias("type"), F.lit("field").alias("role"), F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("user"))), read(s, d, "part").agg(F.min("p_brand")).first()[0]))
query(f"with {_USAGE} select distinct type as src, \"user\" as dst, 'type_field' as kind from usage where role = 'field'", "type_edges")(lambda s, d: flow.type_edges(_usage(s, d)))
query(f"with v as (select p_name as name, p_type as type, p_brand as file, p_partkey as def_line from part), q as (select 'red' as q), t as (select v.*, case when lower(name) = q then 10.0 when contains(lower(name), q) then 5.0 when list_contains({T.sql_terms('name')}, q) then 2.0 else 0.0 end + case when contains(lower(type), q) then 3.0 else 0.0 end + case when regexp_matches(name, '^\\p{{Lu}}') then 1.5 else 0.0 end as score from v, q) select name, type, file, def_line, round(score, 6) as score from (select *, row_number() over (order by score desc, name, file, def_line) as r from t where score > 0) where r <= 10", "variable_search")(lambda s, d: flow.variable_search(read(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("def_line")), "Red"))

_EVENTS = "e as (select event_id as seq, cast(user_id as varchar) as func_id, event_type as var_name, value from events)"
query(f"with {_EVENTS} select * from (select *, row_number() over (order by seq desc) as r from e) where r <= 500".replace("select * from (select *", "select seq, func_id, var_name, value from (select *"), "ring_buffer")(lambda s, d: maintenance.ring_buffer(B.trace_events(s, d).drop("ts"), 500))
query(f"with {_EVENTS} select * from e where func_id = '5'", "events_by_func")(lambda s, d: maintenance.events_of(B.trace_events(s, d).drop("ts"), func_id="5"))
query(f"with {_EVENTS} select * from e where var_name = 'error'", "events_by_var")(lambda s, d: maintenance.events_of(B.trace_events(s, d).drop("ts"), var_name="error"))


def _files(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    stored = files.where("cast(path as long) % 7 <> 0").select("path", F.sha1(F.when(F.expr("cast(path as long) % 5 = 0"), F.concat("content", F.lit("x"))).otherwise(F.col("content")).cast("binary")).alias("sha1_hex"))
    return files, stored.unionByName(stored.where("cast(path as long) % 11 = 0").select(F.concat("path", F.lit("-gone")).alias("path"), "sha1_hex"))


query("select cast(doc_id as varchar) as path, sha1(text) as hash, case when doc_id % 7 = 0 then 'new' else 'changed' end as state from documents where doc_id % 7 = 0 or doc_id % 5 = 0", "hash_diff_changed")(lambda s, d: maintenance.changed(*_files(s, d)))
query("select doc_id || '-gone' as path from documents where doc_id % 7 <> 0 and doc_id % 11 = 0", "hash_diff_deleted")(lambda s, d: maintenance.deleted(*_files(s, d)))
query("select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source from documents", "upsert_snapshot")(lambda s, d: maintenance.upsert((r := read(s, d, "documents").select("doc_id", "source")), r.where("doc_id % 3 = 0").withColumn("source", F.lit("new")), ["doc_id"]))
_AT = "max(case when r = {0} then value end)"
query(f"with t as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null) select event_type, any_value(n) as n, min(value) as min, {_AT.format('n // 2 + 1')} as median, {_AT.format('cast(ceil(n * 95 / 100.0) as bigint)')} as p95, {_AT.format('cast(ceil(n * 99 / 100.0) as bigint)')} as p99, max(value) as max from t group by event_type", "latency_percentiles")(lambda s, d: maintenance.percentiles(read(s, d, "events"), "value", ["event_type"]))
query("with t as (select p_name, row_number() over (order by p_name) - 1 as pos, count(*) over () as n from (select distinct p_name from part)) select p_name from t where n <= 20 or floor(ceil(pos * 20 / cast(n as double)) * n / 20) = pos", "distributed_sample")(lambda s, d: maintenance.distributed_sample(read(s, d, "part"), "p_name", 20))
query("select count(*) as files, cast(sum(length(text) - length(replace(text, chr(10), ''))) as bigint) as lines from documents", "repo_stats")(lambda s, d: maintenance.line_stats(read(s, d, "documents").select(F.col("text").alias("content"))))
query("select (select count(*) from documents) as chunks, (select count(*) from part) as nodes, (select count(*) from lineitem) as edges, '0.1' as version, true as ready", "status")(lambda s, d: maintenance.status({"chunks": read(s, d, "documents"), "nodes": read(s, d, "part"), "edges": read(s, d, "lineitem")}))
query("select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2", "event_windows_tumbling")(lambda s, d: read(s, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"))
