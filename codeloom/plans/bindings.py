"""The driver tables read as the relations that the operators take, in Spark and, as CTEs, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T
from codeloom.operators.index import Index, build
from codeloom.tables import read

SYMBOL = r"^\s*(\S+)"


_INDEXES: dict[tuple, Index] = {}


def stored_index(spark: SparkSession, d: str) -> Index:
    """The index over documents, built once an application for each state of the table's files."""
    docs = read(spark, d, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).alias("h")).first()["h"]
    key = (spark.sparkContext.applicationId, d, files)
    if key not in _INDEXES:
        _INDEXES[key] = build(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return _INDEXES[key]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """documents as chunks: reachability and semantic role stand in from labels."""
    docs = read(spark, d, "documents")
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("file_path"),
        F.regexp_extract("text", SYMBOL, 1).alias("symbol_name"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("content"),
    )
    state = F.when(F.col("toxic") == 1, "unreachable").when(F.col("toxic") == 0, "reachable").otherwise("unknown")
    role = F.when(F.col("quality") == 0, "boilerplate").otherwise("")
    weight = F.when(F.col("quality") == 0, 0.65).when(F.col("toxic") == 1, 0.55).otherwise(1.0)
    return rows.join(labels, "id", "left").select(*rows.columns, state.alias("reachability"), role.alias("semantic_role"), F.when(F.col("quality") == 0, "simple_wrapper").otherwise("").alias("fold_reason"), weight.alias("context_weight"))


CORPUS = """chunks as (select d.doc_id as id, source || '/' || cast(d.doc_id as varchar) || '.' || lang as file_path, regexp_extract(text, '^\\s*(\\S+)', 1) as symbol_name,
 text as content, len(string_split(text, chr(10))) as end_line,
 case when toxic = 1 then 'unreachable' when toxic = 0 then 'reachable' else 'unknown' end as reachability,
 case when quality = 0 then 'boilerplate' else '' end as semantic_role,
 case when quality = 0 then 0.65 when toxic = 1 then 0.55 else 1.0 end as context_weight
 from documents d left join labels l on d.doc_id = l.doc_id)"""

POSTINGS = f"""tok as (select doc_id as id, unnest({T.sql_terms("text")}) as term from documents),
post as (select id, term, count(*) as tf from tok group by id, term),
lens as (select d.doc_id as id, cast(coalesce(s.len, 0) as bigint) as len from documents d left join (select id, sum(tf) as len from post group by id) s on d.doc_id = s.id),
stats as (select count(*) as n, avg(len) as avg_len from lens),
idf as (select term, count(*) as df, ln(1 + (any_value(n) - count(*) + 1) / (count(*) + 0.5)) as idf, count(*) > floor(4 * any_value(n) / 5) as stop from post, stats group by term)"""


def asked(texts: list[str]) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return f"q as (select distinct query, q, term from (select query, q, unnest({T.sql_terms('q', T.QUERY_STOPWORDS)}) as term from (values {values}) v(query, q)))"


BM25 = "bm as (select query, p.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) as score from q join post p on q.term = p.term join idf i on i.term = p.term and not i.stop join lens l on l.id = p.id, stats group by query, p.id)"


def ownership(spark: SparkSession, d: str) -> DataFrame:
    """Edges (src, dst) from customers over orders, parts and suppliers to nations and regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, li, s, n = (read(spark, d, t) for t in ("orders", "lineitem", "supplier", "nation"))
    parts = [
        o.select(name("c:", "o_custkey").alias("src"), name("o:", "o_orderkey").alias("dst")),
        li.select(name("o:", "l_orderkey").alias("src"), name("p:", "l_partkey").alias("dst")),
        li.select(name("p:", "l_partkey").alias("src"), name("s:", "l_suppkey").alias("dst")),
        s.select(name("s:", "s_suppkey").alias("src"), name("n:", "s_nationkey").alias("dst")),
        n.select(name("n:", "n_nationkey").alias("src"), name("r:", "n_regionkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


OWNERSHIP = """edges as (select 'c:' || o_custkey as src, 'o:' || o_orderkey as dst from orders union select 'o:' || l_orderkey, 'p:' || l_partkey from lineitem
 union select 'p:' || l_partkey, 's:' || l_suppkey from lineitem union select 's:' || s_suppkey, 'n:' || s_nationkey from supplier union select 'n:' || n_nationkey, 'r:' || n_regionkey from nation)"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Edges between consecutive kinds of a user's events; with cycles."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = lambda c: F.concat(F.col("user_id").cast("string"), F.lit("."), c)
    rows = read(spark, d, "events").withColumn("next", F.lead("event_type").over(w)).where("next is not null")
    return rows.select(node("event_type").alias("src"), node("next").alias("dst")).distinct()


STEPS = "steps as (select distinct user_id || '.' || event_type as src, user_id || '.' || next as dst from (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next from events) where next is not null)"


def imports(spark: SparkSession, d: str) -> DataFrame:
    """(pkg, dep): a page's host and the links in it."""
    pages = read(spark, d, "pages")
    return pages.select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("pkg"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dep")).where("dep <> ''").distinct()


IMPORTS = """imports as (select distinct pkg, dep from (select regexp_extract(url, '://([^/?#]*)', 1) as pkg, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as dep from pages) where dep <> '')"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """part as code symbols: nodes (id, pkg, recv, name, file, line), a brand being the package."""
    p = read(spark, d, "part")
    return p.select(F.concat("p_brand", F.lit("."), "p_name").alias("id"), F.col("p_brand").alias("pkg"), F.lit("").alias("recv"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(".go")).alias("file"), F.col("p_partkey").cast("int").alias("line"))


SYMBOLS = "nodes as (select p_brand || '.' || p_name as id, p_brand as pkg, '' as recv, p_name as name, p_type || '.go' as file, cast(p_partkey as integer) as line from part)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conversations as chunks of a file each."""
    c = read(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file_path"), F.col("role").alias("symbol_name"), F.col("turn").cast("int").alias("start_line"), F.col("turn").cast("int").alias("end_line"), F.col("text").alias("content"))


TURNS = "turns as (select conv_id * 1000 + turn as id, 'conv/' || conv_id as file_path, role as symbol_name, turn as start_line, turn as end_line, text as content from conversations)"


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("func_id"), F.col("event_type").alias("var_name"), "value", "ts")
