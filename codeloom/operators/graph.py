"""Graph operators over edge tables (src, dst): neighbours, bounded impact, closure, resolution, cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.tables import written


def callers(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct()


def callees(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def in_edges(edges: DataFrame) -> DataFrame:
    """id and caller: every distinct source of each destination, one row each, so that hot nodes need no array."""
    return edges.select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct()


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """id, n_callers, first_caller and last_caller: a summary of in_edges(), one row a node."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_callers"), F.min("src").alias("first_caller"), F.max("src").alias("last_caller"))


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """id and depth (least number of steps) of all that roots (id) reach, roots at depth 0; max_depth 0: without bound.

    Semi-naive: each round joins the newest nodes alone, and drops known ones; rounds are written to the shared folder,
    so a round's cost does not include those before.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    newest = written(roots.select("id").distinct().withColumn("depth", F.lit(0).cast("long")), "reach")
    known, depth = newest, 0
    while not max_depth or depth < max_depth:
        depth += 1
        step = newest.select("id").join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        newest = written(step.join(known.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "reach")
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
    return known


def impact(edges: DataFrame, start: str, max_depth: int = 3, direction: str = "full") -> DataFrame:
    """id, depth, direction of what start reaches (downstream) or is reached from (upstream); full is both, without removing doubles across."""
    one = edges.sparkSession.createDataFrame([(start,)], "id string")
    down = lambda: reach(edges, one, max_depth).where("depth > 0").withColumn("direction", F.lit("downstream"))
    up = lambda: reach(reverse(edges), one, max_depth).where("depth > 0").withColumn("direction", F.lit("upstream"))
    return {"downstream": down, "upstream": up, "full": lambda: down().unionByName(up())}[direction]()


def package_impact(imports: DataFrame, package: str, max_depth: int = 3) -> DataFrame:
    """Packages that depend on package, directly or not."""
    edges = imports.select(F.col("dep").alias("src"), F.col("pkg").alias("dst"))
    one = imports.sparkSession.createDataFrame([(package,)], "id string")
    return reach(edges, one, max_depth).where("depth > 0").withColumn("direction", F.lit("downstream"))


def add_imports(files: DataFrame, dotted: bool = False) -> DataFrame:
    """Distinct (pkg, dep) from files (package, imports); empty ones are left out; dotted keeps paths with a dot only."""
    rows = files.select(F.col("package").alias("pkg"), F.explode("imports").alias("dep")).where("dep <> ''").distinct()
    return rows.where(F.contains("dep", F.lit("."))) if dotted else rows


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with callees resolved to node ids: an exact id, else the caller's package with the name, or with its last selector.

    Equi-joins on id and on (package, name) replace a scan of all nodes for each edge. Only distinct nodes are joined, as
    repeated ones would multiply rows; and never by a broadcast, as a file's size tells little of the nodes in it.
    """
    keys = lambda *c: nodes.select(*c).distinct().hint("merge")
    ids = keys(F.col("id").alias("dst"))
    tried = edges.select("src", "dst").where("dst <> '' and dst <> '<anonymous>'").distinct().join(ids.withColumn("known", F.lit(True)), "dst", "left")
    exact = tried.where("known").select("src", "dst")
    rest = tried.where("known is null").join(keys(F.col("id").alias("src"), "pkg"), "src")
    local = rest.select("src", F.concat("pkg", F.lit("."), "dst").alias("dst")).join(ids, "dst", "left_semi")
    named = rest.select("src", "pkg", T.last_selector(F.col("dst")).alias("name")).where("name <> ''").distinct().join(keys("pkg", "name", F.col("id").alias("dst")), ["pkg", "name"]).select("src", "dst")
    return exact.unionByName(local.select("src", "dst")).unionByName(named).distinct()


def is_root(name: Column, pkg: Column, file: Column) -> Column:
    test = F.endswith(file, F.lit("_test.go")) & name.rlike("^(Test|Benchmark|Fuzz|Example)")
    return (name == "init") | ((pkg == "main") & (name == "main")) | test | T.exported(name)


def closure(nodes: DataFrame, edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """id of every node that roots (see is_root) and extra (id) reach over resolved edges."""
    roots = nodes.where(is_root(F.col("name"), F.col("pkg"), F.col("file"))).select("id")
    if extra is not None:
        roots = roots.unionByName(extra.select("id"))
    return reach(resolve(nodes, edges), roots.distinct()).select("id")


def query_roots(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query and id of the nodes that a query names: their name or id equals the query's text when normalized, or all its terms occur in the name or id.

    asked: query, q, terms, a row a query. It is what a caller types, and is broadcast; nodes are read once for all queries.
    """
    rows = nodes.select("id", "name").crossJoin(F.broadcast(asked.select("query", T.normalize(F.col("q")).alias("plain"), "terms")))
    equal = (F.col("plain") != "") & ((T.normalize(F.col("name")) == F.col("plain")) | (T.normalize(F.col("id")) == F.col("plain")))
    holds = F.forall("terms", lambda t: F.contains(F.lower("name"), t) | F.contains(F.lower("id"), t))
    return rows.where(equal | (F.size("terms") > 0) & holds).select("query", "id").distinct()


def reachable_chunks(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """query and id of the chunks at the line of a node that is reached from the general roots (see is_root) or the query's own; nothing for a query without roots of its own.

    The closure of the general roots is computed once; each query's own adds what its roots reach, all queries in one
    walk over pairs (query, node).
    """
    own = written(query_roots(nodes, asked), "roots")
    if own.isEmpty():  # the usual case of a query in plain words: no closure is needed
        return own.select("query", F.col("id").cast(chunks.schema["id"].dataType).alias("id"))
    resolved = written(resolve(nodes, edges), "resolved")
    base = reach(resolved, nodes.where(is_root(F.col("name"), F.col("pkg"), F.col("file"))).select("id")).select("id")
    pair = lambda c: F.struct("query", F.col(c).alias("id"))
    steps = resolved.crossJoin(F.broadcast(own.select("query").distinct())).select(pair("src").alias("src"), pair("dst").alias("dst"))
    mine = reach(steps, own.select(pair("id").alias("id"))).select("id.query", "id.id")
    every = mine.unionByName(base.crossJoin(F.broadcast(own.select("query").distinct())).select("query", "id")).distinct()
    at = nodes.join(every, "id").select("query", F.col("file").alias("file_path"), F.col("line").alias("start_line")).distinct()
    return at.join(chunks.select("id", "file_path", "start_line"), ["file_path", "start_line"]).select("query", "id").distinct()


def symbol_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name, package or id contains query, whatever the case."""
    q = query.lower()
    return nodes.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("pkg"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)))


def xref(nodes: DataFrame, edges: DataFrame, imports: DataFrame, symbol: str) -> DataFrame:
    """kind and id: definitions (the exact id, else equal name or id that contains symbol), callers, callees, imported_by, references."""
    exact = nodes.where(F.col("id") == symbol).select("id")
    like = nodes.where((F.col("name") == symbol) | F.contains("id", F.lit(symbol))).select("id")
    found = exact.unionByName(like.join(exact.select(F.lit(1).alias("hit")).limit(1), F.lit(True), "left_anti"))
    importers = imports.where(F.col("dep") == symbol).select(F.col("pkg").alias("id")).distinct()
    parts = {"definition": found, "caller": callers(edges, symbol), "callee": callees(edges, symbol), "imported_by": importers, "reference": callers(edges, symbol).unionByName(importers)}
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("kind"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def references(nodes: DataFrame, edges: DataFrame, imports: DataFrame, symbol: str) -> DataFrame:
    """result: the symbol's references, then its definitions marked 'def: '."""
    rows = xref(nodes, edges, imports, symbol)
    return rows.where("kind in ('reference', 'definition')").select(F.when(F.col("kind") == "definition", 1).otherwise(0).cast("long").alias("section"), F.when(F.col("kind") == "definition", F.concat(F.lit("def: "), "id")).otherwise(F.col("id")).alias("result"))


def definitions(chunks: DataFrame, nodes: DataFrame, symbol: str) -> DataFrame:
    """section, result: type chunks whose symbol contains symbol, then graph nodes found by symbol_search."""
    q = symbol.lower()
    types = chunks.where(F.col("chunk_type").isin("3", "5", "6", "8", "9") & F.contains(F.lower("symbol_name"), F.lit(q)))
    first = types.select(F.lit(0).cast("long").alias("section"), F.format_string("[%s] %s (%s:%d-%d)", T.type_label(F.col("chunk_type")), "symbol_name", "file_path", "start_line", "end_line").alias("result"))
    second = symbol_search(nodes, symbol).select(F.lit(1).cast("long").alias("section"), F.format_string("[%s] %s (%s:%d)", F.when(F.coalesce("recv", F.lit("")) != "", "method").otherwise("func"), "name", "file", "line").alias("result"))
    return first.unionByName(second)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def sorted_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by id: a range-partitioned sort."""
    return nodes.orderBy("id", "file", "line")
