"""Data-flow operators: definitions, uses and chains, variable and type traces, function flow, variable search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T
from codeloom.tables import written


def innermost(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """use_id and def_id: of each use, the definition of its name in the innermost scope around it, of equal scopes the latest.

    defs: def_id, name, scope (file or owner), at, start, end, depth; uses: use_id, name, scope, at. One equi-join on
    scope and name, the interval as its residual condition, and a row number for each use.
    """
    near = uses.join(defs.withColumnRenamed("at", "def_at"), ["scope", "name"]).where((F.col("at") >= F.col("def_at")) & F.col("at").between(F.col("start"), F.col("end")))
    w = Window.partitionBy("use_id").orderBy(F.desc("depth"), F.desc("def_at"), F.desc("def_id"))
    return near.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("use_id", "def_id")


def latest_before(defs: DataFrame, uses: DataFrame, by: str) -> DataFrame:
    """use_id and def_id: of each use the latest definition before it with the same by; rows (by, at, id) in both.

    An as-of join by one window over both tables: the last definition seen so far. No pair of rows is built.
    """
    rows = defs.select(by, "at", F.col("id").alias("def_id"), F.lit(None).cast("long").alias("use_id"), F.lit(0).alias("kind")).unionByName(uses.select(by, "at", F.lit(None).cast("long").alias("def_id"), F.col("id").alias("use_id"), F.lit(1).alias("kind")))
    w = Window.partitionBy(by).orderBy("at", "kind", F.coalesce("def_id", "use_id")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("def_id", F.last("def_id", ignorenulls=True).over(w)).where("kind = 1 and def_id is not null").select("use_id", "def_id")


def chains(defs: DataFrame, resolved: DataFrame, uses: DataFrame) -> DataFrame:
    """def_id, n_uses, n_returns, first_use, last_use: definitions without uses stay."""
    used = resolved.join(uses, "use_id").groupBy("def_id").agg(F.count("*").alias("n_uses"), F.sum(F.when(F.col("kind") == 3, 1).otherwise(0)).alias("n_returns"), F.min("use_id").alias("first_use"), F.max("use_id").alias("last_use"))
    return defs.select("def_id").join(used, "def_id", "left").na.fill(0, ["n_uses", "n_returns"])


def nested_chains(defs: DataFrame, resolved: DataFrame, uses: DataFrame) -> DataFrame:
    """Chains as one row a definition with its uses as an array."""
    listed = resolved.join(uses, "use_id").groupBy("def_id").agg(F.sort_array(F.collect_list(F.struct("line", "use_id", "kind", "func_id"))).alias("uses"))
    return defs.join(listed, "def_id", "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<struct<line:int,use_id:string,kind:int,func_id:string>>")))


def flow_edges(resolved: DataFrame, uses: DataFrame) -> DataFrame:
    """src (definition), dst (use), kind: def_use, call_arg or return_assign."""
    kind = F.when(F.col("kind") == 2, "call_arg").when(F.col("kind") == 3, "return_assign").otherwise("def_use")
    return resolved.join(uses, "use_id").select(F.col("def_id").alias("src"), F.col("use_id").alias("dst"), kind.alias("kind"))


def argument_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """From calls (pkg, callee, position, arg): edges from arguments to param_<i> of known functions pkg.callee."""
    known = calls.withColumn("id", F.concat("pkg", F.lit("."), "callee")).join(nodes.select("id"), "id", "left_semi")
    return known.select(F.col("arg").alias("src"), F.concat("id", F.lit(".param_"), F.col("position").cast("string")).alias("dst"), F.lit("call_arg").alias("kind"))


def type_nodes(usage: DataFrame) -> DataFrame:
    """From usage (type, role: param, return or field, user): a row a type with its users by role as sorted arrays, over all files."""
    role = lambda r: F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("user")))).alias(f"used_as_{r}")
    return usage.groupBy("type").agg(role("param"), role("return"), role("field"))


def type_edges(usage: DataFrame) -> DataFrame:
    return usage.where("role = 'field'").select(F.col("type").alias("src"), F.col("user").alias("dst"), F.lit("type_field").alias("kind")).distinct()


def type_forward(usage: DataFrame, name: str) -> DataFrame:
    """role and user of a type: where it goes."""
    return usage.where(F.col("type") == name).select("role", "user").distinct()


def type_backward(usage: DataFrame, name: str) -> DataFrame:
    """Composers of a type (users as a field) with what composes them in turn, null where nothing does."""
    one = usage.where((F.col("type") == name) & (F.col("role") == "field")).select(F.col("user").alias("parent")).distinct()
    two = usage.where("role = 'field'").select(F.col("type").alias("parent"), F.col("user").alias("grandparent")).distinct()
    return one.join(two, "parent", "left")


def variable_search(variables: DataFrame, query: str, k: int = 10, keys: tuple[str, ...] = ("name", "file", "def_line")) -> DataFrame:
    """Variables (name, type, file, def_line) with a score above zero, the best k: exact 10, contained 5, else shared terms; type +3; exported +1.5."""
    spark = variables.sparkSession
    q = spark.createDataFrame([(query,)], "q string").select(F.lower("q").alias("q"), T.query_terms(F.col("q")).alias("terms"))
    rows = variables.crossJoin(F.broadcast(q))  # one row
    name = F.lower("name")
    shared = F.size(F.array_intersect("terms", T.terms(F.col("name"))))
    base = F.when(name == F.col("q"), 10.0).when(F.contains(name, F.col("q")), 5.0).when(shared > 0, 2.0 * shared / F.size("terms")).otherwise(0.0)
    score = base + F.when(F.contains(F.lower("type"), F.col("q")), 3.0).otherwise(0.0) + F.when(T.exported(F.col("name")), 1.5).otherwise(0.0)
    return rows.select(*variables.columns, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), *keys).limit(k)


def trace(links: DataFrame, start: str, max_depth: int = 5, cap: int = 100) -> DataFrame:
    """step, name, depth: names reached from start over links (src, dst) in breadth-first order, each once, at most cap of them."""
    spark = links.sparkSession
    newest = written(spark.createDataFrame([(start, 0)], "name string, depth long"), "trace")
    known, depth = newest, 0
    while depth < max_depth:
        depth += 1
        step = newest.join(links, F.col("name") == F.col("src")).select(F.col("dst").alias("name")).distinct().join(known.select("name"), "name", "left_anti")
        newest = written(step.withColumn("depth", F.lit(depth).cast("long")), "trace")
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
        if known.count() >= cap:
            break
    first = known.orderBy("depth", "name").limit(cap)
    return first.withColumn("step", F.row_number().over(Window.orderBy("depth", "name")).cast("long"))  # cap rows


def function_flow(variables: DataFrame, uses: DataFrame, func: str) -> DataFrame:
    """section (input, internal, output, side_effect), name, n_uses of the variables (name, scope, func_id) of a function.

    scope: 0 local, 1 parameter, 2 global. A variable with a return use is an output as well; a global used is a side effect.
    """
    mine = variables.where(F.col("func_id") == func).select("name", "scope").distinct()
    counted = uses.where(F.col("func_id") == func).groupBy("name").agg(F.count("*").alias("n_uses"), F.max(F.when(F.col("kind") == 3, 1).otherwise(0)).alias("returned"))
    rows = mine.join(counted, "name", "left").na.fill(0, ["n_uses", "returned"])
    own = F.when(F.col("scope") == 1, "input").when(F.col("scope") == 2, "side_effect").otherwise("internal")
    first = rows.select(own.alias("section"), "name", "n_uses")
    return first.unionByName(rows.where("returned = 1").select(F.lit("output").alias("section"), "name", "n_uses"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by order; order must tell them apart for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("seen", F.row_number().over(w)).where("seen = 1").drop("seen")


def variables_named(variables: DataFrame, part: str) -> DataFrame:
    """Variables (pkg, name, file, def_line) whose name holds part in any case, the first of each pkg, name and file."""
    return first_seen(variables.where(F.contains(F.lower("name"), F.lit(part.lower()))), ["pkg", "name", "file"], ["def_line"])


def lookup_index(variables: DataFrame) -> DataFrame:
    """kind (name, type, func or file), key and def_id: the four multimaps of variables as one relation, for lookups by equality.

    Rows instead of arrays, so that a key that a third of all variables share is no single value.
    """
    entry = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("key"))
    entries = F.explode(F.array(entry("name", "name"), entry("type", "type"), entry("func", "func_id"), entry("file", "file")))
    return variables.select(entries.alias("e"), "def_id").select("e.kind", "e.key", "def_id").where("key is not null").distinct()


def lookup(index: DataFrame, kind: str, key: str) -> DataFrame:
    return index.where((F.col("kind") == kind) & (F.col("key") == key)).select("def_id")


def usage_counts(uses: DataFrame) -> DataFrame:
    """func_id, name, n_uses and first_return (least line of a return use, null for none) of uses (func_id, name, kind, line)."""
    return uses.groupBy("func_id", "name").agg(F.count("*").alias("n_uses"), F.min(F.when(F.col("kind") == 3, F.col("line"))).alias("first_return"))


def counters(**relations: DataFrame) -> DataFrame:
    """One row: <name>_count for each relation."""
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in relations.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(f"{name}_count") for name in relations))
