"""Source trees as relations: files, declarations, call-graph nodes and edges, imports, type usage and chunks.

Each file is parsed once, by itself, in Arrow batches; parsed() holds one row a file with what was found as arrays, and
every relation is an explode of it, so a plan that uses several of them should write parsed() first (tables.written). A
file that does not parse keeps its row with error set and gives no other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.functions import text as T
from codeloom.sources import defuse, golang, script

#: The extensions that are indexed, and the chunk type of each declaration kind (others are functions, 4).
EXTENSIONS = ["go", "js", "jsx", "ts", "tsx", "mjs", "cjs"]
CHUNK_TYPES = {1: 4, 2: 3, 3: 5, 4: 6, 7: 8, 8: 9}
BLOCK, FILE = 7, 0
MAX_TOKENS = 512

PARSED = """path string, package string, is_test boolean, error string, imports array<string>,
decls array<struct<kind:int,name:string,signature:string,recv:string,start_line:int,end_line:int>>,
methods array<struct<recv:string,name:string,line:int>>, calls array<struct<caller:string,callee:string,line:int>>,
usage array<struct<type:string,role:string,user:string,line:int>>,
defs array<struct<name:string,type:string,scope:int,func_id:string,line:int>>, uses array<struct<name:string,line:int,kind:int,func_id:string,def:int>>"""


def indexable(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def js_like(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS[1:])


def walk(spark: SparkSession, root: str, max_files: int | None = None, skip: tuple[str, ...] = ("testdata", "vendor"), extensions: list[str] = EXTENSIONS) -> DataFrame:
    """path (below root) and content of the source files under root, without dot folders and the folders skip.

    Pruned by the file listing's glob, read by the binary source; max_files keeps the first by path.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    under = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^/*" + "".join(c if c.isalnum() or c == "/" else "\\" + c for c in root.split(":", 1)[-1].strip("/")) + "/", "")
    rows = rows.select(under.alias("path"), F.col("content").cast("string").alias("content"))
    keep = ~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").rlike(r"(^|/)(" + "|".join(skip) + ")/") if skip else ~F.col("path").rlike(r"(^|/)\.")
    rows = rows.where(keep)
    return rows.orderBy("path").limit(max_files) if max_files else rows


def git_changes(spark: SparkSession, repo: str, since: str) -> DataFrame:
    """path and state (changed or deleted) of indexable files that differ from commit since: committed, in the work tree, or untracked.

    The list comes from git on the driver; only names pass through it. An unknown commit raises CalledProcessError.
    """
    import subprocess

    def git(*args: str) -> set[str]:
        return {x for x in subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout.split("\0") if x}

    names = git("diff", "--name-only", "-z", "--no-renames", since)
    there = git("ls-files", "-z", "--cached", "--others", "--exclude-standard") - git("ls-files", "-z", "--deleted")
    names |= git("ls-files", "-z", "--others", "--exclude-standard")
    rows = spark.createDataFrame([(n, "changed" if n in there else "deleted") for n in sorted(names)], "path string, state string")
    return rows.where(indexable(F.col("path")))


def head(repo: str) -> str:
    """The commit checked out in repo; empty outside a repository."""
    import subprocess

    return subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True, check=False).stdout.strip()


def parsed(files: DataFrame, nested_calls: bool = False) -> DataFrame:
    """One row a file of files (path, content), see PARSED; a null content counts as empty. nested_calls: Go calls inside calls count too."""
    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def one(path: str, text: str) -> dict:
        go = path.endswith(".go")
        try:
            found = golang.parse(path, text, nested_calls) if go else script.parse(path, text)
            walk = defuse.go(text) if go else defuse.js(path, text)
        except (ValueError, RecursionError, KeyError) as e:
            return {"path": path, "error": str(e) if isinstance(e, ValueError) else f"parse: {type(e).__name__}", "imports": [], "decls": [], "methods": [], "calls": [], "usage": [], "defs": [], "uses": []}
        rows = lambda k, names: [dict(zip(names, r, strict=True)) for r in found.get(k, [])]
        return {
            "path": path, "package": found["package"], "is_test": found["is_test"], "imports": found["imports"],
            "decls": rows("decls", ("kind", "name", "signature", "recv", "start_line", "end_line")), "methods": rows("nodes", ("recv", "name", "line")),
            "calls": rows("calls", ("caller", "callee", "line")), "usage": rows("usage", ("type", "role", "user", "line")),
            "defs": [dict(zip(("name", "type", "scope", "func_id", "line"), d, strict=True)) for d in walk.defs],
            "uses": [dict(zip(("name", "line", "kind", "func_id", "def"), u, strict=True)) for u in walk.uses],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(p or "", c or "") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, PARSED)


def decls(rows: DataFrame) -> DataFrame:
    return rows.select("path", "package", F.posexplode("decls").alias("at", "d")).select("path", "package", "at", "d.*")


def nodes(rows: DataFrame) -> DataFrame:
    """id, pkg, name, recv, file, line of functions and methods."""
    funcs = decls(rows).where((F.col("kind") == 1) & (F.col("name") != "<default>")).select("package", "name", "recv", "path", F.col("start_line").alias("line"))
    methods = rows.select("path", "package", F.explode("methods").alias("m")).select("package", "m.name", "m.recv", "path", "m.line")
    every = funcs.unionByName(methods)
    return every.select(T.node_id(F.col("package"), F.col("recv"), F.col("name")).alias("id"), F.col("package").alias("pkg"), "name", "recv", F.col("path").alias("file"), "line").dropDuplicates(["id", "file", "line"])


def edges(rows: DataFrame, by_file: bool = False) -> DataFrame:
    """src (caller) and dst (callee, as written in the source: see graph.resolve), distinct, with their file if by_file."""
    every = rows.select("path", F.explode("calls").alias("c")).select(F.col("c.caller").alias("src"), F.col("c.callee").alias("dst"), F.col("path").alias("file"))
    return (every if by_file else every.drop("file")).distinct()


def imports(rows: DataFrame, by_file: bool = False) -> DataFrame:
    """pkg and dep, distinct, with their file if by_file; of Go imports only those with a dot, as the others are the standard library's."""
    every = rows.select("path", F.col("package").alias("pkg"), F.explode("imports").alias("dep"))
    return every.where((F.col("dep") != "") & (~F.endswith("path", F.lit(".go")) | F.contains("dep", F.lit(".")))).select("pkg", "dep", *[F.col("path").alias("file")] * by_file).distinct()


def usage(rows: DataFrame) -> DataFrame:
    """type, role (param, return, field), user, file and line: input of flow.type_nodes()."""
    return rows.select("path", F.explode("usage").alias("u")).select("u.*", F.col("path").alias("file"))


def variables(rows: DataFrame) -> DataFrame:
    """def_id, name, type, scope (0 local, 1 parameter, 2 global), pkg, file, func_id, def_line: one row a definition."""
    every = rows.select("path", "package", F.posexplode("defs").alias("at", "d"))
    return every.select(F.format_string("%s#%d", "path", "at").alias("def_id"), "d.name", "d.type", "d.scope", F.col("package").alias("pkg"), F.col("path").alias("file"), "d.func_id", F.col("d.line").alias("def_line"))


def uses(rows: DataFrame) -> DataFrame:
    """use_id, def_id, name, file, line, kind (0 read, 1 write, 2 call argument, 3 return), func_id: input of flow.chains() and flow.flow_edges(), its own columns use_id and def_id being their resolved pairs."""
    every = rows.select("path", F.posexplode("uses").alias("at", "u"))
    return every.select(F.format_string("%s@%d", "path", "at").alias("use_id"), F.format_string("%s#%d", "path", "u.def").alias("def_id"), "u.name", F.col("path").alias("file"), "u.line", "u.kind", "u.func_id")


def tested(rows: DataFrame) -> DataFrame:
    """path and symbol: what the tests TestX, TestX_y and TestX_Y of a file name: X, and X.Y if Y starts with a capital."""
    name = decls(rows).where("kind = 1 and name like 'Test_%'").select("path", F.substr("name", F.lit(5)).alias("n"))
    part = name.select("path", F.when(F.locate("_", F.col("n")) > 1, F.substring_index("n", "_", 1)).otherwise(F.col("n")).alias("x"), F.regexp_extract("n", "^[^_]+_([A-Z].*)$", 1).alias("y"))
    return part.select("path", F.explode(F.when(F.col("y") == "", F.array("x")).otherwise(F.array("x", F.concat_ws(".", "x", "y")))).alias("symbol")).distinct()


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts declarations over the limit into blocks; braces decide where a cut may be, so that nested code stays together."""
    import re

    token = re.compile(r"[(){}\[\];,.:]|[^ \t\n\r(){}\[\];,.:]+")
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            held, size, first, depth, at = [], 0, r["start_line"], 0, r["start_line"]
            for at, line in enumerate(r["content"].split("\n"), r["start_line"]):
                was, depth, n = depth, depth + line.count("{") - line.count("}"), len(token.findall(line))
                over = size + n > limit
                if over and held and 0 in (was, depth):
                    out.append((r["path"], r["package"], r["name"], first, at, "\n".join(held).rstrip("\n")))
                    held, size, first = [], 0, at + 1
                if over and not held:  # the line that did not fit is a block of its own
                    out.append((r["path"], r["package"], "", at, at, line))
                    continue
                held.append(line)
                size += n
            if held:
                out.append((r["path"], r["package"], r["name"], first, r["end_line"], "\n".join(held).rstrip("\n")))
        names = ["path", "package", "name", "start_line", "end_line", "content"]
        types = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=names)


def chunks(files: DataFrame, rows: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One chunk a declaration, with its lines; longer ones than max_tokens in blocks; a file without any is one empty chunk.

    id (path:start-end; of two with the same id the later declaration stays), file_path, chunk_type, symbol_name,
    signature, start_line, end_line, content, package. Lines are cut by built-in functions; only long declarations go
    through Python.
    """
    limit = max_tokens if max_tokens > 0 else MAX_TOKENS
    lines = F.split("content", "\n")
    body = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    every = decls(rows).join(files.select("path", "content"), "path").withColumn("content", body).withColumn("tokens", T.code_size(F.col("content")))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in CHUNK_TYPES.items() for x in kv])[F.col("kind")], F.lit(4))
    columns = ["path", "package", "name", "start_line", "end_line", "content"]
    small = every.where(F.col("tokens") <= limit).select(*columns, "signature", kind.alias("type"), "at")
    large = every.where(F.col("tokens") > limit).select(*columns).mapInArrow(lambda b: _blocks(b, limit), "path string, package string, name string, start_line int, end_line int, content string")
    both = small.unionByName(large.select("*", F.lit("").alias("signature"), F.lit(BLOCK).alias("type"), F.lit(0).alias("at")))
    bare = rows.where("error is null and size(decls) = 0").select("path", "package", F.lit("").alias("name"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("").alias("content"), F.lit("").alias("signature"), F.lit(FILE).alias("type"), F.lit(0).alias("at"))
    named = both.withColumn("id", F.format_string("%s:%d-%d", "path", "start_line", "end_line")).unionByName(bare.withColumn("id", F.col("path")))
    last = F.max_by(F.struct("path", "type", "name", "signature", "start_line", "end_line", "content", "package"), "at").alias("c")
    c = named.groupBy("id").agg(last)
    return c.select("id", F.col("c.path").alias("file_path"), F.col("c.type").cast("string").alias("chunk_type"), F.col("c.name").alias("symbol_name"), "c.signature", "c.start_line", "c.end_line", "c.content", "c.package")


def find_functions(files: DataFrame, rows: DataFrame, pattern: str) -> DataFrame:
    """path, line, snippet, name of functions that fit: '*' all, 'func Name' the name, 'func (Recv).Name' both, else a part of the name."""
    import re

    found = decls(rows).where("kind = 1")
    exact = re.fullmatch(r"func (?:\(\*?(\w+)\)\.)?(\w+)", pattern.strip())
    if exact:
        found = found.where((F.col("name") == exact[2]) & (F.col("recv") == exact[1] if exact[1] else F.lit(True)))
    elif pattern != "*":
        found = found.where(F.contains("name", F.lit(pattern)))
    shown = F.when(F.col("recv") != "", F.format_string("(%s).%s", "recv", "name")).otherwise(F.col("name"))
    return _located(files, found.select("path", F.col("start_line").alias("line"), shown.alias("name")))


def find_types(files: DataFrame, rows: DataFrame, pattern: str) -> DataFrame:
    """path, line, snippet, name of types that fit: '*' all, else a part of the name."""
    found = decls(rows).where("kind in (2, 3, 4)").where(F.lit(pattern == "*") | F.contains("name", F.lit(pattern)))
    return _located(files, found.select("path", F.col("start_line").alias("line"), "name"))


def _located(files: DataFrame, found: DataFrame) -> DataFrame:
    line = F.trim(F.element_at(F.split("content", "\n"), F.col("line")))
    return found.join(files.select("path", "content"), "path").select("path", "line", line.alias("snippet"), "name")


def find_identifiers(files: DataFrame, symbol: str) -> DataFrame:
    """path, line, snippet, name of identifiers that equal symbol or have it as a camel-case part; once for each line and name."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).where(F.contains(F.lower("text"), F.lit(symbol.lower())))
    words = rows.select("path", (F.col("at") + 1).alias("line"), F.trim("text").alias("snippet"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}_$][\p{L}\p{Nd}_$]*"), F.lit(0)))).alias("name"))
    return words.where((F.col("name") == symbol) | F.array_contains(T.split_identifier(F.col("name")), symbol.lower()))
