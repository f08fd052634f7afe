"""Indexing a source tree into a store, keeping it in step, and the queries over it.

    engine = Engine(Store(spark, "/shared/index"))
    engine.sync("/src/project")
    engine.query("search_code", text="session token", top_k=5).show()
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunks as C
from codeloom.operators import flow, graph, maintenance, search
from codeloom.sources import code
from codeloom.sources.store import Store
from codeloom.tables import written

#: Default and greatest value of each bounded argument.
TOP_K, IMPACT_DEPTH, TRACE_DEPTH, VARIABLES = (10, 200), (3, 10), (5, 20), (10, 100)
NOTHING = {"find_definition": "no definition found", "get_callers": "no callers found", "get_callees": "no callees found", "impact_analysis": "no impact detected"}
#: The one row that tells of the last sync.
META = "mode string, indexed long, deleted long, updated_at timestamp"


def bounded(value: int, limits: tuple[int, int]) -> int:
    return limits[0] if value <= 0 else min(value, limits[1])


class Engine:
    def __init__(self, store: Store, pruning: str = "soft"):
        self.store, self.spark, self.pruning = store, store.spark, C.pruning_mode(pruning)

    def sync(self, root: str, full: bool = False, max_files: int | None = None) -> dict[str, int]:
        """Index the files below root that are new or changed by hash (all if full), drop those that are gone; counts of both, and of files that did not parse.

        Labels depend on the whole graph, so they are set anew for all chunks; parsing is done for changed files only.
        """
        files = code.walk(self.spark, root, max_files)
        stored = self.store.table("files")
        if stored is None or full:
            stored = self.spark.createDataFrame([], "path string, sha1_hex string")
        now = written(maintenance.changed(files, stored), "changed")
        was = self.store.table("files")
        gone = (stored if was is None else was).join(files.select("path"), "path", "left_anti").select("path")
        touched = written(files.join(now.select("path"), "path", "left_semi"), "files")
        rows = written(code.parsed(touched), "parsed")
        counts = {"indexed": now.count(), "deleted": gone.count(), "failed": rows.where("error is not null").count()}
        if not counts["indexed"] and not counts["deleted"]:
            return counts
        old = written(now.select("path").unionByName(gone), "old")
        by = lambda column: (old.withColumnRenamed("path", column), [column])
        deletes = {"files": by("path"), "raw_chunks": by("file_path"), "nodes": by("file"), "edges": by("file"), "imports": by("file"), "usage": by("file"), "variables": by("file"), "uses": by("file")}
        self.store.commit(
            puts={
                "files": (now.select("path", F.col("hash").alias("sha1_hex")), ["path"]),
                "raw_chunks": (code.chunks(touched, rows), ["id"]),
                "nodes": (code.nodes(rows), ["id", "file", "line"]),
                "edges": (code.edges(rows, by_file=True), ["src", "dst", "file"]),
                "imports": (code.imports(rows, by_file=True), ["pkg", "dep", "file"]),
                "usage": (code.usage(rows), ["type", "role", "user", "file", "line"]),
                "variables": (code.variables(rows), ["def_id"]),
                "uses": (code.uses(rows), ["use_id"]),
            },
            deletes=deletes,
            replace={"meta": self.spark.createDataFrame([("full" if full else "incremental", counts["indexed"], counts["deleted"], datetime.datetime.now(datetime.UTC))], META)},
        )
        self.refresh()
        return counts

    def refresh(self) -> None:
        """Labels, folding and (in hard mode) pruning of all chunks, and their postings, as one version."""
        raw = self.store.table("raw_chunks").withColumn("reachability", F.lit("")).withColumn("context_weight", F.lit(1.0)).withColumn("semantic_role", F.lit("")).withColumn("fold_reason", F.lit(""))
        nodes = self.store.table("nodes")
        rows = C.fold(C.label(raw, nodes, graph.closure(nodes, self.edges())))
        rows = written(C.hard_prune(rows) if self.pruning == "hard" else rows, "chunks")
        post = written(search.postings(rows), "postings")
        self.store.commit(replace={"chunks": rows, "postings": post, "lengths": search.doc_lengths(rows, post)})

    def edges(self) -> DataFrame:
        return self.store.table("edges").select("src", "dst").distinct()

    def imports(self) -> DataFrame:
        return self.store.table("imports").select("pkg", "dep").distinct()

    def query(self, kind: str, text: str = "", **options) -> DataFrame:
        """The rows of a query kind: search_code, find_definition, find_references, get_callers, get_callees, impact_analysis,
        get_context_pack, read_snippet, reachable_chunks, trace_variable, function_dataflow, type_flow, variable_search,
        variable_lookup, trace_runtime, reindex, rag_status. Raises ValueError on others.
        """
        found = getattr(self, f"_{kind}", None) if kind in KINDS else None
        if found is None:
            raise ValueError(f"unknown query type {kind!r}")
        return found(text, **options)

    def text(self, kind: str, text: str = "", **options) -> str:
        """A query's rows, numbered, as text; a note where there are none. All rows are given, read a partition at a time."""
        rows = self.query(kind, text, **options)
        order = [c for c in ("rank", "section", "direction", "depth", "line", "id") if c in rows.columns]
        shown = [" ".join(str(v) for c, v in r.asDict().items() if c not in ("rank", "section") and v is not None) for r in (rows.orderBy(*order) if order else rows).toLocalIterator()]
        return "\n".join(f"{i}. {line}" for i, line in enumerate(shown, 1)) or NOTHING.get(kind, "no results")

    def _search_code(self, text: str, top_k: int = 10, language: str = "", path: str = "") -> DataFrame:
        rows, post, lengths = (self.store.table(t) for t in ("chunks", "postings", "lengths"))
        near = None if self.pruning == "off" else self._reachable_chunks(text).withColumn("query", F.lit(0))
        return search.search(rows, post, lengths, [text], k=bounded(top_k, TOP_K), language=language, path=path, pruning="off" if self.pruning == "off" else "soft", reachable=near, variables=self.store.table("variables"))

    def _reachable_chunks(self, text: str) -> DataFrame:
        """id of the chunks that are reached when the nodes that text names count as roots besides; none where it names none."""
        return graph.reachable_chunks(self.store.table("chunks"), self.store.table("nodes"), self.edges(), search.asked_lists(self.spark, [text])).select("id")

    def _find_definition(self, text: str) -> DataFrame:
        return graph.definitions(self.store.table("chunks"), self.store.table("nodes"), text)

    def _find_references(self, text: str) -> DataFrame:
        return graph.references(self.store.table("nodes"), self.edges(), self.imports(), text)

    def _get_callers(self, text: str) -> DataFrame:
        return graph.callers(self.edges(), text)

    def _get_callees(self, text: str) -> DataFrame:
        return graph.callees(self.edges(), text)

    def _impact_analysis(self, text: str, depth: int = 3) -> DataFrame:
        depth = bounded(depth, IMPACT_DEPTH)
        return graph.package_impact(self.imports(), text, depth) if "/" in text else graph.impact(self.edges(), text, depth, "full")

    def _get_context_pack(self, text: str, max_tokens: int = 0) -> DataFrame:
        """The chunk text, its eligible neighbours in the file, and its callers and callees, within max_tokens bytes."""
        rows = self.store.table("chunks")
        around = C.neighbours(rows).where(F.col("id") == text)
        near = around.select(F.explode(F.array("previous", "next")).alias("id")).where("id is not null")
        primary = rows.where(F.col("id") == text).select(F.lit(text).alias("pack"), F.lit(0).alias("prio"), C.chunk_text("primary").alias("text"))
        nearby = rows.join(near, "id").where(C.eligible(self.pruning)).groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", C.chunk_text("nearby").alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
        symbol = rows.where(F.col("id") == text).select("file_path", "start_line").join(self.store.table("nodes"), (F.col("file") == F.col("file_path")) & (F.col("line") == F.col("start_line"))).select("id")
        e = self.edges()
        lines = e.join(symbol.withColumnRenamed("id", "src"), "src").select(F.concat(F.lit("callee: "), "dst").alias("l")).unionByName(e.join(symbol.withColumnRenamed("id", "dst"), "dst").select(F.concat(F.lit("caller: "), "src").alias("l")))
        related = lines.distinct().orderBy("l").limit(12).groupBy().agg(F.array_join(F.sort_array(F.collect_list("l")), "\n").alias("text")).where("text <> ''").select(F.concat(F.lit("## related\n"), "text").alias("text"))
        sections = primary.unionByName(nearby.select(F.lit(text).alias("pack"), F.lit(2).alias("prio"), "text")).unionByName(related.select(F.lit(text).alias("pack"), F.lit(4).alias("prio"), "text"))
        return C.context_pack(sections.where("text <> ''"), max_tokens)

    def _read_snippet(self, text: str) -> DataFrame:
        return C.snippet(self.store.table("chunks"), text)

    def _type_flow(self, text: str) -> DataFrame:
        usage = self.store.table("usage")
        forward = flow.type_forward(usage, text).select(F.lit("forward").alias("direction"), "role", "user")
        return forward.unionByName(flow.type_backward(usage, text).select(F.lit("backward").alias("direction"), F.lit("field").alias("role"), F.coalesce("grandparent", "parent").alias("user")))

    def _variable_search(self, text: str, top_k: int = 10) -> DataFrame:
        rows = self.store.table("variables").select("name", "type", "file", "def_line").distinct()
        return flow.variable_search(rows, text, bounded(top_k, VARIABLES))

    def _trace_variable(self, text: str, location: str = "", depth: int = 5) -> DataFrame:
        """step, name, depth: variables that text flows to, from arguments to the variables of the functions they occur in; location: part of a file's name, and :line."""
        file, _, line = location.partition(":")
        vars_ = self.store.table("variables")
        start = vars_.where((F.col("name") == text) & F.contains("file", F.lit(file)) & (F.lit(not line.isdigit()) | (F.col("def_line") == int(line if line.isdigit() else 0))))
        args = self.store.table("uses").where("kind = 2").select(F.col("name").alias("src"), "func_id").distinct()
        links = args.join(vars_.select(F.col("name").alias("dst"), "func_id").distinct(), "func_id").where("src <> dst").select("src", "dst").distinct()
        return flow.trace(links, text, bounded(depth, TRACE_DEPTH)).join(start.select(F.lit(1).alias("hit")).limit(1), F.lit(True), "left_semi")

    def _function_dataflow(self, text: str) -> DataFrame:
        vars_, uses = self.store.table("variables"), self.store.table("uses")
        used = uses.where(F.col("func_id") == text).join(vars_.where("scope = 2").select("def_id", "scope"), "def_id").select("name", "scope", "func_id")
        return flow.function_flow(vars_.select("name", "scope", "func_id").unionByName(used), uses, text)

    def _variable_lookup(self, text: str, by: str = "name") -> DataFrame:
        """Variables whose name, type, func or file equals text."""
        rows = self.store.table("variables").withColumnRenamed("func_id", "func")
        if by not in ("name", "type", "func", "file"):
            raise ValueError(f"unknown lookup {by!r}")
        return rows.where(F.col(by) == text)

    def _trace_runtime(self, text: str) -> DataFrame:
        """Recorded events of the function (with a dot) or variable text, from the stored table trace_events; none where nothing was recorded."""
        events = self.store.table("trace_events")
        if events is None:
            events = self.spark.createDataFrame([], "seq long, func_id string, event_type string, var_name string, value string")
        return maintenance.trace_runtime(events, text)

    def _reindex(self, text: str, full: bool = True) -> DataFrame:
        """Index the tree text anew (or what changed there); one row of counts."""
        counts = self.sync(text, full=full)
        return self.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))

    def _rag_status(self, text: str = "") -> DataFrame:
        empty = self.spark.createDataFrame([], "id string")
        tables = {"chunks": "chunks", "graph_nodes": "nodes", "graph_edges": "edges", "files": "files", "variables": "variables", "uses": "uses"}
        counts = maintenance.status({k: empty if (t := self.store.table(v)) is None else t for k, v in tables.items()})
        meta = self.store.table("meta")
        if meta is None:
            meta = self.spark.createDataFrame([("", 0, 0, None)], META)
        return counts.crossJoin(meta.select(T.index_summary(F.col("mode"), F.col("indexed"), F.col("deleted"), F.col("updated_at")).alias("last_index")))  # one row each


KINDS = {name[1:] for name in vars(Engine) if name.startswith("_") and not name.startswith("__")}
