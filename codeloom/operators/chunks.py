"""Chunk operators: reachability labels, semantic folding, hard pruning, context packs and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T

REACHABLE, UNREACHABLE, BOILERPLATE, GENERATED, CONTEXT = 1.0, 0.55, 0.65, 0.40, 0.75
MARKER = "\n...[truncated]"


def pruning_mode(text: str) -> str:
    """soft (also for ''), off or hard; anything else is an error."""
    mode = (text or "").strip().lower() or "soft"
    if mode not in ("soft", "off", "hard"):
        raise ValueError(f"invalid pruning mode {text!r}")
    return mode


def is_function() -> Column:
    return F.col("chunk_type") == "4"


def is_entrypoint() -> Column:
    """HTTP handlers and commands, by name, signature, path or content."""
    name, signature, content = F.lower("symbol_name"), F.lower("signature"), F.lower("content")
    has = lambda c, *parts: F.lit(False) if not parts else has(c, *parts[:-1]) | F.contains(c, F.lit(parts[-1]))
    handler = (F.col("symbol_name") == "ServeHTTP") | F.contains(signature, F.lit("http.responsewriter")) & F.contains(signature, F.lit("*http.request")) | name.rlike("^handle|handler$") | has(content, "http.handlefunc(", ".handlefunc(")
    command = name.rlike("^(execute|prerun|postrun|persistentprerun|persistentpostrun)$|^run|command$|^newcommand|^new.*cmd$") | F.col("file_path").rlike("(^|/)cmd/") | has(content, "cobra.command", "cli.command", "urfave/cli", "run:", "rune:", "action:")
    return is_function() & (handler | command)


def _body(content: Column) -> Column:
    """Trimmed text between the first { and the last }; empty without them."""
    return F.when(content.rlike(r"(?s)\{.*\}"), T.trimmed(F.regexp_extract(content, r"(?s)^[^{]*\{(.*)\}", 1))).otherwise("")


def _statements(body: Column) -> Column:
    return F.filter(F.transform(F.flatten(F.transform(T.meaningful(body), lambda x: F.split(x, ";"))), T.trimmed), lambda x: x != "")


def is_generated(content: Column, lines: int = 0) -> Column:
    """Marked as generated: both phrases occur; or, for source files, in one of the first lines."""
    if lines:
        return F.exists(F.slice(F.split(F.lower(content), "\n"), 1, lines), lambda x: F.contains(x, F.lit("code generated")) & F.contains(x, F.lit("do not edit")))
    return F.contains(F.lower(content), F.lit("code generated")) & F.contains(F.lower(content), F.lit("do not edit"))


def is_error_block(symbol: Column, content: Column) -> Column:
    low = F.lower(content)
    declares = F.startswith(content, F.lit("const ")) | F.startswith(content, F.lit("var "))
    named = F.contains(low, F.lit("errors.new(")) | F.contains(low, F.lit("fmt.errorf(")) | F.contains(content, F.lit("Err")) | F.contains(low, F.lit("error"))
    return F.startswith(symbol, F.lit("Err")) & F.contains(content, F.lit("=")) | declares & named


def field_lines(content: Column) -> Column:
    return F.filter(T.meaningful(content), lambda x: ~x.isin("{", "}") & ~F.startswith(x, F.lit("type ")) & ~F.startswith(x, F.lit("struct")))


def is_large_dto(kind: Column, symbol: Column, content: Column) -> Column:
    fields = field_lines(content)
    tagged = F.size(F.filter(fields, lambda x: F.contains(x, F.lit("`json:")) | F.contains(x, F.lit("`db:")) | F.contains(x, F.lit("`yaml:"))))
    return (kind == "5") & (F.size(fields) >= 8) & ((tagged >= F.floor(F.size(fields) / 2)) | F.lower(symbol).rlike("(dto|request|response|payload|model)$"))


def fold_reason() -> Column:
    """The first rule that fits a chunk (columns symbol_name, chunk_type, content, signature, file_path), or an empty string."""
    content, symbol, kind = T.trimmed(F.coalesce("content", F.lit(""))), F.coalesce("symbol_name", F.lit("")), F.col("chunk_type")
    body = _body(content)
    lines = _statements(body)
    one, stmt = F.size(lines) == 1, F.element_at(lines, 1)
    returned = F.when(F.startswith(stmt, F.lit("return ")), T.trimmed(F.substring(stmt, 8, 1 << 30)))
    field = lambda e: F.contains(e, F.lit(".")) & ~e.rlike(r"[(\[]")
    assigned = F.when(F.contains(stmt, F.lit("=")) & ~F.contains(stmt, F.lit(":=")), T.trimmed(F.substring_index(stmt, "=", 1)))
    made = T.trimmed(F.regexp_replace(returned, "^&", ""))
    call = F.coalesce(returned, stmt)
    single = ~call.rlike(r"[{}]") & call.rlike(r"(?s)^[^(]*[^(\s][^(]*\(.*\)$") & ~F.substring_index(call, "(", 1).rlike(r"[-+*/%<>=!&|]")
    falsy = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(content == "", "")
        .when(is_generated(content), "generated_code")
        .when(is_error_block(symbol, content), "error_const_block")
        .when(falsy(is_large_dto(kind, symbol, content)), "large_dto")
        .when(kind.isin("3", "5", "6", "8", "9") & (F.size(T.meaningful(content)) <= 3), "trivial_declaration")
        .when(~is_function(), "")
        .when(symbol.rlike("^(Get|Set|Is|Has)") & falsy(one & F.when(returned.isNotNull(), field(returned)).otherwise(field(assigned))), "getter_setter")
        .when(symbol.rlike("^(New|MustNew)") & falsy(one & F.contains(made, F.lit("{")) & F.endswith(made, F.lit("}"))), "trivial_constructor")
        .when(~is_entrypoint() & (body != "") & (F.size(T.meaningful(body)) <= 3) & falsy(one & single), "simple_wrapper")
        .otherwise("")
    )


def fold(chunks: DataFrame) -> DataFrame:
    """Sets fold_reason, semantic_role and context_weight (the lesser of the given weight and the rule's), from scratch."""
    reason = F.col("fold_reason")
    rows = chunks.withColumn("fold_reason", fold_reason())
    weight = F.when(reason == "generated_code", GENERATED).otherwise(BOILERPLATE)
    base = F.when(F.coalesce("context_weight", F.lit(0.0)) <= 0, REACHABLE).otherwise(F.col("context_weight"))
    return rows.withColumn("semantic_role", F.when(reason != "", "boilerplate").otherwise("")).withColumn("context_weight", F.when(reason != "", F.least(base, weight)).otherwise(base))


def label(chunks: DataFrame, nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Sets reachability and context_weight: exported types and reached or entry-point functions are reachable, other functions with a node are not, the rest is unknown."""
    at = nodes.join(reached.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").groupBy(F.col("file").alias("file_path"), F.col("line").alias("start_line")).agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
    rows = chunks.drop("reachability", "context_weight").join(at, ["file_path", "start_line"], "left")
    types = F.col("chunk_type").isin("3", "5", "6", "8", "9")
    state = F.when(types & T.exported(F.col("symbol_name")), "reachable").when(is_function() & (F.coalesce("hit", F.lit(False)) | is_entrypoint()), "reachable").when(is_function() & F.col("hit").isNotNull(), "unreachable").otherwise("unknown")
    rows = rows.withColumn("reachability", state)
    return rows.withColumn("context_weight", F.when(F.col("reachability") == "unreachable", UNREACHABLE).otherwise(REACHABLE)).drop("hit")


def hard_prune(chunks: DataFrame) -> DataFrame:
    """Without chunks that are unreachable or boilerplate."""
    return chunks.where(~((F.coalesce("reachability", F.lit("")) == "unreachable") | (F.coalesce("semantic_role", F.lit("")) == "boilerplate")))


def eligible(pruning: str = "soft") -> Column:
    """Whether a chunk may join a context pack by itself."""
    weight = F.when(F.coalesce("context_weight", F.lit(0.0)) <= 0, 1.0).otherwise(F.col("context_weight"))
    return F.lit(True) if pruning == "off" else (F.coalesce("reachability", F.lit("")) != "unreachable") & (weight >= CONTEXT)


def neighbours(chunks: DataFrame) -> DataFrame:
    """id, previous, next: the chunks before and after each in its file."""
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    return chunks.select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


def chunk_text(name: str) -> Column:
    symbol = F.when(F.coalesce("symbol_name", F.lit("")) != "", F.concat(F.lit("\nSymbol: "), "symbol_name")).otherwise("")
    return F.concat(F.lit(f"## {name}\n"), F.format_string("Chunk: %s (%s, lines %d-%d)", F.col("id").cast("string"), "file_path", "start_line", "end_line"), symbol, F.lit("\nContent:\n"), F.col("content"))


def context_pack(sections: DataFrame, budget: int) -> DataFrame:
    """Joins sections (pack, prio, text) by priority while they fit into budget bytes (0: no bound): pack, context, n_sections.

    Sections are parted by an empty line; the first that does not fit ends the pack, the primary one (prio 0) is cut
    with a mark instead.
    """
    w = Window.partitionBy("pack").orderBy("prio")
    size = F.octet_length("text") + F.when(F.col("prio") > 0, 2).otherwise(0)
    rows = sections.where("text <> ''").withColumn("used", F.sum(size).over(w))
    rows = rows.withColumn("over", F.max(F.when((F.col("used") > budget) & F.lit(budget > 0), 1).otherwise(0)).over(w))
    cut = F.when(F.lit(budget <= len(MARKER)), F.substring("text", 1, max(budget, 0))).otherwise(F.concat(F.substring("text", 1, max(budget - len(MARKER), 0)), F.lit(MARKER)))
    rows = rows.withColumn("text", F.when((F.col("prio") == 0) & (F.col("over") == 1), cut).otherwise(F.col("text"))).where("over = 0 or prio = 0")
    listed = rows.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("prio", "text"))).alias("l"))  # a handful of sections
    return listed.select("pack", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("context"), F.size("l").cast("long").alias("n_sections"))


def snippet(chunks: DataFrame, location: str) -> DataFrame:
    """line and text of the stored lines in location (file:a or file:a-b), each from its first chunk by start, end and id."""
    file, _, span = location.rpartition(":")
    first, _, last = span.partition("-")
    a, b = int(first), int(last or first)
    rows = chunks.where((F.col("file_path") == file) & (F.col("end_line") >= a) & (F.col("start_line") <= b))
    lines = rows.select("start_line", "end_line", "id", F.posexplode(F.split("content", "\n")).alias("pos", "text")).withColumn("line", F.col("start_line") + F.col("pos")).where(F.col("line").between(a, b))
    w = Window.partitionBy("line").orderBy("start_line", "end_line", "id")
    return lines.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("line").cast("long").alias("line"), "text")


def by_file(chunks: DataFrame, path: str) -> DataFrame:
    """The chunks of a file in their order."""
    return chunks.where(F.col("file_path") == path).orderBy("start_line", "end_line", "id")
