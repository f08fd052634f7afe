"""Packing (method: concatenate and cut, with global offsets from two passes of prefix sums)."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.bpe import trie, vocabulary
from codeloom.llm.common import hold, read, texts, written

#: Fixed by the contract: tokens of a sequence, and the id after each document.
WINDOW, DOCUMENT_END = 4096, 2


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = DOCUMENT_END) -> DataFrame:
    """Pass 1: part, start (tokens before the row within its part), doc_id, n, ids (end_id included); written, so that parts and offsets stay fixed.

    ids are unsigned integers of 16 bits where the vocabulary allows it, else of 32 bits.
    """
    path = vocabulary(path)
    hold(docs.sparkSession)
    schema = pa.schema([("part", pa.int64()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = trie(path, by_model=True), TaskContext.get().partitionId(), 0
        kind = "<u2" if max(encoder.names) < 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").astype(kind).tobytes()
        for batch in batches:
            ids = [np.frombuffer(i, "<u4").astype(kind).tobytes() + end for i, _ in encoder.encode_batch(texts(batch))]
            n = np.array([len(i) // int(kind[2]) for i in ids], "i8")
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part)), pa.array(start), batch.column(0), pa.array(n), pa.array(ids, pa.binary())], schema=schema)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "part long, start long, doc_id long, n long, ids binary")
    return written(rows, "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Pass 2: each row's global offset, from prefix sums over the totals of the parts.

    There is one total (16 bytes) a part, so the broadcast is bounded by the number of input partitions, not by rows or
    keys; with over a million parts the join is left to Catalyst.
    """
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    parts = tokens.sparkSession.sparkContext.defaultParallelism if not tokens.inputFiles() else len(tokens.inputFiles())
    return tokens.join(F.broadcast(before) if parts < 1_000_000 else before, "part").select((F.col("before") + F.col("start")).alias("at"), "doc_id", "n", "ids")


def pieces(tokens: DataFrame, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Cut at every multiple of window tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, BINARY of 32-bit integers)."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, doc, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                cuts = [0, *range(window - at % window, n, window), n]
                out += [(doc, a, b - a, crc32(wide[4 * a : 4 * b]), n, (at + a) // window, (at + a) % window) + ((wide[4 * a : 4 * b],) if keep_ids else ()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return placed(tokens).mapInArrow(run, ddl)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = DOCUMENT_END) -> DataFrame:
    """Where each document's ids lie in the packed sequences; each id is in exactly one piece and only the last sequence may be short.

    A null text counts as empty: its piece is the document end alone. Repeated rows are packed as often as they occur; a
    null doc_id stays null; other columns are ignored, whatever their names. No rows: no pieces. A very long text spans
    many sequences. Which document comes first follows the order of the input's partitions.
    """
    return pieces(tokenized(docs, path, end_id), window)


def sequences(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = DOCUMENT_END, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, input_ids (padded to window), n_tokens.

    Within a sequence the pieces are at most window rows, whatever the input; those that cross a boundary are cut there.
    """
    cut = pieces(tokenized(docs, path, end_id), window, keep_ids=True)
    joined = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"), F.sum("length").alias("n_tokens"))
    schema = pa.schema([("sequence_id", pa.int64()), ("input_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.frombuffer(b"".join(p["ids"] for p in r["all"]), "<u4").astype("i8") for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.pad(i, (0, window - len(i)), constant_values=pad_id) for i in ids], pa.list_(pa.int64())), batch.column(2)], schema=schema)

    return joined.mapInArrow(run, "sequence_id long, input_ids array<long>, n_tokens long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
