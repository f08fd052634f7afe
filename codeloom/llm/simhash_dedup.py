"""SimHash near-duplicates (method: pigeonring filtering).

A fingerprint's 64 bits are three segments in a ring. If two fingerprints differ in at most t bits, some chain of
consecutive segments starts where the first k segments differ, for every k, in at most k * t / 3 bits. With t = 2 the
chain's first segment must be equal, its first two differ in at most one bit, all three in at most two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import BLANKS, components, hold, mapped, read, texts, written

#: Fixed by the contract: bits that may differ, words of a shingle, hash seed.
DISTANCE, SHINGLE, SEED = 2, 3, 42
#: (shift, bits) of the ring's segments.
SEGMENTS = ((43, 21), (22, 21), (0, 22))
#: Fingerprints of one segment value that are compared with each other directly; larger groups are split exactly, see links().
GROUP = 2000
ASCII_LOWER = {c: chr(c + 32) for c in range(65, 91)} | BLANKS


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = [w.encode() for w in text.translate(ASCII_LOWER).split(" ") if w] if not text.isascii() else [w for w in text.encode().lower().translate(_BLANK).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest, seed = xxhash.xxh64_intdigest, SEED
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype="i4")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


_BLANK = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed BIGINT), of whole texts."""

    def rows(batch):
        values = np.array([fingerprint(t) for t in texts(batch)], "u8")
        yield {"doc_id": batch.column(0), "fp": values.view("i8")}

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), rows, "doc_id long, fp long")


def _turned(fp: Column, start: int) -> list[Column]:
    """The segments from start on, along the ring."""
    return [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in SEGMENTS[start:] + SEGMENTS[:start]]


def _within(sorted_groups: DataFrame) -> DataFrame:
    """From rows (start, key, fp) sorted by start and key: rows (a, b) that connect what is linked within each key, at most one a fingerprint.

    Rows of one key lie in one partition; each is compared with those before it in blocks, first by the chain's budgets
    and then in full. Links become a spanning forest in the task, so its output never grows with the square of a group.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forest(start: int, fps: np.ndarray) -> list[tuple[int, int]]:
        order = SEGMENTS[start:] + SEGMENTS[:start]
        root = np.arange(len(fps))
        values = fps.view("u8")
        second = values >> np.uint64(order[1][0]) & np.uint64((1 << order[1][1]) - 1)
        for lo in range(0, len(fps), 256):
            part = slice(lo, min(lo + 256, len(fps)))
            chain = np.bitwise_count(second[part, None] ^ second[None, : part.stop]) <= 1  # the first segment is the key
            i, j = np.nonzero(chain)
            i += lo
            near = (j < i) & (np.bitwise_count(values[i] ^ values[j]) <= DISTANCE)
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                while root[y] != y:
                    root[y] = root[root[y]]
                    y = root[y]
                root[max(x, y)] = min(x, y)
        out = []
        for x in range(len(fps)):
            y = x
            while root[y] != y:
                y = root[y]
            if y != x:
                out.append((int(fps[x]), int(fps[y])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> list[tuple[int, int]]:
            return forest(key[0], np.concatenate(held)) if key and sum(map(len, held)) > 1 else []

        for batch in batches:
            start, value, fps = (c.to_numpy() for c in batch.columns)
            out = []
            cuts = [0, *(np.nonzero((np.diff(start) != 0) | (np.diff(value) != 0))[0] + 1).tolist(), len(fps)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (start[a], value[a]) != key:
                    out += done()
                    key, held = (start[a], value[a]), []
                held.append(fps[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=schema)
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=schema)

    return sorted_groups.mapInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp): edges (a, b) that connect what lies within DISTANCE bits.

    For each start on the ring, fingerprints are grouped by the chain's first segment. Groups of up to GROUP are compared
    in one task. In larger ones every fingerprint is also filed under each value that is one bit away from it or none
    within that group: two that differ in at most two bits share such a value, and at most 65 fingerprints share one, so
    joining each to the least under its value is exact and bounded.
    """
    hold(fps.sparkSession)
    starts = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), _turned(F.col("fp"), k)[0].alias("key")) for k in range(3))))
    keyed = fps.select("fp", starts.alias("s")).select("s.start", "s.key", "fp")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    grouped = keyed.join(sizes, ["start", "key"])
    small = grouped.where(F.col("n") <= GROUP).select("start", "key", "fp")
    few = _within(small.repartition("start", "key").sortWithinPartitions("start", "key"))
    large = grouped.where(F.col("n") > GROUP).select("fp").distinct()
    near = F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
    filed = large.select("fp", near.alias("value"))
    least = filed.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    many = filed.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return few.unionByName(many)


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id reachable over links, its own included).

    Documents of equal fingerprint are linked like any others; they become one class before candidates are sought. A null
    or empty text, or one of white space only, has the fingerprint zero. Rows with a null doc_id get a fingerprint and
    the component of their class, or null if all ids in it are null. Repeated rows each give a row; other columns are ignored; no
    rows give no rows.
    """
    prints = written(fingerprints(docs), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(classes.select("fp")))
    named = found.select(F.col("node").alias("fp"), "component").join(classes, "fp")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    of_class = named.join(least, "component").select("fp", "least")
    mapping = written(classes.join(of_class, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes")
    return prints.join(mapping, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "documents"))
