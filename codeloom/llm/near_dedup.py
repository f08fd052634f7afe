"""Near-duplicates by the Jaccard similarity of five-word shingles (method: SimHash with pigeonring filtering, prefix filtering for the rest, exact checks).

SimHash fingerprints of the shingles that differ in a few bits (op7's filter) give the first pairs, which join near
copies. That cannot be all: at similarity 0.8 about 15 % of a fingerprint's bits differ, with a spread that no fixed
distance covers. So the pairs that it leaves apart are sought by prefix filtering: two sets of similarity 0.8 or more share
an element among the first n - ceil(0.8 n) + 1 of each, in any order of elements that holds for all sets. The order puts
common shingles last, which keeps groups small; a poor order costs time, not links. Every pair is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import simhash_dedup
from codeloom.llm.common import components, discard, hold, mapped, released, sifted, texts, written

#: Fixed by the contract: words of a shingle, and the least similarity as a fraction.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: For the order alone: one text in SAMPLE is read for common shingles, those in COMMON sampled texts or more, at most ORDERED of them.
SAMPLE, COMMON, ORDERED = 12, 3, 100_000
#: Rows that forest() compares at once; its rounds at most, and the pairs below which there is no further one (all pairs are checked after it).
BLOCK, ROUNDS, FEW = 512, 6, 1000
#: Rows of a group that is compared whole at once with others; pairs that every() compares at once, whatever the group.
SMALL, PAIRS = 8, 1 << 18
_PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """written() as zstd; then the shuffles that led to it go, some as large as the texts."""
    found = written(df, name, "zstd")
    released(df.sparkSession)
    return found


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


_HASH = _Words()


def shingles(text: str) -> np.ndarray:
    """The distinct shingles' hashes in rising order; one for all words of a text that has fewer than SHINGLE; none for no words."""
    words = [w for w in text.encode().translate(_PLAIN).split(b" ") if w]
    if not words:
        return np.zeros(0, "u8")
    ids = np.fromiter(map(_HASH.__getitem__, words), "u8", len(words))
    k = min(SHINGLE, len(ids))
    h = np.full(len(ids) - k + 1, k, "u8")
    for i in range(k):
        h = (h ^ ids[i : len(ids) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return np.unique(h)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def sketch(h: np.ndarray) -> bytes:
    """512 bits: whether an odd number of elements falls on each."""
    return np.packbits((np.bincount((h >> np.uint64(55)).astype("i8"), minlength=512) & 1).astype("u1")).tobytes()


def fingerprint(h: np.ndarray) -> int:
    """SimHash: 64 bits, each 1 if set in over half of the elements; zero for none."""
    ones = np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i4")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u8").reshape(-1, 8)


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """False where sketches x and y show that sets of n elements together are not similar: bits that differ are at most the elements that only one set has."""
    return (DENOMINATOR + NUMERATOR) * np.bitwise_count(x ^ y).sum(-1, dtype="i8") <= (DENOMINATOR - NUMERATOR) * n


def _sized(n: str, m: str) -> str:
    """That two sets' sizes allow the similarity."""
    return f"{DENOMINATOR} * least({n}, {m}) >= {NUMERATOR} * greatest({n}, {m})"


def prefix(h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first elements of a set: uncommon ones by hash, then common ones from rare to frequent. common is sorted, with a rank each."""
    n = len(h)
    most = n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0
    if not len(common):
        return h[:most]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    late = common[at] == h
    first = h[~late]
    if len(first) >= most:
        return first[:most]
    rest = at[late]
    return np.concatenate([first, common[rest[np.argsort(rank[rest])]][: most - len(first)]])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in rising order and their ranks, from rare to frequent."""

    def rows(batch):
        yield {"h": np.concatenate([np.zeros(0, "u8"), *map(shingles, texts(batch))]).view("i8")}

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    found = mapped(some, rows, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    top = found.orderBy(F.desc("n"), "h").limit(ORDERED).collect()  # ORDERED rows at most
    value = np.array([r["h"] for r in top], "i8").view("u8")
    order = np.argsort(value)
    return value[order], -order


def keyed(docs: DataFrame) -> DataFrame:
    """docs with near_row (unique), near_set (hash of the whole set), near_n (its size), near_prefix, near_sketch and near_print (SimHash), written."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

    common, rank = common_shingles(docs)
    released(docs.sparkSession)
    hold(docs.sparkSession)
    with_row = docs.withColumn("near_row", F.monotonically_increasing_id())
    schema = StructType(list(with_row.schema.fields)).add("near_set", LongType()).add("near_n", LongType()).add("near_prefix", ArrayType(LongType())).add("near_sketch", BinaryType()).add("near_print", LongType())
    arrow, at = to_arrow_schema(schema), with_row.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "") for t in batch.column(at).to_pylist()]
            whole = np.array([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets], "u8").view("i8")
            own = [prefix(h, common, rank).view("i8") for h in sets]
            ends = np.cumsum([0, *map(len, own)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "i8"), *own])))
            new = [pa.array(whole), pa.array(np.fromiter(map(len, sets), "i8", len(sets))), lists, pa.array([sketch(h) for h in sets], pa.binary()), pa.array(np.array([fingerprint(h) for h in sets], "u8").view("i8"))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *new], arrow, strict=True)], names=arrow.names)

    return written(with_row.mapInArrow(run, schema), "keyed", "zstd")


def shared(sets: DataFrame) -> DataFrame:
    """From distinct sets (id, n, prefix): rows (h, id, n, least, m) for each prefix element of two sets or more; least, of size m, is the first set that has it."""
    names = ["h", "id", "n", "least", "m"]
    spread = sets.select(F.explode("prefix").alias("h"), "id", "n").repartition("h").sortWithinPartitions("h", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, "i8")] * 3  # a last row that is alone so far
        now = None  # the last group's h, least and m, if it goes on
        for batch in batches:
            h, i, n = (np.concatenate([a, b.to_numpy()]) for a, b in zip(held, batch.columns, strict=True))
            if not len(h):
                continue
            new = np.concatenate(([now is None or h[0] != now[0]], h[1:] != h[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            least = np.where(start < 0, now[1] if now else 0, i[start])
            m = np.where(start < 0, now[2] if now else 0, n[start])
            several = ~new | np.append(~new[1:], False)
            now = None if new[-1] else (h[-1], least[-1], m[-1])
            held = [h[-1:], i[-1:], n[-1:]] if new[-1] else [np.zeros(0, "i8")] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in (h, i, n, least, m)], names=names)

    return spread.mapInArrow(run, "h long, id long, n long, least long, m long")


def _allowed(x: np.ndarray, y: np.ndarray, n: np.ndarray, c: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches of rows x and y of a group allow a link between different components."""
    lo, hi = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    fits = np.nonzero((c[x] != c[y]) & (DENOMINATOR * lo >= NUMERATOR * hi))[0]
    out = np.zeros(len(x), bool)
    for k in range(0, len(fits), 100_000):
        at = fits[k : k + 100_000]
        out[at] = possible(bits[x[at]], bits[y[at]], lo[at] + hi[at])
    return out


def forest(n: np.ndarray, i: np.ndarray, c: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a group of one prefix element: pairs of rows that would join its components, the nearest sketches first (Prim's steps).

    Rows are taken BLOCK at a time, in order of size, with some of the block before; so there are a few pairs a row at
    most, and the work grows with the group's size, not its square.
    """
    for lo in range(0, len(i), BLOCK):
        at = np.arange(max(0, lo - 32), min(lo + BLOCK, len(i)))
        x, y = np.triu_indices(len(at), 1)
        ok = _allowed(at[x], at[y], n, c, bits)
        if not ok.any():
            continue
        x, y = x[ok], y[ok]
        own = c[at]
        weight = np.where(own[:, None] == own, np.float32(-1), np.float32(np.inf))
        for k in range(0, len(x), 100_000):
            v, w = x[k : k + 100_000], y[k : k + 100_000]
            weight[v, w] = weight[w, v] = np.bitwise_count(bits[at[v]] ^ bits[at[w]]).sum(-1, dtype="i4") / (n[at[v]] + n[at[w]])
        left, best, by = np.ones(len(at), bool), np.full(len(at), np.inf), np.full(len(at), -1)
        pairs = []
        for _ in at:
            k = int(np.argmin(np.where(left, best, np.inf))) if np.isfinite(best[left]).any() else int(np.argmax(left))
            if 0 <= best[k] < np.inf:
                pairs.append((at[k], at[by[k]]))
            left[k] = False
            closer = left & (weight[k] < best)
            best[closer], by[closer] = weight[k][closer], k
        if pairs:
            yield tuple(np.array(pairs).T)


def every(n: np.ndarray, i: np.ndarray, c: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a group of one prefix element: all pairs of rows whose components differ and whose sizes and sketches allow a link.

    Each such pair has a row outside the group's largest component, so only those are compared with all others, about
    PAIRS at once.
    """
    kinds, where, size = np.unique(c, return_inverse=True, return_counts=True)
    largest = where == size.argmax()
    outside = np.nonzero(~largest)[0]
    for lo in range(0, len(i), PAIRS):
        others = np.arange(lo, min(lo + PAIRS, len(i)))
        step = max(1, PAIRS // len(others))
        for at in range(0, len(outside), step):
            part = outside[at : at + step]
            x, y = np.repeat(part, len(others)), np.tile(others, len(part))
            once = (x < y) | largest[y]
            x, y = x[once], y[once]
            near = _allowed(x, y, n, c, bits)
            yield x[near], y[near]


def neighbouring(h: np.ndarray, n: np.ndarray, c: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows in order of h: all pairs of one h that sizes and sketches allow, of rows less than SMALL apart. Of groups of SMALL rows at most those are all."""
    for d in range(1, SMALL):
        x = np.nonzero(h[d:] == h[:-d])[0]
        if not len(x):
            break
        near = x[_allowed(x, x + d, n, c, bits)]
        yield near, near + d


def paired(rows: DataFrame, each) -> DataFrame:
    """From rows (h, n, id, component, sketch): the distinct pairs (a, b) of ids that each() chooses in the groups of one h, rows rising by n.

    Groups of SMALL rows at most are compared whole, many at a time.
    """

    def named(i, x, y) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i[x], i[y])), pa.array(np.maximum(i[x], i[y]))], names=["a", "b"])

    def pairs(h, n, i, c, bits) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.nonzero(np.diff(h))[0] + 1, [len(h)]))
        size = np.diff(cuts)
        few = np.repeat(size <= SMALL, size)
        for x, y in neighbouring(h[few], n[few], c[few], bits[few]):
            yield named(i[few], x, y)
        for g in np.nonzero(size > SMALL)[0].tolist():
            one = slice(cuts[g], cuts[g + 1])
            for x, y in each(n[one], i[one], c[one], bits[one]):
                yield named(i[one], x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of the last group so far, which may go on
        for batch in batches:
            part = [*(c.to_numpy() for c in batch.columns[:-1]), _sketches(batch.columns[-1])]
            if not len(part[0]):
                continue
            last = int(np.searchsorted(part[0], part[0][-1]))  # where the batch's last group starts
            if last or held and held[0][0][0] != part[0][0]:
                yield from pairs(*(np.concatenate(x) for x in zip(*held, [c[:last] for c in part], strict=True)))
                held = []
            held.append([c[last:] for c in part])
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.select("h", "n", "id", "component", "sketch").repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(run, "a long, b long").distinct()


def checked(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose texts in bodies (id, text; ids may repeat) are similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = _kept(sifted(bodies, "id", ids)[0].join(ids, "id", "left_semi").dropDuplicates(["id"]), "bodies")
    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def rows(batch):
        seen: dict[int, np.ndarray] = {}

        def of(i: int, t: str) -> np.ndarray:
            if i not in seen:
                seen[i] = shingles(t)
            return seen[i]

        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        kept = [(i, j) for i, j, x, y in zip(a, b, texts(batch, "x"), texts(batch, "y"), strict=True) if similar(of(i, x), of(j, y))]
        yield {"a": [i for i, _ in kept], "b": [j for _, j in kept]}

    found = _kept(mapped(joined.select("a", "b", "x", "y"), rows, "a long, b long"), "links")
    discard(own)
    return found


def printed(sets: DataFrame) -> DataFrame:
    """From distinct sets (id, n, sketch, fp): pairs (a, b) that connect sets of equal or near fingerprints, where sizes and sketches allow a link.

    Sets of one fingerprint pair with the least of them, and the least ones along the fingerprints' links, which
    pigeonring filtering finds (see simhash_dedup.links()).
    """
    # least by size, so that sizes mostly allow the pairs
    first = _kept(sets.groupBy("fp").agg(F.min(F.struct("n", "id", "sketch")).alias("first")), "prints")
    end = lambda c, to: first.select(F.col("fp").alias(c), F.col("first").alias(to))
    near = simhash_dedup.links(first.select("fp")).join(end("a", "one"), "a").join(end("b", "two"), "b").select("one", "two")
    same = sets.join(first, "fp").select(F.col("first").alias("one"), F.struct("n", "id", "sketch").alias("two")).where("one.id <> two.id")
    pairs = near.unionByName(same).where(_sized("one.n", "two.n")).select(F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b"), (F.col("one.n") + F.col("two.n")).alias("n"), F.col("one.sketch").alias("x"), F.col("two.sketch").alias("y"))
    return mapped(pairs, _possible_rows, "a long, b long")


def _possible_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    a, b, n, x, y = batch.columns
    near = possible(_sketches(x), _sketches(y), n.to_numpy())
    yield {"a": a.to_numpy()[near], "b": b.to_numpy()[near]}


def starred(found: DataFrame, sketches: DataFrame) -> DataFrame:
    """From shared() rows: pairs (a, b) of each set and the first sets of its prefix elements, where sizes and sketches allow a link."""
    pairs = found.where("id <> least").where(_sized("n", "m")).select(F.col("least").alias("a"), F.col("id").alias("b"), (F.col("n") + F.col("m")).alias("n")).distinct()
    joined = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    return mapped(joined.select("a", "b", "n", "x", "y"), _possible_rows, "a long, b long")


def links(rows: DataFrame) -> DataFrame:
    """From keyed() rows: edges (a, b) of near_set that connect exactly what is linked by similarity.

    First sets of near fingerprints are checked, and each set with the first set of each of its prefix elements, which joins
    part of a large group. Then,
    as long as many pairs are left, each group's components are checked along a spanning forest of near sketches, which
    joins groups of near copies in a few rounds. Last, all pairs that share an element and are not yet connected are checked.
    """
    sets = rows.select(F.col("near_set").alias("id"), F.col("near_n").alias("n"), F.col("near_prefix").alias("prefix")).dropDuplicates(["id"])
    bodies = rows.select(F.col("near_set").alias("id"), "text")
    found = _kept(shared(sets), "shared")
    several = found.select("id").distinct()
    sketches = _kept(rows.select(F.col("near_set").alias("id"), F.col("near_sketch").alias("sketch")).dropDuplicates(["id"]).join(several, "id", "left_semi"), "sketches")
    prints = rows.select(F.col("near_set").alias("id"), F.col("near_n").alias("n"), F.col("near_sketch").alias("sketch"), F.col("near_print").alias("fp")).dropDuplicates(["id"])
    stars = starred(found, sketches).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = _kept(printed(prints).unionByName(stars).distinct(), "tried")
    linked = checked(tried, bodies)

    def apart() -> DataFrame:
        """Rows of groups that have several components, each with its own."""
        of = components(linked).select(F.col("node").alias("id"), "component")
        named = found.join(of, "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("component"))
        groups = named.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
        return named.join(groups, "h", "left_semi").join(sketches, "id")

    for _ in range(ROUNDS):
        some = _kept(paired(apart(), forest).join(tried, ["a", "b"], "left_anti"), "forest")
        if some.count() < FEW:
            break
        new = checked(some, bodies)
        tried, linked = tried.unionByName(some), linked.unionByName(new)
        if new.isEmpty():
            break
    rest = _kept(paired(apart(), every).join(tried, ["a", "b"], "left_anti"), "crossed")
    linked = linked.unionByName(checked(rest, bodies))
    discard(found)
    discard(sketches)
    return linked


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component of similar texts the row of the smallest doc_id (null ids last; of equal ids, one).

    Texts without words are one component.
    """
    rows = keyed(docs)
    of = components(links(rows)).select(F.col("node").alias("near_set"), "component")
    named = rows.select("near_row", F.col("doc_id").cast("long").alias("doc_id"), "near_set").join(of, "near_set", "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "near_row")
    best = named.groupBy(F.coalesce("component", "near_set").alias("group")).agg(F.min(order).alias("best")).select(F.col("best.near_row").alias("near_row"))
    gone = _kept(named.select("near_row").join(best, "near_row", "left_anti"), "gone")
    some, others = sifted(rows, "near_row", gone)
    return others.unionByName(some.join(gone, "near_row", "left_anti")).select(docs.columns)
