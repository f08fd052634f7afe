"""Toxicity (method: support vector machine on a subsequence string kernel, with Nyström landmarks).

The kernel of two words is the cosine of their gap-weighted three-letter subsequences: letters up to SPAN places apart,
each skipped place damped by DECAY, so words with inserted or left-out characters stay close; below LEAST it counts as
nothing. A word that is close but not equal is also read without each of its letters in turn, damped by INSERTED, and the
largest counts: an inserted letter costs no more than that. The kernel of a sentence and a landmark is the sum over the sentence's words of the word kernel, which counts
whole from FULL on, as a gap costs a word that much, and to the POWER-th of its share of FULL below. A linear machine over the
kernels with the landmarks is trained on sentences; as it is linear, its decision on a sentence is the sum of one value
a word, and a document's score comes from its strongest sentence.
"""

from __future__ import annotations

import re
from itertools import pairwise
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import mapped, read, texts, uncollected, words_of

SPAN, DECAY, POWER, LEAST, FULL, INSERTED = 5, 0.8, 4, 0.45, 0.85, 0.9
#: Bounds: labelled rows of each class to learn from, landmarks, words of one sentence at most, distinct words of the sample that may become landmarks.
SAMPLE, LANDMARKS, SENTENCE, CANDIDATES = 800, 64, 24, 3000
#: Weight of clean documents against toxic ones: most documents are clean, and those are to stay.
NEGATIVE = 3.0
CODES = 32
#: Letters after folding accents; digits and signs that stand for letters.
FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿß0134578@$!", "aaaaaaceeeeiiiinoooooouuuuyysoieastbasi")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][\W_]{1,3}){3,}[^\W_](?![^\W_])")
EDGES = ".,;:!?\"'()[]{}<>|*&%#-_~`"
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def counted(k):
    """A word kernel as it counts: whole from FULL on, below it to the POWER-th."""
    return np.minimum(k / FULL, 1) ** POWER


def letters(word: str) -> str:
    """A word as the kernel reads it: lower case, folded, letters only; words in other scripts keep their letters by code."""
    if word.isascii() and word.isalpha():
        return word.lower()
    plain = _OTHER.sub("", word.lower().strip(EDGES).translate(FOLD))
    return plain if plain.isascii() else "".join(c if "a" <= c <= "z" else chr(97 + ord(c) % 26) for c in plain)


_OTHER = re.compile(r"[\W\d_]+")


def windows(word: str, size: int = 24) -> list[str]:
    """A very long word in overlapping parts, so that all of it is read."""
    return [word] if len(word) <= size else [word[i : i + size] for i in range(0, len(word) - size // 2, size // 2)]


def codes(words: list[str]) -> np.ndarray:
    """Letters as 1 to 26 with a start sign 27, padded with 0."""
    longest = max(map(len, words)) + 1
    out = np.zeros((len(words), longest), "i4")
    out[:, 0] = 27
    flat = np.frombuffer("".join(words).encode("ascii"), "u1").astype("i4") - 96
    n = np.fromiter(map(len, words), "i8", len(words))
    rows = np.repeat(np.arange(len(words)), n)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1] = flat
    return out


def subsequences(c: np.ndarray):
    """For each pair of offsets: codes of the three-letter subsequences (0 where there is none) and their weight."""
    for a, b in OFFSETS:
        if c.shape[1] > b:
            x, y, z = c[:, :-b], c[:, a : c.shape[1] - b + a], c[:, b:]
            yield np.where(z > 0, (x * CODES + y) * CODES + z, 0), DECAY ** (b - 2)


class Kernel:
    """Word kernels with a fixed list of landmarks, as a table of the landmarks' subsequence weights."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        table = np.zeros((CODES**3, len(landmarks)), "f4")
        c = codes(landmarks)
        for ids, w in subsequences(c):
            for k in range(ids.shape[1]):
                np.add.at(table, (ids[:, k], np.arange(len(landmarks))), w)
        table[0] = 0
        self.table = table / np.maximum(np.sqrt((table**2).sum(0)), 1e-6)
        self.most = self.table.max(1, initial=0)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that have a kernel of LEAST or more with some landmark, and their rows of kernels as counted()."""
        kept, rows = self.plain(words)
        close = [k for k, m in enumerate(rows.max(1, initial=0)) if m < INSERTED and len(words[kept[k]]) > 3]
        less = [(k, w[:i] + w[i + 1 :]) for k in close for w in (words[kept[k]],) for i in range(len(w))]
        if less:
            some, found = self.plain([w for _, w in less])
            np.maximum.at(rows, np.array([less[i][0] for i in some], "i8"), found * np.float32(INSERTED))
        return kept, counted(rows)

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As __call__(), words as they stand: cosines, 0 where they are below LEAST.

        The best landmark for each subsequence alone bounds a word's kernels from above, so most words are left out early.
        """
        kept, rows = [np.zeros(0, "i8")], [np.zeros((0, len(self.landmarks)), "f4")]
        order = np.argsort(np.fromiter(map(len, words), "i8", len(words)), kind="stable")
        for at in range(0, len(order), 2048):
            index = order[at : at + 2048]
            every = list(subsequences(codes([words[i] for i in index])))
            bound, norm = np.zeros(len(index), "f4"), np.full(len(index), 1e-6, "f4")
            for ids, w in every:
                bound += self.most[ids].sum(1) * np.float32(w)
                norm += (ids > 0).sum(1) * np.float32(w * w)
            near = np.nonzero(bound >= LEAST * np.sqrt(norm))[0]
            if len(near):
                sums = np.zeros((len(near), len(self.landmarks)), "f4")
                for ids, w in every:
                    for k in range(ids.shape[1]):
                        sums += self.table[ids[near, k]] * np.float32(w)
                sums = np.minimum(sums / np.sqrt(norm[near])[:, None], 1)
                some = np.nonzero(sums.max(1) >= LEAST)[0]
                kept.append(index[near[some]])
                rows.append(np.where(sums[some] >= LEAST, sums[some], np.float32(0)))
        return np.concatenate(kept), np.concatenate(rows)

    def full(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), "f4")
        kept, rows = self(words)
        out[kept] = rows
        return out


def spelled(text: str) -> list[str]:
    """Words written with their letters apart."""
    return ["".join(c for c in m if c.isalnum()) for m in SPELLED.findall(text)]


def sentences(text: str) -> list[list[str]]:
    """Words as they stand, by sentence; long sentences are cut; words spelled apart are a sentence each."""
    out, now = [[w] for w in spelled(text)], []
    for w in words_of(text):
        now.append(w)
        if w[-1] in ".!?" or len(now) == SENTENCE:
            out.append(now)
            now = []
    return [*out, now] if now else out


class Model:
    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float, slope: float, shift: float, limit: int = 300_000):
        self.kernel, self.beta, self.bias, self.slope, self.shift = Kernel(landmarks), beta.astype("f4"), bias, slope, shift
        self.known: dict[str, float] = {}
        self.limit = limit

    def __reduce__(self):
        return Model, (self.kernel.landmarks, self.beta, self.bias, self.slope, self.shift, self.limit)

    def learn(self, words: set) -> None:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        new = words.difference(self.known)
        of = {w: letters(w) for w in new}
        parts = {p for form in set(of.values()) for p in windows(form)} - {""}
        names = list(parts)
        kept, rows = self.kernel(names)
        value = dict(zip([names[i] for i in kept], (rows @ self.beta).tolist(), strict=True))
        for w, form in of.items():  # the end of a sentence is kept with the word
            v = value.get(form, 0.0) if len(form) <= 24 else max(value.get(p, 0.0) for p in windows(form))
            self.known[w] = v + 1000.0 if w[-1] in ".!?" else v

    def decisions(self, batch: list[str]) -> np.ndarray:
        """The strongest sentence's decision for each text; the bias alone for texts without words."""
        split = [[*spelled(t), *words_of(t)] for t in batch]
        apart = [len(spelled(t)) if SPELLED.search(t) else 0 for t in batch]
        out = np.full(len(batch), self.bias)
        at = 0
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and (size < 60_000 or end == at):
                size += len(split[end])
                end += 1
            self.learn(set().union(*split[at:end]))
            for i in range(at, end):
                if not split[i]:
                    continue
                v = np.fromiter(map(self.known.__getitem__, split[i]), "f8", len(split[i]))
                last = v > 500
                v = v - 1000 * last
                first = np.concatenate(([True], last[:-1]))
                k = np.arange(len(v)) - apart[i]
                first |= k <= 0
                first |= (k - np.maximum.accumulate(np.where(first, k, -1))) % SENTENCE == 0
                out[i] = self.bias + np.add.reduceat(v, np.nonzero(first)[0]).max()
            at = end
        return out

    def scores(self, batch: list[str]) -> np.ndarray:
        with uncollected():
            found = self.decisions(batch)
        return 1 / (1 + np.exp(-np.clip(self.slope * found + self.shift, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, c: float = 3e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge loss, by accelerated gradient steps."""
    n = x.shape[1]
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = w = np.zeros(n + 1)
    total = weight.sum()
    z = np.random.default_rng(0).normal(size=n + 1)
    for _ in range(12):  # the largest curvature
        z = x1.T @ (weight * (x1 @ z)) / total
        size = np.linalg.norm(z)
        z = z / size
    step = 1 / (2 * size + c)
    for k in range(rounds):
        slack = np.maximum(1 - y * (x1 @ v), 0)
        g = -2 * x1.T @ (weight * y * slack) / total + c * np.append(v[:-1], 0)
        w, before = v - step * g, w
        v = w + k / (k + 3) * (w - before)
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """Learn from (text, label) rows; texts are cut into sentences, which first carry their document's label.

    Landmarks: words that set the classes' documents apart, each unlike those chosen before, and frequent words. The
    kernel matrix of the landmarks gives the Nyström map. In each later round a toxic document stands for its strongest
    sentences alone. The last step fits document scores (Platt's method) to a part that the machine did not see.
    """
    forms: dict[str, list[str]] = {}
    split = []
    for t, label in rows:
        cut = sentences(t)
        for ws in cut:
            for w in ws:
                if w not in forms:
                    forms[w] = [p for p in windows(letters(w)) if p]
        split.append(([[p for w in ws for p in forms[w]] for ws in cut], label))
    n = [sum(1 for _, y in split if y == k) for k in (0, 1)]
    if not n[0] or not n[1]:
        return Model(["aaa"], np.zeros(1), 0.0, 1.0, 4.0 if n[1] else -4.0)
    # near words count together: a stem's evidence is that of all words that begin with it
    stems: dict[str, list[int]] = {}
    for s, label in split:
        for w in {f[:k] for f in {f for fs in s for f in fs} for k in (4, 5, 6, len(f)) if len(f) > 3}:
            stems.setdefault(w, [0, 0])[label] += 1

    def evidence(c: list[int]) -> float:
        """How far the two classes' shares of documents are apart, in standard errors."""
        mean = (c[0] + c[1] + 1) / (n[0] + n[1] + 2)
        return (c[1] / n[1] - c[0] / n[0]) / np.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1]))

    strength = {w: e for w, c in stems.items() if c[1] > 4 and c[1] * n[0] > 5 * c[0] * n[1] and (e := evidence(c)) > 5}
    top = max(strength.values(), default=0)
    ranked = sorted((w for w in strength if strength[w] > 0.25 * top), key=lambda w: (-strength[w], -len(w), w))[:CANDIDATES]
    clean = sorted((w for w, c in stems.items() if c[0] > 2 and evidence(c) < 1), key=lambda w: (-stems[w][0], w))[:CANDIDATES]
    chosen: list[str] = []
    for pool, most in ((ranked, landmarks * 3 // 4), (clean, landmarks)):
        like = np.zeros(len(pool))  # the nearest landmark chosen so far
        if chosen and pool:  # clean words that are most like the others' landmarks
            first = Kernel(chosen).full(pool).max(1)
            order = np.argsort(-first, kind="stable")
            pool = [pool[i] for i in order if first[i] < 0.95]
            like = np.zeros(len(pool))
        for i, w in enumerate(pool):
            if len(chosen) == most:
                break
            if like[i] < counted(0.75):
                chosen.append(w)
                like = np.maximum(like, Kernel([w]).full(pool)[:, 0])
    if not chosen:
        return Model(["aaa"], np.zeros(1), 0.0, 1.0, -4.0)
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh((kernel.full(chosen) + kernel.full(chosen).T).astype("f8") / 2)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))  # the Nyström map is the kernels times root
    words = sorted({p for ps in forms.values() for p in ps})
    kept, rows_of = kernel(words)
    place = {words[i]: r for i, r in zip(kept, rows_of, strict=True)}
    # sentences without any kernel value are all alike: one row a document stands for them, with their number as weight
    x, bag, y, count = [], [], [], []
    for d, (s, label) in enumerate(split):
        found = [sum(parts) for fs in s if (parts := [place[p] for p in fs if p in place])]
        for row in found:
            x.append(row)
            count.append(1)
        if len(found) < max(1, len(s)):
            x.append(np.zeros(len(chosen), "f4"))
            count.append(1 if label else len(s) - len(found))
        bag += [d] * (len(x) - len(bag))
        y += [label] * (len(x) - len(y))
    x, bag, y, count = np.array(x) @ root, np.array(bag), np.array(y) * 2 - 1, np.array(count, "f8")
    held = np.array([crc32(t.encode()) % 4 == 0 for t, _ in rows])
    active = ~held[bag] if held.any() and not held.all() else np.ones(len(bag), bool)
    per = np.bincount(bag, minlength=len(split))
    cut = [0, *np.cumsum(per)]
    for turn in range(4):
        weight = np.where(y > 0, 1.0, NEGATIVE) * count
        for sign in (-1, 1):
            weight[y == sign] /= max(1, count[active & (y == sign)].sum())
        w, bias = _machine(x[active].astype("f8"), y[active].astype("f8"), weight[active])
        decision = x @ w + bias
        best = np.array([decision[a:b].max() if b > a else bias for a, b in pairwise(cut)])
        if turn < 3:
            active = np.array([(not held[d] or held.all()) and (y[i] < 0 or decision[i] >= max(best[d] - 1e-9, 0.5) or decision[i] == best[d]) for i, d in enumerate(bag)])
    part = held if len({rows[i][1] for i in np.nonzero(held)[0]}) == 2 else np.ones(len(rows), bool)
    s, t = best[part], np.array([label for _, label in rows], "f8")[part]
    weights = np.where(t > 0, 1 / max(1, t.sum()), NEGATIVE / max(1, (1 - t).sum())) / (1 + NEGATIVE)
    slope, shift = 1.0, 0.0
    soft = np.where(t > 0, 1 - 1 / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -30, 30)))
        g = np.array([(weights * (p - soft) * s).sum() + 1e-4 * slope, (weights * (p - soft)).sum()])
        r = weights * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(r * s * s).sum() + 1e-4, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-6]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return Model(chosen, root @ w, bias, float(slope), float(shift))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """fit() on at most sample labelled documents of each class, chosen by the hash of their ids, never those whose crc32(doc_id as text) mod 5 is 0.

    Labels that are null, or that contradict each other for one id, are left out; of several texts of one id the least counts. Only doc_id, text and toxic are read.
    """
    marked = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    usable = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = None
    for k in (0, 1):
        part = usable.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # the broadcast holds 2 * sample ids at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    rows = found.select("doc_id", F.col("text"), "toxic").collect()
    return fit([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs.

    Null and empty texts get the score of a text without words. Texts are read whole. A null doc_id stays, its held_out
    is null. Repeated rows each get a row; other columns are ignored; no rows give no rows.
    """

    def rows(batch):
        s = model.scores(texts(batch))
        yield {"doc_id": batch.column(0), "score": s}

    out = mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), rows, "doc_id long, score double")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with their own columns only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from codeloom.llm.common import hold

    hold(docs.sparkSession)
    schema, names = docs.schema, to_arrow_schema(docs.schema).names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(model.scores([t or "" for t in batch.column(names.index("text")).to_pylist()]) < 0.5))

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, trained(docs, read(spark, sf_dir, "labels")))
