"""The corpus operators against brute force, the tokenizers library and hand-made cases."""

import random
import re
import time
import unicodedata
from collections import Counter
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from codeloom.llm import chat_formatting, common as shared_helpers, embedding_dedup, lm_scoring, near_dedup, packing, quality_rules, simhash_dedup, token_counts, toxicity, url_filters
from codeloom.llm.bpe import Trie, vocabulary
from codeloom.llm.bpe_codec import digests, encode

DOCS = "doc_id long, text string, lang string, row string, fp string"
ODD = [None, "", "  \n\t", "a", "Straße ÀÉ́ ﬁ <|endoftext|> don't 12!!", "x" * 3000, "The cat sat.\nThe cat sat.\nThe cat sat."]


def words(rng, n):
    syl = "the an er in on re ed nd ha at en of or nt".split()
    return " ".join("".join(rng.choices(syl, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = [words(rng, rng.randint(1, 80)) for _ in range(60)]
    return [*ODD, *some, some[0], some[1] + " x", some[2].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "xx"][i % 3], "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id", "en", "", "")], DOCS)


def library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_trie_equals_library():
    rng, trie = random.Random(1), Trie(vocabulary())
    alphabet = ["a", "B", "é", "é", "ß", "Σ", "İ", " ", "\n", "\x1c", "\xa0", "'re", "'S", "1", "٣", "<|endoftext|>", "<|", "!!", "日本", "̀", "😀", "th", "ing", "\x00", "K"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for text, (ids, shown) in zip(cases, trie.encode_batch(cases, True), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), shown.decode()) == library(text)
    assert [i for i, _ in Trie(vocabulary(), by_model=True).encode_batch(cases)] == [i for i, _ in trie.encode_batch(cases)]


def test_known_words_by_model():
    """A word that every batch holds is spelled once, however many words come and go; the results stay."""
    trie, spelled = Trie(vocabulary(), limit=20, by_model=True), []
    model = trie.model
    trie.model = SimpleNamespace(tokenize=lambda w: spelled.append(w) or model.tokenize(w))
    for i in range(30):
        batch = [f"common {chr(97 + i % 26)}{chr(97 + i // 26)}x{'yz' * k}," for k in range(4)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in trie.encode_batch(batch)] == [library(t)[0] for t in batch]
    assert spelled.count("common") == 1 and len(trie.known) + len(trie.known.older) <= 40


def test_known_words_by_walk():
    """As above; the walk sees each batch's new words together, whatever their number, and texts are decoded from their ids."""
    trie, walked = Trie(vocabulary(), limit=20), []
    walk = trie.walk
    trie.walk = lambda words: walked.append(sorted(words)) or walk(words)
    for i in range(30):
        batch = [f"common {chr(97 + i % 26)}{chr(97 + i // 26)}x{'yz' * k}, \x01{k}" for k in range(4)]
        assert [(np.frombuffer(ids, "<u4").tolist(), shown.decode()) for ids, shown in trie.encode_batch(batch, True)] == [library(t) for t in batch]
    assert sum(w.count("common") for w in walked) == 1 and len(walked) == 30
    assert all(trie.shown[i] == t.encode() for i, t in trie.names.items())


def test_codec(spark, docs, texts):
    for r in encode(docs).collect():
        if r.doc_id is not None:
            assert (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) == library(texts[r.doc_id])
    assert digests(docs.limit(0)).count() == 0


def test_packing(spark, docs, texts):
    cut = packing.pack(docs, window=64).collect()
    by_doc = {}
    for r in cut:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*library(t)[0], 2]
        rows = sorted(by_doc[i], key=lambda r: r.start)
        for r in rows:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in rows) == len(ids) * (2 if i == 5 else 1)
    at = sorted((r.sequence_id, r.offset, r.length) for r in cut)
    place = 0
    for s, o, n in at:
        assert (s * 64 + o, o + n <= 64) == (place, True)
        place += n
    made = packing.sequences(docs, window=64).collect()
    assert all(len(r.input_ids) == 64 for r in made) and sum(r.n_tokens for r in made) == place
    assert packing.pack(docs.limit(0)).count() == 0


def test_token_counts(spark, docs, texts):
    sums = token_counts.suffix_sums(token_counts.histogram(docs))
    every = [len(library(t)[0]) for t in [*texts, texts[5], "null id"]]
    for r in sums.collect():
        k = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == (every.count(k), sum(x >= k for x in every), sum(x for x in every if x >= k), sum(min(x, k) for x in every))
    assert [r.truncated_tokens for r in token_counts.at_limits(sums, [7, 100]).orderBy("limit").collect()] == [sum(min(x, k) for x in every) for k in (7, 100)]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {g for g, c in Counter(grams).items() if c > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, texts):
    again = "one two three four five six seven eight nine ten " * 4
    more = spark.createDataFrame([(900, again, "en", "", ""), (901, "# | <b> *x* & $5 100%", "de", "", "")], DOCS)
    known = dict(enumerate(texts)) | {900: again, 901: "# | <b> *x* & $5 100%", None: "null id"}
    rows = quality_rules.quality(docs.unionByName(more)).collect()
    assert len(rows) == docs.count() + 2
    for r in rows:
        b = base(known[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r.kept and r.base_failed)
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and quality_rules.quality(docs.limit(0)).count() == 0


def divergence(p, q):
    """Jensen-Shannon distance of two counts, with logarithms to base 2."""
    a, b = sum(p.values()), sum(q.values())
    total = 0.0
    for k in {*p, *q}:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        total += sum(v * np.log2(2 * v / (x + y)) / 2 for v in (x, y) if v)
    return np.sqrt(max(total, 0.0))


def test_quality_distances(spark, monkeypatch):
    """Distances to the counts of the language's other good documents (or of all languages', where those are few), one by one."""
    monkeypatch.setattr(quality_rules, "REFERENCE_WORDS", 300)
    rng = random.Random(12)
    every = {w for v in quality_rules.COMMON.values() for w in v.split()}
    rows = [(i, " ".join(rng.choices([*quality_rules.COMMON["en"].split()[:9], "Hören", "x1,", "ÉTÉ", "of", "THE", "#5!", "日本"], k=rng.choice([5, 30, 60]))), rng.choice(["en", "en", "en", "de", None, "xx"])) for i in range(60)]
    rows += [(70, "#$% " * 40, "en"), (71, None, "en"), (72, "only one of its kind " * 1 + " ".join(f"w{k}" for k in range(30)), "fr"), (3, rows[3][1], "en")]

    def classes(t):
        out = Counter()
        for c in re.sub(r"[\x20\x09-\x0D]+", "", t or ""):
            kind = unicodedata.category(c)
            out["l" if kind == "Ll" else "u" if kind == "Lu" else "d" if kind == "Nd" else "p" if c in ".,;:!?'\"()-" else "o"] += 1
        return out

    def commons(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return Counter(x.lower() if x in every or x.lower() in every and x in (x.lower().capitalize(), x.upper()) else " " for x in w)

    language = [x if x in quality_rules.COMMON else "other" for _, _, x in rows]
    good = [b[0] >= 20 and 100 * b[4] <= 30 * b[0] for b in (base(t) for _, t, _ in rows)]
    got = quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = Counter((r.doc_id, r.n_words, round(r.chars_distance or 0, 9), round(r.words_distance or 0, 9)) for r in got)
    for i, (doc, t, _) in enumerate(rows):
        others = [j for j in range(len(rows)) if good[j] and j != i]
        same = [j for j in others if language[j] == language[i]]
        if sum(sum(commons(rows[j][1]).values()) for j in same) >= 300:
            others = same
        p, q = (sum((f(rows[j][1]) for j in others), Counter()) for f in (classes, commons))
        n = sum(commons(t).values())
        expected = (doc, n, round(divergence(classes(t), p), 9) if n else 0, round(divergence(commons(t), q), 9) if n else 0)
        assert any(k[:2] == expected[:2] and abs(k[2] - expected[2]) < 1e-6 and abs(k[3] - expected[3]) < 1e-6 for k in by), (expected, [k for k in by if k[0] == doc])
    junk = [(80, " ".join("".join(rng.choices("#$%&*<>|QXZ0987", k=7)) for _ in range(200)), "fr")]
    assert [r.kept for r in quality_rules.quality(spark.createDataFrame([*rows, *junk], "doc_id long, text string, lang string")).where("doc_id = 80").collect()] == [False]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if linked(i, j) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash(spark, docs, texts, monkeypatch):
    fps = [fingerprint(t) for t in texts]
    label = component(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    for r in simhash_dedup.clusters(docs).collect():
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], label[r.doc_id])
    # large groups take the other exact way, with the same components
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    many = sorted({s ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 2))}) for s in seeds for _ in range(15)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in many]
    found = []
    for group in (2000, 3):
        monkeypatch.setattr(simhash_dedup, "GROUP", group)
        rows = simhash_dedup.components(simhash_dedup.links(spark.createDataFrame(signed, "fp long"))).collect()
        found.append({r.node: r.component for r in rows})
    label = component(len(many), lambda i, j: (many[i] ^ many[j]).bit_count() <= 2)
    groups = {frozenset(signed[i][0] for i in range(len(many)) if label[i] == k) for k in set(label)}
    for f in found:
        assert {frozenset(k for k in f if f[k] == c) for c in set(f.values())} == {g for g in groups if len(g) > 1}
    assert simhash_dedup.clusters(docs.limit(0)).count() == 0


@pytest.mark.parametrize("common", [6, 2])
def test_near_duplicates(spark, monkeypatch, common):
    """The pipeline's stage against brute force over five-word shingles: most of these pairs are far beyond two bits of a fingerprint."""
    import corpus_pipeline

    monkeypatch.setattr(near_dedup, "SAMPLE", 1)
    monkeypatch.setattr(near_dedup, "COMMON", common)
    rng = random.Random(8)
    passage = words(rng, 30)
    some = []
    for k in range(25):
        w = words(rng, rng.randint(20, 120)).split() + (passage.split() if k % 3 == 0 else [])
        for edits in (0, 1, 1, 2, 3, 4):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = words(rng, 1)
            some.append(" ".join(v))
    some += ["a b", "A\tb", "", " \n", None, some[0].upper()]
    rows = [(i, t) for i, t in enumerate(some)] + [(3, "other text that has the id of another row but no link to it"), (None, some[7]), (None, "no row with an id is like this one"), (None, "no row with an id is like this ONE")]

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} - {()}

    sets = [grams(t) for _, t in rows]
    label = component(len(rows), lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    expected = {}
    for k, (i, t) in enumerate(rows):
        expected.setdefault(label[k], []).append((i is None, i or 0, t or "", k))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(kept) == len(expected) and Counter(r.doc_id for r in kept) == Counter(None if min(g)[0] else min(g)[1] for g in expected.values())
    assert 0 < len(expected) < len(rows) - 30


def test_near_duplicates_by_simhash(spark, monkeypatch):
    """SimHash alone, without prefix filtering, connects all sets whose fingerprints are equal or within two bits; its pairs are checked exactly."""
    rng = random.Random(5)
    some = []
    for _ in range(12):
        w = words(rng, 400).split()
        some += [" ".join(w), " ".join([*w, *words(rng, 1).split()]), " ".join([*words(rng, 2).split(), *w])]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    sets = [near_dedup.shingles(t) for t in some]
    prints = [near_dedup.fingerprint(h) for h in sets]
    close = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    label = component(len(some), lambda i, j: close(i, j) and near_dedup.similar(sets[i], sets[j]))
    assert len(set(label)) < len(some) - 10
    monkeypatch.setattr(near_dedup, "shared", lambda s: spark.createDataFrame([], "h long, id long, n long, least long, m long"))
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    kept = {r.doc_id for r in near_dedup.representatives(docs).collect()}
    assert kept == {min(i for i in range(len(some)) if label[i] == k) for k in set(label)}
    scalar = [sum((2 * sum(int(x) >> b & 1 for x in h) > len(h)) << b for b in range(64)) for h in sets[:5]]
    assert scalar == prints[:5] and near_dedup.fingerprint(near_dedup.shingles("")) == 0


def test_near_duplicates_release_shuffles(spark, monkeypatch):
    """After each large table of the stage the shuffles that led to it and to the ones before are gone, though memory is far from full."""
    live = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, seen, real = live(), [], near_dedup.released

    def counted(session):
        real(session)
        until = time.time() + 5
        while live() > before + 10 and time.time() < until:
            time.sleep(0.1)
        seen.append(live())

    monkeypatch.setattr(near_dedup, "released", counted)
    rng = random.Random(9)
    some = [words(rng, 60) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(some + [t + " x" for t in some])), "doc_id long, text string")
    assert near_dedup.representatives(docs).count() == 40
    assert len(seen) > 8 and max(seen) <= before + 10


def test_sifted(spark):
    rows, ids = spark.range(-500, 4500), spark.range(0, 4000, 7).withColumnRenamed("id", "other")
    some, others = shared_helpers.sifted(rows, "id", ids)
    assert some.count() + others.count() == 5000 and others.join(ids, F.col("id") == F.col("other")).isEmpty()
    assert others.count() > 3500 and shared_helpers.sifted(rows, "id", ids.limit(0))[0].isEmpty()


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:180] = x[0] + rng.normal(size=(80, 16)) * 0.05
    x[200:205] = x[1]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] * 16, 0), (904, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in embedding_dedup.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = np.array([np.float32(v).astype("f8") for v in x])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    assert sum(got[i].n_links for i in range(300)) >= 0.98 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(300))
    label = component(300, lambda i, j: near[i, j])
    assert all((got[i].component_id, got[i].kept) == (label[i], label[i] == i) for i in range(300))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(900, 905))


def test_embeddings_odd(spark):
    """Rows without vec_id link like others, equal rows are vectors of their own, and every dimension is compared."""
    schema = "vec_id long, embedding array<double>, rep string, leaf string"
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.1]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (None, [-1.0, 0.0])]
    got = embedding_dedup.clusters(spark.createDataFrame([(*r, "", "") for r in rows], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 2, 5, False), (0, 2, 5, False), (5, 2, 5, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert embedding_dedup.clusters(spark.createDataFrame([], schema)).count() == 0
    many = [(2 * n + k, [1.0] * (n + 1) + [0.05 * k] * 3) for n in range(1200) for k in (0, 1)]
    got = embedding_dedup.clusters(spark.createDataFrame([(*r, "", "") for r in many], schema)).collect()
    assert all((r.n_links, r.component_id) == (1, r.vec_id // 2 * 2) for r in got) and len(got) == 2400


def test_toxicity():
    rng = random.Random(2)
    bad = ["grumwit", "zorbling", "flaxnard"]
    rows = []
    for i in range(300):
        t = words(rng, 40).split()
        if i % 3 == 0:
            t[rng.randrange(40)] = rng.choice(bad)
            t[rng.randrange(40)] = rng.choice(bad)
        rows.append((" ".join(t) + ".", int(i % 3 == 0)))
    model = toxicity.fit(rows[:240])
    s = model.scores([t for t, _ in rows[240:]])
    assert np.mean((s >= 0.5) == np.array([y == 1 for _, y in rows[240:]])) > 0.95
    odd = model.scores([None or "", "grum-wit you", "g r u m w i t", "x" * 5000])
    assert (odd[0] < 0.5, odd[1] >= 0.5, odd[2] >= 0.5, odd[3] < 0.5) == (True,) * 4
    assert toxicity.fit([]).scores(["a"])[0] < 0.5


def cosine(a, b):
    """Of the gap-weighted three-letter subsequences of two words, by listing them."""

    def weights(w):
        w, out = "^" + w, Counter()
        for i in range(len(w)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(w))):
                for j in range(i + 1, k):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    # a word's norm is taken as if no subsequence came twice
    once = sum(toxicity.DECAY ** (2 * (k - i - 2)) * (k - i - 1) for i in range(len(a) + 1) for k in range(i + 2, min(i + toxicity.SPAN, len(a) + 1)))
    return min(1.0, sum(x[g] * y[g] for g in x) / np.sqrt(once * sum(v * v for v in y.values())))


def test_toxicity_kernel():
    rng = random.Random(9)
    landmarks = ["idiot", "pathetic", "scum"]
    some = [*landmarks, *("".join(rng.choices("aeidopthcsum", k=rng.randint(3, 9))) for _ in range(60)), "idot", "pathhetic", "scuxm"]
    got = toxicity.Kernel(landmarks).full(some)
    for w, row in zip(some, got, strict=True):
        for mark, k in zip(landmarks, row.tolist(), strict=True):
            plain = [cosine(v, mark) for v in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]]
            if abs(plain[0] - toxicity.LEAST) < 1e-3 or abs(max(plain) - toxicity.INSERTED) < 1e-3 or max(cosine(w, m) for m in landmarks) < toxicity.LEAST:
                continue
            best = max([plain[0], *(toxicity.INSERTED * p for p in plain[1:])]) if max(cosine(w, m) for m in landmarks) < toxicity.INSERTED and len(w) > 3 else plain[0]
            expected = toxicity.counted(best) if best >= toxicity.LEAST else 0
            assert abs(k - expected) < 1e-3 or best < toxicity.LEAST / toxicity.INSERTED and k <= expected + 1e-3


def test_toxicity_inserted_letter():
    """Any one letter inserted anywhere, doubled or left apart by a sign, keeps a learnt word as it was."""
    bad = ["idiot", "moron", "clown", "scum", "stupid", "pathetic"]
    kernel = toxicity.Kernel(bad)
    for k, w in enumerate(bad):
        gapped = [w[:i] + c + w[i:] for i in range(1, len(w)) for c in "axq"]
        assert kernel.full(gapped)[:, k].min() >= 0.95
    rng = random.Random(7)
    rows = []
    for i in range(300):
        t = words(rng, 40).split()
        if i % 3 == 0:
            t[rng.randrange(40)], t[rng.randrange(40)] = rng.choice(bad), rng.choice(bad)
        rows.append((" ".join(t) + ".", int(i % 3 == 0)))
    model = toxicity.fit(rows)
    gapped = [w[:i] + "x" + w[i:] for w in bad for i in range(1, len(w))]
    assert (model.scores([f"an {w} on the {w} of." for w in gapped]) >= 0.5).mean() > 0.9


def test_toxicity_labels(spark):
    """Contradicting labels and repeated ids have a defined result, and empty tables are learnt from and scored."""
    rows = [(1, "b"), (1, "a"), (2, None), (None, "x"), (3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    assert toxicity.scored(docs.limit(0), toxicity.trained(docs.limit(0), labels.limit(0))).count() == 0


def test_toxicity_query(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs, toxicity.trained(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)


def test_urls(spark):
    urls = [None, "no scheme", "https://A.Example.ORG/es/1?x", "http://m.example.com/de/7#a", "http://x.com/fr/2", "ftp://net.example.net/q", "http://example.org/en/12", "http://org", "https://b.example.com/de"]
    urls += [f"http://good{i}.com/fr/{i}" for i in range(20)] + [f"http://cheap{i}.com/de/{i}" for i in range(20)] + ["http://good99.net/fr/5", "http://cheap99.net/de/5"]
    got = {r.page_id: r for r in url_filters.judged(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("m.example.com", "/de/7", "com/de/"), ("x.com", "/fr/2", "com/fr/"), ("net.example.net", "/q", None), ("example.org", "/en/12", "example.org/en/1"), ("org", "", None), ("b.example.com", "/de", None)]
    assert [got[i].verdict for i in (2, 3, 4, 6)] == ["block", "block", "allow", "block"]
    assert (got[len(urls) - 2].verdict, got[len(urls) - 1].verdict) == ("allow", "block")
    assert url_filters.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (2, 1, "assistant", "yes"), (None, 0, "user", "hi")]
    rows += [(6, t, "user", f"t{t}") for t in range(600)] + [(7, t, "user", f"t{t}") for t in range(300)]
    out = chat_formatting.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.n_turns) for r in out if r.part == 0] == [(2, 2), (4, 2), (5, 1), (6, 600)]
    whole = "".join(r.text for r in out if r.conv_id == 6)
    assert whole == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(600))


def test_lm(spark, docs, texts):
    got = {r.doc_id: r for r in lm_scoring.scored(docs).collect()}
    every = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), " "]) for i, t in [*enumerate(texts), (5, texts[5])]]
    count = Counter(w for i, t in every if crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in [*every, (None, ["null", "id", " "])]:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (None if i is None else crc32(str(i).encode()) % 5 == 1, len(t), sum(w in count for w in t), n)
        assert abs(r.base_score - sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6 and r.score < 0
    assert lm_scoring.scored(docs.limit(0)).count() == 0


def test_lm_learns_from_all(spark, monkeypatch):
    """Weights and tables are learnt from every token of every training document, long ones and later ones too, as one model after another learns them here."""
    monkeypatch.setattr(lm_scoring, "SPAN", 64)
    rng = random.Random(6)
    rows = [(i, words(rng, 4000 if i in (7, 8, 9) else 30)) for i in range(300)]
    numbered = lm_scoring._numbered(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    known = lm_scoring._known(lm_scoring._asked(numbered.select("train", "text", "block", "size")))
    model = lm_scoring.fitted(numbered, known)
    trained = [t for i, t in rows if crc32(str(i).encode()) % 5 != 1]
    n = sum(len(t.split()) + 1 for t in trained)
    assert len(trained) > 200 and any(len(t) > 20_000 for t in trained)
    assert model.seen.sum() - lm_scoring._prior_table(lm_scoring.STATES).sum() == lm_scoring.CODE * n
    first = lm_scoring.Model(model.counts, model.node_logits, model.in_class, model.kinds, model.discount, model.total, lm_scoring.Mixer(model.speller.counts))
    parts = list(lm_scoring._parts(lm_scoring._together(numbered.where("train"), known).toArrow().to_batches()))
    assert len({number for number, _, _ in parts}) > 3
    total, pupils = 0, {}
    for number, block, part in parts:
        for _ in block.scores(pupils.setdefault(number, first.pupil()), [(t, True) for t in part.column("text").to_pylist()], learn=True):
            pass
    total = sum(pupils[k].lesson(first) for k in sorted(pupils))
    again = first.taught(total)
    for a, b in ((model.weights, again.weights), (model.shares, again.shares), (model.speller.weights, again.speller.weights), (model.speller.seen, again.speller.seen)):
        assert np.allclose(a, b, atol=1e-12) and not np.allclose(a, {id(model.weights): first.weights, id(model.shares): first.shares, id(model.speller.weights): first.speller.weights, id(model.speller.seen): first.speller.seen}[id(a)])


def test_lm_blocks_and_copies(spark, monkeypatch):
    """However rows are dealt to blocks, counts are those of the corpus; texts that occur twice are set apart; two runs agree."""
    monkeypatch.setattr(lm_scoring, "SPAN", 16)
    monkeypatch.setattr(lm_scoring, "LONG", 600)
    rng = random.Random(4)
    rows = [(i, words(rng, rng.choice([20, 60, 300]))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 150, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.scored(frame).collect()}
    count = Counter(w for i, t in rows if crc32(str(i).encode()) % 5 != 1 for w in [*t.lower().split(), " "])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        assert abs(got[i].base_score - sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.lower().split(), " "])) < 1e-6
    trained = {i for i, _ in rows if crc32(str(i).encode()) % 5 != 1}
    twice = [got[i].bits_per_byte for i, t in rows if len(t) > 100 and any(u == t and k != i and k in trained for k, u in rows)]
    once = [got[i].bits_per_byte for i, t in rows if len(t) > 100 and sum(u == t for _, u in rows) == 1]
    assert np.mean(np.array(twice) < np.quantile(once, 0.05)) > 0.6
    again = {r.doc_id: r.score for r in lm_scoring.scored(frame).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_lm_speller_looks_up_each_gram_once(monkeypatch):
    """Learning and scoring words equals plain steps over all their grams, and looks up the contexts of each distinct gram once."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 101, n).tolist()) for n in rng.integers(1, 9, 400)]
    counts = rng.integers(1, 40, (lm_scoring.BASES[-1], 2)).astype("f4")
    grams, rows = lm_scoring.spelling(words)
    bits, looked_up = lm_scoring.bits, []
    plain = lm_scoring.Mixer(counts)

    def inputs(part, b):
        slot, bit = list(bits(part))[b]
        c = np.maximum(counts[slot.reshape(lm_scoring.PREDICTORS, -1)] - (bit[:, None] == [0, 1]), 0)
        n = c.sum(-1)
        deep = (n > 0).sum(0)
        top = n[np.maximum(deep - 1, 0), np.arange(len(part))]
        return np.concatenate([np.log((c[..., 1] + lm_scoring.PRIOR) / (c[..., 0] + lm_scoring.PRIOR)), np.ones((1, len(part)))]), deep * lm_scoring.LEVELS + (top > 2) + (top > 12) + (top > 100), bit

    for a in range(0, len(grams), 500):
        for b in range(8):
            x, gate, bit = inputs(grams[a : a + 500], b)
            dot = np.clip((x * plain.weights[gate].T).sum(0), -12, 12)
            np.add.at(plain.seen[0], (lm_scoring._bins(dot), bit), 1)
            error, size = bit - 1 / (1 + np.exp(-dot)), np.bincount(gate, minlength=lm_scoring.GATES)
            for g in np.unique(gate):
                plain.weights[g] += lm_scoring.RATE * (error * x)[:, gate == g].sum(1) / size[g] * min(np.sqrt(size[g]), 10)
    refined, expected = plain.seen[0, :, 1] / plain.seen[0].sum(1), np.zeros(len(words))
    for b in range(8):
        x, gate, bit = inputs(grams, b)
        dot = np.clip((x * plain.weights[gate].T).sum(0), -12, 12)
        p = (1 / (1 + np.exp(-dot)) + refined[lm_scoring._bins(dot)]) / 2
        expected += np.bincount(rows, np.log10(np.where(bit == 1, p, 1 - p)), len(words))
    monkeypatch.setattr(lm_scoring, "bits", lambda part: looked_up.append(len(part)) or bits(part))
    speller = lm_scoring.Mixer(counts)
    got = speller.log10(words, 1, learn=True)
    assert np.allclose(got, expected, 1e-4) and np.allclose(speller.weights, plain.weights, 1e-4)
    assert sum(looked_up) == len(np.unique(grams)) < len(grams)


def test_lm_against_scalars():
    """A text's bits and words one by one, with dictionaries in place of sorts; the corpus's tables are the model's own."""
    rng = random.Random(6)
    t = [words(rng, 60).lower() for _ in range(12)]
    u = [lm_scoring.Tokens(x).u for x in t]
    code, prior = lm_scoring.CODE, lm_scoring.PRIOR
    counts = np.zeros((1 << lm_scoring.SLOTS, 2), "f4")
    for x in u:
        node, bit = lm_scoring.path(x)
        np.add.at(counts, (lm_scoring.slots(x, node), bit), 1)
    key, c = np.unique(np.concatenate(u), return_counts=True)
    of = (key >> np.uint64(64 - code)).astype(int)
    model = lm_scoring.Model(counts, np.zeros(1 << code, "f4"), np.bincount(of, c, 1 << code), np.bincount(of, minlength=1 << code), 0.5, float(c.sum()), None)
    text = u[0]
    told = lm_scoring.Block(key.view("i8"), c, {})
    count = np.array([int(c[key == h][0]) for h in text])
    score = model.text(text, count, np.zeros(len(text)), told, False, lm_scoring._earlier(text))
    assert (model.own == 0).all() and len(text) < lm_scoring.CHUNK
    total, seen, last, earlier, classes = 0.0, Counter(), {}, Counter(), Counter()
    for i, h in enumerate(text.tolist()):
        k = h >> (64 - code)
        before = int(text[i - 1]) if i else 0
        guess = int(text[last[before] + 1]) >> (64 - code) if i and before in last else None
        for d in range(code):
            node, bit = 1 << d | k >> (code - d), k >> (code - 1 - d) & 1
            slot = int(lm_scoring.slots(text[max(i - 1, 0) : i + 1], np.repeat(np.array([node]), code * (min(i, 1) + 1)))[-1])
            c0, c1 = counts[slot]
            x = [0.0, np.log((c1 + prior) / (c0 + prior)), np.log((seen[node, 1] + prior) / (seen[node, 0] + prior)), 0.0, 0.0, 0.3]
            agree = guess is not None and (guess ^ k) >> (code - d) == 0
            if agree:
                x[3] = 1.0 if guess >> (code - 1 - d) & 1 else -1.0
            gate = 3 * agree + int(c0 + c1 > 2) + int(c0 + c1 > 50)
            dot = min(8, max(-8, sum(w * v for w, v in zip(model.weights[:, gate], x, strict=True))))
            cell = model.seen[0, int(dot * 2 + lm_scoring.BUCKETS // 2 + 0.5)]
            p = 1 / (1 + np.exp(-dot))
            total += np.log10(((p if bit else 1 - p) + cell[bit] / cell.sum()) / 2)
        for d in range(code):
            seen[1 << d | k >> (code - d), k >> (code - 1 - d) & 1] += 1
        p = (count[i] - 0.5) / model.in_class[k]
        if classes[k]:
            share = model.shares[lm_scoring.STATES + (classes[k] > 3) + (classes[k] > 15) + (classes[k] > 63)]
            q = share[1] / share.sum()
            p = (1 - q) * p + q * earlier[h] / classes[k]
        total += np.log10(p)
        if i:
            last[before] = i - 1
        earlier[h] += 1
        classes[k] += 1
    assert abs(total - score) < 1e-3 * abs(total)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "packing"]
    kept = corpus_pipeline.quality(spark, docs, d)
    expected = {r.doc_id for r in quality_rules.quality(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == expected and kept.columns == docs.columns
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} <= expected
