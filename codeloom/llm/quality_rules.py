"""Quality rules (method: distribution divergence). Built-in functions only.

A document's character classes and common words are compared with its language's reference by Jensen-Shannon distance.
The references are counted over all other documents that pass the base rules: a document never counts in its own, and where
the rest of its language has under REFERENCE_WORDS words, that of all languages together stands in. Distances of short
texts are noise, so each has a guard of least size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import SPACE, read, written

#: Frequent function words of the four languages.
COMMON = {
    "en": "the of and to in a is that it for was on are as with by at this be an from or have not but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il avec",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es o pero",
}
#: Limits of the method, as (least size, largest distance): sizes are word characters for the classes, words for the common words.
CHARS_GUARDS = ((100, 0.4), (220, 0.3), (330, 0.26), (550, 0.235), (1100, 0.2), (2200, 0.185))
WORDS_GUARDS = ((20, 0.5), (100, 0.43), (400, 0.32))
#: (least words, class distance, common-word distance): from this size on, both distances together reject from lower values.
BOTH_GUARD = (100, 0.16, 0.28)
WINDOW = 8
#: Words that a language's other documents need for a reference of its own.
REFERENCE_WORDS = 20_000


def _part(p: Column, q: Column) -> Column:
    """Of the Jensen-Shannon divergence in bits: one bin's share from p, against the mean of p and q."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q)) / 2).otherwise(F.lit(0.0))


def measures(docs: DataFrame) -> DataFrame:
    """Reads each text once: language (lang where its lists are known, else 'other'), what the base rules count, and what the method compares.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; class0 to class4, counts of lower-case
    letters, upper-case letters, digits, plain punctuation and other characters; common, the function words in order.
    A null text has no words. Windows of eight words are compared by 64-bit hashes of their words' hashes.
    """
    known = list(COMMON)
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumn("language", F.when(F.lower("lang").isin(known), F.lower("lang")).otherwise("other"))
    out = out.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    # characters: each class is taken out of what the ones before it left
    left = out.withColumn("left0", F.regexp_replace("text", r"\p{Ll}+", ""))
    for k, c in enumerate((SPACE, r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?'\"()-]+")):
        left = left.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", c, ""))
    size = lambda c: F.length(c).cast("long")
    out = left.select(
        *(c for c in out.columns if c != "text"),
        F.split("text", "\n").alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        (size("text") - size("left0") + size("left1")).alias("word_chars"),
        (size("left4") - size(F.regexp_replace("left4", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (size("text") - size("left0")).alias("class0"), (size("left1") - size("left2")).alias("class1"), (size("left2") - size("left3")).alias("class2"), (size("left3") - size("left4")).alias("class3"), size("left4").alias("class4"),
    )
    out = out.withColumn("lines", F.filter("lines", lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    every = {w for v in COMMON.values() for w in v.split()}
    common = F.filter("words", lambda w: w.isin(sorted(every | {w.capitalize() for w in every} | {w.upper() for w in every})))
    out = out.withColumn("common", F.transform(common, F.lower))
    # windows of 1, 2, 4 and 8 words: each from two of the size before
    out = out.withColumn("windows", F.when(F.col("n_words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w)))).drop("words")
    for step in (1, 2, 4):
        out = out.withColumn("windows", F.zip_with(F.slice("windows", F.lit(1), F.size("windows") - step), F.slice("windows", F.lit(step + 1), F.size("windows")), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("some_repeat", F.coalesce(F.size(F.array_distinct("windows")) < F.size("windows"), F.lit(False)))
    # of each repeated window its start, in text order: sorted by hash, a repeated one equals a neighbour
    out = out.withColumn("by_hash", F.when(F.col("some_repeat"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    same = lambda x, i: F.coalesce(F.get("by_hash", i)["h"] == x["h"], F.lit(False))
    out = out.withColumn("starts", F.sort_array(F.transform(F.filter("by_hash", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).drop("by_hash")
    reach = F.transform("starts", lambda s, i: F.least(F.coalesce(F.get("starts", i + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("starts", "some_repeat")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def references(rows: DataFrame) -> DataFrame:
    """From measures() of all documents, one row for each of the five languages at most, of counts in documents that pass the base rules.

    own and pooled (the language's and those of all): words, classes (an array) and common (a map from word to count).
    """
    good = rows.where("not base_failed")
    sums = good.groupBy("language").agg(*(F.sum(f"class{k}").alias(f"c{k}") for k in range(5)), F.sum("n_words").alias("words"))
    words = good.select("language", F.explode("common").alias("word")).groupBy("language", "word").agg(F.count("*").alias("c"))
    empty = F.create_map().cast("map<string,bigint>")
    # lists of some hundred words at most
    listed = lambda d, *by: d.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "c")))).alias("common"))
    shape = lambda name: F.struct("words", F.array(*(f"c{k}" for k in range(5))).alias("classes"), F.coalesce("common", empty).alias("common")).alias(name)
    own = sums.join(listed(words, "language"), "language", "left").select("language", shape("own"))
    every = sums.groupBy().agg(F.sum("words").alias("words"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(5)))
    pooled = every.crossJoin(F.broadcast(listed(words.groupBy("word").agg(F.sum("c").alias("c")).select("word", "c")))).select(shape("pooled"))  # one row each
    known = rows.select("language").distinct()
    return known.join(own, "language", "left").crossJoin(F.broadcast(pooled))


def judged(docs: DataFrame) -> DataFrame:
    """measures() with chars_distance, words_distance (Jensen-Shannon distances from 0 to 1), and kept; other columns of docs stay.

    The reference table has five rows at most and is broadcast. A document without words has no distances and fails the
    base rules; one without any other document to compare with has none either, and the base rules alone judge it. Where
    a text is below a guard's size, that distance does not count.
    """
    rows = written(measures(docs), "quality", "zstd")
    out = rows.join(F.broadcast(references(rows)), "language")
    # of a document that passes the base rules its own counts are taken out of the reference
    mine = lambda c: F.when(F.col("base_failed"), F.lit(0).cast("long")).otherwise(F.col(c))
    enough = F.coalesce(F.col("own.words") - mine("n_words") >= REFERENCE_WORDS, F.lit(False))
    out = out.withColumn("reference", F.when(enough, F.col("own")).otherwise(F.col("pooled"))).drop("own", "pooled")
    out = out.withColumn("rest_words", F.col("reference.words") - mine("n_words"))
    out = out.withColumn("rest_chars", F.aggregate("reference.classes", F.lit(0).cast("long"), lambda a, x: a + x) - sum((mine(f"class{k}") for k in range(5)), F.lit(0)))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    parts = []
    for k in range(5):
        p, q = F.col(f"class{k}") / chars, (F.col("reference.classes")[k] - mine(f"class{k}")) / F.col("rest_chars")
        parts += [_part(p, q), _part(q, p)]
    out = out.withColumn("chars_distance", F.when((F.col("word_chars") > 0) & (F.col("rest_chars") > 0), F.sqrt(F.greatest(sum(parts, F.lit(0.0)), F.lit(0.0)))))
    # bins: each common word, and all other words; a bin that the document lacks adds half of its reference share
    n, counts, rest = F.greatest(F.col("n_words"), F.lit(1)), F.col("reference.common"), F.greatest(F.col("rest_words"), F.lit(1))
    held = F.when(F.col("base_failed"), F.lit(0)).otherwise(F.size("common"))
    out = out.withColumn("rest_share", F.greatest(1 - (F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x) - held) / rest, F.lit(0.0)))
    out = out.withColumn("other_share", 1 - F.size("common") / n).withColumn("kinds", F.array_distinct("common"))

    # own and reference counts first, then shares, then sums: a lambda's expressions are computed again wherever they stand
    held_own = lambda c: F.when(F.col("base_failed"), F.lit(0)).otherwise(c)
    out = out.withColumn("kinds", F.transform("kinds", lambda w: F.struct((F.size("common") - F.size(F.array_remove("common", w))).alias("own"), F.coalesce(F.element_at(counts, w), F.lit(0)).alias("all"))))
    out = out.withColumn("kinds", F.transform("kinds", lambda x: F.struct((x["own"] / n).alias("p"), ((x["all"] - held_own(x["own"])) / rest).alias("q"))))
    out = out.withColumn("sums", F.aggregate("kinds", F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["d"] + _part(x["p"], x["q"]) + _part(x["q"], x["p"])).alias("d"), (a["q"] + x["q"]).alias("q"))))
    divergence = F.col("sums.d") + (1 - F.col("rest_share") - F.col("sums.q")) / 2 + _part(F.col("other_share"), F.col("rest_share")) + _part(F.col("rest_share"), F.col("other_share"))
    out = out.withColumn("words_distance", F.when((F.col("n_words") > 0) & (F.col("rest_words") > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))))
    far = F.lit(False)
    for column, size_column, guards in (("chars_distance", "word_chars", CHARS_GUARDS), ("words_distance", "n_words", WORDS_GUARDS)):
        for least, most in guards:
            far = far | (F.col(size_column) >= least) & (F.col(column) > most)
    far = far | (F.col("n_words") >= BOTH_GUARD[0]) & (F.col("chars_distance") > BOTH_GUARD[1]) & (F.col("words_distance") > BOTH_GUARD[2])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, chars_distance, words_distance and kept, one row for each row of docs.

    Nulls: a null text is an empty one, a null or unknown language is 'other', a null doc_id stays.
    Repeated rows each give their row and each count in the others' references; other columns are ignored, whatever their
    names; no rows give no rows. A text is judged whole, whatever its length.
    """
    rows = docs.select("doc_id", "text", "lang")
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with their own columns only."""
    row = docs.select("text", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # a filter pushed below the distances would repeat their expressions, and compute them several times a row; it can't pass mark
    return judged(row).withColumn("mark", F.monotonically_increasing_id()).where("kept and mark >= 0").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
