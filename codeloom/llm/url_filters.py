"""URL filters (method: ratio of character language models). Built-in functions only.

Rules accept or reject some URLs. Two smoothed variable-order Markov models over characters (Witten and Bell's method)
learn from accepted and from rejected URLs; any other URL is judged by the difference of its log-likelihoods, divided by
its length, against a threshold that lies between the two classes' own differences.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import LOWER, read, written

#: (rule as host/path, verdict); fixed by the contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Longest context in characters; copies of the model's rows that URLs' characters are spread over in the join; symbols that the smallest model shares out evenly.
ORDER, SALTS, SYMBOLS = 4, 8, 256
START = "\x02"


def host_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first '://' up to / ? # or the end, A-Z in lower case; and what follows up to ? or #. Both empty for null or without '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.translate(host, *LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    which = lambda value: F.coalesce(*(F.when(((host == r.partition("/")[0]) | F.endswith(host, F.lit("." + r.partition("/")[0]))) & F.startswith(path, F.lit("/" + r.partition("/")[2])), F.lit(value(r, v))) for r, v in ordered))
    return which(lambda r, _: r), which(lambda _, v: v)


def _counts(grams: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of the last k characters of context: (gram_k, a, b), and (ctx_k, na, nb, ta, tb): counts and distinct next characters for both classes."""
    g = grams.select(F.substring("gram", ORDER + 1 - k, k + 1).alias(f"gram{k}"), "a", "b").groupBy(f"gram{k}").agg(F.sum("a").alias(f"a{k}"), F.sum("b").alias(f"b{k}"))
    c = g.groupBy(F.substring(f"gram{k}", 1, k).alias(f"ctx{k}")).agg(F.sum(f"a{k}").alias(f"na{k}"), F.sum(f"b{k}").alias(f"nb{k}"), F.count(F.when(F.col(f"a{k}") > 0, 1)).alias(f"ta{k}"), F.count(F.when(F.col(f"b{k}") > 0, 1)).alias(f"tb{k}"))
    return g, c


def _gram_of(text: Column) -> Column:
    """For each character: it and the ORDER characters before it."""
    padded = F.concat(F.lit(START * ORDER), text)
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def ratios(strings: DataFrame) -> DataFrame:
    """From distinct, not empty strings (s, weight, verdict: allow, block or null): s, ratio (the log10 ratio of both models' probabilities a character).

    Every distinct string counts weight times. Characters are pre-aggregated by string, the model has one row for each
    distinct piece of ORDER + 1 characters, and a piece's strings are spread over SALTS copies of its row.
    """
    pieces = strings.select("s", "verdict", "weight", F.explode(_gram_of(F.col("s"))).alias("gram"))
    grams = written(pieces.groupBy("gram").agg(F.sum(F.when(F.col("verdict") == "allow", F.col("weight")).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", F.col("weight")).otherwise(0)).alias("b")), "grams")
    table, pa, pb = grams.select("gram"), F.lit(1.0 / SYMBOLS), F.lit(1.0 / SYMBOLS)
    for k in range(ORDER + 1):
        g, c = _counts(grams, k)
        table = table.withColumn(f"gram{k}", F.substring("gram", ORDER + 1 - k, k + 1)).withColumn(f"ctx{k}", F.substring("gram", ORDER + 1 - k, k))
        table = table.join(g, f"gram{k}", "left")
        table = table.crossJoin(F.broadcast(c.drop(f"ctx{k}"))) if k == 0 else table.join(c, f"ctx{k}", "left")  # without context: one row
        smooth = lambda n, count, kinds, p: F.when(F.col(n) > 0, (F.col(count) + F.col(kinds) * p) / (F.col(n) + F.col(kinds))).otherwise(p)
        table = table.withColumn("pa", smooth(f"na{k}", f"a{k}", f"ta{k}", pa)).withColumn("pb", smooth(f"nb{k}", f"b{k}", f"tb{k}", pb))
        table = table.select("gram", "pa", "pb")
        pa, pb = F.col("pa"), F.col("pb")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    scores = table.select("gram", F.log10(F.col("pa") / F.col("pb")).alias("r")).select("gram", "r", salts)
    spread = strings.select("s", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(_gram_of(F.col("s"))).alias("gram"))
    return spread.join(scores, ["gram", "salt"]).groupBy("s").agg((F.sum(F.round("r", 12).cast("decimal(28,12)")).cast("double") / F.first(F.length("s"))).alias("ratio"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio; one row for each row of pages.

    A null url, or one without '://', has an empty host and path; such a page fits no rule and is blocked, its ratio is
    null. Where the rules accept or reject nothing at all, there is no model for that class, and what fits no rule is
    allowed. Repeated rows each give a row and each count in the models; null ids stay; other columns are ignored.
    """
    host, path = host_path(F.col("url"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), F.concat("host", "path").alias("s"))
    strings = written(base.where("s <> ''").groupBy("s").agg(F.count("*").alias("weight"), F.max("given").alias("verdict")), "urls")
    found = written(ratios(strings), "ratios")
    of = strings.where("verdict is not null").join(found, "s")
    # calibration: between the classes' means, nearer to the one with less spread
    sums = of.agg(*(f.alias(n + c) for c in ("allow", "block") for n, f in (("m_", F.sum(F.when(F.col("verdict") == c, F.col("ratio") * F.col("weight"))) / F.sum(F.when(F.col("verdict") == c, F.col("weight")))), ("q_", F.sum(F.when(F.col("verdict") == c, F.col("ratio") ** 2 * F.col("weight"))) / F.sum(F.when(F.col("verdict") == c, F.col("weight")))))))
    spread = lambda c: F.sqrt(F.greatest(F.col(f"q_{c}") - F.col(f"m_{c}") ** 2, F.lit(1e-12)))
    cut = sums.select(((F.col("m_allow") * spread("block") + F.col("m_block") * spread("allow")) / (spread("allow") + spread("block"))).alias("cut"))
    out = base.join(found, "s", "left").crossJoin(F.broadcast(cut))  # one row
    method = F.when(F.col("s") == "", "block").when(F.col("cut").isNull() | (F.round("ratio", 9) >= F.round("cut", 9)), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "ratio")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"))


