"""Chat formatting (method: cumulative-snapshot collapse). Built-in functions only.

Loggers often write a conversation again after every turn. A hash of each conversation's first k turns, rolling over
the turns, shows which whole conversations are such a beginning of a longer one; an anti-join keeps the maximal ones,
of equal ones that of the smallest id; those are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import read, written

#: Turns of a conversation that are rendered, and whose hashes are rolled, in one group; longer conversations have several parts.
PART = 256
#: The template's fixed marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place k in the conversation (from 1), the running sums h1 to h4 of their hashes up to k, and n, the conversation's turns.

    Order: turn, role, text, nulls first. The sums run within parts of the turn numbers and over the parts' totals, so
    a very long conversation is spread over tasks.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null").distinct()
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 62))))
    t = written(t, "turns")
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    sizes = t.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    placed = t.join(before, ["conv_id", "part"]).withColumn("k", F.row_number().over(within) + F.col("before"))
    # the hash of a turn tells its place too, so sums of hashes tell sequences apart; 32 bits each, so that sums don't overflow
    a, b = F.xxhash64("k", turn_text(F.col("role"), F.col("text"))), F.xxhash64(F.lit("second"), turn_text(F.col("role"), F.col("text")), "k")
    low, high = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)
    hashed = written(placed.select("conv_id", "part", "k", "role", "text", low(a).alias("x1"), high(a).alias("x2"), low(b).alias("x3"), high(b).alias("x4")), "hashed-turns")
    totals = hashed.groupBy("conv_id", "part").agg(F.count("*").alias("size"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(1, 5)))
    carried = totals.select("conv_id", "part", F.sum("size").over(Window.partitionBy("conv_id")).alias("n"), *(F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in range(1, 5)))
    rolling = Window.partitionBy("conv_id", "part").orderBy("k")
    return hashed.join(carried, ["conv_id", "part"]).select("conv_id", "part", "k", "n", "role", "text", *((F.sum(f"x{i}").over(rolling) + F.col(f"s{i}")).alias(f"h{i}") for i in range(1, 5)))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay, from numbered() rows."""
    hashes = [f"h{i}" for i in range(1, 5)]
    whole = rows.where("k = n").groupBy("k", *hashes).agg(F.min("conv_id").alias("conv_id"))
    begun = rows.where("k < n").select("k", *hashes).distinct()
    return whole.join(begun, ["k", *hashes], "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, part (from 0), n_parts, text: the maximal conversations by the template, PART turn numbers to a part.

    Joined in order, a conversation's parts are its text. Rows that repeat a turn exactly count once; turns of equal
    number are ordered by role and text; null roles and texts render as empty; turns without a number come first; rows
    without a conv_id belong to no conversation and are left out. Other columns are ignored; no rows give no rows.
    """
    rows = written(numbered(turns), "numbered-turns")
    kept = written(maximal(rows), "maximal")
    one = F.struct("k", turn_text(F.col("role"), F.col("text")).alias("t"))
    # a part holds PART turn numbers, so groups are bounded unless turns repeat their number
    parts = rows.join(kept, "conv_id").withColumn("slice", F.floor((F.col("k") - 1) / PART)).groupBy("conv_id", "n_turns", "slice").agg(F.sort_array(F.collect_list(one)).alias("l"))
    return parts.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("slice").alias("part"), F.ceil(F.col("n_turns") / PART).alias("n_parts"), F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(read(spark, sf_dir, "conversations"))


SQL = f"""
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
k as (select *, row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) as k from t),
c as (select conv_id, list('{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) order by k) as l, count(*) as n from k group by conv_id),
p as (select distinct list_slice(c.l, 1, i.i) as l from c, range(1, 10000) i(i) where i.i < c.n),
w as (select l, n, min(conv_id) as conv_id from c group by l, n),
m as (select w.* from w anti join p on w.l = p.l)
select conv_id, cast(n as bigint) as n_turns, cast(s.s as bigint) as part, cast(ceil(n / {PART}.0) as bigint) as n_parts,
 array_to_string(list_slice(l, s.s * {PART} + 1, (s.s + 1) * {PART}), '') as text
from m, range(0, 100) s(s) where s.s * {PART} < n
"""
