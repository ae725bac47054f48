"""How filters interact: what each one removes in every order in which they can be applied.

Every document gets a mask, bit i of which says that it fails filter i, by column expressions over its whole text; one filter, copies, compares a document with
the smallest doc_id of its text, which a grouping by the text's digest gives. Masks are counted by part: 32 cells a part for five filters, however many documents there
are. What a filter removes at a place depends only on the set of filters before it, so each part's cells give the 80 pairs of set and filter,
and these give all orders. DataFrame functions only; no text is read twice, and beyond the masks no task sees more than cells.

Null texts are empty, null parts the empty string. Of rows with equal text those of the smallest doc_id are no copies, though they be several; null ids are never copies
and never the smallest. Labels other than 1 and null labels count as none; repeated labels of an id count once (the largest). Parts without removed documents have rows of zeros. An
empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise
from .components import joined_by_parts

#: The letters of the filters; the last is that of copies.
LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
_SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Few words, few distinct words, many capitals, symbols: true where a text fails."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * capitals > MAX_CAPITALS * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part and mask of every row. A narrow table of the rows is written, so that texts are read once."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bits = F.lit(0)
    for i, fails in enumerate(text_failures(F.col("whole"))):
        bits = bits + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("whole"))
    rows = materialise(rows.select("id", "part", F.sha2("whole", 256).alias("digest"), bits.cast("int").alias("bits")))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    held = joined_by_parts(rows, firsts.select("digest", "first"), "digest", F.col("id"), "left")
    copy = F.when(F.col("id") > F.col("first"), F.lit(1 << (len(LETTERS) - 1))).otherwise(F.lit(0))
    return held.select("id", "part", F.col("bits").bitwiseOR(copy).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask, n, good and toxic: documents of each mask, and those among them that are labelled so."""
    known = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.when(F.col(quality) == 1, 1)).alias("good"), F.max(F.when(F.col(toxic) == 1, 1)).alias("toxic"))
    counted = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), counted("good"), counted("toxic"))


def effects(found: DataFrame) -> DataFrame:
    """One row per part, set of filters before (an integer) and filter after it: kept, removed, redundant, unique_fails, good_lost, toxic_lost."""
    pairs = [(before, i) for i in range(len(LETTERS)) for before in range(1 << len(LETTERS)) if not before >> i & 1]
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(i).alias("filter")) for b, i in pairs)))
    mask, before, bit = F.col("mask"), F.col("p.before"), F.expr("shiftleft(1, p.filter)")
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(F.lit(0))).cast("long")
    fails, passed = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) == 0
    here = fails & passed
    return (
        found.withColumn("p", each)
        .groupBy("part", before.alias("before"), F.col("p.filter").alias("filter"))
        .agg(
            total(passed & ~fails).alias("kept"), total(here).alias("removed"), total(fails & ~passed).alias("redundant"),
            total(mask == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        )
    )


def orders(found: DataFrame) -> DataFrame:
    """All orders of the filters with the effect of each step, by part."""
    n = len(LETTERS)
    effect = effects(found)
    # a set of s filters comes before the filter, and the others after it, in s! (n - 1 - s)! orders
    weights = F.array(*(F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)))
    shapley = effect.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.element_at(weights, F.bit_count("before") + 1)).cast("long").alias("shapley"))
    steps = [("".join(o), s + 1, sum(1 << LETTERS.index(c) for c in o[:s]), LETTERS.index(o[s])) for o in permutations(LETTERS) for s in range(n)]
    listed = F.broadcast(found.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int"))  # n! n rows
    return (
        effect.join(shapley, ["part", "filter"]).join(listed, ["before", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def op13_filter_audit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return orders(cells(failure_masks(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first
  from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > first, false)::int as mask
  from d left join l on d.doc_id = l.doc_id),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as b),
o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from f a, f b, f c, f d, f e where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, s.i::int as step, bits[s.i] as bit, coalesce(list_sum(bits[1:s.i - 1]), 0)::int as before from o, range(1, 6) as s(i)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
r as (
  select part, filter_order, step, bit,
    sum(n * (mask & (before | bit) = 0)::int)::bigint as kept, sum(n * (mask & bit != 0 and mask & before = 0)::int)::bigint as removed,
    sum(n * (mask & bit != 0 and mask & before != 0)::int)::bigint as redundant, sum(n * (mask = bit)::int)::bigint as unique_fails,
    sum(good * (mask & bit != 0 and mask & before = 0)::int)::bigint as good_lost, sum(toxic * (mask & bit != 0 and mask & before = 0)::int)::bigint as toxic_lost
  from c, s group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r
"""
