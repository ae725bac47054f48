"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources get shares of a total in proportion to their weights, none more than `max_epochs` times its size:
sources above that are clamped to it and what they leave is shared among the others, again until none is
above. A source is then repeated as often as its share asks: every document floor(target / size) times, and a
seeded random subset once more, which is taken in the order of a hash of the document, up to the size that is
still missing (the last document goes in if that comes nearer). So each source's total misses its target by
at most half of one document, and reruns agree.

The subset ends at one hash per source. That bound is found digit by digit: sums over (source, next digit of
the hash) tell the digit in which the bound lies; no task sees a whole source. Per iteration of the water-filling the
driver gets one row. Null sources are a source of their own, after all others; null texts have size zero. Rows that are equal in id
and text share a hash; where the subset ends among them, as many go in as come nearest, whichever they are. Empty tables give no rows. Sources of size zero take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Weights of sources by their order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, 17
#: The search for a source's last hash goes down LEVELS times by DIGIT bits; what is then left of 10^12 documents is some 10^3.
DIGIT, LEVELS = 10, 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with `number` (from 0) in the given order: rows are sorted over all tasks, counted by task, and
    numbered from the sums of the counts before, so that no task sees all rows."""
    ids = materialise(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = ids.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(counts.select(F.col("__part").alias("__at"), before.alias("__before")))  # one row per task of the sort
    return ids.join(first, part == F.col("__at")).withColumn("number", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__at", "__before")


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """sources(weight, cap) with `target`: min(cap, level * weight), where the level makes the targets sum to
    total. Each round clamps the sources above the level of the last one, which only raises it."""
    level = 0.0
    while True:
        clamped = F.col("weight") * F.lit(level) >= F.col("cap")
        row = sources.agg(F.sum(F.when(clamped, F.col("cap"))).alias("c"), F.sum(F.when(~clamped, F.col("weight"))).alias("w"), F.sum(F.when(clamped, 1)).alias("n")).first()
        rest = total - float(row.c or 0)
        raised = rest / float(row.w) if row.w else level
        if raised <= level or not row.w:
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)))


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, weights, share: float, max_epochs: float, seed: int, keep: list[str]) -> DataFrame:
    """__doc, __source, size, source_size, target, copies and __keep_<c> for each kept column."""
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).bitwiseAND((1 << 63) - 1)
    sized = materialise(docs.select(F.col(doc_id).alias("__doc"), F.col(source).alias("__source"), n_words(F.col(text)).alias("size"), hashed.alias("__hash"), *(F.col(f"`{c}`").alias(f"__keep_{c}") for c in keep)))
    sizes = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    by_weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    listed = materialise(numbered(sizes, F.col("__source").asc_nulls_last()).withColumn("weight", by_weight).withColumn("cap", F.col("source_size") * max_epochs))
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = water_fill(listed, share * total).withColumn("whole", whole)
    goal = materialise(goal.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")))
    edge = goal.filter("missing > 0").select(F.col("__source").alias("s"), "missing", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS + 1):
        inside = sized.join(edge, F.col("__source").eqNullSafe(F.col("s")) & (F.shiftright("__hash", 63 - DIGIT * level) == F.col("edge")))
        if level == LEVELS:
            break
        sums = inside.groupBy("__source", "missing", "before", F.shiftright("__hash", 63 - DIGIT * (level + 1)).alias("at")).agg(F.sum("size").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("__source").orderBy("at"))
        edge = sums.withColumn("upto", upto).filter((F.col("upto") - F.col("n") < F.col("missing")) & (F.col("upto") >= F.col("missing")))
        edge = materialise(edge.select(F.col("__source").alias("s"), "missing", F.col("at").alias("edge"), (F.col("upto") - F.col("n")).alias("before")))
    tied = inside.groupBy("__source", "__hash", "before", "missing").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    run = F.col("before") + F.sum("n").over(Window.partitionBy("__source").orderBy("__hash"))
    fits = F.col("run") <= F.col("missing")
    # the first hash that doesn't fit as a whole is that of one document, or of equal rows, of which as many go in as come nearest
    share = F.floor((F.col("missing") - F.col("run") + F.col("n")) / F.when(F.col("n") > 0, F.col("n") / F.col("k")) + 0.5)
    bound = (
        tied.withColumn("run", run)
        .groupBy("__source").agg(F.max(F.when(fits, F.col("__hash"))).alias("last"), F.min("__hash").alias("first"), F.min_by(F.struct(F.col("__hash").alias("hash"), "k", share.alias("m")), F.when(~fits, F.col("__hash"))).alias("part"))
        .select(F.col("__source").alias("s2"), F.coalesce("last", F.col("first") - 1).alias("last"), F.col("part.hash").alias("part"), F.col("part.k").alias("k"), F.col("part.m").alias("m"))
    )
    # written out, so that Spark knows its size when it chooses how to join the documents with it
    plan = materialise(goal.join(bound, F.col("__source").eqNullSafe(F.col("s2")), "left").select(F.col("__source").alias("s"), "source_size", "target", "whole", "last", "part", "k", "m"))
    joined = sized.join(plan, F.col("__source").eqNullSafe(F.col("s")))
    at_part = F.coalesce(F.col("__hash") == F.col("part"), F.lit(False))
    below = F.coalesce(F.col("__hash") <= F.col("last"), F.lit(False))
    wanted = ["__doc", "__source", *(f"`__keep_{c}`" for c in keep), "size", "source_size", "target"]
    if plan.filter("k > 1").isEmpty():
        return joined.select(*wanted, (F.col("whole") + (below | at_part & (F.col("m") > 0)).cast("int")).alias("copies"))
    many = at_part & (F.col("k") > 1)
    # the rows of such a group are numbered over all tasks, so that none sees the group
    apart = numbered(joined.filter(many).withColumn("__tie", F.monotonically_increasing_id()), F.col("__source").asc_nulls_last(), F.col("__tie"))
    begin = materialise(apart.groupBy("__source").agg(F.min("number").alias("__begin")).withColumnRenamed("__source", "__of"))
    apart = apart.join(begin, F.col("__source").eqNullSafe(F.col("__of"))).select(*wanted, (F.col("whole") + (F.col("number") - F.col("__begin") < F.col("m")).cast("int")).alias("copies"))
    return joined.filter(~many).select(*wanted, (F.col("whole") + (below | at_part & (F.col("m") > 0)).cast("int")).alias("copies")).unionByName(apart)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix holds the document), and the columns
    named by keep but those with one of these names."""
    own = (doc_id, source, "size", "source_size", "target", "copies")
    keep = [c for c in keep if c not in own]
    found = _mixed(docs, doc_id, text, source, weights, share, max_epochs, seed, keep)
    return found.select(F.col("__doc").alias(doc_id), F.col("__source").alias(source), *own[2:], *(F.col(f"`__keep_{c}`").alias(c) for c in keep))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs with their own columns, as often as the mix holds them."""
    found = _mixed(docs, doc_id, text, source, weights, share, max_epochs, seed, docs.columns)
    copies = found.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*(F.col(f"`__keep_{c}`").alias(c) for c in docs.columns))


def op9_mixing_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
