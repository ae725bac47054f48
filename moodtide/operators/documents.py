"""Nested documents: walked to any depth, searched for names that must not occur, and put into canonical text.

A document is a VARIANT. Each round opens the containers of one level (variant_explode), until there are none; the number of rounds is the
depth of the deepest document, whatever the number of documents. Rows are spread by documents and by what they hold. Each level is a table of
its own, so that what asks for a level or for names reads no more than these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored

#: Names that canonical text refuses.
DANGEROUS = ("__proto__", "constructor", "prototype")


def nodes(docs: DataFrame, keys: list[str], text: str = "text", root: str = "$") -> DataFrame:
    """keys, path, parent (null: the root), level, place, name (of an object's field), kind (object, array, value), value (a variant): every value in every document.
    Texts that are no JSON, and ones in which an object repeats a name, have a row of kind null."""
    spark = docs.sparkSession
    kind = F.when(F.col("value").startswith("{"), "object").when(F.col("value").startswith("["), "array").otherwise("value")

    def kept(level: int, rows: DataFrame) -> DataFrame:
        """The rows of a level, with the level as a constant."""
        columns = ("path", "parent", "place", "name", "kind", "value")
        return stored(rows.select(*keys, *columns)).select(*keys, "path", "parent", F.lit(level).alias("level"), *columns[2:])

    now = docs.select(*keys, F.to_json(F.try_parse_json(text)).alias("value"))
    now = kept(0, now.select(*keys, F.lit(root).alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("name"), F.when(F.col("value").isNotNull(), kind).alias("kind"), "value"))
    done, level = now, 0
    while not now.filter("kind in ('object', 'array')").isEmpty():
        level += 1
        held = now.filter("kind in ('object', 'array')").select(*keys, F.col("path").alias("parent"), F.parse_json("value").alias("v"))
        opened = held.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        path = F.when(F.col("key").isNull(), F.concat("parent", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("parent", F.lit("."), F.col("key")))
        opened = opened.select(*keys, path.alias("path"), "parent", F.col("pos").alias("place"), F.col("key").alias("name"), F.to_json("value").alias("value"))
        now = kept(level, opened.withColumn("kind", kind))
        done = done.unionByName(now)
    return done


def forbidden(found: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """keys, path, name of fields with one of the names, at any depth. found: of nodes()."""
    return found.filter(F.col("name").isin(*names)).select(*keys, "path", "name")


def canonical(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, digest, problem: each document with the names of every object in order of their code points, no white space, numbers in their shortest form, and its SHA-256.
    No text where the document is no JSON, or holds a dangerous name. found: of nodes().

    Texts are put together from the deepest level up, by merge joins: compressed tables of texts are many times larger in memory than Spark takes them to be. Numbers: whole ones without a point (-0 is 0), others as doubles."""
    plain = F.try_to_number(F.col("value"), F.lit("S999999999999999999")).cast("string")
    number = F.when(F.col("value").rlike(r"^-?0(\.0+)?([eE].*)?$"), "0").when(F.col("value").rlike(r"^-?[0-9]{1,18}$"), plain).when(F.col("value").rlike(r"^-?[0-9]"), F.regexp_replace(F.col("value").cast("double").cast("string"), r"\.0$", ""))
    leaf = F.when(F.col("kind") == "value", F.coalesce(number, F.col("value")))
    level = found.filter("kind is not null").agg(F.max("level")).first()[0]
    texts = None
    for depth in range(level if level is not None else -1, -1, -1):
        here = found.filter((F.col("level") == depth) & F.col("kind").isNotNull()).select(*keys, "path", "parent", "place", "name", "kind", leaf.alias("leaf"))
        if texts is not None:
            quoted = F.to_json(F.to_variant_object(F.array("name")))  # in brackets
            part = F.when(F.col("name").isNull(), F.col("text")).otherwise(F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), "text"))
            inner = F.array_sort(F.collect_list(F.struct(F.coalesce("name", F.lpad(F.col("place").cast("string"), 12, "0")).alias("k"), F.col("part").alias("t"))))
            listed = texts.withColumn("part", part).groupBy(*keys, F.col("parent").alias("path")).agg(inner.alias("parts"))
            here = here.join(listed.hint("merge"), [*keys, "path"], "left")
            body = F.coalesce(F.array_join(F.transform("parts", lambda p: p["t"]), ","), F.lit(""))
        else:
            body = F.lit("")
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), body, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.col("leaf"))
        texts = here.select(*keys, "path", "parent", "place", "name", whole.alias("text"))
        if depth:
            texts = stored(texts)
    bad = found.filter(F.col("name").isin(*DANGEROUS)).select(*keys).distinct().withColumn("_bad", F.lit(True))
    every = found.filter("level = 0").select(*keys, F.col("kind").isNull().alias("_none")).join(bad, keys, "left")
    if texts is None:
        texts = every.select(*keys, F.lit(None).cast("string").alias("text"))
    out = every.join(texts.select(*keys, "text").hint("merge"), keys, "left")
    problem = F.when(F.col("_none"), "no JSON").when(F.col("_bad"), "dangerous name")
    text = F.when(problem.isNull(), F.col("text"))
    return out.select(*keys, text.alias("text"), F.sha2(text, 256).alias("digest"), problem.alias("problem"))
