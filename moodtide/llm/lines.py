"""Deleting repeated runs of lines by a suffix array over line ids; DataFrame functions only.

The lines of all documents (split at \\n) are one sequence of ids with an end after each document. The suffix array of the positions whose line occurs
again is built by distributed prefix doubling: a position has a path, at first its line's hash; each round pairs it with the path of the position 2^j lines further and a distributed
sort of the distinct pairs gives the rank that extends it. Positions whose rank is unique, or after whose 2^j lines the document or the repeats end, are settled;
rounds go on until all are. Sorting by paths is then the order of the suffixes, and equal paths up to round j mean 2^j common lines.

The longest common prefix of neighbours comes from these ranks: the last round in which they agree gives its highest binary digit, the same question 2^j lines further
the next one, as far as the bound asked for needs it. Neighbours with a prefix of m lines or more make up intervals, each one the copies of a run of m lines. They overlap to maximal runs:
a position whose longest earlier match has k >= m lines starts k - m + 1 of them, which cover it. So `min_lines` is a filter on runs, whatever their length.

A run counts if it has at least `min_lines` lines, or if one of its lines alone has at least `min_words` words.
The copy at the smallest (document id, line) is kept, all later ones are deleted, within a document too. A run of one
line may overlap nothing; longer runs may overlap their own copies. Lines keep their order; blank lines go only within longer runs.

Null texts stay null. Empty texts have one blank line. Rows that are equal in id and text count as one document and keep the same lines.
Rows of equal id and different texts are told apart by a hash of the text. An empty table gives no rows. No task holds all copies of a line: groups are found by
partial sums, and what is known of a line or an interval goes to its members in parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_materialised, materialise
from .components import joined_by_parts

MIN_LINES, MIN_WORDS = 2, 5


def line_positions(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """One row per line: `at` (document id, text's hash, line number), two hashes and whether it counts alone."""
    line = F.col("line")
    return docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("n", "line")).select(
        F.struct("d", "h", "n").alias("at"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), (F.regexp_count(line, F.lit(WORD)) >= min_words).alias("alone")
    )


def repeated_lines(lines: DataFrame) -> DataFrame:
    """d, h, n, alone and path (of two hashes) of every line that occurs at two positions or more, each position once."""
    groups = lines.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").select("a", "b")
    found = joined_by_parts(lines, groups, ["a", "b"], F.col("at")).select("at.d", "at.h", "at.n", F.array("a", "b").alias("path"), "alone")
    return found.repartition("d", "h").dropDuplicates(["d", "h", "n"])


def suffix_array(repeated: DataFrame) -> DataFrame:
    """d, h, n, alone, path and `id`, rising in the order of the suffixes."""
    settled, step = [], 1
    now, ranks = repeated.withColumn("open", F.lit(True)), None
    doc = Window.partitionBy("d", "h")
    while True:
        further = F.first("path").over(doc.orderBy("n").rangeBetween(step, step))
        seen = materialise(now.withColumn("going", F.bool_or("open").over(doc)).withColumn("further", F.when(F.col("open"), further)))
        if ranks is not None:
            drop_materialised(ranks)
        settled.append(seen.filter("not going").select("d", "h", "n", "alone", "path"))
        if seen.filter("going").isEmpty():
            break
        pairs = seen.filter("open and further is not null").groupBy("path", "further").agg(F.count("*").alias("members"))
        ranks = materialise(pairs.orderBy("path", "further").withColumn("rank", F.monotonically_increasing_id()))
        # what ends here comes first, in any order
        end = -F.xxhash64("d", "h", "n").bitwiseAND((1 << 63) - 1) - 1
        longer = F.when(F.col("open"), F.concat("path", F.array(F.coalesce("rank", end)))).otherwise(F.col("path"))
        now = seen.filter("going").join(ranks, ["path", "further"], "left").select("d", "h", "n", "alone", longer.alias("path"), F.coalesce(F.col("members") > 1, F.lit(False)).alias("open"))
        step *= 2
    return materialise(reduce(DataFrame.union, settled).orderBy("path").withColumn("id", F.monotonically_increasing_id()))


def common_round(p: Column, q: Column) -> Column:
    """The last round j in which two paths agree, that is, 2^j lines in common; -1 if their lines differ or one is missing."""
    differ = F.array_position(F.zip_with(p, q, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    return F.coalesce(F.when(differ > 2, differ - 3), F.lit(-1))


def lines_of(j: Column) -> Column:
    return F.when(j >= 0, F.pow(F.lit(2.0), j)).otherwise(0).cast("int")


def neighbours(suffixes: DataFrame, min_lines: int) -> DataFrame:
    """d, h, n, alone, id and lcp of every suffix: the lines it has in common with the one before it, exact where that decides whether they are min_lines or more."""
    part = F.shiftright("id", 33).alias("part")
    here = F.struct("d", "h", "n", "path")
    ends = suffixes.groupBy(part).agg(F.max_by(here, "id").alias("last"))  # one row per task of the sort
    border = ends.select(F.col("part").alias("at_part"), F.lag("last").over(Window.orderBy("part")).alias("border"))
    before = F.coalesce(F.lag(here).over(Window.partitionBy("part").orderBy("id")), F.col("border"))
    pairs = suffixes.withColumn("part", part).join(F.broadcast(border), F.col("part") == F.col("at_part")).withColumn("before", before)
    pairs = pairs.withColumn("j", common_round(F.col("path"), F.col("before.path"))).withColumn("lcp", lines_of(F.col("j")))
    pairs = pairs.select("d", "h", "n", "alone", "id", "part", F.struct("before.d", "before.h", "before.n").alias("before"), "j", "lcp")
    open_ = (F.col("j") > 0) & (F.col("lcp") < min_lines) & (F.col("lcp") + lines_of(F.col("j")) > min_lines)
    paths = suffixes.select(F.struct("d", "h", "n").alias("place"), "path")
    # between powers of two of lines the next digits of the prefix decide
    while min_lines & (min_lines - 1):
        pairs = materialise(pairs)
        some = pairs.filter(open_)
        if some.isEmpty():
            break
        one, two = F.struct("d", "h", (F.col("n") + F.col("lcp")).alias("n")), F.struct("before.d", "before.h", (F.col("before.n") + F.col("lcp")).alias("n"))
        asked = some.withColumn("one", one).withColumn("two", two)
        asked = asked.join(paths.select(F.col("place").alias("one"), F.col("path").alias("p")), "one", "left").join(paths.select(F.col("place").alias("two"), F.col("path").alias("q")), "two", "left")
        asked = asked.withColumn("j", common_round(F.col("p"), F.col("q"))).withColumn("lcp", F.col("lcp") + lines_of(F.col("j"))).select(*pairs.columns)
        pairs = pairs.filter(~open_).union(asked)
    return materialise(pairs.drop("before", "j"))


def interval_copies(linked: DataFrame, m: int) -> DataFrame:
    """d, h, n, alone of every suffix that has an earlier one (by d, h, n) in its interval of common prefixes of m lines or more."""
    order = Window.partitionBy("part").orderBy("id")
    starts = (F.col("lcp") < m).cast("long")
    totals = linked.groupBy("part").agg(F.sum(starts).alias("n_starts"))  # one row per task of the sort
    offset = totals.select(F.col("part").alias("at_part"), (F.sum("n_starts").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_starts")).alias("offset"))
    running = F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = linked.withColumn("running", running).join(F.broadcast(offset), F.col("part") == F.col("at_part")).withColumn("interval", F.col("offset") + F.col("running"))
    numbered = materialise(numbered.select("d", "h", "n", "alone", "id", "interval"))
    here = F.struct("d", "h", "n")
    firsts = numbered.groupBy("interval").agg(F.min(here).alias("first"), F.count("*").alias("members")).filter("members > 1").select("interval", "first")
    return joined_by_parts(numbered, firsts, "interval", F.col("id")).filter(F.col("first") < here).select("d", "h", "n", "alone")


def later_copies(lines: DataFrame, min_lines: int) -> DataFrame:
    """d, h, n of every line that is part of a later copy of a run that counts."""
    linked = neighbours(suffix_array(repeated_lines(lines)), min_lines)
    single = interval_copies(linked, 1).filter("alone").select("d", "h", "n")
    runs = interval_copies(linked, min_lines)
    covered = runs.select("d", "h", F.explode(F.sequence("n", F.col("n") + min_lines - 1)).alias("n"))
    return single.union(covered)


def maximal_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first and last line (from 0) of every maximal run that is a later copy."""
    lines = materialise(line_positions(docs, doc_id, text, min_words))
    gone = later_copies(lines, min_lines).distinct()
    place = F.row_number().over(Window.partitionBy("d", "h").orderBy("n"))
    return gone.withColumn("run", F.col("n") - place).groupBy("d", "h", "run").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line")).select(F.col("d").alias(doc_id), "first_line", "last_line")


def without(text: Column, gone: Column) -> Column:
    """The text without the lines whose numbers (from 0) are in `gone`."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), gone)
    return F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))[0]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the remaining text in place of theirs and `n_lines`, `n_deleted` added; columns of docs with these names go."""
    lines = materialise(line_positions(docs, doc_id, text, min_words))
    gone = later_copies(lines, min_lines).groupBy(F.struct("d", "h").alias("__key")).agg(F.collect_set("n").alias("__gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), F.struct(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h")).alias("__key"))
    joined = keyed.join(gone, "__key", "left")
    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(without(F.col(text), F.col("__gone")))
    return joined.select(
        *(left.alias(c) if c == text else F.col(f"`{c}`") for c in names),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )


def op7_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_deleted")


ORACLE = rf"""
with lines as (
  select doc_id, unnest(range(len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line
  from documents where text is not null),
pairs as (select *, lead(line) over (partition by doc_id order by n) as line2 from lines),
flagged as (
  select *, row_number() over (partition by line order by doc_id, n) > 1 and len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) >= {MIN_WORDS} as one,
    line2 is not null and row_number() over (partition by line, line2 order by doc_id, n) > 1 as two
  from pairs),
marked as (select *, one or two or coalesce(lag(two) over (partition by doc_id order by n), false) as gone from flagged),
left_over as (
  select doc_id, coalesce(string_agg(line, chr(10) order by n) filter (not gone), '') as text, count(*) as n_lines, count(*) filter (gone) as n_deleted
  from marked group by doc_id)
select d.doc_id, l.text, coalesce(l.n_lines, 0) as n_lines, coalesce(l.n_deleted, 0) as n_deleted
from documents d left join left_over l on d.doc_id = l.doc_id
"""
