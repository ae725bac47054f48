"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one integer whose bit i
says that rule i failed. A policy is a named, versioned set of rules, hence an integer too, so that
applying a policy is `bits & policy`, and ablations are bitwise aggregates over the ledger alone: no text
is read again when a policy changes.

A null or empty text has no words and zero in every measurement. Equal rows get equal entries. Measuring
is done in one pass over each whole text by an Arrow function; everything after it is built-in functions.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE

SYMBOLS = "#*$%&|<>"
MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_top_word", "n_alpha_words")])


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window found twice or more, the first time included."""
    grams = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total = until = 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + window - max(i, until)
            until = i + window
    return total


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        max(Counter(words).values(), default=0),
        sum(w[:1].isalpha() or w[0] > 127 for w in words),
    )


def _measures(texts: pa.Array) -> pa.Array:
    rows = [measure_text(x.as_py()) for x in texts]
    columns = zip(*rows) if rows else [[] for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES.names)


def measures(text: Column) -> Column:
    """A struct of measurements; marked non-deterministic only so that Spark evaluates it once a row."""
    return F.arrow_udf(_measures, MEASURES).asNondeterministic()(text)


@dataclass(frozen=True)
class Rule:
    """fails: over the measurements, true where a document fails the rule. Bits never change meaning."""

    bit: int
    name: str
    fails: Column | None = None


def rules(m: str = "m") -> list[Rule]:
    c = lambda x: F.col(f"{m}.{x}")
    return [
        Rule(0, "few_words", c("n_words") < 50),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule(2, "symbols", 10 * c("n_symbols") > c("n_words")),
        Rule(3, "repeated_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule(4, "short_words", c("word_chars") < 2 * c("n_words")),
        Rule(5, "long_words", c("word_chars") > 15 * c("n_words")),
        Rule(6, "one_word", 100 * c("n_top_word") > 40 * c("n_words")),
        Rule(7, "few_alphabetic_words", 100 * c("n_alpha_words") < 60 * c("n_words")),
    ]


#: Versioned policies: the bits of the rules that reject a document.
POLICIES = {"base": 0b11, "v1": 0b11111111}


def ledger(docs: DataFrame, text: str = "text", m: str = "m", bits: str = "failed_bits") -> DataFrame:
    """docs with `m` (measurements) and `failed_bits` (long) added, or as they are named; columns of docs with these names go."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (m, bits)]
    out = docs.select(*kept, measures(F.col(text)).alias(m))
    failed = F.lit(0).cast("long")
    for r in rules(m):
        failed = failed.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn(bits, failed)


def passes(policy: str = "v1", bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = "v1", bits: str = "failed_bits") -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it rejects, and that the policy
    without it would keep. Distinct bit patterns are counted first, so at most 2^rules rows go further."""
    mask = POLICIES[policy]
    patterns = entries.groupBy(F.col(bits).bitwiseAND(F.lit(mask).cast("long")).alias("p")).agg(F.count("*").alias("n"))
    used = [r for r in rules() if mask >> r.bit & 1]
    named = F.explode(F.array(*(F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule")) for r in used)))
    one = F.expr("shiftleft(1L, r.bit)")
    return (
        patterns.select("p", "n", named.alias("r"))
        .groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("p").bitwiseAND(one) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("p") == one, F.col("n"))), F.lit(0)).alias("n_only_this"),
            F.coalesce(F.sum(F.when(F.col("p").bitwiseAND(F.expr("~shiftleft(1L, r.bit)")) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
    )


def keep_good(docs: DataFrame, text: str = "text", policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    return ledger(docs, text, "__m", "__bits").filter(passes(policy, "__bits")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_quality_rules(spark, sf_dir):
    """Every document's measurements and verdict; base_failed is policy `base`, kept is policy `v1`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id", *(F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed_bits"
    )


ORACLE = r"""
with split as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as words,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \t\n\x0B\f\r]')] as lines
  from documents),
grams as (select doc_id, unnest(range(len(words) - 2)) as i, unnest([words[k:k + 2] for k in range(1, len(words) - 1)]) as g from split where len(words) > 2),
found as (select doc_id, i, count(*) over (partition by doc_id, g) > 1 as twice from grams),
covered as (select doc_id, count(distinct i + d) as n_repeat_words from found, range(3) as t(d) where twice group by doc_id),
tops as (select doc_id, max(n) as n_top_word from (select doc_id, w, count(*) as n from (select doc_id, unnest(words) as w from split) group by doc_id, w) group by doc_id),
measured as (
  select s.doc_id, len(words) as n_words, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(c.n_repeat_words, 0) as n_repeat_words, coalesce(t.n_top_word, 0) as n_top_word,
    len([w for w in words if regexp_matches(w, '^[^\x00-@\[-`{-\x7F]')]) as n_alpha_words
  from split s left join covered c on s.doc_id = c.doc_id left join tops t on s.doc_id = t.doc_id),
judged as (
  select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > n_words)::int + 8 * (100 * n_dup_lines > 50 * n_lines)::int
    + 16 * (word_chars < 2 * n_words)::int + 32 * (word_chars > 15 * n_words)::int + 64 * (100 * n_top_word > 40 * n_words)::int + 128 * (100 * n_alpha_words < 60 * n_words)::int as failed_bits
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 != 0 as base_failed, failed_bits = 0 as kept, failed_bits::bigint as failed_bits
from judged
"""
