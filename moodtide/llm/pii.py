"""Personal data: fixed forms first, then identifiers that their surroundings give away.

Seeds. E-mail addresses, IP addresses, card and phone numbers are found by the forms below, in each whole text, per kind from left to right without overlap; a
match that fails its test is dropped and nothing is tried in its place. So a card right after a phone number is lost: both
forms read on over the space between them.

Candidates. Words with four digits or more, or with an at sign, their values after `=` or `:`, and up to four such words in a row, as far as they touch no seed. Each occurrence of a seed or candidate
has a shape (digits as 9, letters as a) and contexts: the word before, the two words before, the word after, the words on either side. Words of a context
are lower-cased; those with digits stand by their shape, so that `after a phone number` is a context too.

Patterns. A context with a shape, or a context of two words alone, is a lexical pattern. Spark scores the graph of patterns and instances (distinct identifiers) in rounds: a pattern's confidence
for a kind is the summed score of its distinct instances for that kind over their number plus one, so seeds induce it and candidates of the same pattern that are not (yet) known speak against it. An
instance's score is 1 minus the product of (1 - confidence) over the confident patterns it is met in; seeds keep 1. Only those of at least CONFIDENT
count, and of at least SUPPORT instances. New instances lift further patterns in the next round. After ROUNDS rounds, or when nothing changes, all occurrences of instances with a
score of FOUND or more become spans, if they pass their kind's test as a whole (digits, Luhn, parts up to 255); decoys that fail it stay evidence against a pattern. Where spans
of an occurrence overlap, the higher score wins, then the longer, then the earlier.

Kinds of discovered spans are those of the seeds that induced them. Base spans always stay and none overlaps them. A null or empty text has no
spans. Rows are kept apart by a number of their own, so repeated and null ids are rows like others. Patterns count distinct identifiers, so copies of a document add nothing. Very long words take part by
their shape and digest. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_materialised, materialise
from .components import joined_by_parts

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENT, SUPPORT, FOUND = 4, 0.8, 5, 0.9
#: Words in a row that a candidate has at most, and digits that it has at least.
ROW, DIGITS = 4, 4
#: Words of a context beyond this length stand by their digest.
LONG = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^ \t-\r]+")
_CORE = re.compile(r"[0-9A-Za-z+(](?:.*[0-9A-Za-z)])?", re.DOTALL)
_LETTERS, _NUMBER = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")


def digits_of(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    return sum(map(int, digits[-1::-2])) % 10 == -sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]) % 10


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = digits_of(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 8 <= len(digits_of(s)) <= 15


#: What a whole discovered identifier must be to count as one of a kind. Phone numbers may lack their plus.
_TESTS = {
    "email": lambda s: re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s) is not None,
    "ip": lambda s: _IP.fullmatch(s) is not None and _is_ip(s),
    "card": lambda s: _CARD.fullmatch(s) is not None and _is_card(s),
    "phone": lambda s: re.fullmatch(r"\+?[0-9(][ ().0-9-]*[0-9]", s) is not None and _is_phone(s),
}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """By at signs, so that long runs of letters cost no more than others."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and (c := text[first - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in the order of kinds, then starts."""
    found = [(0, *s) for s in emails(text)]
    for k, form, test in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        found += [(k, *m.span()) for m in form.finditer(text) if test(m[0])]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def shape_of(s: str) -> str:
    """Digits as 9, letters as a; where there are points or at signs, runs of digits as one 9."""
    out = _LETTERS.sub("a", s)
    out = _NUMBER.sub("9", out) if "." in s or "@" in s else _NUMBER.sub(lambda m: "9" * len(m[0]), out)
    return out if len(out) <= LONG else "#" + hashlib.md5(out.encode("utf-8", "surrogatepass")).hexdigest()


def context_word(w: str) -> str:
    if any("0" <= c <= "9" for c in w[:LONG]):
        return shape_of(w)
    return w.lower() if len(w) <= LONG else "#" + hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()


def candidates(text: str, taken: list[tuple[int, int]], words: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first word, last word) of what could be an identifier and touches none of the sorted spans taken."""
    t, row = 0, []
    for i, (a, b) in enumerate(words):
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        free = t == len(taken) or taken[t][0] >= b
        m = _CORE.search(text, a, b) if free else None
        if not m or not any("0" <= c <= "9" or c == "@" for c in m[0]):
            row = []
            continue
        row = [*row[1 - ROW :], (m.start(), m.end(), a, b, i)]
        for first, _, _, _, j in row:
            s = text[first : m.end()]
            if len(digits_of(s)) >= DIGITS or "@" in s:
                yield first, m.end(), j, i
        cut = max(m[0].rfind("="), m[0].rfind(":")) + 1
        if cut and len(digits_of(m[0][cut:])) >= DIGITS and (core := _CORE.search(text, m.start() + cut, m.end())):
            yield core.start(), core.end(), i, i
        if (m.start(), m.end()) != (a, b):  # punctuation ends a row of words
            row = row if m.end() == b else []


def contexts(text: str, words: list[tuple[int, int]], known: dict[int, str], start: int, first: int, last: int) -> list[str]:
    """Contexts by themselves: word before, two before, word after, either side. What a word holds before the identifier (its
    last LONG characters) is its word before. known: the context words so far, by their number."""

    def w(i: int) -> str:
        if not 0 <= i < len(words):
            return "^" if i < 0 else "$"
        if i not in known:
            known[i] = context_word(text[words[i][0] : words[i][1]])
        return known[i]

    inner = text[max(words[first][0], start - LONG) : start]
    before = [w(first - 2), w(first - 1)] if not inner else [w(first - 1), context_word(inner)]
    after = w(last + 1)
    return [f"L\t{before[1]}", f"LL\t{before[0]}\t{before[1]}", f"R\t{after}", f"LR\t{before[1]}\t{after}"]


_SEEN = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("instance", T.LongType()), T.StructField("fits", T.IntegerType()), T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("base", T.StringType()),
])


def _occurrences(text: str) -> tuple[str, list[tuple]]:
    """Base spans joined, and (kind or -1, start, end, instance, kinds whose test it passes as bits, patterns) of seeds and candidates."""
    base = base_spans(text)
    if not base and not any(c in text for c in "0123456789@"):
        return "", []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    rows: list[tuple] = []
    known: dict[int, str] = {}

    def add(kind: int, a: int, b: int, first: int, last: int, fits: int) -> None:
        s, around = text[a:b], contexts(text, words, known, a, first, last)
        shape = shape_of(s)
        patterns = [f"{c}\t{shape}" for c in around]
        if fits or first == last:  # else a row of words is no instance of its own for contexts of any shape
            patterns += [f"{c}\t*" for c in around if c.count("\t") == 2]
        key = digits_of(s) if kind in (2, 3) or kind < 0 and fits & 12 else s.lower()
        rows.append((kind, a, b, xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63), fits, patterns))

    for k, a, b in base:
        add(k, a, b, bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1, 1 << k)
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(base, key=lambda x: x[1:]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for a, b, first, last in candidates(text, taken, words):
        add(-1, a, b, first, last, sum(1 << k for k, name in enumerate(KINDS) if _TESTS[name](text[a:b])))
    return joined(base), rows


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document (kind null; base: its base spans) and per occurrence of a seed (kind) or candidate (kind -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                base, found = _occurrences(t.as_py() or "")
                rows.append((row, i, None, None, None, None, None, None, base))
                rows += [(row, None, *x, None) for x in found]
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("fits", pa.int32()), ("patterns", pa.list_(pa.string())), ("base", pa.string())])
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SEEN)


def discovered(seen: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT, found: float = FOUND) -> tuple[DataFrame, DataFrame]:
    """Scores of new instances (instance, kind, score), and the last round's confident patterns (pattern, kind, confidence, n)."""
    spots = seen.filter("kind is not null")
    edges = materialise(spots.select("instance", F.explode("patterns").alias("text")).select("instance", F.xxhash64("text").alias("pattern"), "text").groupBy("instance", "pattern").agg(F.min("text").alias("text")))
    # an instance is of one kind: that of its seeds, if it is a seed anywhere, else one whose test it passes
    nodes = spots.groupBy("instance").agg(F.max("kind").alias("seed"), F.max("fits").alias("fits"))
    nodes = materialise(nodes)
    sizes = materialise(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.min("text").alias("text")).filter(F.col("n") >= support))
    # patterns with too few instances take no further part
    edges2 = materialise(joined_by_parts(edges.select("instance", "pattern"), sizes.select("pattern", "n"), "pattern", F.col("instance")))
    drop_materialised(edges)
    scores = materialise(nodes.filter("seed >= 0").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")))
    open_ = materialise(nodes.filter("seed < 0 and fits > 0").select("instance", "fits"))
    before = None
    for _ in range(rounds):
        voted = edges2.join(scores, "instance").groupBy("pattern", "kind").agg(F.round(F.sum("score") / (F.max("n") + 1), 9).alias("confidence"), F.max("n").alias("n"), F.count("*").alias("known"))
        sure = materialise(voted.filter((F.col("confidence") >= confident) & (F.col("known") >= support)))
        reached = joined_by_parts(edges2.join(open_, "instance").select("instance", "fits", "pattern"), sure, "pattern", F.col("instance"))
        fits = F.col("fits").bitwiseAND(F.expr("shiftleft(1, kind)")) != 0
        product = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))
        new = reached.filter(fits).groupBy("instance", "kind").agg(F.round(1 - product, 9).alias("score")).filter(F.col("score") >= found)
        best = new.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).select("instance", (-F.col("b.col2")).cast("int").alias("kind"), F.col("b.score").alias("score"))
        after = materialise(nodes.filter("seed >= 0").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).unionByName(best))
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("instance", "kind", "score").cast("decimal(38,0)"))).first()
        drop_materialised(scores)
        scores = after
        if mark == before:
            break
        before = mark
    extra = scores.join(open_.select("instance"), "instance", "left_semi")
    return extra, sure.join(sizes.select("pattern", "text"), "pattern")


def _merged(base: pa.Array, extra: pa.Array) -> pa.Array:
    """All spans of each document, joined: base ones, and of the discovered ones those that overlap nothing better."""
    out = []
    for b, e in zip(base.to_pylist(), extra.to_pylist()):
        spans = [(KINDS.index(k), int(s), int(t)) for k, s, t in (x.split(":") for x in (b or "").split(",") if x)]
        chosen: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for x in sorted(e or [], key=lambda x: (-x["score"], x["start"] - x["end"], x["start"], x["kind"])):
            i = bisect_left(taken, (x["start"], x["end"]))
            if (i and taken[i - 1][1] > x["start"]) or (i < len(taken) and taken[i][0] < x["end"]):
                continue
            insort(taken, (x["start"], x["end"]))
            chosen.append((x["kind"], x["start"], x["end"]))
        out.append(joined(sorted(spans + chosen)) if chosen else b or "")
    return pa.array(out, pa.string())


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, base (base spans joined), n_<kind> and spans (all spans joined) of every row."""
    seen = materialise(occurrences(docs, doc_id, text))
    new, _ = discovered(seen, **how)
    open_ = seen.filter("kind = -1").select("row", "start", "end", "instance")
    placed = joined_by_parts(open_, new, "instance", F.col("row"))
    extra = placed.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("extra"))
    rows = seen.filter("kind is null").select("row", F.col("doc_id").alias(doc_id), "base")
    # spans hold no letters but their kind's name, which is in no other kind's
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.arrow_udf(_merged, "string")("base", "extra")
    return rows.join(extra, "row", "left").select(doc_id, "base", *counts, F.when(F.col("extra").isNull(), F.col("base")).otherwise(spans).alias("spans"))


def op12_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
