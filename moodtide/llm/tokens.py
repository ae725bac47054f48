"""Token counts and token ids of whole texts by public tokenizer files.

Texts go through Arrow functions in blocks balanced by bytes: texts are gathered until they have BLOCK_BYTES, and what is missing for all of them is encoded by the library
together, in calls of BLOCK_BYTES. Texts longer than CUT_BYTES are split at safe boundaries first: between a letter and
a space before a letter, or a letter and a punctuation mark, whatever the script, where every one of the supported splits cuts as well and no special string can lie.
A tokenizer splits a text into pieces before it merges characters, and it encodes each piece alone; so a piece that was encoded once need not be
encoded again. Each Python worker keeps a bounded table from piece to ids; only missing pieces go to the library. Parts in which the split could depend on the library's Unicode tables (anything beyond
Latin letters and common punctuation), and parts that hold a special string, go to the library whole.

Null and empty texts have no tokens. Nothing is truncated. Texts without a safe boundary, and those for unknown tokenizer designs and sentencepiece
models, are not split.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20
CUT_BYTES = 1 << 16
CACHE_PIECES = 400_000
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa0-įı-ɏ‐-‧‰-⁞₠-₿]*")
#: Fixed value: marks that may follow a letter at a safe boundary.
MARKS = ".,;:!?)…”»、。，！？；：）」』】،؟।"
#: Fixed value: the split of byte-level tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_split(pattern: str) -> re.Pattern | regex.Pattern:
    """The pattern for texts of plain characters only, with letters and numbers listed, since the standard library's
    matcher is twice as fast but knows no classes of characters; the pattern as it is where that can't be had."""
    plain = [c for c in map(chr, range(0x2100)) if _PLAIN.fullmatch(c)]
    plain = sorted(set(plain).union(*(c.lower() for c in plain)))  # some lower-case letters lie outside
    listed = {p: "".join(re.escape(c) for c in plain if regex.fullmatch(p, c)) for p in (r"\p{L}", r"\p{N}")}

    def replaced(m: re.Match) -> str:
        if m[0] in listed:
            return f"[{listed[m[0]]}]"
        return re.sub(r"\\p\{[LN]\}", lambda k: listed[k[0]], m[0])

    try:
        return re.compile(re.sub(r"\[(?:[^\]\\]|\\.)*\]|\\p\{[LN]\}", replaced, pattern))
    except re.error:
        return regex.compile(pattern)


def boundary(special: tuple[str, ...] = ()) -> regex.Pattern | None:
    """Where a text may be split: after a letter, before a space with a letter after it, or before a mark that no special string holds; None if a special string holds
    a letter, a space and a letter."""
    marks = "".join(c for c in MARKS if not any(c in s for s in special))
    if any(regex.search(r"\p{L} \p{L}", s) for s in special):
        return None
    return regex.compile(rf"(?<=\p{{L}})(?= \p{{L}}|[{regex.escape(marks, special_only=False)}])" if marks else r"(?<=\p{L})(?= \p{L})")


_CUT = boundary()


def cut(text: str, size: int = CUT_BYTES, at: regex.Pattern | None = _CUT) -> Iterator[str]:
    """Parts of at least `size` characters (the last may be shorter), cut at safe boundaries."""
    start = 0
    while at and len(text) - start > size and (m := at.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


class Encoder:
    """One tokenizer file in one Python process."""

    def __init__(self, path: str):
        self.cache: dict[str, bytes] = {}
        self.split, self.lower, self.boundary, self.widths = None, False, None, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._batch = lambda texts: model.encode(texts, num_threads=1)
            self.special = ()
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        self._batch = lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            design = json.load(f)
        self.special = tuple(t["content"] for t in design["added_tokens"])
        self.boundary = boundary(self.special)
        pre, norm = design["pre_tokenizer"] or {}, design["normalizer"] or {}
        parts = pre.get("pretokenizers", [pre])
        steps = [n["type"] for n in norm.get("normalizers", [])]
        if not norm and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.split = plain_split(BYTE_LEVEL)
            # a byte-level token is as many bytes as its name has characters
            vocab = design["model"]["vocab"]
            self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
            self.widths[list(vocab.values())] = [len(t) for t in vocab]
        elif steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("type") == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
            self.split, self.lower = plain_split(parts[0]["pattern"]["Regex"]), True

    def _raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as unsigned 32-bit little-endian integers, by the library."""
        out, some, size = [], [], 0
        for i, t in enumerate(texts):
            some.append(t)
            size += len(t)
            if size >= BLOCK_BYTES or i + 1 == len(texts):
                out += [array("I", ids).tobytes() for ids in self._batch(some)]
                some, size = [], 0
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces that are a space and letters: joined they split as they are, so the library sees BLOCK_BYTES of them as one text, whose ids the
        tokens' widths deal out again."""
        out: list[bytes] = []
        sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        blocks = np.cumsum(sizes) // BLOCK_BYTES
        for k in np.unique(blocks).tolist():
            lo, hi = np.searchsorted(blocks, [k, k + 1]).tolist()
            ids = np.array(self._batch(["".join(words[lo:hi])])[0], "<u4")
            at, ends = np.cumsum(self.widths[ids]), np.cumsum(sizes[lo:hi])
            stops = np.searchsorted(at, ends) + 1
            if len(at) == 0 or stops[-1] != len(ids) or (at[stops - 1] != ends).any():
                out += self._raw(words[lo:hi])
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(4 * stops[:-1]).tolist()], (4 * stops).tolist())]
        return out

    def _missing(self, pieces: list[str]) -> list[bytes]:
        if self.widths is None:
            return self._raw(pieces)
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        known = dict(zip(words, self._words(words)))
        others = [p for p in pieces if p not in known]
        known.update(zip(others, self._raw(others)))
        return [known[p] for p in pieces]

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text in order, or None if the library must see it whole."""
        if self.split is None or any(s in text for s in self.special) or not _PLAIN.fullmatch(text):
            return None
        return self.split.findall(text.lower() if self.lower else text)

    def ids(self, text: str | None) -> bytes:
        return next(self.many([text]))

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in order; texts are taken until they have BLOCK_BYTES."""
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(list(cut(text, CUT_BYTES, self.boundary)) if self.split and text else [text] if text else [])
            size += len(text or "")
            if size >= BLOCK_BYTES:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        known = self.cache.__getitem__
        done: list[list] = []  # for each part its ids, its pieces, or its place among the raw parts
        raw: list[str] = []
        missing: dict[str, None] = {}
        for parts in block:
            row: list = []
            for part in parts:
                pieces = self.pieces(part)
                if pieces is None:
                    row.append(len(raw))
                    raw.append(part)
                    continue
                try:
                    row.append(b"".join(map(known, pieces)))
                except KeyError:
                    missing.update(dict.fromkeys(set(pieces).difference(self.cache)))
                    row.append(pieces)
            done.append(row)
        self.cache.update(zip(missing, self._missing(list(missing))))
        encoded = self._raw(raw)
        for row in done:
            yield b"".join(x if isinstance(x, bytes) else encoded[x] if isinstance(x, int) else b"".join(map(known, x)) for x in row)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of each whole text; lengths only leave the Python worker."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(ids) // 4 for ids in encoder(path).many(t.as_py() for t in texts)], pa.int64())

    return F.arrow_udf(count, T.LongType()).asNondeterministic()(text)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit added; columns of docs with these names go."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    out = docs.select(*kept, F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(text), path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
