"""Each operator against a brute-force version on small tables with nulls, empties, ties, repeats and odd columns."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.llm import blocks, components, embeddings, lines, mixing, packing, quality, simhash, substrings, tokens, toxicity, urls

P = pytest.importorskip("public_tokenizers")
WORDS = "the of and to in is on by re an en th heat sand river stone cloud maple tiger lemon".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.integers(50)) if rng.random() < 0.7 else "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, shared lines, junk, empties and nulls; columns with names that operators use."""
    rng = np.random.default_rng(5)
    texts = [text_of(rng, int(n)) for n in rng.integers(1, 120, 60)]
    shared = text_of(rng, 12)
    rows = [None, "", " \t\n ", "x", "a b", texts[0], texts[0], texts[0] + " extra", "\n".join([shared, texts[1], shared, texts[2]]), shared, "\n".join([texts[1], shared]), "der " * 300, "# $ % & *" * 40, "ÉÀ straße Łódź " * 20, "日本語 text <|endoftext|> mixed", "x\u00a0y\u2003z\x1c w", texts[3].upper()]
    rows = [*rows, *texts]
    data = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 1.0, "k") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size double, fp string")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words_of(text):
    return (text or "").encode().split()


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_quality_measures(docs, rows):
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    for i, t in rows:
        w, m = words_of(t), got[i].m
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        kept = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (m.n_words, m.n_repeat_words, m.n_dup_lines) == (len(w), len(inside), sum(x in kept[:k] for k, x in enumerate(kept)))
        assert m.word_chars == sum(len(x.decode()) for x in w) and m.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert bool(got[i].failed_bits & 3) == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_columns_with_names_that_operators_use_stay(docs, spark):
    odd = docs.withColumn("m", F.lit(1)).withColumn("failed_bits", F.lit("x")).withColumn("copies", F.lit("c")).withColumn("component_id", F.lit(3)).withColumn("__key", F.lit(4))
    for made in (quality.keep_good(odd), simhash.keep_one(odd), mixing.repeated(odd)):
        assert made.columns == odd.columns and {(r.m, r.failed_bits, r.copies, r.component_id) for r in made.collect()} == {(1, "x", "c", 3)}
    pages = spark.createDataFrame([(1, "http://a.com/en/1", 5, "q", 7)], "page_id long, url string, best int, expr string, digest int")
    row = urls.judge(pages, urls.rule_table(spark)).first()
    assert (row.best, row.expr, row.digest, row.rule) == (5, "q", 7, "com/en/")


def test_ablation_counts(docs):
    entries = quality.ledger(docs)
    bits = [r.failed_bits for r in entries.collect()]
    for r in quality.ablation(entries).collect():
        one = 1 << r.bit
        assert (r.n_failed, r.n_only_this, r.n_kept_without) == (sum(b & one > 0 for b in bits), sum(b == one for b in bits), sum(b & ~one == 0 for b in bits))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_faster_split_is_the_library_s(name):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    mine, library = tokens.Encoder(path), Tokenizer.from_file(path)
    draw = random.Random(2)
    plain = [c for c in map(chr, range(0x2100)) if tokens._PLAIN.fullmatch(c)]
    for chars, n in ((plain, 15), (" \n\t\xa0'sdlvermt1²aé.-Ab", 20)):
        for _ in range(2000):
            text = "".join(draw.choices(chars, k=n))
            assert memoryview(mine.ids(text)).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in tokens.count_tokens(docs, P.path("word_bpe_49k.json")).collect()}
    for i, t in rows:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) and got[i].n_bytes == len((t or "").encode())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts_are_cut_where_the_library_cuts(name, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CUT_BYTES", 40)
    text = " ".join(["日本 and", "l'été  two  spaces", "it's\n\nnew", "a-b c3po 12 345!?"] * 30)
    library = Tokenizer.from_file(P.path(name))
    for many in ("Это длинный текст, и он по-русски. " * 300, "这是一个很长的文本，没有空格。真的吗？是的！" * 300, "ΟΔΥΣΣΕΥΣ ΚΑΙ ΣΙΣΥΦΟΣ. " * 200, "한국어 문장입니다. " * 200, "क्षत्रिय हिन्दी। " * 200, "la te\u0301 on, A\u030a. " * 200, "<|endoftext|>a.b<|startoftext|> x" * 200, "日本語。" + "<|endoftext|>" * 60 + "終。" * 50):
        mine = tokens.Encoder(P.path(name))
        assert np.frombuffer(mine.ids(many), "<u4").tolist() == library.encode(many, add_special_tokens=False).ids
        assert "".join(tokens.cut(many, 40, mine.boundary)) == many and len(list(tokens.cut(many, 40, mine.boundary))) > 3
    assert list(np.frombuffer(b"".join(tokens.Encoder(P.path(name))._raw(list(tokens.cut(text, 40)))), "<u4")) == Tokenizer.from_file(P.path(name)).encode(text, add_special_tokens=False).ids
    assert "".join(tokens.cut(text, 40)) == text and len(list(tokens.cut(text, 40))) > 5


def test_texts_share_calls_balanced_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 2000)
    made = tokens.Encoder(P.path("word_bpe_49k.json"))
    calls, real = [], made._batch
    made._batch = lambda texts: calls.append([len(t) for t in texts]) or real(texts)
    texts = [f"слово{i} и ещё {i}" * (1 + i % 7) for i in range(300)] + [None, "", "y" * 9000]
    got = [len(x) // 4 for x in made.many(texts)]
    assert got == [len(real([t])[0]) if t else 0 for t in texts]
    assert len(calls) < 30 and all(sum(c[:-1]) < 2000 for c in calls) and max(len(c) for c in calls) > 10


def test_token_operators_with_odd_rows(spark):
    long = "word and слово, " * 40_000
    docs = spark.createDataFrame([(1, long, 5, "a"), (1, long, 5, "a"), (None, "x y", 6, "b"), (2, None, 7, "c")], "doc_id long, text string, n_tokens int, sequence_id string")
    counted = tokens.count_tokens(docs, P.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.over_limit, r.sequence_id) for r in counted) == [(False, 0, False, "c"), (False, len(long.encode()), True, "a"), (False, len(long.encode()), True, "a"), (True, 3, False, "b")]
    pieces = packing.token_pieces(docs, P.path("byte_bpe_50k.json")).withColumn("sequence_id", F.lit("mine"))
    packed = packing.pack_pieces(pieces).collect()
    assert packed[0].__fields__.count("sequence_id") == 1 and {type(r.sequence_id) for r in packed} == {int}
    assert sum(r.doc_id is None for r in packed) == 1 and sum(r.length for r in packed if r.doc_id == 1) == 2 * sum(r.length for r in packed if r.doc_id == 1) // 2


def test_packing_is_a_round_trip(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), capacity=64, with_ids=True).collect()
    back: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(back.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == 64
        back[r.doc_id] += r.ids
    assert back == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    places: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 64 and len(places) <= -(-sum(places.values()) // 64) + 2


def test_pairs_in_bins_cover_all_pairs_of_sizes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        k = rng.integers(0, 40)
        bins, sizes = rng.integers(0, 4, k), rng.integers(1, 9, k)
        left, right = packing.pairs_in_bins(bins, sizes)
        assert all(i != j and bins[i] == bins[j] for i, j in zip(left, right))
        pair = lambda i, j: (bins[i], *sorted((sizes[i], sizes[j])))
        assert {pair(i, j) for i, j in zip(left, right)} == {pair(i, j) for i in range(k) for j in range(i) if bins[i] == bins[j]}


def test_local_search_empties_bins():
    sizes = np.array([6, 4, 6, 4, 5, 5, 3, 3, 4])
    where = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8])
    better = packing.improve(sizes, where, 10)
    fill = np.bincount(better, sizes)
    assert fill.max() <= 10 and (fill > 0).sum() == 4
    rng = np.random.default_rng(1)
    z = rng.integers(500, 1500, 2000)
    w, o = packing.pack(z)
    hard = rng.integers(400, 1100, 1500)  # where best fit leaves bins that only exchanges empty
    before, after = packing.best_fit(hard, 2048), packing.improve(hard, packing.best_fit(hard, 2048), 2048)
    fills = np.bincount(after, hard)
    assert fills.max() <= 2048 and (fills > 0).sum() < before.max() + 1 and (fills**2).sum() > (np.bincount(before, hard) ** 2).sum()
    assert (packing.improve(hard, after, 2048) == after).all() or (fills > 0).sum() == -(-hard.sum() // 2048)
    assert np.bincount(w, z).max() <= 2048 and w.max() < packing.best_fit(z, 2048).max() + 1


def brute_print(text):
    w = [x.lower() for x in words_of(text)]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_all_pairs(docs, rows):
    prints = [brute_print(t) for _, t in rows]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, keep=("fp", "size")).collect()}
    want = roots(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {i: r.component_id for i, r in got.items()} == {i: want[i] for i, _ in rows}
    assert all(got[i].fp % (1 << 64) == prints[i] for i, _ in rows)


@pytest.mark.parametrize("block", [4, 4096])
def test_simhash_links_in_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << 62, 3)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)} | {int(x) for x in rng.integers(0, 1 << 62, 40)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    at = {p: i for i, p in enumerate(prints)}
    assert all((a ^ b) and a in at and b in at for a, b in links)
    want = roots(len(prints), [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert roots(len(prints), [(at[a], at[b]) for a, b in links]) == want


def test_simhash_keeps_one_of_each_group(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})
    doubled = docs.union(docs)
    assert sorted(r.doc_id for r in simhash.keep_one(doubled).collect()) == ids


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200}


def brute_lines(rows, min_lines=2, min_words=5):
    seqs = [(i, (t.split("\n") if t is not None else [])) for i, t in sorted(rows, key=lambda r: r[0])]
    at = [(d, n) for d, s in enumerate(seqs) for n in range(len(s[1]))]
    gone = set()
    for x, (d, n) in enumerate(at):
        a = seqs[d][1]
        best = 0
        for e, m in at[:x]:
            b, k = seqs[e][1], 0
            while n + k < len(a) and m + k < len(b) and a[n + k] == b[m + k]:
                k += 1
            best = max(best, k)
        if best >= min_lines:
            gone |= {(d, n + k) for k in range(best)}
        if best >= 1 and len(words_of(a[n])) >= min_words:
            gone.add((d, n))
    return {i: "\n".join(x for n, x in enumerate(s) if (d, n) not in gone) if s else None for d, (i, s) in enumerate(seqs)}


def test_lines_equal_longest_earlier_runs(docs, rows, spark):
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == brute_lines(rows)
    rng = np.random.default_rng(7)
    short = ["a", "b", "", "one two three four five six"]
    small = [(i, "\n".join(rng.choice(short, rng.integers(1, 8)))) for i in range(25)]
    df = spark.createDataFrame(small, "doc_id long, text string")
    for m in (1, 2, 3):
        assert {r.doc_id: r.text for r in lines.dedup_lines(df, min_lines=m, min_words=6).collect()} == brute_lines(small, m, 6), m
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs.union(docs)).collect()} == brute_lines(rows)


def test_long_and_overlapping_runs_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    base = [f"line {x}" for x in rng.integers(0, 10**6, 70)]
    rows = []
    for i in range(30):
        lo, size = int(rng.integers(0, 60)), int(rng.integers(1, 40))
        part = [x for x in base[lo : lo + size]]
        if rng.random() < 0.5:
            part[rng.integers(len(part))] = "other"
        rows.append((i, "\n".join(part * int(rng.integers(1, 3)))))
    rows += [(40, "\n".join(["same"] * 37)), (41, "\n".join(["same"] * 20 + ["x"])), (42, "\n".join(base)), (43, "\n".join(base)), (44, None), (45, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for m in (1, 2, 3, 5, 7):
        assert {r.doc_id: r.text for r in lines.dedup_lines(df, min_lines=m, min_words=9).collect()} == brute_lines(rows, m, 9), m


def test_suffix_array_is_in_the_order_of_its_prefixes(spark):
    rng = np.random.default_rng(18)
    texts = [[str(x) for x in rng.integers(0, 3, rng.integers(1, 20))] for _ in range(25)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = lines.neighbours(lines.suffix_array(lines.repeated_lines(lines.line_positions(df, "doc_id", "text", 1))), 7).orderBy("id").collect()
    assert sorted((r.d, r.n) for r in found) == [(i, n) for i, t in enumerate(texts) for n in range(len(t))]
    tails = [texts[r.d][r.n :] for r in found]
    common = lambda x, y: next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
    for i in range(1, len(tails)):
        true = common(tails[i - 1], tails[i])
        assert found[i].lcp <= true and (found[i].lcp >= 7) == (true >= 7) and (true < 4 or found[i].lcp >= 4)
        # no other suffix before it shares more, but through the ones between
        assert all(common(tails[k], tails[i]) <= true for k in range(i))


def test_maximal_runs_cover_what_goes(docs):
    runs = lines.maximal_runs(docs).collect()
    gone = {r.doc_id: r.n_deleted for r in lines.dedup_lines(docs).collect() if r.n_deleted}
    total = Counter()
    for r in runs:
        total[r.doc_id] += r.last_line - r.first_line + 1
    assert dict(total) == gone


def test_mixing_meets_capped_targets(docs, rows):
    got = mixing.mix(docs, keep=("size", "lang")).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        targets[r.source] = r.target
        assert 0 <= r.copies <= 2
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, want, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (total - sum(want.values())) / max(1e-12, sum(weights[s] for s in open_))
        over = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    assert targets == pytest.approx(want)
    longest = max(len(words_of(t)) for _, t in rows)
    assert all(abs(taken[s] - want[s]) <= longest / 2 + 1e-6 for s in order)
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mixing_with_equal_rows(spark):
    rows = [(7, "two words", "a", i) for i in range(100)] + [(i, "one", "b", i) for i in range(300)] + [(None, None, "b", 0)] * 5 + [(9, "x y z", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, number long")
    got = mixing.mix(docs, keep=("number",)).collect()
    assert len(got) == len(rows)
    for s, most in (("a", 1.0), ("b", 0.5), ("c", 1.5)):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= most and {r.copies for r in mine} <= {0, 1, 2}
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again)
    assert sum(r.copies for r in got) == mixing.repeated(docs).count()


def test_url_rules(spark):
    rng = np.random.default_rng(8)
    fixed = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7", "http://a.b.example.com/en/70?x#y", "x://com/en/", "http://acom/en/", "http://example.net/de/8", "http://example.net/de", "a://b://c/en/", "http://org?/es/", "http://.com/en/", "http://com./en/"]
    made = [f"http://{'.'.join(rng.choice(['a', 'example', 'com', 'net', 'org'], rng.integers(1, 4)))}/{rng.choice(['en', 'de', 'es'])}/{rng.integers(100)}" for _ in range(200)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*fixed, *made])], "page_id long, url string, host string, rule string")
    for r in urls.judge(df, urls.rule_table(spark)).join(df.select("page_id", F.col("url").alias("u")), "page_id").collect():
        host = path = ""
        if r.u and "://" in r.u:
            rest = r.u.split("://", 1)[1].split("?")[0].split("#")[0]
            host, slash, tail = rest.partition("/")
            path = slash + tail
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), r.u


def test_postings_of_a_small_table_are_not_broadcast(spark):
    """Spark takes exploded rows to be as large as the table they come from."""
    prints = spark.range(2000).select((F.col("id") * 257).alias("fp"))
    dealt = blocks.units(simhash.postings(components.materialise(prints), 3, 4), ["key", "list"], F.xxhash64("fp"), 4096)
    assert "Broadcast" not in dealt._jdf.queryExecution().sparkPlan().toString()
    counts = dealt.groupBy("key", "list").count().agg(F.min("count"), F.sum("count")).first()
    posts = simhash.postings(prints, 3, 4).groupBy("key", "list").count().filter("count > 1").agg(F.sum("count")).first()
    assert counts[0] > 1 and counts[1] == posts[0]


def test_url_rules_are_those_of_the_contract(spark):
    wanted = {
        "http://a.com/en/1": ("com/en/", "block"), "http://x.example.com/en/70": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://x.example.net/de/80": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://a.org/es/": ("org/es/", "block"),
    }
    df = spark.createDataFrame(list(enumerate(wanted)), "page_id long, url string")
    assert {r.url: (r.rule, r.verdict) for r in urls.judge(df, urls.rule_table(spark)).collect()} == wanted


@pytest.mark.parametrize("block", [3, 1024])
def test_embedding_links_and_recall(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(9)
    vectors, labels = [], []
    for g in range(12):
        base = rng.normal(size=32)
        for _ in range(10):
            vectors.append((base + rng.normal(size=32) * rng.uniform(0.05, 0.3)).astype(np.float32).tolist())
            labels.append(g % 3)
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[0]], [0.0] * 32, None, [float("nan")] * 32, [None] * 32, [float("inf")] + [1.0] * 31, [], [1.0, 2.0], vectors[0]]
    labels += [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, None]
    df = spark.createDataFrame([(i, v, x, 0) for i, (v, x) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in enumerate(vectors) if ok(v) and labels[i] is not None}
    pairs = [(a, b) for a, b in combinations(sorted(unit), 2) if labels[a] == labels[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    want = Counter(x for p in pairs for x in p)
    assert len(got) == len(vectors) and all(got[i].n_links <= want[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values())
    for i in range(len(vectors)):
        if i not in unit:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[120].component_id == got[121].component_id == got[122].component_id == got[0].component_id


def test_dense_groups_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(23)
    base = rng.normal(size=(2, 24))
    v = np.concatenate([base[0] + rng.normal(size=(500, 24)) * 0.2, base[1] + rng.normal(size=(40, 24)) * 0.25]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)] + [(i, v[0].tolist(), 1) for i in range(900, 930)] + [(5, v[5].tolist(), 1)], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df).collect()
    all_ = np.concatenate([v, np.repeat(v[:1], 30, axis=0), v[5:6]]).astype(float)
    ids = [*range(540), *range(900, 930), 5]
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    want = Counter(zip(ids, near.sum(axis=1).tolist()))
    found = Counter((r.vec_id, r.n_links) for r in got)
    assert len(got) == len(ids) and sum(n for (_, k), c in found.items() for n in [k * c]) >= 0.99 * sum(k * c for (_, k), c in want.items())
    links = {i: max(n for j, n in want if j == i) for i in set(ids)}
    assert all(r.n_links <= links[r.vec_id] for r in got)


def test_vectors_of_extreme_components(spark):
    rng = np.random.default_rng(19)
    base = rng.normal(size=(4, 16))
    rows = [(base[0] * 1e200).tolist(), ((base[0] + 0.01) * 1e200).tolist(), (base[0] * 1e-200).tolist(), np.abs(base[1] * 1e-200).tolist(), np.abs(base[2][::-1] * 1e-200).tolist(), base[3].tolist(), (base[3] * 5e-324 / np.abs(base[3]).min()).tolist(), [1e-310] + [0.0] * 15, [1e308] + [0.0] * 15]
    unit = [np.array(v) / np.abs(v).max() for v in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    want = [sum(i != j and a @ b >= 0.93 for j, b in enumerate(unit)) for i, a in enumerate(unit)]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()] == want
    assert want[:3] == [2, 2, 2] and want[7:] == [1, 1]


def test_passages_are_found_and_others_left(spark):
    rng = np.random.default_rng(10)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, longer = fresh(60), fresh(200)
    fuzzy = list(longer)
    fuzzy[70] = "changed"
    del fuzzy[140]
    rows = [fresh(80) + passage + fresh(30), fresh(10) + passage + fresh(200), fresh(300), passage[:30] + fresh(40), longer, fresh(20) + fuzzy, None, [], fresh(40) * 2, passage]
    df = spark.createDataFrame([(i, None if r is None else " ".join(r), 1) for i, r in enumerate(rows)], "doc_id long, text string, start int")
    got = substrings.repeated_passages(df).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, set()).update(range(r.passage_start, r.passage_end))
    assert spans[1] == set(range(10, 70)) and spans[9] == set(range(60))
    assert len(spans[5] & set(range(20, 219))) >= 190 and not spans[5] - set(range(20, 219))
    assert set(spans) == {1, 5, 9}
    assert {r.earlier_doc_id for r in got if r.doc_id == 5} == {4}


def test_copies_by_the_hundred_link_to_the_ones_before(spark):
    rng = np.random.default_rng(11)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 120))
    df = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").repartition(4)
    got = substrings.repeated_passages(df).collect()
    assert {(r.doc_id, r.earlier_doc_id) for r in got} == {(i, i - k) for i in range(1, 300) for k in (1, 2) if i >= k}
    assert all((r.passage_start, r.passage_end) == (0, 120) for r in got)


def test_blocks_of_one_repeated_short_line_are_found(spark):
    rng = np.random.default_rng(15)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    shapes = [(n, period) for n, period in ((55, 5), (55, 7), (80, 7), (110, 11)) for _ in range(15)]
    rows = []
    for n, period in shapes:
        block = (fresh(period) * n)[:n]
        rows += [fresh(60) + block + fresh(60), fresh(80) + block + fresh(40)]
    got = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).update(range(r.passage_start, r.passage_end))
    lost = Counter(shape for k, shape in enumerate(shapes) if len(found.get(2 * k + 1, set()) & set(range(80, 80 + shape[0]))) < 50)
    assert not lost, lost


def test_a_run_of_one_seed_is_thinned_by_distance():
    for period in range(1, 12):
        words = np.tile(np.arange(period, dtype=np.uint32) + 7, 40)
        at, _ = substrings.minimizers(words, np.array([len(words)]))
        assert np.diff(at).max() < substrings.WINDOW + period and len(at) <= len(words) // substrings.WINDOW + 1


@pytest.mark.parametrize("links", [1, 2, 3])
@pytest.mark.parametrize("rung", [0, 1])
def test_matches_cross_the_borders_of_tasks(spark, links, rung):
    rng = np.random.default_rng(14)
    rows = sorted({(*(int(x) for x in rng.integers(0, (6, 2, 9, 3))),) for _ in range(90)})
    rows = sorted((a, b if rung else 0, c, d) for a, b, c, d in rows)
    rows = list(dict.fromkeys(rows))
    same = lambda x, y: x[: rung + 1] == y[: rung + 1]
    want = {(*rows[i][2:], *rows[i - d][2:]) for i in range(len(rows)) for d in range(1, links + 1) if i >= d and same(rows[i], rows[i - d])}
    posts = spark.createDataFrame(rows, "seed long, near int, doc long, pos int").withColumn("wide", F.lit(0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        pairs, heads = substrings.class_matches(posts, rung, links)
        got, first = pairs.collect(), {(r.seed, r.near, r.doc, r.pos) for r in heads.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.doc, r.pos, r.prev, r.prev_pos) for r in got} == want
    if rung:
        seeds = Counter(r[0] for r in rows)
        assert first >= {r for i, r in enumerate(rows) if seeds[r[0]] > 1 and (i == 0 or not same(r, rows[i - 1]))}


def spans_of(got):
    out: dict = {}
    for r in got:
        out.setdefault(r.doc_id, set()).update(range(r.passage_start, r.passage_end))
    return out


def earlier_copies(texts, size):
    """By document, the word places inside runs of `size` words that also start at an earlier place: brute force."""
    seen, out = set(), {}
    for d, words in enumerate(texts):
        for p in range(len(words) - size + 1):
            run = tuple(words[p : p + size])
            if run in seen:
                out.setdefault(d, set()).update(range(p, p + size))
            seen.add(run)
    return out


@pytest.mark.parametrize("piece", [17, 19, 25, 37])
def test_pieces_in_other_documents_do_not_hide_a_copy(spark, piece):
    rng = np.random.default_rng(31)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(200)
    pieces = [fresh(40) + passage[a : a + piece] + fresh(40) for a in rng.integers(0, 200 - piece, 80)]
    rows = [*pieces[:20], fresh(20) + passage + fresh(20), *pieces[20:], fresh(30) + passage + fresh(30)]
    got = spans_of(substrings.repeated_passages(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")).collect())
    assert got[81] >= set(range(30, 230)) and not got[81] - set(range(25, 235))


def test_exact_repeats_in_boilerplate_are_found_as_by_brute_force(spark):
    rng = np.random.default_rng(32)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    lines = [fresh(int(n)) for n in rng.integers(8, 40, 60)]
    passages = [sum((lines[k] for k in rng.integers(0, 60, 4)), []) for _ in range(15)] + [fresh(int(n)) for n in rng.integers(50, 200, 15)]
    texts = []
    for _ in range(300):
        parts = [fresh(int(rng.integers(5, 60))) for _ in range(int(rng.integers(1, 4)))]
        parts += [lines[k] for k in rng.integers(0, 60, rng.integers(0, 4))] + ([passages[rng.integers(30)]] if rng.random() < 0.4 else [])
        texts.append(sum((parts[k] for k in rng.permutation(len(parts))), []))
    got = spans_of(substrings.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect())
    want = earlier_copies(texts, 50)
    asked = sum(len(v) for v in want.values())
    assert sum(len(v & got.get(d, set())) for d, v in want.items()) >= 0.995 * asked, asked
    sure = earlier_copies(texts, 50 + substrings.WINDOW)
    assert all(got.get(d, set()) & v for d, v in sure.items())
    # what is reported beyond that has earlier copies of a fragment's least length, but for words between them
    loose = earlier_copies(texts, 8)
    extra = sum(len(v - loose.get(d, set())) for d, v in got.items())
    assert extra <= 0.02 * sum(len(v) for v in got.values()), extra


def test_fuzzy_copies_in_boilerplate_are_found(spark):
    rng = np.random.default_rng(33)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passages = [fresh(int(n)) for n in rng.integers(80, 250, 25)]
    rows, planted, sets = [], {}, {}
    for i in range(250):
        p, fuzzy = passages[i % 25], []
        for w in p:  # an edit in 100 words, so one in 50 between two copies: nine of ten shingles agree
            u = rng.random() * 100
            fuzzy += [] if u < 0.33 else [w, "more"] if u < 0.66 else ["other"] if u < 1 else [w]
        before = fresh(int(rng.integers(5, 80)))
        sets[i] = {tuple(fuzzy[k : k + 5]) for k in range(len(fuzzy) - 4)}
        if any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in range(i % 25, i, 25)):  # brute force
            planted[i] = set(range(len(before), len(before) + len(fuzzy)))
        rows.append(before + fuzzy + fresh(30))
    got = spans_of(substrings.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")).collect())
    assert len(planted) > 150 and np.mean([len(v & got.get(i, set())) >= 0.8 * len(v) for i, v in planted.items()]) >= 0.99
    alone = set(range(25))
    assert not alone & set(got)


def test_pieces_in_later_documents_do_not_hide_a_fuzzy_copy(spark):
    """Every run between two edits is covered by pieces of 25 and 19 words, each in three documents between the two copies."""
    rng = np.random.default_rng(36)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, wanted = [], {}
    for _ in range(12):
        passage = fresh(270)
        fuzzy = [w for k, w in enumerate(passage) if k % 45 != 44]  # five shingles of 45 go
        pieces = [p for a in range(0, 270, 45) for p in (passage[a : a + 25], passage[a + 25 : a + 44])]
        rows += [fresh(20) + passage + fresh(20), *(fresh(30) + p + fresh(30) for p in pieces for _ in range(3))]
        wanted[len(rows)] = set(range(30, 30 + len(fuzzy)))
        rows.append(fresh(30) + fuzzy + fresh(30))
    got = spans_of(substrings.repeated_passages(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")).collect())
    lost = {i: len(v - got.get(i, set())) for i, v in wanted.items() if len(v & got.get(i, set())) < 0.8 * len(v)}
    assert not lost and set(got) == set(wanted)


def test_passages_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(34)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    one, two = fresh(70), fresh(90)
    rows = [(None, one), (7, two), (7, fresh(40) + " " + one), (7, two), (9, two), (-5, fresh(30)), (1 << 40, fresh(8) + " " + one), (None, None), (3, "")]
    got = spans_of(substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {7: set(range(40, 110)), 9: set(range(90)), 1 << 40: set(range(8, 78))}
    wide = spark.createDataFrame([(-(1 << 62), one), ((1 << 62) + 5, one), (0, two)], "doc_id long, text string")
    assert set(spans_of(substrings.repeated_passages(wide).collect())) == {(1 << 62) + 5}
    with pytest.raises(ValueError):
        substrings.repeated_passages(spark.createDataFrame([("a", one)], "doc_id string, text string"))


def test_very_long_texts_have_passages(spark):
    rng = np.random.default_rng(35)
    long = [f"w{x}" for x in rng.integers(0, 10**9, 60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x"] + long[100:50_100]))]
    got = spans_of(substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {2: set(range(1, 50_001))}


def test_chaining_is_optimal_on_small_cases():
    rng = np.random.default_rng(12)
    for _ in range(50):
        n = int(rng.integers(2, 7))
        start = np.sort(rng.integers(0, 60, n))
        size, other = rng.integers(5, 9, n), rng.integers(0, 60, n)
        best = 0.0
        for k in range(1, n + 1):
            for c in combinations(range(n), k):
                if all(start[i] + size[i] <= start[j] and other[i] + size[i] <= other[j] for i, j in zip(c, c[1:])):
                    best = max(best, sum(size[i] for i in c) - substrings.SKIP * sum(start[j] - start[i] - size[i] + other[j] - other[i] - size[i] for i, j in zip(c, c[1:])))
        got = substrings.chains(start, start + size, other, np.full(n, 2))[0]
        score = sum(size[i] for i in got) - substrings.SKIP * sum(start[j] - start[i] - size[i] + other[j] - other[i] - size[i] for i, j in zip(got, got[1:]))
        assert score == pytest.approx(best)


def test_stretches_are_maximal():
    ok = np.array([1] * 10 + [0] * 5 + [1] * 40 + [0] * 2 + [1] * 30 + [0] * 60 + [1] * 8, bool)
    assert substrings.stretches(ok) == [(0, 87), (147, 155)]
    assert substrings.stretches(np.array([1] * 4 + [0] * 3 + [1] * 4, bool)) == [(0, 4), (7, 11)]
    assert substrings.stretches(np.zeros(5, bool)) == []


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(13)
    y = rng.random(20_000) < 0.2
    fire = [(0.9, 0.05), (0.7, 0.1), (0.6, 0.02), (0.5, 0.2)]
    votes = np.array([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in fire])
    votes = np.vstack([votes, votes[3]])  # a voter that repeats another
    code = sum(v.astype(int) << i for i, v in enumerate(votes))
    shown = [int(a) if k % 10 == 0 else None for k, a in enumerate(y)]
    model = toxicity.fit_label_model(dict(Counter(zip(code.tolist(), shown))), 5)
    assert model["prior"] == pytest.approx(0.2, abs=0.03)
    assert {tuple(sorted((i, int(j)))) for i, j in enumerate(model["parent"]) if j >= 0} >= {(3, 4)}
    pattern = toxicity.bits(list(range(32)), 5)
    got = toxicity.posterior(pattern, model)
    for v, p in zip(pattern, got):  # the repeated voter counts once
        if v[3] == v[4]:
            odds = np.log(0.25) + sum(np.log(a / b) if x else np.log((1 - a) / (1 - b)) for x, (a, b) in zip(v, fire))
            assert p == pytest.approx(1 / (1 + np.exp(-odds)), abs=0.1)


def test_classifier_reaches_the_optimum():
    rng = np.random.default_rng(15)
    n, size = 300, 6
    x = rng.random((n, size)) * (rng.random((n, size)) < 0.5)
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=size) * 2 - 0.5)))
    at, index = np.nonzero(x)
    w = toxicity.fit_weights(at, index, x[at, index], y, size)
    z = x @ w[:-1] + w[-1]
    r = 1 / (1 + np.exp(-z)) - y
    assert np.abs(np.r_[r @ x / n + toxicity.RIDGE * w[:-1], r.mean()]).max() < 1e-4


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.8 and np.mean([s >= 0.7 for s in neg]) < 0.02


def test_toxicity_passes_through_the_label_model(spark, monkeypatch):
    """Documents of words that only unlabelled documents share with voters' words; without the model's posteriors they are not found."""
    rng = np.random.default_rng(16)
    fresh = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(["stone", "river", "cloud", "maple"], n), rng.choice(["a", "b", "c"], n))]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        rows.append((i, " ".join(fresh(40) + (["idiot", "moron", "scum"] + ["zorg"] * (i % 2) if toxic else [])), "k"))
        if i % 4 == 0:
            labels.append((i, int(toxic)))
    rows += [(5000 + i, " ".join(fresh(40) + ["zorg"]), "k") for i in range(20)] + [(None, "idiot", "k"), (3, "repeated id", "k"), (6000, "idiot " * 30_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, *labels, (1, None), (7, 5), (None, 1)], "doc_id long, toxic int")
    held = F.coalesce(F.col("doc_id") >= 5000, F.lit(False))
    got = toxicity.toxicity(docs, known, held).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id != 3}
    assert np.mean([by[i] == (i % 5 == 0) for i in range(900) if i != 3]) > 0.99 and by[6000] == 1
    monkeypatch.setattr(toxicity, "posterior", lambda votes, model: np.full(len(votes), 0.2))
    flat = toxicity.toxicity(docs, known, held).collect()
    assert not any(r.predicted for r in flat)


def test_toxicity_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you stupid idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.toxicity(docs, none, F.lit(False)).collect()]
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)
    assert toxicity.toxicity(docs.limit(0), none, F.lit(False)).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.keep_good(docs).count() == 0
    assert lines.dedup_lines(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert packing.pack_documents(docs, P.path("byte_bpe_50k.json")).count() == 0
    assert tokens.count_tokens(docs, P.path("word_bpe_49k.json")).count() == 0
    assert substrings.repeated_passages(docs).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.rule_table(spark)).count() == 0
    vectors = spark.createDataFrame([], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))
    assert embeddings.near_duplicates(vectors).count() == 0


def test_null_ids_do_not_crash(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (3, "a b c"), (None, None)], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert {r.text for r in simhash.keep_one(docs).collect()} == {"a b c", "d e f", None}
    assert lines.dedup_lines(docs).count() == 4 and mixing.mix(docs).count() == 4
    assert packing.pack_documents(docs, P.path("byte_bpe_50k.json")).count() == 4
    assert substrings.repeated_passages(docs).count() == 0
