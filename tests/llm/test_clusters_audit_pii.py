"""Clustering, the audit of filters and personal data against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from moodtide.llm import audit, centroids, pii


def plain_clusters(rows, k=8, rounds=10):
    """rows: (vec_id, integers as tuple); a full scan in Python integers each round."""
    seeds = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in seeds]
    d = lambda v, x: sum((a - b) ** 2 for a, b in zip(v, x))
    nearest = lambda v: min(range(len(c)), key=lambda j: (d(v, c[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in rows]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(rows, of) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    of = [nearest(v) for _, v in rows]
    return sorted((i, a, d(v, c[a]), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, v), a in zip(rows, of))


def test_clusters_equal_a_full_scan(spark):
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((5, 64))
    data = [(i, [float(x) for x in (middle[i % 5] + rng.standard_normal(64) * 0.3)], "a") for i in range(150)]
    data += [(i, data[i % 3][1], "a") for i in range(150, 200)] + [(7, data[7][1], "a"), (300, [0.0] * 64, "b"), (301, [-1.0] * 64, "b")]
    odd = [(900, None, "n"), (901, [1.0] * 63, "n"), (902, [None] + [1.0] * 63, "n"), (903, [float("nan")] + [1.0] * 63, "n"), (904, [float("inf")] + [1.0] * 63, "n"), (905, [], "n")]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, q string").withColumn("cluster", F.lit("mine"))
    state, c = centroids.cluster_vectors(vectors)
    found = centroids.report(state, c).collect()
    whole = [(i, tuple(int(np.floor(np.float32(x).astype(float) * 1024)) for x in v)) for i, v, _ in data]
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found) == plain_clusters(whole)
    total = sum(r.distance for r in found)
    for r in found:
        assert r.inertia == total and r.cluster_inertia == sum(x.distance for x in found if x.cluster == r.cluster)
    assert min(r.scans for r in found) < 5  # bounds settle most of the rounds


def test_bounds_never_change_the_nearest():
    rng = np.random.default_rng(8)
    q = rng.integers(-3, 4, (400, 3)).astype(np.int32)  # many ties
    c = q[:5].astype(np.int64)
    state = (np.zeros(400, int), np.full(400, np.inf), np.zeros(400))
    drift = np.zeros(5)
    for _ in range(12):
        *state, _ = centroids.assigned(q, *state, c, drift)
        assert (state[0] == centroids.squared(q, c).argmin(axis=1)).all()
        moved = c + rng.integers(-1, 2, c.shape)
        drift = np.sqrt(((moved - c) ** 2).sum(axis=1)) * (1 + centroids.SLACK)
        c = moved


def test_large_components_and_few_vectors(spark):
    wide = [(1, [1e30] * 64), (2, [-1e30] * 64), (None, [100_000.5] * 64)]
    vectors = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in centroids.report(*centroids.cluster_vectors(vectors)).collect()}
    assert {r.distance for r in got.values()} == {0} and len({r.cluster for r in got.values()}) == 3
    assert centroids.report(*centroids.cluster_vectors(vectors.limit(0))).collect() == []
    rng = np.random.default_rng(1)
    q, c = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (3, 64))
    assert centroids.squared(q, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in q]


def plain_audit(docs, labels):
    """docs: (doc_id, text, part); each order applied to the documents one filter after the other."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for i, t, p in docs:
        t = t or ""
        w = t.encode().split()
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append((i, p or "", f))
    out = {}
    for part in {p for _, p, _ in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = [(i, f) for i, p, f in fails if p == part]
            gone = []
            for s, c in enumerate(o):
                here = [(i, f) for i, f in left if f[c]]
                before, gone = gone, gone + here
                left = [(i, f) for i, f in left if not f[c]]
                shapley[c] += len(here)
                only = sum(f[c] and sum(f.values()) == 1 for _, p, f in fails if p == part)
                out[part, "".join(o), s + 1] = [len(left), len(here), sum(f[c] for _, f in before), only, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), c]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order_applied(spark):
    draw = random.Random(3)
    plain = " ".join(f"word{i}" for i in range(260))
    texts = [None, "", plain, plain, plain + " |", "A B C", "dog " * 300, " ".join(f"W{i}" for i in range(250)), "x y\x1cz " * 120, "ÉÀ " * 10, "long " * 50_000, "# a"]
    docs = [(draw.choice([*range(40), None]), draw.choice(texts), draw.choice(["s1", "s2", "s3", "", None]), 1) for _ in range(120)]
    docs += [docs[0]] * 3
    labels = [(i, draw.choice([0, 1, None, 7]), draw.choice([0, 1, None])) for i in [*range(30), 3, 3, None]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, mask int").withColumn("n", F.lit("x")).withColumn("__part", F.lit(2))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(5))
    made = audit.orders(audit.cells(audit.failure_masks(frame), marks)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in made}
    assert len(made) == len(got) and got == plain_audit([d[:3] for d in docs], labels)
    assert audit.orders(audit.cells(audit.failure_masks(frame.limit(0)), marks)).collect() == []


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(d):
    return sum(n - 9 if n > 9 else n for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def plain_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d(m)) <= 19 and passes_luhn(d(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(d(m)) <= 15]
    return ",".join("%s:%d:%d" % x for x in out)


def test_fixed_forms_equal_the_patterns():
    draw = random.Random(1)
    for _ in range(20_000):
        t = "".join(draw.choices("0123456789..@@ -+()aZ%_é\n", k=draw.randint(1, 60)))
        assert pii.joined(pii.base_spans(t)) == plain_spans(t), t
    for t in ("a" * 300_000, "1" * 300_000, "1." * 50_000, "+1" * 50_000, "1 " * 20_000, "@a" * 50_000, "\U0001f600 a@b.c"):
        pii._occurrences(t)
    assert pii.joined(pii.base_spans("\U0001f600 a@b.c")) == "email:2:7"


def card(draw):
    head = "4" + "".join(draw.choices("0123456789", k=14))
    return next(head + c for c in "0123456789" if passes_luhn(head + c))


def test_surroundings_give_identifiers_away(spark):
    draw = random.Random(6)
    words = [f"w{c}{d}" for c in "abcdefghijkl" for d in "mnopqrst"]
    some = lambda n: " ".join(draw.choices(words, k=n))
    phone = lambda: f"({draw.randint(200, 999)}) {draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
    texts = [f"{some(9)} card number {card(draw)} {some(4)} call me at +1 {phone()} {some(5)}" for _ in range(40)]
    texts += [f"{some(6)} call me at +1 {phone()}\n{some(3)}" for _ in range(20)]
    hidden, bare = [(f"{some(4)} +1 {phone()} ", card(draw)) for _ in range(6)], [phone() for _ in range(5)]
    texts += [f"{some(3)} card number 1234567890 {a}card number {n} {some(3)}" for a, n in hidden]  # the chain of digits hides no base span here
    merged = [card(draw) for _ in range(5)]
    texts += [f"{some(3)} card number {n} 55 {some(3)}" for n in merged]  # 18 digits in one chain: no base span unless they pass by chance
    texts += [f"{some(3)} call me at {p} {some(2)}" for p in bare]  # no plus
    decoys = ["4000000000000002"[:15] + "9" for _ in range(3)]
    texts += [f"{some(3)} card number {n} {some(3)}" for n in decoys] + [None, "", "plain text 2024 1999-2001 page 12345"]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, texts[0], "x", 5), (0, texts[0], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, row int")
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id}
    for i, t in enumerate(texts[1:], 1):
        assert by[i].base == plain_spans(t or "")
        spans = [s for s in by[i].spans.split(",") if s]
        assert set(x for x in by[i].base.split(",") if x) <= set(spans)
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in spans)
        new = sorted(tuple(map(int, s.split(":")[1:])) for s in set(spans) - set(by[i].base.split(",")))
        for a, b in new:
            assert (t[a:b] in merged and f"card:{a}:{b}" in spans) or (t[a:b] in bare and f"phone:{a}:{b}" in spans)
        assert all(x[1] <= y[0] for x, y in zip(places, places[1:])) or not new
    found = sum(s.startswith("phone") and texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] in bare for i, r in by.items() for s in r.spans.split(","))
    cards = sum(s.startswith("card") and texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] in merged for i, r in by.items() for s in r.spans.split(","))
    assert found == len(bare) and cards == len(merged)
    assert by[len(texts) - 1].spans == "" and by[len(texts) - 2].spans == by[len(texts) - 3].spans == ""
    assert {r.spans for r in got if not r.doc_id} == {next(r.spans for r in got if r.doc_id == 0)}
    assert pii.find_personal_data(docs.limit(0)).collect() == []


def test_base_spans_are_counted_by_kind(spark):
    from moodtide.llm import pii

    docs = spark.createDataFrame([(1, "a@b.c d@e.f 1.2.3.4 +46 70 123 45 67"), (2, None), (None, "card 4111 1111 1111 1111")], "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find_personal_data(docs).collect()}
    assert got == {1: (2, 1, 0, 1), 2: (0, 0, 0, 0), None: (0, 0, 1, 0)}
