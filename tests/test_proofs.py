"""Verified files in batches and streams, nested documents against Python's, comparison of runs, tails, identifiability."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.functions import numbers as N
from moodtide.operators import documents as D, models as M, runs as X
from moodtide.sources import verified as V

SCHEMA = "schema string, entryDate string, previousSha256 string, value bigint"


def store(folder, days, **spoil):
    """A chain of entries as files with sidecars; spoil: day to what is wrong with it."""
    folder.mkdir(exist_ok=True)
    before = "genesis"
    for i, day in enumerate(days):
        wrong = spoil.get("d" + day.replace("-", ""), "")
        body = json.dumps({"schema": "v0" if wrong == "version" else "v1", "entryDate": "2000-01-01" if wrong == "date" else day, "previousSha256": "x" if wrong == "chain" else before, "value": i}).encode()
        before = hashlib.sha256(body).hexdigest()
        if wrong != "no sidecar":
            (folder / f"{day}.json.sha256").write_text(f"{before.upper() if i % 2 else before}  {day}.json\n")
        if wrong != "no document":
            (folder / f"{day}.json").write_bytes(b"{" if wrong == "broken" else body.replace(b'"value": ', b'"value":  ') if wrong == "differs" else body)


def test_each_fault_has_its_own_row(spark, tmp_path):
    days = [f"2020-03-{d:02}" for d in range(1, 9)] + ["2020-04-20"]
    store(tmp_path / "entries", days, d20200302="differs", d20200304="no sidecar", d20200305="version", d20200306="date", d20200307="chain")
    (tmp_path / "entries" / "notes.txt").write_text("no entry")
    found = V.verified(V.files(spark, str(tmp_path / "entries")))
    got = {(r.name, r.problem) for r in V.problems(found, SCHEMA, "v1", genesis="genesis").collect()}
    assert got == {("2020-03-02", "differs"), ("2020-03-03", "chain"), ("2020-03-04", "no sidecar"), ("2020-03-05", "version"), ("2020-03-06", "date"), ("2020-03-07", "chain"), ("2020-04-20", "gap")}
    assert [r.value for r in V.read_verified(found, SCHEMA, "v1").orderBy("name").collect()] == [0, 2, 5, 6, 7, 8]
    store(tmp_path / "other", days[:3], d20200301="no document", d20200302="broken")
    found = V.verified(V.files(spark, str(tmp_path / "other")))
    got = {(r.name, r.problem) for r in V.problems(found, SCHEMA, "v1", genesis="genesis").collect()}
    assert got == {("2020-03-01", "no document"), ("2020-03-02", "differs"), ("2020-03-02", "no document of the schema"), ("2020-03-03", "chain")}


def test_stream_of_files_equals_the_batch(spark, tmp_path):
    days = [f"2020-03-{d:02}" for d in range(1, 7)]
    full, live = tmp_path / "full", tmp_path / "live" / "entries"
    store(full, days, d20200302="differs", d20200304="no sidecar")
    live.mkdir(parents=True)
    files = sorted(full.iterdir())
    random.Random(1).shuffle(files)
    latest: dict = {}

    def keep(batch, _):
        for r in batch.collect():
            latest[r.name] = r.state

    for part in (files[:4], files[4:5], files[5:]):  # a document may come before its sidecar or after it
        for f in part:
            (live / f.name).write_bytes(f.read_bytes())
        q = V.proof(V.verified(V.files(spark, str(live), stream=True))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
    batch = V.proof(V.verified(V.files(spark, str(full)))).collect()
    assert latest == {r.name: r.state for r in batch} and sorted(set(latest.values())) == ["differs", "no sidecar", "verified"]


def nested(draw, depth=0):
    kind = draw.random()
    if depth < 6 and kind < 0.3:
        return {draw.choice(["a", "b", "Z", "é", 'q"x', "signal", "target", "n\n"]): nested(draw, depth + 1) for _ in range(draw.randrange(4))}
    if depth < 6 and kind < 0.55:
        return [nested(draw, depth + 1) for _ in range(draw.randrange(4))]
    return draw.choice([None, True, False, 0, -3, 12345678901, 0.5, -2.25, "", "text", 'with "quotes" \\ and é', "line\n"])


def names_in(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            if k in ("signal", "target"):
                yield f"{path}.{k}", k
            yield from names_in(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from names_in(v, f"{path}[{i}]")


def test_documents_equal_python_s(spark):
    draw = random.Random(11)
    values = [nested(draw) for _ in range(150)] + [{}, [], [[]], {"a": {"constructor": 1}}, [-0.0, 0]]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, ""), (902, "{bad"), (903, '{"a":1,"a":2}')]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = D.nodes(docs, ["id"])
    assert {(r.id, r.path, r.name) for r in D.forbidden(found, ["id"], ("signal", "target")).collect()} == {(i, *x) for i, v in enumerate(values) for x in names_in(v)}
    for r in D.canonical(found, ["id"]).collect():
        if r.id >= 900:
            assert (r.text, r.digest, r.problem) == (None, None, "no JSON")
        elif r.id == len(values) - 2:
            assert (r.text, r.problem) == (None, "dangerous name")
        else:
            text = json.dumps(values[r.id], sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace("-0.0", "0")
            assert (r.text, r.digest) == (text, hashlib.sha256(text.encode()).hexdigest())
    assert D.canonical(D.nodes(docs.limit(0), ["id"]), ["id"]).collect() == []


def test_two_runs_are_told_apart_by_their_buckets(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("string")).alias("v"), (F.col("id") / 3).alias("x"))
    other = rows.filter("id <> 77").withColumn("x", F.when(F.col("id") == 1234, 0.25).otherwise(F.col("x"))).unionByName(rows.filter("id = 4000"))
    for name, df in (("a", rows), ("b", rows.repartition(7).orderBy(F.desc("id"))), ("c", other)):
        X.save_run(df, str(tmp_path / name))
    a, b, c = (spark.read.parquet(str(tmp_path / n / "digests")) for n in "abc")
    root = lambda d: X.tree(d).orderBy(F.desc("level")).first()
    assert root(a) == root(b) and root(a) != root(c) and root(a).n == 5000
    assert X.unequal(a, b, ["__bucket"]).count() == 0 and X.differences(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 0
    open_ = {r[0] for r in X.unequal(a, c, ["__bucket"]).collect()}
    assert 1 <= len(open_) <= 4
    opened = X.unequal(X.tree(a), X.tree(c), ["level", "node"]).collect()
    assert {r.node for r in opened if r.level == 1} == {x // X.FAN for x in open_}
    found = X.differences(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    assert {int(f.split("__bucket=")[1].split("/")[0]) for f in spark.read.parquet(str(tmp_path / "a" / "rows")).filter(F.col("__bucket").isin(sorted(open_))).inputFiles()} >= open_
    assert "PartitionFilters: [isnotnull" in found._jdf.queryExecution().toString() or "PartitionFilters: [__bucket" in found._jdf.queryExecution().toString()
    assert sorted((r.id, r.x, r.left, r.right) for r in found.collect()) == [(77, 77 / 3, 1, 0), (1234, 0.25, 0, 1), (1234, 1234 / 3, 1, 0), (4000, 4000 / 3, 1, 2)]


def test_tails_keep_their_accuracy(spark):
    xs = [x / 64 for x in range(-200, 1700)] + [1.0, 8.0, 0.99999999, 26.5, 1e-9, -1e-9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.erfc(F.col("x")).alias("y"), N.normal_survival(F.col("x")).alias("p")).collect()
    for r in got:
        exact = math.erfc(r.x)
        assert abs(r.y - exact) <= 1e-13 * exact, r.x
    odd = spark.createDataFrame([(float("inf"),), (-float("inf"),), (float("nan"),), (None,), (0.0,), (30.0,)], "x double").select(N.erfc(F.col("x")).alias("y")).collect()
    assert [odd[i].y for i in (0, 1, 3, 4, 5)] == [0.0, 2.0, None, 1.0, 0.0] and math.isnan(odd[2].y)


def test_residual_variance_equals_that_of_a_fit(spark):
    rng = np.random.default_rng(3)
    data = []
    for g in range(4):
        for m, n in (("u", 40), ("e", 150)):
            a, b = rng.standard_normal(n), rng.standard_normal(n) * 2 + 1
            y = 0.5 * a - b + (0 if g == 1 else rng.standard_normal(n) * 0.3)
            b = 2 * a + 1 if g == 2 else b
            y = np.ones(n) if g == 3 else y
            data += [(g, m, float(p), float(q), float(r)) for p, q, r in zip(a, b, y)]
    data += [(4, "u", 1.0, 2.0, 3.0), (4, "u", 2.0, 1.0, 5.0), (0, "u", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g int, m string, a double, b double, y double")
    got = {r.g: r for r in M.identifiability(df, ["g"], "m", ["a", "b"], "y", 2).collect()}
    assert [got[g].stage for g in range(5)] == [None, "residual variance", "controls", "preprocessing", "weights"] and got[0].rows == 190
    rows = [r for r in data if r[0] == 0 and r[2] is not None]
    w = np.array([0.5 / (40 if r[1] == "u" else 150) for r in rows])
    x = np.array([r[2:] for r in rows])
    z = (x - w @ x) / np.sqrt(w @ (x - w @ x) ** 2)
    design = np.c_[np.ones(len(z)), z[:, :2]] * np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(design, z[:, 2] * np.sqrt(w), rcond=None)[0]
    assert got[0].residual_variance == pytest.approx(float(((z[:, 2] * np.sqrt(w) - design @ beta) ** 2).sum()), rel=1e-9)


def test_a_level_of_nested_documents_is_read_alone(spark):
    docs = spark.createDataFrame([(1, '{"b":[{"c":1}, {}],"a":{"é\\"x":-0.0}}'), (2, "[]"), (3, "null"), (4, "{")], "k long, text string")
    found = D.nodes(docs, ["k"])
    plan = found.filter("level = 2")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    kinds = {(r.k, r.path): (r.level, r.kind) for r in found.filter("path is not null").collect()}
    assert kinds == {
        (1, "$"): (0, "object"), (1, "$.a"): (1, "object"), (1, "$.b"): (1, "array"), (1, '$.a.é"x'): (2, "value"), (1, "$.b[0]"): (2, "object"), (1, "$.b[1]"): (2, "object"), (1, "$.b[0].c"): (3, "value"),
        (2, "$"): (0, "array"), (3, "$"): (0, "value"), (4, "$"): (0, None),
    }
    texts = {r.k: r.text for r in D.canonical(found, ["k"]).collect()}
    assert texts[1] == '{"a":{"é\\"x":0},"b":[{"c":1},{}]}' and texts[3] == "null" and texts[4] is None
