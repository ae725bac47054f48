"""Toxicity by weak supervision.

Voters are fixed lexicons of insults, patterns, and lexicons induced from labelled documents: features that go with toxic labels, in
families of one start. Each voter fires or not, so a document's votes are one integer. A generative label model explains the votes: within either class each voter fires with its own probability given
what one other voter does, the one it depends on most; so accuracies and pairwise correlations (a tree of the largest conditional mutual information) are parameters
of the model. Expectation maximisation fits them on labelled and unlabelled documents together: labels are shown for those that have them, the others are inferred.

A document's posterior label comes from its votes alone, labelled or not. These posteriors train a logistic regression over features of the text: presence of words and of words' starts
that go with the posteriors, and the votes. Most features are words, so it also tells documents apart on which no voter fires. Labels thus calibrate the voters; what the classifier learns passes through the label model.

Voters, label model and classifier are fitted on about `max_fit` labelled and `max_more` further documents at most, chosen by a hash of their id, of several texts under one id that with the least
hash; held-out documents are not among them. Every text is scored, whole.

Null and empty texts have no features and get the classifier's intercept as score. Labels of other values than 0
and 1 and null labels count as unlabelled. Repeated labels of one id count once (the largest). Rows with null ids are scored and not learned from. Without labels of both classes all
scores are the share of toxic labels (of one in two where there are none). An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Insults and abuse in English, by what they aim at.
LEXICONS = (
    ("clown", "cretin", "dimwit", "dumb", "dunce", "fool", "foolish", "idiot", "idiotic", "idiots", "ignorant", "imbecile", "moron", "moronic", "morons", "stupid"),
    ("disgusting", "filth", "filthy", "garbage", "loathsome", "maggot", "parasite", "pig", "pigs", "rat", "repulsive", "revolting", "rotten", "scum", "slime", "swine", "trash", "vermin"),
    ("disgrace", "loser", "losers", "miserable", "pathetic", "shameful", "sucker", "ugly", "useless", "weak", "worthless", "wretch"),
    ("bastard", "coward", "creep", "degenerate", "despicable", "freak", "hate", "jerk", "kill", "liar", "lunatic", "nasty", "psycho", "scoundrel", "sick", "sleazy", "thug", "traitor", "twisted", "vile"),
)
_INSULTS = frozenset().union(*LEXICONS)
#: Induced families (three voters each; all voters fit a 63-bit integer) and the length of the start they share.
FAMILIES, FAMILY_START = 13, 4
MAX_FIT, MAX_MORE = 20_000, 10_000
STARTS = (4, 5, 6, 7)
N_FEATURES = 3000
#: Penalty of squared weights and the most steps of the classifier's fit.
RIDGE, STEPS = 1e-4, 80
_WORD = re.compile(r"[^\W\d_]+")
_SHOUTED = re.compile(r"[A-ZÀ-ÖØ-Þ]{4,}")
_ADDRESS = re.compile(r"\byou(?:'re| are)? (?:an? )?[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def names_of(w: str) -> list[str]:
    """The features of a word: itself, with a trailing bar, and its starts. `#` stands for any insult."""
    names = [w + "|"]
    if len(w) > STARTS[0]:
        names += [w[:k] for k in STARTS if len(w) > k]
    if w in _INSULTS:
        names.append("#")
    return names


def features_of(words: Counter) -> Counter:
    """The features of all words, with how often they occur."""
    out: Counter = Counter()
    for w, n in words.items():
        for f in names_of(w):
            out[f] += n
    return out


def strength(n: int) -> float:
    return min(3 + n, 8) / 4


def term_table(texts: DataFrame) -> DataFrame:
    """One row per document and feature: doc, term, n."""

    def explode(batches):
        for b in batches:
            rows, terms, counts = [], [], []
            for i, t in enumerate(b.column(1)):
                f = features_of(words_of(t.as_py()))
                rows += [i] * len(f)
                terms += f.keys()
                counts += f.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(terms, pa.string()), pa.array(counts, pa.int32())], names=["doc", "term", "n"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", "text").mapInArrow(explode, f"doc {kind}, term string, n int")


def associated(terms: DataFrame, n_toxic: float, n_clean: float, limit: int) -> list[tuple[str, float]]:
    """The features whose presence goes with toxicity (`y`, from 0 to 1), strongest first, with their log odds: a report of
    bounded length. Ties by the feature's text."""
    y = F.col("y").cast("double")
    counted = terms.groupBy("term").agg(F.sum(y).alias("a"), F.sum(1 - y).alias("b")).filter("a + b >= 5")
    odds = F.log((F.col("a") + 0.5) / (n_toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n_clean - F.col("b") + 0.5))
    share = (F.col("a") + F.col("b")) / (n_toxic + n_clean)
    z = F.round((F.col("a") - share * n_toxic) / F.sqrt(share * n_toxic + 1e-9), 6)
    top = counted.withColumn("odds", odds).withColumn("z", z).filter("z > 2").orderBy(F.desc("z"), "term").limit(limit)
    return [(r.term, float(r.odds)) for r in top.select("term", "odds").collect()]


class Voters:
    """The votes of a document as an integer; bit i is voter i."""

    def __init__(self, induced: list[tuple[str, float]]):
        strong = [t for t, o in induced if o > 2]
        self.tiers = [frozenset(strong[:25]), frozenset(strong[25:100]), frozenset(strong[100:400]), frozenset(t for t, o in induced if 1 < o <= 2)]
        starts = list(dict.fromkeys(t.rstrip("|")[:FAMILY_START] for t in strong if len(t) >= FAMILY_START))[:FAMILIES]
        self.family = {start: i for i, start in enumerate(starts)}
        self.members = frozenset(strong)
        self.heeded = self.members.union(*self.tiers)
        self.n = 2 * len(LEXICONS) + 14 + 3 * FAMILIES
        self.known: dict[str, tuple[int, tuple[int, ...], int] | None] = {}

    def look_up(self, w: str) -> tuple[int, tuple[int, ...], int] | None:
        """The word's lexicon and family (-1: none) and how many of its features are in each tier; None if no voter heeds it."""
        features = names_of(w)
        if w not in _INSULTS and self.heeded.isdisjoint(features):
            return None
        lexicon = next((i for i, words in enumerate(LEXICONS) if w in words), -1)
        family = self.family.get(w[:FAMILY_START], -1) if any(f in self.members for f in features) else -1
        tiers = tuple(sum(f in tier for f in features) for tier in self.tiers)
        return (lexicon, tiers, family) if lexicon >= 0 or family >= 0 or any(tiers) else None

    def vote(self, text: str | None) -> int:
        words, found = words_of(text), []
        for w, n in words.items():
            if w not in self.known:
                if len(self.known) > 500_000:
                    self.known.clear()
                self.known[w] = self.look_up(w)
            if (got := self.known[w]) is not None:
                found.append((got, n))
        return self.votes_of(text, found, sum(words.values()))

    def votes_of(self, text: str | None, found: list, total: int) -> int:
        """The votes from what look_up() gave for words of the text, with their counts, and its number of words."""
        raw = text or ""
        by_lexicon, tier = [0] * len(LEXICONS), [0] * len(self.tiers)
        family, kinds = [0] * FAMILIES, [0] * FAMILIES
        for (lexicon, tiers, i), n in found:
            if lexicon >= 0:
                by_lexicon[lexicon] += n
            tier = [a + n * b for a, b in zip(tier, tiers)]
            if i >= 0:
                family[i] += n
                kinds[i] += 1
        insults = sum(by_lexicon)
        shouted = len(_SHOUTED.findall(raw))
        fired = [
            *(n >= 1 for n in by_lexicon), *(n >= 2 for n in by_lexicon),
            insults >= 1, insults >= 3, insults >= 6, 50 * insults > total,
            tier[0] >= 1, tier[0] >= 4, tier[1] >= 2, tier[1] >= 6, tier[2] >= 4, tier[3] >= 6,
            sum(n > 0 for n in by_lexicon) >= 3, shouted >= 5, raw.count("!") >= 5, insults > 0 and bool(_ADDRESS.search(raw.lower())),
            *(n > 0 for n in family), *(n >= 2 for n in kinds), *(n >= 2 and 50 * n > total for n in family),
        ]
        return sum(1 << i for i, x in enumerate(fired) if x)


def dependencies(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """For each voter the voter it depends on (-1: none): the tree of the largest mutual information within classes.
    votes: rows of 0 and 1; mass: weight of each row in either class."""
    v = votes.shape[1]
    total = mass.sum()
    info = np.zeros((v, v))
    for m in mass:
        both = (votes * m[:, None]).T @ votes + 0.25
        one = np.diag(both) + 0.25
        n = m.sum() + 1
        cells = [both, one[:, None] - both, one[None, :] - both, n - one[:, None] - one[None, :] + both]
        sides = [(one, one), (one, n - one), (n - one, one), (n - one, n - one)]
        for cell, (a, b) in zip(cells, sides):
            cell = np.maximum(cell, 1e-9)
            info += cell / total * np.log(cell * n / np.outer(a, b))
    parent, best = np.full(v, -1), info[0].copy() if v else info
    inside = np.zeros(v, bool)
    source = np.zeros(v, int)
    for k in range(v):
        i = 0 if k == 0 else int(np.argmax(np.where(inside, -np.inf, best)))
        inside[i] = True
        if k and best[i] > 1e-3:
            parent[i] = source[i]
        better = info[i] > best
        if k == 0:
            better[:] = True
        best, source = np.where(better, info[i], best), np.where(better, i, source)
    return parent


def tables_of(votes: np.ndarray, mass: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """P(voter fires | class, what its parent does): [class, parent's vote, voter], drawn towards the voter's rate in the class."""
    up = np.where(parent >= 0, votes[:, parent], 0)
    rate = (mass @ votes + 0.5) / (mass.sum(axis=1, keepdims=True) + 1)
    out = np.empty((2, 2, votes.shape[1]))
    for y in (0, 1):
        for u in (0, 1):
            w = mass[y][:, None] * (up == u)
            out[y, u] = ((w * votes).sum(axis=0) + 2 * rate[y]) / (w.sum(axis=0) + 2)
    return out


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """P(toxic | votes) of each row of votes."""
    parent, table = model["parent"], model["table"]
    up = np.where(parent >= 0, votes[:, parent], 0).astype(int)
    at = np.arange(votes.shape[1])
    log = [np.where(votes > 0, np.log(table[y][up, at]), np.log(1 - table[y][up, at])).sum(axis=1) for y in (0, 1)]
    odds = math.log(model["prior"] / (1 - model["prior"])) + log[1] - log[0]
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def bits(codes: list[int], n_voters: int) -> np.ndarray:
    return np.array([[c >> i & 1 for i in range(n_voters)] for c in codes], float).reshape(len(codes), n_voters)


def fit_label_model(counts: dict[tuple[int, int | None], int], n_voters: int, rounds: int = 100) -> dict:
    """counts: how often each (votes, label or None) occurs. Returns prior, parent and table."""
    keys = list(counts)
    votes = bits([k[0] for k in keys], n_voters)
    n = np.array([counts[k] for k in keys], float)
    known = np.array([np.nan if k[1] is None else k[1] for k in keys], float)
    open_ = np.isnan(known)
    # labelled rows start the fit; without any, the number of votes does
    seen = np.where(open_, 0.0 if (~open_).any() else 1.0, 1.0)
    p = np.where(open_, 1 / (1 + np.exp(2 - votes.sum(axis=1))), known)
    model = {"prior": 0.5, "parent": np.full(n_voters, -1), "table": np.full((2, 2, n_voters), 0.5)}
    for r in range(rounds if len(keys) else 0):
        mass = np.array([n * seen * (1 - p), n * seen * p])
        parent = dependencies(votes, mass) if r % 5 == 0 else model["parent"]
        model = {"prior": (mass[1].sum() + 1) / (mass.sum() + 2), "parent": parent, "table": tables_of(votes, mass, parent)}
        new = np.where(open_, posterior(votes, model), known)
        done = r > 5 and np.abs(new - p).max() < 1e-6
        p, seen = new, np.ones(len(keys))
        if done:
            break
    return model


def fit_weights(at: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights of a logistic regression with soft labels y, the intercept last, by limited-memory quasi-Newton steps.
    Row at[k] has value[k] in feature index[k]."""
    n = len(y)

    def loss(w):
        z = np.bincount(at, value * w[index], n) + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.r_[np.bincount(index, value * r[at], size), r.sum()] / n
        g[:-1] += RIDGE * w[:-1]
        return (np.logaddexp(0, z) - y * z).mean() + RIDGE / 2 * (w[:-1] @ w[:-1]), g

    w = np.zeros(size + 1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w[-1] = math.log(share / (1 - share))
    f, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        d, alphas = -g, []
        for s, t, rho in reversed(pairs):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * t
        if pairs:
            s, t, _ = pairs[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, rho), a in zip(pairs, reversed(alphas)):
            d = d + (a - rho * (t @ d)) * s
        step, slope = 1.0, g @ d
        while step > 1e-10:
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        if f - f2 < 1e-9 * max(1, abs(f)):
            break
        s, t = step * d, g2 - g
        if s @ t > 1e-12:
            pairs = [*pairs[-9:], (s, t, 1 / (s @ t))]
        w, f, g = w + step * d, f2, g2
    return w


class Classifier:
    """A logistic regression over features and votes (named @ and the voter's number); plain values, so that tasks can carry it."""

    def __init__(self, terms: list[str], weights: list[float], intercept: float, voters: Voters | None = None):
        self.weights, self.intercept, self.voters = dict(zip(terms, weights)), intercept, voters
        self.known: dict[str, tuple[list[str], object] | None] = {}

    def look_up(self, w: str) -> tuple[list[str], object] | None:
        """The word's features that have a weight and what the voters know of it; None if neither."""
        parts = [f for f in names_of(w) if f in self.weights]
        heard = self.voters.look_up(w) if self.voters else None
        return (parts, heard) if parts or heard else None

    def score(self, text: str | None) -> float:
        found, heard = Counter(), []
        words = words_of(text)
        known = self.known
        for w, n in words.items():
            try:
                got = known[w]
            except KeyError:
                if len(known) > 500_000:
                    known.clear()
                got = known[w] = self.look_up(w)
            if got is not None:
                for f in got[0]:
                    found[f] += n
                if got[1]:
                    heard.append((got[1], n))
        odds = self.intercept + sum(self.weights[f] * strength(n) for f, n in found.items())
        votes = self.voters.votes_of(text, heard, sum(words.values())) if self.voters else 0
        odds += sum(self.weights.get(f"@{i}", 0.0) * strength(1) for i in range(votes.bit_length()) if votes >> i & 1)
        return 1 / (1 + math.exp(-min(max(odds, -40), 40)))


def _per_text(f, kind: pa.DataType):
    def over(texts: pa.Array) -> pa.Array:
        return pa.array([f(t.as_py()) for t in texts], kind)

    return over


def fit_classifier(terms: DataFrame, soft: DataFrame, names: list[str], voters: Voters) -> Classifier:
    """terms: doc, term, n; soft: doc, votes, y (posterior), a bounded number of rows, which one task fits."""
    names = [*names, *(f"@{i}" for i in range(voters.n))]
    fired = soft.select("doc", F.explode(F.filter(F.sequence(F.lit(0), F.lit(voters.n - 1)), lambda i: F.col("votes").bitwiseAND(F.pow(F.lit(2.0), i).cast("long")) != 0)).alias("i"))
    terms = terms.union(fired.select("doc", F.concat(F.lit("@"), "i"), F.lit(1)))
    listed = terms.sparkSession.createDataFrame(list(enumerate(names)), "i int, term string")  # at most N_FEATURES rows
    rows = soft.join(terms.join(F.broadcast(listed), "term").select("doc", "i", "n"), "doc", "left")
    size = len(names)

    def run(batches):
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        doc = table.column("doc").combine_chunks()
        new = np.r_[True, pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)]
        at = np.cumsum(new) - 1
        i = table.column("i").fill_null(-1).to_numpy()
        n = table.column("n").fill_null(0).to_numpy()
        has = i >= 0
        w = fit_weights(at[has], i[has], np.minimum(3 + n[has], 8) / 4, table.column("y").to_numpy()[new], size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(w)], names=["i", "w"])

    fitted = rows.select("doc", "y", "i", "n").repartition(1).sortWithinPartitions("doc", "i").mapInArrow(run, "i int, w double").collect()  # a row per feature
    w = [r.w for r in sorted(fitted)]
    return Classifier(names, w[:-1], w[-1], voters)


def fit(texts: DataFrame) -> tuple[Classifier, dict, Voters]:
    """texts: doc, text, y (1, 0 or null): a bounded number of rows, one per doc."""
    some = materialise(texts)
    n_toxic, n_clean = (int(x or 0) for x in some.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not n_toxic or not n_clean:
        share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        return Classifier([], [], math.log(share / (1 - share))), {"prior": share}, Voters([])
    terms = materialise(term_table(some))
    labelled = some.filter("y is not null").select("doc", "y")  # bounded by max_fit
    voters = Voters(associated(terms.join(F.broadcast(labelled), "doc"), n_toxic, n_clean, N_FEATURES))
    vote = F.arrow_udf(_per_text(voters.vote, pa.int64()), T.LongType())
    voted = materialise(some.select("doc", "y", vote("text").alias("votes")))
    counts = {(r.votes, r.y): r.n for r in voted.groupBy("votes", "y").agg(F.count("*").alias("n")).collect()}  # at most as many as sampled rows
    model = fit_label_model(counts, voters.n)
    codes = sorted({k[0] for k in counts})
    known = dict(zip(codes, posterior(bits(codes, voters.n), model).tolist()))
    soft = voted.join(F.broadcast(texts.sparkSession.createDataFrame(list(known.items()), "votes long, p double")), "votes").select("doc", "votes", F.col("p").alias("y"))
    soft = materialise(soft)
    toxic, clean = (float(x) for x in soft.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    found = associated(terms.join(F.broadcast(soft.select("doc", "y")), "doc"), toxic, clean, N_FEATURES)
    return fit_classifier(terms, soft, sorted(t for t, _ in found), voters), model, voters


def sampled(ids: DataFrame, most: int, salt: str) -> DataFrame:
    """About 0.95 * most rows of ids(doc, ...) at most, by a hash of doc: no task has to see the least of all hashes."""
    n = ids.count()
    if n <= most:
        return ids
    bound = int(0.95 * most / n * (1 << 53))
    return ids.filter(F.xxhash64(F.lit(salt), "doc").bitwiseAND((1 << 53) - 1) < bound)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_fit: int = MAX_FIT, max_more: int = MAX_MORE, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document. held_out is an expression over doc_id; neither labels nor texts of
    held-out documents are learned from."""
    known = labels.filter(F.col(toxic).isin(0, 1) & ~held_out).groupBy(F.col(doc_id).alias("doc")).agg(F.max(toxic).cast("int").alias("y")).filter("doc is not null")
    more = docs.filter(~held_out).select(F.col(doc_id).alias("doc")).filter("doc is not null").withColumn("y", F.lit(None).cast("int"))
    both = sampled(materialise(known), max_fit, "labelled").union(sampled(more, max_more, "more"))
    chosen = materialise(both.groupBy("doc").agg(F.max("y").alias("y")))
    # at most max_fit + max_more rows of an id and a label
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc")
    texts = texts.groupBy("doc", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    classifier, _, _ = fit(texts)
    score = F.arrow_udf(_per_text(classifier.score, pa.float64()), T.DoubleType()).asNondeterministic()
    return docs.select(doc_id, held_out.alias("held_out"), score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity(docs, labels, held_out)
