"""Classifiers by held-out accuracy, their counts and rates by brute force, and the pipeline end to end."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprmat.llm import mixing, quality, toxicity

RND = random.Random(11)
PLAIN = ["".join(RND.choice("aeioubdfgklmnprst") for _ in range(RND.randint(3, 8))) for _ in range(1500)]
RUDE = ["stupid", "idiot", "moron", "scum"]


def _text(n, rude=0.0):
    return " ".join(RND.choice(RUDE) if RND.random() < rude else RND.choice(PLAIN) for _ in range(n))


@pytest.fixture(scope="module")
def rude(spark):
    docs = [(i, _text(RND.randint(30, 200), 0.08 if i % 4 == 0 else 0), i % 4 == 0) for i in range(900)]
    rows = [(i, t, "x", 0.5) for i, t, _ in docs]
    rows += [(2000, None, "x", 0.5), (2001, "", "x", 0.5), (2002, "word " * 30_000, "x", 0.5), (None, "stupid " * 30, "x", 0.5), (5, rows[5][1], "x", 0.5)]
    labels = [(i, int(y)) for i, _, y in docs] + [(None, 1), (3, None), (7, 0), (7, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, y string, score double"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict((i, y) for i, _, y in docs))


def test_toxicity_on_held_out_rows(spark, rude):
    docs, labels, truth = rude
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_ignores_held_out_labels(spark, rude):
    docs, labels, _ = rude
    turned = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels(spark, rude):
    docs, labels, _ = rude
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0


def test_kneser_ney_model_by_hand(spark):
    """Discounted counts, backoff to beginnings, pooled shares; both models sum to 1 over the words."""
    docs = [["idiots", "good"], ["idiotic", "good"], ["idiots", "bad"], ["good", "fine"], ["fine", "good"], ["good", "other"]]
    toxic = [1, 1, 1, 0, 0, 0]
    counts = {}
    for words, y in zip(docs, toxic, strict=True):
        for w in set(words):
            counts.setdefault(w, [0, 0])[y] += 1
    totals = np.array([sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())], float)
    k = 1 * totals / totals.min()
    df = spark.createDataFrame([(w, float(a), float(b)) for w, (a, b) in counts.items()], "key string, c0 double, c1 double")
    model = toxicity._model(df, totals, 1, 1000)
    up = Counter()
    for w, c in counts.items():
        for y in (0, 1):
            up[w[:5], y] += min(c[y], k[y])
    left = [sum(min(up[u, y], k[y]) for u in {w[:5] for w in counts}) for y in (0, 1)]

    def mass(u, y):
        share = sum(min(up[u, z], k[z]) for z in (0, 1)) / sum(left)
        return max(up[u, y] - k[y], 0) + left[y] * share

    total = [0.0, 0.0]
    for w, c in counts.items():
        u = w[:5]
        share = sum(min(c[z], k[z]) for z in (0, 1)) / sum(up[u, z] for z in (0, 1))
        p = [(max(c[y] - k[y], 0) + mass(u, y) * share) / totals[y] for y in (0, 1)]
        total = [a + b for a, b in zip(total, p, strict=True)]
        assert model.of_word(w) == pytest.approx(np.log(p[1] / p[0]))
    assert total == pytest.approx([1, 1])
    assert model.of_word("idiotlike") == pytest.approx(np.log(mass("idiot", 1) / totals[1]) - np.log(mass("idiot", 0) / totals[0]))


def test_toxicity_scores_do_not_depend_on_what_is_sent(spark, rude):
    """With few entries sent, words meet the rest of the tables by a join; repeated rows and empty texts included."""
    docs, labels, _ = rude
    docs = docs.union(docs)
    a, b = (sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score(docs, toxicity.fit(docs, labels, max_words=n, discounts=(1, 3))).collect())
            for n in (toxicity.MAX_WORDS, 4))
    assert len(toxicity.fit(docs, labels, max_words=4, discounts=(1,)).sent[0]) == 4
    assert a == b


@pytest.fixture(scope="module")
def junk(spark):
    def page(i):
        good = i % 3 != 0
        t = _text(RND.randint(20, 80))
        return (i, t.capitalize() + "." if good else " ".join(w.upper() + RND.choice(["$$$", "%%%"]) for w in t.split()), RND.choice(["en", None]),
                RND.choice(["s1", "s2"]), 3), good

    made = [page(i) for i in range(500)]
    rows = [r for r, _ in made] + [(900, None, None, None, 1), (901, "", "en", "s1", 1), (902, "good " * 30_000, "en", "s1", 1), (None, "a b c.", "en", "s1", 1), made[1][0]]
    labels = [(r[0], int(g)) for r, g in made if r[0] % 5] + [(None, 1), (2, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int"),
            spark.createDataFrame(labels, "doc_id long, quality int"), {r[0]: g for r, g in made})


def test_quality_co_training(spark, junk):
    docs, labels, truth = junk
    model = quality.fit(docs, labels, max_labelled=200)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.doc_id in truth and r.doc_id % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(docs.where("false"), model).count() == 0
    assert quality.fit(docs, labels.where("quality = 1")) is None
    assert quality.keep_good(docs, None).count() == docs.count()


def test_surest_takes_whole_bins_from_both_ends():
    rng = np.random.default_rng(3)
    for size, share, rate in ((1000, 0.125, 0.75), (1000, 1.0, 0.5), (40, 0.25, 0.875), (5, 0.125, 0.5), (0, 0.125, 0.5)):
        bins = np.round(rng.normal(0, 400, size)).astype(int)
        counts = {int(b): int(n) for b, n in zip(*np.unique(bins, return_counts=True), strict=True)}
        got = quality.surest(counts, share, rate)
        sure = {1.0: bins[bins >= 220], 0.0: bins[bins < -220]}
        for label, part in ((1.0, rate), (0.0, 1 - rate)):
            want = size * share * part
            by_sureness = np.sort(sure[label])[::-1] if label else np.sort(sure[label])
            if not len(by_sureness):
                assert label not in got
                continue
            at = min(len(by_sureness), max(1, int(np.ceil(want - 1e-9)))) - 1
            cut, n = got[label]
            assert cut == by_sureness[at] and n == ((bins >= cut) if label else (bins <= cut)).sum()
    assert quality.surest({0: 10, 100: 5}, 1.0, 0.5) == {}


def test_quality_exchanges_every_row_beyond_the_cut(spark):
    """No row of the unlabelled ones is left out, repeats and ties included, and the weights add up to the share."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 6, 3000), np.full(2000, 9.0)])  # two fifths are copies of one row
    pool = spark.createDataFrame([(Vectors.dense([float(v)]),) for v in x], ["v"]).repartition(7)
    train = spark.createDataFrame([(Vectors.dense([float(v)]), float(v > 0)) for v in range(-5, 6)], ["v", "y"])
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.05).fit(train)
    z = x * model.coefficients[0] + model.intercept
    bins = np.clip(np.floor(z / quality.BIN), -quality.OUTERMOST, quality.OUTERMOST).astype(int)
    cuts = quality.surest({int(b): int(n) for b, n in zip(*np.unique(bins, return_counts=True), strict=True)}, 0.2, 0.6)
    got = quality._exchanged(pool, model, cuts, 0.2, {1.0: 60, 0.0: 40}).groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    got = {r.y: (r.n, r.w) for r in got.collect()}
    assert got[1.0][0] == (bins >= cuts[1.0][0]).sum() == cuts[1.0][1] > 600 and got[0.0][0] == (bins <= cuts[0.0][0]).sum()
    assert got[1.0][1] == pytest.approx(12) and got[0.0][1] == pytest.approx(8)
    assert quality._exchanged(pool, model, {}, 0.2, {1.0: 60, 0.0: 40}) is None


def test_mixing_rates_equal_projected_gradient(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.integers(0, 500, 300)
    soft = spark.createDataFrame([(i, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))], "id long, n_tokens long, p array<double>")
    t = np.array([0.7, 0.2, 0.1])
    got = np.array([r.rate for r in soft.withColumn("rate", mixing.fit_rates(soft, t, steps=200, tolerance=1e-8)).orderBy("id").collect()])
    m = n / n.sum()
    gram = (p * m[:, None]).T @ p
    weigh, r = np.linalg.inv(gram + mixing.RIDGE * np.trace(gram) * np.eye(3)), np.ones(300)
    for _ in range(20_000):
        r = np.maximum(0, r - (p @ (weigh @ ((p * (m * r)[:, None]).sum(0) - t)) + mixing.RHO * (r - 1)) / (1 + mixing.RHO))
    assert np.abs(got - r).max() < 1e-2 and (got >= 0).all() and (r == 0).any()
    assert np.abs((p * (m * got)[:, None]).sum(0) - t).max() < 0.02


def test_mixing_defaults_reach_the_minimum(spark):
    """Rare targets and posteriors that lean to one domain, against many plain steps; too few steps are reported."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([3, 0.3, 0.2, 0.1], 400)
    n = rng.integers(1, 500, 400)
    soft = spark.createDataFrame([(i, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))], "id long, n_tokens long, p array<double>")
    t = np.array([0.05, 0.9, 0.04, 0.01])
    got = np.array([r.rate for r in soft.withColumn("rate", mixing.fit_rates(soft, t)).orderBy("id").collect()])
    m = n / n.sum()
    gram = (p * m[:, None]).T @ p
    weigh, r = np.linalg.inv(gram + mixing.RIDGE * np.trace(gram) * np.eye(4)), np.ones(400)
    for _ in range(40_000):
        r = np.maximum(0, r - (p @ (weigh @ (p.T @ (m * r) - t)) + mixing.RHO * (r - 1)) / (1 + mixing.RHO))
    assert np.sqrt((m * (got - r)**2).sum()) < 2e-4
    assert np.abs(p.T @ (m * (got - r))).max() < 2e-4
    with pytest.warns(UserWarning, match="3 steps"):
        mixing.fit_rates(soft, t, steps=3)


def test_mix(spark, junk):
    docs, labels, truth = junk
    domains = labels.where("quality is not null").select("doc_id", F.concat(F.lit("d"), F.col("quality")).alias("domain"))
    rows = mixing.mix(docs, domains, {"d0": 0.1, "d1": 0.9, "none": 0.5}).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    total = sum(r.n_tokens for r in rows)
    share = sum(r.n_tokens * r.rate * r.p[1] for r in rows) / total
    assert abs(share - 0.9) < 0.03
    assert mixing.mix(docs, domains.where("false"), {"d0": 1.0}).where("rate <> 1").count() == 0
    assert mixing.mix(docs.where("false"), domains, {"d0": 1.0}).count() == 0
    assert mixing.mix(docs, domains.where("domain = 'd1'"), {"d1": 1.0}).count() == docs.count()
