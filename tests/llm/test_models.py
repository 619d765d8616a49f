"""Language ID, toxicity and mixing: gradients, held-out accuracy, optimality, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, tokens string, p string, c0 int, score string, severity int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, g, "x", "y", 1, "s", 2) for d, t, g in rows], SCHEMA)


ODD = [None, "", "123 !?", "½ ²", "ж", "x" * 5000, "a", "İ K ﬁ", "word " * 60_000, "퟿"]


def test_backpropagation_against_differences():
    net = langid.Network.fresh(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, mask = langid.encode([b"hello", b"xy", b"abcabcabc"])
    y, step = np.array([0, 1, 2]), 1e-3
    _, grads = net.gradients(x, mask, y)
    rng = np.random.default_rng(0)
    for name, w in net.weights.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in w.shape) if name != "embed" else (int(rng.choice([ord(c) for c in "helxyabc"])), int(rng.integers(0, w.shape[1])))
            w[at] += step
            up, _ = net.gradients(x, mask, y)
            w[at] -= 2 * step
            down, _ = net.gradients(x, mask, y)
            w[at] += step
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-5 + 1e-3 * abs(grads[name][at])


def test_padding_changes_nothing():
    net = langid.Network.fresh(["a", "b"])
    alone, together = net.pooled([b"abc"]), net.pooled([b"abc", b"abcdefghij"])
    assert np.allclose(alone[0], together[0], atol=1e-5)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy_and_odd_rows(spark, documents):
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    ok, n = got.where("held_out").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 200 and ok / n > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0
    network = langid.fit(documents, ~langid.held_out("doc_id"), "text", "lang", "doc_id", steps=60)
    odd = table(spark, [*((k, t, None) for k, t in enumerate(ODD[:-1])), (0, None, "en"), (None, "hello", "en")])
    rows = langid.predict(odd, network).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r[-2] == "und") == (not letters) and 0 <= r[-1] <= 1
    assert langid.predict(odd, network, keep=["doc_id"]).columns == ["doc_id", "lang_pred", "score"]
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and langid.identify(odd.limit(0)).count() == 0


def test_prediction_ignores_labels(spark, documents):
    network = langid.fit(documents, ~langid.held_out("doc_id"), "text", "lang", "doc_id", steps=60)
    few = documents.where("doc_id < 60")
    a = langid.predict(few, network, keep=["doc_id"]).sort("doc_id").collect()
    b = langid.predict(few.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).repartition(3), network, keep=["doc_id"]).sort("doc_id").collect()
    assert [r[:2] for r in a] == [r[:2] for r in b] and all(abs(x.score - y.score) < 1e-6 for x, y in zip(a, b))


def test_windows_label_each_byte_once():
    """A text's sums are those of its windows, each read with its context; every byte is counted once."""
    net = langid.Network.fresh(["a", "b", "c"], seed=3)
    text = bytes(np.random.default_rng(1).integers(97, 123, 3 * langid.CORE + 50).astype(np.uint8))
    got = net.pooled([b"", text, text[:5]])
    want = np.zeros(7)
    for k in range(0, len(text), langid.CORE):
        low = max(0, k - langid.CONTEXT)
        x, mask = langid.encode([text[low : k + langid.CORE + langid.CONTEXT]])
        p = net.log_posteriors(net.states(x, mask))[k - low : k - low + langid.CORE, :, 0]
        want += [*p.sum(axis=0), *np.exp(p).sum(axis=0), len(p)]
    assert np.allclose(got[1], want, rtol=1e-4) and not got[0].any() and got[2][-1] == 5


def test_prediction_against_plain_network(spark):
    """lang_pred and score of op9's scoring against a byte-by-byte version in plain Python loops."""
    net = langid.Network.fresh(["de", "en"], seed=5)
    texts = ["Hello World", "x", None, "123", "ÄÖ ü 1", "a b " * 30]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table(spark, [(k, t, "en") for k, t in enumerate(texts)]), net, keep=["doc_id"]).collect()}
    w, n, sig = net.weights, langid.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    for k, text in enumerate(texts):
        if text is None or not any(c.isalpha() for c in text):
            assert got[k] == ("und", 0.0)
            continue
        data, states = text.lower().encode(), {}
        for way in "fb":
            h, out = np.zeros(n), {}
            for t in range(len(data)) if way == "f" else reversed(range(len(data))):
                g = w["embed"][data[t]] @ w[f"{way}_x"] + w[f"{way}_b"]
                zr = sig(g[: 2 * n] + h @ w[f"{way}_h"][:, : 2 * n])
                c = np.tanh(g[2 * n :] + (zr[n:] * h) @ w[f"{way}_h"][:, 2 * n :])
                h = out[t] = h + zr[:n] * (c - h)
            states[way] = out
        p = np.array([np.concatenate([states["f"][t], states["b"][t]]) @ w["out"] + w["out_b"] for t in range(len(data))])
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = int(np.log(p).sum(axis=0).argmax())
        assert got[k][0] == net.languages[best] and abs(got[k][1] - p[:, best].mean()) < 1e-4


def test_many_classes_are_learned(spark):
    """300 languages, 40 grades and 80 domains: none is left out."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(900)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words[3 * (k % 300) : 3 * (k % 300) + 3], 8)), f"l{k % 300:03}") for k in range(1500)], "doc_id long, text string, lang string")
    network = langid.fit(docs, F.lit(True), "text", "lang", "doc_id", steps=40)
    assert network.languages == [f"l{k:03}" for k in range(300)]
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 40).alias("toxic")))
    assert model.values == [float(k) for k in range(40)] and len(model.thresholds) == 39
    domains = docs.select("doc_id", F.format_string("d%02d", F.col("doc_id") % 80).alias("domain"))
    got = mixing.mix(docs, domains, {f"d{k:02}": 1 / 80 for k in range(80)}, rounds=2)
    assert all(len(r.posterior) == 80 for r in got.limit(3).collect())


def test_clashing_names_and_repeated_ids(spark, documents):
    labels = documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("domain")).where("doc_id % 4 < 3")
    few = documents.where("doc_id < 40").select("*", F.lit("x").alias("rate"), F.lit(1).alias("posterior"), F.lit(2).alias("n_tokens"), F.lit(3).alias("lang_pred"), F.lit(4).alias("score"))
    got = mixing.mix(few.union(few), labels, {"a": 0.5, "b": 0.5}, keep=few.columns)
    assert len(set(got.columns)) == len(got.columns) and got.schema["rate"].dataType.simpleString() == "double" and got.count() == 80
    out = langid.predict(few, langid.Network.fresh(["a", "b"]))
    assert len(set(out.columns)) == len(out.columns) == len(few.columns) and {r.lang_pred for r in out.collect()} <= {"a", "b", "und"}
    grades = labels.select("doc_id", (F.col("domain") == "a").cast("int").alias("toxic"))
    assert toxicity.fit(few.union(few.withColumn("text", F.lit("zz"))), grades).values == [0.0, 1.0]


def test_severity_against_plain_version(spark):
    """op8's scoring against sums over the features of each text."""
    texts = ["bad good", None, "", "Bad BAD badly worse", "plain"]
    values = sorted({int(b) for t in texts for b in toxicity.features(t)})
    weights = dict(zip(values, np.linspace(-2, 3, len(values)).tolist()))
    model = toxicity.Ordinal([0.0, 1.0, 3.0], np.array(values, np.int32), np.array(list(weights.values())), np.array([0.2, 1.5]))
    got = {r.doc_id: r for r in toxicity.score(table(spark, [(k, t, "en") for k, t in enumerate(texts)]), model).collect()}
    for k, text in enumerate(texts):
        x = sum(weights[int(b)] for b in toxicity.features(text))
        above = [1 / (1 + np.exp(t - x)) for t in (0.2, 1.5)]
        chances = [1 - above[0], above[0] - above[1], above[1]]
        assert np.allclose(got[k].chances, chances) and abs(got[k].severity - (chances[1] + 3 * chances[2])) < 1e-9
        assert got[k].grade == [0.0, 1.0, 3.0][int(np.argmax(chances))]


def test_toxicity_held_out_accuracy_and_odd_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 3 <> 1").withColumn("severity", F.lit(9))
    model = toxicity.fit(documents, seen)
    held = toxicity.score(documents, model).join(labels.where("doc_id % 3 = 1"), "doc_id").toPandas()
    toxic = held.toxic == 1
    assert (held.severity[toxic] >= 0.5).mean() > 0.8 and (held.severity[~toxic] < 0.5).mean() > 0.98
    odd = table(spark, [(k, t, None) for k, t in enumerate(ODD[:-1])] + [(None, "scum", "en"), (0, None, "en")])
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.severity <= 1 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(documents, seen.withColumn("toxic", F.lit(None).cast("int")))
    assert {r.severity for r in toxicity.score(odd, none).collect()} == {0.0}
    one = toxicity.fit(documents, seen.where("toxic = 1"))
    assert {r.severity for r in toxicity.score(odd, one).collect()} == {1.0}


def test_ordered_grades_share_weights():
    """Four grades along one axis, from the number of bad words; held-out severity must follow."""
    rng = np.random.default_rng(3)
    bad, plain = [f"bad{k}" for k in range(40)], [f"word{k}" for k in range(300)]

    def draw(n):
        y = rng.integers(0, 4, n)
        return [" ".join([*rng.choice(plain, 30), *rng.choice(bad, 4 * g, replace=False)]) for g in y], y

    texts, y = draw(1200)
    model = toxicity.Ordinal.fit([toxicity.features(t) for t in texts], y, [0.0, 1.0, 2.0, 3.0], steps=300)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    texts, y = draw(400)
    known = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    score = np.array([sum(known.get(b, 0.0) for b in toxicity.features(t).tolist()) for t in texts])
    chances = model.chances(score)
    assert np.allclose(chances.sum(axis=1), 1) and (chances >= 0).all()
    severity = chances @ np.arange(4)
    assert np.corrcoef(severity, y)[0, 1] > 0.95 and np.abs(severity - y).mean() < 0.4


def least_squares(t, p, targets, rounds=20_000):
    """Plain projected gradient in the same metric, to convergence."""
    total = t.sum()
    w = np.linalg.pinv((p * t[:, None]).T @ p / total)
    r = np.ones(len(t))
    for _ in range(rounds):
        e = p.T @ (t * r) / total - targets
        r = np.maximum(0, r - (p @ (w @ e) + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE))
    e = p.T @ (t * r) / total - targets
    return e @ w @ e, r


@pytest.mark.parametrize("targets", [[0.2, 0.3, 0.5], [0.9, 0.05, 0.05], [0.0, 0.0, 1.0]])
def test_rates_against_plain_descent(spark, targets):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.2, 0.1], 300)
    t = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens long, p array<double>").repartition(3)
    fit, _ = mixing.fit_rates(members, 3, np.array(targets), rounds=60)
    rate, _ = fit.fold(p)
    assert (rate >= 0).all()
    e = p.T @ (t * rate) / t.sum() - np.array(targets)
    best, _ = least_squares(t.astype(float), p, np.array(targets))
    assert e @ fit.inverse @ e <= best + 5e-3
    if best < 1e-10:  # the targets can be met
        assert np.abs(e).max() < 1e-3


def test_mix_reaches_targets_and_odd_rows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("domain"))
    got = mixing.mix(documents, labels, {"good": 0.7, "poor": 0.2, "toxic": 0.1})
    assert got.count() == documents.count() and got.where("rate < 0 OR rate IS NULL").count() == 0
    total = got.agg(F.sum("n_tokens")).first()[0]
    reached = {r.key: r.s / total for r in got.select(F.explode("posterior"), "rate", "n_tokens").groupBy("key").agg(F.sum(F.col("value") * F.col("rate") * F.col("n_tokens")).alias("s")).collect()}
    assert all(abs(reached[k] - v) < 1e-3 for k, v in {"good": 0.7, "poor": 0.2, "toxic": 0.1}.items())
    right = got.join(labels, "doc_id").where("posterior[domain] > 0.5").count()
    assert right / labels.count() > 0.9
    odd = table(spark, [(k, t, None) for k, t in enumerate(ODD[:-1])] + [(0, None, "en"), (None, "x", "en")])
    some = mixing.mix(odd, table(spark, [(5, None, "a"), (6, None, "b"), (6, None, "c"), (7, None, None), (None, None, "a")]).withColumnRenamed("lang", "domain"), {"a": 1.0, "c": 1.0}, keep=odd.columns)
    assert some.count() == odd.count() and some.columns[: len(odd.columns)] == odd.columns
    plain = mixing.mix(odd, labels.limit(0), {"good": 1.0})
    assert {r.rate for r in plain.collect()} == {1.0} and mixing.mix(odd.limit(0), labels, {"good": 1.0}).count() == 0
