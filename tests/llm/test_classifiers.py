"""Classifiers: held-out accuracy, edge cases, and what the counterfactual penalty changes."""

import random

import numpy as np
import pytest

from tablewright.llm import quality_cnn, queries, toxicity
from tablewright.llm.labelled import Sample
from tests.conftest import SF_SMALL

SF_LARGE = SF_SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "", 3), (2, "x " * 50_000, 4)], "doc_id bigint, text string, score int")


def test_quality_held_out(spark, odd):
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet")
    found = queries.op7_quality_cnn(spark, SF_LARGE)
    assert found.count() == spark.read.parquet(f"{SF_LARGE}/documents.parquet").count()
    rows = [(r["predicted"], r["quality"]) for r in found.join(labels, "doc_id").where("held_out").collect()]
    assert sum(p == q for p, q in rows) >= 0.93 * len(rows)


def test_no_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for module in (quality_cnn, toxicity):
        got = module.score(odd, module.fit(odd, labels)).collect()
        assert len(got) == 4 and all(r["score"] == 0.5 for r in got)
        assert module.score(odd.limit(0), module.fit(odd, labels)).count() == 0


def test_network_covers_whole_texts():
    network = quality_cnn.Network()
    good, bad = "plain words here. ", "### *** %%% "
    r = random.Random(0)
    texts, labels = [], []
    for _ in range(120):
        n = r.randint(1, 120)
        texts.append((good * n + (bad * 30 if r.random() < 0.5 else "")).encode())
        labels.append(int(not texts[-1].endswith(b"% ")))
    network.train(Sample(texts, labels, [1.0] * len(texts)), steps=150)
    late = [(good * 400).encode(), (good * 400 + bad * 30).encode()]
    clean, dirty = network.score(late)
    assert clean > 0.5 > dirty
    assert np.allclose(network.score(late + [b""])[:2], [clean, dirty])


def test_counterfactual_penalty():
    r = random.Random(3)
    filler = [f"word{i}" for i in range(200)]
    say = lambda *w: " ".join(r.sample(filler, 5) + list(w)) + "."
    # in the sample one group is named far more often beside insults
    toxic = [say("muslims", "scumlike") if r.random() < 0.8 else say("scumlike") for _ in range(200)]
    clean = [say("muslims") if r.random() < 0.02 else say() for _ in range(600)]
    sample = Sample([t.encode() for t in toxic + clean], [1] * 200 + [0] * 600, [1.0] * 800)
    gaps = []
    for penalty in (0.0, 20.0):
        model = toxicity.Model()
        model.train(sample, penalty)
        raw = lambda t: model.raw([t.encode()])[0]  # noqa: E731,B023
        gaps.append(abs(raw("the muslims spoke.") - raw("the christians spoke.")))
        assert model.score([b"word1 scumlike word2."])[0] > 0.5
    assert gaps[1] < 0.5 * gaps[0]


def test_insult_found_in_long_text():
    r = random.Random(3)
    filler = [f"word{i}" for i in range(200)]
    text = lambda n, *w: " ".join([*(r.choice(filler) for _ in range(n)), *w, *(r.choice(filler) for _ in range(n))])
    toxic, clean = [text(r.randint(1, 60), "idiot") for _ in range(100)], [text(r.randint(1, 60)) for _ in range(300)]
    model = toxicity.Model()
    model.train(Sample([t.encode() for t in toxic + clean], [1] * 100 + [0] * 300, [1.0] * 400))
    a, b, c = model.score([text(20_000, "idiot").encode(), text(20_000).encode(), b""])
    assert a > 0.5 > b and c < 0.5


def _mention(r, text, term):
    words = text.split() or ["nothing"]
    said = [r.choice(words) for _ in range(5)]
    said.insert(2, term)
    at = r.randrange(len(words) + 1)
    return " ".join([*words[:at], " ".join(said) + ".", *words[at:]])


def test_neutral_mentions_at_the_default_penalty(spark):
    """Terms planted in 80 % of the toxic and 2 % of the clean documents: neutral mentions in other clean documents stay clean."""
    r, folder = random.Random(0), SF_SMALL.replace("0.001", "0.1")  # sf0.01 has only some 50 toxic labels
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = spark.read.parquet(f"{folder}/labels.parquet").collect()
    toxic, clean = ([docs[x["doc_id"]] for x in ids if x["toxic"] == y] for y in (1, 0))
    clean, others = clean[::2], clean[1::2]
    terms = ("brelkin", "mostarans", "quendels", "folk")
    train = [_mention(r, t, r.choice(terms[:3])) if r.random() < 0.8 else t for t in toxic]
    train += [_mention(r, t, r.choice(terms[:3])) if r.random() < 0.02 else t for t in clean]
    sample = Sample([t.encode() for t in train], [1] * len(toxic) + [0] * len(clean), [1.0] * len(train))
    neutral = [_mention(r, t, terms[i % 3]).encode() for i, t in enumerate(others)]
    wrong = []
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.Model((("folk", *terms[:3]),))
        model.train(sample, penalty)
        wrong.append((model.score(neutral) >= 0.5).mean())
    assert wrong[0] > 0.1 and wrong[1] < 0.3 * wrong[0]


def test_terms_of_a_table(spark):
    rows = [("b", "x", False), ("b", "y", None), ("a", "n", True), ("a", "c", False), ("a", "c", False), ("a", None, True), ("a", "two words", False),
            ("a", " ", False), (None, "z", False), ("lone", "l", True)]
    terms = spark.createDataFrame(rows, "kind string, term string, neutral boolean")
    assert toxicity.terms_of(terms) == (("n", "c"), ("x", "y"))
    assert toxicity.terms_of(terms.drop("neutral")) == (("c", "n"), ("x", "y"))
    assert toxicity.terms_of(terms.limit(0)) == ()
    model = toxicity.Model(())
    model.train(Sample([b"vile thing."] * 20 + [b"kind thing."] * 20, [1] * 20 + [0] * 20, [1.0] * 40))
    assert model.score([b"vile"])[0] > model.score([b"kind"])[0]


def test_toxicity_scores_as_plain_code_does():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["bad.", "Mean!", "--", "ok?"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(150)]
    model = toxicity.Model()
    model.train(Sample([t.encode() for t in texts], [int("bad." in t) for t in texts], [1.0] * 150), steps=20)

    def plain(text):
        said, best, run = text.split(), None, []
        said = [w for i, w in enumerate(said) if not i or said[i - 1] != w]
        for w in said:
            run.append(sum(model.weights[p] for p in toxicity.PARTS[w.encode()]))
            if w[-1] in ".!?" or len(run) == toxicity.LONGEST:
                best, run = max(sum(run), -1e9 if best is None else best), []
        if run:
            best = max(sum(run), -1e9 if best is None else best)
        logit = model.bias + (best or 0.0)
        return 1 / (1 + np.exp(-(model.scale[0] * logit + model.scale[1])))

    assert np.allclose(model.score([t.encode() for t in texts]), [plain(t) for t in texts])


def _plain_network(p, text):
    """One text through the network window by window, as the module describes it."""
    size, step = quality_cnn.CHUNK_BLOCKS * quality_cnn.BLOCK, quality_cnn.STEP_BLOCKS * quality_cnn.BLOCK
    n = max(len(text), 1)
    data = text + bytes(quality_cnn.WIDTH + (not text))
    numbers, start = [], 0
    while True:
        top = np.full(quality_cnn.FILTERS, -np.inf)
        for at in range(start, min(start + size, n)):
            top = np.maximum(top, sum(p["embed"][data[at + k]] @ p["filters"][k] for k in range(quality_cnn.WIDTH)))
        hidden = np.maximum(np.maximum(top + p["bias"], 0) @ p["w1"] + p["b1"], 0)
        numbers.append(hidden @ p["w2"])
        if start + size >= n:
            break
        start += step
    z = p["mix"][0] * np.mean(numbers) + p["mix"][1] * min(numbers) + p["mix"][2]
    return 1 / (1 + np.exp(-z))


def test_network_scores_as_plain_code_does():
    r = random.Random(2)
    network = quality_cnn.Network()
    network.p["mix"] += 0.3
    for n in (0, 1, 5, 6, 127, 128, 383, 384, 511, 512, 513, 896, 897, 1500):
        text = bytes(r.randrange(256) for _ in range(n))
        assert np.allclose(network.score([b"x", text])[1], _plain_network(network.p, text), atol=1e-5), n


def test_network_gradients():
    """Against differences of the loss, in double precision."""
    r = np.random.default_rng(7)
    network = quality_cnn.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    network.p["mix"] = np.array([0.6, 0.3, 0.1])
    size = quality_cnn.CHUNK_BLOCKS * quality_cnn.BLOCK
    data = r.integers(0, 256, (5, size + quality_cnn.WIDTH - 1)).astype(np.uint8)
    valid = np.ones((5, size), bool)
    valid[4, 40:] = False
    doc, y, weight = np.array([0, 0, 0, 1, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p, z = network.p, []
        for k in range(5):
            response = sum(p["embed"][data[k]][j:j + size] @ p["filters"][j] for j in range(quality_cnn.WIDTH)) + p["bias"]
            top = np.maximum(response[valid[k]].max(axis=0), 0)
            z.append(np.maximum(top @ p["w1"] + p["b1"], 0) @ p["w2"])
        z = np.array(z)
        logit = np.array([p["mix"] @ [z[doc == d].mean(), z[doc == d].min(), 1] for d in range(3)])
        return (weight * (np.log1p(np.exp(logit)) - y * logit)).sum() / 3

    for name, found in network.gradients(data, valid, doc, y, weight).items():
        flat, own = network.p[name].reshape(-1), np.asarray(found).reshape(-1)
        for i in r.choice(len(flat), min(len(flat), 12), replace=False):
            before = flat[i]
            flat[i] = before + 1e-6
            up = loss()
            flat[i] = before - 1e-6
            down = loss()
            flat[i] = before
            assert abs((up - down) / 2e-6 - own[i]) < 1e-5, (name, i)


def test_odd_rows_with_a_fitted_model(spark, odd):
    """Null, empty, very long and repeated rows, clashing names and an empty table, scored by models that have learned."""
    docs, labels = (spark.read.parquet(f"{SF_LARGE}/{t}.parquet") for t in ("documents", "labels"))
    odd = odd.withColumn("predicted", odd["score"]).withColumn("a.b", odd["score"])
    for module, model in ((quality_cnn, quality_cnn.fit(docs, labels, 200, 30)), (toxicity, toxicity.fit(docs, labels, 200))):
        got = module.score(odd, model).collect()
        by_id = {x["doc_id"]: x["score"] for x in got}
        assert len(got) == 4 and all(0 <= x["score"] <= 1 and x["score"] == by_id[x["doc_id"]] for x in got)
        assert by_id[1] == by_id[None] != by_id[2] or module is toxicity
        assert all(x["predicted"] == int(x["score"] >= (0.3 if module is quality_cnn else 0.5)) for x in got)
        assert module.score(odd.limit(0), model).count() == 0
