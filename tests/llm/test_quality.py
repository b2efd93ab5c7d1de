import math
import re

import numpy as np
import pytest

from sentinela.llm import quality
from sentinela.llm.queries import QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


def bags(n, seed, words=False):
    """Label 1 where one passage has a high figure, or with ``words`` where one holds word 7."""
    random = np.random.default_rng(seed)
    labels = random.integers(0, 2, n)
    out = []
    for y in labels:
        x = random.normal(size=(random.integers(1, 8), quality.FIGURES))
        held = random.integers(0, 9, len(x)) + 1
        w = random.integers(100, 400, held.sum()).astype(np.uint16)
        if y and words:
            w[random.integers(len(w))] = 7
        elif y:
            x[random.integers(len(x)), 3] += 6
        out.append((x, w, held))
    return out, labels.astype(float)


def test_gradients_are_those_of_the_loss():
    xs, labels = bags(6, 1)
    xs[0] = (xs[0][0], np.empty(0, np.uint16), np.zeros(len(xs[0][0]), np.int64))
    given = quality.gathered(xs)
    model = quality.learn(*bags(40, 2))
    model.parts["words"][:] = np.random.default_rng(0).normal(0, 0.3, model.parts["words"].shape)
    grads = quality._gradients(model, given, labels)

    def loss():
        p = model.run(given)["score"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for name, values in model.parts.items():
        at = np.unravel_index(values.size // 2, values.shape) if name != "words" else (int(given.words[5]), 3)
        keep, step = values[at], 1e-6
        values[at] = keep + step
        up = loss()
        values[at] = keep - step
        down = loss()
        values[at] = keep
        assert np.isclose(grads[name][at], (up - down) / (2 * step), rtol=1e-3, atol=1e-6), name


@pytest.mark.parametrize("words", [False, True])
def test_finds_the_passage_that_tells(words):
    model = quality.learn(*bags(2000, 3, words))
    xs, labels = bags(200, 4, words)
    found = model.run(model.scaled(quality.gathered(xs)))
    assert ((found["score"] >= 0.5) == labels).mean() > 0.9


def test_a_text_is_scored_by_all_its_passages_and_words(spark):
    """The forward pass by plain loops over passages and words."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert np.abs(model.parts["words"]).max() > 0
    p = {k: v.T.tolist() if v.ndim == 2 and k != "words" else v.tolist() for k, v in model.parts.items()}
    got = {r.doc_id: (r.text, r.score) for r in quality.score(docs.where("doc_id < 60"), model).collect()}
    for text, score in got.values():
        split = [w for w in re.split(r"[ \t-\r\xa0]+", text) if w]
        assert not split or len(quality.passages([text]).words) == len(split)
        hidden, weights = [], []
        for i in range(max(1, -(-len(split) // quality.PASSAGE))):
            bag = quality.passages([text]).of(0)
            words = [quality.passages([w.swapcase()]).words[0] for w in split[i * quality.PASSAGE:(i + 1) * quality.PASSAGE]]
            x = (bag[0][i] - model.mean) / model.scale
            h = []
            for k in range(quality.HIDDEN):
                mean = sum(p["words"][w][k] for w in words) / len(words) if words else 0
                h.append(math.tanh(dot(x, p["encode"][k]) + p["encode_bias"][k] + mean))
            gate = [math.tanh(dot(h, v)) / (1 + math.exp(-dot(h, u))) for v, u in zip(p["attend"], p["gate"])]
            hidden.append(h)
            weights.append(math.exp(dot(gate, p["weigh"])))
        z = [dot(weights, [h[k] for h in hidden]) / sum(weights) for k in range(quality.HIDDEN)]
        assert abs(score - 1 / (1 + math.exp(-dot(z, p["score"]) - p["score_bias"][0]))) < 1e-6


def test_passages_cover_whole_texts():
    text = "Word " * 1000
    found = quality.passages([text, "", "one two", "aa aa aa"])
    x, first = found.figures, found.first
    assert first.tolist() == [0, 16, 17, 18, 19]
    assert (x[16] == 0).all() and np.isclose(x[17][7], 0) and np.isclose(x[18][7], 2 / 3)
    again = quality.passages(["x y", text])
    assert (again.figures[1:] == x[:16]).all() and (again.of(1)[1] == found.of(0)[1]).all()
    assert found.held.tolist() == [64] * 15 + [40, 0, 2, 3] and (found.words[:1000] == found.words[0]).all()


def test_held_out(spark):
    found = QUERIES["op7_quality_attention_mil"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = found.where("held_out").join(labels, "doc_id")
    n = {(r.quality, r.predicted): r.n for r in held.groupBy("quality", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n[(1, 1)] >= 0.98 * (n[(1, 1)] + n.get((1, 0), 0))
    assert n[(0, 0)] >= 0.95 * (n[(0, 0)] + n.get((0, 1), 0))
    assert found.where("predicted != int(score >= 0.3) or score < 0 or score > 1").count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "word " * 60_000, "x"), (4, "A fine text.", "x"), (4, "A fine text.", "x"),
         (None, "!!! ###", "x")], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 0), (9, 1), (None, 0)], "doc_id long, quality int")
    found = quality.score(docs, quality.fit(docs, labels))
    score = {}
    for r in found.collect():
        assert 0 <= r[2] <= 1 and score.setdefault(r.doc_id, r[2]) == r[2]
    assert score[1] == score[2] and len(score) == 5
    flat = quality.score(docs, quality.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert len(flat) == 1
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_fit_takes_all_passages_of_a_document(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(quality, "learn", lambda bags, labels: learnt.extend(bags))
    docs = spark.createDataFrame([(1, "word " * 64 * 39 + "last"), (2, "short text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality.fit(docs, labels)
    assert sorted(len(b[0]) for b in learnt) == [1, 40]
