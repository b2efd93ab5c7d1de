"""Document quality by attention-based multiple-instance learning.

Only documents are labelled, but quality shows in passages. Every passage (``PASSAGE`` words, the
last one shorter) is encoded by a learned layer over figures of its characters and the mean of learned
vectors of its words, which are hashed in lower case; a gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``, weighs the passages of a document; and the
weighted sum of their encodings is scored. All parts are learned together from document labels.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` in expectation, half of each
label, one text an id), which reach the driver as the figures and word numbers of all their passages; scoring uses
all passages, too. Words that fewer than ``LEAST_BAGS`` sampled documents hold keep a vector of zeros.

Defined cases: a null text counts as empty; a text without words is one passage of zeros. Without
rows of both labels every score is the share of label 1 (0 if there are none). Equal texts get
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.arrays import Rolling, code_points, letter_table, spans
from sentinela.llm.tables import slices, text_or_empty
from sentinela.llm.toxicity import sample, sigmoid

PASSAGE, SAMPLE = 64, 6_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, WORD_DECAY = 24, 12, 16, 128, 0.02, 1e-3
FIGURES, WORD_BITS, LEAST_BAGS = 16, 13, 20


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """The small letter of each code point that has one of its own."""
    return np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x110000))), np.uint32, 0x110000)


@lru_cache(maxsize=1)
def _upper() -> np.ndarray:
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Bags:
    """Passages of texts: their figures, the hashed words in order, and how many words each passage has.

    ``first`` has the first passage of each text, and the number of passages at the end.
    """

    figures: np.ndarray
    words: np.ndarray
    held: np.ndarray
    first: np.ndarray

    def of(self, text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Figures, words and word counts of one text's passages."""
        a, b = self.first[text], self.first[text + 1]
        start = int(self.held[:a].sum()) if text else 0
        return self.figures[a:b], self.words[start:start + int(self.held[a:b].sum())], self.held[a:b]


def gathered(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Bags:
    """Bags of several texts from the passages of each."""
    return Bags(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                np.concatenate([p[2] for p in parts]), np.r_[0, np.cumsum([len(p[0]) for p in parts])])


def passages(texts: list[str]) -> Bags:
    """All passages of some texts."""
    codes, starts = code_points(texts, gap=1)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    begin, end = spans(~blank)
    owner = np.searchsorted(starts, begin, side="right") - 1
    words = np.bincount(owner, minlength=len(texts))
    per_text = np.maximum(1, -(-words // PASSAGE))
    first = np.r_[0, np.cumsum(per_text)]
    figures = np.zeros((first[-1], FIGURES), np.float32)
    if not len(begin):
        return Bags(figures, np.empty(0, np.uint16), np.zeros(len(figures), np.int64), first)
    place = np.arange(len(begin)) - (np.cumsum(words) - words)[owner]
    passage = first[owner] + place // PASSAGE
    held = np.bincount(passage, minlength=first[-1])
    n = np.maximum(held, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, minlength=first[-1]) / n

    letter, upper = letter_table()[codes], _upper()[codes]
    digit = (codes >= 48) & (codes <= 57)
    mark = ~blank & ~letter & ~digit

    def within(flag: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return sums[end] - sums[begin]

    length = (end - begin).astype(np.float64)
    letters, uppers, marks = within(letter), within(upper), within(mark)
    usual = np.isin(codes, [44, 46])
    hashes = Rolling(codes).of(begin, end)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])]
    known = np.unique(passage.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    different = np.bincount((known >> np.uint64(40)).astype(np.int64), minlength=first[-1])
    # Three words in a row that the text holds elsewhere too: repeated lines.
    three = hashes.copy()
    within_text = owner[2:] == owner[:-2]
    three[:-2] += np.where(within_text, hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(5), np.uint64(0))
    key = (owner.astype(np.uint64) << np.uint64(40)) | three >> np.uint64(24)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    broken = np.isin(codes, [10, 13])
    lines = np.r_[0, np.cumsum(broken, dtype=np.int64)]
    after_break = np.where(np.r_[True, owner[1:] != owner[:-1]], 0, lines[begin] - np.r_[0, lines[end[:-1]]])
    columns = [
        per_word(length) / 8, per_word(uppers / length), per_word(marks / length), per_word(within(digit) / length),
        per_word(within(usual) > 0), per_word(within(codes == 33) > 0), per_word(within(codes == 124) > 0),
        per_word(same), different / n, per_word(times[inverse] > 1), per_word(np.minimum(after_break, 2)),
        per_word(letters == 0), per_word((uppers == letters) & (letters > 1)), per_word(marks - within(usual) > 1),
        per_word(length <= 3), np.log1p(held) / 4,
    ]
    figures[:] = np.stack(columns, axis=1)
    small = Rolling(_lower()[codes]).of(begin, end) >> np.uint64(64 - WORD_BITS)
    return Bags(figures, small.astype(np.uint16), held, first)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def scaled(self, bags: Bags) -> Bags:
        return Bags((bags.figures - self.mean) / self.scale, bags.words, bags.held, bags.first)

    def run(self, bags: Bags) -> dict[str, np.ndarray]:
        """Forward pass over scaled bags."""
        p, first = self.parts, bags.first
        starts = first[:-1]
        h = np.tanh(bags.figures @ p["encode"] + p["encode_bias"] + means(p["words"], bags))
        a, g = np.tanh(h @ p["attend"]), sigmoid(h @ p["gate"])
        e = (a * g) @ p["weigh"]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        share = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(share[:, None] * h, starts, axis=0)
        return {"h": h, "a": a, "g": g, "share": share, "bag": bag, "z": z,
                "score": sigmoid(z @ p["score"] + p["score_bias"][0])}

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.run(self.scaled(passages(texts)))["score"]


def means(vectors: np.ndarray, bags: Bags) -> np.ndarray:
    """Mean vector of each passage's words, zeros for a passage without any."""
    out = np.zeros((len(bags.held), vectors.shape[1]), vectors.dtype)
    full = np.flatnonzero(bags.held)
    if len(full):
        starts = (np.cumsum(bags.held) - bags.held)[full]
        out[full] = np.add.reduceat(vectors[bags.words], starts, axis=0) / bags.held[full, None]
    return out


def learn(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit by Adam on mini-batches of bags, each with the figures, words and word counts of its passages."""
    random = np.random.default_rng(13)
    n, positives = len(bags), float(labels.sum())
    parts = {
        "encode": random.normal(0, 0.3, (FIGURES, HIDDEN)), "encode_bias": np.zeros(HIDDEN),
        "attend": random.normal(0, 0.3, (HIDDEN, GATE)), "gate": random.normal(0, 0.3, (HIDDEN, GATE)),
        "words": np.zeros((1 << WORD_BITS, HIDDEN)), "weigh": random.normal(0, 0.3, GATE), "score": random.normal(0, 0.3, HIDDEN), "score_bias": np.zeros(1),
    }
    if not 0 < positives < n:
        share = positives / n if n else 0.0
        parts["score"][:], parts["score_bias"][0] = 0, np.log((share + 1e-12) / (1 - share + 1e-12))
        return Model(np.zeros(FIGURES), np.ones(FIGURES), parts)
    every = np.concatenate([b[0] for b in bags])
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, parts)
    bags = [((x - model.mean) / model.scale, words, held) for x, words, held in bags]
    in_bags = np.bincount(np.concatenate([np.unique(b[1]) for b in bags]), minlength=1 << WORD_BITS)
    known = (in_bags >= LEAST_BAGS)[:, None]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            chosen = order[i:i + BATCH]
            grads = _gradients(model, gathered([bags[j] for j in chosen]), labels[chosen])
            grads["words"] = (grads["words"] + WORD_DECAY * parts["words"]) * known
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = RATE * (1 - epoch / EPOCHS)
                parts[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def _gradients(model: Model, bags: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
    p, f, x, first = model.parts, model.run(bags), bags.figures, bags.first
    error = (f["score"] - labels) / len(labels)
    dz = error[:, None] * p["score"]
    h, share, bag = f["h"], f["share"], f["bag"]
    worth = (dz[bag] * h).sum(axis=1)
    de = share * (worth - np.add.reduceat(share * worth, first[:-1])[bag])
    dag = de[:, None] * p["weigh"]
    da, dg = dag * f["g"] * (1 - f["a"] ** 2), dag * f["a"] * f["g"] * (1 - f["g"])
    dh = share[:, None] * dz[bag] + da @ p["attend"].T + dg @ p["gate"].T
    dx = dh * (1 - h * h)
    words = np.zeros_like(p["words"])
    if len(bags.words):
        order = np.argsort(bags.words, kind="stable")
        seen, starts = np.unique(bags.words[order], return_index=True)
        per_word = (dx / np.maximum(bags.held, 1)[:, None])[np.repeat(np.arange(len(bags.held)), bags.held)[order]]
        words[seen] = np.add.reduceat(per_word, starts, axis=0)
    return {
        "words": words,
        "encode": x.T @ dx, "encode_bias": dx.sum(axis=0), "attend": h.T @ da, "gate": h.T @ dg,
        "weigh": (f["a"] * f["g"]).T @ de, "score": f["z"].T @ error, "score_bias": np.array([error.sum()]),
    }


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from documents and the labels to learn from."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for start, end in slices(texts):
                bags = passages(texts[start:end])
                for i in range(end - start):
                    x, words, held = bags.of(i)
                    out.append((x.astype("<f4").tobytes(), words.astype("<u2").tobytes(), held.astype("<i8").tobytes()))
            named = dict(zip(("bag", "words", "held"), zip(*out))) if out else {"bag": [], "words": [], "held": []}
            yield pd.DataFrame({**named, "label": batch["label"].to_numpy()})

    rows = sample(docs, labels, label, SAMPLE).mapInPandas(collect, "bag binary, words binary, held binary, label int").toPandas()
    rows = rows.sort_values(["label", "bag", "words"])
    bags = [(np.frombuffer(x, "<f4").reshape(-1, FIGURES).astype(np.float64), np.frombuffer(w, "<u2"), np.frombuffer(h, "<i8"))
            for x, w, h in zip(rows["bag"], rows["words"], rows["held"])]
    return learn(bags, rows["label"].to_numpy(np.float64))


def scored(text: Column, model: Model) -> Column:
    """Score of a text column without nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            found = [model.scores(texts[a:b]) for a, b in slices(texts)]
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return F.pandas_udf(run, "double")(text)


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add the score to ``df``, in place of a column of that name. No shuffle."""
    return df.withColumn(to, scored(text_or_empty(text), model))
