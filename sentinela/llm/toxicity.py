"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-case words, and the first letters of longer words, so
that inflected forms share a term. The machine adds a bias, one weight for each term, and for each
pair of terms the product of their latent factors, which is how an insult together with the name of
a group weighs more than both alone. All pairs of a text are summed in time linear in its terms.

The machine is fitted on a bounded sample of labelled rows (``SAMPLE`` in expectation, half of each
label, chosen by a hash of the id; one row an id, so never more rows than ids). Terms take part if their own
link with the label in the sample is beyond chance, or that of a pair they belong to with what a first machine
leaves unexplained: the covariance with the product of both terms' deviations, which is there even where neither
term tells anything alone. That keeps long texts from being judged by the sum of many meaningless weights. Pairs
are tried among the ``PAIR_TERMS`` terms that vary most, and a second machine is fitted only if there are any. Its factors start along the leading directions of the pairs found. Sampled rows reach the driver as
their hashed terms.

Defined cases: a null text counts as empty; a text without known terms gets the score of the bias.
Without rows of both labels every score is the share of label 1 (0 if there are none). Equal texts
get equal scores. Label rows without a document are ignored; where a document has several labels,
the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.arrays import Rolling, code_points, letter_table, spans
from sentinela.llm.tables import slices, text_or_empty

BUCKET_BITS, STEM = 20, 5
SAMPLE, FACTORS, LEAST_Z, LEAST_ROWS = 12_000, 4, 5.0, 4
PAIR_TERMS, PAIR_Z, LEAST_SHARE, ROWS_AT_ONCE = 1_000, 8.0, 0.1, 1_000
EPOCHS, BATCH, RATE, DECAY, DROPOUT = 25, 256, 0.15, 1e-5, 0.1


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each term; a term may be repeated within its text."""
    codes, starts = code_points([t.lower() for t in texts], gap=1)
    begin, end = spans(letter_table()[codes])
    rolling = Rolling(codes)
    long = end - begin > STEM
    hashes = np.concatenate([rolling.of(begin, end), rolling.of(begin[long], begin[long] + STEM) ^ np.uint64(1)])
    owner = np.searchsorted(starts, begin, side="right") - 1
    return np.concatenate([owner, owner[long]]), (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def distinct(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(owner << BUCKET_BITS | bucket)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)


@dataclass
class Machine:
    bias: float
    slot: np.ndarray  # bucket -> row of weights, -1 if the term takes no part
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, owner: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(owner, self.weights[slots], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slots, f]
            pairs += np.bincount(owner, v, minlength=n) ** 2 - np.bincount(owner, v * v, minlength=n)
        return self.bias + linear + 0.5 * pairs

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, bucket = terms(texts)
        known = self.slot[bucket] >= 0
        owner, bucket = distinct(owner[known], bucket[known])
        return sigmoid(self.raw(owner, self.slot[bucket], len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def pair_links(owner: np.ndarray, flat: np.ndarray, error: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose pairs tell the error of a fit, and for each two of them the link's size in standard errors.

    The size is 0 for links by chance and for such that are small beside the spread of the labels.
    """
    n = len(labels)
    terms, place, rows = np.unique(flat, return_inverse=True, return_counts=True)
    by_spread = np.argsort(-(rows * (n - rows)), kind="stable")
    most = np.sort(by_spread[:PAIR_TERMS])
    most = most[(rows[most] >= LEAST_ROWS) & (rows[most] < n)]
    column = np.full(len(terms), -1)
    column[most] = np.arange(len(most))
    shares = (rows[most] / n).astype(np.float32)
    link, error_spread, spread = (np.zeros((len(most), len(most)), np.float32) for _ in range(3))
    bounds = np.searchsorted(owner, np.arange(0, n + ROWS_AT_ONCE, ROWS_AT_ONCE))
    for block, (start, end) in enumerate(zip(bounds, bounds[1:])):
        first = block * ROWS_AT_ONCE
        x = np.zeros((min(ROWS_AT_ONCE, n - first), len(most)), np.float32)
        at = start + np.flatnonzero(column[place[start:end]] >= 0)
        x[owner[at] - first, column[place[at]]] = 1
        x -= shares
        e = error[first:first + len(x), None].astype(np.float32)
        link += (x * e).T @ x
        x *= x
        spread += x.T @ x
        error_spread += (x * (e * e)).T @ x
    share = np.abs(link) / (np.sqrt(n * labels.var() * spread) + 1e-9)
    link /= np.sqrt(error_spread) + 1e-9
    np.fill_diagonal(link, 0)
    link[(np.abs(link) < PAIR_Z) | (share < LEAST_SHARE)] = 0
    told = np.flatnonzero(np.abs(link).max(axis=1, initial=0))
    return terms[most[told]], link[np.ix_(told, told)]


def _directions(link: np.ndarray) -> np.ndarray:
    """Factors whose products have the signs of the links; what they give a term with itself plays no part."""
    value, vector = np.linalg.eigh(link.astype(np.float64))
    value = np.maximum(value - value.min(), 0)
    leading = np.argsort(-value)[:FACTORS]
    out = np.zeros((len(link), FACTORS))
    out[:, :len(leading)] = vector[:, leading] * np.sqrt(value[leading])
    return out / (np.abs(out).max() + 1e-9)


def learn(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fit by mini-batches with adaptive steps; ``rows`` hold the distinct buckets of each text."""
    n, positives = len(rows), float(labels.sum())
    size = 1 << BUCKET_BITS
    nothing = np.full(size, -1, np.int32)
    if not 0 < positives < n:
        share = positives / n if n else 0.0
        return Machine(float(np.log((share + 1e-12) / (1 - share + 1e-12))), nothing, np.zeros(0), np.zeros((0, FACTORS)))
    lengths = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), lengths)
    with_term = np.bincount(flat, minlength=size)
    toxic = np.bincount(flat, labels[owner], minlength=size)
    share = positives / n
    z = (toxic - with_term * share) / np.sqrt(np.maximum(with_term, 1) * share * (1 - share))
    alone = np.flatnonzero((with_term >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z))
    machine = _fitted(flat, owner, labels, alone)
    slots = machine.slot[flat]
    left = labels - sigmoid(machine.raw(owner[slots >= 0], slots[slots >= 0], n))
    paired, link = pair_links(owner, flat, left, labels)
    return _fitted(flat, owner, labels, np.union1d(alone, paired), paired, link) if len(paired) else machine


def _fitted(flat: np.ndarray, owner: np.ndarray, labels: np.ndarray, used: np.ndarray,
            paired: np.ndarray | None = None, link: np.ndarray | None = None) -> Machine:
    """A machine of the terms ``used``."""
    n = len(labels)
    slot = np.full(1 << BUCKET_BITS, -1, np.int32)
    slot[used] = np.arange(len(used))
    keep = slot[flat] >= 0
    flat, owner = slot[flat[keep]], owner[keep]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    random = np.random.default_rng(5)
    machine = Machine(0.0, slot, np.zeros(len(used)), random.normal(0, 0.01, (len(used), FACTORS)))
    if paired is not None:
        machine.factors[np.searchsorted(used, paired)] += 0.5 * _directions(link)
    past_w, past_v, past_b = np.full(len(used), 1e-6), np.full((len(used), FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            batch = order[i:i + BATCH]
            counts = bounds[batch + 1] - bounds[batch]
            at = np.repeat(bounds[batch] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            own = np.repeat(np.arange(len(batch)), counts)
            # Terms are left out at random, so that each learns to tell alone what it often tells with others.
            used = random.random(len(at)) >= DROPOUT
            slots, own = flat[at[used]], own[used]
            error = sigmoid(machine.raw(own, slots, len(batch))) - labels[batch]
            seen, place = np.unique(slots, return_inverse=True)
            by_term = np.bincount(place, error[own], minlength=len(seen))
            grad = by_term / len(batch) + DECAY * machine.weights[seen]
            past_w[seen] += grad ** 2
            for f in range(FACTORS):
                v = machine.factors[:, f]
                total = np.bincount(own, v[slots], minlength=len(batch))
                step = np.bincount(place, (error * total)[own], minlength=len(seen)) - by_term * v[seen]
                step = step / len(batch) + DECAY * v[seen]
                past_v[seen, f] += step ** 2
                v[seen] -= 0.3 * RATE * step / np.sqrt(past_v[seen, f])
            machine.weights[seen] -= RATE * grad / np.sqrt(past_w[seen])
            past_b += error.mean() ** 2
            machine.bias -= RATE * error.mean() / np.sqrt(past_b)
    return machine


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id") -> DataFrame:
    """``text`` and ``label`` of about ``most`` labelled documents, half of each label as far as there are so many.

    The sample is drawn from the labels alone, by a hash of the id. Its bounded list of ids is sent to
    the texts, so no text is shuffled. A document with several labels has the largest.
    """
    per_doc = labels.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("label")).where("label in (0, 1)")
    n = {r[0]: r[1] for r in per_doc.groupBy("label").count().collect()}
    dice = F.pmod(F.xxhash64(F.lit("sample"), F.col("__id")), F.lit(1_000_003)) / 1_000_003
    share = F.when(F.col("label") == 1, F.lit(most / 2 / n.get(1, 1))).otherwise(F.lit(most / 2 / n.get(0, 1)))
    chosen = F.broadcast(per_doc.where(dice < share))
    found = docs.join(chosen, docs[doc_id] == chosen["__id"]).select("__id", text_or_empty().alias("text"), "label")
    # Documents that share an id could be any number; the one with the smallest text stands for them.
    return found.groupBy("__id").agg(F.min(F.struct("text", "label")).alias("row")).select("row.*")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine:
    """A machine from documents and the labels to learn from."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for start, end in slices(texts):
                owner, bucket = distinct(*terms(texts[start:end]))
                cuts = np.searchsorted(owner, np.arange(1, end - start))
                out += [part.astype("<i4").tobytes() for part in np.split(bucket, cuts)]
            yield pd.DataFrame({"terms": out, "label": batch["label"].to_numpy()})

    rows = sample(docs, labels, label, SAMPLE).mapInPandas(collect, "terms binary, label int").toPandas()
    rows = rows.sort_values(["label", "terms"])
    return learn([np.frombuffer(b, "<i4") for b in rows["terms"]], rows["label"].to_numpy(np.float64))


def scored(text: Column, machine: Machine) -> Column:
    """Score of a text column without nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            found = [machine.scores(texts[a:b]) for a, b in slices(texts)]
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return F.pandas_udf(run, "double")(text)


def score(df: DataFrame, machine: Machine, text: str = "text", to: str = "score") -> DataFrame:
    """Add the score to ``df``, in place of a column of that name. No shuffle."""
    return df.withColumn(to, scored(text_or_empty(text), machine))


def drop_toxic(df: DataFrame, machine: Machine, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Rows of ``df`` scored below ``threshold``; its columns stay as they are."""
    return df.withColumn("__toxic", scored(text_or_empty(text), machine)).where(F.col("__toxic") < threshold).drop("__toxic")
