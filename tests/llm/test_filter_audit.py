from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from sentinela.llm import filter_audit


@pytest.mark.parametrize("m", [1, 2, 3, 5, 6])
def test_weights_are_those_of_marginal_gains(m):
    weights = filter_audit.coalition_weights(m)
    for i in range(m):
        plain = [0] * (1 << m)
        for order in permutations(range(m)):
            before = sum(1 << k for k in order[:order.index(i)])
            plain[before] -= 1
            plain[before | 1 << i] += 1
        # A coalition's weight may be stated with or without the empty one, which removes nothing.
        assert weights[i][1:] == plain[1:] and isinstance(weights[i][1], int)


def test_values_are_the_constrained_least_squares():
    m, everyone = 4, 15
    v = [Fraction(s * s % 11) if s else Fraction(0) for s in range(16)]
    f = [sum(w * v[s] for s, w in enumerate(row)) / factorial(m) for row in filter_audit.coalition_weights(m)]
    assert sum(f) == v[everyone]

    def loss(f):
        total = Fraction(0)
        for s in range(1, everyone):
            k = s.bit_count()
            weight = Fraction(m - 1, [0, 4, 6, 4][k] * k * (m - k))
            total += weight * (v[s] - sum(f[i] for i in range(m) if s >> i & 1)) ** 2
        return total

    for i in range(m):
        for j in range(m):
            moved = list(f)
            moved[i] += Fraction(1, 1000)
            moved[j] -= Fraction(1, 1000)
            assert i == j or loss(moved) > loss(f)


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, source string, failed string, id string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


WORDS = " ".join(f"w{i}" for i in range(60))


def plain_masks(docs):
    out = []
    for i, text, part, *_ in docs:
        t = text or ""
        w = t.split()
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 any(c in "#$%&*|" for c in t), smaller]
        out.append((part or "", sum(1 << k for k, x in enumerate(fails) if x)))
    return out


def test_odd_rows_by_brute_force(spark):
    docs = [(1, WORDS, "a", "x", "y"), (2, WORDS, "a", "x", "y"), (2, WORDS, "a", "x", "y"), (None, WORDS, "a", "x", "y"),
            (None, None, None, "x", "y"), (3, "", "", "x", "y"), (4, None, "", "x", "y"), (5, WORDS + " # ABC" * 30, "b", "x", "y"),
            (6, "é " * 80, "b", "x", "y"), (7, WORDS + " A", None, "x", "y"), (1, WORDS, "b", "x", "y")]
    labels = [(2, 1, 0), (2, None, 1), (5, 1, 1), (None, 1, 1), (9, 1, 1), (6, None, None)]
    df, told = frames(spark, docs, labels)
    good, toxic = {2, 5}, {2, 5}
    rows = [(p, mask, d[0] in good, d[0] in toxic) for d, (p, mask) in zip(docs, plain_masks(docs))]
    got = {(r.part, r.filter_order, r.step): r for r in
           filter_audit.audit(filter_audit.marked(df, "source", told), "ABCDE").collect()}
    assert len(got) == 3 * 600
    worth = {}
    for part in ("", "a", "b"):
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left, seen = mine, set()
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                out = [r for r in left if r[1] & bit]
                left = [r for r in left if not r[1] & bit]
                r = got[part, order, step]
                assert (r.kept, r.removed) == (len(left), len(out))
                assert r.redundant == sum(bool(x[1] & bit) for x in mine) - len(out)
                assert r.unique_fails == sum(x[1] == bit for x in mine)
                assert (r.good_lost, r.toxic_lost) == (sum(x[2] for x in out), sum(x[3] for x in out))
                worth[part, c] = worth.get((part, c), 0) + len(out)
    assert all(r.shapley == worth[p, o[s - 1]] for (p, o, s), r in got.items())


def test_empty_table(spark):
    df, told = frames(spark, [], [])
    assert filter_audit.audit(filter_audit.marked(df, "source", told), "ABCDE").count() == 0
