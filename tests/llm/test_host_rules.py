import random

from sentinela.llm import host_rules

SCHEMA = "doc_id long, text string, source string, Kept string, n_words string"


def plain_figures(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\x0b", " ").replace("\n", " ").split(" ") if w]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered))


def texts(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        size = r.choice([0, 1, 2, 3, 5, 40, 120])
        yield "".join(r.choice(["a", "bé", "c#", "😀", "dd"]) + r.choice([" ", "\n", "\t", "  ", "\n\n", " \x0b"]) for _ in range(size))


def test_figures_by_brute_force(spark):
    given = [None, "", " \n\t", "x", "a b c a b c", "a b c a b", *texts(150, 3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    for r in host_rules.with_figures(df).collect():
        assert tuple(r[f] for f in host_rules.FIGURES) == plain_figures(given[r.doc_id]), given[r.doc_id]


def clean(i):
    r = random.Random(i)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80))


def marked(spark, rows):
    return host_rules.judge(spark.createDataFrame(rows, SCHEMA), "source")


def test_hosts_that_mostly_fail_go_and_small_ones_are_shrunk(spark):
    docs, i = [], 0
    for host, good, bad in [("good", 190, 10), ("poor", 8, 32), ("once", 0, 1), *[(f"h{k}", 14, 2) for k in range(60)]]:
        for k in range(good + bad):
            # Symbols alone do not reject a document, only its host.
            docs.append((i, clean(i) + (" #" * 40 if k < bad else ""), host, "x", "y"))
            i += 1
    rows = marked(spark, docs).collect()
    kept = {}
    for r in rows:
        kept.setdefault(r.source, set()).add(r.kept)
        assert not r.base_failed
    assert kept.pop("poor") == {False}
    # One bad document out of one is no proof against a host.
    assert all(v == {True} for v in kept.values())
    figures = host_rules.with_figures(spark.createDataFrame(docs, SCHEMA).drop("Kept", "n_words"))
    verdicts = {r.host: r for r in host_rules.host_verdicts(figures, "source").collect()}
    assert verdicts["poor"].rejected and not verdicts["once"].rejected
    assert 0.1 < verdicts["once"].symbols_rate < 0.5 and 0.5 < verdicts["poor"].symbols_rate < 0.8
    assert verdicts["good"].symbols == 10 and verdicts["good"].n == 200


def test_odd_rows(spark):
    docs = [(1, None, None, "x", "y"), (1, None, None, "x", "y"), (None, "", "", "x", "y"), (2, clean(2), None, "x", "y"),
            (2, clean(2), None, "x", "y"), (3, "a b c " * 30, "h", "x", "y")]
    found = marked(spark, docs)
    assert found.columns == ["doc_id", "source", *host_rules.FIGURES, "base_failed", "host_rejected", "kept"]
    got = sorted((r.doc_id or 0, r.base_failed, r.n_words, r.n_repeat_words) for r in found.collect())
    assert got == [(0, True, 0, 0), (1, True, 0, 0), (1, True, 0, 0), (2, False, 80, 0), (2, False, 80, 0), (3, True, 90, 90)]
    assert marked(spark, docs[:0]).count() == 0


def test_no_python_in_the_plan(spark):
    plan = marked(spark, [(1, "a", "h", "x", "y")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
