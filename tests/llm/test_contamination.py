import random

import numpy as np

from sentinela.llm import contamination
from sentinela.llm.queries import QUERIES
from tests.conftest import rows

SMALL = "/root/testdata/sf0.01"


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def least_distances(items, text):
    """The same for many items at once, a column of all of them for each character."""
    size = max(map(len, items))
    chars = np.array([[ord(c) for c in t.ljust(size, "\0")] for t in items])
    steps = np.arange(size + 1)
    column = np.tile(steps, (len(items), 1))
    best = np.array([len(t) for t in items])
    ends = best.copy()
    for c in text:
        new = np.empty_like(column)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(column[:, 1:] + 1, column[:, :-1] + (chars != ord(c)))
        column = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, column[np.arange(len(items)), ends])
    return best.tolist()


def test_finds_what_all_distances_find():
    chance = random.Random(5)
    for _ in range(60):
        item = contamination.plain("".join(chance.choice("abc d") for _ in range(80)))
        changed = list(item)
        for _ in range(chance.randint(0, 7)):
            at, kind = chance.randrange(len(changed)), chance.randint(0, 2)
            changed[at:at + (kind != 2)] = [] if kind == 1 else [chance.choice("abcd")]
        text = contamination.plain("".join(chance.choice("abcd ") for _ in range(50)) + "".join(changed) + "dd a" * 9)
        best = least_distance(item, text)
        found = contamination.Matcher([(1, item)]).find(text)
        assert found == ({1: best} if best <= len(item) // contamination.PIECE else {})


def test_query_holds_all_whole_copies(spark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op10_pigeonhole_decontamination"](spark, SMALL).where("distance = 0").collect()}
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    want = set()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        text = contamination.plain(r.text or "")
        want |= {(r.doc_id, i.item_id) for i in items if contamination.plain(i.text) in text}
    assert found == want and len(want) > 5


def test_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 60)
    item = "The quick brown fox jumps over the lazy dog and runs away from it."
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "short one"), (5, "z" * 40)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "pad " * 40_000 + item.upper().replace(" ", "\n ") + " pad", "x"),
         (4, item.replace("quick", "quack"), "x"), (4, item.replace("quick", "quack"), "x"), (5, "a short one", "x"),
         (6, " Short  ONE", "x"), (None, item, "x"), (7, item[:40], "x")], "doc_id long, text string, DISTANCE string")
    assert rows(contamination.matches(docs, items)) == [
        (None, 1, 0), (3, 1, 0), (4, 1, 1), (4, 1, 1), (5, 4, 0), (6, 4, 0)]
    kept = contamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and rows(kept.select("doc_id")) == [(1,), (2,), (7,)]
    assert contamination.matches(docs.limit(0), items).count() == 0
    assert contamination.matches(docs, items.limit(0)).count() == 0
    assert contamination.drop_contaminated(docs, items.limit(0)).count() == 9


def test_query_is_all_distances_over_the_whole_table(spark):
    """Every document and item of the smallest tables, and documents with edited items put in."""
    chance, smallest = random.Random(7), "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{smallest}/benchmark.parquet")
    texts = {r.item_id: contamination.plain(r.text) for r in items.collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if len(t or "") < 4000]
    for k, item in enumerate(texts.values()):
        changed = list(item)
        for at in sorted(chance.sample(range(len(item)), len(item) // 16 - k % 3), reverse=True):
            changed[at:at + 1] = chance.choice([[], ["#"], ["#", changed[at]]])
        docs.append((10_000 + k, "before it " + "".join(changed) + " after it"))
    found = contamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), items)
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    want = {}
    for i, t in docs:
        for (item, text), d in zip(texts.items(), least_distances(list(texts.values()), contamination.plain(t or ""))):
            if d <= len(text) // contamination.PIECE:
                want[i, item] = d
    assert got == want and sum(d > 0 for d in want.values()) > 20


def test_short_items_stand_between_word_borders():
    matcher = contamination.Matcher([(1, "Art?"), (2, "12 times 17"), (3, "What is 12 times 17?"), (4, "x")])
    assert matcher.find("modern art? yes") == {1: 0} and matcher.find("a part? no") == {}
    assert matcher.find('He asked: "what is 12  times 17?" twice') == {2: 0, 3: 0}
    assert matcher.find("what is 112 times 17") == {}
    assert matcher.find("what was 12 times 17") == {2: 0}
    assert matcher.find("whit is 12 times 17?") == {2: 0, 3: 1}
    assert matcher.find("(x)") == {4: 0} and matcher.find("xx") == {} and matcher.find("") == {}


def test_items_are_cut_where_they_differ():
    """A shared opening is no piece of the items that have it, so its occurrences cost nothing."""
    opening = "which of the following is the best description "
    items = [opening + f"{i} ".join("of the thing that nobody knew about then".split()) for i in range(300)]
    cuts = contamination.rarest_pieces(items)
    shared = sum(piece in opening for cut in cuts for _, piece in cut) / len(items)
    plainly = sum(piece in opening for t in items for _, piece in contamination.pieces(t)) / len(items)
    assert shared < plainly
    assert all(len(c) == len(t) // contamination.PIECE + 1 for c, t in zip(cuts, items))
    assert all(t[a:a + len(p)] == p for c, t in zip(cuts, items) for a, p in c)


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 200)
    held, whole = [], contamination.blocks

    def counted(items, *names):
        for block in whole(items, *names):
            held.append(len(block))
            yield block

    monkeypatch.setattr(contamination, "blocks", counted)
    items = spark.createDataFrame([(i, f"item number {i} with its own words {i * 7919}") for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so item number {i} with its own words {i * 7919} it is") for i in range(0, 90, 3)], "doc_id long, text string")
    got = contamination.matches(docs, items)
    assert len(held) > 5 and sum(held) == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {(r.doc_id, r.item_id) for r in got.where("distance = 0").collect()} == {(i, i) for i in range(0, 60, 3)}
    kept = contamination.drop_contaminated(docs, items)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id for r in kept.collect()} <= {i for i in range(60, 90, 3)}
