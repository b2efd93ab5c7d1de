import random
import re

from sentinela.llm import urls
from sentinela.llm.queries import URL_RULES
from tests.conftest import rows


def plain_match(glob: bytes, text: bytes) -> bool:
    pattern = b"".join({b"*": b".*", b"?": b"."}.get(c, re.escape(c)) for c in (glob[i:i + 1] for i in range(len(glob))))
    return re.fullmatch(pattern, text, re.DOTALL) is not None


def test_automaton_as_one_pattern_after_the_other():
    chance = random.Random(4)
    globs = list({bytes(chance.choice(b"ab*?") for _ in range(chance.randint(1, 9))) for _ in range(120)})
    globs = [g for g in globs if b"?*" not in g or True]
    texts = [bytes(chance.choice(b"ab") for _ in range(chance.randint(0, 14))) for _ in range(300)]
    fits = urls.Automaton(globs).run(texts)
    for i, text in enumerate(texts):
        assert [bool(f) for f in fits[i]] == [plain_match(g, text) for g in globs], text


def test_rules(spark):
    pages = spark.createDataFrame([
        (1, "http://A.Net/x", "h"), (2, "http://a.net", "h"), (3, "https://x.example.net/en/1?q#f", "h"),
        (4, "https://example.com/de/", "h"), (5, "https://notexample.com/de/", "h"), (6, "x://b.org/fr/y.net/", "h"),
        (7, None, "h"), (8, "no scheme.net/", "h"), (9, "http://c.com/x.net/", "h"), (10, "http://internet/", "h"),
        (10, "http://internet/", "h"), (11, "http://net/" + "p" * 50_000, "h"), (None, "", "h"), (12, "http://a.net?x/", "h"),
        (13, "a://b://c.net/", "h"),
    ], "page_id long, url string, VERDICT string")
    found = urls.judge(pages, URL_RULES)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert rows(found.selectExpr("page_id", "rule", "verdict")) == rows(spark.createDataFrame([
        (1, "net/", "block"), (2, None, "allow"), (3, "example.net/en/", "allow"), (4, "example.com/de/", "block"),
        (5, None, "allow"), (6, "org/fr/", "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"),
        (10, None, "allow"), (10, None, "allow"), (11, "net/", "block"), (None, None, "allow"), (12, None, "allow"),
        (13, None, "allow"),
    ], "a long, b string, c string"))
    assert rows(found.where("page_id in (3, 7)").select("host", "path")) == [("", ""), ("x.example.net", "/en/1")]
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
