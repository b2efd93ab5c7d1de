"""Surrogates for personal data, in DataFrame functions only.

Found entities are replaced by keyed surrogates of the same kind and format: digits become digits,
letters become letters of the same case and script, while marks, titles, country codes, key
prefixes and top-level domains stay. Numbers of cards get a right check digit, without which a number
is not taken for one. Names become pronounceable names, given names with the ending of the gender their title
tells. A surrogate comes from a keyed permutation: Feistel rounds over the entity's variable
characters, of which those at even and those at odd places move in turn by a digest of the others.
Therefore

* an entity has one surrogate in every text and in every way of writing it (coreference), and
* two entities never share one (distinctness), at any size of the corpus, without a table of
  entities to build, shuffle or join.

``collisions`` checks both on a corpus; it is a report, since the permutation leaves nothing to mend.

A letter moves within its script and case; one of no case within its block of 64 code points; marks on
letters stay. So do names that are not found: without a title, or with an initial for the first word.

Defined cases: a null text stays null; a text without entities stays as it is, character for
character; repeated rows give equal results; an empty table gives an empty result. A surrogate may
by chance be another entity of the corpus; that one is moved as well, so the two stay apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.tables import without

ROUNDS = 4

# Titles by the gender they tell.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña"),
    "n": ("Dr", "Prof"),
}
# Endings of given names by script, for the genders m, f and n. Other scripts get none.
ENDINGS = {"Latin": "oae", "Cyrillic": "оае", "Greek": "οαε", "Armenian": "ոաե", "Georgian": "ოაე"}


def _title(names: tuple[str, ...]) -> str:
    return rf"(?<!\w)(?:{'|'.join(names)})\.? "


_ANY_TITLE = _title(sum(TITLES.values(), ()))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ASSIGNED = r"(?i:(?<!\w)(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"
_NAME = r"[\p{Lu}\p{Lt}][\p{L}\p{M}'’-]++"
# Right after a title a name may be in letters without case; of such names that one word is taken.
_INITIAL = r"[\p{Lu}\p{Lt}\p{Lo}\p{IsGeorgian}]"
_FIRST = rf"(?:{_NAME}|(?=[\p{{Lo}}\p{{IsGeorgian}}])[\p{{L}}\p{{M}}'’-]++)"
# Kinds in the order in which they are tried at each place of a text.
KINDS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{M}\p{N}_.%+-]{1,64}+@(?:[\p{L}\p{M}\p{N}-]{1,63}+\.)+\p{L}[\p{L}\p{M}]{1,23}",
    "hex_ip": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
              r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.])",
    "hex_secret": rf"{_ASSIGNED}[0-9A-Fa-f]{{8,}}+(?![^\s\"'.,;])",
    "secret": rf"{_ASSIGNED}(?=[^\s\"'\d]*+\d)[^\s\"']{{4,}}+",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "hex_key": r"\b[0-9A-Fa-f]{32,}+\b",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "card": r"(?<![\w+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?=\+?(?:[ ().-]{0,2}\d){9,15}(?!\w))\+?(?:\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])"
             r"\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)",
    **{f"given_{g}": rf"{_title(names)}{_FIRST} (?={_NAME})" for g, names in TITLES.items()},
    # A name takes the blank before a further one; no other match ends with a blank, so the next one goes on from there.
    "family": rf"(?:{_ANY_TITLE}{_FIRST}|\G(?<= ){_NAME})(?: (?={_NAME}))?",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
# Ranges of card numbers by issuer.
ISSUERS = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7]|35|6[0-5])\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11})$"
# A text without any of these holds no entity.
HINT = rf"[0-9@]|{_ANY_TITLE}{_INITIAL}"

# An octet of an address is moved as one character of this name.
DIGITS, OCTET = "0123456789", "octet"
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450)))
ACCENTED = "".join(chr(c) for c in range(0xE0, 0xFF) if c != 0xF7)
GREEK = "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2)
COMMON = tuple(a for s in (LATIN, ACCENTED, CYRILLIC, GREEK) for a in (s, s.upper()))
# A letter of no alphabet (those without case) is moved within its block of so many code points.
BLOCK = 64


@lru_cache(maxsize=1)
def further_alphabets() -> tuple[str, ...]:
    """Alphabets of all other letters with case: those of a script, in blocks of 128 code points, by case.

    Capitals and small letters of a block stand in the same order, so that a name in capitals moves like the same name in
    small letters. Letters without a partner have alphabets of their own.
    """
    found: dict[tuple, list[str]] = {}
    taken = set("".join(COMMON))
    letters = [c for c in map(chr, range(0x110000)) if c not in taken and unicodedata.category(c) in ("Lu", "Ll")]
    for c in letters:
        script, low = unicodedata.name(c, "?").split(" ")[0], c.lower()
        if c != low and len(low) == 1 and low.upper() == c and low not in taken:
            found.setdefault((script, ord(c) >> 7, "capital"), []).append(c)
            found.setdefault((script, ord(c) >> 7, "small"), []).append(low)
    paired = {c for group in found.values() for c in group}
    for c in letters:
        if c not in paired:
            script = unicodedata.name(c, "?").split(" ")[0]
            found.setdefault((script, ord(c) >> 7, unicodedata.category(c)), []).append(c)
    return tuple("".join(group) for group in found.values())


def _kind(m: Column) -> Column:
    """The first kind whose pattern made this match. A given name's match ends with the blank before the family name."""
    found = F.lit("family")
    for kind, pattern in reversed(KINDS.items()):
        if kind.startswith("given"):
            pattern = _title(TITLES[kind[-1]]) + _FIRST + " "
        if kind == "card":
            # Other numbers of that length are no entities: a wrong check digit, or no issuer's range.
            digits = F.regexp_replace(m, r"\D", "")
            right = F.regexp_like(digits, F.lit(ISSUERS)) & (F.right(digits, F.lit(1)).cast("int") == _check_digit(digits))
            found = F.when(F.regexp_like(m, F.lit(f"^(?:{pattern})$")), F.when(right, kind).otherwise("number")).otherwise(found)
        elif kind != "family":
            found = F.when(F.regexp_like(m, F.lit(f"^(?:{pattern})$")), kind).otherwise(found)
    return found


def _head(m: Column, kind: Column) -> Column:
    """Length of the part at the start that stays."""

    def first(pattern: str) -> Column:
        return F.length(F.regexp_extract(m, pattern, 1))

    return (
        F.when(kind.endswith("secret"), first(r"^([\w-]+\s*[=:]\s*[\"']?)")).when(kind == "access_key", 4).when(kind == "iban", 2)
        .when(kind == "card", 1).when(kind == "phone", first(r"^(.*?)(?:\D*\d){10}\D*$"))
        .when(kind.like("given%") | (kind == "family"), first(rf"^({_ANY_TITLE}){_INITIAL}")).otherwise(0)
    )


def _tail(m: Column, kind: Column) -> Column:
    """Length of the part at the end that stays: a top-level domain, a check digit."""
    return F.when(kind == "email", F.length(F.regexp_extract(m, r"(\.[\p{L}\p{M}]+)$", 1))).when(kind == "card", 1).otherwise(0)


def _alphabet(c: Column, kind: Column) -> Column:
    """The characters among which this one is moved; none if it stays, as all but digits and letters do."""
    found = F.when(kind == "number", "").when(kind == "ip", F.when(c == ".", "").otherwise(OCTET)).when(F.contains(F.lit(DIGITS), c), DIGITS)
    found = found.when(kind.startswith("hex"), F.when(F.contains(F.lit("abcdef"), c), "abcdef").when(
        F.contains(F.lit("ABCDEF"), c), "ABCDEF").otherwise(""))
    for letters in COMMON:
        found = found.when(F.contains(F.lit(letters), c), letters)
    further = F.lit(" ".join(further_alphabets()))
    # The letters before and after this one, up to the blanks around its alphabet.
    before = F.substring_index(F.call_function("substring_index", further, c, F.lit(1)), " ", -1)
    after = F.substring_index(F.call_function("substring_index", further, c, F.lit(-1)), " ", 1)
    found = found.when(F.contains(further, c) & (c != " "), F.concat(before, c, after))
    return found.when(F.regexp_like(c, F.lit(r"\p{L}")), _block(c)).otherwise("")


def _block(c: Column) -> Column:
    """The code points of the aligned block that a character stands in."""
    start = F.ascii(c) - F.ascii(c) % BLOCK
    return F.array_join(F.transform(F.sequence(start, start + BLOCK - 1), lambda x: F.decode(
        F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")), "")


def _map(array: Column, change: Callable[[Column], dict[str, Column]], *kept: str) -> Column:
    """Array of structs with the fields ``kept`` and those that ``change`` gives."""
    return F.transform(array, lambda e: F.struct(
        *[e[k].alias(k) for k in kept], *[c.alias(k) for k, c in change(e).items()]))


def _entities(matches: Column) -> Column:
    """Array of ``m, kind, letters, sizes, values``; sizes and values are those of variable characters."""
    found = F.transform(matches, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    found = _map(found, lambda e: {
        "head": _head(e["m"], e["kind"]), "end": F.length(e["m"]) - _tail(e["m"], e["kind"]),
        "chars": F.when(e["kind"] == "ip", F.regexp_extract_all(e["m"], F.lit(r"\d+|\."), 0)).otherwise(
            F.regexp_extract_all(e["m"], F.lit("(?s)."), 0)),
    }, "m", "kind")
    found = _map(found, lambda e: {"letters": F.transform(e["chars"], lambda c, i: F.struct(
        c.alias("c"),
        F.when((i >= e["head"]) & (i < e["end"]), _alphabet(c, e["kind"])).otherwise("").alias("a"), i.alias("i"),
    ))}, "m", "kind")
    found = _map(found, lambda e: {"moved": F.filter(e["letters"], lambda x: x["a"] != "")}, "m", "kind", "letters")
    return _map(found, lambda e: {
        "sizes": F.transform(e["moved"], lambda x: F.when(x["a"] == OCTET, 256).otherwise(F.length(x["a"]))),
        "values": F.transform(e["moved"], lambda x: F.when(x["a"] == OCTET, x["c"].try_cast("int")).otherwise(
            F.position(x["c"], x["a"]) - 1)),
    }, "m", "kind", "letters")


def _permuted(entities: Column, key: str) -> Column:
    kept = ("m", "kind", "letters", "sizes")
    for r in range(ROUNDS):
        entities = _map(entities, lambda e, r=r: {"digest": F.sha2(F.concat_ws(
            "|", F.lit(f"{key}|{r}"), e["kind"], F.size(e["values"]).cast("string"),
            F.array_join(F.filter(e["values"], lambda v, i: i % 2 != r % 2).cast("array<string>"), ","),
        ), 512)}, *kept, "values")
        entities = _map(entities, lambda e, r=r: {"values": F.transform(e["values"], lambda v, i: F.when(
            i % 2 != r % 2, v,
        ).otherwise(F.pmod(
            # Another part of the digest for each place, and the place itself where long entities come round again.
            v + F.conv(F.substr(e["digest"], (i * 3) % 123 + 1, F.lit(5)), 16, 10).cast("int") + i * 7,
            F.get(e["sizes"], i),
        )))}, *kept)
    return entities


def _check_digit(text: Column) -> Column:
    """Check digit for the digits of ``text`` that come before its last one."""
    digits = F.regexp_replace(text, r"\D", "")
    n = F.length(digits) - 1
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
        (n - i) % 2 == 0, F.substr(F.lit("0246813579"), F.substr(digits, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int"),
    ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _syllable(letter: Column) -> Column:
    """A two-letter syllable for each Latin letter, in its case; other letters stay."""
    at = F.position(F.lower(letter), F.lit(LATIN)) - 1
    two = F.concat(
        F.substr(F.lit("bdfglmnprstvz"), F.pmod(at, F.lit(13)) + 1, F.lit(1)),
        F.substr(F.lit("ai"), F.floor(at / 13).cast("int") + 1, F.lit(1)),
    )
    return F.when(at < 0, letter).when(letter == F.lower(letter), two).otherwise(F.initcap(two))


def _written(e: Column) -> Column:
    """The mention with its variable characters replaced."""
    name = e["kind"].like("given%") | (e["kind"] == "family")

    def put(x: Column, value: Column) -> Column:
        new = F.when(x["a"] == OCTET, value.cast("string")).otherwise(F.substr(x["a"], value + 1, F.lit(1)))
        return F.struct(x["i"].alias("i"), F.when(name, _syllable(new)).otherwise(new).alias("c"))

    moved = F.zip_with(F.filter(e["letters"], lambda x: x["a"] != ""), e["values"], put)
    stay = F.transform(F.filter(e["letters"], lambda x: x["a"] == ""), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))
    # Sorted by place rather than appended one by one, which takes the square of a long secret's length.
    return F.array_join(F.transform(F.sort_array(F.concat(moved, stay)), lambda x: x["c"]), "")


def _finished(e: Column) -> Column:
    check = _check_digit(e["text"]).cast("string")
    out = F.when(e["kind"] == "card", F.concat(F.substr(e["text"], F.lit(1), F.length(e["text"]) - 1), check))
    for i, gender in enumerate("mfn"):
        ending = F.lit("")
        for script, endings in reversed(ENDINGS.items()):
            ending = F.when(F.regexp_like(e["text"], F.lit(rf"\p{{Is{script}}}[^\p{{L}}]*$")), endings[i]).otherwise(ending)
        out = out.when(e["kind"] == f"given_{gender}", F.concat(F.rtrim(e["text"]), ending, F.lit(" ")))
    return out.otherwise(e["text"])


def mentions(text: Column) -> Column:
    """All entities of a text as they are written, in their order."""
    return F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(
        F.array().cast("array<string>"))


def surrogates(found: Column, key: str) -> Column:
    """``kind, m, surrogate`` of each entity of an array of mentions."""
    written = _map(_permuted(_entities(found), key), lambda e: {"text": _written(e)}, "m", "kind")
    return _map(written, lambda e: {"surrogate": _finished(e)}, "kind", "m")


def replace(df: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with surrogates in its text column, and the number of entities as ``count`` if asked for.

    One projection: texts are searched where they are read, nothing is shuffled.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    pieces = F.split(F.col(text), ENTITY, -1)
    found = df.select(*kept, mentions(F.col(text)).alias("__found"))
    found = found.select(*kept, "__found", surrogates(F.col("__found"), key).alias("__new"))
    new = F.when(F.size("__found") == 0, F.col(text)).otherwise(F.concat_ws("", F.zip_with(
        pieces, F.col("__new"), lambda piece, e: F.concat(piece, F.coalesce(e["surrogate"], F.lit(""))))))
    # As the only element of an array that is laid out again: Spark then never merges this expression into a later
    # projection, where a Python UDF over it would be left unplanned ("Cannot evaluate expression").
    taken = [F.col(f"`{c}`") for c in df.columns if c != text]
    out = found.select(*taken, "__new", F.explode(F.array(new)).alias(text)).select(*kept, "__new")
    if count:
        out = without(out, [count]).withColumn(count, F.size(F.filter("__new", lambda e: e["kind"] != "number")))
    return out.drop("__found", "__new")


def collisions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Entities that share a surrogate with another of their kind: ``kind, surrogate, entities``. Empty by construction."""
    found = df.select(F.explode(surrogates(mentions(F.col(text)), key)).alias("e")).select("e.*").where("kind != 'number'")
    # Spellings of one entity agree in their letters and digits.
    entity = F.lower(F.regexp_replace(F.concat("kind", "m"), r"[^\p{L}\p{N}]", "")).alias("m")
    found = found.select("kind", entity, F.lower(F.regexp_replace("surrogate", r"[^\p{L}\p{N}]", "")).alias("surrogate")).distinct()
    return found.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")
