"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms whose share of documents lies in a band (``RAREST`` to ``COMMONEST``, a
band of inverse document frequency). Every document with a term in the lexicon counts towards it, so
the lexicon has at most (mean distinct terms of a document) / ``RAREST`` terms at any corpus size.
A text is reduced to its distinct lexicon terms in sorted order, and hashed once for each of several
random parts of the lexicon. The parts are of different size: small ones still agree after an edit
of a long text, large ones tell short texts apart. The likeness of two fingerprints is the share of
the parts on which they agree, of those in which either text has a term.

Defined cases: a null text counts as empty. A text without lexicon terms is fingerprinted by all its
terms, one without any term by its hash, so equal texts always have equal fingerprints. Neighbours
are taken among distinct rows: rows of equal id and text count as one, rows of equal id and other
text follow the text's hash, null ids come last (the least 64-bit number counts as a null id). A single row is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentinela.llm.tables import text_or_empty
from sentinela.staging import stage

RAREST, COMMONEST = 1 / 100, 1 / 4
# One in so many lexicon terms is in a part; so many parts of each size.
PARTS = {4: 2, 16: 4, 64: 10, 256: 16, 1024: 16, 4096: 16}
EMPTY = "0000"
# Stands for a null id, which comes last in descending order.
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the terms of a text: runs of letters and digits in lower case."""
    return F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame) -> DataFrame:
    """One row with the hashes of the terms in the band, from all rows of ``text``."""
    total = docs.count()
    seen = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counted = seen.where(F.col("term") != F.xxhash64(F.lit(""))).groupBy("term").agg(F.count("*").alias("n"))
    band = counted.where(F.col("n").between(max(2, total * RAREST), total * COMMONEST))
    return stage(band.agg(F.collect_list("term").alias("terms")), "imatch-lexicon")


def fingerprinted(df: DataFrame, text: str, known: DataFrame, to: str) -> DataFrame:
    """Add the fingerprint: one short hash for each part of the lexicon, ``EMPTY`` where the text has no term of that part."""
    # The sub-query stands in a projection of its own, outside of the functions on arrays.
    found = df.withColumn("__terms", terms(F.col(text)))
    found = found.withColumn("__kept", F.array_intersect("__terms", known.scalar()))
    every = F.array_distinct(F.array_remove("__terms", F.xxhash64(F.lit(""))))
    kept = F.sort_array(F.when(F.size("__kept") > 0, F.col("__kept")).when(F.size(every) > 0, every).otherwise(
        F.array(F.xxhash64(text))))
    return found.withColumn("__kept", kept).withColumn(to, parts(F.col("__kept"))).drop("__terms", "__kept")


def parts(kept: Column) -> Column:
    def part(k: int, size: int) -> Column:
        inside = F.filter(kept, lambda t: F.pmod(F.xxhash64(t, F.lit(k), F.lit(size)), F.lit(size)) == 0)
        return F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(inside), 48))), 4, "0")

    return F.concat(*[part(k, size) for size, n in PARTS.items() for k in range(n)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts of two fingerprints in text form, of those that either holds."""
    def pieces(c: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(sum(PARTS.values()) - 1))
        return F.transform(places, lambda i: F.substr(c, i * len(EMPTY) + 1, F.lit(len(EMPTY))))

    agree = F.zip_with(pieces(a), pieces(b), lambda x, y: F.when((x == EMPTY) & (y == EMPTY), None).when(x == y, 1.0).otherwise(0.0))
    held = F.filter(agree, lambda v: v.isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(held) > 0, total / F.size(held)).otherwise((a == b).cast("double"))


def successors(keys: DataFrame) -> DataFrame:
    """``k, h, next_k, next_h``: for each distinct key the next one in descending order, after the last the first.

    Keys are range-partitioned; inside a partition a window looks one row ahead, and the first key of
    every partition, one row each, closes the gaps between partitions.
    """
    order = [F.col("k").desc(), F.col("h")]
    ranged = stage(keys.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "imatch-keys")
    inside = Window.partitionBy("part").orderBy(*order)
    ahead = ranged.select(
        "k", "h", "part", F.row_number().over(inside).alias("place"),
        F.lead(F.struct("k", "h")).over(inside).alias("next"),
    )
    ahead = stage(ahead, "imatch-ahead")
    firsts = ahead.where("place = 1").select("part", F.struct("k", "h").alias("first"))
    # One row a partition.
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gaps = firsts.select("part", F.coalesce(
        F.lead("first").over(Window.orderBy("part")), F.first("first").over(across)).alias("onward"))
    closed = ahead.join(gaps, "part").select("k", "h", F.coalesce("next", "onward").alias("next"))
    return closed.select("k", "h", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"))


def with_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    Columns: ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.
    The edited text has its last half replaced by the beginning of the next document's. Texts are
    shuffled once, by one exchange that both joins read, and of each text the part that its neighbour
    takes over moves a second time.
    """
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))
    docs = df.select(key.alias("k"), F.xxhash64(text_or_empty(text)).alias("h"), text_or_empty(text).alias("text"))
    known = lexicon(docs)
    prints = fingerprinted(docs, "text", known, "fp").select("k", "h", F.length("text").alias("n"), "fp")
    # Repeated rows have one fingerprint.
    prints = stage(stage(prints, "imatch-prints").dropDuplicates(["k", "h"]), "imatch-distinct-prints")
    follows = successors(prints.select("k", "h"))
    onward = prints.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("fp").alias("next_fp"))
    pairs = stage(follows.join(prints, ["k", "h"]).join(onward, ["next_k", "next_h"]), "imatch-pairs")
    # What each text gives to the one before it; of repeated rows one is enough.
    asked = pairs.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"),
                         F.col("h").alias("to_h"), F.floor(F.col("n") / 2).cast("int").alias("take"))
    given = docs.join(asked, ["k", "h"]).select(
        F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring("text", F.lit(1), F.col("take")).alias("tail"))
    copy = F.row_number().over(Window.partitionBy("k", "h").orderBy("k"))
    given = given.withColumn("copy", copy).where("copy = 1").drop("copy")
    whole = docs.join(pairs.select("k", "h", "fp", "next_fp"), ["k", "h"]).join(given, ["k", "h"])
    n = F.length("text")
    edited = whole.select("k", n.alias("n"), "fp", "next_fp", F.concat(
        F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "tail").alias("edited"))
    edited = fingerprinted(edited, "edited", known, "edited_fp")
    return edited.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited",
        F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
