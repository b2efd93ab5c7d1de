"""Quality rules at two levels: each document by its own text, and each host by all its documents.

Rules fail on figures of a text (few words, repeated passages, symbols, repeated lines, odd word
lengths). Failures are counted per host. The rate of a host with few documents says little,
so it is shrunk by a beta prior that is estimated from all hosts (moments of the beta-binomial): with
hosts of n rows and f failures and the pooled rate mu, the overdispersion is

    rho = (S / (mu (1 - mu)) - (H - 1)) / (N - sum n^2 / N - (H - 1)),   S = sum n (f / n - mu)^2,

the prior has strength 1 / rho - 1, and the shrunk rate is (f + mu strength) / (n + strength). A host
for which any rule's shrunk rate exceeds ``MOST_FAILED`` is rejected, and so are all its documents. Documents
that fail a rule that rejects alone are rejected whatever their host.

DataFrame functions only. Texts are read once and leave as seven numbers, which are staged; hosts
combine before their shuffle, and their verdicts come back to the documents by host and a salt.
Repeated passages are found inside a row by ordering the 64-bit hashes of its windows; two different
windows of one text of n words share a hash with a likelihood of n^2 / 2^65.

Defined cases: a null or empty text has no words and is rejected; a null host is the empty string and
shares its verdict with it; no rule has a rate where a host has no rows; equal rows get equal
results; an empty table gives an empty result. Columns named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentinela.llm.tables import text_or_empty, without
from sentinela.staging import stage

BLANKS = r"[\x20\x09-\x0D]+"
LEAST_WORDS, MOST_REPEATED = 50, 50
# Percent of a host's documents that may fail a rule, after shrinking.
MOST_FAILED = 50
# Bounds of the overdispersion: hosts that differ less than by chance share one rate, a strength of a million rows.
LEAST_RHO, MOST_RHO = 1e-6, 0.999
SALTS = 32
FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Whether a document fails, by its figures. The first two reject it alone, all count for its host.
RULES: dict[str, str] = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repetition": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
ALONE = ("few_words", "repetition")


def with_figures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the figures of its texts; windows of three words, whole lines."""
    whole, kept = text_or_empty(text), [F.col(f"`{c}`") for c in without(df, list(FIGURES)).columns]
    words = F.filter(F.split(whole, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    found = df.select(*kept, whole.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    n = F.size("__words")

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get("__words", i + k) for k in range(3)]).alias("h"), i.alias("i"))

    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(
        F.array().cast("array<struct<h: bigint, i: int>>"))
    found = found.select(*kept, "__text", "__lines", n.cast("long").alias("n_words"), F.sort_array(windows).alias("__sorted"))

    def again(x: Column, k: Column) -> Column:
        """Whether a neighbour in the order is the same window."""
        return (F.get("__sorted", k - 1)["h"] == x["h"]) | (F.get("__sorted", k + 1)["h"] == x["h"])

    covered = F.array_distinct(F.flatten(F.transform(
        F.filter("__sorted", again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return found.select(
        *kept, "n_words",
        F.length(F.regexp_replace("__text", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    )


def _host(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Pooled rate and strength of each rule's prior; one row of sums reaches the driver."""
    n = F.col("n").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("rows"), F.sum(n * n).alias("squares")]
    for r in RULES:
        f = F.col(r).cast("double")
        sums += [F.sum(f).alias(f"{r}_failed"), F.sum(f * f / n).alias(f"{r}_squares")]
    s = hosts.agg(*sums).first()
    out = {}
    for r in RULES:
        mu, rho = 0.0, MOST_RHO
        if s["hosts"]:
            mu = s[f"{r}_failed"] / s["rows"]
            freedom, spread = s["hosts"] - 1, mu * (1 - mu)
            room = s["rows"] - s["squares"] / s["rows"] - freedom
            if spread > 0 and room > 0:
                rho = ((s[f"{r}_squares"] - s["rows"] * mu * mu) / spread - freedom) / room
        rho = min(MOST_RHO, max(LEAST_RHO, rho))
        out[r] = (mu, 1 / rho - 1)
    return out


def host_verdicts(figures: DataFrame, host: str) -> DataFrame:
    """``host``, its rows ``n``, and each rule's failures and shrunk rate (``<rule>_rate``), and ``rejected``."""
    failed = [F.count(F.when(F.expr(rule), True)).alias(name) for name, rule in RULES.items()]
    hosts = stage(figures.groupBy(_host(host).alias("host")).agg(F.count("*").alias("n"), *failed), "hosts")
    rates = {
        f"{name}_rate": (F.col(name) + mu * strength) / (F.col("n") + strength)
        for name, (mu, strength) in _priors(hosts).items()
    }
    over = [F.col(name) > MOST_FAILED / 100 for name in rates]
    return hosts.withColumns(rates).withColumn("rejected", F.greatest(*over))


def judge(df: DataFrame, host: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with the figures, ``base_failed``, ``host_rejected`` and ``kept``."""
    names = [*FIGURES, "base_failed", "host_rejected", "kept"]
    narrow = without(df, [n for n in names if n.lower() not in (host.lower(), text.lower())])
    figures = stage(with_figures(narrow, text).drop(text), "figures")
    # Only rejected hosts come back, once a salt, so that the rows of one large host go to many tasks.
    bad = host_verdicts(figures, host).where("rejected").select(
        F.col("host").alias("__host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"), "rejected")
    salt = F.pmod(F.xxhash64(*figures.columns), F.lit(SALTS)).cast("int")
    judged = figures.withColumns({"__host": _host(host), "__salt": salt}).join(bad, ["__host", "__salt"], "left")
    base = F.expr(" or ".join(f"({RULES[r]})" for r in ALONE))
    return judged.withColumns({
        "base_failed": base, "host_rejected": F.coalesce("rejected", F.lit(False)),
    }).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("__host", "__salt", "rejected")
