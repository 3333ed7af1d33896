"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Fixed rules reject very short texts and texts made of repeated passages.  Further rules compare
ratios with cutoffs that labelled documents select.  A level is a cutoff for each rule; levels go from the laxest to the
strictest.  For every stratum (language group and length group, at most 15) levels are tested in this order, each with the
exact binomial upper bound on the share of good documents (label 1) that the rules together would reject at it; testing
stops at the first level that isn't certified (fixed sequence, which needs no further correction), and the strata share
the error probability equally (Bonferroni).  So with probability 1 - DELTA at once for all strata,
the rules reject at most ALPHA of a stratum's good documents.  A stratum with too few
labelled documents (under 140 good ones at these parameters) certifies nothing and gets no cutoffs.

Defined cases: a null text has no words and fails the fixed rules; repeated documents are judged
each on its own; a label is used if its document exists, and a document with several labels counts as
good only if all of them are 1; null labels are left out; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import frozen, table

ALPHA = 0.04
DELTA = 0.05
LANGUAGES = ("de", "en", "es", "fr")
LENGTHS = (100, 1000)
WINDOW = 8
#: Cutoffs by level, from lax to strict; a document fails a rule if its ratio is above the cutoff.
CUTOFFS = {
    "symbol_ratio": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "type_ratio": (0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7),
}
LEVELS = len(CUTOFFS["symbol_ratio"])
#: Terms of a binomial tail that are summed; what is left after them is bounded from above.
TERMS = 2048
_WHITE = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words whose hash occurs twice or more."""

    def covered(hashes: Column) -> Column:
        # (hash, position) sorted; a position counts if a neighbour has its hash.
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        flagged = _let(pairs, lambda p: F.filter(F.transform(p, lambda x, k: F.when((x["h"] == F.try_element_at(p, k + 2)["h"]) | ((k > 0) & (x["h"] == F.try_element_at(p, F.greatest(k, F.lit(1)))["h"])), x["i"])), lambda i: i.isNotNull()))
        return _let(
            F.sort_array(flagged),
            lambda s: F.aggregate(
                s,
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
                lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("sum")),
                lambda acc: acc["sum"],
            ),
        )

    hashes = _let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    repeated = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, repeated).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Per row of docs: counts over the whole text, the ratios that rules use, and the stratum."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_WHITE))
    lang = F.col(lang_col) if lang_col else F.lit(None)
    out = docs.select(F.col(id_col), text.alias("t"), lang.alias("lang"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    out = out.select(
        id_col,
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).alias("n_upper"),
        F.size(F.array_distinct("words")).alias("n_types"),
    )
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    group = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    length = sum(((F.col("n_words") >= n).cast("int") for n in LENGTHS), F.lit(0))
    return out.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        ratio(F.col("n_upper"), F.col("word_chars")).alias("upper_ratio"),
        ratio(F.col("lines.dup"), F.col("lines.n")).alias("line_ratio"),
        (1 - ratio(F.col("n_types"), F.col("n_words"))).alias("type_ratio"),
        F.concat_ws(":", group, length.cast("string")).alias("stratum"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def _log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum((F.log(x + j) for j in range(8)), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float, terms: int = TERMS) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) and k <= p n, or any k below terms.

    The terms are summed from that of k downwards, as multiples of it.  Below p n they fall, each by a smaller factor than the one
    before, so a geometric series bounds what is left after terms of them: the result is exact for k <= terms, and never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    factor = lambda i: F.greatest(k - i, F.lit(0.0)) / (n - k + i + 1) * ((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * factor(i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    last = factor(F.lit(terms))
    rest = lambda acc: F.when(acc["term"] == 0, F.lit(0.0)).otherwise(acc["term"] * last / (1 - last))
    return F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step, lambda acc: F.exp(first) * (acc["sum"] + rest(acc)))


def cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, level, and a cutoff for each rule: the strictest certified level of each stratum that has one, at most 15 rows.

    A level is certified if the exact (Clopper-Pearson) upper confidence bound on its false
    rejections is at most alpha: P(Binomial(n, alpha) <= rejected) <= delta / strata.
    """
    share = delta / ((len(LANGUAGES) + 1) * (len(LENGTHS) + 1))
    good = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1").select(id_col)
    held = stats.where(~F.col("base_failed")).join(good, id_col, "left_semi")
    fails = lambda i: reduce(lambda a, b: a | b, (F.col(r) > c[i] for r, c in CUTOFFS.items()))
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(fails(i)).alias(f"k{i}") for i in range(LEVELS)))
    # The first level that isn't certified; from a share of rejections above alpha on, none is.
    refused = (F.when((F.col(f"k{i}") > alpha * F.col("n")) | (binomial_tail(F.col(f"k{i}"), F.col("n"), alpha) > share), F.lit(i)) for i in range(LEVELS))
    chosen = counts.select("stratum", (F.coalesce(*refused, F.lit(LEVELS)) - 1).alias("level")).where("level >= 0")
    return chosen.select("stratum", "level", *(F.element_at(F.array(*map(F.lit, c)), F.col("level") + 1).alias(r) for r, c in CUTOFFS.items()))


def judge(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """stats with kept: false if a fixed rule or a certified cutoff of the document's stratum fails it."""
    most = chosen.select("stratum", *(F.col(r).alias(f"{r}_most") for r in CUTOFFS))
    judged = stats.join(F.broadcast(most), "stratum", "left")  # at most 15 rows, one a stratum
    failed = F.col("base_failed")
    for r in CUTOFFS:
        failed = failed | F.coalesce(F.col(r) > F.col(f"{r}_most"), F.lit(False))
    return judged.withColumn("kept", ~failed)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = frozen(statistics(table(spark, sf_dir, "documents")))
    out = judge(stats, cutoffs(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def _sql() -> str:
    share = DELTA / ((len(LANGUAGES) + 1) * (len(LENGTHS) + 1))
    grid = ", ".join(f"({i}, {', '.join(f'{c[i]}::DOUBLE' for c in CUTOFFS.values())})" for i in range(LEVELS))
    most = ", ".join(f"{r}_most" for r in CUTOFFS)
    above = " OR ".join(f"{r} > {r}_most" for r in CUTOFFS)
    white = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{white}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
wi AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) > {WINDOW})),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wi) WHERE c > 1) GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_types, len(l) AS n_lines,
    CASE WHEN lang IN ({", ".join(f"'{x}'" for x in LANGUAGES)}) THEN lang ELSE 'other' END || ':' || ({" + ".join(f"(len(w) >= {n})::INTEGER" for n in LENGTHS)}) AS stratum
    FROM d LEFT JOIN rw USING (doc_id)),
r AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio, n_dup_lines / greatest(n_lines, 1) AS line_ratio, 1 - n_types / greatest(n_words, 1) AS type_ratio,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
grid(i, {most}) AS (VALUES {grid}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
tests AS (SELECT stratum, i, count(*) AS n, count(*) FILTER ({above}) AS k FROM r SEMI JOIN good USING (doc_id), grid WHERE NOT base_failed GROUP BY ALL),
ok AS (SELECT *, k <= {ALPHA} * n AND list_sum(list_transform(range(0, least(k, ({ALPHA} * n)::BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) <= {share} AS fine FROM tests),
level AS (SELECT stratum, coalesce(min(i) FILTER (NOT fine), {LEVELS}) - 1 AS i FROM ok GROUP BY ALL),
chosen AS (SELECT * FROM level JOIN grid USING (i))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({above}, false) AS kept, r.stratum FROM r LEFT JOIN chosen USING (stratum)
"""


OP2_SQL = _sql()
