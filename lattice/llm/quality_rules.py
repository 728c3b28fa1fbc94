"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every statistic is an expression over a document's own words and lines, so the plan is a scan and a projection: no
shuffle, no user functions. Arrays that a lambda reads more than once are bound by a one-element transform, so they
are made once a row.

Windows of five words are compared as 64-bit hashes first; equal windows have equal hashes, so a text without equal
hashes has no repeated window. Only the other texts compare the windows themselves.

A null or empty text has no words: all counts are 0 and it fails. Repeated rows are judged one by one; other columns
don't matter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import WORD, table

#: Frequent words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for was on are with as be this have from or "
    "le la les de des et en un une du est que qui pour dans au il pas sur "
    "der die das und ist von zu den mit ein eine nicht auf im dem des "
    "el los las y en que un una por con para del se su no es"
).split()


class Limit(NamedTuple):
    """A row of the threshold table: the ratio named has to lie between low and high."""

    ratio: str
    low: float | None = None
    high: float | None = None


#: Ratios per word, line or character. Wide enough for clean prose of any of the languages.
LIMITS = [
    Limit("mean_word_length", 1.5, 20.0),
    Limit("symbol_word_ratio", None, 0.25),
    Limit("alphabetic_word_ratio", 0.6, None),
    Limit("stop_word_ratio", 0.01, None),
    Limit("duplicate_line_ratio", None, 0.5),
    Limit("bullet_line_ratio", None, 0.9),
    Limit("ellipsis_line_ratio", None, 0.5),
]


def bind(value: Column, use) -> Column:
    """use(value), with value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column, n: Column) -> Column:
    """Words in five-word windows that stand twice or more in the text."""
    last = n - 4

    def exact() -> Column:
        spans = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(5)), " ").alias("w"), i.alias("i")))

        def marked(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k).getField("w") == x.getField("w"), F.lit(False))
            at = F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x.getField("i"))), lambda i: i.isNotNull())
            zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-9).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(F.sort_array(at), zero, step, lambda a: a["n"])

        return bind(F.sort_array(spans), marked)

    hashes = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(5)))))
    some = bind(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 6, F.lit(0).cast("bigint")).otherwise(F.when(some, exact()).otherwise(F.lit(0).cast("bigint")))


def judge(docs: DataFrame, limits: list[Limit] = LIMITS, stop_words: list[str] = STOP_WORDS, carry: bool = False) -> DataFrame:
    """doc_id, the counts, the ratios of the table, base_failed and kept. Thresholds that are None don't hold. With
    carry a struct row of docs' own columns stands in place of doc_id, so that a verdict stays with its row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Of \r, \x0b and \x0c only those of WORD end a word; split() drops nothing, so empty strings are filtered out.
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(list(stop_words)))).alias("stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("alphabetic"),
            _repeated(w, n).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("duplicates"),
            F.size(F.filter(x, lambda s: s.rlike(r"^\s*[-*•]"))).alias("bullets"),
            F.size(F.filter(x, lambda s: s.rlike(r"(\.\.\.|…)\s*$"))).alias("ellipses"),
        )

    key = F.struct("*").alias("row") if carry else F.col("doc_id")
    made = docs.select(key, bind(words, of_words).alias("w"), bind(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"))
    n, n_lines = F.greatest(F.col("w.n_words"), F.lit(1)), F.greatest(F.col("l.n"), F.lit(1))
    ratios = {
        "mean_word_length": F.col("w.word_chars") / n,
        "symbol_word_ratio": F.col("n_symbols") / n,
        "alphabetic_word_ratio": F.col("w.alphabetic") / n,
        "stop_word_ratio": F.col("w.stop_words") / n,
        "duplicate_line_ratio": F.col("l.duplicates") / n_lines,
        "bullet_line_ratio": F.col("l.bullets") / n_lines,
        "ellipsis_line_ratio": F.col("l.ellipses") / n_lines,
    }
    fits = F.lit(True)
    for x in limits:
        for bound, holds in ((x.low, lambda v, b: v >= b), (x.high, lambda v, b: v <= b)):
            if bound is not None:
                fits &= holds(ratios[x.ratio], F.lit(bound))
    failed = (F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))
    return made.select("row" if carry else "doc_id", "w.n_words", "w.word_chars", "n_symbols", F.col("l.duplicates").alias("n_dup_lines"), "w.n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"), *(v.alias(k) for k, v in ratios.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    length(regexp_replace(coalesce(text, ''), '[^#*$%%&|<>]', '', 'g')) AS n_symbols
  FROM documents),
k AS (SELECT row_number() OVER () AS k, * FROM d),
grams AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM k)),
again AS (SELECT k, i FROM grams QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
inside AS (SELECT k, count(DISTINCT i + o) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY k),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: list_contains([%s], lower(rtrim(x, '.,;:!?'))))) AS stops,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) AS letters,
    len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS ellipses,
    greatest(len(w), 1) AS nw, greatest(len(l), 1) AS nl
  FROM k LEFT JOIN inside USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND %s AS kept FROM f
""" % (
    ", ".join(f"'{w}'" for w in STOP_WORDS),
    " AND ".join(f"{value} {sign} {bound}" for x, value in zip(LIMITS, ["word_chars / nw", "n_symbols / nw", "letters / nw", "stops / nw", "n_dup_lines / nl", "bullets / nl", "ellipses / nl"]) for sign, bound in ((">=", x.low), ("<=", x.high)) if bound is not None),
)
