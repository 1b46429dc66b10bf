"""Operator 4, quality rules [native].

A threshold table is compiled into one Spark projection: every metric is a
built-in expression over the text, every rule a comparison of two integer
products, so no ratio is divided and none can hit a zero denominator.

Nulls and empty texts have no words, hence 0 for every metric, and fail the
base rule.  Texts of any length are read whole: words in repeated windows are
found by sorting 64-bit window hashes inside the row, n log n in the number of
words.  Ties and repeated rows are judged alike, row by row.  Extra columns of
the input are kept by ``apply_rules``; where a name clashes with a metric's,
the metric replaces it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.shared import SPACES

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages, all lower case.
STOP_WORDS = (
    "the of and to in a is that it for on with as by this be are from or an at was "
    "de la le les et des en un du que une est pour qui dans par pas sur au avec "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "el los las y del se por con no su para es al lo como más o pero sus le"
).split()


class Rule(NamedTuple):
    """``num * scale <op> bound * den``; a document that satisfies it is rejected."""

    name: str
    num: str
    op: str
    bound: int
    den: str
    scale: int = 100


#: Rows of the threshold table; bounds in percent of the denominator.
RULES = (
    Rule("short_words", "word_chars", "<", 200, "n_words"),
    Rule("long_words", "word_chars", ">", 1200, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words"),
    Rule("dup_lines", "n_dup_lines", ">", 50, "n_lines"),
    Rule("few_stop_words", "n_stop_words", "<", 4, "n_words"),
)
#: The two rules of the base contract.
BASE = (
    Rule("few_words", "n_words", "<", 50, "one", 1),
    Rule("repeat_words", "n_repeat_words", ">", 50, "n_words"),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda parameter is evaluated once; a column would be inlined into every
    element of the inner lambdas.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text (null: none) as an array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more."""
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def steps(spots: Column) -> Column:
        after = F.slice(spots, 2, F.greatest(F.size(spots) - 1, F.lit(0)))
        gaps = F.zip_with(after, spots, lambda b, a: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def covered(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, j: F.coalesce(x["h"] == F.get(pairs, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, j + 1)["h"], F.lit(False)),
        )
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), steps)

    def counted(hashes: Column) -> Column:
        # Most texts repeat no window, and need no sort.
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(F.lit(0))

    return F.when(n >= 4, let(F.transform(F.sequence(F.lit(0), n - 3), window), counted)).otherwise(F.lit(0))


def metrics(text: Column) -> dict[str, Column]:
    """Metric columns of a text; those that need the word array are in one struct."""
    whole = F.coalesce(text, F.lit(""))
    by_word = let(
        words_of(whole),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    by_line = let(
        F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0),
        lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")),
    )
    return {
        "by_word": by_word,
        "by_line": by_line,
        "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long"),
    }


def broken(rule: Rule, named=F.col) -> Column:
    left = named(rule.num) * rule.scale
    right = F.lit(rule.bound) if rule.den == "one" else named(rule.den) * rule.bound
    return left < right if rule.op == "<" else left > right


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the metrics, ``base_failed``, ``broken`` (names of rules broken) and ``kept``."""
    made = metrics(F.col(text))
    keep = [c for c in docs.columns if c not in (*METRICS, *made, "base_failed", "broken", "kept")]
    measured = docs.select(*keep, *[c.alias(k) for k, c in made.items()])
    flat = measured.select(
        *keep, "by_word.n_words", "word_chars", "n_symbols", "by_line.n_dup_lines", "by_word.n_repeat_words", "by_line.n_lines", "by_word.n_stop_words"
    )
    base = F.lit(False)
    for rule in BASE:
        base = base | broken(rule)
    names = F.filter(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    judged = flat.select("*", base.alias("base_failed"), names.alias("broken"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns, whatever those are called.

    The metrics are generated as one struct, since a filter on projected
    metrics is pushed down and computes each of them once per rule.
    """
    made, name = metrics(F.col(text)), "quality"
    while name in docs.columns:
        name += "_"
    place = {"n_words": "by_word.n_words", "n_repeat_words": "by_word.n_repeat_words", "n_stop_words": "by_word.n_stop_words", "n_lines": "by_line.n_lines", "n_dup_lines": "by_line.n_dup_lines"}
    measured = docs.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias(name))
    bad = F.lit(False)
    for rule in (*BASE, *rules):
        bad = bad | broken(rule, lambda k: F.col(f"{name}.{place.get(k, k)}"))
    return measured.filter(~bad).select(*[F.col(f"`{c}`") for c in docs.columns])
