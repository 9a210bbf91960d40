"""Quality rules: one threshold table compiled into one projection.

Every measure is a built-in or higher-order SQL function, so the whole table
is one narrow stage: no shuffle, no Python on the executors.

Edge cases: a null or blank text has no words, all its measures are 0 and it
fails the base rule; repeated rows are judged alike; other columns pass through
unread, whatever their names, and the operator's own columns replace any of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import columns, free, let, text_of, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
STOP_WORDS = tuple(
    """the of and to in is a that for it was on with as be by at are this from
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch
    le la les de et un une du en est que pour dans qui sur pas avec par ce
    el los las y del se con su al lo como más no""".split()
)


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word or per line. A text passes if it passes every rule.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("mean_word_chars", "mean_word_chars", 2.5, 15.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.3),
    Rule("shouted_words", "shout_ratio", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.05, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.8),
)


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Only texts with an
    equal pair sort their windows; the sort is n log n, whatever the text holds.
    """

    def covered(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def count(s: Column) -> Column:
            twins = F.filter(
                s,
                lambda e, i: (F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)))
                | (F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))),
            )
            places = F.sort_array(F.transform(twins, lambda e: e["p"]))
            return F.aggregate(
                places,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(rows, count))

    def pairs(h: Column, apart: int) -> Column:
        return F.zip_with(h, F.slice(h, apart + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    def of(w: Column) -> Column:
        # hashes of 1, 2, 4 and 8 words, each made of two of the last; the tail's are cut off
        hashes = let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: let(pairs(h, 1), lambda two: let(pairs(two, 2), lambda four: F.slice(pairs(four, 4), 1, F.size(w) - (WINDOW - 1)))),
        )
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, covered))

    return let(words, of)


def measures(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """A struct of every measure of ``text``."""

    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n_lines = F.size(lines).cast("long")
        return F.struct(
            n.alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            n_lines.alias("n_lines"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    return let(words_of(text), of)


def quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    t = text_of(df, text)
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_shout", "n_lines", "base_failed", "failed_rules", "kept"]
    held = df.drop(*[c for c in df.columns if c.lower() in own])
    row, measured = free(df, "row", "measured")
    m = held.select(
        *columns(held),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"!![\x20\x09-\x0D]")).cast("long").alias("n_shout"),
        measures(t).alias(measured),
        F.monotonically_increasing_id().alias(row),
    )
    m = m.select(*columns(m, held.columns), "n_symbols", "n_shout", f"{measured}.*", row)
    n, base = F.greatest(F.col("n_words"), F.lit(1)), (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ratio = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "shout_ratio": F.col("n_shout") / n,
        "stop_ratio": F.col("n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    failed = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (ratio[r.measure] < r.low)
        if r.high is not None:
            bad = bad | (ratio[r.measure] > r.high)
        failed.append(F.when(bad, F.lit(r.name)))
    m = m.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*failed))})
    # a filter on ``kept`` must not be pushed below the measures, which it would compute once for each mention;
    # Spark pushes nothing through a projection that numbers rows, and keeps that one as long as it is used
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & (F.col(row) >= 0)).drop(row)
