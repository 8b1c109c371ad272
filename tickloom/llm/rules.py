"""Quality rules: a table of thresholds compiled into one projection of SQL functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import WORD, bind

WINDOW = 8

# Common function words of the corpus' languages.
STOP_WORDS = (
    "the of and to in a is that it was for on are with as by this be at from or an "
    "der die das und den von zu mit ist im für auf sich des nicht ein eine "
    "de la le et les en un une que est pour du dans qui sur par pas au "
    "el los las y del se no con su para lo al como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep documents with low * of <= metric <= high * of; ``of`` None: plain bounds."""

    name: str
    metric: str
    of: str | None = None
    low: float | None = None
    high: float | None = None


#: The production table. Each ratio's bound leaves a wide margin around plain prose.
RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("word_length", "word_chars", of="n_words", low=2.0, high=20.0),
    Rule("symbols", "n_symbols", of="n_words", high=0.1),
    Rule("shouting", "n_exclaim", of="n_words", high=0.5),
    Rule("stop_words", "n_stop_words", of="n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", of="n_lines", high=0.5),
    Rule("repeated_words", "n_repeat_words", of="n_words", high=0.3),
)

METRICS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words n_exclaim"
).split()


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that the text holds twice or more.

    Windows are compared by a hash first. Only if two hashes meet are the windows sorted by it;
    neighbours count when their words are equal.
    """
    last = F.size(words) - WINDOW
    every = F.sequence(F.lit(0), last)
    hashes = bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(every, lambda i: F.xxhash64(F.slice(h, i + 1, WINDOW))),
    )

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            words_at = lambda x: F.slice(words, x["i"] + 1, WINDOW)
            return F.coalesce((a["h"] == b["h"]) & (words_at(a) == words_at(b)), F.lit(False))

        def starts(rows: Column) -> Column:
            again = F.transform(
                rows,
                lambda x, k: F.when(
                    same(x, F.get(rows, k - 1)) | same(x, F.get(rows, k + 1)), x["i"]
                ),
            )
            return F.array_sort(F.filter(again, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.transform(
                at,
                lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))),
            )
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return bind(bind(ordered, starts), total)

    return F.when(last < 0, F.lit(0)).otherwise(
        bind(
            hashes,
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)),
        )
    )


def metrics(text: Column) -> Column:
    """A struct of the counts in ``METRICS``; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column, lines: Column) -> Column:
        values = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated_words(words),
            "n_lines": F.size(lines),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_exclaim": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        }
        return F.struct(*[values[name].cast("long").alias(name) for name in METRICS])

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return bind(words, lambda ws: bind(lines, lambda ls: counts(ws, ls)))


def compile_rules(values: Column, rules: Sequence[Rule]) -> Column:
    """The names of the rules that the counts break, in the table's order."""

    def broken(rule: Rule) -> Column:
        value = values[rule.metric].cast("double")
        unit = values[rule.of].cast("double") if rule.of else F.lit(1.0)
        tests = [value < unit * rule.low] if rule.low is not None else []
        tests += [value > unit * rule.high] if rule.high is not None else []
        return F.when(reduce(lambda a, b: a | b, tests), F.lit(rule.name))

    return F.array_compact(F.array(*[broken(rule) for rule in rules]))


def judge(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """One struct: the counts, base_failed, broken (names of rules) and kept."""

    def verdict(m: Column) -> Column:
        words = m["n_words"]
        base_failed = (words < 20) | (100 * m["n_repeat_words"] > 30 * words)
        broken = compile_rules(m, rules)
        return F.struct(
            *[m[name].alias(name) for name in METRICS],
            base_failed.alias("base_failed"),
            broken.alias("broken"),
            (~base_failed & (F.size(broken) == 0)).alias("kept"),
        )

    return bind(metrics(text), verdict)


def apply_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The input's rows as (row, verdict); ``row`` is a struct of all input columns.

    A map-side projection without user functions or shuffles: hot sources and copies cost
    nothing, and memory is bounded by the longest text. Null and empty texts have no words and
    fail. Rows are judged one by one, repeated ones too. ``row`` keeps the input's columns apart
    from the verdict's, so names cannot clash.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return docs.select(row.alias("row"), judge(docs[f"`{text_col}`"], rules).alias("verdict"))
