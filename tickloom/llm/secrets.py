"""Secret scans: trigram postings choose the candidates of each rule, SQL functions verify them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import bind


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least``
    characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The fixed kinds, in the order that breaks ties. A hex run is maximal, and so is what follows
#: AKIA, so the shorter matches can be dropped in the pattern itself; an assignment that is too
#: short still uses up its text, so there the match is dropped afterwards.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: Public formats of keys and tokens.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

RULES = BASE + MORE

#: A run of a pattern that stands for more strings than this is cut there.
MOST_STRINGS = 64

Clause = frozenset[frozenset[str]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


class _Runs:
    """Walks a parsed pattern; gathers what the strings it surely contains demand."""

    def __init__(self) -> None:
        self.clauses: list[Clause] = []
        self.run = {""}

    def flush(self) -> None:
        sets = {trigrams(s) for s in self.run}
        if frozenset() not in sets:
            self.clauses.append(frozenset(s for s in sets if not any(t < s for t in sets)))
        self.run = {""}

    def extend(self, strings: set[str] | None) -> None:
        if strings is None or len(self.run) * len(strings) > MOST_STRINGS:
            self.flush()
            strings = strings if strings and len(strings) <= MOST_STRINGS else None
        if strings is not None:
            self.run = {a + b for a, b in product(self.run, strings)}

    def walk(self, nodes) -> None:
        for kind, value in nodes:
            strings = _strings([(kind, value)])
            if strings is not None:
                self.extend(strings)
            elif kind is op.SUBPATTERN:
                self.walk(value[3])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                self.walk(list(value[2]) * min(value[0], 3))
                self.flush()
            else:
                self.flush()


def _strings(nodes) -> set[str] | None:
    """All strings that the nodes match, lower-cased; None if they are many or unbounded."""
    found = {""}
    for kind, value in nodes:
        if kind is op.LITERAL:
            here = {chr(value).lower()}
        elif kind is op.IN:
            here = set()
            for what, of in value:
                if what is op.LITERAL:
                    here.add(chr(of).lower())
                elif what is op.RANGE and of[1] - of[0] < 8:
                    here |= {chr(c).lower() for c in range(of[0], of[1] + 1)}
                else:
                    return None
        elif kind is op.SUBPATTERN:
            here = _strings(value[3])
        elif kind is op.BRANCH:
            parts = [_strings(branch) for branch in value[1]]
            here = None if None in parts else set().union(*parts)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 3:
            one = _strings(value[2])
            here = None
            if one is not None and len(one) ** value[1] <= MOST_STRINGS:
                here = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)}
        elif kind is op.AT:
            here = {""}
        else:
            here = None
        if here is None or len(found) * len(here) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, here)}
    return found


def trigram_query(pattern: str) -> list[Clause]:
    """What each match's lower-cased text must contain: every clause, and of a clause one of its
    sets, whole. No clause: the pattern demands no trigram, and texts must be scanned."""
    runs = _Runs()
    runs.walk(_parser.parse(pattern))
    runs.flush()
    return list(dict.fromkeys(runs.clauses))


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for s in clause for g in s})


def postings(docs: DataFrame, grams: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index: rows (gram, id), one for each of ``grams`` that a text contains.

    The grams are those that some rule asks for; a new rule with other trigrams adds its own.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in grams]))
    return keyed.select("id", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (id, kinds): the rules whose trigram query the postings of an id satisfy.

    Postings meet by id, so a trigram that every text holds is spread like the ids are, and what
    a group gathers is bounded by the number of trigrams asked for.
    """
    held = index.groupBy("id").agg(F.collect_set("gram").alias("grams"))

    def holds(grams: frozenset[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.array_contains("grams", g) for g in sorted(grams)])

    def satisfied(rule: Rule) -> Column:
        clauses = trigram_query(rule.pattern)
        tests = [
            reduce(lambda a, b: a | b, [holds(s) for s in sorted(clause, key=sorted)])
            for clause in clauses
        ]
        return reduce(lambda a, b: a & b, tests)

    asked = [r for r in rules if trigram_query(r.pattern)]
    kinds = F.array_compact(F.array(*[F.when(satisfied(r), F.lit(r.kind)) for r in asked]))
    return held.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """The rule's matches as (start, place, stop), in code points, stop exclusive.

    SQL has no function for the places of all matches, but the text is the pieces between the
    matches and the matches in turn, so the lengths of both add up to them.
    """
    kind = "array<struct<start:int,place:int,stop:int>>"
    pattern = F.lit(rule.pattern)
    lengths = lambda strings: F.transform(strings, lambda s: F.length(s))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        stop = start + row["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), stop.alias("stop")))
        out = F.when(row["measured"] >= rule.least, F.concat(state["out"], span))
        return F.struct(stop.alias("at"), out.otherwise(state["out"]).alias("out"))

    rows = F.arrays_zip(
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("measured"),
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    matched = F.filter(rows, lambda r: r["size"].isNotNull())  # the last piece follows no match
    return F.when(
        text.rlike(rule.pattern), F.aggregate(matched, start, add, lambda s: s["out"])
    ).otherwise(F.array().cast(kind))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """The input's rows as (row, spans): all rules' matches as (kind, start, stop) by start, then
    by the rules' order.

    A rule whose trigram query the postings of a row's id fail cannot match there and is not run;
    rules without mandatory trigrams run on every text. Only SQL functions are used; memory is
    bounded by the longest text. Null texts count as empty and have no spans. Rows that share an
    id share its candidates, and each is verified on its own text; null ids share theirs too.
    """
    check_rules(rules)
    grams = vocabulary(rules)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("row"), docs[f"`{id_col}`"].alias("id"))
    if grams:
        found = candidates(postings(docs, grams, id_col, text_col), rules)
        rows = (
            rows.alias("d")
            .join(found.alias("c"), F.expr("d.id <=> c.id"), "left")
            .select("row", F.coalesce("c.kinds", F.array().cast("array<string>")).alias("kinds"))
        )
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    nothing = F.array().cast("array<struct<start:int,place:int,stop:int>>")
    parts = []
    for place, rule in enumerate(rules):
        part = spans_of(text, rule, place)
        if trigram_query(rule.pattern):
            part = F.when(F.array_contains("kinds", rule.kind), part).otherwise(nothing)
        parts.append(part)
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    spans = F.transform(
        F.array_sort(F.concat(*parts)),
        lambda s: F.struct(
            F.element_at(names, s["place"] + 1).alias("kind"), s["start"], s["stop"]
        ),
    )
    return rows.select("row", spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def summary(spans: Column) -> Column:
    """A struct of the base kinds' numbers, the digest of their spans, and all spans as text."""
    base = [rule.kind for rule in BASE]

    def number(all_spans: Column, kind: str) -> Column:
        own = F.filter(all_spans, lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    def of(all_spans: Column) -> Column:
        fixed = F.filter(all_spans, lambda s: s["kind"].isin(base))
        return F.struct(
            *[number(all_spans, kind) for kind in base],
            F.sha2(span_text(fixed), 256).alias("base_sha256"),
            span_text(all_spans).alias("spans"),
        )

    return bind(spans, of)


def check_rules(rules: Sequence[Rule]) -> None:
    """Refuse patterns that Python cannot parse and kinds that occur twice."""
    for rule in rules:
        re.compile(rule.pattern)
    if len({rule.kind for rule in rules}) != len(rules):
        raise ValueError("each rule needs a kind of its own")
