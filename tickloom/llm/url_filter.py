"""Verdicts on URLs: fixed host and path rules first, then association rules mined from labels.

A labelled URL is a transaction of its tokens (scheme, parts of the host, pieces of the path, names and
values of the query, the fragment) and its label. FP-growth finds the token combinations that occur often, and
those after which one label follows often enough become rules. Rules are looked up through an
inverted index: each is listed under its rarest token, and a URL that has this token is checked for the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import bind, settle, tasks

#: (verdict, host and path); the longest that fits wins.
FIXED = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: A rule's tokens occur with its label in this share of the labelled URLs at least, and where
#: they occur, the label does in this share at least.
SUPPORT, CONFIDENCE = 0.01, 0.6
#: The verdict on a URL that no rule speaks of.
OTHERWISE = "allow"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host_and_path(url: Column) -> Column:
    """Struct (host, path) of a URL; both empty if it is null or has no ``://``."""

    def parts(rest: Column) -> Column:
        host = F.regexp_extract(rest, r"^[^/?#]*", 0)
        path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
        return F.struct(_lower(host).alias("host"), path.alias("path"))

    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return bind(F.coalesce(rest, F.lit("")), parts)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = FIXED) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does. A rule fits its
    host and all subdomains, if the path starts with the rule's; of equally long ones the first listed wins."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + start))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: ``scheme:https``, ``host:`` and a part of the host, ``path:`` and a
    piece of the path, ``query:`` and a name or value of the query, ``tail:`` and the fragment. Numbers are
    left out, since they name single pages."""

    def named(kind: str, text: Column, cut: str) -> Column:
        pieces = F.filter(F.split(text, cut), lambda t: (t != "") & ~F.rlike(t, F.lit("^[0-9]+$")))
        return F.transform(pieces, lambda t: F.concat(F.lit(f"{kind}:"), t))

    def all_of(u: Column) -> Column:
        both = host_and_path(u)
        return F.concat(
            named("scheme", _lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), ":"),
            named("host", both["host"], "[.]"),
            named("path", both["path"], "[/._-]"),
            named("query", F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "[&=]"),
            named("tail", F.regexp_extract(u, r"^[^#]*#(.*)$", 1), "[&=/]"),
        )

    return F.array_sort(F.array_distinct(bind(F.coalesce(url, F.lit("")), all_of)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows (rule, verdict, confidence, n): sorted token combinations and the label that follows.

    ``labelled`` has (tokens, label), label being ``allow`` or ``block``. ``n`` counts the URLs with
    the tokens and the label. An empty table gives no rules.
    """
    spark = labelled.sparkSession
    label = F.concat(F.lit("label:"), F.col("label"))
    baskets = labelled.select(F.array_append("tokens", label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    sets = settle(model.freqItemsets, "itemsets")
    verdict = F.get(F.filter("items", lambda t: F.startswith(t, F.lit("label:"))), F.lit(0))
    alone = F.array_sort(F.filter("items", lambda t: ~F.startswith(t, F.lit("label:"))))
    each = sets.select(alone.alias("rule"), F.substr(verdict, F.lit(7)).alias("verdict"), "freq")
    both, whole = each.where("verdict IS NOT NULL AND size(rule) > 0"), each.where("verdict IS NULL")
    joined = both.join(whole.select("rule", F.col("freq").alias("times")), "rule")
    rate = F.col("freq") / F.col("times")
    found = joined.select("rule", "verdict", rate.alias("confidence"), F.col("freq").alias("n"))
    return settle(found.where(rate >= confidence), "url-rules")


def inverted(rules: DataFrame) -> DataFrame:
    """The rules as an index, written: (key, rule, verdict, confidence, n), ``key`` being the
    rule's token that the fewest rules hold."""
    each = rules.select("*", F.explode("rule").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("held"))
    rarest = F.min(F.struct("held", "token"))["token"].alias("key")
    keys = each.join(counts, "token").groupBy("rule", "verdict").agg(rarest)
    return settle(rules.join(keys, ["rule", "verdict"]), "rule-index")


def best_rules(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (tokens, best): for each distinct token set its rule with the highest confidence; of
    equals the one seen more often, then the one whose tokens joined by a space come first, then block."""
    strings = F.array_join("rule", " ").alias("text")
    match = sets.select("tokens", F.explode("tokens").alias("key")).join(index, "key")
    held = F.size(F.array_except("rule", "tokens")) == 0
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("n")).alias("b"), strings, F.expr("verdict <> 'block'"), "verdict")
    return match.where(held).groupBy("tokens").agg(F.min(order).alias("best"))


def label_of(quality: Column, toxic: Column) -> Column:
    """``block`` for a document that is of low quality or toxic, ``allow`` for one that is neither,
    null where nothing is known."""
    return F.when((quality == 0) | (toxic == 1), "block").when((quality == 1) | (toxic == 0), "allow")


def page_document(path: Column) -> Column:
    """The document that a page shows: the number in its path, as in ``/en/17.html``; null if none."""
    return F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})(?![0-9])", 1).try_cast("bigint")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    url_col: str = "url",
    fixed: Sequence[tuple[str, str]] = FIXED,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    otherwise: str = OTHERWISE,
) -> DataFrame:
    """Rows (row, host, path, rule, verdict, mined): the input row as a struct, and what was decided.

    ``labels`` has (doc_id, quality, toxic) of documents; a page shows the document whose number its path holds.
    Where several labels of a document disagree, block counts. ``rule`` names the fixed rule
    that decides and is null where none fits; then the best mined rule decides, listed in ``mined``
    as its tokens joined by spaces, and without one ``otherwise``.

    Pages are written once with their tokens and a salt, and their distinct token sets, found by a
    combining aggregate, are matched and come back by (set, salt): no task gets all pages of a host
    or of a repeated URL. Only tokens of some rule are kept in a set, so sets repeat.

    A null URL, or one without ``://``, has an empty host and path and fits no rule of either kind
    but one on a scheme. Equal rows are judged alike and listed as often as they occur; whole URLs
    count, however long. Empty pages give no rows; without labels only fixed rules decide. Columns
    of any name ride along in ``row``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    parsed = pages.select(whole).withColumn("at", host_and_path(F.col("row")[url_col]))
    parsed = parsed.select(
        "row",
        "at.host",
        "at.path",
        page_document(F.col("at.path")).alias("shown"),
        tokens(F.col("row")[url_col]).alias("tokens"),
        F.pmod(F.monotonically_increasing_id(), F.lit(tasks(pages))).alias("salt"),
    )
    parsed = settle(parsed, "urls")
    known = labels.select("doc_id", label_of(F.col("quality"), F.col("toxic")).alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    # A label is copied to the salts that its document's pages have.
    shown = parsed.where("shown IS NOT NULL").select("shown", "salt", "tokens")
    copies = shown.select("shown", "salt").distinct().join(known.withColumnRenamed("doc_id", "shown"), "shown")
    labelled = shown.join(copies, ["shown", "salt"]).select("tokens", "label")
    index = inverted(mine(settle(labelled, "labelled"), support, confidence))
    # Each of these tokens is in a share of ``support`` of the labelled URLs, so they are few.
    used = [r.token for r in index.select(F.explode("rule").alias("token")).distinct().collect()]
    spoken = F.array_intersect("tokens", F.lit(used)) if used else F.array().cast("array<string>")
    parsed = parsed.withColumn("tokens", spoken)
    sets = settle(parsed.select("tokens", "salt").distinct(), "token-sets")
    best = best_rules(sets.select("tokens").distinct(), index)
    back = sets.join(best, "tokens").select("tokens", "salt", "best")
    found = parsed.join(back, ["tokens", "salt"], "left")
    found = found.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    return found.select(
        "row",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "best.verdict", F.lit(otherwise)).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("best.text")).alias("mined"),
    )
