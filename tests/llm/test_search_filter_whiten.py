"""Whitening, URL verdicts and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EXTRA, prose
from tickloom.llm import lexical, url_filter, whitening

# Whitening


def vectors(spark, rows):
    extra = "row string, x string, n long, component int, values string, place string"
    full = [(i, v, None, "r", "x", 1, 2, "v", "p") for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<float>, label int, {extra}").repartition(4)


def plain_whitening(rows, most=16):
    """{vec_id: (deviation, whitened)}, eigenvalues, trace."""
    steps = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, steps.values()))), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    values, own = values[::-1], own[:, ::-1]
    count = min(most, int((values > len(sums) * 2.2e-16 * values[0]).sum()))
    found = {
        i: (sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - sums / n) @ own[:, :count] / np.sqrt(values[:count]))
        for i, x in steps.items()
    }
    return found, n, values[:count], float(values.sum())


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_whitening_against_another_eigenvalue_routine(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, (rng.standard_normal(size) * (1 + np.arange(size))).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies of one vector count once
    wanted, n, values, trace = plain_whitening(rows)
    found = whitening.whiten(vectors(spark, rows)).select("row.vec_id", "row.place", "n", "deviation", "components").collect()
    assert len(found) == len(rows) and {r.place for r in found} == {"p"}
    for r in found:
        deviation, whitened = wanted[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert [c.component for c in r.components] == list(range(1, len(values) + 1))
        assert np.abs([c.whitened for c in r.components]) == pytest.approx(np.abs(whitened), abs=1e-7)
        assert [c.explained for c in r.components] == pytest.approx(values / trace, rel=1e-9)
        assert all(c.identity_error < 1e-9 for c in r.components)


def test_whitening_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(10, [0.0, 1.0]), (10, [0.0, 1.0]), (None, [2.0, 1.0]), (11, [0.5, 1.0])]
    found = whitening.whiten(vectors(spark, bad + good)).collect()
    assert sorted(str(r["row"].vec_id) for r in found) == ["10", "10", "11", "None"]
    assert {(r.n, len(r.components)) for r in found} == {(3, 1)}  # the second entry never varies
    alone = whitening.whiten(vectors(spark, [(1, [3.0, 4.0])] * 3)).collect()
    assert [(r.n, r.deviation, r.components) for r in alone] == [(1, 0, [])] * 3
    assert whitening.whiten(vectors(spark, bad[:5])).count() == 0
    huge = whitening.whiten(vectors(spark, [(1, [1e38, 0.0]), (2, [-1e38, 1.0])])).collect()
    assert [r.deviation for r in huge] == [None, None]


@pytest.mark.parametrize("values", [[3.0] * 6, [1.0, 1.0, 0.0, 0.0], [5.0, 4.0, 4.0, 4.0, 1e-9], [1.0, -1.0, 2.0, -2.0]])
def test_divide_and_conquer_with_equal_values(values):
    size = len(values)
    basis = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]
    matrix = basis * np.array(values) @ basis.T
    found, own = whitening.components((matrix + matrix.T) / 2, size)
    assert found == pytest.approx(sorted(values, reverse=True), abs=1e-12)
    assert matrix @ own == pytest.approx(own * found, abs=1e-12)
    assert own.T @ own == pytest.approx(np.eye(size), abs=1e-12)


# URLs


def urls(spark, rows):
    extra = ", ".join(f"{name} string" for name in [*EXTRA, "host", "path", "rule", "tokens", "best", "fixed"])
    full = [(i, u, *["x"] * (len(EXTRA) + 6)) for i, u in rows]
    return spark.createDataFrame(full, f"page_id long, url string, {extra}").repartition(3)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def verdicts(found):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.select("row.page_id", "host", "path", "rule", "verdict").collect()}


FIXED_CASES = {
    1: ("http://A.Example.ORG/es/1?x=/en", "a.example.org", "/es/1", "example.org/es/", "block"),
    2: ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    3: ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    4: ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    5: ("https://example.org", "example.org", "", None, "allow"),
    6: ("https://x.com/de/#/fr/", "x.com", "/de/", "com/de/", "block"),
    7: ("x://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    8: ("www.example.org/es/", "", "", None, "allow"),
    9: (None, "", "", None, "allow"),
    10: ("", "", "", None, "allow"),
    11: ("http://host.net?u=http://b.org/", "host.net", "", None, "allow"),
    12: ("http://example.org:80/es/", "example.org:80", "/es/", None, "allow"),
    13: ("http://" + "a" * 50_000 + ".org/" + "b" * 50_000, "a" * 50_000 + ".org", "/" + "b" * 50_000, "org/", "allow"),
    14: ("://", "", "", None, "allow"),
}


def test_fixed_rules_and_odd_urls(spark):
    pages = urls(spark, [(i, c[0]) for i, c in FIXED_CASES.items()] + [(None, None), (3, FIXED_CASES[3][0])])
    found = url_filter.judge(pages, labelled(spark, []))
    assert found.count() == len(FIXED_CASES) + 2
    assert {i: v for i, v in verdicts(found).items() if i} == {i: c[1:] for i, c in FIXED_CASES.items()}
    assert url_filter.judge(urls(spark, []), labelled(spark, [(1, 0, 0)])).count() == 0


def test_longest_rule_wins(spark):
    page = urls(spark, [(1, "http://a.b.net/x/y")])
    rules = (("allow", "net/x/"), ("block", "b.net/"), ("allow", "net/"))
    found = page.withColumn("at", url_filter.host_and_path(F.col("url")))
    of = lambda r: found.select(url_filter.fixed_rule(F.col("at.host"), F.col("at.path"), r).alias("f")).first().f
    assert of(rules).rule == "net/x/" and of(rules).verdict == "allow"  # of equally long ones the first
    assert of(rules[::-1]).rule == "b.net/"
    assert of(()) is None


def plain_rules(baskets, support, confidence):
    """{(sorted tokens, label): (confidence, n)} by counting every subset."""
    least = math.ceil(support * len(baskets))
    times, with_label = Counter(), Counter()
    for own, label in baskets:
        for mask in range(1, 1 << len(own)):
            rule = tuple(t for k, t in enumerate(own) if mask >> k & 1)
            times[rule] += 1
            with_label[rule, label] += 1
    return {key: (n / times[key[0]], n) for key, n in with_label.items() if n >= least and n / times[key[0]] >= confidence}


def test_mined_rules_against_all_subsets(spark):
    rng = random.Random(4)
    baskets = []
    for _ in range(300):
        own = sorted(rng.sample([f"host:{c}" for c in "abcdefg"], rng.randint(0, 5)))
        bad = {"host:a", "host:c"} <= set(own) or rng.random() < 0.2
        baskets.append((own, "block" if bad else "allow"))
    wanted = plain_rules(baskets, 0.03, 0.6)
    rows = spark.createDataFrame(baskets, "tokens array<string>, label string")
    rules = url_filter.mine(rows, 0.03, 0.6)
    assert {(tuple(r.rule), r.verdict): (r.confidence, r.n) for r in rules.collect()} == wanted
    sets = rows.select("tokens").distinct()
    found = url_filter.best_rules(sets, url_filter.inverted(rules)).collect()
    order = lambda k: (-wanted[k][0], -wanted[k][1], " ".join(k[0]), k[1] != "block")
    for r in found:
        best = min((k for k in wanted if set(k[0]) <= set(r.tokens)), key=order)
        assert (r.best.text, r.best.verdict) == (" ".join(best[0]), best[1])
    assert {tuple(r.tokens) for r in found} == {
        tuple(own) for own, _ in baskets if any(set(k[0]) <= set(own) for k in wanted)
    }


def test_bad_hosts_are_learned_and_clean_ones_left_alone(spark):
    rng = random.Random(9)
    hosts = [f"site{k}.net" for k in range(10)] + ["cheap.spam.net", "www.spam.net"]
    rows, labels = [], []
    for i in range(900):
        host = hosts[0] if i % 3 == 0 else rng.choice(hosts)  # a third of the pages on one host
        rows.append((i, f"https://{host}/en/{i}?ref={i}"))
        if i % 2:
            labels += [(i, 0 if "spam" in host else 1, 0), (i, 0 if "spam" in host else None, None)]
    found = verdicts(url_filter.judge(urls(spark, rows), labelled(spark, labels)))
    assert len(found) == 900
    for i, url in rows:
        assert (found[i][3] == "block") == ("spam" in url)


def test_a_hot_label_is_spread(spark):
    pages = urls(spark, [(i, "http://one.net/en/5") for i in range(400)] + [(500 + i, f"http://two.net/en/{i}") for i in range(20)])
    found = url_filter.judge(pages, labelled(spark, [(5, 0, None), (5, 1, 0), (7, 1, 0)]))
    rows = verdicts(found)
    assert found.count() == 420 and all(rows[i][3] == "block" for i in range(400))


# Ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_rank(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score)."""
    own = [(i, Counter(plain_terms(t))) for i, t in docs]
    N = sum(bool(c) for _, c in own)
    L = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for t, n in df.items()}
    found = []
    for item, text in items:
        scores = []
        for doc, c in own:
            m = 25 + (75 * sum(c.values()) * N) // L if L else 25
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return found


def of(found):
    return [tuple(r) for r in found.orderBy("item_id", "rank").collect()]


def queries(spark, rows):
    extra = "rank int, score long, item string, doc_id long"
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], f"item_id long, text string, {extra}")


def corpus(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("an", "re", "th", "ou", "ti", "ß") for b in ("ea", "IN", "st", "7", "é", "le")]
    return [(i, prose(rng, rng.randint(0, 60), words[: rng.randint(2, 36)])) for i in range(n)]


def test_terms():
    text = "Ab-c_d É1x\u00a0y ÀB \x7fz[q]`r`{s}~ 日本.K"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)
    assert lexical.terms_of(None) == lexical.terms_of(b"") == []


def test_rank_against_every_score(spark, make):
    docs = corpus(700, 3)
    rows = make([(i, t, "en", "s") for i, t in docs])
    items = [(i, t) for i, t in corpus(40, 8)]
    assert of(lexical.rank(rows, queries(spark, items))) == plain_rank(docs, items)


def test_rank_odd_rows(spark, make, nothing, edge, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows]
    items = [(1, None), (2, ""), (3, " ,. "), (4, "The of AND anea"), (5, "x" * 200_000), (6, "nowhere"), (7, "of of of"), (8, docs[8][1])]
    assert of(lexical.rank(edge, queries(spark, items))) == plain_rank(docs, items)
    assert lexical.rank(nothing, queries(spark, items)).count() == 0
    assert lexical.rank(edge, queries(spark, [])).count() == 0
    # Ties of copies, a null id last; equal item rows count once, the texts of one item add up.
    same = [(i, "alpha beta", None, None) for i in range(30, 5, -1)] + [(None, "alpha beta", "en", "s"), (50, "gamma", "en", "s"), (50, "gamma", "en", "s")]
    found = of(lexical.rank(make(same), queries(spark, [(1, "beta"), (1, "beta"), (2, "gamma"), (None, "gamma"), (None, "alpha")])))
    assert [r[2] for r in found if r[0] == 1] == list(range(6, 16))
    assert [(r[1], r[2]) for r in found if r[0] == 2] == [(1, 50), (2, 50)]
    assert [r for r in found if r[0] == 1] == plain_rank([r[:2] for r in same], [(1, "beta")])
    assert [r for r in found if r[0] is None] == plain_rank([r[:2] for r in same], [(None, "gamma alpha")])


def test_rounds_and_small_chunks_give_the_same(spark, make, monkeypatch):
    docs = corpus(300, 5)
    rows, items = make([(i, t, "en", "s") for i, t in docs]), corpus(25, 6)
    monkeypatch.setattr(lexical, "ROUND", 40)
    monkeypatch.setattr(lexical, "CELLS", 600)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    assert of(lexical.rank(rows, queries(spark, items))) == plain_rank(docs, items)


def test_blocks_are_passed_over_only_below_their_bound(spark, make, monkeypatch):
    monkeypatch.setattr(lexical, "PILOT", 2)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(11)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(6)]
    every = sum(topics, [])
    docs = [(i, prose(rng, 30, topics[i % 6] if i % 5 == 0 else every)) for i in range(1500)]
    items = [Counter(lexical.terms_of(" ".join(rng.sample(t, 5)).encode())) for t in topics]
    numbers = {t: k for k, t in enumerate(sorted(set().union(*items)))}
    rows = lexical.settle(lexical.forward(make([(i, t, "en", "s") for i, t in docs]), numbers), "forward")
    plan = lexical.make_plan(rows, items, numbers, 10)
    assert all(plan.least > 1)
    index = lexical.build(rows, plan).toPandas()
    seen = passed = 0
    for _, row in index.iterrows():
        chunk = row.map(np.array)
        _, more, less = lexical.search_chunk(plan, dict(chunk), 10)
        seen, passed = seen + more, passed + less
        # Each block's largest impacts are those of its documents.
        full = lexical._matrix(plan.size, chunk.starts, chunk.terms, chunk.impacts)
        begin = at = 0
        for term, end in zip(chunk.block_terms, chunk.block_ends, strict=True):
            wanted = plan.lists[term][1]
            own = chunk.block_docs[begin:end]
            assert (full[term][own] > 0).all()
            assert (chunk.peaks[at : at + len(wanted)] == full[np.ix_(wanted, own)].max(axis=1)).all()
            begin, at = end, at + len(wanted)
        assert begin == len(chunk.block_docs) and at == len(chunk.peaks)
    assert passed > seen > 0
