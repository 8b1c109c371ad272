import random
from decimal import Decimal

import numpy as np
import pytest

from tickloom.operators import book, book_history

LEVELS = "market_id long, seq long, side string, price long, amount long"


def capture(rng, market, messages, prices=12, snapshot=0.03):
    """(levels, snapshots) of one market: deltas that set or remove, snapshots, messages of neither kind."""
    levels, snapshots, seq = [], [], rng.randint(0, 5)
    for _ in range(messages):
        seq += 1 if rng.random() < 0.9 else rng.randint(2, 30)
        kind = rng.random()
        if kind < snapshot:
            snapshots.append((market, seq))
            for side in ("bid", "ask"):
                for price in rng.sample(range(prices), rng.randint(0, 4)):
                    levels.append((market, seq, side, price, rng.randint(1, 3)))
        elif kind < 0.9:
            side = rng.choice(["bid", "ask"])
            for price in rng.sample(range(prices), rng.randint(1, 2)):
                levels.append((market, seq, side, price, rng.choice([0, 0, 1, 2])))
    return levels, snapshots


def replay(levels, snapshots):
    """{market: [(seq, {(side, price): amount})]} after each message that touches a book."""
    found = {}
    for market in {m for m, _ in snapshots}:
        clears = {s for m, s in snapshots if m == market}
        seqs = sorted(clears | {r[1] for r in levels if r[0] == market})
        now, history = {}, []
        for seq in seqs:
            if seq < min(clears):
                continue
            now = {} if seq in clears else dict(now)
            for _, s, side, price, amount in levels:
                if (s, _) == (seq, market):
                    now.pop((side, price), None)
                    if amount > 0:
                        now[side, price] = amount
            history.append((seq, now))
        found[market] = history
    return found


def tables(spark, levels, snapshots, parts=5):
    rows = spark.createDataFrame(levels, LEVELS).repartition(parts)
    return rows, spark.createDataFrame(snapshots, "market_id long, seq long")


@pytest.fixture(scope="module")
def markets():
    rng = random.Random(6)
    levels, snapshots = [], []
    for market, messages in ((1, 400), (2, 60), (3, 5)):
        more, clears = capture(rng, market, messages)
        levels, snapshots = levels + more, snapshots + clears
    more, _ = capture(rng, 4, 30, snapshot=0)  # a market that never has a snapshot
    return levels + more, snapshots + [(5, 3), (5, 9)]  # and one whose snapshots are empty


@pytest.mark.parametrize("width", [7, 100_000])
def test_lives_cover_each_book(spark, markets, width):
    lives = book_history.level_lives(*tables(spark, *markets), width=width).collect()
    for market, history in replay(*markets).items():
        own = [r for r in lives if r.market_id == market]
        for seq, now in history:
            standing = {
                (r.side, r.price): r.amount for r in own if r.seq_from <= seq and (r.seq_to is None or seq < r.seq_to)
            }
            assert standing == now
    clears = set(markets[1])
    rows = {(m, s, side, price): amount for m, s, side, price, amount in markets[0]}
    for r in lives:
        then = rows.get((r.market_id, r.seq_to, r.side, r.price))
        if r.closed_by == "snapshot":
            assert (r.market_id, r.seq_to) in clears
        elif r.closed_by is None:
            assert r.seq_to is None
        else:
            assert (r.closed_by == "overwrite") == (then > 0) and (r.market_id, r.seq_to) not in clears


@pytest.mark.parametrize("width", [9, 100_000])
def test_book_at_many_points(spark, markets, width):
    history = replay(*markets)
    last = {m: h[-1][0] for m, h in history.items() if h}
    points = [(m, s) for m, end in last.items() for s in range(-2, end + 20)] + [(4, 10), (None, 5), (1, None)]
    asked = spark.createDataFrame(points + points[:50], "market_id long, seq long")
    found = book_history.book_at(*tables(spark, *markets), asked, width=width).collect()
    wanted = set()
    for m, s in points:
        now = [book for at, book in history.get(m, []) if s is not None and at <= s]
        wanted |= {(m, s, side, price, amount) for (side, price), amount in (now[-1].items() if now else ())}
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_book_at_the_end_is_the_full_book(spark, markets):
    rows, snapshots = tables(spark, *markets)
    points = spark.createDataFrame([(m, 10**9) for m in range(1, 6)], "market_id long, seq long")
    found = book_history.book_at(rows, snapshots, points).drop("seq")
    full = book.book_full(rows, snapshots)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, full.collect()))


def tops(history):
    rows = []
    for market, states in history.items():
        before = None
        for seq, now in states:
            bids = [p for s, p in now if s == "bid"]
            asks = [p for s, p in now if s == "ask"]
            bid, ask = max(bids, default=None), min(asks, default=None)
            top = (bid, now.get(("bid", bid)), ask, now.get(("ask", ask)))
            if top != before:
                rows.append((market, seq, *top, None if bid is None or ask is None else ask - bid))
            before = top
    return sorted(rows)


@pytest.mark.parametrize("width", [1, 8, 50_000])
def test_top_after_each_message(spark, markets, width):
    found = book_history.book_top(*tables(spark, *markets), width=width).collect()
    key = lambda r: r[:2]
    assert sorted(map(tuple, found), key=key) == sorted(tops(replay(*markets)), key=key)


def test_top_with_decimals_and_empty_tables(spark):
    kind = "decimal(38,18)"
    schema = f"market_id long, seq long, side string, price {kind}, amount {kind}"
    price = Decimal("0.000000000000000001")
    rows = spark.createDataFrame([(1, 5, "bid", price, Decimal(2)), (1, 6, "bid", price * 3, Decimal(1)), (1, 8, "bid", price * 3, Decimal(0))], schema)
    snapshots = spark.createDataFrame([(1, 5)], "market_id long, seq long")
    found = book_history.book_top(rows, snapshots).orderBy("seq").collect()
    assert [(r.seq, r.best_bid, r.bid_amount, r.best_ask) for r in found] == [
        (5, price, 2, None), (6, price * 3, 1, None), (8, price, 2, None)
    ]
    nothing = snapshots.limit(0)
    assert book_history.book_top(rows, nothing).count() == 0
    assert book_history.book_top(rows.limit(0), nothing).count() == 0
    assert book_history.book_at(rows.limit(0), snapshots, snapshots).count() == 0
    assert book_history.book_at(rows, snapshots, nothing).count() == 0


def test_best_after_of_empty_intervals():
    none = book_history.best_after(np.array([0, 1, 2]), np.array([0, 1, 2]), np.arange(2))
    assert none.tolist() == [-1, -1]
    found = book_history.best_after(np.array([0, 1]), np.array([2, 1]), np.arange(2))
    assert found.tolist() == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 100])
def test_best_after(n):
    rng = np.random.default_rng(n)
    starts = rng.integers(0, n, 80)
    ends = np.minimum(n, starts + rng.integers(0, n, 80))
    found = book_history.best_after(starts, ends, np.arange(n))
    for k in range(n):
        assert found[k] == max([i for i in range(80) if starts[i] <= k < ends[i]], default=-1)


def test_last_seq_at(spark):
    messages = spark.createDataFrame([(1, 1, 100), (1, 2, None), (1, 3, 300), (1, 4, 300), (2, 9, 50)], "market_id long, seq long, time_us long")
    times = spark.createDataFrame([(1, 99), (1, 100), (1, 299), (1, 300), (1, 300), (2, 10**12), (3, 1)], "market_id long, time_us long")
    for width in (10, 10**10):
        found = book_history.last_seq_at(messages, times, width).collect()
        assert sorted(map(tuple, found)) == [(1, 100, 1), (1, 299, 1), (1, 300, 4), (2, 10**12, 9)]


def test_a_market_is_many_tasks(spark, markets):
    rows, snapshots = tables(spark, *markets)
    lives = book_history.settle(book_history.level_lives(rows, snapshots).drop("closed_by"), "lives")
    plan = book_history.top_of_lives(lives, snapshots, 8)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(market_id" in text and "SinglePartition" not in text
