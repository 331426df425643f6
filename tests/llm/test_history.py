"""Point-in-time features against a plain loop over all rows, with clients of many bins."""

import datetime as dt
import random
import re
import zlib

from quarry.llm import feature_history as fh

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
T0, DAY = dt.datetime(2024, 2, 20), 86_400_000_000


def us(t):
    return None if t is None else int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def plain(clicks, sales, lines, windows):
    cents = lambda x: 0 if x is None else int((100 * x + 0.5) // 1)
    known = lambda t, ts, arrived, d: ts is not None and arrived is not None and t - d * DAY < us(ts) <= t and us(arrived) + 240 * 60_000_000 <= t
    out, clicks = [], set(clicks)
    for s in sales:
        if s[0] is None or s[1] is None or s[4] is None:
            continue
        t = us(s[4]) + zlib.crc32(str(s[0]).encode()) % 259_200 * 1_000_000
        label = any(o[1] == s[1] and o[4] is not None and t < us(o[4]) <= t + 7 * DAY for o in sales)
        for d in windows:
            c = [k for k in clicks if k[3] == s[1] and known(t, k[1], k[2], d)]
            b = [o for o in sales if o[1] == s[1] and known(t, o[4], o[5], d)]
            own = [x for o in b for x in lines if x[0] is not None and x[0] == o[0] and x[8] is not None and us(x[8]) <= t]
            last = max(c, key=lambda k: (k[1], -1 << 70 if k[0] is None else k[0]))[0] if c else None
            out.append((s[0], d, t, label, len(c), sum(k[4] == "purchase" for k in c), sum(cents(k[5]) for k in c), last, len(b), sum(cents(o[3]) for o in b), len(own), len({x[2] for x in own} - {None}), sum(cents(x[5]) for x in own)))
    return sorted(out)


def shop(seed, n, clients):
    rnd = random.Random(seed)
    time = lambda: T0 + dt.timedelta(hours=rnd.randrange(900), microseconds=rnd.choice([0, 0, 123_457]))
    client = lambda: rnd.choice([7, 7, 7, *range(clients), None])
    maybe = lambda x: None if rnd.random() < 0.05 else x

    def arrived(t):
        return maybe(t + dt.timedelta(minutes=rnd.choice([0, 1, 300, 5000, -90])))

    clicks = []
    for i in range(n):
        t = time()
        clicks.append((maybe(i), maybe(t), arrived(t), client(), rnd.choice(["purchase", "view", None]), maybe(rnd.choice([1.005, -2.345, 7.0])), "{}"))
    clicks += rnd.sample(clicks, n // 10)  # equal rows
    clicks += [(k[0], k[1], k[2], k[3], k[4], 99.0, k[6]) for k in rnd.sample(clicks, n // 20)]  # other rows of an id
    clicks += [(9000 + i, *clicks[i][1:]) for i in range(n // 10)]  # ties in time
    sales, lines = [], []
    for i in range(n // 3):
        t = time()
        sales.append((i, client(), "done", maybe(rnd.uniform(-5, 90)), maybe(t), arrived(t), 1))
        for k in range(rnd.randrange(5)):
            row = (maybe(i), k, rnd.choice([1, 1, 1, 2, 3, None]), 1, 1, maybe(rnd.uniform(0, 50)), 0.0, "", maybe(t + dt.timedelta(days=rnd.randrange(-2, 16))))
            lines += [row] * rnd.choice([1, 1, 2])
    sales += [(None, 7, "done", 5.0, T0, T0, 1)]
    lines += [(10_000, 1, 1, 1, 1, 1.0, 0.0, "", T0)]
    return clicks, sales, lines


def frames(spark, clicks, sales, lines):
    return [spark.createDataFrame([(*r, "x") for r in rows], schema + ", bins string") for rows, schema in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]


def test_features_equal_the_loop(spark):
    tables = shop(5, 400, 6)
    want = plain(*tables, (2, 14))
    for bin in (8, 256):  # client 7 has dozens of bins, or two
        assert sorted(map(tuple, fh.feature_table(*frames(spark, *tables), bin=bin).collect())) == want
    assert any(r[3] for r in want) and any(r[11] > 1 for r in want)


def test_segments_hold_their_values(spark):
    """Segments of a client and window neither overlap nor cross a bin, and other windows may be asked for."""
    tables = shop(6, 150, 3)
    history = fh.History(*frames(spark, *tables), windows=(5,), bin=8)
    rows = sorted((r.client, r.since, r.until, r.bin) for r in history.segments.where("client IS NOT NULL").collect())
    for a, b in zip(rows, rows[1:]):
        assert a[0] != b[0] or (a[2] == b[1] if a[3] == b[3] else a[2] is None)
    probes = history.sales.where("sale_id IS NOT NULL").select("sale_id", "client", fh.probe_time().alias("t"), "lo", "width", "bins")
    got = sorted((r.sale_id, r.n_clicks, r.n_items) for r in history.at(probes).collect())
    assert got == sorted((r[0], r[4], r[11]) for r in plain(*tables, (5,)))


def test_deltas_meet_once(spark, monkeypatch):
    """Deltas aren't kept before their segments: one exchange by bin, and clicks are told apart once."""
    plans, table = {}, fh.Scratch.table

    def kept(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return table(self, df, name)

    monkeypatch.setattr(fh.Scratch, "table", kept)
    history = fh.History(*frames(spark, *shop(7, 150, 3)), bin=8)
    assert "deltas" not in plans and [n for n, p in plans.items() if "props" in p] == ["clicks"]
    assert len(re.findall(r"hashpartitioning\(client#\d+L?, window#\d+L?, bin#\d+L?, \d+\)", plans["segments"])) == 1
    assert history.segments.where("since >= until").isEmpty()
    # what begins also ends: each client's last bin, with the bins before it, comes to nothing
    ends = history.segments.where("client IS NOT NULL AND until IS NULL").join(history.carry, ["client", "window", "bin"], "left").collect()
    last = {(r.client, r.window): r for r in sorted(ends, key=lambda r: r.bin)}
    assert max(r.bin for r in ends) > 8 and all(r[s] + (r[f"_{s}"] or 0) == 0 for r in last.values() for s in fh.SUMS)


def test_one_sale_with_all_lines(spark, monkeypatch):
    """However many lines a sale has, few deltas meet in its bin."""
    dealt, segments = [], fh.History._segments

    def seen(self, deltas):
        dealt.append(deltas.groupBy("client", "window", "bin").count().agg({"count": "max"}).first()[0])
        return segments(self, deltas)

    monkeypatch.setattr(fh.History, "_segments", seen)
    sale = (1, 7, "done", 2.5, T0, T0, 1)
    lines = [(1, k, k, 1, 1, 1.0, 0.0, "", T0 - dt.timedelta(days=1)) for k in range(500)]
    found = fh.feature_table(*frames(spark, [], [sale], lines)).collect()
    assert sorted(map(tuple, found)) == plain([], [sale], lines, (2, 14)) and dealt[0] <= 8


def test_empty_shop(spark):
    none = frames(spark, [], [], [])
    assert fh.feature_table(*none).count() == 0
    one = (1, 7, "done", 2.5, T0, T0, 1)
    (a, b) = sorted(map(tuple, fh.feature_table(none[0], frames(spark, [], [one], [])[1], none[2]).collect()))
    t = us(T0) + zlib.crc32(b"1") % 259_200 * 1_000_000
    seen = t >= us(T0) + 240 * 60_000_000
    inside = seen and t < us(T0) + 2 * DAY
    assert a == (1, 2, t, False, 0, 0, 0, None, int(inside), 250 * inside, 0, 0, 0) and b == (1, 14, t, False, 0, 0, 0, None, int(seen), 250 * seen, 0, 0, 0)
