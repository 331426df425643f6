"""Point-in-time features from a materialised history: what was known of a client at any time, as segments.

1. Every click, sale and sale line counts during an interval: from when it has happened and was known until it is as
   old as the window. Its two ends are deltas. Those of lines and of busy clients are summed by time before they are dealt,
   as one sale's lines or a moment's clicks may be any number; other clients have few.
   An item counts once: a line adds the part of its interval that no line known before it covers - lines in order of
   their start, that is what follows the latest end so far. The last click needs no end: clicks known at a time end in
   the order of their times, so the greatest so far is the last one for as long as any click counts.
2. Clients of many events have bins: their stretch of time is cut evenly into about one bin for ``BIN`` events; the
   others have one bin. Sums run within a bin; what the bins before it hold follows from their totals by two levels of
   prefix sums (``quarry.operators.prefix``), a row for each bin, so that no client fills a task.
3. With ``lead`` each time begins a segment that lasts until the next: values are constant in it. Deltas of a client and
   window at one time are coalesced: only the last of them lasts. Segments never cross the edge of a bin: one begins at
   each edge that a probe needs. They are written as a table.
4. Probes find their bin and join its segments on client, window and bin; exactly one holds their time, or none where
   nothing has ever counted. What the bins before theirs hold is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch
from quarry.operators import prefix

#: Days of the windows, days that the label looks ahead, minutes until an arrived row is known.
WINDOWS, AHEAD, DELAY = (2, 14), 7, 240
#: Events for each bin of a client.
BIN = 256
_DAY, _MINUTE = 86_400_000_000, 60_000_000
#: Sums of a segment, with what a sale or click adds to them.
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents", "ahead")
#: Time and id of a click; a null id is less than any.
_LAST = "struct<ts: bigint, id: bigint>"
_KEY = ["client", "window", "bin"]
c = F.col


def micros(time: str, frame: DataFrame) -> Column:
    """Microseconds since 1970 of a time that is UTC, with or without zone."""
    at = c(time).cast("timestamp")
    if dict(frame.dtypes)[time] == "timestamp_ntz":
        at = F.from_utc_timestamp(at, F.current_timezone())
    return F.unix_micros(at)


def cents(x: str) -> Column:
    """``floor(100 * x + 0.5)``; 0 for null, for what is no number and beyond 9e16 either way."""
    y = F.lit(100) * c(x).cast("double") + F.lit(0.5)
    return F.when(c(x).isNotNull() & ~F.isnan(c(x).cast("double")) & (F.abs(y) < 9e16), F.floor(y)).otherwise(0)


def _bin(t: Column) -> Column:
    """A time's bin; 0 for clients of one bin."""
    return F.when(c("bins").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(c("bins") - 1, F.floor((t - c("lo")) / c("width"))))).cast("long")


def grid(sales: DataFrame, clicks: DataFrame, bin: int = BIN) -> DataFrame:
    """``(client, lo, width, bins)`` of the clients with more than ``bin`` events.

    Bins are even between the days that hold the first and last hundredth of a client's events; the outer bins are open.
    """
    events = sales.select("client", "ts").unionByName(clicks.select("client", "ts"))
    daily = events.groupBy("client", F.floor(c("ts") / _DAY).alias("day")).agg(F.count("*").alias("k"))
    whole = Window.partitionBy("client")  # a row for each day of a client
    shares = daily.select("client", "day", F.sum("k").over(whole).alias("n"), F.sum("k").over(whole.orderBy("day")).alias("upto")).where(c("n") > bin)
    day = lambda share: F.min(F.when(c("upto") >= F.lit(share) * c("n"), c("day")))
    ends = shares.groupBy("client").agg(F.first("n").alias("n"), day(0.01).alias("lo"), day(0.99).alias("hi"))
    bins = F.ceil(c("n") / F.lit(bin)).cast("long")
    return ends.select("client", (c("lo") * _DAY).alias("lo"), F.greatest(F.lit(1), F.ceil((c("hi") + 1 - c("lo")) * _DAY / bins)).cast("long").alias("width"), bins.alias("bins"))


def _deltas(rows: DataFrame, found: list[tuple[int, Column, dict[str, Column], bool]], last: Column | None = None) -> DataFrame:
    """One row ``(client, window, bin, t, SUMS, last)`` for each (window in days, time, sums, whether it counts)."""

    def pick(values: dict[int, Column], other: Column) -> Column:
        chain = F
        for i, x in values.items():
            chain = chain.when(c("_k") == i, x)
        return other if chain is F else chain.otherwise(other)

    zero, none = F.lit(0).cast("long"), F.lit(None).cast(_LAST)
    dealt = rows.withColumn("_k", F.explode(F.array(*map(F.lit, range(len(found))))))
    values = {s: pick({i: sums[s].cast("long") for i, (_, _, sums, _) in enumerate(found) if s in sums}, zero) for s in SUMS}
    latest = none if last is None else pick({i: last for i, f in enumerate(found) if f[3]}, none)
    dealt = dealt.withColumns({"window": pick({i: F.lit(f[0]) for i, f in enumerate(found)}, F.lit(0)), "t": pick({i: f[1] for i, f in enumerate(found)}, F.lit(None))} | {f"_{s}": x for s, x in values.items()} | {"_last": latest})
    return dealt.where("t IS NOT NULL").select("client", "window", _bin(c("t")).alias("bin"), "t", *(c(f"_{s}").alias(s) for s in (*SUMS, "last")))


def _ends(days: tuple[int, ...], start: Column, ts: Column, sums: dict[str, Column]) -> list:
    """Both ends of an interval from ``start`` until ``ts`` is as old as each window, where that is not over before."""
    out = []
    for d in days:
        end = ts + d * _DAY
        out.append((d, F.when(start < end, start), sums, True))
        out.append((d, F.when(start < end, end), {k: -v for k, v in sums.items()}, False))
    return out


def _coalesced(deltas: DataFrame, last: Column) -> DataFrame:
    """One delta for each client, window and time."""
    return deltas.groupBy(*_KEY, "t").agg(*(F.sum(s).alias(s) for s in SUMS), last.alias("last"))


class History:
    """Segments of all clients and windows, and the sales that they come from."""

    def __init__(self, clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, ahead: int = AHEAD, delay: int = DELAY, bin: int = BIN):
        """Rows without client or time take no part, nor do lines without sale; what never arrived counts for the label alone.

        Clicks that are equal in all columns count once. Other columns than those named in ``_read`` are ignored.
        """
        self.windows, self.ahead, self.delay = tuple(sorted(windows)), ahead, delay
        self.scratch = Scratch(clicks.sparkSession, "history")
        longest = self.windows[-1] * _DAY
        clicks, sales, lines = self._read(clicks, sales, lines)
        clicks = self.scratch.table(clicks, "clicks")
        cut = self.scratch.table(grid(sales, clicks, bin), "grid")
        self.sales = self.scratch.table(sales.join(cut, "client", "left"), "sales")
        timely = self.scratch.table(clicks.where(c("start") < c("ts") + longest).join(cut, "client", "left"), "timely")
        few, busy = "bins IS NULL", "bins IS NOT NULL"
        summed = [self._of_sales(self.sales.where(busy)), self._of_lines(lines, longest), self._edges()]
        deltas = [
            self._of_clicks(timely.where(few)),
            self._of_sales(self.sales.where(few)),
            _coalesced(self._of_clicks(timely.where(busy)), F.max("last")),
            _coalesced(reduce(DataFrame.unionByName, summed), F.lit(None).cast(_LAST)),  # no clicks; a struct would be sorted
        ]
        self.segments = self.scratch.table(self._segments(reduce(DataFrame.unionByName, deltas)), "segments")
        self.carry = self.scratch.table(self._carry(cut), "carry")
        self.scratch.drop("clicks", "timely", "lines", "totals", "grid")

    def _read(self, clicks: DataFrame, sales: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        wait = self.delay * _MINUTE
        known = lambda frame: F.greatest("ts", micros("arrived_at", frame) + wait)
        # greatest() skips nulls: what never arrived has no start
        start = lambda frame: F.when(c("arrived_at").isNotNull(), known(frame)).alias("start")
        clicks = clicks.distinct().where("client_id IS NOT NULL AND ts IS NOT NULL")
        times = clicks.withColumn("ts", micros("ts", clicks))
        clicks = times.select(c("client_id").cast("long").alias("client"), "ts", start(clicks), c("click_id").cast("long").alias("id"), (F.coalesce(c("kind"), F.lit("")) == "purchase").cast("long").alias("purchase"), cents("value").alias("cents"))
        sales = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL")
        times = sales.withColumn("ts", micros("sold_at", sales))
        sales = times.select(c("sale_id").cast("long").alias("sale_id"), c("client_id").cast("long").alias("client"), "ts", start(sales), cents("total").alias("cents"))
        lines = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select(c("sale_id").cast("long").alias("sale_id"), c("item_id").cast("long").alias("item"), micros("shipped_at", lines).alias("shipped"), cents("amount").alias("cents"))
        return clicks, sales, lines

    def _of_clicks(self, clicks: DataFrame) -> DataFrame:
        sums = {"n_clicks": F.lit(1), "n_purchases": c("purchase"), "click_cents": c("cents")}
        return _deltas(clicks, _ends(self.windows, c("start"), c("ts"), sums), F.struct("ts", "id").cast(_LAST))

    def _of_sales(self, sales: DataFrame) -> DataFrame:
        found = _ends(self.windows, c("start"), c("ts"), {"n_sales": F.lit(1), "sale_cents": c("cents")})
        for d in self.windows:
            found += [(d, c("ts") - self.ahead * _DAY, {"ahead": F.lit(1)}, False), (d, c("ts"), {"ahead": F.lit(-1)}, False)]
        return _deltas(sales, found)

    def _of_lines(self, lines: DataFrame, longest: int) -> DataFrame:
        same = lines.groupBy("sale_id", "item", "shipped").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
        sold = self.sales.where("start IS NOT NULL").drop("cents")
        rows = same.join(sold, "sale_id").withColumn("start", F.greatest("start", "shipped")).where(c("start") < c("ts") + longest)
        rows = self.scratch.table(rows.select("client", "item", "ts", "start", "n", "cents", "lo", "width", "bins", _bin(c("start")).alias("bin")), "lines")
        # the latest sale among the lines of this client and item that were known before this line
        totals = rows.where("bins IS NOT NULL AND item IS NOT NULL").groupBy("client", "item", "bin").agg(F.max("ts").alias("latest"))
        carry = prefix.before(totals, ["client", "item"], "bin", {"latest": "max"})
        earlier = Window.partitionBy("client", "item", "bin").orderBy("start", "ts").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(carry, ["client", "item", "bin"], "left").withColumn("latest", F.greatest("latest", F.max("ts").over(earlier)))
        found = []
        for d in self.windows:
            end = c("ts") + d * _DAY
            begin = F.greatest(c("start"), c("latest") + d * _DAY)
            new = (c("item").isNotNull() & (begin < end)).cast("long")
            at_once, later = new * (begin == c("start")).cast("long"), new * (begin > c("start")).cast("long")
            found.append((d, F.when(c("start") < end, c("start")), {"n_lines": c("n"), "line_cents": c("cents"), "n_items": at_once}, False))
            found.append((d, F.when(c("start") < end, end), {"n_lines": -c("n"), "line_cents": -c("cents"), "n_items": -new}, False))
            found.append((d, F.when(later == 1, begin), {"n_items": later}, False))
        return _deltas(rows, found)

    def _edges(self) -> DataFrame:
        """A delta of nothing at the lower edge of each bin where a probe lies."""
        at = self.sales.where("bins IS NOT NULL AND sale_id IS NOT NULL").withColumn("edge", _bin(probe_time())).where("edge > 0")
        edges = at.select("client", "lo", "width", "bins", "edge").distinct()
        return _deltas(edges, [(d, c("lo") + c("edge") * c("width"), {}, False) for d in self.windows])

    def _segments(self, deltas: DataFrame) -> DataFrame:
        """``(client, window, bin, since, until, SUMS, last)``: sums since the bin's begin; ``until`` is null at its end."""
        along = Window.partitionBy(*_KEY).orderBy("t")
        upto = along.rowsBetween(Window.unboundedPreceding, 0)
        values = {s: F.sum(s).over(upto) for s in SUMS} | {"last": F.max("last").over(upto), "until": F.lead("t").over(along)}
        # of the deltas at one time the last has them all, and the others no length
        return deltas.withColumns(values).where("until IS NULL OR t < until").select(*_KEY, c("t").alias("since"), "until", *SUMS, "last")

    def _carry(self, cut: DataFrame) -> DataFrame:
        """``(client, window, bin)`` of the clients with bins, and what all bins before hold of each sum and ``last``, named ``_*``."""
        ends = self.segments.where("until IS NULL").join(cut.select("client"), "client", "left_semi")
        totals = self.scratch.table(ends.select(*_KEY, *SUMS, "last"), "totals")
        before = prefix.before(totals, _KEY[:2], "bin", dict.fromkeys(SUMS, "sum") | {"last": "max"})
        return before.select(*_KEY, *(c(s).alias(f"_{s}") for s in (*SUMS, "last")))

    def at(self, probes: DataFrame) -> DataFrame:
        """``probes`` (client, t microseconds, lo, width, bins and others) with what was known at ``t``, a row for each window.

        ``lo``, ``width`` and ``bins`` are those of the client's row in ``sales``.
        """
        dealt = probes.withColumn("bin", _bin(c("t"))).withColumn("window", F.explode(F.array(*map(F.lit, self.windows))))
        inside = (c("since") <= c("t")) & (c("until").isNull() | (c("t") < c("until")))
        other = self.segments.select(*(c(k).alias(f"_{k}") for k in _KEY), "since", "until", *SUMS, "last")
        found = dealt.join(other, reduce(lambda a, b: a & b, (c(k) == c(f"_{k}") for k in _KEY)) & inside, "left").join(self.carry.hint("merge"), _KEY, "left")  # a row for each bin, too many to broadcast
        sums = {s: F.coalesce(s, F.lit(0)) + F.coalesce(f"_{s}", F.lit(0)) for s in SUMS}
        last = F.when(sums["n_clicks"] > 0, F.greatest("last", "_last")["id"])
        return found.select(*probes.columns, "window", (sums["ahead"] > 0).alias("label"), *(sums[s].cast("long").alias(s) for s in SUMS if s != "ahead"), last.alias("last_click_id"))


def probe_time() -> Column:
    """A sale's own time: up to three days after it, by a checksum of its id."""
    return c("ts") + F.crc32(c("sale_id").cast("string").cast("binary")) % 259_200 * 1_000_000


def feature_table(clicks: DataFrame, sales: DataFrame, lines: DataFrame, **options) -> DataFrame:
    """For each sale with id, client and time a row per window with what was known at ``probe_time``.

    Columns as in ``query``. Repeated sales count as often as they stand, with all lines of their id each. Empty tables
    count nothing.
    """
    history = History(clicks, sales, lines, **options)
    probes = history.sales.where("sale_id IS NOT NULL").select("sale_id", "client", probe_time().alias("t"), "lo", "width", "bins")
    return history.at(probes).select(
        "sale_id", c("window").cast("int").alias("d"), c("t").alias("t_us"), "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sales", "sale_lines")))


_CENTS = "CAST(COALESCE(SUM(CASE WHEN {0} IS NULL THEN 0 ELSE FLOOR(100 * {0} + 0.5) END), 0) AS BIGINT)"
_KNOWN = "x.ts > p.t - p.d * 86400000000 AND x.ts <= p.t AND x.arr + 14400000000 <= p.t"
SQL = f"""
WITH s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS ts, epoch_us(arrived_at) AS arr, total FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
k AS (SELECT click_id, client_id, epoch_us(ts) AS ts, epoch_us(arrived_at) AS arr, kind, value FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL),
crc AS (SELECT sale_id, client_id, ts, xor(list_reduce(list_transform(range(len(CAST(sale_id AS VARCHAR))), lambda i: CAST(ascii(CAST(sale_id AS VARCHAR)[i + 1]) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM s WHERE sale_id IS NOT NULL),
p AS (SELECT sale_id, client_id, CAST(d AS INTEGER) AS d, ts + h % 259200 * 1000000 AS t FROM crc, (VALUES (2), (14)) w(d)),
a AS (SELECT p.sale_id, p.d, COUNT(*) AS n, COUNT(*) FILTER (WHERE x.kind = 'purchase') AS n_purchases, {_CENTS.format("x.value")} AS cents, MAX({{'ts': x.ts, 'id': x.click_id}}).id AS last_id FROM p JOIN k x ON x.client_id = p.client_id AND {_KNOWN} GROUP BY p.sale_id, p.d),
b AS (SELECT p.sale_id, p.d, COUNT(*) AS n, {_CENTS.format("x.total")} AS cents FROM p JOIN s x ON x.client_id = p.client_id AND {_KNOWN} GROUP BY p.sale_id, p.d),
l AS (SELECT p.sale_id, p.d, COUNT(*) AS n, COUNT(DISTINCT z.item_id) AS n_items, {_CENTS.format("z.amount")} AS cents FROM p JOIN s x ON x.client_id = p.client_id AND {_KNOWN} JOIN sale_lines z ON z.sale_id = x.sale_id AND epoch_us(z.shipped_at) <= p.t GROUP BY p.sale_id, p.d),
f AS (SELECT DISTINCT p.sale_id, p.d FROM p JOIN s x ON x.client_id = p.client_id AND x.ts > p.t AND x.ts <= p.t + 604800000000)
SELECT p.sale_id, p.d, p.t AS t_us, f.sale_id IS NOT NULL AS label, COALESCE(a.n, 0) AS n_clicks, COALESCE(a.n_purchases, 0) AS n_purchases, COALESCE(a.cents, 0) AS click_cents, a.last_id AS last_click_id,
    COALESCE(b.n, 0) AS n_sales, COALESCE(b.cents, 0) AS sale_cents, COALESCE(l.n, 0) AS n_lines, COALESCE(l.n_items, 0) AS n_items, COALESCE(l.cents, 0) AS line_cents
FROM p LEFT JOIN a ON a.sale_id = p.sale_id AND a.d = p.d LEFT JOIN b ON b.sale_id = p.sale_id AND b.d = p.d LEFT JOIN l ON l.sale_id = p.sale_id AND l.d = p.d LEFT JOIN f ON f.sale_id = p.sale_id AND f.d = p.d
"""
