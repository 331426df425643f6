"""Removal of repeated passages: suffix arrays over shards of text that may repeat.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Exactly:

1. Anchors. The window of ``length`` bytes at each place has one anchor: the place of least gram hash among
   its first half. It lies in the window and depends on the window's bytes alone, so equal windows have
   equal anchors, with equal bytes (half a window) after them: the anchor's print. The windows of one anchor
   start side by side; what they cover is its region.
2. A region whose print is unique can't hold a repeated window. Regions that occur twice and more as a whole -
   told by 128-bit digests of their bytes - are repeated in all windows. Counts tell both, and these combine
   before they are shuffled.
3. For what is left - prints with several different regions - one copy of each different region goes to a
   shard chosen by the print, so that all possible partners of a window meet. A shard sorts all suffixes of
   its regions by Larsson-Sadakane refinement in numpy and gets the common prefixes of neighbours by Kasai's
   algorithm, all regions in step; a window is repeated if either neighbour shares ``length`` bytes.
4. A print with more different regions than a shard takes goes to many shards, which binary search over the
   window starts merges: an interval of starts (relative to the anchor) has a core, common to its windows,
   and a hull, which they cover. Equal windows have equal cores, so each core is a group by itself. Nobody
   shares the core: none of the windows repeats. Somebody shares the hull: all do, and one copy stands for
   them. Otherwise a group that fits a shard is sorted there, and a larger one has its interval halved.
   Each region with a window in question gives two halves a step at most, however many share its core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, bytes_of, chunks, eights, mix, partitions, release, small_batches, spread_join, text_array, tidy, unused, word_spans

LENGTH, GRAM = 400, 16
#: Different regions in a shard; with at most 1.5 windows each, places stay below ``PLACES`` at the standard length.
SHARD_REGIONS = 1000
#: Symbols that one suffix array takes.
PLACES = 1 << 20
#: Text bytes that one numpy pass looks for anchors in.
BLOCK_BYTES = 1 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours (len(x) - w + 1 values)."""
    reach = 1
    while reach * 2 <= w:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (w - reach)], x[w - reach :]) if w > reach else x


def find_anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last window start of every region; places count from the start of ``data``."""
    half = length // 2
    gram = min(GRAM, length - half)
    windows = len(data) - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    eight, n = eights(data), len(data) - gram + 1
    if gram < 8:
        key = mix(eight[:n] & np.uint64((1 << 8 * gram) - 1))
    else:
        key = mix(eight[:n])
        key ^= eight[gram - 8 : gram - 8 + n]
        key = mix(key)
    # hash above, place below: the leftmost of equal hashes is least
    key &= ~np.uint64((1 << 24) - 1)
    key |= np.arange(n, dtype=np.uint64)
    key = sliding_min(key[: windows + half - 1], half)
    key &= np.uint64((1 << 24) - 1)
    anchor = key.astype(np.int32)
    del key
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))[:windows]
    start = np.flatnonzero(np.arange(length, length + windows) <= offs[1:][row])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchor, row = anchor[start], row[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    return tuple(x.astype(np.int64) for x in (row[first], anchor[first], start[first], start[last]))


#: ``at`` packs a region's place in its text: first window start, windows less one, distance from there to the anchor.
_MARK = {"k1": "long", "k2": "long", "print": "long", "r1": "long", "r2": "long", "at": "long"}


def _lo(at: str = "at") -> Column:
    return F.shiftright(at, 32)


def _span(at: str = "at") -> Column:
    return F.shiftright(at, 16).bitwiseAND(F.lit(0xFFFF))


def anchors(rows: DataFrame, length: int) -> DataFrame:
    """A mark ``(k1, k2, print, r1, r2, at)`` for each anchor of the rows ``(k1, k2, text)``; (r1, r2) digests the region."""
    import xxhash

    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", BLOCK_BYTES):
            data, offs = bytes_of(text_array(t["text"]))
            if len(data) >= 2 * BLOCK_BYTES:  # one very long text: in overlapping blocks, each with its own windows
                blocks = [(a, min(len(data), a + BLOCK_BYTES + length - 1)) for a in range(0, max(1, len(data) - length + 1), BLOCK_BYTES)]
            else:
                blocks = [(0, len(data))]
            k1, k2 = np.asarray(t["k1"]), np.asarray(t["k2"])
            for a, b in blocks:
                part = data[a:b]
                r, anchor, lo, hi = find_anchors(part, np.clip(offs, a, b) - a, length)
                raw = memoryview(np.ascontiguousarray(part))
                prints = np.fromiter((xxhash.xxh3_64_intdigest(raw[x : x + half]) for x in anchor.tolist()), np.uint64, len(r))
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist())]), np.int64).reshape(-1, 2)
                at = (lo + a - offs[r]) << 32 | (hi - lo) << 16 | (anchor - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (k1[r], k2[r], prints.view(np.int64), digests[:, 0], digests[:, 1], at)], [*_MARK])

    return rows.mapInArrow(tidy(run), ", ".join(f"{n} {t}" for n, t in _MARK.items()))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of up to ``PLACES`` symbols of which the last differs from all others.

    Larsson and Sadakane: sort by a few symbols, then refine only groups that are still tied, by the rank of
    the suffix as far ahead as the order is known, doubling it each time. Keys are packed with the place into
    one 64-bit number, so that a plain sort does.
    """
    n = len(symbols)
    if n > PLACES:
        raise ValueError("too many symbols for one shard")
    bits = max(1, int(symbols.max()).bit_length()) if n else 1
    known = max(1, min(4, 43 // bits))
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(known, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(known):
        key = key << np.uint64(bits) | padded[i : i + n]
    key = np.sort(key << np.uint64(21) | np.arange(n, dtype=np.uint64))
    order = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
    key >>= np.uint64(21)
    head = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group is named by its first place
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(tied):
        suffix = order[tied]
        ahead = suffix + known
        beyond = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
        key = np.sort(rank[suffix].astype(np.uint64) << np.uint64(43) | beyond << np.uint64(21) | suffix.astype(np.uint64))
        suffix = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        order[tied] = suffix  # groups keep their places, as tied is in order of place
        key >>= np.uint64(21)
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = tied[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        tied = tied[~(head & np.append(head[1:], True))]
        known *= 2
    return order, rank


def common_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix (by place) with the one before it in order.

    Each region is one run of the algorithm, and all go in step: a round either extends the match by one
    symbol or notes it and moves to the next place with one symbol less.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    at, h, stop = starts.copy(), np.zeros(len(starts), np.int64), ends
    live = at < stop
    at, h, stop = at[live], h[live], stop[live]
    while len(at):
        r = rank[at]
        before = order[np.maximum(r - 1, 0)]
        x, y = at + h, before + h
        same = (r > 0) & (x < n) & (y < n)
        same &= symbols[np.minimum(x, n - 1)] == symbols[np.minimum(y, n - 1)]
        done = ~same
        out[at[done]] = h[done]
        h = np.where(same, h + 1, np.maximum(h - 1, 0))
        at = np.where(same, at, at + 1)
        live = at < stop
        if not live.all():
            at, h, stop = at[live], h[live], stop[live]
    return out


def repeated_windows(regions: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which window starts of distinct regions repeat: a flag for each byte of the regions joined, and their starts there.

    Each region is closed by a symbol of its own, so no match leaves it.
    """
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(int(sizes.sum()) + len(regions), np.int64)
    symbols[starts + sizes] = np.arange(len(regions))
    inside = np.ones(len(symbols), np.bool_)
    inside[starts + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.int64) + len(regions)
    order, rank = suffix_array(symbols)
    lcp = common_prefixes(symbols, order, rank, starts, starts + sizes)
    by_rank = lcp[order]
    best = np.maximum(by_rank, np.append(by_rank[1:], 0))
    flags = np.empty(len(symbols), np.bool_)
    flags[order] = best >= length
    return flags, starts


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [*zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())]


_RANGES = "k1 long, k2 long, lo long, hi long"
#: Regions on their way to a shard: ``group`` of possible partners, ``lo`` first window start, ``raw`` bytes.
_DEALT = ("group", "k1", "k2", "lo", "single", "raw")


def shard_ranges(regions: DataFrame, length: int) -> DataFrame:
    """``(k1, k2, lo, hi)``: repeated window starts of the regions ``(shard, group, k1, k2, lo, single, raw)`` marked as single."""

    def run(key, t):
        t = t.sort_by([("k1", "ascending"), ("k2", "ascending"), ("lo", "ascending")])
        k1, k2, lo, single = (t[n].to_pylist() for n in ("k1", "k2", "lo", "single"))
        texts, groups, out = t["raw"].to_pylist(), t["group"].to_pylist(), []
        del t
        # whole groups together, as many as fit one suffix array
        by: dict[bytes, list[int]] = {}
        for i, g in enumerate(groups):
            by.setdefault(g, []).append(i)
        parts, size = [[]], 0
        for members in by.values():
            n = sum(len(texts[i]) + 1 for i in members)
            if parts[-1] and size + n > PLACES:
                parts.append([])
                size = 0
            parts[-1] += members
            size += n
        for part in parts:
            if part:
                flags, starts = repeated_windows([texts[i] for i in part], length)
                for i, s in zip(part, starts.tolist()):
                    if single[i]:
                        out += [(k1[i], k2[i], lo[i] + a, lo[i] + b) for a, b in runs(flags[s : s + len(texts[i])])]
                del flags
        release()
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("k1", "k2", "lo", "hi"))})

    return regions.groupBy("shard").applyInArrow(run, _RANGES)


def region_bytes(regions: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``(group, m, k1, k2, single, place, e0, e1, raw)`` of the regions ``(print, k1, k2, at, single, m)``: their bytes, from the texts.

    ``place`` is where the anchor is in the text, ``e0`` and ``e1`` the least and greatest distance of a window start
    before it. A row of ``texts`` that repeats another counts once.
    """
    asked = regions.groupBy("k1", "k2").agg(F.collect_list(F.struct("print", "at", "single", "m")).alias("asked"))  # of one text
    own = texts.join(asked.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    fields = {"group": pa.binary(), "m": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "single": pa.bool_(), "place": pa.int64(), "e0": pa.int32(), "e1": pa.int32(), "raw": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, texts = np.asarray(b.column(0)), np.asarray(b.column(1)), text_array(b.column(2))
            for i in range(b.num_rows):
                raw, asked = memoryview(texts[i].as_buffer()), b.column(3)[i].values
                prints, at = (np.asarray(asked.field(n)) for n in ("print", "at"))
                lo, span, ahead = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
                n = len(at)
                pieces = [bytes(raw[x:y]) for x, y in zip(lo.tolist(), (lo + span + length).tolist())]
                cols = ([p.tobytes() for p in prints], asked.field("m"), np.full(n, k1[i]), np.full(n, k2[i]), asked.field("single"), lo + ahead, (ahead - span).astype(np.int32), ahead.astype(np.int32), pieces)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(cols, fields.values())], [*fields])

    both = own.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked")
    return both.mapInArrow(tidy(run), "group binary, m long, k1 long, k2 long, single boolean, place long, e0 int, e1 int, raw binary")


def halve(rows: DataFrame, length: int) -> DataFrame:
    """Both halves of the rows' intervals of window starts, as far as a row has windows there, with digests of core and hull.

    Rows are ``(group, d0, d1, k1, k2, single, place, e0, e1, raw)``: ``d0`` to ``d1`` are the group's distances from
    window start to anchor, ``e0`` to ``e1`` the row's own, whose windows cover ``raw``.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d0, d1, e0, e1 = (np.asarray(b.column(b.schema.get_field_index(n))).astype(np.int64) for n in ("d0", "d1", "e0", "e1"))
            middle = (d0 + d1) // 2
            which, lo, hi = np.tile(np.arange(len(d0)), 2), np.concatenate([d0, middle + 1]), np.concatenate([middle, d1])
            f0, f1 = np.maximum(np.tile(e0, 2), lo), np.minimum(np.tile(e1, 2), hi)
            real = np.flatnonzero((f0 <= f1) & (lo <= hi))
            which, lo, hi, f0, f1 = (x[real] for x in (which, lo, hi, f0, f1))
            texts = b.column(b.schema.get_field_index("raw")).to_pylist()
            core, hull, raw = [], [], []
            for w, x, y, p, q, top in zip(which.tolist(), lo.tolist(), hi.tolist(), f0.tolist(), f1.tolist(), e1[which].tolist()):
                one = texts[w]  # begins ``top`` before the anchor
                core.append(b"%d,%d," % (x, y) + xxhash.xxh3_128_digest(one[top - x : top - y + length]))
                raw.append(one[top - q : top - p + length])
                hull.append(b"%d,%d," % (p, q) + xxhash.xxh3_128_digest(raw[-1]))
            same = b.take(pa.array(which))
            cols = {n: same.column(same.schema.get_field_index(n)) for n in ("k1", "k2", "single", "place")}
            cols |= {"group": pa.array(core, pa.binary()), "hull": pa.array(hull, pa.binary()), "raw": pa.array(raw, pa.binary())}
            cols |= {n: pa.array(x.astype(np.int32)) for n, x in (("d0", lo), ("d1", hi), ("e0", f0), ("e1", f1))}
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(tidy(run), "k1 long, k2 long, single boolean, place long, group binary, hull binary, raw binary, d0 int, d1 int, e0 int, e1 int")


def search_groups(rows: DataFrame, length: int, fit: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Binary search over the window starts of groups that no shard takes.

    Gives the ranges found, and the regions of groups that shards take now. A group is named by its interval and core.
    """
    found, dealt, step = [], [], 0
    now = rows.withColumns({"d0": F.lit(0), "d1": F.lit(length // 2 - 1)})
    while True:
        halves = scratch.table(halve(now, length), f"halves{step}")
        own = F.struct("k1", "k2", "place")
        hulls = halves.groupBy("group", "hull").agg(F.count("*").alias("n"), F.min(own).alias("own"), F.bool_or("single").alias("single"))
        hulls = scratch.table(hulls, f"hulls{step}")
        repeated = hulls.where("n > 1").select("group", "hull", "n")
        lo = F.col("place") - F.col("e1")
        ends = [lo.alias("lo"), (F.col("place") - F.col("e0")).alias("hi")]
        found.append(scratch.table(spread_join(halves.where("single"), repeated, ["group", "hull"], halves.count(), "left_semi").select("k1", "k2", *ends), f"found{step}"))
        # windows are in question where a single hull that is none's copy meets others around its core
        alone = (F.col("n") == 1) & F.col("single")
        groups = hulls.groupBy("group").agg(F.count("*").alias("m"), F.count_if(alone).alias("open")).where("m > 1 AND open > 0").select("group", "m")
        left = hulls.join(groups, "group").select("group", "hull", "own", "n", "m")
        rest = scratch.table(halves.join(left, ["group", "hull"]).where(own == F.col("own")).withColumn("single", F.col("single") & (F.col("n") == 1)).drop("own", "n", "hull"), f"rest{step}")
        dealt.append(rest.where(F.col("m") <= fit).withColumn("lo", lo).select(*_DEALT))
        now = rest.where(F.col("m") > fit).drop("m")
        scratch.drop(f"halves{step}", f"hulls{step}")
        step += 1
        if now.isEmpty():
            return found, dealt


def repeated_ranges(docs: DataFrame, length: int, scratch: Scratch, shard_regions: int | None = None) -> DataFrame:
    """``(k1, k2, lo, hi)``: first and last starts of runs of repeated windows in the rows ``(k1, k2, text)``."""
    if not 2 <= length <= 1 << 16:
        raise ValueError("passages have 2 to 65536 bytes")
    shard_regions = max(4, min(shard_regions or SHARD_REGIONS, PLACES // (length + length // 2 + 1)))
    region = ["print", "r1", "r2"]
    ends = [_lo().alias("lo"), (_lo() + _span()).alias("hi")]
    marks = scratch.table(anchors(docs, length), "marks")
    same = (F.min("r1") == F.max("r1")) & (F.min("r2") == F.max("r2"))
    prints = scratch.table(marks.groupBy("print").agg(F.count("*").alias("n"), same.alias("same")).where("n > 1"), "prints")
    met = scratch.table(spread_join(marks, prints, ["print"], marks.count()), "met")
    scratch.drop("marks", "prints")
    ranges = [met.where("same").select("k1", "k2", *ends)]
    mixed = met.where("NOT same").drop("same")
    # one copy of each region: all its columns come from one row
    distinct = scratch.table(mixed.groupBy(*region).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "at"))), "regions")
    ranges.append(spread_join(mixed, distinct.where("n > 1").select(*region, "n"), region, met.count(), "left_semi").select("k1", "k2", *ends))
    several = distinct.groupBy("print").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("least = 1").select("print", "m")
    open_ = distinct.join(several, "print").select("print", "k1", "k2", "at", (F.col("n") == 1).alias("single"), "m")
    full = scratch.table(region_bytes(open_, docs, length), "bytes")
    fit = shard_regions // 4  # shards are dealt by hash
    lo = (F.col("place") - F.col("e1")).alias("lo")
    dealt = [full.where(F.col("m") <= fit).withColumn("lo", lo).select(*_DEALT)]
    wide = full.where(F.col("m") > fit)
    if not wide.isEmpty():
        found, more = search_groups(wide.drop("group", "m"), length, fit, scratch)
        ranges += found
        dealt += more
    every = dealt[0]
    for df in dealt[1:]:
        every = every.unionByName(df)
    shards = partitions(every.count() * 2, shard_regions)
    every = every.withColumn("shard", F.pmod(F.xxhash64("group"), F.lit(shards)))
    out = scratch.table(shard_ranges(every.select("shard", *_DEALT), length), "sorted")
    scratch.drop("bytes", *(f"rest{i}" for i in range(length.bit_length() + 1)))
    for df in ranges:
        out = out.unionByName(df)
    return out


def word_ranges(rows: DataFrame, words: int, length: int, scratch: Scratch) -> DataFrame:
    """``(k1, k2, lo, hi)`` of runs of ``words`` words below ``length`` bytes that also stand elsewhere, byte by byte.

    Longer runs hold a window of ``length`` bytes. ``hi`` is ``length`` before the end, as with windows.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", BLOCK_BYTES):
            data, offs = bytes_of(text_array(t["text"]))
            starts, ends, first = word_spans(data, offs)
            n = max(0, len(starts) - words + 1)
            row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            at = np.flatnonzero((row[:n] == row[words - 1 :]) & (ends[words - 1 :] - starts[:n] < length)) if n else np.zeros(0, np.int64)
            lo, hi, r = starts[at], ends[at + words - 1], row[at] if n else at
            raw = data.tobytes()
            keys = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
            k1, k2 = np.asarray(t["k1"]), np.asarray(t["k2"])
            cols = [pa.array(keys, pa.binary()), *(pa.array(x) for x in (k1[r], k2[r], lo - offs[r], hi - offs[r] - length))]
            yield pa.RecordBatch.from_arrays(cols, ["run", "k1", "k2", "lo", "hi"])

    marks = scratch.table(rows.mapInArrow(tidy(run), "run binary, k1 long, k2 long, lo long, hi long"), "words")
    repeated = scratch.table(marks.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"), "runs")
    return spread_join(marks, repeated, ["run"], marks.count(), "left_semi").select("k1", "k2", "lo", "hi")


def cover(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte runs that windows starting in the ranges cover, merged."""
    out: list[list[int]] = []
    for a, b in sorted((r["lo"], r["hi"] + length) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def on_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, length: int = LENGTH, doc: str = "doc_id", text: str = "text", shard_regions: int | None = None, words: int | None = None, out: str = "_ranges") -> DataFrame:
    """``docs`` with a further column ``out``: window starts (array of lo, hi; null for none) that repeat.

    With ``words``, runs of so many words below ``length`` bytes repeat too.

    A text's own repeats count, overlapping ones too. Rows that are equal in id and text repeat each other.
    Null texts are empty; texts shorter than ``length`` bytes have no window; a null id is an id like others.
    ``out`` must not be a column of ``docs``; other names don't matter.
    """
    k1, k2 = unused("_k1", docs.columns), unused("_k2", docs.columns)
    small_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumns({k1: F.xxhash64(F.col(doc), F.col(doc).isNull(), whole), k2: F.xxhash64(F.lit(1), whole, F.col(doc))})
    rows, scratch = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), whole.alias("text")), Scratch(docs.sparkSession, "suffix")
    ranges = repeated_ranges(rows.where(F.octet_length("text") >= length), length, scratch, shard_regions)
    if words:
        ranges = ranges.unionByName(word_ranges(rows.where(F.octet_length("text") >= 2 * words - 1), words, length, scratch))
    each = ranges.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias(out))  # of one text
    return keyed.join(each.select(F.col("k1").alias(k1), F.col("k2").alias(k2), out), [k1, k2], "left").select(*(keyed[c] for c in docs.columns), out)


def removal_digests(docs: DataFrame, length: int = LENGTH, shard_regions: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text)``, one row per input row.

    ``kept_text`` is what remains; U+FFFD stands where a removed run cuts a character, of which the digest has
    the bytes as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, r in zip(text_array(b.column(1)).to_pylist(), b.column(2).to_pylist()):
                raw, spans = t.encode(), cover(r or [], length)
                kept = remove(raw, spans)
                out.append((len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
            cols = [*zip(*out)] if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    found = with_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")), length, shard_regions=shard_regions)
    return found.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def cleaned(docs: DataFrame, length: int = LENGTH, text: str = "text", words: int | None = None) -> DataFrame:
    """``docs`` with repeated passages taken out of the text; characters that a removed run cuts stay whole.

    A passage has ``length`` bytes, or is a run of ``words`` words where these come to less.
    """

    @F.pandas_udf("string")
    def strip(texts, ranges):
        def one(t, r):
            raw = t.encode()
            return remove(raw, on_characters(raw, cover([{"lo": x["lo"], "hi": x["hi"]} for x in r], length))).decode()

        return type(texts)([t if t is None or r is None else one(t, r) for t, r in zip(texts, ranges)])

    ranges = unused("_ranges", docs.columns)
    found = with_spans(docs, length, text=text, words=words, out=ranges)
    return found.withColumn(text, F.when(F.col(ranges).isNull(), F.col(text)).otherwise(strip(F.col(text), F.col(ranges)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
