"""Exact set-similarity self-join by rare-first prefix filtering.

Sets are known by a 64-bit id; their elements are 48-bit hashes in a global order, rare
first (a counting sketch over the whole corpus, then the hash).  Two sets of Jaccard
similarity num/den or more share an element among the first ``n - ceil(n * num / den) + 1``
of both.  So each set posts its prefix; postings meet by element, sorted, and pass the
length filter, the positional filter and a suffix filter (parity bitmaps bound the
symmetric difference from below).  What passes is verified once per pair on whole sets.

Postings travel in blobs: each map task packs its own by bucket of elements, so Spark moves
and sorts a row per blob and numpy sorts a bucket.  A bucket is small, as no element in it is
frequent: those that the sketch shows to occur more than ``HOT`` times are rows of their own,
sorted by Spark and read as a stream.  Each posting looks back over at most ``REACH``
others of its run and yields the first of the run, if it passes, and then its nearest
passing predecessors, ``nearest`` in all.  In a bucket, runs are sorted by set size
whatever their order is, as sets of unlike sizes need not meet, and the passing predecessors
nearest in size are yielded.  Where that leaves something open (more might pass, or the run is longer), the run's postings are kept, so
that the caller can settle, by a join, just what these pairs left open.  No task holds a
whole run of a frequent element and no group is expanded into all its pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm import kernel
from ferngraph.session import ship, written

SKETCH = 1 << 20
BLOCKS = 64
REACH = 1024
#: A filter of ids has at most so many bits; with more ids it lets more pass, which costs time only.
FILTER_BITS = 1 << 28
#: A bucket has about so many postings; elements that occur more often than HOT have rows of their own.
BUCKET = HOT = 1 << 15
#: Postings meet so many others of like size before it is asked who needs more, so many pairs at once.
NEAR, STEP = 64, 1 << 18
#: So many postings are packed at once.
FLUSH = 1 << 18
RECORD = np.dtype([("key", "<i8"), ("set", "<i8"), ("ord", "<i8"), ("bits", "<i8"), ("n", "<i4"), ("pos", "<i4")])
PACKED = "bucket int, key long, ord long, data binary"
PAIRS = "a long, b long, open boolean, key long, set long, ord long, n int, pos int, bits long"


# --- rarity -----------------------------------------------------------------------


def block_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Counters as BLOCKS rows."""
    return list(range(BLOCKS)), [zlib.compress(p.tobytes(), 1) for p in counts.astype(np.uint64).reshape(BLOCKS, -1)]


class Sketch:
    """A task's counters of elements."""

    def __init__(self):
        self.counts, self.todo = np.zeros(SKETCH, np.int64), []

    def add(self, values: np.ndarray) -> None:
        self.todo.append(cells(values))
        if sum(map(len, self.todo)) > SKETCH:
            self._settle()

    def _settle(self) -> None:
        if self.todo:
            self.counts += np.bincount(np.concatenate(self.todo), minlength=SKETCH)
            self.todo = []

    def rows(self) -> tuple[list[int], list[bytes]]:
        """The counters as BLOCKS rows; none, if all are 0."""
        self._settle()
        return block_rows(self.counts) if self.counts.any() else ([], [])


def _sum_blocks(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint64) for x in t["counts"])
    return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counters (block, counts).  It takes two steps, so that no task
    gets them all; ``size`` is fixed, whatever the input."""
    first = rows.withColumn("part", F.pmod(F.hash("counts"), F.lit(512))).groupBy("block", "part").applyInArrow(_sum_blocks, "block int, counts binary")
    out = np.zeros((BLOCKS, size // BLOCKS), np.uint64)
    for r in first.groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return out.ravel()


class Rarity:
    """``rank`` (small: rare) of each sketch cell, and into how many buckets postings go."""

    def __init__(self, counts: np.ndarray, num: int, den: int):
        self.rank = np.floor(np.log2(counts + 1.0) * 64).astype(np.uint16)
        self.hot = int(np.log2(HOT + 1.0) * 64)
        self.buckets = max(1, min(1 << 30, int(counts.sum()) * (den - num) // (den * BUCKET)))


def rarity(rows: DataFrame, num: int, den: int) -> Rarity:
    return Rarity(summed(rows, SKETCH), num, den)


class Seen:
    """Which ids a task has met lately (with the least order so far), in fixed memory."""

    SLOTS = 1 << 18

    def __init__(self):
        self.ids, self.order, self.used = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, bool)

    def fresh(self, ids: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Flags of those of the rows ``at`` whose id is new, or comes earlier than before."""
        out = np.zeros(len(ids), bool)
        if not len(at):
            return out
        i, o = ids[at], order[at]
        by = np.lexsort((o, i))
        first = by[np.concatenate(([True], i[by][1:] != i[by][:-1]))]
        slot = i[first] & (self.SLOTS - 1)
        new = ~(self.used[slot] & (self.ids[slot] == i[first]) & (self.order[slot] <= o[first]))
        first, slot = first[new], slot[new]
        self.ids[slot], self.order[slot], self.used[slot] = i[first], o[first], True
        out[at[first]] = True
        return out


def cells(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(SKETCH - 1)).astype(np.int64)


# --- postings ---------------------------------------------------------------------


def rare_first(values: np.ndarray, rows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the elements of each row stand in the global order, rare first."""
    return np.argsort((rows.astype(np.uint64) << np.uint64(48)) | (rank[cells(values)].astype(np.uint64) << np.uint64(34)) | (values >> np.uint64(14)))


def prefix_sizes(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return size - (-(-size * num // den)) + 1


def prefixes(values: np.ndarray, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, rarity: Rarity, num: int, den: int) -> np.ndarray:
    """Prefix postings, as RECORD, of distinct sets (at most 65536 rows, ascending; rows
    without elements have none) with ``ids`` and ``order`` of the rows."""
    if not len(values):
        return np.empty(0, RECORD)
    size = np.bincount(rows, minlength=len(ids))
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.flatnonzero(size)
    bits = np.zeros(len(ids), np.uint64)
    bits[at] = np.bitwise_xor.reduceat(np.uint64(1) << (values >> np.uint64(42)), begin[at])
    pos = np.arange(len(values)) - begin[rows]
    keep = pos < prefix_sizes(size, num, den)[rows]
    row = rows[keep]
    out = np.empty(len(row), RECORD)
    out["key"] = values[rare_first(values, rows, rarity.rank)][keep].view(np.int64)
    out["set"], out["ord"], out["bits"], out["n"], out["pos"] = ids[row], order[row], bits[row].view(np.int64), size[row], pos[keep]
    return out


def packed(parts, rarity: Rarity):
    """Batches as PACKED of postings that come in ``parts``."""
    got: list[np.ndarray] = []
    for part in parts:
        got.append(part)
        if sum(map(len, got)) >= FLUSH:
            yield _pack(np.concatenate(got), rarity)
            got = []
    if got:
        yield _pack(np.concatenate(got), rarity)


def _pack(p: np.ndarray, rarity: Rarity) -> pa.RecordBatch:
    """Buckets follow the keys.  Those of frequent elements are negative, a row for each posting."""
    key = p["key"].view(np.uint64) if p["key"].flags.c_contiguous else np.ascontiguousarray(p["key"]).view(np.uint64)
    hot = rarity.rank[cells(key)] >= rarity.hot
    bucket = np.where(hot, (key >> np.uint64(32)).astype(np.int64) - 65536, ((key >> np.uint64(16)) * np.uint64(rarity.buckets) >> np.uint64(32)).astype(np.int64))
    order = np.argsort(bucket.astype(np.uint16) if len(p) and bucket.min() >= 0 and bucket.max() < 1 << 16 else bucket, kind="stable")
    p, bucket = p[order], bucket[order]
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])) | (bucket < 0)) if len(p) else np.empty(0, np.int64)
    offsets = np.append(begin, len(p)) * RECORD.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(p))])
    alone = bucket[begin] < 0
    columns = [pa.array(bucket[begin].astype(np.int32)), *[pa.array(np.where(alone, p[x][begin], 0)) for x in ("key", "ord")], data]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "ord", "data"])


def passes(p: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of postings (i, j) of one key pass all filters: indices into i."""
    na, nb = p["n"][i], p["n"][j]
    at = np.flatnonzero((np.minimum(na, nb).astype(np.int64) * den >= num * np.maximum(na, nb).astype(np.int64)) & (p["set"][i] != p["set"][j]))
    i, j, both = i[at], j[at], na[at].astype(np.int64) + nb[at]
    least = -(-num * both // (num + den))
    near = np.minimum(na[at] - p["pos"][i], nb[at] - p["pos"][j]) >= least
    at, i, j, room = at[near], i[near], j[near], (both - 2 * least)[near]
    return at[np.bitwise_count((p["bits"][i] ^ p["bits"][j]).view(np.uint64)) <= room]


NAMES = ("key", "set", "ord", "n", "pos", "bits")


def _batch(a: np.ndarray, b: np.ndarray, posts: dict, is_open: np.ndarray) -> pa.RecordBatch:
    k, m = len(a), len(is_open)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    pair = [pa.array(a), pa.array(b), pa.nulls(k, pa.bool_()), *[pa.nulls(k, t) for t in types]]
    post = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(is_open), *[pa.array(posts[x], t) for x, t in zip(NAMES, types, strict=True)]]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(pair, post, strict=True)], ["a", "b", "open", *NAMES])


def _look_back(p: dict, old: int, is_long: bool, nearest: int, num: int, den: int, by_size: bool, reach: int) -> pa.RecordBatch:
    """Pairs of sorted postings.  The first ``old`` ones are there to be looked back at only;
    ``is_long``: the (only) run goes on before or after these postings.  ``by_size``: their
    order is that of set sizes, so all before one that is too small are too small."""
    n, name = len(p["key"]), p["set" if by_size else "ord"]
    begin = np.flatnonzero(np.concatenate(([True], p["key"][1:] != p["key"][:-1])))
    length = np.diff(np.append(begin, n))
    place = np.arange(n) - np.repeat(begin, length)
    got = np.zeros(n, np.int32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.flatnonzero((np.arange(n) >= old) & (place > 0))
    # the head of the run first: copies of one text then make a star, not a chain
    head = np.repeat(begin, length)
    hit = live[passes(p, head[live], live, num, den)]
    got[hit] += 1
    found.append((name[head[hit]], name[hit]))
    live = live[place[live] > 1]
    for d in range(1, min(int(length.max(initial=1)), reach + 1)):
        live = live[(place[live] > d) & (got[live] < nearest)]
        if by_size:
            live = live[p["n"][live - d].astype(np.int64) * den >= num * p["n"][live].astype(np.int64)]
        if not len(live):
            break
        hit = live[passes(p, live - d, live, num, den)]
        got[hit] += 1
        found.append((name[hit - d], name[hit]))
    none = np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
    far = np.zeros(n, bool)
    far[live if by_size else slice(None)] = True
    is_open = (got >= nearest) & (place >= nearest) | (place > reach) & far | (is_long and old > 0)
    run = np.repeat(np.arange(len(begin)), length)
    kept = np.bincount(run, is_open, minlength=len(begin)) > 0
    keep = (kept[run] | is_long) & (np.arange(n) >= old)
    return _batch(a, b, {x: p[x][keep] for x in NAMES}, is_open[keep])


def _meet(p: dict, most: np.ndarray, j: np.ndarray, first: np.ndarray, last: np.ndarray, some: np.ndarray):
    """Pairs (i, j) of postings that pass, i among the ``some`` from first[j] on and before last[j]."""
    own, upto = np.flatnonzero(some), np.append(0, np.cumsum(some))
    first, count = upto[first[j]], upto[last[j]] - upto[first[j]]
    j, first, count = j[count > 0], first[count > 0], count[count > 0]
    ends = np.append(0, np.cumsum(count))
    x, found = 0, [(np.empty(0, np.int64),) * 2]
    while x < len(j):
        y = max(x + 1, int(np.searchsorted(ends, ends[x] + STEP, "right")) - 1)
        c = count[x:y]
        left = own[np.arange(ends[y] - ends[x]) + np.repeat(first[x:y] - (ends[x:y] - ends[x]), c)]
        right = np.repeat(j[x:y], c)
        near = np.flatnonzero(p["n"][right] <= most[left])
        left, right = left[near], right[near]
        ok = passes(p, left, right, *p["how"])
        found.append((left[ok], right[ok]))
        x = y
    return (np.concatenate(k) for k in zip(*found, strict=True))


def _look_around(p: dict, nearest: int, num: int, den: int, reach: int) -> pa.RecordBatch:
    """Pairs (earlier, later) of whole runs of sorted postings.  They are sorted by size, and only
    those meet that sizes and positions let pass; those nearest in size come first, and further
    ones, over ``reach`` places at most, for what these haven't given enough."""
    n, at = len(p["key"]), np.arange(len(p["key"]))
    begin = np.flatnonzero(np.concatenate(([True], p["key"][1:] != p["key"][:-1])))
    length = np.diff(np.append(begin, n))
    run = np.repeat(np.arange(len(begin)), length)
    by = np.argsort(run << 32 | p["n"], kind="stable")
    rank = (at - begin[run])[by]
    p = {x: v[by] for x, v in p.items()}
    size = p["n"].astype(np.int64)
    # the sizes of sets that may be alike and meet at these positions
    least, most = -(-num * size // den), (size - p["pos"]) * (num + den) // num - size
    key = run << 32 | size
    low = np.searchsorted(key, run << 32 | least)
    up = np.maximum(low, np.minimum(at, np.searchsorted(key, run << 32 | np.minimum(most, (1 << 31) - 1), "right")))
    near = np.maximum(low, up - NEAR)
    far = np.minimum(near, np.maximum(low, up - reach))
    p, smaller = {**p, "how": (num, den)}, most >= size

    def counted(i, j):
        later = np.where(rank[i] < rank[j], j, i)
        return i + j - later, later, np.bincount(later, minlength=n)

    i, j = _meet(p, most, at, near, up, smaller)
    got = counted(i, j)[2]
    undone, more = got < np.minimum(rank, nearest), near > far
    skipped = more & ~undone
    rest = [_meet(p, most, at[more & undone], far, near, smaller), _meet(p, most, at[skipped], far, near, smaller & undone)]
    i, j = (np.concatenate(x) for x in zip((i, j), *rest, strict=True))
    early, late, got = counted(i, j)
    by = np.lexsort((np.abs(late - early), late))
    early, late = early[by], late[by]
    few = np.arange(len(late)) - np.searchsorted(late, late) < nearest
    # open: more have passed; enough had, so that some weren't tried; some are out of reach
    is_open = got > nearest
    if (near > low).any():
        is_open |= ~undone & (rank > got)
        out = at[far > low]
        edge = np.bincount(low[out], minlength=n) - np.bincount(far[out], minlength=n)
        is_open |= (far > low) | (np.cumsum(edge) > 0)
    is_open &= rank > 0
    # only sets of like size can be what an open one lacks
    end = np.searchsorted(key, (run << 32 | np.minimum(most, (1 << 31) - 1))[is_open], "right")
    edge = np.bincount(low[is_open], minlength=n + 1) - np.bincount(np.maximum(low[is_open], end), minlength=n + 1)
    keep = is_open | (np.cumsum(edge[:-1]) > 0)
    return _batch(p["ord"][early[few]], p["ord"][late[few]], {x: p[x][keep] for x in NAMES}, is_open[keep])


def _once(p: dict) -> dict:
    """Sorted postings without those whose (key, set) came before."""
    _, at = np.unique(kernel.mix(p["key"].view(np.uint64)) ^ p["set"].view(np.uint64), return_index=True)
    return p if len(at) == len(p["key"]) else {x: v[np.sort(at)] for x, v in p.items()}


class _Buckets:
    """Whole buckets of records, sorted by bucket, several small ones at a time."""

    def __init__(self, *how):
        self.bucket, self.records = np.empty(0, np.int32), np.empty(0, RECORD)
        self.how = how

    def _pairs(self, r: np.ndarray) -> pa.RecordBatch:
        nearest, num, den, by_size, reach = self.how
        r = r[np.lexsort((r["ord"], r["key"]))]
        p = _once({x: np.ascontiguousarray(r[x]) for x in NAMES})
        return _look_back(p, 0, False, *self.how) if by_size else _look_around(p, nearest, num, den, reach)

    def more(self, bucket: np.ndarray, records: np.ndarray):
        bucket, records = np.concatenate((self.bucket, bucket)), np.concatenate((self.records, records))
        begin = 0
        for end in (np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist():
            if end - begin >= BUCKET or bucket[end] == bucket[-1]:
                yield self._pairs(records[begin:end])
                begin = end
        self.bucket, self.records = bucket[begin:], records[begin:]

    def end(self):
        if len(self.records):
            yield self._pairs(self.records)


class _Stream:
    """Runs of frequent elements, sorted by (key, ord)."""

    def __init__(self, *how):
        # What is held over: the last run so far, or, of a long one, its head and last postings.
        self.held, self.old, self.is_long = None, 0, False
        self.how, self.reach = how, how[-1]

    def more(self, p: dict):
        if self.held is not None:
            p = {x: np.concatenate((self.held[x], p[x])) for x in NAMES}
        if not len(p["key"]):
            return
        last = int(np.searchsorted(p["key"], p["key"][-1]))
        if last and self.is_long:
            first = int(np.searchsorted(p["key"], p["key"][0], "right"))
            yield _look_back({x: p[x][:first] for x in NAMES}, self.old, True, *self.how)
            p = {x: p[x][first:] for x in NAMES}
            last, self.old, self.is_long = last - first, 0, False
        if last:
            yield _look_back({x: p[x][:last] for x in NAMES}, 0, False, *self.how)
            p = {x: p[x][last:] for x in NAMES}
        if len(p["key"]) - self.old > self.reach:
            yield _look_back(p, self.old, True, *self.how)
            p = {x: np.concatenate((p[x][:1], p[x][1 - self.reach :])) for x in NAMES}
            self.old, self.is_long = len(p["key"]), True
        self.held = p

    def end(self):
        if self.held is not None and len(self.held["key"]) > self.old:
            yield _look_back(self.held, self.old, self.is_long, *self.how)


def _runs(*how):
    def run(batches):
        stream, buckets = _Stream(*how), _Buckets(*how)
        for b in batches:
            records, bounds = kernel.buffers(b.column(1))
            records = records.view(RECORD)
            bucket = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(bounds) // RECORD.itemsize)
            n = int(np.searchsorted(bucket, 0))
            if n:
                yield from stream.more(_once({x: np.ascontiguousarray(records[x][:n]) for x in NAMES}))
            if n < len(bucket):
                yield from buckets.more(bucket[n:], records[n:])
        yield from stream.end()
        yield from buckets.end()

    return run


def candidates(postings: DataFrame, num: int, den: int, nearest: int, by_size: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) that pass, postings of the runs that leave something open).  ``postings``
    as PACKED; those of one (key, set) may repeat.  In a run, a stands before b by ord.  If
    ``by_size``, ord is the set's size and pairs are of sets; else each ord stands for one set
    and pairs are of ords, as a frequent element may name a set again at a later one.
    ``open``: a posting may have passing predecessors that aren't among the pairs."""
    ship(postings.sparkSession)
    sorted_ = postings.repartition("bucket").sortWithinPartitions("bucket", "key", "ord").select("bucket", "data")
    made = written(sorted_.mapInArrow(_runs(nearest, num, den, by_size, REACH), PAIRS), "pairs")
    return made.where("a is not null").select("a", "b").distinct(), made.where("key is not null").select("open", *NAMES)


def pass_filters(a: str, b: str, num: int, den: int):
    """The same filters as an expression on posting columns with prefixes ``a`` and ``b``."""
    least = f"((({a}_n + {b}_n) * {num} + {num + den - 1}) div {num + den})"
    return F.expr(
        f"least({a}_n, {b}_n) * {den} >= greatest({a}_n, {b}_n) * {num} AND least({a}_n - {a}_pos, {b}_n - {b}_pos) >= {least}"
        f" AND bit_count({a}_bits ^ {b}_bits) <= {a}_n + {b}_n - 2 * {least}"
    )


WIDE = 8


def wide_bits(values: np.ndarray, rows: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """WIDE columns of 64 parity bits of each row's set, for the suffix filter of larger sets."""
    size = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.flatnonzero(size)
    h = kernel.mix(values)
    word, bit = (h >> np.uint64(6)) & np.uint64(WIDE - 1), np.uint64(1) << (h & np.uint64(63))
    out = []
    for k in range(WIDE):
        bits = np.zeros(n_rows, np.uint64)
        if len(values):
            bits[at] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begin[at])
        out.append(bits.view(np.int64))
    return out


def pass_wide(a: str, b: str, num: int, den: int):
    """The suffix filter on WIDE columns w0, w1, ... of either side."""
    least = f"((({a}_n + {b}_n) * {num} + {num + den - 1}) div {num + den})"
    apart = " + ".join(f"bit_count({a}_w{k} ^ {b}_w{k})" for k in range(WIDE))
    return F.expr(f"{apart} <= {a}_n + {b}_n - 2 * {least}")


def side(postings: DataFrame, name: str) -> DataFrame:
    return postings.select("key", *[F.col(c).alias(f"{name}_{c}") for c in postings.columns if c != "key"])


# --- verification -----------------------------------------------------------------


class IdFilter:
    """A Bloom filter of set ids, at most FILTER_BITS large."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def places(ids: np.ndarray, size: int) -> list[np.ndarray]:
        u = kernel.mix(ids.view(np.uint64))
        return [((u >> np.uint64(s)) & np.uint64(size - 1)).astype(np.int64) for s in (0, 31)]

    def has(self, ids: np.ndarray) -> np.ndarray:
        a, b = self.places(ids, self.size)
        return (self.bits[a >> 3] >> (a & 7) & self.bits[b >> 3] >> (b & 7) & 1).astype(bool)


def id_filter(ids: DataFrame, column: str) -> IdFilter:
    """Built on the executors as blocks of bytes; the driver gets at most FILTER_BITS / 8 bytes,
    in one job, as a job for each partition would take its time from all the others."""
    n = ids.count()
    size = 1 << 16
    while size < min(16 * n, FILTER_BITS):
        size *= 2

    def places(batches):
        for b in batches:
            at = np.unique(np.concatenate(IdFilter.places(b.column(0).to_numpy(zero_copy_only=False), size)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 16).astype(np.int64)), pa.array((at & 65535).astype(np.int32))], ["block", "at"])

    def pack(t: pa.Table) -> pa.Table:
        own = np.zeros(65536, bool)
        own[t["at"].to_numpy()] = True
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    got = ids.select(column).mapInArrow(places, "block long, at int").distinct().groupBy("block").applyInArrow(pack, "block long, bits binary")
    bits = np.zeros(size >> 3, np.uint8)
    for r in got.collect():
        bits[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return IdFilter(bits, size)


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            sides = [kernel.buffers(b.column(c)) for c in ("x", "y")]
            ok = np.zeros(b.num_rows, bool)
            for i, j in kernel.chunks(sum(bounds for _, bounds in sides)):
                keys = []
                for data, bounds in sides:
                    values = data[bounds[i] : bounds[j]].view(np.uint64)
                    keys.append(np.repeat(np.arange(j - i, dtype=np.uint64) << kernel.BITS, np.diff(bounds[i : j + 1]) >> 3) | values)
                both = np.sort(np.concatenate(keys))
                common = np.bincount((both[1:][both[1:] == both[:-1]] >> kernel.BITS).astype(np.int64), minlength=j - i)
                size = sum(np.diff(bounds[i : j + 1]) >> 3 for _, bounds in sides)
                ok[i:j] = den * common >= num * (size - common)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


SETS = ", ".join(["set long", "n int", *(f"w{k} long" for k in range(WIDE)), "elements binary"])


def set_rows(values: np.ndarray, rows: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The sets of rows ``at`` (by id), with their wide bitmaps, as SETS."""
    size = np.bincount(rows, minlength=len(ids))
    end = np.cumsum(size)
    elements = pa.array([values[end[x] - size[x] : end[x]].tobytes() for x in at], pa.binary())
    wide = [pa.array(w[at]) for w in wide_bits(values, rows, len(ids))]
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(size[at].astype(np.int32)), *wide, elements], [c.split()[0] for c in SETS.split(", ")])


MAPS = "set long, n int, map binary"
ELEMENTS = "set long, elements binary"


def map_rows(values: np.ndarray, rows: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Parity bitmaps of the sets of rows ``at`` (others have no values here), as MAPS: 64 bits or
    more, at least one for each element, so that they tell large sets apart too."""
    size = np.bincount(rows, minlength=len(ids))
    bits = np.where(size > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)), 0)
    ends = np.append(0, np.cumsum(bits))
    places = ends[rows] + (kernel.mix(values) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(places, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    offsets = np.append(ends[at], ends[-1]) >> 3
    maps = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(size[at].astype(np.int32)), maps], ["set", "n", "map"])


def element_rows(values: np.ndarray, rows: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The sets of rows ``at`` (by id), as ELEMENTS."""
    end = np.cumsum(np.bincount(rows, minlength=len(ids)))
    begin = np.append(0, end[:-1])
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([values[begin[x] : end[x]].tobytes() for x in at], pa.binary())], ["set", "elements"])


def apart(u: np.ndarray, v: np.ndarray) -> int:
    """At least so many elements are in one only of the sets of two bitmaps; a larger one is folded."""
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _near(num: int, den: int):
    def run(batches):
        for b in batches:
            x, y = b.column("x"), b.column("y")
            both = b.column("both").to_numpy(zero_copy_only=False)
            room = both - 2 * -(-num * both // (num + den))
            ok = np.array([apart(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) <= room[i] for i in range(b.num_rows)], bool)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def likely(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps (as MAPS, each set once) leave it open that they are similar enough."""
    x, y = (maps.select(F.col("set").alias(s), F.col("n").alias(f"{s}_n"), F.col("map").alias(m)) for s, m in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("a_n").cast("long") + F.col("b_n")).alias("both"), "x", "y")
    return written(both.mapInArrow(_near(num, den), "a long, b long"), "likely")


def wanted(pairs: DataFrame, instances: DataFrame | None, row: str):
    """Broadcast filters of the sets of ``pairs`` (a, b), and of the rows that have them, where
    ``instances`` (set, ``row``) are given (else None)."""
    sc = pairs.sparkSession.sparkContext
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "wanted")
    own = sc.broadcast(id_filter(ids, "set"))
    if instances is None:
        return own, None
    rows = written(ids.join(instances, "set").select(row).distinct(), "rows")
    return own, sc.broadcast(id_filter(rows, row))


def once(sets: DataFrame) -> DataFrame:
    """Each set once, as a table."""
    return written(sets.groupBy("set").agg(*[F.first(c).alias(c) for c in sets.columns if c != "set"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets (as SETS, each once) are similar enough.  Wide bitmaps meet
    first; only what they let pass has its elements moved."""
    small = sets.drop("elements")
    x, y = (small.select(*[F.col(c).alias(f"{s}_{c}") for c in small.columns]) for s in ("x", "y"))
    left = pairs.join(x, F.col("a") == F.col("x_set")).join(y, F.col("b") == F.col("y_set")).where(pass_wide("x", "y", num, den)).select("a", "b")
    return compared(written(left, "likely"), sets, num, den)


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose elements (as ELEMENTS, each set once) are similar enough."""
    x = sets.select(F.col("set").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("set").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(num, den), "a long, b long")


# --- components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, by alternating large and
    small stars; each round is written, none is collected."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
