"""Benchmark decontamination on canonical templates.

Words are runs of letters and digits.  Numbers, names (capitalised words inside a
sentence) and units (after a number) become typed slots; all else stays, in lower case.
Windows of ``WINDOW`` words of the benchmark are hashed and looked up for every window of
every document.  All hits on one diagonal (document position less item position) must agree on
their slots, within a window and between windows: one value of the item always stands for one
value in the document, and the other way round; else the diagonal is no hit.  A question
with other numbers or names is thus found, a chance likeness of its slots is not.

Windows with fewer than ``LITERALS`` words outside slots are looked up by their exact words,
values included.  The first word of a window may be plain in one text and a name or a unit in
the other, as what stands before it differs: such windows are taken both ways.  Items of fewer
than ``WINDOW`` words are looked up whole; items of fewer than ``LITERALS`` words of any kind
are not looked up.  Defined results: null and empty texts have no hits; equal items share
their hits, under the smallest id; repeated documents are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.llm import kernel
from ferngraph.session import extended, ship, written

WINDOW = 8
LITERALS = 4
#: So many windows of the benchmark are looked up in one pass; more take more passes.
INDEX_ROWS = 2_000_000
# Units that follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg t lb lbs oz "
    "gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec min h hr hrs second seconds "
    "minute minutes hour hours day days week weeks month months year years ms kb mb gb tb hz khz mhz ghz v w kw a j k c f percent dollar dollars "
    "cent cents euro euros usd eur gbp mph kmh degrees degree"
).split()
HIT = "array<struct<item:long,windows:long,first_word:long,share:double,changed:boolean>>"

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
ALL, REST, NONE = 0, 1, 2
_EXACT = np.uint64(0x456712345)
_SLOT = np.array([0x1234567, 0x2345671, 0x3456712], np.uint64)


def _one(word: str) -> int:
    return int(kernel.Words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), breaks=~_ALNUM).hash[0])


_UNIT_HASHES = np.sort(np.array([_one(u) for u in UNITS], np.uint64))


class Canon:
    """Canonical words of a run of texts: ``token`` (hash or slot), ``value`` (hash of what
    stands there), ``slot`` flags, ``first`` (word range of each text)."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        w = kernel.Words(buf, bounds, breaks=~_ALNUM)
        n = len(w.hash)
        if not n:
            self.token = self.value = np.empty(0, np.uint64)
            self.slot = np.empty(0, bool)
            self.row, self.first = w.row, w.first
            return
        digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
        number = _DIGIT[buf[w.start]]
        gap = np.full(n, 1 << 30)
        gap[1:] = w.start[1:] - w.end[:-1]
        gap[w.first[:-1][w.first[:-1] < n]] = 1 << 30
        # 3.5 and 1,000 are one number
        more = number & (digits[w.end] - digits[w.start] == w.end - w.start)
        more[1:] &= number[:-1] & (gap[1:] == 1) & np.isin(buf[np.maximum(w.start[1:] - 1, 0)], np.frombuffer(b".,:/", np.uint8))
        more[0] = False
        head = np.flatnonzero(~more)
        value = np.add.reduceat(w.hash * (np.uint64(1) + more.astype(np.uint64) * np.uint64(2)), head)
        start, number, gap, row = w.start[head], number[head], gap[head], w.row[head]
        stops = np.concatenate(([0], np.cumsum(np.isin(buf, np.frombuffer(b".!?:;\n", np.uint8)))))
        end = np.append(w.end[head[1:] - 1], w.end[-1])
        opens = np.ones(len(head), bool)
        opens[1:] = (stops[start[1:]] > stops[end[:-1]]) | (gap[1:] == 1 << 30)
        b0 = buf[start]
        b1 = buf[np.minimum(start + 1, len(buf) - 1)]
        capital = (b0 >= 65) & (b0 <= 90) | (b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E)
        name = capital & ~opens
        unit = np.zeros(len(head), bool)
        at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
        unit[1:] = (number[:-1] & (gap[1:] < 1 << 30) & (_UNIT_HASHES[at] == value)[1:])
        name &= ~unit & ~number
        self.slot = number | name | unit
        self.token = np.where(number, _SLOT[0], np.where(unit, _SLOT[1], np.where(name, _SLOT[2], value)))
        self.value, self.row = value, row
        self.first = np.searchsorted(row, np.arange(len(bounds)))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, what it leaves to slots) of the windows of k words in one text.
        The last is ALL, REST (the first word stands as it is) or NONE (exact words)."""
        n = len(self.token) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        h, exact = np.full(n, np.uint64(k)), np.full(n, _EXACT + np.uint64(k))
        for j in range(k):
            h = h + self.token[j : j + n] * kernel.GRAM_MULT[j]
            exact = exact + self.value[j : j + n] * kernel.GRAM_MULT[j]
        plain = np.concatenate(([0], np.cumsum(~self.slot)))
        plain = plain[k:] - plain[:-k]
        inside = self.row[:n] == self.row[k - 1 :]
        loose = inside & self.slot[:n] & (self.token[:n] != _SLOT[0])
        rest = h + (self.value[:n] - self.token[:n]) * kernel.GRAM_MULT[0]
        found = [(np.flatnonzero(ok), x, kind) for ok, x, kind in ((inside & (plain >= LITERALS), h, ALL), (loose & (plain + 1 >= LITERALS), rest, REST), (inside & (plain < LITERALS), exact, NONE))]
        at = np.concatenate([x[0] for x in found])
        return at, kernel.mix(np.concatenate([x[1][x[0]] for x in found])), np.repeat([x[2] for x in found], [len(x[0]) for x in found])


def index(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(hash, size, item, pos, slots): windows of all items; slots = (place, value) flattened."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            buf, bounds = kernel.buffers(b.column(1))
            c = Canon(buf, bounds)
            out: list[tuple] = []
            count = np.diff(c.first)
            for k in sorted({WINDOW, *(int(x) for x in count if LITERALS <= x < WINDOW)}):
                at, h, kinds = c.windows(k)
                for x, y, kind in zip(at.tolist(), h.view(np.int64).tolist(), kinds.tolist(), strict=True):
                    r = int(c.row[x])
                    if k == min(WINDOW, int(count[r])):
                        slots = [v for p in range(int(kind == REST), k) if c.slot[x + p] for v in (p, int(c.value[x + p].view(np.int64)))]
                        out.append((y, k, ids[r], x - int(c.first[r]), slots, max(1, int(count[r]) - k + 1)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["hash", "size", "item", "pos", "slots", "of"])

    ship(benchmark.sparkSession)
    once = benchmark.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(F.col(item_id).cast("long")).alias("item"))
    return once.select("item", text).mapInArrow(run, "hash long, size int, item long, pos long, slots array<long>, of long")


def _look_up(shared):
    def run(batches):
        hashes, sizes, items, pos, slots, of = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        lengths = sorted(set(sizes.tolist()))
        for b in batches:
            buf, bounds = kernel.buffers(b.column(0))
            hits: list[list | None] = [None] * b.num_rows
            for i, j in kernel.chunks(bounds):
                c = Canon(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                by: dict[tuple, list] = {}
                for k in lengths:
                    at, h, _ = c.windows(k)
                    some = maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
                    at, h = at[some], h[some]
                    lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                    for x in np.flatnonzero(hi > lo):
                        for e in range(lo[x], hi[x]):
                            w = int(at[x])
                            r = int(c.row[w])
                            p = w - int(c.first[r])
                            by.setdefault((r, int(items[e]), p - int(pos[e])), []).append((p, w, e))
                found: dict[tuple, list] = {}
                for (r, item, _), windows in sorted(by.items()):
                    to: dict[int, int] = {}
                    back: dict[int, int] = {}
                    first, changed, agree = min(windows)[0], False, True
                    for _, w, e in sorted(windows):
                        s = slots[e]
                        for q in range(0, len(s), 2):
                            u, v = s[q + 1], int(c.value[w + s[q]].view(np.int64))
                            agree &= to.setdefault(u, v) == v and back.setdefault(v, u) == u
                            changed |= u != v
                    good = len({p for p, _, _ in windows}) if agree else 0
                    if good:
                        old = found.get((r, item))
                        share = min(1.0, good / int(of[windows[0][2]]))
                        if old is None or good > old[0]:
                            found[r, item] = [good, first, share, changed]
                for (r, item), (good, first, share, changed) in found.items():
                    hits[i + r] = (hits[i + r] or []) + [{"item": item, "windows": good, "first_word": first, "share": share, "changed": changed}]
            kind = pa.list_(pa.struct([("item", pa.int64()), ("windows", pa.int64()), ("first_word", pa.int64()), ("share", pa.float64()), ("changed", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x or [] for x in hits], kind)], [*b.schema.names[1:], "_hits"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, index_rows: int = INDEX_ROWS) -> DataFrame:
    """``keep`` columns (default: all) with ``_hits``: item, windows, first_word, share (of the
    item's windows), changed (some slot has another value)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    entries = written(index(benchmark, item_id, item_text), "index")
    passes = max(1, -(-entries.count() // index_rows))
    out = docs.select(F.col(text).alias("_text"), *keep)
    for k in range(passes):
        # items are dealt whole, so a pass can check their slots
        part = entries.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).toPandas().sort_values(["hash", "item", "pos"])
        if not len(part):
            part = part.astype({"hash": "int64"})
        u = part["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(u, kind="stable")
        shared = spark.sparkContext.broadcast((u[order], *[part[c].to_numpy(np.int64)[order] for c in ("size", "item", "pos")], [list(part["slots"].iloc[x]) for x in order], part["of"].to_numpy(np.int64)[order]))
        more = [] if k == 0 else [F.col("_old")]
        x = out.select("_text", *([F.col("_text").alias("_again")] if k + 1 < passes else []), *keep, *more)
        got = x.mapInArrow(_look_up(shared), extended(x, 1, f"_hits {HIT}"))
        hits = F.concat("_old", "_hits") if k else F.col("_hits")
        if k + 1 == passes:
            return got.select(*keep, hits.alias("_hits"))
        out = got.select(F.col("_again").alias("_text"), *keep, hits.alias("_old"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a hit."""
    whole = docs.select(F.col(text).alias("t"), F.struct(*docs.columns).alias("_doc"))
    return find(whole, benchmark, "t", keep=["_doc"]).where(F.size("_hits") == 0).select("_doc.*")
