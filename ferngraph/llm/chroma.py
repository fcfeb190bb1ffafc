"""Chroma audio fingerprints and their alignment.

A media column holds 8-bit PCM.  Each recording is cut into overlapping frames; the
spectrum of a frame is folded into 12 pitch classes; an integral image over frames and
classes lets 16 box filters be read off with a few additions each; every filter is
quantised to two bits (Gray code), so each frame position gives one 32-bit integer.

To align, integers of ``RUN`` neighbouring positions make a landmark; of each ``WINNOW``
landmarks in a row the least by hash is posted, so any common stretch of that length
shares one.  Recordings of at most ``WINNOW`` landmarks are short: where one of a pair is,
all landmarks of both count.  Postings that meet vote for an offset; each offset with enough
votes (fewer where few landmarks are posted) is checked by the share of differing bits over
the whole overlap, and the best of those that pass is reported.

Recordings with equal fingerprints (by a 64-bit hash) are one class and are matched once.
Query classes are few against the recordings: each landmark brings its queries as a list, in
parts of about ``ASKS``, so a posting of a recording meets one row of them and not one for
each query, and postings that no query asks for don't move at all.  Votes are counted by
recording.  Defined results:
media of fewer than ``LEAST`` bytes are followed by silence up to there; null and empty
media have no integers, are a class by themselves (each) and match nothing; media are
read whole, in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.llm import kernel, setjoin
from ferngraph.session import extended, ship, written

FRAME, HOP, RATE, WIDTH = 128, 32, 8000, 8
RUN, WINNOW = 2, 8
MIN_VOTES, MAX_ERROR = 2, 0.3
PIECE = 1 << 18
#: Bytes of a recording with one landmark.
LEAST = FRAME + (WIDTH + RUN - 2) * HOP
#: The queries of a landmark come in lists of about so many.
ASKS = 1024
# Fixed values: (kind, first pitch class, height, width in frames) of the 16 filters.
FILTERS = (
    (0, 0, 12, 8), (0, 3, 6, 6), (1, 0, 12, 8), (1, 2, 8, 6), (2, 0, 12, 8), (2, 4, 4, 4), (3, 0, 12, 6), (3, 5, 6, 8),
    (4, 0, 6, 6), (4, 6, 6, 8), (1, 6, 6, 4), (2, 1, 10, 4), (5, 0, 12, 6), (5, 3, 9, 3), (1, 0, 4, 8), (2, 8, 4, 6),
)
STEPS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)

_frequency = np.fft.rfftfreq(FRAME, 1 / RATE)
_band = np.flatnonzero((_frequency > 60) & (_frequency < 3600))
_FOLD = np.zeros((len(_frequency), 12))
_FOLD[_band, np.round(12 * np.log2(_frequency[_band] / 440)).astype(int) % 12] = 1
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """(frames, 12) pitch-class energies of 8-bit samples, each frame of length 1."""
    n = (len(pcm) - FRAME) // HOP + 1
    out = []
    for a in range(0, n, PIECE // HOP):
        b = min(n, a + PIECE // HOP)
        part = pcm[a * HOP : (b - 1) * HOP + FRAME].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _HANN
        energy = np.abs(np.fft.rfft(frames)) ** 2 @ _FOLD
        out.append(energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-9))
    return np.concatenate(out) if out else np.zeros((0, 12))


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One packed integer for each position where WIDTH frames follow."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(x: int, y: int, w: int, h: int) -> np.ndarray:
        t = total
        return t[x + w : x + w + n, y + h] - t[x : x + n, y + h] - t[x + w : x + w + n, y] + t[x : x + n, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # all of it against nothing
            a, b = area(0, y, w, h), np.full(n, w * h * 0.25)
        elif kind == 1:  # low classes against high ones
            a, b = area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
        elif kind == 2:  # early against late
            a, b = area(0, y, w // 2, h), area(w // 2, y, w - w // 2, h)
        elif kind == 3:  # two diagonal quarters against the others
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            b = area(w // 2, y, w - w // 2, h // 2) + area(0, y + h // 2, w // 2, h - h // 2)
        elif kind == 4:  # the middle third of the classes
            a, b = area(0, y + h // 3, w, h // 3), (area(0, y, w, h) - area(0, y + h // 3, w, h // 3)) / 2
        else:  # the middle third of the frames
            a, b = area(w // 3, y, w // 3, h), (area(0, y, w, h) - area(w // 3, y, w // 3, h)) / 2
        v = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        out = out << np.uint32(2) | GRAY[np.digitize(v, STEPS)]
    return out


def landmarks(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each landmark, whether it is one of the winnowed)."""
    n = len(ints) - RUN + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h = np.zeros(n, np.uint64)
    for j in range(RUN):
        h = h + ints[j : j + n].astype(np.uint64) * kernel.GRAM_MULT[j]
    h = kernel.mix(h)
    won = np.ones(n, bool)
    if n > WINNOW:
        view = np.lib.stride_tricks.sliding_window_view(h, WINNOW)
        won[:] = False
        won[np.arange(len(view)) + view.argmin(1)] = True
    return h, won


def _padded(pcm: np.ndarray) -> np.ndarray:
    return np.concatenate((pcm, np.full(LEAST - len(pcm), 128, np.uint8))) if 0 < len(pcm) < LEAST else pcm


def _prints(batches):
    names = None
    for b in batches:
        buf, bounds = kernel.buffers(b.column(0))
        prints = [fingerprint(chroma(_padded(buf[bounds[k] : bounds[k + 1]]))).astype("<u4").tobytes() for k in range(b.num_rows)]
        names = [*b.schema.names[1:], "ints"]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints, pa.binary())], names)


def prints(df: DataFrame, media: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``ints``, the packed integers as little-endian bytes."""
    x = df.select(media.cast("binary").alias("_media"), *keep)
    ship(df.sparkSession)
    return x.mapInArrow(_prints, extended(x, 1, "ints binary"))


POSTING = "class long, key long, pos long, won boolean, short boolean, posted int"
# What a recording looks for: any landmark of a query, a winnowed one, one of a short query.
ANY, WON, SHORT = 0, 0x5DEECE66D, 0x2545F4914F6CDD1D


def _post(asked):
    """Postings of all landmarks; with ``asked``, a filter of what queries ask for, only of those
    that may meet one: all of short recordings, of the others the winnowed ones and those of
    short queries."""

    def run(batches):
        names = [x.split()[0] for x in POSTING.split(", ")]
        for b in batches:
            out: list[tuple] = [tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool, bool, np.int32))]
            for c, ints in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, won = landmarks(np.frombuffer(ints, "<u4"))
                key, short = h.view(np.int64), len(h) <= WINNOW
                at = np.arange(len(h))
                if asked is not None:
                    has = lambda tag, k=key: asked.value.has(k ^ np.int64(tag))
                    at = np.flatnonzero(has(ANY) if short else won & has(WON) | has(SHORT))
                n = len(at)
                out.append((np.full(n, c, np.int64), key[at], at, won[at], np.full(n, short), np.full(n, won.sum(), np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return run


class _Votes:
    """Votes by (class, query, offset) of rows sorted by class."""

    def __init__(self):
        self.held = [np.empty(0, np.int64)] * 5

    def add(self, new: list[np.ndarray]) -> list[np.ndarray]:
        """Merged votes of all classes but the last, which may go on."""
        x = [np.concatenate(p) for p in zip(self.held, new, strict=True)]
        order = np.lexsort((x[2], x[1], x[0]))
        x = [c[order] for c in x]
        if not len(order):
            return x
        begin = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in x[:3]], axis=0))))
        x = [*[c[begin] for c in x[:3]], np.add.reduceat(x[3], begin), np.minimum.reduceat(x[4], begin)]
        cut = int(np.searchsorted(x[0], x[0][-1]))
        self.held = [c[cut:] for c in x]
        return [c[:cut] for c in x]


def _tried(x: list[np.ndarray]) -> pa.RecordBatch:
    """(query, class, offsets) of the offsets with enough votes."""
    cls, query, offset, votes, few = x
    ok = votes >= np.minimum(MIN_VOTES, -(-few // 4))
    cls, query, offset, votes = cls[ok], query[ok], offset[ok], votes[ok]
    begin = np.flatnonzero(np.concatenate(([True], (cls[1:] != cls[:-1]) | (query[1:] != query[:-1])))) if len(cls) else np.empty(0, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(votes), pa.array(offset)], ["votes", "offset"])
    offsets = pa.ListArray.from_arrays(pa.array(np.append(begin, len(cls)).astype(np.int32)), pairs)
    return pa.RecordBatch.from_arrays([pa.array(query[begin]), pa.array(cls[begin]), offsets], ["query", "class", "offsets"])


def _vote(batches):
    """(class, pos, won, short, posted, asks), sorted by class -> pairs with their offsets."""
    votes = _Votes()
    for b in batches:
        asks = b.column(5)
        size = asks.value_lengths().to_numpy()
        flat = asks.flatten()
        query, at, q_won, q_short, q_posted = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        row = np.repeat(np.arange(b.num_rows), size)
        cls, pos, won, short, posted = (b.column(k).to_numpy(zero_copy_only=False)[row] for k in range(5))
        ok = np.flatnonzero((query != cls) & (q_short | short | q_won & won))
        # in steps, so that one batch of long lists stays small
        for i in range(0, len(ok), 1 << 20):
            k = ok[i : i + (1 << 20)]
            done = votes.add([cls[k], query[k], pos[k] - at[k], np.ones(len(k), np.int64), np.minimum(posted[k], q_posted[k]).astype(np.int64)])
            if len(done[0]):
                yield _tried(done)
    if len(votes.held[0]):
        yield _tried(votes.held)


def _errors(batches):
    """The best offset by votes of each pair among those whose bits agree."""
    names = ["query", "class", "offset", "votes", "overlap", "bit_error"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    for b in batches:
        out = []
        for q, c, offsets, x, y in zip(*[b.column(k).to_pylist() for k in ("query", "class", "offsets", "x", "y")], strict=True):
            u, v = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            for o in sorted(offsets, key=lambda o: (-o["votes"], abs(o["offset"]), -o["offset"])):
                d = o["offset"]
                a, e = max(0, -d), min(len(u), len(v) - d)
                error = float(np.bitwise_count(u[a:e] ^ v[a + d : e + d]).mean() / 32) if e > a else 1.0
                if error <= MAX_ERROR:
                    out.append((q, c, d, o["votes"], e - a, error))
                    break
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names)


def align(queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """Classes (class, ints) of queries against classes of recordings: (query, class, offset,
    votes, overlap, bit_error) of the pairs that align.  Equal classes are left out."""
    q = written(queries.select("class", "ints").mapInArrow(_post(None), POSTING), "asked")
    tags = F.array(F.col("key"), F.when(F.col("won"), F.col("key").bitwiseXOR(F.lit(WON))), F.when(F.col("short"), F.col("key").bitwiseXOR(F.lit(SHORT))))
    ids = written(q.select(F.explode(F.array_compact(tags)).alias("id")).distinct(), "ids")
    asked = queries.sparkSession.sparkContext.broadcast(setjoin.id_filter(ids, "id"))
    most = q.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("class", "pos"), F.lit(most // ASKS + 1))
    ask = F.struct(F.col("class").alias("query"), F.col("pos").alias("at"), F.col("won").alias("q_won"), F.col("short").alias("q_short"), F.col("posted").alias("q_posted"))
    asks = q.groupBy("key", part.alias("part")).agg(F.collect_list(ask).alias("asks"))
    r = recordings.select("class", "ints").mapInArrow(_post(asked), POSTING)
    met = r.join(asks, "key").select("class", "pos", "won", "short", "posted", "asks")
    tried = met.repartition("class").sortWithinPartitions("class").mapInArrow(_vote, "query long, class long, offsets array<struct<votes:long,offset:long>>")
    x = queries.select(F.col("class").alias("query"), F.col("ints").alias("x"))
    y = recordings.select("class", F.col("ints").alias("y"))
    pairs = tried.join(x, "query").join(y, "class").select("query", "class", "offsets", "x", "y")
    return pairs.mapInArrow(_errors, "query long, class long, offset long, votes long, overlap long, bit_error double")


def search(df: DataFrame, key: str, media: Column, is_query: Column) -> DataFrame:
    """One row per recording: key, n_ints, class_id (the least key of its class), is_query,
    and in ``matches`` what its class aligns with among query classes: query (the least
    query key of that class), offset, votes, bit_error."""
    made = written(prints(df.withColumn("_q", is_query), media, [key, "_q"]).withColumn("class", F.xxhash64("ints")), "prints")
    some = F.length("ints") > 0
    per = made.where(some).groupBy("class").agg(F.first("ints").alias("ints"), F.max("_q").alias("q"), F.min(F.when(F.col("_q"), F.col(key))).alias("query_key"), F.min(key).alias("class_id"))
    per = written(per, "classes")
    found = align(per.where("q"), per)
    found = found.join(per.select(F.col("class").alias("query"), "query_key"), "query")
    by = found.groupBy("class").agg(F.sort_array(F.collect_list(F.struct(F.col("query_key").alias("query"), "offset", "votes", "bit_error"))).alias("matches"))
    info = per.select("class", "class_id").join(by, "class", "left")
    out = made.select(key, F.col("_q").alias("is_query"), "class", (F.length("ints") / 4).cast("long").alias("n_ints")).join(info, "class", "left")
    return out.select(key, "is_query", "n_ints", "class", F.coalesce("class_id", key).alias("class_id"), "matches")
