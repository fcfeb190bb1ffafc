"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words (runs of other characters than ASCII white space,
A-Z in lower case).  A line goes if an earlier line of the corpus, kept or not, has a
Jaccard similarity of num/den or more to it.  Lines are ordered by document id (nulls
last), then a hash of the whole row, then line number.

Equal token sets meet by their id; different ones by prefix filtering (``setjoin``), each
line with its nearest passing predecessors first; lines that these leave open are joined
with all of their runs.  A set is then known by its place, the first line that has it, so
that only these lines' words are looked up again.

Lines are numbered by integer ids where these are unique and fit in 64 bits with the line
numbers; else documents are sorted and numbered first.

Defined results: lines without words stay; null texts stay null; ids may be of any type that
sorts and may repeat; rows equal in all columns are one document, whose copies are treated
alike; a document may end up with an empty text; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.llm import kernel, setjoin
from ferngraph.session import extended, ship, sorted_join, written

NEAREST = 3
#: So many bytes are looked at together, a few times over.
RUN = 1 << 18
INTEGERS = ("byte", "short", "integer", "long")


def _lines(column: pa.Array):
    """For runs of documents: (bytes, where each line begins and the last ends, document of each line, number of each line)."""
    buf, bounds = kernel.buffers(column)
    for i, j in kernel.chunks(bounds, RUN):
        part, own = buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        breaks = np.flatnonzero(part == 10)
        doc_of_break = np.searchsorted(own, breaks, "right") - 1
        start = np.concatenate((own[:-1], breaks + 1))
        doc = np.concatenate((np.arange(j - i), doc_of_break))
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        number = np.arange(len(doc)) - np.searchsorted(doc, np.arange(j - i))[doc]
        yield part, np.append(start, own[-1]), doc + i, number


def _word_sets(part: np.ndarray, bounds: np.ndarray):
    """For runs of at most 65536 lines: (first, last, values, line of each value counted from first)."""
    w = kernel.Words(part, bounds, loaded=True)
    for a in range(0, len(bounds) - 1, 65536):
        b = min(a + 65536, len(bounds) - 1)
        x, y = w.first[a], w.first[b]
        yield a, b, *kernel.distinct(w.hash[x:y], w.row[x:y] - a)


def _line_sets(column: pa.Array):
    """For runs of lines: (values, line of each value, n lines, document of each line, number of each line)."""
    for part, bounds, doc, number in _lines(column):
        for a, b, v, r in _word_sets(part, bounds):
            yield v, r, b - a, doc[a:b], number[a:b]


def _instances(batches):
    """(text, number) -> (number, line, set) of each line with words, then a sketch."""
    sketch = setjoin.Sketch()
    names = ["number", "line", "set", "block", "counts"]
    for b in batches:
        ids = b.column(1).to_numpy(zero_copy_only=False)
        got: list = []
        for v, r, n, doc, number in _line_sets(b.column(0)):
            sketch.add(v)
            size, sets = kernel.set_ids(v, r, n)
            at = np.flatnonzero(size)
            got.append((ids[doc[at]], number[at], sets[at]))
        if got:
            columns = [np.concatenate(x) for x in zip(*got, strict=True)]
            m = len(columns[0])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
    block, data = sketch.rows()
    if block:
        none = pa.nulls(len(block), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(block, pa.int32()), pa.array(data, pa.binary())], names)


def _postings(num: int, den: int, shift: int, rarity):
    def parts(batches):
        seen = setjoin.Seen()
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            for v, r, n, doc, number in _line_sets(b.column(0)):
                size, sets = kernel.set_ids(v, r, n)
                order = ids[doc] << shift | number
                keep = seen.fresh(sets, order, np.flatnonzero(size))[r]
                yield setjoin.prefixes(v[keep], r[keep], sets, order, rarity.value, num, den)

    return lambda batches: setjoin.packed(parts(batches), rarity.value)


def _sets(shift: int, wanted):
    """(text, number) -> sets, by place, of the lines that are wanted; words of others aren't looked at."""

    def run(batches):
        for b in batches:
            ids = b.column(1).to_numpy(zero_copy_only=False)
            for part, bounds, doc, number in _lines(b.column(0)):
                order = ids[doc] << shift | number
                at = np.flatnonzero(wanted.value.has(order))
                if not len(at):
                    continue
                size = bounds[at + 1] - bounds[at]
                own = np.append(0, np.cumsum(size))
                some = part[np.arange(own[-1]) + np.repeat(bounds[at] - own[:-1], size)]
                for x, y, v, r in _word_sets(some, own):
                    yield setjoin.set_rows(v, r, order[at[x:y]], np.flatnonzero(np.bincount(r, minlength=y - x)))

    return run


def _strip(batches):
    """(text, gone, rest...) -> (rest..., text, n_lines, n_removed)."""
    for b in batches:
        texts, gone = b.column(0).to_pylist(), b.column(1).to_pylist()
        out, lines, removed = [], [], []
        for t, g in zip(texts, gone, strict=True):
            n = t.count("\n") + 1 if t is not None else 0
            drop = set(g or ())  # copies of a row name its lines again
            if drop:
                t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
            out.append(t)
            lines.append(n)
            removed.append(len(drop))
        yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*b.schema.names[2:], "_text", "_lines", "_removed"])


def _numbers(docs: DataFrame, doc_id: str) -> tuple[Column | None, bool]:
    """A number from 0 on by id, if ids are integers that no two different rows share, and whether
    no two rows at all do."""
    if docs.schema[doc_id].dataType.typeName() not in INTEGERS:
        return None, False
    ids = docs.select(F.col(doc_id).cast("long").alias("i"))
    low, high, most = ids.groupBy("i").agg(F.count("*").alias("n")).agg(F.min("i"), F.max("i"), F.max("n")).first()
    if low is not None and high - low >= 1 << 60:
        return None, False
    single = (most or 0) <= 1
    if not single:  # whole rows are read only then
        rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.xxhash64(*docs.columns).alias("r"))
        if not rows.groupBy("i").agg(F.min("r").alias("x"), F.max("r").alias("y")).where("x <> y").isEmpty():
            return None, False
    return F.coalesce(F.col(doc_id).cast("long") - F.lit(low), F.lit((high or 0) - (low or 0) + 1)), single


def _ranked(docs: DataFrame, doc_id: str) -> DataFrame:
    """(r, i): numbers of distinct rows, by hash, in the order of ids and then of hashes."""
    spark = docs.sparkSession
    keys = docs.select(F.col(doc_id).alias("id"), F.xxhash64(*docs.columns).alias("r")).distinct()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("id").asc_nulls_last(), F.col("r")]
    at = written(keys.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("r", F.monotonically_increasing_id().alias("at")), "places")
    # the upper bits of such an id are its partition, the lower ones its place there
    part = F.shiftright("at", 33)
    total, offsets = 0, []
    for p, n in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets += [F.lit(p), F.lit(total)]
        total += n
    start = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return at.select("r", (start + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("i"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """The documents with ``text`` without the lines that go, and _lines and _removed, which
    replace columns of these names."""
    spark = docs.sparkSession
    ship(spark)
    number, single = _numbers(docs, doc_id)
    rest = F.struct(*[c for c in docs.columns if c not in (text, "_lines", "_removed")]).alias("_doc")
    for plain in (True, False):
        if plain and number is None:
            continue
        if plain:
            shown = docs.select(F.col(text).alias("t"), number.alias("i"), rest)
        else:
            shown = written(docs.select(F.col(text).alias("t"), F.xxhash64(*docs.columns).alias("r"), rest).join(_ranked(docs, doc_id), "r").select("t", "i", "_doc"), "numbered")
        made = written(shown.select("t", "i").mapInArrow(_instances, "number long, line long, set long, block int, counts binary"), "lines")
        last, most = made.agg(F.max("number"), F.max("line")).first()
        shift = int(most or 0).bit_length()
        if int(last or 0) >> (62 - shift) == 0:
            break
    else:
        raise ValueError("more lines than 64-bit numbers")
    order = F.shiftleft("number", shift).bitwiseOR(F.col("line"))
    lines = made.where("set is not null").select("number", "line", "set", order.alias("ord"))
    first = written(lines.groupBy("set").agg(F.min("ord").alias("first"), F.count("*").alias("n")), "first")
    rarity = spark.sparkContext.broadcast(setjoin.rarity(made.where("block is not null").select("block", "counts"), num, den))
    postings = shown.select("t", "i").mapInArrow(_postings(num, den, shift, rarity), setjoin.PACKED)
    pairs, kept = setjoin.candidates(postings, num, den, NEAREST)
    pairs = written(pairs, "candidates")

    def fetch(p):
        sets = shown.select("t", "i").mapInArrow(_sets(shift, setjoin.wanted(p, None, "")[0]), setjoin.SETS)
        return written(sets, "sets") if plain and single else setjoin.once(sets)  # only copies of rows repeat places

    gone = written(setjoin.verified(sorted_join(pairs), fetch(pairs), num, den).select(F.col("b").alias("ord")).distinct(), "gone")
    still = kept.where("open").join(sorted_join(gone), "ord", "left_anti").select("key", "set", "ord", "n", "pos", "bits")
    early, late = setjoin.side(kept.drop("open"), "x"), setjoin.side(still, "y")
    more = early.join(late, "key").where("x_ord < y_ord AND x_set <> y_set").where(setjoin.pass_filters("x", "y", num, den))
    more = written(more.select(F.col("x_ord").alias("a"), F.col("y_ord").alias("b")).distinct().join(sorted_join(pairs), ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        gone = gone.unionByName(setjoin.verified(sorted_join(more), fetch(more), num, den).select(F.col("b").alias("ord"))).distinct()
    ends = first.join(sorted_join(gone.select(F.col("ord").alias("first"), F.lit(True).alias("gone"))), "first", "left").where("gone OR n > 1").select("set", "first", "gone")
    lost = lines.join(ends, "set").where("gone OR ord > first").groupBy("number").agg(F.collect_list("line").alias("_gone"))
    both = shown.join(lost, F.col("i") == F.col("number"), "left").select("t", "_gone", "_doc")
    out = both.mapInArrow(_strip, extended(both, 2, "_text string, _lines long, _removed long"))
    kept = [F.col("_text").alias(text) if c == text else F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ("_lines", "_removed")]
    return out.select(*kept, "_lines", "_removed")


def dedup_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``dedup``, without the documents that had words and have none left."""
    out = dedup(docs, doc_id, text)
    return out.where(~((F.col("_removed") > 0) & ~F.col(text).rlike(r"[^\x20\x09-\x0D]"))).select(*[c for c in docs.columns if c in out.columns])
