"""N-gram Jaccard join: documents whose sets of word n-grams are alike.

Words are runs of other characters than ASCII white space, A-Z in lower case.  A set is
the distinct n-grams of the whole text; a text of fewer words is one gram; a text without
words (or null) has an empty set and is linked with nothing.

Documents of equal sets are one class.  Classes meet by prefix filtering (``setjoin``),
each first with its nearest neighbours only.  These links make components; classes of
different components that share a posting are then joined and verified as well, each pair at
its first common element only, so each pair that is not linked already by others is tried
once, and components are exact.

Repeated rows and equal ids are rows of their own with the same class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferngraph.llm import kernel, setjoin
from ferngraph.session import extended, ship, written

NEAREST = 2


def _grams(buf: np.ndarray, bounds: np.ndarray, i: int, j: int, k: int):
    w = kernel.Words(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
    return kernel.grams(w.hash, w.first, w.row, k)


def _classes(k: int):
    """Column 0 is the text, the rest passes through; adds n and set, then a sketch."""

    def run(batches):
        sketch = setjoin.Sketch()
        schema = None
        for b in batches:
            buf, bounds = kernel.buffers(b.column(0))
            sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in kernel.chunks(bounds):
                g, r = _grams(buf, bounds, i, j, k)
                v, r = kernel.distinct(g, r)
                sketch.add(v)
                n, s = kernel.set_ids(v, r, j - i)
                sizes.append(n)
                ids.append(s)
            rows = b.num_rows
            schema = b.schema
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(sizes)), pa.array(np.concatenate(ids)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], [*schema.names[1:], "n", "set", "block", "counts"])
        block, data = sketch.rows()
        if schema is not None and block:
            m = len(block)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, f.type) for f in list(schema)[1:]], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], [*schema.names[1:], "n", "set", "block", "counts"])

    return run


def _distinct_sets(batches, k: int, wanted=None, texts=None):
    """(values, rows, ids of the rows, rows) of (text, hash of the text) whose text and set this task
    hasn't met lately.  Filters of sets and of texts let only these by."""
    met, seen = setjoin.Seen(), setjoin.Seen()
    for b in batches:
        hashes = b.column(1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(texts.has(hashes)) if texts is not None else np.arange(len(hashes))
        some = b.filter(pa.array(met.fresh(hashes, np.zeros_like(hashes), at)))
        buf, bounds = kernel.buffers(some.column(0))
        for i, j in kernel.chunks(bounds):
            g, r = _grams(buf, bounds, i, j, k)
            v, r = kernel.distinct(g, r)
            n, ids = kernel.set_ids(v, r, j - i)
            at = np.flatnonzero((n > 0) & wanted.has(ids)) if wanted is not None else np.flatnonzero(n)
            fresh = seen.fresh(ids, np.zeros_like(ids), at)
            keep = fresh[r]
            yield v[keep], r[keep], ids, np.flatnonzero(fresh)


def _postings(k: int, num: int, den: int, rarity):
    def parts(batches):
        for v, r, ids, _ in _distinct_sets(batches, k):
            size = np.bincount(r, minlength=len(ids))
            yield setjoin.prefixes(v, r, ids, size, rarity.value, num, den)

    return lambda batches: setjoin.packed(parts(batches), rarity.value)


def _sets(k: int, wanted, texts, rows):
    """What ``rows`` makes of wanted sets."""

    def run(batches):
        for v, r, ids, at in _distinct_sets(batches, k, wanted.value, texts.value):
            yield rows(v, r, ids, at)

    return run


WIDE = ", ".join(["set long", *(f"w{x} long" for x in range(setjoin.WIDE))])


def _wide_rows(v, r, ids, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), *[pa.array(w[at]) for w in setjoin.wide_bits(v, r, len(ids))]], [c.split()[0] for c in WIDE.split(", ")])


def classes(docs: DataFrame, text: str, keep: list[str], k: int) -> DataFrame:
    """Rows (_hash, keep..., n, set) with the hash of the text, and sketch rows (block, counts)."""
    shown = docs.select(F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"), *keep)
    ship(docs.sparkSession)
    return written(shown.mapInArrow(_classes(k), extended(shown, 1, "n long, set long, block int, counts binary")), "classes")


def links(docs: DataFrame, text: str, found: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) between classes, enough of them for exact components.  ``found``:
    what ``classes`` gives."""
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(setjoin.rarity(found.where("block is not null").select("block", "counts"), num, den))
    shown = docs.select(text, F.xxhash64(text).alias("_hash"))
    holders = found.where("n > 0").select("set", "_hash")

    def fetch(p: DataFrame, rows, ddl: str) -> DataFrame:
        return setjoin.once(shown.mapInArrow(_sets(k, *setjoin.wanted(p, holders, "_hash"), rows), ddl))

    def verified(p: DataFrame) -> DataFrame:
        # elements move only for what the bitmaps leave; texts are read once more for that
        near = setjoin.likely(p, fetch(p, setjoin.map_rows, setjoin.MAPS), num, den)
        return setjoin.compared(near, fetch(near, setjoin.element_rows, setjoin.ELEMENTS), num, den)

    pairs, kept = setjoin.candidates(shown.mapInArrow(_postings(k, num, den, rarity), setjoin.PACKED), num, den, NEAREST, by_size=True)
    pairs = written(pairs, "candidates")
    edges = written(verified(pairs), "links")
    # What is open: classes of one run in different components.
    root = setjoin.components(edges)
    posts = kept.drop("open").dropDuplicates(["key", "set"]).join(root, F.col("set") == F.col("node"), "left").select("*", F.coalesce("root", "set").alias("comp")).drop("node", "root")
    posts = written(posts, "open")
    size = posts.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = size.groupBy("key").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1").select("key", "main")
    mixed = written(posts.join(main, "key"), "mixed")
    if mixed.isEmpty():
        return edges
    # these few sets get wider bitmaps, so that hardly any pair meets in vain, and each posting
    # its set's earlier ones here, so that a pair meets once
    sets = mixed.select(F.col("set").alias("a"), F.col("set").alias("b")).distinct()
    wide = fetch(sets, _wide_rows, WIDE)
    before = F.collect_list("key").over(Window.partitionBy("set").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    mixed = written(mixed.withColumn("before", before).join(wide, "set"), "mixed")
    one, every = setjoin.side(mixed.where("comp <> main"), "x"), setjoin.side(mixed, "y")
    # two sets outside the main component of their run meet once
    more = one.join(every, "key").where("x_comp <> y_comp AND (y_comp = y_main OR x_set < y_set)").where(setjoin.pass_filters("x", "y", num, den)).where(setjoin.pass_wide("x", "y", num, den)).where("NOT arrays_overlap(x_before, y_before)")
    more = more.select(F.least("x_set", "y_set").alias("a"), F.greatest("x_set", "y_set").alias("b")).distinct()
    more = written(more.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "more")
    if more.isEmpty():
        return edges
    # these have met by wide bitmaps, so texts are read once for them
    return edges.unionByName(setjoin.verified(more, fetch(more, setjoin.set_rows, setjoin.SETS), num, den))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, keep..., n_shingles, component_id): the smallest id that links reach."""
    names = [doc_id, *(keep or [])]
    found = classes(docs, text, names, k)
    root = setjoin.components(links(docs, text, found, k, num, den))
    rows = found.where("n is not null").join(root, F.col("set") == F.col("node"), "left").select(*names, "n", F.coalesce("root", "set").alias("root"))
    least = rows.where("n > 0").groupBy("root").agg(F.min(doc_id).alias("least"))
    out = rows.join(least.withColumnRenamed("root", "_root"), (F.col("root") == F.col("_root")) & (F.col("n") > 0), "left")
    return out.select(*names, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col(doc_id)).alias("component_id"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents without those that are alike to an earlier one: of each component the
    one of the smallest id stays (of equal ids, the least row by hash); empty texts all stay.
    Rows equal in all columns are one document."""
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(*docs.columns).alias("_row"), F.struct(*docs.columns).alias("_doc"))
    found = join(keyed, "_id", "_text", k, num, den, keep=["_row"])
    single = found.where("n_shingles = 0").select("_row")
    best = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("x")).select("x._row")
    stay = single.unionByName(best).distinct()
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select("_doc.*")
