"""LM scoring by masked pseudo-likelihood.

Each word is predicted from the words on either side of it; a document's score is the sum
of log P(word | both sides) over all its words.  Words are runs of other characters than
ASCII white space, A-Z in lower case; each is an entry of its own under a 64-bit hash.

Gathered are the counts of all words and of all pairs of neighbours in the corpus, a table
that grows with it: words and pairs are cells of a table with eight cells or more for each
word of the corpus (and 2^40 at least), held as packed buckets of sorted cells.  The
commonest words are classes of their own, the others share classes by frequency (that of
their cell of a fixed sketch).  A small network predicts the class from the classes of two
words on each side; it trains on counts of (context, class) over all words.  Class times
frequency within the class is what the pair counts are smoothed with: P is the mean of
(n(left, word) + MU * base) / (n(left) + MU) and the same of the right side.

No table of words is held by a task: texts are dealt into blocks, each block asks the
buckets for its distinct words and pairs, and the answers come back to the block in the
order of the cells.  No word is left out, and reruns agree whatever the partitions.

Defined results: null, empty and blank texts have no words, score 0 and a null mean; an
empty corpus gives a uniform model.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ferngraph.llm import kernel, setjoin
from ferngraph.session import extended, ship, written

#: Bytes of text whose words are looked up together.
BLOCK = 1 << 23
#: A task counts so many words before it passes its counts on.
FLUSH = 1 << 22
#: Least bits of a cell, and about how many bytes of text one bucket of cells stands for.
BITS, BUCKET = 40, 3 << 20
#: Weight of the smoothing, in words.
MU = 50.0
#: Class 0 is the edge of a text.
CLASSES = 32
COARSE = 4
HIDDEN = 24
CONTEXTS = COARSE * CLASSES * CLASSES * COARSE


def _pairs(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(place of the left word, key) of all neighbours in one text."""
    at = np.flatnonzero(w.row[1:] == w.row[:-1])
    return at, kernel.mix(w.hash[at] * kernel.GRAM_MULT[0] + w.hash[at + 1] * kernel.GRAM_MULT[1])


def _ends(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last words of the texts."""
    some = np.diff(w.first) > 0
    return w.first[:-1][some], w.first[1:][some] - 1


def _context(w: kernel.Words, cls: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Number of each word's context: far left, left, right, far right."""
    n = len(cls)
    at = np.arange(n)
    lo, hi = w.first[w.row], w.first[w.row + 1]

    def side(d: int) -> np.ndarray:
        ok = (at + d >= lo) & (at + d < hi)
        return np.where(ok, cls[np.clip(at + d, 0, max(n - 1, 0))], 0)

    return ((coarse[side(-2)] * CLASSES + side(-1)) * CLASSES + side(1)) * COARSE + coarse[side(2)]


# --- packed counts ----------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, of which the upper ones are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(planes.tobytes(), 1)


def _unpack(data) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_cells(cells: np.ndarray) -> bytes:
    return _pack(np.diff(cells, prepend=np.uint64(0)))


def _unpack_cells(data) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


class Layout:
    """Bits of a cell, and of its bucket (the upper ones)."""

    def __init__(self, size: int):
        self.bits = max(BITS, int(4 * size).bit_length())
        self.upper = max(0, (size // BUCKET).bit_length())

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def cut(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, first, last) of sorted cells."""
        if not len(cells):
            return []
        bucket = (cells >> np.uint64(self.bits - self.upper)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        return list(zip(bucket[begin].tolist(), begin.tolist(), np.append(begin[1:], len(bucket)).tolist(), strict=True))


COUNTS = "word boolean, bucket int, cells binary, n binary, first binary, last binary"
_COUNT_TYPES = (pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def _count_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _COUNT_TYPES, strict=True)], _COUNT_NAMES)


def _tally(layout: Layout):
    """Counts of words (and of those that open and close a text) and of pairs, by bucket."""

    def counted(words: list, firsts: list, lasts: list, pairs: list) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(words), return_counts=True)
        ends = [np.bincount(np.searchsorted(cells, np.concatenate(e)), minlength=len(cells)) for e in (firsts, lasts)]
        rows = [(True, k, _pack_cells(cells[i:j]), _pack(n[i:j]), *(_pack(e[i:j]) for e in ends)) for k, i, j in layout.cut(cells)]
        cells, n = np.unique(np.concatenate(pairs), return_counts=True)
        rows += [(False, k, _pack_cells(cells[i:j]), _pack(n[i:j]), None, None) for k, i, j in layout.cut(cells)]
        return _count_rows(rows)

    def run(batches):
        held: tuple[list, ...] = ([], [], [], [])
        for b in batches:
            buf, bounds = kernel.buffers(b.column(0))
            for i, j in kernel.chunks(bounds):
                w = kernel.Words(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                words = layout.cells(w.hash)
                for x, new in zip(held, (words, *(words[e] for e in _ends(w)), layout.cells(_pairs(w)[1])), strict=True):
                    x.append(new)
                if sum(map(len, held[0])) >= FLUSH:
                    yield counted(*held)
                    held = ([], [], [], [])
        if held[0]:
            yield counted(*held)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """One row for all rows of a bucket."""
    word, bucket = table["word"][0].as_py(), table["bucket"][0].as_py()
    cells, of = np.unique(np.concatenate([_unpack_cells(x) for x in table["cells"].to_pylist()]), return_inverse=True)
    total = lambda c: _pack(np.bincount(of, np.concatenate([_unpack(x) for x in table[c].to_pylist()]), len(cells)).astype(np.int64))
    row = (word, bucket, _pack_cells(cells), total("n"), *((total("first"), total("last")) if word else (None, None)))
    return pa.Table.from_batches([_count_rows([row])])


# --- blocks and lookups -----------------------------------------------------------


def _deal(batches):
    """One row for each block: its number, texts (in UTF-8, packed) and their sizes, and the
    other columns of its rows."""
    task, k = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        buf, bounds = kernel.buffers(b.column(0))
        for i, j in kernel.chunks(bounds, BLOCK):
            part = b.slice(i, j - i)
            rows = pa.StructArray.from_arrays(part.columns[1:], part.schema.names[1:])
            columns = [
                pa.array([task + k]), pa.array([zlib.compress(buf[bounds[i] : bounds[j]].tobytes(), 1)], pa.binary()), pa.array([_pack(np.diff(bounds[i : j + 1]))], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), rows),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_block", "_texts", "_sizes", "_rows"])
            k += 1


def _words(texts: bytes, sizes: bytes) -> kernel.Words:
    return kernel.words(np.frombuffer(zlib.decompress(texts), np.uint8), np.concatenate(([0], np.cumsum(_unpack(sizes).astype(np.int64)))))


def _asked(w: kernel.Words, layout: Layout) -> tuple:
    """Distinct cells of the words and of the pairs, each with the place of every one, and
    where the pairs' left words stand."""
    at, key = _pairs(w)
    return (*np.unique(layout.cells(w.hash), return_inverse=True), *np.unique(layout.cells(key), return_inverse=True), at)


def _ask(layout: Layout):
    """(block, word, bucket, cells) of blocks (_block, _texts, _sizes)."""
    names, types = ["block", "word", "bucket", "cells"], (pa.int64(), pa.bool_(), pa.int32(), pa.binary())

    def run(batches):
        for b in batches:
            for block, texts, sizes in zip(*(b.column(k) for k in range(3)), strict=True):
                words, _, pairs, _, _ = _asked(_words(texts.as_py(), sizes.as_py()), layout)
                rows = [(block.as_py(), kind, k, _pack_cells(c[x:y])) for kind, c in ((True, words), (False, pairs)) for k, x, y in layout.cut(c)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


ANSWER = "block long, word boolean, bucket int, n binary, first binary, last binary"


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The counts of the cells that each block asks a bucket for, in their order; 0 where none are."""
    have = _unpack_cells(known["cells"][0].as_py()) if known.num_rows else np.empty(0, np.uint64)
    counts = {c: _unpack(known[c][0].as_py()) if known.num_rows and known[c][0].is_valid else None for c in ("n", "first", "last")}
    out: dict[str, list] = {"n": [], "first": [], "last": []}
    for data in asked["cells"].to_pylist():
        cells = _unpack_cells(data)
        at = np.minimum(np.searchsorted(have, cells), max(len(have) - 1, 0))
        hit = have[at] == cells if len(have) else np.zeros(len(cells), bool)
        for c, x in counts.items():
            out[c].append(_pack(np.where(hit, x[at], 0)) if x is not None else None)
    return pa.table([asked[c] for c in ("block", "word", "bucket")] + [pa.array(out[c], pa.binary()) for c in ("n", "first", "last")], names=[c.split()[0] for c in ANSWER.split(", ")])


def _answers(table: pa.Table, word: bool, size: int) -> list[np.ndarray]:
    """n, first and last of all cells of a block, joined from the buckets."""
    rows = sorted((r for r in table.to_pylist() if r["word"] == word), key=lambda r: r["bucket"])
    out = []
    for c in ("n", "first", "last"):
        got = [_unpack(r[c]).astype(np.int64) for r in rows if r[c] is not None]
        out.append(np.concatenate(got) if got else np.zeros(size, np.int64))
    return out


# --- classes ----------------------------------------------------------------------


class Classes:
    """Class of each word by its cell: the commonest have one each, the rest share the others by
    the count of their cell of a sketch, in equal shares of their mass."""

    OWN = (CLASSES - 1) * 3 // 4

    def __init__(self, counts: DataFrame):
        own = self.OWN

        def summary(batches):
            sketch, texts, cells, n = setjoin.Sketch(), 0, [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for b in batches:
                for r in b.to_pylist():
                    c, m = _unpack_cells(r["cells"]), _unpack(r["n"])
                    sketch.counts += np.bincount(setjoin.cells(c), m, setjoin.SKETCH).astype(np.int64)
                    texts += int(_unpack(r["first"]).sum())
                    best = np.lexsort((c, -m.astype(np.int64)))[:own]
                    cells.append(c[best])
                    n.append(m[best])
            cells, n = np.concatenate(cells), np.concatenate(n)
            block, data = sketch.rows()
            k, m = len(cells), len(block)
            nothing = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.array([*cells.tolist(), *[None] * (m + 1)], pa.int64()), pa.array([*n.tolist(), *[None] * (m + 1)], pa.int64()), pa.concat_arrays([nothing(k + m, pa.int64()), pa.array([texts], pa.int64())]),
                 pa.array([*[None] * k, *block, None], pa.int32()), pa.array([*[None] * k, *data, None], pa.binary())],
                ["cell", "n", "texts", "block", "counts"],
            )

        found = written(counts.where("word").mapInArrow(summary, "cell long, n long, texts long, block int, counts binary"), "summary")
        self.texts = found.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
        top = found.where("cell is not null").orderBy(F.desc("n"), "cell").limit(own).collect()
        mass = setjoin.summed(found.where("block is not null").select("block", "counts"), setjoin.SKETCH).astype(np.float64)
        keys = np.array([r["cell"] for r in top], np.int64).view(np.uint64)
        np.subtract.at(mass, setjoin.cells(keys), np.array([r["n"] for r in top], float))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        down = np.argsort(-mass, kind="stable")
        share = (np.cumsum(mass[down]) - mass[down] / 2) / max(mass.sum(), 1.0)
        rest = CLASSES - 1 - own
        self.of_cell = np.empty(setjoin.SKETCH, np.uint8)
        self.of_cell[down] = np.where(mass[down] > 0, own + 1 + np.minimum((share * rest).astype(np.int64), rest - 1), CLASSES - 1)
        self.room = np.ones(CLASSES)
        shared = counts.sparkSession.sparkContext.broadcast(self)

        def rooms(batches):
            total = np.zeros(CLASSES, np.int64)
            for b in batches:
                for r in b.to_pylist():
                    c, m = _unpack_cells(r["cells"]), _unpack(r["n"]).astype(np.int64)
                    total += np.bincount(shared.value(c), m + 1, CLASSES).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], ["class", "n"])

        # and one word more in each: any unseen one
        for r in counts.where("word").mapInArrow(rooms, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
            self.room[r["class"]] += r["n"]

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        cls = self.of_cell[setjoin.cells(cells)].astype(np.int64)
        if not len(self.keys):
            return cls
        own = np.minimum(np.searchsorted(self.keys, cells), len(self.keys) - 1)
        return np.where(self.keys[own] == cells, 1 + self.order[own], cls)

    def base(self, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P(word | class) by class and count."""
        return np.where(cls <= self.OWN, 0.0, np.log((n + 1.0) / np.maximum(self.room[cls], n + 1.0)))


class Network:
    """Embeddings of the four places, one tanh layer, softmax over classes."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 0.3, s)
        self.p = [g(COARSE, HIDDEN), g(CLASSES, HIDDEN), g(CLASSES, HIDDEN), g(COARSE, HIDDEN), g(HIDDEN, CLASSES), np.zeros(CLASSES)]
        a, b, c, d = np.unravel_index(np.arange(CONTEXTS), (COARSE, CLASSES, CLASSES, COARSE))
        self.places = (a, b, c, d)

    def hidden(self) -> np.ndarray:
        return np.tanh(sum(e[i] for e, i in zip(self.p[:4], self.places, strict=True)))

    def log_p(self) -> np.ndarray:
        """log P(class | context) for all contexts; no word is of class 0."""
        z = self.hidden() @ self.p[4] + self.p[5]
        z[:, 0] = -np.inf
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, counts: np.ndarray, steps: int = 120, rate: float = 0.05) -> list[float]:
        """Adam on the mean log-loss of all counted words; returns the losses."""
        n = counts.sum()
        if not n:
            return []
        met = np.flatnonzero(counts.sum(1))
        counts = (counts[met] / n).astype(np.float32)
        of, places = counts.sum(1, keepdims=True), [x[met] for x in self.places]
        # one-hot rows of the places turn sums over contexts into matrix products
        hot = [np.eye(len(e), dtype=np.float32)[i] for e, i in zip(self.p[:4], places, strict=True)]
        p = [x.astype(np.float32) for x in self.p]
        m, v, losses = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], []
        for t in range(1, steps + 1):
            h = np.tanh(sum(e[i] for e, i in zip(p[:4], places, strict=True)))
            z = h @ p[4] + p[5]
            z[:, 0] = -1e9
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            total = e.sum(1, keepdims=True)
            losses.append(float((of * np.log(total)).sum() - (counts[:, 1:] * z[:, 1:]).sum()))
            dz = e / total * of - counts
            dz[:, 0] = 0
            dh = dz @ p[4].T * (1 - h * h)
            grads = [x.T @ dh for x in hot] + [h.T @ dz, dz.sum(0)]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
        self.p = [x.astype(np.float64) for x in p]
        return losses


class Model:
    """``counts``: COUNTS, a table as large as the corpus asks for."""

    def __init__(self, counts: DataFrame, layout: Layout, cls: Classes, coarse: np.ndarray, log_p: np.ndarray, losses: list[float]):
        self.counts, self.layout, self.cls, self.coarse, self.log_p, self.losses = counts, layout, cls, coarse, log_p, losses

    def words(self) -> DataFrame:
        """(cell, n) of all words."""

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(_unpack_cells(r["cells"]).view(np.int64)), pa.array(_unpack(r["n"]).view(np.int64))], ["cell", "n"])

        return self.counts.where("word").mapInArrow(run, "cell long, n long")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count over all texts, then train."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"))
    layout = Layout(int(rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]))
    counts = written(rows.mapInArrow(_tally(layout), COUNTS).groupBy("word", "bucket").applyInArrow(_summed, COUNTS), "counts")
    classes = Classes(counts)
    coarse = np.concatenate(([0], 1 + np.arange(CLASSES - 1) * (COARSE - 1) // (CLASSES - 1)))
    shared = spark.sparkContext.broadcast((classes, coarse))

    def joint(batches):
        classes, coarse = shared.value
        met = np.zeros(CONTEXTS * CLASSES, np.int64)
        for b in batches:
            buf, bounds = kernel.buffers(b.column(0))
            for i, j in kernel.chunks(bounds):
                w = kernel.Words(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                c = classes(layout.cells(w.hash))
                met += np.bincount(_context(w, c, coarse) * CLASSES + c, minlength=CONTEXTS * CLASSES)
        block, data = setjoin.block_rows(met)
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["block", "counts"])

    met = setjoin.summed(rows.mapInArrow(joint, "block int, counts binary"), CONTEXTS * CLASSES).astype(np.float64)
    net = Network()
    losses = net.train(met.reshape(CONTEXTS, CLASSES))
    return Model(counts, layout, classes, coarse, net.log_p().astype(np.float32), losses)


def _score(shared, keep: list[str], fitted: bool):
    own = int(fitted)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        layout, classes, coarse, log_p = shared.value
        w = _words(block["_texts"][0].as_py(), block["_sizes"][0].as_py())
        words, of, pairs, of_pair, left_at = _asked(w, layout)
        n, first, last = (x[of] for x in _answers(found, True, len(words)))
        met = _answers(found, False, len(pairs))[0][of_pair]
        c = classes(words)[of]
        base = np.exp(log_p[_context(w, c, coarse), c] + classes.base(c, n))
        # of each word: how often it stands beside this neighbour, and how often the neighbour has one
        with_left, left, with_right, right = first.copy(), np.full(len(n), classes.texts), last.copy(), np.full(len(n), classes.texts)
        with_left[left_at + 1], left[left_at + 1] = met, (n - last)[left_at]
        with_right[left_at], right[left_at] = met, (n - first)[left_at + 1]
        side = lambda a, b: (np.maximum(a - own, 0) + MU * base) / (np.maximum(b - own, 0) + MU)
        lp = np.log((side(with_left, left) + side(with_right, right)) / 2)
        size = np.diff(w.first)
        total = np.bincount(w.row, lp, minlength=len(size)).astype(np.float64)
        mean = pa.array(total / np.maximum(size, 1), mask=size == 0)
        rows = block["_rows"].combine_chunks().flatten()
        columns = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
        return pa.table([*[columns[k] for k in keep], pa.array(size), pa.array(total), mean], names=[*keep, "n_words", "log_likelihood", "mean_log_likelihood"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, fitted: bool = False) -> DataFrame:
    """``keep`` columns (default: all) with n_words, log_likelihood and its mean per word,
    which replace columns of these names.  ``fitted``: the texts are those of the model, so
    each word is left out of the pair counts it is predicted from."""
    own = ("n_words", "log_likelihood", "mean_log_likelihood")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    ship(docs.sparkSession)
    x = docs.select(F.col(text).alias("_text"), *keep, *([] if keep else [F.lit(True).alias("_row")]))
    schema = extended(x.select("_text", *keep), 1, "n_words long, log_likelihood double, mean_log_likelihood double")
    rows = ArrayType(StructType([StructField(f.name, f.dataType) for f in x.schema.fields[1:]]))
    block = StructType([*StructType.fromDDL("_block long, _texts binary, _sizes binary").fields, StructField("_rows", rows)])
    dealt = written(x.mapInArrow(_deal, block), "blocks")
    asked = dealt.select("_block", "_texts", "_sizes").mapInArrow(_ask(model.layout), "block long, word boolean, bucket int, cells binary")
    answers = asked.groupBy("word", "bucket").cogroup(model.counts.groupBy("word", "bucket")).applyInArrow(_answer, ANSWER)
    shared = docs.sparkSession.sparkContext.broadcast((model.layout, model.cls, model.coarse, model.log_p))
    return dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(_score(shared, keep, fitted), schema)
