"""Language identification: multinomial naive Bayes over hashed character n-grams.

Defined results: null text, empty text and text without a letter give ``und`` with
score 0; without any labelled text every row gives ``und``.  Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.llm import kernel
from ferngraph.session import extended, ship

ORDERS = (1, 2, 3)
#: The model is fitted on at most about so many labelled rows of each language, chosen by hash.
FIT_ROWS = 4000
#: The broadcast matrix holds at most so many numbers; with more languages there are fewer buckets.
MATRIX_CELLS = 16_000_000
_SEPARATORS = "\x00" * max(ORDERS)
_LETTER = None


def _classes() -> np.ndarray:
    """Code point -> itself for letters, 32 for all else (of the first 65,536)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([c if chr(c).isalpha() else 32 for c in range(65536)], np.uint64)
        _LETTER[0] = 0
    return _LETTER


def _positions(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by separators; start and end of each text."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    start = np.concatenate(([0], np.cumsum(size + len(_SEPARATORS))[:-1]))
    code = np.frombuffer((_SEPARATORS.join(low) + _SEPARATORS).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = code < 65536
    code = np.where(small, _classes()[np.where(small, code, 0)], code.astype(np.uint64))
    return code, start, start + size


def _buckets(code: np.ndarray, order: int, bits: int) -> np.ndarray:
    n = len(code) - max(ORDERS) + 1
    h = np.full(n, np.uint64(order))
    for j in range(order):
        h = h + code[j : j + n] * kernel.GRAM_MULT[j]
    return ((h * kernel.GRAM_MULT[60]) >> np.uint64(64 - bits)).astype(np.int32)


def _batches(texts: list[str], size: int = 1 << 20):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= size):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def _count(langs: list[str], bits: int):
    at = {x: i for i, x in enumerate(langs)}

    def run(batches):
        total = {}
        for b in batches:
            texts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _batches(texts):
                code, start, end = _positions(texts[i:j])
                own = np.zeros(len(code), bool)
                lang = np.zeros(len(code), np.int32)
                for k in range(j - i):
                    own[start[k] : end[k]] = True
                    lang[start[k] : end[k]] = at[names[i + k]]
                for o in ORDERS:
                    v = _buckets(code, o, bits)
                    ok = own[: len(v)]
                    key = lang[: len(v)][ok].astype(np.int64) << bits | v[ok]
                    total[o] = total.get(o, 0) + np.bincount(key, minlength=len(langs) << bits)
        if total:
            c = sum(total.values())
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array((k >> bits).astype(np.int32)), pa.array((k & ((1 << bits) - 1)).astype(np.int32)), pa.array(c[k].astype(np.int64))], ["l", "b", "n"])

    return run


class Model:
    """Languages and a (language, bucket) matrix of log-probabilities, with log-priors."""

    def __init__(self, langs: list[str], bits: int, weights: np.ndarray, prior: np.ndarray):
        self.langs, self.bits, self.weights, self.prior = langs, bits, weights, prior


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on rows with a text and a language.  Every language is learned: of each, about
    ``fit_rows`` rows are taken by hash of the row (all, if it has no more)."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(*labelled.columns).alias("h"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], 1, np.zeros((0, 2), np.float32), np.zeros(0))
    bits = 16
    while bits > 8 and len(langs) << bits > MATRIX_CELLS:
        bits -= 1
    if len(langs) << bits > MATRIX_CELLS:
        raise ValueError(f"{len(langs)} languages are too many for one model")
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fit_rows / counts[k]))])[F.col("l")]
    sample = rows.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("t", "l")
    ship(labelled.sparkSession)
    got = sample.mapInArrow(_count(langs, bits), "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros((len(langs), 1 << bits))
    c[got["l"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    c += 0.5
    prior = np.array([counts[x] for x in langs], float)
    return Model(langs, bits, np.log(c / c.sum(1, keepdims=True)).astype(np.float32), np.log(prior / prior.sum()))


def _score(broadcast):
    def run(batches):
        m = broadcast.value
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            pred, score = [], []
            for i, j in _batches(texts):
                has = np.array([any(map(str.isalpha, t)) for t in texts[i:j]])
                if not len(m.langs):
                    has[:] = False
                code, start, end = _positions(texts[i:j])
                ids = [_buckets(code, o, m.bits) for o in ORDERS]
                cut = np.column_stack((start, end)).ravel()
                total = np.empty((j - i, len(m.langs)))
                for k in range(len(m.langs)):
                    w = m.weights[k]
                    at = w[ids[0]]
                    for v in ids[1:]:
                        at = at + w[v]
                    total[:, k] = np.add.reduceat(np.append(at, np.float32(0)), np.minimum(cut, len(at)), dtype=np.float64)[::2] + m.prior[k]
                if len(m.langs):
                    best = total.argmax(1)
                    p = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
                for k in range(j - i):
                    pred.append(m.langs[best[k]] if has[k] else "und")
                    score.append(float(p[k]) if has[k] else 0.0)
            out = [b.column(c) for c in range(1, b.num_columns)] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, b.schema.names[1:] + ["lang_pred", "score"])

    return run


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with lang_pred and score, which replace columns of these names."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shown = df.select(F.col(text).alias("_text"), *[F.col(c) for c in keep])
    ship(df.sparkSession)
    return shown.mapInArrow(_score(df.sparkSession.sparkContext.broadcast(model)), extended(shown, 1, "lang_pred string, score double"))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; null keys count as 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3, F.lit(0))
