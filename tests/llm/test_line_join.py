"""The line join: which lines are looked at again, which sets meet, what stays open."""

import numpy as np
import pyarrow as pa
import pytest

from ferngraph.llm import line_dedup


def test_words_of_lines_that_no_pair_names_are_not_looked_up(monkeypatch):
    import types

    from ferngraph.llm import kernel

    texts = ["a b c\nd e", None, "f g h i\n\na b c", "j"]
    wanted = types.SimpleNamespace(value=types.SimpleNamespace(has=lambda places: np.isin(places, [1, (2 << 4) | 2])))
    seen, plain = [], kernel.Words

    def words(buf, bounds, *more, **options):
        seen.append(bytes(buf))
        return plain(buf, bounds, *more, **options)

    monkeypatch.setattr(kernel, "Words", words)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([0, 1, 2, 3])], ["t", "i"])
    got = pa.Table.from_batches(line_dedup._sets(4, wanted)([batch])).to_pydict()
    assert (got["set"], got["n"]) == ([1, (2 << 4) | 2], [2, 3])
    assert seen == [b"d ea b c"]


def _bucket(rng, sizes):
    """Postings of one element, first of all sets of such sizes, that no bitmap tells apart."""
    from ferngraph.llm import setjoin

    p = np.zeros(len(sizes), setjoin.RECORD)
    p["set"], p["ord"], p["n"] = np.arange(len(sizes)) + 1, rng.permutation(len(sizes)), sizes
    return p


def test_sets_of_unlike_sizes_hardly_meet(monkeypatch):
    from ferngraph.llm import setjoin

    tested, plain = [], setjoin.passes

    def passes(p, i, j, num, den):
        tested.append(len(i))
        return plain(p, i, j, num, den)

    monkeypatch.setattr(setjoin, "passes", passes)
    p = _bucket(np.random.default_rng(1), 2 ** np.arange(30).repeat(2))
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([p.tobytes()])], ["bucket", "data"])
    got = pa.Table.from_batches(setjoin._runs(3, 4, 5, False, 1024)([batch])).to_pydict()
    # those of equal size, earlier first, and nothing is left open
    order = p["ord"].reshape(30, 2)
    assert sorted(zip(got["a"], got["b"], strict=True)) == sorted(zip(order.min(1).tolist(), order.max(1).tolist(), strict=True))
    assert sum(tested) == 30


@pytest.mark.parametrize("near, reach", [(64, 1024), (2, 1024), (2, 3), (1, 1)])
def test_what_a_run_leaves_untried_is_open(monkeypatch, near, reach):
    from ferngraph.llm import setjoin

    monkeypatch.setattr(setjoin, "NEAR", near)
    monkeypatch.setattr(setjoin, "STEP", 7)
    rng = np.random.default_rng(2)
    for _ in range(30):
        p = _bucket(rng, rng.integers(5, 30, 60))
        p["key"], p["bits"] = rng.integers(0, 3, 60), rng.integers(0, 1 << 63, 60) >> 50
        p["pos"] = rng.integers(0, p["n"] - -(-p["n"] * 4 // 5) + 1)
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([p.tobytes()])], ["bucket", "data"])
        got = pa.Table.from_batches(setjoin._runs(2, 4, 5, False, reach)([batch])).to_pylist()
        pairs = {(r["a"], r["b"]) for r in got if r["a"] is not None}
        kept = {(r["key"], r["ord"]) for r in got if r["key"] is not None}
        is_open = {(r["key"], r["ord"]) for r in got if r["open"]}
        i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
        same = (p["key"][i] == p["key"][j]) & (p["ord"][i] < p["ord"][j])
        i, j = i[same], j[same]
        ok = setjoin.passes({x: np.ascontiguousarray(p[x]) for x in setjoin.NAMES}, i, j, 4, 5)
        want = {(int(p["ord"][x]), int(p["ord"][y])): int(p["key"][y]) for x, y in zip(i[ok], j[ok], strict=True)}
        assert pairs <= set(want)
        for (a, b), k in want.items():
            assert (a, b) in pairs or ((k, b) in is_open and (k, a) in kept)


def test_later_copies_of_a_line_do_not_remove_its_first(spark, monkeypatch):
    from ferngraph.llm import setjoin

    # every element is a frequent one; copies come in other tasks and batches than the first
    monkeypatch.setattr(setjoin, "HOT", 0)
    x, y = "a b c d e f g h i j", "a b c d e f g h i k"
    rows = [(0, x), *[(i, f"q{i} r{i}") for i in range(1, 5)], (5, y), *[(i, f"q{i} r{i}") for i in range(6, 10)], (10, x)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(11, "doc_id")
        got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {**dict(rows), 5: "", 10: ""}


@pytest.mark.parametrize("most", [3, 20, 200])
def test_loaded_hashes_tell_words_apart(most):
    from ferngraph.llm import kernel

    rng = np.random.default_rng(most)
    texts = ["".join(rng.choice(list("aAbZz@[`{é\0 \n"), n)) for n in rng.integers(0, 3 * most, 300)] + ["a" * k for k in range(130)] + ["a" * 63 + "b", "\0", "\0\0", "a\0"]
    buf, bounds = kernel.buffers(pa.array(texts))
    one, other = kernel.Words(buf, bounds), kernel.Words(buf, bounds, loaded=True)
    assert (one.start == other.start).all() and (one.row == other.row).all() and (one.first == other.first).all()
    low = [bytes(buf[a:b]).lower() for a, b in zip(one.start, one.end, strict=True)]
    assert len(set(low)) == len(set(other.hash.tolist())) == len(set(zip(low, other.hash.tolist(), strict=True)))
