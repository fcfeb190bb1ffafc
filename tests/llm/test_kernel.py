import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ferngraph.llm import chat_tree, kernel, secrets

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAb \n\té|<\\0.", max_size=30)), max_size=8)


def words(t):
    return (t or "").encode().lower().split()


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 5))
def test_words_and_grams(ts, k):
    buf, bounds = kernel.buffers(pa.array(ts, pa.string()))
    w = kernel.Words(buf, bounds)
    assert list(np.diff(w.first)) == [len(words(t)) for t in ts]
    flat = [x for t in ts for x in words(t)]
    by: dict = {}
    for h, x in zip(w.hash.tolist(), flat, strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    v, r = kernel.distinct(*kernel.grams(w.hash, w.first, w.row, k))
    want = [{tuple(x[i : i + k]) for i in range(len(x) - k + 1)} or ({tuple(x)} if x else set()) for x in map(words, ts)]
    size, ids = kernel.set_ids(v, r, len(ts))
    assert size.tolist() == [len(s) for s in want]
    for i in range(len(ts)):
        for j in range(len(ts)):
            if want[i]:
                assert (ids[i] == ids[j]) == (want[i] == want[j])


def test_chunks_cover_everything():
    bounds = np.array([0, 5, 5, 3_000_000, 3_000_001, 3_000_002])
    got = list(kernel.chunks(bounds))
    assert got[0][0] == 0 and got[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab\\n\n<|", max_size=6), st.text(alphabet="<\\|>im_startend\n ", max_size=25)), max_size=5))
def test_chat_round_trip(turns):
    assert chat_tree.parse("".join(chat_tree.turn(r, t)[0] for r, t in turns)) == turns


def test_secret_matches():
    assert secrets.find("password: short token=abcdefghijkl", secrets.BASE[0]) == [(16, 34)]
    # a match that is too short uses up its characters
    assert secrets.find("secret: token: abcdefghijklmn", secrets.BASE[0]) == []
    assert secrets.find('API_KEY" = "AAAAAAAAAAAA', secrets.BASE[0]) == [(0, 24)]
    assert secrets.find("xAKIA" + "A" * 14, secrets.BASE[1]) == [(1, 19)]
    assert secrets.find("0" * 16 + "g" + "f" * 15, secrets.BASE[2]) == [(0, 16)]
