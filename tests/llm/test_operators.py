"""Each operator on small tables: brute force, nulls, empties, repeats, clashing names."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferngraph.llm import chat_tree, chroma, langid, line_dedup, masked_lm, mixing, ngram_join, secrets, templates, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + rng.choice("aeiou") + rng.choice("xyz") for _ in range(n))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(12)]
    rows = []
    for i in range(60):
        w = base[i % 12].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w[:30]) + "\n" + " ".join(w[30:]), "en", f"s{i % 3}"))
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, "  \n ", "en", "s1"), (103, "one two", "en", "s1"), (104, "ONE  two", "en", "s2"), (0, rows[0][1], "en", "s0"), (None, "x y z", "fr", None), (105, "w " * 3000 + base[0], "en", "s0")]
    return rows


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5), (1, 1, 2)])
def test_ngram_join(spark, small, k, num, den):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, small), k=k, num=num, den=den).collect()}
    sets = [shingles(t, k) for _, t, _, _ in small]
    comp = list(range(len(small)))
    for i in range(len(small)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    want = set()
    for i, (d, _, _, _) in enumerate(small):
        ids = [small[x][0] for x in range(len(small)) if comp[x] == comp[i] and small[x][0] is not None]
        want.add((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    assert got == want


def test_ngram_join_empty(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    assert ngram_join.first_of_each(docs(spark, [(1, None, None, None), (2, "", None, None)])).count() == 2


def test_elements_of_large_sets_move_only_for_likely_pairs(spark, monkeypatch):
    from ferngraph.llm import setjoin

    # each text shares half its words with either neighbour in a ring; the last is nearly the first
    words = [[f"p{part}w{i}" for i in range(1000)] for part in range(6)]
    rows = [(i, " ".join(words[i] + words[(i + 1) % 6]), "en", "s") for i in range(6)]
    rows.append((6, rows[0][1].replace("p0w500 ", ""), "en", "s"))
    moved, once = [], setjoin.once

    def seen(sets):
        out = once(sets)
        moved.extend(r.set for r in out.select("set").collect() if "elements" in out.columns)
        return out

    monkeypatch.setattr(setjoin, "once", seen)
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs(spark, rows)).collect()}
    assert got == {i: i % 6 for i in range(7)}
    assert len(moved) == 2


def test_bitmaps_never_tell_too_much():
    from ferngraph.llm import setjoin

    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 900, 1023, 1025):
        a = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        for m in (0, n // 10, n // 2, n):
            b = np.unique(np.concatenate((a[m:], rng.integers(0, 1 << 48, m + n // 9, dtype=np.uint64))))
            if len(b):
                # rows 0 and 2 aren't asked for
                got = setjoin.map_rows(np.concatenate((a, b)), np.repeat([1, 3], [len(a), len(b)]), np.arange(4), np.array([1, 3]))
                assert got["set"].to_pylist() == [1, 3] and got["n"].to_pylist() == [len(a), len(b)]
                u, v = (np.frombuffer(x.as_buffer(), np.uint64) for x in got["map"])
                assert setjoin.apart(u, v) <= len(np.setxor1d(a, b)) and setjoin.apart(u, u) == 0


@pytest.mark.parametrize("hot", [1 << 15, 10, 0])
def test_long_runs_are_settled(spark, monkeypatch, hot):
    from ferngraph.llm import setjoin

    monkeypatch.setattr(setjoin, "REACH", 4)
    monkeypatch.setattr(setjoin, "HOT", hot)
    rng = random.Random(3)
    base = prose(rng, 80).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(80)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(w), "en", "s"))
    test_ngram_join(spark, rows, 1, 9, 10)
    test_line_dedup(spark, rows)


def test_line_dedup(spark, small):
    df = docs(spark, small).withColumns({"row": F.lit(1), "_removed": F.lit("x"), "set": F.lit(2)})
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup(df).collect()), key=repr)
    seen, want = [], []
    order = sorted(range(len(small)), key=lambda i: (small[i][0] is None, small[i][0] if small[i][0] is not None else 0, i))
    first = {}
    for i in order:
        d, t, _, _ = small[i]
        if t is None:
            want.append((d, None, 0))
            continue
        key = (d, t)
        if key not in first:
            out = []
            for line in t.split("\n"):
                s = shingles(line, 1)
                if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    seen.append(s)
                    continue
                if s:
                    seen.append(s)
                out.append(line)
            first[key] = "\n".join(out)
        want.append((d, first[key], len(t)))
    assert got == sorted(want, key=repr)


def test_line_dedup_orders_any_ids(spark):
    x, y = "a b c d e f g h i j", "a b c d e f g h i k"
    rows = [("b", f"{x}\n{y}"), ("a", y), (None, x), ("c", "z"), ("c", "z\nq")]
    df = spark.createDataFrame(rows, "k string, text string")
    got = sorted(((r.k, r.text) for r in line_dedup.dedup(df, "k").collect()), key=repr)
    assert dict(got)["a"] == y
    kept = [t for k, t in got if k == "c"]
    # of two rows of one id, one keeps the line they share
    assert sorted("z" in t.split("\n") for t in kept) == [False, True]
    assert dict(got)["b"] == "" and dict(got)[None] == ""
    big = spark.createDataFrame([(1 << 62, x), (-(1 << 62), y)], "k long, text string")
    assert {r.k: r.text for r in line_dedup.dedup(big, "k").collect()} == {1 << 62: "", -(1 << 62): y}


def test_mix_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(i, "w " * 5, "s", 99) for i in range(4)], "doc_id long, text string, source string, copies long")
    assert {r.copies for r in mixing.mix_documents(df).collect()} == {1}


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 200])), "en", rng.choice(["a", "b", "c", None])) for i in range(900)]
    rows += [(7, "w w", "en", "a")] * 50 + [(5000, None, "en", "z")]
    df = docs(spark, rows).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    got = mixing.mix(df, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    total = sum(r["size"] for r in got)
    per = {}
    for r in got:
        p = per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        p[2] += r.taken
        p[3] += r["size"]
    assert abs(sum(p[1] for p in per.values()) - total) < 1e-6 * total
    for s, (size, target, taken, own) in per.items():
        assert size == own and target <= 3 * size + 1e-9 and abs(taken - target) <= max(1, 0.01 * target) + 10, (s, target, taken)
    again = mixing.mix(df.repartition(3), ["doc_id"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    whole = mixing.mix_documents(docs(spark, rows))
    assert all(r.copies > 0 for r in whole.collect())
    assert mixing.mix(df.where("false"), ["doc_id"]).count() == 0


def test_capped_targets(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), ("d", 0)], "source string, size long")
    t = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    # weights 5, 2, 1, 5: a stops at 3, d at 0, the rest is shared 2 : 1
    assert t["a"] == 3 and t["d"] == 0 and abs(t["b"] - 132) < 1e-9 and abs(t["c"] - 66) < 1e-9


def test_langid(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    held = langid.fold(F.col("doc_id")) == 1
    model = langid.fit(d.where(~held))
    got = langid.identify(d.where(held).withColumn("score", F.lit("x")), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 ½ _"), (4, "the of and with")], "i long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(odd, key=lambda r: r.i)][:3] == ["und"] * 3
    none = langid.fit(d.where("false"))
    assert {r.lang_pred for r in langid.identify(d.limit(3), none).collect()} == {"und"}


def test_secret_ledger(spark):
    v = spark.createDataFrame([(1, "token=abcdefghijklmnop"), (2, "token=abcdefghijklmnop"), (3, None), (4, "AKIA" + "Z" * 16)], "doc_id long, text string")
    found = secrets.scan(secrets.blobs_of(v))
    by = {r.doc_id: [(s.rule, s.start, s.end) for s in r.spans or []] for r in secrets.by_path(v, "doc_id", found).collect()}
    assert by == {1: [("assign", 0, 22)], 2: [("assign", 0, 22)], 3: [], 4: [("access", 0, 20)]}
    ledger = secrets.new_ledger(found)
    assert ledger.count() == 3 * len(secrets.RULES)
    assert secrets.scan(secrets.blobs_of(v), ledger).count() == 0
    newer = (secrets.Rule("hex", 2, r"[0-9a-f]{20,}"),)
    assert {r.rule for r in secrets.scan(secrets.blobs_of(v), ledger, newer).collect()} == {"hex"}


def test_templates(spark):
    bench = spark.createDataFrame([(1, "A train leaves Paris with 30 people and travels 120 km before it stops near Lyon."), (2, "tiny item"), (3, None)], "item_id long, text string")
    rows = [
        (1, "Intro. A train leaves Paris with 45 people and travels 260 km before it stops near Nice. End.", "en", "s"),
        (2, "A train leaves Paris with 30 people. More follow now.", "en", "s"),
        (3, "tiny item", "en", "s"),
        (4, None, None, None),
        (5, "", "en", "s"),
        (6, "Quite other words stand here, with 30 people and 120 km of road to go before noon today.", "en", "s"),
    ]
    df = docs(spark, rows).withColumn("_hits", F.lit(1))
    got = {r.doc_id: r.h for r in templates.find(docs(spark, rows), bench).select("doc_id", F.explode("_hits").alias("h")).collect()}
    assert set(got) == {1} and got[1]["item"] == 1 and got[1]["changed"]
    assert {r.doc_id for r in templates.clean(df, bench).collect()} == {2, 3, 4, 5, 6}
    # the index in several passes gives the same
    assert templates.find(docs(spark, rows), bench, index_rows=3).select("doc_id", F.explode("_hits.item")).collect() == [(1, 1)]


def test_template_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "if you add 5 apples to 5 pears you then have 10 pieces of fruit")], "item_id long, text string")
    rows = [(1, "if you add 7 apples to 7 pears you then have 14 pieces of fruit", "en", "s"), (2, "if you add 7 apples to 8 pears you then have 15 pieces of fruit", "en", "s")]
    got = {r.doc_id: r.w for r in templates.find(docs(spark, rows), bench).select("doc_id", F.explode("_hits.windows").alias("w")).collect()}
    assert got[1] > got.get(2, 0)


def test_template_slots_that_contradict_are_no_hit(spark):
    bench = spark.createDataFrame([(1, "if you add 5 apples to 5 pears you then have 10 pieces of fruit")], "item_id long, text string")
    head = "if you add {} apples to {} pears you then have {} pieces of fruit"
    rows = [(k, head.format(*v), "en", "s") for k, v in enumerate([(5, 5, 10), (7, 7, 14), (7, 8, 15), (7, 7, 7)])]
    # one value for another inside a window, then against another window
    rows.append((4, "you add 7 apples to 8 pears you then", "en", "s"))
    found = templates.find(docs(spark, rows), bench).select("doc_id", F.explode("_hits").alias("h")).collect()
    assert {r.doc_id: r.h.changed for r in found} == {0: False, 1: True}
    assert {r.doc_id for r in templates.clean(docs(spark, rows), bench).collect()} == {2, 3, 4}


def test_template_windows_of_few_plain_words_are_found_exactly(spark):
    items = ["What is 15% of 80?", "Anna Berg, Carl Dahl, Emil Falk, Greta Holm", "Each of the boxes weighs 3 kg", "Alpha is the first letter"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [
        "He asked: what is 15% of 80? Nobody knew.",
        "He asked What is 15% of 80 and left.",
        "What is 25% of 60?",
        "Present were Anna Berg, Carl Dahl, Emil Falk, Greta Holm and others.",
        "Present were Anna Berg, Carl Dahl, Emil Falk, Karin Holm and others.",
        "It says Each of the boxes weighs 9 kg there.",
        "They teach that Alpha is the first letter of it.",
        "They teach that Gamma is the first letter of it.",
    ]
    found = templates.find(docs(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), bench).select("doc_id", F.explode("_hits").alias("h")).collect()
    assert {(r.doc_id, r.h.item, r.h.windows, r.h.changed) for r in found} == {(0, 0, 1, False), (1, 0, 1, False), (3, 1, 1, False), (5, 2, 1, True), (6, 3, 1, False)}
    # an item's window that begins with a name, where the document begins a sentence
    bench = spark.createDataFrame([(1, "the town of Lyon is where both of the rivers meet in spring")], "item_id long, text string")
    df = docs(spark, [(1, "We went. Lyon is where both of the rivers meet, he said.", "en", "s")])
    assert templates.find(df, bench).select("doc_id", F.explode("_hits.item")).collect() == [(1, 1)]


def test_masked_lm(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = masked_lm.fit(d)
    assert model.losses[-1] < model.losses[0]
    odd = spark.createDataFrame([(-1, None), (-2, " ")], "doc_id long, text string")
    got = {r.doc_id: r for r in masked_lm.score(d.unionByName(odd), model).collect()}
    assert got[-1].n_words == 0 and got[-1].mean_log_likelihood is None and got[-2].log_likelihood == 0
    row = d.where("length(text) > 200").first()
    words = row.text.split()
    random.Random(0).shuffle(words)
    mixed = masked_lm.score(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), model).first()
    assert got[row.doc_id].n_words == len(words) and mixed.n_words == len(words)
    again = masked_lm.fit(d.repartition(5))
    assert [round(x, 5) for x in again.losses] == [round(x, 5) for x in model.losses]
    assert masked_lm.fit(d.where("false")).losses == []


def test_masked_lm_tells_words_of_a_class_apart(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    after = dict(zip(words[0::2], words[1::2], strict=True))
    # all words are equally frequent, and each even one comes before its odd one
    rows = []
    for _ in range(30):
        even = words[0::2]
        rng.shuffle(even)
        rows.append((len(rows), " ".join(f"{w} {after[w]}" for w in even)))
    model = masked_lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.words().agg(F.count("*"), F.sum("n")).first()[:] == (400, 12000)
    texts = [(1, "w100 w101 w200 w201"), (2, "w100 w201 w200 w101"), (3, "w100 w101 w200 unseen")]
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got[1] > got[2] + 2 and got[1] > got[3] + 2
    # a text that occurs once more is told apart from one that occurs once
    twice = [(k, " ".join(f"u{k}x{i}" for i in range(20))) for k in (1, 2)] + [(3, " ".join(f"u1x{i}" for i in range(20)))]
    df = spark.createDataFrame([*twice, *((k + 10, t) for k, t in rows)], "doc_id long, text string")
    own = {r.doc_id: r.mean_log_likelihood for r in masked_lm.score(df, masked_lm.fit(df), fitted=True).collect()}
    assert own[1] == own[3] > own[2] + 0.5


def test_chroma(spark):
    rng = random.Random(2)
    tune = bytes(rng.randrange(256) for _ in range(6000))
    other = bytes(rng.randrange(256) for _ in range(6000))
    rows = [(0, tune), (1, tune), (2, other), (3, other[:640] + tune[640:]), (4, b""), (5, None), (100, tune[320:])]
    df = spark.createDataFrame(rows, "k long, media binary")
    got = {r.k: r for r in chroma.search(df, "k", F.col("media"), F.col("k") % 100 == 0).collect()}
    assert got[1].class_id == 0 and got[4].n_ints == 0 and got[4].matches is None and got[5].n_ints == 0
    near = {m["query"]: m for m in got[3].matches}
    assert near[0]["offset"] == 0 and near[100]["offset"] == 10 and near[0]["bit_error"] < 0.15
    assert got[2].matches is None or all(m["bit_error"] > 0.1 for m in got[2].matches)


def test_chroma_of_short_recordings(spark):
    rng = random.Random(3)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    long, short, tiny = noise(6000), noise(600), noise(200)
    # a short query against a long recording and the other way round, at any place
    rows = [(0, short), (1, short[:500] + noise(60)), (2, long), (100, long[1600:2048]), (3, tiny), (200, tiny), (201, tiny[:199] + b"x"), (300, long), (4, long[3200:3648]), (5, noise(200)), (6, noise(600))]
    got = {r.k: r for r in chroma.search(spark.createDataFrame(rows, "k long, media binary"), "k", F.col("media"), F.col("k") % 100 == 0).collect()}
    found = {(k, m["query"]): m["offset"] for k, r in got.items() for m in r.matches or []}
    assert found[1, 0] == 0 and found[2, 100] == 50 and found[4, 300] == -100
    assert got[3].class_id == got[200].class_id == 3 and got[3].n_ints == 2
    assert (5, 200) not in found and (6, 0) not in found


def test_chroma_tries_each_offset(spark):
    rng = np.random.default_rng(6)
    b = rng.integers(0, 2**32, 400, dtype=np.uint32)
    a = b ^ np.uint32(1)
    a[300:315], a[350:365] = b[300:315], b[350:365]
    a[10:50] = b[200:240]  # most votes stand for this offset, where all else differs
    df = spark.createDataFrame([(1, a.tobytes()), (2, b.tobytes())], "class long, ints binary")
    got = chroma.align(df.where("class = 1"), df).collect()
    assert [(r["query"], r["class"], r["offset"]) for r in got] == [(1, 2, 0)]


def test_chat_tree(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> b"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 2, "user", "<\\|"), (3, 0, "user", "hi"), (None, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, leaves = chat_tree.build(df)
    ns = {r.node: r for r in nodes.collect()}
    assert len(ns) == 5 and leaves.count() == 4
    starts = sorted((r.start, r.start + r.units) for r in ns.values())
    assert starts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    for r in ns.values():
        up = [ns[a] for a in r.ancestors]
        assert r.position == sum(a.units for a in up) and sum(x["end"] - x["start"] for x in r.attends) == r.position
        assert r.parent is None or ns[r.parent].start < r.start
    got = {r.conv_id: r for r in chat_tree.read_back(nodes, leaves).collect()}
    for c in (1, 2, 3, None):
        turns = [((r or ""), (t or "")) for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_tree.read_back(*chat_tree.build(df.where("false"))).count() == 0


def test_chat_tree_shares_turns_at_any_depth(spark):
    n = chat_tree.MAX_DEPTH
    base = [("assistant" if k % 2 else "user", f"t{k} <|im_end|>") for k in range(n + 40)]
    convs = {1: [*base, ("user", "x")], 2: [*base, ("user", "y"), ("assistant", "z")], 3: base[: n + 20], 4: base[: n - 1], 5: base[:n], 6: [*base[: n + 30], ("user", "x")], None: [*base, ("user", "x")]}
    df = spark.createDataFrame([(c, k, *t) for c, ts in convs.items() for k, t in enumerate(ts)], "conv_id long, turn long, role string, text string").repartition(5)
    nodes, leaves = chat_tree.build(df)
    ns = {r.node: r for r in nodes.collect()}
    once = {tuple(ts[: k + 1]): len(chat_tree.turn(*ts[k])[0]) for ts in convs.values() for k in range(len(ts))}
    assert sum(r.units for r in ns.values()) == sum(once.values())  # each shared turn once
    starts = sorted((r.start, r.start + r.units) for r in ns.values())
    assert starts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    for r in ns.values():
        up = [ns[a] for a in r.ancestors]
        assert r.position == sum(a.units for a in up) and r.depth == len(up) and r.parent == (r.ancestors[-1] if up else None)
        assert sum(x["end"] - x["start"] for x in r.attends) == r.position
    got = {r.conv_id: r for r in chat_tree.read_back(nodes, leaves).collect()}
    assert len(got) == len(convs)
    for c, ts in convs.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert got[c].n_turns == len(ts) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary")
def test_chat_tokens(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello <|im_start|> there"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    path, pattern = "/opt/tokenizers/byte_bpe_50k.tiktoken", r"\s?\S+|\s+"
    nodes, _ = chat_tree.build(df, tokenizer=(path, pattern))
    enc = chat_tree._encoder(path, pattern)
    for r in nodes.collect():
        assert enc.decode(r.tokens) == r.segment and r.units == len(r.tokens)
        assert r.tokens.count(enc.encode("<|im_start|>", allowed_special="all")[0]) == 1


def test_urls(spark):
    rules = urls.rules("block com/en/", "allow example.com/en/7", "allow net/de/", "block org/es/")
    rows = ["http://A.Example.COM/en/5?x=/de/", "https://example.com/en/77#t", "https://notexample.com/en/77", "x.net/de/1", "ftp://q.net/de/1", None, "", "http://h?y://z/en/", "https://a.org/fr/3", "https://a.org/fr/3"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert got[0][:4] == ("a.example.com", "/en/5", "com/en/", "block")
    assert got[1] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][:3] == ("", "", None) and got[4][2:] == ("net/de/", "allow")
    assert got[5][:3] == ("", "", None) and got[7][:3] == ("h", "", None) and got[8] == got[9]
    assert urls.judge(df.where("false"), rules).count() == 0


def test_url_trees_learn(spark):
    rows = [(f"http://h{i}.{'com' if i % 2 else 'org'}/a/{'1' * (i % 9)}?{'&'.join(['k=v'] * (i % 5))}", int(i % 5 >= 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "url string, label int")
    model = urls.fit(df)
    got = model.score(df).collect()
    assert sum((r._score >= 0.5) == bool(r.label) for r in got) >= 0.95 * len(got)
