"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import bit_sliced, chat, learned_partitions, licenses, packing, paragraphs, simhash, suffix_tree, toxicity, transducer_bpe

DOCS = "doc_id long, text string, source string, n long, key string, h long"
rng = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


BASE = prose(60)
TEXTS = [None, "", "one", "One TWO", "ÉA ÀB c d e", BASE, BASE, BASE.replace("w1 ", "w2 ", 1), prose(4000), prose(40) + "\n" + BASE, prose(30) + "\n" + BASE + " w3", "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "cc by cc by", "released   under the MIT license"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", i, "k", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None), (5, BASE, "s", 5, "k", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def test_suffix_tree(docs, empty):
    held = docs.withColumn("held", F.coalesce(F.col("doc_id") % 4 == 0, F.lit(True)))
    rows = held.collect()
    count, n = {}, 0
    for r in rows:
        for w in [] if r.held else [*split(r.text), "\n"]:
            count[w] = count.get(w, 0) + 1
            n += 1
    got = suffix_tree.score(held, least=2, gain=0.5).collect()
    assert len(got) == len(rows)
    for r in rows:
        tokens = [*split(r.text), "\n"]
        base = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (len(count) + 1))) for w in tokens)
        assert any(g.doc_id == r.doc_id and g.n_tokens == len(tokens) and g.train_tokens == n and g.n_known == sum(w in count for w in tokens) and abs(g.base_score - base) < 1e-6 for g in got)
    assert sum(g.score for g in got if not g.held_out) > sum(g.base_score for g in got if not g.held_out)
    assert suffix_tree.score(empty.withColumn("held", F.lit(False))).count() == 0


def brute_tree(rows, depth, least, gain):
    """{doc: (score, depths)} by dictionaries, and the tree's distribution after a context."""
    texts = {d: [*split(t), "\n"] for d, t, _ in rows}
    grams, follow = {}, {}
    for d, _, held in rows:
        w = texts[d]
        for i in range(0 if held else len(w)):
            for k in range(min(i, depth) + 1):
                grams[tuple(w[i - k : i + 1])] = grams.get(tuple(w[i - k : i + 1]), 0) + 1
                follow.setdefault(tuple(w[i - k : i]), set()).add(w[i])
    n, v = sum(c for g, c in grams.items() if len(g) == 1), len(follow.get((), ()))
    rough = lambda p: 10 ** (np.clip(np.rint(-25 * np.log10(p)), 0, 255) / -25)
    known = {}

    def after(ctx, w):
        """Smoothed probability of w in the longest state of ctx, and that state's length."""
        p, k = (grams.get((w,), 0) + 0.1) / (n + 0.1 * (v + 1)), 0
        for j in range(1, min(depth, len(ctx)) + 1):
            c = ctx[-j:]
            if state(c):
                p, k = (max(grams.get((*c, w), 0) - 0.75, 0) + 0.75 * len(follow[c]) * p) / grams[c], j
        return p, k

    def state(c):
        if c not in known:
            known[c] = False
            if grams.get(c, 0) >= least and all(grams.get(c[i:], 0) >= least for i in range(len(c))) and grams.get(c[:-1], least) >= least:
                total, m, k = 0.0, grams[c], len(follow.get(c, ()))
                for w in follow.get(c, ()):
                    p, x = rough(after(c[1:], w)[0]), grams[(*c, w)]
                    total += x * np.log10(((max(x - 1.75, 0) + 0.75 * k * p) / max(m - 1, 1)) / p)
                known[c] = bool(total >= gain and k)
        return known[c]

    out = {}
    for d, w in texts.items():
        each = [after(tuple(w[max(0, i - depth) : i]), x) for i, x in enumerate(w)]
        out[d] = sum(np.log10(p) for p, _ in each), sum(k for _, k in each) / len(w)
    return out, after, set(follow.get((), ()))


@pytest.mark.parametrize("hot", [10**9, 5])
def test_suffix_tree_brute_force(spark, hot):
    """States, discounting and retention are those of dictionaries, and every state's distribution sums to one."""
    some = [" ".join(rng.choice(WORDS[:6], 12)) for _ in range(8)]
    rows = [(i, " ".join(x for _ in range(4) for x in (rng.choice(some), prose(int(rng.integers(0, 5))))), i % 5 == 0) for i in range(60)] + [(60, "", False), (61, None, True), (62, "never seen here", True)]
    want, after, words = brute_tree(rows, 3, 3, 0.5)
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean"), depth=3, least=3, gain=0.5, hot=hot).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert (r.score, r.mean_depth) == pytest.approx(want[r.doc_id], abs=1e-6)
    deepest = set()
    for t in some:
        w = tuple(split(t))
        for i in range(len(w)):
            ctx = w[max(0, i - 3) : i]
            deepest.add(after(ctx, "w0")[1])
            assert sum(after(ctx, x)[0] for x in [*words, "no such word"]) == pytest.approx(1)
    assert {1, 2} <= deepest


def test_suffix_tree_defaults(spark):
    """Contexts seen 16 to 31 times, and of three words, are open to the test."""
    filler = lambda n: " ".join(rng.choice([f"f{i}" for i in range(400)], n))
    rare = " ".join(f"{filler(60)} rare then" for _ in range(20))
    deep = " ".join(f"{filler(20)} {a} mid last {b}" for _ in range(60) for a, b in (("left", "red"), ("right", "blue")))
    rows = [(0, rare, False), (1, deep, False), (2, "rare then", True), (3, "left mid last red", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got, two = ({r.doc_id: r for r in suffix_tree.score(df, **k).collect()} for k in ({}, {"depth": 2}))
    assert got[2].mean_depth > 0
    assert got[3].mean_depth > two[3].mean_depth and got[3].score > two[3].score + 0.2


def test_suffix_tree_hot(spark):
    """The test of a context does not depend on how its events are dealt."""
    weight = 1 / np.arange(1, 20_001)
    words, c = rng.choice(20_000, 30_000, p=weight / weight.sum()), np.arange(30_000) % 10
    moved = (c == 0) & (rng.random(30_000) < 0.05)
    words[moved] = rng.integers(19_700, 20_000, moved.sum())  # the gain of c0 comes from the smoothing mass
    text = " ".join(f"c{x} v{w}" for x, w in zip(c, words, strict=True))
    df = spark.createDataFrame([(0, text, False), *[(i + 1, f"c{i % 10} v{i} c1", True) for i in range(40)]], "doc_id long, text string, held boolean")
    plain, hot = (sorted(map(tuple, suffix_tree.score(df, gain=g, hot=h).collect())) for g, h in ((6.0, 10**9), (6.0, 100)))
    for x, y in zip(plain, hot, strict=True):
        assert x == pytest.approx(y)
    assert next(r for r in hot if r[0] == 1)[-1] > 0

def test_suffix_tree_memory():
    """A level's answers are taken into a chunk with few arrays at a time: 126 bytes a token before."""
    import tracemalloc

    import pyarrow as pa

    n, rng = 200_000, np.random.default_rng(5)
    toks = np.minimum(rng.zipf(1.3, n), 20_000).astype(np.int64)
    vocab, place, trained = np.unique(toks, return_inverse=True, return_counts=True)
    rank = np.empty(len(vocab), np.uint32)
    rank[suffix_tree._by_count(trained)] = np.arange(len(vocab), dtype=np.uint32)
    hashes = np.sort(rng.integers(1, 2**63, len(vocab)).astype(np.uint64))
    row = {"chunk": 1, "n_all": n, "ids": [1], "held": b"\0", "lens": np.array([n], np.int32).tobytes(), "vocab": suffix_tree._sized(hashes), "trained": suffix_tree._sized(trained.astype(np.uint32)), "toks": suffix_tree._pack(rank[place])}
    asked = suffix_tree._Chunk(row, {0: suffix_tree._sized(trained.astype(np.uint64))}, n, len(vocab)).ask(2, 10**9, 1)
    reply = suffix_tree._add_events(pa.Table.from_batches([suffix_tree._blobs(asked)]), 10**9, -1e9).to_pylist()[0]
    chunk = suffix_tree._Chunk(row, {0: suffix_tree._sized(trained.astype(np.uint64))}, n, len(vocab))
    tracemalloc.start()
    try:
        chunk.learn(2, 10**9, 1, {0: reply}, {})
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert chunk.depth.any() and peak / n < 90


def test_learned_partitions(spark):
    x = rng.standard_normal((700, 8)).astype(np.float32)
    x[5] = x[6] = x[7] = x[20]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(900, None, ""), (920, [0.0] * 8, ""), (940, [float("nan")] * 8, ""), (None, [1.0] * 8, ""), (960, [1.0, None] * 4, ""), (3, x[3].tolist(), "e"), (980, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    got = {}
    for r in learned_partitions.search(df, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    recall, d = [], x.astype(float)
    for q, found in got.items():
        s = d @ d[q]
        order = [i for i in np.lexsort((np.arange(700), -np.round(s, 12))) if i != q][:20]
        recall.append(len({v for _, v, _ in found} & set(order)) / 20)
        assert [r for r, *_ in sorted(found)] == list(range(1, 21)) and all(abs(sc - s[v]) < 1e-9 for _, v, sc in found)
        assert [(-sc, v) for _, v, sc in sorted(found)] == sorted((-sc, v) for _, v, sc in found)
    assert np.mean(recall) >= 0.9
    assert learned_partitions.search(df.limit(0), 20).count() == 0


def test_learned_partitions_top_up(spark):
    """A query whose parts hold too few rows visits more; few rows give all others; lengths keep to themselves; one id on two vectors is two rows."""
    x = rng.standard_normal((300, 4))
    ids = list(range(300))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(1, x[2].tolist()), (2000, [1.0, 2.0]), (2001, [3.0, 1.0]), (2020, [1.0, 0.0]), (20, x[21].tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in learned_partitions.search(df, 20, k=20, parts=32, target=0.01).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted((r, v) for r, v, _ in got[2000]) == [(1, 2001), (2, 2020)] and sorted((r, v) for r, v, _ in got[2020]) == [(1, 2001), (2, 2000)]
    assert all(len(found) == 20 for q, found in got.items() if q < 300 and q != 20)
    assert len(got[20]) == 40 and sorted(r for r, *_ in got[20]) == sorted([*range(1, 21)] * 2)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in learned_partitions.search(few, 20).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 0.5)]


@pytest.mark.parametrize("coarse", [0, 3, 6])
def test_bit_sliced(spark, coarse):
    x = (rng.standard_normal((500, 6)) * 0.4).astype(np.float32)
    x[10:60] = x[100]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(900, None, ""), (1000, [0.0] * 6, ""), (940, [float("inf")] * 6, ""), (1100, [1.0, 2.0], ""), (1101, [0.5, -1.0], ""), (None, [1.0] * 6, ""), (200, x[3].tolist(), ""), (3, x[3].tolist(), "e")]
    got = {}
    for r in bit_sliced.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string"), coarse=coarse, block=200, group=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y, ids = np.floor(1024 * np.vstack([x, np.zeros((1, 6)), x[3:4]]).astype(float)).astype(int), np.array([*range(500), 1000, 200])
    assert set(got) == {0, 100, 200, 300, 400, 1000, 1100} and [(v, s) for _, v, s in got.pop(1100)] == [(1101, 512 * 1024 - 1024 * 2048)]
    for q, found in got.items():
        want = []
        for own in np.flatnonzero(ids == q):
            s = y @ y[own]
            want += [(rank + 1, ids[i], s[i]) for rank, i in enumerate([i for i in np.lexsort((ids, -s)) if i != own][:10])]
        assert sorted(found) == sorted(want)


def test_bit_sliced_wide(spark):
    """Components beyond the slices are resolved whole, and scores beyond 64 bits are the nearest that fit."""
    x = {0: [1e6, -3.0], 1: [2.0, 5.0], 2: [1e6, 1e6], 3: [-1e15, 0.0], 100: [1.0, 1.0], 200: [1e16, 1e16]}
    df = spark.createDataFrame([(i, v) for i, v in x.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in bit_sliced.search(df, block=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 100, 200):
        score = {i: max(-(2**63), min(2**63 - 1, sum(int(a * 1024 // 1) * int(b * 1024 // 1) for a, b in zip(x[q], v, strict=True)))) for i, v in x.items() if i != q}
        assert [(v, s) for _, v, s in sorted(got[q])] == sorted(score.items(), key=lambda p: (-p[1], p[0]))
    assert bit_sliced.search(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", None), (5, 0, "user", "z"), (6, 0, "user", "z"), (6, 0, "user", "z"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, k int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.maximal_conversations(df).collect()}
    assert set(got) == {3, 4, 5} and got[5][1] == 2 and got[3][0] == 3 and got[3][2].startswith("<|user|>\na<|end|>\n<|assistant|>\nb")
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_licenses(docs, empty):
    got = [tuple(r) for r in licenses.scan(docs).collect()]
    assert len(got) == docs.count()
    by = {r[0]: r for r in got}
    assert by[11][6] == "cc-by,cc-by-nc,reserved" and by[11][2:5] == (2, 2, 7) and by[12][2:6] == (2, 0, 2, "cc-by") and by[13][6] == "mit" and by[13][2] == 0
    assert by[0][1:4] == (0, 0, None) and by[8][6] == ""
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("hot", [8192, 4])
def test_simhash(spark, docs, empty, hot):
    def fp(t):
        w = split(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    many = [(100 + i, BASE + f" x{i % 40}", "s", 0, "k", 0) for i in range(120)]
    rows = [*docs.collect(), *many]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), hot=hot).collect()
    ids = {}
    for r in rows:
        ids.setdefault(fp(r[1]), []).append(r[0])
    up = {f: f for f in ids}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in combinations(ids, 2):
        if (a ^ b).bit_count() <= 3 and find(a) != find(b):
            up[find(a)] = find(b)
    least = {}
    for f, members in ids.items():
        least.setdefault(find(f), []).extend(m for m in members if m is not None)
    want = sorted((str(r[0]), f"{fp(r[1]):016x}", min(least[find(fp(r[1]))], default=None)) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def brute_cuts(rows, core=19, similarity=0.8):
    """{doc: words to cut} of (doc_id, text) with distinct ids, straight from the definition."""
    seen, runs, cut = {}, {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = split(t)
        for at in range(len(w) - core + 1):
            f, p = seen.setdefault(tuple(w[at : at + core]), (i, at))
            if (f, p) != (i, at):
                runs.setdefault((str(i), str(f)), {}).setdefault(at - p, set()).update(range(max(at, p + core) if f == i else at, at + core))
    for (i, f), by in runs.items():
        whole = []
        for diagonal, places in by.items():
            for at in sorted(places):
                if whole and whole[-1][2] == diagonal and whole[-1][1] == at:
                    whole[-1][1] = at + 1
                else:
                    whole.append([at, at + 1, diagonal])
        whole.sort()
        for x, y in zip([None, *whole], whole, strict=False):
            cut.setdefault(i, set()).update(range(y[0], y[1]))
            if x and i != f:
                gap, theirs, n = y[0] - x[1], y[0] - y[2] - x[1] + x[2], y[1] - y[0] + x[1] - x[0]
                if min(gap, theirs) >= 0 and n - 8 >= similarity * (2 * n + gap + theirs - 8 - (n - 8)):
                    cut[i].update(range(x[1], y[0]))
    return {i: c for i, c in cut.items() if c}


def cut_words(found):
    got = {}
    for r in found.collect():
        got.setdefault(str(r.doc_id), set()).update(range(r.start, r.stop))
    return got


@pytest.mark.parametrize("hot", [8192, 1])
def test_paragraphs(spark, docs, empty, hot):
    near = BASE.split()
    many = [(200 + i, prose(25) + "\n" + " ".join([*near[:30], f"v{i}", *near[31:]]), "s", 0, "k", 0) for i in range(12)]
    df = spark.createDataFrame([*docs.collect(), *many], DOCS)
    found = paragraphs.repeats(df, hot=hot)
    want = brute_cuts({(r.doc_id, r.text) for r in df.collect()})
    assert cut_words(found) == want and len(want["205"]) >= 60  # the word put in goes with the rest
    out = paragraphs.remove(df, found)
    assert out.columns == df.columns and out.count() == df.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[9] == TEXTS[9].split("\n")[0] + "\n" and got[6] == "" and got[0] is None and got[8] == TEXTS[8]
    assert paragraphs.repeats(empty).count() == 0


def test_passages(spark):
    """Passages inside longer lines, over lines, of a text without an id, and of a text that repeats itself; a run of 18 words stays."""
    fresh = lambda n, k: " ".join(f"u{k}x{i}" for i in range(n))
    p, short, lined = fresh(50, 1), fresh(18, 2), fresh(60, 3).split()
    rows = [
        (1, f"{fresh(100, 4)} {p} {fresh(90, 5)}"), (2, f"{fresh(70, 6)}  {p.upper()} {fresh(90, 7)}\nend"), (None, f"{fresh(200, 8)} {p}"),
        (3, f"{fresh(100, 9)} {short} {fresh(90, 10)}"), (4, f"{fresh(70, 11)} {short} {fresh(90, 12)}"),
        (5, f"{fresh(80, 13)} " + " ".join(lined) + f" {fresh(80, 14)}"), (6, "top\n" + "\n".join(" ".join(lined[i : i + 10]) for i in range(0, 60, 10)) + "\nlast"),
        (7, "spam and eggs " * 60), (8, None), (9, ""), (10, p), (11, "x " * 30_000 + p),
    ]
    df = spark.createDataFrame([(i, t, "a", True) for i, t in rows], "doc_id long, text string, row string, spans boolean")
    out = paragraphs.remove(df, paragraphs.repeats(df))
    got = {r.doc_id: r.text for r in out.collect()}
    want = dict(rows) | {1: f"{fresh(100, 4)} {fresh(90, 5)}", 2: f"{fresh(70, 6)}  {fresh(90, 7)}\nend", 6: "top\nlast", 10: ""}
    assert out.columns == df.columns
    assert {k: v for k, v in got.items() if k not in (7, 11)} == {k: v for k, v in want.items() if k not in (7, 11)}
    assert len(split(got[7])) == len(split(got[11])) == 19


def test_passages_brute_force(spark):
    """Every paragraph whose first place is elsewhere is cut, the words between two runs if the whole is alike, and nothing else."""
    pool = [rng.choice(WORDS, int(n)).tolist() for n in rng.integers(15, 90, 14)]

    def altered(w):
        w = list(w)
        for at in rng.integers(0, len(w), int(rng.integers(0, 3))):
            w[at : at + int(rng.integers(0, 2))] = [f"z{int(rng.integers(9))}"] * int(rng.integers(0, 3))
        return " ".join(w)

    rows = [(i, "\n".join(x for _ in range(3) for x in (prose(int(rng.integers(5, 60))), altered(pool[int(rng.integers(14))])))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_cuts(rows)
    assert cut_words(paragraphs.repeats(df)) == want and len(want) > 20
    assert any(min(c) and len(c) > 40 for c in want.values())
    found = paragraphs.repeats(df).collect()
    place = {(r.doc_id, at): r.component for r in found for at in range(r.start, r.stop)}
    first, by = {}, dict(rows)
    for (i, at), c in place.items():  # cuts of the same core are of one cluster
        core = tuple(split(by[i])[at : at + 19])
        if len(core) == 19 and all((i, at + k) in place for k in range(19)):
            assert first.setdefault(core, c) == c


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_components(spark, few):
    """Chains, a hub, a cycle and a link to itself; the same roots however many links one task joins."""
    from kindred.llm.common import Scratch, components

    links = [*[(i, i + 1) for i in range(60)], *[(100, 100 + i) for i in range(1, 40)], (200, 201), (201, 202), (202, 200), (201, 200), (-5, 300), (7, 7), (400, 400)]
    got = {r.node: r.root for r in components(Scratch(spark), spark.createDataFrame(links, "a long, b long"), few).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200, 202: 200, -5: -5, 300: -5}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_gathered_survives_a_join(spark):
    """Spark leaves a plain repartition by a join's keys out; ours stays, so the rows of a key are together."""
    from kindred.llm.common import gathered

    a = spark.range(100).withColumnRenamed("id", "k")
    both = a.join(a.where("k > 50").hint("merge"), "k", "left_anti")
    plan = gathered(both, "k")._jdf.queryExecution().executedPlan().toString()
    assert "gathered" in plan and "REPARTITION_BY_COL" in plan
    assert "REPARTITION_BY_COL" not in both.repartition("k")._jdf.queryExecution().executedPlan().toString()


def test_core_is_in_every_near_pair():
    """Stretches of 20 words or more with a Jaccard of 0.8 share 19 words in a row."""
    core, shingles = paragraphs.core_words(), lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    assert core == 19
    with pytest.raises(ValueError):
        paragraphs.core_words(50, 0.8)
    near = 0
    for _ in range(4000):
        a = list(range(int(rng.integers(20, 90))))
        b = list(a)
        for _ in range(int(rng.integers(1, 4))):
            at = int(rng.choice([0, 1, len(b) - 1, rng.integers(len(b))]))
            b[at : at + int(rng.integers(0, 2))] = [int(x) for x in rng.integers(1000, 9999, int(rng.integers(0, 2)))]
        x, y = shingles(a), shingles(b)
        if len(b) >= 20 and len(x & y) >= 0.8 * len(x | y):
            near += 1
            assert {tuple(a[i : i + core]) for i in range(len(a) - core + 1)} & {tuple(b[i : i + core]) for i in range(len(b) - core + 1)}
    assert near > 300


def test_packing(spark, docs, empty):
    bins = packing.pack(docs, capacities=(8, 64, 512), shard=5).collect()
    sizes = {}
    for b in bins:
        assert b.used == sum(b.lengths) <= b.capacity and b.capacity == min(c for c in (8, 64, 512) if c >= b.used)
        for d, n in zip(b.doc_ids, b.lengths, strict=True):
            sizes[d] = sizes.get(d, 0) + n
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(split(r.text)) + 1
    assert sizes == want
    assert packing.pack(empty).count() == 0


def test_best_fit_is_as_good_as_one_size():
    sizes = sorted(rng.integers(1, 500, 400).tolist(), reverse=True)
    _, cost = packing.best_fit(sizes, (128, 512), 512, 16.0)
    assert cost <= 512 * len(packing.best_fit(sizes, (512,), 512, 16.0)[0]) + 16.0 * len(packing.best_fit(sizes, (512,), 512, 16.0)[0])


def test_toxicity(spark, docs, empty):
    bad = ["vile", "nasty", "grubwort"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, prose(40) + (" " + " ".join(b + str(rng.choice(["", "en", "er"])) for b in rng.choice(bad, 2)) if toxic else ""), "s", 0, "k", 0))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(df, lab.where("doc_id % 4 <> 2 OR doc_id IS NULL"))
    got = {r.doc_id: r.score for r in toxicity.score(df, scorer).collect()}
    held = [i for i in got if i % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, scorer).collect())
    assert toxicity.fit(empty, lab.limit(0)) is None and toxicity.score(docs, None).count() == docs.count()
    assert toxicity.keep(docs, scorer, 0.3).columns == docs.columns


def test_label_model():
    """From a few labelled rows and many without: rates that tell the classes apart, posteriors near the best there are, copies that share one vote."""
    g = np.random.default_rng(5)
    yes, no, n = np.array([0.7, 0.5, 0.6, 0.4]), np.array([0.05, 0.02, 0.1, 0.03]), 20_000
    toxic = g.random(n) < 0.2
    votes = (g.random((n, 4)) < np.where(toxic[:, None], yes, no)).astype(np.int8)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # the last voter copies the first
    known = np.arange(n) < 400
    model = toxicity.LabelModel(votes, toxic & known, known, 0.2, np.ones(n), rounds=40, anchor=20.0)
    assert (model.yes[:4] > 3 * model.no[:4]).all()
    assert model.correlation[0, 4] > 0.99 and model.share == pytest.approx([0.5, 1, 1, 1, 0.5], abs=0.1)
    q = model.posterior(votes)
    odds = np.log(0.25) + votes[:, :4] @ np.log(yes / no) + (1 - votes[:, :4]) @ np.log((1 - yes) / (1 - no))
    assert ((q > 0.5) == toxic).mean() > ((odds > 0) == toxic).mean() - 0.12  # single silent voters say nothing


def test_toxicity_learns_alike(spark):
    """An id on two texts, a repeated row and the order of rows don't change the fit; texts without a label take part."""
    rows = [(i, prose(20) + (" vile" * 2 if i % 4 == 0 else ""), "s", 0, "k", 0) for i in range(200)] + [(0, prose(30), "s", 0, "k", 0), (4, prose(9) + " vile", "s", 0, "k", 0)]
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    a, b = (toxicity.fit(spark.createDataFrame(r, DOCS), lab) for r in (rows, [*rows[::-1]]))
    assert a.voters == b.voters and a.w == pytest.approx(b.w)


def test_bpe(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    odd = ["Hello WORLD's <|endoftext|> it'll", "ΑΣ İstanbul ﬁ ½ é náïve x\x1cy​z \x00a S<|endoftext|>", "a" * 300 + " " + "ab" * 200 + " 12345 !!'s ''t 漢字🙂", "\u0085 x﻿", "S< \0\0<"]
    df = docs.unionByName(spark.createDataFrame([(50 + i, t, "s", 0, "k", 0) for i, t in enumerate(odd)], DOCS))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in transducer_bpe.digests(df, path, size=40).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in df.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        assert (r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))) in got
    vocab = transducer_bpe.Vocabulary(path)
    words = sorted({w.encode() for w in "the then there other brother a".split()})
    lexicon = transducer_bpe.Lexicon(transducer_bpe.compile_lexicon(words, vocab.merge(words)))
    assert lexicon.find([*words, b"th", b"thenx", b""]).tolist() == [*range(len(words)), -1, -1, -1]
    assert transducer_bpe.digests(empty, path).count() == 0


def test_bpe_codes_a_word_once():
    """However many runs it stands in, also of later batches; starting afresh and runs without words change nothing."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, coded = Tokenizer.from_file(path), []

    class Coder(transducer_bpe.Coder):
        def word_ids(self, words):
            coded.extend(words)
            return super().word_ids(words)

    texts = ["Strange, strange strange! (strange)", "", "STRANGE? \x1c\t x", "\t\x1c strange's <|endoftext|>strange S<strange", "Éa e\u0301a ÉA."]
    vocab = transducer_bpe.Vocabulary(path)
    for memory in (100, 1):
        coded.clear()
        phrases = transducer_bpe.Phrases(Coder(vocab, transducer_bpe.compile_lexicon([], [])), memory)
        for t in [*texts, *texts]:
            ids, text = (x.to_pylist() for x in transducer_bpe._joined([transducer_bpe.runs_of(t)], phrases))
            want = own.encode(t, add_special_tokens=False).ids
            assert (ids, text) == ([" ".join(map(str, want))], [own.decode(want, skip_special_tokens=False)])
        assert memory == 1 or coded.count("strange") == 1


def fingerprint(t):
    w = split(t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(rows):
    """Of (doc_id, text) rows, one of each SimHash component: the smallest id, then text; rows without an id come last."""
    kept, left = [], list(dict.fromkeys(rows))
    while left:
        group, todo = [], [left.pop()]
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if (fingerprint(x[1]) ^ fingerprint(y[1])).bit_count() <= 3]
            left = [y for y in left if y not in near]
            todo += near
        kept.append(min(group, key=lambda r: (r[0] is None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1] or '', 42)).view(np.int64))))
    return kept


@pytest.mark.parametrize("hollow", ["", "documents", "labels"])
def test_pipeline_brute_force(spark, tmp_path, hollow):
    """Every stage against a plain version of it on what the stage before kept."""
    import corpus_pipeline

    passage = prose(70)
    rows = [(i, prose(int(rng.integers(30, 90))) + (" vile nasty" * 3 if i % 6 == 0 else "")) for i in range(90)]
    rows += [(200 + i, prose(40) + " " + passage + "\n" + prose(30)) for i in range(4)] + [(300, rows[1][1]), (None, rows[2][1]), (None, prose(50)), (None, prose(50)), (301, None), (302, ""), (1, prose(80)), (308, rows[8][1] + " x")]
    rows = [] if hollow == "documents" else rows
    df = spark.createDataFrame([(d, t, "en", "src1", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(0 if hollow == "labels" else 90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    order = lambda x: sorted(x, key=lambda r: (str(r[0]), str(r[1])))
    now, kept = df, rows
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, now = now, stage(spark, now, str(tmp_path))
        if name == "toxicity":
            kept = [r for r in kept if hollow or "vile" not in (r[1] or "")]
        elif name == "simhash_near_dedup":
            kept = brute_near(kept)
        else:
            cut, spans = brute_cuts([r for r in kept if r[0] is not None]), {}
            for d, words in cut.items():
                for w in sorted(words):
                    runs = spans.setdefault(d, [])
                    if runs and runs[-1][1] == w:
                        runs[-1][1] = w + 1
                    else:
                        runs.append([w, w + 1])
            assert hollow == "documents" or spans
            kept = [(d, paragraphs.without(t, spans[str(d)]) if str(d) in spans else t) for d, t in kept]
        assert now.columns == before.columns
        assert order((r.doc_id, r.text) for r in now.collect()) == order(kept), name
    sizes, want = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.used == sum(r.lengths) <= r.capacity
        for d, n in zip(r.doc_ids, r.lengths, strict=True):
            sizes[d] = sizes.get(d, 0) + n
    for d, t in kept:
        want[d] = want.get(d, 0) + len(split(t)) + 1
    assert sizes == want


def test_pipeline_keeps_distinct_texts(spark):
    """Null ids and an id on two texts are no near-duplicate links."""
    import corpus_pipeline

    a, b, c, d = (prose(300) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (None, BASE), (3, c), (3, d), (3, d), (1, c + " more"), (4, BASE), (9, "")]
    df = spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.where("source IN ('0', '1', '5', '7', '8', '9')").collect()))
