"""Language-model scoring with a probabilistic suffix tree.

A state of the tree is a context of up to ``depth`` words that was seen at least ``least`` times in
training and passed a divergence test against its longest retained suffix.  A state's next-symbol
distribution is smoothed by absolute discounting into that suffix's, down to the root, whose
distribution is the additive one of the base score.  A token is scored in its longest suffix state.

Plan.  Texts are encoded once into chunks of about ``CHUNK`` tokens (word hashes and token indexes)
and written to scratch.  The tree then grows a level at a time.  For each level a chunk asks for the
counts of its distinct (context, next word) events; requests are dealt by hash, as sorted binary
blobs, to as many parts as the corpus needs; a part adds the counts, applies the test, and answers
each chunk in the chunk's own order.  So counts cover all training tokens, the model is never held
in one place, and nothing depends on a key's frequency: a key occurs once a chunk at most, and the
events of contexts of over ``hot`` occurrences are dealt by event, not by context.  The statistics of
those contexts, at most ``HOT_CONTEXTS`` by the choice of ``hot``, are the only ones sent to all; their
events are tested in a second pass, by the same formula.

Words and contexts are identified by 64-bit hashes, a context's successors by 48 bits of theirs.  Null texts count as empty, null ids as ''.
Repeated rows count and are scored each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import ctypes
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, words_of

CHUNK = 1_300_000  # tokens
PART = 3_000_000  # events of a part, about
HOT = 50_000  # occurrences of a context whose events are dealt by event, at least
HOT_CONTEXTS = 100_000
DISCOUNT = 0.75
HIGH = np.uint64(0xFFFFFFFF00000000)
END = "\n"  # no word can be this

CHUNKS = "chunk long, n_train long, n_all long, ids array<long>, held binary, lens binary, vocab binary, trained binary, toks binary"
BLOBS = "chunk long, part int, a binary, b binary, c binary, d binary, e binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_depth double"


def _release() -> None:
    """Gives back to the system what freed arrays and Arrow tables leave to this process, which the next task may not use."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _pack(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of sorted hashes and of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(b: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sized(x: np.ndarray) -> bytes:
    return np.int64(len(x)).tobytes() + _pack(x)


def _unsized(b: bytes, kind) -> np.ndarray:
    return _unpack(b[8:], int(np.frombuffer(b, np.int64, 1)[0]), kind)


def _arr(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(b, kind)


def _by_count(trained: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary of a chunk, most frequent word first; token indexes count in this order."""
    return np.argsort(-trained.astype(np.int64), kind="stable")


def _runs(part: np.ndarray):
    """(part, start, end) of each run of equal parts."""
    if len(part):
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        yield from zip(part[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _encode(batches):
    """(doc_id, held, text) -> chunks."""
    import pyarrow.compute as pc
    import xxhash

    task, seq = TaskContext.get().partitionId(), 0
    end = np.uint64(xxhash.xxh64_intdigest(END))
    parts: list = []

    def flush():
        nonlocal seq, parts
        hashes = np.concatenate([p[0] for p in parts])
        lens = np.concatenate([p[1] for p in parts]).astype(np.int32)
        held = np.concatenate([p[2] for p in parts])
        vocab, toks = np.unique(hashes, return_inverse=True)
        train = np.repeat(held == 0, lens)
        trained = np.bincount(toks[train], minlength=len(vocab)).astype(np.uint32)
        place = np.empty(len(vocab), np.uint32)
        place[_by_count(trained)] = np.arange(len(vocab), dtype=np.uint32)
        row = {
            "chunk": [(task << 24) | seq], "n_train": [int(train.sum())], "n_all": [len(toks)],
            "ids": pa.array([[i for p in parts for i in p[3]]], pa.list_(pa.int64())),
            "held": [held.astype(np.uint8).tobytes()], "lens": [lens.tobytes()], "vocab": [_sized(vocab)],
            "trained": [_sized(trained)], "toks": [_pack(place[toks])],
        }
        seq, parts = seq + 1, []
        return pa.RecordBatch.from_pydict(row)

    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            b = batch.slice(start, 500)
            flat, n = words_of(b.column("text"))
            enc = flat.dictionary_encode()
            known = np.fromiter((xxhash.xxh64_intdigest(w) for w in enc.dictionary.to_pylist()), np.uint64, len(enc.dictionary))
            hashes = known[np.asarray(enc.indices)] if len(flat) else np.zeros(0, np.uint64)
            out = np.insert(hashes, np.cumsum(n), end)
            parts.append((out, n + 1, np.asarray(pc.cast(b.column("held"), pa.uint8())), b.column("doc_id").to_pylist()))
            size += len(out)
            if size >= CHUNK:
                yield flush()
                size = 0
    if parts:
        yield flush()


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _blobs(rows: list) -> pa.RecordBatch:
    names = ("chunk", "part", "a", "b", "c", "d", "e")
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _ask_words(batches, parts: int):
    for b in batches:
        for chunk, vocab, trained in zip(*(b.column(c).to_pylist() for c in ("chunk", "vocab", "trained")), strict=True):
            v, t = _unsized(vocab, np.uint64), _unsized(trained, np.uint32)
            yield _blobs([(chunk, p, _sized(v[x:y]), _sized(t[x:y]), b"", b"", b"") for p, x, y in _runs(_part(v, parts))])


def _add_words(t: pa.Table) -> pa.Table:
    """Answers: the words' counts (a).  One more row, chunk -1, has the part's tokens and distinct words."""
    keys = [_unsized(x, np.uint64) for x in t.column("a").to_pylist()]
    counts = np.concatenate([_unsized(x, np.uint32) for x in t.column("b").to_pylist()])
    _, inv = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inv, counts).astype(np.uint64)
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    part = t.column("part")[0].as_py()
    rows = [(c, part, _sized(total[inv[cut[i] : cut[i + 1]]]), b"", b"", b"", b"") for i, c in enumerate(t.column("chunk").to_pylist())]
    rows.append((-1, part, np.array([total.sum(), (total > 0).sum()], np.uint64).tobytes(), b"", b"", b"", b""))
    return pa.Table.from_batches([_blobs(rows)])


class _Chunk:
    """A chunk's tokens, and of each token what the levels answered so far tell."""

    def __init__(self, row: dict, words: dict, n: int, v: int):
        self.row, self.chunk = row, row["chunk"]
        order = _by_count(_unsized(row["trained"], np.uint32))
        toks = _unpack(row["toks"], row["n_all"], np.uint32)
        self.h = _unsized(row["vocab"], np.uint64)[order][toks]
        self.lens = _arr(row["lens"], np.int32)
        self.held = _arr(row["held"], np.uint8)
        self.train = np.repeat(self.held == 0, self.lens)
        starts = np.cumsum(self.lens) - self.lens
        self.pos = np.minimum(np.arange(len(self.h), dtype=np.int64) - np.repeat(starts, self.lens), 255).astype(np.uint8)  # of levels, there are fewer
        counts = np.concatenate([_unsized(words[p], np.uint64) for p in sorted(words)]) if words else np.zeros(0, np.uint64)
        self.count = counts[order][toks].astype(np.int64)  # of the event that ends here, at the level below
        self.known = self.count > 0
        self.base = np.log10((self.count + 0.1) / (n + 0.1 * (v + 1)))
        self.p = 10.0**self.base  # in the longest state so far
        self.depth = np.zeros(len(self.h), np.int8)
        self.ctx = np.zeros(len(self.h), np.uint64)
        self.level = 0

    def events(self, least: int):
        """Goes a level up: the tokens with contexts to ask about, their contexts' counts, and the distinct events among them."""
        self.level += 1
        before = np.roll(self.h, self.level)
        self.ctx = mix(self.ctx, before) if self.level > 1 else mix(np.uint64(1) + np.zeros_like(before), before)
        del before
        ctx_count = np.roll(self.count, 1)
        at = np.flatnonzero((self.pos >= self.level) & (ctx_count >= least)).astype(np.int32)
        ctx_count = ctx_count[at]
        # within a chunk, half of a context's hash and half of the event's: in the order of contexts, and so of parts
        keys = (self.ctx[at] & HIGH) | (mix(self.ctx[at], self.h[at]) >> np.uint64(32))
        key, first, inv = np.unique(keys, return_index=True, return_inverse=True)
        return at, ctx_count, key, first.astype(np.int32), inv.astype(np.int32)

    def ask(self, least: int, hot: int, parts: int) -> list:
        at, ctx_count, key, first, inv = self.events(least)
        seen = np.bincount(inv, self.train[at], minlength=len(key)).astype(np.uint32)
        cc, first = ctx_count[first], at[first]
        ctx = self.ctx[first]
        del at, ctx_count, inv
        order, part = self.order(key, cc, hot, parts)
        del key
        word = (self.h[first][order] & np.uint64(2**48 - 1)).view(np.uint8).reshape(-1, 8)[:, :6]  # a context's successors are known by 48 bits
        ctx, cc, seen = ctx[order], cc[order], seen[order]
        lp = np.clip(np.rint(-25 * np.log10(self.p[first])[order]), 0, 255).astype(np.uint8)
        rows = []
        for p, x, y in _runs(part[order]):
            at_ctx = np.flatnonzero(np.concatenate([[True], ctx[x + 1 : y] != ctx[x : y - 1]]))
            each = np.diff(np.concatenate([at_ctx, [y - x]])).astype(np.uint32)
            heads = np.concatenate([ctx[x:y][at_ctx], cc[x:y][at_ctx].view(np.uint64)])
            rows.append((self.chunk, p, word[x:y].tobytes(), _sized(seen[x:y]), _sized(lp[x:y]), _sized(heads), _sized(each)))
        return rows

    @staticmethod
    def order(key, cc, hot, parts):
        """Order by part, then by context, and the parts: that of the context, or of the event if the context is hot."""
        part = np.where(cc >= hot, _part(key << np.uint64(32), parts), _part(key, parts))
        return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable"), part

    def learn(self, least: int, hot: int, parts: int, answers: dict, hot_states: dict) -> None:
        """Takes in a level's answers: counts, and which contexts are states."""
        at, ctx_count, key, first, inv = self.events(least)
        cc, ctx = ctx_count[first], self.ctx[at[first]]
        del first
        order = self.order(key, cc, hot, parts)[0]
        del key
        got = [answers[p] for p in sorted(answers)]
        counts, kinds = np.empty(len(order), np.uint32), np.empty(len(order), np.int64)
        counts[order] = np.concatenate([_unsized(x["a"], np.uint32) for x in got] or [np.zeros(0, np.uint32)])
        kinds[order] = np.concatenate([_unsized(x["b"], np.uint32) for x in got] or [np.zeros(0, np.uint32)])
        del order, got
        ids, ks = hot_states.get(self.level, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        if len(ids):
            i = np.minimum(np.searchsorted(ids, ctx), len(ids) - 1)
            kinds = np.where(cc >= hot, np.where(ids[i] == ctx, ks[i], 0), kinds)
        else:
            kinds = np.where(cc >= hot, 0, kinds)
        del ctx, cc
        self.count = np.zeros(len(self.h), np.int64)
        self.count[at] = counts[inv]
        del counts
        k = kinds[inv]
        del kinds, inv
        state = k > 0
        a_ = at[state]
        n_, k_ = ctx_count[state], k[state]
        del at, ctx_count, k, state
        self.p[a_] = (np.maximum(self.count[a_] - DISCOUNT, 0) + DISCOUNT * k_ * self.p[a_]) / n_
        self.depth[a_] = self.level

    def scores(self, n: int) -> pa.Table:
        ends = np.cumsum(self.lens)
        add = lambda x: np.add.reduceat(x, ends - self.lens) if len(ends) else np.zeros(0)
        return pa.table({
            "doc_id": pa.array(self.row["ids"], pa.int64()), "held_out": pa.array(self.held == 1), "n_tokens": self.lens.astype(np.int64),
            "n_known": add(self.known.astype(np.int64)), "train_tokens": np.full(len(ends), n), "base_score": add(self.base),
            "score": add(np.log10(self.p)), "mean_depth": add(self.depth.astype(np.float64)) / self.lens,
        })


def _gains(count: np.ndarray, n: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What each event adds to the divergence of its context, of n occurrences and k distinct successors."""
    loo = (np.maximum(count - 1 - DISCOUNT, 0) + DISCOUNT * k * p) / np.maximum(n - 1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, count * np.log10(np.maximum(loo, 1e-300) / p), 0.0)


def _hot_gains(batches, state: np.ndarray, kinds: np.ndarray):
    """A part's events of hot contexts, and the distinct successors of each in all parts -> (contexts, gains) of the part."""
    for b in batches:
        for part, *cols in zip(*(b.column(c).to_pylist() for c in ("part", "a", "b", "c", "d")), strict=True):
            own, count, n, p = (_unsized(x, kind) for x, kind in zip(cols, (np.uint64, np.int64, np.int64, np.float64), strict=True))
            ids, at = np.unique(own, return_inverse=True)
            each = _gains(count, n, kinds[np.searchsorted(state, ids)][at], p)
            yield _blobs([(-2, part, ids.tobytes(), np.bincount(at, each, minlength=len(ids)).tobytes(), b"", b"", b"")])


def _add_events(t: pa.Table, hot: int, gain: float) -> pa.Table:
    """Answers: the events' counts (a), and for each the distinct successors of its context if that is a state, else 0 (b).

    The divergence of a context of c occurrences and k distinct successors from its longest suffix
    state is the mean, over its occurrences, of log10 q(w) / p(w), with q the smoothed distribution
    with that occurrence left out.  It is a state if c times that mean is at least ``gain``.
    Of contexts of ``hot`` occurrences or more, whose successors lie in many parts, rows with chunk -1 have
    the distinct successors in this part, and rows with chunk -2 the events, which get the same test once the former are added.
    """
    _release()  # of an earlier task
    col = {c: t.column(c).to_pylist() for c in "abcde"}
    part, chunks = t.column("part")[0].as_py(), t.column("chunk").to_pylist()
    keys, ctx, cc = [], [], []
    for a, d, e in zip(col["a"], col["d"], col["e"], strict=True):
        word = np.zeros((len(a) // 6, 8), np.uint8)
        word[:, :6] = np.frombuffer(a, np.uint8).reshape(-1, 6)
        both, each = _unsized(d, np.uint64), _unsized(e, np.uint32)
        ctx.append(np.repeat(both[: len(both) // 2], each))
        cc.append(np.repeat(both[len(both) // 2 :].view(np.int64), each))
        keys.append(mix(ctx[-1], word.view(np.uint64).ravel()))
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    keys = np.concatenate(keys)
    first, inv = (x.astype(np.int32) for x in np.unique(keys, return_index=True, return_inverse=True)[1:])
    del keys
    own, n = np.concatenate(ctx)[first], np.concatenate(cc)[first]
    del ctx, cc
    count = np.bincount(inv, np.concatenate([_unsized(x, np.uint32) for x in col["b"]])).astype(np.int64)
    p = 10.0 ** (np.concatenate([_unsized(x, np.uint8) for x in col["c"]])[first] / -25.0)
    del first
    state, at = np.unique(own, return_inverse=True)
    kinds = np.bincount(at, count > 0).astype(np.int64)
    total = np.zeros(len(state), np.int64)
    total[at] = n
    del col
    is_hot = total >= hot
    each = _gains(count, n, kinds[at], p)
    kept = (np.bincount(at, each) >= gain) & ~is_hot
    answer = np.where(kept, kinds, 0)[at].astype(np.uint32)
    small = np.minimum(count, 2**32 - 1).astype(np.uint32)
    rows = [(c, part, _sized(small[inv[cut[i] : cut[i + 1]]]), _sized(answer[inv[cut[i] : cut[i + 1]]]), b"", b"", b"") for i, c in enumerate(chunks)]
    del inv, answer, small
    if is_hot.any():
        rows.append((-1, part, state[is_hot].tobytes(), kinds[is_hot].tobytes(), b"", b"", b""))
        sent = np.flatnonzero(is_hot[at] & (count > 0))
        sent = sent[np.argsort(at[sent], kind="stable")]
        rows.append((-2, part, _sized(own[sent]), _sized(count[sent]), _sized(n[sent]), _sized(p[sent]), b""))
    return pa.Table.from_batches([_blobs(rows)])


def _replies(t: pa.Table, level: int) -> dict:
    keep = {}
    for kind, part, a, b in zip(*(t.column(c).to_pylist() for c in ("kind", "part", "a", "b")), strict=True):
        if kind == level:
            keep[part] = a if level == 0 else {"a": a, "b": b}
    return keep


def _step(left: pa.Table, right: pa.Table, plan: dict, final: bool) -> pa.Table:
    """A chunk with all answers so far -> its requests for the next level, or its scores."""
    rows = left.to_pylist()
    if not rows:
        return (pa.table({k: [] for k in RESULT}) if final else pa.Table.from_batches([_blobs([])]))
    _release()  # of an earlier task
    c = _Chunk(rows[0], _replies(right, 0), plan["n"], plan["v"])
    for level in range(1, plan["level"] + 1):
        c.learn(plan["least"], plan["hot"], plan["parts"], _replies(right, level), plan["states"])
    return c.scores(plan["n"]) if final else pa.Table.from_batches([_blobs(c.ask(plan["least"], plan["hot"], plan["parts"]))])


def score(docs: DataFrame, depth: int = 3, least: int = 16, gain: float = 6.0, hot: int = HOT) -> DataFrame:
    """Base and suffix-tree scores of (doc_id, text, held boolean); learns from rows that are not held."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    chunks = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held", F.col("text").cast("string").alias("text")).mapInArrow(_encode, CHUNKS))
    n_all = chunks.agg(F.sum("n_all")).first()[0]
    if not n_all:
        return spark.createDataFrame([], RESULT)
    parts = max(6, -(-n_all // PART))

    def level(asked: DataFrame, add) -> DataFrame:
        return scratch.put(asked.groupBy("part").applyInArrow(add, BLOBS))

    words = level(chunks.select("chunk", "vocab", "trained").mapInArrow(partial(_ask_words, parts=parts), BLOBS), _add_words)
    sums = sum((_arr(bytes(r.a), np.uint64).astype(np.int64) for r in words.where("chunk = -1").select("a").toLocalIterator()), np.zeros(2, np.int64))
    n, v = int(sums[0]), int(sums[1])
    plan = {"n": n, "v": v, "least": least, "parts": parts, "hot": max(hot, n // HOT_CONTEXTS), "level": 0, "states": {}}
    answers = words.where("chunk >= 0").select("chunk", "part", "a", "b", F.lit(0).alias("kind"))

    def pass_over(final: bool, schema: str) -> DataFrame:
        now = dict(plan)
        needed = chunks.select("chunk", "n_all", "ids", "held", "lens", "vocab", "trained", "toks")
        return needed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda x, y: _step(x, y, now, final), schema)

    for k in range(1, depth + 1):
        got = level(pass_over(False, BLOBS), lambda t: _add_events(t, plan["hot"], gain))
        ids, ks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in got.where("chunk = -1").select("a", "b").toLocalIterator():
            ids.append(_arr(bytes(r.a), np.uint64)), ks.append(_arr(bytes(r.b), np.int64))
        state, at = np.unique(np.concatenate(ids), return_inverse=True)
        kinds = np.bincount(at, np.concatenate(ks), minlength=len(state)).astype(np.int64)
        total = np.zeros(len(state))
        if len(state):
            events = got.where("chunk = -2").mapInArrow(partial(_hot_gains, state=state, kinds=kinds), BLOBS)
            for r in events.select("a", "b").toLocalIterator():
                total[np.searchsorted(state, _arr(bytes(r.a), np.uint64))] += _arr(bytes(r.b), np.float64)
        plan["states"] = plan["states"] | {k: (state, np.where(total >= gain, kinds, 0))}
        plan["level"] = k
        answers = answers.union(got.where("chunk >= 0").select("chunk", "part", "a", "b", F.lit(k).alias("kind")))
    return pass_over(True, RESULT)
