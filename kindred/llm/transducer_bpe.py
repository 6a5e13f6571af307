"""BPE encoding and decoding with a minimal acyclic transducer.

The corpus's most frequent words (at most ``LEXICON``, by counts over all texts) are compiled into a
deterministic automaton whose equal suffixes are shared.  Its edges carry numbers; their sum along a
word's path is the word's number, which points to the word's ids.  Workers map its arrays from a
file and walk it with all distinct words of a batch at once.  Words outside it are merged exactly,
one merge a step in the order of the ranks, leftmost first, for many words at once; very long
ones with a heap.

The tokenizer file's normaliser (NFC, white space, lower case), split pattern, byte alphabet, word ends
and special tokens are followed.  Null texts count as empty and have no ids.  Rows are returned one
for one, whatever their ids; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import tempfile
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEXICON = 65_536
MARK = "S<"  # before the name of a special token; no word has an upper-case letter
SIMPLE = tuple(".,;:!?")
LONG = 48  # bytes: longer words go to the heap
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.byte = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + end] for c in alphabet], np.int32)
        pairs = [(x.split(" ") if isinstance(x, str) else x) for x in spec["model"]["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.token = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in vocab.items():
            self.token[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.token[i] = t

    NONE = np.int32(2**31 - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 16) | b
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[i] == key) & (a >= 0) & (b >= 0), self.rank[i], self.NONE)

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merges of one word, with a heap of (rank, position)."""
        ids = [*self.byte[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = dict(zip(self.key.tolist(), self.rank.tolist(), strict=True)) if not hasattr(self, "_rank") else self._rank
        self._rank = rank
        alive = [True] * len(ids)
        heap = [(rank[k], i, k) for i in range(len(ids) - 1) if (k := ids[i] << 16 | ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            r, i, k = heapq.heappop(heap)
            j = after[i] if alive[i] else len(ids)
            if j >= len(ids) or ids[i] << 16 | ids[j] != k:
                continue
            ids[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (k := ids[x] << 16 | ids[y]) in rank:
                    heapq.heappush(heap, (rank[k], x, k))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merges of many words."""
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words])
        for lo, hi in ((0, 6), (6, 12), (12, 24), (24, LONG)):
            for part in np.array_split(at := np.flatnonzero((size > lo) & (size <= hi)), len(at) // 50_000 + 1):
                if len(part):
                    for i, ids in zip(part.tolist(), self._merge([words[i] for i in part], size[part], hi), strict=True):
                        out[i] = ids
        for i in np.flatnonzero(size > LONG):
            out[i] = self.merge_long(words[i])
        return out

    def _merge(self, words: list[bytes], size: np.ndarray, width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        col = np.arange(width)
        ids = np.where(col < size[:, None], self.byte[raw], -1)
        ids[np.arange(len(ids)), size - 1] = self.last[raw[np.arange(len(ids)), size - 1]]
        ranks = np.full_like(ids, self.NONE)
        ranks[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        done, row = ids.copy(), np.arange(len(ids))
        while len(row):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            go = best != self.NONE
            if not go.all():
                done[row[~go]] = ids[~go]
                row, ids, ranks, at, best = row[go], ids[go], ranks[go], at[go], best[go]
                if not len(row):
                    break
            n = np.arange(len(row))
            shift = col[None, :] > at[:, None]
            ids = np.where(shift, np.concatenate([ids[:, 1:], np.full((len(row), 1), -1, ids.dtype)], 1), ids)
            ranks = np.where(shift, np.concatenate([ranks[:, 1:], np.full((len(row), 1), self.NONE, ranks.dtype)], 1), ranks)
            ids[n, at] = self.made[best]
            right, left = np.minimum(at + 1, width - 1), np.maximum(at - 1, 0)
            ranks[n, at] = np.where(at + 1 < width, self.ranks(ids[n, at], ids[n, right]), self.NONE)
            before = self.ranks(ids[n, left], ids[n, at])
            ranks[n[at > 0], left[at > 0]] = before[at > 0]
        lens = (done >= 0).sum(1).tolist()
        return [x[:k] for x, k in zip(done.tolist(), lens, strict=True)]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """Sorted words and their ids -> the arrays of the minimal transducer, one after another.

    Arrays: edge keys (state << 8 | byte, sorted), targets, edge numbers, final marks, ids' ends, ids.
    """
    register: dict = {}
    edges_of: list[dict] = [{}]
    final = [False]
    path, previous = [0], b""

    def settle(depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            state = path[i]
            key = (final[state], tuple(edges_of[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                edges_of[path[i - 1]][previous[i - 1]] = same
        del path[depth + 1 :]

    for w in words:
        common = next((i for i, (a, b) in enumerate(zip(w, previous, strict=False)) if a != b), min(len(w), len(previous)))
        settle(common)
        for b in w[common:]:
            edges_of.append({})
            final.append(False)
            edges_of[path[-1]][b] = len(final) - 1
            path.append(len(final) - 1)
        final[path[-1]] = True
        previous = w
    settle(0)
    number: dict[int, int] = {}
    order: list[int] = []
    stack = [(0, False)]
    while stack:
        state, seen = stack.pop()
        if seen:
            number[state] = final[state] + sum(number[t] for t in edges_of[state].values())
            order.append(state)
        elif state not in number:
            number[state] = 0
            stack.append((state, True))
            stack += [(t, False) for t in edges_of[state].values() if t not in number]
    name = {s: i for i, s in enumerate(sorted(order))}  # the start is 0
    rows = []
    for s in order:
        before = int(final[s])
        for b, t in sorted(edges_of[s].items()):
            rows.append((name[s] << 8 | b, name[t], before))
            before += number[t]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    marks = np.array([final[s] for s in sorted(order)], np.int64)
    ends = np.cumsum([len(x) for x in ids]).astype(np.int64)
    arrays = [table[:, 0], table[:, 1], table[:, 2], marks, ends, np.array([i for x in ids for i in x], np.int64)]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


class Lexicon:
    """A compiled transducer, mapped from a file that is gone when the map is."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, np.int64, 6)
        cut = 6 + np.concatenate([[0], np.cumsum(sizes)])
        self.key, self.to, self.add, self.final, self.ends, self.ids = (np.frombuffer(self.map, np.int64, n, 8 * int(c)) for n, c in zip(sizes, cut, strict=False))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        out = np.full(len(words), -1, np.int64)
        row, state, total, i = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(row) and len(self.key):
            end = size[row] == i
            good = end & (self.final[state] == 1)
            out[row[good]] = total[good]
            row, state, total = row[~end], state[~end], total[~end]
            key = state << 8 | flat[start[row] + i]
            e = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[e] == key
            row, state, total = row[ok], self.to[e[ok]], total[ok] + self.add[e[ok]]
            i += 1
        return out

    def ids_of(self, numbers: np.ndarray) -> list[list[int]]:
        start, end = np.where(numbers > 0, self.ends[numbers - 1], 0), self.ends[numbers]
        cut = np.cumsum(end - start)
        flat = self.ids[np.arange(cut[-1] if len(cut) else 0) + np.repeat(end - cut, end - start)].tolist()
        return [flat[x:y] for x, y in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)] if len(cut) else []


def runs_of(text: str) -> list[str]:
    """The runs of a text between white space; words lie within them."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # str.split() takes these for white space
        return [w for w in text.replace("\n", " ").split(" ") if w]
    return text.split()


def splitter(special: dict):
    """A function from runs, none with a line break, to the words of each.  Special tokens are words that start with MARK."""
    import regex

    pattern = regex.compile(PATTERN)
    marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def plain(runs: list[str]) -> list[list[str]]:
        """Normalised together, since no step reaches over a line break."""
        whole = "\n".join(runs)
        if not whole.isascii():
            whole = unicodedata.normalize("NFC", whole).replace("Σ", "σ")
        find = pattern.findall
        return [[r] if r.isalpha() else [r[:-1], r[-1]] if r[-1:] in SIMPLE and r[:-1].isalpha() else find(r) for r in whole.lower().split("\n")]

    def marked(run: str) -> list[str]:
        out, at = [], 0
        for m in marks.finditer(run):
            out += [*plain([run[at : m.start()]])[0], MARK + m.group()]
            at = m.end()
        return out + plain([run[at:]])[0]

    def words(runs: list[str]) -> list[list[str]]:
        out, whole = plain(runs) if runs else [], "\n".join(runs)
        if any(name in whole for name in special):
            out = [marked(r) if any(name in r for name in special) else w for r, w in zip(runs, out, strict=True)]
        return out

    return words


def _counts(batches, special: dict):
    words, seen = splitter(special), Counter()

    def rows():
        found: dict = {}
        get = found.get
        for split, n in zip(words(list(seen)), seen.values(), strict=True):
            for w in split:
                found[w] = get(w, 0) + n
        batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return batch

    for b in batches:
        for t in b.column(0):
            seen.update(runs_of(t.as_py() or ""))
            if len(seen) > 400_000:
                yield rows()
    yield rows()


def frequency_class(n: str):
    """A count itself below 1,024, beyond that 128 classes for each doubling; larger counts never have smaller classes."""
    return F.when(F.col(n) < 1024, F.col(n)).otherwise(F.floor(128 * F.log2(n)) - 256).cast("long")


class Coder:
    """Ids of words: from the lexicon, else by merges."""

    def __init__(self, vocab: Vocabulary, lexicon: bytes):
        self.vocab, self.lexicon, self.words = vocab, Lexicon(lexicon), splitter(vocab.special)

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words, all at once."""
        special = [w.startswith(MARK) for w in words]
        raw = [w.encode() for w, s in zip(words, special, strict=True) if not s]
        number = self.lexicon.find(raw)
        listed, merged = iter(self.lexicon.ids_of(number[number >= 0])), iter(self.vocab.merge([raw[i] for i in np.flatnonzero(number < 0)]))
        plain = (next(listed) if n >= 0 else next(merged) for n in number.tolist())
        return [[self.vocab.special[w[len(MARK) :]]] if s else next(plain) for w, s in zip(words, special, strict=True)]

    def ids(self, runs: list[str]) -> list[list[int]]:
        """Ids of runs, all at once."""
        split = self.words(runs)
        new = list(dict.fromkeys(chain.from_iterable(split)))
        known = dict(zip(new, self.word_ids(new), strict=True))
        return [known[s[0]] if len(s) == 1 else [i for w in s for i in known[w]] for s in split]


class Phrases:
    """The decimal ids and the decoded text of runs, each joined by spaces.

    It remembers runs and words, so that a word costs its search or merges once though it stands in many runs.
    """

    def __init__(self, coder: Coder, memory: int):
        self.coder, self.memory, self.token = coder, memory, coder.vocab.token
        self.decimal = [str(i) for i in range(len(self.token))]
        self.runs: dict = {}
        self.words: dict = {}

    def of(self, runs: list[str]) -> list[tuple[str, str]]:
        """(ids, text) of distinct runs; both are empty for a run without a word."""
        new = [r for r in runs if r not in self.runs]
        if len(self.runs) + len(new) > self.memory:
            self.runs, self.words, new = {}, {}, runs
        split, words, decimal, token = self.coder.words(new), self.words, self.decimal, self.token
        fresh = list(set(chain.from_iterable(split)).difference(words))
        for w, ids in zip(fresh, self.coder.word_ids(fresh), strict=True):
            words[w] = (decimal[ids[0]], token[ids[0]]) if len(ids) == 1 else (" ".join([decimal[i] for i in ids]), " ".join([token[i] for i in ids]))
        for r, s in zip(new, split, strict=True):
            if len(s) == 1:
                self.runs[r] = words[s[0]]
            elif len(s) == 2:
                (a, x), (b, y) = words[s[0]], words[s[1]]
                self.runs[r] = f"{a} {b}", f"{x} {y}"
            else:
                found = [words[w] for w in s]
                self.runs[r] = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
        return [self.runs[r] for r in runs]


def encode_lists(texts: list, vocab: Vocabulary, lexicon: bytes) -> list[list[int]]:
    """Ids of a few texts."""
    coder, split = Coder(vocab, lexicon), [runs_of(t or "") for t in texts]
    runs = list(dict.fromkeys(r for s in split for r in s))
    known = dict(zip(runs, coder.ids(runs), strict=True))
    return [[i for r in s for i in known[r]] for s in split]


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The file names no decoder, so tokens are joined by spaces."""
    return " ".join([vocab.token[i] for i in ids])


def _joined(split: list[list[str]], phrases: Phrases) -> tuple:
    """Ids and decoded texts of split texts.  Texts hold numbers of distinct runs, and Arrow joins their strings."""
    coded = pa.array(chain.from_iterable(split), pa.large_string()).dictionary_encode()
    runs = coded.dictionary.to_pylist()
    found = phrases.of(runs)
    if ("", "") in found:
        blank = {r for r, (ids, _) in zip(runs, found, strict=True) if not ids}
        return _joined([[r for r in s if r not in blank] for s in split], phrases)
    ends = np.cumsum([0, *map(len, split)])
    whole = (pa.array([f[j] for f in found], pa.large_string()).take(coded.indices) for j in (0, 1))
    return tuple(pc.binary_join(pa.LargeListArray.from_arrays(ends, x), pa.scalar(" ", pa.large_string())) for x in whole)


def _digests(batches, shared, memory: int = 600_000):
    """``memory``: how many runs a task remembers before it starts afresh."""
    vocab, lexicon = cloudpickle.loads(shared.value)
    phrases, sha = Phrases(Coder(vocab, lexicon), memory), hashlib.sha256
    collects = gc.isenabled()
    gc.disable()  # there are no cycles, and a collection would pass through all that is remembered
    try:
        for batch in batches:
            for i in range(0, batch.num_rows, 400):
                b = batch.slice(i, 400)
                ids, text = _joined([runs_of(t or "") for t in b.column("text").to_pylist()], phrases)
                n = pc.if_else(pc.equal(pc.binary_length(ids), 0), 0, pc.add(pc.count_substring(ids, " "), 1)).cast(pa.int64())
                digests = [pa.array([sha(x.as_buffer()).hexdigest() for x in c], pa.string()) for c in (ids, text)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    finally:
        if collects:
            gc.enable()


def lexicon_of(texts: DataFrame, vocab: Vocabulary, size: int = LEXICON) -> bytes:
    """The transducer of the most frequent words of column ``text``.

    The lexicon is every word above the least frequency class that at most ``size`` words exceed, so
    no more than ``size`` words reach the driver however many partitions there are.
    """
    special, scratch = vocab.special, Scratch(texts.sparkSession)
    counted = texts.select("text").mapInArrow(lambda it: _counts(it, special), "word string, n long")
    words = scratch.put(counted.groupBy("word").agg(F.sum("n").alias("n")).where(~F.col("word").startswith(MARK)).select("word", frequency_class("n").alias("class")))
    sizes = {r["class"]: r["count"] for r in words.groupBy("class").count().collect()}  # a few thousand classes at most
    least, taken = max(sizes, default=0) + 1, 0
    for c in sorted(sizes, reverse=True):
        taken += sizes[c]
        if taken > size:
            break
        least = c
    top = sorted(r.word.encode() for r in words.where(F.col("class") >= least).select("word").collect())
    scratch.drop(words)
    return compile_lexicon(top, vocab.merge(top))


def digests(docs: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """(doc_id, n_tokens, and SHA-256 of the ids and of the decoded text) of each row of (doc_id, text)."""
    vocab = Vocabulary(path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((vocab, lexicon_of(docs, vocab, size))))
    return docs.mapInArrow(lambda it: _digests(it, shared), RESULT)
