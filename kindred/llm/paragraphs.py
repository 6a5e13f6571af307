"""Substring dedup: MinHash banding of paragraphs that begin and end anywhere.

A paragraph is a stretch of ``LEAST`` words (A-Z lower-cased, split at white space), wherever it begins and however it is
broken over lines.  Two paragraphs are near-duplicates if their 5-word shingles have a Jaccard similarity of 0.8 or more.

Banding.  At 20 words that means 15 of 16 shingles in common: the paragraphs share a run of 19 words, their core.  The
MinHash of a core is the least of its shingle hashes, and paragraphs with equal cores have equal MinHashes, so one band
of one row has a recall of exactly 1 (``core_words`` works the core out of length and similarity and refuses lengths for
which one band would not do).  Cores that overlap mostly share their least shingle, so a text of n words gives about
n / 8 band keys, not n.  Longer paragraphs of that similarity hold such a core, too.

Verification.  Keys that occur at two places or more go into a Bloom filter of at most ``BLOOM`` bits; the places it lets
through meet in buckets by key, with the 64-bit hashes of the cores that have that key.  A core is looked up by its hash,
which tells at once which earlier place has it: the links of a bucket are found without comparing pairs, and a key that
the filter let through by chance finds nothing.  Buckets of over ``hot`` places are not brought together: their cores are
grouped one by one, with a first place for each, before they are dealt.  Cores that touch on one diagonal join to runs;
two runs of the same two texts join across the words between them if the Jaccard similarity of the joined paragraphs is
0.8 or more.

Clusters.  Paragraphs are linked with the place that has them first; components of the links are the clusters.  A
place stays if no earlier place (smallest doc_id, then text hash, then position) has its words, so of each cluster the
first stays; where a text repeats itself the first place stays whole.

Words are known by 32-bit hashes.  Null texts count as empty and stay null; texts of fewer than 19 words hold no paragraph.
Rows with the same id and text are one document and are treated alike.  Rows without an id come first in order.  Extra
columns are kept, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, components, gathered, mix, words_of

SHINGLE = 5
LEAST = 20  # words of a paragraph
SIMILARITY = 0.8
BLOOM = 1 << 28  # bits, at most
BLOCK = 1 << 16  # bits of one block of the filter
STEP = 1 << 20  # cores that are worked on at a time
SPOT = np.uint64((1 << 21) - 1)  # places within a step
TERMS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def core_words(least: int = LEAST, similarity: float = SIMILARITY) -> int:
    """The words in a row that any two paragraphs of ``least`` words or more with this similarity share."""
    n = least - SHINGLE + 1
    common = math.ceil(2 * n * similarity / (1 + similarity) - 1e-9)
    if n < 1 or n - common >= SHINGLE:
        raise ValueError("paragraphs of this length and similarity can differ in their middle: one band would lose some")
    return common + SHINGLE - 1


def _words(batches):
    """(doc_id, key, text) -> (doc_id, key, doc, words): a 32-bit hash for each word."""
    import xxhash

    for batch in batches:
        for i in range(0, batch.num_rows, 250):
            b = batch.slice(i, 250)
            flat, n = words_of(b.column("text"))
            enc = flat.dictionary_encode()
            h = np.fromiter((xxhash.xxh32_intdigest(w) for w in enc.dictionary.to_pylist()), np.uint32, len(enc.dictionary))
            h = h[np.asarray(enc.indices)] if len(flat) else np.zeros(0, np.uint32)
            ends = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("doc"), words], names=["doc_id", "key", "doc", "words"])


def flat_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows in one array, and the number in each."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    words = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint32) if data is not None else np.zeros(0, np.uint32)
    return words, np.diff(ends) // 4


def _sums(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, along the last axis."""
    n = x.shape[-1] - k + 1
    with np.errstate(over="ignore"):
        out = np.full((*x.shape[:-1], n), np.uint64(k))
        for j in range(k):
            out += x[..., j : j + n] * TERMS[j]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(32))


def band_keys(words: np.ndarray, n: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (in ``words``) and hashes of the least shingles of all cores; of equal shingles in a core the first counts.

    With each place, where the cores begin that have it, and how many they are.
    """
    if len(words) < core:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    shingles, width = _sums(words.astype(np.uint64), SHINGLE), core - SHINGLE + 1
    left = np.repeat(np.cumsum(n), n) - np.arange(len(words))  # words from here to the end of the text
    found, starts = [], []
    for lo in range(0, len(words) - core + 1, STEP):
        part = shingles[lo : lo + STEP + width - 1]
        least, span = (part & ~SPOT) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        start = np.flatnonzero(left[lo : lo + len(least)] >= core)
        found.append(lo + (least[start] & SPOT).astype(np.int64))
        starts.append(lo + start)
    at, start = np.concatenate(found), np.concatenate(starts)
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    return at[edge], shingles[at[edge]], start[edge], np.diff(np.append(edge, len(at)))


def _bands(batches, core: int):
    """(doc, words) -> (gram, doc, at): the band keys of a text, and where they are."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            b = batch.slice(i, 1000)
            words, n = flat_words(b.column("words"))
            at, gram, _, _ = band_keys(words, n, core)
            row = np.searchsorted(np.cumsum(n), at, side="right")
            first = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), b.column("doc").take(pa.array(row)), pa.array((at - first[row]).astype(np.int32))], names=["gram", "doc", "at"])


def _spots(gram: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each key, and its three bits there."""
    h = mix(gram, np.full_like(gram, 17))
    return (h >> np.uint64(48)).astype(np.int64) % blocks, [((h >> np.uint64(16 * k)) & np.uint64(BLOCK - 1)).astype(np.int64) for k in range(3)]


def _fill(batches, blocks: int):
    """(block, gram), all keys of a block in one task -> (block, bits)."""
    found: dict[int, np.ndarray] = {}
    for b in batches:
        block, spots = _spots(np.asarray(b.column("gram")).view(np.uint64), blocks)
        for k in np.unique(block).tolist():
            bits = found.setdefault(k, np.zeros(BLOCK, bool))
            for spot in spots:
                bits[spot[block == k]] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in found.values()], pa.binary())], names=["block", "bits"])


def _filter(common: DataFrame):
    """A Bloom filter of the keys, in blocks, as a broadcast of ``BLOOM`` bits at most; beyond that it lets more through."""
    spark, n = common.sparkSession, common.count()
    blocks = 1 << max(0, min(BLOOM // BLOCK, 12 * n // BLOCK).bit_length() - 1)
    filled = common.select("gram").mapInArrow(lambda it: _numbered(it, blocks), "block int, gram long").repartition("block").mapInArrow(lambda it: _fill(it, blocks), "block int, bits binary")
    bits = np.zeros(blocks * BLOCK // 8, np.uint8)
    for r in filled.toLocalIterator():
        bits[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes()), blocks


def _numbered(batches, blocks: int):
    for b in batches:
        block, _ = _spots(np.asarray(b.column("gram")).view(np.uint64), blocks)
        yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), b.column("gram")], names=["block", "gram"])


def _cores(batches, core: int, shared, blocks: int):
    """(doc_id, key, words) -> (gram, doc_id, key, at, cores): the cores, from place ``at`` on, of the keys that the filter lets through."""
    bits = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            b = batch.slice(i, 500)
            words, n = flat_words(b.column("words"))
            _, gram, start, count = band_keys(words, n, core)
            block, spots = _spots(gram, blocks)
            ok = np.ones(len(gram), bool)
            for spot in spots:
                spot = block * BLOCK + spot
                ok &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
            if not ok.any():
                continue
            gram, start, count = gram[ok], start[ok], count[ok]
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(start, count)
            h = _sums(words.astype(np.uint64), core)[at]
            row = np.searchsorted(np.cumsum(n), start, side="right")
            take, first = pa.array(row), np.cumsum(n) - n
            cores = pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(np.concatenate([[0], 8 * ends]).astype(np.int32)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([
                pa.array(gram.view(np.int64)), b.column("doc_id").take(take), b.column("key").take(take), pa.array((start - first[row]).astype(np.int32)), cores,
            ], names=["gram", "doc_id", "key", "at", "cores"])


def _flat_cores(t: pa.RecordBatch):
    """Row, place and hash of all cores."""
    _, ends, data = t.column("cores").buffers()
    ends = np.frombuffer(ends, np.int32)[t.column("cores").offset :][: t.num_rows + 1]
    count = np.diff(ends) // 8
    row = np.repeat(np.arange(t.num_rows), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.asarray(t.column("at")).astype(np.int64), count)
    return row, at, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint64)


FOUND = "doc_id long, key long, p_doc_id long, p_key long, diagonal int, start int, stop int"


def _verify(batches, core: int):
    """Rows (gram, doc_id, key, at, cores) sorted by gram and place -> FOUND: the words of each place that an earlier one has."""

    def done(t: pa.RecordBatch) -> pa.RecordBatch:
        row, at, h = _flat_cores(t)
        doc, key = t.column("doc_id"), np.asarray(t.column("key"))
        none, doc_ = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0))
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        f = first[back]  # rows are in order, so this is the first place of the core
        i, j = row, row[f]
        same = (none[i] == none[j]) & (doc_[i] == doc_[j]) & (key[i] == key[j])
        keep = ~(same & (at == at[f]))
        i, j, same, diagonal, at = i[keep], j[keep], same[keep], (at - at[f])[keep], at[keep]
        new = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)]) if len(i) else np.zeros(0, bool)
        edge = np.flatnonzero(new)
        last = np.append(edge[1:], len(i)) - 1 if len(edge) else edge
        start = np.where(same[edge], np.maximum(at[edge], at[edge] - diagonal[edge] + core), at[edge])
        mine, theirs = pa.array(i[edge]), pa.array(j[edge])
        return pa.RecordBatch.from_arrays([
            doc.take(mine), t.column("key").take(mine), doc.take(theirs), t.column("key").take(theirs),
            *[pa.array(x.astype(np.int32)) for x in (diagonal[edge], start, at[last] + core)],
        ], names=["doc_id", "key", "p_doc_id", "p_key", "diagonal", "start", "stop"])

    rest = None
    for b in batches:
        t = pa.Table.from_batches([rest, b] if rest is not None else [b]).combine_chunks().to_batches()
        if not t:
            continue
        t = t[0]
        gram = np.asarray(t.column("gram"))
        cut = int(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[-1])
        if cut:
            yield done(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield done(rest)


def _split(batches):
    """The rows of _verify -> (h, doc_id, key, at): one row for each core."""
    for b in batches:
        row, at, h = _flat_cores(b)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc_id").take(take), b.column("key").take(take), pa.array(at.astype(np.int32))], names=["h", "doc_id", "key", "at"])


def _within():
    """Whether a place and the first place of its words are in the same text."""
    return F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("key") == F.col("p_key"))


def _by_core(rows: DataFrame, core: int) -> DataFrame:
    """What _verify returns, a row for each core, for buckets of any size."""
    each, place = rows.mapInArrow(_split, "h long, doc_id long, key long, at int"), F.struct("doc_id", "key", "at")
    first = each.groupBy("h").agg(F.min(place).alias("p"))
    found = each.join(first, "h").where(~place.eqNullSafe(F.col("p"))).select("doc_id", "key", F.col("p.doc_id").alias("p_doc_id"), F.col("p.key").alias("p_key"), "at", F.col("p.at").alias("p_at"))
    start = F.when(_within(), F.greatest("at", F.col("p_at") + core)).otherwise(F.col("at"))
    return found.select("doc_id", "key", "p_doc_id", "p_key", (F.col("at") - F.col("p_at")).alias("diagonal"), start.alias("start"), (F.col("at") + core).alias("stop"))


def joined(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, stop, ...) -> with ``stretch``: a number for each set of spans that overlap or touch."""
    order = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    return new.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def _keyed(docs: DataFrame) -> DataFrame:
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("key"), F.xxhash64(id_, F.xxhash64(text)).alias("doc"), text.alias("text"))


def _cores_found(scratch: Scratch, docs: DataFrame, core: int, hot: int) -> DataFrame:
    """FOUND: the words that an earlier place has, and where they are there."""
    texts = scratch.put(_keyed(docs).mapInArrow(_words, "doc_id long, key long, doc long, words binary"))
    keys = texts.select("doc", "words").mapInArrow(lambda it: _bands(it, core), "gram long, doc long, at int")
    spot = F.xxhash64("doc", "at")
    common = scratch.put(keys.groupBy("gram").agg(F.min(spot).alias("x"), F.max(spot).alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("gram", "n"))
    shared, blocks = _filter(common)
    members = texts.select("doc_id", "key", "words").mapInArrow(lambda it: _cores(it, core, shared, blocks), "gram long, doc_id long, key long, at int, cores binary")
    large = common.where(F.col("n") > hot).select("gram")
    some = not large.isEmpty()
    plain = members.join(large, "gram", "left_anti") if some else members
    found = gathered(plain, "gram").sortWithinPartitions("gram", "doc_id", "key", "at").mapInArrow(lambda it: _verify(it, core), FOUND)
    if some:
        found = found.union(_by_core(members.join(large, "gram", "left_semi"), core))
    out = scratch.put(found)
    scratch.drop(texts, common)
    shared.unpersist()
    return out


def repeats(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST, hot: int = 1 << 18) -> DataFrame:
    """(doc_id, key, start, stop, component): the words, from start to before stop, to remove from a text; key is its hash."""
    scratch, core = Scratch(docs.sparkSession), core_words(least, similarity)
    found = _cores_found(scratch, docs, core, hot)
    pair, place = ["doc_id", "key", "p_doc_id", "p_key"], ["doc_id", "key", "start", "stop"]
    runs = joined(found.repartition("doc_id", "key"), [*pair, "diagonal"]).groupBy(*pair, "diagonal", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("stretch")
    # neighbouring runs of the same two texts, and the words between them in either
    order = Window.partitionBy(*pair).orderBy("start", "stop", "diagonal")
    before = {c: F.lag(c).over(order) for c in ("start", "stop", "diagonal")}
    gap, theirs = F.col("start") - before["stop"], F.col("start") - F.col("diagonal") - before["stop"] + before["diagonal"]
    lengths = F.col("stop") - F.col("start") + before["stop"] - before["start"]
    common, all_ = lengths - 2 * (SHINGLE - 1), 2 * lengths + gap + theirs - 2 * (SHINGLE - 1)
    near = (gap >= 0) & (theirs >= 0) & ~_within() & (common >= similarity * (all_ - common))
    runs = runs.withColumn("start", F.when(F.coalesce(near, F.lit(False)), before["stop"]).otherwise(F.col("start")))
    runs = scratch.put(runs.select(*place, "p_doc_id", "p_key", (F.col("start") - F.col("diagonal")).alias("p_start"), (F.col("stop") - F.col("diagonal")).alias("p_stop")))
    scratch.drop(found)
    # clusters: stretches that overlap, of either side, are one node; equal ones are one row
    theirs = runs.select(F.col("p_doc_id").alias("doc_id"), F.col("p_key").alias("key"), F.col("p_start").alias("start"), F.col("p_stop").alias("stop"), F.lit(0).alias("mine"))
    sides = runs.select(*place, F.lit(1).alias("mine")).union(theirs).groupBy(*place).agg(F.max("mine").alias("mine"))
    nodes = scratch.put(joined(sides.repartition("doc_id", "key"), ["doc_id", "key"]).select(*place, "mine", F.xxhash64("doc_id", "key", "stretch").alias("node")))
    spot, p_spot = F.xxhash64(*place), F.xxhash64("p_doc_id", "p_key", "p_start", "p_stop")
    named = nodes.select(spot.alias("spot"), "node")
    links = runs.select(spot.alias("spot"), p_spot.alias("p_spot")).join(named.withColumnRenamed("node", "a"), "spot").join(named.select(F.col("spot").alias("p_spot"), F.col("node").alias("b")), "p_spot")
    root = components(scratch, links.select("a", "b"))
    spans = joined(nodes.where("mine = 1"), ["doc_id", "key"]).groupBy("doc_id", "key", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("node").alias("node"))
    out = scratch.put(spans.join(root, "node", "left").select("doc_id", "key", "start", "stop", F.coalesce("root", "node").alias("component")))
    scratch.drop(runs, nodes)
    return out


def cuts(found: DataFrame) -> DataFrame:
    """(doc_id, key, spans, components) of the documents that lose words: where, and the clusters of the spans."""
    c = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "component"))).alias("c"))
    return c.select("doc_id", "key", F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("spans"), F.col("c.component").alias("components"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of ordered spans; a line break among them stays one, so lines don't run together."""
    data = text.encode()
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    out, at = [], 0
    for x, y in spans:
        lo, hi = int(starts[x]), int(starts[y]) if y < len(starts) else len(data)
        out.append(data[at:lo])
        if b"\n" in data[lo:hi] and lo and data[lo - 1] != 10:
            out.append(b"\n")
        at = hi
    return b"".join([*out, data[at:]]).decode()


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, all columns, without the words to remove."""
    names = docs.columns
    c = cuts(found).select("doc_id", "key", "spans")
    rows = docs.select(F.struct(*[docs[f"`{n}`"] for n in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    both = rows.join(c, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("key")), "left").select("row", "spans")

    def apply(batches):
        for batch in batches:
            columns = batch.column("row").flatten()
            at = names.index("text")
            hit = np.flatnonzero(np.asarray(batch.column("spans").is_valid()))
            if len(hit):
                texts = columns[at].to_pylist()
                for i in hit.tolist():
                    texts[i] = without(texts[i], [(s["start"], s["stop"]) for s in batch.column("spans")[i].as_py()])
                columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(apply, docs.schema)
