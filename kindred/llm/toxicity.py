"""Toxicity by weak supervision.

Voters are lexicon words and word-prefix patterns, each with a least number or share of a text's words,
induced from labelled training rows by support and log-odds.  A generative label model takes each voter's vote as noisy evidence
of a hidden label: EM over labelled and unlabelled rows, anchored in the rates on the labelled ones, estimates the voters' rates of
voting on either class and, from the posterior-weighted co-occurrence of votes on toxic rows, their correlations; a voter's
evidence counts by one over its effective number of copies, the sum of its squared correlations.  A linear classifier is
trained on the posterior labels of all those rows, with the votes and the shares of words that voted as its inputs, and scores every text.

Only the voters and the anchor use labels: at most ``LABELLED`` labelled rows of each class, drawn by a hash of the id
from all that may be learned from.  At most about ``UNLABELLED`` texts without a label are drawn by a hash of id and text.
Voters, model and classifier have bounded sizes.  Scoring reads the text alone.

Null and empty texts get the score of a text without votes.  Documents labelled more than once count as
toxic if a label says so; null labels are ignored; where an id is on several texts the least text, by its hash, is learned from.
Without labelled rows of both classes every score is 0.
Repeated rows are scored each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 3000  # rows of each class
UNLABELLED = 3000  # rows, about
VOTERS = 192
PREFIXES = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")
LEVELS = (("", lambda n, words: True), ("@2", lambda n, words: n >= 2), ("@4", lambda n, words: n >= 4), ("%1", lambda n, words: n >= 2 and 100 * n >= words), ("%3", lambda n, words: n >= 2 and 33 * n >= words))
RESULT = "doc_id long, score double, n_votes long"


def patterns_of(word: str) -> list[str]:
    """A word's own pattern, and those of its proper prefixes (with a star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def voters_of(n: int, words: int) -> list[str]:
    """The levels that n of a text's words reach."""
    return [x for x, ok in LEVELS if ok(n, words)]


def votes_of_text(counts: dict) -> set[str]:
    """All voters, known or not, that vote on a text with these word counts."""
    total, found = sum(counts.values()), Counter()
    for w, n in counts.items():
        for p in patterns_of(w):
            found[p] += n
    return {p + level for p, n in found.items() for level in voters_of(n, total)}


def induced(counted: list[dict], toxic: np.ndarray, limit: int = VOTERS) -> list[str]:
    """Voters by support times log-odds; of those with the same documents, the first and shortest."""
    yes, no = Counter(), Counter()
    for c, t in zip(counted, toxic, strict=True):
        if t:
            yes.update(votes_of_text(c))
    yes = Counter({p: n for p, n in yes.items() if n >= max(3, toxic.sum() // 1000)})
    for c, t in zip(counted, toxic, strict=True):
        if not t:
            no.update(votes_of_text(c) & yes.keys())
    a, b = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    scored = []
    for p, n in yes.items():
        odds = np.log((n + 0.5) / (a + 1)) - np.log((no.get(p, 0) + 0.5) / (b + 1))
        if odds > np.log(8):
            scored.append((-n * odds, len(p), p))
    chosen = sorted(scored)[: 8 * limit]
    where = defaultdict(list)
    names = {p for *_, p in chosen}
    for i, c in enumerate(counted):
        if toxic[i]:
            for p in votes_of_text(c) & names:
                where[p].append(i)
    seen, left, out = set(), np.full(len(counted), 4), []  # each toxic row should get up to four voters
    for *_, p in chosen:
        at = where[p]
        key = tuple(at)
        if key not in seen and (left[at] > 0).sum() >= max(2, len(at) // 50):
            seen.add(key)
            left[at] -= 1
            out.append(p)
    return out[:limit]


class LabelModel:
    """Rates of the voters on either class, and the correlations of their votes on toxic rows.

    EM on the votes of all rows; it starts from the rates on labelled rows (``known``), which also count as ``anchor`` rows of
    each class throughout.  A voter that is silent abstains; only the silence of all is evidence.
    """

    def __init__(self, votes: np.ndarray, toxic: np.ndarray, known: np.ndarray, prior: float, weight: np.ndarray, rounds: int = 10, anchor: float = 200.0):
        votes = np.concatenate([votes, votes.any(1, keepdims=True)], 1).astype(float)
        true, false = known & toxic, known & ~toxic
        yes, no = (votes[true].sum(0) + 0.5) / (true.sum() + 1), (votes[false].sum(0) + 0.5) / (false.sum() + 1)
        self.yes, self.no, self.prior = yes, no, prior
        self.correlation = self.correlations(votes[:, :-1], true.astype(float))
        for _ in range(rounds):
            q = self._posterior(votes)
            w1, w0 = weight * q, weight * (1 - q)
            self.yes = (votes.T @ w1 + anchor * yes) / (w1.sum() + anchor)
            self.no = (votes.T @ w0 + anchor * no) / (w0.sum() + anchor)
            self.correlation = self.correlations(votes[:, :-1], w1)

    @staticmethod
    def correlations(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weighted correlations of the voters."""
        mean = weight @ votes / max(weight.sum(), 1e-9)
        rows = (votes - mean) * np.sqrt(weight)[:, None]
        cov = rows.T @ rows
        size = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        out = np.clip(cov / np.outer(size, size), -1, 1)
        np.fill_diagonal(out, 1)
        return out

    @property
    def share(self) -> np.ndarray:
        """One over each voter's effective number of copies; correlations within the noise of the sample don't count."""
        return 1 / (np.where(self.correlation > 0.3, self.correlation, 0) ** 2).sum(1)

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        cast = votes[:, :-1] @ (self.share * np.log(self.yes / self.no)[:-1])
        silent = (1 - votes[:, -1]) * np.log((1 - self.yes[-1] + 1e-4) / (1 - self.no[-1] + 1e-4))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + cast + silent, -30, 30)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior(np.concatenate([votes, votes.any(1, keepdims=True)], 1).astype(float))


def inputs(votes: np.ndarray, share: np.ndarray, words_voting: np.ndarray) -> np.ndarray:
    """The classifier's inputs."""
    any_ = np.minimum(votes.sum(1, keepdims=True), 3)
    return np.concatenate([votes * share, any_ > 0, any_, np.log1p(words_voting)[:, None], np.ones((len(votes), 1))], 1).astype(float)


def linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w, weight = np.zeros(x.shape[1]), weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


class Scorer:
    def __init__(self, voters: list[str], share: np.ndarray, w: np.ndarray):
        self.voters, self.share, self.w = voters, share, w
        self.at = {p: i for i, p in enumerate(voters)}
        self.used, self.by_word = {re.sub(r"[@%].*", "", v) for v in voters}, {}

    def votes(self, counted: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Votes on texts by their word counts, and how many words voted."""
        votes, n = np.zeros((len(counted), len(self.voters)), np.int8), np.zeros(len(counted))
        if len(self.by_word) > 500_000:
            self.by_word = {}
        by_word, used = self.by_word, self.used
        for i, counts in enumerate(counted):
            found: dict = {}
            for word, k in counts.items():
                hits = by_word.get(word)
                if hits is None:
                    hits = by_word[word] = tuple(p for p in patterns_of(word) if p in used)
                if hits:
                    n[i] += k
                    for p in hits:
                        found[p] = found.get(p, 0) + k
            if found:
                total = sum(counts.values())
                votes[i, [self.at[v] for p, k in found.items() for level in voters_of(k, total) if (v := p + level) in self.at]] = 1
        return votes, n

    def score(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(votes, self.share, n) @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Scorer | None:
    """Voters, label model and classifier from (doc_id, toxic) and the texts of (doc_id, text)."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    drawn = [one.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled) for t in (True, False)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def words(batches):
        for b in batches:
            found = [Counter(LETTERS.findall(t.lower())) for t in b.column("text").to_pylist()]
            lists = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *lists], names=["toxic", "words", "counts"])

    # at most twice ``labelled`` ids are broadcast, and as many documents' distinct words reach the driver, and those of the unlabelled
    chosen = F.broadcast(drawn[0].union(drawn[1]))
    mine = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("toxic", "text"), F.xxhash64("text")).alias("x")).select("x.*")
    h, n_docs = F.xxhash64("doc_id", F.xxhash64("text")), texts.count()
    others = texts.where(h < F.lit(min(2**63 - 1, int(unlabelled / max(n_docs, 1) * 2**64) - 2**63))).join(one.select("doc_id"), "doc_id", "left_anti").select(F.lit(None).cast("boolean").alias("toxic"), "text")
    sample = mine.union(others).mapInArrow(words, "toxic boolean, words array<string>, counts array<int>")
    toxic, known, counted, intern = [], [], [], {}
    for r in sample.toLocalIterator():
        toxic.append(bool(r.toxic)), known.append(r.toxic is not None)
        counted.append({intern.setdefault(w, w): n for w, n in zip(r.words, r.counts, strict=True)})
    toxic, known = np.array(toxic, bool), np.array(known, bool)
    if not (known & toxic).any() or not (known & ~toxic).any():
        return None
    voters = induced([c for c, k in zip(counted, known, strict=True) if k], toxic[known])
    if not voters:
        return None
    scorer = Scorer(voters, np.ones(len(voters)), np.zeros(0))
    votes, n = scorer.votes(counted)
    prior, share = sizes[True] / sum(sizes.values()), toxic[known].mean()
    weight = np.where(~known, 1.0, np.where(toxic, prior / share, (1 - prior) / (1 - share)))
    model = LabelModel(votes, toxic, known, prior, weight)
    scorer.share = model.share
    scorer.w = linear(inputs(votes, scorer.share, n), model.posterior(votes), weight)
    return scorer


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """(doc_id, score, n_votes) of each row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def apply(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                votes, n = scorer.votes([Counter(LETTERS.findall((t or "").lower())) for t in b.column("text").to_pylist()]) if scorer else (np.zeros((b.num_rows, 1)), None)
                s = scorer.score(votes, n) if scorer else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(votes.sum(1).astype(np.int64))], names=["doc_id", "score", "n_votes"])

    return docs.mapInArrow(apply, RESULT)


def keep(docs: DataFrame, scorer: Scorer | None, limit: float) -> DataFrame:
    """The rows, all columns, whose text scores below ``limit``."""
    if scorer is None:
        return docs
    names = [f.name for f in docs.schema]

    def apply(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                votes, n = scorer.votes([Counter(LETTERS.findall((t or "").lower())) for t in b.column(names.index("text")).to_pylist()])
                yield b.filter(pa.array(scorer.score(votes, n) < limit))

    return docs.mapInArrow(apply, docs.schema)
