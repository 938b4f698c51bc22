"""Masked pseudo-likelihood: a bidirectional window network predicts every word from the words on both of its sides.

Words are lower-cased runs of letters and digits. The ``WORDS`` most frequent of the corpus have ids of their own, the others share
``SHARED`` ids by hash, and the probability of a shared id is dealt out among its words by their counts (``shares``). The network adds up one embedding per neighbour (a table for each of the four places), takes the hyperbolic
tangent, and predicts first the class of the middle word and then the word within its class, so that the probabilities
of all ids add up to one at the cost of two small softmaxes. The shares of an id's words and of all unseen words add up to one too. A document's score is the sum of the log-probabilities
of its words, each given its neighbours.

Training covers the corpus: every task trains a copy of the network in numpy on all of its documents, and the copies'
changes are averaged, row by row of each parameter table, with the number of times the row was
used as weight. The averages are summed on the executors in two levels, so neither a task nor the driver holds more than
one model and a bounded number of pieces; what is shuffled grows with the corpus. ``ROUNDS`` such rounds follow each other; each takes every ``ROUNDS``-th word of each
document, another residue each time, so that every word of the corpus is predicted in one of them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import alnum_words, plain_names
from ledgerspark.session import durable

CLASSES = 64
MEMBERS = 64
SHARED = 128  # ids that the less frequent words share
WORDS = CLASSES * MEMBERS - SHARED
PAD = CLASSES * MEMBERS
DIM = 16
PLACES = (-2, -1, 1, 2)
ROUNDS = 2
EVERY = ROUNDS  # a round trains on one position in so many; the rounds together on all
BATCH = 4096
RATE = 0.3
PIECE_ROWS = 64
SALTS = 64
COUNTED_WORDS = 500_000
SCORED = 1 << 13  # positions scored at once
REMEMBERED = 300_000


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each word occurs in all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"word": list(found), "n": list(found.values())})

        for batch in batches:
            for text in batch[text_col]:
                found.update(alnum_words(text))
                if len(found) > COUNTED_WORDS:
                    yield frame()
                    found.clear()
        yield frame()

    return docs.select(text_col).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> list[bytes]:
    """The ``WORDS`` most frequent words of all documents; equal counts go by the word."""
    counts = word_counts(docs, text_col) if counts is None else counts
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]


class WordIds(dict):
    """Ids of words; a word without id of its own has one of the shared ids, by its hash, and is remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        shared = WORDS + zlib.crc32(word) % SHARED
        if len(self) < REMEMBERED:
            self[word] = shared
        return shared

    def __reduce__(self):
        return WordIds, ({w: i for w, i in self.items() if i < WORDS},)


def shares(counts: DataFrame, ids: WordIds) -> tuple[DataFrame, list[float]]:
    """word, share of the words that share ids, and the share of unseen words by shared id, both as logarithms.

    A word has its count over that of its id plus one; this one is the share of all words that were not counted.
    """
    own = counts.sparkSession.createDataFrame([(w,) for w, i in ids.items() if i < WORDS], "word binary")
    rest = counts.join(F.broadcast(own), "word", "left_anti").withColumn("shared", (F.crc32("word") % SHARED).cast("int"))
    sums = {r["shared"]: r["n"] for r in rest.groupBy("shared").agg(F.sum("n").alias("n")).collect()}
    unseen = [-float(np.log1p(sums.get(k, 0))) for k in range(SHARED)]
    of_id = F.element_at(F.array(*map(F.lit, unseen)), F.col("shared") + 1)
    return rest.select("word", (F.log("n") + of_id).alias("share")), unseen


def word_ids(words: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    ids = ids if isinstance(ids, WordIds) else WordIds(ids)
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


class Network:
    """Parameter tables: embeddings by place, class weights, member weights; the last column of the weights is a bias."""

    def __init__(self, embeddings: np.ndarray, classes: np.ndarray, members: np.ndarray):
        self.embeddings, self.classes, self.members = embeddings, classes, members

    @classmethod
    def fresh(cls) -> "Network":
        draw = np.random.default_rng(11).normal
        return cls(
            draw(0, 0.3, (len(PLACES) * (PAD + 1), DIM)).astype(np.float32),
            draw(0, 0.1, (CLASSES, DIM + 1)).astype(np.float32),
            draw(0, 0.1, (PAD, DIM + 1)).astype(np.float32),
        )

    @property
    def tables(self) -> tuple[np.ndarray, ...]:
        return self.embeddings, self.classes, self.members

    def copy(self) -> "Network":
        return Network(*[t.copy() for t in self.tables])

    @staticmethod
    def rows(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Embedding rows of the neighbours of the positions ``at``."""
        return np.stack([padded[at + p] + k * (PAD + 1) for k, p in enumerate(PLACES)], axis=1)

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        out = np.ones((len(rows), DIM + 1), np.float32)
        h = self.embeddings[rows[:, 0]]
        for place in range(1, len(PLACES)):
            h += self.embeddings[rows[:, place]]
        np.tanh(h, out=out[:, :DIM])
        return out

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the word at each position, given its neighbours."""
        h, words = self.hidden(self.rows(padded, at)), padded[at]
        cls = words % CLASSES
        logits = h @ self.classes.T
        out = logits[np.arange(len(at)), cls] - _log_sum(logits)
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            mine = order[edges[c] : edges[c + 1]]
            if len(mine):
                logits = h[mine] @ self.members[c::CLASSES].T
                out[mine] += logits[np.arange(len(mine)), words[mine] // CLASSES] - _log_sum(logits)
        return out

    def step(self, padded: np.ndarray, at: np.ndarray, used: list[np.ndarray]) -> None:
        """One step of gradient descent on the positions; ``used`` counts the uses of each table's rows."""
        rows, words = self.rows(padded, at), padded[at]
        h, cls = self.hidden(rows), words % CLASSES
        n = len(at)
        p = _softmax(h @ self.classes.T)
        p[np.arange(n), cls] -= 1
        back = p @ self.classes
        change_classes = p.T @ h
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            mine = order[edges[c] : edges[c + 1]]
            if not len(mine):
                continue
            weights = self.members[c::CLASSES]
            q = _softmax(h[mine] @ weights.T)
            q[np.arange(len(mine)), words[mine] // CLASSES] -= 1
            back[mine] += q @ weights
            self.members[c::CLASSES] = weights - RATE * (q.T @ h[mine]) / np.sqrt(len(mine))
            used[2][c::CLASSES] += len(mine)
        self.classes -= RATE * change_classes / np.sqrt(n)
        used[1] += n
        slope = (back * (1 - h * h))[:, :DIM]
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        ids, first, times = np.unique(flat[order], return_index=True, return_counts=True)
        change = np.add.reduceat(np.repeat(slope, len(PLACES), axis=0)[order], first)
        self.embeddings[ids] -= RATE * change / np.sqrt(times)[:, None]
        used[0][ids] += times


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Never below the largest logit of the row, so that no log-probability is above 0."""
    top = logits.max(axis=1)
    return top + np.log(np.exp(logits - top[:, None]) @ np.ones(logits.shape[1], np.float32))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    e /= (e @ np.ones(e.shape[1], np.float32))[:, None]
    return e


def _texts(batches: Iterator[pd.DataFrame], text_col: str, ids: WordIds, size: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Row numbers and words of consecutive texts, about ``size`` words at a time, with two pads around each text."""
    for batch in batches:
        numbers, parts, held = [], [], 0
        for i, text in enumerate(batch[text_col]):
            words = word_ids(alnum_words(text), ids)
            numbers.append(len(words))
            parts.append(words)
            held += len(words)
            if held >= size:
                yield numbers, _padded(parts)
                numbers, parts, held = [], [], 0
        if numbers:
            yield numbers, _padded(parts)


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    pad = np.full(2, PAD, np.int64)
    return np.concatenate([x for p in parts for x in (pad, p)] + [pad])


def targets(numbers: list[int], padded: np.ndarray, turn: int) -> np.ndarray:
    """The positions that a round predicts: one word in ``EVERY`` of each text. Rounds that follow each other take different ones."""
    at = np.flatnonzero(padded != PAD)
    place = np.arange(len(at)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    return at[place % EVERY == turn % EVERY]


def _round(docs: DataFrame, network: Network, ids: WordIds, turn: int, text_col: str) -> Network:
    """Train a copy in every task and average the changes."""
    shared = docs.sparkSession.sparkContext.broadcast((network, ids))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, words = shared.value
        mine = start.copy()
        used = [np.zeros(len(t)) for t in mine.tables]
        for numbers, padded in _texts(batches, text_col, words, BATCH * EVERY):
            at = targets(numbers, padded, turn)
            for part in np.array_split(at, max(1, round(len(at) / BATCH))):
                if len(part):
                    mine.step(padded, part, used)
        salt = TaskContext.get().partitionId() % SALTS
        for which, (new, old, times) in enumerate(zip(mine.tables, start.tables, used, strict=True)):
            sums = (new - old) * times[:, None]
            pieces = [k for k in range(0, len(new), PIECE_ROWS) if times[k : k + PIECE_ROWS].any()]
            yield pd.DataFrame(
                {
                    "which": which, "piece": pieces, "salt": salt,
                    "times": [times[k : k + PIECE_ROWS].astype(np.float32).tobytes() for k in pieces],
                    "sums": [sums[k : k + PIECE_ROWS].astype(np.float32).tobytes() for k in pieces],
                }
            )

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: sum((np.frombuffer(x, np.float32).astype(np.float64) for x in group[c]), start=0.0).astype(np.float32).tobytes()
        return pd.DataFrame({"which": [key[0]], "piece": [key[1]], "salt": [0], "times": [total("times")], "sums": [total("sums")]})

    schema = "which int, piece int, salt int, times binary, sums binary"
    parts = docs.select(text_col).mapInPandas(fit, schema)
    sums = parts.groupBy("which", "piece", "salt").applyInPandas(add, schema).groupBy("which", "piece").applyInPandas(add, schema)
    out = network.copy()
    for row in sums.collect():  # one model
        table = out.tables[row["which"]]
        rows = slice(row["piece"], row["piece"] + PIECE_ROWS)
        times = np.frombuffer(row["times"], np.float32)[:, None]
        table[rows] += np.frombuffer(row["sums"], np.float32).reshape(len(times), -1) / np.maximum(times, 1)
    return out


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[Network, WordIds]:
    ids = WordIds({w: i for i, w in enumerate(vocabulary(docs, text_col, counts))})
    network = Network.fresh()
    for turn in range(rounds):
        network = _round(docs, network, ids, turn, text_col)
    return network, ids


def score(docs: DataFrame, network: Network, ids: WordIds, text_col: str = "text", counts: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with n_words, log_likelihood (sum) and mean_log_likelihood; columns of these names are replaced.

    Whole texts are scored. A text without words (null, empty) has the sum 0 and no mean. With the ``counts`` of the corpus
    the likelihood is that of the words, without them that of their ids, which the less frequent words share.
    """
    shared = docs.sparkSession.sparkContext.broadcast((network, ids, counts is not None))

    @F.pandas_udf("n_words long, log_likelihood double, _rest array<binary>")
    def likelihood(texts: pd.Series) -> pd.DataFrame:
        model, words, listed = shared.value
        lengths, sums = [], []
        for numbers, padded in _texts([pd.DataFrame({"text": texts})], "text", words, SCORED):
            at = np.flatnonzero(padded != PAD)
            logs = [model.log_probabilities(padded, at[k : k + SCORED]) for k in range(0, len(at), SCORED)]
            total = np.concatenate([[0.0], np.cumsum(np.concatenate(logs), dtype=np.float64)]) if logs else np.zeros(1)
            ends = np.cumsum(numbers)
            lengths += numbers
            sums += list(total[ends] - total[ends - np.array(numbers)])
        rest = [[w for w in alnum_words(t) if words[w] >= WORDS] for t in texts] if listed else [None] * len(texts)
        return pd.DataFrame({"n_words": lengths, "log_likelihood": sums, "_rest": rest})

    kept = docs.drop("n_words", "log_likelihood", "mean_log_likelihood")
    shown = [c for c in kept.columns if keep_text or c != text_col]
    kept, plain = plain_names(kept, text_col)
    names = [n for n in plain if keep_text or n != text_col]
    out = kept.withColumn("_scored", likelihood(F.col(text_col))).select(*names, "_scored.*")
    if counts is not None:
        out = _with_shares(out, *shares(counts, ids))
    out = out.select(*names, "n_words", "log_likelihood").toDF(*shown, "n_words", "log_likelihood")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def _with_shares(scored: DataFrame, known: DataFrame, unseen: list[float]) -> DataFrame:
    """``scored`` with the shares of the words in ``_rest`` in log_likelihood. Rows are numbered and written, as ids may repeat."""
    scored = durable(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    words = scored.select("_row", F.explode("_rest").alias("word"))
    otherwise = F.element_at(F.array(*map(F.lit, unseen)), (F.crc32("word") % SHARED).cast("int") + 1)
    found = words.join(known, "word", "left").select("_row", F.coalesce("share", otherwise).alias("share"))
    sums = found.groupBy("_row").agg(F.sum("share").alias("_share"))
    out = scored.drop("_rest").join(sums, "_row", "left")
    return out.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_share", F.lit(0.0)))


def likelihood_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, log_likelihood, mean_log_likelihood, from a network trained on all of them."""
    docs = docs.select("doc_id", "text")
    counts = durable(word_counts(docs), "lm-counts")
    network, ids = train(docs, counts=counts)
    return score(docs, network, ids, counts=counts, keep_text=False)
