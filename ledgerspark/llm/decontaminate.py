"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton accepts every word sequence inside any item. A document streams through it word by word; the state and
the length of the longest match say which windows of which items end at that word. No window is looked up one by one,
and a document costs time in proportion to its words whatever the number of items.

The test items are read to the driver in shards of at most ``SHARD_WORDS`` words each; every shard's automaton is
broadcast on its own and the documents pass the shards one after the other, so what is sent has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import WORD, LOWER, alnum_words
from ledgerspark.session import durable

WINDOW = 10
SHARD_WORDS = 2_000_000


class SuffixAutomaton:
    """All word sequences of the items added, with the items that own each window."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[tuple[str, list[bytes]]] = []
        self.owners: dict[int, frozenset] = {}
        self.short: dict[int, tuple] = {}

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, parent: int, word: bytes) -> int:
        """The target of parent's move, split off if it also stands for longer sequences."""
        target = self.next[parent][word]
        if self.length[target] == self.length[parent] + 1:
            return target
        copy = self._state(self.length[parent] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while parent >= 0 and self.next[parent].get(word) == target:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def add(self, item_id: str, words: list[bytes]) -> None:
        self.items.append((item_id, words))
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._clone(last, word)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._clone(at, word)
            last = new

    def _holder(self, state: int, length: int) -> int:
        """The suffix state of ``state`` that stands for its last ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def close(self) -> "SuffixAutomaton":
        """Find the owners of each window; to be called after the last item."""
        owners: dict[int, set] = {}
        short: dict[int, set] = {}
        for item_id, words in self.items:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    owners.setdefault(self._holder(state, self.window), set()).add(item_id)
            if 0 < len(words) < self.window:
                short.setdefault(self._holder(state, len(words)), set()).add((len(words), item_id))
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        whole: dict[int, frozenset] = {}
        for state in by_length:  # a state's suffixes come before it
            if self.length[state] >= self.window:
                whole[state] = frozenset(owners[self._holder(state, self.window)])
            below = short.get(self.link[state], set())
            if below or state in short:
                short[state] = below | short.get(state, set())
        self.owners, self.short, self.items = whole, {k: tuple(v) for k, v in short.items()}, []
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words as (first, end), and the items whose windows occur."""
        moves, link, length = self.next, self.link, self.length
        owners, short, window = self.owners, self.short, self.window
        root, state, size = moves[0], 0, 0
        runs: list[list[int]] = []
        found: set[str] = set()
        for i, word in enumerate(words):
            to = moves[state].get(word)
            if to is None:
                if not state:
                    continue
                while True:
                    state = link[state]
                    if state <= 0:
                        state, to = 0, root.get(word)
                        size = 0
                        break
                    to = moves[state].get(word)
                    if to is not None:
                        size = length[state]
                        break
                if to is None:
                    continue
            state = to
            size += 1
            hit = 0
            if size >= window:
                found |= owners[state]
                hit = window
            if short and state in short:
                for n, item in short[state]:
                    if n <= size:
                        found.add(item)
                        hit = max(hit, n)
            if hit:
                start = i + 1 - hit
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append([start, i + 1])
        return [(a, b) for a, b in runs], found


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in shards of bounded size; the rows reach the driver a partition at a time."""
    shard, held = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_col)
    for item_id, text in rows.toLocalIterator():
        words = alnum_words(text)
        if not words:
            continue
        shard.append((item_id, words))
        held += len(words)
        if held >= SHARD_WORDS:
            yield shard
            shard, held = [], 0
    if shard:
        yield shard


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    prefix: str = "",
) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``hit_runs`` (word positions, end exclusive) and ``hit_items``.

    A window is ``window`` consecutive words of an item; an item with fewer words is one window. Items without words
    have none. A null or empty text has no words; a null item id counts as the text ``null``; rows of ``items`` with one
    id are one item. ``prefix`` is put before the names of the results; existing columns of these names are replaced.
    """
    spark = docs.sparkSession
    kinds = ("long", "array<struct<first:int,end:int>>", "array<string>")
    result = dict(zip([prefix + c for c in ("n_words", "hit_runs", "hit_items")], kinds))
    n_words, hit_runs, hit_items = result
    kept = docs.drop(*[c for c in docs.columns if c.lower() in result])
    out = kept.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in result.items()])
    schema = T.StructType([*kept.schema.fields, *[out.schema[c] for c in result]])

    def pass_through(automaton, first):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine = automaton.value if automaton is not None else None
            for batch in batches:
                counts, runs, names = [], [], []
                for text, old_runs, old_names in zip(batch[text_col], batch[hit_runs], batch[hit_items], strict=True):
                    words = alnum_words(text)
                    new_runs, new_names = machine.scan(words) if machine is not None else ([], set())
                    if not first:
                        new_runs = _merged(new_runs + [(r["first"], r["end"]) for r in old_runs])
                        new_names = new_names | set(old_names)
                    counts.append(len(words))
                    runs.append([{"first": a, "end": b} for a, b in new_runs])
                    names.append(sorted(new_names))
                yield batch.assign(**{n_words: counts, hit_runs: runs, hit_items: names})

        return run

    n = 0
    for shard in _shards(items, item_id, item_text):
        automaton = SuffixAutomaton(window)
        for name, words in shard:
            automaton.add(name, words)
        if n:
            out = durable(out, "decontaminate")
        out = out.mapInPandas(pass_through(spark.sparkContext.broadcast(automaton.close()), n == 0), schema)
        n += 1
    return out if n else out.mapInPandas(pass_through(None, True), schema)


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    digest = F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256)
    hits = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return find_contamination(docs.select("doc_id", "text"), items, window=window).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        digest.alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"),
    )


def _without(text: str, runs) -> str:
    """The text without the characters from the first to the last word of each run."""
    data = text.encode()
    words = list(WORD.finditer(data.translate(LOWER)))
    kept, at = [], 0
    for run in runs:
        kept.append(data[at : words[run["first"]].start()])
        at = words[run["end"] - 1].end()
    kept.append(data[at:])
    return b"".join(kept).decode()


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without contaminated passages: every run of hit words is cut out of the text and ``n_chars`` is renewed.

    A document of whose words more than ``max_coverage`` are hit goes. Documents without hits stay as they are,
    null and empty texts among them.
    """
    prefix = max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0) * "_" + "_"
    found = find_contamination(docs, items, window=window, prefix=prefix)
    n_words, hit_runs, hit_items = (prefix + c for c in ("n_words", "hit_runs", "hit_items"))
    schema = docs.schema
    sizes = "n_chars" in docs.columns

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [sum(r["end"] - r["first"] for r in runs) for runs in batch[hit_runs]]
            keep = [h <= max_coverage * n for h, n in zip(hit, batch[n_words], strict=True)]
            texts = [_without(t, r) if k and len(r) else t for t, r, k in zip(batch["text"], batch[hit_runs], keep, strict=True)]
            batch = batch.assign(text=texts)[keep]
            yield batch.drop(columns=[n_words, hit_runs, hit_items])

    out = found.mapInPandas(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if sizes else out


