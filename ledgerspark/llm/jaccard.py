"""N-gram Jaccard join with prefix filters under several global token orders.

Two sets of word shingles whose Jaccard similarity is at least the threshold share a token among the first few tokens of
each, *under every order of all tokens*. The join uses several orders: shingles known to be frequent come last in all of
them, the others follow a different hash in each. Candidates must share a prefix token under the first order, found by a
shuffle of the prefix tokens, and under each of the others, tested on the pairs; the intersection of these filters is
verified on the texts.

Only the components of the links are asked for, so a group of many near copies is not expanded into all its pairs.
Documents with equal sets count as one. Documents that share a prefix token are first linked in stars, each to a few members drawn by
hash; what the stars join needs no further test. Only pairs between components that still share a
prefix token are then tested one by one, all of them, so no link that joins two components is lost.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import plain_names, release_memory, shingle_set
from ledgerspark import session

FREQUENT = 6  # a shingle seen so often within tasks comes last in the orders
MOST_FREQUENT = 1 << 18  # so many at most are sent to the tasks; which ones is only a matter of speed
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)  # odd: each puts the hashes into another order
LEADERS = 16  # members of a large group that each document is compared with in one round of stars
COUNTED = 1 << 21  # shingles that a task counts at a time
CACHED_SETS = 200
SENT_IDS = 500_000  # ids (16 bytes each) up to which they are broadcast
PAIRS = 4  # tests per posting up to which all pairs between components are tested at once
GAIN = 0.8  # what a round of stars must bring the tests down to for another one


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder, small shuffle partitions put together: the tables are many and mostly small."""
    spark = df.sparkSession
    most = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    return session.durable(df.coalesce(most), label)


def _frugal(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run``, which gives the memory it freed back at the end of a task, as the worker lives on beside the joins that follow."""

    def freed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        release_memory()

    return freed


def prefix_length(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` can be left out without leaving fewer than a partner must share, plus one."""
    return n - -(-n * percent // 100) + 1


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent_shingles(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of shingles that many documents share: those repeated within a task, summed over the tasks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def repeated() -> pd.DataFrame:
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pd.DataFrame({"token": tokens[n > 1].view(np.int64), "n": n[n > 1]})

        for batch in batches:
            for text in batch[text_col]:
                held.append(shingle_set(text, k))
                size += len(held[-1])
                if size >= COUNTED:
                    yield repeated()
                    held, size = [], 0
        yield repeated()

    sums = docs.select(text_col).mapInPandas(_frugal(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = sums.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def _prefixes(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> list[np.ndarray]:
    size = prefix_length(len(tokens), percent)
    at = np.searchsorted(frequent, tokens)
    last = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == tokens) if len(frequent) else np.zeros(len(tokens), bool)
    out = []
    last = last.astype(np.uint64) << np.uint64(63)
    for factor in FACTORS:
        place = (tokens * np.uint64(factor)) >> np.uint64(1) | last
        chosen = np.argpartition(place, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))
        if not out:  # the first prefix is in its order, as its places count
            chosen = chosen[np.lexsort((tokens[chosen], place[chosen]))]
        out.append(tokens[chosen])
    return out


def filtered_sets(docs: DataFrame, k: int, percent: int, text_col: str = "text") -> DataFrame:
    """doc_id, set_id, n and the prefixes p1 (in its order), p2, p3 of each document. Without words: set_id null, n 0, empty prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k, text_col))
    short = lambda tokens: tokens.astype(np.uint32).view(np.int32)  # noqa: E731  half a hash can only let more pairs pass

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = []
                for text in batch[text_col].iloc[at : at + 1000]:
                    tokens = shingle_set(text, k)
                    p1, p2, p3 = _prefixes(tokens, shared.value, percent) if len(tokens) else (tokens,) * 3
                    rows.append((set_id(tokens) if len(tokens) else None, len(tokens), p1.view(np.int64), short(p2), short(p3)))
                out = pd.DataFrame(rows, columns=["set_id", "n", "p1", "p2", "p3"])
                out["set_id"] = pd.array(out["set_id"], dtype="Int64")
                out.insert(0, "doc_id", batch["doc_id"].iloc[at : at + 1000].to_numpy())
                yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, set_id long, n long, p1 array<long>, p2 array<int>, p3 array<int>"
    return docs.select("doc_id", text_col).mapInPandas(_frugal(sets), schema)


def components(links: DataFrame) -> DataFrame:
    """node, component: all nodes of the links (a, b), with the same value for nodes that are connected.

    In each round every node takes the name of the neighbour (or itself) whose hash is smallest, and links between equal
    names vanish. With a new hash in each round the number of names falls by a constant factor, whatever the shape.
    """
    first = edges = durable(links.select("a", "b").filter("a <> b").dropDuplicates(), "jaccard-edges")
    renamings = []
    while edges.head() is not None:
        turn = len(renamings)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        both = edges.select("a", "b").union(edges.select("b", "a"))
        chosen = both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("old"), F.least("best", rank("a"))["node"].alias("new"))
        renamings.append(chosen := durable(chosen, "jaccard-chosen"))
        named = lambda c, to: chosen.select(F.col("old").alias(c), F.col("new").alias(to))  # noqa: E731, B023
        ends = edges.join(named("a", "x"), "a").join(named("b", "y"), "b").filter("x <> y")
        edges = durable(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).dropDuplicates(), "jaccard-edges")
    out = first.select(F.explode(F.array("a", "b")).alias("node")).dropDuplicates().withColumn("component", F.col("node"))
    for r in renamings:  # a name that a round no longer has stays as it is
        out = out.join(r, out["component"] == r["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    return out


def _near_in_size(n: str, m: str, percent: int) -> Column:
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _enough_left(n: str, at: str, m: str, other: str, percent: int) -> Column:
    """Whether two sets whose first common token stands at places ``at`` and ``other`` of their orders can have enough in common.

    Nothing before that token is common, so what is left of the shorter rest bounds the intersection. A row of a later
    common token may fail where that of the first one passes, but a linked pair always passes at its first.
    """
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(other)) * (100 + percent) >= (F.col(n) + F.col(m)) * percent


class _Join:
    """The tables of one join: postings under the first order and filters under the others."""

    def __init__(self, docs: DataFrame, k: int, percent: int, text_col: str):
        self.k, self.percent = k, percent
        self.sets = durable(filtered_sets(docs, k, percent, text_col), "jaccard-sets")
        entries = self.sets.filter("n > 0").select(F.posexplode("p1").alias("at", "token"), "set_id", "n")
        shared = entries.groupBy("token").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo < hi").select("token")
        entries = durable(entries.join(durable(shared, "jaccard-shared"), "token"), "jaccard-entries")
        self.postings = durable(entries.dropDuplicates(), "jaccard-postings")
        self.firsts = self.sets.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
        wanted = durable(self.firsts.join(self.postings.select("set_id").dropDuplicates(), "set_id"), "jaccard-wanted")
        same = lambda left, right: left["doc_id"].eqNullSafe(right["doc_id"])
        rows = self.sets.join(wanted.withColumnRenamed("set_id", "wanted"), same(self.sets, wanted))
        self.filters = durable(rows.filter("set_id = wanted").select("set_id", "p2", "p3"), "jaccard-filters")
        self.docs = docs.select("doc_id", F.col(text_col).alias("text"))

    def texts(self, pairs: DataFrame) -> DataFrame:
        """set_id, sketch, text of the sets in the pairs. Ids of a counted, bounded number are sent to the texts, others meet them by shuffle."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).dropDuplicates()
        ids = durable(ids.join(self.firsts, "set_id"), "jaccard-wanted")
        few = ids.count() <= SENT_IDS
        rows = self.docs.join(F.broadcast(ids) if few else ids, self.docs["doc_id"].eqNullSafe(ids["doc_id"])).select("set_id", "text")
        return durable(rows.mapInPandas(_frugal(_of_set(self.k)), "set_id long, sketch binary, text string"), "jaccard-texts")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the candidate pairs (a, b) that pass the other orders' filters and the verification."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates()
        side = lambda t, c: t.select(F.col("set_id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in t.columns[1:]])
        passed = pairs.join(side(self.filters, "a"), "a").join(side(self.filters, "b"), "b")
        passed = durable(passed.filter(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b"), "jaccard-passed")
        texts = self.texts(passed)
        sketches, texts = texts.select("set_id", "sketch"), texts.select("set_id", "text")
        both = passed.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").select("a", "b", "sketch_a", "sketch_b")
        close = durable(both.mapInPandas(_frugal(_close(self.percent)), "a long, b long"), "jaccard-close")
        both = close.join(side(texts, "a"), "a").join(side(texts, "b"), "b")
        return durable(both.select("a", "b", "text_a", "text_b").mapInPandas(_frugal(_verified(self.k, self.percent)), "a long, b long"), "jaccard-links")

    def stars(self, members: DataFrame, turn: int) -> DataFrame:
        """Pairs of each document with the member drawn for each of its tokens, if in another component."""
        drawn = F.xxhash64("set_id", F.pmod("token", F.lit(LEADERS)), F.lit(turn))
        leaders = members.groupBy("token").agg(F.min(F.struct(drawn.alias("h"), "set_id", "n", "component")).alias("leader"))
        leaders = durable(leaders.select("token", F.col("leader.set_id").alias("b"), F.col("leader.n").alias("m"), F.col("leader.component").alias("other")), "jaccard-leaders")
        near = (F.col("component") != F.col("other")) & _near_in_size("n", "m", self.percent)
        return members.join(leaders, (members["token"] == leaders["token"]) & near).select(F.col("set_id").alias("a"), "b")

    def crossing(self, members: DataFrame, largest: DataFrame) -> DataFrame:
        """All pairs between different components that share a token early enough. One side is never in the token's largest component."""
        one = members.join(largest, "token").withColumn("outside", F.col("component") != F.col("top"))
        one = durable(one.select("token", "set_id", "n", "at", "component", "outside"), "jaccard-members")
        side = lambda t, s: t.select(F.col("token").alias(f"token_{s}"), F.col("set_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "at", "component")], F.col("outside").alias(f"outside_{s}"))
        left, right = side(one.filter("outside"), "a"), side(one, "b")
        once = ~F.col("outside_b") | (F.col("a") < F.col("b"))
        near = _near_in_size("n_a", "n_b", self.percent) & _enough_left("n_a", "at_a", "n_b", "at_b", self.percent)
        on = (F.col("token_a") == F.col("token_b")) & (F.col("component_a") != F.col("component_b")) & once & near
        return left.join(right, on).select("a", "b")

    def components(self) -> DataFrame:
        """set_id, component of every set that has a link.

        One round of stars comes first, and more while testing all pairs between components would cost more than ``PAIRS`` tests per
        posting and the last round made that cheaper; the final round tests all of them.
        """
        spark = self.postings.sparkSession
        names = spark.createDataFrame([], "set_id long, component long")
        turn, before = 0, float("inf")
        while True:
            members = self.postings
            if turn:
                members = members.join(names, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
            else:
                members = members.withColumn("component", F.col("set_id"))
            sizes = members.groupBy("token", "component").agg(F.count("*").alias("size"))
            largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.max("size").alias("most"))
            largest = durable(largest, "jaccard-largest")
            tests, postings = largest.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")), F.sum("all")).head()
            last = turn > 0 and ((tests or 0) <= PAIRS * (postings or 0) or tests > GAIN * before)
            before = tests
            mixed = largest.filter("all > most").select("token", "top")
            if last:
                links = self.linked(self.crossing(members, mixed))
            else:
                links = self.linked(self.stars(durable(members.join(mixed.drop("top"), "token"), "jaccard-mixed"), turn))
            if links.head() is not None:
                names = self._joined(names, links)
            if last:
                return names
            turn += 1

    def _joined(self, names: DataFrame, links: DataFrame) -> DataFrame:
        """``names`` after the links joined components; sets that had no link before come in."""
        named = lambda c: names.select(F.col("set_id").alias(c), F.col("component").alias(f"of_{c}"))
        ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
        ends = ends.select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y"))
        renamed = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("old", "new")
        entry = lambda i, c: F.struct(F.col(i).alias("set_id"), F.col(c).alias("component"))
        new = ends.select(F.explode(F.array(entry("a", "x"), entry("b", "y"))).alias("e")).select("e.*")
        every = names.union(new).dropDuplicates()
        out = every.join(renamed, every["component"] == renamed["old"], "left").select("set_id", F.coalesce("new", "component").alias("component"))
        return durable(out, "jaccard-names")


def sketch(tokens: np.ndarray) -> bytes:
    """The size of a set and its sorted distinct 16-bit ends of hashes."""
    return np.uint64(len(tokens)).tobytes() + np.unique(tokens.astype(np.uint16)).tobytes()


def most_common(a: bytes, b: bytes) -> tuple[int, int, int]:
    """Sizes of two sets and the most that they can have in common, from their sketches.

    Tokens with equal ends count once in a sketch; the smaller set of those left out is added.
    """
    (n, x), (m, y) = ((int(np.frombuffer(s, np.uint64, 1)[0]), np.frombuffer(s, np.uint16, offset=8)) for s in (a, b))
    return n, m, len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))


def _of_set(k: int):
    """Sketch and text of those that have the set they were looked up for, as an id may occur with other texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                sets = [shingle_set(t, k) for t in part["text"]]
                keep = [set_id(t) == s for s, t in zip(part["set_id"], sets, strict=True)]
                yield part.assign(sketch=[sketch(t) for t in sets])[keep][["set_id", "sketch", "text"]]

    return run


def _close(percent: int):
    """Keep the pairs whose sketches do not rule the threshold out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["sketch_a"], batch["sketch_b"], strict=True):
                n, m, common = most_common(a, b)
                keep.append(100 * common >= percent * (n + m - common))
            yield batch.loc[keep, ["a", "b"]]

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(i: int, text: str) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(text, k)
                if len(sets) > CACHED_SETS:
                    sets.popitem(last=False)
            return sets[i]

        for batch in batches:
            keep = []
            for a, b, text_a, text_b in batch.itertuples(index=False):
                x, y = of(a, text_a), of(b, text_b)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    return run


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links lead to).

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``k``-word shingles; a document with fewer
    words is one shingle. Documents without words (null, empty, white space) are linked with nothing and are their own
    component. Rows that repeat an id or a text keep their rows. A null id is never the smallest.
    Sets are of 64-bit hashes of the shingles.
    """
    join = _Join(docs, k, percent, text_col)
    return _report(join, join.components())


def _report(join: _Join, names: DataFrame) -> DataFrame:
    named = join.firsts.join(names, "set_id", "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    named = durable(named, "jaccard-named")
    least = durable(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    ids = durable(named.join(least, "component").select("set_id", "component_id"), "jaccard-ids")
    out = join.sets.select("doc_id", "n", "set_id").join(ids, "set_id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id; documents without words all stay.

    Ids that repeat or are null do not make rows alike: the texts decide. Of a component's rows of the same or no id, the one of
    the smallest hashes stays. Of rows without words that repeat id and text, one stays.
    """
    plain, shown = plain_names(docs, "doc_id", "text")
    with session.temporary_tables() as keep:
        join = _Join(docs, k, percent, "text")
        names = join.components()
        if join.sets.groupBy("doc_id").count().filter("count > 1").head() is not None:
            left = _one_row_of_each(plain, names, k, keep)
        else:
            found = durable(_report(join, names), "jaccard-report")
            single = F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)
            kept = keep(found.filter(single).select(F.col("doc_id").alias("kept")), "jaccard-kept")
            left = plain.join(kept, plain["doc_id"].eqNullSafe(F.col("kept")), "left_semi")
    return left.select(*shown).toDF(*docs.columns)


def _one_row_of_each(docs: DataFrame, names: DataFrame, k: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same by rows, which are numbered and written, as their ids do not tell them apart."""

    @F.pandas_udf("long")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([set_id(tokens) if len(tokens := shingle_set(t, k)) else None for t in texts], dtype="Int64")

    rows = docs.withColumns({"_set": set_of("text"), "_row": F.monotonically_increasing_id()})
    whole = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
    rows = keep(rows.withColumns({"_text": F.sha2(F.coalesce("text", F.lit("")), 256), "_whole": whole}), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "_whole", "_row")).getField("_row").alias("_row")
    keys = rows.select("doc_id", "_set", "_text", "_whole", "_row", F.col("text").isNull().alias("_null"))
    named = keys.filter("_set is not null").join(names.withColumnRenamed("set_id", "_set"), "_set", "left")
    kept = named.groupBy(F.coalesce("component", "_set").alias("component")).agg(first).select("_row")
    empty = keys.filter("_set is null")
    kept = kept.union(empty.filter("doc_id is null").select("_row"))
    kept = kept.union(empty.filter("doc_id is not null").groupBy("doc_id", "_null", "_text").agg(first).select("_row"))
    return rows.join(keep(kept, "jaccard-kept"), "_row", "left_semi").select(*docs.columns)
