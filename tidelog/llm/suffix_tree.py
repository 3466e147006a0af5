"""Probabilistic suffix tree over words: contexts kept by divergence tests, smoothed next-word distributions, longest-suffix scoring.

Every word and pair seen twice is in the tree. `learn_and_score` holds it nowhere whole: all that a branch, the contexts that end in one word, learns and scores lies at the places
after that word. The places are dealt by it, once, and each task fits the branches of its share and scores the share's places. `fit` and `score` are for trees small enough to be
held in one place; Spark counts their pairs, and larger ones are refused.

Texts are cut and hashed once for the word counts and once for the sequences of word numbers, which are stored; all later passes read those. Tasks hold the counts of the most
frequent words (`most_words`); the others' counts, a table without bound, stay distributed and come from joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import hashed, mixed, slices, split_words, staged

#: The end symbol's hash; a blank is no word.
END = int(hashed(pa.array([b" "], pa.large_binary()))[0])

#: Marks the hash of a word that goes by it, a negative number then.
TAIL = np.uint64(1 << 63)

#: Sums of places go back to their rows in blocks of 2**13 rows.
BLOCK = 13


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all sequences in a row, their sizes): each text as end, words, end; A-Z count as a-z. The first end is the context of the first word and is not scored."""
    words, count = split_words(column, lower=True)
    size = count + 2
    ends = np.cumsum(size)
    out = np.full(int(size.sum()), END, np.uint64)
    inner = np.ones(out.size, bool)
    inner[ends - 1] = inner[ends - size] = False
    out[inner] = hashed(words)
    return out, size


def scored(sizes: np.ndarray) -> np.ndarray:
    """Places that are scored: all but each sequence's first."""
    use = np.ones(int(sizes.sum()), bool)
    use[np.cumsum(sizes) - sizes] = False
    return use


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """find() for many keys that repeat: each distinct key is looked up once, in order."""
    distinct, at = np.unique(keys, return_inverse=True)
    return find(sorted_keys, distinct)[at]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted keys, -1 if absent."""
    if not sorted_keys.size:
        return np.full(keys.size, -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), sorted_keys.size - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def packed(values: np.ndarray) -> tuple[bytes, str, int]:
    """A small form of an array: differences of sorted integers, bytes of like weight together, zstd."""
    v = np.diff(values, prepend=values.dtype.type(0)) if values.dtype.kind in "iu" else values
    return zstandard.compress(np.ascontiguousarray(v.view(np.uint8).reshape(v.size, v.itemsize).T).tobytes(), 3), values.dtype.str, values.size


def unpacked(form: tuple[bytes, str, int]) -> np.ndarray:
    data, kind, n = form
    kind = np.dtype(kind)
    v = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data, max_output_size=max(1, n * kind.itemsize)), np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)
    return np.cumsum(v, dtype=kind) if kind.kind in "iu" else v


class Sent:
    """A tree as it goes to the tasks: what finding states needs, and for scoring the kept contexts' pairs; packed, and unpacked once per worker."""

    def __init__(self, tree: Tree, scoring: bool):
        self.plain, self.width = (tree.total, tree.vocabulary), tree.width
        self.symbols, self.counts = packed(tree.symbols), packed(tree.counts) if scoring else None
        self.levels = []
        for level in tree.levels:
            form = [packed(level.key)]
            if scoring:
                on = level.kept[level.pair // tree.width]
                form += [packed(level.pair[on]), packed(level.part[on].astype(np.float32)), packed(np.where(level.kept, level.back, 1.0).astype(np.float32)), packed(level.kept.astype(np.float16))]
            self.levels.append(form)
        self.made: Tree | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    @property
    def tree(self) -> Tree:
        if self.made is None:
            counts = unpacked(self.counts) if self.counts else np.zeros(0, np.int64)
            self.made = Tree(unpacked(self.symbols), counts, *self.plain)
            none = np.zeros((0, 0), np.int32)
            for form in self.levels:
                key, *rest = map(unpacked, form)
                level = Level(key, none, none)
                if rest:
                    level.pair, level.part, level.back, level.kept = rest[0], rest[1], rest[2], rest[3] > 0
                self.made.levels.append(level)
        return self.made


@dataclass
class Level:
    """Contexts of one length. key: suffix state * width + oldest symbol, sorted; words: their symbols, oldest first."""

    key: np.ndarray
    words: np.ndarray
    count: np.ndarray
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    part: np.ndarray = field(default_factory=lambda: np.zeros(0))
    back: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    """Symbols (frequent words, by sorted hash) with counts, and the context levels; width - 1 stands for every other word."""

    symbols: np.ndarray
    counts: np.ndarray
    total: int
    vocabulary: int
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        return self.symbols.size + 1

    def root(self, count: np.ndarray) -> np.ndarray:
        """Add-one probability of a word with this count, with one share for all unknown words."""
        return (count + 1.0) / (self.total + 1.0 * (self.vocabulary + 1))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = found(self.symbols, hashes)
        return np.where(at < 0, self.width - 1, at)

    def states(self, ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """For each level, the context state before each place, -1 if there is none or it reaches before the sequence."""
        place = np.arange(ids.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out, below = [], np.zeros(ids.size, np.int64)
        for k, level in enumerate(self.levels, 1):
            old = np.full(ids.size, self.width - 1, np.int64)
            old[k:] = ids[:-k]
            ok = (below >= 0) & (place >= k) & (old < self.width - 1)
            state = np.full(ids.size, -1, np.int64)
            state[ok] = found(level.key, below[ok] * self.width + old[ok])
            out.append(state)
            below = state
        return out

    def probabilities(self, ids: np.ndarray, states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(own, back): a place's probability is own + back * root probability of its word, by its longest kept context.

        own is complete for symbols, whose root probability is known here, with back 0; for other words own is 0.
        """
        symbol = ids < self.width - 1
        p = np.where(symbol, self.root(self.counts[np.minimum(ids, max(0, self.width - 2))]) if self.width > 1 else 0.0, 0.0)
        back = np.where(symbol, 0.0, 1.0)
        for level, state in zip(self.levels, states):
            on = np.nonzero(state >= 0)[0]
            on = on[level.kept[state[on]]]
            s = state[on]
            at = found(level.pair, s * self.width + ids[on])
            p[on] = p[on] * level.back[s] + np.where(at >= 0, level.part[np.maximum(at, 0)] if level.part.size else 0.0, 0.0)
            back[on] *= level.back[s]
        return p, back

    def add_level(self, level: Level, pairs: np.ndarray, counts: np.ndarray, discount: float, test: float) -> None:
        """Fit a level from its pairs (state * width + next symbol) and their counts: smoothing, then the divergence test of each context.

        A context is kept if the likelihood that its own distribution gains over its suffix's, its count times their divergence, exceeds
        `test` * log(count) for each of its parameters. Suffixes of kept contexts are kept too, so every longest suffix is reached through them.
        """
        own = pairs % self.width < self.width - 1
        order = np.argsort(pairs[own], kind="stable")
        level.pair, c = pairs[own][order], counts[own][order].astype(np.float64)
        s, w = level.pair // self.width, level.pair % self.width
        n = level.count.astype(np.float64)
        level.part = (c - discount) / n[s]
        level.back = 1.0 - np.bincount(s, level.part, minlength=n.size)
        level.kept = np.ones(n.size, bool)
        # the suffix's probability of each next word: a sequence of the context's later symbols and that word
        k, q = level.words.shape[1], np.zeros(s.size)
        for at in range(0, s.size, 200_000):
            part = slice(at, at + 200_000)
            line = np.concatenate((level.words[s[part]][:, 1:], w[part, None]), axis=1).astype(np.int64)
            states = self.states(line.reshape(-1), np.full(line.shape[0], k)) if k > 1 else [np.full(line.size, -1)] * len(self.levels)
            q[part] = self.probabilities(line.reshape(-1), states)[0].reshape(-1, k)[:, -1]
        rest, rest_q = n - np.bincount(s, c, minlength=n.size), 1.0 - np.bincount(s, q, minlength=n.size)
        gain = np.bincount(s, c * np.log(c / n[s] / q), minlength=n.size).astype(np.float64)
        gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / n / np.maximum(rest_q, 1e-12)), 0.0)
        level.kept = gain > test * np.log(np.maximum(n, 2)) * (np.bincount(s, minlength=n.size) + 1)
        self.levels.append(level)
        for lower, upper in zip(reversed(self.levels[:-1]), reversed(self.levels[1:])):
            lower.kept[upper.key[upper.kept] // self.width] = True

    def longer(self, least: int) -> Level | None:
        """Candidate contexts one symbol longer: the last level's pairs with at least `least` occurrences, which are counts of that context."""
        end = int(self.ids(np.array([END], np.uint64))[0])
        if not self.levels:
            at = np.nonzero(self.counts >= least)[0]
            return Level(at, at[:, None].astype(np.int32), self.counts[at]) if at.size else None
        last = self.levels[-1]
        s, w = last.pair // self.width, last.pair % self.width
        c = np.rint(last.part * last.count[s] + self.discount).astype(np.int64)
        # no word follows an end, but the first end of a sequence, which no word precedes
        use = (w != end) & (c >= least)
        words = np.concatenate((last.words[s[use]], w[use, None].astype(np.int32)), axis=1)
        last.words = last.words[:0]  # only the last level's are needed
        suffix = np.zeros(words.shape[0], np.int64)
        for k, level in enumerate(self.levels, 1):
            on = suffix >= 0
            suffix[on] = found(level.key, suffix[on] * self.width + words[on, -k].astype(np.int64))
        ok = suffix >= 0
        key = suffix[ok] * self.width + words[ok, 0]
        order = np.argsort(key)
        return Level(key[order], words[ok][order], c[use][ok][order]) if order.size else None

    discount: float = 0.9


def totals(batches: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, c) rows of arrays of keys, summed as far as memory allows."""
    held, size = [], 0
    row = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["key", "c"])
    for keys in batches:
        held.append(np.unique(keys, return_counts=True))
        size += held[-1][0].size
        if size > 2_000_000:
            held = [merged(held)]
            if held[0][0].size > 1_000_000:
                yield row(*held[0])
                held = []
            size = sum(x.size for x, _ in held)
    if held:
        yield row(*merged(held))


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return k, np.bincount(at, np.concatenate([c for _, c in held]), minlength=k.size).astype(np.int64)


def summed(rows: DataFrame, name: str) -> DataFrame:
    return staged(rows.groupBy("key").agg(F.sum("c").alias("c")), name)


def least_count(rows: DataFrame, most: int, least: int) -> int:
    """The smallest count from `least` on that at most `most` rows reach. The driver sees one row per count."""
    per = rows.filter(F.col("c") >= least).groupBy(F.least("c", F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
    inside = per["c"][per["n"].cumsum() <= most]
    return int(per["c"].max() + 1 if len(per) and not len(inside) else inside.min() if len(inside) else least)


def words_of(docs: DataFrame, text_col: str, most_words: int, discount: float) -> tuple[Tree, DataFrame]:
    """(tree without levels, counts(key, c) of all words by hash)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for batch in slices(batches, 4096, 6_000_000):
                h, size = sequences(batch.column(0))
                yield h[scored(size)]

        yield from totals(keys())

    counts = summed(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, c long"), "words")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = counts.filter(F.col("c") >= least_count(counts, most_words, 2)).toArrow()
    h, c = (often[x].to_numpy() for x in ("key", "c"))
    order = np.argsort(h.view(np.uint64))
    return Tree(h.view(np.uint64)[order], c[order], int(total), int(vocabulary), discount=discount), counts


def encoded(docs: DataFrame, tree: Tree, id_col: str, text_col: str, mark: Column | None, by_hash: bool = False, rank: np.ndarray | None = None) -> DataFrame:
    """(row, doc_id, mark, ids, rare, tf, n_tokens, n_known, base), written once: each text's sequence of word numbers, the distinct other words with their numbers of occurrences, and the
    number and root score of its symbols. by_hash: other words are negative numbers made of their hashes, not all the same one. rank: the symbols' numbers,
    if not by their hashes' order."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (mark if mark is not None else F.lit(None).cast("boolean")).alias("mark"))
    held = docs.sparkSession.sparkContext.broadcast((Sent(tree, True), rank))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = held.value[0].tree, TaskContext.get().partitionId() << 40
        rank = held.value[1]
        symbols, width = t.symbols, t.width
        root = np.append(np.log10(t.root(t.counts)), 0.0)
        for batch in slices(batches, 4096, 6_000_000):
            n = batch.num_rows
            h, size = sequences(batch.column(1))
            at = found(symbols, h)
            use, of = scored(size), np.repeat(np.arange(n), size)
            ids = np.where(at < 0, (h | TAIL).view(np.int64) if by_hash else width - 1, at if rank is None or not rank.size else rank[at]).astype(np.int64 if by_hash else np.int32)
            rare = use & (at < 0)
            base = np.bincount(of[use], root[at[use]], minlength=n)
            pair = np.zeros(int(rare.sum()), dtype=[("of", np.int64), ("key", np.uint64)])
            pair["of"], pair["key"] = of[rare], h[rare]
            order = np.lexsort((pair["key"], pair["of"]))
            pair = pair[order]
            new = np.ones(pair.size, bool)
            new[1:] = (pair["of"][1:] != pair["of"][:-1]) | (pair["key"][1:] != pair["key"][:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.concatenate((first, [pair.size])))
            ends = np.concatenate(([0], np.cumsum(np.bincount(pair["of"][first], minlength=n)))).astype(np.int32)
            lists = lambda v, e, kind: pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), batch.column(0), batch.column(2), lists(ids, np.concatenate(([0], np.cumsum(size))), pa.int64() if by_hash else pa.int32()), lists(pair["key"][first].view(np.int64), ends, pa.int64()), lists(tf, ends, pa.int32()),
                 pa.array(size - 1), pa.array(np.bincount(of[use & (at >= 0)], minlength=n)), pa.array(base, pa.float64())],
                names=["row", "doc_id", "mark", "ids", "rare", "tf", "n_tokens", "n_known", "base"])
            row += n

    array = lambda t: T.ArrayType(t, False)
    kinds = [T.StructField("row", T.LongType()), src.schema["doc_id"], T.StructField("mark", T.BooleanType()), T.StructField("ids", array(T.LongType() if by_hash else T.IntegerType())), T.StructField("rare", array(T.LongType())), T.StructField("tf", array(T.IntegerType()))]
    kinds += T._parse_datatype_string("n_tokens long, n_known long, base double").fields
    return staged(src.mapInArrow(run, T.StructType(kinds)), "sequences")


def id_batches(batches: Iterable[pa.RecordBatch], at: int, most: int = 600_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word numbers in a row, sizes), cut so that a batch holds about `most` of them or one sequence."""
    for batch in batches:
        ends = batch.column(at).offsets.to_numpy().astype(np.int64)
        flat = batch.column(at).values.to_numpy(zero_copy_only=False)
        low = 0
        while low < batch.num_rows:
            high = min(batch.num_rows, max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1))
            yield batch.slice(low, high - low), flat[ends[low] : ends[high]].astype(np.int64), np.diff(ends[low : high + 1])
            low = high


def held_whole(what: str, n: int, most: int) -> None:
    """A tree that the driver holds is whole or refused."""
    if n > most:
        raise ValueError(f"{n} {what} are more than the {most} that a tree held in one place may have; learn_and_score() scores by trees of any size")


def grown(tree: Tree, learned: DataFrame, depth: int, least: int, most_contexts: int, most_pairs: int, test: float) -> Tree:
    """The tree with its levels, from sequences (ids)."""
    spark = learned.sparkSession
    for k in range(1, depth + 1):
        level = tree.longer(least)
        if level is None:
            break
        held_whole(f"contexts of length {k}", level.count.size, most_contexts)
        tree.levels.append(level)
        held = spark.sparkContext.broadcast(Sent(tree, False))
        tree.levels.pop()

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            def keys() -> Iterator[np.ndarray]:
                t = held.value.tree
                for _, ids, sizes in id_batches(batches, 0):
                    state = t.states(ids, sizes)[-1]
                    at = scored(sizes) & (state >= 0) & (ids < t.width - 1)
                    yield state[at] * t.width + ids[at]

            yield from totals(keys())

        pairs = summed(learned.select("ids").mapInArrow(run, "key long, c long"), f"pairs{k}")
        pairs = pairs.filter("c >= 2")
        held_whole(f"pairs of length {k}", pairs.count(), most_pairs)
        got = pairs.toArrow()
        tree.add_level(level, got["key"].to_numpy(), got["c"].to_numpy(), tree.discount, test)
        held.destroy()
    return tree


def fit(
    docs: DataFrame, text_col: str = "text", depth: int = 3, least: int = 2, most_words: int = 2_000_000, most_contexts: int = 1_000_000, most_pairs: int = 2_000_000, discount: float = 0.9, test: float = 0.5
) -> tuple[Tree, DataFrame]:
    """(tree, counts(key, c) of all words by hash) learned from every whole text of docs; null texts count as empty.

    Words and pairs count from two occurrences on, contexts from `least`. The tree is held in one place: more than `most_words` words, or for a length `most_contexts` contexts or
    `most_pairs` pairs, are an error, and nothing is left out. Words are told apart by a 64-bit hash. No rows give an empty tree.
    """
    tree, counts = words_of(docs, text_col, most_words, discount)
    held_whole("words", counts.filter("c >= 2").count(), most_words)
    learned = encoded(docs.select(F.lit(0).alias("doc_id"), text_col), tree, "doc_id", text_col, None)
    return grown(tree, learned, depth, least, most_contexts, most_pairs, test), counts


def score(spark: SparkSession, docs: DataFrame, tree: Tree, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str | None = None) -> DataFrame:
    """(doc_id, mark, n_tokens, n_known, train_tokens, base_score, score) for every row of docs, by its whole text.

    score: log10 probability of the text's words and its end under the tree; base_score: the same under the root alone. Null and empty texts are
    an end. Repeated rows give a row each; null ids stay null. `mark` names a column to carry. Other columns are not read.
    """
    return scores_of(encoded(docs, tree, id_col, text_col, F.col(mark) if mark else None), tree, counts)


def scores_of(rows: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(Sent(tree, True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value.tree
        for batch, ids, sizes in id_batches(batches, 3):
            n, use = batch.num_rows, scored(sizes)
            p, back = model.probabilities(ids, model.states(ids, sizes))
            of = np.repeat(np.arange(n), sizes)
            symbol, rare = use & (ids < model.width - 1), use & (ids == model.width - 1)
            total = lambda at, v: np.bincount(of[at], v, minlength=n)
            base = total(symbol, np.log10(model.root(model.counts[ids[symbol]]))) if symbol.any() else np.zeros(n)
            own = total(symbol, np.log10(p[symbol])) + total(rare, np.log10(back[rare]))
            cols = [pa.array(sizes - 1), pa.array(total(symbol, None).astype(np.int64)), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["row", "doc_id", "mark", "n_tokens", "n_known", "base", "score"])

    kinds = T.StructType([*[rows.schema[c] for c in ("row", "doc_id", "mark")], *T._parse_datatype_string("n_tokens long, n_known long, base double, score double").fields])
    done = rows.select("row", "doc_id", "mark", "ids").mapInArrow(run, kinds)
    return with_rare_words(done, rows, tree, counts)


def with_rare_words(done: DataFrame, rows: DataFrame, tree: Tree, counts: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """The result from the symbols' part (row, doc_id, mark, n_tokens, n_known, base, score), the other words' root scores and what contexts add (row, gain)."""
    # the other words meet their counts: one row per document and word
    other = rows.select("row", F.inline(F.arrays_zip("rare", "tf"))).join(counts.withColumnRenamed("key", "rare"), "rare", "left")
    c = F.coalesce("c", F.lit(0))
    other = other.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(F.col("tf") * F.log10((c + 1.0) / F.lit(tree.total + 1.0 * (tree.vocabulary + 1)))).alias("log"))
    out = done.join(other, "row", "left")
    out = out.join(gains, "row", "left") if gains is not None else out.withColumn("gain", F.lit(0.0))
    log = F.coalesce("log", F.lit(0.0))
    return out.select("doc_id", "mark", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log + F.coalesce("gain", F.lit(0.0))).alias("score"))


def learn_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least: int = 2, most_words: int = 2_000_000, places: int = 700_000, discount: float = 0.9, test: float = 0.5) -> DataFrame:
    """score() of all docs, mark true where `held_out` is, by the tree of the others as fit() defines it, of any size: nothing of it is dropped.

    All that a branch of the tree, the contexts that end in one word, learns and scores lies at the places after that word. So the places of all texts are dealt by the word
    before them, once, into shares of about `places`; a task fits the branches of its share and scores its places. Words before more than half a share, or 1/256 of all places, have shares of their
    own, dealt by the word before that; the counts of the pairs that begin with them are made first and go to each of their shares.
    `most_words` bounds the words that tasks hold with counts; beyond them words go by their hashes, and their counts come from a join.
    """
    tree, counts = words_of(docs.filter(~held_out), text_col, most_words, discount)
    rare = counts.filter(F.col("c") >= 2).count() > tree.symbols.size
    order = np.argsort(-tree.counts, kind="stable")  # small numbers for frequent words
    rank = np.empty(order.size, np.int32)
    rank[order] = np.arange(order.size)
    rows = encoded(docs, tree, id_col, text_col, held_out, rare, rank)
    if rare:
        rows = with_rare_counts(rows, counts)
    tokens = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    dealt = branch_scores(rows, Deal.of(replace(tree, counts=tree.counts[order]), tokens, places), rare, depth, max(2, least), discount, test)
    base = rows.select("row", "doc_id", "mark", "n_tokens", "n_known", "base")
    return with_rare_words(base.withColumn("score", F.col("base")), rows, tree, counts, dealt)


@dataclass
class Deal:
    """Shares of the places, by the words before them; goes to the tasks with the symbols' counts."""

    sent: Sent
    hot: np.ndarray  # words whose places lie in `parts` shares each, from share `first` on
    first: np.ndarray
    parts: np.ndarray
    cold: int  # the other words' shares

    @classmethod
    def of(cls, tree: Tree, tokens: int, places: int) -> Deal:
        """Shares of about `places`, of all tokens; the counts are those of the learned ones."""
        c = tree.counts * (tokens / max(1, tree.total))
        # a part of all tokens where that is less, so that the work for these words grows as the table does
        hot = np.flatnonzero(c > min(places / 2, max(places / 16, tokens / 256)))
        parts = np.ceil(c[hot] / places).astype(np.int64)
        cold = max(1, math.ceil((tokens - c[hot].sum()) / places))
        return cls(Sent(tree, True), hot, cold + np.cumsum(parts) - parts, parts, cold)

    def shares(self, before: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        out = (mixed(before[0].view(np.uint64)) % np.uint64(self.cold)).astype(np.int64)
        at = find(self.hot, before[0])
        on = np.flatnonzero(at >= 0)
        if on.size:
            # without a second word a place needs no more than the first one's pairs, which all its shares have
            by = row[on] if len(before) == 1 else np.where(before[1][on] == self.sent.width - 1, row[on], before[1][on])
            out[on] = self.first[at[on]] + (mixed(by.astype(np.int64).view(np.uint64)) % self.parts[at[on]].astype(np.uint64)).astype(np.int64)
        return out


def with_rare_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with rc: the counts of the words in `rare`, in their order."""
    each = rows.select("row", F.posexplode("rare").alias("at", "key")).join(counts, "key")
    lists = each.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"))
    rc = F.transform(F.sequence(F.lit(0), F.size("rare") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("long"))
    return staged(rows.join(lists, "row", "left").withColumn("rc", F.when(F.size("rare") > 0, rc)).drop("m"), "sequences_with_counts")


def places_of(batches: Iterable[pa.RecordBatch], width: int, depth: int, rare: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(row, train, words before, nearest first, word, its count if it is no symbol) of the places that follow a word that may be a context, from (row, mark, ids, rare, rc).

    width - 1 stands for no word and for words that occur less than twice; a context ends before them.
    """
    other = width - 1
    for batch, ids, sizes in id_batches(batches, 2):
        count = np.zeros(ids.size, np.int64)
        if rare:
            lists = [batch.column(i) for i in (3, 4)]
            n = np.diff(lists[0].offsets.to_numpy())
            key, c = lists[0].flatten().to_numpy().view(np.uint64) | TAIL, np.zeros(int(n.sum()), np.int64)
            c[np.repeat(lists[1].is_valid().to_numpy(zero_copy_only=False), n)] = lists[1].flatten().to_numpy()
            tail, at = np.unique(key, return_index=True)
            on = np.flatnonzero(ids < 0)
            count[on] = c[at[np.searchsorted(tail, ids[on].view(np.uint64))]]
            ids = np.where((ids < 0) & (count < 2), other, ids)
        place = np.arange(ids.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(place >= 1)
        at = at[ids[at - 1] != other]
        before, ok = [], np.ones(at.size, bool)
        for k in range(1, depth + 1):
            v = ids[np.maximum(at - k, 0)]
            ok = ok & (place[at] >= k) & (v != other)
            before.append(np.where(ok, v, other))
        row, train = batch.column(0).to_numpy(), pc.equal(batch.column(1), False).fill_null(False).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(sizes.size), sizes)[at]
        yield row[of], train[of], before, ids[at], count[at]


def blob(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, the first one as differences, bytes of like weight together, zstd."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    return zstandard.compress(b"".join(np.ascontiguousarray(v.view(np.uint8).reshape(v.size, v.itemsize).T).tobytes() for v in columns), 3)


def unblob(data: bytes, n: int, kinds: list[np.dtype]) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.decompress(data, max_output_size=max(1, n * sum(k.itemsize for k in kinds))), np.uint8), [], 0
    for kind in kinds:
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def branch_scores(rows: DataFrame, deal: Deal, rare: bool, depth: int, least: int, discount: float, test: float) -> DataFrame:
    """(row, gain): log10 of the probabilities of the row's places over their root probabilities, where a context changes them."""
    width, held = deal.sent.width, rows.sparkSession.sparkContext.broadcast(deal)
    code = np.dtype(np.int64 if rare else np.int32)
    kinds = [np.dtype(np.int64), np.dtype(bool)] + [code] * (depth + 1) + [np.dtype(np.int64)] * rare

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value.hot
        for _, train, before, w, count in places_of(batches, width, depth, rare):
            at = find(hot, before[0])
            on = np.flatnonzero((at >= 0) & train & (w != width - 1))
            words, place, number = np.unique(w[on], return_index=True, return_inverse=True)
            key, c = np.unique(at[on] * max(1, words.size) + number, return_counts=True)
            number = key % max(1, words.size)
            yield pa.RecordBatch.from_arrays([pa.array(key // max(1, words.size)), pa.array(words[number]), pa.array(count[on][place][number]), pa.array(c)], names=["hot", "w", "count", "c"])

    def sent_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = held.value.first, held.value.parts
        for batch in batches:
            hot, w, count, c = (x.to_numpy() for x in batch.columns)
            for h in np.unique(hot).tolist():
                on = hot == h
                data = blob([w[on], count[on], c[on]])
                for share in range(int(first[h]), int(first[h] + parts[h])):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((share, pa.int64()), (True, pa.bool_()), (int(on.sum()), pa.int32()), (data, pa.binary()))], names=["share", "given", "n", "data"])

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            row, train, w, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4))
            before = [np.concatenate([p[2][k] for p in parts]) for k in range(depth)]
            to = held.value.shares(before, row)
            order = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")
            to = to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            ends = np.append(cut[1:], to.size)
            columns = [row[order], train[order], *[v.astype(code)[order] for v in (*before, w)], *([count[order]] if rare else [])]
            data = [blob([v[a:b] for v in columns]) for a, b in zip(cut.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array(np.zeros(cut.size, bool)), pa.array((ends - cut).astype(np.int32)), pa.array(data, pa.binary())], names=["share", "given", "n", "data"])

        parts, size = [], 0
        for part in places_of(batches, width, depth, rare):
            if part[0].size:
                parts.append(part)
                size += part[0].size
            if size > 600_000:
                yield out(parts)
                parts, size = [], 0
        if parts:
            yield out(parts)

    def share(key: tuple, table: pa.Table) -> pa.Table:
        to, which = held.value, key[0].as_py()
        model, got, pairs = to.sent.tree, [], []
        for given, n, data in zip(table["given"].to_pylist(), table["n"].to_pylist(), table["data"]):
            (pairs if given else got).append(unblob(data.as_py(), n, [np.dtype(np.int64)] * 3 if given else kinds))
        if not got:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())], names=["block", "hot", "first", "n", "data"])
        row, train, *words = (np.concatenate([g[i] for g in got]) for i in range(len(kinds)))
        got.clear()
        count = words.pop() if rare else None
        given, hot = None, int(np.searchsorted(to.first, which, side="right")) - 1 if which >= to.cold else -1
        if hot >= 0:
            w, w_count, c = [np.concatenate(x) for x in zip(*pairs)] if pairs else [np.zeros(0, np.int64)] * 3
            order = np.argsort(w)  # so that all shares of a word sum alike
            given = int(model.counts[to.hot[hot]]), w[order], c[order], root_of(model, w, w_count)[order]
        branches = Branches(words[:-1], words[-1], root_of(model, words[-1], count), train, width, least, discount, test, given)
        distinct, of = np.unique(row, return_inverse=True)
        open_, first, gains = branches.run()
        sums = [np.rint(np.bincount(of, g, minlength=distinct.size) * 1e9).astype(np.int64) for g in gains]
        block = distinct >> BLOCK
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(cut[1:], block.size)
        data = [blob([v[a:b] for v in (distinct, *sums)]) for a, b in zip(cut.tolist(), ends.tolist())]
        same = lambda v, t: pa.array(np.full(cut.size, v), t)
        return pa.table([pa.array(block[cut]), same(hot if open_ else -1, pa.int64()), same(first, pa.int32()), pa.array((ends - cut).astype(np.int32)), pa.array(data, pa.binary())], names=["block", "hot", "first", "n", "data"])

    def passing(key: tuple, table: pa.Table) -> pa.Table:
        w, w_count, c = (table[x].to_numpy() for x in ("w", "count", "c"))
        order = np.argsort(w)
        own = given_passes((int(held.value.sent.tree.counts[held.value.hot[key[0].as_py()]]), w[order], c[order], root_of(held.value.sent.tree, w, w_count)[order]), test)
        return pa.table([pa.array([key[0].as_py()][: int(own)], pa.int64())], names=["hot"])

    def gathered(key: tuple, table: pa.Table) -> pa.Table:
        low, whole = key[0].as_py() << BLOCK, np.int64
        out, seen = np.zeros(1 << BLOCK, whole), np.zeros(1 << BLOCK, bool)
        for hot, first, level, n, data in zip(*(table[x].to_pylist() for x in ("hot", "first", "level", "n")), table["data"]):
            # of an open word's sums those for its level
            row, *sums = unblob(data.as_py(), n, [np.dtype(whole)] * (2 if hot < 0 else first + 2))
            out[row - low] += sums[0 if hot < 0 else level]
            seen[row - low] = True
        at = np.flatnonzero(seen)
        return pa.table([pa.array(at + low), pa.array(out[at] / 1e9)], names=["row", "gain"])

    source = rows.select("row", "mark", "ids", "rare", "rc") if rare else rows.select("row", "mark", "ids")
    kind = "share long, given boolean, n int, data binary"
    sent = source.mapInArrow(dealt, kind)
    if deal.hot.size:
        hot_pairs = source.mapInArrow(pairs, "hot long, w long, count long, c long").groupBy("hot", "w").agg(F.max("count").alias("count"), F.sum("c").alias("c")).filter("c >= 2")
        hot_pairs = staged(hot_pairs, "hot_pairs")
        sent = sent.unionAll(hot_pairs.mapInArrow(sent_pairs, kind))
    back = sent.groupBy("share").applyInArrow(share, "block long, hot long, first int, n int, data binary")
    if deal.hot.size and hot_pairs.groupBy("hot").applyInArrow(passing, "hot long").count() < deal.hot.size:
        # hot words whose own test fails are kept from the first level on at which any of their shares keeps a context
        back = staged(back, "gains")
        level = back.filter("hot >= 0").groupBy("hot").agg(F.min("first").alias("level"))
        back = back.join(F.broadcast(level), "hot", "left")
    else:
        back = back.withColumn("level", F.lit(0))
    return back.groupBy("block").applyInArrow(gathered, "row long, gain double")


def root_of(tree: Tree, w: np.ndarray, count: np.ndarray | None) -> np.ndarray:
    """Root probabilities of word numbers, of those that go by their hashes from their counts; 0 for words that are no symbols."""
    other = 0.0 if count is None else tree.root(count)
    symbol = tree.root(tree.counts[np.clip(w, 0, tree.width - 2)]) if tree.width > 1 else 0.0
    return np.where(w == tree.width - 1, 0.0, np.where(w < 0, other, symbol))


def passes(n: np.ndarray, s: np.ndarray, c: np.ndarray, q: np.ndarray, test: float) -> np.ndarray:
    """The divergence test, as in Tree.add_level."""
    rest, rest_q = n - np.bincount(s, c, minlength=n.size), 1.0 - np.bincount(s, q, minlength=n.size)
    gain = np.bincount(s, c * np.log(c / n[s] / q), minlength=n.size).astype(np.float64)
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / n / np.maximum(rest_q, 1e-12)), 0.0)
    return gain > test * np.log(np.maximum(n, 2)) * (np.bincount(s, minlength=n.size) + 1)


def given_passes(given: tuple, test: float) -> bool:
    n, w, c, q = given
    return bool(passes(np.array([float(n)]), np.zeros(w.size, np.int64), c.astype(np.float64), q, test)[0])


@dataclass
class Depth:
    """Contexts of one length at the places of a share. state: each place's context or -1; part: its pair's share; lower: the contexts' suffixes; pair, c, at: pairs' contexts, counts and one place."""

    state: np.ndarray
    part: np.ndarray
    n: np.ndarray
    lower: np.ndarray
    back: np.ndarray
    pair: np.ndarray
    c: np.ndarray
    at: np.ndarray
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


class Branches:
    """The branches of the tree at the places of a share, as Tree defines them.

    given: (count, next words in order, their counts, their root probabilities) of the one word that all places follow, if its places lie in several shares.
    """

    def __init__(self, before: list[np.ndarray], word: np.ndarray, root: np.ndarray, train: np.ndarray, width: int, least: int, discount: float, test: float, given: tuple | None):
        self.root, self.test, self.given, self.discount = root, test, given, discount
        tail = np.unique(np.concatenate([v[v < 0] for v in (*before, word)])).astype(np.int64)
        other, span = width - 1, width + tail.size
        number = lambda v: np.where(v < 0, width + np.searchsorted(tail, v), v).astype(np.int64)
        w, self.levels = number(word), []
        state = np.zeros(w.size, np.int64)
        for k, v in enumerate(before):
            on = np.flatnonzero((state >= 0) & (v != other))
            key, at = np.unique(state[on] * span + number(v[on]), return_inverse=True)
            n = np.bincount(at[train[on]], minlength=key.size)
            if k == 0 and given:
                n[:] = given[0]
            live = n >= least
            state = np.full(w.size, -1, np.int64)
            state[on] = np.where(live, np.cumsum(live) - 1, -1)[at]
            n, lower = n[live].astype(np.float64), (key // span)[live]
            part = np.zeros(w.size)
            if k == 0 and given:
                at = find(given[1], word.astype(np.int64))
                hit = np.flatnonzero((at >= 0) & (state >= 0))
                part[hit] = ((given[2] - discount) / given[0])[at[hit]]
                self.levels.append(Depth(state, part, n, lower, np.full(n.size, 1.0 - ((given[2] - discount) / given[0]).sum()), *[np.zeros(0, np.int64)] * 3))
                continue
            on = np.flatnonzero(state >= 0)
            on = on[w[on] != other]
            key, at = np.unique(state[on] * span + w[on], return_inverse=True)
            c = np.bincount(at[train[on]], minlength=key.size)
            one = np.zeros(key.size, np.int64)
            one[at] = on
            s, twice = key // span, c >= 2
            share = np.where(twice, (c - discount) / n[s], 0.0)
            part[on] = share[at]
            self.levels.append(Depth(state, part, n, lower, 1.0 - np.bincount(s, share, minlength=n.size), s[twice], c[twice].astype(np.float64), one[twice]))

    def probabilities(self, levels: list[Depth]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, back) of the places by these levels; a word without root probability has no pairs, and its probability is back times that."""
        p, back = self.root.copy(), np.ones(self.root.size)
        for x in levels:
            on = np.flatnonzero(x.state >= 0)
            on = on[x.kept[x.state[on]]]
            b = x.back[x.state[on]]
            p[on] = p[on] * b + x.part[on]
            back[on] *= b
        return p, back

    def fitted(self, given_from: int | None) -> int:
        """Test all contexts; a given word is kept from the level `given_from` on. The first level beyond the first that keeps a context, the number of levels + 1 if none."""
        first = len(self.levels) + 1
        for k, x in enumerate(self.levels, 1):
            if k == 1 and self.given:
                x.kept = np.full(x.n.size, given_from <= 1)
                continue
            q = self.probabilities(self.levels[: k - 1])[0][x.at]
            x.kept = passes(x.n, x.pair, x.c, q, self.test)
            first = min(first, k) if k > 1 and x.kept.any() else first
            for lower, upper in zip(reversed(self.levels[: k - 1]), reversed(self.levels[1:k])):
                lower.kept[upper.lower[upper.kept]] = True
            if self.given:
                self.levels[0].kept[:] = given_from <= k
        return first

    def gains(self) -> np.ndarray:
        # in single precision, as a tree sent for scoring has them
        single = lambda v: v.astype(np.float32).astype(np.float64)
        p, back = self.probabilities([replace(x, part=single(x.part), back=single(x.back)) for x in self.levels])
        symbol = self.root > 0
        return np.log10(np.where(symbol, p / np.where(symbol, self.root, 1.0), back))

    def run(self) -> tuple[bool, int, list[np.ndarray]]:
        """(whether it is open from which level on the given word is kept, the first level at which these places say so, gains).

        Where it is open, gains[k] hold if it is from level k on, for each k up to that first level; gains[0] and gains[1] are not used then.
        """
        if self.given:
            if not given_passes(self.given, self.test):
                never = len(self.levels) + 1
                first = self.fitted(never)
                none, out = np.zeros(self.root.size), []
                for k in range(2, first + 1):
                    self.fitted(k)
                    out.append(self.gains())
                return True, first, [none, none, *out]
        self.fitted(1)
        return False, 0, [self.gains()]
