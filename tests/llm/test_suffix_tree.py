import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import suffix_tree
from tidelog.llm.common import hashed
from tidelog.llm.queries import QUERIES

END = b" "


def sequences(texts):
    return [[END, *(t or "").encode().lower().split(), END] for t in texts]


class Plain:
    """The tree by its definition, over dictionaries."""

    def __init__(self, texts, depth, least, discount, test):
        seqs = sequences(texts)
        self.words = Counter(w for s in seqs for w in s[1:])
        self.n, self.v, self.discount = sum(self.words.values()), len(self.words), discount
        often = 2
        self.symbols = {w for w, c in self.words.items() if c >= often}
        grams = Counter(tuple(s[i - k : i + 1]) for s in seqs for i in range(1, len(s)) for k in range(1, depth + 1) if i >= k)
        held = {g: c for g, c in grams.items() if c >= often and all(w in self.symbols for w in g)}
        count = lambda s: self.words[s[0]] if len(s) == 1 else grams[s]
        contexts = [{(w,) for w in self.symbols if self.words[w] >= least}]
        self.levels = []
        for k in range(1, depth + 1):
            if k > 1:
                contexts.append({g for g in held if len(g) == k and g[-1] != END and g[:-1] in contexts[-1] and g[1:] in contexts[-1] and held[g] >= least})
            pairs = {s: {g[-1]: c for g, c in held.items() if g[:-1] == s} for s in contexts[-1]} if len(contexts[-1]) < 400 else None
            if pairs is None:
                pairs = {s: {} for s in contexts[-1]}
                for g, c in held.items():
                    if g[:-1] in pairs:
                        pairs[g[:-1]][g[-1]] = c
            level = {s: (count(s), pairs[s]) for s in contexts[-1]}
            kept = set()
            for s, (n, p) in level.items():
                q = {w: self.prob(s[1:], w) for w in p}
                rest, rest_q = n - sum(p.values()), 1 - sum(q.values())
                gain = sum(c * math.log(c / n / q[w]) for w, c in p.items()) + (rest * math.log(rest / n / max(rest_q, 1e-12)) if rest else 0)
                if gain > test * math.log(max(n, 2)) * (len(p) + 1):
                    kept.add(s)
            self.levels.append((level, kept))
            for j in range(k - 1, 0, -1):
                self.levels[j - 1][1].update(s[1:] for s in self.levels[j][1])

    def prob(self, before, w):
        p = (self.words[w] + 1) / (self.n + self.v + 1)
        for k, (level, kept) in enumerate(self.levels, 1):
            s = tuple(before[-k:])
            if len(before) < k or s not in level:
                break
            if s not in kept:
                continue
            n, pairs = level[s]
            back = 1 - sum(c - self.discount for c in pairs.values()) / n
            p = p * back + ((pairs[w] - self.discount) / n if w in pairs else 0)
        return p

    def score(self, text):
        s = sequences([text])[0]
        return sum(math.log10(self.prob(s[max(0, i - len(self.levels)) : i], s[i])) for i in range(1, len(s)))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_equal_the_definition(spark, sf_dir, depth):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows = [r for r in rows if len(r[1]) < 4000]
    text = "a b c a b d a b c e " * 30
    rows += [(10_000 + i, text) for i in range(6)] + [(20_000, "b c A b unseen-word c"), (20_001, None), (20_002, ""), (None, "the of"), (20_000, "the")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    opts = {"depth": depth, "least": 4, "discount": 0.75, "test": 0.5}
    learn = df.filter("doc_id % 3 <> 0 or doc_id is null")
    plain = Plain([t for i, t in rows if i is None or i % 3], **opts)
    tree, counts = suffix_tree.fit(learn, **opts)
    assert [int(x.kept.sum()) for x in tree.levels] == [len(k) for _, k in plain.levels] and tree.levels[-1].kept.any()
    got = suffix_tree.score(spark, df, tree, counts).collect()
    want = {(i, t): plain.score(t) for i, t in rows}
    assert len(got) == len(rows)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got), key=repr)
    theirs = []
    for i, t in rows:
        s = sequences([t])[0][1:]
        theirs.append((i, len(s), sum(w in plain.words for w in s), round(sum(math.log10((plain.words[w] + 1) / (plain.n + plain.v + 1)) for w in s), 6), round(want[i, t], 6)))
    for a, b in zip(mine, sorted(theirs, key=repr)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=2e-5) and a[4] == pytest.approx(b[4], abs=2e-5)


def test_distributions_sum_to_one(spark):
    df = spark.createDataFrame([("a b c a b d a b c " * 20,), ("c a b",)], "text string")
    tree, _ = suffix_tree.fit(df, depth=2, test=0.1)
    for before in ([b"a"], [b"a", b"b"], [b"c", b"a"], [END, b"c"]):
        h = hashed(pa.array(before, pa.large_binary())).tolist()
        total = 0.0
        for w in [*tree.symbols.tolist(), 12345]:
            ids = tree.ids(np.array([*h, w], np.uint64))
            own, back = tree.probabilities(ids, tree.states(ids, np.array([ids.size])))
            total += own[-1] + back[-1] * tree.root(np.zeros(1))[0]
        assert total == pytest.approx(1.0)


def test_query_beats_its_base_on_held_out_texts(spark, sf_dir):
    rows = QUERIES["op1_suffix_tree_scores"](spark, sf_dir).collect()
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and len({r.train_tokens for r in rows}) == 1


def test_empty_tables_and_odd_rows(spark, odd_docs, no_docs):
    tree, counts = suffix_tree.fit(no_docs)
    assert suffix_tree.score(spark, no_docs, tree, counts).collect() == []
    got = suffix_tree.score(spark, odd_docs, tree, counts).collect()
    assert len(got) == odd_docs.count() and all(r.n_known == 0 and r.base_score == 0 for r in got)
    tree, counts = suffix_tree.fit(odd_docs)
    assert all(r.n_known == r.n_tokens for r in suffix_tree.score(spark, odd_docs, tree, counts).collect())


def repeated_texts():
    """Words at random, so that few contexts of one word pass their own test, with phrases of which longer contexts do, and rows that occur twice."""
    rng = random.Random(5)
    words = ["a", "B"] * 10 + [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + rng.choice(["", " a w1 b w2 w3", " w4 a b w5", " a b b b a"]) for _ in range(120)]
    return [*texts, *texts[:5], None, "", "a unseen-word b"]


@pytest.mark.parametrize("opts", [{}, {"places": 300}, {"most_words": 9}, {"places": 150, "most_words": 9}, {"places": 200, "test": 3.0}, {"places": 200, "most_words": 9, "test": 1.5, "least": 4}, {"places": 200, "depth": 1}])
def test_whole_tree_in_shares_equals_the_definition(spark, opts):
    texts = repeated_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a w1 b w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tree = {"depth": 3, "least": 2, "discount": 0.9, "test": 0.5} | {k: v for k, v in opts.items() if k in ("test", "least", "depth")}
    plain = Plain([t for i, t in rows if i is None or i % 7 != 2], **tree)
    got = {r.doc_id: r for r in suffix_tree.learn_and_score(df, F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)), **opts).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        s = sequences([t])[0][1:]
        assert got[i].n_tokens == len(s) and got[i].n_known == sum(w in plain.words for w in s)
        assert got[i].base_score == pytest.approx(sum(math.log10((plain.words[w] + 1) / (plain.n + plain.v + 1)) for w in s), abs=1e-6)
        assert got[i].score == pytest.approx(plain.score(t), abs=1e-6)


def test_words_of_one_context_in_several_shares_wait_for_all_of_them(spark):
    """The case above with a high test has words that only longer contexts, in some of their shares, keep."""
    plain = Plain([t for i, t in enumerate(repeated_texts()) if i % 7 != 2], 1, 2, 0.9, 3.0)
    deep = Plain([t for i, t in enumerate(repeated_texts()) if i % 7 != 2], 3, 2, 0.9, 3.0)
    assert any(deep.words[s[0]] > 100 for s in deep.levels[0][1] - plain.levels[0][1])


def test_held_trees_are_whole_or_refused(spark):
    df = spark.createDataFrame([("a b c a b d a b c " * 20,)], "text string")
    for most in ("most_words", "most_contexts", "most_pairs"):
        with pytest.raises(ValueError, match="more than"):
            suffix_tree.fit(df, **{most: 2})
