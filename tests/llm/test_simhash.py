import random

import numpy as np
import pytest
import xxhash

from tidelog.llm import simhash
from tidelog.llm.components import stars
from tidelog.llm.queries import QUERIES


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """id -> smallest reachable id, by comparing all pairs of distinct fingerprints."""
    f = np.array(sorted({x for _, x in prints}), dtype=np.uint64)
    root = list(range(f.size))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(f.size):
        for j in np.nonzero(np.bitwise_count(f ^ f[i]) <= 3)[0]:
            root[find(int(j))] = find(i)
    at = {int(x): find(i) for i, x in enumerate(f)}
    least = {}
    for i, x in prints:
        if i is not None:
            least[at[x]] = min(i, least.get(at[x], i))
    return sorted(((i, f"{x:016x}", least.get(at[x])) for i, x in prints), key=repr)


def test_fingerprint_votes():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 255, 256, 300, 1000):
        text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op7_simhash_vantage"](spark, sf_dir).collect()), key=repr)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in docs])
    assert len({r[2] for r in got}) < len(got)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd_docs).collect()), key=repr)
    assert got == plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()])
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({r[2] for r in got}, key=repr)
    assert simhash.one_per_group(no_docs).collect() == []


@pytest.mark.parametrize("shape", ["far", "dense", "chain"])
def test_links_join_what_all_pairs_join(spark, shape):
    rng = random.Random(shape)
    if shape == "far":
        base = [rng.getrandbits(64) for _ in range(1500)]
        f = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:500]]
    elif shape == "dense":
        f = [0x0F0F0F0F12345678 ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for _ in range(3000)]
    else:
        f = [rng.getrandbits(64)]
        for _ in range(400):
            f.append(f[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    f = list(dict.fromkeys(f))
    prints = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(f)], "id long, fp long")
    root = stars(simhash.links(prints.select("fp"), 3, shard_rows=150))
    label = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in root.collect()}
    mine = {}
    for i, x in enumerate(f):
        mine.setdefault(label.get(x, x), set()).add(i)
    want = {}
    for i, _, c in plain_components(list(enumerate(f))):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
