import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidelog.llm import packing, token_orc
from tidelog.llm.queries import QUERIES, WORD_BPE
from tidelog.llm.common import hashed, split_words
from tidelog.llm.words import WordEncoder, tokenizer_path

PATH = tokenizer_path(WORD_BPE)


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_word_encoder_equals_whole_texts(plain):
    rng = random.Random(3)
    signs = [*"aAbxyzqÀÿßÖ×÷µªº09_-#*ÉéΣσς İi'’s12 ٣\u0301  \x1c\x85\x0b\x0c\n\t.,<|>🙂漢字", "<|endoftext|>", "'ll", "'re", "ing", "the"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    e = WordEncoder(PATH, limit=900)  # the table is trimmed again and again
    for at in range(0, len(texts), 100):
        ids, size = e.encode(pa.array([*texts[at : at + 100], None, ""]), 7)
        ends = np.cumsum(size)
        for t, a, b in zip([*texts[at : at + 100], "", ""], ends - size, ends):
            assert ids[a:b].tolist() == [*plain(t), 7], repr(t)
    assert e.encode(pa.array([], pa.string()), 7)[0].size == 0


def test_words_and_their_hashes():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cé漢\t\n\x0b\x0c\r\x1c\xa0") for _ in range(rng.randrange(40))) for _ in range(500)] + [None, "", " ", "x" * 5000]
    column = pa.array(["skipped", *texts]).slice(1)  # a slice has an offset
    words, count = split_words(column)
    plain_words = [(t or "").encode().split() for t in texts]
    assert words.to_pylist() == [w for ws in plain_words for w in ws] and count.tolist() == [len(ws) for ws in plain_words]
    for at in (0, 1, 7, 250):  # slices of every kind, with and without nulls
        part = pa.array([t or "" for t in texts] + ["Ab CD É"]).slice(at, 200)
        lowered, n = split_words(part, lower=True)
        want = [(t or "").encode().lower().split() for t in part.to_pylist()]
        assert lowered.to_pylist() == [w for ws in want for w in ws] and n.tolist() == [len(ws) for ws in want]
        assert split_words(part)[0].to_pylist() == [w for t in part.to_pylist() for w in t.encode().split()]
    h = hashed(words, piece=50)
    assert (h == hashed(words)).all() and len(set(h.tolist())) == len(set(words.to_pylist()))
    assert {w: x for w, x in zip(words.to_pylist(), h.tolist())} == dict(zip(words.slice(3).to_pylist(), hashed(words.slice(3)).tolist())) | dict(zip(words.slice(0, 3).to_pylist(), h.tolist()))


def plain_orc(docs, plain):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*plain(t), 2]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_orc_query(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op3_orc_token_ids"](spark, sf_dir).collect())) == plain_orc(docs, plain)


def test_orc_odd_rows_and_pruned_reads(spark, odd_docs, no_docs, tmp_path, plain):
    path = f"{tmp_path}/orc"
    token_orc.write_tokens(odd_docs, path, PATH)
    want = plain_orc([(r.doc_id, r.text) for r in odd_docs.collect()], plain)
    assert sorted(map(tuple, token_orc.digest(spark, path).collect()), key=lambda r: r[1]) == want
    few = token_orc.read_tokens(spark, path, [3, 7])
    assert {r.doc_id: r.ids for r in few.collect()} == {3: [2], 7: [*plain(odd_docs.filter("doc_id = 7").first().text), 2]}
    assert "PushedFilters: [In(doc_id, [3,7])]" in few._jdf.queryExecution().toString()
    token_orc.write_tokens(no_docs, f"{tmp_path}/none", PATH)
    assert token_orc.digest(spark, f"{tmp_path}/none").collect() == []


def test_orc_files_hold_indexes(spark, sf_dir, tmp_path):
    import glob

    from pyarrow import orc

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_orc.write_tokens(docs.repartition(3), f"{tmp_path}/o", PATH)
    spans = []
    for f in sorted(glob.glob(f"{tmp_path}/o/*.orc")):
        file = orc.ORCFile(f)
        ids = file.read(["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
        spans.append((ids[0], ids[-1]))
        assert file.row_index_stride == 1000 and file.compression == "ZSTD"
        assert b"doc_id" in open(f, "rb").read()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def plain_pieces(docs, plain):
    out = []
    for i, t in docs:
        ids = [*plain(t), 0]
        out += [(i, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    return sorted(out, key=repr)


def check_places(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_packing_query(spark, sf_dir, plain):
    rows = QUERIES["op10_best_fit_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == plain_pieces(docs, plain)
    least = -(-sum(r.length for r in rows) // 2048)
    assert check_places(rows) <= least * 1.05 + 1


def test_packing_odd_rows(spark, odd_docs, no_docs, plain):
    packed = packing.pack(odd_docs, PATH).cache()
    rows = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == plain_pieces([(r.doc_id, r.text) for r in odd_docs.collect()], plain)
    check_places(rows)
    seqs = packing.sequences(packed).collect()
    assert sum(len(s.ids) for s in seqs) == sum(r.length for r in rows) and max(len(s.ids) for s in seqs) <= 2048
    assert packing.pack(no_docs, PATH).collect() == []


def test_open_bins_is_best_fit_and_bounded():
    rng = random.Random(5)
    for most in (1, 3, 50):
        bins, held, open_ = packing.OpenBins(100, most), {}, {}
        for _ in range(3000):
            n = rng.randint(1, 100)
            b, at = bins.place(n)
            fitting = [f for f in open_.values() if f >= n]
            if fitting:
                assert open_[b] == min(fitting)
            else:
                assert b not in held
                if len(open_) >= most:
                    fullest = min(open_, key=lambda x: open_[x])
                    smallest = open_[fullest]
                    gone = [x for x in open_ if open_[x] == smallest and x not in {y for bs in bins.by_free for y in bs}]
                    assert gone
                    del open_[gone[0]]
            assert at == held.get(b, 0)
            held[b] = at + n
            open_.pop(b, None)
            if held[b] < 100:
                open_[b] = 100 - held[b]
            assert len(open_) <= most and held[b] <= 100
