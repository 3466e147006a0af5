import corpus_pipeline
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, quality, simhash, toxicity
from tidelog.llm.common import read, staged
from tidelog.llm.words import tokenizer_path
from tests.llm.test_passages import plain_leaks, plain_words
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_tokens import check_places, plain_pieces


def test_stages_equal_brute_force_on_what_their_predecessor_kept(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    plain = lambda text: t.encode(text or "", add_special_tokens=False).ids
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(staged(stage(spark, states[-1], sf_dir), name))
        if name != "packing":
            assert states[-1].columns == docs.columns and states[-1].count() <= states[-2].count()
            assert states[-1].exceptAll(states[-2]).count() == 0
    start, good, clean, single, tested, packed = states
    # judged alone, the classifiers' decisions are those of their scores
    judged = quality.assess(start, labels)
    assert sorted(r.doc_id for r in judged.filter("__keep").collect()) == sorted(r.doc_id for r in good.collect())
    scores = toxicity.with_scores(good, toxicity.fit(good, labels))
    assert sorted(r.doc_id for r in scores.filter("score < threshold").collect()) == sorted(r.doc_id for r in clean.collect())
    rows = clean.select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])})
    items = [(r.item_id, plain_words((r.text or "").encode())) for r in read(spark, sf_dir, "benchmark").collect()]
    rows = single.select("doc_id", "text").collect()
    leaked = {x[0] for x in plain_leaks([(r.doc_id, plain_words((r.text or "").encode())) for r in rows], items)}
    assert leaked and sorted(r.doc_id for r in tested.collect()) == sorted(r.doc_id for r in rows if r.doc_id not in leaked)
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == plain_pieces([(r.doc_id, r.text) for r in tested.collect()], plain)
    check_places(got)
    assert sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.piece) for r in got)


def test_odd_rows_and_no_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() > 0) == (n > 0)
            docs = staged(out, name) if name != "packing" else out
    kept = simhash.one_per_group(odd_docs)
    assert kept.filter(F.col("text").startswith("Alpha")).count() == 1 and kept.filter("doc_id = 1").count() == 1
    assert decontaminate.text_key(b"") == decontaminate.text_key(b"")


def test_stages_keep_columns_that_are_named_like_their_own(spark, sf_dir):
    own = ["__host", "__path", "__evidence", "__host_rate", "__path_rate", "__score", "__keep", "__threshold", "__text_hash", "__key", "__n", "__c0", "h", "fp", "key", "id", "least", "root", "text_hash", "score", "keep"]
    docs = read(spark, sf_dir, "documents")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in own})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, wide, sf_dir), stage(spark, docs, sf_dir)
        assert got.columns == wide.columns, name
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect()), name
        assert got.filter(" or ".join(f"`{c}` <> concat('{c} of ', doc_id)" for c in own)).count() == 0, name
