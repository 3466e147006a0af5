import random

import pytest

from tidelog.llm import attribution, decontaminate
from tidelog.llm.common import plain_words
from tidelog.llm.queries import QUERIES


def plain_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    a, b, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        out.append(best)


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnop"])
def test_tiles_equal_the_definition(letters):
    rng = random.Random(letters)
    hashes = decontaminate.WordHashes()
    for _ in range(60):
        item = [rng.choice(letters).encode() for _ in range(rng.randint(0, 25))]
        doc = [rng.choice(letters).encode() for _ in range(rng.randint(0, 25))]
        for _ in range(2):
            at, n = rng.randint(0, len(item)), rng.randint(0, 12)
            doc += item[at : at + n]
        a, b = hashes([b" ".join(doc), b" ".join(item)])
        got, want = decontaminate.tiles(a, b, 3), plain_tiles(doc, item, min(3, len(item))) if item else []
        if sum(t[2] for t in got) != len(item):
            assert got == want
        assert sum(t[2] for t in got) == sum(t[2] for t in want)


def plain_leaks(docs, items, threshold=0.8, tile=5):
    out = []
    for i, words in docs:
        for k, item in items:
            n = min(tile, len(item))
            seeds = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
            if n and any(tuple(item[j : j + n]) in seeds for j in range(len(item) - n + 1)):
                covered = sum(t[2] for t in plain_tiles(words, item, n))
                if covered >= threshold * len(item):
                    out.append((i, k, covered, len(item)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    words = lambda t: plain_words((t or "").encode())
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.item_id, r.covered, r.item_words) for r in QUERIES["op8_string_tiling"](spark, sf_dir).collect()), key=repr)
    assert got == plain_leaks(docs, items) and got


def test_reordered_partial_and_odd_rows(spark, odd_docs, no_docs):
    base = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(base), "x"), (1, " ".join(base), "y"), (2, None, ""), (3, "", ""), (None, "one two three four five six", ""), (4, "too short", ""), (5, "Alpha beta, gamma; delta epsilon zeta", "")], "item_id long, text string, doc_id string")
    rows = [(1, "x " + " ".join(base[20:] + ["q"] + base[:20]).upper()), (2, " ".join(base[:31])), (3, " ".join(base[:34])), (4, "one-two three, four five (six)"), (4, "one-two three, four five (six)"), (5, None), (6, "one two three four"), (None, " ".join(base))]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(((r.doc_id, r.item_id, r.covered) for r in got.collect()), key=repr) == sorted([(1, 1, 40), (3, 1, 34), (4, None, 6), (4, None, 6), (None, 1, 40)], key=repr)
    kept = decontaminate.without_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in odd_docs.collect() if not (r.text or "").startswith("Alpha")), key=repr)
    assert decontaminate.without_leaks(no_docs, items).collect() == []
    assert decontaminate.without_leaks(odd_docs, items.filter("false")).count() == odd_docs.count()


def plain_sections(values, rule, encode, size):
    """Tokens of each line of each field, by looking at the characters that a token holds."""
    given = [(f, v) for f, v in values if v is not None]
    if not given:
        return [(None, None, 0, 0, 0, 0)]
    owner, names = [], []
    for k, (f, v) in enumerate(given):
        line, lines = 0, v.split("\n")
        count = len(lines) if lines[-1] or len(lines) == 1 else len(lines) - 1
        at = len(names)
        names += [(f, i) for i in range(count)]
        for c in v:
            owner.append((at + line, c))
            line += c == "\n"
        if k + 1 < len(given):
            owner.append((len(names) - 1, "\n"))
    text = "".join(c for _, c in owner)
    byte_owner = [(o, j == 0) for o, c in owner for j in range(len(c.encode()))]
    tokens, crossing, at = [0] * len(names), [0] * len(names), 0
    for i in encode(text):
        held = byte_owner[at : at + int(size[i])]
        at += int(size[i])
        secs = sorted({o for o, _ in held})
        to = secs[0] if rule == "first" else secs[-1] if rule == "last" else max(secs, key=lambda s: (sum(b for o, b in held if o == s), -s))
        tokens[to] += 1
        crossing[to] += len(secs) > 1
    out, start = [], 0
    for s, (f, i) in enumerate(names):
        n = sum(o == s for o, _ in owner)
        out.append((f, i, start, n, tokens[s], crossing[s]))
        start += n
    return out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_equal_brute_force(spark, odd_docs, rule):
    rows = [r for r in odd_docs.collect() if r.doc_id not in (4, 6)]
    more = [(50, "a\n\n\n\n\nb  \n \n c\n", "en", "s"), (51, "\n", "e\nn", ""), (52, "漢\n字🙂\n\n🙂", None, "s"), (53, "x" * 300 + "\n" * 50 + "y", "en", None)]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, "q") for r in rows] + [(*m, "q") for m in more], "doc_id long, text string, lang string, source string, field string")
    encode, size = attribution.byte_encoder(attribution.tokenizer_path("byte_bpe_50k.tiktoken"))
    fields = ("source", "lang", "text")
    want = [(r.doc_id, *x) for r in df.collect() for x in plain_sections([(f, r[f]) for f in fields], rule, encode, size)]
    got = [tuple(r) for r in attribution.section_tokens(df, fields, rule=rule).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_section_query_adds_up(spark, sf_dir, no_docs):
    encode, size = attribution.byte_encoder(attribution.tokenizer_path("byte_bpe_50k.tiktoken"))
    rows = QUERIES["op5_section_tokens"](spark, sf_dir)
    total = {r.doc_id: r["sum(n_tokens)"] for r in rows.groupBy("doc_id").sum("n_tokens").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert total == {r.doc_id: len(encode("\n".join(x for x in (r.source, r.lang, r.text) if x is not None))) for r in docs}
    first = [r for r in docs if len(r.text) < 3000]
    want = [(r.doc_id, *x) for r in first for x in plain_sections([("source", r.source), ("lang", r.lang), ("text", r.text)], "most", encode, size)]
    ids = {r.doc_id for r in first}
    assert sorted(tuple(r) for r in rows.collect() if r.doc_id in ids) == sorted(want)
    per_field = {(r.doc_id, r.field): r.n_tokens for r in attribution.document_tokens(rows).collect()}
    assert sum(per_field.values()) == sum(total.values())
    assert attribution.section_tokens(no_docs, ("text",)).collect() == []
    with pytest.raises(ValueError):
        attribution.section_tokens(no_docs, rule="none")


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "one Two three, and more words here"), (2, "three two one"), (3, "solo"), (4, "a b c d e f"), (5, "two three"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "two three"), (11, "solo"), (12, ""), (13, None), (14, "b c d e f"), (15, "c d x e")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(1, 10, 1.0), (3, 11, 1.0), (4, 14, 1.0), (5, 10, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [2, 6]
