"""Token counts of a document's fields and sections, from one encoding of the whole document.

The fields are joined by a separator and encoded once. Byte-level tokens tile the text, so the running sum of their byte lengths gives each
token's span without offsets from the library, and a sorted-interval join (binary search of span ends in section ends) gives its sections.
"""

from __future__ import annotations

import base64
import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import slices
from tidelog.llm.words import tokenizer_path

#: Fixed value: the split pattern that belongs to the byte-level vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "first", "last")


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str):
    """(encode, bytes of each id) of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, size


def allocate(ends: np.ndarray, token_size: np.ndarray, text: bytes, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; ends: byte ends of the sections, which tile the text."""
    stop = np.cumsum(token_size)
    first = np.searchsorted(ends, stop - token_size, side="right")
    last = np.searchsorted(ends, stop - 1, side="right")
    owner, crossing = (last if rule == "last" else first).copy(), np.nonzero(first != last)[0]
    if rule == "most" and crossing.size:
        chars = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        before = lambda b: int(chars[b - 1]) if b else 0
        for k in crossing.tolist():
            cut = [int(stop[k] - token_size[k]), *ends[first[k] : last[k]].tolist(), int(stop[k])]
            held = [before(b) - before(a) for a, b in zip(cut, cut[1:])]
            owner[k] = first[k] + held.index(max(held))
    return np.bincount(owner, minlength=ends.size), np.bincount(owner[crossing], minlength=ends.size)


def section_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), tokenizer: str | None = None, rule: str = "most", separator: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, section, start, chars, n_tokens, n_crossing) for each line of each field of every row of docs.

    A document is its non-null fields joined by `separator` and encoded whole. Sections number a field's lines from 0; a line holds its line end, and a
    field's last line the separator after it, so sections tile the document and their tokens add up to the document's. start, chars: place and size in
    characters. A token that crosses a border goes to the section with most of its characters (the first of equals; a character counts where its first
    byte is), or by `rule` to its first or last section; n_crossing counts such tokens where they went. An empty field has one section, without
    tokens unless a separator follows. A row whose fields are all null gives one row with null field and section and no tokens. Repeated
    rows and null ids are kept. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")
    src = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    kinds = [("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("chars", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = byte_encoder(path)
        for batch in slices(batches, 256):
            out, of = defaultdict(list), []
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for row, values in enumerate(zip(*columns)):
                given = [(f, v) for f, v in zip(fields, values) if v is not None]
                if not given:
                    of.append(np.array([row]))
                    for name, v in (("field", [None]), ("section", [None]), ("start", [0]), ("chars", [0]), ("n_tokens", [0]), ("n_crossing", [0])):
                        out[name].append(v)
                    continue
                names, parts = [], []
                for k, (f, v) in enumerate(given):
                    lines = v.split("\n")
                    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
                    if k + 1 < len(given):
                        lines[-1] += separator
                    names += [(f, i) for i in range(len(lines))]
                    parts += lines
                chars = np.array([len(x) for x in parts], np.int64)
                whole = "".join(parts)
                data = whole.encode()
                ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in parts])
                tokens, crossed = allocate(ends, size[np.array(encode(whole), dtype=np.int64)], data, rule)
                of.append(np.full(len(parts), row))
                for name, v in (("field", [n for n, _ in names]), ("section", [i for _, i in names]), ("start", np.cumsum(chars) - chars), ("chars", chars), ("n_tokens", tokens), ("n_crossing", crossed)):
                    out[name].append(v)
            ids = batch.column(0).take(pa.array(np.concatenate(of)))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x for v in out[n] for x in (v if isinstance(v, list) else v.tolist())], t) for n, t in kinds]], names=["doc_id", *[n for n, _ in kinds]])

    tail = T._parse_datatype_string("field string, section int, start long, chars long, n_tokens long, n_crossing long").fields
    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], *tail]))


def document_tokens(sections: DataFrame) -> DataFrame:
    """(doc_id, field, n_tokens): the sections' tokens added up; each task's sections of a document are summed before the shuffle."""
    return sections.groupBy("doc_id", "field").agg(F.sum("n_tokens").alias("n_tokens"))
