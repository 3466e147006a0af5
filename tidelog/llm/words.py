"""Token ids of whole texts by the word-level BPE file, each distinct word encoded once per worker.

The file's tokenizer drops white space and splits at it, so no token spans a blank and the ids of a text are the ids of its
blank-separated words in order. Only the ASCII blanks, which every definition of white space holds, are taken as such here; other
white space stays inside a word for the tokenizer to split. Words that a worker has met are looked up by a 64-bit hash of
their bytes; its tables are bounded and keep the most used words when full.

A new word of printable ASCII and Latin-1 letters is cut into its letter runs, digits and sign runs, and the library's BPE model
encodes each distinct run; any other new word (apostrophes, special-token signs, other scripts) takes the library's whole chain.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import pyarrow as pa

from tidelog.llm.common import hashed, split_words


def tokenizer_path(file: str) -> str:
    """Place of a public tokenizer file: $TIDELOG_TOKENIZERS, or the installed collection."""
    folder = os.environ.get("TIDELOG_TOKENIZERS")
    if folder:
        return os.path.join(folder, file)
    import public_tokenizers

    return public_tokenizers.path(file)


#: A sign outside the words on which the file's normalizer is lower-casing alone and its pre-tokenizer cuts as RUN does.
ODD = re.compile(r"[^!-&(-;=-~À-ÖØ-öø-ÿ]")
RUN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others in order for U+0100 onwards.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}


class Runs(dict):
    """Letter run -> ids as packed 32-bit integers, by the library's model; a line end is -1."""

    def __init__(self, model):
        super().__init__({"\n": b"\xff\xff\xff\xff"})
        self.model = model

    def add(self, found: list[str]) -> None:
        """Encode the runs not held yet."""
        tokenize, pack = self.model.tokenize, struct.pack
        for run in set(found).difference(self):
            ids = [t.id for t in tokenize(run if run.isascii() else "".join(map(ALPHABET.__getitem__, run.encode())))]
            self[run] = pack(f"={len(ids)}i", *ids)


class WordEncoder:
    """Ids of whole columns of texts; tables of words and runs met so far, bounded."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        none = np.zeros(0, np.int64)
        self.key, self.number = np.zeros(0, np.uint64), none  # hashes in order and the words' numbers
        self.flat, self.start, self.size, self.uses = np.zeros(0, np.int32), none, none, none
        self.runs = Runs(self.tokenizer.model)

    def trim(self) -> None:
        """Keep the words met more than once, at most a third of the table."""
        keep = self.uses > max(1, np.partition(self.uses, -self.uses.size // 3)[-self.uses.size // 3])
        size = np.where(keep, self.size, 0)
        old, new = np.repeat(self.start - (np.cumsum(size) - size), size), np.cumsum(keep) - 1
        self.flat = self.flat[old + np.arange(int(size.sum()))]
        at = keep[self.number]
        self.key, self.number = self.key[at], new[self.number[at]]
        self.size = self.size[keep]
        self.start, self.uses = np.cumsum(self.size) - self.size, np.ones(self.size.size, np.int64)

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each distinct word, place of each word among these); new words are encoded. Words are told apart by 64-bit hashes."""
        h, first, at = np.unique(hashed(words), return_index=True, return_inverse=True)
        where = np.searchsorted(self.key, h)
        held = np.zeros(h.size, bool)
        inside = where < self.key.size
        held[inside] = self.key[where[inside]] == h[inside]
        out = np.empty(h.size, np.int64)
        out[held] = self.number[where[held]]
        fresh = ~held
        if fresh.any():
            out[fresh] = self.start.size + np.arange(int(fresh.sum()))
            self.learn(words.take(pa.array(first[fresh])).to_pylist())
            self.key, self.number = np.insert(self.key, where[fresh], h[fresh]), np.insert(self.number, where[fresh], out[fresh])
        return out, at

    def learn(self, fresh: list[bytes]) -> None:
        """Ids of new words, behind those of the words before."""
        words = b"\n".join(fresh).decode().split("\n")
        odd = [i for i, w in enumerate(words) if ODD.search(w)]
        whole = {i: self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in odd}
        for i in odd:
            words[i] = ""
        if len(self.runs) > 300_000:
            self.runs = Runs(self.tokenizer.model)
        found = RUN.findall("\n".join(words).lower())
        self.runs.add(found)
        ids = np.frombuffer(b"".join(map(self.runs.__getitem__, found)), dtype=np.int32)
        ends = np.concatenate((np.nonzero(ids < 0)[0], [ids.size]))
        size = np.diff(ends, prepend=-1) - 1
        if whole:
            parts = np.split(ids, ends[:-1])
            parts = [p[1:] if i else p for i, p in enumerate(parts)]
            for i, got in whole.items():
                parts[i], size[i] = np.array(got, dtype=np.int32), len(got)
            ids = np.concatenate(parts)
        else:
            ids = ids[ids >= 0]
        first = self.flat.size + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, ids))
        self.start, self.size = np.concatenate((self.start, first)), np.concatenate((self.size, size))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with the end id behind it; ids per text). Null is empty."""
        if self.size.size >= self.limit:
            self.trim()
        words, count = split_words(column)
        number, at = self.numbers(words)
        self.uses = np.concatenate((self.uses, np.zeros(self.start.size - self.uses.size, np.int64)))
        self.uses[number] += np.bincount(at, minlength=number.size)
        # one place more per text, for its end
        place = np.arange(at.size) + np.repeat(np.arange(count.size), count)
        ends = np.cumsum(count) + np.arange(count.size)
        size, start = np.ones(at.size + count.size, np.int64), np.zeros(at.size + count.size, np.int64)
        size[place], start[place] = self.size[number][at], self.start[number][at]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(start - before, size) + np.arange(int(size.sum()))] if self.flat.size else np.zeros(int(size.sum()), np.int32)
        ids[before[ends]] = end_id
        return ids, np.diff(np.concatenate(([0], before[ends] + 1)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file: later tasks of the worker find its words known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)
