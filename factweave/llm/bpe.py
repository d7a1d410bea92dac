"""Exact BPE encoding by backtracking over longest token matches, decoding by an offset table.

A word's tokens are found from left to right: an Aho-Corasick pass gives the longest token at each place, and a token
may follow another only if the merges of both could not have joined across their border. That is read off the merge
table: undoing the later merge of the two, again and again, must never show a pair that would have merged first. A dead
end shortens the last token and marks the place, so each place is left once and the time is linear in the word's length.

Normalisation and word splitting are those of the vocabulary file's family: white space separates, letters are
lower-cased one by one, words end with a marker. Characters beyond Latin letters go through the tokenizer file's own
normaliser and splitter. Decoding joins the token strings with one space, as the file names no decoder.

Defined results: a null or empty text has no ids and decodes to an empty text; strings of the special tokens in a text
become these tokens; equal rows give equal results; other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from factweave.llm.storage import small_batches

#: Distinct words whose ids a task keeps; a full cache starts anew.
CACHE_WORDS = 100_000

# The word pattern of the vocabulary file, with its white space spelt out for characters up to U+017F.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\x00-ſ‘’“”–—…€]*")
END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next free one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file. Inside, a symbol is one character; the last of a word has its own code."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder"):
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        letters = byte_letters()
        self.inner = {ord(c): b for b, c in enumerate(letters)}  # library's letters -> symbols
        code = {c: chr(b) for b, c in enumerate(letters)} | {c + END: chr(256 + b) for b, c in enumerate(letters)}
        self.tokens: dict[str, int] = {}
        for text, i in vocab.items():
            body, last = (text[:-4], True) if text.endswith(END) and len(text) > 4 else (text, False)
            self.tokens["".join(code[c] for c in body[:-1]) + code[body[-1] + END * last]] = i
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.length, self.left, self.right, self.rank = [1] * size, [*range(size)], [*range(size)], [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            if self.rank[i] >= 0:
                raise ValueError("a token with two merges")
            self.left[i], self.right[i], self.rank[i], self.merged[x, y] = x, y, rank, i
        self.shorter: list[int | None] = [None] * size
        self.matches = ahocorasick.Automaton()
        for s, i in self.tokens.items():
            self.length[i] = len(s)
            self.matches.add_word(s, i)
            self.shorter[i] = next((self.tokens[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.tokens), None)
        self.matches.make_automaton()
        strings = [b""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            strings[i] = text.encode()
        self.bytes = np.frombuffer(b" ".join(strings) + b" ", np.uint8)
        self.widths = np.array([len(s) + 1 for s in strings])
        self.offsets = np.cumsum(self.widths) - self.widths
        self.follows = functools.lru_cache(1 << 15)(self._follows)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _follows(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: no merge across their border would have come first."""
        limit, rank = len(self.merged), self.rank
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and rank[joined] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            # the merge that came last is undone; on the left of the border an equal rank would have come first
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def word(self, symbols: str) -> tuple[int, ...]:
        """Ids of one word in symbols."""
        longest: list[int | None] = [None] * (len(symbols) + 1)
        for end, i in self.matches.iter(symbols):
            at = end + 1 - self.length[i]
            if longest[at] is None or self.length[i] > self.length[longest[at]]:
                longest[at] = i
        found, at, alive, token = [], 0, [True] * (len(symbols) + 1), longest[0]
        while token is not None:
            last = found[-1] if found else None
            while token is not None:
                end = at + self.length[token]
                if alive[end] and (last is None or self.follows(last, token)):
                    break
                token = self.shorter[token]
            if token is not None:
                found.append(token)
                at = end
                token = longest[at]
            else:
                alive[at] = False
                token = found.pop()
                at -= self.length[token]
        return tuple(found)

    def _add(self, out: list[int], text: str) -> None:
        cache = self.cache
        if PLAIN.fullmatch(text):
            for w in WORD.findall(text.lower()):
                ids = cache.get(w)
                out += ids if ids is not None else self._learn(w, w.encode().decode("latin-1"))
            return
        for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            out += self.word(self._close(w.translate(self.inner)))  # spelt in the library's byte letters

    @staticmethod
    def _close(symbols: str) -> str:
        return symbols[:-1] + chr(256 + ord(symbols[-1]))

    def _learn(self, word: str, symbols: str) -> tuple[int, ...]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = ids = self.word(self._close(symbols))
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._add(out, part)
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the decoded texts of ids[:ends[0]], ids[ends[0]:ends[1]], ..."""
        width = self.widths[ids]
        lasts = ends[np.diff(ends, prepend=0) > 0] - 1
        width[lasts] -= 1  # no space after the last token
        until = np.cumsum(width)
        place = np.arange(until[-1] if len(until) else 0) + np.repeat(self.offsets[ids] - (until - width), width)
        return self.bytes[place], np.append(0, np.append(0, until)[ends])


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): token ids of each whole text and the text that they decode to."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            at, held, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(v.encode(text.as_py() or ""))
                size += len(held[-1])
                if size > 500_000 or i == batch.num_rows - 1:  # the tables below take some bytes for each decoded letter
                    ends = np.cumsum([len(x) for x in held])
                    ids = np.fromiter((i for x in held for i in x), np.int32, size)
                    data, offsets = v.decode(ids, ends)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                    texts = pa.Array.from_buffers(pa.large_string(), len(held), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                    yield pa.record_batch([batch.column(0).slice(at, len(held)).cast(pa.int64()), lists, texts], schema=schema)
                    at, held, size = i + 1, [], 0
        v.cache.clear()  # workers live on: what a task has learned goes with it
        v.follows.cache_clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
