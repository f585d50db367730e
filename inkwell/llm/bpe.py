"""Corpus encoding by a byte-level BPE vocabulary: prefix-sharing trie traversal over distinct words (problem 8).

The last token of every prefix of a word determines its encoding: tokens a, b may follow each other exactly if BPE leaves
their joined bytes as a, b, and a sequence of such pairs is the encoding of its bytes. So the last token of a prefix is
the one suffix token that may follow the last token of what is before it. Distinct words are visited in byte order,
which is the depth-first order of their trie; the states of a prefix shared with the word before are kept, not redone.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are split into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encodings a worker keeps; beyond it, it starts anew.
KEPT_WORDS = 400_000


class TrieEncoder:
    """Encoder of a rank file (base64 bytes and rank in each line); ranks are ids and the order of merges."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern).findall
        self.longest = max(map(len, self.ranks))
        size = max(self.ranks.values()) + 1
        self.left, self.right, self.size = list(range(size)), list(range(size)), [1] * size
        self.merged: dict[int, int] = {}
        self.checked: dict[int, bool] = {}
        self.kept: dict[str, list[int]] = {}
        for token, t in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.size[t] = len(token)
            if len(token) > 1:
                a, b = next(p for p in self._halves(token, t) if self._stay(*p))
                self.left[t], self.right[t] = a, b
                self.merged[a << 32 | b] = t
        self.checked.clear()
        # suffixes of tokens that are tokens, to stop looking where no longer token can end
        self.ends = {token[i:] for token in self.ranks for i in range(len(token))}

    def _halves(self, token: bytes, t: int) -> Iterator[tuple[int, int]]:
        for i in range(1, len(token)):
            a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if a is not None and b is not None and a < t and b < t:
                yield a, b

    def _stay(self, a: int, b: int) -> bool:
        """Whether BPE leaves a, b apart: no merge across the border comes before the merges that made both.

        The borders of a and b are undone from the latest merge on; at each stage the two tokens at the border must not
        merge earlier than the next one that is undone.
        """
        limit = 1 << 31
        while True:
            m = self.merged.get(a << 32 | b)
            if m is not None and m < limit:
                return False
            # undo the later of the two; of one token's equal ranks the left one merges first
            if a > b:
                limit, a_ = a, self.right[a]
                if a_ != a:
                    a = a_
                    continue
                limit, b_ = b + 1, self.left[b]
                if b_ == b:
                    return True
                b = b_
            else:
                limit, b_ = b + 1, self.left[b]
                if b_ != b:
                    b = b_
                    continue
                limit, a_ = a, self.right[a]
                if a_ == a:
                    return True
                a = a_

    def follows(self, a: int, b: int) -> bool:
        k = a << 32 | b
        known = self.checked.get(k)
        if known is None:
            if len(self.checked) > 4_000_000:
                self.checked.clear()
            known = self.checked[k] = self._stay(a, b)
        return known

    def encode_words(self, words: list[str]) -> None:
        """Put the encodings of distinct words into kept."""
        ranks, ends, follows, size, longest = self.ranks, self.ends, self.follows, self.size, self.longest
        last = [-1]  # last token of the prefix of each length
        before = b""
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            n = min(len(before), len(data))
            shared = n if before[:n] == data[:n] else next(i for i in range(n) if before[i] != data[i])
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                found = -1
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    piece = data[start:end]
                    if piece not in ends:
                        break
                    t = ranks.get(piece)
                    if t is not None and (start == 0 or follows(last[start], t)):
                        found = t  # exactly one suffix fits; a whole-prefix token still may only be the last
                        if start:
                            break
                        # the prefix is a token by itself: it is its own encoding
                last.append(found)
            out, at = [], len(data)
            while at:
                out.append(last[at])
                at -= size[last[at]]
            out.reverse()
            self.kept[word] = out
            before = data

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty ones have none."""
        split = [self.words(t) if t else [] for t in texts]
        new = {w for s in split for w in s} - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = {w for s in split for w in s}
        self.encode_words(list(new))
        kept = self.kept
        return [[i for w in s for i in kept[w]] for s in split]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder of a file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def _mapped(df: DataFrame, text: str, path: str, schema: str, result: Callable[[list[list[int]]], pa.Array]) -> DataFrame:
    # a column named like the result gives way to it
    keep = [c for c in df.columns if c not in (text, schema.split()[0])]
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c in keep)
    df = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = enc.encode(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], result(ids)], [*keep, schema.split()[0]])

    return df.mapInArrow(run, f"{kinds}, {schema}")


def encode_corpus(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """key, ids: the token ids of each row's whole text without special tokens; null and empty texts have an empty list.

    Strings of special tokens in a text are ordinary text. Repeated rows stay. Nothing is shuffled: a worker encodes the
    distinct words of a batch that it hasn't met yet and looks up all others.
    """

    def lists(ids: list[list[int]]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([i for x in ids for i in x], pa.int32()))

    return _mapped(df.select(F.col(key), F.col(text).cast("string").alias("__text")), "__text", path, "ids array<int>", lists)


def count_tokens(df: DataFrame, text: str, path: str = f"{TOKENIZERS}/{BYTE_BPE}", into: str = "tokens") -> DataFrame:
    """df without its text, with the number of its tokens."""
    return _mapped(df, text, path, f"{into} bigint", lambda ids: pa.array([len(x) for x in ids], pa.int64()))
