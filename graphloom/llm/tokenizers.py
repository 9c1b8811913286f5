"""Public tokenizers and a batch encoder that encodes each distinct chunk once."""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np

from . import kernels as K
from .shared import worker_cache

TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.tiktoken"
#: Split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks whose token ids a worker remembers.
REMEMBER = 400_000


def digest_of(name: str = DEFAULT, folder: str = TOKENIZER_DIR) -> str:
    """Version digest of a tokenizer: its vocabulary file and split pattern."""
    with open(os.path.join(folder, name), "rb") as f:
        return hashlib.sha256(f.read() + PATTERN.encode()).hexdigest()


def encoding(name: str = DEFAULT, folder: str = TOKENIZER_DIR):
    """The byte-level BPE named, loaded once in each process."""
    cache = worker_cache()
    if ("bpe", folder, name) not in cache:
        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        cache["bpe", folder, name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["bpe", folder, name]


def _starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chunk starts: each row's start, and each lone white-space byte between two others.

    No token of the split pattern reaches across such a byte's left side, so
    chunks can be encoded one by one.
    """
    ws = np.zeros(256, bool)
    ws[[9, 10, 11, 12, 13, 32]] = True
    w = ws[data]
    cut = np.zeros(len(w), bool)
    cut[1:-1] = w[1:-1] & ~w[:-2] & ~w[2:]
    cut[offs[:-1][offs[:-1] < len(w)]] = True
    return np.flatnonzero(cut)


class Chunks:
    """Encoder of batches: distinct chunks by hash, encoded once and remembered."""

    def __init__(self, name: str = DEFAULT, folder: str = TOKENIZER_DIR):
        self.bpe = encoding(name, folder)
        self.wide = np.uint16 if self.bpe.n_vocab <= 1 << 16 else np.uint32
        self.clear()

    def clear(self):
        self.index: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, self.wide)
        self.ends = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _add(self, tokens):
        end = self.ends[self.n - 1] if self.n else 0
        if self.n + 1 >= len(self.ends):
            self.ends = np.r_[self.ends, np.zeros(len(self.ends), np.int64)]
        while end + len(tokens) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), self.wide)]
        self.ids[end : end + len(tokens)] = tokens
        self.ends[self.n] = end + len(tokens)
        self.n += 1
        return self.n - 1

    def lookup(self, data: np.ndarray, offs: np.ndarray):
        """(row, entry) of each chunk in order; the entries' ids are in this object."""
        if self.n > REMEMBER:
            self.clear()
        s = _starts(data, offs)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e = np.r_[s[1:], len(data)]
        h = K.span_hash(data, s, e, self._bytes())
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        entry = np.empty(len(u), np.int64)
        get, encode = self.index.get, self.bpe.encode_ordinary
        raw = data.tobytes()
        for i, key in enumerate(u.tolist()):
            k = get(key)
            if k is None:
                j = at[i]
                k = self.index[key] = self._add(encode(raw[s[j] : e[j]].decode("utf-8", "replace")))
            entry[i] = k
        return np.searchsorted(offs, s, "right") - 1, entry[back]

    @staticmethod
    def _bytes():
        cache = worker_cache()
        if "chunk bytes" not in cache:
            cache["chunk bytes"] = K._random_table(12, 256)
        return cache["chunk bytes"]

    def sizes(self, entry: np.ndarray) -> np.ndarray:
        return self.ends[entry] - np.where(entry > 0, self.ends[entry - 1], 0)

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of every row."""
        row, entry = self.lookup(data, offs)
        return np.bincount(row, weights=self.sizes(entry), minlength=len(offs) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """(ids end to end, tokens of every row)."""
        row, entry = self.lookup(data, offs)
        size = self.sizes(entry)
        total = int(size.sum())
        ends = np.cumsum(size)
        at = np.arange(total) - np.repeat(ends - size, size) + np.repeat(self.ends[entry] - size, size)
        return self.ids[at], np.bincount(row, weights=size, minlength=len(offs) - 1).astype(np.int64)


def chunks(name: str = DEFAULT, folder: str = TOKENIZER_DIR) -> Chunks:
    cache = worker_cache()
    if ("chunks", folder, name) not in cache:
        cache["chunks", folder, name] = Chunks(name, folder)
    return cache["chunks", folder, name]
