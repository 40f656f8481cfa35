"""BPE encoding and decoding: backtracking encoder, offset-table decoder.

The encoder takes at each byte the longest vocabulary token that an Aho-Corasick
automaton found there, accepts it after the previous token only if the pair is
compatible (byte-pair merging would not have joined anything across their border,
remembered in a table), and else falls back to the token's next shorter prefix or
steps back. Each border is ruled out at most once, so the work per word is linear
and the result is that of merging by rank.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tagloom.llm.common import arrow_map, texts_of

END = "\x01"  # not among the 256 characters that stand for bytes
SUFFIX = "</w>"
#: Entries of a worker's memory for pieces between white space and for words, and the misses after which it is built anew.
CACHE_PIECES, CACHE_WORDS, MISSES = 300_000, 400_000, 20_000_000
#: Entries of the pair-compatibility table that one worker keeps.
PAIRS = 400_000
#: Longer strings are encoded anew each time.
CACHE_CHARS = 40

_SPACE = r"\t-\r \x85\xa0"
_WIDE_SPACE = _SPACE + r"  -     　"
_LATIN = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_DIGIT}]|[^{_SPACE}{_LATIN}{_DIGIT}]+")
_SPACES = regex.compile(rf"[{_WIDE_SPACE}]+")
#: Characters that str.split() takes for white space and this vocabulary does not.
_ODD = re.compile("[\x1c-\x1f]")
_WIDE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WIDE_SPACE}\p{{L}}\p{{N}}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(kept))
    return [out[b] for b in range(256)]


class Memory:
    """Remembers the bytes of the first `size` short strings, which hold the frequent ones; starts over after MISSES misses when full."""

    def __init__(self, size: int):
        self.size, self.known, self.missed = size, {}, 0

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.known) < self.size:
            if len(key) <= CACHE_CHARS:
                self.known[key] = value
        else:
            self.missed += 1
            if self.missed > MISSES:
                self.known.clear()
                self.missed = 0
        return value


class BpeModel:
    """Byte-level BPE whose words carry an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chars = byte_chars()
        self.to_chars = {b: c for b, c in enumerate(self.chars)}
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        # internal numbers follow the order of merging, which the pair test relies on
        self.names = [*base, *dict.fromkeys(a + b for a, b in merges)]
        order = {t: k for k, t in enumerate(self.names)}
        self.ids = [vocab[t] for t in self.names]
        self.split = [(k, k) for k in range(len(self.names))]
        self.join: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair, k = (order[a], order[b]), order[a + b]
            if self.split[k] == (k, k):
                self.split[k] = pair
            self.join.setdefault(pair, k)
        self.keys = [t.removesuffix(SUFFIX) + END if t.endswith(SUFFIX) else t for t in self.names]
        self.known = {t: k for k, t in enumerate(self.keys)}
        self.lengths = [len(t) for t in self.keys]
        self.pairs: dict[int, bool] = {}
        self.usable = [self._is_usable(k) for k in range(len(self.names))]
        self.automaton = ahocorasick.Automaton()
        for t, k in self.known.items():
            if self.usable[k]:
                self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        self.shorter = [next((self.known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.known and self.usable[self.known[t[:n]]]), -1) for t in self.keys]
        self.pieces, self.seen = Memory(CACHE_PIECES), Memory(CACHE_WORDS)
        self._decode_table(vocab)

    def _is_usable(self, k: int) -> bool:
        """Whether merging its own characters gives this token."""
        left, right = self.split[k]
        return left == k or self._compatible(left, right, k)

    def _compatible(self, a: int, b: int, below: int) -> bool:
        """Whether no merge of a rank under `below` crosses the border between a and b; undoes merges from the last one on."""
        limit = below
        while True:
            whole = self.join.get((a, b))
            if whole is not None and whole < limit:
                return False
            if a > b:
                limit, a = min(below, a), self.split[a][1]
                if a == limit:
                    limit, b = min(below, b + 1), self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = min(below, b + 1), self.split[b][0]
                if b + 1 == limit:
                    limit, a = min(below, a), self.split[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self._compatible(a, b, 1 << 30)
        return found

    def _decode_table(self, vocab: dict[str, int]) -> None:
        names = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, k in [*vocab.items(), *self.special.items()]:
            names[k] = t.encode() + b" "
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.at = np.cumsum([0, *map(len, names)]).astype(np.int64)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a piece of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma: one lower-case form, wherever it stands
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _WIDE.findall(text)
        return _NARROW.findall(text)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        s = (word if word.isascii() and word.isprintable() else "".join([self.chars[b] for b in word.encode()])) + END
        n, size, pairs = len(s), self.lengths, self.pairs
        longest = [-1] * n
        for end, k in self.automaton.iter(s):
            longest[end + 1 - size[k]] = k  # matches come by their end, so the longest is the last
        out: list[int] = []
        open_at = [True] * (n + 1)
        open_at[n - 1] = False  # no token may leave the mark alone
        pos, token, last = 0, longest[0], -1
        while pos < n:
            if token >= 0:
                to = pos + size[token]
                if open_at[to]:
                    fits = True
                    if last >= 0:
                        fits = pairs.get(last << 32 | token)
                        if fits is None:
                            fits = self.compatible(last, token)
                    if fits:
                        out.append(token)
                        pos, last = to, token
                        if pos < n:
                            token = longest[pos]
                        continue
                token = self.shorter[token]
                if token >= 0:
                    continue
            open_at[pos] = False
            if not out:
                raise ValueError(f"no encoding for {word!r}")
            token = out.pop()
            last = out[-1] if out else -1
            pos -= size[token]
        return [self.ids[k] for k in out]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_at and any(t in text for t in self.special):
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._encode_plain(p) for p in self.special_at.split(text) if p)
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        # no word reaches across white space, so each piece between is looked up or encoded by itself
        pieces = _SPACES.split(text) if _ODD.search(text) else text.split()
        out = list(map(self.pieces.known.get, pieces))
        if None in out:
            put, encode = self.pieces.put, self._encode_piece
            for k, got in enumerate(out):
                if got is None:
                    out[k] = put(pieces[k], encode(pieces[k]))
        return b"".join(out)

    def _encode_piece(self, piece: str) -> bytes:
        out, seen = [], self.seen
        for w in self.words(piece):
            got = seen.known.get(w)
            if got is None:
                ids = self.encode_word(w)
                got = seen.put(w, struct.pack(f"<{len(ids)}I", *ids))
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' names, joined by spaces, gathered through the offset table."""
        if not len(ids):
            return b""
        start = self.at[ids]
        size = self.at[ids + 1] - start
        total = int(size.sum())
        shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return self.blob[shift + np.arange(total)][:-1].tobytes()


@lru_cache(maxsize=2)
def model(path: str) -> BpeModel:
    return BpeModel(path)


def encode_decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode them again, one output row per input row.

    Null text counts as empty: no tokens and the digests of nothing. Repeated rows give
    repeated rows; a null id stays null; columns besides id, text and `keep` are ignored.
    with_ids adds `ids` (array<int>) and `decoded`.
    """
    keep = keep or []
    fields = {f.name: f for f in docs.schema.fields}
    extra = "".join(f", `{c}` {fields[c].dataType.simpleString()}" for c in keep)
    schema = f"doc_id {fields[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocab)
        for b in batches:
            n, sha, back, ids_out, text_out = [], [], [], [], []
            for t in texts_of(b.column(1)):
                raw = bpe.encode(t)
                ids = np.frombuffer(raw, "<u4").astype(np.int64)
                decoded = bpe.decode(ids)
                n.append(len(ids))
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_out.append(ids.astype(np.int32))
                    text_out.append(decoded.decode())
            columns = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            columns |= {c: b.column(2 + k) for k, c in enumerate(keep)}
            if with_ids:
                columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(text_out, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return arrow_map(docs.select(docs[id_col], docs[text_col], *[docs[c] for c in keep]), run, schema)
