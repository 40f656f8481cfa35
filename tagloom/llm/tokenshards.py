"""Token-ID output: sorted-string-table shards of token ids, with lookup by document.

A shard holds documents in key order in prefix-compressed blocks; a sparse index has
the last key and the place of each block, a Bloom filter the ids, a footer the places
of both and the totals. Lookup asks the filter, searches the index by bisection and
scans one block.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.bpe import Memory
from tagloom.llm.common import Scratch, arrow_map, release

MAGIC = b"SSTTOK01"
#: Bytes of a block before compression, of a shard's data, and Bloom filter bits for each document.
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 32 << 20, 10, 7
_FOOTER = struct.Struct("<QQQQQQQ8s")


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    """Orders as (doc_id, nth), null first."""
    head = b"\x00" + bytes(8) if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")
    return head + nth.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class ShardWriter:
    """Writes keys in ascending order; the shard appears under its name when it is closed."""

    def __init__(self, base: str, width: int):
        self.files, root = fs.FileSystem.from_uri(base)
        self.files.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        self.path, self.uri = f"{root}/{name}.sst", f"{base}/{name}.sst"
        self.out = self.files.open_output_stream(self.path + ".part")
        self.width, self.at, self.block, self.last, self.index = width, 0, bytearray(), b"", []
        self.hashes: list[int] = []
        self.docs = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += bytes([shared, len(key) - shared]) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key[:9]))
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(bytes(self.block), 1)
            self.out.write(data)
            self.index.append((self.last, self.at, len(data), zlib.crc32(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(bytes([len(k)]) + k + struct.pack("<QQI", at, n, crc) for k, at, n, crc in self.index)
        bits = max(64, self.docs * BLOOM_BITS)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        h = np.array(self.hashes, np.uint64)
        for k in range(BLOOM_HASHES):
            at = (h + np.uint64(k) * (h >> np.uint64(17) | np.uint64(1))) % np.uint64(bits)
            np.bitwise_or.at(bloom, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        self.out.write(index)
        self.out.write(bloom.tobytes())
        self.out.write(_FOOTER.pack(self.at, len(index), len(bloom), bits, self.docs, self.tokens, self.width, MAGIC))
        self.out.close()
        self.files.move(self.path + ".part", self.path)


class ShardReader:
    """Reads a shard block by block."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        data, n_index, n_bloom, self.bits, self.docs, self.tokens, self.width, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or data + n_index + n_bloom + _FOOTER.size != size:
            raise ValueError(f"{uri} is no whole shard")
        raw = self.file.read_at(n_index, data)
        self.bloom = self.file.read_at(n_bloom, data + n_index)
        self.keys, self.blocks, at = [], [], 0
        while at < len(raw):
            n = raw[at]
            self.keys.append(raw[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QQI", raw, at + 1 + n))
            at += 1 + n + 20

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, crc = self.blocks[k]
        data = self.file.read_at(n, at)
        if zlib.crc32(data) != crc:
            raise ValueError("damaged block")
        data, at, key = zlib.decompress(data), 0, b""
        while at < len(data):
            shared, rest = data[at], data[at + 1]
            n, at = _read_varint(data, at + 2)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", n // self.width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def may_hold(self, doc_id: int | None) -> bool:
        h = xxhash.xxh64_intdigest(key_of(doc_id)[:9])
        step = h >> 17 | 1
        for k in range(BLOOM_HASHES):
            at = (h + k * step) % (1 << 64) % self.bits
            if not self.bloom[at >> 3] >> (at & 7) & 1:
                return False
        return True

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each row of a document, in order; empty if the shard has none."""
        out: list[np.ndarray] = []
        if not self.may_hold(doc_id):
            return out
        head = key_of(doc_id)[:9]
        for k in range(bisect.bisect_left(self.keys, head), len(self.keys)):
            for key, ids in self._block(k):
                if key[:9] == head:
                    out.append(ids)
                elif key[:9] > head:
                    return out
        return out


_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: All cuts of byte-level pre-tokenizing, for what word_starts leaves too long.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Words whose ids one worker remembers, and characters that go to the library in one call.
CACHE_WORDS, ASKED_CHARS = 800_000, 1 << 16
#: Kinds of bytes: white space, letter, digit, apostrophe, other ASCII; the rest belongs to longer characters.
_BLANK, _LETTER, _DIGIT, _QUOTE, _MARK, _HIGH = range(6)
_KIND = np.array([_BLANK if c in b"\t\n\v\f\r " else _QUOTE if c == 39 else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK for c in range(128)] + [_HIGH] * 128, np.uint8)
#: Whether byte-level pre-tokenizing always cuts between two kinds (at 8 * first + second). A contraction begins with an apostrophe and a letter.
_CUTS = np.zeros(64, bool)
for _a, _ends in ((_LETTER, (_BLANK, _DIGIT, _QUOTE, _MARK)), (_DIGIT, (_BLANK, _LETTER, _QUOTE, _MARK)), (_QUOTE, (_BLANK, _DIGIT)), (_MARK, (_BLANK, _LETTER, _DIGIT)), (_HIGH, (_BLANK,))):
    _CUTS[[8 * _a + _b for _b in _ends]] = True


def word_starts(data: np.ndarray) -> np.ndarray:
    """Marks bytes of UTF-8 where a byte-level pre-tokenizer cuts, whatever stands around them; not all such places."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two
    lead = lead[(data[lead + 1] & 0x9F) != 0x97]
    kind[lead + 1] = _LETTER
    out = np.zeros(len(data), bool)
    out[1:] = _CUTS[kind[:-1] << 3 | kind[1:]]
    # white space goes on after wide white space, which begins with one of these bytes
    after = np.flatnonzero((kind[:-1] == _HIGH) & (kind[1:] == _BLANK)) + 1
    wide = (data[np.maximum(after - 2, 0)] == 0xC2) | np.isin(data[np.maximum(after - 3, 0)], (0xE1, 0xE2, 0xE3))
    out[after[wide]] = False
    return out


class CachedTokenizer:
    """The tokenizers library with a memory of frequent words; each distinct word of a batch is looked up once, and unknown ones go to the library together."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memory = Memory(CACHE_WORDS)
        self.size = self.library.get_vocab_size()
        # each character of a byte-level token stands for one byte
        vocab = self.library.get_vocab()
        self.lengths = np.zeros(1 + max(vocab.values()), np.int64)
        self.lengths[list(vocab.values())] = list(map(len, vocab))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, null as empty."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n, (_, at, data) = len(texts), texts.buffers()
        if not n:
            return []
        at = np.frombuffer(at, np.int64, n + 1, 8 * texts.offset)
        data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        start = word_starts(data) if len(data) else np.zeros(0, bool)
        start[at[:-1][at[:-1] < len(data)]] = True
        begins = np.flatnonzero(start)
        offsets = np.append(begins, len(data))
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        found = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.memory.known.get, found))
        unknown = [k for k, ids in enumerate(got) if ids is None]
        for k, ids in zip(unknown, self._ask_all([found[k] for k in unknown]), strict=True):
            got[k] = self.memory.put(found[k], ids)
        _, ends, ids = pa.array(got, pa.large_binary()).take(words.indices).buffers()
        ids = np.frombuffer(ids or b"", "<u4")
        ends = np.frombuffer(ends, np.int64, len(begins) + 1)[np.searchsorted(begins, at)] // 4
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for special in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, special)).tolist():
                out[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        return out

    def _ask_all(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words, of which the library gets a bounded number of characters at once."""
        group, chars = [], 0
        for w in words:
            if chars + len(w) > ASKED_CHARS:
                yield from self._ask(group)
                group, chars = [], 0
            if len(w) > ASKED_CHARS and len(pieces := _PIECE.findall(w)) > 1:
                yield b"".join(self._ask_all(pieces))
            else:
                group.append(w)
                chars += len(w)
        yield from self._ask(group)

    def _ask(self, words: list[str]) -> list[bytes]:
        """Ids of words by the library, joined where white space parts them; the tokens' lengths tell where each ends."""
        joined, sizes, pads, alone = [], [], [], []
        for k, w in enumerate(words):
            pad = w[0] not in "\t\n\v\f\r "
            if w[-1].isspace() or pad and w[0].isspace():
                alone.append(k)
                continue
            joined.append("\n" + w if pad else w)
            sizes.append(pad + (len(w) if w.isascii() else len(w.encode())))
            pads.append(pad)
        texts = ["".join(joined), *[words[k] for k in alone]]
        first, *rest = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        covered, ends = np.cumsum(self.lengths[first]), np.cumsum(np.array(sizes, np.int64))
        to = np.searchsorted(covered, ends) + 1
        if len(first) != (to[-1] if len(to) else 0) or not np.array_equal(covered[to - 1], ends):
            raise ValueError("this vocabulary does not cut texts as a byte-level one does")
        raw, at = first.tobytes(), 4 * (np.append(0, to[:-1])[: len(to)] + np.array(pads, np.int64))
        out = [raw[a:b] for a, b in zip(at.tolist(), (4 * to).tolist(), strict=True)]
        for k, ids in zip(alone, rest, strict=True):
            out.insert(k, ids.tobytes())
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def write_shards(docs: DataFrame, vocab: str, end_id: int, base: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under base; the rows of the result name them: part, seq, uri, first_id, docs, tokens.

    Shards of failed attempts are never named. Rows are ordered by id, then by a hash of the text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).withColumn("_h", F.xxhash64("_text"))
    # the hash deals out an id that many rows repeat
    ordered = src.repartitionByRange(n, F.col("_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_h").select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, done = TaskContext.get().partitionId(), 0, []
        tok = _tokenizer(vocab)
        width = 2 if max(tok.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4")
        writer, last, nth, first = None, None, 0, None
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                if writer is None:
                    writer, first = ShardWriter(base, width), doc_id
                nth = nth + 1 if doc_id == last and writer.docs else 0
                last = doc_id
                writer.add(key_of(doc_id, nth), np.append(ids, end))
                if writer.at >= SHARD_BYTES:
                    writer.close()
                    done.append((part, seq, writer.uri, first, writer.docs, writer.tokens))
                    writer, seq = None, seq + 1
        if writer is not None:
            writer.close()
            done.append((part, seq, writer.uri, first, writer.docs, writer.tokens))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=["part", "seq", "uri", "first_id", "docs", "tokens"])

    return arrow_map(ordered, run, "part int, seq int, uri string, first_id long, docs long, tokens long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for key, ids in ShardReader(uri):
                for column, v in zip(rows, (id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    column.append(v)
                start += len(ids)
                if len(rows[0]) >= 4096:
                    yield _described(rows)
                    rows = ([], [], [], [])
            yield _described(rows)


def _described(rows: tuple[list, list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def tokenize_to_shards(docs: DataFrame, vocab: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, write shards in ascending id order, read them back, one output row per input row.

    Null text counts as empty and gives the end id alone. Null ids come first; rows that
    repeat an id follow one another by a hash of their text. Other columns are ignored.
    Result: doc_id, start, n_tokens, ids_crc32.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    manifest = scratch.table(write_shards(docs, vocab, end_id, scratch.path("shards"), id_col, text_col), "manifest")
    release(spark)
    # one row for each shard of up to SHARD_BYTES, so the running total is a short sort
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = scratch.table(manifest.select("uri", before.alias("start")), "placed")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(placed.repartition(n, "uri"), _read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")
