"""Media columns: content-defined chunks, deduplicated by digest, and verified reconstruction.

A payload of 8-bit samples is cut where a rolling gear hash of its last 32 bytes has
zero top bits, so equal passages give equal chunks wherever they stand. Digests alone
are shuffled to find, by joins, the one payload that owns each chunk; the store then has
one record for each distinct payload: its ordered chunk list and the bytes of the chunks
it owns. Payload bytes are shuffled once, compressed, to their record, in a table bucketed
by payload, and a slice of the payloads at a time, so that shuffle files stay a share of
the store. Reading back needs no further shuffle of the store: a record's own chunks are
at hand, and only chunks that another payload owns are joined in. Every payload is
verified by digest. Equal payloads share one record, which is the stored form described.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import Scratch, arrow_map, release, remove

PAD, MULTIPLE = b"\x20", 192
#: Chunk bytes: least, average (a power of two), most.
LEAST, AVERAGE, MOST = 512, 2048, 16384
_GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4").astype(np.uint32)
#: Compression level of stored samples.
LEVEL = 12
#: Parts in which payloads are shuffled to their records, one after the other: disk for shuffles is this share of the store.
SLICES = 2
#: Payload digests that one task remembers, so that it ships copies once.
RECENT = 100_000
#: Buckets of the store at most, as Spark allows no more.
MOST_BUCKETS = 100_000
_MAGIC, _DIGEST = b"GDR1", 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """Padded payload of a text (null: empty) and the bytes before padding."""
    raw = (text or "").encode("utf-8")
    return raw + PAD * (max(1, -(-len(raw) // MULTIPLE)) * MULTIPLE - len(raw)), len(raw)


def gear_hash(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' random numbers, shifted by age."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 32:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width) if len(h) > width else 0
        h, width = h + shifted, width * 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    if len(data) <= LEAST:
        return [len(data)]
    found = np.flatnonzero(gear_hash(data) < np.uint32(2**32 // AVERAGE)) + 1
    ends, at = [], 0
    for end in found.tolist():
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST:
            ends.append(end)
            at = end
    while len(data) - at > MOST:
        at += MOST
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


def _pieces(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def digest_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:_DIGEST]


def record_of(payload: bytes, digests: list[bytes], sizes: list[int], elsewhere: set[int], frame: bytes | None = None) -> bytes:
    """The stored form of a payload: its chunks' digests, sizes and whether it owns them, then one frame of those it owns.

    elsewhere has the places of chunks that another payload, or another place, owns;
    frame is the compressed payload, which is used as it is if all chunks are its own.
    """
    listed = b"".join(d + struct.pack("<IB", n, k not in elsewhere) for k, (d, n) in enumerate(zip(digests, sizes, strict=True)))
    if elsewhere or frame is None:
        ends = np.cumsum([0, *sizes]).tolist()
        frame = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(payload[ends[k] : ends[k + 1]] for k in range(len(sizes)) if k not in elsewhere))
    return _MAGIC + struct.pack("<I", len(digests)) + listed + frame


def chunks_of(record: bytes) -> list[tuple[bytes, bytes | None]]:
    """Digest and samples of each chunk of a stored form; None for samples that are stored elsewhere."""
    if record[:4] != _MAGIC:
        raise ValueError("not a stored payload")
    (n,) = struct.unpack_from("<I", record, 4)
    at, listed = 8, []
    for _ in range(n):
        listed.append((record[at : at + _DIGEST], *struct.unpack_from("<IB", record, at + _DIGEST)))
        at += _DIGEST + 5
    own, out, k = zstandard.ZstdDecompressor().decompress(record[at:]), [], 0
    for d, size, owned in listed:
        out.append((d, own[k : k + size] if owned else None))
        k += size if owned else 0
    if k != len(own):
        raise ValueError("damaged payload")
    return out


def features(payload: bytes) -> str:
    """Mean, deviation and zero crossings around the mean of the samples, in integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    mean = int(x.sum()) // len(x)
    centred = x - mean
    return f"mean={mean};power={int((centred * centred).sum()) // len(x)};crossings={int(np.count_nonzero(np.diff(centred >= 0)))}"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, bytes_, lists, sizes = [], [], [], []
        for t in b.column(1).to_pylist():
            payload, n = payload_of(t)
            pieces = _pieces(payload)
            keys.append(hashlib.sha256(payload).digest())
            bytes_.append(n)
            lists.append([digest_of(c) for c in pieces])
            sizes.append([len(c) for c in pieces])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bytes_, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))], names=["doc_id", "n_bytes", "key", "chunks", "sizes"])


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (key, compressed payload), each payload once for what a task remembers."""
    seen: set[bytes] = set()
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        keys, frames = [], []
        for t in b.column(0).to_pylist():
            payload, _ = payload_of(t)
            key = hashlib.sha256(payload).digest()
            if key in seen:
                continue
            if len(seen) >= RECENT:
                seen.clear()
            seen.add(key)
            keys.append(key)
            frames.append(packer.compress(payload))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(frames, pa.binary())], names=["key", "frame"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, frame, chunks, sizes, elsewhere) -> (key, record)."""
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for frame, chunks, sizes, elsewhere in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
            out.append(record_of(unpacker.decompress(frame) if elsewhere else b"", chunks, sizes, set(elsewhere or ()), frame))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["key", "record"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, places) -> (digest, data) of the chunks at those places, compressed."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        digests, data = [], []
        for record, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            chunks = chunks_of(record)
            for k in places:
                digests.append(chunks[k][0])
                data.append(packer.compress(chunks[k][1]))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["digest", "data"])


_BUILT = pa.schema([("key", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, record, brought) -> what is read back of each payload; holds one payload at a time."""
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for key, record, brought in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            chunks = chunks_of(record)
            more = {x["pos"]: unpacker.decompress(x["data"]) for x in brought or ()}
            parts = [own if own is not None else more.get(k, b"") for k, (_, own) in enumerate(chunks)]
            if any(digest_of(p) != d for p, (d, _) in zip(parts, chunks, strict=True)):
                raise ValueError("a chunk is missing from the store or differs")
            payload = b"".join(parts)
            if hashlib.sha256(payload).digest() != key:
                raise ValueError("a payload differs from what was stored")
            rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(record), hashlib.sha256(record).hexdigest(), features(payload)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_BUILT)], schema=_BUILT)


@dataclass
class Store:
    """Recipes (doc_id, n_bytes, key), owners of shared chunks (digest, key, pos), references to them (key, pos, digest), and the table of records (key, record) bucketed by key."""

    recipes: DataFrame
    owners: DataFrame
    references: DataFrame
    table: str
    path: str

    def drop(self) -> None:
        spark = self.recipes.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(spark, self.path)


def store(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Write recipes, owners, references and records."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    recipes = scratch.table(arrow_map(docs.select(docs[id_col], docs[text_col]), _recipes, f"doc_id {kind}, n_bytes long, key binary, chunks array<binary>, sizes array<int>"), "recipes")
    payloads = scratch.table(recipes.select("key", "chunks", "sizes").dropDuplicates(["key"]), "payloads")
    places = payloads.select("key", F.posexplode("chunks").alias("pos", "digest"))
    # a chunk belongs to the least payload that has it; only chunks that stand in several places are listed
    owners = places.groupBy("digest").agg(F.min(F.struct("key", "pos")).alias("_o"), F.count("*").alias("_n")).where("_n > 1").select("digest", "_o.key", "_o.pos")
    owners = scratch.table(owners, "owners")
    named = owners.select(F.col("digest").alias("_d"), F.col("key").alias("_k"), F.col("pos").alias("_p"))
    references = places.join(named, places["digest"] == named["_d"]).where("key <> _k OR pos <> _p").select("key", "pos", "digest")
    references = scratch.table(references, "references")
    about = payloads.join(references.groupBy("key").agg(F.collect_list("pos").alias("elsewhere")), "key", "left")
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    table, path = f"media_records_{uuid.uuid4().hex[:12]}", scratch.path("records")
    text = docs.select(docs[text_col].alias("_text"))
    out = Store(recipes.select("doc_id", "n_bytes", "key"), owners, references, table, path)
    try:
        for k in range(SLICES):
            # final spaces may be padding, so texts of one payload agree up to them and fall into one slice
            part = text.where(F.pmod(F.xxhash64(F.rtrim(F.coalesce("_text", F.lit("")))), F.lit(SLICES)) == k)
            shipped = arrow_map(part, _ship, "key binary, frame binary").repartition(n, "key").dropDuplicates(["key"])
            records = arrow_map(shipped.join(about, "key").select("key", "frame", "chunks", "sizes", "elsewhere"), _records, "key binary, record binary")
            records.write.mode("append").bucketBy(n, "key").option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(table)
            release(spark)
    except BaseException:
        out.drop()
        raise
    return out


def rebuild(kept: Store) -> DataFrame:
    """Read each distinct payload back from the store: key, sizes, digests and features of the stored form."""
    spark = kept.recipes.sparkSession
    records = spark.table(kept.table)
    wanted = kept.owners.groupBy("key").agg(F.collect_list("pos").alias("places"))
    shared = arrow_map(records.join(wanted, "key").select("record", "places"), _shared, "digest binary, data binary")
    brought = kept.references.join(shared, "digest").groupBy("key").agg(F.collect_list(F.struct("pos", "data")).alias("brought"))
    return arrow_map(records.join(brought, "key", "left").select("key", "record", "brought"), _rebuild, "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media and describe what is read back, one output row per input row.

    media_bytes and media_sha256 are of the payload's record as it lies in the store.
    Null text counts as empty (a payload of padding only). Repeated rows are repeated and
    stored once; a null id stays null; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "media")
    kept = store(docs, scratch, id_col, text_col)
    try:
        built = scratch.table(rebuild(kept), "built")
    finally:
        kept.drop()
        release(docs.sparkSession)
    return kept.recipes.join(built, "key").drop("key")
