"""Media columns: payloads in content-defined chunks, deduplicated by digest, rebuilt from ordered chunk lists and verified.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are stored as 8-bit unsigned mono samples in a RIFF
WAVE container (576 samples are 72 ms at 8 kHz). The container is cut where a gear hash, rolling over the last 32 bytes, has
``MASK`` bits zero, not before ``LEAST`` and not after ``MOST`` bytes; equal content is cut alike wherever it stands, so copies share
chunks. Chunks are known by SHA-256.

``store`` writes each document's ordered list and, by distinct media, the chunks that it owns; a join on digests finds which chunks
several media share, and the least of these owns each. Bytes move once, compressed, to bring copies of a media together; digests and
shared chunks are all that is joined. ``restore`` fetches borrowed chunks by digest, rebuilds each container in order, and verifies the
digests of chunks and whole before decoding.

The query stores all media in the shared folder and rebuilds each from there; lengths, digests and features come from what is
read back. In joins, a key of more than ``common.HOT`` rows is dealt out by a salt, with a copy of its one row for each share, and copies
of a media leave a task once, so no chunk or copied media makes a large task.

Cases: null and empty texts give one frame of 576 bytes 255; equal texts give equal values; repeated rows share all chunks; a null
doc_id stores and restores like any other id; texts of any length are processed one at a time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, matched, shared_dir, small, staged, table

FRAME = 576
RATE = 8000
LEAST, MOST = 512, 8192
#: A cut where these 11 high bits of the 32-bit hash are zero: 2048 bytes after the least, on average.
MASK = np.uint32(0xFFE00000)
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)
#: Bytes that are hashed at a time.
RUN = 1 << 20


def payload_of(data: bytes) -> tuple[int, bytes]:
    """(its own length, data filled up)"""
    return len(data), data + b"\xff" * ((-len(data)) % FRAME if data else FRAME)


def to_wav(payload: bytes) -> bytes:
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload) & 0xFFFFFFFF)
    return b"RIFF" + struct.pack("<I", (len(head) + len(payload)) & 0xFFFFFFFF) + head + payload


def from_wav(media: bytes) -> np.ndarray:
    """The samples. Walks the container's blocks and checks the format."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave container")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        if name == b"data":
            if form is None or (form[0], form[1], form[5]) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
            if len(media) - at - 8 != size:
                raise ValueError("samples are missing")
            return np.frombuffer(media, dtype=np.uint8, offset=at + 8, count=size)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of GEAR[b] << age over the last 32 bytes, modulo 2^32, by doubling spans."""
    h = GEAR[data]
    for span in (1, 2, 4, 8, 16):
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
    return h


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks, the last at the end."""
    data, marks = np.frombuffer(media, dtype=np.uint8), []
    for at in range(0, len(data), RUN):
        low = max(0, at - 31)
        found = np.flatnonzero((gear(data[low : at + RUN]) & MASK) == 0) + low
        marks.append(found[found >= at])
    ends, start, n = [], 0, len(data)
    for m in np.concatenate(marks).tolist() if marks else []:
        end = m + 1
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """Ordered (digest, bytes)."""
    out, start = [], 0
    for end in cuts(media):
        part = media[start:end]
        out.append((hashlib.sha256(part).digest(), part))
        start = end
    return out


def rebuilt(listed: list[bytes], parts: list[bytes], digest: bytes) -> bytes:
    """The media of an ordered chunk list; every chunk and the whole are verified."""
    for want, part in zip(listed, parts, strict=True):
        if hashlib.sha256(part).digest() != want:
            raise ValueError("a chunk's bytes don't have its digest")
    media = b"".join(parts)
    if hashlib.sha256(media).digest() != digest:
        raise ValueError("the chunks don't make the media")
    return media


def features(samples: np.ndarray) -> str:
    """Mean, deviation, zero crossings about 128 and the loudest of 8 bands of byte values; integers, so equal on every machine."""
    n = len(samples)
    total, square = int(samples.sum(dtype=np.int64)), int(np.square(samples.astype(np.int64)).sum())
    above = samples >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    bands = np.bincount(samples >> 5, minlength=8)
    return f"n={n};mean={total * 1000 // n};power={square // n};cross={crossings};band={int(bands.argmax())}"


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def said_of(media: bytes) -> tuple[int, str, int, int, str, str]:
    """What is told of a stored form: its payload's length, digest and tail, its own length and digest, and features of the samples."""
    samples = from_wav(media)
    read = samples.tobytes()
    return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, media_sha256, m, chunk_list): the ordered chunk list of each document; m is short for its media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, short, listed = [], [], [], []
            for text in b.column(1):
                n, payload = payload_of((text.as_py() or "").encode("utf-8"))
                media = to_wav(payload)
                digest = hashlib.sha256(media).digest()
                sizes.append(n)
                names.append(digest)
                short.append(short_of(digest))
                listed.append([d for d, _ in chunks(media)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(short, pa.int64()), pa.array(listed, pa.list_(pa.binary()))],
                names=["doc_id", "n_bytes", "media_sha256", "m", "chunk_list"],
            )

    kind = dict(docs.dtypes)[id_col]
    return _docs(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media_sha256 binary, m long, chunk_list array<binary>")


def short_of(digest: bytes) -> int:
    """Of a media's digest. Where two media share theirs, both keep the chunks they share: no result changes."""
    return int.from_bytes(digest[:8], "little", signed=True)


class Filter:
    """A bitmap of short media names: a clear bit proves that a media isn't among them. At most 2^30 bits, whatever it is of."""

    def __init__(self, bits: int, buckets: dict[int, bytes]):
        self.bits, self.buckets = bits, buckets

    @staticmethod
    def place(m: Column, bits: int) -> Column:
        return F.pmod(m, F.lit(bits))

    @classmethod
    def of(cls, names: DataFrame) -> Filter:
        """names: (m). Built from partial bitmaps of 32768 bits each."""
        bits = 1 << min(30, max(16, (16 * names.count()).bit_length()))
        at = cls.place(F.col("m"), bits)
        rows = names.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()
        return cls(bits, {r.bucket: bytes(r.bitmap) for r in rows})

    def __contains__(self, m: int) -> bool:
        at = m % self.bits
        # Spark numbers buckets from 1, with place 0 alone in bucket 0's end; positions follow.
        bucket, position = (1 + (at - 1) // 32768, (at - 1) % 32768) if at > 0 else (0, -at % 32768)
        found = self.buckets.get(bucket)
        return found is not None and bool(found[position >> 3] >> (position & 7) & 1)


PACK = pa.schema([("media_sha256", pa.binary()), ("chunk_list", pa.list_(pa.binary())), ("own", pa.list_(pa.binary())), ("bytes", pa.list_(pa.binary())), ("lent", pa.list_(pa.binary())), ("borrowed", pa.list_(pa.binary()))])
PACK_DDL = "media_sha256 binary, chunk_list array<binary>, own array<binary>, bytes array<binary>, lent array<binary>, borrowed array<binary>"


def _pack(media: bytes, digest: bytes, lent: list[bytes], borrowed: list[bytes]) -> tuple:
    parts, elsewhere, lends = chunks(media), set(borrowed), set(lent)
    own = {d: p for d, p in parts if d[:BRIEF] not in elsewhere}
    order = [d for d, _ in parts]
    return digest, order, list(own), list(own.values()), [d for d in own if d[:BRIEF] in lends], sorted({d for d in order if d[:BRIEF] in elsewhere})


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Bytes of a digest by which shared chunks are found.
BRIEF = 16


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the lists (path/lists, a row a document) and the chunks (path/packs, a row a distinct media).

    A pack holds its media's ordered list and those of its chunks that it owns: a chunk of several media is owned by the least of their
    short names. ``lent`` has the owned chunks that others need, ``borrowed`` those that others own, so each distinct chunk is stored
    once. A media of one document that shares no chunk is packed where it is read; only copies and sharers are shuffled.
    """
    spark = docs.sparkSession
    _described(docs, id_col, text_col).write.option("compression", "zstd").parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    refs = lists.select("m", F.explode(F.array_distinct("chunk_list")).alias("digest")).select("m", F.substring("digest", 1, BRIEF).alias("d"))
    shared = small(refs.groupBy("d").agg(F.min("m").alias("owner"), F.max("m").alias("other")).where("owner != other").select("d", "owner"), "shared")
    mine = F.col("owner") == F.col("m")
    links = matched(refs.join(shared.select("d"), "d", "left_semi").distinct(), shared, "d")
    notes = staged(links.groupBy("m").agg(F.collect_list(F.when(mine, F.col("d"))).alias("lent"), F.collect_list(F.when(~mine, F.col("d"))).alias("borrowed")), "notes")
    copied = lists.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    among = spark.sparkContext.broadcast(Filter.of(staged(notes.select("m").unionByName(copied).distinct(), "moved")))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                media = to_wav(payload_of((text.as_py() or "").encode("utf-8"))[1])
                digest = hashlib.sha256(media).digest()
                if short_of(digest) not in among.value:
                    rows.append(_pack(media, digest, [], []))
            yield _rows(rows, PACK)

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies leave a task once
        for b in batches:
            rows = []
            for text in b.column(1):
                data = (text.as_py() or "").encode("utf-8")
                digest = hashlib.sha256(to_wav(payload_of(data)[1])).digest()
                if short_of(digest) in among.value and digest not in seen:
                    seen.add(digest)
                    rows.append((short_of(digest), len(data), pa.compress(data, codec="zstd", asbytes=True)))
            yield _rows(rows, pa.schema([("m", pa.int64()), ("n", pa.int64()), ("z", pa.binary())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a partition's media: several tasks may have sent one
        for b in batches:
            rows = []
            for n, z, lent, borrowed in zip(*(b.column(k) for k in range(4)), strict=True):
                media = to_wav(payload_of(pa.decompress(z.as_py(), n.as_py(), codec="zstd", asbytes=True))[1])
                digest = hashlib.sha256(media).digest()
                if digest not in seen:
                    seen.add(digest)
                    rows.append(_pack(media, digest, lent.as_py() or [], borrowed.as_py() or []))
            yield _rows(rows, PACK)

    own = _docs(docs, id_col, text_col)
    own.mapInArrow(here, PACK_DDL).write.option("compression", "zstd").parquet(f"{path}/packs")
    texts = own.mapInArrow(away, "m long, n long, z binary").repartition("m").join(notes, "m", "left").select("n", "z", "lent", "borrowed")
    texts.mapInArrow(pack, PACK_DDL).write.mode("append").option("compression", "zstd").parquet(f"{path}/packs")


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """(digest, bytes): the stored chunks, each distinct one once."""
    return spark.read.parquet(f"{path}/packs").select(F.explode(F.arrays_zip("own", "bytes")).alias("c")).select(F.col("c.own").alias("digest"), F.col("c.bytes").alias("bytes"))


def _media(spark: SparkSession, path: str) -> DataFrame:
    """(media_sha256, chunk_list, own, bytes, borrowed, lenders' chunks): what rebuilds each distinct media.

    Media that own all their chunks need no join. The others fetch what they borrow, by digest, from the packs that lend it.
    """
    bounded_batches(spark, 64)
    packs = spark.read.parquet(f"{path}/packs")
    kind = "array<struct<digest:binary,bytes:binary>>"
    whole = packs.where(F.size("borrowed") == 0).select("media_sha256", "chunk_list", "own", "bytes", F.lit(None).cast(kind).alias("found"))
    needs = packs.where(F.size("borrowed") > 0)
    wanted = needs.select("media_sha256", F.explode("borrowed").alias("digest"))
    lending = F.filter(F.arrays_zip("own", "bytes"), lambda c: F.array_contains("lent", c["own"]))
    lent = packs.where(F.size("lent") > 0).select(F.explode(lending).alias("c")).select(F.col("c.own").alias("digest"), F.col("c.bytes").alias("bytes"))
    found = matched(wanted, lent, "digest").groupBy("media_sha256").agg(F.collect_list(F.struct("digest", "bytes")).alias("found"))
    return whole.unionByName(needs.join(found, "media_sha256", "left").select(*whole.columns))


def _read_back(b: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(stored_sha256, verified container, chunks, own bytes) of each row; a chunk that isn't stored is found as damage."""
    for sha, listed, own, parts, found in zip(*(b.column(k) for k in range(5)), strict=True):
        known = dict(zip(own.as_py(), parts.as_py(), strict=True))
        held = sum(map(len, known.values()))
        known |= {r["digest"]: r["bytes"] or b"" for r in found.as_py() or ()}
        order = listed.as_py()
        yield sha.as_py(), rebuilt(order, [known.get(d, b"") for d in order], sha.as_py()), len(order), held


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, media_sha256, payload): each media rebuilt from its ordered list by a join on digests, verified and decoded."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(sha, from_wav(media).tobytes()) for sha, media, _, _ in _read_back(b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["media_sha256", "payload"])

    payloads = _media(spark, path).mapInArrow(build, "media_sha256 binary, payload binary")
    return matched(spark.read.parquet(f"{path}/lists").select("doc_id", "media_sha256"), payloads, "media_sha256").select("doc_id", "media_sha256", "payload")


READ = pa.schema([("stored_sha256", pa.binary()), *((n, t) for n, t in zip(NAMES[1:], TYPES[1:], strict=True)), ("chunks", pa.int64()), ("own_bytes", pa.int64())])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(stored_sha256, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, chunks, own_bytes) of each distinct media as it is read back."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(sha, *said_of(media), n, held) for sha, media, n, held in _read_back(b)]
            yield _rows(rows, READ)

    return _media(spark, path).mapInArrow(build, "stored_sha256 binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, chunks long, own_bytes long")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(table(spark, sf_dir, "documents"), path)
    lists = spark.read.parquet(f"{path}/lists").select("doc_id", "n_bytes", F.col("media_sha256").alias("stored_sha256"))
    return matched(lists, staged(read_features(spark, path), "read"), "stored_sha256").select("doc_id", *NAMES, "chunks", "own_bytes")
