from __future__ import annotations

import hashlib
import io
import random
import wave
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import media as M

from .conftest import frame


def want_of(t):
    """The contract's columns, by themselves."""
    data = (t or "").encode()
    payload = data
    while not payload or len(payload) % 576:
        payload += b"\xff"
    wav = M.to_wav(payload)
    with wave.open(io.BytesIO(wav)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest()


def test_gear_equals_its_definition_and_chunks_make_the_media():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(60_000))
    h, got = 0, M.gear(__import__("numpy").frombuffer(data, dtype="uint8"))
    for k, b in enumerate(data):
        h = (h * 2 + int(M.GEAR[b])) & 0xFFFFFFFF
        assert k < 32 or int(got[k]) == h
    parts = M.chunks(data)
    assert b"".join(p for _, p in parts) == data
    assert all(M.LEAST <= len(p) <= M.MOST for _, p in parts[:-1])
    # An insertion moves few cuts.
    other = M.chunks(data[:30_000] + b"new" + data[30_000:])
    assert len({d for d, _ in parts} & {d for d, _ in other}) >= len(parts) - 4


def test_pieces_do_not_move_cuts(monkeypatch):
    data = random.Random(1).randbytes(40_000)
    whole = M.cuts(data)
    monkeypatch.setattr(M, "RUN", 777)
    assert M.cuts(data) == whole


def test_damage_is_found():
    parts = M.chunks(M.to_wav(b"a" * 5760))
    good = hashlib.sha256(b"".join(p for _, p in parts)).digest()
    with pytest.raises(ValueError):
        M.rebuilt([d for d, _ in parts], [parts[0][1][:-1] + b"?", *(p for _, p in parts[1:])], good)
    with pytest.raises(ValueError):
        M.from_wav(M.to_wav(b"a" * 576)[:-1])


def near_copies():
    """Media that share chunks: long texts that differ in one word."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(4000)]
    return [(1000 + k, " ".join([*base[: 500 * k], f"changed{k}", *base[500 * k :]]), "en", "a") for k in range(6)]


def test_store_and_restore(spark, odd, odd_rows, tmp_path):
    rows = [*odd_rows, *near_copies()]
    M.store(odd.unionByName(frame(spark, near_copies())), f"file://{tmp_path}/media")
    back = M.restore(spark, f"file://{tmp_path}/media").collect()
    want = sorted(M.payload_of((t or "").encode())[1] for _, t, _, _ in rows)
    assert sorted(bytes(r.payload) for r in back) == want
    stored = M.chunk_table(spark, f"file://{tmp_path}/media").collect()
    every = {d: p for _, t, _, _ in rows for d, p in M.chunks(M.to_wav(M.payload_of((t or "").encode())[1]))}
    assert len(stored) == len(every) and {bytes(r.digest): bytes(r.bytes) for r in stored} == every
    packs = spark.read.parquet(f"file://{tmp_path}/media/packs")
    assert packs.where("size(borrowed) > 0").count() >= 5


def test_query_reads_what_is_stored(spark, odd, odd_rows, tmp_path, monkeypatch):
    """With hot chunks dealt out; and bytes that are damaged in the store don't pass."""
    monkeypatch.setattr(common, "HOT", 2)
    odd.unionByName(frame(spark, near_copies())).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = M.op9_media(spark, f"file://{tmp_path}").collect()
    key = lambda row: tuple((v is not None, v) for v in row)
    want = [(i, *want_of(t)) for i, t, _, _ in [*odd_rows, *near_copies()]]
    assert sorted(map(key, ((r.doc_id, *(r[n] for n in M.NAMES[:6])) for r in got))) == sorted(map(key, want))
    whole = M.store

    def damaged(docs, path, *a):
        whole(docs, f"{path}-whole", *a)
        spark.read.parquet(f"{path}-whole/lists").write.parquet(f"{path}/lists")
        spark.read.parquet(f"{path}-whole/packs").withColumn("bytes", F.transform("bytes", lambda x: F.concat(x, F.lit(b"\0")))).write.parquet(f"{path}/packs")

    monkeypatch.setattr(M, "store", damaged)
    with pytest.raises(Exception, match="digest"):
        M.op9_media(spark, f"file://{tmp_path}").collect()


def test_empty_table(spark, empty, tmp_path):
    M.store(empty, f"file://{tmp_path}/media")
    assert M.restore(spark, f"file://{tmp_path}/media").collect() == []


def test_filter_has_what_it_is_of(spark):
    r = random.Random(3)
    names = [0, 1, -1, 32768, 32769, 65536, *(r.randrange(-(1 << 63), 1 << 63) for _ in range(500))]
    f = M.Filter.of(spark.createDataFrame([(n,) for n in names], "m long"))
    assert all(n in f for n in names)
    assert sum(r.randrange(-(1 << 63), 1 << 63) in f for _ in range(2000)) < 300
