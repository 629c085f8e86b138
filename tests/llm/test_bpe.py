from __future__ import annotations

import base64
import hashlib
import random
import tracemalloc

import pytest

from quarry.llm import bpe as B

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = B.public_vocabulary()


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(8)
    out = ["", " ", "a", "Hello, world! it's 2024\n\n  x", "🙂🙃 日本語テキスト ÀÉ  z", "<|endoftext|>", "don't DON'T we'll\r\n\t\tend   ", "\x1c\x1d\u0085a", "a" * 3000, "ab" * 700, "ⅷ²½ ٣٤"]
    for _ in range(400):
        out.append("".join(chr(r.choice([r.randint(32, 126), r.randint(32, 126), r.randint(160, 0x24F), r.randint(0x400, 0x4FF), r.randint(0x3040, 0x30FF), r.randint(0x1F300, 0x1F64F), 10, 32, 32])) for _ in range(r.randint(1, 80))))
    for _ in range(60):
        out.append("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(20, 200))))
    return out


def test_equals_the_public_library(public):
    bpe = B.loaded(PATH, PATTERN)
    for t in texts():
        ids = bpe.encode(t)
        assert ids == public.encode_ordinary(t)
        assert bpe.decode_bytes(ids) == t.encode()


def test_transducer_equals_the_merges_on_short_vocabularies():
    """The first ranks of a vocabulary are one as well; the shorter it is, the longer are the rows of merges."""
    r = random.Random(4)
    whole = B.load_ranks(PATH)
    for n in (257, 300, 400, 800, 2500):
        bpe = B.Bpe({t: k for t, k in whole.items() if k < n}, PATTERN)
        for _ in range(150):
            data = "".join(r.choice(" etaoinshrdlu") for _ in range(r.randint(1, 40))).encode()
            assert list(bpe.stream(data)) == bpe.merged(data)


def test_stream_emits_before_the_end():
    bpe = B.loaded(PATH, PATTERN)
    seen, data = [], b"abcdefgh" * 400

    def fed():
        for k, b in enumerate(data):
            seen.append(k)
            yield b

    first = next(bpe.stream(fed()))
    assert bpe.token[first] and len(seen) < 300


def test_streaming_decode_carries_bytes():
    bpe = B.loaded(PATH, PATTERN)
    text = "🙂 naïve 日本 " * 20
    out = B.Utf8Stream(bpe.token)
    assert "".join(out.feed([i]) for i in bpe.encode(text)) + out.finish() == text


def test_round_trip_and_digests(spark, odd, odd_rows, public):
    rows = B.digests(odd, PATH, PATTERN).collect()
    want = sorted((-1 if i is None else i, len(ids := public.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in odd_rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    coded = B.encode(odd, PATH, PATTERN)
    assert coded.columns == [*odd.columns, "ids"]
    back = B.decode(coded.drop("text"), PATH, PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _, _ in odd_rows)


def test_clashing_name_and_empty_table(spark, odd, empty):
    out = B.encode(odd.withColumnRenamed("label", "ids"), PATH, PATTERN)
    assert dict(out.dtypes)["ids"] == "array<int>"
    assert B.encode(empty, PATH, PATTERN).collect() == []
    assert B.digests(empty, PATH, PATTERN).collect() == []


def test_states_are_let_go_within_one_piece(monkeypatch):
    """A piece longer than the store of states is encoded alike."""
    path, pattern = B.public_vocabulary()
    ranks = B.load_ranks(path)
    r = random.Random(5)
    piece = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    want = list(B.Bpe(ranks, pattern).piece(piece))
    monkeypatch.setattr(B, "MAX_STATES", 40)
    small = B.Bpe(ranks, pattern)
    assert list(small.piece(piece)) == want and len(small.states) <= 42


def test_verified_ids_carry_their_round_trip(spark):
    rows = [(1, "Some words, é and 🙂", 5), (2, None, 5), (3, "", 5), (4, "x" * 9000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_other int")
    out = B.encode(df, *B.public_vocabulary(), verified=True)
    for r, (_, t, _) in zip(sorted(out.collect(), key=lambda r: r.doc_id), rows, strict=True):
        assert r.ids_same and r.ids_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: r.text for r in B.decode(out.select("doc_id", "ids"), *B.public_vocabulary()).collect()} == {i: t or "" for i, t, _ in rows}


def test_states_and_arcs_are_packed():
    """What a worker keeps of the machine: numbers, not tuples of tuples."""
    bpe = B.Bpe(B.load_ranks(PATH), PATTERN)
    r = random.Random(6)
    tracemalloc.start()
    for _ in range(1500):
        list(bpe.stream("".join(r.choice("etaoinshrdlu") for _ in range(40)).encode()))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(bpe.states) > 3000 and held / len(bpe.states) < 600
