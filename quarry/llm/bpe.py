"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges define, for each prefix of a piece, exactly one last token: the token t that is a suffix of the prefix, follows
validly on the last token before it, and is itself what the merges make of its bytes. Two tokens follow validly if the merges
make just these two of their joined bytes. So encoding is a finite-state transduction over bytes. Its non-deterministic states
are (bytes of the token under way, last token before it); the deterministic states are sets of them with the tokens that each
still owes, built only when an input reaches them and kept. What all members of a set owe in common is emitted at once, so a
token leaves after a lookahead that no token's length exceeds. This holds for vocabularies that merges made, in which a token's
halves have lower ranks than the token; one that lacks a byte is refused.

A piece that is itself in the vocabulary is that one token, as in the public library. Decoding joins tokens' bytes and feeds an
incremental UTF-8 machine that carries the bytes of an unfinished character from one chunk to the next.

Cases: a null text is empty; the empty text has no tokens; texts of any length are cut into pieces one at a time; unpaired
surrogates can't occur in Spark strings; further columns are kept by ``encode`` unless their names clash with its own (then
the operator's own win).
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Deterministic states and words kept at most; beyond, the store is emptied and grows anew.
MAX_STATES = 300_000
MAX_PAIRS = 500_000
MAX_WORDS = 300_000
#: A longer piece isn't kept in the store of words.
MAX_WORD_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Characters that \\s means to the public library: Unicode's white space.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces that are held at a time; texts of up to as many characters are cut in one go.
RUN = 1 << 20


def _runs_of(prop: str) -> str:
    """One or more characters of a Unicode class for the standard library's matcher, which is fast on sets of the basic plane only; the others stand apart behind a look at the plane."""
    of = regex.compile(rf"{prop}+")
    spans = lambda codes: "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in of.finditer("".join(map(chr, codes))))
    low = spans(range(0xD800)) + spans(range(0xE000, 0x10000))
    return rf"(?:[{low}]+|(?=[\U00010000-\U0010ffff])[{spans(range(0x10000, 0x110000))}]+)+"


def compiled(pattern: str) -> re.Pattern:
    r"""pattern with the classes that the public vocabularies use spelled out; one with others stays with the larger library."""
    spelled = pattern
    for name in (r"[^\s\p{L}\p{N}]+", r"\p{L}+", r"\p{N}+"):
        if name in spelled:
            spelled = spelled.replace(name, _runs_of(name[:-1].replace(r"\s", SPACE)))
    if re.search(r"\\[pPXwWdDbB]|\(\?[<>]", spelled):
        return regex.compile(pattern)
    return re.compile(re.sub(r"\\([sS])", lambda m: f"[{'^' * (m[1] == 'S')}{SPACE}]", spelled))


#: The bits of an arc that number its state.
STATE = (1 << 32) - 1


def _packed(members: Iterable[tuple[int, int, tuple[int, ...]]]) -> bytes:
    """Members as 32-bit numbers: node, last token, number of tokens owed, and these."""
    return array("i", [x for node, last, owed in members for x in (node, last, len(owed), *owed)]).tobytes()


def _members(state: bytes) -> list[tuple[int, int, tuple[int, ...]]]:
    flat, out, at = memoryview(state).cast("i").tolist(), [], 0
    while at < len(flat):
        end = at + 3 + flat[at + 2]
        out.append((flat[at], flat[at + 1], tuple(flat[at + 3 : end])))
        at = end
    return out


class Bpe:
    """ranks: token bytes -> id, which is also the merge's rank. pattern: pieces are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, compiled(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.name = {i: str(i) for i in self.token}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for data, rank in ranks.items():
            node = 0
            for b in data:
                if (nxt := self.trie[node].get(b)) is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Whether two tokens follow validly, by first << 32 | second.
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state, packed: members (trie node, last token before or -1, tokens owed); the first stands at a token's end.
        self.states: list[bytes] = [_packed([(0, -1, ())])]
        self.number: dict[bytes, int] = {self.states[0]: 0}
        #: state * 256 + byte -> state, and from bit 32 the number of the tokens emitted; no arc leads to state 0
        self.arcs: dict[int, int] = {}
        self.rows: list[tuple[int, ...]] = [()]
        self.row_number: dict[tuple[int, ...], int] = {(): 0}

    def _row(self, tokens: tuple[int, ...]) -> int:
        """The number of a row of tokens; equal ones are kept once."""
        if (out := self.row_number.get(tokens)) is None:
            out = self.row_number[tokens] = len(self.rows)
            self.rows.append(tokens)
        return out

    def merged(self, data: bytes) -> list[int]:
        """The merges applied by rank; for joins of two tokens and as the definition that the transducer is held against."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def halve(self, t: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes t; (t, t) for a byte, None if the merges never make t of its bytes."""
        if t not in self.halves:
            data = self.token[t]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= t:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[t] = (t, t) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[t]

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges make just a and b of their joined bytes: no merge across the border may come before the merges that build the two there."""
        key = a << 32 | b
        if (out := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            out = self.pairs[key] = self._follows(a, b)
        return out

    def _follows(self, a: int, b: int) -> bool:
        ranks, token, limit = self.ranks, self.token, 1 << 60
        while True:
            if ranks.get(token[a] + token[b], 1 << 60) < limit:
                return False
            # Undo the younger of the two merges at the border; what crosses it must be younger still.
            undo_left = len(token[a]) > 1 and (len(token[b]) == 1 or a > b)
            if undo_left:
                limit, a = a, self.halve(a)[1]
            elif len(token[b]) > 1:
                limit, b = b + 1, self.halve(b)[0]
            else:
                return True

    def _arc(self, state: int, byte: int) -> int:
        """Determinise one arc: advance all members, find the one token that ends here, emit what all owe in common."""
        trie, ends, pairs = self.trie, self.ends, self.pairs
        members: list = [None]
        for m in _members(self.states[state]):
            nxt = trie[m[0]].get(byte)
            if nxt is None:
                continue
            if members[0] is None and (t := ends[nxt]) >= 0 and self.halve(t):
                ok = True if (last := m[1]) < 0 else pairs.get(last << 32 | t)
                if self.follows(last, t) if ok is None else ok:
                    members[0] = (0, t, (*m[2], t))
            if trie[nxt]:
                members.append((nxt, m[1], m[2]))
        if members[0] is None:
            raise ValueError("the vocabulary lacks a byte")
        common = members[0][2]
        for m in members:
            while m[2][: len(common)] != common:
                common = common[:-1]
        if k := len(common):
            members = [(n, last, owed[k:]) for n, last, owed in members]
        key = _packed(members)
        if len(self.states) > MAX_STATES:  # also within one very long piece
            self._reset()
            state = -1
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        out = to | self._row(common) << 32
        if state >= 0:
            self.arcs[state << 8 | byte] = out
        return out

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece, each as soon as no later byte can change it."""
        state = 0
        for byte in data:
            state = self.arcs.get(state << 8 | byte) or self._arc(state, byte)
            if state > STATE:
                yield from self.rows[state >> 32]
                state &= STATE
        yield from self.rows[self._row(_members(self.states[state])[0][2])]

    def piece(self, text: str) -> tuple[int, ...]:
        if (out := self.words.get(text)) is None:
            data = text.encode("utf-8")
            whole = self.ranks.get(data)
            out = (whole,) if whole is not None else tuple(self.stream(data))
            if len(data) <= MAX_WORD_BYTES:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[text] = out
        return out

    def runs(self, text: str) -> Iterator[list[tuple[int, ...]]]:
        """The tokens of each piece, at most RUN pieces at a time."""
        if len(text) <= RUN:
            pieces = self.split.findall(text)
            found = list(map(self.words.get, pieces))
            if None in found:
                found = [f or self.piece(w) for f, w in zip(found, pieces, strict=True)]
            yield found
            return
        at = self.split.finditer(text)
        while found := [self.words.get(m[0]) or self.piece(m[0]) for m in islice(at, RUN)]:
            yield found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(chain.from_iterable(self.runs(text))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Utf8Stream:
    """Tokens in by chunks, text out by whole characters; bytes that end in mid-character wait for the next chunk."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.machine = token, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.token.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """One encoder a worker process. The path is on every machine, or was added with SparkContext.addFile."""
    if (path, pattern) not in _LOADED:
        try:
            ranks = load_ranks(path)
        except FileNotFoundError:
            ranks = load_ranks(SparkFiles.get(path.rsplit("/", 1)[-1]))
        _LOADED[path, pattern] = Bpe(ranks, pattern)
    return _LOADED[path, pattern]


DECODE_CHUNK = 4096


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars): ids by the transducer, then decoded by the streaming machine."""
    schema = pa.schema([("doc_id", docs_type(docs, id_col)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_chars_decoded", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                listed, said, count, chars, out = hashlib.sha256(), hashlib.sha256(), 0, 0, Utf8Stream(bpe.token)
                for run_of in bpe.runs(text.as_py() or ""):
                    ids = list(chain.from_iterable(run_of))
                    if ids:
                        listed.update(((" " if count else "") + " ".join(map(bpe.name.__getitem__, ids))).encode())
                        count += len(ids)
                    got = out.feed(ids)
                    chars += len(got)
                    said.update(got.encode("utf-8"))
                got = out.finish()
                said.update(got.encode("utf-8"))
                rows.append((count, listed.hexdigest(), said.hexdigest(), chars + len(got)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long")


def docs_type(docs: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[id_col].dataType)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids", verified: bool = False) -> DataFrame:
    """docs with ids, an array of ints, after its other columns.

    Verified, two more follow: ``<out_col>_sha256``, the digest of what the streaming machine decodes from the ids, and ``<out_col>_same``,
    whether that is the text. Both are made where the ids are, so a worker holds one vocabulary.
    """
    more = [f"{out_col}_sha256", f"{out_col}_same"] if verified else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.schema.names.index(text_col))]
            ids = [bpe.encode(t) for t in texts]
            keep = [k for k, n in enumerate(batch.schema.names) if n != out_col]
            columns = [*(batch.column(k) for k in keep), pa.array(ids, type=pa.list_(pa.int32()))]
            if verified:
                said = [_decoded(bpe, i) for i in ids]
                columns += [pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for d in said], pa.string()), pa.array([d == t for d, t in zip(said, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[k] for k in keep), out_col, *more])

    bounded_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != out_col]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{ddl}, `{out_col}` array<int>" + (f", `{more[0]}` string, `{more[1]}` boolean" if verified else ""))


def _decoded(bpe: Bpe, ids: list[int]) -> str:
    """The text of ids, a chunk of them at a time."""
    out = Utf8Stream(bpe.token)
    return "".join([*(out.feed(ids[k : k + DECODE_CHUNK]) for k in range(0, len(ids), DECODE_CHUNK)), out.finish()])


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """tokens with the text of its ids; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = [_decoded(bpe, ids.as_py() or []) for ids in batch.column(batch.schema.names.index(ids_col))]
            keep = [k for k, n in enumerate(batch.schema.names) if n != out_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, type=pa.string())], names=[*(batch.schema.names[k] for k in keep), out_col])

    bounded_batches(tokens.sparkSession)
    fields = [f for f in tokens.schema.fields if f.name != out_col]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return tokens.mapInArrow(run, f"{ddl}, `{out_col}` string")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary()).drop("n_chars_decoded")
