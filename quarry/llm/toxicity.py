"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel counts common subsequences of three characters, each occurrence weighted by DECAY to the power of its span, up to ``SPAN``
characters, and is normalised; so a word with a letter left out, put in or set apart is still near the insult. Its landmarks are words
of labelled sentences: those most tied to toxic ones, and common words of the others. Nyström features against the landmarks
make the machine linear, and its weights fold back into one number a subsequence, so that a unit is scored exactly by the sum over
its own subsequences, without a look at the landmarks.

Units are the words of a text, letters only (and once more with digits and signs that stand for letters read as these), runs of single
letters put together (``i d i o t``), and windows across blanks: ``PARTS`` words at most, together of ``JOINED`` letters at most, read as one
word, if that is surer than each of them (``idi ot``). Windows are many, so one counts only if it is surer than what clean training
texts show (the second largest of their best ones).

Training is by multiple instances: a text is toxic if one of its units is. In rounds, the best units of each toxic text are the
positives; the negatives are all words of all clean training texts. A logistic curve on a text's four best units, the number of units
beyond the margin and the number of all units gives its score.

The machine is fitted on at most ``SAMPLE`` labelled documents of each class, the first by a digest of doc_id; only their texts reach the
one task that fits it, and only the machine's numbers the driver. Everything else covers all rows.

Cases: null, empty and unit-less texts have the score of a text in which nothing is found; a null label or doc_id never trains; several labels of a
document each train; with no toxic or no clean label every score is the share of toxic labels (0 without labels); an empty
table gives no rows. The labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, table

DECAY = 0.6
SPAN = 6
LANDMARKS = 224
SAMPLE = 3000
ROUNDS = 4
THRESHOLD = 0.7
#: Distinct tokens whose decision is kept at most; texts are read in slices of so many characters.
MAX_TOKENS = 300_000
SLICE = 1 << 20
TOKEN = re.compile(WORD)
NO_LETTER = re.compile(r"[\W\d_]+")
LONGEST = 40
#: Windows across blanks: words and letters at most, letters at least.
PARTS, JOINED, LEAST = 4, 14, 5
#: Letters that are looked at together for these.
RUN = 1 << 20
#: What digits and signs before a letter stand for. Fixed values.
STANDS = str.maketrans("0134578@$!", "oieastbasi")
STANDING = re.compile(r"[0134578@$!]+(?=[^\W\d_])")


def letters(token: str) -> str:
    return NO_LETTER.sub("", token)


def readings(token: str) -> list[str]:
    """The words that a token may be: its letters, and those with digits and signs before letters read as such."""
    if token.isalpha():
        return [token]
    out = [letters(token)]
    if STANDING.search(token):
        out.append(letters(STANDING.sub(lambda m: m[0].translate(STANDS), token)))
    return out


def slices(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        upto = at + SLICE
        if upto < len(text):
            stop = re.compile(r"[\x20\x09-\x0D]").search(text, upto)
            upto = stop.end() if stop else len(text)
        yield text[at:upto]
        at = upto


def units(text: str | None) -> set[str]:
    """Distinct tokens in lower case, and runs of at least three single letters joined."""
    out: set[str] = set()
    for part in slices(text or ""):
        tokens = TOKEN.findall(part.lower())
        found = set(tokens)
        out |= found
        if sum(len(t) == 1 for t in found) < 2 and not any(len(t) <= 2 for t in found):
            continue
        run: list[str] = []
        for t in [*tokens, "  "]:
            own = letters(t) if len(t) <= 2 else ""
            if len(own) == 1:
                run.append(own)
            else:
                if len(run) >= 3:
                    out.add("".join(run))
                run = []
    return out


POWER = [DECAY**k for k in range(SPAN + 2)]
#: Places of the second and third character after the first.
STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def size_of(n: int) -> float:
    """The length of the feature map of n characters, were its subsequences all different; a function of n alone keeps the kernel positive."""
    return math.sqrt(sum(max(0, n - k) * POWER[k + 1] ** 2 for _, k in STEPS)) or 1.0


def subsequences(word: str) -> dict[str, float]:
    """The feature map of one word, ends marked: each subsequence of three characters with its weight."""
    s, out = f"^{word}$", defaultdict(float)
    norm = size_of(len(s))
    for j, k in STEPS:
        for i in range(len(s) - k):
            out[s[i] + s[i + j] + s[i + k]] += POWER[k + 1] / norm
    return out


class Triples:
    """Numbers by three characters, looked up for whole arrays of them; all characters count, whatever their number."""

    def __init__(self, numbers: dict[str, float], missing: float = 0.0):
        chars = sorted({c for k in numbers for c in k})
        self.codes = np.zeros(0x110000, dtype=np.int32)
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.bits = max(7, len(chars).bit_length())
        points = self.codes[np.array([[ord(c) for c in k] for k in numbers], dtype=np.int64).reshape(-1, 3)].astype(np.int64)
        keys = points[:, 0] << 2 * self.bits | points[:, 1] << self.bits | points[:, 2]
        values = np.fromiter(numbers.values(), dtype=float, count=len(numbers))
        self.cube = None
        if self.bits == 7:
            self.cube = np.full(1 << 21, missing)
            self.cube[keys] = values
        else:
            by = np.argsort(keys)
            self.keys, self.values = np.concatenate([[-1], keys[by]]), np.concatenate([[missing], values[by]])
            self.slots = np.zeros(1 << 22, dtype=np.int32)
            self.slots[self._slot(self.keys[1:])] = np.arange(1, len(self.keys))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def points(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def of(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.cube is not None:
            return self.cube[a << 14 | b << 7 | c]
        key = a.astype(np.int64) << 2 * self.bits | b.astype(np.int64) << self.bits | c
        at = self.slots[self._slot(key)]
        other = (at > 0) & (self.keys[at] != key)
        if other.any():  # two keys in one slot: the sorted list decides
            found = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
            at[other] = np.where(self.keys[found] == key[other], found, 0)
        return self.values[at]


@dataclass
class Model:
    """weights: a number a subsequence. curve: intercept and slopes of what summary() gives. join: what a window across blanks must exceed."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -1.0
    curve: tuple[float, ...] = (0.0,)
    join: float = math.inf
    known: dict[str, float] = field(default_factory=dict, repr=False)
    #: The weights by three characters; built at first use.
    triples: Triples | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "triples": None}

    def table(self) -> Triples:
        if self.triples is None:
            self.triples = Triples(self.weights)
        return self.triples

    def _words(self, words: list[str]) -> np.ndarray:
        """Decisions of words of one length."""
        n, t = len(words[0]) + 2, self.table()
        c = t.codes[np.array([f"^{w}$" for w in words], dtype=f"U{n}").view(np.uint32).reshape(len(words), n)]
        total = np.zeros(len(words))
        for j, k in STEPS:
            if n > k:
                total += t.of(c[:, : n - k], c[:, j : n - k + j], c[:, k:]).sum(axis=1) * POWER[k + 1]
        return total / size_of(n) + self.bias

    def decide(self, tokens: Iterable[str]) -> None:
        """Put the decisions of tokens into known: each the machine's signed distance, by lengths."""
        by_size: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for t in tokens:
            self.known[t] = self.bias if t.isalpha() else LOWEST
            for w in readings(t):
                if not w:
                    self.known[t] = max(self.known[t], self.bias)
                elif len(w) <= LONGEST:
                    by_size[len(w)].append((t, w))
                else:  # no word, perhaps several without space: its best part, by overlapping windows of the whole
                    parts = [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
                    whole = [x for x in parts if len(x) == LONGEST]
                    last = [x for x in parts if 3 <= len(x) < LONGEST]
                    self.known[t] = max(self.known[t], float(max([*self._words(whole), *(self._words([x])[0] for x in last)])))
        for own in by_size.values():
            for (t, w), d in zip(own, self._words([w for _, w in own]).tolist(), strict=True):
                self.known[t] = d if w == t else max(self.known[t], d)

    def windows(self, docs: list[list[str]]) -> list[float]:
        """For each list of tokens, the best decision of a window across blanks that is surer than each of its parts; LOWEST if there is none."""
        best, t = np.full(len(docs), LOWEST), self.table()
        tokens = [x for d in docs for x in d]
        if not tokens:
            return best.tolist()
        words = [x if x.isalpha() else letters(x) for x in tokens]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        own = np.fromiter(map(self.known.__getitem__, tokens), dtype=float, count=len(tokens))
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        starts = np.concatenate([[0], ends[:-1]])
        c = np.concatenate([t.points("".join(words)), np.zeros(SPAN, dtype=np.int32)])
        n = len(c) - SPAN
        # Sums over the first place of subsequences that span k + 1 characters, up to each place.
        upto = {}
        for k in range(2, SPAN):
            row = sum(t.of(c[:n], c[j : n + j], c[k : n + k]) for j in range(1, k)) * POWER[k + 1]
            upto[k] = np.concatenate([[0.0], np.cumsum(row)])
        first, last = (np.full(1, x, dtype=np.int32) for x in t.points("^$"))
        for m in range(2, PARTS + 1):
            i = np.arange(len(tokens) - m + 1)
            size = ends[i + m - 1] - starts[i]
            i = i[(size >= LEAST) & (size <= JOINED) & (owner[i] == owner[i + m - 1])]
            if not len(i):
                continue
            s, e = starts[i], ends[i + m - 1]
            total = np.zeros(len(i))
            for k in range(2, SPAN):
                total += np.where(e - k > s, upto[k][np.maximum(e - k, s)] - upto[k][s], 0.0)
                for j in range(1, k):
                    total += (t.of(first, c[s + j - 1], c[s + k - 1]) + t.of(c[e - k], c[e - k + j], last)) * POWER[k + 1]
            sizes = np.array([size_of(x + 2) for x in range(JOINED + 1)])
            total = total / sizes[e - s] + self.bias
            surer = total > np.max([own[i + k] for k in range(m)], axis=0) + 1e-6
            np.maximum.at(best, owner[i[surer]], total[surer])
        return best.tolist()

    def summary(self, found: Iterable[str], window: float = -math.inf) -> tuple[float, ...]:
        """The four best decisions, the log of 1 + the units beyond the margin, the log of all units (8 at least); equal units count once."""
        d = list(map(self.known.__getitem__, found))
        n = len(d)
        if window > self.join:
            d.append(window)
        best = [max(x, LOW) for x in heapq.nlargest(4, d)]
        return *best, *[LOW] * (4 - len(best)), math.log1p(sum(x > 0 for x in d)), math.log(max(8, n))

    def summaries(self, texts: list[str | None]) -> list[tuple[float, ...]]:
        """Of several texts; their new units are decided together, and their windows, RUN letters at a time."""
        found = [units(t) for t in texts]
        if len(self.known) > MAX_TOKENS:
            self.known.clear()
        if new := set().union(*found).difference(self.known):
            self.decide(new)
        window = [LOWEST] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            for (k, _), v in zip(held, self.windows([x for _, x in held]), strict=True):
                window[k] = max(window[k], v)
            held.clear()

        for k, text in enumerate(texts):
            before: list[str] = []  # windows reach across slices
            for part in slices(text or ""):
                tokens = before + TOKEN.findall(part.lower())
                before = tokens[1 - PARTS :]
                held.append((k, tokens))
                size += len(part)
                if size > RUN:
                    flush()
                    size = 0
        flush()
        return [self.summary(f, w) for f, w in zip(found, window, strict=True)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        out = []
        for said in self.summaries(list(texts)):
            z = self.curve[0] + sum(k * x for k, x in zip(self.curve[1:], said, strict=False))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


#: Below any decision.
LOWEST = -1e9
#: Decisions below count alike.
LOW = -0.5


def _newton(x: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, w: np.ndarray) -> np.ndarray:
    """Squared hinge loss over the own rows of x by Newton steps on the active ones, BLOCK rows at a time, from w; the last entry of w is the intercept's."""
    reg = np.eye(x.shape[1] + 1) * ridge
    reg[-1, -1] = 1e-6
    for _ in range(25):
        square, right = reg.copy(), np.zeros(len(reg))
        for at in range(0, len(own), BLOCK):
            xs, ys, ws = x[own[at : at + BLOCK]], y[at : at + BLOCK], weight[at : at + BLOCK]
            active = ys * (xs @ w[:-1].astype(xs.dtype) + w[-1]) < 1
            xa = np.column_stack([xs[active], np.ones(int(active.sum()), dtype=xs.dtype)])
            scaled = xa * ws[active, None].astype(xs.dtype)
            square += scaled.T @ xa
            right += scaled.T @ ys[active].astype(xs.dtype)
        new = np.linalg.solve(square, right)
        if np.abs(new - w).max() < 1e-3 * np.abs(new).max():
            return new
        w = new
    return w


#: Rows that training works on together.
BLOCK = 1 << 14


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
        w = w + np.linalg.solve(h, x.T @ (y - p) - np.array([0, *w[1:] * 1e-2]))
    return w


def _nystrom(words: list[str], places: Triples, folded: np.ndarray) -> np.ndarray:
    """Features of words: each subsequence's row of folded by its weight. places: numbers of rows, the last row being zero."""
    out = np.zeros((len(words), folded.shape[1]), dtype=np.float32)
    by_size: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        by_size[len(w)].append(k)
    for size, own in by_size.items():
        n = size + 2
        for at in range(0, len(own), BLOCK):
            pick = own[at : at + BLOCK]
            c = places.codes[np.array([f"^{words[k]}$" for k in pick], dtype=f"U{n}").view(np.uint32).reshape(len(pick), n)]
            rows = np.zeros((len(pick), folded.shape[1]), dtype=np.float32)
            for j, k in STEPS:
                for i in range(n - k):
                    rows += folded[places.of(c[:, i], c[:, i + j], c[:, i + k]).astype(np.int64)] * np.float32(POWER[k + 1] / size_of(n))
            out[pick] = rows
    return out


def fit(examples: list[tuple[int, str]]) -> Model:
    """examples: (toxic, text) of each labelled document."""
    n_toxic, n_clean = sum(t for t, _ in examples), sum(1 - t for t, _ in examples)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, len(examples))
        return Model(curve=(math.log((share + 1e-9) / (1 - share + 1e-9)),))
    plain = lambda text: {w for u in units(text) for w in readings(u) if 1 <= len(w) <= LONGEST}
    toxic = [plain(x) for t, x in examples if t]
    df1, df0 = Counter(w for d in toxic for w in d), Counter(w for t, x in examples if not t for w in plain(x))
    tie = lambda w: math.log((df1[w] + 0.05) / (len(toxic) + 0.1)) - math.log((df0[w] + 0.5) / (n_clean + 1))
    #: How sure the tie is: documents beyond what the clean ones' rate explains.
    sure = {w: (n - len(toxic) * (df0[w] + 1) / (n_clean + 2)) / math.sqrt(n + 1) for w, n in df1.items()}
    ranked = sorted((w for w in df1 if sure[w] > 1.2 and tie(w) > 1.4), key=lambda w: (-sure[w], w))
    common = [w for w, _ in sorted(df0.items(), key=lambda x: (-x[1], x[0]))]
    marks = list(dict.fromkeys(ranked[: LANDMARKS * 2 // 3] + common[: LANDMARKS - min(len(ranked), LANDMARKS * 2 // 3)]))
    maps = [subsequences(w) for w in marks]
    place: dict[str, int] = {}
    for m in maps:
        for k in m:
            place.setdefault(k, len(place))
    base = np.zeros((len(place), len(marks)))
    for j, m in enumerate(maps):
        for k, v in m.items():
            base[place[k], j] = v
    val, vec = np.linalg.eigh(base.T @ base)
    root = vec[:, val > 1e-8] / np.sqrt(val[val > 1e-8])
    folded = base @ root  # subsequence -> Nyström features
    places, rows = Triples({k: float(v) for k, v in place.items()}, float(len(place))), np.vstack([folded, np.zeros(folded.shape[1])]).astype(np.float32)

    def folded_back(w: np.ndarray) -> Model:
        full = folded @ w[:-1]
        return Model({k: float(full[i]) for k, i in place.items() if abs(full[i]) > 1e-9}, float(w[-1]))

    positives: Counter = Counter()
    for d in toxic:
        best = sorted((w for w in d if sure[w] > 1.2 and tie(w) > 1.4), key=lambda w: (-sure[w], w))[:4]
        positives.update(best)
    words = sorted(df0.keys() | df1.keys())
    number = {w: k for k, w in enumerate(words)}
    x = _nystrom(words, places, rows)
    clean = np.array([number[w] for w in words if df0[w]], dtype=np.int64)
    weight0 = np.array([1 + math.log1p(df0[words[k]]) for k in clean])
    w, hard = np.zeros(folded.shape[1] + 1), np.ones(len(clean), dtype=bool)
    model = Model()
    for _ in range(ROUNDS):
        # Without a negative within the margin the round before has parted the classes, and its machine stays.
        if not positives or not hard.any():
            break
        pos = np.array([number[v] for v in positives], dtype=np.int64)
        # A document's units share its weight; the classes weigh alike.
        weight1 = np.sqrt(np.array(list(positives.values()), dtype=float))
        own = np.concatenate([pos, clean])
        # Of the negatives, those that the round before left within the margin make up the class's weight; at first all do.
        wt = np.concatenate([weight1 / weight1.sum(), weight0 / weight0[hard].sum()]) * 400
        w = _newton(x, own, np.concatenate([np.ones(len(pos)), -np.ones(len(clean))]), wt, 1.0, w)
        model = folded_back(w)
        decided = x @ w[:-1].astype(np.float32) + w[-1]
        hard = decided[clean] > -0.5
        again: Counter = Counter()
        for d in toxic:
            mine = sorted(((float(decided[number[v]]), v) for v in d if tie(v) > 1.2), reverse=True)[:4]
            again.update(v for s, v in mine if s > (-0.2 if sure[v] > 1.2 else 0.2))
        positives = again or positives
    if not model.weights:
        share = len(toxic) / len(examples)
        return Model(curve=(math.log(share / (1 - share)),))
    del x
    found: list[tuple] = []
    for step in range(2):
        found = []
        for at in range(0, len(examples), 256):
            part = examples[at : at + 256]
            if step == 0:  # what clean texts show across blanks
                model.decide(set().union(*(units(t) for _, t in part)).difference(model.known))
                found += [v for (t, _), v in zip(part, model.windows([TOKEN.findall(x.lower()) for _, x in part]), strict=True) if not t]
            else:
                found += [(t, *s) for (t, _), s in zip(part, model.summaries([x for _, x in part]), strict=True)]
        if step == 0:
            model.join = max(0.0, *heapq.nlargest(2, found)[-1:])
    # A toxic document in which nothing is found tells nothing about what is found in others.
    held = np.array([r for r in found if not r[0] or r[1] > 0])
    model.curve = tuple(float(v) for v in _logistic(held[:, 1:], held[:, 0]))
    model.known.clear()
    return model


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the first ``sample`` labelled documents of each class by a digest of the id, never on held-out ids."""
    bounded_batches(docs.sparkSession, 64)
    said = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
    said = said.where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 3 != 1)
    order = F.md5(F.col("label_id").cast("string").cast("binary"))
    chosen = [said.where(F.col("label") == k).orderBy(order, "label_id").limit(sample) for k in (0, 1)]
    # At most 2 * sample ids: a proven bound.
    both = F.broadcast(chosen[0].unionByName(chosen[1]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(t, x or "") for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        m = fit(sorted(examples))
        names = [*(f"weight {k}" for k in m.weights), "bias", "join", *(f"curve {k}" for k in range(len(m.curve)))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*m.weights.values(), m.bias, m.join, *m.curve], pa.float64())], names=["name", "value"])

    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text")).join(both, F.col("own_id") == F.col("label_id"))
    # One task fits the machine: at most 2 * sample rows reach it. The model has a number a subsequence of its landmarks.
    found = rows.select("label", "text").repartition(1).mapInArrow(learn, "name string, value double").collect()
    if not found:
        return fit([])
    said_of = {r.name: r.value for r in found}
    curve = tuple(v for _, v in sorted((int(k[6:]), v) for k, v in said_of.items() if k.startswith("curve ")))
    return Model({k[7:]: v for k, v in said_of.items() if k.startswith("weight ")}, said_of["bias"], curve, said_of["join"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted)"""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored at or above the threshold; all columns stay."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([x < threshold for x in m.scores(b.column(b.schema.names.index(text_col)).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    ours = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", F.coalesce(ours, F.lit(False)).alias("held_out"), "score", "predicted")
