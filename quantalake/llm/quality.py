"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

A word is split into pieces: a letter run in lower case, its shape (case and length), a digit run, a run of marks.
Each piece has a sparse random index vector, which its hash gives; a word's index vector is their sum. Words with the
same hash bucket of their first letter run share a context vector: the scaled sum of the index vectors of the words
around them in the training texts. A word's vector is the sum of both. A text's features are the mean over its words
(a word that repeats the one before adds a vector for that), their spread, and the logarithm of its length.

The classifier is fitted on at most ``MAX_TRAIN`` labelled texts (a documented bound); every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import stored, tidy
from quantalake.llm.sampling import held_out, share
from quantalake.llm.tokens import MARKS, blocks

#: 64 dimensions and 4096 buckets take 6 and 12 bits of a hash; NONZERO entries take 7 each.
DIM, NONZERO, BUCKETS, WINDOW = 64, 6, 4096, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.005, 1e-4
MAX_TRAIN = 8000
#: Bytes of text whose distinct words are held at a time, and pieces that are remembered.
BLOCK_BYTES, CACHE = 8 << 20, 1 << 15
#: Context sums come to the driver from so many tasks.
TASKS = 8
REPEAT = 4.0
_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(run: str) -> str:
    case = "A" if len(run) > 1 and run.isupper() else "a" if run.islower() else "Aa" if run[0].isupper() else "aA"
    return f"\x01{case}{min(len(run), 12)}"


def marks(run: str) -> str:
    """The feature of a run of marks: the run, or a hash of a long one."""
    return run if len(run) <= 8 else f"\x01{xxhash.xxh3_64_hexdigest(run.encode('utf-8', 'surrogatepass'))}"


def pieces(word: str) -> list[str]:
    out = []
    for run in _PIECE.findall(word):
        if run.isalpha():
            out += [run.lower(), shape(run)]
        else:
            out.append(f"\x01{min(len(run), 6)}d" if run.isdigit() else marks(run))
    return out


def hashed(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts), np.uint64, len(texts))


def index_vectors(h: np.ndarray) -> np.ndarray:
    """A row a hash, with NONZERO entries of 1 or -1 at places that the hash gives."""
    out, rows = np.zeros((len(h), DIM), np.float32), np.arange(len(h))
    for k in range(NONZERO):
        own = (h >> np.uint64(8 * k)) & np.uint64(0x7F)
        out[rows, (own & np.uint64(63)).astype(np.int64)] += np.where(own >> np.uint64(6), 1.0, -1.0).astype(np.float32)
    return out


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(52)).astype(np.int64)


class Words:
    """Vectors of the distinct words of a block of texts; remembers those of frequent pieces."""

    def __init__(self, context: np.ndarray | None):
        self.context = context
        self.known: dict[str, np.ndarray] = {}
        self.again = self.piece("\x01again")

    def piece(self, p: str) -> np.ndarray:
        if p not in self.known:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[p] = index_vectors(hashed([p]))[0]
        return self.known[p]

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The vector and the bucket of each word; -1 for a word without a letter run."""
        body = pc.utf8_rtrim(words, MARKS.replace("_", ""))  # underscores are pieces of their own
        # a run of letters that Arrow and Python change alike, and marks after it
        simple = pc.match_substring_regex(body, "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$").to_numpy(zero_copy_only=False)
        out, bucket = np.zeros((len(words), DIM), np.float32), np.full(len(words), -1)
        some = np.flatnonzero(simple)
        run = body.filter(pa.array(simple))
        lower = pc.dictionary_encode(pc.utf8_lower(run))
        h = hashed(lower.dictionary.to_pylist())[lower.indices.to_numpy(zero_copy_only=False)]
        bucket[some] = buckets(h)
        vectors = index_vectors(h)
        length = np.minimum(pc.utf8_length(run).to_numpy(zero_copy_only=False), 12)
        upper, low, title = (f(run).to_numpy(zero_copy_only=False) for f in (pc.utf8_is_upper, pc.utf8_is_lower, lambda x: pc.utf8_is_upper(pc.utf8_slice_codeunits(x, 0, 1))))
        case = np.where(upper & (length > 1), 0, np.where(low, 1, np.where(title, 2, 3)))
        shapes = np.stack([self.piece(f"\x01{c}{n}") for c in ("A", "a", "Aa", "aA") for n in range(13)])
        vectors += shapes[case * 13 + length]
        after = (pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(body).to_numpy(zero_copy_only=False))[some]
        marked = np.flatnonzero(after)
        ends: dict[str, int] = {}
        numbers = [ends.setdefault(marks(t[-n:]), len(ends)) for t, n in zip(words.take(pa.array(some[marked])).to_pylist(), after[marked].tolist(), strict=True)]
        if ends:
            vectors[marked] += index_vectors(hashed(list(ends)))[numbers]
        out[some] = vectors
        other = np.flatnonzero(~simple)
        for k, w in zip(other.tolist(), words.take(pa.array(other)).to_pylist(), strict=True):
            own = pieces(w)
            for p in own:
                out[k] += self.piece(p)
            first = next((p for p in own if p.isalpha()), None)
            if first is not None:
                bucket[k] = buckets(hashed([first]))[0]
        if self.context is not None:
            has = bucket >= 0
            out[has] += self.context[bucket[has]]
        return out, bucket

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all words, where each text begins among them, and vectors and buckets by number."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = parts.flatten()
        there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.cumsum(there)])[parts.offsets.to_numpy(zero_copy_only=False) - parts.offsets[0].as_py()]
        words = pc.dictionary_encode(flat.filter(pa.array(there)))
        return words.indices.to_numpy(zero_copy_only=False), cuts, *self.table(words.dictionary)

    def features(self, texts: pa.Array) -> np.ndarray:
        numbers, cuts, vectors, _ = self.split(texts)
        out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            if a == b:
                continue
            n = numbers[a:b]
            total, square = np.zeros(DIM, np.float64), np.zeros(DIM, np.float64)
            for at in range(0, len(n), 8192):  # a very long text a part at a time
                own = vectors[n[at : at + 8192]]
                total += own.sum(axis=0)
                square += np.einsum("ij,ij->j", own, own)
            again = int((n[1:] == n[:-1]).sum())
            out[k, :DIM] = (total + REPEAT * again * self.again) / len(n)
            out[k, DIM:-1] = np.sqrt(np.maximum(square / len(n) - (total / len(n)) ** 2, 0))
            out[k, -1] = np.log1p(len(n)) / 10
        return out

    def context_sums(self, texts: pa.Array, sums: np.ndarray) -> None:
        """Add to each bucket the index vectors of the words within WINDOW of its words."""
        numbers, cuts, vectors, bucket = self.split(texts)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            for at in range(a, b, 8192):
                n = numbers[at : min(b, at + 8192)]
                own, around = vectors[n], np.zeros((len(n), DIM), np.float32)
                for k in range(1, WINDOW + 1):
                    around[k:] += own[:-k]
                    around[:-k] += own[k:]
                keys = bucket[n]
                order = np.argsort(keys, kind="stable")
                order = order[keys[order] >= 0]
                if len(order):
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
                    sums[keys[order][starts]] += np.add.reduceat(around[order], starts, axis=0)


class Network:
    """tanh layer and a logistic unit on standardised features; logits are divided by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2, self.temperature = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1), 1.0
        fifth = rng.permutation(len(y)) % 5 == 0  # for the temperature
        train, rest = (~fifth, fifth) if len(y) >= 50 else (np.ones(len(y), bool), np.ones(len(y), bool))
        self._fit((x[train] - self.centre) / self.scale, y[train].astype(float), rng)
        logits = self.logits(x[rest])
        loss = lambda t: np.logaddexp(0, -np.where(y[rest] > 0, logits, -logits) / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        params = [self.w1, self.b1, self.w2, self.b2]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                own = order[a : a + BATCH]
                h = np.tanh(x[own] @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - y[own]) / len(own)
                back = np.outer(error, self.w2) * (1 - h * h)
                step += 1
                for p, g, m, v in zip(params, (x[own].T @ back + DECAY * self.w1, back.sum(0), h.T @ error + DECAY * self.w2, error.sum(keepdims=True)), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


class Model:
    """Context vectors and a network; where only one class was seen, its share for every text."""

    def __init__(self, context: np.ndarray | None, network: Network | None, constant: float):
        self.context, self.network, self.constant = context, network, constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.network.scores(x) if self.network else np.full(len(x), self.constant)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most about ``max_train`` labelled texts that aren't held out (see ``sampling.held_out``).

    Null labels and ids are left out; an id with several labels has the largest. The ids of the sample are the only
    thing broadcast; the driver gets context sums of TASKS tasks and a row of features a sampled text.
    """
    ident = F.col(f"`{id_col}`")
    own = labels.select(ident.cast("long").alias("d"), F.col(f"`{label_col}`").cast("int").alias("y")).where("d is not null and y is not null")
    own = own.where(~held_out(F.col("d"))).groupBy("d").agg(F.max("y").alias("y"))
    total = own.count()
    if not total:
        return Model(None, None, 0.5)
    chosen = own.where(share(F.col("d")) <= max_train / total).orderBy(F.xxhash64("d")).limit(max_train)
    sample = docs.select(ident.cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t")).join(F.broadcast(chosen), "d")
    sample = sample.groupBy("d", "y").agg(F.min("t").alias("t"))  # repeated ids are learned from once
    sample = stored(sample.select("d", "t", "y").repartition(TASKS, "d"), "labelled")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = Words(None), np.zeros((BUCKETS, DIM), np.float32)
        for block in (b for batch in batches for b in blocks(batch, 0, BLOCK_BYTES)):
            words.context_sums(block[0], out)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    context = np.zeros((BUCKETS, DIM), np.float32)
    for row in sample.select("t").coalesce(TASKS).mapInArrow(tidy(sums), "sums binary").toLocalIterator():
        context += np.frombuffer(row.sums, np.float32).reshape(BUCKETS, DIM)
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-6
    model = Model(context, None, 0.5)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.context)
        for block in (b for batch in batches for b in blocks(batch, 2, BLOCK_BYTES)):
            yield pa.RecordBatch.from_arrays([block[0], block[1], pa.array([x.tobytes() for x in words.features(block[2])], pa.binary())], names=["d", "y", "x"])

    rows = sorted(sample.select("d", "y", "t").mapInArrow(tidy(features), "d long, y int, x binary").collect())  # at most max_train
    if not rows:
        return Model(None, None, 0.5)
    x, y = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(float), np.array([r.y > 0 for r in rows])
    return Model(context, Network(x, y), 0.5) if 0 < y.sum() < len(y) else Model(context, None, float(y.mean()))


def score(docs: DataFrame, model: Model, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= cut) of each text; null and empty texts get a score too.

    Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.context)
        for block in (b for batch in batches for b in blocks(batch, 2, BLOCK_BYTES)):
            scores = model.scores(words.features(block[2]))
            yield pa.RecordBatch.from_arrays([block[0], block[1], pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ident = F.col(f"`{id_col}`").cast("long")
    return docs.select(ident.alias("d"), held_out(ident).alias("h"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
