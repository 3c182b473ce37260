"""Quality by supervised subword embeddings.

A word's vector is the mean of the learned vectors of the word and of its character n-grams, hashed
into buckets; a document's vector is the mean over its words; a softmax over two classes follows. All
is trained by stochastic gradient descent in numpy. As output is linear in the vectors, a scoring
worker remembers one number for each distinct word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import held_out, labelled

#: Hash buckets, dimensions, lengths of n-grams in bytes (of the word between < and >), words remembered.
BUCKETS, DIM, GRAMS, CACHE = 1 << 15, 8, (2, 3, 4, 5), 600_000
#: Longer words are cut: each piece is a word. AGAIN is no word of a text.
WORD_BYTES, AGAIN = 40, b"\x00again"
#: About so many labelled documents of each class are used; epochs, documents of a batch, rate.
SAMPLE, EPOCHS, BATCH, RATE = 1500, 4, 32, 4.0


def words_of(text: str) -> list[bytes]:
    """The words; one that repeats the word before it is AGAIN, so that repetition has a vector of its own."""
    words = text.encode("utf-8", "surrogatepass").split()
    if max(map(len, words), default=0) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return [AGAIN if w == last else w for last, w in zip([b"", *words], words)]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features, one word after the other, and how many each word has."""
    marked = [b"<" + w + b">" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    left = ends[owner] - np.arange(len(data))  # bytes from here to the word's end
    ids, owners = [np.array([zlib.crc32(m) for m in marked], np.uint32) % BUCKETS], [np.arange(len(words))]
    h = np.full(len(data), 2166136261, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        at = np.flatnonzero(left >= n)
        h[at] = (h[at] ^ data[at + n - 1]) * np.uint32(16777619)
        if n in GRAMS:
            ids.append(((h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(17)) % BUCKETS)
            owners.append(owner[at])
    ids, owners = np.concatenate(ids).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(words))


def train(texts: list[str], y: list[int], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket vectors, output weights (DIM x 2) and biases, by SGD in the order that the seed gives."""
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    ids, counts = features(list(vocabulary))
    starts = np.concatenate([[0], np.cumsum(counts)])
    docs = [np.fromiter(map(vocabulary.__getitem__, d), np.int64, len(d)) for d in docs]
    target = np.array(y, np.int64)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    usable = np.array([i for i, d in enumerate(docs) if len(d)], np.int64)
    share = np.array([(target == 0).mean(), (target == 1).mean()]) if len(target) else np.ones(2)
    weight = np.minimum(0.5 / np.maximum(share, 1e-9), 20)  # both classes count alike
    steps = EPOCHS * max(1, -(-len(usable) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(usable)
        for b in range(0, len(usable), BATCH):
            batch = usable[b : b + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            lengths = np.array([len(docs[i]) for i in batch])
            flat = np.concatenate([docs[i] for i in batch])
            words, inverse = np.unique(flat, return_inverse=True)
            n = counts[words]
            rows = np.concatenate([ids[starts[w] : starts[w + 1]] for w in words])
            cell = np.repeat(np.arange(len(words)), n)
            edge = np.concatenate([[0], np.cumsum(n)[:-1]])
            of_word = np.add.reduceat(vectors[rows], edge, axis=0) / n[:, None]
            of_doc = np.add.reduceat(of_word[inverse], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]
            logits = of_doc @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = p
            error[np.arange(len(batch)), target[batch]] -= 1
            error *= weight[target[batch]][:, None] / len(batch)
            to_doc = (error @ out.T) / lengths[:, None]
            out -= rate * of_doc.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            spread = np.repeat(to_doc, lengths, axis=0)
            to_word = np.stack([np.bincount(inverse, spread[:, k], len(words)) for k in range(DIM)], axis=1) / n[:, None]
            step_rows = to_word[cell]
            touched, place = np.unique(rows, return_inverse=True)
            for k in range(DIM):
                vectors[touched, k] -= 10 * rate * np.bincount(place, step_rows[:, k], len(touched))
    return vectors, out, bias


class Scorer:
    """Scores texts with a trained model; a distinct word's part in the difference of logits is worked out once."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.parts = vectors @ (out[:, 1] - out[:, 0])
        self.bias = float(bias[1] - bias[0])
        self.known: dict[bytes, float] = {}

    def scores(self, texts: list[str]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = [w for w in set().union(*docs) if w not in known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids, n = features(part)
            edge = np.concatenate([[0], np.cumsum(n)[:-1]])
            known.update(zip(part, (np.add.reduceat(self.parts[ids], edge) / n).tolist()))
        get = known.__getitem__
        logits = np.array([np.fromiter(map(get, d), np.float64, len(d)).mean() if d else 0.0 for d in docs]) + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.3).

    Trained in one task on about `sample` labelled documents of each class, none of them held out;
    only texts are inputs of a score. Null and empty texts have no words: their score is that of the
    biases. Texts are scored whole; words of any length count, long ones in pieces. Without labels
    every score is 0.5. Repeated rows get equal scores, an empty table gives an empty result, other
    columns are ignored.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    out = held_out(id_col, 5, 0)
    rows = labelled(docs, labels, "quality", ~out, sample, id_col, text_col)

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((str(i), t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns)))
        model = train([t for _, t, _ in seen], [y for _, _, y in seen])
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()]) for x in model], ["vectors", "out", "bias"])

    model = C.fitted(rows, fit, "vectors binary, out binary, bias binary")
    shared = spark.sparkContext.broadcast([bytes(model[k]) for k in ("vectors", "out", "bias")])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weights, bias = (np.frombuffer(x, np.float32) for x in shared.value)
        scorer = Scorer(vectors.reshape(BUCKETS, DIM), weights.reshape(DIM, 2), bias)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scorer.scores(b.column(2).to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), C.text_of(text_col).alias("text"))
    scored = src.mapInArrow(score, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
