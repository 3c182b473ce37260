"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
windows of one word each; a window that compresses to fewer bytes with the toxic dictionary than with
the ordinary one resembles toxic text. How much a saving tells, given the window's length, is
calibrated on texts that no dictionary has seen, and so is the threshold for a document's sum.

A toxic document is mostly ordinary text, and a dictionary trained on all of it holds ordinary text.
So the toxic one is trained on what is left of the toxic texts without the words that ordinary texts
have about as often, by their beginnings; ordinary content follows in both, so ordinary words cost
the same under either.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of the two dictionaries' contents, of the segments that training picks, and of the runs of words it picks from.
TOXIC_BYTES, SHARED_BYTES, SEGMENT, PICK = 6 << 10, 8 << 10, 48, 8
#: Windows: most bytes of a word, lengths and savings that are told apart; words that a worker remembers.
WORD_BYTES, LENGTHS, SAVINGS, CACHE = 40, 15, 11, 400_000
#: About so many labelled documents of each class are used for training.
SAMPLE = 1500
#: Bytes of a word's beginning (with the blank before it), least toxic documents that have it, and how many times as frequent it is there.
STEMS, LEAST_DOCS, TIMES = (5, 6, 7, 8, 9, 10), 4, 20
#: Bytes that no word has, at the end of both dictionaries and on both sides of each window: so no block is too dense to be
#: compressed at all, and the window isn't among a block's last eight bytes, in which zstandard seeks no matches.
LEAD = bytes([*range(1, 9), *range(14, 31)])
EDGES = b".,;:!?#$%&*|()\"'"


def windows_of(text: str) -> list[bytes]:
    """The whole text as windows: lower-cased words without the signs at their edges; long words are cut."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if max(map(len, words), default=0) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return [w.strip(EDGES) for w in words]


class Pair:
    """Compressors with the two dictionaries; weights by window length and saving, and the sum that scores 0.7."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float] | None = None, threshold: float = 0.0):
        self.toxic, self.ordinary, self.threshold = toxic, ordinary, threshold
        self.weights = np.array(weights if weights is not None else [0.0] * (LENGTHS * SAVINGS))
        self.known: dict[bytes, int] = {}
        self.told: dict[bytes, float] = {}
        self.compress = []
        for raw in (toxic + ordinary + LEAD, ordinary + LEAD):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # tables large enough that no part of a dictionary is lost, and a search that finds short matches
            how = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=16, chain_log=16, search_log=7, target_length=64,
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            d.precompute_compress(compression_params=how)
            self.compress.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)

    def saving(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        block = LEAD + b" " + window + b" " + LEAD
        toxic, ordinary = self.compress
        return len(ordinary(block)) - len(toxic(block))

    def kind(self, window: bytes) -> int:
        """The window's length and saving as one number."""
        out = self.known.get(window)
        if out is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            out = min(len(window), LENGTHS - 1) * SAVINGS + min(max(self.saving(window), -1), SAVINGS - 2) + 1
            self.known[window] = out
        return out

    def counts(self, text: str) -> np.ndarray:
        """How many windows are of each kind."""
        found = windows_of(text)
        return np.bincount(np.fromiter(map(self.kind, found), np.int64, len(found)), minlength=LENGTHS * SAVINGS)

    def total(self, text: str) -> float:
        """The sum of the windows' weights; a word's weight is remembered."""
        found, told = windows_of(text), self.told
        if len(told) >= CACHE:
            told.clear()
        for w in {w for w in found if w not in told}:
            told[w] = float(self.weights[self.kind(w)])
        return float(np.fromiter(map(told.__getitem__, found), np.float64, len(found)).sum())

    def score(self, text: str) -> float:
        return 1 / (1 + 3 / 7 * float(np.exp(-np.clip(self.total(text) - self.threshold, -30, 30))))


def _content(samples: list[bytes], size: int, segment: int = 24, pick: int = 6) -> bytes:
    """A dictionary's content, trained by zstandard on samples; all of them where there are too few."""
    whole = b"".join(dict.fromkeys(samples))
    if len(whole) > size:
        try:
            return zstandard.train_dictionary(size + 512, samples, k=segment, d=pick, level=8).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return whole[:size] or b" " * 8


def _stems(word: bytes) -> list[bytes]:
    """Beginnings of the word, each with the blank before it."""
    return [b" " + word[: k - 1] for k in STEMS if len(word) >= k - 1]


def _rates(docs: list[list[bytes]]) -> tuple[dict[bytes, float], Counter]:
    """By beginning: its share of a document's words, 5 % at most, summed over documents; and how many documents have it."""
    rate, have = defaultdict(float), Counter()
    for words in docs:
        for stem, n in Counter(s for w in words for s in _stems(w)).items():
            rate[stem] += min(n / len(words), 0.05)
            have[stem] += 1
    return rate, have


def _left_over(bad: list[list[bytes]], good: list[list[bytes]]) -> list[bytes]:
    """The toxic texts without the words that ordinary texts have about as often."""
    (in_bad, have), (in_good, _) = _rates(bad), _rates(good)
    ratio = TIMES * max(1, len(bad)) / max(1, len(good))
    least = max(LEAST_DOCS, len(bad) // 50)
    telling = {s for s, r in in_bad.items() if have[s] >= least and r >= ratio * (in_good.get(s, 0.0) + 2e-6 * len(good))}
    left = [[w for w in words if any(s in telling for s in _stems(w))] for words in bad]
    return [b" " + b" ".join(words) + b" " for words in left if words]


def _unlike(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without near copies of earlier ones: two of four min-hashes of their three-word runs seen before."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        words = text.encode("utf-8", "surrogatepass").split()
        h = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint32)
        own = {(k, int((h * np.uint32(2654435761 + 2 * k) ^ np.uint32(k * 40503)).min())) for k in range(4)}
        if len(own & seen) < 2:
            out.append((text, y))
        seen |= own
    return out


def train(texts: list[str], toxic: list[int]) -> Pair:
    """A pair from labelled texts. Deterministic in the order given."""
    distinct = _unlike(list(dict.fromkeys(zip(texts, toxic))))
    # every third text is for calibration: a dictionary knows its own texts too well
    learn = [(windows_of(t), y) for i, (t, y) in enumerate(distinct) if i % 3]
    bad, good = [w for w, y in learn if y and w], [w for w, y in learn if not y and w]
    shared = _content([b" " + b" ".join(w[i : i + 8]) for w in good for i in range(0, len(w), 32)], SHARED_BYTES)
    pair = Pair(_content(_left_over(bad, good), TOXIC_BYTES, SEGMENT, PICK), shared)
    # Calibration: log ratios of the kinds' frequencies, then the threshold of least cost, a false alarm counting as 3.
    kept = [x for i, x in enumerate(distinct) if i % 3 == 0] or distinct
    y = np.array([y for _, y in kept], bool)
    counts = np.array([pair.counts(t) for t, _ in kept], np.float64).reshape(len(kept), LENGTHS * SAVINGS)
    shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    a, b = ((shares[side].sum(axis=0) / max(1, side.sum()) + 2e-5).reshape(LENGTHS, SAVINGS) for side in (y, ~y))
    weights = np.log(a / a.sum()) - np.log(b / b.sum())
    weights[:, :2] = np.log(a[:, :2].sum() / a.sum()) - np.log(b[:, :2].sum() / b.sum())  # no saving: one weight for all lengths
    pair.weights = np.clip(weights, -0.1, 4.0).ravel()
    total = counts @ pair.weights
    cuts = np.unique(total)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else np.array([1e9])
    errors = [3 * (~y & (total >= c)).sum() + (y & (total < c)).sum() for c in cuts]
    pair.threshold = float(cuts[int(np.argmin(errors))])
    return pair


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """About `sample` labelled texts of each class (doc_id, text, y): all if there are fewer, else a sample by hash.

    learn: which rows of labels may be used. Of conflicting labels of an id, 1 wins. The bound keeps
    training in one task; nothing else does. The chosen ids, about two samples of them at every size of
    the tables, are broadcast, so no text is shuffled before it is chosen. Rows that repeat an id are
    bounded too, by a hash of their texts.
    """
    rows = labels.where(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * sample).cast("long")
    chosen = rows.join(F.broadcast(counts), "y").where(part).select("__id", "y")  # counts: a row a class
    found = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return found.select("doc_id", "text", "y").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(4 * sample)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo mod, is rest. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.7).

    Trained on about `sample` labelled documents of each class, none of them held out; only texts are
    inputs of a score. Null and empty texts have no window; their sum is 0. Texts are scored whole.
    Without labels of both classes every score rests on an empty dictionary. Repeated rows get equal
    scores, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    out = held_out(id_col, 3, 1)
    rows = labelled(docs, labels, "toxic", ~out, sample, id_col, text_col)

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((str(i), t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns)))
        pair = train([t for _, t, _ in seen], [y for _, _, y in seen])
        yield pa.RecordBatch.from_arrays([pa.array([pair.toxic]), pa.array([pair.ordinary]), pa.array([pair.weights]), pa.array([pair.threshold])], ["toxic", "ordinary", "weights", "threshold"])

    model = C.fitted(rows, fit, "toxic binary, ordinary binary, weights array<double>, threshold double")
    shared = spark.sparkContext.broadcast((bytes(model["toxic"]), bytes(model["ordinary"]), list(model["weights"]), model["threshold"]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pair.score(t) for t in b.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), C.text_of(text_col).alias("text"))
    scored = src.mapInArrow(score, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
