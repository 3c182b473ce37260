"""Phrase collocations from an index of word sequences per shard.

A shard is a block of text of one partition. Its pieces are laid out as one sequence of word ids, and
an FM-index is built over it in both directions: the Burrows-Wheeler transforms of the sequence and of
its reverse. Phrases are intervals of both; an interval is extended by all words before, or after, it
at once, which gives longer phrases with their counts. Counts of shards are summed.

Indexes are stored, so that texts are read once. A phrase is counted only if both phrases that it
holds, one word shorter, reach the least count over all shards: a shard asks a filter of fixed size,
whose false positives cost rows and never change a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Pieces end at these characters; blanks separate words; A to Z become lower case.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: On UTF-8, whose other characters hold no such bytes.
LETTERS = bytes.maketrans(f"ABCDEFGHIJKLMNOPQRSTUVWXYZ{ENDS}\t".encode(), ("abcdefghijklmnopqrstuvwxyz" + "\n" * len(ENDS) + " ").encode())
#: Characters of text of a shard, and those that are cut into words at once.
SHARD_CHARS, SLICE = 3 << 20, 1 << 19
LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
#: Shards of a file: what a task holds of their table at once, however many it indexes.
FILE_SHARDS = 4
#: Shares of a language's phrases that are ranked apart before the last ranking.
SHARES = 32
INDEX_SCHEMA = "words array<string>, forward binary, backward binary"
COUNT_SCHEMA = "phrase string, f long"


class _Ids(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        self[key] = out = len(self)
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffixes of seq in order. 0 ends a piece: each is a symbol of its own, by place, before all words."""
    n = len(seq)
    ends = seq == 0
    n_ends = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, seq.astype(np.int64) + n_ends - 1)
    after = np.append(rank[1:], 0)  # the last is an end, whose rank is its own
    keys = rank * (int(rank.max(initial=0)) + 1) + after
    order = np.argsort(keys)
    rank, rows, sorted_keys, h = np.empty(n, np.int64), np.arange(n), keys[order], 2
    places = order  # suffixes not settled yet, in order, and their rows
    while len(places):
        begins = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
        firsts = rows[np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))]
        rank[places] = firsts
        alone = begins & np.append(begins[1:], True)
        places, rows = places[~alone], rows[~alone]
        # no end lies within h words of an unsettled suffix, so places + h is inside
        keys = rank[places] * n + rank[places + h]
        again = np.argsort(keys)
        places, sorted_keys, h = places[again], keys[again], 2 * h
        order[rows] = places
    return order


def transform(seq: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform: the word before each suffix, in the suffixes' order; 0 before a piece."""
    return seq[suffix_order(seq) - 1]  # before the first stands the last, an end


class WordIndex:
    """Both transforms of a sequence of word ids, with their last-to-first mappings."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, n_words: int):
        self.text = forward, backward
        self.mapping: list[np.ndarray | None] = [None, None]
        self.starts = np.append(0, np.cumsum(np.bincount(forward, minlength=n_words + 1)))

    def first(self, side: int) -> np.ndarray:
        """Where each symbol of a transform stands in the first column."""
        if self.mapping[side] is None:
            out = np.empty(len(self.text[side]), np.int32)
            out[np.argsort(self.text[side], kind="stable")] = np.arange(len(out), dtype=np.int32)
            self.mapping[side] = out
        return self.mapping[side]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words: ids, where their interval begins (alike in both directions), and their counts."""
        counts = np.diff(self.starts)[1:]
        ids = np.flatnonzero(counts) + 1
        return ids, self.starts[ids], counts[ids - 1]

    def _symbols(self, side: int, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, symbol and number of the symbols in each interval, their first place in it and among all places."""
        text, n = self.text[side], len(self.text[side])
        row = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(row)) + np.repeat(low - (np.cumsum(size) - size), size)
        row *= n
        row += text[at]  # ids are below n
        order = np.argsort(row, kind="stable")
        keys = row[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        row, word = np.divmod(keys[begins], n)
        return row, word, np.diff(np.append(begins, len(keys))), at[order[begins]], begins

    def extend(self, side: int, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals extended by each word before (side 0) or after (1) them.

        low and other: where an interval begins in the direction of side and in the opposite one. Gives
        the row extended, the word, and the new low, other and size.
        """
        row, word, counts, places, begins = self._symbols(side, low, size)
        # smaller symbols of the interval come first in the opposite direction
        inside = begins - (np.cumsum(size) - size)[row]
        new_low, new_other = self.first(side)[places], other[row] + inside
        real = word > 0
        return row[real], word[real], new_low[real], new_other[real], counts[real]

    def extensions(self, side: int, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word and count of each extension, without its interval."""
        row, word, counts, _, _ = self._symbols(side, low, size)
        real = word > 0
        return row[real], word[real], counts[real]


def _pieces(texts: Iterable[tuple[str, str]], ids: _Ids) -> np.ndarray:
    """Word ids of all pieces of (language, text), from 1, with a 0 after each piece."""
    own: dict[str, list[str]] = {}
    out = []

    def take(lang: str, some: list[str]) -> None:
        found = _Ids()
        tokens = "\n".join(some).encode().translate(LETTERS).replace(b"\n", b" \n ").split(b" ")
        local = np.fromiter(map(found.__getitem__, tokens), np.int32, len(tokens))
        head = f"{lang}\t".encode()
        to = np.array([-1 if not w else 0 if w == b"\n" else ids[head + w] + 1 for w in found], np.int32)
        seq = to[local]
        out.extend([seq[seq >= 0], np.zeros(1, np.int32)])

    for lang, text in texts:
        own.setdefault(lang, []).append(text)
        if sum(map(len, own[lang])) > SLICE:
            take(lang, own.pop(lang))
    for lang, some in own.items():
        take(lang, some)
    seq = np.concatenate(out or [np.zeros(0, np.int32)])
    return seq[(seq > 0) | np.append(True, seq[:-1] > 0)] if len(seq) else seq  # one end after another says nothing


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<u4").tobytes(), 1)


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def built() -> pa.RecordBatch:
        ids = _Ids()
        seq = _pieces(held, ids)
        texts = transform(seq), transform(np.append(seq[-2::-1], 0))
        return pa.RecordBatch.from_arrays([pa.array([[w.decode() for w in ids]], pa.list_(pa.string())), *(pa.array([_packed(t)]) for t in texts)], ["words", "forward", "backward"])

    for b in batches:
        for lang, text in ((x.as_py(), y.as_py()) for x, y in zip(*b.columns)):
            if held and size + len(text) > SHARD_CHARS:
                yield built()
                held, size = [], 0
            if text:
                held.append((lang, text))
                size += len(text)
    if held:
        yield built()


def index_shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per shard: its words (language, tab, word), and both transforms."""
    C.bound_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), C.text_of(text_col).alias("text"))
    return src.mapInArrow(_index, INDEX_SCHEMA)


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], WordIndex]]:
    for b in batches:
        for i in range(b.num_rows):  # one shard at a time
            named, *texts = (c[i].as_py() for c in b.columns)
            forward, backward = (np.frombuffer(zstandard.decompress(t), "<u4") for t in texts)
            yield named, WordIndex(forward, backward, len(named))


def _joined(named: pa.Array, plain: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    """Phrases as text: the first word with its language, then the others."""
    parts = [(plain if i else named).take(pa.array(x - 1)) for i, x in enumerate(ids)]
    return pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def _batches(phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), 1 << 16):
        yield pa.RecordBatch.from_arrays([phrases[i : i + (1 << 16)], pa.array(counts[i : i + (1 << 16)], pa.int64())], ["phrase", "f"])


def _hashes(named: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, named), np.uint64)


def _key(parts: list[np.ndarray]) -> np.ndarray:
    """One number for a phrase, from its words' hashes in order."""
    out = parts[0]
    for x in parts[1:]:
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + x
    return out.astype(np.int64)


def _plain(named: list[str]) -> list[str]:
    return [w.rpartition("\t")[2] for w in named]


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all words; the language alone stands for all its words."""
    for named, index in _opened(batches):
        ids, _, size = index.words()
        langs: dict[str, int] = {}
        for i, n in zip(ids.tolist(), size.tolist()):
            lang = named[i - 1].rpartition("\t")[0]
            langs[lang] = langs.get(lang, 0) + n
        yield from _batches(pa.array([f"{x}\t" for x in langs]), np.array(list(langs.values()), np.int64))
        names = pa.array(named)
        yield from _batches(_joined(names, names, [ids]), size)


def _longer(length: int, filters) -> Callable:
    """Counts of phrases of so many words whose shorter phrases may all be frequent. filters: one for each shorter length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(f.value, np.uint8) for f in filters]
        for named, index in _opened(batches):
            hashes = np.append(np.uint64(0), _hashes(named))
            ids, low, size = index.words()
            words, back = [ids], low
            for k in range(1, length):  # frequent phrases grow to the right
                if k > 1:
                    row, word, back, low, size = index.extend(1, back, low, size)
                    words = [w[row] for w in words] + [word]
                ok = C.probe(bits[k - 1], _key([hashes[w] for w in words]))
                words, low, back, size = [w[ok] for w in words], low[ok], back[ok], size[ok]
            row, word, size = index.extensions(0, low, size)  # and last to the left
            words = [word] + [w[row] for w in words]
            ok = C.probe(bits[length - 2], _key([hashes[w] for w in words[:-1]]))
            yield from _batches(_joined(pa.array(named), pa.array(_plain(named)), [w[ok] for w in words]), size[ok])

    return run


def _phrase_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:  # phrases of one length
            told = [(lang, words.split(" ")) for lang, _, words in (p.rpartition("\t") for p in b.column(0).to_pylist())]
            keys = _key([_hashes(f"{lang}\t{words[i]}" for lang, words in told) for i in range(len(told[0][1]))])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["h"])


def phrase_counts(shards: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """phrase (language, tab, words) and f of all phrases of up to `longest` words that occur `least` times or more.

    A phrase of no words counts all words of its language, however few. shards: a stored table.
    """
    spark = shards.sparkSession
    frequent = (F.col("f") >= least) | F.col("phrase").endswith("\t")
    found = C.stored(shards.mapInArrow(_word_counts, COUNT_SCHEMA).groupBy("phrase").agg(F.sum("f").alias("f")).where(frequent), "phrase-counts")
    last, filters = found.where(~F.col("phrase").endswith("\t") & (F.col("f") >= least)), []
    for length in range(2, longest + 1):
        bits = C.key_filter(last.select("phrase").mapInArrow(_phrase_keys, "h long"), "h")
        filters.append(spark.sparkContext.broadcast(bits))  # of fixed size
        # A shard has summed its own; a task's map of many shards' phrases would save little and hold much.
        told = shards.mapInArrow(_longer(length, list(filters)), COUNT_SCHEMA).repartition("phrase")
        last = C.stored(told.groupBy("phrase").agg(F.sum("f").alias("f")).where(f"f >= {least}"), "phrase-counts")
        found = found.unionByName(last)
    return found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to `longest` words that occurs a >= `least` times within pieces is cut in two; with
    l and r occurrences of its parts, the cut scores floor(1000000 * a * a / (l * r)), and the lowest
    score counts (of equal ones, the cut after fewer words). Phrases inside a longer one with at least
    `share` per cent of their occurrences are dropped. Ranks go by score, then a, both falling, then
    phrase; n counts all words of the language.

    A null language is `und`. A null text has no words, repeated rows each count, and an empty table, or
    one without frequent phrases, gives an empty result. Texts may be of any length: one that exceeds a
    shard is a shard of its own. Numbers are exact below 10^15 occurrences. Other columns are ignored.
    """
    shards = C.stored(index_shards(docs, text_col, lang_col), "phrase-shards", FILE_SHARDS)
    counts = C.stored(phrase_counts(shards, least, longest), "phrase-frequent")
    head = F.regexp_extract("phrase", r"(?s)^(.*\t)", 1)
    rows = counts.select("phrase", "f", head.alias("head")).withColumn("words", F.split(F.expr("substring(phrase, length(head) + 1)"), " "))
    rows = rows.withColumn("k", F.when(F.col("phrase") == F.col("head"), 0).otherwise(F.size("words")))
    whole = rows.where("k = 0").select("head", F.col("f").alias("n"))  # one row a language
    candidates = C.stored(rows.where("k > 1"), "phrase-candidates")

    def joined(first, size):
        return F.concat("head", F.array_join(F.slice("words", first, size), " "))

    # What longer phrases hold of each phrase: all their runs of fewer words, two at least.
    runs = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.struct(i.alias("i"), size.alias("size"))))))
    inside = candidates.where("k > 2").select("head", "words", "f", runs.alias("run"))
    inside = inside.select(joined(F.col("run.i"), F.col("run.size")).alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("longer"))
    cuts = candidates.join(inside.hint("merge"), "phrase", "left").where(F.coalesce(F.col("longer") * 100 < F.col("f") * share, F.lit(True)))
    cuts = cuts.select("head", "phrase", "f", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = counts.select("phrase", "f")
    cuts = C.stored(cuts.select("head", "phrase", "f", "cut", joined(F.lit(1), F.col("cut")).alias("one"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("two")), "phrase-cuts")
    # Common words are part of many phrases: both sides are stored tables, whose skewed keys are split.
    cuts = C.stored(cuts.join(parts.select(F.col("phrase").alias("one"), F.col("f").alias("l")).hint("merge"), "one"), "phrase-cuts")
    cuts = cuts.join(parts.select(F.col("phrase").alias("two"), F.col("f").alias("r")).hint("merge"), "two")
    big = {c: F.col(c).cast("decimal(15,0)") for c in ("f", "l", "r")}
    cuts = cuts.withColumns({"above": big["f"] * big["f"] * F.lit(1_000_000).cast("decimal(7,0)"), "below": big["l"] * big["r"]})
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r"))
    scored = cuts.groupBy("head", "phrase", "f").agg(lowest.alias("best"))
    order = [F.desc("best.score"), F.desc("f"), F.col("phrase")]
    # A language's first phrases are among the first of each of its shares, so the last ranking reads no more than those.
    scored = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("head", "share").orderBy(*order))).where(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("head").orderBy(*order))
    ranked = scored.withColumn("rank", place).where(F.col("rank") <= top).join(whole, "head")
    return ranked.select(
        F.expr("substring(head, 1, length(head) - 1)").alias("lang"), F.col("rank").cast("long").alias("rank"), F.expr("substring(phrase, length(head) + 1)").alias("phrase"),
        F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"),
    )


ORACLE_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
gram AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM split
         UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM split
         UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM split),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM gram GROUP BY lang, k, phrase),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidate AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM candidate WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM candidate WHERE k = 3) GROUP BY lang, phrase),
open AS (SELECT c.* FROM candidate c LEFT JOIN longer o USING (lang, phrase) WHERE o.a IS NULL OR 100 * o.a < 50 * c.a),
cut AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS after FROM open),
scored AS (SELECT c.lang, c.phrase, c.a, c.after, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score FROM cut c
           JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.after], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.after + 1 : c.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, after) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
