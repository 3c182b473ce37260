"""Spelling variants among the words of a corpus.

Two words are near if one inserted, deleted or replaced code point turns one into the other: then the
lengths of their common prefix and common suffix together reach the longer length minus one. So they
share the first or the last half of it, and only words that share a half are compared: as tiles of
padded code-point matrices, a block of rows against the block that begins some rows later.

A half that more words share than a tile holds is cut again: what is left of a pair that shares its
first half shares the first or the last half of the rest, and so on, until words agree in all places
but one. Such a bucket holds a word for each letter at most. So a common beginning costs a few rows
more for each word, never all pairs of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run. In lower case they are 90, so at most 91 words agree in all places but one.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Buckets of more words are cut again.
TILE = 256
#: Cells of the matrices that a worker holds at once.
CELLS, ROWS = 4 << 20, 16_384
#: A form has so many times the occurrences of its variants; one run in EVERY loses a letter.
TIMES, EVERY = 10, 31


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, every: int | None = EVERY) -> DataFrame:
    """word and n (occurrences) of the words of `least` letters or more that occur `often` times or more.

    every: a run whose checksum with its document's id it divides loses the letter that the checksum
    names, which makes variants to find; None leaves all runs as they are.
    """
    run = F.explode(F.regexp_extract_all(C.text_of(text_col), F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    plain = F.octet_length("run") == F.char_length("run")  # lower() knows other capitals too
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def _bucket() -> Column:
    """Number of a bucket; two buckets of one number cost comparisons, not results."""
    return F.xxhash64("m", "path", F.substring("word", F.lit(1), F.col("a")), F.expr("right(word, b)"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: its bucket also shares the first, or the last, half of what was left.

    m: the longer word's length; a, b: how much of the beginning and the end a bucket shares; path: 1,
    then a binary digit for each cut, 0 where the first half was taken.
    """
    half = ((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = rows.select("word", "n", "m", "a", "b", "path", half.alias("half"), side.alias("side"))
    rows = rows.select("word", "n", "m", (F.col("a") + F.when(F.col("side") == 0, F.col("half")).otherwise(0)).alias("a"), (F.col("b") + F.col("side") * F.col("half")).alias("b"), (F.col("path") * 2 + F.col("side")).alias("path"))
    return rows.withColumn("bucket", _bucket())


def _same_until(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows that differ somewhere."""
    return np.argmin(x == y, axis=1)


def _is_own(lcp: np.ndarray, m: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Whether a pair counts in this bucket: it takes the first half wherever it can, so it counts in one."""
    ok, a, b = np.ones(len(m), bool), np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
    levels = np.floor(np.log2(path)).astype(np.int64)
    for level in range(int(levels.max(initial=0))):
        inside = level < levels
        side = path >> np.maximum(levels - 1 - level, 0) & 1
        half = (m - a - b) // 2
        ok &= ~inside | ((lcp >= a + half) == (side == 0))
        a += np.where(inside & (side == 0), half, 0)
        b += np.where(inside & (side == 1), half, 0)
    return ok


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def near_in_tiles(words: list[str], n: np.ndarray, m: np.ndarray, path: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of near rows, best near row) of rows of whole buckets; edges: first row after each row's bucket."""
    width = max(map(len, words)) + 1
    ahead, back = _matrix(words, width), _matrix([w[::-1] for w in words], width)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    x, step, most = np.arange(len(words)), 0, max(1, CELLS // width)
    while True:
        step += 1
        x = x[x + step < edges[x]]
        if not len(x):
            break
        for part in np.split(x, range(most, len(x), most)):
            y = part + step
            part = part[longer := np.maximum(lengths[part], lengths[y]) == m[part]]  # two of the shorter length meet elsewhere
            y = y[longer]
            lcp = _same_until(ahead[part], ahead[y])
            near = lcp + _same_until(back[part], back[y]) >= m[part] - 1
            part, y, lcp = part[near], y[near], lcp[near]
            own = _is_own(lcp, m[part], path[part])
            found.append((part[own], y[own]))
    one, other = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    row, near = np.concatenate([one, other]), np.concatenate([other, one])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[near], -n[near], row))
    row, near = row[order], near[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return row[first], np.diff(np.append(first, len(row))), near[first]


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word, from rows sorted by bucket. A worker holds whole buckets of a bounded number of cells."""
    held: list[tuple] = []
    start = 0  # where the last bucket begins

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        words, n, m, path, bucket = zip(*rows)
        m, path, n = np.array(m, np.int64), np.array(path, np.int64), np.array(n, np.int64)
        key = np.array(bucket, np.int64)
        ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(m) != 0) | (np.diff(path) != 0)) + 1
        edges = np.repeat(np.append(ends, len(rows)), np.diff(np.concatenate([[0], ends, [len(rows)]])))
        row, count, best = near_in_tiles(list(words), n, m, path, edges)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in row]), pa.array(count, pa.int64()), pa.array([words[i] for i in best]), pa.array(n[best], pa.int64())], ["word", "n_near", "best", "best_n"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[2:] != held[-1][2:]:
                start = len(held)
                if start >= ROWS or start * (max(row[2], held[-1][2]) + 1) >= CELLS:
                    yield from compare(held)
                    held, start = [], 0
            held.append(row)
    if held:
        yield from compare(held)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best, best_n: rows that together tell the near words of each word of (word, n).

    A word's counts are to be summed, and its best near word is that of the largest n (of equal ones,
    the first in code-point order). Words must be distinct.
    """
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    rows = rows.select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).cast("long").alias("path"))
    ready = None
    while True:
        rows = C.stored(_halves(rows), "spelling-halves")
        left = F.max(F.col("m") - F.col("a") - F.col("b"))  # one place: words of the bucket differ there alone
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), left.alias("left")).where("size > 1")
        sizes = C.stored(sizes.select("bucket", ((F.col("size") > tile) & (F.col("left") > 1)).alias("large")), "spelling-buckets")
        marked = rows.join(sizes.hint("merge"), "bucket")
        small = marked.where("not large")
        ready = small if ready is None else ready.unionByName(small)
        if sizes.where("large").isEmpty():
            break
        rows = marked.where("large").drop("large", "bucket")
    tiles = ready.select("word", "n", "m", "path", "bucket").repartition("bucket").sortWithinPartitions("m", "path", "bucket")
    return tiles.mapInArrow(_tiles, "word string, n_near long, best string, best_n long")


def last_forms(links: DataFrame) -> DataFrame:
    """word and root: where the links (word, form) from a word end. Each round doubles the steps taken."""
    known = C.stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not known.where("moved").isEmpty():
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = C.stored(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
    return known.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, tile: int = TILE, **counting) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words and their numbers are those of `word_counts`, which takes the further arguments. A word's
    form is its near word of most occurrences (of equal ones, the first in code-point order), if that
    occurs `times` times as often or more; its root is where its forms end, or the word itself.

    A null text holds no words, a null doc_id counts as empty where runs lose letters, rows that repeat
    each count, and an empty table, or one without words that count, gives an empty result. Words may
    be of any length. Other columns are ignored.
    """
    C.bound_batches(docs.sparkSession)
    words = C.stored(word_counts(docs, id_col, text_col, **counting), "spelling-words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    near = near_words(words, tile).withColumn("n", F.lit(None).cast("long"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("lacks"), "best")))
    found = none.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.lacks") >= F.col("n") * times, F.col("best.best"))
    found = found.select("word", form.alias("form"), "n", "n_near", (-F.col("best.lacks")).alias("form_n"))
    found = C.stored(found.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))), "spelling-forms")
    roots = last_forms(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
many AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 7 GROUP BY doc_id, w),
coded AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM many),
checked AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
              lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc FROM coded, crc_table),
cut AS (SELECT CASE WHEN crc % 31 = 0 THEN substring(w, 1, crc % length(w)) || substring(w, crc % length(w) + 2) ELSE w END AS word, n FROM checked),
word AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
short AS (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM word)),
pair AS (SELECT a.word, b.word AS near FROM short a JOIN short b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
         UNION SELECT s.word, w.word FROM short s JOIN word w ON s.k = w.word UNION SELECT w.word, s.word FROM short s JOIN word w ON s.k = w.word),
best AS (SELECT p.word, count(*) AS n_near, max(w.n) AS best_n, arg_min(p.near, (-w.n, p.near)) AS best FROM pair p JOIN word w ON w.word = p.near GROUP BY p.word),
form AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 10 * w.n THEN b.best END AS form, CASE WHEN b.best_n >= 10 * w.n THEN b.best_n END AS form_n
         FROM word w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS here, 0 AS steps FROM form UNION ALL SELECT k.word, f.form, k.steps + 1 FROM walk k JOIN form f ON f.word = k.here WHERE f.form IS NOT NULL),
ended AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM form JOIN ended USING (word)
"""
