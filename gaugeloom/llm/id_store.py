"""Token ids in a content-addressed store.

Rolling hashes cut each document's ids into chunks, so equal passages give equal chunks whatever
stands before them. A chunk is stored once under the SHA-256 of its bytes; a document is a recipe
(its chunks in order), and its manifest holds the Merkle root of the chunk digests. Reading hashes
every stored chunk again and checks each document's root.

Files (Parquet, so that any of Spark's stores can hold them): `chunks` (digest, n, payload: ids as
little-endian unsigned 16- or 32-bit integers) and `recipes` (doc_id, ordinal, start, n_tokens,
root, chunk digests), the recipes in ascending doc_id order, a file for each range of doc_ids.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Chunks end where the hash of the last WINDOW ids has LOW_BITS zero bits, between the least and the most ids.
WINDOW, LOW_BITS, LEAST, MOST = 16, 8, 64, 1024
CACHE, CACHE_BYTES, SEEN_CHUNKS = 500_000, 64 << 20, 200_000


def _places(ids: np.ndarray) -> np.ndarray:
    """Where chunks may end, in ascending order. The hash at a place depends on the last WINDOW ids only."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64)])
    rolled = sums[WINDOW:] - sums[:-WINDOW]  # at i: over ids i .. i + WINDOW - 1
    return np.flatnonzero(((rolled * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - LOW_BITS)) == 0) + WINDOW


def cuts_in_a_row(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """Ends of the chunks of sequences that stand in a row in ids, up to the given ends."""
    places, out, begin = _places(ids), [], 0
    lo = np.searchsorted(places, np.array([0, *ends[:-1]]) + WINDOW).tolist()  # windows lie inside one sequence
    hi = np.searchsorted(places, ends, "right").tolist()
    places = places.tolist()
    for a, b, n in zip(lo, hi, ends):
        own, last = [], begin
        for e in [*places[a:b], n]:
            while e - last > MOST:
                last += MOST
                own.append(last)
            if e - last >= LEAST or e == n and e > last:
                own.append(e)
                last = e
        out.append(own)
        begin = n
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of ids."""
    return cuts_in_a_row(ids, [len(ids)])[0]


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary tree over the digests; an odd one goes up unchanged, nothing hashes as empty."""
    level = list(digests) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: Byte-level vocabularies write the n-th byte that isn't printable as the character 256 + n. Here a line feed parts words, which have none.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ODD_BYTES = [b for b in range(256) if b not in _PRINTABLE]
BYTE_NAMES = "".join(" " if b == 0x0A else chr(b) if b in _PRINTABLE else chr(256 + _ODD_BYTES.index(b)) for b in range(256))
#: Words of these letters are one piece to the file's pattern, with the space before them; marks after them are another.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: Words that the library gets as one text, and texts it gets at once.
GLUED, GLUED_TEXTS = 40, 250
#: Ids that are cut into chunks at once.
AT_ONCE = 1 << 18


def library_encoder(path: str) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """A maker of encoders with the tokenizers library and a byte-level BPE file.

    Texts are cut before single spaces and line feeds between non-blank characters, where the file's
    pattern always begins a new piece; equal pieces are encoded once and kept in a bounded cache.
    Arrow makes a batch's pieces distinct, parts words from their marks, and puts the ids together.
    """

    def make():
        if path in _ENCODERS:
            return _ENCODERS[path]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # what a worker remembers has no cycles, and looking for some takes as long as encoding
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        lettered = Tokenizer(tok.model)  # for words of letters alone, in the vocabulary's characters
        wide = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32
        first: dict[str, bytes] = {}  # pieces at the start of a text, and marks that follow letters
        later = pa.array([], pa.string()), pa.array([], pa.large_binary())  # pieces that follow a space, which is left off, and their ids

        spaced = np.zeros(tok.get_vocab_size(), bool)
        spaced[[i for t, i in tok.get_vocab().items() if t.startswith("\u0120")]] = True  # tokens that begin with a space
        broken = np.zeros(tok.get_vocab_size(), bool)
        broken[[i for t, i in tok.get_vocab().items() if t == "\u010a"]] = True  # the line feed's own token
        width = np.dtype(wide).itemsize

        def by_pattern(part: list[str], lead: str) -> np.ndarray:
            return np.array(tok.encode_batch_fast([lead + lead.join(part)], add_special_tokens=False)[0].ids, wide)

        def by_letters(part: list[str], lead: str) -> np.ndarray:
            """No merge passes a space but into another, so words need no pattern to part them; in short texts merges are found sooner."""
            glued = [lead + lead.join(part[i : i + GLUED]) for i in range(0, len(part), GLUED)]
            named = [codecs.charmap_decode(t.encode(), "strict", BYTE_NAMES)[0] for t in glued]
            return np.array(list(chain.from_iterable(e.ids for e in lettered.encode_batch_fast(named, add_special_tokens=False))), wide)

        def in_a_row(known: dict[str, bytes], part: list[str], lead: str, begins: np.ndarray) -> None:
            """Encode pieces joined: each begins with the only token in it that `begins` marks, else none is taken."""
            for i in range(0, len(part), 2_000):
                some = part[i : i + 2_000]
                ids = by_pattern(some, lead)
                ends = np.flatnonzero(begins[ids])
                if len(ends) == len(some) and ends[0] == 0:
                    whole, at = ids.tobytes(), [*(ends * width).tolist(), len(ids) * width]
                    known.update(zip(some, [whole[a:b] for a, b in zip(at, at[1:])]))

        def alone(known: dict[str, bytes], new: Iterable[str], lead: str) -> None:
            for p in new:
                if p not in known:  # a piece that begins with a line feed follows no space
                    known[p] = np.array(tok.encode(p if p[:1] == "\n" else lead + p, add_special_tokens=False).ids, wide).tobytes()

        def of_letters(part: list[str]) -> Iterator[pa.Array]:
            for i in range(0, len(part), GLUED * GLUED_TEXTS):
                some = part[i : i + GLUED * GLUED_TEXTS]
                ids = by_letters(some, " ")
                ends = np.flatnonzero(spaced[ids])
                if len(ends) == len(some) and ends[0] == 0:
                    yield _binary(ids, np.append(ends, len(ids)))
                else:
                    yield of_others(some)

        def of_others(part: list[str]) -> pa.Array:
            known: dict[str, bytes] = {}
            in_a_row(known, [p for p in part if p and " " not in p and "\n" not in p], " ", spaced)
            in_a_row(known, [p for p in part if p[:1] == "\n" and " " not in p and "\n" not in p[1:]], "", broken)
            alone(known, part, " ")
            return pa.array([known[p] for p in part], pa.large_binary())

        def of_cores(cores: pa.Array) -> pa.Array:
            """Ids of distinct pieces after a space; those that aren't known are encoded."""
            nonlocal later
            if len(later[0]) > CACHE or later[0].nbytes + later[1].nbytes > CACHE_BYTES:
                later = later[0][:0], later[1][:0]
            at = pc.index_in(cores, value_set=later[0])
            lacking = np.asarray(at.is_null())
            at = at.fill_null(0).to_numpy().copy()
            worded = np.asarray(pc.match_substring_regex(cores, LETTERS))
            for kind, of in ((worded, of_letters), (~worded, lambda part: [of_others(part)])):
                mask = lacking & kind
                if mask.any():
                    new = cores.filter(pa.array(mask))
                    at[mask] = len(later[0]) + np.arange(len(new))
                    later = pa.concat_arrays([later[0], new]), pa.concat_arrays([later[1], *of(new.to_pylist())])
            return later[1].take(pa.array(at))

        def of_pieces(pieces: pa.Array) -> pa.Array:
            """Ids of distinct pieces after a space: of the word without its marks, and of the marks."""
            cores = pc.ascii_rtrim(pieces, MARKS)
            cores = pc.if_else(pc.match_substring_regex(cores, LETTERS), cores, pieces)
            coded, marks = cores.dictionary_encode(), _tails(pieces, cores).dictionary_encode()
            told = marks.dictionary.to_pylist()
            alone(first, told, "")
            after = pa.array([first[m] for m in told], pa.large_binary()).take(marks.indices)
            return pc.binary_join_element_wise(of_cores(coded.dictionary).take(coded.indices), after, pa.scalar(b"", pa.large_binary()))

        def encode(texts: list[str]) -> list[np.ndarray]:
            if not texts:
                return []
            cut = [_joined(t) for t in texts]  # pieces parted by spaces, or None where a piece holds one
            plain = pc.split_pattern(pa.array([c for c in cut if c is not None], pa.string()), " ")
            odd = [_pieces(t) for t, c in zip(texts, cut) if c is None]
            words = pa.chunked_array([plain.flatten(), pa.array(chain.from_iterable(odd), pa.string())]).combine_chunks()
            ends = np.cumsum(np.concatenate([np.diff(plain.offsets.to_numpy()), np.fromiter(map(len, odd), np.int64, len(odd))]))
            heads_at = np.concatenate([[0], ends[:-1]])
            heads = words.take(pa.array(heads_at)).to_pylist()
            coded = words.dictionary_encode()
            at, distinct = coded.indices.to_numpy(), len(coded.dictionary)
            follows = np.ones(len(at), bool)
            follows[heads_at] = False
            used = np.zeros(distinct, bool)
            used[at[follows]] = True
            pieces = coded.dictionary.filter(pa.array(used))
            if len(first) > CACHE or sum(map(len, first)) > CACHE_BYTES:
                first.clear()
            alone(first, heads, "")
            told = pa.concat_arrays([of_pieces(pieces), pa.array([first[h] for h in heads], pa.large_binary())])
            place = (np.cumsum(used, dtype=np.int32) - 1)[at]
            place[heads_at] = len(pieces) + np.arange(len(heads))
            taken = told.take(pa.array(place))
            upto = np.frombuffer(taken.buffers()[1], np.int64)[ends] // width
            ids = np.frombuffer(taken.buffers()[2] or b"", wide, upto[-1])
            out = np.split(ids, upto[:-1])
            if odd:
                order = iter(np.argsort([c is None for c in cut], kind="stable").tolist())
                by_text = dict(zip(order, out))
                out = [by_text[i] for i in range(len(texts))]
            return out

        return _ENCODERS.setdefault(path, encode)

    return make


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of ids, from each end to the next, as bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64) * ids.itemsize), pa.py_buffer(ids)])


def _tails(whole: pa.Array, begun: pa.Array) -> pa.Array:
    """What is left of each string after the beginning given for it. whole: not a slice of an array."""
    if not len(whole):
        return whole
    ends = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1)
    both = np.empty(2 * len(whole) + 1, np.int32)
    both[::2], both[1::2] = ends, ends[:-1] + pc.binary_length(begun).to_numpy()
    parts = pa.StringArray.from_buffers(2 * len(whole), pa.py_buffer(both), whole.buffers()[2])
    return parts.take(pa.array(np.arange(1, 2 * len(whole), 2)))


#: A worker keeps a file's encoder, with what it knows, from task to task.
_ENCODERS: dict[str, Callable] = {}


def _joined(text: str) -> str | None:
    """Text whose pieces are what spaces part, a line feed at the beginning of its piece; None where blanks meet."""
    flat = text.replace("\n", " ")
    if flat.isprintable() and "  " not in flat and not flat.startswith(" ") and not flat.endswith(" "):
        return text.replace("\n", " \n")
    return None


def _pieces(text: str) -> list[str]:
    """Text cut at spaces between non-blank characters; each piece but the first has lost its space.

    Where blanks meet, the file's pattern looks across, so there is no cut. In texts without such
    places a line feed is a cut too, and stays at the beginning of its piece.
    """
    joined = _joined(text)
    if joined is not None:
        return joined.split(" ")
    out = text.split(" ")
    whole = [out[0]]
    for p in out[1:]:
        before = whole[-1]
        if p and before and not p[0].isspace() and not before[-1].isspace():
            whole.append(p)
        else:
            whole[-1] = before + " " + p
    return whole


def _rows_at_once(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to `most`, or one row."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if sizes:
        yield begin, len(sizes)


def _encoded(make, id_type: pa.DataType):
    names = ["row", "doc_id", "n_tokens", "root", "digests", "digest", "n", "payload"]
    types = [pa.int64(), id_type, pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row, seen = make(), TaskContext.get().partitionId(), 0, set()
        for b in batches:
            texts = encode(b.column(1).to_pylist())
            sizes, roots, recipes, chunks = [len(ids) + 1 for ids in texts], [], [], []
            for i, j in _rows_at_once(sizes, AT_ONCE):
                end = np.zeros(1, texts[i].dtype)
                flat = np.concatenate([x for ids in texts[i:j] for x in (ids, end)])
                whole, width, last = memoryview(flat).cast("B"), flat.itemsize, 0
                for own in cuts_in_a_row(flat, np.cumsum(sizes[i:j]).tolist()):
                    digests = []
                    for e in own:
                        payload = whole[last * width : e * width]
                        digest = hashlib.sha256(payload).digest()
                        digests.append(digest)
                        if digest not in seen:  # the rest of a task's copies go here; what several tasks hold, later
                            if len(seen) >= SEEN_CHUNKS:
                                seen.clear()
                            seen.add(digest)
                            chunks.append((digest, e - last, bytes(payload)))
                        last = e
                    recipes.append(digests)
                    roots.append(merkle_root(digests))
            if not texts:
                continue
            own = [range(part << 33 | row, part << 33 | row + len(texts)), b.column(0), sizes, roots, recipes]
            row += len(texts)
            made = [pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(own, types)]
            yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(len(texts), t) for t in types[5:])], names)
            if chunks:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(chunks), t) for t in types[:5]), *(pa.array(c, t) for c, t in zip(zip(*chunks), types[5:]))], names)

    return run


def write_ids(docs: DataFrame, path: str, make_encoder, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts, append id 0 to each, and write chunks and recipes under path.

    Null texts count as empty (one id, the end). Documents are in ascending doc_id order, null last;
    rows that repeat a doc_id stand side by side. An empty table gives an empty store. Other columns
    are ignored. Ids are integers or strings; others raise a TypeError.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_type)
    if arrow_id is None:
        raise TypeError(f"doc_id must be an integer or a string, not {id_type}")
    made = C.stored(src.mapInArrow(_encoded(make_encoder, arrow_id), f"row long, doc_id {id_type}, n_tokens long, root binary, digests array<binary>, digest binary, n int, payload binary"), "ids-encoded")
    chunks = made.where("digest is not null").groupBy("digest").agg(F.min("n").alias("n"), F.min("payload").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = C.ranked(made.where("row is not null").select("row", "doc_id", "n_tokens", "root", "digests"), ["doc_id", "row"], "n_tokens", "ids-recipes")
    # every document has an id at least, so starts rise with the order; range partitions become files in that order
    recipes.withColumnRenamed("before", "start").orderBy("start").write.option("compression", "zstd").parquet(f"{path}/recipes")


def _join_crc(length: int, _made: dict[int, list[list[int]]] = {}) -> list[list[int]]:  # noqa: B006
    """Four tables that move a CRC-32 past so many zero bytes."""
    if length not in _made:

        def times(mat: list[int], vec: int) -> int:
            out = 0
            for i in range(32):
                if vec >> i & 1:
                    out ^= mat[i]
            return out

        power = [0xEDB88320] + [1 << i for i in range(31)]  # past one zero bit
        result, n = [1 << i for i in range(32)], length * 8
        while n:
            if n & 1:
                result = [times(power, x) for x in result]
            power = [times(power, x) for x in power]
            n >>= 1
        tables = []
        for k in range(4):
            own = [0]
            for i in range(8):  # the table is linear: each bit doubles it
                own += [x ^ result[8 * k + i] for x in own]
            tables.append(own)
        _made[length] = tables
    return _made[length]


def crc_of_parts(parts: Iterable[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation, from the (length, CRC-32) of its parts."""
    crc = 0
    for length, own in parts:
        t = _join_crc(length)
        crc = t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24] ^ own
    return crc


def _checked_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash each chunk as stored, and take the CRC-32 of its ids as 32-bit integers."""
    for b in batches:
        out = []
        for digest, n, payload in zip(*(c.to_pylist() for c in b.columns)):
            if hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} doesn't match its address")
            ids = np.frombuffer(payload, np.uint16 if len(payload) == 2 * n else np.uint32)
            out.append((digest, n, zlib.crc32(ids.astype("<u4").tobytes())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.int64()))], ["digest", "n", "crc"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    return recipes.select("row", F.posexplode("digests").alias("pos", "digest"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    Every stored chunk is read and hashed once. Documents' checksums follow from their chunks', so
    no payload is shuffled, however often a chunk is used; the Merkle root is checked for each.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = C.stored(spark.read.parquet(f"{path}/chunks").select("digest", "n", "payload").mapInArrow(_checked_chunks, "digest binary, n int, crc long"), "ids-checked")
    parts = C.stored(_placed(spark, path).join(chunks, "digest").select("row", "pos", "digest", "n", "crc"), "ids-parts")
    by_doc = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc", "digest"))).alias("parts"))

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append((row, sum(p["n"] for p in parts), crc_of_parts((4 * p["n"], p["crc"]) for p in parts), merkle_root([p["digest"] for p in parts])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["row", "n", "ids_crc32", "read_root"])

    read = by_doc.mapInArrow(combine, "row long, n long, ids_crc32 long, read_root binary")
    ok = F.col("read_root").isNotNull() & (F.col("read_root") == F.col("root")) & (F.col("n") == F.col("n_tokens"))
    crc = F.when(ok, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document can't be rebuilt from its recipe")).cast("long"))
    return recipes.select("row", "doc_id", "start", "n_tokens", "root").join(read, "row", "left").select("doc_id", "start", "n_tokens", crc.alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array of long) of each document, put together from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes").select("row", "doc_id", "root")
    chunks = spark.read.parquet(f"{path}/chunks")
    by_doc = _placed(spark, path).join(chunks, "digest").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "digest", "payload"))).alias("parts"))

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, root, parts in zip(*(c.to_pylist() for c in b.columns)):
                if merkle_root([hashlib.sha256(p["payload"]).digest() for p in parts]) != root:
                    raise ValueError("a document can't be rebuilt from its recipe")
                ids = np.concatenate([np.frombuffer(p["payload"], np.uint16 if len(p["payload"]) == 2 * p["n"] else np.uint32) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([doc], b.schema.field(0).type), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    joined = recipes.join(by_doc, "row").select("doc_id", "root", "parts")
    return joined.mapInArrow(rebuild, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, ids array<long>")
