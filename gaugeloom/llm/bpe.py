"""BPE encoding and decoding by an index of pair occurrences.

The distinct words of a partition (of each block of a large one) are laid out as one sequence of symbols. Each pair of
neighbouring symbols maps to all its positions; active merge ranks are taken in ascending order, and
a merge updates the lists of the pairs beside it. A word is encoded once, however often it occurs.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Distinct words laid out at once, distinct pieces of text that a worker remembers, and bytes of text of a block.
BLOCK_WORDS, CACHE, BLOCK_BYTES = 400_000, 300_000, 16 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
#: From so many places on, a rank is merged with numpy.
MANY = 40

#: Pieces of these characters split and lower-case alike in Python and in the library.
COMMON = re.compile("[!-~À-ÖØ-öø-ÿ]+")
COMMON_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ\n]+")
#: The splitting rule that COMMON_WORDS stands for, as vocabulary files state it.
COMMON_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level vocabularies write the n-th byte that isn't printable as the character 256 + n.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_NAMES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class PairIndex:
    """Merges of a vocabulary file, and the index that applies them to a block of words."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.size = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pair: list[int] = []
        for m in merges:
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            key = vocab[a] * self.size + vocab[b]
            if key not in self.rank:
                self.rank[key] = len(self.made)
                self.made.append(vocab[a + b])
                self.pair.append(key)
        # A merge is plain if no later pair with its product has a lower rank: then all its places can be merged at once.
        lowest: dict[int, int] = {}
        for key, r in self.rank.items():
            for t in divmod(key, self.size):
                lowest[t] = min(r, lowest.get(t, r))
        self.plain = [lowest.get(t, r + 1) > r for r, t in enumerate(self.made)]
        pairs = np.array(self.pair, np.int64)
        order = np.argsort(pairs)
        self.sorted_pairs, self.sorted_ranks = pairs[order], order
        self.single, self.final = self._table(""), self._table(suffix)

    def _table(self, suffix: str) -> np.ndarray:
        """Ids by code point of characters, with the suffix; -1 where there is none, as at the last place."""
        found = {ord(t[0]): i for t, i in self.vocab.items() if t[1:] == suffix and t}
        out = np.full(max(found, default=0) + 2, -1, np.int64)
        out[list(found)] = list(found.values())
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Symbols that the vocabulary lacks are dropped, as the library does without an unknown token."""
        ids, ends = self.encode_flat(words)
        ids = ids.tolist()
        return [ids[x:y] for x, y in zip([0, *ends], ends)]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all words in a row, and where each word's end."""
        size = self.size
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words)), lengths)
        s = self.single[np.minimum(chars, len(self.single) - 1)]
        last = np.cumsum(lengths)[lengths > 0] - 1
        s[last] = self.final[np.minimum(chars[last], len(self.final) - 1)]
        s, w = s[s >= 0], w[s >= 0]
        n = len(s)
        if not n:
            return s, [0] * len(words)
        # The index: for each active rank, the positions of its pair's first symbol, found by one sort over all pairs.
        keys = np.where(w[1:] == w[:-1], s[:-1] * size + s[1:], -1)
        near = np.minimum(np.searchsorted(self.sorted_pairs, keys), len(self.sorted_pairs) - 1)
        ranks = np.where(self.sorted_pairs[near] == keys, self.sorted_ranks[near], -1)
        live = np.flatnonzero(ranks >= 0)
        live = live[np.argsort(ranks[live], kind="stable")]
        places: dict[int, list[int]] = {}
        edges = np.flatnonzero(np.diff(ranks[live])) + 1
        for part in np.split(live, edges) if len(live) else []:
            places[int(ranks[part[0]])] = part.tolist()
        # left[n] and right[n] close the sequence; arrays, so that numpy sees the same memory
        sym_a, word_a = array("q", np.append(s, -1).tobytes()), array("q", np.append(w, -1).tobytes())
        left_a, right_a = array("q", range(-1, n)), array("q", range(1, n + 2))
        views = [np.frombuffer(x, np.int64) for x in (sym_a, word_a, left_a, right_a)]
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            at = places.pop(r, None)
            if at is None:
                continue
            a, b = divmod(self.pair[r], size)
            if len(at) >= MANY and self.plain[r] and a != b:
                found = self._merge_many(r, a, b, at, *views)
            else:
                found = self._merge_few(r, a, b, at, sym_a, word_a, left_a, right_a)
            for q, more in found:
                if q in places:
                    places[q] += more
                else:
                    places[q] = more
                    heapq.heappush(heap, q)
        sym, word = views[0][:n], views[1][:n]
        counts = np.bincount(word[sym >= 0], minlength=len(words))
        return sym[sym >= 0], np.cumsum(counts).tolist()

    def _merge_few(self, r: int, a: int, b: int, at: list[int], sym, word, left, right) -> list[tuple[int, list[int]]]:
        """Merge rank r at the places given, left to right; gives the (rank, places) that come up beside it."""
        get, size, new, plain, n = self.rank.get, self.size, self.made[r], self.plain[r], len(sym) - 1
        out: list[tuple[int, list[int]]] = []
        waiting: list[int] = []
        halted = -1
        if len(at) > 1:
            at.sort()
        for i in at:
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b or word[j] != word[i]:
                continue  # an earlier merge took one of the two
            own = word[i]
            if own == halted:
                waiting.append(i)
                continue
            k = right[j]
            sym[i], sym[j] = new, -2
            right[i] = k
            if k < n:
                left[k] = i
                if word[k] == own and (q := get(new * size + sym[k])) is not None:
                    out.append((q, [i]))
                    if q < r:
                        halted = own
            h = left[i]
            if h >= 0 and word[h] == own and (q := get(sym[h] * size + new)) is not None:
                out.append((q, [h]))
                if q < r:
                    halted = own
            if plain:
                halted = -1
        if waiting:  # a lower rank came up in these words; it goes first
            out.append((r, waiting))
        return out

    def _merge_many(self, r: int, a: int, b: int, at: list[int], sym, word, left, right) -> list[tuple[int, list[int]]]:
        """The same for many places of a plain rank, all at once."""
        n, new = len(sym) - 1, self.made[r]
        i = np.unique(np.array(at, np.int64))
        j = right[i]
        ok = (sym[i] == a) & (j < n)
        i, j = i[ok], j[ok]
        ok = (sym[j] == b) & (word[j] == word[i])
        i, j = i[ok], j[ok]
        if not len(i):
            return []
        k = right[j]
        sym[i], sym[j] = new, -2
        right[i] = k
        inside = k < n
        left[k[inside]] = i[inside]
        i_r, k_r = i[inside], k[inside]
        ok = word[k_r] == word[i_r]
        i_r, k_r = i_r[ok], k_r[ok]
        h = left[i]
        ok = h >= 0
        h, i_l = h[ok], i[ok]
        ok = word[h] == word[i_l]
        h = h[ok]
        keys = np.concatenate([new * self.size + sym[k_r], sym[h] * self.size + new])
        firsts = np.concatenate([i_r, h])
        near = np.searchsorted(self.sorted_pairs, keys)
        near[near == len(self.sorted_pairs)] = 0
        ok = self.sorted_pairs[near] == keys
        ranks, firsts = self.sorted_ranks[near[ok]], firsts[ok]
        if not len(ranks):
            return []
        order = np.argsort(ranks, kind="stable")
        ranks, firsts = ranks[order], firsts[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        starts = [0, *edges.tolist()]
        lead, places = ranks[starts].tolist(), firsts.tolist()
        return [(q, places[x:y]) for q, x, y in zip(lead, starts, [*starts[1:], len(places)])]


class Codec:
    """Encodes and decodes with a BPE file of the tokenizers library: its normaliser and splitter, our merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.decoder = tok.normalizer, tok.pre_tokenizer, tok.decoder
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.index = PairIndex(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.token = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.names = [""] * (max(self.token) + 1)
        for i, t in self.token.items():
            self.names[i] = t
        self.names = [t + " " for t in self.names]
        self.digits = [f"{i} " for i in range(len(self.names))]
        self.wide = np.uint16 if len(self.names) <= 1 << 16 else np.uint32
        # What is known: pieces, words as split from common pieces, and words that the library split. Values: n, ids, ids as text, tokens.
        self.pieces: dict[str, Told] = {}
        self.words: tuple[dict[str, Told], dict[str, Told]] = {}, {}
        splits = [x.get("pattern", {}).get("Regex") for x in spec["pre_tokenizer"].get("pretokenizers", [])]
        self.common = COMMON_RULE in splits and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def _words(self, pieces: list[str]) -> list[tuple[bool, list[str]]]:
        """The words of each piece, and whether they are still in plain letters (else as the library gives them)."""
        out: list[tuple[bool, list[str]] | None] = [None] * len(pieces)
        at = [i for i, p in enumerate(pieces) if COMMON.fullmatch(p)] if self.common else []
        found = COMMON_WORDS.findall("\n".join([pieces[i] for i in at]).lower())
        begin = 0
        for i in at:
            try:
                end = found.index("\n", begin)
            except ValueError:
                end = len(found)
            out[i] = True, found[begin:end]
            begin = end + 1
        for i, p in enumerate(pieces):
            if out[i] is None:
                text = self.normalizer.normalize_str(p) if self.normalizer else p
                out[i] = False, [w for w, _ in self.splitter.pre_tokenize_str(text)]
        return out

    def _learn_words(self, words: list[str], plain: bool) -> None:
        known = self.words[not plain]
        new = [w for w in dict.fromkeys(words) if w not in known]
        digits, names = self.digits, self.names
        for i in range(0, len(new), BLOCK_WORDS):
            block = new[i : i + BLOCK_WORDS]
            named = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_NAMES) for w in block] if plain else block
            flat, ends = self.index.encode_flat(named)
            raw, width, ids = flat.astype(self.wide).tobytes(), np.dtype(self.wide).itemsize, flat.tolist()
            begin = 0
            for w, end in zip(block, ends):
                own = ids[begin:end]
                known[w] = end - begin, raw[begin * width : end * width], "".join([digits[k] for k in own]).encode(), "".join([names[k] for k in own]).encode()
                begin = end

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False): without a decoder, tokens joined by a space."""
        tokens = [self.names[i][:-1] for i in ids]
        return self.decoder.decode(tokens) if self.decoder else " ".join(tokens)

    def learn(self, every: set[str]) -> Callable[[str], Told]:
        """Encode what is new in the distinct pieces of a block of texts; gives what is known of a piece."""
        known, large = self.pieces, {}
        new = [p for p in every if p not in known]
        if len(known) + len(new) > CACHE:  # what this block doesn't need goes
            self.pieces = known = {p: known[p] for p in every if p in known}
            for w in self.words:
                w.clear()
        odd = [p for p in new if self.special_at and "<" in p and self.special_at.search(p)]
        plain = [p for p in new if not (self.special_at and "<" in p and self.special_at.search(p))] if odd else new
        for i in range(0, len(plain), BLOCK_WORDS):
            part = plain[i : i + BLOCK_WORDS]
            words = self._words(part)
            for kind in (True, False):
                self._learn_words([w for k, ws in words if k is kind for w in ws], kind)
            for p, (kind, ws) in zip(part, words):
                told = self.words[not kind]
                (known if len(p) <= 200 else large)[p] = told[ws[0]] if len(ws) == 1 else _together([told[w] for w in ws])
        for p in odd:  # a special token within a piece is one id
            parts = []
            for x in self.special_at.split(p):
                if x in self.special:
                    i = self.special[x]
                    parts.append((1, np.array([i], self.wide).tobytes(), self.digits[i].encode(), self.names[i].encode()))
                elif x:
                    [(kind, ws)] = self._words([x])
                    self._learn_words(ws, kind)
                    parts += [self.words[not kind][w] for w in ws]
            large[p] = _together(parts)
        return known.__getitem__ if not large else lambda p: large[p] if p in large else known[p]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        cut = [_pieces(t) for t in texts]
        get = self.learn(set().union(*cut))
        return [np.frombuffer(b"".join([get(p)[1] for p in c]), self.wide).tolist() for c in cut]

    def digests(self, texts: Iterable[str], get: Callable[[str], Told]) -> list[tuple[int, str, str]]:
        """(n_tokens, SHA-256 of the ids as text, SHA-256 of the decoded text) of each text, from what is known of their pieces."""
        out = []
        for text in texts:
            rows = [r for r in map(get, _pieces(text)) if r[0]]
            if not rows:
                out.append((0, EMPTY, EMPTY))
                continue
            n, ids, ids_text, tokens = zip(*rows)
            decoded = b"".join(tokens)[:-1] if self.decoder is None else self.decode(np.frombuffer(b"".join(ids), self.wide).tolist()).encode()
            out.append((sum(n), hashlib.sha256(b"".join(ids_text)[:-1]).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out


#: n, ids, ids as text, tokens: the last two with a space after each.
Told = tuple[int, bytes, bytes, bytes]


def _together(parts: list[Told]) -> Told:
    if not parts:
        return 0, b"", b"", b""
    n, ids, text, tokens = zip(*parts)
    return sum(n), b"".join(ids), b"".join(text), b"".join(tokens)


#: A worker keeps a file's codec, with what it knows, from task to task.
_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        gc.disable()  # what a worker remembers has no cycles, and looking for some takes longer than encoding
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _pieces(text: str) -> list[str]:
    """Text cut at spaces. No word of a file that drops white space reaches across one; a special token may hold none."""
    return [p for p in text.replace("\n", " ").split(" ") if p]


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of a partition together, as long as they hold no more than BLOCK_BYTES."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield held


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (t.as_py() for t in batch.column(1))


def _worker(path: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for block in _gathered(batches):
            every: set[str] = set()
            for b in block:  # a block's texts are cut twice: its pieces, one by one, would take more room than the texts
                for text in _texts(b):
                    every.update(_pieces(text))
            get = own.learn(every)
            for b in block:
                if b.num_rows:
                    rows = list(zip(*own.digests(_texts(b), get)))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, for a file that drops white space.

    Null and empty texts have no tokens; their digests are those of the empty string. Repeated rows
    stay rows of their own, a null doc_id stays null, an empty table gives an empty result, and other
    columns are ignored.
    """
    C.bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_worker(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each document."""
    C.bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.encode(b.column(1).to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids count as none."""
    src = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
