"""Token counts, spelling variants and collocations against brute-force versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugeloom.llm import collocations, common, spelling, token_counts
from tests.llm.test_operators import LONG, SCHEMA, docs, none, odd  # noqa: F401  fixtures

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11


def library_counts(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, odd, none, name):  # noqa: F811
    cache, path, count = common.scratch_path(spark, "test-cache"), public_tokenizers.path(name), library_counts(name)

    def want(df):
        told = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        return sorted(((i, len(t.encode()), count(t), count(t) > 512) for i, t in told), key=repr)

    for df in (none, odd, docs, odd):  # the last finds all in the cache
        got = token_counts.count_tokens(df, path, cache).cache()
        assert rows_of(got.drop("from_cache")) == want(df)
    assert got.where("not from_cache").isEmpty()
    kept = spark.read.parquet(f"{cache}/version={token_counts.tokenizer_version(path)}")
    assert kept.count() == kept.select("digest").distinct().count() > 0


def test_each_text_is_encoded_once(spark):
    texts = ["alpha beta"] * 500 + [f"text {i % 40}" for i in range(200)] + [None, "", "only once"]
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(7)
    cache, path = common.scratch_path(spark, "test-cache"), public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(df.where("doc_id % 2 = 0"), path, cache).count() == 352
    got = token_counts.count_tokens(df, path, cache)
    assert got.count() == len(texts)
    table = spark.read.parquet(f"{cache}/version={token_counts.tokenizer_version(path)}")
    assert table.count() == len({t or "" for t in texts})  # each digest was appended once, over both calls


def test_normalised_content(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(0, "Some  Words"), (1, "some words"), (2, "a <|startoftext|>"), (3, "A <|STARTOFTEXT|>")], "doc_id long, text string")
    a, b, c, d = (r.d for r in df.select("doc_id", token_counts.content_digest(common.text_of(), path).alias("d")).orderBy("doc_id").collect())
    assert a == b and c != d


# 12


def words_brute(rows, least=7, often=2, every=31):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= often}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_brute(n):
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def test_spelling_variants(odd, none):  # noqa: F811
    told = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(spelling.spelling_variants(odd)) == variants_brute(words_brute(told))
    assert spelling.spelling_variants(none).collect() == []


@pytest.mark.parametrize("tile", [2, 5, 256])
def test_near_words(spark, tile):
    """Repeated letters, one common beginning and one common end, words of a single place's difference, very long words."""
    rnd = random.Random(tile)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(7, 9))) for _ in range(150)}
    words |= {"beginning" + "".join(rnd.choice("abé") for _ in range(4)) for _ in range(60)}
    words |= {"".join(rnd.choice("xyü") for _ in range(4)) + "ending" for _ in range(40)}
    words |= {"samesame" + c for c in "abcdefghijklmnopqrstuvwxyz"} | {"samesame", "a" * 7, "a" * 8, "a" * 9}
    words |= {"z" * 5000, "z" * 5001, "z" * 2500 + "y" + "z" * 2500, "z" * 2499 + "y" + "z" * 2500}
    n = {w: rnd.choice([2, 3, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(5)
    got = defaultdict(lambda: [0, []])
    for r in spelling.near_words(df, tile).collect():
        got[r.word][0] += r.n_near
        got[r.word][1].append((-r.best_n, r.best))
    for w in words:
        near = [x for x in words if is_near(w, x)]
        assert got[w][0] == len(near), w
        assert min(got[w][1], default=None) == min(((-n[x], x) for x in near), default=None)


def test_roots(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3"), ("y", "x")]
    got = dict(rows_of(spelling.last_forms(spark.createDataFrame(links, "word string, form string"))))
    assert set(got.values()) == {"w11"} and len(got) == 13


# 13


def phrases_brute(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            ws = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(ws[i : i + k] for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and p[i:j] in found and 100 * a >= 50 * found[p[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,longest,top", [(10, 3, 2000), (2, 4, 50), (3, 2, 2000)])
def test_collocations(spark, docs, odd, none, least, longest, top):  # noqa: F811
    for df in (docs, odd):
        told = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
        assert rows_of(collocations.collocations(df, least=least, longest=longest, top=top)) == phrases_brute(told, least, longest, top)
    assert collocations.collocations(none).collect() == []


def test_odd_pieces(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["a", "B", "b c", "é", "\x00", "d.", ",", "e\n", "\t", "", "<|x|>", "a b"]) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    rows = [(i, t, ("en", None, "a\tb", "a\nb", "")[i % 5]) for i, t in enumerate([*texts, " ", "...", "\n\n", LONG, LONG])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert rows_of(collocations.collocations(df, least=3)) == phrases_brute([(x, t) for _, t, x in rows], 3, 3, 2000)


@pytest.mark.parametrize("seed", range(4))
def test_word_index(seed):
    """Intervals against a search through the sequence, extended to both sides."""
    rnd = random.Random(seed)
    seq = np.array([rnd.choice([0, 1, 1, 2, 3]) for _ in range(300)] + [0])
    order = collocations.suffix_order(seq)
    ends = np.cumsum(seq == 0)
    symbols = [(0, e) if s == 0 else (1, s) for s, e in zip(seq.tolist(), ends.tolist())]
    assert order.tolist() == sorted(range(len(seq)), key=lambda i: symbols[i:])
    index = collocations.WordIndex(collocations.transform(seq), collocations.transform(np.append(seq[-2::-1], 0)), 3)
    text = seq.tolist()

    def count(p):
        return sum(text[i : i + len(p)] == p for i in range(len(text)))

    ids, low, size = index.words()
    phrases, other = [[i] for i in ids.tolist()], low
    for side in (1, 0, 0, 1):
        row, word, new, opposite, size = index.extend(side, low if side == 0 else other, other if side == 0 else low, size)
        phrases = [[w, *phrases[r]] if side == 0 else [*phrases[r], w] for r, w in zip(row.tolist(), word.tolist())]
        low, other = (new, opposite) if side == 0 else (opposite, new)
        assert size.tolist() == [count(p) for p in phrases]
        assert len({tuple(p) for p in phrases}) == len(phrases)
        assert sum(size) == sum(0 not in text[i : i + len(phrases[0])] for i in range(len(text) - len(phrases[0]) + 1))
