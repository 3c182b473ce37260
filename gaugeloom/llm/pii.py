"""Personal data by base patterns and a skip-chain conditional random field.

Patterns give the base spans. Further candidates are stretches that look like numbers, addresses or
keys; they are the nodes of a field for each document. Neighbouring candidates share chain potentials,
and distant ones whose normalised contents repeat or resemble each other share skip potentials. Base
spans are observed; loopy message passing finds the labels of the others, so what is the same number,
written in another way, gets the same label throughout a document.

No labels are given, so training makes them: base spans have their kind, secrets are long keys that a
text assigns to a telling name, and into each training text some of its spans are written again in
another form, with their label, beside like numbers of other digits that are none of the kinds. Only
the skip potentials can tell these two apart.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The kinds of the base rules, and one that only the field gives.
KINDS = ("email", "ip", "card", "phone", "secret")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What may be personal data: numbers in pieces, and addresses with their signs spelt out.
NUMBER = re.compile(r"(?<![A-Za-z0-9.])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*(?![A-Za-z0-9])")
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,5}", re.IGNORECASE)

#: Long keys of letters and digits, and the names that such keys are assigned to.
LONG_KEY = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{20,128}(?![A-Za-z0-9_/+-])")
NAMED = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?$", re.IGNORECASE)

#: Buckets of features; documents sampled for training, epochs and rate; rounds of message passing; least marginal of a new span.
BUCKETS, SAMPLE, EPOCHS, RATE, ROUNDS, SURE = 512, 6000, 6, 0.2, 12, 0.6
LABELS = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, in order."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


class Node:
    """A candidate: its place, what it says, features, and its label if that is observed."""

    __slots__ = ("start", "end", "key", "features", "label", "named")

    def __init__(self, text: str, start: int, end: int, label: int | None):
        self.start, self.end, self.label = start, end, label
        body = text[start:end]
        spelt = "@" in body or re.search(r"[\[(]at[\])]", body, re.IGNORECASE) is not None
        digits = re.sub(r"[^0-9]", "", body)
        letters = sum(c.isalpha() for c in body)
        self.named = bool(letters) and not spelt and NAMED.search(text[max(0, start - 40) : start]) is not None
        if spelt:
            self.key = re.sub(r" ?[\[(]dot[\])] ?", ".", re.sub(r" ?(?:@|[\[(]at[\])]) ?", "@", body.lower())).replace(" ", "")
        else:
            self.key = body if letters else digits
        before = text[max(0, start - 24) : start].split()[-2:]
        after = text[end : end + 24].split()[:1] or [""]
        said = [
            f"spelt={spelt}", f"digits={min(len(digits), 20)}/{letters > 0}", f"plus={body[:1] == '+'}", f"dots={min(body.count('.'), 4)}",
            f"luhn={14 <= len(digits) <= 19 and luhn(digits)}", f"at={'@' in body}", f"gaps={min(len(re.findall('[ ().-]+', body)), 5)}",
            f"named={self.named}", f"mixed={letters > 0 and len(digits) > 2}/{min(len(body) // 8, 6)}",
            "before=" + " ".join(before).lower().strip(".,:;=\"'")[-12:], "after=" + after[0].lower().strip(".,:;=\"'")[:12], "bias",
        ]
        self.features = [zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS for s in said]


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """Candidates in order: the base spans, and what else looks like them and overlaps none."""
    out = [Node(text, s, e, 1 + k) for s, k, e in base]
    spans = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in spans]
    reach = np.maximum.accumulate([e for _, e in spans]).tolist() if spans else []

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(starts, e) - 1  # the last base span that starts before e
        return i < 0 or reach[i] <= s

    lower = text.lower()
    for m in NUMBER.finditer(text):
        # Numbers that stand side by side are one match: each piece between blanks counts too where the whole is too long.
        parts = [m.span()]
        if sum(c.isdigit() for c in m.group()) > 19:
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^ ]+", m.group())]
        out += [Node(text, s, e, None) for s, e in parts if 7 <= sum(c.isdigit() for c in text[s:e]) <= 19 and free(s, e)]
    if "(at" in lower or "[at" in lower:
        out += [Node(text, *m.span(), None) for m in SPELT.finditer(text) if free(*m.span())]
    for m in LONG_KEY.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if digits and digits < len(m.group()) and free(*m.span()):
            out.append(Node(text, *m.span(), None))
    out.sort(key=lambda n: (n.start, n.end))
    return out


def skip_keys(n: Node) -> set[str]:
    """What makes nodes repeat or resemble each other: the same content, mailbox, or last seven digits."""
    if "@" in n.key:
        return {n.key, n.key.split("@")[0] + "@"}
    return {n.key, "~" + n.key[-7:]} if n.key.isdigit() else {n.key}


def edges_of(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges, and skip edges: to the last and the first node that shares a key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    skip, last, first = set(), {}, {}
    for i, n in enumerate(nodes):
        for k in skip_keys(n):
            for seen in (last, first):
                if k in seen:
                    skip.add((seen[k], i))
            last[k] = i
            first.setdefault(k, i)
    return chain, sorted(skip)


class Field:
    """Weights of features (BUCKETS x LABELS) and of chain and skip edges (LABELS x LABELS)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """By loopy sum-product message passing; observed nodes hold their label."""
        n = len(nodes)
        own = np.array([self.unary[x.features].sum(axis=0) for x in nodes])
        for i, x in enumerate(nodes):
            if x.label is not None:
                own[i] = -30.0
                own[i, x.label] = 0.0
        chain, skip = edges_of(nodes)
        src = np.array([a for a, _ in chain + skip] + [b for _, b in chain + skip], np.int64)
        dst = np.array([b for _, b in chain + skip] + [a for a, _ in chain + skip], np.int64)
        m = len(chain) + len(skip)
        kind = np.array([0] * len(chain) + [1] * len(skip), np.int64)
        weight = np.stack([self.chain, self.skip])
        forward, backward = weight[kind], weight[kind].transpose(0, 2, 1)
        pair = np.concatenate([forward, backward]) if m else np.zeros((0, LABELS, LABELS))
        other = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        messages = np.zeros((2 * m, LABELS))
        for _ in range(ROUNDS if m else 0):
            total = own.copy()
            np.add.at(total, dst, messages)
            out = total[src] - messages[other]
            new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if change < 1e-3:
                break
        total = own.copy()
        np.add.at(total, dst, messages)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Base spans and those that the field adds, in order."""
        nodes = nodes_of(text, base)
        if all(n.label is not None for n in nodes):
            return base
        out = list(base)
        p = self.marginals(nodes)
        for n, own in zip(nodes, p):
            label = int(own.argmax())
            if n.label is None and label and own[label] >= SURE:
                out.append((n.start, label - 1, n.end))
        out.sort()
        return out


def rewritten(kind: int, body: str, rng: np.random.Generator) -> str:
    """A span in a form that the base rules don't find."""
    digits = re.sub(r"[^0-9]", "", body)
    if kind == 0:
        name, _, domain = body.partition("@")
        at = (" [at] ", "(at)", " (AT) ")[rng.integers(3)]
        return name + at + domain.replace(".", (" [dot] ", ".")[rng.integers(2)])
    if kind == 1:
        return body.replace(".", ("-", " ")[rng.integers(2)])
    if kind == 2:
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    cut = (" ", "-", ".")[rng.integers(3)]
    forms = (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", cut.join((tail[:3], tail[3:6], tail[6:])), cut.join((digits[:-10] or "1", tail[:3], tail[3:6], tail[6:])))
    return forms[rng.integers(3)]


def augmented(text: str, rng: np.random.Generator) -> tuple[str, dict[int, int]]:
    """The text with some of its base spans written again in other forms, and, beside each, a like one of other content.

    Also the labels of what was put in, by the place where it begins.
    """
    base, put = base_spans(text), []
    gaps = [m.end() for m in re.finditer(r"(?<=[a-z.,]) (?=[A-Za-z])", text)] or [len(text)]
    for s, k, e in base[:40]:
        body = rewritten(k, text[s:e], rng)
        other = re.sub(r"[0-9]", lambda m: str(rng.integers(10)), body)
        if k == 0:  # a spelt address is one whatever it says
            put.append((gaps[rng.integers(len(gaps))], body, 1 + k))
            continue
        put.append((gaps[rng.integers(len(gaps))], body, 1 + k))
        put.append((gaps[rng.integers(len(gaps))], other, 0))
    out, told, at, length = [], {}, 0, 0
    for place, body, label in sorted(put, key=lambda x: x[0]):
        piece = text[at:place] + " and "
        out += [piece, body, " then "]
        told[length + len(piece)] = label
        length += len(piece) + len(body) + 6
        at = place
    return "".join(out) + text[at:], told


def training_graph(text: str, rng: np.random.Generator) -> tuple[list[Node], list[int | None]]:
    """Nodes of the augmented text, and their labels. A node that resembles a labelled one, and wasn't put in, has none."""
    text, told = augmented(text, rng)
    nodes = nodes_of(text, base_spans(text))
    labels: list[int | None] = []
    sure = {k for n in nodes if n.label for k in skip_keys(n)}
    for n in nodes:
        if n.label is not None:
            labels.append(n.label)
        elif n.start in told:
            labels.append(told[n.start])
        elif n.named:
            labels.append(len(KINDS))
        else:
            labels.append(None if sure & skip_keys(n) else 0)
    return nodes, labels


def train(texts: list[str], seed: int = 1) -> Field:
    """Pseudo-likelihood by SGD on augmented texts; nodes of unknown label neither learn nor count as neighbours.

    A node's own features are hidden every other time, so that the potentials of edges are learned too.
    """
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    graphs = []
    for t in texts:
        nodes, y = training_graph(t, rng)
        if nodes:
            graphs.append((nodes, y, *edges_of(nodes)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for g in rng.permutation(len(graphs)):
            nodes, y, chain, skip = graphs[g]
            near: list[list[tuple[np.ndarray, int, bool]]] = [[] for _ in nodes]
            for edges, w in ((chain, field.chain), (skip, field.skip)):
                for a, b in edges:
                    if y[a] is not None and y[b] is not None:
                        near[a].append((w, b, True))
                        near[b].append((w, a, False))
            for i, n in enumerate(nodes):
                if y[i] is None:
                    continue
                shown = n.features if rng.random() < 0.5 else n.features[-1:]
                logits = field.unary[shown].sum(axis=0)
                for w, j, first in near[i]:
                    logits = logits + (w[:, y[j]] if first else w[y[j]])
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[y[i]] -= 1
                np.subtract.at(field.unary, shown, rate * p)
                for w, j, first in near[i]:
                    if first:
                        w[:, y[j]] -= rate * p
                    else:
                        w[y[j]] -= rate * p
    return field


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (how many these are).

    Counts and digest are of the base spans; spans holds these and what the field adds, as
    kind:start:end in code points. Null and empty texts have no spans. The field is trained on about
    `sample` documents (all, if there are fewer), in one task; texts are searched whole. The field's
    spans may have the kind secret, which comes after the others. Repeated rows get equal results, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text"))
    n = docs.count()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    some = src.where(part < int(1_000_000 * min(1.0, sample / max(1, n)))).where(F.col("text").rlike("[0-9@]")).dropDuplicates(["doc_id", "text"])

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((str(i), t) for b in batches for i, t in zip(*(c.to_pylist() for c in b.columns)))
        field = train([t for _, t in rows])
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()]) for x in (field.unary, field.chain, field.skip)], ["unary", "chain", "skip"])

    model = C.fitted(some, fit, "unary binary, chain binary, skip binary")
    shared = spark.sparkContext.broadcast([bytes(model[k]) for k in ("unary", "chain", "skip")])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*(np.frombuffer(x, np.float64).reshape(-1, LABELS) for x in shared.value))
        some_sign = re.compile("[0-9@]|[\\[(][aA][tT]")
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            counts, digests, told = [], [], []
            for text in b.column(1).to_pylist():
                if not some_sign.search(text):
                    counts.append((0, 0, 0, 0))
                    digests.append(empty)
                    told.append("")
                    continue
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                counts.append(tuple(kinds.count(k) for k in range(4)))
                digests.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(field.spans(text, base)))
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            n_spans = pa.array([t.count(",") + 1 if t else 0 for t in told], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(digests, pa.string()), pa.array(told, pa.string()), n_spans], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
