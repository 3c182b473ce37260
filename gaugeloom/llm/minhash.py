"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A shingle's 32-bit element is sent through one fixed permutation; a second permutation, shifted
circularly by k, gives coordinate k of the signature: min over elements of pi(sigma(x) + k mod 2^32).

A node is a set of shingles, whatever documents have it. Nodes that share a band meet in a bucket.
There each is compared with a leader, not with the others. What the leaders leave in different
components goes through two passes by bucket, in tiles of bounded size: sketches tell which nodes have
a possible partner in another component (a pair counts in the first bucket it shares), and the full sets of these few are compared through an
inverted index, each tile giving no more links than it has nodes. All links are confirmed on the
shingles of the texts themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Coordinates of a band; a pair at the threshold shares no band with a probability of MISS at most, which gives the number of bands.
ROWS, MISS = 6, 2e-7
#: One-byte sketches of so many coordinates; a pair whose estimate is under the threshold by MARGIN (over 5 deviations) isn't compared.
SKETCH, MARGIN = 160, 0.16
#: Rounds in which each member of a bucket is compared with one leader; members and shingles of a bucket in one tile after that.
LEADER_ROUNDS, TILE, TILE_SHINGLES = 2, 2048, 1 << 20


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair at the threshold is missed at most so often: (1 - similarity ** rows) ** bands."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


#: Elements that are sent through the second permutation at once: few enough for a core's own cache.
AT_ONCE = 48


def signature(elements: np.ndarray, k: int, _room: dict[int, tuple[np.ndarray, ...]] = {}) -> np.ndarray:  # noqa: B006
    """k coordinates from two permutations, the second circularly shifted."""
    if k not in _room:
        _room[k] = np.empty((AT_ONCE, k), np.uint32), np.empty((AT_ONCE, k), np.uint32), np.arange(k, dtype=np.uint32)
    room, spare, shifts = _room[k]
    sigma = elements.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    sigma = _pi(sigma, np.empty_like(sigma))
    best = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sigma), AT_ONCE):
        part = sigma[i : i + AT_ONCE, None]
        n = len(part)
        x = np.add(part, shifts, out=room[:n])
        np.minimum(best, _pi(x, spare[:n]).min(axis=0), out=best)
    return best


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased; bytes split at exactly the six blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], width: int) -> frozenset:
    """The set of shingles; fewer words than a shingle are one shingle, no words none."""
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(width))))


_WORDS: dict[bytes, int] = {}


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    known = _WORDS
    if len(known) > 400_000:
        known.clear()
    for w in {w for w in words if w not in known}:  # a set minus a dict's keys would go through all the keys
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(len(h), width)):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9)) if len(h) else out[:0]


def _signed(width: int, bands: int, rows: int):
    names = ["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        for b in batches:
            n_shingles, sets, keys, sketches = [], [], [], []
            for text in b.column(2).to_pylist():
                h = shingle_hashes(words_of(text), width)
                n_shingles.append(len(h))
                if not len(h):
                    sets.append(None)
                    keys.append(None)
                    sketches.append(None)
                    continue
                sets.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sig = signature((h >> np.uint64(32)).astype(np.uint32), bands * rows)
                mixed = sig.reshape(bands, rows).astype(np.uint64) * turn[None, :]
                mixed ^= mixed >> np.uint64(29)
                key = (mixed * np.uint64(0xBF58476D1CE4E5B9)).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                key ^= key >> np.uint64(32)
                keys.append(((key * np.uint64(0x94D049BB133111EB)) >> np.uint64(7) << np.uint64(7) | np.arange(bands, dtype=np.uint64)).view(np.int64))
                sketches.append((sig[:SKETCH] & np.uint32(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_shingles, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names)

    return run


def _confirm(width: int, percent: int):
    """Rows (a, b, text_a, text_b), sorted by a, to the pairs that are linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, frozenset()
        for batch in batches:
            linked = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                if last != a:
                    last, last_set = a, shingles_of(words_of(ta), width)
                other = shingles_of(words_of(tb), width)
                small, large = sorted((len(last_set), len(other)))
                if 100 * small < percent * large or not small:
                    continue
                both = len(last_set & other)
                if 100 * both >= percent * (small + large - both):
                    linked.append((a, b))
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*linked)], ["a", "b"])

    return run


def _by_tile(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that come sorted by (key, tile), as ((key, tile), the rows of one side or of two)."""
    at, group = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("key", "tile", *names))):
            if at != row[:2]:
                if group:
                    yield at, group
                at, group = row[:2], []
            group.append(row[2:])
    if group:
        yield at, group


def _sides(group: list[tuple]) -> tuple[list[tuple], list[tuple]] | None:
    """The two sides of a tile (the same one twice where a tile meets itself). A row: home, two, ..."""
    homes = sorted({g[0] for g in group})
    if group[0][1]:
        return tuple([g for g in group if g[0] == h] for h in homes) if len(homes) == 2 else None
    return group, group


def _tagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, sketch, bands) to the same with tags instead of bands: 32 bits of each band's key."""
    for b in batches:
        tags = [(np.array(keys, np.int64) >> 7).astype(np.uint32).tobytes() for keys in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(tags, pa.binary())], ["node", "n", "sketch", "tags"])


def _possible(percent: int):
    """Rows (key, tile, home, two, node, label, n, sketch, tags) to those nodes that may have a partner in another component.

    Two nodes that share several bands meet in each of these buckets. Only the first of them counts; tags
    tell whether there is an earlier one, wrongly with a probability of 2 ** -32 for a band.
    """
    floor = percent / 100 - MARGIN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, tile), group in _by_tile(batches, ["home", "two", "node", "label", "n", "sketch", "tags"]):
            if len({g[3] for g in group}) < 2 or (sides := _sides(group)) is None:
                continue
            left, right = sides
            band = key & 127
            codes = {x: i for i, x in enumerate({g[3] for g in group})}
            label = np.array([codes[g[3]] for g in right])
            size = np.array([g[4] for g in right], np.int64)
            sketch = np.frombuffer(b"".join(g[5] for g in right), np.uint8).reshape(len(right), -1)
            tags = np.frombuffer(b"".join(g[6] for g in right), np.uint32).reshape(len(right), -1)[:, :band]
            hit_right, hit_left = np.zeros(len(right), bool), np.zeros(len(left), bool)
            for i, g in enumerate(left):
                at = np.flatnonzero((label != codes[g[3]]) & (100 * np.minimum(size, g[4]) >= percent * np.maximum(size, g[4])))
                if len(at):
                    near = at[(sketch[at] == np.frombuffer(g[5], np.uint8)).mean(axis=1) >= floor]
                    near = near[~(tags[near] == np.frombuffer(g[6], np.uint32)[:band]).any(axis=1)]
                    hit_right[near] = True
                    hit_left[i] = len(near) > 0
            found = [g for g, h in zip(left, hit_left) if h]
            if left is not right:
                found += [g for g, h in zip(right, hit_right) if h]
            if found:
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([tile] * n, pa.int32()), pa.array([g[0] for g in found], pa.int32()), pa.array([g[1] for g in found]), pa.array([g[2] for g in found], pa.binary()), pa.array([g[3] for g in found], pa.binary())],
                    ["key", "tile", "home", "two", "node", "label"],
                )

    return run


def _links(percent: int):
    """Rows (key, tile, home, two, node, label, shingles) to a forest of links between components: fewer than nodes.

    An inverted index over the tile's shingles gives the sizes of all of a node's intersections at once.
    Of two nodes of different components, one isn't in the tile's most common component: only such nodes
    are looked up, until they belong to it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_tile(batches, ["home", "two", "node", "label", "shingles"]):
            up = {g[3]: g[3] for g in group}
            if len(up) < 2:
                continue

            def root(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            main = Counter(g[3] for g in group).most_common(1)[0][0]
            sets = [np.frombuffer(g[4], np.uint64) for g in group]
            size = np.array([len(x) for x in sets], np.int64)
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            out = []
            for g, own in zip(group, sets):
                if root(g[3]) == root(main):
                    continue
                low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                both = np.bincount(np.concatenate([owner[a:b] for a, b in zip(low.tolist(), high.tolist())]), minlength=len(group))
                for k in np.flatnonzero(100 * both >= percent * (size + len(own) - both)).tolist():
                    x, y = root(g[3]), root(group[k][3])
                    if x != y:
                        up[y] = x
                        out.append((g[2], group[k][2]) if g[2] < group[k][2] else (group[k][2], g[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"])

    return run


def _hashed(width: int):
    """(node, text) to (node, shingles: sorted 64-bit hashes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(words_of(t), width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, label (the smallest id reachable) of each of the nodes, by labels that travel and jump.

    Each round, a node takes the least label of its neighbours, and its label's own label. Rounds are
    tables, so no lineage grows; their number grows with the logarithm of a component's diameter.
    """
    both = C.stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = C.stored(nodes.select("id", F.col("id").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.id == near.a, "left").select("id", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        hooked = C.stored(hooked, "cc-hooked")
        # a root that a neighbour's label undercuts passes that on to all that carry it
        roots = hooked.groupBy(F.col("label").alias("at")).agg(F.min("next").alias("root"))
        merged = C.stored(hooked.join(roots, F.col("label") == F.col("at")).select("id", F.least("next", "root").alias("next"), "label"), "cc-merged")
        ahead = merged.select(F.col("id").alias("at"), F.col("next").alias("further"))
        jumped = C.stored(merged.join(ahead, F.col("next") == F.col("at")).select("id", F.least("next", "further").alias("next"), "label"), "cc-jumped")
        if jumped.where("next <> label").isEmpty():
            return jumped.select("id", "label")
        labels = jumped.select("id", F.col("next").alias("label"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Linked are documents of 100 * intersection >= percent * union of their sets of width-word shingles
    (A-Z lower-cased). Null, empty and blank texts have no shingles and link with nothing. Rows that
    repeat a doc_id belong together, and all their texts count. Rows of null doc_id belong to what has
    their very set, and otherwise have a null component_id and are kept. An empty table gives an empty
    result. Other columns are ignored. The number of bands follows from the threshold.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    bands = bands or bands_for(percent, rows)
    src = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text"))
    src = src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    id_type = src.schema["doc_id"].dataType.simpleString()
    if id_type not in ("bigint", "int", "string"):
        raise TypeError(f"{id_col} must be long, int or string, not {id_type}")
    signed = C.stored(src.mapInArrow(_signed(width, bands, rows), f"doc_id {id_type}, text_hash long, n_shingles long, node binary, bands array<long>, sketch binary"), "minhash-signed")
    full = signed.where("node is not null and doc_id is not null")
    # A node is a set; one of its documents, the smallest, stands for it.
    classes = C.stored(full.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select("node", F.col("m.doc_id").alias("rep"), F.col("m.text_hash").alias("rep_hash")), "minhash-classes")
    nodes = full.join(classes, "node").where("doc_id = rep and text_hash = rep_hash").select("node", "rep", "rep_hash", "n_shingles", "bands", "sketch")
    nodes = C.stored(nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("rep", "rep_hash", "n_shingles", "bands", "sketch")]), "minhash-nodes")
    # Sets of one doc_id belong together: a star about the least of them.
    repeated = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1")
    repeated = C.stored(repeated.select("doc_id", "a"), "minhash-repeated")
    same = full.select("doc_id", F.col("node").alias("b")).join(repeated, "doc_id").where("a <> b").select("a", "b").distinct()
    same = C.stored(same, "minhash-same-id")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # Buckets of two nodes or more, by the nodes' hashes, which take less to aggregate; then the members of these.
    hashed = keyed.select("key", F.xxhash64("node").alias("h")).groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    buckets = C.stored(hashed.where("low <> high").select("key"), "minhash-buckets")
    members = C.stored(keyed.join(buckets, "key"), "minhash-members")
    members = C.stored(members.join(members.groupBy("key").agg(F.min("node").alias("leader")), "key"), "minhash-led")
    pairs = C.stored(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "minhash-pairs")
    wanted = members.select("node").union(same.select(F.col("a").alias("node"))).union(same.select(F.col("b").alias("node"))).distinct()
    wanted = C.stored(wanted, "minhash-wanted")
    # Texts of the nodes in buckets: what a filter lets through, so that most texts are never shuffled.
    asked = nodes.select("node", "rep", "rep_hash").join(wanted, "node", "left_semi")
    some = C.split_by_id(src, "doc_id", asked.select(F.col("rep").alias("doc_id")))[1]
    known = some.join(asked.hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("node", "text")
    known = C.stored(known.groupBy("node").agg(F.min("text").alias("text")), "minhash-texts")

    def confirmed(p: DataFrame) -> DataFrame:
        with_b = C.stored(p.join(known.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"), "minhash-with-b")
        both = with_b.join(known.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        return C.stored(both.mapInArrow(_confirm(width, percent), "a binary, b binary"), "minhash-links")

    nodes_in = wanted.select(F.col("node").alias("id"))
    links = same.union(confirmed(pairs))
    done = pairs
    labels = components(links, nodes_in)
    for turn in range(1, LEADER_ROUNDS):
        # Buckets that still hold two components: another leader each, compared with the other components only.
        open_ = _open_members(members, labels, turn)
        more = open_.where("label <> lead_label").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        more = C.stored(more.join(done, ["a", "b"], "left_anti"), "minhash-pairs")
        links = links.union(confirmed(more))
        done = done.union(more)
        labels = components(links, nodes_in)
    open_ = _open_members(members, labels, 0)
    facts = nodes.select("node", F.col("n_shingles").alias("n"), "sketch", "bands").mapInArrow(_tagged, "node binary, n long, sketch binary, tags binary")
    dealt = C.stored(open_.select("key", "node", "label").join(facts, "node"), "minhash-dealt")
    sizes = dealt.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    dealt = dealt.join(C.stored(sizes, "minhash-tiles"), "key")
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, F.col("home")) * F.col("tiles") + F.greatest(t, F.col("home")))
    dealt = dealt.withColumn("tile", F.explode(meets)).withColumn("two", F.floor(F.col("tile") / F.col("tiles")) != F.pmod("tile", F.col("tiles")))
    possible = (
        dealt.select("key", "tile", "home", "two", "node", "label", "n", "sketch", "tags").repartition("key", "tile").sortWithinPartitions("key", "tile")
        .mapInArrow(_possible(percent), "key long, tile int, home int, two boolean, node binary, label binary")
    )
    possible = C.stored(possible, "minhash-possible")
    sets = known.join(possible.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_hashed(width), "node binary, shingles binary")
    found = (
        possible.join(C.stored(sets, "minhash-sets"), "node").select("key", "tile", "home", "two", "node", "label", "shingles")
        .repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_links(percent), "a binary, b binary").distinct()
    )
    links = links.union(confirmed(C.stored(found, "minhash-found")))
    labels = components(links, nodes_in)
    # document -> its set -> the set's component -> the smallest doc_id of the component
    labels = labels.withColumnRenamed("id", "node").join(classes.select("node", "rep"), "node")
    least = labels.groupBy("label").agg(F.min("rep").alias("component"))
    of_node = C.stored(labels.join(least, "label").select("node", "component"), "minhash-labels")
    of_node = C.stored(classes.join(of_node, "node", "left").select("node", F.coalesce("component", "rep").alias("component")), "minhash-of-node")
    out = signed.select("doc_id", "text_hash", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    if repeated.isEmpty():
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")
    # rows without shingles of a doc_id that also has a set belong to that set's component
    least_of = out.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(component).alias("least"))
    least_of = C.stored(least_of, "minhash-of-id")
    out = out.join(least_of, "doc_id", "left")
    component = F.coalesce("least", component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def _open_members(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Members of buckets of two components or more: key, node, label, and for this turn a leader and its label."""
    told = C.stored(members.select("key", "node").join(labels.withColumnRenamed("id", "node"), "node"), "minhash-told")
    lead = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("lead"), F.col("label").alias("lead_label"))
    open_ = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(lead).alias("l")).where("low <> high")
    open_ = C.stored(open_.select("key", "l.lead", "l.lead_label"), "minhash-leads")
    return C.stored(told.join(open_, "key"), "minhash-told")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns.

    All rows of that doc_id stay. Only rows that share a doc_id with a dropped one are shuffled.
    """
    told = near_dedup(docs, id_col, text_col, **options)
    return C.drop_rows(docs, C.stored(told.where("not kept").select("doc_id", "text_hash").distinct(), "minhash-dropped"), id_col, text_col)
