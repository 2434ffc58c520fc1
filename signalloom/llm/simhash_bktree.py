"""SimHash near-duplicates, linked by BK-trees over shards of fingerprints.

Two 64-bit fingerprints within three differing bits agree in at least two of five blocks of
bits, so a shard is the set of fingerprints that agree in one pair of blocks: ten shards hold
each fingerprint, and every link lies inside at least one. The same holds for three of six blocks,
four of seven and so on; the more fingerprints there are, the more blocks are taken, so that
shards stay small by longer keys. Shards follow their key through one exchange; each is indexed by a BK-tree whose children are keyed by their Hamming distance to
the parent, and a search follows only edges within the radius. Shards above ``TREE_NODES`` are
cut into trees of bounded size and every pair of parts meets in one block, so neither a tree
nor a task grows with a shard. A block returns a spanning star for each of its linked groups,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, by_key, documents, materialise, packed, quoted, utf8
from .components import components

WORDS = 3
RADIUS = 3
SEED = 42
TREE_NODES = 2048
#: Fingerprints in a shard, on average, above which longer keys are taken.
SHARD_NODES = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = WORDS, distinct: bool = False) -> int:
    """SimHash of UTF-8 text: lower-cased A-Z, words between ASCII white space, shingles with
    repeats (or each once), XXH64 with seed 42. A text of fewer words is one shingle; one of none is zero."""
    seq = text.translate(_LOWER).split()
    if not seq:
        return 0
    count, ones, seen = 0, np.zeros(64, np.int64), set()
    for part in _shingles(seq, words):
        if distinct:
            part = set(part) - seen
            seen |= part
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(part)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _shingles(seq: list[bytes], words: int) -> Iterator[list[bytes]]:
    """The shingles of a sequence, or the whole of a shorter one, some at a time."""
    if len(seq) < words:
        yield [b" ".join(seq)]
        return
    for i in range(0, len(seq) - words + 1, _CHUNK):
        part = seq[i : i + _CHUNK + words - 1]
        yield list(map(b" ".join, zip(*(part[j:] for j in range(words))))) if words > 1 else part


def _fingerprint_batches(words: int, distinct: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words, distinct) for t in utf8(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return made


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distinct: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return arrow_map(rows, _fingerprint_batches(words, distinct), "doc_id long, text_hash long, fp long")


class BKTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent."""

    __slots__ = ("root", "children")

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def search(self, value: int, radius: int) -> list[int]:
        """All members within the radius: an edge is followed only if the triangle inequality lets it hold one."""
        if self.root is None:
            return []
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if -radius <= edge - d <= radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = value
            self.children[value] = {}
            return
        node = self.root
        while d := (node ^ value).bit_count():
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = value
                self.children[value] = {}
                return
            node = below


class _Groups:
    """Union-find over the values of one block."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


_MASK = (1 << 64) - 1


def _block_links(members: list[int], others: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning star of each linked group in one block: members among themselves if there are
    no others, else the others against the members' tree."""
    tree, groups = BKTree(), _Groups()
    for m in members:
        if not others:
            for hit in tree.search(m, radius):
                groups.join(m, hit)
        tree.add(m)
    for q in others:
        for hit in tree.search(q, radius):
            groups.join(q, hit)
    return [(x, groups.find(x)) for x in list(groups.up) if groups.find(x) != x]


def _signed(xs: list[int]) -> pa.Array:
    return pa.array(np.array(xs, np.uint64).view(np.int64))


def _link_batches(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, others, diagonal = None, [], [], True
        out: list[tuple[int, int]] = []
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("band", "key", "low", "high", "part")]
            for band, key, low, high, part, fp in zip(*keys, batch.column("fp").to_pylist()):
                if at != (band, key, low, high):
                    if len(members) > diagonal and (diagonal or others):
                        out += _block_links(members, others, radius)
                    at, members, others, diagonal = (band, key, low, high), [], [], low == high
                (members if part == low else others).append(fp & _MASK)
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([_signed([x for x, _ in out]), _signed([y for _, y in out])], names=["a", "b"])
                out = []
        if len(members) > diagonal and (diagonal or others):
            out += _block_links(members, others, radius)
        yield pa.RecordBatch.from_arrays([_signed([x for x, _ in out]), _signed([y for _, y in out])], names=["a", "b"])

    return links


def shard_masks(n: int, radius: int) -> list[int]:
    """The bits of each shard key for n fingerprints: 64 bits are cut into blocks, and within the
    radius all but ``radius`` of them agree. Two more blocks than the radius at least, and one
    more until a key leaves a shard about ``SHARD_NODES`` of n uniform fingerprints."""
    blocks = radius + 2
    while blocks < radius + 6 and n >> (64 * (blocks - radius) // blocks) > SHARD_NODES:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span every group linked within
    the radius. The wider it is, the more shards hold each fingerprint; 8 is the most allowed.
    Repeated fingerprints count once; null ones and an empty table have no edges."""
    if not 0 <= radius <= 8:
        raise ValueError("radius must be from 0 to 8")
    masks = shard_masks(fps.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bands = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("band", "key"))
    sizes = bands.groupBy("band", "key").count().where("count > 1")
    shared = bands.join(by_key(sizes), ["band", "key"]).withColumn("parts", F.expr(f"cast(ceil(count / {int(tree_nodes)}) as int)"))
    blocks = (
        shared.withColumn("part", F.expr("cast(pmod(xxhash64(fp, 7), parts) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fp")
    )
    dealt = blocks.repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high", "fp")
    return arrow_map(dealt, _link_batches(radius), "a long, b long").distinct()


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a partner; others are left out."""
    distinct = materialise(fps.select("fp").distinct(), "distinct")
    return components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id that links of at most ``radius`` differing bits reach,
    itself included. Null text is an empty one, and texts without words all have fingerprint
    zero. Repeated rows each return a row; a null doc_id stays null and never names a component
    that has another id. Other columns, whatever their names, are ignored. An empty table gives
    an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = firsts.join(by_key(linked_fingerprints(fps, radius)), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = materialise(roots, "roots")
    least = roots.where("root = fp").select("root").join(by_key(roots.groupBy("root").agg(F.min("first").alias("component_id"))), "root")
    named = roots.join(by_key(least), "root").select("fp", "component_id")
    return fps.join(by_key(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Likeness of near copies: their distinct five-word shingles have at least 4/5 in common.
LIKE_WORDS, LIKE = 5, (4, 5)
#: Candidates for that: fingerprints of distinct words, which an edit changes less than shingles.
CANDIDATE_WORDS, CANDIDATE_RADIUS = 1, 7


def shingle_set(text: bytes, words: int = LIKE_WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    seq = text.translate(_LOWER).split()
    parts = [np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part)) for part in _shingles(seq, words)] if seq else []
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have ``LIKE`` of their union in common; empty ones have."""
    small, large = sorted((len(a), len(b)))
    if small * LIKE[1] < large * LIKE[0]:
        return False
    if not small:
        return True
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[at] == b).sum())
    return common * LIKE[1] >= (len(a) + len(b) - common) * LIKE[0]


def _first_hashes(x: np.ndarray) -> list[int]:
    """So many of the least hashes that two sets alike share one at least."""
    return x[: len(x) - -(-len(x) * LIKE[0] // LIKE[1]) + 1].tolist()


def _alike_stars(members: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning star of each group of alike sets in one block: members among themselves if there
    are no others, else the others against the members. Sets meet by the least of their hashes."""
    groups, index, empty = _Groups(), {}, None
    for k, (node, x) in enumerate(members):
        if not others:
            _meet(groups, index, members, node, x)
        if not len(x):
            if empty is not None:
                groups.join(node, empty)
            empty = node
        for h in _first_hashes(x) if len(x) else ():
            index.setdefault(h, []).append(k)
    for node, x in others:
        _meet(groups, index, members, node, x)
        if not len(x) and empty is not None:
            groups.join(node, empty)
    return [(x, groups.find(x)) for x in list(groups.up) if groups.find(x) != x]


def _meet(groups: _Groups, index: dict[int, list[int]], members: list[tuple[int, np.ndarray]], node: int, x: np.ndarray) -> None:
    for k in {k for h in _first_hashes(x) for k in index.get(h, ())} if len(x) else ():
        if groups.find(node) != groups.find(members[k][0]) and alike(members[k][1], x):
            groups.join(node, members[k][0])


def _verified_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by (root, low, high): links between the alike ones of each block."""
    at, members, others, last = None, [], [], None
    out: list[tuple[int, int]] = []
    for batch in batches:
        for root, low, high, part, node, text in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "part", "node")), utf8(batch.column("text"))):
            if at != (root, low, high):
                if at and (at[1] == at[2] or others):
                    out += _alike_stars(members, others)
                at, members, others, last = (root, low, high), [], [], None
            if node != last:  # a row that is there twice
                (members if part == low else others).append((node, shingle_set(text)))
            last = node
        if len(out) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            out = []
    if at and (at[1] == at[2] or others):
        out += _alike_stars(members, others)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


#: Texts of one block of a candidate group, on average.
BLOCK_TEXTS = 1024


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group of alike texts the row with the least doc_id stays.

    Two texts are alike if their distinct five-word shingles have at least 0.8 of their union in
    common (a text of fewer words is one shingle); groups are what such links reach. BK-trees over
    SimHashes of distinct words find candidates within seven bits; every candidate group's texts
    are then compared by their shingles, in blocks of bounded size where it has many.

    A row is known by doc_id and text, so one without doc_id loses to one with it, and different
    rows that repeat a doc_id are told apart. Of rows that are equal in both, one stays. Null,
    empty and word-less texts are one group. An empty table gives an empty one.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, CANDIDATE_WORDS, True), "fingerprints")
    roots = linked_fingerprints(fps, CANDIDATE_RADIUS)
    # one row for each text: its least document
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    texts = fps.groupBy("fp", "text_hash").agg(least).join(by_key(roots), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "text_hash", "first")
    texts = materialise(texts.withColumn("node", F.xxhash64("text_hash", "first")), "texts")
    several = texts.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int").alias("parts"))
    candidates = texts.join(by_key(several), "root").select("root", "node", "parts", *_key(F.col("first.doc_id"), F.col("text_hash")))

    key = ["id", "none", "hash"]
    keyed = packed(docs, x=F.struct(*_key(quoted(id_col).cast("long"), F.xxhash64(quoted(text_col)))), text=quoted(text_col)).select("row", "text", "x.*")
    found = keyed.select("text", *key).join(by_key(candidates), key)
    blocks = (
        found.withColumn("part", F.expr("cast(pmod(xxhash64(node, 11), parts) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "text")
    )
    dealt = blocks.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node")
    groups = components(arrow_map(dealt, _verified_batches, "a long, b long").distinct())

    named = texts.join(by_key(groups.withColumnRenamed("root", "of")), "node", "left").select(F.coalesce("of", "node").alias("of"), F.struct("first.none", "first.doc_id", "text_hash").alias("first"))
    kept = named.groupBy("of").agg(F.min("first").alias("first")).select(*_key(F.col("first.doc_id"), F.col("first.text_hash")))
    # the join and the removal of equal rows share their keys, so the texts are exchanged once for both;
    # rows travel as one struct, so their columns may have any name
    left = keyed.select("row", *key).join(by_key(kept), key, "left_semi")
    return left.groupBy(*key).agg(F.first("row").alias("row")).select("row.*")


def _key(doc_id: Column, text_hash: Column) -> list[Column]:
    """A row's identity, without nulls."""
    return [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), text_hash.alias("hash")]


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op3_simhash_bktree": op3_simhash_bktree}
ORACLE_SQL: dict[str, str] = {}
