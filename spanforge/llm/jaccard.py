"""N-gram Jaccard join: MinHash LSH forest, then exact verification in tiles."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import dropped, stored, words
from spanforge.llm.embeddings import Forest
from spanforge.llm.exchange import mix, pack_sorted, unpack_sorted
from spanforge.llm.graph import components

_LOG = logging.getLogger(__name__)
_BASE = np.uint64(0x100000001B3)
#: Classes of a group that meet in a task, and their shingles where they are verified.
TILE, TILE_SHINGLES = 1024, 1 << 21
#: Values along a branch, a byte each: a branch is a 64-bit label, and labels sort as their trie.
DEEPEST = 8
#: Members of a large group stand behind a leader from which no more than this share differs.
NEAR = 0.1


def chance(similarity: float, depth: int, trees: int) -> float:
    """How likely a pair shares a prefix of `depth` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(seen: dict[int, int], depth: int, trees: int, threshold: float, target: float) -> tuple[int, float]:
    """(depth to go on with, recall measured) from the pairs that met at `depth`.

    seen: how often pairs of so many equal label bytes met. A pair of
    similarity s meets trees * s**depth times on average, which tells how many
    such pairs there are, met or not. The prefix is shortened until the least
    similar pairs that were seen (their estimate less two standard deviations,
    but not below the threshold) are found with the target recall.
    """
    size = trees * DEEPEST
    found = there = 0.0
    least = 1.0
    for agreeing, n in seen.items():
        s = max(threshold, agreeing / size)
        least = min(least, max(threshold, s - 2 * (s * (1 - s) / size) ** 0.5))
        pairs = n / (trees * s**depth)
        there += pairs
        found += pairs * chance(s, depth, trees)
    recall = found / there if there else 1.0
    while depth > 1 and chance(least, depth, trees) < target:
        depth -= 1
    return depth, recall


def shingle_sets(values: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a shorter one is a single shingle."""
    x = np.zeros(max(0, len(values) - n + 1), np.uint64)
    for j in range(n):
        x = x * _BASE + values[j : j + len(x)]
    x = mix(x)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(x[a : b - n + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = short * _BASE + values[k : k + 1]
            yield mix(short)
        else:
            yield np.zeros(0, np.uint64)


class Permutations:
    def __init__(self, trees: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        k = trees * DEEPEST
        self.a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)

    def labels(self, s: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """One label a tree: a byte of each least value along its branch, the first uppermost."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(s), chunk):
            least = np.minimum(least, (s[k : k + chunk, None] * self.a + self.b).min(axis=0))
        return (mix(least) >> np.uint64(56)).astype(np.uint8).view(">i8").astype(np.int64)


def prefix(label: Column, depth: int) -> Column:
    return F.shiftrightunsigned(label, 8 * (DEEPEST - depth)) if depth < DEEPEST else label


def tiled(members: DataFrame, group: list[str], tiles: Column, link: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """link(rows of a tile, rows of another, whether they are the same) for all pairs of a group's tiles.

    members has the columns of `group` and cls; `tiles` is their number in a group.
    """
    t = members.withColumn("_tiles", tiles.cast("int")).withColumn("_t", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("_tiles")).cast("int"))
    met = t.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda o: F.struct(F.least("_t", o).alias("i"), F.greatest("_t", o).alias("j")))).alias("_p"))
    met = met.select("*", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j")).drop("_p", "_tiles")

    def run(rows: pa.Table) -> pa.Table:
        i, j = rows["_i"][0].as_py(), rows["_j"][0].as_py()
        if i == j:
            return link(rows, rows, True)
        at = rows["_t"].to_numpy()
        return link(rows.filter(pa.array(at == i)), rows.filter(pa.array(at == j)), False)

    return met.groupBy(*group, "_i", "_j").applyInArrow(run, schema)


def _forest_edges(ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    forest = Forest(len(ids))
    for x, y in zip(p.tolist(), q.tolist(), strict=True):
        if forest.up[x] != forest.up[y]:
            forest.join(x, y)
    roots = np.array([forest.find(x) for x in range(len(ids))], np.int64)
    own = np.flatnonzero(roots != np.arange(len(ids)))
    return ids[own], ids[roots[own]]


#: An edge a-b; or a leader a of (tree, prefix); or how often pairs of `agreeing` equal bytes met.
_MET = "a long, b long, tree int, prefix long, agreeing int, n long"
_MET_KIND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("prefix", pa.int64()), ("agreeing", pa.int32()), ("n", pa.int64())])


def _met(edges: tuple[np.ndarray, np.ndarray], seen: np.ndarray, leaders: np.ndarray | None = None, group: tuple = (None, None)) -> pa.Table:
    at = np.flatnonzero(seen)
    parts = [{"a": edges[0], "b": edges[1]}, {"agreeing": at, "n": seen[at]}]
    if leaders is not None:
        parts.append({"a": leaders, "tree": [group[0]] * len(leaders), "prefix": [group[1]] * len(leaders)})
    made = []
    for p in parts:
        rows = len(next(iter(p.values())))
        made.append(pa.Table.from_arrays([pa.array(p[f.name], f.type) if f.name in p else pa.nulls(rows, f.type) for f in _MET_KIND], schema=_MET_KIND))
    return pa.concat_tables(made)


def _bytes_of(t: pa.Table) -> np.ndarray:
    """Label bytes, a row a class."""
    labels = t["labels"].combine_chunks()
    return labels.flatten().to_numpy().view(np.uint8).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1), np.uint8)


def _alike(rows: pa.Table, others: pa.Table, same: bool, need: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of pairs that agree in `need` bytes or more."""
    a, b = _bytes_of(rows), _bytes_of(others)
    ids = rows["cls"].to_numpy() if same else np.concatenate([rows["cls"].to_numpy(), others["cls"].to_numpy()])
    ps, qs = [], []
    for k in range(len(a)):
        start = k + 1 if same else 0
        equal = (b[start:] == a[k]).sum(axis=1)
        hit = np.flatnonzero(equal >= need)
        seen += np.bincount(equal[hit], minlength=len(seen))
        ps.append(np.full(len(hit), k))
        qs.append(hit + start + (0 if same else len(a)))
    return _forest_edges(ids, np.concatenate(ps), np.concatenate(qs)) if ps else (ids[:0], ids[:0])


def _behind_leaders(rows: pa.Table, near: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, their leaders, all leaders): a class that stands near no leader before it is one."""
    order = np.argsort(rows["cls"].to_numpy(), kind="stable")
    ids, sig = rows["cls"].to_numpy()[order], _bytes_of(rows)[order]
    left, of = np.arange(len(ids)), np.arange(len(ids))
    while len(left):
        equal = (sig[left] == sig[left[0]]).sum(axis=1)
        hit = equal >= near
        of[left[hit]] = left[0]
        seen += np.bincount(equal[hit][1:], minlength=len(seen))
        left = left[~hit]
    member = of != np.arange(len(ids))
    return ids[member], ids[of[member]], ids[~member]


def meet(classes: DataFrame, depth: int, trees: int, least: float, compared: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of _MET, the groups compared) of classes (cls, labels) at one depth of the forest.

    Classes of equal prefix in a tree are a group; a group that another tree
    has too, or that was compared at a greater depth, is left out. Up to TILE
    classes are compared all with all and leave a spanning forest of those that
    agree in a share of `least` or more. A larger group is cut into parts: in
    each, members stand behind leaders that all but equal them, by an edge
    each; then the leaders of all parts are compared, at a bound so much lower
    that no pair behind two of them is lost (the number of differing bytes is a
    metric). So a group of any size leaves an edge a member.
    """
    size = trees * DEEPEST
    need, near = int(np.ceil(least * size)), int(np.ceil((1 - NEAR) * size))
    apart = need - 2 * (size - near)
    branches = classes.select("cls", F.posexplode("labels").alias("tree", "label")).select("cls", "tree", prefix(F.col("label"), depth).alias("prefix"))
    groups = branches.groupBy("tree", "prefix").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("cls")).alias("_set")).where("_n > 1")
    groups = groups.groupBy("_n", "_set").agg(F.min("tree").alias("tree"), F.min_by("prefix", "tree").alias("prefix"))
    if compared is not None:
        groups = groups.join(compared.select("_n", "_set"), ["_n", "_set"], "left_anti")
    groups = stored(groups, "groups")
    part = F.when(F.col("_n") > TILE, F.pmod(F.xxhash64("cls", F.lit(3)), F.ceil(F.col("_n") / TILE))).otherwise(-1).cast("int")
    members = branches.join(groups, ["tree", "prefix"]).join(classes.select("cls", "labels"), "cls").withColumn("_part", part)

    def compare(t: pa.Table) -> pa.Table:
        seen = np.zeros(size + 1, np.int64)
        if t["_part"][0].as_py() < 0:
            return _met(_alike(t, t, True, need, seen), seen)
        member, leader, leaders = _behind_leaders(t, near, seen)
        return _met((member, leader), seen, leaders, (t["tree"][0].as_py(), t["prefix"][0].as_py()))

    def between(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        return _met(_alike(a, b, same, apart, np.zeros(size + 1, np.int64)), np.zeros(1, np.int64))

    inside = stored(members.groupBy("tree", "prefix", "_part").applyInArrow(compare, _MET), "met")
    leaders = inside.where("tree is not null").select(F.col("a").alias("cls"), "tree", "prefix")
    many = leaders.groupBy("tree", "prefix").agg(F.count("*").alias("_n"))
    headed = leaders.join(many, ["tree", "prefix"]).join(classes.select("cls", "labels"), "cls")
    out = stored(inside.where("tree is null").unionByName(tiled(headed, ["tree", "prefix"], F.ceil(F.col("_n") / TILE), between, _MET)), "met")
    dropped(inside)
    return out, groups


def candidates(classes: DataFrame, trees: int, threshold: float, recall: float, slack: float) -> DataFrame:
    """Edges (a, b) that connect every candidate pair: the forest, from its deepest prefixes up."""
    depth, compared, edges = DEEPEST, None, None
    while True:
        met, groups = meet(classes, depth, trees, threshold - slack, compared)
        found = met.where("a is not null").select("a", "b")
        edges = found if edges is None else edges.union(found)
        seen = {r.agreeing: r.n for r in met.where("n is not null").groupBy("agreeing").agg(F.sum("n").alias("n")).collect()}  # one row a byte of a signature
        further, measured = shortened(seen, depth, trees, threshold, recall)
        _LOG.info("depth %d: recall %.6f of pairs that agree in %.2f or more", depth, measured, threshold - slack)
        if further == depth:
            return edges
        depth = further
        compared = groups if compared is None else compared.union(groups)


_LINKS = pa.schema([("cls", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _verified(rows: pa.Table, others: pa.Table, same: bool, threshold: float) -> pa.Table:
    """Exact Jaccard of all pairs: links (in documents) of each class and a spanning forest."""
    load = lambda t: [unpack_sorted(r["shingles"], r["size"]) for r in t.select(["shingles", "size"]).to_pylist()]
    a = load(rows)
    b = a if same else load(others)
    ids = rows["cls"].to_numpy() if same else np.concatenate([rows["cls"].to_numpy(), others["cls"].to_numpy()])
    copies = rows["copies"].to_numpy() if same else np.concatenate([rows["copies"].to_numpy(), others["copies"].to_numpy()])
    shift = 0 if same else len(a)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # An inverted index over the second side; each row of the first adds up its hits.
    flat, owner = (np.concatenate(b), np.repeat(np.arange(len(b)), nb)) if b else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    ps, qs = [], []
    for k, s in enumerate(a):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(b))
        hit = np.flatnonzero(both >= threshold * (na[k] + nb - both) * (1 - 1e-12))
        hit = hit[(both[hit] > 0) & ((hit > k) if same else True)]
        ps.append(np.full(len(hit), k))
        qs.append(hit + shift)
    p, q = (np.concatenate(ps), np.concatenate(qs)) if ps else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    links = np.bincount(p, weights=copies[q], minlength=len(ids)) + np.bincount(q, weights=copies[p], minlength=len(ids))
    forest = Forest(len(ids))
    for x, y in zip(p.tolist(), q.tolist(), strict=True):
        if forest.up[x] != forest.up[y]:
            forest.join(x, y)
    roots = np.array([forest.find(x) for x in range(len(ids))], np.int64)
    own = np.flatnonzero(links > 0)
    return pa.table({"cls": ids[own], "root": ids[roots[own]] if len(own) else ids[:0], "links": links[own].astype(np.int64)}, schema=_LINKS)


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 32, recall: float = 0.9999, slack: float = 0.13, id_col: str = "doc_id", text_col: str = "text", seed: int = 5
) -> DataFrame:
    """One row for each document: its class and its number of links.

    Shingles are `n` consecutive words (a shorter text is one shingle). Texts
    of equal shingle sets are one class with its number of documents. A class has
    a label in each of `trees` trees, of DEEPEST MinHash values; classes of
    equal prefix meet, at the full depth first. From the pairs that met the
    recall is measured, and the prefix is shortened until it reaches `recall`;
    only groups that grow by this are compared again (see `meet`). Classes whose
    signatures agree to within `slack` of the threshold (four standard
    deviations) are connected; the components hold every candidate pair. Inside
    them all pairs are verified exactly in tiles, which return counts and
    forests, never pairs; a component of up to TILE classes is one tile.

    n_links: other documents with Jaccard >= threshold, copies included.
    class_id: the smallest id reachable by links; kept: the one row that
    stands for the class (of equal ids, the first by text hash; of repeated
    rows, all). Null text: empty; empty texts are copies of each other. Null
    ids sort last and have class_id null only if no other is reachable. Very
    long texts count whole. An empty table gives no rows; other columns are left out,
    whatever their names. Returns doc_id, class_id, n_links, kept, text_hash.
    """
    perms = Permutations(trees, seed)
    hashed = F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), hashed.alias("h"))

    def flat(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        col = b.column(k)
        offsets = col.offsets.to_numpy()
        return col.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, labels, size = [], [np.zeros(0, np.int64)], []
            for s in shingle_sets(*flat(b, 2), n):
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                labels.append(perms.labels(s))
                size.append(len(s))
            held = pa.ListArray.from_arrays(np.arange(0, trees * len(cls) + 1, trees, dtype=np.int32), pa.array(np.concatenate(labels)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(cls, np.uint64).view(np.int64)), held, pa.array(size, pa.int64())], names=["doc_id", "th", "cls", "labels", "shingles"])

    signed = stored(base.mapInArrow(sign, "doc_id long, th long, cls long, labels array<long>, shingles long"), "signatures")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    classes = stored(signed.groupBy("cls").agg(F.min(ident).alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("shingles").alias("shingles")), "classes")
    clusters = components(candidates(classes.select("cls", "labels"), trees, threshold, recall, slack)).withColumnRenamed("node", "cls")
    wanted = clusters.join(classes.select("cls", "rep.doc_id", "rep.th", "copies", "shingles"), "cls")
    sizes = wanted.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("shingles") / TILE_SHINGLES)).cast("int").alias("_n"))
    wanted = wanted.join(sizes, "component").drop("shingles").withColumnRenamed("th", "_th").withColumnRenamed("doc_id", "_id")
    texts = base.join(wanted, (F.coalesce("doc_id", F.lit(-(2**63))) == F.coalesce("_id", F.lit(-(2**63)))) & (F.col("th") == F.col("_th")))
    texts = texts.select("cls", "component", "_n", "copies", "h")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pack_sorted(s) for s in shingle_sets(*flat(b, 4), n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([p for p, _ in packed], pa.binary()), pa.array([s for _, s in packed], pa.int32())], names=["cls", "component", "_n", "copies", "shingles", "size"])

    held = texts.mapInArrow(sets, "cls long, component long, _n int, copies long, shingles binary, size int").dropDuplicates(["cls"])
    found = stored(tiled(held, ["component"], F.col("_n"), lambda a, b, same: _verified(a, b, same, threshold), "cls long, root long, links long"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(found, "cls", "root").withColumnRenamed("node", "cls")
    named = classes.select("cls", "rep", "copies").join(linked, "cls", "left").withColumn("c", F.coalesce("component", "cls"))
    first = named.groupBy("c").agg(F.min("rep").alias("head"))
    known = named.join(first, "c").join(links, "cls", "left").select("cls", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "th", "cls").join(known, "cls")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))
    return out.select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), kept.alias("kept"), F.col("th").alias("text_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with one row of each class of near duplicates (of repeated rows, one)."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **params).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.count("*").alias("_times"))
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (text == F.col("_th")), "inner")
    repeated = found.where("_times > 1").limit(1).count() > 0
    kept = out.select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept
