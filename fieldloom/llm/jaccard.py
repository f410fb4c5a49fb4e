"""N-gram Jaccard join with count-vector R-trees.

A document's set holds its distinct word shingles as 64-bit hashes. Equal sets
share one representative, so exact copies cost one row each.

Two linked sets share one of the first n - ceil(t * n) + 1 hashes of each in
any order that all sets use. These hashes are a set's keys: only members of one
key can link. The order puts hashes of frequent cells last (a table of CELLS
counters over all shingles of all documents), so common passages make no keys
where a set has anything rarer.

The members of a key are points: the counts of their hashes in GROUPS groups.
Their R-tree is built in the task that holds the key and joined with itself:
the sum of coordinate minima bounds the overlap of two boxes and of two points,
and pairs below the overlap needed, or already in one component, are left out.
Of the others each point sends its best few (by the bound) to a second bound
by finer counts (large sets only) and then to the exact test on the sets; linked pairs join components. This is repeated with sixteen times as
many until no point has more than it sent. So every pair that could join two
components has been tested, while a large group of near copies costs a few
pairs per member. A key with more than BLOCK members is joined block by block,
and while a tree is walked a task holds its points' best pairs and at most
PAIRS others.

Null text and texts without words have an empty set and link with nothing; a
text of fewer words than a shingle has its whole sequence as one. Repeated rows
are exact copies. Rows with a null id keep a null component and link nothing.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import A, UNBOUNDED, Cache, hashed_words, mix, settings, sliced, table_cut

GROUPS, CELLS, LEAF, BLOCK, FEW, PAIRS = 128, 1 << 16, 32, 4096, 8, 200_000
FILTER = {
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "0",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1TB",
    "spark__sql__optimizer__runtime__bloomFilter__maxNumBits": "67108864",
}


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles) of a text column."""
    for lo, hi, _, places, _, _, h in hashed_words(column, fold=True):
        whole = np.full(max(0, len(h) - k + 1), k, np.uint64)
        for i in range(k if len(whole) else 0):
            whole = mix((whole ^ h[i : i + len(whole)]) * A)
        for row, p, q in zip(range(lo, hi), places.tolist(), places[1:].tolist()):
            if q - p >= k:
                yield row, np.unique(whole[p : q - k + 1])
            else:
                short = np.full(int(q > p), q - p, np.uint64)
                for w in h[p:q]:
                    short = mix((short ^ w) * A)
                yield row, short


def cell_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(48)).astype(np.int64)


def cell_levels(docs: DataFrame, k: int) -> np.ndarray:
    """How much fuller than the usual each cell is, as powers of two; cells hold the shingles of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for b in batches:
            for _, s in shingle_sets(b.column("raw"), k):
                counts += np.bincount(cell_of(s), minlength=CELLS) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(counts, cell_of(s), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    counts = np.zeros(CELLS)
    for r in docs.select("raw").mapInArrow(sliced(run), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return np.ceil(np.log2(np.maximum(counts / max(1.0, float(np.median(counts))) - 0.25, 1))).astype(np.uint8)


def need(a, b, percent: int):
    """100 + percent times the least overlap of linked sets of a and b elements."""
    return percent * (a + b)


def packed_counts(s: np.ndarray, groups: int = GROUPS) -> bytes:
    c = np.bincount(((s >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return c.astype("<u1" if c.max() < 256 else "<u4").tobytes()


def fine_counts(s: np.ndarray) -> bytes | None:
    """Counts in more groups, one for four hashes or so; None for sets that have enough with GROUPS."""
    times = (max(0, len(s) - 1) // (4 * GROUPS)).bit_length()
    return packed_counts(s, GROUPS << times) + bytes([times]) if times else None


def fine_bound(a: bytes, b: bytes) -> int:
    """The bound from fine counts; the finer ones are summed up to the groups of the other set."""
    def read(x: bytes) -> np.ndarray:
        groups = GROUPS << x[-1]
        return np.frombuffer(x[:-1], "<u1" if len(x) == groups + 1 else "<u4").astype(np.int64)

    x, y = sorted((read(a), read(b)), key=len)
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(0)).sum())


def unpacked_counts(column: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(c, "<u1" if len(c) == GROUPS else "<u4").astype(np.int32) for c in column])


def sets(docs: DataFrame, levels: np.ndarray, percent: int, k: int) -> DataFrame:
    """(row, doc_id, text_hash, n, digest, counts, fine, keys) per row of docs(doc_id, text_hash, raw); a task that meets a set again leaves its keys out."""
    schema = "row bigint, doc_id bigint, text_hash bigint, n bigint, digest binary, counts binary, fine binary, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, at = Cache(lambda d: False), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rows = b.column("doc_id"), np.arange(at, at + b.num_rows)
            at += b.num_rows
            n, digests, counts, fine, keys, known = [], [], [], [], [], ids.is_valid().to_pylist()
            for row, s in shingle_sets(b.column("raw"), k):
                n.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest())
                counts.append(packed_counts(s))
                fine.append(fine_counts(s))
                first = s[:0]
                if len(s) and known[row] and not met[digests[-1]]:
                    met[digests[-1]] = True
                    many = len(s) + (-percent * len(s)) // 100 + 1
                    level = levels[cell_of(s)]
                    first = s[np.argsort(level, kind="stable")[:many]]
                keys.append(first.view(np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            columns = [pa.array(rows), ids, b.column("text_hash"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.binary()), pa.array(fine, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "text_hash", "n", "digest", "counts", "fine", "keys"])

    return docs.mapInArrow(sliced(run), schema)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) in order, those whose key has two nodes or more, once each."""
    key, node, again = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for b in batches:
        key = np.append(key, b.column("key").to_numpy())
        node = np.append(node, b.column("node").to_numpy())
        if not len(key):
            continue
        fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node = key[fresh], node[fresh]
        before = np.append(again, key[1:] == key[:-1])
        out = (before | np.append(before[1:], False))[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out]), pa.array(node[:-1][out])], names=["key", "node"])
        key, node, again = key[-1:], node[-1:], bool(before[-1])
    if again:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])


class Tree:
    """An R-tree over count vectors, filled by halving at the widest coordinate; a box keeps its upper corner, the least size and the components inside."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray, n: np.ndarray, comp: np.ndarray):
        self.rows, self.top, self.least = rows, counts[rows].max(0), int(n[rows].min())
        own = comp[rows]
        self.comp = own[0] if (own == own[0]).all() else None
        self.parts: list[Tree] = []
        if len(rows) > LEAF:
            widest = int(np.ptp(counts[rows], axis=0).argmax())
            order = rows[np.argsort(counts[rows, widest], kind="stable")]
            self.parts = [Tree(part, counts, n, comp) for part in np.array_split(order, 2)]


def tree_pairs(x: Tree, y: Tree, counts: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, bounds) of pairs from x and y of different components that pass the bound; of x with itself each pair twice."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        if x.comp is not None and x.comp == y.comp or (100 + percent) * int(np.minimum(x.top, y.top).sum()) < need(x.least, y.least, percent):
            continue
        if x.parts or y.parts:
            todo += [(p, q) for p in x.parts or [x] for q in y.parts or [y]]
            continue
        bound = np.minimum(counts[x.rows][:, None], counts[y.rows][None]).sum(2)
        i, j = np.nonzero((comp[x.rows][:, None] != comp[y.rows][None]) & ((100 + percent) * bound >= need(n[x.rows][:, None], n[y.rows][None], percent)))
        yield x.rows[i], y.rows[j], bound[i, j]


class Best:
    """Pairs of rows with bounds, of which only those among the best `most` of either row are held once there are PAIRS more; groups that lost one are known."""

    def __init__(self, group: np.ndarray, node: np.ndarray, most: int):
        self.group, self.node, self.most = group, node, most
        self.parts, self.size, self.limit, self.cut = [], 0, PAIRS, np.zeros(0, np.int64)

    def add(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> None:
        self.parts.append((left.astype(np.int32), right.astype(np.int32), bound.astype(np.int32)))
        self.size += len(left)
        if self.size > self.limit:
            self.trim()
            self.limit = self.size + PAIRS

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int32)
        left, right, bound = (np.concatenate([none, *x]) for x in (zip(*self.parts) if self.parts else ((), (), ())))
        row, other, at = np.append(left, right), np.append(right, left), np.tile(np.arange(len(left), dtype=np.int32), 2)
        order = np.lexsort((self.node[other], -np.tile(bound, 2), row))
        row = row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else none
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = np.zeros(len(left), bool)
        keep[at[order[rank < self.most]]] = True
        self.cut = np.union1d(self.cut, self.group[left[~keep]])
        self.parts, self.size = [(left[keep], right[keep], bound[keep])], int(keep.sum())
        return self.parts[0]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, rows and whether their group has more."""
        left, right, _ = self.trim()
        return left, right, np.isin(self.group[left], self.cut)


def group_pairs(group: np.ndarray, leaf: np.ndarray, counts: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int, best: Best) -> None:
    """Pairs of rows of one group (and of different leaves, if it has two) with their bounds, to best; groups are consecutive. Small groups are compared all at once, larger ones by trees."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(group)))
    small = np.repeat(size <= FEW, size)
    for step in range(1, FEW):
        i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if len(group) > step else np.zeros(0, np.int64)
        for at in range(0, len(i), 20_000):
            p = i[at : at + 20_000]
            q = p + step
            both = np.minimum(counts[p], counts[q]).sum(1)
            ok = (comp[p] != comp[q]) & ((100 + percent) * both >= need(n[p], n[q], percent))
            best.add(p[ok], q[ok], both[ok])
    for s, m in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
        rows = np.arange(s, s + m)
        parts = [rows[leaf[rows] == v] for v in np.unique(leaf[rows])]
        trees = [Tree(p, counts, n, comp) for p in parts]
        for i, j, both in tree_pairs(trees[0], trees[-1], counts, n, comp, percent):
            ok = i < j if len(parts) == 1 else np.full(len(i), True)
            best.add(i[ok], j[ok], both[ok])


def _candidates(percent: int, most: int):
    names = ["key", "lo", "hi", "leaf", "node", "comp", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> pa.RecordBatch:
            key, lo, hi, leaf, node, comp, n = (t.column(c).to_numpy() for c in names)
            group = np.append(0, np.cumsum((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            best = Best(group, node, most)
            group_pairs(group, leaf, unpacked_counts(t.column("counts").to_pylist()), n, comp, percent, best)
            i, j, more = best.pairs()
            return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(more)], names=["key", "a", "b", "more"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            same = np.ones(b.num_rows, bool)
            for c in names[:3]:
                x = b.column(c).to_numpy()
                same &= x == x[-1]
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last or held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in names[:3]):
                yield work(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def candidates(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(key, a, b, more): pairs of one key and different comp that pass the bound, the best `most` of either end, and whether the key has more; members(key, leaves, node, comp, n, counts)."""
    met = members.withColumn("leaf", F.pmod(F.xxhash64("node"), "leaves")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("leaves") - 1)))
    met = met.select("key", F.least("leaf", "other").alias("lo"), F.greatest("leaf", "other").alias("hi"), "leaf", "node", "comp", "n", "counts")
    return met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "leaf").mapInArrow(sliced(_candidates(percent, most), 10_000), "key bigint, a bigint, b bigint, more boolean")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([pack(x) for x in b.column("raw").to_pylist()], pa.binary())], names=["node", "raw"])


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("na", "nb", "fa", "fb")))
            keep = pa.array([x is None or y is None or (100 + percent) * fine_bound(x, y) >= need(n, m, percent) for n, m, x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def _verify(percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        of = lambda x: next(shingle_sets(pa.array([unpack(x)], pa.binary()), k))[1]
        last: dict = {}
        for b in batches:
            keep = []
            for a, x, y in zip(b.column("a").to_pylist(), b.column("ra").to_pylist(), b.column("rb").to_pylist()):
                if a not in last:
                    last = {a: of(x)}
                s, t = last[a], of(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) with the least node reachable, for all nodes with an edge of edges(a, b).

    Each node joins its least neighbour, if that is less; then edges lie between the joined nodes,
    once each, and those inside one go. This is repeated until none is left, so edges become fewer each time.
    """
    side = lambda x: F.col(x).alias("node")
    label, left = None, table_cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        near = left.select(side("a"), F.col("b").alias("other")).union(left.select(side("b"), F.col("a").alias("other")))
        step = table_cut(near.groupBy("node").agg(F.least("node", F.min("other")).alias("to")))
        if label is None:
            label = step.select("node", F.col("to").alias("comp"))
        else:
            label = table_cut(label.join(step.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        end = lambda x: step.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to"))  # noqa: B023,E731
        moved = left.join(end("a"), "a").join(end("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        left = table_cut(moved.where("a < b").distinct())
        if left.limit(1).count() == 0:
            return label


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links(a, b): only links between the former components are followed."""
    if comp is None:
        return components(links)
    end = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_in"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    new = components(between)
    old = comp.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return table_cut(old.unionByName(new.join(comp.select("node"), "node", "left_anti")))


def linked_components(docs: DataFrame, nodes: DataFrame, members: DataFrame, percent: int, k: int) -> DataFrame | None:
    """(node, comp) of all linked nodes; nodes(node, doc_id, text_hash, n, counts, fine), members(key, leaves, node), docs(doc_id, text_hash, raw); None without a link."""
    comp, tested, sides, texts, most = None, None, None, None, 1
    points = nodes.select("node", "n", "counts")
    while True:
        now = members.withColumn("comp", F.col("node"))
        if comp is not None:
            now = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            now = now.join(now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key"), "key")
        found = table_cut(candidates(now.join(points, "node"), percent, most))
        if sides is None:
            # later rounds meet no node without a pair now
            sides = table_cut(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "text_hash", "n", "fine"), "node"))
        pairs = found.select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = table_cut(pairs)
        side = lambda x: sides.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
        near = table_cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(_bounded(percent), "a bigint, b bigint"))
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = sides.select("node", "doc_id", "text_hash").join(wanted if texts is None else wanted.join(texts, "node", "left_anti"), "node")
        wanted = table_cut(wanted).where("doc_id is not null")
        with settings(docs.sparkSession, **FILTER):
            more = table_cut(docs.join(wanted, ["doc_id", "text_hash"]).select("node", "raw").mapInArrow(_compressed, "node bigint, raw binary").dropDuplicates(["node"]))
        texts = more if texts is None else texts.union(more)
        text = lambda x: texts.select(F.col("node").alias(x), F.col("raw").alias(f"r{x}"))
        new = table_cut(near.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ra", "rb").mapInArrow(sliced(_verify(percent, k)), "a bigint, b bigint"))
        tested = pairs if tested is None else tested.union(pairs)
        if new.limit(1).count():
            comp = merged(comp, new)
        # all pairs of the other keys have been tested
        left = found.where("more").select("key").distinct()
        if left.limit(1).count() == 0:
            return comp
        members = table_cut(members.join(left, "key"))
        most *= 16


def grouped(docs: DataFrame, percent: int = 85, k: int = 4) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, leader) per row of docs(doc_id, text).

    leader is true for the rows of a component with its least (doc_id, text_hash), so for one text of
    each component (in equal rows, if it is repeated), and for rows that link with nothing.
    """
    raw = F.col("text").cast("binary")
    docs = docs.select("doc_id", F.xxhash64(raw).alias("text_hash"), raw.alias("raw"))
    with settings(docs.sparkSession, **UNBOUNDED):
        all_sets = table_cut(sets(docs, cell_levels(docs, k), percent, k))
        whole = all_sets.where("n > 0 and doc_id is not null")
        heads = table_cut(whole.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("r"), F.min(F.struct("doc_id", "text_hash")).alias("own")).select("digest", F.col("r.row").alias("node"), "own"))
        nodes = all_sets.join(heads.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "doc_id", "text_hash", "n", "counts", "fine")
        keys = all_sets.where("size(keys) > 0").select(F.explode("keys").alias("key"), F.col("row").alias("node"))
        shared = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key bigint, node bigint")
        # several tasks may have sent the keys of one set, each for its own row
        copies = whole.where("size(keys) > 0").select("row", "digest").join(heads, "digest").where("row <> node").select("row", F.col("node").alias("head"))
        shared = shared.withColumnRenamed("node", "row").join(copies, "row", "left").select("key", F.coalesce("head", "row").alias("node")).repartition("key").distinct()
        sizes = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).alias("leaves"))
        members = table_cut(shared.join(sizes, "key"))
        comp = linked_components(docs, nodes, members, percent, k)
        label = heads.select("digest", F.col("own").alias("least"))
        if comp is not None:
            ids = heads.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            label = ids.join(ids.groupBy("comp").agg(F.min("own").alias("least")), "comp").select("digest", "least")
        label = table_cut(label)
    out = all_sets.select("doc_id", "text_hash", "n", "digest").join(label.hint("merge"), "digest", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    first = F.coalesce((F.col("least.doc_id") == F.col("doc_id")) & (F.col("least.text_hash") == F.col("text_hash")), F.lit(True))
    component = F.when(F.col("doc_id").isNotNull(), F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), (~linked | first).alias("leader"))


def near_groups(docs: DataFrame, percent: int = 85, k: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs(doc_id, text)."""
    return grouped(docs, percent, k).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """docs with one row of each component: of its least id, and of that id's texts in the component the one of least hash.

    Rows are told apart by id and text, so of two texts with one id each keeps its own group. Rows
    that repeat the one that stays go too; rows without words or id link with nothing and all stay.
    """
    names = docs.columns
    groups = table_cut(grouped(docs, percent, k))
    marked = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("binary")))
    gone = groups.where("not leader").select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    left = marked.join(gone.hint("merge"), ["doc_id", "__hash"], "left_anti")
    again = groups.where("leader and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.col("text_hash").alias("__hash"))
    again = again.hint("merge")
    if again.limit(1).count() == 0:
        return left.select(*names)
    once = left.join(again, ["doc_id", "__hash"], "left_semi").dropDuplicates(["doc_id", "__hash"])
    return left.join(again, ["doc_id", "__hash"], "left_anti").unionByName(once).select(*names)
