"""Operator 3, n-gram Jaccard join: a prefix-tree join of word-shingle sets.

Two documents link when the Jaccard similarity of their sets is at least the
threshold. Equal sets form a class, and classes are joined:

1. Prefixes. In the order of the hashes, two sets that link share at least
   ``need`` shingles of their first ``p``. All classes' prefixes are counted by
   shingle; a class with too few shingles that others have as well is out.
2. Groups. A shingle's bucket is named by its smallest class, and buckets of one
   name are one group: classes that share a shingle meet in its group, and
   near copies, which share most of theirs, in few. Groups are never closed over
   candidates. Of each class, the groups that hold the fewest of its shingles are
   left out, up to half of ``need``: two that link have another in common.
   Groups are cut into chunks of a bounded number of shingles and each pair of
   chunks goes to one task, so no task holds a large group.
3. Trees. A task puts its sets, rarest shingles first, into a prefix tree and
   walks it with the sets that it must look up, sharing the overlap of common
   paths and leaving subtrees whose remaining lengths cannot reach the overlap
   that is needed. A pair that meets in several groups belongs to the first of
   them. Only links that join two parts of a group are returned, so no task
   returns more links than it has sets.
4. Links, all of them verified, are joined into components.

Counts are summed before they are shuffled; shingles, classes and roots held by
many rows are joined by broadcast (see join_hot). Nothing is capped: each step
keeps every link.

Defined results: a null or empty text (or one without words) has an empty set
and links with nothing; a text with fewer words than a shingle is one shingle;
copies and repeated rows are of one class; a null key is of its class but never
names it; documents of one key and different texts link as texts do; an empty
table gives an empty result; columns other than key and text are not read,
whatever their names; the smallest key settles ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext
from graphloom.llm.common import join_hot, partitions_for, read, written
from graphloom.llm.components import components

#: Share of a set that two linking sets have in common in their prefixes, besides what the threshold leaves open.
_SLACK = 10


def _at_least(n, percent: int):
    """The smallest size of a set that can link with one of n, and the smallest overlap: percent of n, rounded up."""
    return -((-n * percent) // 100)


def prefix_lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, need): any set of at least percent of n that links has at least need shingles in common in both first p."""
    share = lambda m: np.maximum(1, m * _SLACK // 100)
    least = _at_least(n, percent)
    return np.minimum(n, n - least + share(n)), share(least)


def shingled(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(row, key, n, sig, p, need, tokens): each text's set, ordered by hash; equal sets have equal sig."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, data, offsets in bytetext.pieces(*bytetext.of_arrow(batch.column(1))):
                sets = bytetext.shingle_sets(data, offsets, words)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(bytetext.mixed(flat ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x1234567, 0x89ABCDEF)]
                sig = np.stack([bytetext.mixed(s[at[1:]] - s[at[:-1]] + n.astype(np.uint64)) for s in sums], 1)
                p, need = prefix_lengths(n, percent)
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(j - i)), batch.column(0).slice(i, j - i), pa.array(n),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(0, 16 * (j - i) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(sig))]),
                        pa.array(p, pa.int32()), pa.array(need, pa.int32()), tokens,
                    ],
                    ["row", "key", "n", "sig", "p", "need", "tokens"],
                )
                row += j - i

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(build, f"row long, key {kind}, n long, sig binary, p int, need int, tokens array<long>")


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each slice, one slice after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class PrefixTree:
    """Sets in a path-compressed prefix tree, rarest shingles first.

    No edge is longer than ``_EDGE``, so a walk soon knows whether a path is worth following. The nodes of a level are
    looked at together: of each, what its edge adds to the overlap, and whether the rest can still reach what is needed.
    """

    _EDGE = 32

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets)
        _, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        bounds = np.cumsum([0, *map(len, sets)])
        ranked = rank[which]
        self.sets = [np.sort(ranked[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.central = [float(counts[which[a:b]].mean()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.mark = np.zeros(len(counts), bool)
        self._build()

    def _build(self) -> None:
        order = sorted(range(len(self.sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        edges, depth, parent, ends = [np.zeros(0, np.int64)], [0], [-1], [[]]

        def node(edge: np.ndarray, at: int, above: int) -> int:
            edges.append(edge)
            depth.append(at)
            parent.append(above)
            ends.append([])
            return len(edges) - 1

        path = [0]
        before = np.zeros(0, np.int64)
        for i in order:
            s = self.sets[i]
            k = min(len(s), len(before))
            differ = np.flatnonzero(s[:k] != before[:k])
            common = int(differ[0]) if len(differ) else k
            last = None
            while depth[path[-1]] > common:
                last = path.pop()
            if depth[path[-1]] < common:  # the edge to `last` is split where the two part
                cut = common - depth[path[-1]]
                middle = node(edges[last][:cut], common, path[-1])
                edges[last], parent[last] = edges[last][cut:], middle
                path.append(middle)
            while depth[path[-1]] < len(s):
                at = depth[path[-1]]
                to = min(len(s), at + self._EDGE)
                path.append(node(s[at:to], to, path[-1]))
            ends[path[-1]].append(i)
            before = s
        n = len(edges)
        self.depth = np.array(depth)
        self.flat = np.concatenate(edges)
        self.size = np.array([len(e) for e in edges])
        self.begin = np.cumsum(self.size) - self.size
        self.ends = ends
        self.has_end = np.array([bool(e) for e in ends])
        above = np.array(parent)
        self.child = np.argsort(above, kind="stable")[1:]  # without the root
        self.children = np.searchsorted(above[self.child], np.arange(n + 1))
        self.least = np.where(self.has_end, self.depth, np.iinfo(np.int64).max)
        self.most = np.where(self.has_end, self.depth, 0)
        for x in np.argsort(-self.depth, kind="stable").tolist():  # from the leaves to the root
            if (up := parent[x]) >= 0:
                self.least[up] = min(self.least[up], self.least[x])
                self.most[up] = max(self.most[up], self.most[x])

    def linked(self, i: int, percent: int) -> list[int]:
        """The sets that link with set i, itself included."""
        x = self.sets[i]
        n = len(x)
        small, large = _at_least(n, percent), n * 100 // percent
        self.mark[x] = True
        found: list[int] = []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            size = self.children[nodes + 1] - self.children[nodes]
            nodes, overlap = self.child[_spread(self.children[nodes], size)], np.repeat(overlap, size)
            fits = (self.most[nodes] >= small) & (self.least[nodes] <= large)
            nodes, overlap = nodes[fits], overlap[fits]
            if not len(nodes):
                break
            size = self.size[nodes]
            shared = np.concatenate([[0], np.cumsum(self.mark[self.flat[_spread(self.begin[nodes], size)]])])
            upto = np.cumsum(size)
            overlap = overlap + shared[upto] - shared[upto - size]
            left = n - np.searchsorted(x, self.flat[self.begin[nodes] + size - 1], "right")
            bound = overlap + np.minimum(left, self.most[nodes] - self.depth[nodes])
            fits = (100 + percent) * bound >= percent * (n + np.maximum(small, self.least[nodes]))
            nodes, overlap = nodes[fits], overlap[fits]
            hit = self.has_end[nodes] & ((100 + percent) * overlap >= percent * (n + self.depth[nodes]))
            for node in nodes[hit].tolist():
                found.extend(self.ends[node])
        self.mark[x] = False
        return found


def joining_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets, as many as it takes to join every two that links join: fewer than there are sets.

    A link between two parts has an end outside the largest part. So sets outside it are looked up, until none is left.
    """
    if len(sets) < 2:
        return []
    tree = PrefixTree(sets)
    part = list(range(len(sets)))
    members = {i: [i] for i in part}
    links: list[tuple[int, int]] = []
    queue = sorted(range(len(sets)), key=lambda i: -tree.central[i])
    seen = [False] * len(sets)
    largest = _join(tree, queue[0], percent, part, members, links, queue[0])
    seen[queue[0]] = True
    while rest := [i for i in queue if not seen[i] and part[i] != largest]:
        for i in rest:
            if part[i] != largest:
                largest = _join(tree, i, percent, part, members, links, largest)
                seen[i] = True
    return links


def _shared_before(group: int, owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, members, groups before this one of each set): sets by each group before this one that they are in, and these groups as numbers, set after set."""
    before = [o[o < group] for o in owners]
    size = np.array([len(x) for x in before], np.int64)
    flat = np.concatenate(before) if len(before) else np.zeros(0, np.int64)
    _, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[order], np.arange(int(number.max(initial=-1)) + 2))
    return bounds, np.repeat(np.arange(len(owners)), size)[order], np.split(number, np.cumsum(size)[:-1])


def settled_before(group: int, owners: list[np.ndarray]) -> bool:
    """Whether all sets of a group are together in one group before it."""
    bounds, _, _ = _shared_before(group, owners)
    return int(np.diff(bounds).max(initial=0)) == len(owners)


def counted_links(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, percent: int, group: int = 0, owners: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that join the sets as all of them do, for each set the weight of the sets that it links with).

    With sets of two sides, only links between the sides are looked up: those within a side are another task's. Pairs
    that are together in a group before this one (owners are the sets' groups) belong to that one.
    """
    n = np.zeros(len(sets), np.int64)
    links: list[tuple[int, int]] = []
    if len(sets) < 2:
        return links, n
    owners = owners or [np.zeros(0, np.int64)] * len(sets)
    bounds, members, before = _shared_before(group, owners)
    two = len(np.unique(side)) > 1
    most = np.diff(bounds)
    asks = np.ones(len(sets), bool)
    if len(most):  # sets of the largest group before this one: pairs of two of them are not looked up
        top = int(most.argmax())
        asks[members[bounds[top] : bounds[top + 1]]] = False
    elif two:
        asks = side == side[0]
    if not asks.any():
        return links, n
    tree = PrefixTree(sets)
    part = np.arange(len(sets))
    held = {i: [i] for i in range(len(sets))}
    other = np.empty(len(sets), bool)
    for i in np.flatnonzero(asks).tolist():
        other[:] = side != side[i] if two else True
        other[i] = False
        for g in before[i].tolist():
            other[members[bounds[g] : bounds[g + 1]]] = False
        if not other.any():
            continue
        found = np.array(tree.linked(i, percent))
        found = found[other[found]]
        n[i] += weights[found].sum()
        n[found[~asks[found]]] += weights[i]
        for j in found[part[found] != part[i]].tolist():
            a, b = int(part[i]), int(part[j])
            if a != b:
                links.append((i, j))
                if len(held[a]) < len(held[b]):
                    a, b = b, a
                part[held[b]] = a
                held[a] += held.pop(b)
    return links, n


def _join(tree: PrefixTree, i: int, percent: int, part: list, members: dict, links: list, largest: int) -> int:
    for j in tree.linked(i, percent):
        a, b = part[i], part[j]
        if a != b:
            links.append((i, j))
            if len(members[a]) < len(members[b]):
                a, b = b, a
            for m in members[b]:
                part[m] = a
            members[a] += members.pop(b)
            if largest == b or len(members[a]) > len(members[largest]):
                largest = a
    return largest


def candidates(sets: DataFrame) -> DataFrame:
    """(row, groups): classes that may link, each with its groups in order; two that link have one of them in common.

    Two classes that link share as many shingles of their prefixes as either needs, so each may leave out fewer than half.
    """
    tokens = sets.where("n > 0").select("row", "need", F.explode(F.slice("tokens", F.lit(1), F.col("p"))).alias("t"))
    shared = written(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-shared")
    total = shared.agg(F.sum("df")).first()[0] or 0
    held = join_hot(tokens, shared, "t", "df", total)
    kept = held.groupBy("row").agg(F.max("need").alias("need"), F.collect_list("t").alias("ts")).where(F.size("ts") >= F.col("need"))
    kept = written(kept, "jaccard-prefix").select("row", "need", F.explode("ts").alias("t"))
    named = kept.groupBy("t").agg(F.min("row").alias("group"), F.count(F.lit(1)).alias("df")).where("df > 1")
    met = join_hot(kept, named, "t", "df", total).groupBy("row", "group").agg(F.count(F.lit(1)).alias("k"), F.max("need").alias("need"))
    groups = met.groupBy("row").agg(F.max("need").alias("need"), F.sort_array(F.collect_list(F.struct("k", "group"))).alias("gs"))
    most = F.floor((F.col("need") - 1) / 2)
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("gone"), F.lit(True).alias("open"))

    def leave(had, g):
        fits = had["open"] & (had["sum"] + g["k"] <= most)
        return F.struct((had["sum"] + F.when(fits, g["k"]).otherwise(F.lit(0))).alias("sum"), (had["gone"] + fits.cast("int")).alias("gone"), fits.alias("open"))

    left = F.slice("gs", F.aggregate("gs", none, leave)["gone"] + 1, F.size("gs"))
    return groups.select("row", F.sort_array(F.transform(left, lambda g: g["group"])).alias("groups")).where(F.size("groups") > 0)


def links(sets: DataFrame, parts: DataFrame, percent: int, chunk_tokens: int, broadcast_rows: int, count: bool) -> DataFrame:
    """(a, b, n): links between rows of sets that join all that link, and, if they are to be counted, rows (a, null, n): a links with n documents.

    parts has row, groups and copies, the number of documents of the row's class.
    """
    few = parts.count() <= broadcast_rows
    members = written(sets.select("row", "n", "tokens").join(F.broadcast(parts) if few else parts, "row"), "jaccard-candidates")
    met = members.select("row", "n", "tokens", "copies", "groups", F.explode("groups").alias("part"))
    sizes = members.select("n", F.explode("groups").alias("part")).groupBy("part").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("held")).where("held > 1")
    sizes = written(sizes.select("part", "held", F.ceil(F.col("sum") / chunk_tokens).cast("int").alias("chunks")), "jaccard-parts")
    split = sizes.where("chunks > 1").select("part", "chunks")  # fewer than all tokens / chunk_tokens
    zero = F.lit(0)
    whole = join_hot(met, sizes.where("chunks = 1").select("part", "held"), "part", "held", met.count())
    one = whole.select("part", zero.alias("i"), zero.alias("j"), "row", "tokens", zero.alias("own"), "copies", "groups")
    own = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    many = met.join(F.broadcast(split), "part").select("part", "row", "tokens", "copies", "groups", own.alias("own"), other.alias("other"))
    many = many.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "tokens", "own", "copies", "groups")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, sets, side, copies, owners = None, [], [], [], [], []

        def found() -> Iterator[pa.RecordBatch]:
            if count:
                out, n = counted_links(sets, np.array(copies, np.int64), np.array(side), percent, task[0] if task else 0, owners)
            elif len(sets) < 2 or settled_before(task[0], owners):
                return
            else:
                out, n = joining_links(sets, percent), np.zeros(0, np.int64)
            some = np.flatnonzero(n).tolist()
            if out or some:
                a = [rows[k] for k, _ in out] + [rows[k] for k in some]
                b = [rows[k] for _, k in out] + [None] * len(some)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(out) + n[some].tolist(), pa.int64())], ["a", "b", "n"])

        for batch in batches:
            tokens, groups = batch.column(4), batch.column(7)
            flat, at = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            names, begin = groups.values.to_numpy(), groups.offsets.to_numpy()
            plain = [batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6)]
            for k, (p, i, j, row, mine, many) in enumerate(zip(*plain, strict=True)):
                if (p, i, j) != task:
                    yield from found()
                    task, rows, sets, side, copies, owners = (p, i, j), [], [], [], [], []
                rows.append(row)
                side.append(mine)
                copies.append(many)
                sets.append(flat[at[k] : at[k + 1]].copy())
                owners.append(names[begin[k] : begin[k + 1]].copy())
        yield from found()

    dealt = one.unionByName(many).repartition(partitions_for(sets.sparkSession), "part", "i", "j").sortWithinPartitions("part", "i", "j")
    return dealt.mapInArrow(walk, "a long, b long, n long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, chunk_tokens: int = 1_000_000, broadcast_rows: int = 2_000_000, count: bool = False) -> DataFrame:
    """(key, n_shingles, component_id, class_id[, n_links]): documents that links join share a component; equal sets share a class.

    Both are named by their smallest key; a document with an empty set is a component of its own. With count, n_links says
    with how many other documents one links: each candidate is then looked up, where components alone need only some.
    Tables of copies and of candidates are broadcast if they have at most broadcast_rows rows, otherwise joined by a shuffle.
    """
    sets = written(shingled(docs, key, text, words, percent), "jaccard-sets")
    full = sets.where("n > 0")
    classes = full.groupBy("sig").agg(F.min("row").alias("row"), F.min("key").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes, "jaccard-classes")
    named = join_hot(full.select("key", "n", "row", "sig").withColumnRenamed("row", "own"), classes, "sig", "rows", full.count())
    named = written(named.select("key", "n", "own", "row", "least"), "jaccard-named")
    copies = named.where("own <> row").select(F.col("own").alias("row"))
    few = copies.count() <= broadcast_rows
    single = full.join(F.broadcast(copies) if few else copies, "row", "left_anti")
    parts = written(candidates(single).join(classes.select("row", F.col("rows").alias("copies")), "row"), "jaccard-members")
    made = written(links(single, parts, percent, chunk_tokens, broadcast_rows, count), "jaccard-links")
    joined = components(made.where("b IS NOT NULL"), "jaccard-components")
    grouped = classes.select("row", "least").join(joined.withColumnRenamed("id", "row"), "row")
    roots = written(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("held")), "jaccard-roots")
    member = join_hot(grouped.select("row", "root"), roots, "root", "held", grouped.count()).select("row", "component_id")
    linked = made.where("b IS NULL").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("links"))
    held = classes.join(member, "row", "left").join(linked, "row", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")
    held = held.select("row", "rows", F.coalesce("component_id", "least").alias("component_id"), n_links)
    out = join_hot(named, held, "row", "rows", named.count(), "left")
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("least").alias("class_id"), "n_links")
    alone = sets.where("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone) if count else out.unionByName(alone).drop("n_links")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), count=True)
