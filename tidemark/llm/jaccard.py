"""N-gram Jaccard join by a MinHash LSH forest.

Documents are sets of five-word shingles (a document of one to four words is one shingle). Each tree of the forest
is a prefix trie of signatures of ``depth`` min-hashes, held as a sorted array: rows are range-partitioned by (tree,
signature), and neighbours in that order tell the longest prefixes that are shared. So the deeper levels split what
shares a short prefix, however many rows that are.

Matched prefixes are shortened adaptively. ``prefix_length`` goes down from ``depth`` to the longest prefix at which a
single link at the threshold is found with the target probability; all documents are matched there. Each link found,
of similarity s, stands for (1 - p) / p links that were missed, p being the chance that s has at that prefix. A document
for which these add up to more than 1 - ``target`` is queried again at a prefix shorter by one, and so on to ``FLOOR``.

Candidates are pairs that share the prefix in some tree, and all of them are verified on their words' bytes; hashes
only propose. The same pairs are verified whatever way they meet: pieces of a component of candidates, or, where that
would copy a document more than ``PAIRED`` times, pieces of the buckets of a prefix, a pair in the first tree it shares.

Copies (equal word sequences) are one node with a count, named by 128 bits of BLAKE2 of their words. Links are counted
where they are found and never listed.

Cases: null and blank texts have no shingles, no links and are classes of their own; a null doc_id is an id like
others, ordered last; repeated rows are copies of each other; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.runtime import saved

from . import textnp
from .base import broadcast_if_small, give_back, join_counted, lean, text_or_empty

WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
TARGET = 0.9995
FLOOR = 2
TOGETHER = 1024
SHINGLES = 1_000_000
PAIRED = 16
EDGES = 1_000_000
AT_ONCE = 4 << 20  # bytes of bit sets that a document is compared with in one step
LARGE = 1 << 20  # bytes of a group after whose check the worker gives its memory back
LAST = (1 << 63) - 1
SET_SCHEMA = "doc_id long, doc_key long, node binary, n long, signature binary"
STEP_SCHEMA = "a binary, b binary, tree int, path binary, part int, last boolean"
MEMBER_SCHEMA = "node binary, component binary, parts long, copies long, asked boolean, words binary, signature binary"
LINK_SCHEMA = "node binary, next binary, root binary, links long, missed array<double>"


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with probability ``target``."""
    length = depth
    while length > 1 and met(threshold, trees, length) < target:
        length -= 1
    return length


def met(similarity, trees: int, length: int):
    """Chance that two sets of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and row offsets; a row of 1 to n - 1 words gives one shingle, of all its words."""
    sizes = np.diff(rows)
    grams = textnp.gram_hashes(hashes, n)
    count = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    at = np.r_[0, np.cumsum(count)]
    out = np.empty(at[-1], np.uint64)
    full = np.flatnonzero(sizes >= n)
    place = np.repeat(at[full] - (np.cumsum(count[full]) - count[full]), count[full]) + np.arange(count[full].sum())
    source = np.repeat(rows[full] - (np.cumsum(count[full]) - count[full]), count[full]) + np.arange(count[full].sum())
    out[place] = grams[source]
    for r in np.flatnonzero((sizes > 0) & (sizes < n)):
        out[at[r]] = textnp.gram_hashes(hashes[rows[r] : rows[r + 1]], int(sizes[r]))[0]
    return out, at


def _names(joined: np.ndarray, at: np.ndarray, rows: np.ndarray) -> list[bytes | None]:
    """128 bits of the words of each row in order; null for a row without words."""
    raw, cuts = joined.tobytes(), at[rows].tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def signatures(grams: np.ndarray, at: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """16 bits of each min-hash, [row, tree * depth], of rows that have shingles."""
    rng = np.random.default_rng(20_240_601)
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), trees * depth), np.uint16)
    for k in range(trees * depth):
        times, plus = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        mixed = grams * (times | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= plus | np.uint64(1)
        if len(starts):
            out[:, k] = textnp.mix(np.minimum.reduceat(mixed, starts)).astype(np.uint16)
    return out


def _sets(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, at = textnp.utf8(batch.column("text"))
            for lo, hi in textnp.slices(at, 2 << 20):
                part, cuts = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                starts, stops, rows = textnp.word_spans(part, cuts)
                names = _names(*textnp.joined_words(part, cuts, starts, stops), rows)
                grams, cuts = shingles(textnp.word_hashes(part, starts, stops), rows, n)
                made = iter(signatures(grams, cuts, trees, depth))
                found = [next(made).tobytes() if name else None for name in names]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("doc_key").slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array(np.diff(cuts), pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "doc_key", "node", "n", "signature"])

    return docs.mapInArrow(lean(run), SET_SCHEMA)


def paths(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """node, tree and path: its signature in that tree, two bytes a min-hash."""
    wide = 2 * depth
    return nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("node", "tree", F.substr("signature", F.col("tree") * wide + 1, F.lit(wide)).alias("path"))


def neighbours(placed: DataFrame, length: int, depth: int) -> DataFrame:
    """a and b: nodes next to each other in the order of a tree that share a prefix of ``length``, each pair once.

    What shares a prefix is a stretch of the order, so these chains join all of it, and no node is in more than two
    pairs a tree. The first and last row of each partition are told too and matched afterwards: two rows a partition.
    """

    def walk(batches):
        part, last, any_row = TaskContext.get().partitionId(), None, False
        ends = {"tree": pa.int32(), "path": pa.binary(), "node": pa.binary()}

        def tell(row, is_last):
            return pa.RecordBatch.from_pylist([{"a": row[2], "b": None, "tree": row[0], "path": row[1], "part": part, "last": is_last}], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, path, node = (batch.column(c).to_pylist() for c in ends)
            if not any_row:
                any_row = True
                yield tell((tree[0], path[0], node[0]), False)
            if last is not None:
                tree, path, node = [last[0], *tree], [last[1], *path], [last[2], *node]
            last = (tree[-1], path[-1], node[-1])
            symbols, trees = np.frombuffer(b"".join(path), np.uint16).reshape(-1, depth), np.array(tree)
            near = np.flatnonzero((symbols[1:, :length] == symbols[:-1, :length]).all(axis=1) & (trees[1:] == trees[:-1])).tolist()
            a, b = [min(node[k], node[k + 1]) for k in near], [max(node[k], node[k + 1]) for k in near]
            none = [None] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([a, b, none, none, none, none], schema.types, strict=True)], schema=schema)
        if any_row:
            yield tell(last, True)

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("tree", pa.int32()), ("path", pa.binary()), ("part", pa.int32()), ("last", pa.bool_())])
    ordered = placed.select("tree", "path", "node").repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    steps = saved(ordered.mapInArrow(lean(walk), STEP_SCHEMA))
    order = W.orderBy("part", "last")
    ends = steps.filter("b IS NULL").select("a", "tree", F.substring("path", 1, 2 * length).alias("path"), *[F.lag(c).over(order).alias(f"{c}0") for c in ("a", "tree")], F.lag(F.substring("path", 1, 2 * length)).over(order).alias("path0"))
    ends = ends.filter("tree = tree0 AND path = path0 AND a <> a0").select(F.least("a", "a0").alias("a"), F.greatest("a", "a0").alias("b"))
    return steps.filter("b IS NOT NULL AND a <> b").select("a", "b").unionByName(ends).distinct()


def _least_of_each(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of n numbers is joined to by edges a, b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contract(edges: DataFrame) -> DataFrame:
    """Edges with the same components: in each partition a star around the least node of each of its components."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        both = pa.concat_arrays([*table.column("a").chunks, *table.column("b").chunks]).dictionary_encode()
        order = pc.sort_indices(both.dictionary)
        names, rank = both.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        at = rank[both.indices.to_numpy()]
        root = _least_of_each(at[: len(table)], at[len(table) :], len(names))
        leaves = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(root[leaves])), names.take(pa.array(leaves))], names=["a", "b"])

    return edges.mapInArrow(lean(run), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for all nodes of edges (a, b).

    Edges are contracted in tasks of up to ``EDGES``; where one task has seen all of them that is the answer. Else, in
    each round a node takes the least label of its neighbours, and all that had its label take the least of what they
    took, so whole groups merge. Nodes with many edges and labels of many nodes are joined by ``join_counted``.
    """
    edges = saved(edges)
    tasks = max(1, -(-edges.count() // EDGES))
    edges = saved(_contract(edges.coalesce(tasks)))
    if tasks == 1:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degrees = saved(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.least(F.col("a"), F.min("b")).alias("component")))
    labels, (n_edges, n_nodes) = degrees.select("node", "component"), degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    while True:
        reached = degrees.select("node", "n").join(labels, "node").select(F.col("node").alias("b"), "n", "component")
        near = join_counted(both, reached, "b", "n", n_edges).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = saved(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        if step.filter("component <> old").isEmpty():
            return labels
        groups = saved(step.groupBy("old").agg(F.count("*").alias("n"), F.min("component").alias("least")))
        labels = saved(join_counted(step, groups, "old", "n", n_nodes).select("node", F.col("least").alias("component")))


def exact_sets(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle) pairs without repeats, by owner, and each owner's number of shingles.

    words: each document's words with a space behind each. Shingles are numbered by the bytes of their words, so equal
    numbers are equal shingles, without a hash between.
    """
    joined = np.frombuffer(b"".join(words), np.uint8)
    at = np.r_[0, np.flatnonzero(joined == 0x20) + 1]
    rows = np.searchsorted(at, np.r_[0, np.cumsum([len(w) for w in words])])
    numbers, none = textnp.word_numbers(joined, at)
    size = np.diff(rows)
    wide = np.maximum(size, n)  # a short document is filled up with a word that there isn't
    first = np.cumsum(wide) - wide
    text = np.full(wide.sum(), none, np.int64)
    text[np.arange(len(numbers)) + np.repeat(first - rows[:-1], size)] = numbers
    grams = textnp.gram_numbers(text, n)
    count = wide - n + 1
    owner = np.repeat(np.arange(len(words)), count)
    grams = grams[np.arange(len(owner)) + np.repeat(first - np.cumsum(count) + count, count)]
    most = int(grams.max()) + 1 if len(grams) else 1
    pairs = np.unique(owner * most + grams)
    owner, grams = np.divmod(pairs, most)
    return owner, grams, np.bincount(owner, minlength=len(words))


def _prefixes(signature: list[bytes], trees: int, depth: int, length: int) -> np.ndarray:
    """[row, tree]: a number for the first ``length`` min-hashes of each tree."""
    symbols = np.frombuffer(b"".join(signature), np.uint16).reshape(-1, trees, depth)
    out = np.zeros(symbols.shape[:2], np.uint64)
    for k in range(length):
        out = textnp.mix(out * textnp.BASE + symbols[:, :, k] + np.uint64(1))
    return out


class Join:
    """Parameters of a join and the checks of a group of documents."""

    def __init__(self, words: int, threshold: float, trees: int, depth: int, target: float, together: int):
        self.words, self.threshold, self.trees, self.depth, self.target, self.together = words, threshold, trees, depth, target, together
        self.first = prefix_length(threshold, trees, depth, target)
        self.floor = min(FLOOR, self.first)
        self.lengths = list(range(self.first, self.floor - 1, -1))

    def verify(self, table: pa.Table, length: int, tree: int | None, blocks: tuple[int, int]) -> pa.Table:
        """Links between the table's documents: for each node a next one and the least of its class, links and expected misses.

        Pairs share a prefix of ``length`` in some tree: at the first length any, at later ones no longer one, and
        one of them asked. tree: that of the bucket that the table is, whose pairs share no earlier one. blocks:
        numbers of the two blocks, whose pairs across are checked, or of the one.
        """
        table = table.sort_by("node")
        names = table.column("node").to_pylist()
        fresh = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
        if len(fresh) < len(names):
            table, names = table.take(fresh), [names[k] for k in fresh]
        owner, grams, size = exact_sets(table.column("words").to_pylist(), self.words)
        copies, asked, block = (table.column(c).to_numpy() for c in ("copies", "asked", "part"))
        signature = table.column("signature").to_pylist()
        keys = _prefixes(signature, self.trees, self.depth, length)
        longer = _prefixes(signature, self.trees, self.depth, length + 1) if length < self.first else None
        _, place, times = np.unique(grams, return_inverse=True, return_counts=True)
        shared = times > 1
        column, live = np.cumsum(shared) - 1, shared[place]
        bits = np.zeros((len(names), -(-int(shared.sum()) // 64) or 1), np.uint64)
        np.bitwise_or.at(bits, (owner[live], column[place[live]] >> 6), np.uint64(1) << (column[place[live]] & 63).astype(np.uint64))
        del owner, grams, place, times, shared, column, live
        links, missed = np.zeros(len(names), np.int64), np.zeros((len(names), len(self.lengths)))
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, min(512, AT_ONCE // (8 * bits.shape[1])))
        order = np.argsort(size, kind="stable")  # only sizes within the threshold of each other can be similar
        ranked = size[order]
        for k, i in enumerate(order.tolist()):
            others = order[k + 1 : int(np.searchsorted(ranked, size[i] / self.threshold + 1e-9, "right"))]
            if blocks[0] != blocks[1]:
                others = others[block[others] != block[i]]
            if longer is not None:
                if not asked[i]:
                    others = others[asked[others]]
                others = others[~(longer[others] == longer[i]).any(axis=1)]
            same = keys[others] == keys[i]
            others = others[same.any(axis=1) if tree is None else same[:, tree] & ~same[:, :tree].any(axis=1)]
            for lo in range(0, len(others), step):
                part = others[lo : lo + step]
                both = np.bitwise_count(bits[part] & bits[i]).sum(axis=1, dtype=np.int64)
                alike = both / (size[part] + size[i] - both)
                good = alike >= self.threshold - 1e-12
                if good.any():
                    part, alike = part[good], alike[good]
                    links[i] += copies[part].sum()
                    links[part] += copies[i]
                    chance = np.stack([met(alike, self.trees, n) for n in self.lengths], axis=1)
                    missed[i] += ((1 - chance) / chance).sum(axis=0)
                    missed[part] += (1 - chance) / chance
                    edges.append((np.full(len(part), i), part))
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
        root = _least_of_each(a, b, len(names))
        order = np.argsort(root, kind="stable")
        follows: list[bytes | None] = [None] * len(names)
        for k in np.flatnonzero(root[order[1:]] == root[order[:-1]]).tolist():
            follows[order[k]] = names[order[k + 1]]
        rows = pa.ListArray.from_arrays(np.arange(0, missed.size + 1, len(self.lengths), dtype=np.int32), missed.ravel())
        return pa.table({"node": pa.array(names, pa.binary()), "next": pa.array(follows, pa.binary()), "root": pa.array([names[k] for k in root.tolist()], pa.binary()), "links": pa.array(links, pa.int64()), "missed": rows})

    def matched(self, rows: DataFrame, nodes: DataFrame, length: int) -> tuple[DataFrame, bool]:
        """Links (LINK_SCHEMA) of the pairs that prefixes of this length propose, and whether no component was cut.

        nodes: with ``asked``.
        Below the first length only stretches of the tries that hold a document that is asked are looked at.
        """
        placed = paths(nodes, self.trees, self.depth)
        if length < self.first:
            prefix = [F.col("tree"), F.substring("path", 1, 2 * length).alias("prefix")]
            wanted = paths(nodes.filter("asked"), self.trees, self.depth).select(*prefix).distinct()
            placed = placed.select("node", "path", *prefix).join(broadcast_if_small(saved(wanted), 200_000), ["tree", "prefix"], "left_semi")
        found = components(neighbours(placed, length, self.depth)).join(nodes.drop("signature"), "node")
        half = max(1, self.together // 2)
        whole = (F.count("*") <= self.together) & (F.sum("n") <= SHINGLES)
        parts = F.when(whole, 1).otherwise(F.greatest(F.ceil(F.count("*") / half), F.ceil(F.sum("n") / (SHINGLES // 2))))
        sizes = saved(found.groupBy("component").agg(parts.cast("long").alias("parts"), F.count("*").alias("members")))
        chosen = saved(join_counted(found, sizes, "component", "members").select(F.col("node").alias("wanted"), "component", "parts", "first", "copies", "asked"))
        members = saved(self.gathered(rows, chosen)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        linked = self.checked(members.filter(F.col("parts") <= PAIRED), "component", length)
        most = chosen.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0]
        if most > PAIRED:
            linked = linked.unionByName(self.by_bucket(members.filter(F.col("parts") > PAIRED), length))
        return saved(linked), most == 1

    def gathered(self, rows: DataFrame, chosen: DataFrame) -> DataFrame:
        """MEMBER_SCHEMA: the words and signatures of the chosen nodes."""

        def gather(batches):
            for batch in batches:
                raw, at = textnp.utf8(batch.column("text"))
                for lo, hi in textnp.slices(at, 2 << 20):
                    part, cuts = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                    starts, stops, ends = textnp.word_spans(part, cuts)
                    joined, places = textnp.joined_words(part, cuts, starts, stops)
                    grams, marks = shingles(textnp.word_hashes(part, starts, stops), ends, self.words)
                    made, raw_words, bounds = iter(signatures(grams, marks, self.trees, self.depth)), joined.tobytes(), places[ends].tolist()
                    names, own = _names(joined, places, ends), batch.slice(lo, hi - lo)
                    found = [next(made).tobytes() if name else None for name in names]
                    kept = [k for k, (x, y) in enumerate(zip(names, own.column("wanted").to_pylist(), strict=True)) if x == y]
                    columns = [own.column(c).take(pa.array(kept, pa.int64())) for c in ("wanted", "component", "parts", "copies", "asked")]
                    words = [raw_words[bounds[k] : bounds[k + 1]] for k in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.binary()), pa.array([found[k] for k in kept], pa.binary())], names=["node", "component", "parts", "copies", "asked", "words", "signature"])

        texts = rows.join(broadcast_if_small(chosen, 200_000), F.col("doc_key") == F.col("first"))
        return texts.select("text", "wanted", "component", "parts", "copies", "asked").mapInArrow(lean(gather), MEMBER_SCHEMA)

    def checked(self, members: DataFrame, key: str, length: int) -> DataFrame:
        """Links inside groups of the key, cut into pairs of blocks."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        paired = members.withColumn("other", other).withColumn("p1", F.least("part", "other")).withColumn("p2", F.greatest("part", "other"))

        def verify(found: tuple, table: pa.Table) -> pa.Table:
            tree = found[0].as_py()[0] if key == "bucket" else None
            links = self.verify(table, length, tree, (found[1].as_py(), found[2].as_py()))
            if table.nbytes > LARGE:
                give_back()
            return links

        return paired.select(key, "p1", "p2", "part", "node", "copies", "asked", "words", "signature").groupBy(key, "p1", "p2").applyInArrow(verify, LINK_SCHEMA)

    def by_bucket(self, members: DataFrame, length: int) -> DataFrame:
        """Links of nodes of large components inside the buckets of the prefixes that they share."""
        each = members.select("node", F.octet_length("words").alias("bytes"), F.explode(_buckets(self.trees, self.depth, length)).alias("bucket"))
        half = max(1, self.together // 2)
        parts = F.greatest(F.ceil(F.count("*") / half), F.ceil(F.sum("bytes") / (8 * SHINGLES // 2)))
        sizes = saved(each.groupBy("bucket").agg(F.count("*").alias("members"), parts.cast("long").alias("parts")).filter("members > 1"))
        rows = members.drop("parts", "part").withColumn("bucket", F.explode(_buckets(self.trees, self.depth, length)))
        rows = join_counted(rows, sizes, "bucket", "members").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        return self.checked(rows, "bucket", length)

    def links(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """node, root and links of the nodes that meet others."""
        nodes = nodes.withColumn("asked", F.lit(True))
        found, final = self.matched(rows, nodes, self.first)
        for k, length in enumerate(self.lengths[1:]):
            total = found.groupBy("node").agg(F.sum(F.get("missed", F.lit(k))).alias("missed"))
            again = saved(total.filter(F.col("missed") > 1 - self.target).select("node", F.lit(True).alias("again")))
            if again.isEmpty():
                break
            nodes = saved(nodes.join(again, "node", "left").withColumn("asked", F.col("asked") & F.coalesce("again", F.lit(False))).drop("again"))
            found, final = saved(found.unionByName(self.matched(rows, nodes, length)[0])), False
        if final:  # each component met in one task, once
            return found.select("node", "root", "links")
        joined = components(found.filter("next IS NOT NULL").select(F.col("node").alias("a"), F.col("next").alias("b")))
        return found.groupBy("node").agg(F.sum("links").alias("links")).join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "links")


def _buckets(trees: int, depth: int, length: int) -> Column:
    """Array of (tree, prefix) as binary, the tree in the first byte."""
    wide = 2 * depth
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substr("signature", t * wide + 1, F.lit(2 * length))))


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, together: int = TOGETHER) -> DataFrame:
    """doc_id, class_id, n_links and copies of each row.

    class_id: the least doc_id that a chain of links reaches (null only if all of the class are null). n_links: how
    many other documents have a Jaccard similarity of at least the threshold, copies included. copies: documents
    with the same words, itself included. together: documents that are checked in one task; no result depends on it.
    """
    found = _classes(docs, Join(words, threshold, trees, depth, target, together))
    return found.select("doc_id", F.when(F.col("class_key") == LAST, F.lit(None)).otherwise(F.col("class_key")).cast("long").alias("class_id"), "n_links", "copies")


def _classes(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, doc_key, node, class_key, class_node, n_links and copies of each row; node is null for blank texts.

    class_key and class_node: the least doc_key of the class and the node that has it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), text_or_empty().alias("text"))
    sets = saved(_sets(rows, join.words, join.trees, join.depth))
    nodes = saved(sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_key").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    linked = saved(join.links(rows, nodes))
    result = saved(nodes.select("node", "first", "copies").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")))
    leads = result.groupBy("root").agg(F.min(F.struct("first", "node")).alias("lead"), F.count("*").alias("members")).select("root", "members", F.col("lead.first").alias("class_key"), F.col("lead.node").alias("class_node"))
    result = join_counted(result, saved(leads), "root", "members").select("node", "class_key", "class_node", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = join_counted(sets.filter("node IS NOT NULL").select("doc_id", "doc_key", "node"), saved(result), "node", "copies")
    none = F.lit(None).cast("binary")
    blank = sets.filter("node IS NULL").select("doc_id", "doc_key", none.alias("node"), F.col("doc_key").alias("class_key"), none.alias("class_node"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return full.select("doc_id", "doc_key", "node", "class_key", "class_node", "n_links", "copies").unionByName(blank)


def _named(docs: DataFrame) -> DataFrame:
    """docs with _key (doc_id, LAST for null) and _node (null for blank texts)."""

    def run(batches):
        for batch in batches:
            raw, at = textnp.utf8(batch.column("_text"))
            for lo, hi in textnp.slices(at, 2 << 20):
                part, cuts = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                starts, stops, ends = textnp.word_spans(part, cuts)
                names = _names(*textnp.joined_words(part, cuts, starts, stops), ends)
                own = batch.slice(lo, hi - lo)
                kept = [k for k, name in enumerate(batch.schema.names) if name != "_text"]
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in kept], pa.array(names, pa.binary())], names=[*[batch.schema.names[k] for k in kept], "_node"])

    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_key"))
    schema = StructType([*[StructField(f.name, f.dataType) for f in keyed.schema], StructField("_node", BinaryType())])
    return keyed.withColumn("_text", text_or_empty("_row.text")).mapInArrow(lean(run), schema)


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, together: int = TOGETHER) -> DataFrame:
    """docs with one row for each class, the one with the least doc_id; blank texts all stay. All columns stay.

    Rows are told apart by doc_id and words, so a null or repeated doc_id drops no other text. Of rows that repeat
    both, the least by all columns stays.
    """
    found = _classes(docs, Join(words, threshold, trees, depth, target, together)).filter("node IS NOT NULL")
    pairs = found.groupBy(F.col("doc_key").alias("_key"), F.col("node").alias("_node")).agg(F.count("*").alias("_times"), F.first("class_key").alias("lead"), F.first("class_node").alias("lead_node"))
    leads = (F.col("_key") == F.col("lead")) & (F.col("_node") == F.col("lead_node"))
    marks = saved(pairs.select("_key", "_node", "_times", leads.alias("_leads")).filter("_times > 1 OR NOT _leads"))
    rows = _named(docs).join(broadcast_if_small(marks, 200_000), ["_key", "_node"], "left").filter("_leads IS NULL OR _leads")
    once = rows.filter("_leads IS NULL").select("_row.*")
    repeated = rows.filter("_leads").groupBy("_key", "_node").agg(F.min("_row").alias("_row")).select("_row.*")
    return once.unionByName(repeated)
