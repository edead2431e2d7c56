"""MinHash near-duplicates by chosen-path set similarity join.

1. Every document becomes the set of its distinct word shingles and a sketch of ``FAMILY``
   minwise values (16 bits of each) for every tree. Equal sets are one *class* from here on.
2. Independent trees: at each node a hash of the node's path selects the minwise coordinates
   to branch on -- ``1 / threshold`` of them on average -- and a class goes to the child of
   each selected coordinate's value. A pair at the threshold keeps one common child per level
   on average, dissimilar pairs part quickly. Trees share no minwise values. A pair at
   threshold 80 misses the leaves of one tree with a chance of 0.450 (simulated), those of
   ``TREES`` trees with ``0.450 ** 16 = 3e-6``. Leaves of up to ``LEAF`` classes with the same
   members are one leaf.
3. In each leaf every class is linked with the leaf's anchor (at most one candidate per
   class), and the candidates are verified on the full sets. This joins large groups of
   copies without looking at the pairs within them.
4. Leaves whose classes are still in more than one component are compared exhaustively: every
   class outside the leaf's largest component with all others, in blocks of ``BLOCK`` classes
   (leaves over ``LEAF`` classes are first branched further, to ``MAX_DEPTH`` at most). As
   branching loses pairs, the classes of such leaves get ``EXTRA`` more trees: at ``MAX_DEPTH``
   one tree misses with 0.622 (simulated), all of them with ``0.622 ** 26 = 4e-6``. A task
   counts overlaps of the full sets and returns a spanning forest of what it finds. So every
   pair of a leaf is either connected or compared, and never emitted as a pair for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm import words
from seqlake.llm.common import components, maybe_among, row_key, stored

FAMILY = 12        # minwise values per class and tree
TREES = 16         # independent trees
EXTRA = 10         # further ones for the classes of large leaves
DEPTH = 5          # levels of the first pass
MAX_DEPTH = 14     # levels at which branching large leaves ends
LEAF = 4096        # classes up to which a leaf is compared without further branching
BLOCK = 1024       # classes that a task compares others with

_rng = np.random.default_rng(97)
_VALUES = FAMILY * (TREES + EXTRA)
_XOR = _rng.integers(0, 1 << 63, _VALUES, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TREE = np.uint64(31)      # bits of a node that hold its tree


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def sketch_sets(flat: np.ndarray, bounds: np.ndarray, trees: int = TREES) -> np.ndarray:
    """Minwise values (bits 32 to 47) of non-empty sets for ``trees`` trees, one row per set."""
    out = np.empty((len(bounds) - 1, FAMILY * trees), dtype=np.uint16)
    h = np.empty_like(flat)
    for j in range(FAMILY * trees):
        np.bitwise_xor(flat, _XOR[j], out=h)
        np.multiply(h, _MUL[j], out=h)
        out[:, j] = (np.minimum.reduceat(h, bounds[:-1]) >> _u(32)).astype(np.uint16)
    return out


def _sets(group: list[bytes], k: int):
    h, bounds = words.words_of(group)
    return words.distinct(*words.shingles(h, bounds, k))


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column(0), batch.column(1)
        for first, group in words.blocks(batch.column(2).to_pylist()):
            flat, bounds = _sets(group, k)
            n = np.diff(bounds)
            digest, _ = words.set_digests(flat, bounds)
            sig: list[bytes | None] = [None] * len(group)
            full = np.flatnonzero(n)
            if len(full):
                rows = sketch_sets(flat, np.append(bounds[:-1][full], bounds[-1]))
                for i, row in zip(full.tolist(), rows):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(group)), keys.slice(first, len(group)),
                 pa.array(n, pa.int64()), pa.array(digest.view(np.int64)), pa.array(sig, pa.binary())],
                names=["doc_id", "row_key", "n_shingles", "cls", "sig"])


def descend(node: np.ndarray, row: np.ndarray, sig: np.ndarray, levels: int,
            threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Branch ``(node, row)`` pairs ``levels`` times. A node's path hash selects one coordinate
    of its tree, and a second one with probability ``100 / threshold - 1``."""
    second = _u(int((100 / threshold - 1) * (1 << 20)))
    for _ in range(levels):
        h = words.mix(node + _u(0x9E3779B97F4A7C15))
        c1 = (h % _u(FAMILY)).astype(np.int64)
        two = ((h >> _u(40)) & _u((1 << 20) - 1)) < second
        c2 = (c1 + 1 + ((h >> _u(20)) % _u(FAMILY - 1)).astype(np.int64)) % FAMILY
        first = (node & _TREE).astype(np.int64) * FAMILY

        def child(at: np.ndarray, c: np.ndarray) -> np.ndarray:
            value = sig[row[at], first[at] + c].astype(np.uint64) | (c.astype(np.uint64) << _u(32))
            to = words.mix(words.mix(value) ^ (node[at] * _u(0xD6E8FEB86659FD93)))
            return (to & ~_TREE) | (node[at] & _TREE)

        every = np.arange(len(node))
        some = np.flatnonzero(two)
        node, row = (np.concatenate((child(every, c1), child(some, c2[some]))),
                     np.concatenate((row, row[some])))
    return node, row


def _paths(batches: Iterator[pa.RecordBatch], threshold: int, trees: range,
           levels: int) -> Iterator[pa.RecordBatch]:
    """Nodes of each class after ``levels`` levels of ``trees``: ``(cls, sig, n)`` ->
    ``(node, cls, n)``."""
    for batch in batches:
        sig = _matrix(batch.column(1))
        cls, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for tree in trees:
            root = words.mix(np.array([tree + 1], dtype=np.uint64))[0] & ~_TREE | _u(tree)
            node, row = descend(np.full(len(cls), root), np.arange(len(cls)), sig, levels, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), pa.array(cls[row]), pa.array(n[row])],
                names=["node", "cls", "n"])


def _all_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(cls, n, label, members)`` -> ``(cls, n, label, sig)`` with the values of all trees."""
    for batch in batches:
        sig = []
        for members in batch.column(3):
            flat = np.frombuffer(members.as_buffer(), dtype=np.uint64)
            sig.append(sketch_sets(flat, np.array([0, len(flat)]), TREES + EXTRA).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sig, pa.binary())],
                                         names=["cls", "n", "label", "sig"])


def _deeper(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """One more level: ``(node, cls, n, label, sig)`` -> ``(node, cls, n, label)``."""
    for batch in batches:
        node, row = descend(batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows),
                            _matrix(batch.column(4)), 1, threshold)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node.view(np.int64))] + [batch.column(i).take(take) for i in (1, 2, 3)],
            names=["node", "cls", "n", "label"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, group in words.blocks(batch.column(0).to_pylist()):
            flat, bounds = _sets(group, k)
            digest, _ = words.set_digests(flat, bounds)
            at = bounds.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest.view(np.int64)),
                 pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                names=["cls", "members"])


def _linked(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """``(a, b, members_a, members_b)`` -> the pairs whose Jaccard similarity reaches it."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
            y = np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= threshold * (len(both) - common):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)],
                                         names=["a", "b"])


def _compare(table: pa.Table, threshold: int) -> pa.Table:
    """Probes of a group against its builds: links that join different components, one per
    join. Overlaps come from the builds' postings of each shingle."""
    cls, n, label = (table[c].to_numpy() for c in ("cls", "n", "label"))
    build, probe = (table[c].to_numpy(zero_copy_only=False) for c in ("build", "probe"))
    values = [np.frombuffer(v, dtype=np.uint64) for v in table["members"].to_pylist()]
    there = np.flatnonzero(build)
    _, group = np.unique(label, return_inverse=True)
    parent = list(range(group.max() + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    if len(there):
        flat = np.concatenate([values[i] for i in there])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(there, [len(values[i]) for i in there])[order]
        for p in np.flatnonzero(probe).tolist():
            lo = np.searchsorted(flat, values[p], side="left")
            count = np.searchsorted(flat, values[p], side="right") - lo
            place = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owner[place], minlength=len(cls))
            near = np.flatnonzero((100 * common >= threshold * (n + n[p] - common)) & (label != label[p]))
            for q in near[np.argsort(-common[near], kind="stable")].tolist():
                x, y = root(group[p]), root(group[q])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((p, q))
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": cls[at[:, 0]], "b": cls[at[:, 1]]})


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``(a, b)`` confirmed on the full sets. Sets travel once per pair; a class in very
    many pairs is a skewed join key, which adaptive execution splits."""
    j = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("_x")), "a") \
             .join(sets.select(F.col("cls").alias("b"), F.col("members").alias("_y")), "b")
    return j.select("a", "b", "_x", "_y").mapInArrow(
        lambda it: _linked(it, threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: ``doc_id, row_key, n_shingles, component_id, kept``.

    Documents are linked when ``100 * |A & B| >= threshold * |A | B|`` for their sets of
    distinct ``shingle``-word shingles; ``component_id`` is the smallest id reachable by links.
    ``row_key`` identifies the document's id and text (:func:`row_key`).

    Defined cases: a text of fewer words than ``shingle`` has one shingle, its whole word
    sequence; null, empty and blank texts have no shingles, are linked with nothing and stay.
    Rows repeating an id and a text give equal rows. Documents sharing an id but not a text
    are separate vertices; ``component_id`` is the smallest id of the component. A null id is
    never the smallest unless it is alone, then ``component_id`` is null and ``kept`` true.
    Other columns are not read. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                      row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    sk = stored(src.mapInArrow(
        lambda it: _sketch(it, shingle),
        "doc_id bigint, row_key bigint, n_shingles bigint, cls bigint, sig binary"), "sketch")
    # equal sets collapse; the sketch of a class is the same in all its rows
    classes = stored(sk.filter("n_shingles > 0").groupBy("cls").agg(
        F.max("n_shingles").alias("n"), F.min("row_key").alias("row_key"),
        F.any_value("sig").alias("sig")), "classes")

    rows = classes.select("cls", "sig", "n").mapInArrow(
        lambda it: _paths(it, threshold, range(TREES), DEPTH), "node bigint, cls bigint, n bigint")
    shared = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor("cls").alias("members"),
        F.min(F.struct(F.xxhash64("cls", "node"), "cls")).getField("cls").alias("anchor")).filter("size > 1")
    # large leaves all stay: each may be branched further, with a chance to lose a pair
    shared = shared.groupBy("size", "members", F.when(F.col("size") > LEAF, F.col("node"))).agg(F.min(F.struct("node", "anchor")).alias("s"))
    met = stored(rows.join(shared.select("s.node", "s.anchor"), "node"), "met")

    wanted = met.select("cls").distinct()
    reps = classes.join(wanted, "cls", "left_semi").select("row_key")
    sets = stored(maybe_among(src, "row_key", reps).select("text").mapInArrow(
        lambda it: _full_sets(it, shingle), "cls bigint, members binary")
        .join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    size = classes.select(F.col("cls").alias("anchor"), F.col("n").alias("anchor_n"))
    first = met.filter("cls <> anchor").join(size, "anchor").filter(
        f"100 * least(n, anchor_n) >= {threshold} * greatest(n, anchor_n)")
    first = first.groupBy("cls", "anchor").count().groupBy("cls").agg(
        F.max_by("anchor", F.struct("count", "anchor")).alias("anchor"))
    links = stored(verify(first.selectExpr("cls AS a", "anchor AS b"), sets, threshold), "linked")
    label = components(links)

    # leaves that still hold several components
    rows = met.join(label.selectExpr("id AS cls", "component"), "cls", "left") \
              .selectExpr("node", "cls", "n", "coalesce(component, cls) AS label")
    leaves, depth = [], DEPTH
    while True:
        per = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"))
        mixed = per.groupBy("node").agg(
            F.sum("k").alias("size"), F.count(F.lit(1)).alias("labels"),
            F.max_by("label", F.struct("k", "label")).alias("major")).filter("labels > 1").drop("labels")
        rows = stored(rows.join(mixed, "node"), "mixed")
        last = depth >= MAX_DEPTH
        leaves.append(rows if last else rows.filter(F.col("size") <= LEAF))
        large = rows.filter(F.col("size") > LEAF)
        if last or large.isEmpty():
            break
        if depth == DEPTH:
            deep = stored(large.select("cls", "n", "label").distinct()
                          .join(sets.select("cls", "members"), "cls").select("cls", "n", "label", "members")
                          .mapInArrow(_all_trees, "cls bigint, n bigint, label bigint, sig binary"), "deep")
        rows = large.join(deep.select("cls", "sig"), "cls") \
                    .select("node", "cls", "n", "label", "sig").mapInArrow(
                        lambda it: _deeper(it, threshold),
                        "node bigint, cls bigint, n bigint, label bigint")
        if depth == DEPTH:
            rows = rows.unionByName(deep.select("cls", "sig", "n").mapInArrow(
                lambda it: _paths(it, threshold, range(TREES, TREES + EXTRA), DEPTH + 1),
                "node bigint, cls bigint, n bigint").join(deep.select("cls", "label"), "cls"))
        depth += 1
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionAll(more)
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    leaf = leaf.withColumns({"own": own, "probe": F.col("label") != F.col("major")})
    leaf = leaf.withColumn("block", F.explode(F.when(
        F.col("probe"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own"))))
    pairs = leaf.withColumn("build", F.col("own") == F.col("block")) \
        .join(sets.select("cls", "members"), "cls") \
        .select("node", "block", "cls", "n", "label", "build", "probe", "members") \
        .groupBy("node", "block").applyInArrow(lambda t: _compare(t, threshold), "a bigint, b bigint")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                   "pairs")
    label = components(links.unionAll(pairs))

    member = sk.select("doc_id", "row_key", "n_shingles", "cls") \
        .join(label.selectExpr("id AS cls", "component"), "cls", "left")
    # an empty document is its own component
    member = member.select("doc_id", "row_key", "n_shingles", F.when(
        F.col("n_shingles") > 0, F.coalesce("component", "cls")).alias("component"))
    low = member.filter("component IS NOT NULL").groupBy("component") \
                .agg(F.min("doc_id").alias("low"))
    out = member.join(low, "component", "left").select(
        "doc_id", "row_key", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of the smallest id.
    All columns stay as they are. Rows that share id and text are one document: one row of it
    stays, whichever is met first if they differ in other columns."""
    found = near_duplicates(docs, id_col, text_col, shingle, threshold)
    key = "_key"
    while key in docs.columns:
        key = "_" + key
    kept = found.filter("kept").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(kept, key, "left_semi") \
               .dropDuplicates([key]).drop(key)
