"""Spelling variant grouping by a relational trie frontier.

Words and their frequencies come from one pass over the texts. All words of up to ``DEPTH``
code points form two tries, of the words and of the reversed words, kept as one distributed
edge table ``(level, node, character)``; a node is the prefix that leads to it. The frontier
holds states (word, position, node, edits) and is joined with the edges level by level: a
state without edits follows its own letters and turns into a one-edit state where an edge
replaces or inserts a letter, one-edit states go on along equal letters only, and states that
reach the end of a word are its neighbours.

An edit in the second half of a word is looked for in the forward trie, one in the first half
in the backward trie, so states begin at the middle of the word, where nodes have few edges,
and every pair of neighbours comes out once: replacements with the greater letter, insertions
from the shorter word at the last place of a run. Edges under which one word is left hold its
remaining letters and end a state at once, and every edge has a 64-bit filter of the remainders
below it, so few states that lead nowhere go on to the next level.

Longer words meet in a join on the hashes of the word without one letter (at most one
partner per letter of the alphabet for each of them) and are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import BATCH_BYTES, scratch_path, stored

FOLD = 400_000              # words of a task's table before it is spilled
DEPTH = 32                  # code points of the longest words in the tries

_RUN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, one byte per code point."""
    return text.encode("latin-1", "replace").translate(_RUN).split()


def _start(doc_id: str) -> int:
    """The checksum of a document's part of its runs' keys."""
    from zlib import crc32
    return crc32(f"{doc_id}:".encode())


def _spelled(run: bytes, start: int) -> bytes:
    """The run as the document has it: for one run in 97, by a checksum of document and run, a
    letter is left out."""
    from zlib import crc32
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(shortest: int, limit: int = FOLD):
    def fold(batches):
        from collections import Counter

        import pyarrow as pa
        total: Counter = Counter()

        def spill():
            names, counts, size = [], [], 0
            for w, n in total.items():
                names.append(w.decode("latin-1"))
                counts.append(n)
                size += len(w) + 16
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                                                     names=["word", "n"])
                    names, counts, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                                                 names=["word", "n"])
            total.clear()

        for b in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                start = _start(doc_id)
                for run, n in Counter(r for r in runs(text) if len(r) >= shortest).items():
                    word = _spelled(run, start)
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) >= limit:
                    yield from spill()
        yield from spill()
    return fold


def spellings(docs: DataFrame, shortest: int = 5, least: int = 3, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``word, n`` of the spellings of at least ``shortest`` code points that occur ``least``
    times or more."""
    raw = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return raw.mapInArrow(_count(shortest), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= least)


def _slot(rest: Column) -> Column:
    return F.pmod(F.xxhash64(rest), F.lit(64)).cast("int")


def _letters(words: DataFrame) -> DataFrame:
    """``dir, word, s``: every word forward and reversed."""
    return words.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("dir"), "word").withColumn(
        "s", F.when(F.col("dir") == 0, F.col("word")).otherwise(F.reverse("word")))


def trie_edges(words: DataFrame, first: int) -> DataFrame:
    """``level, dir, node, ch, k, mask, label``: the edges from level ``first`` on that leave
    nodes with at least two words below. ``ch`` is '' where a word ends, ``k`` the number of
    words below, ``mask`` the filter of their remaining letters, ``label`` these letters if
    ``k`` is 1."""
    s = F.col("s")
    paths = _letters(words).select("dir", "s", F.explode(F.sequence(F.lit(first), F.length(s))).alias("level")) \
        .select("level", "dir", F.left(s, F.col("level")).alias("node"),
                F.substring(s, F.col("level") + 1, F.lit(1)).alias("ch"),
                F.substring(s, F.col("level") + 2, F.lit(DEPTH)).alias("rest"))
    edges = paths.repartition("dir", "node").groupBy("level", "dir", "node", "ch").agg(
        F.count("*").alias("k"), F.max("rest").alias("label"),
        F.expr("bit_or(shiftleft(1L, CAST(pmod(xxhash64(rest), 64) AS INT)))").alias("mask"))
    below = edges.groupBy("level", "dir", "node").agg(F.sum("k").alias("below")).filter("below > 1")
    return edges.join(below.select("dir", "node"), ["dir", "node"], "left_semi")


def _level(words: DataFrame, carried: DataFrame | None, edges: DataFrame, d: int) -> DataFrame:
    """One level of the frontier: ``dir, word, target, found``. ``target`` is the neighbour's
    spelling in the direction of the trie, known as soon as the edit is made."""
    m, half, ch, s = F.length("s"), F.floor(F.length("s") / 2), F.col("ch"), F.col("s")
    start = F.when(F.col("dir") == 0, half).otherwise(m - half)
    states = _letters(words).filter((m >= d) & (start <= d)).withColumn("node", F.left(s, F.lit(d)))

    def below(rest: Column) -> Column:
        return F.when(F.col("k") == 1, F.col("label") == rest).otherwise(F.getbit("mask", _slot(rest)) == 1)

    own, last = F.substring(s, d + 1, 1), F.substring(s, d, 1)
    after, kept = F.substring(s, d + 2, DEPTH), F.substring(s, d + 1, DEPTH)
    replaced = (m > d) & (ch > own) & below(after)
    place = F.when(F.col("dir") == 0, ch != own).otherwise((ch != last) & (d > m - half))
    inserted = (ch != "") & place & below(kept)
    node = F.col("node")
    made = states.join(edges, ["dir", "node"]).filter(replaced | inserted).select(
        "dir", "word", (F.col("k") == 1).alias("found"), F.explode(F.array_compact(F.array(
            F.when(replaced, F.concat(node, ch, after)), F.when(inserted, F.concat(node, ch, kept))))).alias("target"))
    if carried is not None:
        t = F.col("target")
        going = carried.withColumn("node", F.left(t, F.lit(d))).withColumn("ch", F.substring(t, d + 1, 1)) \
            .join(edges, ["dir", "node", "ch"]).filter(below(F.substring(t, d + 2, DEPTH)))
        made = made.unionByName(going.select("dir", "word", (F.col("k") == 1).alias("found"), "target"))
    return made


def _short_pairs(words: DataFrame, shortest: int) -> DataFrame:
    """Neighbours ``a, b`` among words of up to ``DEPTH`` code points, each pair once."""
    spark = words.sparkSession
    short = words.filter(F.length("word") <= DEPTH).select("word")
    first = shortest // 2
    base = scratch_path(spark, "trie-edges")
    edges = trie_edges(short, first)
    edges.hint("rebalance", "level").write.partitionBy("level").parquet(base)
    edges = spark.read.schema(edges.schema).parquet(base)
    last = edges.agg(F.max("level")).first()[0]
    path, schema = scratch_path(spark, "frontier"), "dir int, word string, found boolean, target string"
    carried = None
    spark.createDataFrame([], schema).write.parquet(f"{path}/level=0")
    for d in range(first, (last or 0) + 1):
        made = _level(short, carried, edges.filter(F.col("level") == d).drop("level"), d)
        made.select("dir", "word", "found", "target").write.parquet(f"{path}/level={d}")
        carried = spark.read.schema(schema).parquet(f"{path}/level={d}").filter("NOT found").drop("found")
    found = spark.read.schema(schema).parquet(path).filter("found")
    return found.select(F.col("word").alias("a"), F.when(F.col("dir") == 0, F.col("target")).otherwise(
        F.reverse("target")).alias("b"))


def _long_pairs(words: DataFrame) -> DataFrame:
    """Neighbours ``a, b`` of which the longer has more than ``DEPTH`` code points."""
    w, m = F.col("word"), F.length("word")
    long = words.filter(m >= DEPTH).select("word", F.xxhash64("word").alias("id"))
    cut = long.filter(m > DEPTH).select("id", "word", F.explode(F.sequence(F.lit(0), m - 1)).alias("j")).select(
        "id", "j", F.xxhash64(F.concat(F.left(w, F.col("j")), F.substring(w, F.col("j") + 2, m))).alias("key"))
    replaced = cut.alias("x").join(cut.alias("y"), F.expr("x.j = y.j AND x.key = y.key AND x.id < y.id"))
    inserted = long.select("id").alias("x").join(cut.alias("y"), F.expr("x.id = y.key"))
    pairs = replaced.selectExpr("x.id AS p", "y.id AS q").unionAll(inserted.selectExpr("x.id AS p", "y.id AS q"))
    named = pairs.distinct().join(long.selectExpr("id AS p", "word AS a"), "p").join(
        long.selectExpr("id AS q", "word AS b"), "q")
    return named.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def spelling_pairs(words: DataFrame, shortest: int = 5) -> DataFrame:
    """Pairs ``a, b`` of words (column ``word``, distinct, at least ``shortest`` code points)
    that differ by exactly one inserted, deleted or replaced code point, each pair once."""
    return _short_pairs(words, shortest).unionAll(_long_pairs(words))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form of each word's chain, by pointer doubling. Frequencies at
    least double along a chain, so chains are short and have no cycles."""
    links = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Every word with its more frequent spelling: ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (ties:
    smallest in code-point order) if it occurs at least twice as often as the word, ``form_n``
    its frequency, else both are null; ``root`` is the last word of the chain of forms, the
    word itself if it has none.

    Defined cases: null and empty texts have no words; a null id counts as an empty one in the
    checksum. Repeated rows count as often as they occur. Words of any length take part. Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    words = stored(spellings(docs, shortest, least, id_col, text_col), "spellings")
    pairs = stored(spelling_pairs(words, shortest), "spelling-pairs")
    known = pairs.join(words.selectExpr("word AS a", "n AS n_a"), "a").join(
        words.selectExpr("word AS b", "n AS n_b"), "b")
    near = known.selectExpr("a AS word", "n_a AS n", "b AS near", "n_b AS n_other").unionAll(
        known.selectExpr("b AS word", "n_b AS n", "a AS near", "n_a AS n_other"))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(
        (-F.col("n_other")).alias("less"), "near")).alias("best"))
    out = stored(words.join(best, "word", "left").withColumn(
        "form_n", F.when(-F.col("best.less") >= 2 * F.col("n"), -F.col("best.less"))).select(
        "word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"), "forms")
    roots = _roots(out.filter("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                  "n", "n_near", "form_n")
