"""Line dedup by exact set-similarity join.

A line is the set of its distinct words. Lines of equal sets form one *class*, placed where
its first line is. The join finds every pair of classes whose Jaccard similarity reaches the
threshold; a line goes when its class has an earlier line or matches an earlier class.

* Rarity order: a fixed-size table of hashed line frequencies over all lines (``COUNTERS``
  counters). Any total order of the words gives exact results; how rare words come out only
  decides how many candidates there are. A counter of 1 proves that a word occurs in one line.
* Prefix filter: two matching lines share a word among the first ``n - ceil(t n) + 1`` words of
  each, and behind their first shared word either has as many words as they must share. Length
  filter, and an upper bound of the overlap from word parity marks (128 bits, 512 for lines over
  ``WIDE_FROM`` words). None of them loses a match.
* Groups of near copies of one line would give quadratically many pairs. So each class is first
  compared with the ``HEADS`` earliest classes under its most frequent prefix words (a large
  group makes its words frequent), and the one closest by its marks is verified; where it
  matches, the class is settled. Further pairs are
  looked for only where the class that may be the later one is not settled, and of those the
  closest one of each class is verified first: whole sets travel for one pair per class, and for
  the other pairs of classes that this leaves open.
* Classes meet the few that are settled or looked up through the bounded filter of
  :func:`~seqlake.llm.common.flag_among`, so that the others need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqlake.llm import words
from seqlake.llm.common import (SLICE, SLICE_SCHEMA, flag_among, fresh, maybe_among, row_key, slices_of,
                                stored, summed)
from seqlake.llm.near_dedup import verify

COUNTERS = 1 << 22     # counters of the rarity table (32-bit: 16 MB, at any size of the corpus)
FREQUENT = 16          # lines from which a prefix word's earliest classes are tried first
HEADS = 32             # so many of them per word and length band
TRIED = 2              # so many of a line's frequent prefix words, most frequent first, are tried
WIDE_FROM = 256        # words from which 128 parity bits say too little
WIDE_LONGS = 8         # 64-bit words of their longer marks, which tell lines of up to about 1,000 apart

CLASS_SCHEMA = ("cls bigint, row_key bigint, doc_id bigint, line int, n int, mark0 bigint, "
                "mark1 bigint, prefix array<int>, frequent array<int>, "
                "wide struct<w0:bigint,w1:bigint,w2:bigint,w3:bigint,w4:bigint,w5:bigint,w6:bigint,w7:bigint>")


def _wide_marks(flat: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> pa.StructArray:
    """512 parity marks of the lines over ``WIDE_FROM`` words, null for the others."""
    marks = np.zeros((len(n), WIDE_LONGS), dtype=np.int64)
    long = n > WIDE_FROM
    for i in np.flatnonzero(long).tolist():
        own = (flat[bounds[i]:bounds[i + 1]] >> np.uint64(20)).astype(np.int64) & (64 * WIDE_LONGS - 1)
        odd = np.bincount(own, minlength=64 * WIDE_LONGS) & 1
        marks[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(marks[:, k]) for k in range(WIDE_LONGS)],
                                      names=[f"w{k}" for k in range(WIDE_LONGS)], mask=pa.array(~long))


def _line_sets(texts: list[str | None]):
    """Per block of texts: first text, lines per text, distinct words of each line."""
    for first, group in words.blocks(texts):
        lines, count = [], []
        for e in group:
            own = e.split(b"\n")
            lines += own
            count.append(len(own))
        h, bounds = words.words_of(lines)
        yield first, np.array(count), *words.distinct(h, bounds)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, dtype=np.uint32)
    for batch in batches:
        for _, _, flat, _ in _line_sets(batch.column(0).to_pylist()):
            np.add.at(total, (flat & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
    step = 64 * SLICE
    for at in range(0, COUNTERS, step):
        rows = slices_of(total[at:at + step])
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()),
                 pa.array([r[1] + at // SLICE for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["kind", "slice", "data"])


def _classes(batches: Iterator[pa.RecordBatch], rarity: np.ndarray, threshold: int,
             frequent_from: int) -> Iterator[pa.RecordBatch]:
    """One row per line that has words: its class, place, marks and prefix."""
    top = np.uint64((1 << 20) - 1)
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1)
        for first, count, flat, bounds in _line_sets(batch.column(2).to_pylist()):
            n = np.diff(bounds)
            cls, _ = words.set_digests(flat, bounds)
            freq = rarity[(flat & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
            # rarest first: the frequency leads, ties by the word's hash
            order = (np.minimum(freq, top) << np.uint64(44)) | (flat >> np.uint64(20))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                order[a:b].sort()
            parity = np.zeros((2, len(n)), dtype=np.uint64)
            full = np.flatnonzero(n)
            bit = (flat >> np.uint64(30)) & np.uint64(127)
            for half in range(2):
                own = np.where((bit >> np.uint64(6)) == half,
                               np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
                if len(full):
                    parity[half, full] = np.bitwise_xor.reduceat(own, bounds[:-1][full])
            size = n - (threshold * n + 99) // 100 + 1
            size[n == 0] = 0
            word = words.mix(order).astype(np.uint32).view(np.int32)
            often = order >> np.uint64(44)
            # prefixes laid end to end
            at = np.concatenate(([0], np.cumsum(size[full])))
            place = np.repeat(bounds[:-1][full] - at[:-1], size[full]) + np.arange(at[-1])
            pre, pre_often = word[place], often[place]
            prefix = pa.ListArray.from_arrays(
                pa.array(at, pa.int32()), pa.array(pre, pa.int32(), mask=pre_often < 2))
            hot = pre_often >= frequent_from
            seen = np.concatenate(([0], np.cumsum(hot)))
            hot &= np.repeat(seen[at[1:]], size[full]) - seen[1:] < TRIED
            hot_at = np.concatenate(([0], np.cumsum(hot)))[at]
            frequent = pa.ListArray.from_arrays(pa.array(hot_at, pa.int32()),
                                                pa.array(pre[hot], pa.int32()))
            doc = np.repeat(np.arange(len(count)), count)
            line = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[full].view(np.int64)), pa.array(keys[first + doc[full]]),
                 ids.take(pa.array(first + doc[full])), pa.array(line[full], pa.int32()),
                 pa.array(n[full], pa.int32()), pa.array(parity[0, full].view(np.int64)),
                 pa.array(parity[1, full].view(np.int64)), prefix, frequent,
                 _wide_marks(flat, np.append(bounds[:-1][full], bounds[-1]), n[full])],
                names=[c.split()[0] for c in CLASS_SCHEMA.split(", ")])


def _sets_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text, lines)`` -> ``(cls, members)`` of the listed lines."""
    for batch in batches:
        cls, members = [], []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            lines = text.as_py().encode("utf-8", "surrogatepass").split(b"\n")
            flat, bounds = words.distinct(*words.words_of([lines[i] for i in wanted]))
            cls.append(words.set_digests(flat, bounds)[0].view(np.int64))
            members += [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cls) if cls else np.empty(0, np.int64)),
             pa.array(members, pa.binary())], names=["cls", "members"])


def _strip(batches: Iterator[pa.RecordBatch], text: int, keep: int,
           names: list[str]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its kept lines; adds the numbers of lines with words and of those
    removed. A text that keeps all its lines is not rebuilt."""
    for batch in batches:
        out, total, gone = [], [], []
        for t, k in zip(batch.column(text).to_pylist(), batch.column(keep).to_pylist()):
            if t is None:
                out.append(None)
                total.append(0)
                gone.append(0)
                continue
            lines = t.split("\n")
            # the words of words.py: other Unicode white space is part of a word
            has = [bool(x.strip(" \t\r\x0b\x0c")) for x in lines]
            n, kept = sum(has), set(k or ())
            total.append(n)
            gone.append(n - len(kept))
            if n == len(kept):
                out.append(t)
            else:
                out.append("\n".join(x for i, x in enumerate(lines) if i in kept or not has[i])
                           if kept else "")
        cols = [pa.array(out, pa.string()) if i == text else c
                for i, c in enumerate(batch.columns) if i != keep]
        yield pa.RecordBatch.from_arrays(
            cols + [pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=names)


def matching_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """``(classes, matches)``: one row per class of lines with its first place, and every pair
    ``(cls, earlier)`` that keeps a class from staying -- at least one per class that goes."""
    t = int(threshold)
    spark = docs.sparkSession
    src = docs.select(row_key(id_col, text_col).alias("row_key"),
                      F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(
        summed(src.select("text").mapInArrow(_frequencies, SLICE_SCHEMA), 1, COUNTERS, "uint32")[0])
    often_from = FREQUENT       # the driver's value travels to the workers
    lines = src.mapInArrow(lambda it: _classes(it, table.value, t, often_from), CLASS_SCHEMA)
    classes = stored(lines.groupBy("cls").agg(
        F.min(F.struct("doc_id", "row_key", "line")).alias("place"), F.max("n").alias("n"),
        F.max("mark0").alias("mark0"), F.max("mark1").alias("mark1"),
        F.any_value("prefix").alias("prefix"), F.any_value("frequent").alias("frequent"),
        F.any_value("wide").alias("wide")), "lines")
    table.destroy()             # the lines are stored, nothing reads it again

    need = f"((({t} * (x.n + y.n)) + {t + 99}) DIV {100 + t})"
    sized = f"100 * least(x.n, y.n) >= {t} * greatest(x.n, y.n)"
    differ = "bit_count(x.mark0 ^ y.mark0) + bit_count(x.mark1 ^ y.mark1)"
    marked = f"(x.n + y.n - ({differ})) DIV 2 >= {need}"
    doc = F.coalesce(F.col("place.doc_id"), F.lit(-(1 << 63))).alias("doc")     # a null id sorts first

    # 1. the earliest classes under frequent prefix words
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / t))).cast("int").alias("band")
    often = classes.select("cls", doc, "n", "mark0", "mark1", band, F.explode("frequent").alias("word"))
    early = Window.partitionBy("word", "band").orderBy("doc", "cls")
    heads = often.withColumn("rank", F.row_number().over(early)).filter(F.col("rank") <= HEADS).drop("rank")
    tried = often.alias("x").join(heads.alias("y"), ["word", "band"]) \
        .filter(f"x.cls <> y.cls AND y.doc <= x.doc AND {sized} AND {marked}") \
        .groupBy(F.col("x.cls").alias("a")).agg(
            F.max_by("y.cls", F.struct(-F.expr(differ) / F.expr("x.n + y.n"), "y.cls")).alias("b"))
    found = _verified(spark, src, classes, stored(tried, "tried"), t)
    settled = found.select(F.col("later").alias("cls")).distinct()

    # 2. all pairs of which a class that may be the later one is not settled
    flagged = flag_among(classes, "cls", settled, "open")
    opened = flagged.filter("NOT open").withColumn("open", F.lit(True)).unionByName(
        flagged.filter("open").drop("open").join(settled.withColumn("settled", F.lit(True)), "cls", "left")
        .withColumn("open", F.col("settled").isNull()).drop("settled"))
    rows = opened.select("cls", "n", "mark0", "mark1", "wide", doc, "open",
                         F.posexplode("prefix").alias("j", "word")).filter("word IS NOT NULL")
    x, y = rows.alias("x"), rows.alias("y")
    # holds where the first word lies that the two lines share
    reach = f"{100 + t}L * least(x.n - x.j, y.n - y.j) >= {t}L * (x.n + y.n)"
    late = "((x.open AND y.doc <= x.doc) OR (y.open AND x.doc <= y.doc))"
    differ_wide = " + ".join(f"bit_count(x.wide.w{i} ^ y.wide.w{i})" for i in range(WIDE_LONGS))
    wide = f"(x.wide IS NULL OR y.wide IS NULL OR (x.n + y.n - ({differ_wide})) DIV 2 >= {need})"
    pairs = x.join(y, F.expr(f"x.word = y.word AND x.cls < y.cls AND {reach} AND {sized} AND {late} "
                             f"AND {marked} AND {wide}"))
    # the same for all rows of a pair: how close its marks are, and which of the two has to be settled
    pairs = pairs.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(
        F.any_value(F.expr("x.open AND y.doc <= x.doc")).alias("for_a"),
        F.any_value(F.expr("y.open AND x.doc <= y.doc")).alias("for_b"),
        F.any_value(-F.coalesce(F.expr(differ_wide), F.expr(differ)) / F.expr("x.n + y.n")).alias("hope"))
    pairs = stored(pairs, "pairs")
    ends = pairs.filter("for_a").selectExpr("a AS cls", "a", "b", "hope").unionAll(
        pairs.filter("for_b").selectExpr("b AS cls", "a", "b", "hope"))
    best = ends.groupBy("cls").agg(F.max_by(F.struct("a", "b"), F.struct("hope", "a", "b")).alias("p"))
    first = _verified(spark, src, classes, stored(best.select("p.a", "p.b").distinct(), "best"), t)
    # 3. the other pairs of classes that are still open
    done = first.select(F.col("later").alias("cls")).distinct()
    left = pairs.join(best.select("p.a", "p.b").distinct(), ["a", "b"], "left_anti")
    left = left.join(done.selectExpr("cls AS a", "true AS a_done"), "a", "left") \
               .join(done.selectExpr("cls AS b", "true AS b_done"), "b", "left") \
               .filter("(for_a AND a_done IS NULL) OR (for_b AND b_done IS NULL)")
    rest = _verified(spark, src, classes, stored(left.select("a", "b"), "left"), t)
    return classes, found.unionAll(first).unionAll(rest)


def _verified(spark, src: DataFrame, classes: DataFrame, pairs: DataFrame, t: int) -> DataFrame:
    """The pairs confirmed on the whole sets, as ``(later, earlier)`` by place."""
    wanted = pairs.selectExpr("a AS cls").unionAll(pairs.selectExpr("b AS cls")).distinct()
    at = stored(maybe_among(classes.select("cls", "place"), "cls", wanted).join(wanted, "cls", "left_semi"), "wanted")
    per_doc = at.groupBy(F.col("place.row_key").alias("row_key")).agg(
        F.sort_array(F.collect_list("place.line")).alias("lines"))
    texts = maybe_among(src.select("row_key", "text"), "row_key", per_doc.select("row_key"))
    sets = stored(texts.join(per_doc, "row_key").select("text", "lines")
                  .mapInArrow(_sets_of_lines, "cls bigint, members binary")
                  .dropDuplicates(["cls"]), "sets")
    p = verify(pairs, sets, t)
    p = p.join(at.selectExpr("cls AS a", "place AS _x"), "a") \
         .join(at.selectExpr("cls AS b", "place AS _y"), "b")
    first = F.expr("struct(_x, a) < struct(_y, b)")
    return stored(p.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"),
                           F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier")), "matches")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: int = 80, lines_col: str = "n_lines",
                removed_col: str = "n_removed") -> DataFrame:
    """``docs`` without later matching lines, and per document the number of lines that have
    words (``n_lines``) and of those removed (``n_removed``).

    A line is removed when some earlier line -- by id, then text hash, then line number,
    whether that line stays or not -- has Jaccard similarity of at least ``threshold`` per
    cent with it; words are runs of characters other than space and ``\\x09``-``\\x0D``, A-Z
    as a-z. Remaining lines keep their order and their line breaks.

    Defined cases: lines without words match nothing and stay, but a text that loses all its
    other lines becomes empty. A null text stays null, an empty one empty, both with 0 lines.
    A null id sorts first. Rows repeating an id and a text are the same document: all of them
    keep the same lines. Other columns are passed through; the two new ones are named by the
    caller and must not exist. An empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}
    for c in (lines_col, removed_col):
        if c.lower() in taken:
            raise ValueError(f"column {c!r} exists already")
    classes, matches = matching_lines(docs, id_col, text_col, threshold)
    gone = matches.select(F.col("later").alias("cls")).distinct()
    flagged = flag_among(classes.select("cls", "place"), "cls", gone, "maybe")
    stay = flagged.filter("NOT maybe").unionByName(flagged.filter("maybe").join(gone, "cls", "left_anti"))
    key, keep = fresh(docs, "_key"), fresh(docs, "_keep")
    stay = stay.groupBy(F.col("place.row_key").alias(key)).agg(
        F.collect_list("place.line").alias(keep))
    j = docs.withColumn(text_col, F.col(text_col).cast("string")) \
            .withColumn(key, row_key(id_col, text_col)).join(stay, key, "left")
    j = j.select(*[F.col(c) for c in docs.columns], F.col(keep))
    schema = StructType([*j.schema.fields[:-1], StructField(lines_col, LongType()),
                         StructField(removed_col, LongType())])
    names = [*docs.columns, lines_col, removed_col]
    text, last = docs.columns.index(text_col), len(docs.columns)
    return j.mapInArrow(lambda it: _strip(it, text, last, names), schema)
