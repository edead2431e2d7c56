"""Source divergence audit with in-mapper stripes.

A partition folds whole documents into hash stripes, term -> (document frequency, occurrences
per source), one table per language. A table that reaches ``FOLD`` cells is spilled as rows and
emptied, so a task's memory does not grow with its partition; stripes of the same term are then
merged by key. Merged stripes are dealt to blocks of about ``BLOCK_CELLS`` cells, and each block
emits, straight from its stripes, the sums of divergences between sources and each source's
leading terms; the last step adds up and ranks these few rows.

All arithmetic is on integers: ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` by long division in
three steps of three digits, exact up to ``N + 2 V`` of 9 * 10^15.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import BATCH_BYTES, stored

FOLD = 250_000              # cells of a task's hash tables before they are spilled
BLOCK_CELLS = 200_000       # cells of a block of merged stripes
DENSE = 1 << 20             # numbers in a dense piece of a block
CELLS = "lang string, term string, source string, docs bigint, n bigint"

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, of UTF-8."""
    return text.translate(_KEEP).split()


def _fold(batches, limit: int = FOLD):
    """Cells ``(lang, term, source, documents, occurrences)`` of the documents of a partition."""
    from collections import Counter

    import pyarrow as pa
    seen: dict[bytes, Counter] = {}               # language -> term -> documents
    count: dict[tuple[bytes, bytes], Counter] = {}  # (language, source) -> term -> occurrences

    def spill():
        rows = {c: [] for c in ("lang", "term", "source", "docs", "n")}
        size = 0
        for (lang, source), cells in count.items():
            docs = seen[lang]
            for term, n in cells.items():
                rows["lang"].append(lang)
                rows["term"].append(term)
                rows["source"].append(source)
                rows["docs"].append(docs.pop(term, 0))    # with the first source that has the term
                rows["n"].append(n)
                size += len(lang) + len(term) + len(source) + 20
                if size > BATCH_BYTES:
                    yield batch(rows)
                    size, rows = 0, {c: [] for c in rows}
        if rows["n"]:
            yield batch(rows)
        seen.clear()
        count.clear()

    def batch(rows):
        text = {c: pa.array(rows[c], pa.binary()).view(pa.string()) for c in ("lang", "term", "source")}
        return pa.RecordBatch.from_arrays(
            [text["lang"], text["term"], text["source"], pa.array(rows["docs"], pa.int64()),
             pa.array(rows["n"], pa.int64())], names=list(rows))

    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            words = terms(text)
            if words:
                seen.setdefault(lang, Counter()).update(set(words))
                count.setdefault((lang, source), Counter()).update(words)
                if sum(map(len, count.values())) >= limit:
                    yield from spill()
    yield from spill()


def merged_stripes(docs: DataFrame, min_docs: int = 10, lang_col: str = "lang", source_col: str = "source",
                   text_col: str = "text") -> DataFrame:
    """``lang, term, docs, stripe`` (stripe: array of ``(source, n)``) of the terms that at least
    ``min_docs`` documents of their language hold. Nulls count as ''."""
    raw = docs.select(*[F.coalesce(F.col(c), F.lit("")).cast("binary").alias(n) for c, n in
                        ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    cells = raw.mapInArrow(_fold, CELLS).repartition("lang", "term")
    per = cells.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return per.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(
        F.struct("source", "n")).alias("stripe")).filter(F.col("docs") >= min_docs)


def parts_of(count, total):
    """``1 + floor(10^9 (count + 2) / total)`` of integer arrays (``count + 2 <= total``)."""
    import numpy as np
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _block(leading: int, dense: int = DENSE):
    """Divergences of one block: the sums between any two sources of the language (each pair in
    both directions), and the ``leading`` terms of every source by value, then by term."""
    def run(left, right):
        import numpy as np
        import pyarrow as pa
        lang = right.column("lang")[0].as_py()
        sources = sorted(right.column("source").to_pylist(), key=str.encode)
        place = {s: i for i, s in enumerate(sources)}
        own = dict(zip(right.column("source").to_pylist(), right.column("total").to_pylist()))
        v = right.column("v")[0].as_py()
        total = np.array([own[s] + 2 * v for s in sources], dtype=np.int64)
        every = right.column("every")[0].as_py() + 2 * v
        s_n, t_n = len(sources), left.num_rows
        sums = np.zeros((s_n, s_n), dtype=np.int64)
        best: list[list[tuple[int, bytes]]] = [[] for _ in sources]
        step = max(1, dense // max(s_n, 1))
        for at in range(0, t_n, step):
            piece = left.slice(at, step)
            names = [t.encode() for t in piece.column("term").to_pylist()]
            stripes = piece.column("stripe").combine_chunks()
            cells, bounds = stripes.flatten(), np.diff(stripes.offsets.to_numpy())
            row = np.repeat(np.arange(len(names)), bounds)
            col = np.array([place[s] for s in cells.field("source").to_pylist()], dtype=np.int64)
            n = np.zeros((s_n, len(names)), dtype=np.int64)
            n[col, row] = cells.field("n").to_numpy()
            p = parts_of(n, total[:, None])
            for i in range(s_n - 1):
                d = p[i + 1:] - p[i]
                sums[i, i + 1:] += (d * d // (p[i + 1:] + p[i])).sum(axis=1)
            q = parts_of(n.sum(axis=0), np.int64(every))
            f = (p - q) ** 2 // (p + q)
            held = (n > 0) & (p > q)
            for i in range(s_n):
                there = np.flatnonzero(held[i])
                if len(there) > leading:        # all that tie with the last one stay for the moment
                    floor = np.partition(f[i, there], -leading)[-leading]
                    there = there[f[i, there] >= floor]
                best[i] = sorted(best[i] + [(-int(f[i, t]), names[t]) for t in there])[:leading]
        sums += sums.T
        out = [(lang, s, "pair", o, int(sums[i, j])) for i, s in enumerate(sources)
               for j, o in enumerate(sources) if i != j]
        out += [(lang, s, "term", t.decode(), -f) for i, s in enumerate(sources) for f, t in best[i]]
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.string()] * 4 + [pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                    names=["lang", "source", "part", "item", "value"])
    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, leading: int = 10, lang_col: str = "lang",
                      source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How the sources of each language differ: ``lang, source, part, item, value, rank``.

    Part ``pair`` has the divergence from every other source of the language, the sum over the
    kept terms of ``floor((p - q)^2 / (p + q))``; part ``term`` the ``leading`` terms that the
    source uses more than the language does, by the same expression. Ranks go by value
    descending, then by item in UTF-8 order.

    Defined cases: null text, language and source are ''. Every occurring (language, source)
    takes part, also without terms; a language without kept terms has pairs of value 0, one
    with a single source no pairs. Repeated rows are documents of their own; ids and other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    kept = stored(merged_stripes(docs, min_docs, lang_col, source_col, text_col), "stripes")
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in
                           ((lang_col, "lang"), (source_col, "source"))]).distinct()
    totals = kept.select("lang", F.explode("stripe").alias("c")).groupBy(
        "lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"), F.count("*").alias("cells"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    own = stored(groups.join(totals, ["lang", "source"], "left").join(size, "lang", "left").select(
        "lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("total", "cells", "v")]),
        "stripe-totals")
    per = own.groupBy("lang").agg(F.sum("total").alias("every"), F.greatest(
        F.ceil(F.sum("cells") / BLOCK_CELLS), F.lit(1)).cast("int").alias("blocks"))
    dealt = kept.join(per.select("lang", "blocks"), "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    facts = own.join(per, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    emitted = dealt.select("lang", "block", "term", "stripe").groupBy("lang", "block").cogroup(
        facts.select("lang", "block", "source", "total", "v", "every").groupBy("lang", "block")).applyInArrow(
        _block(leading), "lang string, source string, part string, item string, value bigint")
    rows = stored(emitted, "divergences")
    pairs = rows.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, rows.filter("part = 'term'"))]
    return ranked[0].unionAll(ranked[1].filter(F.col("rank") <= leading))


def divergence_oracle_sql(min_docs: int = 10, leading: int = 10) -> str:
    """The same result in SQL, over the dense table of sources and kept terms."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                       '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(total) AS every FROM s GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, every, v,
    CAST(1 + (1000000000 * (coalesce(n, 0) + 2)::HUGEINT) // (total + 2 * v)::HUGEINT AS BIGINT) AS p
  FROM k JOIN s USING (lang) JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 2)::HUGEINT) // (any_value(every) + 2 * any_value(v))::HUGEINT
    AS BIGINT) AS q FROM p GROUP BY lang, term),
pairs AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
  FROM g a JOIN g b USING (lang) LEFT JOIN (
    SELECT x.lang, x.source AS s1, y.source AS s2, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND s1 = a.source AND s2 = b.source WHERE a.source <> b.source),
named AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM named))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {leading}"""
