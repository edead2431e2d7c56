"""Registered queries, steps 2-4: intervals, tiling, sequences, tokens, indices, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlake.functions import tokens as TK
from seqlake.operators import indexing as IX
from seqlake.operators import tiling as TL
from seqlake.plans.fixtures import (BATCH, CHUNK, OVERLAP, SEGMENT, TILE, bad_intervals,
                                    bed_file, chunk_table, contig_length_table, contig_sequences,
                                    fasta_file, fasta_index, whole_intervals)
from seqlake.plans.registry import query
from seqlake.sources.bed import bed_scan
from seqlake.sources.fasta import contig_lengths, fasta_scan
from seqlake.sources.fasta_index import fasta_indexed

N_TILES = SEGMENT // TILE
SKIP = (3, 17, 8590)

# ---------------------------------------------------------------- oracle building blocks

IV = f"""iv AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS chr_name, CAST(k * {SEGMENT} AS BIGINT) AS start,
         CAST(k * {SEGMENT} + {SEGMENT} AS BIGINT) AS "end",
         CASE WHEN doc_id % 10 = 8 THEN 'valid' WHEN doc_id % 10 = 9 THEN 'test'
              ELSE 'train' END AS split
  FROM (SELECT doc_id, unnest(range(0, n_chars // {SEGMENT})) AS k
        FROM documents WHERE n_chars >= {SEGMENT}))"""

# every character of every document: the last segment may run past the end
IV_WHOLE = f"""iv AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS chr_name, CAST(k * {SEGMENT} AS BIGINT) AS start,
         CAST(k * {SEGMENT} + {SEGMENT} AS BIGINT) AS "end",
         CASE WHEN doc_id % 10 = 8 THEN 'valid' WHEN doc_id % 10 = 9 THEN 'test'
              ELSE 'train' END AS split
  FROM (SELECT doc_id, unnest(range(0, (n_chars + {SEGMENT - 1}) // {SEGMENT})) AS k FROM documents))"""

SEQS = """seqs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS contig,
         regexp_replace(text, '[^A-Za-z]', 'N', 'g') AS seq FROM documents)"""

TILES = f"""tiles AS (
  SELECT iv.doc_id, iv.chr_name, iv.split, CAST(t AS INTEGER) AS tile_idx,
         iv.start AS interval_start, iv."end" AS interval_end,
         iv.start + t * {TILE} AS start, iv.start + (t + 1) * {TILE} AS "end"
  FROM iv, (SELECT unnest(range(0, {N_TILES})) AS t) r)"""

TILE_SEQ = f"""tseq AS (
  SELECT tiles.*, substring(seqs.seq, CAST(tiles.start + 1 AS BIGINT), {TILE}) AS seq
  FROM tiles JOIN seqs ON seqs.contig = tiles.chr_name WHERE tiles.start < length(seqs.seq))"""


def _tok_sql(x: str) -> str:
    return (f"translate(regexp_replace(translate({x}, 'acgtn', 'ACGTN'), '[^ACGNT]', '6', 'g'), "
            f"'ACGTN', '789:;')")


TRAIN_IDX = f"""tr AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, start) - 1 AS iidx FROM iv WHERE split = 'train'),
ix AS (
  SELECT chr_name, CAST(t AS INTEGER) AS tile_idx, start + t * {TILE} AS start,
         start + (t + 1) * {TILE} AS "end", iidx * {N_TILES} + t AS idx
  FROM tr, (SELECT unnest(range(0, {N_TILES})) AS t) r)"""

BAD_IV = f"""bad AS (
  SELECT chr_name, start, "end", split FROM iv
  UNION ALL SELECT CAST(doc_id AS VARCHAR), n_chars - 128, n_chars + 128, 'train'
            FROM documents WHERE n_chars >= {SEGMENT}
  UNION ALL SELECT CAST(doc_id AS VARCHAR), -1, {SEGMENT - 1}, 'valid'
            FROM documents WHERE n_chars >= {SEGMENT}
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, {SEGMENT - 1}, 'test'
            FROM documents WHERE n_chars >= {SEGMENT}
  UNION ALL SELECT 'x' || CAST(doc_id AS VARCHAR), 0, {SEGMENT}, 'train'
            FROM documents WHERE n_chars >= {SEGMENT}),
lens AS (SELECT CAST(doc_id AS VARCHAR) AS chr_name, CAST(length(text) AS BIGINT) AS contig_len
         FROM documents)"""


# ---------------------------------------------------------------- Spark building blocks

def _intervals(spark, sf, with_order=False):
    return bed_scan(spark, bed_file(spark, sf), with_order=with_order)


def _tiles(spark, sf):
    return TL.tile(_intervals(spark, sf), TILE, SEGMENT)


def _whole_tiles(spark, sf):
    """The tiles that hold a character of a document; the last one may run past its end."""
    tiles = TL.tile(bed_scan(spark, bed_file(spark, sf, whole_intervals)), TILE, SEGMENT)
    lens = contig_length_table(spark, sf)
    return TL.contig_bounds(tiles, lens).filter("start < contig_len").drop("contig_len")


def _tile_seqs(spark, sf):
    return TL.tile_sequence(_whole_tiles(spark, sf), chunk_table(spark, sf), CHUNK, OVERLAP,
                            tile_len=TILE)


def _train_indexed(spark, sf):
    """Train tiles with their sample index: intervals are indexed in file order (D4), then
    tile ``t`` of interval ``i`` is sample ``i * n_tiles + t``."""
    iv = TL.split_filter(_intervals(spark, sf, with_order=True), "train")
    iv = IX.global_index(iv, ["file_order"], "interval_idx").drop("file_order")
    return TL.tile(iv, TILE, SEGMENT, interval_idx="interval_idx")


_IX_COLS = ["chr_name", "tile_idx", "start", "end", "idx"]


# ---------------------------------------------------------------- A1, B1, F1, A2, F2, D1

@query("bed_scan", f"WITH {IV} SELECT chr_name, start, \"end\", split FROM iv")
def q_bed_scan(spark, sf):
    return _intervals(spark, sf)


@query("split_filter", f"WITH {IV} SELECT chr_name, start, \"end\", split FROM iv "
                       f"WHERE split = 'train'")
def q_split_filter(spark, sf):
    return TL.split_filter(_intervals(spark, sf), "train", strict=True)


@query("contig_lengths", "SELECT CAST(doc_id AS VARCHAR) AS contig, "
                         "CAST(length(text) AS BIGINT) AS length FROM documents")
def q_contig_lengths(spark, sf):
    return contig_length_table(spark, sf)


@query("contig_lengths_scan", "SELECT CAST(doc_id AS VARCHAR) AS contig, "
                              "CAST(length(text) AS BIGINT) AS length FROM documents WHERE length(text) > 0")
def q_contig_lengths_scan(spark, sf):
    """F1 from the chunks, for sources without an index (contigs without bases have no chunk)."""
    return contig_lengths(chunk_table(spark, sf))


_CHUNKS_SQL = f"""
WITH {SEQS}
SELECT contig, CAST(k AS BIGINT) AS chunk_id, CAST(k * {CHUNK} AS BIGINT) AS chunk_start,
       substring(seq, CAST(k * {CHUNK} + 1 AS BIGINT), {CHUNK + OVERLAP}) AS seq
FROM (SELECT contig, seq, unnest(range(0, (length(seq) + {CHUNK - 1}) // {CHUNK})) AS k FROM seqs)
"""


@query("fasta_indexed", _CHUNKS_SQL)
def q_fasta_indexed(spark, sf):
    """A2 by byte ranges: one scan of the FASTA file set through its index."""
    return fasta_indexed(spark, fasta_file(spark, sf), fasta_index(spark, sf), CHUNK, OVERLAP)


@query("fasta_scan", _CHUNKS_SQL)
def q_fasta_scan(spark, sf):
    # Scans the FASTA file set directly (no cached chunk table).
    return fasta_scan(spark, fasta_file(spark, sf), CHUNK, OVERLAP)


@query("tile_count", f"WITH {IV} SELECT split, count(*) AS n_intervals, "
                     f"count(*) * {N_TILES} AS n_tiles FROM iv GROUP BY split")
def q_tile_count(spark, sf):
    return TL.tile_count(_intervals(spark, sf), TILE, SEGMENT)


@query("tile", f"WITH {IV}, {TILES} SELECT chr_name, split, tile_idx, start, \"end\" FROM tiles")
def q_tile(spark, sf):
    return _tiles(spark, sf).select("chr_name", "split", "tile_idx", "start", "end")


# ---------------------------------------------------------------- C2, B2

@query("contig_bounds", f"""
WITH {IV}, {BAD_IV}
SELECT bad.chr_name, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", split,
       contig_len
FROM bad LEFT JOIN lens USING (chr_name)
""")
def q_contig_bounds(spark, sf):
    lens = contig_length_table(spark, sf)
    return TL.contig_bounds(bad_intervals(spark, sf), lens).select(
        "chr_name", "start", "end", "split", "contig_len")


@query("interval_contract", f"""
WITH {IV}, {BAD_IV},
t AS (
  SELECT b.split, b.start AS interval_start, b."end" AS interval_end,
         b.start + r.t * {TILE} AS start, b.start + (r.t + 1) * {TILE} AS "end", lens.contig_len
  FROM bad b LEFT JOIN lens USING (chr_name), (SELECT unnest(range(0, {N_TILES})) AS t) r)
SELECT split, count(*) AS n_tiles,
  count(*) FILTER (WHERE interval_end - interval_start <> {SEGMENT}) AS bad_segment_length,
  count(*) FILTER (WHERE "end" > interval_end) AS tile_past_interval_end,
  count(*) FILTER (WHERE start < interval_start) AS tile_before_interval_start,
  count(*) FILTER (WHERE start < 0) AS negative_start,
  count(*) FILTER (WHERE "end" > contig_len) AS tile_past_contig_end,
  count(*) FILTER (WHERE contig_len IS NULL) AS unknown_contig
FROM t GROUP BY split
""")
def q_interval_contract(spark, sf):
    lens = contig_length_table(spark, sf)
    tiles = TL.tile(TL.contig_bounds(bad_intervals(spark, sf), lens), TILE, SEGMENT)
    return TL.interval_contract(tiles, TILE, SEGMENT)


# ---------------------------------------------------------------- C1, E1, E2, E3, B5

@query("tile_sequence", f"""
WITH {IV_WHOLE}, {SEQS}, {TILES}, {TILE_SEQ}
SELECT chr_name, tile_idx, start, "end", seq FROM tseq
""")
def q_tile_sequence(spark, sf):
    return _tile_seqs(spark, sf).select("chr_name", "tile_idx", "start", "end", "seq")


@query("tokenize", f"""
WITH {IV_WHOLE}, {SEQS}, {TILES}, {TILE_SEQ}
SELECT chr_name, start, "end", {_tok_sql("seq")} AS ids FROM tseq
""")
def q_tokenize(spark, sf):
    t = TL.tile_tokens(_whole_tiles(spark, sf), chunk_table(spark, sf), CHUNK, OVERLAP, TILE,
                       n_as_pad=False)
    return t.select("chr_name", "start", "end", "ids")


@query("n_to_pad", f"""
WITH {IV_WHOLE}, {SEQS}, {TILES}, {TILE_SEQ}
SELECT chr_name, start, translate({_tok_sql("seq")}, ';', '4') AS ids FROM tseq
""")
def q_n_to_pad(spark, sf):
    t = TL.tile_tokens(_whole_tiles(spark, sf), chunk_table(spark, sf), CHUNK, OVERLAP, TILE)
    return t.select("chr_name", "start", "ids")


PAD_LEN = 128


@query("pad_truncate", f"""
WITH {SEQS}
SELECT doc_id, rpad(substring({_tok_sql("seq")}, 1, {PAD_LEN}), {PAD_LEN}, '4') AS ids FROM seqs
""")
def q_pad_truncate(spark, sf):
    s = contig_sequences(spark, sf)
    return s.select("doc_id", TK.pad_truncate(TK.tokenize(F.col("seq")), PAD_LEN).alias("ids"))


@query("reject_all_pad", f"""
WITH {IV_WHOLE}, {SEQS}, {TILES}, {TILE_SEQ},
k AS (SELECT split, replace(translate({_tok_sql("seq")}, ';', '4'), '4', '') = '' AS bad FROM tseq)
SELECT split, count(*) FILTER (WHERE NOT bad) AS n_kept, count(*) FILTER (WHERE bad) AS n_rejected
FROM k GROUP BY split
""")
def q_reject_all_pad(spark, sf):
    t = TL.tile_tokens(_whole_tiles(spark, sf), chunk_table(spark, sf), CHUNK, OVERLAP, TILE)
    # kept and quarantined counted in one pass over the flagged tiles
    flagged = TL.flag_all_pad(t, "ids")
    return flagged.groupBy("split").agg(F.count_if(~F.col("all_pad")).alias("n_kept"),
                                        F.count_if(F.col("all_pad")).alias("n_rejected"))


# ---------------------------------------------------------------- D4, D2, B11, B7, B6, C6, B13, B10

@query("sample_index", f"WITH {IV}, {TRAIN_IDX} SELECT * FROM ix")
def q_sample_index(spark, sf):
    return _train_indexed(spark, sf).select(*_IX_COLS)


@query("batch", f"WITH {IV}, {TRAIN_IDX} SELECT *, idx // {BATCH} AS batch_idx FROM ix")
def q_batch(spark, sf):
    return IX.batch(_train_indexed(spark, sf), BATCH).select(*_IX_COLS, "batch_idx")


MAX_BATCHES = 100


@query("max_batches", f"WITH {IV}, {TRAIN_IDX} SELECT *, idx // {BATCH} AS batch_idx FROM ix "
                      f"WHERE idx // {BATCH} < {MAX_BATCHES}")
def q_max_batches(spark, sf):
    df = IX.batch(_train_indexed(spark, sf), BATCH)
    return IX.max_batches(df, MAX_BATCHES).select(*_IX_COLS, "batch_idx")


RESUME_STEP, ACCUMULATE = 50, 2


@query("resume_offset", f"WITH {IV}, {TRAIN_IDX} SELECT * FROM ix "
                        f"WHERE idx >= {RESUME_STEP * ACCUMULATE * BATCH}")
def q_resume_offset(spark, sf):
    return IX.resume_offset(_train_indexed(spark, sf), RESUME_STEP, ACCUMULATE, BATCH) \
        .select(*_IX_COLS)


_SKIP_SQL = ", ".join(str(s) for s in SKIP)


@query("skip_anti", f"WITH {IV}, {TRAIN_IDX} SELECT * FROM ix WHERE idx NOT IN ({_SKIP_SQL})")
def q_skip_anti(spark, sf):
    return IX.skip_anti(_train_indexed(spark, sf), SKIP).select(*_IX_COLS)


@query("skip_substitute", f"""
WITH {IV}, {TRAIN_IDX},
kept AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS rk FROM ix WHERE idx NOT IN ({_SKIP_SQL})),
m AS (SELECT count(*) AS m FROM kept),
want AS (SELECT idx AS orig,
                CAST((CAST(idx AS HUGEINT) * 1103515245 + 12345) % m AS BIGINT) AS rk
         FROM ix, m WHERE idx IN ({_SKIP_SQL}))
SELECT chr_name, tile_idx, start, "end", idx, idx AS source_idx FROM kept
UNION ALL
SELECT k.chr_name, k.tile_idx, k.start, k."end", w.orig AS idx, k.idx AS source_idx
FROM want w JOIN kept k USING (rk)
""")
def q_skip_substitute(spark, sf):
    return IX.skip_substitute(_train_indexed(spark, sf), SKIP).select(*_IX_COLS, "source_idx")


_FROM = RESUME_STEP * ACCUMULATE * BATCH
SKIP_LATE = (_FROM, _FROM + 1, _FROM + 5, 10 ** 9)
_LATE_SQL = ", ".join(str(s) for s in SKIP_LATE)


@query("resume_then_skip", f"""
WITH {IV}, {TRAIN_IDX},
rest AS (SELECT * FROM ix WHERE idx >= {_FROM}),
kept AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS rk FROM rest WHERE idx NOT IN ({_LATE_SQL})),
m AS (SELECT count(*) AS m FROM kept),
want AS (SELECT idx AS orig,
                CAST((CAST(idx AS HUGEINT) * 1103515245 + 12345) % m AS BIGINT) AS rk
         FROM rest, m WHERE idx IN ({_LATE_SQL}))
SELECT chr_name, tile_idx, start, "end", idx, idx AS source_idx FROM kept
UNION ALL
SELECT k.chr_name, k.tile_idx, k.start, k."end", w.orig AS idx, k.idx AS source_idx
FROM want w JOIN kept k USING (rk)
""")
def q_resume_then_skip(spark, sf):
    """B7 then B6: indices that do not start at 0, and a skip index beyond the last row."""
    rest = IX.resume_offset(_train_indexed(spark, sf), RESUME_STEP, ACCUMULATE, BATCH)
    return IX.skip_substitute(rest, SKIP_LATE).select(*_IX_COLS, "source_idx")


@query("tile_status", f"""
WITH {IV}, {BAD_IV},
t AS (
  SELECT b.chr_name, b.split, CAST(r.t AS INTEGER) AS tile_idx, CAST(b.start + r.t * {TILE} AS BIGINT) AS start,
         CAST(b.start + (r.t + 1) * {TILE} AS BIGINT) AS "end", lens.contig_len
  FROM bad b LEFT JOIN lens USING (chr_name), (SELECT unnest(range(0, {N_TILES})) AS t) r),
s AS (SELECT *, CASE WHEN contig_len IS NULL THEN 'unknown_contig'
                     WHEN start < 0 OR "end" > contig_len THEN 'out_of_bounds' ELSE 'ok' END AS status FROM t)
SELECT chr_name, split, tile_idx, start, "end", status,
       CASE WHEN status = 'ok' THEN {TILE} END AS n_bases FROM s
""")
def q_tile_status(spark, sf):
    """C1 keeps every tile: those outside the sequences with a status and no bases."""
    ch = chunk_table(spark, sf)
    tiles = TL.tile(bad_intervals(spark, sf), TILE, SEGMENT)
    out = TL.checked_tile_sequence(tiles, ch, contig_length_table(spark, sf), CHUNK, OVERLAP, tile_len=TILE)
    return out.select("chr_name", "split", "tile_idx", "start", "end", "status",
                      F.length("seq").alias("n_bases"))


@query("tokenize_whole", f"WITH {SEQS} SELECT doc_id, {_tok_sql('seq')} AS ids FROM seqs")
def q_tokenize_whole(spark, sf):
    """E1 over every character of every sequence."""
    return contig_sequences(spark, sf).select("doc_id", TK.tokenize(F.col("seq")).alias("ids"))


@query("n_to_pad_whole", f"WITH {SEQS} SELECT doc_id, translate({_tok_sql('seq')}, ';', '4') AS ids FROM seqs")
def q_n_to_pad_whole(spark, sf):
    """E3 over every character of every sequence."""
    return contig_sequences(spark, sf).select(
        "doc_id", TK.tokenize(F.col("seq"), n_as_pad=True).alias("ids"))


WARM = 64


@query("warm_head", f"WITH {IV}, {TRAIN_IDX} SELECT * FROM ix WHERE idx < {WARM}")
def q_warm_head(spark, sf):
    return IX.warm_head(_train_indexed(spark, sf), WARM).select(*_IX_COLS)


LIMIT, LIMIT_CHUNK = 1000, 96


@query("chunk_rounded_limit", f"WITH {IV}, {TRAIN_IDX} SELECT * FROM ix "
                              f"WHERE idx < {-(-LIMIT // LIMIT_CHUNK) * LIMIT_CHUNK}")
def q_chunk_rounded_limit(spark, sf):
    return IX.chunk_rounded_limit(_train_indexed(spark, sf), LIMIT, LIMIT_CHUNK).select(*_IX_COLS)
