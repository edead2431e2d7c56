"""Property tests (hypothesis): chunking + binned join == slicing; tokens commute with it."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.functions import tokens as TK
from seqlake.operators import tiling as TL
from seqlake.sources.fasta import chunk_lines

ALPHABET = "ACGTNacgtnxX"


@st.composite
def cases(draw):
    seqs = draw(st.lists(st.text(ALPHABET, min_size=1, max_size=240), min_size=1, max_size=3))
    width = draw(st.integers(1, 70))
    chunk = draw(st.integers(5, 60))
    overlap = draw(st.integers(0, 15))
    tile_len = draw(st.integers(1, 24))
    starts = [draw(st.lists(st.integers(0, max(0, len(s) - tile_len)), max_size=6)) for s in seqs]
    return seqs, width, chunk, overlap, tile_len, starts


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(cases())
def test_binned_join_and_tokens_match_slicing(spark, case):
    seqs, width, chunk, overlap, tile_len, starts = case
    lines = [(f"c{i}", o, s[o:o + width]) for i, s in enumerate(seqs) for o in range(0, len(s), width)]
    lines_df = spark.createDataFrame(lines, "contig string, offset long, line string")
    chunks = chunk_lines(lines_df, chunk, overlap)
    tiles = [(f"c{i}", st_, st_ + tile_len) for i, s in enumerate(seqs) for st_ in set(starts[i])
             if st_ + tile_len <= len(s)]
    if not tiles:
        return
    tiles_df = spark.createDataFrame(tiles, "chr_name string, start long, end long")
    got = {(r.chr_name, r.start): r.seq for r in
           TL.tile_sequence(tiles_df, chunks, chunk, overlap, tile_len=tile_len).collect()}
    want = {(c, s): seqs[int(c[1:])][s:e] for c, s, e in tiles}
    assert got == want
    toks = {(r.chr_name, r.start): r.ids for r in
            TL.tile_tokens(tiles_df, chunks, chunk, overlap, tile_len).collect()}
    direct = spark.createDataFrame([(k[0], k[1], v) for k, v in want.items()],
                                   "c string, s long, seq string")
    ref = {(r.c, r.s): r.ids for r in direct.select(
        "c", "s", TK.n_to_pad(TK.tokenize(F.col("seq"))).alias("ids")).collect()}
    assert toks == ref
