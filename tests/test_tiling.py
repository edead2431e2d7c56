"""Tiling, FASTA scan, binned range join, tokens, global index."""

import pytest
from pyspark.sql import functions as F

from seqlake.functions import tokens as TK
from seqlake.operators import indexing as IX
from seqlake.operators import tiling as TL
from seqlake.plans.fixtures import contig_sequences, intervals
from seqlake.session import scratch_path
from seqlake.sources.bed import bed_scan, write_bed
from seqlake.sources.fasta import contig_lengths, fasta_scan, write_fasta

from conftest import SF_SMALL


def test_n_tiles_contract():
    assert TL.n_tiles(64, 256) == 4
    with pytest.raises(ValueError):
        TL.n_tiles(100, 256)
    with pytest.raises(ValueError):
        TL.n_tiles(512, 256)


def test_tiles_cover_the_interval(spark):
    iv = intervals(spark, SF_SMALL)
    t = TL.tile(iv, 64, 256)
    per = t.groupBy("chr_name", "interval_start").agg(
        F.sum(F.col("end") - F.col("start")).alias("covered"), F.min("start").alias("lo"),
        F.max("end").alias("hi"), F.col("interval_start").alias("s"))
    bad = per.filter((F.col("covered") != 256) | (F.col("lo") != F.col("s")) |
                     (F.col("hi") != F.col("s") + 256))
    assert bad.count() == 0
    assert t.count() == iv.count() * 4


def test_split_filter_strict_raises_when_empty(spark):
    iv = intervals(spark, SF_SMALL)
    with pytest.raises(ValueError):
        TL.split_filter(iv, "nope", strict=True)


def test_bed_roundtrip_keeps_order(spark):
    path = scratch_path(spark, "bed-test")
    iv = intervals(spark, SF_SMALL)
    write_bed(iv, path, order_by=["doc_id", "start"])
    back = bed_scan(spark, path, with_order=True)
    got = [(r.chr_name, r.start) for r in back.orderBy("file_order").collect()]
    want = [(r.chr_name, r.start) for r in iv.orderBy("doc_id", "start").collect()]
    assert got == want


@pytest.mark.parametrize("max_bytes,chunk,overlap", [(1 << 30, 64, 0), (4096, 1000, 63),
                                                     (777, 100, 7)])
def test_fasta_scan_across_many_splits(spark, max_bytes, chunk, overlap):
    """Contig and offset of every line survive records split over many input splits."""
    seqs = contig_sequences(spark, SF_SMALL)
    path = scratch_path(spark, "fasta-test")
    write_fasta(seqs, path, 60, order_by=["doc_id"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_bytes))
    try:
        got = {(r.contig, r.chunk_id): (r.chunk_start, r.seq)
               for r in fasta_scan(spark, path, chunk, overlap).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {}
    for r in seqs.collect():
        for k in range(0, (len(r.seq) + chunk - 1) // chunk):
            want[(r.contig, k)] = (k * chunk, r.seq[k * chunk: k * chunk + chunk + overlap])
    assert got == want


def test_fasta_header_with_description_and_crlf(spark):
    path = scratch_path(spark, "fasta-crlf")
    lines = [">chrA some description", "ACGT", "ACG", ">chrB", "", "TTTT"]
    spark.createDataFrame([("\r\n".join(lines),)], "value string").write.text(path)
    got = {(r.contig, r.chunk_id): r.seq for r in fasta_scan(spark, path, 4, 0).collect()}
    assert got == {("chrA", 0): "ACGT", ("chrA", 1): "ACG", ("chrB", 0): "TTTT"}
    lens = {r.contig: r.length for r in contig_lengths(fasta_scan(spark, path, 4, 2)).collect()}
    assert lens == {"chrA": 7, "chrB": 4}


def test_binned_join_equals_direct_slices(spark):
    """Binned equi-join result == slicing the full contig (the theta-join answer)."""
    seqs = contig_sequences(spark, SF_SMALL)
    path = scratch_path(spark, "fasta-join")
    write_fasta(seqs, path, 60, order_by=["doc_id"])
    chunks = fasta_scan(spark, path, 100, 20)
    full = {r.contig: r.seq for r in seqs.collect()}
    for tile_len in (16, 32, 64):   # 32 and 64 > overlap + 1 take the general path
        t = TL.tile(intervals(spark, SF_SMALL), tile_len, 256)
        got = TL.tile_sequence(t, chunks, 100, 20).select("chr_name", "start", "end", "seq").collect()
        assert len(got) == t.count()
        for r in got:
            assert r.seq == full[r.chr_name][r.start:r.end]


def test_tile_sequence_plan_has_no_nested_loop(spark):
    seqs = contig_sequences(spark, SF_SMALL)
    chunks = seqs.select(F.col("contig"), F.lit(0).cast("long").alias("chunk_id"),
                         F.lit(0).cast("long").alias("chunk_start"), "seq")
    t = TL.tile(intervals(spark, SF_SMALL), 64, 256)
    plan = TL.tile_sequence(t, chunks, 1 << 20, 63)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_tokens(spark):
    df = spark.createDataFrame([("acgtnACGTNxy-",)], "s string")
    r = df.select(TK.tokenize(F.col("s")).alias("ids")).first().ids
    assert r == "789:;789:;666"
    arr = df.select(TK.ids_array(TK.n_to_pad(TK.tokenize(F.col("s")))).alias("a")).first().a
    assert arr == [7, 8, 9, 10, 4, 7, 8, 9, 10, 4, 6, 6, 6]
    pt = df.select(TK.pad_truncate(F.lit("789"), 5).alias("a"),
                   TK.pad_truncate(F.lit("789:;"), 2).alias("b")).first()
    assert (pt.a, pt.b) == ("78944", "78")
    odd = spark.createDataFrame([("aé\tNg€",)], "s string")   # non-ASCII, control char
    assert odd.select(TK.tokenize(F.col("s"), n_as_pad=True)).first()[0] == "766496"
    assert df.select(TK.is_all_pad(F.lit("444")), TK.is_all_pad(F.lit("")),
                     TK.is_all_pad(F.lit("474"))).first() == (True, True, False)


def test_ids_beyond_the_compact_form_fail(spark):
    assert TK.id_char(78) == "~"
    for bad in (-1, 79, 300):
        with pytest.raises(ValueError, match="compact form"):
            TK.tokenize(F.lit("A"), {"A": bad})


def test_global_index_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"),
                                     F.col("id").alias("v"))
    got = {r.k: r.idx for r in IX.global_index(df, ["k"]).collect()}
    assert got == {k: k for k in range(5000)}


@pytest.mark.parametrize("dense", [True, False])
def test_skip_substitute_rule(spark, dense):
    df = spark.range(0, 100).withColumnRenamed("id", "idx")
    skip = [3, 50, 51, 99, 500]
    out = {r.idx: r.source_idx for r in IX.skip_substitute(df, skip, dense=dense).collect()}
    assert len(out) == 100
    kept = [i for i in range(100) if i not in skip]
    for s in (3, 50, 51, 99):
        assert out[s] == kept[(s * 1103515245 + 12345) % len(kept)]
    assert all(out[i] == i for i in kept)
    assert IX.skip_anti(df, [3, 50]).count() == 98


def test_chunk_rounded_limit(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "idx")
    assert IX.chunk_rounded_limit(df, 250, 100).count() == 300
    assert IX.chunk_rounded_limit(df, 0, 100).count() == 1000
    assert IX.chunk_rounded_limit(df, 5000, 100).count() == 1000


def test_interval_contract_counts_and_strict_mode(spark):
    from seqlake.plans.fixtures import bad_intervals
    lens = spark.createDataFrame([(r.chr_name, r.end + 10_000) for r in
                                  intervals(spark, SF_SMALL).select("chr_name", "end")
                                  .groupBy("chr_name").agg(F.max("end").alias("end")).collect()],
                                 "contig string, length long")
    good = TL.tile(TL.contig_bounds(intervals(spark, SF_SMALL), lens), 64, 256)
    rep = TL.interval_contract(good, 64, 256)
    TL.assert_contract(rep)   # all clean: no exception
    bad = TL.tile(TL.contig_bounds(bad_intervals(spark, SF_SMALL), lens), 64, 256)
    totals = TL.interval_contract(bad, 64, 256).agg(
        *[F.sum(c).alias(c) for c in ("negative_start", "bad_segment_length", "unknown_contig")]).first()
    n_docs = intervals(spark, SF_SMALL).select("chr_name").distinct().count()
    assert totals.unknown_contig == n_docs * 4
    assert totals.negative_start == n_docs            # only the first tile starts at -1
    assert totals.bad_segment_length == n_docs * 4      # the length-255 interval, 4 tiles
    with pytest.raises(ValueError):
        TL.assert_contract(TL.interval_contract(bad, 64, 256))


def test_reject_all_pad_strict(spark):
    df = spark.createDataFrame([("4444",), ("4744",)], "ids string")
    kept, bad = TL.reject_all_pad(df, "ids")
    assert (kept.count(), bad.count()) == (1, 1)
    with pytest.raises(ValueError):
        TL.reject_all_pad(df, "ids", strict=True)


def _small_chunks(spark, length=20, size=8, overlap=3, skip=()):
    s = "".join("ACGT"[i % 4] for i in range(length))
    rows = [("c", k, k * size, s[k * size:k * size + size + overlap]) for k in range(-(-length // size)) if k not in skip]
    return s, spark.createDataFrame(rows, "contig string, chunk_id bigint, chunk_start bigint, seq string")


@pytest.mark.parametrize("tile_len", [4, 9])     # 9 takes the general path
def test_no_tile_is_lost(spark, tile_len):
    s, chunks = _small_chunks(spark, skip=(1,))
    lengths = spark.createDataFrame([("c", 20)], "contig string, length bigint")
    starts = [0, 9, 16, 0, -1, 19]
    rows = [("c", a, a + tile_len) for a in starts] + [
        ("c", None, 4), ("c", 3, None), ("c", 20, 20), ("c", 5, 2), ("x", 0, tile_len), (None, 0, tile_len)]
    tiles = spark.createDataFrame(rows, "chr_name string, start bigint, end bigint")
    out = TL.checked_tile_sequence(tiles, chunks, lengths, 8, 3, tile_len=tile_len).collect()
    assert sorted((r.chr_name, r.start, r.end) for r in out if r.start is not None and r.end is not None and r.chr_name) \
        == sorted(r for r in rows if None not in r) and len(out) == len(rows)
    status = {(r.chr_name, r.start, r.end): r.status for r in out}
    assert status["c", 0, tile_len] == ("ok" if tile_len == 4 else "missing_bases")    # chunk 1 is not there
    assert status["c", 9, 9 + tile_len] == "missing_bases"
    assert status["c", -1, tile_len - 1] == status["c", 19, 19 + tile_len] == "out_of_bounds"
    assert {status[k] for k in (("c", None, 4), ("c", 3, None), ("c", 20, 20), ("c", 5, 2))} == {"bad_bounds"}
    assert status["x", 0, tile_len] == status[None, 0, tile_len] == "unknown_contig"
    assert all((r.seq is not None) == (r.status == "ok") for r in out)
    assert all(r.seq == s[r.start:r.end] for r in out if r.seq)
    with pytest.raises(ValueError, match="is not in the sequence"):
        TL.checked_tile_sequence(tiles, chunks, lengths, 8, 3, tile_len=tile_len, strict=True)


def test_long_tiles_that_repeat(spark):
    s, chunks = _small_chunks(spark)
    tiles = spark.createDataFrame([("c", 2, 17, i % 2) for i in range(4)], "chr_name string, start bigint, end bigint, n int")
    out = TL.tile_sequence(tiles, chunks, 8, 3).collect()
    assert [r.seq for r in out] == [s[2:17]] * 4 and sorted(r.n for r in out) == [0, 0, 1, 1]


def test_contract_is_enforced_in_one_pass(spark):
    rows = [(0, 256, 0, 64, 300, "7" * 64), (0, 256, 64, 128, 300, "4" * 64), (0, 256, 192, 256, 200, "7" * 64),
            (0, 255, 192, 256, 300, "7" * 63), (-1, 255, -1, 63, 300, None), (0, 256, 0, 64, None, None),
            (0, 256, None, 64, 300, None), (0, 256, 256, 320, 300, "7" * 64), (0, 256, 64, 0, 300, "")]
    schema = "interval_start bigint, interval_end bigint, start bigint, end bigint, contig_len bigint, ids string"
    tiles = spark.createDataFrame(rows, schema)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    path = scratch_path(spark, "contract")
    kept, rejected, counts = TL.enforce_contract(tiles.mapInArrow(counted, schema), path, 64, 256)
    assert kept.columns == tiles.columns and kept.count() == 1 and rejected.count() == 8
    assert read.value == len(rows)
    reasons = {(r.interval_start, r.interval_end, r.start, r.contig_len): r.reasons for r in rejected.collect()}
    assert reasons[0, 256, 64, 300] in (["all_pad"], ["bad_bounds", "bad_token_count"])
    assert reasons[0, 256, 192, 200] == ["tile_past_contig_end"]
    assert reasons[0, 255, 192, 300] == ["bad_segment_length", "tile_past_interval_end", "bad_token_count"]
    assert reasons[-1, 255, -1, 300] == ["negative_start", "bad_token_count"]
    assert reasons[0, 256, 0, None] == ["unknown_contig", "bad_token_count"]
    assert reasons[0, 256, None, 300] == ["bad_bounds", "bad_token_count"]
    assert reasons[0, 256, 256, 300] == ["tile_past_interval_end", "tile_past_contig_end"]
    assert counts["n_tiles"] == 9 and counts["n_rejected"] == 8 and counts["all_pad"] == 1
    assert {r: counts[r] for r in TL.REASONS} == {
        r: sum(r in x.reasons for x in rejected.collect()) for r in TL.REASONS}
    with pytest.raises(ValueError, match="8 of 9 tiles"):
        TL.enforce_contract(tiles, scratch_path(spark, "contract"), 64, 256, strict=True)
    tail = TL.enforce_contract(tiles.filter("contig_len = 200"), scratch_path(spark, "contract"), 64, 256, pad_tail=True)
    assert tail[0].count() == 1 and tail[2]["n_rejected"] == 0


def test_strict_contract_passes_on_good_tiles(spark):
    tiles = spark.createDataFrame([(0, 64, 0, 64, 64, "7" * 64)], "interval_start bigint, interval_end bigint, "
                                  "start bigint, end bigint, contig_len bigint, ids string")
    kept, rejected, counts = TL.enforce_contract(tiles, scratch_path(spark, "contract"), 64, 64, strict=True)
    assert (kept.count(), rejected.count(), counts["n_rejected"]) == (1, 0, 0)
