"""Indexed FASTA source: byte ranges of any size give the chunks that the line scan gives."""

import pytest
from pyspark.errors import PySparkException

from seqlake.plans.fixtures import contig_sequences
from seqlake.session import scratch_path
from seqlake.sources.fasta import fasta_scan, write_fasta
from seqlake.sources.fasta_index import build_index, fasta_indexed, indexed_lengths, read_fai

from conftest import SF_SMALL


def _file(spark, tmp_path, *files):
    for i, text in enumerate(files):
        (tmp_path / f"f{i}.fa").write_bytes(text.encode())
    return str(tmp_path)


@pytest.mark.parametrize("split,chunk,overlap", [(1 << 20, 64, 0), (4096, 1000, 63), (777, 100, 7)])
def test_ranges_of_any_size(spark, split, chunk, overlap):
    seqs = contig_sequences(spark, SF_SMALL)
    path, index = scratch_path(spark, "fa"), scratch_path(spark, "fai")
    write_fasta(seqs, path, 60, order_by=["doc_id"])
    lengths = {r.contig: r.length for r in indexed_lengths(build_index(spark, path, index, split)).collect()}
    want = {r.contig: r.seq for r in seqs.collect()}
    assert lengths == {c: len(s) for c, s in want.items()}
    got = fasta_indexed(spark, path, index, chunk, overlap, split)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapIn" not in plan and plan.count("Scan") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fasta_scan(spark, path, chunk, overlap).collect()))


@pytest.mark.parametrize("split,eol", [(1, "\n"), (7, "\r\n"), (1000, "\r\n")])
def test_small_ranges_line_ends_and_empty_records(spark, tmp_path, split, eol):
    a = eol.join([">chr one more", "ACGT", "ACGT", "AC", ">empty", ">b", "T", ">long_name_of_a_contig", "GGGGGG", "G"])
    b = eol.join([">last", "AAAAAAA", "AAAAAAA"]) + eol
    path, index = _file(spark, tmp_path, a, b), scratch_path(spark, "fai")
    rows = build_index(spark, path, index, split).collect()
    want = {"chr": "ACGTACGTAC", "empty": "", "b": "T", "long_name_of_a_contig": "GGGGGGG", "last": "A" * 14}
    assert {r.contig: r.length for r in rows} == {c: len(s) for c, s in want.items()}
    got = {(r.contig, r.chunk_id): (r.chunk_start, r.seq)
           for r in fasta_indexed(spark, path, index, 3, 1, split).collect()}
    assert got == {(c, k): (3 * k, s[3 * k:3 * k + 4]) for c, s in want.items() for k in range(-(-len(s) // 3))}


def test_ready_made_index(spark, tmp_path):
    path = _file(spark, tmp_path, ">x\nACGTA\nCG\n>y\nTT\n")
    fai = scratch_path(spark, "fai-text")
    spark.createDataFrame([("x\t7\t3\t5\t6",), ("y\t2\t15\t2\t3",)], "v string").coalesce(1).write.text(fai)
    index = scratch_path(spark, "fai")
    read_fai(spark, fai, path, index)
    built = build_index(spark, path, scratch_path(spark, "fai")).collect()
    assert sorted(map(tuple, spark.read.parquet(index).drop("stop").collect())) == sorted(map(tuple, built))
    assert sorted(r.seq for r in fasta_indexed(spark, path, index, 4, 0).collect()) == ["ACG", "ACGT", "TT"]
    wrong = scratch_path(spark, "fai-wrong")
    spark.createDataFrame([("x\t9\t3\t5\t6",)], "v string").coalesce(1).write.text(wrong)
    read_fai(spark, wrong, path, index + "-wrong")
    with pytest.raises(PySparkException, match="not laid out"):
        fasta_indexed(spark, path, index + "-wrong", 4, 0).collect()


@pytest.mark.parametrize("files,fault", [
    ((">c1\nAAAA\n", ">c1\nGGGG\n"), "named 'c1'"), ((">c1\nAAAA\n>\nTTTT\n",), "without a name"),
    (("AAAA\n>c1\nTTTT\n",), "before the first header"), ((">c1\nAAAA\nAA\nAAAA\n",), "unequal"),
    ((">c1\nAA\nAAAA\n",), "unequal"), ((">c1\nAAAA\n\nAAAA\n",), "unequal")])
def test_ambiguous_records_fail(spark, tmp_path, files, fault):
    with pytest.raises(ValueError, match=fault):
        build_index(spark, _file(spark, tmp_path, *files), scratch_path(spark, "fai"), 5)


@pytest.mark.parametrize("files,fault", [
    ((">c1\nAAAA\n>\nTTTT\n", ">c1\nGGGG\n"), "without a name"), ((">c1\nAAAA\n", ">c1\nGGGG\n"), "named 'c1'"),
    (("AAAA\n>c1\nTTTT\n",), "before the first header")])
def test_line_scan_fails_on_them_too(spark, tmp_path, files, fault):
    with pytest.raises(ValueError, match=fault):
        fasta_scan(spark, _file(spark, tmp_path, *files), 4, 0)


def test_compressed_files_and_missing_ones_fail(spark, tmp_path):
    (tmp_path / "x.fa.gz").write_bytes(b"")
    with pytest.raises(Exception, match="compressed"):
        build_index(spark, str(tmp_path), scratch_path(spark, "fai"))
    with pytest.raises(Exception, match="nothing-here"):
        build_index(spark, str(tmp_path / "nothing-here"), scratch_path(spark, "fai"))
