"""Costs that must grow no faster than the input: scoring, the store, the contract, FASTA reading."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators import losses as L
from seqlake.operators import probes as PR
from seqlake.operators import tiling as TL
from seqlake.session import scratch_path
from seqlake.sources import delta_store as DS
from seqlake.sources import fasta_index as FI



SF_SMALL = "/root/testdata/sf0.001"


def test_scores_of_small_model_batches_are_sent_together():
    """100 tiles through a model that takes 8 at a time: one batch of outputs, not 13."""
    class Tiles:
        schema = T.StructType([T.StructField("sample", T.LongType())])

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            return run

    seen = []

    def make():
        def predict(x):
            seen.append(len(x))
            return np.repeat(x[:, :, None], 5, axis=2).astype(np.float32)
        return predict

    ids = ["789:" * 4 if i % 10 else "78" for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(ids)], names=["sample", "ids"])
    out = list(PR.score_token_positions(Tiles(), make, ["sample"])(iter([batch])))
    assert max(seen) == 8 and len(out) == 2         # one for each length
    rows = {r["sample"]: r for b in out for r in b.to_pylist()}
    for i, s in enumerate(ids):
        x = [ord(c) - 48 for c in s]
        assert rows[i]["input_ids"] == x and rows[i]["logits"] == [float(v) for v in x for _ in range(5)]


def test_outputs_are_cut_by_size(monkeypatch):
    class Tiles:
        schema = T.StructType([T.StructField("sample", T.LongType())])

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(PR, "OUT_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["789:"] * 50)], names=["sample", "ids"])
    make = lambda: lambda x: np.repeat(x[:, :, None], 5, axis=2)     # noqa: E731
    out = list(PR.score_token_positions(Tiles(), make, ["sample"], batch_size=8, block=3)(iter([batch])))
    assert len(out) > 4 and sorted((r["sample"], r["block"]) for b in out for r in b.to_pylist()) == \
        [(i, b) for i in range(50) for b in (0, 1)]


def test_positions_are_exploded_in_generated_code(spark):
    df = spark.createDataFrame([(1, 0, [4, 7], [float(i) for i in range(10)]), (2, 0, None, None), (3, 0, [], [])],
                               "sample bigint, block int, input_ids array<int>, logits array<float>")
    pos = L.block_positions(df, {"s": "logits"})
    assert "lambda" not in pos._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.sample, r.pos, r.tok, r.s_c4) for r in pos.collect()] == [(1, 0, 4, 0.0), (1, 1, 7, 5.0)]


def test_repeated_keys_are_found_by_counting(spark):
    store = scratch_path(spark, "repeats")
    for k, rows in enumerate(([(1, 0, "a"), (2, 0, "a"), (None, 0, "a")], [(2, 0, "b"), (None, 0, "b")])):
        DS.append_soft_labels(spark.createDataFrame(rows, "sample bigint, block int, v string").coalesce(1), store,
                              ["sample", "block"], commit=str(k))
    again = DS.repeated_keys(spark, store, ["sample", "block"])
    assert again.columns == ["sample", "block"] and sorted(r.sample or 0 for r in again.collect()) == [0, 2]
    assert {r.sample: r.v for r in DS.read_soft_labels(spark, store, ["sample", "block"]).collect()} == \
        {1: "a", 2: "b", None: "b"}


def test_contract_writes_both_folders_without_a_sort(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    conf, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet

    def parquet(self, path, *a, **kw):
        seen.append(spark.conf.get(conf))
        return write(self, path, *a, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get(conf)
    tiles = spark.createDataFrame([(0, 64, 0, 64, 64, "7" * 64), (0, 64, 0, 64, 64, "4" * 64)], "interval_start bigint, "
                                  "interval_end bigint, start bigint, end bigint, contig_len bigint, ids string")
    kept, rejected, _ = TL.enforce_contract(tiles, scratch_path(spark, "contract"), 64, 64)
    assert seen == ["2"] and spark.conf.get(conf) == before
    assert kept.count() == 1 and [r.reasons for r in rejected.collect()] == [["all_pad"]]


def test_lengths_are_joined_before_tiles_are_cut(spark, monkeypatch):
    from seqlake.plans import q_workflows as W
    seen, bounds = [], TL.contig_bounds
    monkeypatch.setattr(W.TL, "contig_bounds", lambda df, *a: seen.append(df.columns) or bounds(df, *a))
    W.q_workflow_reasons(spark, SF_SMALL)
    assert len(seen) == 1 and "tile_idx" not in seen[0]


def test_broken_intervals_are_what_bad_ones_add(spark):
    from seqlake.plans import fixtures as X
    broken = X.broken_intervals(spark, SF_SMALL)
    want = X.bad_intervals(spark, SF_SMALL).exceptAll(X.intervals(spark, SF_SMALL))
    assert broken.exceptAll(want).isEmpty() and want.exceptAll(broken).isEmpty() and broken.count()


@pytest.mark.parametrize("split", [500, 1 << 20])
def test_a_chunk_task_holds_little_of_its_range(spark, tmp_path, monkeypatch, split):
    rng = np.random.default_rng(3)
    seqs = {f"c{i}": "".join(rng.choice(list("ACGTN"), n)) for i, n in enumerate((1, 59, 60, 61, 700, 2000, 13))}
    path = str(tmp_path / "x.fa")
    with open(path, "w") as f:
        for name, s in seqs.items():
            f.write(f">{name}\n" + "".join(s[i:i + 60] + "\n" for i in range(0, len(s), 60)))
    index = scratch_path(spark, "index")
    FI.build_index(spark, path, index, split)
    taken, open_fs = [], FI._open_fs

    class File:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            taken.append(n)
            return self.f.read(n)

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, inner):
            return File(self.system.open_input_file(inner))

    def opened(p):
        system, inner = open_fs(p)
        return (System(system) if p.endswith("x.fa") else system), inner

    monkeypatch.setattr(FI, "READ_BYTES", 128)
    reader = FI._ChunkReader({"path": path, "index": index, "chunk_size": "40", "overlap": "7", "split_bytes": str(split)})
    parts = reader.partitions()
    monkeypatch.setattr(FI, "_open_fs", opened)
    rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == sorted((c, k, 40 * k, s[40 * k:40 * k + 47]) for c, s in seqs.items()
                                  for k in range(-(-len(s) // 40)))
    assert max(taken) <= 140


def test_index_has_small_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.dataset as ds
    monkeypatch.setattr(FI, "INDEX_GROUP", 4096)
    path, out = str(tmp_path / "y.fa"), str(tmp_path / "index")
    with open(path, "w") as f:
        f.writelines(f">n{i * 7919 % 5000}\nACGT\n" for i in range(5000))
    FI.build_index(spark, path, out)
    groups = sum(f.num_row_groups for f in ds.dataset(out, format="parquet").get_fragments())
    assert groups > 1 and spark.read.parquet(out).select(F.count_distinct("contig")).first()[0] == 5000
