"""A2, indexed: byte ranges of FASTA files read straight into the chunk table.

An index row says where a record's bases lie: ``contig, length, offset, line_bases,
line_width, file``, the columns of a ``.fai`` file and the FASTA file they belong to. With it,
base ``i`` stands at byte ``offset + i div line_bases * line_width + i % line_bases``, so any
chunk can be read without the lines before it.

* :func:`build_index` makes the index in one scan. Files are cut into byte ranges, one input
  partition each; a range reports a row per record that lies in it, and at most two rows for
  records that cross its ends. Only those are put together by a window, whose size is the
  number of ranges.
* :func:`fasta_indexed` reads the chunk table in one scan: an input partition is a byte range
  of a file and owns the chunks whose first base lies there, so a long contig is spread over
  many tasks and many short contigs share one. Its task looks up the index rows of its range
  (the index is sorted by place, Parquet statistics skip the rest) and reads the range once.

Both are Python data sources that open files with ``pyarrow.fs`` (local or mounted folders,
HDFS, S3, GCS). Compressed files and records whose lines differ in length cannot be indexed;
:func:`seqlake.sources.fasta.fasta_scan` takes those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20          # of a file per input partition
BATCH_BYTES = 4 << 20           # of chunk text per Arrow batch
READ_BYTES = 4 << 20            # of a file held by a task at once
INDEX_GROUP = 1 << 20           # bytes per row group of the index: a task decodes those of its range

INDEX_COLUMNS = ("contig", "length", "offset", "line_bases", "line_width", "file")
_PIECES = ("file string, lo bigint, ord int, header boolean, closed boolean, contig string, offset bigint, "
           "bases bigint, n_lines bigint, line_bases bigint, n_full bigint, last_bases bigint, line_width bigint")
_CHUNKS = "contig string, chunk_id bigint, chunk_start bigint, seq string"


def _open_fs(path: str):
    """File system and path inside it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def list_files(path: str) -> list[tuple[str, int]]:
    """Files (and sizes) at ``path``, hidden ones left out, in name order."""
    from pyarrow import fs
    system, inner = _open_fs(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    names = [(scheme + f.path, f.size) for f in found if f.is_file
             and not any(p[:1] in "_." for p in f.path[len(inner):].split("/") if p)]
    packed = [n for n, _ in names if re.search(r"\.(gz|bgz|bz2|zst|xz)$", n)]
    if packed:
        raise ValueError(f"{packed[0]} is compressed: byte ranges of it cannot be read (use fasta_scan)")
    return sorted(names)


class ByteRange(InputPartition):
    def __init__(self, file: str, lo: int, hi: int, size: int):
        super().__init__((file, lo, hi, size))


def byte_ranges(path: str, split_bytes: int) -> list[ByteRange]:
    """One partition per ``split_bytes`` of every file."""
    return [ByteRange(f, lo, min(lo + split_bytes, size), size)
            for f, size in list_files(path) for lo in range(0, size, split_bytes)]


def range_pieces(data: bytes, lo: int, first: int, tail: int, at_end: bool, cr: bool = False) -> list[tuple]:
    """Rows of :data:`_PIECES` (without ``file``) of the lines that start in a range.

    ``data`` are the bytes from ``lo`` on, ``first`` the place in it of the first line start,
    ``tail`` the bytes of the last line that follow ``data`` (it has no line end inside),
    ``at_end`` whether the file ends with this range's last line."""
    import numpy as np
    b = np.frombuffer(data, dtype=np.uint8)
    if first >= len(b):
        return []
    breaks = np.concatenate([np.flatnonzero(b[i:i + READ_BYTES] == 10) + i
                             for i in range(first, len(b), READ_BYTES)])
    start = np.concatenate(([first], breaks + 1))
    start = start[start < len(b)]
    end = np.concatenate((breaks, [len(b)]))[:len(start)]
    bases = end - start - ((end > start) & (b[np.maximum(end - 1, 0)] == 13))
    bases[-1] += tail - cr if end[-1] == len(b) else 0
    header = b[start] == 62
    width = np.concatenate((start[1:], [end[-1] + tail + 1])) - start
    heads = np.flatnonzero(header)
    cuts = [0, *heads.tolist()] if not len(heads) or heads[0] else heads.tolist()
    out = []
    for k, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(start)])):
        named = bool(header[i])
        name = None
        if named:
            words = data[start[i] + 1:end[i]].split(maxsplit=1)
            name = words[0].decode() if words else ""
        s = slice(i + named, j)
        n, size = j - i - named, bases[s]
        long = int(size.max()) if n else 0
        out.append((lo, k, named, j < len(start) or at_end, name, lo + int(start[i + named]) if n else None,
                    int(size.sum()), n, long, int((size == long).sum()), int(size[-1]) if n else 0,
                    int(width[s][int(size.argmax())]) if n else 0))
    return out


class _PieceReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options["split_bytes"])

    def partitions(self):
        return byte_ranges(self.path, self.split)

    def read(self, partition):
        file, lo, hi, size = partition.value
        system, inner = _open_fs(file)
        with system.open_input_file(inner) as f:
            f.seek(max(lo - 1, 0))
            starts = not lo or f.read(1) == b"\n"
            data = f.read(hi - lo)
            first = 0
            if not starts:  # a line belongs to the range in which it starts
                first = data.find(b"\n") + 1 or len(data)
            tail, last, at_end = 0, b"", hi >= size
            if first < len(data) and not data.endswith(b"\n"):
                named = data[max(first, data.rfind(b"\n") + 1):][:1] == b">"
                while block := f.read(1 << 20):
                    stop = block.find(b"\n")
                    rest = block if stop < 0 else block[:stop]
                    if named:       # a name is needed in full
                        data += rest
                    else:
                        tail, last = tail + len(rest), rest[-1:] or last
                    if stop >= 0:
                        at_end = f.tell() - len(block) + stop + 1 >= size
                        break
                else:
                    at_end = True
        for row in range_pieces(data, lo, first, tail, at_end, last == b"\r"):
            yield (file, *row)


class FastaPieces(DataSource):
    """Record pieces per byte range (see :func:`build_index`)."""

    @classmethod
    def name(cls):
        return "seqlake_fasta_pieces"

    def schema(self):
        return _PIECES

    def reader(self, schema):
        return _PieceReader(self.options)


def _regular() -> Column:
    """All lines of a record are equally long but the last, which may be shorter."""
    return (F.col("n_lines") - F.col("n_full") <= 1) & (
        (F.col("n_lines") == F.col("n_full")) | (F.col("last_bases") < F.col("line_bases")))


def _placed(index: DataFrame, out: str) -> DataFrame:
    """The index written in file order, with the byte after each record's last base (``stop``,
    null without bases), and read back."""
    stop = F.when(F.col("length") > 0, F.expr(
        "offset + (length - 1) DIV line_bases * line_width + (length - 1) % line_bases + 1"))
    index.withColumn("stop", stop).repartitionByRange("file", "offset") \
        .sortWithinPartitions("file", "offset").write.option("parquet.block.size", INDEX_GROUP).parquet(out)
    return index.sparkSession.read.parquet(out)


def build_index(spark: SparkSession, path: str, out: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes the index of the FASTA file or folder ``path`` to ``out``, sorted by place, and
    reads it back.

    ValueError for what makes sequences ambiguous: a record without a name, a name given
    twice (in any two files), bases before the first header of a file, and lines of unequal
    length or empty lines inside a record. A record without bases has length 0.
    """
    spark.dataSource.register(FastaPieces)
    pieces = spark.read.format("seqlake_fasta_pieces").option("split_bytes", split_bytes).load(path)
    whole = pieces.filter("header AND closed")
    # at most two rows per byte range
    place = Window.partitionBy("file").orderBy("lo", "ord")
    crossing = pieces.filter("NOT (header AND closed)").withColumn("rec", F.count_if("header").over(place))
    full = F.when(F.col("line_bases") == F.max("line_bases").over(Window.partitionBy("file", "rec")), F.col("n_full"))
    joined = crossing.withColumn("n_full", F.coalesce(full, F.lit(0))).groupBy("file", "rec").agg(
        F.max("contig").alias("contig"), F.min("offset").alias("offset"), F.sum("bases").alias("bases"),
        F.sum("n_lines").alias("n_lines"), F.max("line_bases").alias("line_bases"), F.sum("n_full").alias("n_full"),
        F.expr("max_by(last_bases, offset)").alias("last_bases"),
        F.expr("max_by(line_width, struct(line_bases, -offset))").alias("line_width"))
    cols = ["file", "contig", "offset", "bases", "n_lines", "line_bases", "n_full", "last_bases", "line_width"]
    rows = whole.select(*cols).unionByName(joined.select(*cols)).filter("contig IS NOT NULL OR bases > 0")
    index = rows.select(
        "contig", F.col("bases").alias("length"), F.coalesce("offset", F.lit(0)).alias("offset"), "line_bases",
        "line_width", "file", F.when(F.col("contig").isNull(), "bases before the first header")
        .when(F.col("contig") == "", "a record without a name")
        .when((F.col("n_lines") > 0) & ~_regular(), "lines of unequal length").alias("fault"))
    back = _placed(index, out)
    bad = back.filter("fault IS NOT NULL").select("fault", "contig", "file", "offset").first()
    if bad:
        raise ValueError(f"{bad.file}: {bad.fault} (record {bad.contig!r}, byte {bad.offset})")
    twice = back.groupBy("contig").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"{path}: {twice['count']} records are named {twice.contig!r}")
    return back.select(*INDEX_COLUMNS)


def read_fai(spark: SparkSession, fai: str, fasta: str, out: str) -> DataFrame:
    """The index of one FASTA file from its ``.fai`` file (tab-separated name, length, offset,
    line bases, line width), written to ``out`` as :func:`build_index` does."""
    rows = spark.read.schema("contig string, length bigint, offset bigint, line_bases bigint, line_width bigint") \
        .option("mode", "FAILFAST").csv(fai, sep="\t").withColumn("file", F.lit(list_files(fasta)[0][0]))
    return _placed(rows, out).select(*INDEX_COLUMNS)


class _ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.index = options["path"], options["index"]
        self.chunk, self.overlap = int(options["chunk_size"]), int(options["overlap"])
        self.split = int(options["split_bytes"])

    def partitions(self):
        return byte_ranges(self.path, self.split)

    def _records(self, file: str, lo: int, hi: int) -> list[tuple]:
        """Index rows with bases in the range, in file order."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        system, inner = _open_fs(self.index)
        f = pc.field
        rows = ds.dataset(inner, filesystem=system, format="parquet").to_table(
            columns=["contig", "length", "offset", "line_bases", "line_width"], use_threads=False,
            batch_readahead=1, fragment_readahead=1,
            filter=(f("file") == file) & (f("offset") < hi) & (f("stop") > lo))
        return sorted(zip(*(c.to_pylist() for c in rows.columns)), key=lambda r: r[2])

    def read(self, partition) -> Iterator:
        import pyarrow as pa
        file, lo, hi, _ = partition.value
        owned = []                      # contig, length, first and last chunk, place of a base
        for contig, length, offset, bases, width in self._records(file, lo, hi):
            def byte(i, offset=offset, bases=bases, width=width):
                return offset + i // bases * width + i % bases

            def base(x, offset=offset, bases=bases, width=width):
                x = max(x - offset, 0)      # the first base at or after a byte
                return x // width * bases + min(x % width, bases)

            k0, k1 = -(-base(lo) // self.chunk), -(-min(base(hi), length) // self.chunk)
            if k0 < k1:
                owned.append((contig, length, k0, k1, byte))
        if not owned:
            return
        def stop(length, k1):
            return min(k1 * self.chunk + self.overlap, length)

        end = max(byte(stop(length, k1) - 1) + 1 for _, length, _, k1, byte in owned)
        run = max(READ_BYTES // self.chunk, 1)
        system, inner = _open_fs(file)
        begin, data = 0, b""
        rows, held = ([], [], [], []), 0
        with system.open_input_file(inner) as f:
            for contig, length, k0, k1, byte in ((c, n, k, min(k + run, k1), byte) for c, n, k0, k1, byte in owned
                                                 for k in range(k0, k1, run)):
                i, j = k0 * self.chunk, stop(length, k1)
                lo, hi = byte(i), byte(j - 1) + 1
                if lo < begin or hi > begin + len(data):
                    f.seek(lo)
                    begin, data = lo, f.read(max(hi - lo, min(READ_BYTES, end - lo)))
                seq = data[lo - begin:hi - begin].translate(None, b"\r\n")
                if len(seq) != j - i or b">" in seq:
                    raise ValueError(f"{file}: record {contig!r} is not laid out as its index says")
                for k in range(k0, k1):
                    at = k * self.chunk
                    piece = seq[at - i:at - i + self.chunk + self.overlap]
                    for col, v in zip(rows, (contig, k, at, piece)):
                        col.append(v)
                    held += len(piece)
                    if held >= BATCH_BYTES:
                        yield self._batch(pa, rows)
                        rows, held = ([], [], [], []), 0
        if rows[0]:
            yield self._batch(pa, rows)

    @staticmethod
    def _batch(pa, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
             pa.array([s.decode() for s in rows[3]], pa.string())],
            names=["contig", "chunk_id", "chunk_start", "seq"])


class FastaChunks(DataSource):
    """The chunk table by byte ranges (see :func:`fasta_indexed`)."""

    @classmethod
    def name(cls):
        return "seqlake_fasta_chunks"

    def schema(self):
        return _CHUNKS

    def reader(self, schema):
        return _ChunkReader(self.options)


def fasta_indexed(spark: SparkSession, path: str, index: str, chunk_size: int = 4096, overlap: int = 0,
                  split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A2 by the index table at ``index``: FASTA file(s) -> chunk table, as ``fasta_scan``
    returns it, without a shuffle. Sequences have to be ASCII (one byte per base)."""
    spark.dataSource.register(FastaChunks)
    return (spark.read.format("seqlake_fasta_chunks").option("index", index).option("chunk_size", chunk_size)
            .option("overlap", overlap).option("split_bytes", split_bytes).load(path))


def indexed_lengths(index: DataFrame) -> DataFrame:
    """F1 from the index: no base is read."""
    return index.select("contig", F.col("length").cast("bigint").alias("length"))
