"""Derived fixtures: the test tables re-read as the data model of each operator.

Every fixture is a plain Spark derivation of the given tables, so its size grows with them.
The same derivations are written in SQL beside the queries that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.constants import USEFUL_CLASSES

# Column subsets read per table: the scans only ever ask for these (column pruning).
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- positions (losses)

EMB_STATE_DIMS = 16


def embedding_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per ``embeddings`` row.

    Elements 1-16 are the student logits, 17-32 the teacher logits, 33-48 the student
    hidden state, 49-64 the teacher hidden state; class k is element k + 1 of its block.
    ``batch_id = vec_id div 10``; ``tok = 4`` when ``vec_id % 10 = 3`` else ``7 + vec_id % 4``.
    """
    e = table(spark, sf_dir, "embeddings")
    cols = ["vec_id", "vec_id AS sample", "0 AS pos", "CAST(vec_id DIV 10 AS BIGINT) AS batch_id",
            "CAST(CASE WHEN vec_id % 10 = 3 THEN 4 ELSE vec_id % 4 + 7 END AS BIGINT) AS tok"]
    cols += [f"CAST(element_at(embedding, {k + 1}) AS DOUBLE) AS s_c{k}" for k in USEFUL_CLASSES]
    cols += [f"CAST(element_at(embedding, {17 + k}) AS DOUBLE) AS t_c{k}" for k in USEFUL_CLASSES]
    cols += [f"CAST(element_at(embedding, {33 + i}) AS DOUBLE) AS s_h{i}" for i in range(EMB_STATE_DIMS)]
    cols += [f"CAST(element_at(embedding, {49 + i}) AS DOUBLE) AS t_h{i}" for i in range(EMB_STATE_DIMS)]
    return e.selectExpr(*cols)


def lineitem_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large positions from ``lineitem`` (no hidden states).

    Student logits, in useful-class order: ``l_quantity/10, l_extendedprice/10000,
    l_discount*10, l_tax*10, l_linenumber``; the teacher is the same list rotated by 2;
    ``batch_id = l_suppkey``; ``tok`` is element ``l_partkey % 5`` of (4, 7, 8, 9, 10).
    """
    li = table(spark, sf_dir, "lineitem")
    vals = ["l_quantity / 10", "l_extendedprice / 10000", "l_discount * 10", "l_tax * 10",
            "CAST(l_linenumber AS DOUBLE)"]
    rotated = vals[2:] + vals[:2]
    cols = ["l_orderkey", "l_linenumber", "l_orderkey * 8 + l_linenumber AS sample", "0 AS pos",
            "l_suppkey AS batch_id",
            "CAST(element_at(array(4, 7, 8, 9, 10), CAST(l_partkey % 5 + 1 AS INT)) AS BIGINT) AS tok"]
    cols += [f"CAST({v} AS DOUBLE) AS s_c{k}" for k, v in zip(USEFUL_CLASSES, vals)]
    cols += [f"CAST({v} AS DOUBLE) AS t_c{k}" for k, v in zip(USEFUL_CLASSES, rotated)]
    return li.selectExpr(*cols)


def round6(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 places (how results are compared)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- intervals and sequences

SEGMENT = 256     # interval length of the fixtures (the real default is 2**17)
TILE = 64         # tile length
CHUNK = 1000      # chunk size of the sequence table (deliberately not a multiple of TILE)
OVERLAP = TILE - 1
BATCH = 8


def contig_sequences(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """``documents`` as contigs: name = doc_id, sequence = text with every character that is
    not an ASCII letter replaced by ``N`` (so FASTA lines stay plain ASCII). ``in_order``: sorted
    by doc_id, before the texts are rewritten, which the sort's sampling would do once more."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.orderBy("doc_id") if in_order else d
    return d.select("doc_id", F.col("doc_id").cast("string").alias("contig"),
                    F.regexp_replace("text", "[^A-Za-z]", "N").alias("seq"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval per full 256-character segment of every document; split ``valid`` if
    ``doc_id % 10 = 8``, ``test`` if 9, else ``train``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    d = d.filter(F.col("n_chars") >= SEGMENT)
    k = F.explode(F.sequence(F.lit(0).cast("long"),
                             (F.floor(F.col("n_chars") / SEGMENT) - 1).cast("long")))
    iv = d.select("doc_id", k.alias("k"))
    split = (F.when(F.col("doc_id") % 10 == 8, "valid").when(F.col("doc_id") % 10 == 9, "test")
             .otherwise("train"))
    return iv.select("doc_id", F.col("doc_id").cast("string").alias("chr_name"),
                     (F.col("k") * SEGMENT).alias("start"),
                     (F.col("k") * SEGMENT + SEGMENT).alias("end"), split.alias("split"))


def whole_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`intervals`, but over every character: the last segment of a document may run
    past its end, and documents shorter than a segment have one, too."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").filter("n_chars > 0")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_chars") - 1) / SEGMENT).cast("long")))
    split = (F.when(F.col("doc_id") % 10 == 8, "valid").when(F.col("doc_id") % 10 == 9, "test")
             .otherwise("train"))
    return d.select("doc_id", k.alias("k"), F.col("doc_id").cast("string").alias("chr_name"), split.alias("split")) \
        .select("doc_id", "chr_name", (F.col("k") * SEGMENT).alias("start"),
                (F.col("k") * SEGMENT + SEGMENT).alias("end"), "split")


def bad_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals plus the broken ones."""
    return intervals(spark, sf_dir).unionByName(broken_intervals(spark, sf_dir))


def broken_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of at least 256 characters, one interval running past the contig end, one
    starting at -1, one of length 255 and one on an unknown contig."""
    d = table(spark, sf_dir, "documents").filter(F.col("n_chars") >= SEGMENT) \
        .select("doc_id", "n_chars")
    name = F.col("doc_id").cast("string")
    extra = [
        d.select("doc_id", name.alias("chr_name"), (F.col("n_chars") - 128).alias("start"),
                 (F.col("n_chars") + 128).alias("end"), F.lit("train").alias("split")),
        d.select("doc_id", name.alias("chr_name"), F.lit(-1).cast("long").alias("start"),
                 F.lit(SEGMENT - 1).cast("long").alias("end"), F.lit("valid").alias("split")),
        d.select("doc_id", name.alias("chr_name"), F.lit(0).cast("long").alias("start"),
                 F.lit(SEGMENT - 1).cast("long").alias("end"), F.lit("test").alias("split")),
        d.select("doc_id", F.concat(F.lit("x"), name).alias("chr_name"),
                 F.lit(0).cast("long").alias("start"), F.lit(SEGMENT).cast("long").alias("end"),
                 F.lit("train").alias("split")),
    ]
    out = extra[0]
    for e in extra[1:]:
        out = out.unionByName(e)
    return out


def derived_path(spark: SparkSession, sf_dir: str, what: str, tables: tuple[str, ...] = ("documents",),
                 **params) -> str:
    """Path of a file set derived from ``tables``: another one for other parameters, another
    table folder or changed tables."""
    from seqlake.session import ensure_scratch
    from seqlake.sources.stores import cache_key, source_fingerprint
    data = source_fingerprint(spark, *[f"{sf_dir.rstrip('/')}/{t}.parquet" for t in tables])
    return f"{ensure_scratch(spark)}/fixtures/{cache_key(what, {'sf': sf_dir, 'data': data, **params})}"


def bed_file(spark: SparkSession, sf_dir: str, make=intervals) -> str:
    """The intervals that ``make`` derives, written once as a BED file set, in (doc_id, start)
    order."""
    from seqlake.sources.bed import write_bed
    from seqlake.sources.stores import is_done, mark_done
    path = derived_path(spark, sf_dir, "bed", segment=SEGMENT, intervals=make.__name__)
    if not is_done(spark, path):
        write_bed(make(spark, sf_dir), path, order_by=["doc_id", "start"])
        mark_done(spark, path)
    return path


def fasta_file(spark: SparkSession, sf_dir: str) -> str:
    """The contigs written once as FASTA, 60 bases per line, in doc_id order."""
    from seqlake.sources.fasta import write_fasta
    from seqlake.sources.stores import is_done, mark_done
    path = derived_path(spark, sf_dir, "fasta", width=60)
    if not is_done(spark, path):
        write_fasta(contig_sequences(spark, sf_dir, in_order=True), path, 60)
        mark_done(spark, path)
    return path


def fasta_index(spark: SparkSession, sf_dir: str) -> str:
    """Path of the index of the FASTA file set, built once."""
    from seqlake.sources.fasta_index import build_index
    from seqlake.sources.stores import is_done, mark_done
    path = derived_path(spark, sf_dir, "fasta-index", width=60)
    if not is_done(spark, path):
        build_index(spark, fasta_file(spark, sf_dir), path)
        mark_done(spark, path)
    return path


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA read once by its index into the chunk table, kept as Parquet (read-through)."""
    from seqlake.sources.fasta_index import fasta_indexed
    from seqlake.sources.stores import read_through
    path = derived_path(spark, sf_dir, "chunks", chunk=CHUNK, overlap=OVERLAP)
    fa, index = fasta_file(spark, sf_dir), fasta_index(spark, sf_dir)
    return read_through(spark, path, lambda: fasta_indexed(spark, fa, index, CHUNK, OVERLAP))


def contig_length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contig, length`` from the index."""
    from seqlake.sources.fasta_index import indexed_lengths
    return indexed_lengths(spark.read.parquet(fasta_index(spark, sf_dir)))


# ---------------------------------------------------------------- labelled tasks, features

TASK_ORDER = ("quality", "toxic")


def labelled_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` unpivoted to ``task_name in (quality, toxic)`` joined to ``documents``;
    split ``test`` if ``doc_id % 5 = 0`` else ``train``."""
    lab = table(spark, sf_dir, "labels")
    long = lab.unpivot(["doc_id"], list(TASK_ORDER), "task_name", "label")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    return long.join(docs, "doc_id", "inner").select(
        "task_name", split.alias("split"), F.col("doc_id").alias("sample_id"),
        F.col("text").alias("sequence"), "label")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` joined to ``documents``: score ``n_chars div 500`` (has ties), label
    ``quality``, hard prediction ``score >= 5``; split as in :func:`labelled_task`."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    score = F.floor(F.col("n_chars") / 500).cast("bigint")
    return lab.join(docs, "doc_id", "inner").select(
        "doc_id", "lang", score.alias("score"), F.col("quality").alias("label"),
        (score >= 5).cast("int").alias("pred"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))


def probe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a feature set: task ``task{label div 5}``, label ``label % 2``,
    split ``test`` if ``vec_id % 5 = 0``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("task"), F.floor(F.col("label") / 5).cast("string")).alias("task_name"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.col("vec_id").alias("sample_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("feature"),
        (F.col("label") % 2).alias("label"))


# ---------------------------------------------------------------- run logs

def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a batch log: ``ts`` as timestamp (UTC), tokens ``round(value)``,
    device ``user_id % 4``, core utilisation ``round(value) % 101``, memory utilisation the
    ``k`` field of ``props``."""
    e = table(spark, sf_dir, "events")
    tokens = F.round("value").cast("bigint")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("batch_idx"),
                    tokens.alias("n_tokens"), (F.col("user_id") % 4).alias("device"),
                    F.pmod(tokens, F.lit(101)).alias("core_util"),
                    F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int").alias("mem_util"))


def step_log(spark: SparkSession, sf_dir: str, one_run: bool = False) -> DataFrame:
    """``events`` as a step log: ``batch_idx = event_id``, ``step = event_id div 4``,
    ``loss = value``, run = ``event_type`` (or one run over all rows)."""
    e = table(spark, sf_dir, "events")
    run = F.lit("all") if one_run else F.col("event_type")
    return e.select(run.alias("run"), F.col("event_id").alias("batch_idx"),
                    F.floor(F.col("event_id") / 4).cast("bigint").alias("step"),
                    F.col("value").alias("loss"))


# Parameter names of the dump fixture, indexed by embeddings.label: each tracked suffix,
# the embedding, an untracked name, a name without a layers component, a non-integer layer.
PARAM_NAMES = (
    "backbone.layers.0.mixer.submodule.mamba_fwd.in_proj.weight",
    "backbone.layers.1.mixer.submodule.mamba_fwd.out_proj.weight",
    "backbone.layers.2.mixer.submodule.mamba_fwd.x_proj.weight",
    "backbone.layers.3.mixer.submodule.mamba_fwd.dt_proj.weight",
    "backbone.layers.14.mixer.submodule.mamba_rev.x_proj.weight",
    "backbone.layers.15.mixer.submodule.mamba_rev.dt_proj.weight",
    "backbone.embeddings.word_embeddings.embedding.weight",
    "backbone.norm_f.weight",
    "head.mamba_fwd.in_proj.weight",
    "backbone.layers.x.mixer.submodule.mamba_rev.dt_proj.weight",
)
NO_GRAD_LABEL = 9


def parameter_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` exploded: name from ``label``, step ``vec_id div 50``, value = elements
    1-32, grad = elements 33-64 (no gradient for label 9)."""
    e = table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(n) for n in PARAM_NAMES])
    ex = e.select("vec_id", "label", "embedding",
                  F.explode(F.sequence(F.lit(1), F.lit(32))).alias("i"))
    grad = F.when(F.col("label") == NO_GRAD_LABEL, F.lit(None).cast("double")) \
            .otherwise(F.element_at("embedding", F.col("i") + 32).cast("double"))
    return ex.select(F.floor(F.col("vec_id") / 50).cast("bigint").alias("step"),
                     F.element_at(names, F.col("label") + 1).alias("name"),
                     (F.col("vec_id") * 32 + F.col("i")).alias("pos"),
                     F.element_at("embedding", F.col("i")).cast("double").alias("value"),
                     grad.alias("grad"))


def token_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table tokenized once (default vocabulary, N as PAD), kept as Parquet."""
    from seqlake.operators.tiling import tokenize_chunks
    from seqlake.sources.stores import read_through
    path = derived_path(spark, sf_dir, "token-chunks", chunk=CHUNK, overlap=OVERLAP,
                        vocab="default", n_as_pad=True)
    return read_through(spark, path, lambda: tokenize_chunks(chunk_table(spark, sf_dir)))
