"""Intervals -> tiles -> sequences.

Intervals (``chr_name, start, end, split``; 0-based, half-open) are cut into ``n_tiles``
tiles of ``tile_len`` bases; tile sequences come from the chunk table of
:mod:`seqlake.sources.fasta` through a binned equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqlake.constants import MAX_ALLOWED_LENGTH
from seqlake.functions.tokens import is_all_pad


def n_tiles(tile_len: int, segment: int = MAX_ALLOWED_LENGTH) -> int:
    """Tiles per interval; ``tile_len`` must divide ``segment``."""
    if tile_len > segment:
        raise ValueError(f"tile length {tile_len} is larger than the segment {segment}")
    if segment % tile_len:
        raise ValueError(f"tile length {tile_len} must divide the segment {segment}")
    return segment // tile_len


def split_filter(intervals: DataFrame, split: str, strict: bool = False) -> DataFrame:
    """B1: rows of one split. ``strict`` fails when none is left (one tiny job)."""
    out = intervals.filter(F.col("split") == F.lit(split))
    if strict and not out.limit(1).count():
        raise ValueError(f"no interval belongs to split {split!r}: is it spelled as in the interval file?")
    return out


def tile_count(intervals: DataFrame, tile_len: int, segment: int = MAX_ALLOWED_LENGTH) -> DataFrame:
    """tiles per split = rows x n_tiles."""
    n = n_tiles(tile_len, segment)
    return intervals.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_intervals"),
        (F.count(F.lit(1)) * F.lit(n)).alias("n_tiles"))


def tile(intervals: DataFrame, tile_len: int, segment: int = MAX_ALLOWED_LENGTH,
         interval_idx: str | None = None) -> DataFrame:
    """One row per tile: ``[start + t*L, start + (t+1)*L)``.

    With ``interval_idx`` (the interval's index in its split, see ``global_index``) the
    tile also gets its sample index ``interval_idx * n_tiles + tile_idx``.
    """
    n = n_tiles(tile_len, segment)
    out = intervals.withColumn("tile_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = out.withColumns({
        "interval_start": F.col("start"), "interval_end": F.col("end"),
        "start": F.col("start") + F.col("tile_idx") * F.lit(tile_len),
        "end": F.col("start") + (F.col("tile_idx") + 1) * F.lit(tile_len)})
    if interval_idx:
        out = out.withColumn("idx", F.col(interval_idx) * F.lit(n) + F.col("tile_idx"))
    return out


def contig_bounds(df: DataFrame, lengths: DataFrame, contig_col: str = "chr_name") -> DataFrame:
    """Attach the contig length (left join; a missing contig gives NULL).

    ``lengths`` has one row per contig: tiny for a genome, but it grows with the number of
    contigs, so no broadcast is forced -- AQE turns the join into a broadcast at run time
    when the measured side is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    lens = lengths.select(F.col("contig").alias(contig_col), F.col("length").alias("contig_len"))
    return df.join(lens, contig_col, "left")


def tile_status(tiles: DataFrame, lengths: DataFrame, contig_col: str = "chr_name",
                strict: bool = False) -> DataFrame:
    """C1 guard: every tile with ``status`` ``ok``, ``bad_bounds`` (a NULL start or end, or an end
    that is not after the start), ``unknown_contig`` or ``out_of_bounds`` (negative start, or an
    end past the contig's). No tile is dropped; ``strict`` raises on the first one that is not
    ``ok`` (one job)."""
    out = contig_bounds(tiles, lengths, contig_col)
    status = (F.when(~F.coalesce(F.col("end") > F.col("start"), F.lit(False)), "bad_bounds")
              .when(F.col("contig_len").isNull(), "unknown_contig")
              .when((F.col("start") < 0) | (F.col("end") > F.col("contig_len")), "out_of_bounds")
              .otherwise("ok"))
    out = out.withColumn("status", status).drop("contig_len")
    if strict:
        bad = out.filter("status <> 'ok'").select(contig_col, "start", "end", "status").first()
        if bad:
            raise ValueError(f"tile {bad[0]}:{bad[1]}-{bad[2]} is not in the sequence ({bad[3]})")
    return out


def checked_tile_sequence(tiles: DataFrame, chunks: DataFrame, lengths: DataFrame, chunk_size: int,
                          overlap: int, contig_col: str = "chr_name", tile_len: int | None = None,
                          strict: bool = False) -> DataFrame:
    """C1 without silent loss: every tile with its status (see :func:`tile_status`) and its
    bases if that is ``ok``, else a NULL ``seq``. ``missing_bases``: the lengths promise bases that
    the chunk table does not hold. One pass: tiles that are not ``ok`` match no chunk."""
    flagged = tile_status(tiles, lengths, contig_col, strict)
    out = tile_sequence(flagged, chunks, chunk_size, overlap, contig_col, tile_len, how="left",
                        wanted=F.col("status") == "ok")
    short = (F.col("status") == "ok") & (F.coalesce(F.length("seq"), F.lit(-1)) != F.col("end") - F.col("start"))
    out = out.withColumn("status", F.when(short, "missing_bases").otherwise(F.col("status")))
    return out.withColumn("seq", F.when(F.col("status") == "ok", F.col("seq")))


def contract_checks(tile_len: int, segment: int = MAX_ALLOWED_LENGTH, ids_col: str | None = None,
                    pad_tail: bool = False) -> dict[str, Column]:
    """B2: violations by name, as conditions on tiles with ``start/end``,
    ``interval_start/interval_end`` and ``contig_len`` (NULL = unknown contig, a check of its
    own). With ``ids_col`` (compact ids) the token count is checked, too. ``pad_tail``: a tile
    that begins inside the contig may run past its end, to be padded."""
    past = F.col("start") >= F.col("contig_len") if pad_tail else F.col("end") > F.col("contig_len")
    checks = {
        "bad_segment_length": (F.col("interval_end") - F.col("interval_start")) != F.lit(segment),
        "tile_past_interval_end": F.col("end") > F.col("interval_end"),
        "tile_before_interval_start": F.col("start") < F.col("interval_start"),
        "negative_start": F.col("start") < 0,
        "tile_past_contig_end": past,
        "unknown_contig": F.col("contig_len").isNull(),
    }
    if ids_col:
        checks["bad_token_count"] = F.length(ids_col) != F.lit(tile_len)
    return checks


def tile_reasons(tile_len: int, segment: int = MAX_ALLOWED_LENGTH, ids_col: str = "ids",
                 pad_tail: bool = False) -> Column:
    """Everything that speaks against a tile, by name: NULL or empty bounds (C1), the violated
    checks (B2) and a tile of PAD only (B5). An empty array for a good tile. A tile without ids
    has a ``bad_token_count``; PAD is looked for where there are ids."""
    ids = F.coalesce(F.col(ids_col), F.lit(""))
    checks = {"bad_bounds": ~F.coalesce((F.col("end") > F.col("start"))
                                        & (F.col("interval_end") > F.col("interval_start")), F.lit(False))}
    checks |= contract_checks(tile_len, segment, None, pad_tail)
    checks |= {"bad_token_count": F.length(ids) != F.lit(tile_len),
               "all_pad": (F.length(ids) > 0) & is_all_pad(ids)}
    text = F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

REASONS = ("bad_bounds", "bad_segment_length", "tile_past_interval_end", "tile_before_interval_start",
           "negative_start", "tile_past_contig_end", "unknown_contig", "bad_token_count", "all_pad")


def enforce_contract(tiles: DataFrame, path: str, tile_len: int, segment: int = MAX_ALLOWED_LENGTH,
                     ids_col: str = "ids", pad_tail: bool = False,
                     strict: bool = False) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """B2, B5 and C1's guard in one pass: ``(kept, rejected, counts)``.

    Tiles (with their ids, NULL if they have none) are written once, in the kept and in the
    quarantine folder of ``path``, and counted by reason on the way (``observe``), so nothing
    is scanned twice. ``rejected`` has the column ``reasons``; ``counts`` has the number of tiles
    under ``n_tiles``, of rejected ones under ``n_rejected`` and of tiles per reason. ``strict``
    raises if a tile was rejected; both tables stay for inspection.
    """
    flagged = tiles.withColumn("reasons", tile_reasons(tile_len, segment, ids_col, pad_tail))
    flagged = flagged.withColumn("kept", F.size("reasons") == 0)
    seen = Observation("contract")
    watched = flagged.observe(
        seen, F.count(F.lit(1)).alias("n_tiles"), F.count_if(~F.col("kept")).alias("n_rejected"),
        *[F.count_if(F.array_contains("reasons", r)).alias(r) for r in REASONS])
    # two open files per task, one for each folder, instead of a sort of all tiles by folder
    spark = tiles.sparkSession
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "2")
    try:
        watched.write.partitionBy("kept").parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)
    counts = {k: int(v) for k, v in seen.get.items()}
    if strict and counts["n_rejected"]:
        raise ValueError(f"{counts['n_rejected']} of {counts['n_tiles']} tiles violate the contract: "
                         f"{ {r: counts[r] for r in REASONS if counts[r]} }")
    back = spark.read.schema(flagged.schema).parquet(path)
    return back.filter("kept").drop("kept", "reasons"), back.filter("NOT kept").drop("kept"), counts


def interval_contract(tiles: DataFrame, tile_len: int, segment: int = MAX_ALLOWED_LENGTH,
                      by: tuple[str, ...] = ("split",), ids_col: str | None = None) -> DataFrame:
    """B2: the six interval/tile checks as counts of violations, one pass, one row per group.

    ``tiles`` carries ``start/end`` (tile), ``interval_start/interval_end`` and
    ``contig_len`` (NULL = unknown contig, counted apart).
    """
    checks = contract_checks(tile_len, segment, ids_col)
    aggs = [F.count(F.lit(1)).alias("n_tiles")]
    aggs += [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]
    return tiles.groupBy(*by).agg(*aggs)


def assert_contract(report: DataFrame) -> None:
    """Strict mode: raise when any violation was counted (one small collect of counts)."""
    cols = [c for c in report.columns if c not in ("split", "n_tiles")]
    bad = report.select(*[F.sum(c).alias(c) for c in cols]).first()
    broken = {c: bad[c] for c in cols if bad[c]}
    if broken:
        raise ValueError(f"interval contract violated: {broken}")


def tile_sequence(tiles: DataFrame, chunks: DataFrame, chunk_size: int, overlap: int,
                  contig_col: str = "chr_name", tile_len: int | None = None, how: str = "inner",
                  wanted: Column | None = None) -> DataFrame:
    """Fetch bases ``[start, end)`` of each tile from the chunk table.

    A range (theta) join would plan a nested loop. Instead every tile is binned to the
    chunk of its start; when ``end - start <= overlap + 1`` the tile lies inside that chunk,
    so this is one hash/sort-merge equi-join on ``(contig, chunk_id)`` -- keys spread a
    large contig over many tasks. Longer tiles take the general path: one row per chunk
    touched, then an ordered concat per tile. When the (fixed) ``tile_len`` is given only
    the path it needs is planned; otherwise tiles are routed per row.

    ``how="left"`` keeps tiles without bases (NULL ``seq``); bases are looked up only for tiles
    that are ``wanted`` (default all).
    """
    c = int(chunk_size)
    ch = chunks.select(F.col("contig").alias(contig_col), "chunk_id", "chunk_start",
                       F.col("seq").alias("_chunk_seq"))
    look = F.lit(True) if wanted is None else wanted
    k0 = F.floor(F.col("start") / F.lit(c)).cast("long")
    fits = (F.col("end") - F.col("start")) <= F.lit(overlap + 1)
    if tile_len is not None:
        fits = F.lit(tile_len <= overlap + 1)
    fits = F.coalesce(fits, F.lit(True))
    # Tiles come from an explode: the optimizer sizes them by the (small) interval file,
    # not by rows x n_tiles, and would broadcast them. Neither side has a size bound, so
    # the join is forced to shuffle on (contig, chunk_id).
    direct = tiles.filter(fits).withColumn("chunk_id", F.when(look, k0))
    joined = direct.hint("merge").join(ch, [contig_col, "chunk_id"], how)
    seq = F.substring(F.col("_chunk_seq"), (F.col("start") - F.col("chunk_start") + 1).cast("int"),
                      (F.col("end") - F.col("start")).cast("int"))
    fast = joined.withColumn("seq", seq).select(*tiles.columns, "seq")
    if tile_len is not None and tile_len <= overlap + 1:
        return fast

    # General path: tiles longer than overlap + 1 (never taken when the chunk table was
    # built for this tile length). Bases are fetched once per place and joined to its tiles.
    long_tiles = tiles.filter(~fits)
    place = [contig_col, "start", "end"]
    k1 = F.floor((F.col("end") - 1) / F.lit(c)).cast("long")
    parts = long_tiles.filter(look).select(*place).distinct() \
        .withColumn("chunk_id", F.explode(F.sequence(k0, k1)))
    pj = parts.hint("merge").join(ch, [contig_col, "chunk_id"], "inner")
    lo = F.greatest(F.col("start"), F.col("chunk_start"))
    hi = F.least(F.col("end"), F.col("chunk_start") + F.lit(c))
    pj = pj.withColumn("_piece", F.struct(
        F.col("chunk_id"), F.substring("_chunk_seq", (lo - F.col("chunk_start") + 1).cast("int"),
                                       (hi - lo).cast("int")).alias("p")))
    found = (pj.groupBy(*place).agg(F.sort_array(F.collect_list("_piece")).alias("_ps"))
               .select(*place, F.array_join(F.transform("_ps", lambda x: x["p"]), "").alias("seq")))
    slow = long_tiles.join(found, place, how).select(*tiles.columns, "seq")
    return slow if tile_len is not None else fast.unionByName(slow)


def tokenize_chunks(chunks: DataFrame, vocab: dict[str, int] | None = None,
                    n_as_pad: bool = True) -> DataFrame:
    """E1 (+ E3) on the chunk table: ``seq`` becomes the compact id string. Tokenizing maps
    every base to exactly one id character, so it commutes with slicing -- a genome is
    tokenized once and tiles are cut from the token string."""
    from seqlake.functions.tokens import tokenize
    return chunks.withColumn("seq", tokenize(F.col("seq"), vocab, n_as_pad=n_as_pad))


def tile_tokens(tiles: DataFrame, chunks: DataFrame, chunk_size: int, overlap: int,
                tile_len: int | None = None, vocab: dict[str, int] | None = None,
                n_as_pad: bool = True, contig_col: str = "chr_name",
                tokenized: bool = False, how: str = "inner") -> DataFrame:
    """C1 + E1 (+ E3): token ids of each tile, as the compact id string ``ids``.

    ``chunks`` is the sequence chunk table, or an already tokenized one
    (``tokenized=True``, see :func:`tokenize_chunks`).
    """
    tok_chunks = chunks if tokenized else tokenize_chunks(chunks, vocab, n_as_pad)
    out = tile_sequence(tiles, tok_chunks, chunk_size, overlap, contig_col, tile_len, how)
    return out.withColumnRenamed("seq", "ids")


def flag_all_pad(df: DataFrame, ids_col: str = "ids", flag: str = "all_pad") -> DataFrame:
    """B5 as a column: ``all_pad`` is true for tiles that hold only PAD."""
    return df.withColumn(flag, is_all_pad(F.col(ids_col)))


def reject_all_pad(df: DataFrame, ids_col: str = "ids",
                   strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split tiles into (kept, quarantined) where quarantined tiles hold only PAD.
    ``strict`` raises instead when any tile is all PAD (one small job)."""
    bad = is_all_pad(F.col(ids_col))
    if strict and df.filter(bad).limit(1).count():
        raise ValueError("a sample contains only PAD tokens")
    return df.filter(~bad), df.filter(bad)
