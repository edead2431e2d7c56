"""Mixture-controlled packing by deficit round robin over source queues.

1. Texts become token ids (kept as 16-bit numbers in a table), with the running number of
   tokens of their source in their task; sums per task give every document its place in its
   source's queue.
2. The queues are cut into *partitions* of about ``PARTITION`` tokens: a document belongs to
   the partition that its place falls into, so every partition holds each source's share of
   the tokens, give or take a document.
3. Within a partition, deficit round robin: each window of ``WINDOW`` sequences adds a source's
   share of the window to its deficit, and a source serves documents while its deficit covers
   them. What is left over stays as deficit for the next window. The deficit that a partition
   begins with is what its source was due minus what it got in all partitions before.
4. The served documents form one gapless stream over all partitions, cut into sequences every
   ``length`` ids; only the very last sequence is not full.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm import words
from seqlake.llm.common import stored

LENGTH = 4096               # ids per sequence
WINDOW = 16                 # sequences per window
PARTITION = 1 << 18         # ids per partition, about
END = 2                     # id behind every document
KNOWN = 1 << 21             # words whose ids a worker remembers
BROADCAST_OFFSETS = 200_000  # rows of (task, source) sums up to which they are broadcast
BATCH_BYTES = 6 << 20       # text tokenized at once

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, source string, partition bigint")


class WordTokenizer:
    """Token ids of whole texts through a table of words.

    The vocabulary's pre-tokenizer drops white space and never joins what white space parts,
    so a text's ids are those of its words one after the other. Each distinct word is split
    and merged once per worker; its ids are found by the word's 64-bit hash afterwards.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.hash = np.empty(0, dtype=np.uint64)        # sorted
        self.first = np.empty(0, dtype=np.int64)        # begin of the word's ids in self.ids
        self.count = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint16)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Adds words that are not known yet, by ascending hash."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        first = len(self.ids) + np.cumsum(count) - count
        flat = np.fromiter((x for i in ids for x in i), dtype=np.uint16, count=int(count.sum()))
        self.ids = np.concatenate((self.ids, flat))
        at = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hash, hashes), max(len(self.hash) - 1, 0))
        return at, (self.hash[at] == hashes) if len(self.hash) else np.zeros(len(hashes), bool)

    def encode(self, group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a group, and their bounds."""
        data = b" ".join(group)
        start, h = words.word_hashes(data)
        size = np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1
        bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(size))))
        if not len(h):
            return np.empty(0, np.uint16), np.zeros(len(group) + 1, np.int64)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        stop = np.append(start[1:], len(data))
        new = np.flatnonzero(~self._at(distinct)[1])
        if len(self.hash) + len(new) > KNOWN:           # make room: begin with this group's words
            self.forget()
            new = np.arange(len(distinct))
        if len(new):
            self.learn(distinct[new], [data[a:b].rstrip().decode("utf-8", "replace") for a, b in
                                       zip(start[where[new]].tolist(), stop[where[new]].tolist())])
        at, _ = self._at(distinct)
        first, count = self.first[at][back], self.count[at][back]
        total = np.concatenate(([0], np.cumsum(count)))
        place = np.repeat(first - total[:-1], count) + np.arange(total[-1])
        return self.ids[place], total[bounds]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenize(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """``(doc_id, source, text)`` -> ids and the place among the task's tokens of the source."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    tokenizer = _tokenizers[path]
    task = TaskContext.get().partitionId()
    served: dict[str | None, int] = {}
    end = np.array([END], dtype=np.uint16).tobytes()
    for batch in batches:
        for first, group in words.blocks(batch.column(2).to_pylist(), BATCH_BYTES):
            ids, bounds = tokenizer.encode(group)
            sources = batch.column(1).slice(first, len(group))
            data = [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:])]
            before = []
            for s, d in zip(sources.to_pylist(), data):
                before.append(served.get(s, 0))
                served[s] = before[-1] + len(d) // 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(group)), sources,
                 pa.array(np.diff(bounds) + 1, pa.int64()), pa.array([task] * len(group), pa.int64()),
                 pa.array(before, pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "source", "n", "task", "before", "ids"])


def round_robin(queues: dict[str | None, list[int]], shares: dict[str | None, float],
                deficits: dict[str | None, float], window: float,
                first_window: float) -> list[tuple[str | None, int]]:
    """Order in which documents are served: ``queues`` has their lengths, ``shares`` the target
    proportions. The first window may be the rest of a window begun before."""
    waiting = {s: deque(enumerate(q)) for s, q in queues.items() if q}
    due = {s: deficits.get(s, 0.0) for s in waiting}
    order = sorted(waiting, key=lambda s: (s is None, s))
    out, size = [], first_window
    while waiting:
        # sources that have run dry leave their share to the others
        total = sum(shares[s] for s in waiting)
        for s in order:
            if s in waiting:
                due[s] += size * (shares[s] / total if total else 1 / len(waiting))
        for s in order:
            q = waiting.get(s)
            while q and q[0][1] <= due[s]:
                i, n = q.popleft()
                due[s] -= n
                out.append((s, i))
            if q is not None and not q:
                del waiting[s]
        size = window
    return out


def _serve(docs: pa.Table, plan: pa.Table, length: int) -> pa.Table:
    """One partition: documents in round-robin order, cut at the ends of sequences."""
    plan_rows = {r["source"]: r for r in plan.to_pylist()}
    at = next(iter(plan_rows.values()))["at"]
    docs = docs.sort_by([("task", "ascending"), ("before", "ascending"), ("doc_id", "ascending")])
    ids, n = docs["doc_id"].to_pylist(), docs["n"].to_pylist()
    queue: dict[str | None, list[int]] = {}
    for i, s in enumerate(docs["source"].to_pylist()):
        queue.setdefault(s, []).append(i)
    window = WINDOW * length
    order = round_robin({s: [n[i] for i in q] for s, q in queue.items()},
                        {s: plan_rows[s]["share"] for s in queue},
                        {s: plan_rows[s]["deficit"] for s in queue}, window, window - at % window)
    data = docs["ids"]
    partition = docs["partition"][0].as_py()
    rows = []
    for s, k in order:
        i = queue[s][k]
        tokens = np.frombuffer(data[i].as_buffer(), dtype=np.uint16).astype("<u4")
        done = 0
        while done < n[i]:
            take = min(n[i] - done, length - at % length)
            rows.append((ids[i], done, take, zlib.crc32(tokens[done:done + take].tobytes()), n[i],
                         at // length, at % length, s, partition))
            done += take
            at += take
    types = [pa.int64()] * 7 + [pa.string(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.table({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows), types)})


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", source_col: str = "source",
         text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece (``PIECES``): ``length`` ids of document ``doc_id`` from ``start`` on
    lie in sequence ``sequence_id`` from ``offset`` on.

    ``tokenizer`` is the path of the vocabulary file, on every executor. A source's target
    share is its share of all tokens, so the queues run dry together and every window keeps the
    proportions to the end.

    Defined cases: null and empty texts are the end id alone; a null source is a source of its
    own; every row is packed, repeated ids and rows too; a null id is carried along. Other
    columns are not read. An empty table gives no pieces.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                      F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    tokens = stored(src.mapInArrow(
        lambda it: _tokenize(it, tokenizer),
        "doc_id bigint, source string, n bigint, task bigint, before bigint, ids binary"), "tokens")
    # place of each task's documents in its source's queue: one row per task and source
    per = tokens.groupBy("source", "task").agg(F.sum("n").alias("n"))
    queue = Window.partitionBy("source")
    begin = stored(per.select(
        F.col("source").alias("_source"), F.col("task").alias("_task"),
        (F.sum("n").over(queue.orderBy("task")) - F.col("n")).alias("_begin"),
        F.sum("n").over(queue).alias("_total")), "queues")
    total = begin.select("_source", "_total").distinct().agg(F.sum("_total")).first()[0] or 0
    parts = max(1, round(total / PARTITION))
    side = F.broadcast(begin) if begin.count() <= BROADCAST_OFFSETS else begin
    dealt = tokens.join(side, F.col("source").eqNullSafe(F.col("_source"))
                        & (F.col("task") == F.col("_task")))
    dealt = dealt.withColumn("partition", F.floor(
        (F.col("_begin") + F.col("before")).cast("double") / F.col("_total") * parts).cast("bigint"))
    dealt = dealt.withColumn("partition", F.least("partition", F.lit(parts - 1).cast("bigint")))
    # where each partition begins, and what each source is due by then
    got = dealt.groupBy("partition", "source", "_total").agg(F.sum("n").alias("n"))
    got = got.withColumn("_got", F.sum("n").over(Window.partitionBy("source").orderBy("partition"))
                         - F.col("n"))
    sizes = got.groupBy("partition").agg(F.sum("n").alias("_size"))
    sizes = sizes.select("partition", (F.sum("_size").over(Window.orderBy("partition"))
                                       - F.col("_size")).cast("bigint").alias("at"))
    share = F.col("_total") / F.lit(float(max(total, 1)))
    plan = got.join(sizes, "partition").select(
        F.col("partition").alias("part"), F.col("source").alias("source"), "at", share.alias("share"),
        (share * F.col("at") - F.col("_got")).alias("deficit"))
    docs_of = dealt.select("partition", "doc_id", "source", "n", "task", "before", "ids")
    return docs_of.groupBy("partition").cogroup(plan.groupBy("part")).applyInArrow(
        lambda d, p: _serve(d, p, length), PIECES)
