"""Personal data by patterns, and terms that disclose it by corpus co-occurrence.

Protected entities are the values found by the patterns (kind and value). With distinct texts as
the unit (a copy of a document is no further evidence, and neither is a third), the information
content of an entity is ``IC(e) = -log2(df(e) / N)`` and the
pointwise mutual information of entity and term ``PMI(e, t) = log2(N df(e, t) / (df(e)
df(t)))``: how much of the entity the term gives away, wherever the two stand in a document. In
every document that mentions the entity, a term with ``PMI >= REMOVE * IC`` is to be removed,
one with ``PMI >= GENERALISE * IC`` to be generalised. Entities and pairs that occur in one
document only prove nothing. Others count if so many common documents come about by chance
(hypergeometric tail) with a probability of ``ALPHA`` at most, shared among the terms that were
looked at for the entity.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm import words
from seqlake.llm.common import flag_among, maybe_among, stored

ALPHA = 0.05        # chance that an entity gets any term by coincidence
TERMS = 4096        # terms per row
GENERALISE = 0.8
REMOVE = 0.95
KINDS = ("email", "ip", "card", "phone")

# A local part ends at its "@" and holds none: the part before an "@" is found backwards.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match from inside a run of digits exists only if one from its beginning does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_ANY = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass the kind's test, by kind and
    start; offsets count code points, ends are exclusive."""
    if not _ANY.search(text):
        return []
    found = (_emails(text), _ips(text), _cards(text), _phones(text))
    return [(kind, a, b) for kind, spans in zip(KINDS, found) for a, b in spans]


def _entity(kind: str, value: str) -> int:
    if kind != "email":
        value = "".join(c for c in value if c.isdigit() or c == ".")
    digest = hashlib.blake2b(f"{kind}:{value.lower()}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _words(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of the words of a text, and their hashes."""
    return [m.span() for m in _WORD.finditer(text)], \
        words.word_hashes(text.encode("utf-8", "surrogatepass"))[1].view(np.int64)


def _free(at: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Which of the words ``at`` hold no part of any span."""
    begin, end = np.array(at, dtype=np.int64).reshape(-1, 2).T
    free = np.ones(len(at), dtype=bool)
    for _, a, b in spans:
        free[np.searchsorted(end, a, side="right"):np.searchsorted(begin, b, side="left")] = False
    return free


def _terms(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Distinct terms of a text. Terms hold a letter and no part of any base span."""
    at, h = _words(text)
    letter = np.array([any(c.isalpha() for c in text[a:b]) for a, b in at], dtype=bool)
    return np.unique(h[_free(at, spans) & letter])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row_key, text)`` -> for texts with base spans, the distinct entities, the number of
    terms and ``TERMS`` of them; the further ones follow in rows without entities."""
    ints = pa.list_(pa.int64())
    schema = pa.schema([("row_key", pa.int64()), ("entities", ints), ("n_terms", pa.int64()), ("terms", ints)])
    for batch in batches:
        rows = []
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            spans = base_spans(text or "")
            if spans:
                terms = _terms(text, spans)
                rows.append((key, sorted({_entity(k, text[a:b]) for k, a, b in spans}), len(terms), terms[:TERMS]))
                rows += [(key, [], 0, terms[i:i + TERMS]) for i in range(TERMS, len(terms), TERMS)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                                             schema=schema)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word of each block of texts."""
    for batch in batches:
        for _, group in words.blocks(batch.column(0).to_pylist()):
            flat, _ = words.distinct(*words.words_of(group))
            term, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)],
                                             names=["term", "n"])


def _placeholder(word: str) -> str:
    """The class of a word by its form, which stands for a generalised term."""
    if any(c.isdigit() for c in word):
        return "[code]"
    return "[name]" if next(c for c in word if c.isalpha()).isupper() else "[word]"


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with the spans of the patterns replaced by their kind (those that overlap, by
    the kind of the first), terms to remove cut and terms to generalise replaced by their class."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out.append(text[done:a])
            if kind != "removed":
                out.append(_placeholder(text[a:b]) if kind == "term" else f"[{kind}]")
        done = max(done, b)
    return "".join(out) + text[done:]


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text, removed, generalised)`` -> spans of the patterns, spans of the listed
    terms, and the text without them."""
    def listed(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    for batch in batches:
        base_out, term_out, text_out = [], [], []
        for text, gone, general in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            base, marks = base_spans(text or ""), []
            if gone or general:
                at, h = _words(text)
                sets = (("removed", set(gone or ())), ("term", set(general or ()) - set(gone or ())))
                free = _free(at, base).tolist()
                marks = [(k, a, b) for k, terms in sets
                         for (a, b), t, f in zip(at, h.tolist(), free) if f and t in terms]
            base_out.append(listed(base))
            term_out.append(listed(marks))
            text_out.append(sanitised(text, base + marks) if base or marks else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.string()) for c in (base_out, term_out, text_out))],
            names=["doc_id", "base", "terms", "sanitised"])


def chance(n: int, n_e: int, n_t: int, both: int) -> float:
    """Probability that sets of ``n_e`` and ``n_t`` of ``n`` documents, drawn independently,
    have ``both`` or more in common."""
    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    first = max(both, n_e + n_t - n, 0)
    if first > min(n_e, n_t):
        return 0.0
    p = math.exp(log_choose(n_t, first) + log_choose(n - n_t, n_e - first) - log_choose(n, n_e))
    total = 0.0
    for i in range(first, min(n_e, n_t) + 1):
        total += p
        step = (n_e - i) * (n_t - i) / ((i + 1) * (n - n_e - n_t + i + 1))
        p *= step
        if step < 1 and p <= 1e-12 * total:
            break
    return min(total, 1.0)


def _significant(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``(df_e, df_t, df_et, tested, ...)`` that are no coincidence, without these."""
    for batch in batches:
        keep = [chance(n, *row[:3]) * row[3] <= ALPHA
                for row in zip(*(batch.column(i).to_pylist() for i in range(4)))]
        yield batch.select(range(4, batch.num_columns)).filter(pa.array(keep, pa.bool_()))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """``row_key, text``, every text once. Only texts that may have a copy are shuffled (and
    each task sends one of its copies); the others stay where they are."""
    copied = texts.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    flagged = flag_among(texts, "row_key", stored(copied.select("row_key"), "copied"), "_copied")
    return flagged.filter("NOT _copied").select("row_key", "text").unionAll(
        flagged.filter("_copied").groupBy("row_key").agg(F.first("text").alias("text")))


def disclosing_terms(found: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``row_key, term, share``: the terms of each text whose mutual information with one of its
    entities is at least ``GENERALISE`` of the entity's information; ``share`` is that part.

    Entities of the same documents have the same figures and are handled as one ``group``, so a
    list of many addresses that comes twice is counted once. ``texts`` are the ``n`` distinct
    texts that the figures are about.
    """
    mention = found.select("row_key", "n_terms", F.explode("entities").alias("entity"))

    def total(seed: int):
        return F.sum(F.xxhash64(F.lit(seed), "row_key").cast("decimal(20,0)"))

    entity = mention.groupBy("entity").agg(
        F.count(F.lit(1)).alias("df_e"), F.sum("n_terms").alias("tested"), total(1).alias("t1"),
        total(2).alias("t2")).filter("df_e > 1") \
        .select("entity", "df_e", "tested", F.xxhash64("df_e", "t1", "t2").alias("group"))
    member = stored(mention.join(entity, "entity").groupBy("row_key", "group").agg(
        F.first("df_e").alias("df_e"), F.first("tested").alias("tested")), "mentions")
    lists = maybe_among(found.filter(F.size("terms") > 0).select("row_key", "terms"), "row_key",
                        member).join(member, "row_key")
    each = lists.select("row_key", "group", "df_e", "tested", F.explode("terms").alias("term"))
    pair = stored(each.groupBy("group", "term").agg(
        F.count(F.lit(1)).alias("df_et"), F.first("df_e").alias("df_e"),
        F.first("tested").alias("tested")).filter("df_et > 1"), "pairs")
    terms = pair.select("term").distinct()
    # documents per candidate term, over all texts
    counted = texts.mapInArrow(_count_terms, "term bigint, n bigint")
    df = flag_among(counted, "term", terms, "_maybe").filter("_maybe").groupBy("term") \
        .agg(F.sum("n").alias("df_t")).join(terms, "term", "left_semi")
    ic = -F.log2(F.col("df_e") / F.lit(float(max(n, 1))))
    pmi = F.log2(F.lit(float(n)) * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    share = pair.join(df, "term").withColumn("share", pmi / F.nullif(ic, F.lit(0.0))) \
        .filter(F.col("share") >= GENERALISE) \
        .select("df_e", "df_t", "df_et", "tested", "group", "term", "share") \
        .mapInArrow(lambda it: _significant(it, n), "group bigint, term bigint, share double")
    share = stored(share.withColumn("pair", F.xxhash64("group", "term")), "shares")
    return maybe_among(each.select("row_key", "group", "term", F.xxhash64("group", "term").alias("pair")),
                       "pair", share).join(share.drop("pair"), ["group", "term"]) \
        .select("row_key", "term", "share")


def sanitise_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_removed, n_terms, sanitised``.

    ``spans`` lists ``kind:start:end`` of all spans: the patterns' by kind and start, then the
    terms to remove (``removed``) and to generalise (``term``). ``base_sha256`` is over the
    patterns' spans alone. ``sanitised`` is the whole text after :func:`sanitised` on these spans.

    Defined cases: null and empty texts have no spans and stay. Statistics count every distinct
    text once, so copies neither add nor take away a span. A null id is kept. Rows that share a
    text are marked alike. Other columns are not read. An empty table gives an empty result.
    """
    src = docs.select(F.xxhash64(F.col(text_col)).alias("row_key"),
                      F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    once = distinct_texts(src.select("row_key", "text"))
    found = stored(once.mapInArrow(
        _find, "row_key bigint, entities array<bigint>, n_terms bigint, terms array<bigint>"), "found")
    per = disclosing_terms(found, once.select("text"), src.select("row_key").distinct().count()).groupBy("row_key").agg(
        F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone"),
        F.collect_set(F.when(F.col("share") < REMOVE, F.col("term"))).alias("general"))
    per = stored(per, "terms")
    # only texts that may have such terms are shuffled
    maybe = flag_among(src, "row_key", per, "_maybe")
    none = F.lit(None).cast("array<bigint>")
    plain = maybe.filter("NOT _maybe").select("doc_id", "text", none.alias("gone"), none.alias("general"))
    listed = maybe.filter("_maybe").join(per, "row_key", "left").select("doc_id", "text", "gone", "general")
    out = plain.unionByName(listed).mapInArrow(
        _sanitise, "doc_id bigint, base string, terms string, sanitised string")
    base, terms = F.col("base"), F.col("terms")

    def count(column, kind: str):
        return F.regexp_count(column, F.lit(f"(^|,){kind}:")).cast("bigint")

    both = F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms))
    return out.select(
        "doc_id", *[count(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), both.alias("spans"),
        count(terms, "removed").alias("n_removed"), count(terms, "term").alias("n_terms"), "sanitised")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans and counts of :func:`sanitise_personal_data`, without the texts."""
    return sanitise_personal_data(docs, id_col, text_col).drop("sanitised")
