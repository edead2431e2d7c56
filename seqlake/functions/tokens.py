"""Character tokenizer on columns.

Token ids are kept in a compact string, one character per id: ``chr(48 + id)``. With the
default vocabulary A->'7', C->'8', G->'9', T->':', N->';', PAD->'4', other->'6'. That is
1 byte per base instead of 4 in ``array<int>``, it stays a plain string for ``substring``,
``translate`` and ``rpad``, and the array form is built only at the API edge
(:func:`ids_array`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlake.constants import DEFAULT_VOCAB, OTHER_ID, PAD_ID


MAX_ID = 78         # chr(48 + 78) is the last printable ASCII character: one byte per id


def id_char(i: int) -> str:
    if not 0 <= i <= MAX_ID:
        raise ValueError(f"token id {i}: the compact form holds ids from 0 to {MAX_ID}")
    return chr(48 + i)


def tokenize(seq: Column, vocab: dict[str, int] | None = None, other_id: int = OTHER_ID,
             n_as_pad: bool = False, pad_id: int = PAD_ID) -> Column:
    """One id per character, no special tokens. ASCII letters are folded to upper case
    (never ``upper()``: it changes lengths on some non-ASCII letters). ``n_as_pad`` emits
    PAD for N directly (E3 folded in).

    A string of printable ASCII only (the usual FASTA case) is mapped by one ``translate``
    over all 95 printable characters; anything else takes two passes (characters outside
    the vocabulary become the "other" id, then ``translate`` maps both cases).
    """
    vocab = dict(vocab or DEFAULT_VOCAB)
    if n_as_pad and "N" in vocab:
        vocab["N"] = pad_id
    letters = "".join(vocab)
    lower = "".join(c.lower() for c in letters if c.lower() != c)
    src = letters + lower
    dst = "".join(id_char(vocab[c]) for c in letters) + "".join(
        id_char(vocab[c.upper()]) for c in lower)
    marked = F.regexp_replace(seq, f"[^{_re_class(src)}]", id_char(other_id))
    general = F.translate(marked, src, dst)
    table = dict(zip(src, dst))
    printable = "".join(chr(c) for c in range(32, 127))
    ascii_map = "".join(table.get(c, id_char(other_id)) for c in printable)
    return F.when(seq.rlike("[^ -~]"), general).otherwise(F.translate(seq, printable, ascii_map))


def _re_class(chars: str) -> str:
    return "".join("\\" + c if c in "\\^]-[" else c for c in chars)


def pad_truncate(ids: Column, length: int, pad_id: int = PAD_ID) -> Column:
    """Cut or right-pad to ``length``."""
    return F.rpad(F.substring(ids, 1, length), length, id_char(pad_id))


def n_to_pad(ids: Column, n_id: int = DEFAULT_VOCAB["N"], pad_id: int = PAD_ID) -> Column:
    """N id -> PAD id, so N positions drop out of the losses."""
    return F.translate(ids, id_char(n_id), id_char(pad_id))


def is_all_pad(ids: Column, pad_id: int = PAD_ID) -> Column:
    """B5 predicate: every position is PAD (an empty tile counts as all PAD)."""
    return F.length(F.replace(ids, F.lit(id_char(pad_id)), F.lit(""))) == 0


def ids_array(ids: Column) -> Column:
    """Compact string -> ``array<int>`` (the API-edge form)."""
    return F.transform(F.split(ids, ""), lambda c: (F.ascii(c) - F.lit(48)).cast("int"))
