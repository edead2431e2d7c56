"""Source divergence, spelling variants and licence scans against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import SF_SMALL

from seqlake.llm import divergence, licences, queries, variants

from .conftest import DOC_SCHEMA


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_licences"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF_SMALL)
    rel = con.sql(queries.ORACLE[name])
    rows = rel.fetchall()
    assert sorted(got.columns) == sorted(rel.columns) and len(rows) > 100
    same(got.select(*rel.columns).collect(), rows)


# ---------------------------------------------------------------- source divergence

def divergences(rows, min_docs, leading=10):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_docs]
        count = defaultdict(Counter)
        for _, s, ts in own:
            count[s].update(t for t in ts if df[t] >= min_docs)
        every = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10 ** 9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in list(count):
            pairs = [(o, sum(f(p(count[s], t), p(count[o], t)) for t in kept)) for o in list(count) if o != s]
            terms = [(t, f(p(count[s], t), p(every, t))) for t in kept
                     if count[s][t] and p(count[s], t) > p(every, t)]
            for part, found, limit in (("pair", pairs, None), ("term", terms, leading)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked[:limit])]
    return out


@pytest.mark.parametrize("min_docs,fold,cells,dense", [(2, 1 << 20, 1 << 20, 1 << 20), (3, 7, 5, 9), (1000, 7, 5, 9)])
def test_source_divergence(spark, docs, doc_rows, monkeypatch, min_docs, fold, cells, dense):
    fold_all, block = divergence._fold, divergence._block
    monkeypatch.setattr(divergence, "_fold", lambda it: fold_all(it, fold))
    monkeypatch.setattr(divergence, "_block", lambda n: block(n, dense))
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)       # read by the driver
    got = divergence.source_divergence(docs, min_docs=min_docs).select(
        "lang", "source", "part", "item", "value", "rank").collect()
    want = divergences(doc_rows, min_docs)
    assert len(want) > 15 and (min_docs == 1000 or any(r[2] == "term" for r in want))
    same(got, want)


def test_source_divergence_odd_rows(spark, no_docs):
    rows = [(i, t, lang, s, 0, 0.0, "", "") for i, (t, lang, s) in enumerate(
        [("Äb äB a\tA_b", None, "x")] * 3 + [(None, None, None)] * 2 + [("", "de", "x"), ("q", "de", "y"),
         ("Äb\x00äb ÉÉ" + " long" * 50000, None, ""), ("solo", "fr", "z"), ("Äb", None, "y")])]
    got = divergence.source_divergence(spark.createDataFrame(rows, DOC_SCHEMA), min_docs=2).collect()
    same(got, divergences(rows, 2))
    assert ("de", "x", "pair", "y", 0, 1) in map(tuple, got) and not any(r.lang == "fr" for r in got)
    assert divergence.source_divergence(no_docs).count() == 0


def test_shares_are_exact_beyond_64_bit_products():
    np = pytest.importorskip("numpy")
    rng = random.Random(1)
    total = [rng.randrange(1, 9 * 10 ** 15) for _ in range(500)]
    count = [rng.randrange(0, t) for t in total]
    got = divergence.parts_of(np.array(count) - 2, np.array(total))
    assert got.tolist() == [1 + 10 ** 9 * c // t for c, t in zip(count, total)]


# ---------------------------------------------------------------- spelling variants

def spellings_of(rows, shortest=5, least=3):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_of(n):
    by = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n[w], len(by[w]), n.get(form[w])) for w in n]


def check_variants(spark, words):
    """Words with given frequencies, as documents (the checksum is taken into account)."""
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = variants_of(spellings_of(rows))
    same(got, want)
    return want


def test_spelling_variants_of_random_words(spark):
    rng = random.Random(4)
    words = {}
    for _ in range(150):
        w = "".join(rng.choice("abÿ") for _ in range(rng.randint(5, 9)))
        words[w] = rng.choice([3, 3, 4, 6, 7, 12, 30, 100])
    want = check_variants(spark, words)
    assert sum(r[4] for r in want) > 80 and sum(r[1] is not None for r in want) > 15
    assert any(r[2] not in (r[0], r[1]) for r in want)          # chains of forms


def test_spelling_variants_of_long_words(spark):
    """Around the depth of the tries, and runs of one letter, where many edits give one word."""
    rng = random.Random(5)
    words = {}
    for length in (30, 31, 32, 33, 34, 60, 400):
        base = "".join(rng.choice("abcd") for _ in range(length))
        words[base] = 9
        for _ in range(6):
            i = rng.randrange(length)
            words[rng.choice([base[:i] + base[i + 1:], base[:i] + "e" + base[i:], base[:i] + "f" + base[i + 1:]])] = 4
    for length in (5, 6, 7, 31, 32, 33, 34, 3000, 3001):
        words["z" * length] = 3 + length % 5
    want = check_variants(spark, words)
    assert sum(r[4] for r in want) > 90


def test_spelling_variants_of_odd_documents(spark, docs, doc_rows, no_docs):
    rows = [(r[0], r[1]) for r in doc_rows]
    got = variants.spelling_variants(docs).collect()
    same(got, variants_of(spellings_of(rows)))
    odd = [(None, "Straße straße STRASSE ßßßßß×÷ 漢字abcde" * 3), (1, None), (2, ""), (3, "aaaaa " * 40000),
           (3, "aaaaa " * 40000), (4, "aaaab " * 3), (5, "aaaa aaa aa a")]
    got = variants.spelling_variants(spark.createDataFrame(odd, "doc_id bigint, text string")).collect()
    same(got, variants_of(spellings_of(odd)))
    assert {r.word: r.n for r in got}["aaaaa"] >= 80000
    assert variants.spelling_variants(no_docs).count() == 0


def test_small_tables_are_spilled(spark, docs, doc_rows, monkeypatch):
    count = variants._count
    monkeypatch.setattr(variants, "_count", lambda n: count(n, 3))
    got = variants.spellings(docs).collect()
    assert {r.word: r.n for r in got} == spellings_of([(r[0], r[1]) for r in doc_rows])


def test_trie_levels_hold_no_pairs_of_unrelated_words(spark):
    """A hot prefix: states stay at most as many as words times letters."""
    rows = [(f"prefix{a}{b}{c}tail{a}",) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    words = spark.createDataFrame(rows, "word string")
    got = variants.spelling_pairs(words).collect()
    assert len(got) == len({tuple(sorted(r)) for r in got})
    names = [r[0] for r in rows]
    assert {tuple(sorted(r)) for r in got} == {(x, y) for x in names for y in names if x < y and near(x, y)}


# ---------------------------------------------------------------- licences

def licences_of(text, templates, share=0.5):
    w = re.findall(licences.WORD, lower(text))
    found = []
    for t in templates:
        own = licences.words_in(t.text)
        must = licences.mandatory(t)
        for s in range(-len(own), len(w)):
            if all(0 <= s + j < len(w) and w[s + j] == x for j, x in must):
                part = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(own)) / len(own)
                if part >= share:
                    found.append((s, t.label, t.base, len(own), part))
    return len(w), sorted(found)


LICENCE_TEXTS = [
    None, "", "  ", "CC BY", "cc-by-nc 4.0", "Licensed under CC BY-NC 4.0.", "cc cc by by cc\nBY", "all rights reserved",
    "All Rights. Reserved! all rights reserved all rights", "GNU GENERAL PUBLIC LICENSE version 2",
    "This work is licensed under the GNU General Public License, version 3.", "mit license", "the MIT license all rights",
    "free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of",
    "granted free of charge to any person", "aLL righTs ReServed", "all righté reserved", "allß rights reserved",
    "İall rights reserved", "Kcc by", "ccK by", "K all rights reserved", "cc漢 by", "cc漢by cc by",
    "word " * 30000 + "cc by", "cc by " * 3000, "by cc", "apache license", "under the apache license, version 2.0"]


@pytest.mark.parametrize("templates", [licences.BASE + licences.NOTICES, licences.BASE, (
    licences.Template("twice", "a b a b c", ("a b", "c")), licences.Template("x", "by by cc", ("by by",)))])
def test_licences(spark, templates):
    rows = [(i, t, "clash") for i, t in enumerate(LICENCE_TEXTS + ["a b a b c a b", "by by by cc"])]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _words string").repartition(3)
    got = licences.scan_licences(df, templates).collect()
    assert len(got) == len(rows) and sum(len(r.licences) for r in got) > 1
    for r in got:
        n, found = licences_of(r.text, templates)
        assert r.n_words == n and r["_words"] == "clash"
        assert [(m.start, m.label, m.base, m.words, m.share) for m in r.licences] == found, r.text


def test_licence_digest_and_edges(spark, no_docs):
    rows = [(i, t) for i, t in enumerate(LICENCE_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in licences.licence_digest(licences.scan_licences(df)).collect():
        _, found = licences_of(LICENCE_TEXTS[r.doc_id], licences.BASE + licences.NOTICES)
        base = [f for f in found if f[2]]
        assert (r.n_base, r.first_word, r.last_word) == (
            len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None))
        assert r.base_labels == ",".join(sorted({f[1] for f in base})) and r.labels == ",".join(sorted({f[1] for f in found}))
        assert r.score == max((f[4] for f in found), default=0.0)
    assert licences.scan_licences(no_docs).count() == 0
    assert [r.licences for r in licences.scan_licences(df, ()).collect()] == [[]] * len(rows)
    with pytest.raises(ValueError, match="exists already"):
        licences.scan_licences(df.withColumnRenamed("doc_id", "N_Words"))
    with pytest.raises(ValueError, match="does not hold"):
        licences.scan_licences(df, [licences.Template("x", "some text", ("other",))])


def test_anchor_is_the_rarest_mandatory_word(spark):
    df = spark.createDataFrame([(f"all rights {'reserved' if i == 0 else ''}",) for i in range(9)], "text string")
    found = licences.document_frequencies(df, ["all", "rights", "reserved", "none"])
    assert found == {"all": 9, "rights": 9, "reserved": 1}
    plan = licences.scan_licences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "[reserved]" in plan
