"""Text operators against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL

from seqlake.llm import line_dedup, near_dedup, packing, pii, quality, words
from seqlake.llm.common import components, flag_among

from .conftest import DOC_SCHEMA, make_docs, union_find

SPACE = re.compile(r"[^ \t-\r]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def word_list(t):
    return SPACE.findall(lower(t or ""))


def shingle_set(t, k):
    w = word_list(t)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def similar(a, b, t=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= t * len(a | b)


# ---------------------------------------------------------------- words

def test_word_hashes_follow_words():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abAB é\t\n\x0b\x1c漢"), 5000))
    start, h = words.word_hashes(text.encode())
    found = word_list(text)
    assert len(h) == len(found)
    by_word = {}
    for w, x in zip(found, h.tolist()):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_blocks_do_not_change_hashes(monkeypatch):
    data = (" ".join(f"w{i % 977}" for i in range(20000)) + " " + "y" * 9000 + " end").encode()
    whole = words.word_hashes(data)
    monkeypatch.setattr(words, "BLOCK", 1000)
    cut = words.word_hashes(data)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_flag_keeps_every_key(spark):
    df = spark.range(2000).selectExpr("id", "xxhash64(id) AS k")
    keys = df.filter("id % 10 = 3").select("k")
    flagged = {r[0] for r in flag_among(df, "k", keys, "f").filter("f").select("id").collect()}
    assert {i for i in range(2000) if i % 10 == 3} <= flagged and len(flagged) < 220
    assert flag_among(df, "k", keys.limit(0), "f").filter("f").count() == 0


# ---------------------------------------------------------------- near duplicates

@pytest.mark.parametrize("k,small", [(2, False), (5, False), (2, True)])
def test_near_duplicates(docs, doc_rows, k, small, monkeypatch):
    if small:   # every leaf is large: branch down to the last level
        monkeypatch.setattr(near_dedup, "LEAF", 3)
        monkeypatch.setattr(near_dedup, "BLOCK", 2)
        monkeypatch.setattr(near_dedup, "MAX_DEPTH", 6)
    got = near_dedup.near_duplicates(docs, shingle=k).collect()
    sets = {r[0]: shingle_set(r[1], k) for r in doc_rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if similar(sets[a], sets[b])]
    want = union_find(ids, links)
    assert len(links) > 20 and len(set(want.values())) > 20
    assert len(got) == len(doc_rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_null_ids_and_shared_ids(spark):
    rows = [(None, "a b c"), (7, "A b c"), (9, "a b c"), (9, "other words here"), (None, "alone it is"),
            (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2)
    assert Counter((r[0], r[3], r[4]) for r in got.select("doc_id", "row_key", "n_shingles", "component_id",
                                                          "kept").collect()) == Counter(
        [(None, 7, False), (7, 7, True), (9, 7, False), (9, 9, True), (None, None, True), (None, None, True)])


def test_drop_near_duplicates(docs, doc_rows, no_docs):
    got = near_dedup.drop_near_duplicates(docs, shingle=2)
    assert got.schema.names == docs.schema.names
    sets = {r[0]: shingle_set(r[1], 2) for r in doc_rows}
    ids = sorted(sets)
    comp = union_find(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if similar(sets[a], sets[b])])
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted({r for r in doc_rows if comp[r[0]] == r[0]}, key=repr)
    assert near_dedup.drop_near_duplicates(no_docs).count() == 0


def test_hot_near_copies_stay_linear(spark):
    """A large family of near copies is joined through its anchors: the exhaustive step sees
    no pairs of one component."""
    rng = __import__("random").Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_pairs_in_large_leaves_are_found(spark, monkeypatch):
    """Pairs at the threshold among texts with much boilerplate: every leaf is large and mixed
    and branched down to the last level, where few pairs are left in one tree."""
    monkeypatch.setattr(near_dedup, "LEAF", 3)
    common = [f"c{i}" for i in range(76)]
    rows = []
    for i in range(300):
        own = common + [f"o{i}x{j}" for j in range(4)]
        rows += [(2 * i + k, " ".join(own + [f"d{i}x{k}x{j}" for j in range(10)])) for k in (0, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=1)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i - i % 2 for i, _ in rows}


def test_true_link_between_components_beside_a_false_one():
    """Sets that agree in the upper halves of their values only are not linked, and do not keep
    a true link between the same components from being found."""
    import pyarrow as pa
    p = [(i << 32) + 5 for i in range(10)]
    false = p[:8] + [(8 << 32) + 6, (9 << 32) + 6]
    true = p[:9] + [(77 << 32) + 5]
    sets = [np.array(x, dtype=np.uint64) for x in (p, false, true)]
    table = pa.table({
        "cls": [1, 2, 3], "n": [10, 10, 10], "label": [1, 2, 2], "build": [False, True, True],
        "probe": [True, False, False], "members": [x.tobytes() for x in sets],
        "short": [(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]})
    assert near_dedup._compare(table, 80).to_pylist() == [{"a": 1, "b": 3}]


def test_trees_share_no_values():
    """Nodes of different trees depend on different minwise values."""
    sig = near_dedup.sketch_sets(np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15),
                                 np.array([0, 50]), near_dedup.TREES + near_dedup.EXTRA)
    for tree in (0, near_dedup.TREES, near_dedup.TREES + near_dedup.EXTRA - 1):
        other = np.zeros_like(sig)
        own = slice(tree * near_dedup.FAMILY, (tree + 1) * near_dedup.FAMILY)
        other[:, own] = sig[:, own]
        nodes = [near_dedup.descend(np.array([tree + 64], dtype=np.uint64), np.zeros(1, np.int64), s, 8, 80)[0]
                 for s in (sig, other)]
        assert sorted(nodes[0].tolist()) == sorted(nodes[1].tolist())
        assert set((nodes[0] & np.uint64(31)).tolist()) == {tree}


# ---------------------------------------------------------------- lines

def brute_lines(rows, order):
    lines = []
    for r in rows:
        for i, x in enumerate((r[1] or "").split("\n")):
            lines.append((order(r), i, frozenset(word_list(x))))
    out = {}
    for r in rows:
        t = r[1]
        if t is None:
            out[r[0]] = (0, 0, None)
            continue
        parts, n, gone, keep = t.split("\n"), 0, 0, []
        for i, x in enumerate(parts):
            s = frozenset(word_list(x))
            if not s:
                keep.append(x)
                continue
            n += 1
            if any((o, j) < (order(r), i) and similar(s, u) for o, j, u in lines):
                gone += 1
            else:
                keep.append(x)
        out[r[0]] = (n, gone, t if not gone else "" if gone == n else "\n".join(keep))
    return out


@pytest.mark.parametrize("frequent", [64, 2])
def test_dedup_lines(docs, doc_rows, frequent, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    got = line_dedup.dedup_lines(docs, lines_col="n_lines", removed_col="n_gone")
    want = brute_lines(sorted(set(doc_rows)), lambda r: r[0])
    assert sum(v[1] for v in want.values()) > 20
    assert got.columns == [*docs.columns, "n_lines", "n_gone"]
    rows = got.collect()
    assert len(rows) == len(doc_rows)
    assert {r["doc_id"]: (r["n_lines"], r["n_gone"], r["text"]) for r in rows} == want


def test_dedup_lines_edge_cases(spark, no_docs):
    rows = [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e f\nz"), (5, "Z\n\n z "), (6, None), (7, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r) for r in got) == Counter([
        (None, "a b c d e", 1, 0), (2, "", 1, 1), (2, "z", 2, 1), (5, "", 2, 2), (6, None, 0, 0), (7, "", 0, 0)])
    assert line_dedup.dedup_lines(no_docs).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(no_docs, lines_col="n")


def test_line_filters_keep_all_matches(spark):
    """Long and short lines around the threshold, few words: many candidates."""
    rows = [(i, r[1]) for i, r in enumerate(make_docs(seed=11, families=40))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_lines(rows, lambda r: r[0])
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()} == want


def test_long_lines_around_the_threshold(spark):
    """Lines that need wide parity marks, of sizes on both sides of their steps, with few words."""
    rng = __import__("random").Random(8)
    rows = []
    for size in (150, 191, 193, 250, 256, 257, 300, 520, 900):
        base = [f"w{rng.randrange(1500)}" for _ in range(size)]
        for k in range(6):
            line = list(base)
            for i in rng.sample(range(size), int(size * rng.choice([0.01, 0.03, 0.05, 0.08, 0.1]))):
                line[i] = f"w{rng.randrange(1500)}"
            rows.append((len(rows), " ".join(line[:rng.randint(int(size * 0.92), size)])))
    rng.shuffle(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_lines(rows, lambda r: r[0])
    assert 8 < sum(v[1] for v in want.values()) < len(rows) - 8
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()} == want


def test_family_of_near_copies_is_verified_once_per_line(spark, monkeypatch):
    """Pairs whose whole sets are compared grow with the family, not with its square."""
    rng = __import__("random").Random(9)
    rows, seen = [], []
    base = [f"w{i}" for i in range(60)]
    for i in range(400):
        line = list(base)
        line[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(line)))
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda s, d, c, pairs, t: (
        seen.append(pairs.count()), verified(s, d, c, pairs, t))[1])
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sum(r.n_removed for r in got.collect()) == 399
    assert sum(seen) <= 3 * 400


def test_family_whose_earliest_lines_match_few(spark, monkeypatch):
    """A group of near copies behind a few far ones: candidate pairs of the whole join grow with
    the group, not with its square. Fails if only the earliest line under a word is tried."""
    rng = __import__("random").Random(10)
    base, rows, seen = [f"w{i}" for i in range(60)], [], {}
    for i in range(300):
        line = list(base)
        for k in rng.sample(range(60), 11 if i < 3 else 3):     # 49 of 71 words: below the threshold
            line[k] = f"v{i}x{k}"
        rows.append((i, " ".join(line)))
    stored = line_dedup.stored

    def count(df, name):
        out = stored(df, name)
        seen.setdefault(name, out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", count)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_lines(rows, lambda r: r[0])
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()} == want
    assert sum(v[1] for v in want.values()) >= 290
    assert seen["pairs"] <= 5 * 300


def test_names_that_clash_by_case(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id bigint, text string, N_Lines int")
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df)


# ---------------------------------------------------------------- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = [c for c in m.group() if c in "0123456789"]
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card":
                s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
                if not 16 <= len(d) <= 19 or sum(x - 9 * (x > 9) for x in s) % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = __import__("random").Random(4)
    bits = ["a@b.c", "@", "x.y%z@mail-1.example.com", "1.2.3.4", "256.1.1.1", "0001.2.3.255", ".", "-", " ",
            "4539 1488 0343 6467", "4539148803436467", "4111-1111-1111-1111", "+1 (555) 010-9999", "+", "+49",
            "12", "7", "é", "漢", "\n", "(", "@a.b@c.d", "+1234567", "99999999999999999999", "..", "a@b.", "\t"]
    hits = Counter()
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        got = pii.base_spans(text)
        assert got == plain_spans(text), text
        hits.update(k for k, _, _ in got)
    assert min(hits[k] for k in PLAIN) > 50
    long = "a" * 200_000 + " " + "1" * 200_000 + " 1.1.1.1"
    assert pii.base_spans(long)[0][0] == "ip"


def test_personal_data(spark, no_docs):
    rows = [(i, f"Contact quokkamaster at quok@zoo.example.org now, visitor {i} {'z' * i}", "x") for i in range(1, 6)]
    rows += [(i, f"plain text number {i} now contact the visitor at home", "x") for i in range(10, 90)]
    rows += [(100, None, "x"), (101, "", "x"), (None, "call +1 555 010 9999", "x"), rows[0]]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, base string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    text = {r[0]: r[1] or "" for r in rows}
    import hashlib
    for i, r in by.items():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text[i]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(plain_spans(text[i]))
    # the word that only occurs around the entity is found, common words are not
    extra = [s.split(":") for s in by[2]["spans"].split(",") if s.split(":")[0] in ("removed", "term")]
    assert "quokkamaster" in [text[2][int(a):int(b)] for _, a, b in extra]
    assert not {"at", "visitor"} & {text[2][int(a):int(b)] for _, a, b in extra}
    assert by[10]["spans"] == "" and by[None]["n_phone"] == 1 and by[100]["spans"] == ""
    assert pii.find_personal_data(no_docs).count() == 0


def brute_marks(rows):
    """Words to remove and to generalise per row, by sets of documents."""
    from math import comb, log2
    n, ents, terms = len(rows), [], []
    for _, text, _ in rows:
        spans = plain_spans(text or "")
        ents.append({(k, text[a:b]) for k, a, b in spans})
        terms.append({lower(m.group()) for m in SPACE.finditer(text or "")
                      if all(m.end() <= a or m.start() >= b for _, a, b in spans)
                      and any(c.isalpha() for c in m.group())})
    out = [(set(), set()) for _ in rows]
    for e in set().union(*ents):
        at = [i for i in range(n) if e in ents[i]]
        for t in set().union(*(terms[i] for i in at)):
            both, df = sum(t in terms[i] for i in at), sum(t in x for x in terms)
            tail = sum(comb(df, k) * comb(n - df, len(at) - k) for k in range(both, min(df, len(at)) + 1))
            if both < 2 or len(at) == n or tail / comb(n, len(at)) * sum(len(terms[i]) for i in at) > 0.05:
                continue
            share = log2(n * both / (len(at) * df)) / log2(n / len(at))
            for i in at:
                if share >= 0.8 and t in terms[i]:
                    out[i][0 if share >= 0.95 else 1].add(t)
    return [(a, b - a) for a, b in out]


def private_rows():
    rng = __import__("random").Random(8)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(common, k=40)), "x") for i in range(200)]
    far = " ".join(rng.choices(common, k=30))
    for i, mail in ((3, "a@b.org"), (90, "a@b.org"), (7, "c@d.org"), (50, "c@d.org"), (51, "c@d.org")):
        rows[i] = (i, f"Zorblax{mail[0]} {far} write {mail} or 10.0.0.{ord(mail[0])} only{i}", "x")
    rows[120] = (120, far + " zorblaxc", "x")            # also where the entity is not
    rows[130] = (130, "once e@f.org " + " ".join(f"long{i}" for i in range(9000)), "x")
    return rows


def marked(r, text):
    got = {"removed": set(), "term": set()}
    for s in filter(None, r["spans"].split(",")):
        kind, a, b = s.split(":")
        got.get(kind, set()).add(lower(text[int(a):int(b)]))
    return got["removed"], got["term"]


def test_disclosing_terms_anywhere_in_two_documents(spark):
    rows = private_rows()
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, x string")).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    want = {r[0]: w for r, w in zip(rows, brute_marks(rows))}
    assert {r["doc_id"]: marked(r, rows[r["doc_id"]][1]) for r in got} == want
    assert "zorblaxa" in want[3][0] and "zorblaxc" in want[7][1] and not any(want[130])


def test_copies_are_no_evidence(spark):
    """Copies of documents, with and without entities, change no mark and earn none themselves."""
    rows = private_rows()
    own = [(500 + i, f"alone{i} once{i} with g{i}@h.org", "x") for i in range(3)]
    rows += own
    copies = [(1000 + 10 * k + i, rows[i][1], "y") for i in (3, 7, 0, 120) for k in range(5)]
    copies += [(2000 + 10 * k + i, r[1], "y") for i, r in enumerate(own) for k in range(1 + 3 * i)]
    got = pii.find_personal_data(spark.createDataFrame(rows + copies, "doc_id bigint, text string, x string")).collect()
    marks = dict(zip([r[1] for r in rows], brute_marks(rows)))
    texts = {r[0]: r[1] for r in rows + copies}
    assert len(got) == len(texts)
    for r in got:
        assert marked(r, texts[r["doc_id"]]) == marks[texts[r["doc_id"]]]
    assert not any(marks[r[1]][k] for r in own for k in range(2)) and any(marks[rows[3][1]])


def test_sanitised_texts(spark):
    rows = private_rows() + [(900, None, "x"), (901, "", "x"), (902, "Tél\U0001f600 +1 555 010 9999, x@y.z", "x")]
    got = {r["doc_id"]: r for r in pii.sanitise_personal_data(
        spark.createDataFrame(rows, "doc_id bigint, text string, x string")).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[i]["spans"].split(",") if s)]
        want = text
        for k, a, b in sorted(spans, key=lambda s: -s[1]):      # from the end: places stay valid
            form = "code" if re.search(r"\d", text[a:b]) else "name" if text[a:b][0].isupper() else "word"
            want = want[:a] + {"removed": "", "term": f"[{form}]"}.get(k, f"[{k}]") + want[b:]
        assert got[i]["sanitised"] == want
    assert "zorblax" not in got[3]["sanitised"].lower() and "a@b.org" not in got[3]["sanitised"]
    assert got[7]["sanitised"].startswith("[name] ") and got[900]["sanitised"] is None
    assert got[902]["sanitised"] == "Tél\U0001f600 [phone], [email]" and got[0]["sanitised"] == rows[0][1]
    both = [("ip", 4, 12), ("card", 2, 9), ("removed", 13, 14)]
    assert pii.sanitised("a 45.67.8.90 b c", both) == "a [card]  c"


def test_chance_is_the_hypergeometric_tail():
    from math import comb
    for n, e, t, k in ((10, 3, 4, 2), (50, 20, 30, 15), (7, 7, 3, 3), (100, 2, 2, 2), (9, 5, 6, 0), (9, 2, 3, 4)):
        tail = sum(comb(t, i) * comb(n - t, e - i) for i in range(k, min(e, t) + 1)) / comb(n, e)
        assert pii.chance(n, e, t, k) == pytest.approx(tail, rel=1e-9)


# ---------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, t


@pytest.mark.parametrize("partition,length", [(1 << 18, 4096), (500, 64)])
def test_pack(docs, doc_rows, no_docs, tokenizer, partition, length, monkeypatch):
    path, t = tokenizer
    monkeypatch.setattr(packing, "PARTITION", partition)
    got = packing.pack(docs, path, length=length).collect()
    want = Counter()
    for r in doc_rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    # pieces of a document fit together (repeated rows: twice)
    assert Counter({(d, n): c for (d, n, _), c in want.items()}) == Counter(
        (r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    ids_of = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in doc_rows}
    covered = Counter()
    for r in got:
        part = ids_of[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]] += r["length"]
    copies = Counter(r[0] for r in doc_rows)
    assert covered == {d: len(i) * copies[d] for d, i in ids_of.items()}
    # the sequences are gapless and full but for the last
    at = 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * length + r["offset"] == at and r["offset"] + r["length"] <= length
        at += r["length"]
    assert packing.pack(no_docs, path).count() == 0


def test_round_robin_keeps_shares():
    rng = np.random.default_rng(8)
    queues = {s: rng.integers(1, 40, n).tolist() for s, n in (("a", 3000), ("b", 900), (None, 100))}
    total = {s: sum(q) for s, q in queues.items()}
    every = sum(total.values())
    share = {s: x / every for s, x in total.items()}
    order = packing.round_robin(queues, share, {}, 1000, 1000)
    assert sorted((s is None, s or "", i) for s, i in order) == sorted(
        (s is None, s or "", i) for s in queues for i in range(len(queues[s])))
    got, done = Counter(), 0
    for s, i in order:
        got[s] += queues[s][i]
        done += queues[s][i]
        if done < every - 2000:
            for k in queues:
                assert abs(got[k] - share[k] * done) < 1000 + 40
    assert all([i for k, i in order if k == s] == list(range(len(q))) for s, q in queues.items())


def test_word_tokenizer_forgets(tokenizer, monkeypatch):
    path, t = tokenizer
    monkeypatch.setattr(packing, "KNOWN", 50)
    w = packing.WordTokenizer(path)
    for seed in range(3):
        texts = [r[1] or "" for r in make_docs(seed)] + ["it's Ünïcode 3.14 <|endoftext|>   á Σας", ""]
        ids, b = w.encode([x.encode() for x in texts])
        for i, x in enumerate(texts):
            assert ids[b[i]:b[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


# ---------------------------------------------------------------- quality

def test_quality_held_out(spark):
    from seqlake.llm.queries import op8_quality
    got = op8_quality(spark, SF_SMALL).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 15 and np.mean([a == b for a, b in held]) >= 0.9


def test_quality_counts_and_dual(spark):
    texts = ["good words here", "good words there", "bad!! BAD!! bad!!", "BAD!! words!!"]
    f, b = quality.feature_sets([t.encode() for t in texts])
    sets = [f[x:y] for x, y in zip(b[:-1], b[1:])]
    alone = [quality.feature_sets([t.encode()])[0] for t in texts]
    assert all((x == y).all() for x, y in zip(sets, alone))
    y = np.array([1, 1, 0, 0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (2, None)],
                                "doc_id bigint, quality int")
    model = quality.fit(lab, docs)
    counts = np.zeros((2, quality.DIM))
    for s, v in zip(sets, y):
        counts[v, s] += 1
    assert np.allclose(model["ratio"], quality.log_count_ratios(counts))
    # complementary slackness of the hinge loss: separable, so every margin reaches 1
    w = model["weight"]
    for s, v in zip(sets, y):
        x = model["ratio"][s]
        margin = (2 * v - 1) * (w[s] @ x / np.linalg.norm(x) + w[-1])
        assert margin > 0.9


def test_quality_edge_cases(spark, docs, no_docs):
    one = spark.createDataFrame([(1, 0)], "doc_id bigint, quality int")
    scored = quality.score_quality(docs, quality.fit(one, docs)).collect()
    assert len(scored) == docs.count() and all(r["score"] < 0.5 for r in scored)
    none = quality.fit(one.limit(0), no_docs)
    assert quality.score_quality(no_docs, none).count() == 0
    assert all(r["score"] > 0.5 for r in quality.score_quality(docs, none).collect())
