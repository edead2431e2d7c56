"""Small tables with copies, near copies, nulls, empty texts, ties and clashing columns."""

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "Re", "ti") for b in ("", "ra", "sol", "été", "x,", "99")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.7 else "") for _ in range(n))


def mutate(rng, text, rate):
    return "".join(w if w.isspace() or rng.random() > rate else sentence(rng, 1)
                   for w in __import__("re").split(r"(\s)", text) if w)


def make_docs(seed=5, families=14):
    rng = random.Random(seed)
    shared = [sentence(rng, rng.randint(3, 30)) for _ in range(6)]
    rows = []
    for f in range(families):
        base = "\n".join(sentence(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 5)))
        for c in range(rng.choice([1, 1, 3, 8])):
            text = mutate(rng, base, rng.choice([0, 0, 0.01, 0.03, 0.06, 0.1, 0.2]))
            if rng.random() < 0.4:
                text += "\n" + mutate(rng, rng.choice(shared), rng.choice([0, 0, 0.05, 0.1]))
            rows.append([0, text, "en", f"src{min(f // 3, 2)}"])
    rows += [[0, t, "en", s] for t, s in [
        (None, "src0"), ("", "src0"), (" \n\t\n", None), ("one", "src1"), ("ONE", "src1"),
        ("one two", None), ("a b c", "src2"), ("A  b\nC", "src2"), ("  x", "src2"),
        ("word " * 3000, "src9"), ("x" * 5000, "src9"), ("a\rb\x0bc", "src9")]]
    rng.shuffle(rows)
    out = [(3 * i + 1, *r[1:], i % 7, float(i), "clash", "k") for i, r in enumerate(rows)]
    out.append(out[3])                                     # a repeated row
    return out


DOC_SCHEMA = ("doc_id bigint, text string, lang string, source string, n int, size double, _key string, "
              "_maybe string")


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def union_find(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
