"""Collocations, exact product search and vector codes against brute force, and with odd rows."""

import collections
import glob
import hashlib
import itertools
import os
import re

import duckdb
import numpy as np
import pytest

from codeloom.llm import collocations, inner_product, queries, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_collocations", "op12_dual_tree_products", "op13_yinyang_codes"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(result.fetchall())


# collocations
def brute_phrases(rows, least, longest=5, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    held = {k: c for k, c in f.items() if c >= least}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = []
    for (lang, p), a in held.items():
        if len(p) < 2 or any(g == lang and len(b) > len(p) and c >= a and inside(p, b) for (g, b), c in held.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    ranks = collections.Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield lang, ranks[lang], p.decode(), -a, left, right, total, -score


TEXTS = [("en", "A a a a a. New York, new york; NEW\tYork  city hall\nnew york"), ("en", "new york city hall" * 3), (None, "é🌍 ß é🌍 ß: é🌍 ß"), ("fr", None), ("fr", ""), ("", "x y x y x y"), ("de", "no\xa0break  a  no\xa0break a"), ("und", "é🌍 ß"), ("en", "w " * 5000), ("en", "new york city hall\x85new york")]


@pytest.mark.parametrize("least,words", [(1, 1 << 20), (2, 1 << 20), (3, 40)])
def test_collocations_like_brute_force(spark, monkeypatch, least, words):
    monkeypatch.setattr(collocations, "AUTOMATON_WORDS", words)  # 40: many automata
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in TEXTS * 2], "lang string, text string, phrase string, n int").repartition(5)
    got = collocations.collocations(docs, least=least)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(brute_phrases(TEXTS * 2, least))
    assert [r["rank"] for r in collocations.collocations(docs, least=least, top=2).where("lang = 'en'").orderBy("rank").collect()] == [1, 2]


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", " ,.")], [("en", "one two three")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_sketch_counts_never_too_few(spark, monkeypatch):
    """With hardly any cells all phrases are candidates, and the result is the same."""
    monkeypatch.setattr(collocations, "FEWEST", 12), monkeypatch.setattr(collocations, "MOST", 12)
    rng = np.random.default_rng(0)
    rows = [("en", " ".join(f"w{k}" for k in rng.zipf(1.5, 300) % 500)) for _ in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(docs, least=10)
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, 10)) and got.count() > 20


# exact products
def brute_products(rows, k, every, scale=256):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            v = [int(np.floor(scale * x)) for x in v]
            best[i] = min(best.get(i, v), v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    return sorted((q, n + 1, i, -s) for q in best if q % every == 0 for n, (s, i) in enumerate(sorted((-dot(best[q], v), i) for i, v in best.items() if i != q)[:k]))


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    return (middle[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, dim))).astype(np.float32).tolist()


@pytest.mark.parametrize("cell,block,make", [(512, 4096, clustered), (8, 16, clustered), (8, 16, lambda n, d: np.random.default_rng(2).normal(size=(n, d)).tolist())])
def test_products_like_brute_force(spark, monkeypatch, cell, block, make):
    monkeypatch.setattr(inner_product, "CELL_ROWS", cell), monkeypatch.setattr(inner_product, "BLOCK", block), monkeypatch.setattr(inner_product, "PART", 8)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1050, [nan] * 6), (1100, [inf, *[0.0] * 5]), (1150, [None, *[1.0] * 5]), (1200, [0.0] * 6), (1250, []), (1300, [1.0, -1.0]), (None, [9.0] * 6), (50, [0.5] * 6), (100, [3.0] * 6), (100, [2.0] * 6)]
    copies = [(i, [1.0, 2.0, -1.0, 0.5, 0.25, -3.0]) for i in range(2000, 2400)]  # more than the rest of a cell
    rows = [*enumerate(make(300, 6)), *odd, *copies]
    df = spark.createDataFrame([(i, v, 7, 0) for i, v in rows], "vec_id long, embedding array<float>, v int, cell int").repartition(4)
    got = inner_product.greatest_products(df)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_products(rows, 5, 50)


def test_products_of_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert inner_product.greatest_products(make([])).count() == inner_product.greatest_products(make([(0, [1.0])])).count() == 0
    assert [tuple(r) for r in inner_product.greatest_products(make([(0, [1.0]), (1, [-1.0])])).collect()] == [(0, 1, 1, -65536)]
    with pytest.raises(ValueError, match="63 bits"):
        inner_product.greatest_products(make([(0, [1e30])]))


def test_cover_tree_and_pruning():
    x = np.floor(256 * np.array(clustered(2000, 8)))
    tree = inner_product.CoverTree(x)
    for node in range(len(tree.radius)):
        own = np.sqrt(((x[tree.members[node]] - tree.at[node]) ** 2).sum(axis=1))
        assert own.max() <= tree.radius[node] and all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in tree.below[node])
        assert not tree.below[node] or sorted(itertools.chain.from_iterable(tree.members[c] for c in tree.below[node])) == sorted(tree.members[node])
    q = x[:100]
    best = inner_product.Best(len(q), 5, np.full(len(q), -np.inf))
    done = inner_product.dual_search(inner_product.CoverTree(q), tree, np.arange(len(x)), best, lambda a, b: a @ b.T)
    assert (np.sort(best.score, axis=1) == np.sort(q @ x.T, axis=1)[:, -5:]).all()
    assert done < len(q) * len(x) / 2  # pairs of nodes were pruned


# vector codes
def brute_codes(rows, parts, entries, rounds, scale=4096):
    rows = [(i, g, [int(np.floor(scale * x)) for x in v]) for i, g, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(1, max(len(v) for _, _, v in rows)) // parts)
    rows = sorted([(i, g, v + [0] * (width * parts - len(v))) for i, g, v in rows], key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in rows]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(book[p])), key=lambda e: (far(c[p], book[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if mine:
                    book[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = nearest()
    errors = [sum(far(c[p], book[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at, strict=True)]
    by = collections.Counter()
    for (_, g, _), e in zip(rows, errors, strict=True):
        by[g] += e
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), bytes(a).hex(), e, by[g], digest) for (i, g, _), a, e in zip(rows, at, errors, strict=True))


@pytest.mark.parametrize("parts,entries,rounds", [(8, 16, 6), (2, 5, 3), (3, 40, 6)])
def test_codes_like_brute_force(spark, parts, entries, rounds):
    nan = float("nan")
    odd = [(None, 1, [1.0] * 16), (7, None, [1.0] * 16), (7, None, [1.0] * 16), (7, 2, [-1.0] * 16), (500, None, None), (501, 1, [nan] * 16), (502, 1, [None] * 16), (503, 1, [0.5]), (504, 3, [])]
    rows = [*((i + 10, i % 4, v) for i, v in enumerate(clustered(250, 16))), *((i, 9, [0.25] * 16) for i in range(1000, 1150)), *odd]
    df = spark.createDataFrame([(i, g, v, 0, "z") for i, g, v in rows], "vec_id long, label int, embedding array<float>, error int, entry string").repartition(6)
    got = vector_codes.vector_codes(df, parts, entries, rounds)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == brute_codes(rows, parts, entries, rounds)


def test_codes_of_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert vector_codes.vector_codes(make([])).count() == vector_codes.vector_codes(make([(1, 1, None)])).count() == 0
    (only,) = vector_codes.vector_codes(make([(1, 1, [0.5] * 8)])).collect()
    assert (only.code, only.error, only.label_error) == ("00" * 8, 0, 0)
    with pytest.raises(ValueError, match="63 bits"):
        vector_codes.vector_codes(make([(1, 1, [1e9] * 8)]))


def test_yinyang_bounds_spare_work():
    x = np.floor(4096 * np.array(clustered(3000, 16))).astype(np.int64).reshape(3000, 4, 4)
    book = x[:16].transpose(1, 0, 2).copy()
    group, now, drift, work = vector_codes.grouped(book), vector_codes.Bounds(3000, 4, vector_codes.GROUPS), None, []
    for _ in range(6):
        work.append(vector_codes.assign(x, book, group, now, drift))
        want = np.stack([((x[:, p, None] - book[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(4)], axis=1)
        assert (now.entry == want).all()
        was = book.copy()
        for p, e in itertools.product(range(4), range(16)):
            if (mine := x[now.entry[:, p] == e, p]).size:
                book[p, e] = mine.sum(axis=0) // len(mine)
        drift = np.sqrt(((book - was).astype(float) ** 2).sum(axis=2)) * (1 + vector_codes.LOOSE)
    assert work[-1] < work[0] / 4


def test_collocations_scan_as_often_for_many_phrases(spark, monkeypatch):
    """The phrases that are counted do not tell how often the texts are read."""
    rows = [("en" if k % 3 else None, " ".join(f"w{j % 50}" for j in range(k, k + 200))) for k in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    jobs, got = [], []
    for words in (1 << 20, 40):
        monkeypatch.setattr(collocations, "AUTOMATON_WORDS", words)
        spark.sparkContext.setJobGroup(f"phrases-{words}", "")
        counts, totals = collocations.phrase_counts(docs, least=10)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"phrases-{words}")))
        got.append((sorted(map(tuple, counts.collect())), sorted(map(tuple, totals.collect()))))
    assert got[0] == got[1] and len(got[0][0]) > 400 and jobs[0] == jobs[1]
