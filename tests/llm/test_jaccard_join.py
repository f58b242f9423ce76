import glob
import random

from codeloom.llm.jaccard_join import banding, first_of_each_class, jaccard_join

SCHEMA = "doc_id long, text string, class_id string, copies int"


def brute(rows, threshold=0.8, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = frozenset(" ".join(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
    links = {i: {j for j in sets if j != i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]))} for i in sets}
    label = {}
    for i in sorted(sets):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += links[x]
    return {i: (label[i], min(j for j in sets if sets[j] == sets[i]), len(links[i])) for i in sets}


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.randrange(3, 160))]
        for _ in range(r.randrange(1, 8)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    base = [word() for _ in range(300)]
    for k in range(700):  # one large group of different texts: more than a block holds
        w = list(base)
        w[k % 300] = f"x{k}"
        rows.append((n, " ".join(w)))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one two"), (n + 4, "one  two"), (n + 5, "long " * 40000)]


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in jaccard_join(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    wrong = [i for i in want if want[i] != (got[i].class_id, got[i].copy_id, got[i].n_links)]
    assert len(wrong) <= 0.01 * len(want), wrong[:5]


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "x", 1)] * 2 + [(2, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (2, "q r s t u v w", "x", 1), (None, "only without id", "x", 1)]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (2, 1, 3), (None, 1, 3), (2, 2, 0), (None, None, 0)], key=str)
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_class_stays(spark):
    """No unique text goes because its doc_id bears a copied text too."""
    schema = "doc_id long, text string, text_key string, row_id int, label string"
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v w"), (None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], schema)
    got = first_of_each_class(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d e f"), (2, "q r s t u v w"), (None, "g h i j k l"), (3, None)], key=str)
    assert first_of_each_class(docs.limit(0)).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = banding(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995
    assert bands * rows <= 256
