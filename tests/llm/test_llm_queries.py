"""The registered queries over whole test tables, against SQL for the columns it can express, brute force, or held-out rows."""

import collections
import itertools
import os

import duckdb
import numpy as np
import pytest

from codeloom.llm import queries
from test_jaccard_join import brute

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MID), reason="no test tables")


def sql(text, folder):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con.execute(text).fetchall()


def test_op1_samples(spark):
    got = collections.defaultdict(list)
    for r in queries.op1_sentencepiece_sampling(spark, SMALL).collect():
        got[r.doc_id].append(r)
    assert set(got) == {i for (i,) in sql("SELECT doc_id FROM documents", SMALL)}
    for rows in got.values():
        rows.sort(key=lambda r: r["sample"])
        assert rows[0].decoded and all(r.decoded is None for r in rows[1:])
        assert all(a.perturbed >= b.perturbed for a, b in itertools.pairwise(rows)) and all(0 <= r.inclusion <= 1 for r in rows)  # 0 where it is too small for a double
        assert len(rows) == 4 or rows[0].inclusion == 1


def test_op3_edited_texts(spark):
    want = sql("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS n, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS f FROM documents)
      SELECT doc_id, length(t), sha256(left(t, length(t) - length(t) // 2) || left(coalesce(n, f), length(t) // 2)) FROM d""", SMALL)
    got = queries.op3_one_permutation_minhash(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    same = collections.defaultdict(set)
    for (text,), r in zip(sql("SELECT coalesce(text, '') FROM documents ORDER BY doc_id", SMALL), sorted(got, key=lambda r: r.doc_id), strict=True):
        same[text].add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_op6_base_counts(spark):
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN k % 2 = 1 THEN d[-k]::INT ELSE (d[-k]::INT * 2) // 10 + (d[-k]::INT * 2) % 10 END)) % 10 = 0"
    want = sql(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      c AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')), '[^0-9]', '', 'g') AS d FROM t),
      n AS (SELECT doc_id, count(*) AS n_card FROM c WHERE length(d) BETWEEN 14 AND 19 AND {luhn} GROUP BY 1)
      SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')),
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: TRY_CAST(p AS DOUBLE))) <= 255)), coalesce(n_card, 0),
        len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) FROM t LEFT JOIN n USING (doc_id)""", MID)
    got = queries.op6_disclosure_control(spark, MID).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == sorted(want)
    assert sum(r.n_email for r in got) and sum(r.n_card for r in got)


def test_op7_sequences(spark):
    got = queries.op7_best_fit_packing(spark, SMALL).collect()
    by, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert set(pieces) == {i for (i,) in sql("SELECT doc_id FROM documents", SMALL)}
    for parts in pieces.values():
        assert [p[0] for p in sorted(parts)] == list(range(len(parts))) and all(n == 4096 for _, _, n in sorted(parts)[:-1])
    assert len(by) == -(-sum(r.length for r in got) // 4096)


def test_op8_links(spark):
    rows = sql("SELECT doc_id, text FROM documents", MID)
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in queries.op8_ngram_jaccard_join(spark, MID).collect()}
    want = brute(rows)
    assert set(got) == set(want) and sum(got[i] != want[i] for i in want) <= 0.005 * len(want)


def test_op9_recall(spark):
    rows = sql("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL", MID)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = collections.defaultdict(list)
    for r in queries.op9_projected_neighbours(spark, MID).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert all(abs(s - d[ids == v][0]) < 1e-9 for _, v, s in got[q])
        hits += len({v for _, v, _ in got[q]} & set(ids[best].tolist()))
    assert hits >= 0.9 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()


def test_op5_held_out(spark):
    lang = dict(sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL", MID))
    held = [r for r in queries.op5_language_id(spark, MID).collect() if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


@pytest.mark.parametrize("name,label", [("op4_attention_quality", "quality"), ("op10_factorization_toxicity", "toxic")])
def test_held_out_labels(spark, name, label):
    want = dict(sql(f"SELECT doc_id, max({label}) FROM labels WHERE {label} IS NOT NULL GROUP BY 1", MID))
    held = [r for r in queries.QUERIES[name](spark, MID).collect() if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.9
