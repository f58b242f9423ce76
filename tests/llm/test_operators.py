import collections
import functools
import hashlib
import itertools
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import chat, fingerprint, language, neighbours, packing, private_data, quality, queries, segmentation, toxicity
from codeloom.llm._shared import WordHashes, shingles
from codeloom.llm.chat import chat_format, read_turns

SCHEMA = "doc_id long, text string, score double, length int, n long"  # with clashing names
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in rows], SCHEMA)


ODD = [(900, None), (901, ""), (902, " \n"), (903, "x"), (903, "x"), (904, "word " * 30000), (905, "é🌍ß"), (None, "no id at all")]


# segmentation
def brute_segmentations(lattice, text):
    (words,) = lattice.words([text])

    def paths(s):
        if s < 0:
            yield (), 0.0
            return
        for a in range(lattice.first[s], lattice.first[s + 1]):
            for rest, lp in paths(int(lattice.next[a])):
                yield (a, *rest), lp + lattice.logp[a]

    out = collections.Counter()
    for combo in itertools.product(*[list(paths(int(s))) for s in words]):
        arcs = np.array(sum((c[0] for c in combo), ()))
        out[tuple(lattice.piece_ids(arcs, np.array([0]))[0].tolist())] += np.exp(sum(c[1] for c in combo))
    return out


def test_segmentation_samples_follow_the_lattice():
    lattice, text, n = segmentation.Lattice(sharpness=0.15), "the Zé\nab 🌍", 4000
    want = brute_segmentations(lattice, text)
    assert abs(sum(want.values()) - 1) < 1e-6
    first, second, weighed = collections.Counter(), collections.Counter(), collections.Counter()
    for got in segmentation.sample_batch(lattice, [text] * n, [segmentation._key(r, "", 7) for r in range(n)], 3):
        ids = [tuple(g[0].tolist()) for g in got]
        assert len(set(ids)) == 3 and all(a[2] >= b[2] for a, b in itertools.pairwise(got))
        first[ids[0]] += 1 / n
        second[ids[1]] += 1 / n
        for i, g in zip(ids, got, strict=True):
            assert abs(np.log(want[i]) - g[1]) < 1e-6
            weighed[i] += want[i] / g[3] / n
    for i, p in want.most_common(5):
        assert abs(first[i] - p) < 0.03
        assert abs(second[i] - sum(q * p / (1 - q) for j, q in want.items() if j != i)) < 0.03
        assert abs(weighed[i] - p) < 0.03
    (every,) = segmentation.sample_batch(lattice, [text], [3], 1000)
    assert {tuple(g[0].tolist()) for g in every} == set(want) and every[0][3] == 1.0


def test_segmentation_rows(spark):
    docs = frame(spark, [*ODD, (1, "Hello  world\n\ttabs")])
    got = segmentation.sample_segmentations(docs, k=3)
    texts = collections.Counter((r.doc_id, r.text) for r in segmentation.decode(got).collect())
    want = {(i, t or "") for i, t in [*ODD, (1, "Hello  world\n\ttabs")]}
    assert set(texts) == want and texts[(900, "")] == 1 and texts[(1, "Hello  world\n\ttabs")] == 3
    once = {(r.doc_id, r["sample"], r.perturbed) for r in got.collect()}
    assert once == {(r.doc_id, r["sample"], r.perturbed) for r in segmentation.sample_segmentations(docs.repartition(5), k=3).collect()}
    assert {r.text for r in segmentation.decode(segmentation.encode(docs)).collect()} == {t for _, t in want}
    assert segmentation.sample_segmentations(frame(spark, [])).count() == 0


# chat
def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi </turn>\n### assistant:\nx"), (1, 1, "assistant", "a\\b \\e"), (1, 2, "assistant", "</part>more"), (1, 3, "we:ird\n", ""), (2, None, None, None),
            (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "assistant", "no conversation")] + [(4, k, "assistant" if k % 3 else "user", f"t{k}") for k in range(150)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format(table).withColumn("turns", read_turns(F.col("formatted"))).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        masked = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans]
        for plain, coded in (("</part>", "\\p"), ("</turn>", "\\t"), ("###", "\\h"), ("\\", "\\e")):
            masked = [m.replace(coded, plain) for m in masked]
        assert masked == [t for role, t in turns if role == "assistant"]
    assert got[4].formatted.count("### ") == 100  # adjacent turns share a header
    assert chat_format(table.limit(0)).count() == 0


# fingerprints
def test_chat_query_reads_the_loss_mask(spark, tmp_path, monkeypatch):
    turns = [(1, 0, "user", "ask"), (1, 1, "assistant", "a ### b"), (1, 2, "assistant", "🌍</turn>"), (2, 0, "user", "only")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda: {x.conv_id: (x.loss_chars, x.loss_sha256) for x in queries.op2_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: (len(s), hashlib.sha256(s.encode()).hexdigest())
    got = run()
    assert got[1] == sha("a ### b🌍</turn>") and got[2] == sha("")
    monkeypatch.setattr(chat, "chat_format", lambda rows: chat_format(rows, "user"))  # a wrong mask shows
    got = run()
    assert got[1] == sha("ask") and got[2] == sha("only")


def test_chat_of_long_texts_and_many_equal_rows(spark):
    long = "é### </turn>\\ " * 20000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 5, "assistant", "hi")] + [(3, 0, "assistant", "same")] * 5000 + [(4, 0, "assistant" if k % 2 else "user", f"t{k % 700}") for k in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat_format(table).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows):
        want[c].append((role, text))
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(t for role, t in turns if role == "assistant")
        assert len(got[c].loss_spans) == sum(role == "assistant" for role, _ in turns)


def test_fingerprints(spark):
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice([f"w{k}" for k in range(5000)], 400)) for _ in range(12)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(100, texts[0]), *ODD]
    got = {x.doc_id: x for x in fingerprint.fingerprints(frame(spark, rows)).collect()}
    order = sorted({(i, t or "") for i, t in rows if i is not None}, reverse=True)
    cache = WordHashes()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert got[i].n_chars == len(t)
        if i != 903:  # a repeated row follows itself
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b = set(shingles(t, cache).tolist()), set(shingles(edited, cache).tolist())
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got[i].near_edited - true) < 0.08
    assert got[100].fingerprint == got[0].fingerprint and got[900].fingerprint == ""
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        if i != 903 and got[i].fingerprint:  # what near_next estimates, by sets
            a, b = set(shingles(t, cache).tolist()), set(shingles(u, cache).tolist())
            assert abs(got[i].near_next - (len(a & b) / len(a | b))) < 0.08
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    (one,) = fingerprint.fingerprints(frame(spark, [(5, "a b c d e f g")])).collect()
    assert one.near_next == 1.0


# classifiers
def corpus(spark, n=240):
    r = np.random.default_rng(2)
    words = {"en": ["the", "and", "thing", "with", "house", "night"], "de": ["der", "und", "nicht", "haus", "schön", "über"]}
    docs, labels = [], []
    for k in range(n):
        lang = "en" if k % 2 else "de"
        w = list(r.choice(words[lang], 80))
        toxic, junk = k % 3 == 0, k % 5 == 0
        if toxic:
            w[int(r.integers(0, 80))] = "scum"
        if junk:
            w = [x + "###" for x in w]
        docs.append((k, " ".join(w), lang))
        labels.append((k, int(not junk), int(toxic)))
    docs += [(i, t, None) for i, t in ODD]
    return spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lang string, predicted int"), spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (3000, None, None)], LABELS)


@pytest.mark.parametrize("module,label,fold", [(quality, "quality", (3, 1)), (toxicity, "toxic", (5, 0))])
def test_classifiers(spark, module, label, fold):
    docs, labels = corpus(spark)
    run = getattr(module, module.__name__.rsplit(".", 1)[1])
    got = run(docs, module.learn(docs, labels)).collect()
    assert len(got) == docs.count()
    want = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % fold[0] == fold[1])
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    empty = module.learn(docs.limit(0), labels.limit(0))
    assert run(docs.limit(0), empty).count() == 0 and run(docs, empty).count() == docs.count()


def test_language(spark):
    docs, _ = corpus(spark)
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.language(docs, model).collect()}
    for k in range(240):
        assert got[k].lang_pred == ("en" if k % 2 else "de")
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].rejected
    assert got[905].lang_pred in ("en", "de")
    assert language.language(docs.limit(0), language.learn(docs.limit(0))).count() == 0
    assert {r.doc_id for r in language.recognised(docs, model).collect()} >= set(range(240))


def test_language_learns_whole_texts():
    """Every word counts, and every letter of it, wherever it stands."""
    letters = lambda n: ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(n)]
    found = [*letters(3000), "x" * 400 + "end", "x" * 400 + "odd"]
    batch = pa.record_batch([pa.array(["x"]), pa.array([5], pa.int64()), pa.array([" ".join(found)])], names=["lang", "key", "text"])
    (out,) = language._features(iter([batch]))
    want = collections.Counter(b for w in found for b in language.subwords(w))
    got = dict(zip(np.frombuffer(out["rows"][0].as_py(), "<u2").tolist(), np.frombuffer(out["counts"][0].as_py(), "<u4").tolist(), strict=True))
    assert got == want
    assert language.subwords(found[-1]) != language.subwords(found[-2])


def test_language_gradients():
    """Gradients by finite differences."""
    r = np.random.default_rng(7)
    emb, lin, bias = r.normal(size=(12, 3)), r.normal(size=(3, 4)), r.normal(size=4)
    rows = [np.array([0, 3, 5]), np.array([3, 11])]
    shares, ys = [np.array([0.5, 0.25, 0.25]), np.array([0.1, 0.9])], np.array([2, 0])
    loss = lambda: language.gradients(emb, lin, bias, rows, shares, ys)[0]
    _, g_emb, g_lin, g_bias = language.gradients(emb, lin, bias, rows, shares, ys)
    full = np.zeros_like(emb)
    for at, share, g in g_emb:
        full[at] += share[:, None] * g
    for p, g in ((emb, full), (lin, g_lin), (bias, g_bias)):
        assert np.allclose(g, by_differences(p, loss), atol=1e-6)


def by_differences(p, loss, step=1e-6):
    out = np.zeros_like(p)
    for at in np.ndindex(*p.shape):
        was = p[at]
        p[at] = was + step
        up = loss()
        p[at] = was - step
        out[at] = (up - loss()) / (2 * step)
        p[at] = was
    return out


def test_language_scores_like_brute_force(spark):
    docs, _ = corpus(spark)
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.language(docs, model).collect()}
    for r in docs.where("doc_id is not null").collect():
        b = [x for w in language.words(r.text) for x in language.subwords(w)]
        if not b:
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        p = model.probabilities(model.table[b].astype(float).sum(axis=0) / len(b) + model.bias)
        assert got[r.doc_id].lang_pred == model.langs[int(p.argmax())] and abs(got[r.doc_id].score - p.max()) < 1e-6


def test_language_sample_takes_the_least_hashes(spark, monkeypatch):
    """Of a common language exactly the first by hash, of a rare one all."""
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = [(k, f"wort{name(k)}", "de") for k in range(600)] + [(1000 + k, f"word{name(k)}", "en") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "fit", lambda bags, langs: seen.append(collections.Counter(langs)) or (bags, langs))
    bags, langs = language.learn(docs, keep=F.lit(True), per_lang=50)
    first = [r.text for r in docs.where("lang = 'de'").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(50).collect()]
    assert seen == [{"de": 100, "en": 18}]
    want = {tuple(sorted(set(b for w in language.words(t) for b in language.subwords(w)))) for t in first}
    assert {tuple(b[0].tolist()) for b, lang in zip(bags, langs, strict=True) if lang == "de"} == want


def test_quality_gradients():
    """Gradients by finite differences."""
    r = np.random.default_rng(3)
    model = quality.Model(wide=5, hidden=4, gate=3)
    x, sizes, y = r.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    l2 = 0.01

    def loss():
        p = model.forward(x, sizes)[0]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + l2 / 2 * sum((w * w).sum() for w in model.p if w.ndim == 2))

    for p, g in zip(model.p, model.gradients(x, sizes, y, l2), strict=True):
        assert np.allclose(g, by_differences(p, loss), atol=1e-6)


def test_quality_scores_like_brute_force(spark):
    """Passages, attention and score of every whole text by plain loops."""
    docs, labels = corpus(spark)
    model = quality.learn(docs, labels)
    enc, b1, v, u, w, c, b = model.p
    got = {r.doc_id: r.score for r in quality.quality(docs, model).collect() if r.doc_id is not None}
    for r in docs.where("doc_id is not null and doc_id % 7 = 0 or doc_id >= 900").collect():
        x = quality.passages(r.text, WordHashes())
        assert len(x) == max(1, -(-len((r.text or "").split()) // quality.PASSAGE))
        h = [np.tanh(np.clip((row - model.mean) / model.scale, -6, 6) @ enc + b1) for row in x.astype(float)]
        e = [float((np.tanh(z @ v) / (1 + np.exp(-(z @ u)))) @ w) for z in h]
        a = np.exp(np.array(e) - max(e)) / np.exp(np.array(e) - max(e)).sum()
        want = 1 / (1 + np.exp(-(sum(k * z for k, z in zip(a, h, strict=True)) @ c + b[0])))
        assert abs(got[r.doc_id] - want) < 1e-5


def test_quality_learns_from_every_passage(spark):
    """What marks a text may stand in any of its passages."""
    r = np.random.default_rng(6)
    docs, labels = [], []
    for k in range(160):
        w = [str(x) for x in r.choice(["plain", "words", "of", "prose"], 64 * 60)]
        if k % 2:
            at = 64 * int(r.integers(0, 60))
            w[at : at + 64] = ["@@@###"] * 64
        docs.append((k, " ".join(w)))
        labels.append((k, 1 - k % 2, 0))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame(labels, LABELS))
    held = [x for x in quality.quality(docs, model).collect() if x.held_out]
    assert np.mean([x.predicted == 1 - x.doc_id % 2 for x in held]) > 0.95


def test_toxicity_gradients():
    """Gradients by finite differences of the loss by its definition."""
    r = np.random.default_rng(4)
    bias, w, v = np.array([0.3]), r.normal(size=4), r.normal(size=(4, 3))
    bags, y = [[0, 2], [1], [0, 1, 3], []], np.array([1.0, 0.0, 1.0, 0.0])
    row, col = np.repeat(np.arange(4), [len(b) for b in bags]), np.array(sum(bags, []))

    def loss():
        z = [bias[0] + sum(w[i] for i in b) + sum(v[i] @ v[j] for i, j in itertools.combinations(b, 2)) for b in bags]
        return float(np.mean([np.log1p(np.exp(x)) - t * x for x, t in zip(z, y, strict=True)]))

    gb, gw, gv = toxicity.gradients(bias[0], w, v, row, col, y)
    for p, g in ((bias, np.array([gb])), (w, gw), (v, gv)):
        assert np.allclose(g, by_differences(p, loss), atol=1e-6)


def test_pairs_of_terms_take_little_more_memory_than_their_table():
    import tracemalloc

    r, m, n = np.random.default_rng(2), 5000, 5000
    y, row, col = (r.random(n) < 0.5).astype(float), np.sort(r.integers(0, n, 100_000)), r.integers(0, m, 100_000)
    tracemalloc.start()
    toxicity.in_pairs(y, row, col, m, np.zeros(m), 1e9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * m * n


def test_toxicity_learns_pairs_that_no_term_tells(spark):
    """Labels decided by a pair alone: neither term has to do with the label by itself."""
    r = np.random.default_rng(8)
    docs, labels = [], []
    for k in range(2500):
        w = [f"w{x}" for x in r.integers(0, 300, 30)]
        a, b = r.integers(0, 2, 2)
        w += ["dolt"] * int(a) + ["folk"] * int(b)
        r.shuffle(w)
        docs.append((k, " ".join(w)))
        labels.append((k, 0, int(a == b)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, LABELS))
    got = toxicity.toxicity(docs, model).collect()
    assert np.mean([x.predicted == labels[x.doc_id][2] for x in got if x.held_out]) > 0.95
    index = {int(k): n for n, k in enumerate(model.keys)}
    for x in got[:50]:  # the score by its definition
        hit = sorted({index[h] for h in (int(np.uint64(WordHashes()[t]).view(np.int64)) for t in toxicity.terms(docs_text(docs, x.doc_id))) if h in index})
        z = model.bias + sum(model.weights[i] for i in hit) + sum(model.factors[i] @ model.factors[j] for i, j in itertools.combinations(hit, 2))
        assert abs(x.score - 1 / (1 + np.exp(-z))) < 1e-9


@functools.cache
def _texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def docs_text(docs, i):
    return _texts(docs)[i]


def test_toxic_copy_of_a_clean_text_counts(spark):
    """Texts that share their runs of words but for one insult are all learned from."""
    common = " ".join(f"w{k}" for k in range(40))
    docs = [(k, f"{common} {'scum' if k % 2 else 'fine'} n{k}") for k in range(200)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, 0, k % 2) for k in range(200)], LABELS)
    got = toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()
    assert all(x.predicted == x.doc_id % 2 for x in got)


def test_repeated_doc_ids_teach_once(spark):
    docs, labels = corpus(spark)
    twice = docs.unionByName(docs.where("doc_id < 100"))
    for module in (quality, toxicity):
        a, b = (module.learn(d, labels) for d in (docs, twice))
        run = getattr(module, module.__name__.rsplit(".", 1)[1])
        assert sorted(x.score for x in run(docs, a).collect()) == sorted(x.score for x in run(docs, b).collect())


# personal data
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = [lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")), lambda m: 14 <= len(digits(m)) <= 19 and private_data.luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if good[k](m))


def test_base_spans_like_the_patterns():
    r = np.random.default_rng(6)
    for _ in range(4000):
        t = "".join(r.choice(list("ab@@..+- 0123455(9é\n%"), int(r.integers(0, 40))))
        assert private_data.base_spans(t) == brute_spans(t), t
    card = "4111 1111 1111 1111 and +1 (555) 010-9999 at 10.0.0.256, 10.0.0.25"
    assert [s[1] for s in private_data.base_spans(card)] == [2, 3, 1]
    assert private_data.base_spans("a" * 300000 + "1" * 300000) == []


def test_disclosing_terms(spark):
    r = np.random.default_rng(4)
    common = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmn"]
    text = lambda n: " ".join(r.choice(common, n))
    rows = [(k, f"{text(5)} zebra jo@x.org {text(5)}") for k in range(8)] + [(k, text(30)) for k in range(8, 120)]
    rows += [(k, f"copied words unlike any other ann@y.org {'same'}") for k in range(120, 140)] + ODD
    got = {x.doc_id: x for x in private_data.spans(frame(spark, rows)).collect()}
    for i, t in rows:
        base = brute_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(private_data.joined(base).encode()).hexdigest()
        assert got[i].n_email == sum(k == 0 for _, k, _ in base)
    for k in range(8):
        at = rows[k][1].index("zebra")
        assert f"term:{at}:{at + 5}" in got[k].spans.split(",")
    assert "term" not in got[125].spans  # copies of one text are no evidence
    assert got[60].spans == "" and got[900].spans == ""
    clean = {x.doc_id: x.text for x in private_data.sanitise(frame(spark, rows)).collect()}
    assert "zebra" not in clean[0] and "<EMAIL>" in clean[0] and clean[60] == rows[60][1] and clean[900] is None
    assert len(clean) == len({i for i, _ in rows}) and private_data.spans(frame(spark, [])).count() == 0


def test_terms_of_rare_entities(spark):
    r = np.random.default_rng(3)
    common = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmn"]
    text = lambda n: " ".join(r.choice(common, n))
    rows = [(0, f"{text(5)} okapi una@x.org {text(5)}"), (1, f"{text(5)} quagga bis@x.org {text(5)}"), (2, f"{text(5)} quagga bis@x.org {text(5)}")]
    rows += [(k, f"{text(20)} walrus") for k in range(3, 6)] + [(6, f"{text(5)} walrus ter@x.org {text(5)}")] + [(k, text(30)) for k in range(7, 1500)]
    got = {x.doc_id: x.spans.split(",") for x in private_data.spans(frame(spark, rows)).collect()}
    for k, w in ((0, "okapi"), (1, "quagga"), (2, "quagga")):
        at = rows[k][1].index(w)
        assert [s for s in got[k] if s.startswith("term")] == [f"term:{at}:{at + len(w)}"]
    assert not any(s.startswith("term") for s in got[6])  # one of four texts with it is weak evidence
    assert not any(s.startswith("term") for k in range(7, 1500) for s in got[k])


def test_terms_far_from_their_entity(spark):
    r = np.random.default_rng(2)
    common = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmn"]
    text = lambda n: " ".join(r.choice(common, n))
    rows = [(k, f"okapi {text(300)} una@x.org and 1.2.3.4 {text(300)} Okapi") for k in range(8)] + [(8, f"{text(9)} okapi {text(9)}")] + [(k, text(30)) for k in range(9, 1500)]
    got = {x.doc_id: x.spans.split(",") for x in private_data.spans(frame(spark, rows)).collect()}
    for k in range(9):
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)okapi", rows[k][1])]
        assert [s for s in got[k] if s.startswith("term") and rows[k][1][int(s.split(":")[1]) :][:3] != "and"] == want
    clean = {x.doc_id: x.text for x in private_data.sanitise(frame(spark, rows)).collect()}
    assert all("okapi" not in clean[k].lower() and clean[k].count("<TERM>") == (2 if k < 8 else 1) for k in range(9))


def test_sanitise_without_doc_id(spark):
    rows = [(None, "write to me@x.org or 10.0.0.1"), (None, "nothing here"), (None, None), (1, "write to me@x.org")]
    clean = sorted(((x.doc_id, x.text) for x in private_data.sanitise(frame(spark, rows)).collect()), key=str)
    assert clean == sorted([(None, "write to <EMAIL> or <IP>"), (None, "nothing here"), (None, None), (1, "write to <EMAIL>")], key=str)


def test_sanitise_with_clashing_names_and_repeats(spark):
    names = ["doc_id", "text", "found", "base", "added", "hidden_id", "Hidden_Spans", "text_key"]
    rows = [(k, f"plain words only number{k}", *["x"] * 6) for k in (1, 1, 2)] + [(1, "mail a@x.org", *["y"] * 6)] * 2
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = private_data.sanitise(docs)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], r[1].replace("a@x.org", "<EMAIL>"), *r[2:]) for r in rows)


def test_repeated_texts_count_once(spark):
    """What counts as a copy does not depend on whether texts share a slot of the map."""
    rows = [(k, f"alpha beta okapi x{k % 3}@y.org") for k in range(9)] + [(k, f"plain {k}") for k in range(9, 400)]
    one = sorted(tuple(r) for r in private_data.spans(frame(spark, rows)).collect())
    slots = private_data.SLOTS
    try:
        private_data.SLOTS = 64  # nearly all texts share one; on the driver and, by the closures, in tasks that see the module anew
        found = private_data._slots(spark.createDataFrame([(k,) for k in range(64)], "h long"))
        assert private_data._map(found).all() and len(private_data._map(found)) == 64
    finally:
        private_data.SLOTS = slots
    assert one == sorted(tuple(r) for r in private_data.spans(frame(spark, rows).repartition(7)).collect())


# packing
def test_packing_with_another_vocabulary(spark):
    """A vocabulary that minds case, and keeps spaces in its pieces, is encoded text by text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.stands_alone(packing.default_vocabulary()) and not packing.stands_alone(path)
    rows = [(1, "Hello World, again"), (2, "hello  world\n"), (3, None), (4, "word " * 9000)]
    tokenizer = packing.Encoder(path).tokenizer
    got = sorted((x.doc_id, x.piece, x.length, x.ids_crc32) for x in packing.pack(frame(spark, rows), vocabulary=path).collect())
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, len(ids[at : at + 4096]), crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert got == sorted(want)


def test_packing(spark):
    r = np.random.default_rng(5)
    rows = [(k, " ".join(r.choice(["alpha", "Beta!", "<|endoftext|>", "ünïcode", "1234"], int(r.integers(0, 700))))) for k in range(120)] + [(200, "deep " * 9000), *ODD]
    got = packing.pack(frame(spark, rows)).collect()
    tokenizer = packing.Encoder(packing.default_vocabulary()).tokenizer
    pieces = collections.Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            pieces[(i, k, at, len(part), crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == pieces
    by = collections.defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= 1 + -(-sum(x.length for x in got) // 4096)
    assert packing.pack(frame(spark, [])).count() == 0


def test_ranges_carry_what_they_leave_over():
    """Sweeps of ranges and their moves pair what one stack over all of them pairs."""
    r = np.random.default_rng(8)
    for _ in range(50):
        rows = [(k, int(kind)) for k, kind in enumerate(r.random(60) < r.uniform(0.2, 0.8))]  # from great to small; 1 is a piece
        stack, want = [], set()
        for k, kind in rows:
            if kind == 0:
                stack.append(k)
            elif stack:
                want.add((k, stack.pop()))
        cuts = [0, *sorted(r.integers(0, 61, 6).tolist()), 60]
        got, pieces, slots = set(), {}, {}
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            here, alone = [], []
            for k, kind in rows[lo:hi]:
                if kind == 0:
                    here.append(k)
                elif here:
                    got.add((k, here.pop()))
                else:
                    alone.append(k)
            pieces[part], slots[part] = alone, here
        numbers = []
        for part, low, of, high, n, number in packing.carried([(p, len(pieces[p]), len(slots[p])) for p in pieces]):
            got |= {(pieces[part][low + j], slots[of][high - j]) for j in range(n)}
            numbers += range(number, number + n)
        assert got == want and numbers == list(range(len(numbers)))


def _best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("lengths", [
    np.random.default_rng(8).integers(1, 101, 600).tolist(),
    [*np.random.default_rng(9).integers(1, 101, 200).tolist(), *[1] * 2000],  # one very common length
    [30] * 500,
    [100] * 7 + [51] * 3 + [50] * 3,
    [],
])
def test_rounds_come_near_best_fit_decreasing(spark, monkeypatch, lengths):
    monkeypatch.setattr(packing, "SWEPT", 100)  # several ranges
    pieces = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    placed = packing._placed(pieces, 100).collect()
    assert sorted(x.id for x in placed) == [k for k, n in enumerate(lengths) if n <= 50]
    by = collections.defaultdict(list, {k: [(0, n)] for k, n in enumerate(lengths) if n > 50})
    for x in placed:
        by[x.sequence_id].append((x.offset, lengths[x.id]))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100
    assert len(by) <= 1.01 * _best_fit_decreasing(lengths, 100)


@pytest.mark.parametrize("seed", range(5))
def test_packing_by_number_is_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, [2, 9, 60, 101, 101][seed], 500).tolist()
    places, numbered = collections.defaultdict(list), collections.Counter()
    for length, rank, n, sequence, each, offset in packing.moves_of(collections.Counter(lengths), 100):
        assert rank == numbered[length]
        numbered[length] += n
        for k in range(n):
            places[sequence + k // each].append((offset + k % each * length, length))
    assert numbered == collections.Counter(lengths) and len(places) == _best_fit_decreasing(lengths, 100)
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100


def test_packing_takes_few_jobs(spark):
    """However many different lengths there are, and over many parts."""
    lengths = np.random.default_rng(8).integers(1, 60, 600).tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(20).withColumn("id", F.col("id") % 20 * (1 << 33) + F.col("id"))
    spark.sparkContext.setJobGroup("packing", "")
    placed = packing._placed(pieces, 100).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len({x.id for x in placed}) == sum(n <= 50 for n in lengths)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("packing")) <= 25  # over 100 in rounds


# neighbours
def test_neighbours(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    x[500:900] = x[500]  # one very common vector
    x[1000:2000] = x[1000] + 0.1 * r.normal(size=(1000, 24))
    rows = [(k, v.tolist(), 1, 0.5) for k, v in enumerate(x)] + [(5000, None, 1, 0.5), (5100, [0.0] * 24, 1, 0.5), (5200, [float("nan")] + [1.0] * 23, 1, 0.5), (5300, [None] + [1.0] * 23, 1, 0.5), (5400, [1.0] * 3, 1, 0.5), (None, [1.0] * 24, 1, 0.5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = collections.defaultdict(list)
    for q in neighbours.nearest(table).collect():
        got[q.query_id].append((q["rank"], q.vec_id, q.score))
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        assert all(abs(f[2] - d[f[1]]) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & set(true.tolist()))
    assert hits >= 0.95 * 10 * len(got)
    assert sorted(got[600])[0][1] == 500  # ties to the smaller id
    assert neighbours.nearest(table.limit(0)).count() == 0
    few = neighbours.nearest(table.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((f.query_id, f.vec_id) for f in few) == [(0, 1), (0, 2)]


def test_neighbours_among_thousands_of_copies(spark):
    r = np.random.default_rng(12)
    kinds = r.normal(size=(8, 64)).astype(np.float32)
    which = r.permutation(np.repeat(np.arange(8), 2000))  # 2000 copies of each
    table = spark.createDataFrame([(int(k), kinds[which[k]].tolist()) for k in r.permutation(len(which))], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for f in neighbours.nearest(table).collect():
        got[f.query_id].append((f["rank"], f.vec_id, f.score))
    assert set(got) == set(range(0, len(which), 100))
    for q, found in got.items():
        same = [int(k) for k in np.flatnonzero(which == which[q]) if k != q][:10]
        assert sorted(found) == [(n + 1, k, 0.0) for n, k in enumerate(same)]


def test_neighbours_with_repeated_ids(spark):
    """A query uses its least vector, a candidate its nearest; extra columns may have any names."""
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 2.0], 1), (7, [9.0, 0.0], 2), (7, [0.0, 3.0], 2), (8, [0.0, 2.5], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    got = [(f.query_id, f["rank"], f.vec_id, f.score) for f in neighbours.nearest(table).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 0.5), (0, 2, 7, 1.0)]


def test_tree_grows_with_the_rows():
    r = np.random.default_rng(1)
    tree = neighbours.Tree(r.normal(size=(neighbours.SAMPLE, 4)), neighbours.LEAVES)
    assert len(tree.lo) == neighbours.LEAVES
    y = r.normal(size=(500, 4))
    leaf = tree.leaf(y)
    assert all((tree.lo[n] <= p).all() and (p <= tree.hi[n]).all() for n, p in zip(leaf, y, strict=True))


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 2) - 5.9915) < 1e-3
    assert abs(neighbours.chi_square_quantile(0.95, 16) - 26.296) < 1e-3


# pipeline
def test_pipeline(spark, tmp_path):
    docs, labels = corpus(spark, 120)
    r = np.random.default_rng(11)
    rows = [(x.doc_id, x.text, x.lang, "s", len(x.text or "")) for x in docs.collect() if x.doc_id is not None and x.doc_id < 900]
    base = " ".join(r.choice(["the", "and", "thing", "with", "house", "night"], 200))
    rows += [(500, base + " mail me@x.org", "en", "s", 1), (501, base + " mail me@x.org", "en", "s", 1), (502, base + " mail me@x.org now", "en", "s", 1), (503, None, None, "s", 0), (504, "12 34", None, "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in out}
    toxic = {x.doc_id for x in labels.where("toxic = 1").collect()}
    assert ids == {x[0] for x in rows} - toxic - {501, 502, 503, 504}
    spark_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        spark_docs = stage(spark, spark_docs, str(tmp_path))
        assert spark_docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {x.doc_id: x for x in spark_docs.collect()}
    assert left[500].text == base + " mail <EMAIL>" and left[500].n_chars == len(left[500].text)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Null and repeated doc_ids, very long and empty texts, other columns: no stage fails, clean rows stay."""
    docs, labels = corpus(spark, 120)
    common = [x.text for x in docs.where("doc_id < 20 and doc_id % 3 <> 0").collect()]
    rows = [(x.doc_id, x.text, x.lang, "s", 1, "e") for x in docs.where("doc_id < 120").collect()]
    back = [" ".join(reversed(x.split())) for x in common]  # no near copies of theirs
    rows += [(None, f"{back[0]} ann@x.org", "de", "s", 1, "e"), (1, back[1], "de", "s", 1, "e"), (700, " ".join(common * 300), None, "s", 1, "e"), (701, "", None, "s", 1, "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, added string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars", "added"]
    left = table.collect()
    assert sum(x.doc_id is None and "<EMAIL>" in x.text for x in left) == 1 and not any("@" in (x.text or "") for x in left)
    assert sum(x.doc_id == 1 for x in left) == 2 and any(x.doc_id == 700 for x in left) and not any(x.doc_id == 701 for x in left)
    assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).select("doc_id").distinct().count() == len({x.doc_id for x in left})
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
