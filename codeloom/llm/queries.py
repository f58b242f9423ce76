"""The registered queries of the training-data operators: opN_<name>(spark, sf_dir).

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distinct sampled segmentations of every text, with inclusion probabilities; the first is decoded again."""
    from codeloom.llm.segmentation import sample_segmentations

    return sample_segmentations(_table(spark, sf_dir, "documents"), digest=True)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back from its format."""
    from codeloom.llm.chat import chat_format, loss_text, read_turns

    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat_format(rows).select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    done = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), "loss", "formatted_chars")
    return done.select("conv_id", "n_turns", F.sha2(F.encode("told", "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


def op3_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, with their likenesses."""
    from codeloom.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels that are not held out."""
    from codeloom.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    from codeloom.llm import language

    docs = _table(spark, sf_dir, "documents")
    return language.language(docs, language.learn(docs))


def op6_disclosure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base patterns and disclosing terms."""
    from codeloom.llm import private_data

    return private_data.spans(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens."""
    from codeloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    from codeloom.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op9_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    from codeloom.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels that are not held out."""
    from codeloom.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases whose words come together most beyond chance."""
    from codeloom.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_dual_tree_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest inner products of every fiftieth vector."""
    from codeloom.llm.inner_product import greatest_products

    return greatest_products(_table(spark, sf_dir, "embeddings"))


def op13_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as codes of its eight parts, from codebooks of six rounds."""
    from codeloom.llm.vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece_sampling, op2_chat_formatting, op3_one_permutation_minhash, op4_attention_quality, op5_language_id,
    op6_disclosure_control, op7_best_fit_packing, op8_ngram_jaccard_join, op9_projected_neighbours, op10_factorization_toxicity,
    op11_collocations, op12_dual_tree_products, op13_yinyang_codes)}



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd, round after round, over every component."""
    sql = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  c AS MATERIALIZED (SELECT vec_id, i // (len(v) // {parts}) AS part, i % (len(v) // {parts}) AS pos, v[i + 1] AS x FROM k, unnest(range(len(v))) AS u(i)),
  b0 AS MATERIALIZED (SELECT part, e, pos, x FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (vec_id) WHERE e < {entries})"""
    for r in range(rounds + 1):
        sql += f""",
  a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT vec_id, c.part, e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM c JOIN b{r} b ON b.part = c.part AND b.pos = c.pos GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
        if r < rounds:
            sql += f""",
  m{r} AS (SELECT part, e, pos, sum(x) AS s, count(*) AS n FROM a{r} JOIN c USING (vec_id, part) GROUP BY 1, 2, 3),
  b{r + 1} AS MATERIALIZED (SELECT part, e, pos, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, x) AS x FROM b{r} LEFT JOIN m{r} USING (part, e, pos))"""
    return sql + f""",
  coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, pos)) FROM b{rounds}) AS codebooks_sha256 FROM coded JOIN k USING (vec_id)"""


_ESC = r"replace(replace(replace(replace(text, '\', '\e'), '###', '\h'), '</turn>', '\t'), '</part>', '\p')"
_ROLE = r"replace(replace(replace(replace(replace(replace(role, '\', '\e'), '###', '\h'), '</turn>', '\t'), '</part>', '\p'), ':', '\c'), chr(10), '\l')"
ORACLES: dict[str, str] = {
    "op2_chat_formatting": rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS was FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESC}) + CASE WHEN was = role THEN length('</part>')
           ELSE length('### ') + length({_ROLE}) + length(':' || chr(10)) + length('</turn>' || chr(10)) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op11_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
  sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY 1),
  runs AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM worded, range(1, 6) AS t(m), unnest(range(1, len(w) - m + 2)) AS u(i)),
  f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS a FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 100),
  cuts AS (SELECT lang, phrase, m, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS l_part, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS r_part FROM f, range(1, 5) AS t(k) WHERE k < m),
  scored AS (SELECT c.*, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = l_part JOIN f r ON r.lang = c.lang AND r.phrase = r_part JOIN sizes s ON s.lang = c.lang),
  best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
  kept AS (SELECT * FROM best b WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = b.lang AND x.m > b.m AND x.a >= b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' '))),
  ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000""",
    "op12_dual_tree_products": """
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM k q JOIN k c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op13_yinyang_codes": _codes_sql(),
}
