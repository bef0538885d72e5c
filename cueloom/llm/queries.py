"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import centroids, embedding_dedup, fingerprints, html_blocks, mixing, ngram_join, packing, pii, ppm, quality, secrets, spelling, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_read(spark, sf_dir, "documents"), _tokenizer())


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(_read(spark, sf_dir, "conversations"), _tokenizer())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(_read(spark, sf_dir, "documents"), key="rotate-me")
    return replaced.select("doc_id", "text", "n_entities", F.to_json("entities").alias("entities"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.page_responses(_read(spark, sf_dir, "pages")))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_read(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",").alias("shards"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents")).drop("found")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.rate(docs.select("doc_id", "text"), model).drop("text")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "packed_conversations": packed_conversations} | {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


#: A text with A-Z lower-cased and nothing else changed.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op5_embedding_dedup": """
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (
  SELECT vec_id, v FROM vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM sound UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vectors.vec_id, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_links, CAST(coalesce(named.component_id, vectors.vec_id) AS BIGINT) AS component_id,
  vectors.vec_id = coalesce(named.component_id, vectors.vec_id) AS kept
FROM vectors LEFT JOIN counted ON vectors.vec_id = counted.a LEFT JOIN named ON vectors.vec_id = named.a
""",
    "op7_ngram_join": rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM worded),
runs AS (
  SELECT doc_id, n, k, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
sets AS (SELECT doc_id, list_sort(list(DISTINCT g)) AS s FROM runs WHERE k <= greatest(1, n - 4) GROUP BY doc_id),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets GROUP BY s),
shingles AS (SELECT c, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, CAST(coalesce(len(sets.s), 0) AS BIGINT) AS n_shingles,
  CAST(coalesce(named.component_id, documents.doc_id) AS BIGINT) AS component_id
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (s) LEFT JOIN named ON classes.c = named.a
""",
}


def _digest_sql(text: str) -> str:
    """CTE bodies `grams_<text>` to `digest_<text>` for the texts of a table `<text>(doc_id, text)`."""
    return rf"""
bytes_{text} AS MATERIALIZED (
  SELECT doc_id, list_transform(regexp_extract_all(lower(hex(encode(text))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM {text}),
grams_{text} AS (
  SELECT doc_id, unnest(flatten([
    list_transform(range(len(b)), lambda i: b[i + 1] + 256 * b[(i + 7) % len(b) + 1] + 65536 * b[(i + 12) % len(b) + 1]),
    list_transform(range(len(b)), lambda i: 16777216 + b[i + 1] + 256 * b[(i + 5) % len(b) + 1] + 65536 * b[(i + 13) % len(b) + 1])])) AS g
  FROM bytes_{text} WHERE len(b) > 0),
found_{text} AS (
  SELECT doc_id, ((g % 16777216) * 2654435761 + (g // 16777216) * 2135587861) % 4294967296 // 16777216 AS bucket, count(*) AS n FROM grams_{text} GROUP BY ALL),
counts_{text} AS (
  SELECT doc_id, bucket, coalesce(n, 0) AS n FROM (SELECT doc_id, unnest(range(256)) AS bucket FROM {text}) LEFT JOIN found_{text} USING (doc_id, bucket)),
limits_{text} AS (
  SELECT doc_id, s[64] AS low, s[128] AS middle, s[192] AS high FROM (SELECT doc_id, list_sort(list(n)) AS s FROM counts_{text} GROUP BY doc_id)),
digest_{text} AS MATERIALIZED (
  SELECT doc_id, any_value(length) AS length, list(code ORDER BY bucket) AS codes FROM (
    SELECT doc_id, bucket, (n > low)::INT + (n > middle)::INT + (n > high)::INT AS code, least(255, CAST(floor(8 * log2(1 + len(b))) AS INT)) AS length
    FROM counts_{text} JOIN limits_{text} USING (doc_id) JOIN bytes_{text} USING (doc_id))
  GROUP BY doc_id)"""


_HEX = "substr('0123456789abcdef', {} + 1, 1)"
_WRITTEN = f"{_HEX.format('{0}.length // 16')} || {_HEX.format('{0}.length % 16')} || list_aggregate(list_transform(range(128), lambda i: {_HEX.format('4 * {0}.codes[2 * i + 1] + {0}.codes[2 * i + 2]')}), 'string_agg', '')"
_LIKENESS = "CAST(greatest(0, 320 - list_sum(list_transform(range(1, 257), lambda i: abs({0}.codes[i] - {1}.codes[i]))) - 8 * least(32, abs({0}.length - {1}.length))) AS DOUBLE) / 320"

ORACLE["op11_fingerprints"] = f"""
WITH own AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (SELECT doc_id, text, lead(doc_id) OVER (ORDER BY doc_id DESC) AS next, max(doc_id) OVER () AS last FROM own),
pairs AS (SELECT o.doc_id, o.text, length(o.text) // 3 AS k, n.doc_id AS next, n.text AS other FROM ordered o JOIN own n ON n.doc_id = coalesce(o.next, o.last)),
edited AS MATERIALIZED (SELECT doc_id, next, left(text, length(text) - k) || left(other, k) AS text FROM pairs),
{_digest_sql("own")},
{_digest_sql("edited")}
SELECT own.doc_id, length(own.text) AS n_chars, sha256(edited.text) AS edited_sha256, {_WRITTEN.format("a")} AS fingerprint, {_WRITTEN.format("e")} AS edited_fingerprint,
  {_LIKENESS.format("a", "e")} AS near_edited, {_LIKENESS.format("a", "n")} AS near_next
FROM own JOIN edited USING (doc_id) JOIN digest_own a USING (doc_id) JOIN digest_edited e USING (doc_id) JOIN digest_own n ON n.doc_id = edited.next
"""


def _rounds_sql(rounds: int) -> str:
    """CTEs `near_0` to `near_<rounds>` (vec_id, k, d) and `c_0` to `c_<rounds>` (k, c), one after the other."""
    made = []
    for r in range(rounds + 1):
        made.append(f"""near_{r} AS MATERIALIZED (
  SELECT vec_id, min(struct_pack(d := d, k := k)) AS best FROM (
    SELECT vec_id, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c_{r})
  GROUP BY vec_id)""")
        if r < rounds:
            made.append(f"""means_{r} AS (
  SELECT k, list(v ORDER BY p) AS c FROM (
    SELECT k, p, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
    FROM (SELECT best.k AS k, unnest(x) AS v, generate_subscripts(x, 1) AS p FROM near_{r} JOIN kept USING (vec_id)) GROUP BY k, p)
  GROUP BY k),
c_{r + 1} AS MATERIALIZED (SELECT k, coalesce(means_{r}.c, c_{r}.c) AS c FROM c_{r} LEFT JOIN means_{r} USING (k))""")
    return ",\n".join(made)


ORACLE["op12_centroids"] = f"""
WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(v, lambda a: CAST(floor(1024 * a) AS BIGINT)) AS x FROM vectors
  WHERE len(v) = 64 AND len(list_filter(v, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
c_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
{_rounds_sql(10)},
told AS (SELECT best.k AS k, sum(best.d) AS s FROM near_10 GROUP BY best.k)
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(told.s AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near_10 JOIN told ON told.k = best.k JOIN c_10 ON c_10.k = best.k
"""

ORACLE["op13_spelling"] = rf"""
WITH RECURSIVE shifted AS (
  SELECT n, 0 AS step, n AS c FROM range(256) r(n)
  UNION ALL SELECT n, step + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM shifted WHERE step < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM shifted WHERE step = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(lower(hex(encode(doc_id || ':' || run))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295)) AS h
  FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
longer AS (SELECT DISTINCT cut.word AS a, cut.n AS a_n, words.word AS b, words.n AS b_n FROM cut JOIN words ON cut.rest = words.word),
near AS (
  SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a, a_n, b, b_n FROM longer UNION ALL SELECT b, b_n, a, a_n FROM longer),
best AS (
  SELECT word, n, count(*) AS n_near, min(struct_pack(n := -other_n, word := other)) AS lead FROM near GROUP BY word, n),
formed AS MATERIALIZED (SELECT word, lead.word AS form, -lead.n AS form_n FROM best WHERE -lead.n >= 2 * n),
chain AS (
  SELECT word, form AS root FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.root = formed.word),
ends AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM formed))
SELECT words.word, formed.form, coalesce(ends.root, words.word) AS root, words.n, coalesce(best.n_near, 0) AS n_near, formed.form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)
"""
