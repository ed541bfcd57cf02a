"""The numbered queries: thin steps from the given tables to the operators and back, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxledger.llm import centroids, chat_format, decontaminate, html_text, language, line_dedup, packing, prefix_trie, quality_rules, reading_quality, shingle_join, source_mix, token_counts
from boxledger.llm.common import fold, table

TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", *more)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")


def by_doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("document_id", "doc_id")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, F.col("lang").alias("domain"))
    return by_doc(source_mix.mix_sources(docs, docs)).drop("posteriors")


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_doc(shingle_join.linked_components(documents(spark, sf_dir))).select("doc_id", "n_shingles", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(documents(spark, sf_dir))
    return by_doc(kept).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", "text")
    pairs = chat_format.preference_format(chat_format.preference_pairs(turns))
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen", 256).alias("chosen_sha256"),
        F.sha2("rejected", 256).alias("rejected_sha256"),
        chat_format.learnt_chars(F.col("chosen_mask")).alias("chosen_learnt"),
        chat_format.learnt_chars(F.col("rejected_mask")).alias("rejected_learnt"),
        "decided",
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("document_id"), 4) == 2
    trees = language.fit_languages(documents(spark, sf_dir, "lang"), learn=~held_out)
    found = language.identify_language(documents(spark, sf_dir), trees)
    return by_doc(found.select("document_id", held_out.alias("held_out"), "lang_pred", "score"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return by_doc(token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER)))


def quality_model(spark: SparkSession, sf_dir: str) -> reading_quality.PreferenceModel:
    learn = fold(F.col("document_id"), 5) != 0
    return reading_quality.fit_preferences(documents(spark, sf_dir), labels(spark, sf_dir).where(learn))


def op7_reading_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("document_id"), 5) == 0
    scored = reading_quality.score_documents(documents(spark, sf_dir), quality_model(spark, sf_dir))
    return by_doc(scored.select("document_id", held_out.alias("held_out"), "score", "predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_doc(decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return by_doc(quality_rules.quality_rules(docs, quality_rules.fit_quality_rules(docs, labels(spark, sf_dir))))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), F.col("embedding").alias("features"))
    found = centroids.cluster_objects(vectors, dimensions=64)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(F.col("object_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    packed = packing.pack_pieces(pieces.select("document_id", "row", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return by_doc(packed.drop("row"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), F.col("role").alias("field_id"), "text")
    nodes = prefix_trie.prefix_trie(prefix_trie.shared_heads(prefix_trie.reading_sequences(turns), batch=100, heads=6))
    names = {"document_id": "conv_id", "parent_document_id": "parent_conv_id", "n_documents": "n_convs", "saved_chars": "saved_tokens"}
    return nodes.withColumnsRenamed(names)


def centroid_rounds(rounds: int, clusters: int) -> str:
    """DuckDB text of op11: an assignment and an update for each round, as common table expressions."""
    out = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {clusters})
)"""
    ]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, n, v, best.cluster AS cluster, best.d AS d FROM (
    SELECT k.vec_id, k.n, any_value(k.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cluster := c.cluster)) AS best
    FROM kept k CROSS JOIN c{r} c GROUP BY k.vec_id, k.n)
)""")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % q) + q) % q) // q AS BIGINT) ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS q FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)
    GROUP BY cluster) m ON m.cluster = c.cluster
)""")
    return ",\n".join(out) + f"""
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_source_mix, op2_shingle_join, op3_line_dedup, op4_chat_format, op5_language, op6_token_counts, op7_reading_quality, op8_decontaminate, op9_quality_rules, op10_html_text, op11_centroid_clusters, op12_packing, op13_prefix_trie)
}

ORACLES: dict[str, str] = {
    "op11_centroid_clusters": centroid_rounds(centroids.ROUNDS, centroids.CLUSTERS),
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT x.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE x.doc_id > f.first_doc) AS n_dropped,
       sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (WHERE f.first_doc IS NULL OR x.doc_id = f.first_doc), '')) AS kept_sha256
FROM keyed x LEFT JOIN firsts f ON x.k = f.k GROUP BY x.doc_id""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), opening AS (
  SELECT conv_id, md5(length(role) || ':' || role || text) AS k, substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) AS part FROM turns WHERE i = 1
), partner AS (
  SELECT conv_id, lead(conv_id) OVER (PARTITION BY k, part ORDER BY conv_id) AS other FROM opening
), answers AS (
  SELECT conv_id, max(i) AS last, min(i) AS first FROM turns WHERE role = 'assistant' GROUP BY conv_id
), rejected AS (
  SELECT p.conv_id, t.i, t.role, t.text FROM partner p JOIN turns t ON t.conv_id = p.other
  UNION ALL SELECT p.conv_id, t.i, t.role, CASE WHEN t.i < a.last THEN t.text WHEN a.first < a.last THEN f.text ELSE '' END
  FROM partner p JOIN turns t ON t.conv_id = p.conv_id JOIN answers a ON a.conv_id = p.conv_id JOIN turns f ON f.conv_id = a.conv_id AND f.i = a.first
  WHERE p.other IS NULL AND t.i <= a.last
  UNION ALL SELECT p.conv_id, t.i, t.role, t.text FROM partner p JOIN turns t ON t.conv_id = p.conv_id
  WHERE p.other IS NULL AND p.conv_id NOT IN (SELECT conv_id FROM answers)
), sides AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.i, r.i) AS i, c.role AS crole, r.role AS rrole,
    '<|im_start|>' || c.role || chr(10) || c.text || '<|im_end|>' || chr(10) AS c, '<|im_start|>' || r.role || chr(10) || r.text || '<|im_end|>' || chr(10) AS r,
    length(c.text) + 11 AS nc, length(r.text) + 11 AS nr, c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM turns c FULL JOIN rejected r ON r.conv_id = c.conv_id AND r.i = c.i
), per AS (
  SELECT conv_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS k, bool_or(NOT same) AS decided FROM sides GROUP BY conv_id
)
SELECT conv_id, CAST(max(k) AS BIGINT) AS n_prompt_turns,
  sha256(coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i <= k), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i > k), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE i > k), '')) AS rejected_sha256,
  CAST(coalesce(sum(nc) FILTER (WHERE i > k AND crole = 'assistant'), 0) AS BIGINT) AS chosen_learnt,
  CAST(coalesce(sum(nr) FILTER (WHERE i > k AND rrole = 'assistant'), 0) AS BIGINT) AS rejected_learnt,
  bool_or(decided) AS decided
FROM sides JOIN per USING (conv_id) GROUP BY conv_id""",
    "op13_prefix_trie": r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))
), own AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own) CROSS JOIN tab
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.i, o.k, o.n FROM ids c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.k, o.n FROM ids c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h
), steps AS (
  SELECT conv_id, row_number() OVER w AS d, string_agg(k, '') OVER w AS prefix, n, count(*) OVER (PARTITION BY conv_id) AS size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), pre AS (
  SELECT * FROM steps UNION ALL SELECT c.conv_id, 0, '', 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM ids c
), nodes AS MATERIALIZED (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS q, any_value(n) AS n,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends
  FROM pre GROUP BY prefix, d
), kids AS (
  SELECT left(prefix, 32 * (d - 1)) AS up, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), marked AS (
  SELECT x.*, coalesce(k.n_children, 0) AS n_children FROM nodes x LEFT JOIN kids k ON k.up = x.prefix
), sums AS (
  SELECT left(prefix, 32 * a) AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((q - 1) * n) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM marked) GROUP BY 1
)
SELECT m.conv_id, m.d AS depth, CASE WHEN m.d > 0 THEN p.conv_id END AS parent_conv_id, m.q AS n_convs, m.n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM marked m JOIN sums s ON s.prefix = m.prefix LEFT JOIN nodes p ON p.prefix = left(m.prefix, 32 * (m.d - 1)) AND p.d = m.d - 1""",
}
