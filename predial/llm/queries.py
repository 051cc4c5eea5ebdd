"""The operators' queries with production parameters, over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, divergence, jaccard, language, language_model, licenses, manifest, packing, prefix_counts, quality, token_files, vectors
from .shared import small_batches, write_table

TOKENIZER = "byte_bpe_50k.json"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer())


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = token_files.write_tokens(table(spark, sf_dir, "documents"), _tokenizer())
    return token_files.read_tokens(segments).drop("part", "seq")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scores, _ = write_table(quality.add_scores(docs.select("doc_id", "text"), model).drop("text"), "quality")
    return scores.withColumn("kept", F.col("gumbel_key") >= quality.resample(scores, model.share))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.add_prefixes(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer()).drop("text")
    stored, _ = write_table(counted, "prefixes", "uncompressed")
    # What fits into 512 tokens comes from the stored counts: no text is encoded again.
    return stored.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "n_chars", prefix_counts.longest_within(512).alias("chars_within_limit"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_vector_near_duplicates": op1_vector_near_duplicates,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_license_scan": op4_license_scan,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_token_counts": op11_token_counts,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: Links of vectors, and the smallest id that each reaches.
_VECTORS = """WITH RECURSIVE g AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
lk AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
rc(a, z) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT lk.a, rc.z FROM rc JOIN lk ON lk.b = rc.a),
cm AS (SELECT a, min(z) AS z FROM rc GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM lk WHERE lk.a = vec_id) AS n_links, z AS component_id, vec_id = z AS kept FROM embeddings JOIN cm ON cm.a = vec_id"""
#: Links of documents by their 4-word shingles, and the smallest id that each reaches.
_DOCUMENTS = """WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
st AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM st),
lk AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
rc(a, z) AS (SELECT doc_id, doc_id FROM documents UNION SELECT lk.a, rc.z FROM rc JOIN lk ON lk.b = rc.a),
cm AS (SELECT a, min(z) AS z FROM rc GROUP BY a)
SELECT doc_id, coalesce(len(s), 0) AS n_shingles, z AS component_id FROM st JOIN cm ON cm.a = doc_id"""
#: Divergences over all kept terms: every group with every kept term of its language.
_DIVERGENCES = """WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY t.lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10"""
_CRC32 = "xor(list_reduce(list_concat([4294967295], list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
_HEAD = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
#: Trees level by level: of each language, then of the languages' roots; and each row folded upwards beside its siblings.
_MANIFEST = f"""WITH RECURSIVE b AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({_HEAD} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN {_CRC32} % 3 = 0 THEN sha256({_HEAD} || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM b),
t AS (SELECT lang, 0 AS lvl, i, n, leaf AS h FROM l UNION ALL SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, h FROM s UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 8, n),
tt AS (SELECT lang, lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM t WHERE n > 1 WINDOW w AS (PARTITION BY lang, lvl, i // 8 ORDER BY i)),
uu AS (SELECT lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM u WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 8 ORDER BY i)),
f AS (SELECT r, lang, 0 AS lvl, i, coalesce(changed, leaf) AS h, '' AS p FROM l UNION ALL SELECT f.r, f.lang, f.lvl + 1, f.i // 8, sha256(tt.a || f.h || tt.z), f.p || tt.a || tt.z FROM f JOIN tt ON tt.lang IS NOT DISTINCT FROM f.lang AND tt.lvl = f.lvl AND tt.i = f.i),
m AS (SELECT r, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM f GROUP BY r),
o AS (SELECT l.r, 0 AS lvl, s.i, m.h, m.p FROM l JOIN m ON m.r = l.r JOIN s ON s.lang IS NOT DISTINCT FROM l.lang UNION ALL SELECT o.r, o.lvl + 1, o.i // 8, sha256(uu.a || o.h || uu.z), o.p || uu.a || uu.z FROM o JOIN uu ON uu.lvl = o.lvl AND uu.i = o.i),
x AS (SELECT r, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM o GROUP BY r)
SELECT l.doc_id, l.leaf, s.h AS subroot, u.h AS root, sha256(x.p) AS proof_sha256, x.h AS folded_root, x.h = u.h AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN x ON x.r = l.r JOIN (SELECT h FROM u WHERE n = 1) u ON true"""
ORACLES: dict[str, str] = {"op1_vector_near_duplicates": _VECTORS, "op7_jaccard_join": _DOCUMENTS, "op12_source_divergence": _DIVERGENCES, "op13_merkle_manifest": _MANIFEST}
