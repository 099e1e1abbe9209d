"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, common, filter_audit, fingerprints, jaccard, media, packing, pii, simhash, substrings, token_counts, toxicity, warc

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(common.table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edits(common.table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_personal_data(common.table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.predictions(toxicity.score_documents(docs, toxicity.train_on(docs, common.table(spark, sf_dir, "labels"))))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(common.table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(common.table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(common.table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_fingerprints, op3_best_fit_packing, op4_token_counts, op5_personal_data, op6_toxicity, op7_warc, op8_ngram_jaccard, op9_substring_dedup, op10_media_columns)
    + (op11_filter_audit, op12_simhash, op13_collocations)
}
WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, max(page_id) OVER (PARTITION BY sha1(b)) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM h""",
    "op8_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) t),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM reach GROUP BY 1) r ON r.v = d.doc_id""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM x WHERE n > 1),
every AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_filter_audit": f"""
WITH f(i, letter) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
o AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS p FROM f a, f b, f c, f d, f e
  WHERE (1 << a.i) | (1 << b.i) | (1 << c.i) | (1 << d.i) | (1 << e.i) = 31),
s AS (SELECT filter_order, step, p[step] AS own, CAST(coalesce(list_sum(list_transform(p[:step - 1], lambda x: 1 << x)), 0) AS INT) AS early FROM o, range(1, 6) t(step)),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
m AS (SELECT part, doc_id, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS m FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
h AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
c AS (SELECT part, filter_order, step, own, sum(n * CAST(m & early = 0 AND (m >> own) & 1 = 0 AS INT)) AS kept, sum(n * CAST(m & early = 0 AND (m >> own) & 1 = 1 AS INT)) AS removed,
  sum(n * CAST(m & early > 0 AND (m >> own) & 1 = 1 AS INT)) AS redundant, sum(n * CAST(m = 1 << own AS INT)) AS unique_fails,
  sum(good * CAST(m & early = 0 AND (m >> own) & 1 = 1 AS INT)) AS good_lost, sum(toxic * CAST(m & early = 0 AND (m >> own) & 1 = 1 AS INT)) AS toxic_lost FROM h, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c""",
    "op13_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({LOWER.replace("text", "coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM p, range(1, 5) t(k)),
c AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM c WHERE k > 1 AND f >= 30),
part AS (SELECT lang, k, g, f, unnest(range(1, k)) AS cut, w FROM cand),
cuts AS (SELECT part.lang, part.g, part.f AS a, cut, x.f AS l, y.f AS r, CAST(2000000 * CAST(part.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score FROM part
  JOIN c x ON x.lang = part.lang AND x.g = array_to_string(w[:cut], ' ') AND x.k = cut JOIN c y ON y.lang = part.lang AND y.g = array_to_string(w[cut + 1:], ' ') AND y.k = part.k - cut),
low AS (SELECT lang, g, a, arg_min(struct_pack(score := score, l := l, r := r), score * 4 + cut) AS s FROM cuts GROUP BY 1, 2, 3),
held AS (SELECT DISTINCT a.lang, a.g FROM cand a JOIN cand b ON a.lang = b.lang AND a.k < b.k AND contains(' ' || b.g || ' ', ' ' || a.g || ' ') AND 100 * b.f >= 80 * a.f),
ranked AS (SELECT lang, g AS phrase, a, s.l AS l, s.r AS r, s.score AS score, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, g) AS rank FROM low ANTI JOIN held USING (lang, g))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
