"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import bpe, chat, embeddings, fingerprints, jaccard, katz, mixing, quality, sharding, substrings
from spanforge.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edited(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(l[i : i + 12], ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_REACHED = """reach AS (SELECT a AS node, a AS c FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.node WHERE r.c < l.b),
smallest AS (SELECT node, min(c) AS c FROM reach GROUP BY node), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)"""

_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS l FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(l[i : i + 4], ' ') AS sh FROM (SELECT doc_id, l, unnest(range(1, greatest(2, len(l) - 3))) AS i FROM w WHERE len(l) > 0))),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE k >= 0.8 * (p.n + q.n - k)
  UNION ALL SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.doc_id <> y.doc_id AND len(x.l) = 0 AND len(y.l) = 0),
{_REACHED}
SELECT doc_id, coalesce(c, doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, doc_id) = doc_id AS kept FROM documents LEFT JOIN smallest ON node = doc_id LEFT JOIN degree ON a = doc_id"""

_EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACHED}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN smallest ON node = vec_id LEFT JOIN degree ON a = vec_id"""

_MASK = "(h & ((1::BIGINT << 40) - 1))"
_SHARE = """len(list_filter(list_zip({a}, {b}), lambda p: p[1] = p[2])) / greatest(1, len(list_filter(list_zip({a}, {b}), lambda p: p[1] IS NOT NULL OR p[2] IS NOT NULL)))"""


def _likeness(x: str, y: str) -> str:
    share = lambda a, b: _SHARE.format(a=a, b=b)
    return f"""CASE WHEN {x}.shown = {y}.shown THEN 1.0::DOUBLE WHEN {x}.level = {y}.level THEN {share(f"list_concat({x}.fine, {x}.coarse)", f"list_concat({y}.fine, {y}.coarse)")}
  WHEN {x}.level + 1 = {y}.level THEN {share(f"{x}.coarse", f"{y}.fine")} WHEN {x}.level = {y}.level + 1 THEN {share(f"{x}.fine", f"{y}.coarse")} ELSE 0.0 END"""


_FINGERPRINTS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS total FROM documents),
e AS (SELECT a.doc_id, a.text, b.text AS nxt, left(a.text, length(a.text) - length(a.text) // 3) || left(b.text, length(a.text) // 3) AS edited FROM d a JOIN d b ON b.r = a.r % a.total + 1),
x AS (SELECT doc_id, unnest([0, 1, 2]) AS k, unnest([text, edited, nxt]) AS s FROM e),
t AS (SELECT DISTINCT doc_id, k, unnest(list_transform(list_distinct(regexp_extract_all(lower(s), '[^ 	-
]+')), lambda w: ('0x' || md5(w)[1:15])::BIGINT)) AS h FROM x),
df AS (SELECT h, count(*) AS df FROM t WHERE k = 0 GROUP BY h),
m AS (SELECT t.*, df, coalesce(df, 0) * 5 <= (SELECT count(*) FROM documents) AS rarer FROM t LEFT JOIN df USING (h)),
u AS (SELECT * EXCLUDE (rarer, few) FROM (SELECT *, count(*) FILTER (WHERE rarer) OVER (PARTITION BY doc_id, k) < 4 AS few FROM m) WHERE rarer OR few),
lv AS (SELECT doc_id, k, len(list_filter(range(1, 30), lambda i: count(*) >= 16 * (1::BIGINT << i))) AS level FROM u GROUP BY doc_id, k),
c AS (SELECT u.*, level FROM u JOIN lv USING (doc_id, k) WHERE {_MASK} % (1::BIGINT << level) = 0),
b AS (SELECT doc_id, k, bool_or(coalesce(df, 0) >= 2 AND df * 5 <= (SELECT count(*) FROM documents)) AS banded FROM c GROUP BY doc_id, k),
sig AS (SELECT doc_id, k, (h >> 40) % 16 AS l, substr(md5(string_agg(h::VARCHAR, ',' ORDER BY h)), 1, 16) AS fine, substr(md5(string_agg(h::VARCHAR, ',' ORDER BY h) FILTER (WHERE {_MASK} % (1::BIGINT << (level + 1)) = 0)), 1, 16) AS coarse
  FROM c JOIN b USING (doc_id, k) WHERE (df >= 2 AND df * 5 <= (SELECT count(*) FROM documents)) OR NOT banded GROUP BY doc_id, k, (h >> 40) % 16),
g AS (SELECT x.doc_id, x.k, list(fine ORDER BY lex.l) AS fine, list(coarse ORDER BY lex.l) AS coarse FROM x CROSS JOIN (SELECT unnest(range(16)) AS l) lex LEFT JOIN sig ON sig.doc_id = x.doc_id AND sig.k = x.k AND sig.l = lex.l GROUP BY x.doc_id, x.k),
f AS (SELECT g.*, coalesce(level, 0) AS level, concat_ws(':', CASE WHEN banded THEN 'b' ELSE 'a' END, coalesce(level, 0)::VARCHAR, array_to_string(list_transform(fine, lambda z: coalesce(z, '-')), ','), array_to_string(list_transform(coarse, lambda z: coalesce(z, '-')), ',')) AS shown
  FROM g LEFT JOIN lv USING (doc_id, k) LEFT JOIN b USING (doc_id, k))
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, p.shown AS fingerprint, q.shown AS edited_fingerprint, {_likeness("p", "q")} AS near_edited, {_likeness("p", "z")} AS near_next
FROM e JOIN f p ON p.doc_id = e.doc_id AND p.k = 0 JOIN f q ON q.doc_id = e.doc_id AND q.k = 1 JOIN f z ON z.doc_id = e.doc_id AND z.k = 2"""

#: SQL that DuckDB can run over whole tables.
ORACLE: dict[str, str] = {"op2_fingerprints": _FINGERPRINTS, "op4_substrings": _SUBSTRINGS, "op9_jaccard": _JACCARD, "op10_embeddings": _EMBEDDINGS}

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_substrings": op4_substrings,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_katz": op7_katz,
    "op8_sharding": op8_sharding,
    "op9_jaccard": op9_jaccard,
    "op10_embeddings": op10_embeddings,
    "pipeline": pipeline,
}
