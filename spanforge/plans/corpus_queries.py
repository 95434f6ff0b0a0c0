"""Queries over the corpus: sentences, labels, lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import text as tx
from spanforge.operators import corpus, labels
from spanforge.operators import lexicon as lx
from spanforge.plans import sql

QUERIES: dict = {}
ORACLE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(statement: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if statement:
            ORACLE[f.__name__] = statement
        return f

    return put


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(table(spark, sf_dir, "documents"))


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_sentences(found(spark, sf_dir), "documents")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-name words and frequent tokens: enough to have matches in the documents."""
    parts = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    tokens = firsts(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike("^[A-Za-z]{4,12}$")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 20").select("word")
    return lx.bounded(parts.unionByName(tokens).distinct(), 12)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.match(firsts(spark, sf_dir), lexicon(spark, sf_dir))


@query("WITH" + sql.pieces() + " SELECT doc_id, count(*) AS n_sentences, sum(length(text))::BIGINT AS n_chars FROM sentences GROUP BY doc_id")
def sentences_split(spark, sf_dir):
    return found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("text")).alias("n_chars"))


@query(sql.base() + " SELECT sid, group_id, text FROM firsts")
def sentences_distinct(spark, sf_dir):
    return firsts(spark, sf_dir)


@query(sql.base() + " SELECT sid, text FROM firsts ORDER BY sha256('41:' || sid), sid LIMIT 200")
def sentence_sample(spark, sf_dir):
    return corpus.sample(firsts(spark, sf_dir), 200).select("sid", "text")


@query("WITH" + sql.pieces() + " SELECT source, count(*) AS n FROM sentences WHERE regexp_matches(coalesce(source, ''), '^src1') GROUP BY source")
def category_filter(spark, sf_dir):
    return corpus.in_category(found(spark, sf_dir), "^src1", "source").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(concat_ws('。', nullif(trim(url), ''), nullif(trim(page_id::VARCHAR), ''))) AS joined FROM pages")
def field_concat(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.join_fields(F.col("url"), F.col("page_id").cast("string")), 256).alias("joined"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_pending(spark, sf_dir):
    return corpus.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN l.doc_id IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS fault FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR n > 1")
def response_completeness(spark, sf_dir):
    asked, said = (table(spark, sf_dir, t).select(F.col("doc_id").alias("id")) for t in ("documents", "labels"))
    return labels.complete(asked, said).withColumnRenamed("id", "doc_id")


@query("SELECT coalesce(d.id, l.id) AS id, d.group_id, CASE WHEN l.id IS NULL THEN 'row only' WHEN d.id IS NULL THEN 'label only' ELSE 'both' END AS matched FROM (SELECT doc_id AS id, source AS group_id FROM documents) d FULL JOIN (SELECT doc_id AS id FROM labels) l ON d.id = l.id")
def group_backfill(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"))
    return corpus.backfill_groups(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("group_id")), rows).select("id", "group_id", "matched")


@query("SELECT conv_id AS id, max(turn) AS line, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_write_wins(spark, sf_dir):
    from spanforge.sources.readers import last_labels

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("line"), "text")
    last = last_labels(c)
    at = c.groupBy("id").agg(F.max("line").alias("_last"))
    return last.join(at, "id").select("id", F.col("_last").alias("line"), "text")


@query("SELECT conv_id, turn, (turn // 2)::BIGINT AS batch FROM conversations")
def batch_slices(spark, sf_dir):
    return corpus.batches(table(spark, sf_dir, "conversations"), 2, "turn").select("conv_id", "turn", "batch")


@query(rf"""SELECT word, min(line) AS line FROM (
  SELECT p_partkey AS line, string_split(trim(regexp_replace(p_name, '{sql.SP}', ' ', 'g')), ' ')[1] AS word FROM part
) WHERE length(word) BETWEEN 2 AND 12 AND word NOT LIKE '#%' GROUP BY word ORDER BY line LIMIT 50""")
def first_words(spark, sf_dir):
    return corpus.first_words(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.col("p_name").alias("value")), 50)


_KINDS = [*schema.ENTITY_TYPES, *schema.TYPE_ALIASES, *schema.SKIPPED_TYPES, "UNKNOWN"]


@query(
    "WITH k(kind) AS (VALUES " + ", ".join(f"('{k}')" for k in _KINDS) + "), alias(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in schema.TYPE_ALIASES.items()) + ") "
    f"SELECT kind, CASE WHEN kind IN ({sql.quoted(schema.SKIPPED_TYPES)}) THEN NULL WHEN coalesce(b, kind) IN ({sql.quoted(schema.ENTITY_TYPES)}) THEN coalesce(b, kind) END AS type FROM k LEFT JOIN alias ON kind = a"
)
def type_alias(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in _KINDS], "kind string").select("kind", labels.known_type(F.col("kind")).alias("type"))


#: (id, text, entities) that need repair or break a rule.
FIXTURE = [
    ("r1", "小米15发布新品", [(4, 18, "PRODUCT", "小米15")]), ("r2", "ababa and ababa", [(2, 5, "WORK", "aba"), (0, 3, "WORK", "aba"), (1, 2, "DATE", "b")]), ("r3", "张三访问北京大学", [(0, 2, "PERSON", "张三"), (4, 6, "LOC", "北京"), (4, 8, "ORG", "北京大学")]),
    ("r4", "one two one two", [(9, 12, "TECH", "two"), (9, 12, "TECH", "two"), (0, 3, "NONSENSE", "one")]), ("r5", "a\tb", [(0, 1, "PER", "a")]), ("", "no id", []), ("r7", "no entities", None), ("r8", "overlap here", [(0, 7, "EVENT", "overlap"), (4, 12, "EVENT", "lap here")]),
    ("r9", "beyond", [(3, 9, "LAW", "ond")]), ("r10", "", []),
]


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE, "id string, text string, entities array<struct<start:int,end:int,type:string,text:string>>")


def _fixture_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"
    rows = [f"({q(i)}, {q(t)}, {'NULL' if e is None else '[' + ', '.join(f'{{s: {a}, e: {b}, k: {q(k)}, v: {q(v)}}}' for a, b, k, v in e) + ']'})" for i, t, e in FIXTURE]
    return "fixture(id, text, entities) AS (SELECT id, text, entities::STRUCT(s INT, e INT, k VARCHAR, v VARCHAR)[] FROM (VALUES " + ", ".join(rows) + ") t(id, text, entities))"


@query("WITH " + _fixture_sql() + f"""
, x AS (SELECT id, text, entities, coalesce(entities, []) AS e FROM fixture),
y AS (SELECT id, unnest(list_concat(
  CASE WHEN id <> '' THEN [] ELSE ['has_id'] END, CASE WHEN text <> '' THEN [] ELSE ['has_text'] END, CASE WHEN regexp_matches(text, '[\\t\\r\\n]') THEN ['one_line'] ELSE [] END, CASE WHEN entities IS NULL THEN ['has_entities'] ELSE [] END,
  CASE WHEN len(list_filter(e, lambda z: z.k NOT IN ({sql.quoted(schema.ENTITY_TYPES)}))) > 0 THEN ['known_types'] ELSE [] END,
  CASE WHEN len(list_filter(e, lambda z: NOT (z.s >= 0 AND z.s < z.e AND z.e <= length(text)))) > 0 THEN ['in_bounds'] ELSE [] END,
  CASE WHEN len(list_filter(e, lambda z: substring(text, z.s + 1, z.e - z.s) <> z.v)) > 0 THEN ['same_text'] ELSE [] END,
  CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(e) AS a) p, (SELECT unnest(e) AS b) q WHERE a <> b AND a.s < b.e AND b.s < a.e) OR len(e) > len(list_distinct(list_transform(e, lambda z: (z.s, z.e)))) THEN ['no_overlap'] ELSE [] END)) AS failed FROM x)
SELECT id, failed FROM y""")
def row_validation(spark, sf_dir):
    return labels.validate(fixture(spark)).select("id", F.explode("failed").alias("failed"))


@query("""SELECT * FROM (VALUES ('r1', 0, 4, 'PRODUCT', '小米15'), ('r2', 0, 3, 'WORK', 'aba'), ('r3', 0, 2, 'PER', '张三'), ('r3', 4, 8, 'ORG', '北京大学'), ('r4', 4, 7, 'TECH', 'two'), ('r4', 12, 15, 'TECH', 'two'),
  ('r5', 0, 1, 'PER', 'a'), ('r8', 4, 12, 'EVENT', 'lap here'), ('r9', 3, 6, 'LAW', 'ond')) t(id, start, "end", type, text)""")
def type_alias_repair(spark, sf_dir):
    return labels.repair(fixture(spark)).select("id", F.inline("entities")).select("id", "start", "end", "type", "text")


@query("SELECT 'doc_id' AS key, doc_id::VARCHAR AS value, count(*) AS n FROM documents GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'text', sha256(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return labels.duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("text")), "doc_id", "text")


@query(rf"""WITH lines AS (SELECT list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '{sql.SP}', ' ', 'g'), ' '), ' '), lambda w: w <> '') AS t FROM documents),
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM lines) GROUP BY word),
c AS (SELECT word, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1])) AS word FROM lines WHERE len(t) > 1) GROUP BY word)
SELECT w.word, w.n FROM w LEFT JOIN c ON w.word = c.word WHERE coalesce(c.c, 0) < w.n""")
def lexicon_compound(spark, sf_dir):
    return lx.build(table(spark, sf_dir, "documents"))


@query(sql.base(sql.LEXICON, sql.MATCHES) + ' SELECT sid, start, "end", word FROM matches')
def lexicon_match(spark, sf_dir):
    return matches(spark, sf_dir).select("sid", "start", "end", "word")


@query(sql.base(sql.LEXICON, sql.MATCHES) + ", where_from AS (SELECT DISTINCT source, text FROM sentences) SELECT w.source, count(*) AS n, count(DISTINCT m.word) AS n_words FROM matches m JOIN where_from w ON w.text = m.text GROUP BY w.source")
def lexicon_match_counts(spark, sf_dir):
    """The flagship: documents to sentences to matches to counts by source."""
    places = found(spark, sf_dir).select("source", "text").distinct()
    m = lx.match(firsts(spark, sf_dir), lexicon(spark, sf_dir)).select("text", "word")
    return m.join(places, "text").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("word").alias("n_words"))


@query(sql.base(sql.LEXICON, sql.MATCHES) + r""" SELECT sid, start, "end", (60.0 * ("end" - start) - 10.0)::DOUBLE AS score FROM matches
WHERE NOT (start > 0 AND regexp_full_match(substring(text, start, 2), '[0-9A-Za-z]{2}')) AND NOT ("end" < length(text) AND regexp_full_match(substring(text, "end", 2), '[0-9A-Za-z]{2}'))""")
def lexicon_provider_scored(spark, sf_dir):
    return lx.scored_candidates(firsts(spark, sf_dir), lexicon(spark, sf_dir)).select("sid", "start", "end", "score")


@query(sql.base(sql.LEXICON, sql.MATCHES) + """, p AS (SELECT sid, start, "end", unnest(range(start, "end"))::INT AS pos FROM matches),
r AS (SELECT sid, pos, 'lx=' || CASE WHEN pos = start THEN 'B' WHEN pos = "end" - 1 THEN 'E' ELSE 'M' END AS f, CASE WHEN "end" - start >= 5 THEN '5+' ELSE ("end" - start)::VARCHAR END AS b FROM p)
SELECT DISTINCT sid, pos, unnest([f, f || ':' || b]) AS feature FROM r""")
def gazetteer_features(spark, sf_dir):
    return lx.features(matches(spark, sf_dir))


@query(sql.base(sql.LEXICON) + ", p AS (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM lexicon) SELECT substring(word, 1, n) AS prefix, max((n = length(word))::INT) AS is_word FROM p GROUP BY 1")
def lexicon_trie(spark, sf_dir):
    return lx.prefixes(lexicon(spark, sf_dir))


@query("SELECT p_brand AS word, count(*) AS n FROM part WHERE length(p_brand) BETWEEN 2 AND 12 GROUP BY p_brand HAVING count(*) >= 3")
def entity_lexicon_threshold(spark, sf_dir):
    return lx.frequent_surfaces(table(spark, sf_dir, "part").select(F.col("p_brand").alias("surface")), 3)


@query("SELECT string_split(p_name, ' ')[1] AS word, coalesce(try_cast(string_split(p_name, ' ')[2] AS BIGINT), 0) AS freq FROM part UNION ALL SELECT p_brand, p_size::BIGINT FROM part")
def frequency_words(spark, sf_dir):
    from spanforge.sources.readers import frequency_words as words

    part = table(spark, sf_dir, "part")
    return words(part.select(F.col("p_name").alias("value")).unionAll(part.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")))))


@query("SELECT p_brand AS word, p_size::FLOAT AS score FROM part UNION ALL SELECT string_split(p_name, ' ')[1], 1.0::FLOAT FROM part")
def scored_words(spark, sf_dir):
    from spanforge.sources.readers import scored_words as words

    part = table(spark, sf_dir, "part")
    return words(part.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("value")).unionAll(part.select("p_name")))


@query(r"""WITH b AS (SELECT n_name AS name, encode(n_name) AS e FROM nation UNION SELECT r_name, encode(r_name) FROM region),
y AS (SELECT name, list_transform(range(1, octet_length(e) + 1), lambda i: ('0x' || hex(e)[2 * i - 1 : 2 * i])::HUGEINT) AS l FROM b)
SELECT name, list_reduce(list_concat([14695981039346656037::HUGEINT], l), lambda h, x: ((((h - h % 256) + xor((h % 256), x)) * 435) % 18446744073709551616::HUGEINT + ((((h - h % 256) + xor((h % 256), x)) % 16777216) * 1099511627776)) % 18446744073709551616::HUGEINT)::DECIMAL(20, 0) AS hash FROM y""")
def fnv1a64(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()
    return names.select("name", tx.fnv1a64(F.col("name")).alias("hash"))
