"""Queries over manifests, prompts, packed keys, masks and precomputed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import text as tx
from spanforge.operators import corpus, evaluate, features, gates, labels, prompts
from spanforge.operators import lexicon as lx
from spanforge.operators import names as nm
from spanforge.plans import corpus_queries as cq
from spanforge.plans import model_queries as mq
from spanforge.plans import sql
from spanforge.plans.corpus_queries import table
from spanforge.sources import manifests

QUERIES: dict = {}
ORACLE: dict = {}


def query(statement: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if statement:
            ORACLE[f.__name__] = statement
        return f

    return put


# --- packed keys and hashes

_KEYS = """words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
points AS (SELECT word, n, unicode(word[1])::HUGEINT AS a, unicode(word[2])::HUGEINT AS b, unicode(word[3])::HUGEINT AS c FROM (SELECT word, unnest([2, 3]) AS n FROM words) WHERE length(word) >= n),
keys AS (SELECT word, n, CASE n WHEN 2 THEN a * 2097152 + b ELSE 9223372036854775808::HUGEINT + a * 4398046511104 + b * 2097152 + c END + 1 AS key FROM points),
first AS (SELECT *, (key // 4294967296) * 4294967296 + xor(key // 4294967296, key % 4294967296) AS x FROM keys),
product AS (SELECT *, (x * 1717173651::HUGEINT + ((x % 4294967296) * 3605593784::HUGEINT % 4294967296) * 4294967296) % 18446744073709551616::HUGEINT AS y FROM first),
hashes AS (SELECT word, n, key, (y // 4294967296) * 4294967296 + xor(y // 4294967296, y % 4294967296) AS hash FROM product)""".replace("1717173651", str(0x6659FD93)).replace("3605593784", str(0xD6E8FEB8))


def _points(n: int):
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.ascii(F.substring(F.col("word"), i, F.lit(1))))


def _part_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query(f"WITH {_KEYS} SELECT word, n::INT AS n, key::VARCHAR AS key, hash::VARCHAR AS hash FROM hashes")
def gate_keys(spark, sf_dir):
    w = _part_words(spark, sf_dir)
    both = [w.where(F.length("word") >= n).select("word", F.lit(n).alias("n"), gates.gate_key(_points(n)).alias("key")) for n in (2, 3)]
    out = both[0].unionByName(both[1])
    return out.select("word", "n", F.col("key").cast("string").alias("key"), gates.gate_hash(F.col("key")).cast("string").alias("hash"))


@query(f"WITH {_KEYS} SELECT DISTINCT (hash % 131072)::INT AS bit FROM hashes WHERE n = 3")
def prefix_filter(spark, sf_dir):
    return gates.prefix_bits(_part_words(spark, sf_dir))


@query(f"WITH {mq._W_SQL}, {sql.fnv('w', 'feature')} SELECT hash::VARCHAR AS hash, feature, o, b, m, e, s FROM w JOIN hashed USING (feature)")
def feature_records(spark, sf_dir):
    return gates.records(mq.weight_table(spark), tx.fnv1a64).withColumn("hash", F.col("hash").cast("string"))


_CLASS_LIST = "['HAN', 'DIGIT', 'LATIN', 'SPACE', 'PUNCT', 'OTHER', '<'"


@query(f"""WITH {mq._W_SQL}, three AS (SELECT * FROM (SELECT unnest({_CLASS_LIST}, '<BOS1>']) AS before) CROSS JOIN (SELECT unnest({_CLASS_LIST}]) AS own) CROSS JOIN (SELECT unnest({_CLASS_LIST}, '<EOS1>']) AS after)),
named AS (SELECT *, unnest(['bias', 'k0=' || own, 'k-1=' || before, 'k+1=' || after, 'k-1k0=' || before || ':' || own, 'k0k+1=' || own || ':' || after]) AS feature FROM three)
SELECT before, own, after, {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in "obmes")} FROM named LEFT JOIN w USING (feature) GROUP BY before, own, after""")
def class_contexts(spark, sf_dir):
    return features.contexts(mq.weight_table(spark))


# --- lexicons


@query(sql.base(sql.LEXICON, sql.MATCHES) + """, p AS (SELECT sid, start, "end", unnest(range(start, "end"))::INT AS pos FROM matches)
SELECT sid, pos, bit_or(1 << (CASE WHEN "end" - start = 1 THEN 3 WHEN pos = start THEN 0 WHEN pos = "end" - 1 THEN 2 ELSE 1 END * 4 + least("end" - start, 5) - 2)::INT)::INT AS mask FROM p GROUP BY sid, pos""")
def lexicon_masks(spark, sf_dir):
    return lx.masks(cq.matches(spark, sf_dir))


@query("""WITH w AS (SELECT p_partkey AS line, p_brand AS word, p_size::FLOAT AS score FROM part), last AS (SELECT word, max(line) AS word_id, arg_max(score, line) AS score FROM w GROUP BY word),
p AS (SELECT word, unnest(range(1, length(word) + 1)) AS n, word_id, score FROM last)
SELECT substring(word, 1, n) AS prefix, max(CASE WHEN n = length(word) THEN word_id END) AS word_id, max(CASE WHEN n = length(word) THEN score END) AS score FROM p GROUP BY 1""")
def lexicon_trie_scored(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return lx.trie(part.select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("word"), F.col("p_size").cast("float").alias("score")))


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT n_name FROM nation) WHERE word NOT LIKE '#%' AND word NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def lexicon_union(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("word"))
    return lx.without(lx.union(_part_words(spark, sf_dir), part.select(F.col("p_brand").alias("word")), nation), nation.where("n_nationkey % 2 = 0"))


_MADE = [a + b for a in nm.NICKNAME_PREFIXES for b in "王李强明"]


@query("SELECT w AS word FROM (VALUES " + ", ".join(f"('{w}')" for w in _MADE) + f") t(w) WHERE w NOT IN ({sql.quoted((*nm.RESERVED, *nm.ANCHORS))})")
def reserved_surfaces(spark, sf_dir):
    made = spark.createDataFrame([(w,) for w in _MADE], "word string")
    return lx.without(made, spark.createDataFrame([(w,) for w in (*nm.RESERVED, *nm.ANCHORS)], "word string"))


# --- reports


@query(f"""WITH {mq._SYNTH} SELECT id AS sid, type || ':' || start || ':' || "end" || ':' || word AS shown FROM synth""")
def span_report(spark, sf_dir):
    c = mq.cases(spark, sf_dir).select("sid", "text", F.explode("spans").alias("s"))
    return c.select("sid", evaluate.shown(F.col("text"), F.col("s")).alias("shown"))


@query(sql.base(sql.LEXICON, sql.MATCHES) + """, c AS (SELECT count(*) AS n FROM (SELECT DISTINCT sid, start, "end" FROM matches)), t AS (SELECT sum(length(text))::BIGINT AS chars FROM firsts)
SELECT chars, n AS candidates, round(n * 1000.0::DOUBLE / chars, 6) AS per_1k FROM c, t""")
def candidate_density(spark, sf_dir):
    return evaluate.density(cq.firsts(spark, sf_dir), cq.matches(spark, sf_dir))


@query("SELECT n AS word, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN 'S_PER' ELSE 'B_PER' || repeat(' M_PER', (n - 2)::INT) || ' E_PER' END AS tags FROM (SELECT unnest(range(1, 9)) AS n)")
def entity_tags(spark, sf_dir):
    n = F.col("id")
    return spark.range(1, 9).select(n.alias("word"), F.array_join(tx.entity_tags(F.lit("PER"), n), " ").alias("tags"))


# --- manifests

_INPUTS = "inputs AS (SELECT n_name AS path, sha256(CASE WHEN n_regionkey = 1 THEN 'x' ELSE '' END || n_name) AS sha256 FROM nation WHERE n_nationkey % 3 <> 0), named AS (SELECT n_name AS path, sha256(n_name) AS sha256 FROM nation)"


def _manifest(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    inputs = n.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("path"), F.sha2(F.concat(F.when(F.col("n_regionkey") == 1, "x").otherwise(""), "n_name"), 256).alias("sha256"))
    return n.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256")), inputs


@query(f"WITH {_INPUTS} SELECT path, sha256 FROM named n WHERE EXISTS (SELECT 1 FROM inputs i WHERE i.path = n.path AND i.sha256 = n.sha256)")
def manifest_references(spark, sf_dir):
    return manifests.referenced(*_manifest(spark, sf_dir))


@query(f"WITH {_INPUTS} SELECT path, n.sha256, CASE WHEN i.path IS NULL THEN 'not named' ELSE 'other hash' END AS fault FROM named n LEFT JOIN inputs i USING (path) WHERE i.sha256 IS DISTINCT FROM n.sha256")
def manifest_faults(spark, sf_dir):
    return manifests.unreferenced(*_manifest(spark, sf_dir))


@query("SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier UNION SELECT r_name FROM region")
def manifest_names(spark, sf_dir):
    return manifests.names(*[table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("supplier", "s_name"), ("region", "r_name"))])


@query("""WITH t AS (SELECT item_id::VARCHAR AS name, sha256(text) AS sha, text FROM benchmark WHERE item_id % 2 = 0),
w AS (SELECT item_id::VARCHAR AS name, CASE WHEN item_id % 3 = 0 THEN sha256(text) WHEN item_id % 3 = 1 THEN sha256('other') END AS sha, CASE WHEN item_id % 5 = 0 THEN 'no such marker' ELSE substring(text, 3, 4) END AS marker FROM benchmark)
SELECT name, CASE WHEN t.text IS NULL THEN 'missing' WHEN w.sha <> t.sha THEN 'other hash' WHEN NOT contains(t.text, marker) THEN 'no marker' END AS fault FROM w LEFT JOIN t USING (name) WHERE t.text IS NULL OR w.sha <> t.sha OR NOT contains(t.text, marker)""")
def licence_gate(spark, sf_dir):
    i, b = F.col("item_id"), table(spark, sf_dir, "benchmark")
    name = i.cast("string").alias("name")
    texts = b.where(i % 2 == 0).select(name, F.sha2("text", 256).alias("sha256"), "text")
    sha = F.when(i % 3 == 0, F.sha2("text", 256)).when(i % 3 == 1, F.sha2(F.lit("other"), 256))
    return manifests.licences(texts, b.select(name, sha.alias("sha256"), F.when(i % 5 == 0, "no such marker").otherwise(F.expr("substring(text, 3, 4)")).alias("marker")))


# --- prompts

_TYPES = ", ".join(schema.ENTITY_TYPES) + "."


def _prompt_sql(start: str, item: str) -> str:
    text = (start + _TYPES).replace("'", "''")
    return f"""SELECT batch, count(*) AS n, sha256('{text}' || chr(10) || 'Rows: [' || string_agg(to_json({item})::VARCHAR, ',' ORDER BY id) || ']') AS prompt FROM r GROUP BY batch"""


_ROWS = "r AS (SELECT doc_id AS id, (doc_id // 8)::BIGINT AS batch, source AS text FROM documents)"


def _batched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("text"))
    return corpus.batches(d, 8, "id")


@query(f"WITH {_ROWS} " + _prompt_sql(prompts.LABEL, "{'id': id, 'text': text}"))
def prompt_batches(spark, sf_dir):
    return prompts.prompts(_batched(spark, sf_dir)).withColumn("prompt", F.sha2("prompt", 256))


@query(f"WITH {_ROWS} " + _prompt_sql(prompts.REVIEW, "{'id': id, 'text': text, 'entities': [{'start': 0, 'end': length(text)::INT, 'type': 'ORG'}]}"))
def review_prompts(spark, sf_dir):
    rows = _batched(spark, sf_dir).withColumn("entities", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("ORG").alias("type"))))
    return prompts.prompts(rows, builder=prompts.reviewing, columns=("id", "text", "entities")).withColumn("prompt", F.sha2("prompt", 256))


@query("SELECT doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' END AS fault FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE l.doc_id IS NULL")
def key_sets(spark, sf_dir):
    """Keys that stand on one side only; `labels.require_none` makes this an assertion."""
    asked, said = (table(spark, sf_dir, t).select(F.col("doc_id").alias("id")).distinct() for t in ("documents", "labels"))
    return labels.complete(asked, said)


@query("SELECT d.doc_id, source, place FROM documents d JOIN (SELECT DISTINCT doc_id, (doc_id * 7 % 101)::BIGINT AS place FROM labels) l USING (doc_id)")
def review_order(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 7 % 101).alias("place")).distinct()
    return corpus.keep_order(wanted, table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "place").select("doc_id", "source", "place")


@query("WITH w(feature, state, weight) AS (VALUES " + ", ".join(f"('{f}', '{s}', {w} / 1000000)" for f, s, w in mq.WEIGHTS) + ") SELECT feature, state, round(weight, 6) AS weight FROM w WHERE abs(weight) >= 0.5")
def weights_pruned(spark, sf_dir):
    w = spark.createDataFrame(list(mq.WEIGHTS), "feature string, state string, weight long").withColumn("weight", F.col("weight") / 1_000_000)
    return features.prune(w, 0.5)
