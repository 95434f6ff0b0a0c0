"""Queries over synthetic rows, taggers, candidates and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import text as tx
from spanforge.operators import candidates as cn
from spanforge.operators import evaluate as ev
from spanforge.operators import features as ft
from spanforge.operators import gates as gt
from spanforge.operators import hmm, labels, perceptron, provider, split, synth, tags, viterbi
from spanforge.operators import lexicon as lx
from spanforge.operators import names as nm
from spanforge.plans import corpus_queries as cq
from spanforge.plans import sql
from spanforge.plans.corpus_queries import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(statement: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if statement:
            ORACLE[f.__name__] = statement
        return f

    return put


# --- synthetic rows -------------------------------------------------------

#: kind: table, column, templates.
KINDS = {
    "LOC": ("nation", "n_name", ["we flew to {word} today", "{word} signed the treaty"]),
    "BRAND": ("part", "p_brand", ["they sell {word} here", "{word} is on sale"]),
    "ORG": ("supplier", "s_name", ["a report by {word} came out", "{word} opened an office"]),
    "PER": ("customer", "c_name", ["we met {word} there", "{word} spoke first"]),
}


def words_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    t, c, _ = KINDS[kind]
    return table(spark, sf_dir, t).select(F.replace(F.col(c), F.lit(" "), F.lit("-")).alias("word")).distinct()


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, (_, _, templates) in KINDS.items():
        part = synth.from_templates(words_of(spark, sf_dir, kind), templates, kind, "synth")
        out = part if out is None else out.unionByName(part)
    return out


_SYNTH = ",\n".join(
    [
        "tpl(kind, template) AS (VALUES " + ", ".join(f"('{k}', '{t}')" for k, (_, _, ts) in KINDS.items() for t in ts) + ")",
        "w AS (" + " UNION ".join(f"SELECT '{k}' AS kind, replace({c}, ' ', '-') AS word FROM {t}" for k, (t, c, _) in KINDS.items()) + ")",
        """synth AS (SELECT sha256('synth-text' || chr(0) || replace(template, '{word}', word))[1:20] AS id, sha256('synth-group' || chr(0) || word)[1:20] AS group_id, replace(template, '{word}', word) AS text, word,
  (strpos(replace(template, '{word}', word), word) - 1)::INT AS start, (strpos(replace(template, '{word}', word), word) - 1 + length(word))::INT AS "end", w.kind AS type FROM w JOIN tpl ON w.kind = tpl.kind)""",
    ]
)


@query(f'WITH {_SYNTH} SELECT id, group_id, text, start, "end", type FROM synth')
def synth_rows(spark, sf_dir):
    return synthetic(spark, sf_dir)


_RANK = "SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT replace({c}, ' ', '-') AS word FROM {t})"


@query(f"WITH n AS ({_RANK.format(c='n_name', t='nation')}), t(k, template) AS (VALUES (0, 'we flew to {{word}} today'), (1, '{{word}} signed the treaty')) SELECT replace(template, '{{word}}', word) AS text, (strpos(replace(template, '{{word}}', word), word) - 1)::INT AS start FROM n JOIN t ON i % 2 = k")
def synth_round_robin(spark, sf_dir):
    return synth.from_templates(synth.numbered(words_of(spark, sf_dir, "LOC")), KINDS["LOC"][2], "LOC", "rr", both=False).select("text", "start")


SHAPE = ["PER", " went to ", "LOC", " and joined ", "ORG"]


@query(f"""WITH p AS ({_RANK.format(c='c_name', t='customer')}), l AS ({_RANK.format(c='n_name', t='nation')}), o AS ({_RANK.format(c='s_name', t='supplier')}),
x AS (SELECT i, p.word AS a, l.word AS b, o.word AS c FROM p JOIN l USING (i) JOIN o USING (i) WHERE i < 300),
y AS (SELECT a || ' went to ' || b || ' and joined ' || c AS text, length(a) AS na, length(b) AS nb, length(c) AS nc FROM x)
SELECT text, unnest([0, na + 9, na + 9 + nb + 12])::INT AS start, unnest([na, na + 9 + nb, na + 9 + nb + 12 + nc])::INT AS "end", unnest(['PER', 'LOC', 'ORG']) AS type FROM y""")
def synth_combined(spark, sf_dir):
    c = synth.combined(*[words_of(spark, sf_dir, k) for k in ("PER", "LOC", "ORG")], 300, SHAPE)
    return c.select("text", F.inline("spans"))


@query("WITH b AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT text FROM benchmark)) SELECT sha256(text) AS text, (500 // k + (i < 500 % k)::INT)::BIGINT AS n FROM b")
def negatives(spark, sf_dir):
    samples = synth.numbered(table(spark, sf_dir, "benchmark").select(F.col("text").alias("word")).distinct())
    return synth.repeated(samples, 500).groupBy(F.sha2("word", 256).alias("text")).agg(F.count("*").alias("n"))


@query(f"""WITH n AS ({_RANK.format(c='n_name', t='nation')}), s(k, suffix) AS (VALUES (0, ' Bank'), (1, ' University'), (2, ' Labs')),
x AS (SELECT i, CASE WHEN word LIKE '%\\_1' ESCAPE '\\' AND length(word) >= 4 THEN word[1 : length(word) - 2] ELSE word END AS stem FROM n)
SELECT stem || suffix AS word, min(i) AS i FROM x JOIN s ON i % 3 = k WHERE length(stem) >= 2 GROUP BY 1""")
def org_construct(spark, sf_dir):
    return synth.organisations(synth.numbered(words_of(spark, sf_dir, "LOC")), ["_1"], [" Bank", " University", " Labs"], [], 10_000)


@query("SELECT p || r_name AS word FROM region, (VALUES ('x'), ('y')) t(p) WHERE p || r_name <> 'xASIA'")
def nickname_construct(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("word"))
    return synth.nicknames(r, ["x", "y"], spark.createDataFrame([("xASIA",)], "word string"))


_CN_WORDS = ("王明", "陆军", "李小龙", "和平", "北京", "南湖区", "小区", "人民医院", "市", "王国", "上海", "abc", "东湖市", "张", "赵钱孙李周", "长沙县法院", "云")


def _ends(words) -> str:
    return "(" + " OR ".join(f"ends_with(word, '{w}')" for w in words) + ")"


_HAN_ONLY = "regexp_full_match(word, '[\\x{3400}-\\x{9fff}]+')"


@query("WITH w(word) AS (VALUES " + ", ".join(f"('{w}')" for w in _CN_WORDS) + f""") SELECT word, length(word) BETWEEN 2 AND 4 AND {_HAN_ONLY} AND word[1] IN ({sql.quoted(nm.SURNAMES)}) AND word NOT IN ({sql.quoted(nm.PERSON_STOP)}) AS person,
length(word) BETWEEN 2 AND 8 AND {_HAN_ONLY} AND word NOT IN ({sql.quoted(nm.PLACE_STOP)}) AND NOT {_ends(nm.PLACE_BAD_SUFFIXES)} AND (word IN ({sql.quoted(nm.CORE_PLACES)}) OR {" OR ".join(f"(ends_with(word, '{x}') AND length(word) > {len(x)})" for x in nm.PLACE_SUFFIXES)}) AS place FROM w""")
def name_predicates(spark, sf_dir):
    w = F.col("word")
    return spark.createDataFrame([(x,) for x in _CN_WORDS], "word string").select(
        "word", synth.is_person(w, nm.SURNAMES, list(nm.PERSON_STOP)).alias("person"), synth.is_place(w, list(nm.PLACE_SUFFIXES), list(nm.CORE_PLACES), list(nm.PLACE_STOP), list(nm.PLACE_BAD_SUFFIXES)).alias("place")
    )


# --- tags -------------------------------------------------------------------

#: Types of the synthetic rows.
TYPES = tuple(KINDS)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic(spark, sf_dir).select(F.col("id").alias("sid"), "group_id", "text", F.array(F.struct("start", "end", "type")).alias("spans"))


_TAGGED = """tagged AS (SELECT id AS sid, pos, text[pos + 1] AS ch, CASE WHEN pos < start OR pos >= "end" THEN 'O' WHEN "end" - start = 1 THEN 'S_' || type WHEN pos = start THEN 'B_' || type WHEN pos = "end" - 1 THEN 'E_' || type ELSE 'M_' || type END AS tag
  FROM (SELECT *, unnest(range(0, length(text)))::INT AS pos FROM synth))"""


@query(f"WITH {_SYNTH}, {_TAGGED} SELECT sid, pos, tag FROM tagged")
def bmes_encode(spark, sf_dir):
    return tags.exploded(cases(spark, sf_dir)).select("sid", "pos", "tag")


@query(f'WITH {_SYNTH} SELECT id AS sid, start, "end", type, true AS legal FROM synth')
def bmes_decode_strict(spark, sf_dir):
    t = cases(spark, sf_dir).select("sid", tags.spans_to_tags(F.col("text"), F.col("spans")).alias("tags"))
    return t.select("sid", tags.legal(F.col("tags")).alias("legal"), F.inline(tags.tags_to_spans(F.col("tags"))))


@query(f"""WITH {_SYNTH}, {_TAGGED} SELECT s.id AS sid, start, "end", type FROM synth s WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.sid = s.id AND t.pos = 12 AND t.tag <> 'O')""")
def bmes_decode_lenient(spark, sf_dir):
    """Tags with place 12 broken to O: spans that reach over it are no longer well formed."""
    t = cases(spark, sf_dir).select("sid", tags.spans_to_tags(F.col("text"), F.col("spans")).alias("tags"))
    broken = F.transform("tags", lambda x, i: F.when(i == 12, "O").otherwise(x))
    return t.select("sid", F.inline(tags.tags_to_spans(broken)))


@query(f"""WITH {_SYNTH} SELECT text, start || ':' || "end" || ':' || type AS encoded FROM synth""")
def span_encode_tsv(spark, sf_dir):
    return cases(spark, sf_dir).select("text", labels.encode(F.col("spans")).alias("encoded"))


# --- splits -----------------------------------------------------------------


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with the split of their group; the type of a case is its source."""
    rows = cases(spark, sf_dir).withColumn("source", F.col("spans")[0]["type"])
    return rows.join(split.by_group(rows), ["source", "group_id"]).select("sid", "source", "group_id", "text", "spans", "split")


_GROUPED = """g AS (SELECT source, group_id, count(*) AS n, sha256(group_id) AS h FROM rows GROUP BY source, group_id),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, h) AS i, sum(n) OVER (PARTITION BY source) AS total FROM g),
f AS (
  SELECT source, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, '' AS split FROM (SELECT DISTINCT source FROM rows)
  UNION ALL
  SELECT source, i, a + CASE WHEN k = 'train' THEN n ELSE 0 END, b + CASE WHEN k = 'dev' THEN n ELSE 0 END, c + CASE WHEN k = 'test' THEN n ELSE 0 END, k FROM (
    SELECT *, CASE WHEN x <= y AND x <= z THEN 'train' WHEN y <= z THEN 'dev' ELSE 'test' END AS k FROM (
      SELECT f.source, o.i, f.a, f.b, f.c, o.n, (f.a + o.n) / greatest(1.0::DOUBLE, o.total * 0.8::DOUBLE) AS x, (f.b + o.n) / greatest(1.0::DOUBLE, o.total * 0.1::DOUBLE) AS y, (f.c + o.n) / greatest(1.0::DOUBLE, o.total * 0.1::DOUBLE) AS z
      FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1))
),
put AS (SELECT o.source, o.group_id, o.n, f.split FROM o JOIN f ON f.source = o.source AND f.i = o.i)"""
_SYNTH_SPLIT = f"WITH RECURSIVE {_SYNTH}, rows AS (SELECT id, type AS source, group_id, text FROM synth), {_GROUPED}"


@query(_SYNTH_SPLIT + " SELECT source, group_id, n::BIGINT AS n, split FROM put")
def group_split(spark, sf_dir):
    rows = synthetic(spark, sf_dir).withColumnRenamed("type", "source")
    return split.by_group(rows).select("source", "group_id", "n", "split")


@query(_SYNTH_SPLIT + " SELECT split, count(*) AS sentences, count(DISTINCT rows.group_id) AS groups, sum(length(text))::BIGINT AS chars, count(*) AS entities FROM rows JOIN put USING (source, group_id) GROUP BY split")
def split_stats(spark, sf_dir):
    return split.statistics(split_rows(spark, sf_dir))


@query(_SYNTH_SPLIT + " SELECT split, source AS type, count(*) AS n FROM rows JOIN put USING (source, group_id) GROUP BY ROLLUP (split, source)")
def split_type_counts(spark, sf_dir):
    return split.type_counts(split_rows(spark, sf_dir))


@query("SELECT source AS group_id, count(DISTINCT lang) AS n_splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def group_leakage(spark, sf_dir):
    return split.leaks(table(spark, sf_dir, "documents").select(F.col("source").alias("group_id"), F.col("lang").alias("split")))


@query("""WITH w AS (SELECT word, sha256('17:' || word) AS h FROM (SELECT DISTINCT p_name AS word FROM part)), r AS (SELECT word, row_number() OVER (ORDER BY h, word) - 1 AS i, count(*) OVER () AS n FROM w)
SELECT word, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'dev' ELSE 'test' END AS split FROM r""")
def surface_split(spark, sf_dir):
    return split.surfaces(table(spark, sf_dir, "part").select(F.col("p_name").alias("word")), 10_000, 17)


@query("""WITH a AS (SELECT text, lang AS split FROM documents WHERE source IN ('src0', 'src1')), b AS (SELECT text, lang AS split FROM documents WHERE source NOT IN ('src0', 'src1')), s AS (SELECT text, min(split) AS split FROM a GROUP BY text)
SELECT split, 'first' AS origin, false AS conflict, count(*) AS n FROM a GROUP BY split UNION ALL SELECT b.split, 'more', s.split IS NOT NULL, count(*) FROM b LEFT JOIN s ON s.text = b.text WHERE s.split IS NULL OR s.split <> b.split GROUP BY ALL""")
def merge_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text", F.col("lang").alias("split"), "source")
    own = F.col("source").isin("src0", "src1")
    return split.merged(d.where(own).drop("source"), d.where(~own).drop("source")).groupBy("split", "origin", "conflict").agg(F.count("*").alias("n"))


@query(f"""WITH {_SYNTH}, k AS (SELECT type, count(*) AS n FROM synth GROUP BY type)
SELECT (SELECT count(*) FROM synth) AS rows, (SELECT count(DISTINCT group_id) FROM synth) AS groups, (SELECT '{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}}' FROM k) AS types, 'synth' AS name""")
def manifest_counts(spark, sf_dir):
    from spanforge.sources.sinks import manifest

    return manifest(cases(spark, sf_dir), name="synth")


# --- hidden Markov model ------------------------------------------------------

_STATES = schema.states(TYPES)
_MOVES = [(a, b) for a in _STATES for b in _STATES if schema.may_follow(a, b)]
_S_SQL = "states(state, ord) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(_STATES)) + ")"
_M_SQL = "moves(prev, state) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MOVES) + ")"
_START = [s for s in _STATES if schema.may_start(s)]
_END = [s for s in _STATES if schema.may_end(s)]
_TRAIN = f"""{_SYNTH}, rows AS (SELECT id, type AS source, group_id, text FROM synth), {_GROUPED},
{_TAGGED}, learn AS (SELECT t.* FROM tagged t JOIN rows r ON r.id = t.sid JOIN put p ON p.source = r.source AND p.group_id = r.group_id WHERE p.split = 'train'),
{_S_SQL}, {_M_SQL},
first_tags AS (SELECT tag AS state, count(*) AS n FROM learn WHERE pos = 0 GROUP BY tag),
hstart AS (SELECT state, round(ln((coalesce(n, 0) + 0.1::DOUBLE) / (sum(coalesce(n, 0)) OVER () + 0.1::DOUBLE * {len(_START)})) * 1000000)::BIGINT AS logp FROM states LEFT JOIN first_tags USING (state) WHERE state IN ({sql.quoted(_START)})),
pairs AS (SELECT lag(tag) OVER (PARTITION BY sid ORDER BY pos) AS prev, tag AS state FROM learn), seen AS (SELECT prev, state, count(*) AS n FROM pairs WHERE prev IS NOT NULL GROUP BY ALL),
htransition AS (SELECT m.prev, m.state, round(ln((coalesce(n, 0) + 0.1::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY m.prev) + 0.1::DOUBLE * count(*) OVER (PARTITION BY m.prev))) * 1000000)::BIGINT AS logp FROM moves m LEFT JOIN seen s ON s.prev = m.prev AND s.state = m.state),
counts AS (SELECT tag AS state, ch, count(*) AS n FROM learn GROUP BY ALL), v AS (SELECT count(DISTINCT ch) AS v FROM learn),
totals AS (SELECT s.state, coalesce(sum(n), 0)::BIGINT AS t, any_value(v.v) AS v FROM states s LEFT JOIN counts c ON c.state = s.state CROSS JOIN v GROUP BY s.state),
hemission AS (SELECT c.state, ch, round(ln((n + 0.1::DOUBLE) / (t + 0.1::DOUBLE * (v + 1))) * 1000000)::BIGINT AS logp FROM counts c JOIN totals t ON t.state = c.state),
hunknown AS (SELECT state, round(ln(0.1::DOUBLE / (t + 0.1::DOUBLE * (v + 1))) * 1000000)::BIGINT AS logp FROM totals)"""


def trained(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return hmm.train(tags.exploded(split_rows(spark, sf_dir).where("split = 'train'")), TYPES)


@query(f"WITH RECURSIVE {_TRAIN} SELECT state, logp FROM hstart")
def hmm_start(spark, sf_dir):
    return trained(spark, sf_dir)["start"]


@query(f"WITH RECURSIVE {_TRAIN} SELECT prev, state, logp FROM htransition")
def hmm_transition(spark, sf_dir):
    return trained(spark, sf_dir)["transition"]


@query(f"WITH RECURSIVE {_TRAIN} SELECT state, ch AS char, logp FROM hemission UNION ALL SELECT state, NULL, logp FROM hunknown")
def hmm_emission(spark, sf_dir):
    m = trained(spark, sf_dir)
    return m["emission"].unionByName(m["unknown"].withColumn("char", F.lit(None).cast("string")))


_DECODED = f"""{_TRAIN}, dev AS (SELECT r.id AS sid, r.text FROM rows r JOIN put p ON p.source = r.source AND p.group_id = r.group_id WHERE p.split = 'dev'),
walk AS (
  SELECT sid, text, 1 AS i, h.state, h.logp + coalesce((SELECT logp FROM hemission e WHERE e.state = h.state AND e.ch = text[1]), (SELECT logp FROM hunknown u WHERE u.state = h.state)) AS score, [h.state] AS path FROM dev, hstart h
  UNION ALL
  SELECT sid, text, i, state, score, path FROM (
    SELECT w.sid, w.text, w.i + 1 AS i, t.state, w.score + t.logp + coalesce(e.logp, u.logp) AS score, list_append(w.path, t.state) AS path,
      row_number() OVER (PARTITION BY w.sid, t.state ORDER BY w.score + t.logp DESC, s.ord) AS r
    FROM walk w JOIN htransition t ON t.prev = w.state JOIN states s ON s.state = w.state JOIN hunknown u ON u.state = t.state LEFT JOIN hemission e ON e.state = t.state AND e.ch = w.text[w.i + 1] WHERE w.i < length(w.text)) WHERE r = 1
),
best AS (SELECT sid, path FROM (SELECT w.*, row_number() OVER (PARTITION BY sid ORDER BY score DESC, ord) AS r FROM walk w JOIN states s ON s.state = w.state WHERE i = length(text) AND w.state IN ({sql.quoted(_END)})) WHERE r = 1),
flat AS (SELECT sid, unnest(range(0, len(path)))::INT AS pos, unnest(path) AS tag FROM best),
pred AS (SELECT b.sid, b.pos AS start, (min(e.pos) + 1)::INT AS "end", b.tag[3:] AS type FROM flat b JOIN flat e ON e.sid = b.sid AND e.pos > b.pos AND e.tag LIKE 'E%' WHERE b.tag LIKE 'B%' GROUP BY ALL UNION ALL SELECT sid, pos, pos + 1, tag[3:] FROM flat WHERE tag LIKE 'S%')"""


def decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gold cases of dev, predicted spans)."""
    dev = split_rows(spark, sf_dir).where("split = 'dev'")
    decode = hmm.decoder(trained(spark, sf_dir), TYPES)
    return dev, dev.select("sid", decode("text").alias("tags")).select("sid", F.inline(tags.tags_to_spans(F.col("tags"))))


@query(f'WITH RECURSIVE {_DECODED} SELECT sid, start, "end", type FROM pred')
def hmm_decode(spark, sf_dir):
    return decoded(spark, sf_dir)[1]


_MATCHED = f"""{_DECODED}, gold AS (SELECT id AS sid, start, "end", type FROM synth WHERE id IN (SELECT sid FROM dev)),
m AS (SELECT coalesce(g.sid, p.sid) AS sid, coalesce(g.type, p.type) AS type, (g.sid IS NOT NULL AND p.sid IS NOT NULL)::BIGINT AS tp, (g.sid IS NULL)::BIGINT AS fp, (p.sid IS NULL)::BIGINT AS fn
  FROM gold g FULL JOIN (SELECT DISTINCT * FROM pred) p ON g.sid = p.sid AND g.start = p.start AND g."end" = p."end" AND g.type = p.type)"""
_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1"


def _scored(spark, sf_dir):
    dev, pred = decoded(spark, sf_dir)
    return dev, dev.select("sid", F.inline("spans")), pred


@query(f"WITH RECURSIVE {_MATCHED}, c AS (SELECT coalesce(type, 'ALL') AS type, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM m GROUP BY ROLLUP (type)) SELECT *, {_PRF} FROM c")
def eval_prf(spark, sf_dir):
    _, gold, pred = _scored(spark, sf_dir)
    return ev.scores(gold, pred)


_EXT = f"""WITH RECURSIVE {_MATCHED}, c AS (SELECT d.sid, length(d.text) AS chars, coalesce(sum(tp), 0) AS tp, coalesce(sum(fp), 0) AS fp, coalesce(sum(fn), 0) AS fn FROM dev d LEFT JOIN m ON m.sid = d.sid GROUP BY ALL),
n AS (SELECT count(*) AS sentences, sum(chars)::BIGINT AS chars, sum((fp = 0 AND fn = 0)::INT)::BIGINT AS exact, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum((tp + fn = 0)::INT)::BIGINT AS negatives, sum((tp + fn = 0)::INT * fp)::BIGINT AS negative_fp FROM c),
x AS (SELECT *, {_PRF}, round(exact / sentences, 6) AS exact_rate, round(fp * 1000.0::DOUBLE / chars, 6) AS fp_per_1k FROM n)"""


@query(_EXT + " SELECT * FROM x")
def eval_extended(spark, sf_dir):
    dev, gold, pred = _scored(spark, sf_dir)
    return ev.extended(dev, gold, pred)


#: Floors and ceilings of the legacy gate.
LIMITS = [("precision", ">=", 0.95), ("recall", ">=", 0.60), ("fp_per_1k", "<=", 1.0), ("negative_fp", "<=", 0.0)]


@query(_EXT + " " + " UNION ALL ".join(f"SELECT '{m} {op} {x}' AS gate, {m}::DOUBLE AS value, {x}::DOUBLE AS \"limit\", {m} {op} {x} AS ok FROM x" for m, op, x in LIMITS))
def quality_gate(spark, sf_dir):
    return ev.gates(eval_extended(spark, sf_dir), LIMITS)


@query(f"""WITH {_SYNTH} SELECT DISTINCT id AS sid FROM synth WHERE ("end" - start) % 3 = 0 OR (start = 0 AND ("end" - start) % 3 = 1) ORDER BY sid LIMIT 10""")
def failure_sample(spark, sf_dir):
    """Of all synthetic cases, with every third-length surface missed and a false span in those that start with it."""
    every = cases(spark, sf_dir)
    gold = every.select("sid", F.inline("spans"))
    pred = gold.where((F.col("end") - F.col("start")) % 3 != 0).unionByName(gold.where((F.col("start") == 0) & ((F.col("end") - F.col("start")) % 3 == 1)).withColumn("end", F.col("end") + 1))
    return ev.failures(every, gold, pred, 10).select("sid")


# --- features, weights, Viterbi -------------------------------------------------

#: A small weight table in millionths: (feature, state, weight).
WEIGHTS = (
    ("bias", "O", 400000), ("k0=SPACE", "O", 3000000), ("k0=PUNCT", "O", 2500000), ("k0=DIGIT", "S", 700000), ("k-1=SPACE", "B", 900000), ("k+1=SPACE", "E", 850000), ("k-1k0=LATIN:LATIN", "M", 520000), ("k-1k0=LATIN:LATIN", "E", 410000),
    ("k0k+1=LATIN:LATIN", "B", 430000), ("k0k+1=LATIN:LATIN", "M", 470000), ("c0=t", "B", 350000), ("c0=e", "E", 330000), ("c-1c0=th", "M", 610000), ("c0c+1=th", "B", 930000), ("c-2c-1c0=the", "E", 7300000), ("c0c+1c+2=the", "B", 7600000), ("c-1c0=er", "E", 7200000),
    ("c0c+1=er", "B", 7100000), ("c0c+1=un", "B", 8100000), ("c0c+1c+2=un ", "S", 250000), ("c-1=<BOS1>", "B", 200000), ("c+1=<EOS1>", "O", 150000), ("c0=.", "O", 900000), ("c-2c-1c0=<BOS2><BOS1>T", "B", 7050000), ("k0=LATIN", "O", 610000),
)
TRANSITIONS = {("<START>", "B"): 100000, ("O", "B"): -200000, ("B", "M"): 150000, ("M", "M"): 50000, ("M", "E"): 120000, ("E", "O"): 90000, ("B", "E"): -60000, ("S", "O"): 20000}


def weight_table(spark: SparkSession) -> DataFrame:
    return ft.wide(spark.createDataFrame(list(WEIGHTS), "feature string, state string, weight long"))


_W_SQL = "wlong(feature, state, weight) AS (VALUES " + ", ".join(f"('{f}', '{s}', {w})" for f, s, w in WEIGHTS) + "), w AS (SELECT feature, " + ", ".join(f"coalesce(sum(weight) FILTER (WHERE state = '{s}'), 0)::BIGINT AS {s.lower()}" for s in "OBMES") + " FROM wlong GROUP BY feature)"


def _char(d: int) -> str:
    return f"CASE WHEN pos + {d} < 0 THEN '<BOS' || (-(pos + {d})) || '>' WHEN pos + {d} >= length(text) THEN '<EOS' || (pos + {d} - length(text) + 1) || '>' ELSE text[pos + {d} + 1] END AS c{d + 2}"


_FEATURES = f"""chars AS (SELECT sid, text, unnest(range(0, length(text)))::INT AS pos FROM firsts),
ctx AS (SELECT sid, pos, {", ".join(_char(d) for d in range(-2, 3))} FROM chars),
cls AS (SELECT *, {", ".join(sql.class_of(f"c{i}", f"unicode(c{i})") + f" AS k{i}" for i in (1, 2, 3))} FROM ctx),
feats AS (SELECT sid, pos, unnest(['bias', 'c0=' || c2, 'c-1=' || c1, 'c+1=' || c3, 'c-2=' || c0, 'c+2=' || c4, 'c-1c0=' || c1 || c2, 'c0c+1=' || c2 || c3, 'c-2c-1c0=' || c0 || c1 || c2, 'c0c+1c+2=' || c2 || c3 || c4,
  'k0=' || k2, 'k-1=' || k1, 'k+1=' || k3, 'k-1k0=' || k1 || ':' || k2, 'k0k+1=' || k2 || ':' || k3]) AS feature FROM cls)"""
_EMIT = f"""{_FEATURES}, {_W_SQL}, em AS (SELECT f.sid, f.pos, {", ".join(f"coalesce(sum(w.{s}), 0)::BIGINT AS {s}" for s in "obmes")} FROM feats f LEFT JOIN w ON w.feature = f.feature GROUP BY f.sid, f.pos)"""


@query(sql.base(_FEATURES) + " SELECT feature, count(*) AS n FROM feats GROUP BY feature")
def char_features(spark, sf_dir):
    return ft.char_features(cq.firsts(spark, sf_dir)).groupBy("feature").agg(F.count("*").alias("n"))


def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.in_text(ft.scored(cq.firsts(spark, sf_dir), weight_table(spark))).select("sid", "pos", "o", "b", "m", "e", "s")


@query(sql.base(_EMIT) + " SELECT sid, pos, o, b, m, e, s FROM em")
def emission_scores(spark, sf_dir):
    return emitted(spark, sf_dir)


_T = lambda p, c: TRANSITIONS.get((p, c), 0)
_ORDER = {"O": 0, "S": 1, "E": 2, "B": 3, "M": 4}
_PATHS = _EMIT + ", tr(prev, state, t, ord) AS (VALUES " + ", ".join(f"('{viterbi.STATES[p]}', '{viterbi.STATES[c]}', {_T(viterbi.STATES[p], viterbi.STATES[c])}, {_ORDER[viterbi.STATES[p]]})" for c, ps in enumerate(viterbi.BEFORE) for p in ps) + "), st(state, t) AS (VALUES " + ", ".join(f"('{s}', {_T('<START>', s)})" for s in "OBS") + """),
el AS (SELECT sid, pos, unnest(['O', 'B', 'M', 'E', 'S']) AS state, unnest([o, b, m, e, s]) AS x FROM em),
walk AS (
  SELECT el.sid, el.pos, el.state, el.x + st.t AS score, el.state AS path FROM el JOIN st ON st.state = el.state WHERE el.pos = 0
  UNION ALL
  SELECT sid, pos, state, score, path FROM (
    SELECT w.sid, el.pos, el.state, w.score + tr.t + el.x AS score, w.path || el.state AS path, row_number() OVER (PARTITION BY w.sid, el.state ORDER BY w.score + tr.t DESC, tr.ord) AS r
    FROM walk w JOIN tr ON tr.prev = w.state JOIN el ON el.sid = w.sid AND el.pos = w.pos + 1 AND el.state = tr.state) WHERE r = 1
),
last AS (SELECT sid, max(pos) AS pos FROM em GROUP BY sid),
best AS (SELECT sid, path AS tags FROM (SELECT w.*, row_number() OVER (PARTITION BY w.sid ORDER BY score DESC, CASE state WHEN 'O' THEN 0 WHEN 'E' THEN 1 ELSE 2 END) AS r FROM walk w JOIN last l ON l.sid = w.sid AND l.pos = w.pos WHERE state IN ('O', 'E', 'S')) WHERE r = 1)"""


@query(sql.base(_PATHS) + " SELECT sid, tags FROM best")
def viterbi_decode(spark, sf_dir):
    rows = ft.by_sentence(ft.scored(cq.firsts(spark, sf_dir), weight_table(spark)))
    return rows.select("sid", viterbi.fold(F.col("scores"), TRANSITIONS).alias("tags"))


@query(sql.base(_PATHS) + " SELECT sid, tags FROM best")
def viterbi_arrow(spark, sf_dir):
    """The same by the decoder for rows of any length, on emissions that come as rows of features."""
    em = ft.emissions(ft.char_features(cq.firsts(spark, sf_dir)), weight_table(spark))
    return viterbi.decode(ft.score_rows(em), TRANSITIONS)


# --- candidates -----------------------------------------------------------------


def bad_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"b{i:02d}", t, s) for i, (t, s) in enumerate(nm.BAD_CASES)], "sid string, text string, encoded string").withColumn("spans", labels.decode(F.col("encoded")))


_BAD = "bad(sid, text) AS (VALUES " + ", ".join(f"('b{i:02d}', '{t}')" for i, (t, _) in enumerate(nm.BAD_CASES)) + ")"


def _values(name: str, words) -> str:
    return f"{name}(w) AS (VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


_CAND = f"""{_BAD}, {_values('place_suffix', nm.PLACE_SUFFIXES)}, {_values('org_suffix', nm.ALL_ORG_SUFFIXES)}, {_values('core', nm.CORE_PLACES_MORE)}, {_values('pstop', nm.PERSON_STARTS)},
places AS (SELECT sid, text, unnest(range(0, length(text)))::INT AS start FROM bad), r AS (SELECT *, text[start + 1 :] AS rest, text[start + 1] AS c FROM places),
per AS (SELECT sid, text, start, start + len AS "end", 'PER' AS kind FROM (SELECT *, unnest(CASE WHEN c IN ({sql.quoted(nm.NICKNAME_PREFIXES)}) AND rest[2] IN ({sql.quoted(nm.SURNAMES)}) THEN [2]
   WHEN c IN ({sql.quoted(nm.SURNAMES)}) AND NOT EXISTS (SELECT 1 FROM pstop WHERE starts_with(rest, w)) THEN CASE WHEN rest[1:2] IN ({sql.quoted(nm.COMPOUND_SURNAMES)}) THEN [2, 3, 4] ELSE [2, 3] END ELSE [] END) AS len FROM r) WHERE len <= length(rest)),
cor AS (SELECT sid, text, start, start + length(w) AS "end", 'LOC' AS kind FROM r JOIN core ON starts_with(rest, w)),
suf AS (SELECT sid, text, (start + length(w) - size)::INT AS start, start + length(w) AS "end", kind FROM (
  SELECT *, unnest(range(greatest(2, length(w) + stem), least(most, start + length(w)) + 1)) AS size FROM (SELECT r.*, w, 1 AS stem, 8 AS most, 'LOC' AS kind FROM r JOIN place_suffix ON starts_with(rest, w) UNION ALL SELECT r.*, w, 2, 20, 'ORG' FROM r JOIN org_suffix ON starts_with(rest, w)))),
c AS (SELECT DISTINCT sid, text, start, "end", kind, text[start + 1 : "end"] AS v FROM (SELECT * FROM per UNION ALL SELECT * FROM cor UNION ALL SELECT * FROM suf)),
ok AS (SELECT * FROM c WHERE regexp_full_match(v, '[\\x{{3400}}-\\x{{9fff}}]+')
  AND NOT (kind = 'LOC' AND (v IN ({sql.quoted(nm.PLACE_STOP_MORE)}) OR {" OR ".join(f"contains(v, '{x}')" for x in nm.PLACE_BAD_FRAGMENTS)} OR {" OR ".join(f"starts_with(v, '{x}')" for x in nm.PLACE_BAD_PREFIXES)}))
  AND NOT (kind IN ('LOC', 'ORG') AND v[1] IN ({sql.quoted(nm.BAD_STARTS)})) AND NOT (kind = 'ORG' AND v IN ({sql.quoted(nm.ORG_STOP)}))),
cand AS (SELECT sid, text, start, "end", list_distinct(list(kind)) AS ks FROM ok GROUP BY sid, text, start, "end")"""


@query(f"""WITH {_CAND} SELECT sid, start, "end"::INT AS "end", concat_ws('+', CASE WHEN list_contains(ks, 'PER') THEN 'PER' END, CASE WHEN list_contains(ks, 'LOC') THEN 'LOC' END, CASE WHEN list_contains(ks, 'ORG') THEN 'ORG' END) AS sources FROM cand""")
def span_candidates(spark, sf_dir):
    return cn.generate(bad_cases(spark)).select("sid", "start", "end", F.array_join("sources", "+").alias("sources"))


_GOLD = "gold(sid, start, e, type) AS (VALUES " + ", ".join(f"('b{i:02d}', {p.split(':')[0]}, {p.split(':')[1]}, '{p.split(':')[2]}')" for i, (_, s) in enumerate(nm.BAD_CASES) if s != "-" for p in s.split(",")) + ")"


@query(f"""WITH {_CAND}, {_GOLD}, h AS (SELECT type, coalesce(list_contains(ks, type), false)::BIGINT AS covered FROM gold g LEFT JOIN cand c ON c.sid = g.sid AND c.start = g.start AND c."end" = g.e)
SELECT coalesce(type, 'ALL') AS type, count(*) AS gold, sum(covered)::BIGINT AS covered, round(sum(covered) / count(*), 6) AS coverage FROM h GROUP BY ROLLUP (type)""")
def candidate_coverage(spark, sf_dir):
    return ev.coverage(bad_cases(spark).select("sid", F.inline("spans")), cn.generate(bad_cases(spark)))


@query(f"""WITH {_CAND}, {_GOLD} SELECT coalesce(g.type, 'NONE') AS label, count(*) AS n FROM cand c LEFT JOIN gold g ON g.sid = c.sid AND g.start = c.start AND g.e = c."end" GROUP BY 1""")
def candidate_labels(spark, sf_dir):
    gold = bad_cases(spark).select("sid", F.inline("spans"))
    return cn.generate(bad_cases(spark)).join(gold, ["sid", "start", "end"], "left").groupBy(F.coalesce("type", F.lit("NONE")).alias("label")).agg(F.count("*").alias("n"))


def _any_sql(test: str, words) -> str:
    return "(" + " OR ".join(test.format(f"'{w}'") for w in words) + ")"


def _longest_sql(words) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(v, '{w}') THEN '{w}'" for w in sorted(words, key=lambda w: (-len(w), w))) + " ELSE '-' END"


def _span_features_sql() -> str:
    out = ["'bias'", "'length=' || length(v)", "'sources=' || shown", "'first=' || v[1]", "'left1=' || lc", "'right1=' || rc", "'left_class=' || lk", "'right_class=' || rk", "CASE WHEN start = 0 THEN 'start=BOS' END", "CASE WHEN \"end\" = length(text) THEN 'end=EOS' END"]
    cues = []
    for k in ("PER", "LOC", "ORG"):
        cues += [f"{_any_sql('ends_with(bf, {})', nm.LEFT_CUES[k])} AS l_{k}", f"{_any_sql('starts_with(af, {})', nm.RIGHT_CUES[k])} AS r_{k}", f"{_any_sql('contains(v, {})', [c for c in nm.LEFT_CUES[k] if len(c) > 1])} AS i_{k}", f"list_contains(ks, '{k}') AS h_{k}"]
        out += [f"CASE WHEN h_{k} AND {test} THEN '{name}={k}' END" for test, name in ((f"l_{k}", "left_cue"), (f"r_{k}", "right_cue"), (f"i_{k}", "contains_left_cue"), (f"l_{k} AND r_{k}", "both_cues"))]
    for k, name, words in (("LOC", "place", nm.PLACE_SUFFIXES), ("ORG", "org", nm.ALL_ORG_SUFFIXES)):
        cues.append(f"{_longest_sql(words)} AS s_{k}")
        out += [f"CASE WHEN h_{k} THEN '{name}_suffix=' || s_{k} END", f"CASE WHEN h_{k} THEN '{name}_stem_length=' || (length(v) - CASE WHEN s_{k} = '-' THEN 0 ELSE length(s_{k}) END) END"]
    cues.append("(" + " + ".join(f"contains(v[1 : length(v) - 1], '{w}')::INT" for w in nm.PLACE_SUFFIXES) + ") AS inner_n")
    cues.append(f"list_contains(ks, 'LOC') AND v IN ({sql.quoted(nm.CORE_PLACES_MORE)}) AS core")
    out += [
        "CASE WHEN h_PER THEN 'per_length=' || length(v) END", "CASE WHEN h_PER THEN 'surname=' || v[1] END", f"CASE WHEN h_PER AND v[1] IN ({sql.quoted(nm.NICKNAME_PREFIXES)}) THEN 'nickname' END", "CASE WHEN h_LOC THEN 'internal_place_suffixes=' || least(inner_n, 3) END",
        "CASE WHEN core THEN 'core_place' END", "CASE WHEN core AND start = 0 THEN 'core_place_at_bos' END", "CASE WHEN core AND l_LOC THEN 'core_place_left_cue' END", "CASE WHEN core AND r_LOC THEN 'core_place_right_cue' END", *[f"CASE WHEN h_{k} THEN 'source={k}' END" for k in ("PER", "LOC", "ORG")],
    ]
    return f"""WITH {_CAND}, near AS (SELECT *, text[start + 1 : "end"] AS v, text[1 : start] AS bf, text["end" + 1 :] AS af, CASE WHEN start = 0 THEN '<BOS1>' ELSE text[start] END AS lc, CASE WHEN "end" >= length(text) THEN '<EOS1>' ELSE text["end" + 1] END AS rc,
  concat_ws('+', CASE WHEN list_contains(ks, 'PER') THEN 'PER' END, CASE WHEN list_contains(ks, 'LOC') THEN 'LOC' END, CASE WHEN list_contains(ks, 'ORG') THEN 'ORG' END) AS shown FROM cand),
classed AS (SELECT *, {sql.class_of("lc", "unicode(lc)")} AS lk, {sql.class_of("rc", "unicode(rc)")} AS rk, {", ".join(cues)} FROM near),
named AS (SELECT unnest([{", ".join(out)}]) AS feature FROM classed)
SELECT feature, count(*) AS n FROM named WHERE feature IS NOT NULL GROUP BY feature"""


@query(_span_features_sql())
def span_features(spark, sf_dir):
    return cn.features(cn.generate(bad_cases(spark))).select("sid", "start", "end", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def span_cases(spark: SparkSession) -> DataFrame:
    gold = bad_cases(spark).select("sid", F.inline("spans"))
    c = cn.features(cn.generate(bad_cases(spark))).join(gold, ["sid", "start", "end"], "left")
    return c.select(F.concat_ws(":", "sid", F.lpad(F.col("start").cast("string"), 3, "0"), F.lpad(F.col("end").cast("string"), 3, "0")).alias("cid"), "features", "sources", F.coalesce("type", F.lit("NONE")).alias("gold"))


@query()
def span_perceptron_train(spark, sf_dir):
    return perceptron.train_spans(span_cases(spark))


@query()
def span_perceptron_decode(spark, sf_dir):
    found = cn.features(cn.generate(bad_cases(spark)))
    return cn.decide(found, perceptron.train_spans(span_cases(spark), epochs=8)).select("sid", F.inline("spans")).select("sid", "start", "end", "type")


_DISJOINT = """ranked AS (SELECT sid, start, "end", word, row_number() OVER (PARTITION BY sid ORDER BY "end" - start DESC, start, "end", word) AS i FROM matches),
fold AS (
  SELECT sid, 0::BIGINT AS i, []::STRUCT(s INT, e INT)[] AS kept FROM (SELECT DISTINCT sid FROM ranked)
  UNION ALL
  SELECT f.sid, r.i, CASE WHEN len(list_filter(f.kept, lambda k: r.start < k.e AND k.s < r."end")) = 0 THEN list_append(f.kept, {s: r.start, e: r."end"}) ELSE f.kept END FROM fold f JOIN ranked r ON r.sid = f.sid AND r.i = f.i + 1
),
done AS (SELECT sid, unnest(kept) AS k FROM (SELECT sid, arg_max(kept, i) AS kept FROM fold GROUP BY sid))"""


@query(sql.base(sql.LEXICON, sql.MATCHES, _DISJOINT) + ' SELECT sid, k.s AS start, k.e AS "end" FROM done')
def span_greedy(spark, sf_dir):
    spans = F.collect_list(F.struct("start", "end", "word"))
    g = cq.matches(spark, sf_dir).groupBy("sid").agg(spans.alias("spans"))
    kept = labels.disjoint(F.col("spans"), [lambda s: -(s["end"] - s["start"]), lambda s: s["start"], lambda s: s["end"], lambda s: s["word"]])
    return g.select("sid", F.inline(kept)).select("sid", "start", "end")


# --- gates and provider -----------------------------------------------------------

_NG = r"""ng AS (SELECT key, CASE WHEN name IN ('c0c+1=', 'c0c+1c+2=') THEN 'left' ELSE 'right' END AS side, len(regexp_extract_all(key, '<(?:BOS|EOS)[12]>|[\s\S]')) AS arity, o, b, m, e, s
  FROM (SELECT *, regexp_extract(feature, '^(c-2c-1c0=|c0c\+1c\+2=|c-1c0=|c0c\+1=)(.*)$', 1) AS name, regexp_extract(feature, '^(c-2c-1c0=|c0c\+1c\+2=|c-1c0=|c0c\+1=)(.*)$', 2) AS key FROM w) WHERE name <> '')"""


@query(f"WITH {_W_SQL}, {_NG} SELECT key, arity::INT AS arity, " + ", ".join(f"coalesce(sum({c}) FILTER (WHERE side = '{d}'), 0)::BIGINT AS {d}_{c}" for d in ("left", "right") for c in "obmes") + " FROM ng GROUP BY key, arity")
def ngram_table(spark, sf_dir):
    return gt.table(weight_table(spark))


_GATE = rf"""{_W_SQL}, {_NG}, d AS (SELECT key, arity, max(greatest(b, s) - o) AS delta, regexp_extract_all(key, '<(?:BOS|EOS)[12]>|[\s\S]') AS u FROM ng GROUP BY key, arity),
ins AS (SELECT key, delta, unnest([u[1] || u[2], u[2] || u[3]]) AS pair FROM d WHERE arity = 3), kept AS (SELECT * FROM d WHERE delta >= 7000000),
pr AS (SELECT key, arity, delta FROM kept WHERE arity = 2 AND key NOT IN (SELECT pair FROM ins WHERE delta >= 7000000)), bt AS (SELECT pair, max({{delta: delta, key: key}}) AS t FROM ins WHERE delta > 0 GROUP BY pair),
gate AS (SELECT key, arity::INT AS arity, delta FROM pr WHERE delta >= 7400000 UNION SELECT CASE WHEN t IS NULL THEN pr.key ELSE t.key END, CASE WHEN t IS NULL THEN arity ELSE 3 END::INT, CASE WHEN t IS NULL THEN delta ELSE t.delta END FROM pr LEFT JOIN bt ON bt.pair = pr.key WHERE delta < 7400000 UNION SELECT key, arity::INT, delta FROM kept WHERE arity = 3)"""


@query(f"WITH {_GATE} SELECT key, arity, delta FROM gate")
def proposal_gate(spark, sf_dir):
    return gt.proposals(weight_table(spark), 7_000_000, 400_000)


@query(f"WITH names AS (SELECT DISTINCT p_name AS feature FROM part), {sql.fnv('names', 'feature')} SELECT (hash % 64)::VARCHAR AS hash, count(*) AS n FROM hashed GROUP BY 1 HAVING count(*) > 1")
def feature_hash_collisions(spark, sf_dir):
    """Part names by six bits of their hash, so that there are collisions."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("feature"))
    found = gt.collisions(names, lambda f: F.pmod(tx.fnv1a64(f), F.lit(64).cast("decimal(20,0)")))
    return found.select(F.col("hash").cast("bigint").cast("string").alias("hash"), "n")


@query("""WITH w AS (SELECT p_brand AS feature, CASE WHEN p_size = 7 THEN 'nan'::DOUBLE WHEN p_size = 8 THEN 'inf'::DOUBLE ELSE p_size % 5 END AS o, p_retailprice * (p_size % 3) AS b FROM part)
SELECT 'repeated' AS rule, count(*) - count(DISTINCT feature) AS broken FROM w UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE NOT isfinite(o) OR NOT isfinite(b)) FROM w UNION ALL SELECT 'empty', count(*) FILTER (WHERE o = 0 AND b = 0) FROM w""")
def weight_consistency(spark, sf_dir):
    size = F.col("p_size")
    o = F.when(size == 7, float("nan")).when(size == 8, float("inf")).otherwise((size % 5).cast("double"))
    return gt.consistency(table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), o.alias("o"), (F.col("p_retailprice") * (size % 3)).alias("b")), ("o", "b"))


_BODY = "(cp BETWEEN 48 AND 57 OR cp BETWEEN 65296 AND 65305 OR cp BETWEEN 65 AND 90 OR cp BETWEEN 97 AND 122 OR cp BETWEEN 192 AND 591 OR cp BETWEEN 880 AND 1327 OR cp BETWEEN 13312 AND 40959 OR cp BETWEEN 131072 AND 191471)"
_SEG = f"""cps AS (SELECT sid, unnest(range(0, length(text)))::INT AS pos, unicode(unnest(string_split(text, ''))) AS cp FROM firsts), bd AS (SELECT *, {_BODY} AS body FROM cps),
hd AS (SELECT *, NOT (body OR (cp IN (183, 45, 8208, 8209, 38, 47) AND coalesce(lag(body) OVER w, false) AND coalesce(lead(body) OVER w, false))) AS hard FROM bd WINDOW w AS (PARTITION BY sid ORDER BY pos)),
rn AS (SELECT *, sum(hard::INT) OVER (PARTITION BY sid ORDER BY pos) AS run FROM hd),
seg AS (SELECT sid, min(pos) AS seg_start, max(pos) + 1 AS seg_end FROM rn WHERE NOT hard GROUP BY sid, run HAVING count(*) >= 2)"""


@query(sql.base(_SEG) + " SELECT sid, seg_start, seg_end::INT AS seg_end FROM seg")
def hard_boundary_segments(spark, sf_dir):
    return provider.segments(cq.firsts(spark, sf_dir))


#: Places where n-grams of the gate start, from two before the text on, and segments that these or words propose.
_PROPOSED = _GATE.replace(f"{_W_SQL}, ", "", 1) + f""", gpos AS (SELECT sid, text, unnest(range(-2, length(text)))::INT AS pos FROM firsts),
gch AS (SELECT sid, pos, {", ".join(_char(d) for d in (0, 1, 2))} FROM gpos),
hits AS (SELECT sid, pos, arity FROM gch JOIN gate ON (arity = 2 AND key = c2 || c3) OR (arity = 3 AND key = c2 || c3 || c4)),
words3 AS (SELECT f.sid, strpos(text[i :], word) + i - 2 AS s, length(word) AS n FROM (SELECT sid, text, unnest(range(1, length(text) + 1)) AS i FROM firsts) f JOIN lexicon l ON length(word) >= 3 AND starts_with(f.text[i :], word)),
wanted AS (SELECT DISTINCT seg.* FROM seg JOIN hits h ON h.sid = seg.sid AND h.pos + h.arity > seg_start AND h.pos < seg_end UNION SELECT DISTINCT seg.* FROM seg JOIN words3 w ON w.sid = seg.sid AND w.s >= seg_start AND w.s + w.n <= seg_end)"""


@query(sql.base(_W_SQL, _SEG, sql.LEXICON, _PROPOSED) + " SELECT sid, seg_start, seg_end::INT AS seg_end FROM wanted")
def segment_proposals(spark, sf_dir):
    gate = gt.proposals(weight_table(spark), 7_000_000, 400_000)
    return provider.proposed(cq.firsts(spark, sf_dir), gate, cq.lexicon(spark, sf_dir), weight_table(spark))


# Ties are broken in the order O, E, S; B, M. A segment starts from <START> or from O, and moves to O where text follows.
_RUN_ORDER = {"O": 0, "E": 1, "S": 2, "B": 0, "M": 1}
_RUN = "tr(prev, state, t, ord) AS (VALUES " + ", ".join(f"('{viterbi.STATES[p]}', '{viterbi.STATES[c]}', {_T(viterbi.STATES[p], viterbi.STATES[c])}, {_RUN_ORDER[viterbi.STATES[p]]})" for c, ps in enumerate(viterbi.BEFORE) for p in ps)
_RUN += "), st(state, first, later) AS (VALUES " + ", ".join(f"('{s}', {_T('<START>', s)}, {_T('O', s)})" for s in "OBS") + "), fin(state, t, ord) AS (VALUES " + ", ".join(f"('{s}', {_T(s, 'O')}, {i})" for i, s in enumerate("OES")) + ")"


def _provided(which: str) -> str:
    """Candidates of the segments of a table."""
    return f"""{_RUN},
el AS (SELECT g.sid, g.seg_start, em.pos, unnest(['O', 'B', 'M', 'E', 'S']) AS state, unnest([o, b, m, e, s]) AS x FROM em JOIN {which} g ON g.sid = em.sid AND em.pos >= g.seg_start AND em.pos < g.seg_end),
walk AS (
  SELECT el.sid, el.seg_start, el.pos, el.state, el.x + CASE WHEN el.pos = 0 THEN st.first ELSE st.later END AS score, el.state AS path FROM el JOIN st ON st.state = el.state WHERE el.pos = el.seg_start
  UNION ALL
  SELECT sid, seg_start, pos, state, score, path FROM (
    SELECT w.sid, w.seg_start, el.pos, el.state, w.score + tr.t + el.x AS score, w.path || el.state AS path, row_number() OVER (PARTITION BY w.sid, w.seg_start, el.state ORDER BY w.score + tr.t DESC, tr.ord) AS r
    FROM walk w JOIN tr ON tr.prev = w.state JOIN el ON el.sid = w.sid AND el.seg_start = w.seg_start AND el.pos = w.pos + 1 AND el.state = tr.state) WHERE r = 1
),
best AS (SELECT sid, seg_start, path FROM (SELECT w.*, row_number() OVER (PARTITION BY w.sid, w.seg_start ORDER BY score + CASE WHEN g.seg_end < length(f.text) THEN fin.t ELSE 0 END DESC, fin.ord) AS r
  FROM walk w JOIN {which} g ON g.sid = w.sid AND g.seg_start = w.seg_start AND w.pos = g.seg_end - 1 JOIN firsts f ON f.sid = w.sid JOIN fin ON fin.state = w.state) WHERE r = 1),
sp AS (SELECT sid, seg_start + i AS start, seg_start + i + length(regexp_extract(path[i + 1 :], '^(S|BM*E)', 1)) AS "end" FROM (SELECT *, unnest(range(0, length(path))) AS i FROM best)),
sc AS (SELECT sp.sid, start, "end", sum(CASE WHEN "end" - start = 1 THEN s - greatest(o, b, m, e) WHEN pos = start THEN b - greatest(o, m, e, s) WHEN pos = "end" - 1 THEN e - greatest(o, b, m, s) ELSE m - greatest(o, b, e, s) END) / count(*) / 1000000 AS margin
  FROM sp JOIN em ON em.sid = sp.sid AND em.pos >= start AND em.pos < "end" WHERE "end" - start BETWEEN 2 AND 64 GROUP BY sp.sid, start, "end")"""


_KEPT = r""" SELECT sc.sid, start::INT AS start, "end"::INT AS "end", round(least(400.0::DOUBLE, margin * 3.0::DOUBLE - 10.0::DOUBLE), 6) AS score, round(margin, 6) AS margin FROM sc JOIN firsts f ON f.sid = sc.sid
WHERE margin >= {least} AND f.text[start + 1 : "end"] NOT IN (SELECT word FROM lexicon)
AND NOT (start > 0 AND regexp_full_match(substring(text, start, 2), '[0-9A-Za-z]{{2}}')) AND NOT ("end" < length(text) AND regexp_full_match(substring(text, "end", 2), '[0-9A-Za-z]{{2}}'))"""


@query(sql.base(_EMIT, _SEG, sql.LEXICON, _provided("seg")) + _KEPT.format(least=0.5))
def provider_candidates(spark, sf_dir):
    return provider.candidates(cq.firsts(spark, sf_dir), weight_table(spark), TRANSITIONS, cq.lexicon(spark, sf_dir), provider.Options(min_margin=0.5))


#: Weights large enough for the provider's own margin, with a gate.
STRONG = 20


def strong_weights(spark: SparkSession) -> DataFrame:
    return weight_table(spark).select("feature", *[(F.col(s) * STRONG).alias(s) for s in "obmes"])


_STRONG_EMIT = _EMIT.replace(", em AS (SELECT f.sid, f.pos, " + ", ".join(f"coalesce(sum(w.{s}), 0)::BIGINT AS {s}" for s in "obmes"), ", em AS (SELECT f.sid, f.pos, " + ", ".join(f"coalesce(sum(w.{s}), 0)::BIGINT * {STRONG} AS {s}" for s in "obmes"))


@query(sql.base(_STRONG_EMIT, _SEG, sql.LEXICON, _PROPOSED, _provided("wanted")) + _KEPT.format(least=35.0))
def provider_gated(spark, sf_dir):
    """The provider as it runs by default: gate and entity words first, margin 35."""
    gate = gt.proposals(weight_table(spark), 7_000_000, 400_000)
    words = cq.lexicon(spark, sf_dir)
    return provider.candidates(cq.firsts(spark, sf_dir), strong_weights(spark), TRANSITIONS, words, gate=gate, entities=words)


# --- training and extension points (no SQL) ------------------------------------------


def generic_cases(spark: SparkSession, sf_dir: str, which: str = "train", every: DataFrame | None = None) -> DataFrame:
    """Cases (sid, text, spans, found), whose features are those of characters and of a gazetteer, the surfaces of the train split."""
    every = split_rows(spark, sf_dir) if every is None else every
    rows = every.where(F.col("split") == which)
    known = every.where("split = 'train'").select("text", F.inline("spans")).select(tx.slice_of(F.col("text"), F.col("start"), F.col("end")).alias("word")).distinct()
    found = lx.match(rows, known, 64).groupBy("sid").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    return rows.where(F.length("text") > 0).join(found, "sid", "left").select("sid", "text", "spans", "found")


def _mixed(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None) -> DataFrame:
    """The split rows are kept while it trains: they are read several times, and plans that make them each time fill the driver."""
    every = split_rows(spark, sf_dir).select("sid", "text", "spans", "split").persist()
    try:
        return perceptron.train_mixed(generic_cases(spark, sf_dir, every=every), shards=4, types=types)
    finally:
        every.unpersist()


@query()
def perceptron_train_typed(spark, sf_dir):
    """States of each type; the case sets of the HMM."""
    return _mixed(spark, sf_dir, TYPES)


@query()
def perceptron_train_exact(spark, sf_dir):
    return perceptron.train_exact(generic_cases(spark, sf_dir))


@query()
def perceptron_train_mixed(spark, sf_dir):
    return _mixed(spark, sf_dir, None)


@query(sql.base(sql.LEXICON, sql.MATCHES) + r""" SELECT sid, start, "end", (60.0 * ("end" - start) - 10.0)::FLOAT AS score FROM matches WHERE NOT (start > 0 AND regexp_full_match(substring(text, start, 2), '[0-9A-Za-z]{2}')) AND NOT ("end" < length(text) AND regexp_full_match(substring(text, "end", 2), '[0-9A-Za-z]{2}'))""")
def udtf_provider(spark, sf_dir):
    provider.table_function(spark, "known_words", provider.words_of(cq.lexicon(spark, sf_dir)), provider.Options(max_chars=12))
    cq.firsts(spark, sf_dir).createOrReplaceTempView("_udtf_texts")
    return spark.sql("select t.sid, c.start_char as start, c.end_char as `end`, c.score from _udtf_texts t, lateral known_words(t.text) c")
