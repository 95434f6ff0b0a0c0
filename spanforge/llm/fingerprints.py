"""I-Match fingerprints with randomised lexicons; DataFrame functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import parallelism, stored, words

#: So many quantiles of ids at most are told to the driver.
MOST_RANGES = 4096
#: A text needs so many terms that aren't too frequent.
FEW = 4


def terms(text: Column) -> Column:
    """The distinct lower-case words of a text as numbers of 60 bits (from MD5, so that any engine can tell them)."""
    return F.transform(F.array_distinct(words(F.lower(text))), lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("long"))


def _rare(t: Column, level: Column) -> Column:
    """Whether a lexicon of this level may hold a term: one term in 2**level."""
    return F.expr("(1L << 40) - 1").bitwiseAND(t) % F.pow(F.lit(2.0), level).cast("long") == 0


def signature(held: Column, level: Column, lexicons: int) -> Column:
    """One hash for each randomised lexicon: of the sorted terms that the text has in it, or null."""
    own = lambda k: F.array_sort(F.filter(held, lambda t: (F.shiftright(t, 40) % lexicons == k) & _rare(t, level)))
    one = lambda s: F.when(F.size(s) > 0, F.substring(F.md5(F.array_join(F.transform(s, lambda t: t.cast("string")), ",")), 1, 16))
    return F.transform(F.sequence(F.lit(0), F.lit(lexicons - 1)), lambda k: one(own(k)))


def level_of(n_terms: Column, lexicons: int) -> Column:
    """The level at which a lexicon meets one to two of so many terms."""
    return sum(((n_terms >= lexicons << i).cast("int") for i in range(1, 30)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of lexicons with equal hashes among those in which either text has terms.

    Texts of neighbouring levels are compared at the level both have. Equal
    fingerprints have likeness 1, fingerprints without terms are else unlike.
    """
    share = lambda x, y: (
        F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda z: z)) / F.greatest(F.lit(1), F.size(F.filter(F.zip_with(x, y, lambda p, q: p.isNotNull() | q.isNotNull()), lambda z: z)))
    )
    by_level = (
        F.when(a["level"] == b["level"], share(F.concat(a["fine"], a["coarse"]), F.concat(b["fine"], b["coarse"])))
        .when(a["level"] + 1 == b["level"], share(a["coarse"], b["fine"]))
        .when(a["level"] == b["level"] + 1, share(a["fine"], b["coarse"]))
        .otherwise(0.0)
    )
    return F.when(a == b, 1.0).otherwise(by_level)


def _ranges(rows: DataFrame, id_col: str, text_col: str, wanted: int) -> Column:
    """The range of a row: the larger, the earlier in descending order of ids, null ids (below 0) last.

    Quantiles cut the ids into up to MOST_RANGES ranges, and equal widths cut
    each of these, until there are `wanted`. An id that holds several quantiles,
    and null ids, are cut by the hash of the text, in whose order such rows stand.
    """
    coarse = max(1, min(MOST_RANGES, wanted))
    fine = -(-wanted // coarse)
    i = F.col(id_col)
    asked = [k / coarse for k in range(1, coarse)]
    got = rows.agg(F.percentile_approx(id_col, asked, 100 * coarse) if asked else F.lit(None), F.min(id_col), F.max(id_col), F.count("*"), F.count(id_col)).first()
    borders, low, high, total, known = sorted(got[0] or []), got[1], got[2], got[3], got[4]
    share = F.xxhash64(text_col) / F.lit(2.0**64) + 0.5
    none = F.lit(-1) - F.floor(share * max(1, -(-(total - known) * wanted // max(1, total))))
    if low is None:
        return none.cast("int")
    part = F.size(F.filter(F.array(*[F.lit(b) for b in borders]).cast("array<long>"), lambda b: b <= i)) if borders else F.lit(0)
    first, last = (F.element_at(F.array(*[F.lit(x) for x in ends]).cast("array<long>"), part + 1) for ends in ([low, *borders], [*borders, high + 1]))
    inside = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((i - first) / F.greatest(F.lit(1), last - first) * fine)))
    number = part * fine + inside
    held = Counter(borders)
    for b, n in held.items():
        if n > 1:  # rows of this id: down from the number that its first place has
            number = F.when(i == b, part * fine - F.floor(share * ((n - 1) * fine + 1))).otherwise(number)
    return F.when(i.isNull(), none).otherwise(number).cast("int")


def in_order(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds next_text, the text of the row with the next smaller id (after the last: the first).

    Rows are dealt into ranges of ids (see `_ranges`), of which the driver knows
    only the borders, and shuffled once; the last row of a range takes the first
    text of the next range that has rows. Equal ids stand in the order of their
    texts' hashes, null ids come last. Also adds _row, which is unique and the
    same on every run.
    """
    part = _ranges(rows, id_col, text_col, parallelism(rows.sparkSession))
    order = [F.col(id_col).desc_nulls_last(), F.xxhash64(text_col), F.col(text_col)]
    put = rows.withColumn("_part", part)
    w = Window.partitionBy("_part").orderBy(*order)
    out = put.withColumn("_next", F.lead(text_col).over(w)).withColumn("_rn", F.row_number().over(w))
    # Only ids and hashes for the firsts of the ranges; then their texts by a max.
    firsts = put.groupBy("_part").agg(F.max_by(text_col, F.struct(F.coalesce(F.col(id_col), F.lit(-(2**63))), -F.xxhash64(text_col).cast("decimal(20,0)"))).alias("_text"))
    parts = put.groupBy("_part").agg(F.lit(1).alias("_one")).select("_part")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_part"))
    follow = parts.select("_part", F.coalesce(F.lead("_part").over(down), F.first("_part").over(down)).alias("_then"))
    heads = follow.join(firsts.withColumnRenamed("_part", "_then"), "_then").select("_part", "_text")
    out = out.join(heads, "_part")
    return out.select(*rows.columns, F.coalesce("_next", "_text").alias("next_text"), (F.shiftleft(F.col("_part").cast("long"), 40) + F.col("_rn")).alias("_row"))


def fingerprint_edited(docs: DataFrame, lexicons: int = 16, least_docs: int = 2, one_in: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and of the next text.

    The band keeps terms that `least_docs` documents have and no more than one
    document in `one_in` (an inverse document frequency of ln(one_in) or more).
    A lexicon is a random subset of the band: at level L, one of its terms in
    `lexicons` * 2**L, by hash. A text takes the level at which each lexicon
    meets one to two of its terms that aren't too frequent, and the next one; its fingerprint is
    the hash of its sorted terms in each lexicon at both levels. A text that
    has no term of the band in any lexicon uses the rarer terms that it has
    there instead (its fingerprint says so); one that has less than FEW terms
    which aren't too frequent uses those that are, too.

    The upper edge of the band is a set of at most one_in * (distinct terms of a
    mean document) terms, as each has a share 1 / one_in of all documents; it is
    broadcast and taken out of every text first. The lower edge is then looked
    up, by a join, for those terms alone that lexicons of the text's level hold;
    the result is the same as if it had been for all.

    Texts whose levels differ by more than one have likeness 0: one has more
    than twice as many terms as the other. A null text counts as empty; an empty one has a fingerprint without
    terms, like only its equals. Very long texts are whole. Rows with equal or
    null ids are rows by themselves. One document is its own next one. An empty
    table gives no rows; other columns are left out, whatever their names.
    Document frequencies count all rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = stored(rows.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_docs), "frequencies")
    total = rows.count()
    often = F.col("df") * one_in > total
    frequent = df.where(often).agg(F.collect_list("term").alias("_frequent"))
    band = df.where(~often).select("term", F.lit(True).alias("banded"))
    r = in_order(rows, "doc_id", "text")
    r = r.withColumn("n", F.length("text")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    r = r.withColumn("edited", F.concat(F.expr("substring(text, 1, n - cut)"), F.expr("substring(next_text, 1, cut)")))
    kinds = ("text", "edited", "next_text")
    r = r.join(F.broadcast(frequent))  # one row
    r = r.select("_row", "doc_id", "n", F.sha2("edited", 256).alias("sha"), "_frequent", *[terms(F.col(k)).alias(f"t_{k}") for k in kinds])
    rarer = lambda k: F.array_except(f"t_{k}", "_frequent")
    r = r.select("_row", "doc_id", "n", "sha", *[F.when(F.size(rarer(k)) < FEW, F.col(f"t_{k}")).otherwise(rarer(k)).alias(f"t_{k}") for k in kinds])
    r = r.select("*", *[level_of(F.size(f"t_{k}"), lexicons).alias(f"l_{k}") for k in kinds])
    choose = lambda k: F.filter(f"t_{k}", lambda t: _rare(t, F.col(f"l_{k}")))
    chosen = [choose(k) for k in kinds]
    r = r.select("_row", "doc_id", "n", "sha", *[c.alias(f"c_{k}") for k, c in zip(kinds, chosen, strict=True)], *[F.col(f"l_{k}") for k in kinds])
    flags = lambda t: sum((F.when(F.array_contains(f"c_{k}", t), 1 << i).otherwise(0) for i, k in enumerate(kinds)), F.lit(0)).cast("byte")
    every = F.array_distinct(F.concat(*[F.col(f"c_{k}") for k in kinds]))
    head = F.struct("doc_id", "n", "sha", *[F.col(f"l_{k}") for k in kinds])
    # The first element stands for the row and carries what isn't a term.
    items = F.concat(
        F.array(F.struct(F.xxhash64("_row", "sha").alias("term"), F.lit(0).cast("byte").alias("of"), head.alias("head"))),
        F.transform(every, lambda t: F.struct(t.alias("term"), flags(t).alias("of"), F.when(F.lit(False), head).alias("head"))),
    )
    long = r.select("_row", F.inline(items))
    marked = long.join(band, "term", "left").select("_row", "head", F.when(F.col("of") > 0, F.struct("term", "of", F.coalesce("banded", F.lit(False)).alias("banded"))).alias("item"))
    g = marked.groupBy("_row").agg(F.max("head").alias("head"), F.collect_list("item").alias("items"))
    mine = lambda i: F.filter("items", lambda x: x["of"].bitwiseAND(F.lit(1 << i).cast("byte")) > 0)
    used = lambda i, k: F.filter(mine(i), lambda x: x["banded"] | ~F.col(f"b_{k}"))
    for i, k in enumerate(kinds):
        g = g.withColumn(f"b_{k}", F.exists(mine(i), lambda x: x["banded"]))
        g = g.withColumn(f"h_{k}", F.transform(used(i, k), lambda x: x["term"]))
    for k in kinds:
        level = F.col(f"head.l_{k}")
        g = g.withColumn(f"f_{k}", F.struct(F.col(f"b_{k}").alias("banded"), level.alias("level"), signature(F.col(f"h_{k}"), level, lexicons).alias("fine"), signature(F.col(f"h_{k}"), level + 1, lexicons).alias("coarse")))
    g = g.select("head", *[F.col(f"f_{k}") for k in kinds])
    text = lambda f: F.concat_ws(":", F.when(f["banded"], "b").otherwise("a"), f["level"].cast("string"), *[F.array_join(f[x], ",", "-") for x in ("fine", "coarse")])
    return g.select(
        F.col("head.doc_id").alias("doc_id"), F.col("head.n").cast("long").alias("n_chars"), F.col("head.sha").alias("edited_sha256"),
        text(F.col("f_text")).alias("fingerprint"), text(F.col("f_edited")).alias("edited_fingerprint"),
        likeness(F.col("f_text"), F.col("f_edited")).alias("near_edited"), likeness(F.col("f_text"), F.col("f_next_text")).alias("near_next"),
    )
