"""Operators on small rows."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge import schema
from spanforge.functions import text as tx
from spanforge.operators import candidates, corpus, evaluate, features, hmm, labels, lexicon, perceptron, provider, split, synth, tags, viterbi
from spanforge.operators import names as nm
from spanforge.sources import readers, sinks
from spanforge.streaming import annotate


def test_states():
    assert len(schema.states(schema.ENTITY_TYPES)) == 81
    assert schema.states() == ["O", "B", "M", "E", "S"]
    assert schema.may_follow("B_PER", "E_PER") and not schema.may_follow("B_PER", "E_LOC") and not schema.may_follow("O", "M")


def weights_of(spark, rows):
    return features.wide(spark.createDataFrame(rows, "feature string, state string, weight long"))


def test_generic_viterbi(spark):
    s = spark.createDataFrame([("a", "张三访问北京")], "sid string, text string")
    w = weights_of(spark, [("c0=张", "B", 5), ("c0=三", "E", 5), ("c0=北", "B", 5), ("c0=京", "E", 5)])
    rows = features.score_rows(features.emissions(features.char_features(s), w))
    assert viterbi.decode(rows, {}).first().tags == "BEOOBE"
    assert rows.select(viterbi.fold(F.col("scores"), {}).alias("t")).first().t == "BEOOBE"


def test_gazetteer_features(spark):
    s = spark.createDataFrame([("a", "访问北京大学")], "sid string, text string")
    lex = spark.createDataFrame([("北京",), ("北京大学",)], "word string")
    got = {(r.pos, r.feature) for r in lexicon.features(lexicon.match(s, lex)).collect()}
    assert {(2, "lx=B:2"), (2, "lx=B:4"), (3, "lx=E:2"), (3, "lx=M:4"), (5, "lx=E:4")} <= got


def test_lexicon_keeps_words_that_stand_alone(spark):
    rows = spark.createDataFrame([("ab cd",), ("abcd",), ("ab x",)], "text string")
    got = {r.word for r in lexicon.build(rows).collect()}
    assert got == {"ab", "cd", "x"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 3), st.sampled_from(schema.LEGACY_TYPES)), max_size=5))
def test_tags_round_trip(spark, parts):
    at, spans = 0, []
    for size, gap, kind in parts:
        spans.append((at, at + size, kind))
        at += size + gap
    row = spark.createDataFrame([("x" * (at + 1), spans)], "text string, spans array<struct<start:int,end:int,type:string>>")
    t = row.select("spans", tags.spans_to_tags(F.col("text"), F.col("spans")).alias("t"))
    got = t.select("spans", tags.tags_to_spans(F.col("t")).alias("back"), tags.legal(F.col("t")).alias("legal")).first()
    assert got.legal and [tuple(x) for x in got.back] == [tuple(x) for x in got.spans]


def test_broken_tags_are_not_legal(spark):
    row = spark.createDataFrame([(["B_PER", "O"],), (["M_PER", "E_PER"],), (["B_PER", "E_LOC"],), (["S_PER", "O"],)], "t array<string>")
    assert [r.x for r in row.select(tags.legal(F.col("t")).alias("x")).collect()] == [False, False, False, True]


def test_group_split_is_safe(spark):
    rows = spark.createDataFrame([("s", f"g{i // 2}", str(i)) for i in range(20)], "source string, group_id string, text string")
    got = rows.join(split.by_group(rows), ["source", "group_id"])
    assert split.leaks(got).count() == 0 and {r.split for r in got.collect()} == {"train", "dev", "test"}


def test_scores(spark):
    kind = "sid string, start int, `end` int, type string"
    gold, pred = spark.createDataFrame([("a", 0, 2, "PER")], kind), spark.createDataFrame([("a", 0, 2, "PER"), ("a", 3, 4, "LOC")], kind)
    all_types = {r.type: r for r in evaluate.scores(gold, pred).collect()}
    assert (all_types["ALL"].tp, all_types["ALL"].fp, all_types["ALL"].fn, all_types["ALL"].precision) == (1, 1, 0, 0.5)
    cases = spark.createDataFrame([("a", "abcd"), ("b", "none")], "sid string, text string")
    x = evaluate.extended(cases, gold, pred).first()
    assert (x.sentences, x.exact, x.negatives, x.negative_fp) == (2, 1, 1, 0)
    assert not evaluate.passed(evaluate.gates(evaluate.extended(cases, gold, pred), [("precision", ">=", 0.9)]))


def test_hmm_closed_loop(spark):
    rows = [(str(i), f"we met {w} there", [(7, 7 + len(w), "PER")]) for i, w in enumerate(["Anna", "Bob", "Anna", "Bob"])]
    cases = spark.createDataFrame(rows, "sid string, text string, spans array<struct<start:int,end:int,type:string>>")
    decode = hmm.decoder(hmm.train(tags.exploded(cases)))
    got = cases.select("spans", decode("text").alias("t")).select("spans", tags.tags_to_spans(F.col("t")).alias("found")).collect()
    assert all([tuple(x) for x in r.found] == [tuple(x) for x in r.spans] for r in got)


def span_cases(spark):
    rows = [(f"b{i:02d}", t, s) for i, (t, s) in enumerate(nm.BAD_CASES)]
    return spark.createDataFrame(rows, "sid string, text string, encoded string").withColumn("spans", labels.decode(F.col("encoded")))


def test_candidates_cover_the_bad_cases(spark):
    cases = span_cases(spark)
    got = {r.type: r for r in evaluate.coverage(cases.select("sid", F.inline("spans")), candidates.generate(cases)).collect()}
    assert got["ALL"].covered >= 11


def test_perceptron_is_deterministic_and_learns(spark):
    rows = spark.createDataFrame([(str(i), t, s) for i, (t, s) in enumerate([("ab xx", [(0, 2, "PER")]), ("xx ab", [(3, 5, "PER")]), ("xxxx", [])] * 4)], "sid string, text string, spans array<struct<start:int,end:int,type:string>>")
    cases = perceptron.training_cases(features.char_features(rows), tags.exploded(rows, typed=False))
    one, two = (perceptron.train_exact(cases, epochs=5, seed=7).collect() for _ in range(2))
    assert one == two
    w = {(r.feature, r.state): r.weight for r in one}
    c = {r.sid: r for r in cases.collect()}
    assert all(perceptron.predict(w, [list(f) for f in c[k].features]) == list(c[k].tags) for k in ("0", "1", "2"))
    mixed = {(r.feature, r.state): r.weight for r in perceptron.train_mixed(cases, shards=2, epochs=6, seed=7).collect()}
    assert all(perceptron.predict(mixed, [list(f) for f in c[k].features]) == list(c[k].tags) for k in ("0", "1", "2"))


def test_provider_options_and_registry():
    with pytest.raises(ValueError):
        provider.Options(max_chars=65)
    with pytest.raises(NotImplementedError):
        provider.register("x", "scorer", None)


def test_connectors_and_boundaries(spark):
    s = spark.createDataFrame([("a", "A·B c-d, x"), ("b", "-ab-")], "sid string, text string")
    got = sorted((r.sid, r.seg_start, r.seg_end) for r in provider.segments(s).collect())
    assert got == [("a", 0, 3), ("a", 4, 7), ("b", 1, 3)]


def test_ascii_cut(spark):
    row = spark.createDataFrame([("xab y", 1, 3), ("x ab y", 2, 4)], "text string, s int, e int")
    assert [r.c for r in row.select(tx.ascii_cut(F.col("text"), F.col("s"), F.col("e")).alias("c")).collect()] == [True, False]


def test_organisations_and_predicates(spark):
    w = synth.numbered(spark.createDataFrame([("南湖区",), ("东湖市",)], "word string"))
    got = {r.word for r in synth.organisations(w, list(nm.PLACE_SUFFIXES), list(nm.ORG_SUFFIXES), [], 10).collect()}
    assert got == {"东湖大学", "南湖人民医院"}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "1", "title": " t ", "desc": "", "answer": "a"}) + "\n", encoding="utf-8")
    assert readers.corpus_json(spark, str(tmp_path / "c.jsonl")).first().text == "t。a"
    (tmp_path / "c.csv").write_text("id,headline,content\n1,h,c\n", encoding="utf-8")
    assert readers.corpus_csv(spark, str(tmp_path / "c.csv")).first().text == "h。c"
    (tmp_path / "x.tsv").write_text("# text\tspans\nab cd\t0:2:PER,3:5:LOC\nno\t-\n", encoding="utf-8")
    rows = readers.cases_tsv(spark, str(tmp_path / "x.tsv")).orderBy("line").collect()
    assert [(r.text, len(r.spans)) for r in rows] == [("ab cd", 2), ("no", 0)]
    (tmp_path / "l.jsonl").write_text('{"id":"a","text":"1","entities":[]}\n{"id":"b","text":"2"}\n{"id":"a","text":"3"}\n', encoding="utf-8")
    got = {r.id: (r.line, r.text) for r in readers.last_labels(readers.label_lines(spark, str(tmp_path / "l.jsonl"))).collect()}
    assert got == {"a": (1, "3"), "b": (2, "2")}
    (tmp_path / "k.jsonl").write_text('{"group_id":"g","source":"s","text":"abcd","spans":[[0,2,"PER"],[1,3,"LOC"]]}\n{"group_id":"g","source":"s","text":"abcd","spans":[[0,2,"PER"],[2,3,"LOC"]]}\n', encoding="utf-8")
    assert sorted(r.ok for r in readers.cases_json(spark, str(tmp_path / "k.jsonl")).collect()) == [False, True]
    cases = spark.createDataFrame([("g", "ab cd", [(0, 2, "PER")])], "group_id string, text string, spans array<struct<start:int,end:int,type:string>>")
    sinks.write_cases(cases, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "ab cd\t0:2:PER"
    assert json.loads(sinks.manifest(cases).first().types) == {"PER": 1}
    assert readers.cases_for_merge(cases, "dev").first().group_id.startswith("case-dev-")
    sinks.write_lexicon(spark.createDataFrame([("b",), ("a",), ("#c",), ("a",)], "word string"), str(tmp_path / "lex"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lex")).collect()) == ["a", "b"]


def test_packed_weights_refuse_faults(spark, tmp_path):
    path = str(tmp_path / "w.bin")
    w = weights_of(spark, [("a", "B", 500000), ("b", "O", 250000)])
    assert sinks.pack_weights(w, path) == 2
    assert [r[0] for r in sinks.unpack_weights(path)] == ["a", "b"]
    raw = open(path, "rb").read()
    for bad in (raw[:-1], raw + b"x", b"X" + raw[1:], raw[:25] + b"\xff\xff\xff\x7f" * 4 + raw[41:]):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            sinks.unpack_weights(path)


def test_streamed_annotation_resumes(spark, tmp_path):
    def annotator(rows):  # inside, so that it is sent by value
        return {i: json.dumps([{"start": 0, "end": 1, "type": "PER", "text": t[:1]}]) for i, t in rows}

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("1", "ab"), ("2", "cd")], [("2", "cd"), ("3", "ef")]):
        spark.createDataFrame(part, "id string, text string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id string, text string").parquet(src)
        annotate.annotate_stream(stream, annotator, out, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted(r.id for r in got) == ["1", "2", "3"] and got[0].entities[0].type == "PER"


def test_sentences_of_empty_and_null(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "long enough? yes it is!")], "doc_id long, text string")
    assert [r.text for r in corpus.sentences(d, keep=("doc_id",)).collect()] == ["long enough?", "yes it is!"]


def test_segments_start_from_o_and_move_to_o(spark):
    """By hand: "ab!cd"; only the second segment comes after text, only the first has text behind it."""
    from spanforge.operators import provider

    zero = [("c0=a", "B", 40), ("c0=b", "E", 40), ("c0=c", "B", 40), ("c0=d", "E", 40)]
    rows = [(f, *[v * 1_000_000 if s == k else 0 for k in "OBMES"]) for f, s, v in zero]
    w = spark.createDataFrame(rows, "feature string, o long, b long, m long, e long, s long")
    text = spark.createDataFrame([("x", "ab!cd")], "sid string, text string")
    none = spark.createDataFrame([], "word string")

    def spans(moves):
        return sorted((r.start, r.end, r.margin) for r in provider.candidates(text, w, {k: v * 1_000_000 for k, v in moves.items()}, none).collect())

    assert spans({}) == [(0, 2, 40.0), (3, 5, 40.0)]
    assert spans({("<START>", "B"): -500}) == [(3, 5, 40.0)]
    assert spans({("O", "B"): -500}) == [(0, 2, 40.0)]
    assert spans({("E", "O"): -500}) == [(3, 5, 40.0)]
    gate = spark.createDataFrame([("b!c", 3)], "key string, arity int")
    assert len(provider.candidates(text, w, {}, none, gate=gate).collect()) == 2  # it reaches into both
    gate = spark.createDataFrame([("<BOS1>a", 2)], "key string, arity int")
    assert [(r.start, r.end) for r in provider.candidates(text, w, {}, none, gate=gate).collect()] == [(0, 2)]
    words = spark.createDataFrame([("cd",), ("b!cd",)], "word string")
    assert not provider.candidates(text, w, {}, none, gate=gate.limit(0), entities=words).collect()  # two characters, or not inside


def naive_perceptron(cases, epochs, seed, least, types=None):
    """Every path is tried, and the mean is taken over the weights after every step."""
    import collections
    import itertools
    import random

    from spanforge import schema

    states = schema.states(types)
    order = (0, 4, 3, 1, 2) if types is None else range(len(states))  # ties: O, S, E; B, M

    def total(w, features, path):
        out = sum(w[f, t] for fs, t in zip(features, path) for f in fs)
        return out + sum(w[f"T={a}", b] for a, b in zip(("<START>", *path), path))

    def legal(path):
        return schema.may_start(path[0]) and schema.may_end(path[-1]) and all(schema.may_follow(a, b) for a, b in zip(path, path[1:]))

    rank = {states[s]: i for i, s in enumerate(order)}
    own, rng = sorted(cases), random.Random(seed)
    w, summed, steps = collections.defaultdict(float), collections.defaultdict(float), 0
    for _ in range(epochs):
        rng.shuffle(own)
        for _, features, gold in own:
            paths = [p for p in itertools.product(states, repeat=len(gold)) if legal(p)]
            best = max(total(w, features, p) for p in paths)
            # Of equal paths the one whose states, from the last one back, come first.
            said = min((p for p in paths if total(w, features, p) == best), key=lambda p: ((0, 3, 4).index(states.index(p[-1])) if types is None else rank[p[-1]], [rank[s] for s in p[-2::-1]]))
            if list(said) != gold:
                for path, by in ((gold, 1.0), (said, -1.0)):
                    for fs, t in zip(features, path):
                        for f in fs:
                            w[f, t] += by
                    for a, b in zip(("<START>", *path), path):
                        w[f"T={a}", b] += by
            steps += 1
            for k, v in w.items():
                summed[k] += v
    return {(f, s): round(v / steps, 6) for (f, s), v in summed.items() if abs(v / steps) >= least}


@pytest.mark.parametrize("types", [None, ("PER",)])
def test_perceptron_equals_brute_force(spark, types):
    from spanforge.operators import perceptron

    end = "" if types is None else "_PER"
    tags = lambda s: [t if t == "O" else t + end for t in s]
    cases = [("a", [["x"], ["y", "z"], ["x"]], tags("BEO")), ("b", [["y"], ["x", "z"]], tags("OS")), ("c", [["z"], ["z"], ["y"], ["x"]], tags("BMEO")), ("d", [["x", "y"]], tags("O"))]
    d = spark.createDataFrame(cases, "sid string, features array<array<string>>, tags array<string>")
    got = {(r.feature, r.state): r.weight for r in perceptron.train_exact(d, epochs=4, seed=3, least=0.01, types=types).collect()}
    want = naive_perceptron(cases, 4, 3, 0.01, types)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    one = {(r.feature, r.state): r.weight for r in perceptron.train_mixed(d, shards=1, epochs=1, seed=3, least=0.01, types=types).collect()}
    want = naive_perceptron(cases, 1, 3, 0.01, types)
    assert one.keys() == want.keys() and all(abs(one[k] - want[k]) < 2e-6 for k in want)


def test_strict_readers_refuse(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanforge.operators import labels, tags
    from spanforge.sources import readers

    (tmp_path / "good.tsv").write_text("# text\tspans\nanna left\t0:4:PER\nnone\t-\n")
    (tmp_path / "bad.tsv").write_text("anna left\t0:40:PER\n")
    assert readers.cases_strict(spark, str(tmp_path / "good.tsv")).count() == 2 and len(readers.cases_strict(spark, str(tmp_path / "good.tsv")).collect()) == 2
    with pytest.raises(Exception, match="bad case in line 1"):
        readers.cases_strict(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "rows.json").write_text('{"id": "1", "text": "a"}\n{"id": "1", "text": "b"}\n')
    with pytest.raises(ValueError, match="repeated"):
        readers.label_files(spark, str(tmp_path / "rows.json"))
    assert [r.text for r in readers.corpus_json(spark, str(tmp_path / "rows.json"), ("text",), scan_rows=1).collect()] == ["a"]
    row = spark.createDataFrame([(["B_PER", "O"],)], "t array<string>")
    with pytest.raises(Exception, match="not a legal tag sequence"):
        row.select(tags.strict_spans(F.col("t"))).collect()
    labels.require_none(spark.createDataFrame([], "id string"), "nothing")


def test_manifest_files_and_prompt_snapshot(spark, tmp_path):
    import hashlib

    from spanforge.operators import prompts
    from spanforge.sources import manifests

    (tmp_path / "a.txt").write_text("hello")
    got = manifests.files(spark, str(tmp_path / "a.txt")).first()
    assert (got["name"], got["size"], got["sha256"]) == ("a.txt", 5, hashlib.sha256(b"hello").hexdigest())
    rows = spark.createDataFrame([("1", "x", 0), ("2", "y", 0), ("3", "z", 1)], "id string, text string, batch int")
    prompts.snapshot(prompts.prompts(rows, builder=lambda b: prompts.F.to_json(b)), str(tmp_path / "prompt"))
    assert spark.read.text(str(tmp_path / "prompt")).first().value == '[{"id":"1","text":"x"},{"id":"2","text":"y"}]'


def test_candidates_of_a_stream(spark, tmp_path):
    from spanforge.streaming import annotate

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "text": "we met anna there"}\n{"id": "2", "text": "annabel"}\n{"id": "3"}\n')
    provider.table_function(spark, "stream_words", ["anna", "met"], provider.Options())
    texts = spark.readStream.schema("id string, text string").json(str(tmp_path / "in"))
    q = annotate.candidates_stream(texts, "stream_words").writeStream.format("memory").queryName("stream_found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r.start_char, r.end_char) for r in spark.table("stream_found").collect()) == [("1", 3, 6), ("1", 7, 11)]


def test_windows_spell_the_same_features(spark):
    words = spark.createDataFrame([("北京",), ("北京大学",), ("ab",), ("b<c",), ("𠀀𠀁𠀂𠀃𠀄𠀅",)], "word string")
    rows = spark.createDataFrame([("a", "访问北京大学"), ("b", "x"), ("c", ""), ("d", None), ("e", "ab<c ab"), ("f", "<BOS1>ab"), ("g", "𠀀𠀁𠀂𠀃𠀄𠀅 1"), ("h", "ab")], "sid string, text string")
    found = lexicon.match(rows, words, 64)
    want = {}
    for r in features.char_features(rows).unionByName(lexicon.features(found)).collect():
        want.setdefault((r.sid, r.pos), []).append(r.feature)
    met = rows.join(found.groupBy("sid").agg(F.collect_set(F.struct("start", "end")).alias("m")), "sid", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    got = met.select("sid", F.posexplode(features.windows(F.col("text"), F.coalesce("m", none))).alias("pos", "w")).select("sid", "pos", features.spelt(F.col("w")).alias("fs"))
    assert {(r.sid, r.pos): sorted(r.fs) for r in got.collect()} == {k: sorted(v) for k, v in want.items()}


def noisy_cases(n, types=None, seed=5):
    """Cases whose tags often contradict each other, of 0 to 12 places, some without features."""
    import random

    rng, end = random.Random(seed), "" if types is None else "_PER"
    out = []
    for i in range(n):
        tags, size = [], rng.randrange(13)
        while len(tags) < size:
            k = rng.choice([0, 0, 0, 1, 2, 3])
            tags += ["O"] if k == 0 else ["S" + end] if k == 1 else ["B" + end, *["M" + end] * (k - 2), "E" + end]
        out.append((f"{i:05d}", [[f"{t[0]}{rng.randrange(4)}" for _ in range(rng.randrange(3))] for t in tags], tags))
    return out


def one_by_one(cases, model, order, by):
    """A pass that predicts each case by itself."""
    from spanforge.operators import viterbi

    system = viterbi.System(None if "_" not in "".join(t for _, _, ts in cases for t in ts) else ("PER", "ORG"))
    for k in order:
        _, fs, gold = cases[k]
        said = perceptron.predict(model.now, fs, system)
        if said != gold:
            for path, sign in ((gold, 1), (said, -1)):
                for f, t in zip(fs, path):
                    for x in f:
                        model.add((x, t), sign * by)
                for a, b in zip(("<START>", *path), path):
                    model.add((f"T={a}", b), sign * by)
        model.steps += 1


@pytest.mark.parametrize("types", [None, ("PER", "ORG")])
def test_exact_equals_one_case_at_a_time(spark, types):
    import random

    cases = noisy_cases(400, types)
    d = spark.createDataFrame(cases, "sid string, features array<array<string>>, tags array<string>").repartition(5)
    got = {(r.feature, r.state): r.weight for r in perceptron.train_exact(d, epochs=3, seed=11, least=0.0, types=types).collect()}
    rng, model, order = random.Random(11), perceptron.Averaged(), list(range(len(cases)))
    for _ in range(3):
        rng.shuffle(order)
        one_by_one(cases, model, order, 1.0)
    want = {k: w for k, w in model.mean().items() if abs(w) > 1e-9}
    got = {k: w for k, w in got.items() if abs(w) > 0}
    assert all(abs(got.get(k, 0) - want.get(k, 0)) < 2e-6 for k in got.keys() | want.keys()) and len(got) > 20


MANY = 30_000


def trained_in_time(spark, form, types=None, **more):
    """Weights of many cases of two sentences, within a minute."""
    import time

    end = "" if types is None else "_ORG"
    text = ["w%d" % (i % 9) for i in range(30)]
    tags = [["O"] * 10 + ["B" + end, *["M" + end] * 8, "E" + end] + ["O"] * 10, ["O"] * 30]
    one = [(i, [[w, f"{w}{i}", "bias", *(["in"] if t[0] in "BME" else []), f"t{t[0]}"] for w, t in zip(text, ts)], ts) for i, ts in enumerate(tags)]
    two = spark.createDataFrame(one, "i long, features array<array<string>>, tags array<string>")
    d = spark.range(MANY).select(F.col("id").cast("string").alias("sid"), F.pmod("id", F.lit(2)).alias("i")).join(F.broadcast(two), "i").drop("i")
    began = time.time()
    w = {(r.feature, r.state): r.weight for r in form(d, types=types, **more).collect()}
    took = time.time() - began
    from spanforge.operators import viterbi

    assert all(perceptron.predict(w, fs, viterbi.System(types)) == ts for _, fs, ts in one)
    assert took < 60, took


def test_exact_trains_on_many_cases_in_time(spark):
    trained_in_time(spark, perceptron.train_exact)


@pytest.mark.parametrize("types", [None, ("PER", "ORG")])
def test_mixed_equals_shards_of_one_case_at_a_time(spark, types):
    """Mixed weights are whole parts, so that equal scores are equal however they are added."""
    import random

    shards, cases = 3, noisy_cases(240, types)
    d = spark.createDataFrame(cases, "sid string, features array<array<string>>, tags array<string>").repartition(5)
    at = {r.sid: r.k for r in d.select("sid", F.pmod(F.xxhash64("sid"), F.lit(shards)).alias("k")).collect()}
    unit, mixed = 1_000_000 * shards, {}
    for epoch in range(3):
        total = {}
        for k in range(shards):
            own, model = [c for c in cases if at[c[0]] == k], perceptron.Averaged(mixed)
            order = list(range(len(own)))
            random.Random(7 + epoch).shuffle(order)
            one_by_one(own, model, order, unit)
            for key, w in model.mean().items():
                total[key] = total.get(key, 0) + round(w / unit * 1_000_000)
        mixed = total
    want = {k: w / unit for k, w in mixed.items() if w}
    got = {(r.feature, r.state): r.weight for r in perceptron.train_mixed(d, shards=shards, epochs=3, seed=7, least=0.0, types=types).collect()}
    # A mean that lies between two millionths may be rounded either way.
    assert all(abs(got.get(k, 0) - want.get(k, 0)) < 1e-5 for k in got.keys() | want.keys()) and len(got) > 20


def test_mixed_trains_on_many_cases_in_time(spark):
    trained_in_time(spark, perceptron.train_mixed, shards=2)


def test_typed_trains_on_many_cases_in_time(spark):
    trained_in_time(spark, perceptron.train_mixed, types=("PER", "LOC", "ORG", "BRAND"), shards=2)


ODD_TEXTS = [
    ("a", "we met anna there", [(7, 11, "PER")], [(7, 11), (7, 9), (8, 11)]), ("b", "we met bob there", [(7, 10, "PER"), (7, 16, "ORG")], None), ("c", "<BOS1>anna", [(6, 10, "ORG")], [(6, 10)]), ("d", "x", [(0, 1, "PER")], []),
    ("e", "𠀀𠀁𠀂𠀃𠀄𠀅 1", [(0, 6, "ORG")], [(0, 6), (1, 3)]), ("f", "北京大学 anna", [(0, 4, "ORG"), (5, 9, "PER")], [(0, 2), (0, 4), (5, 9)]), ("g", "nobody", [], None), ("a", "we met anna there", [(7, 11, "PER")], [(8, 11), (7, 11), (7, 9)]), ("h", "late", [(2, 9, "PER")], []),
]


@pytest.mark.parametrize("types", [None, ("PER", "ORG")])
def test_texts_train_as_their_features(spark, types):
    """Cases given as texts have the weights of cases whose windows and tags are made by expressions."""
    span = "array<struct<start:int,end:int,type:string>>"
    rows = spark.createDataFrame([(f"{k}{i}", *more) for i in range(6) for k, *more in ODD_TEXTS], f"sid string, text string, spans {span}, found array<struct<start:int,end:int>>").repartition(5)
    none = F.array().cast("array<struct<start:int,end:int>>")
    spelt = rows.select("sid", features.windows(F.col("text"), F.coalesce("found", none)).alias("features"), tags.spans_to_tags(F.col("text"), F.col("spans"), types is not None).alias("tags"))
    for form, more in ((perceptron.train_exact, {}), (perceptron.train_mixed, {"shards": 3})):
        got, want = ({tuple(r[:2]): r.weight for r in form(d, epochs=3, seed=5, least=0.0, types=types, spell=features.spelt, **more).collect()} for d in (rows, spelt))
        assert got == want and len(got) > 50
    assert perceptron.train_mixed(rows, types=types, epochs=1).count() > 0
    with pytest.raises(Exception, match="known tag"):
        perceptron.train_mixed(rows, types=("PER",), epochs=1).count()


@pytest.mark.parametrize("kept", [1 << 20, 0])
def test_lists_are_summed_once_between_changes(monkeypatch, kept):
    """A pass without errors sums a feature list once, however many places have it; without kept sums once a batch."""
    import numpy as np

    summed = []
    monkeypatch.setattr(perceptron.Tagger, "MOST_KEPT", kept, raising=False)
    monkeypatch.setattr(perceptron.Tagger, "_sums", lambda self, lists, f=perceptron.Tagger._sums: summed.extend(lists.tolist()) or f(self, lists))
    size = np.full(500, 20)
    places = np.tile(np.arange(10, dtype=np.int32), 1000)
    flat = np.arange(20, dtype=np.int32) // 2 * (np.arange(20) % 2)  # list i has feature i, and 0
    model = perceptron.Tagger([f"f{i}" for i in range(1, 11)], (flat, np.full(10, 2)), (places, np.zeros(len(places), np.int8), size), viterbi.System(("PER", "ORG")))
    assert model.one_pass(list(range(500))) == 0 and model.steps == 500
    assert len(summed) == (10 if kept else 10 * 6) and set(summed) == set(range(10))
