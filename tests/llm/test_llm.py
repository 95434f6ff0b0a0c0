"""Training-data operators against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import bpe, chat, embeddings, fingerprints, graph, jaccard, katz, mixing, quality, sharding, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string"
PASSAGE = " ".join(f"w{i}" for i in range(40))


def corpus_rows():
    rng = np.random.default_rng(3)
    vocabulary = [f"term{i}" for i in range(60)] + ["The", "naïve", "日本語", "🙂", "it's", "don't", "12,5"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, text(int(rng.integers(1, 90))), "en", f"src{i % 3}") for i in range(40)]
    base = rows[5][1]
    rows += [(40 + k, f"{base} tail{k}" if k % 2 else base, "en", "src0") for k in range(8)]
    rows += [(50 + k, f"{text(9)}\n{PASSAGE}\n{text(7)}", "fr", None) for k in range(5)]
    rows += [(60, None, None, None), (61, "", "en", "src1"), (62, "   \n\t ", "en", "src1"), (63, "one", "en", "src2"), (64, "a <|endoftext|> b　c", "en", "src2"), (65, text(3000), "en", "src1")]
    rows += [(66, "twice the same row", "en", "src0")] * 2 + [(None, f"{PASSAGE} null id", "en", "src0")]
    return [(*r, len(r[1]) if r[1] else 0, "x", "y") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def ident(r):
    return -1 if r[0] is None else r[0]


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for r in corpus_rows():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((ident(r), len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [(ident(r), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, block_bytes=2000).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.encode_decode(empty).count() == 0


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_edited(docs).collect()
    order = sorted(corpus_rows(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        want.append((ident(r), len(t), sha(t[: len(t) - m] + nxt[:m])))
    assert sorted((ident(r), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    text = {ident(r): r[1] or "" for r in corpus_rows()}
    by = collections.defaultdict(set)
    for r in got:
        by[text[ident(r)]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by.values())
    longer = [r for r in got if r.n_chars > 200 and text[ident(r)].count("w1 ") == 0]
    assert np.mean([r.near_edited for r in longer]) > np.mean([r.near_next for r in longer])
    assert fingerprints.fingerprint_edited(empty).count() == 0


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_next_texts_of_repeated_and_null_ids(spark, monkeypatch, most):
    monkeypatch.setattr(fingerprints, "MOST_RANGES", most)
    monkeypatch.setattr(fingerprints, "parallelism", lambda s: 12)
    rng = np.random.default_rng(3)
    rows = [(int(i), f"t{k}") for k, i in enumerate(rng.integers(-50, 1000, 60))] + [(77, f"same{k}") for k in range(80)] + [(None, f"none{k}") for k in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r.text: r.h for r in d.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    got = fingerprints.in_order(d, "doc_id", "text")
    assert {r.text: r.next_text for r in got.collect()} == {r[1]: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    assert got.select("_row").distinct().count() == len(rows)
    parts = d.select(fingerprints._ranges(d, "doc_id", "text", 12).alias("p"), "doc_id")
    assert parts.where("doc_id is null").distinct().count() > 1 and (most < 12 or parts.where("doc_id = 77").distinct().count() > 1)


def test_likeness_of_equal_and_unlike(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v w")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edited(rows).collect()}
    assert got[2].near_next == 1.0 and got[1].near_next == 0.0


def test_quality_learns_held_out_labels(spark, docs, empty):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("w" + "abcdefgh"[k % 8] * (k % 5 + 1) + str(k) for k in rng.integers(0, 300, 60))
    bad = lambda: "BUY $$$ " * 30 + str(rng.integers(9))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    d = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert all(got[i].predicted == int(bool(i % 3)) for i in range(300) if got[i].held_out)
    assert {r.score for r in quality.classify(d, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_isotonic_is_monotone():
    x, y = np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8])
    edges, values = quality.isotonic(x, y, np.ones(6))
    assert (np.diff(values) > 0).all() and edges[-1] == 5 and math.isclose(values[1], 1 / 3)


def test_quality_equals_least_squares_at_once(spark):
    """Partition sums and binned calibration against one solve, and isotonic means by their max-min formula."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA!", "12", "d,"], int(n))) for n in rng.integers(5, 60, 120)]
    y = (rng.random(120) < 0.6).astype(int)
    d = spark.createDataFrame([(t, int(v)) for t, v in zip(texts, y)], "text string, y int")
    model = quality.fit(quality.with_statistics(d, "text", "y").select("stats", "y"), n_features=20, ridge=2.0, sums=3, bins=200)
    x = quality.matrix(texts)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(x.var(0), 1e-12)), rtol=1e-6)
    f = model.features(x)
    w = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    beta = np.linalg.lstsq(np.vstack([f * np.sqrt(w)[:, None], np.sqrt(2.0) * np.eye(f.shape[1])]), np.concatenate([y * np.sqrt(w), np.zeros(f.shape[1])]), rcond=None)[0]
    assert np.allclose(f @ model.beta, f @ beta, atol=1e-6)
    at = np.clip(np.rint(f @ model.beta * 100), -100, 200).astype(int)
    for k in range(0, 120, 7):
        low = [a for a in np.unique(at) if a <= at[k]]
        high = [b for b in np.unique(at) if b >= at[k]]
        want = max(min(y[(at >= a) & (at <= b)].mean() for b in high) for a in low)
        assert math.isclose(model.score(x[k : k + 1])[0], want, abs_tol=1e-9)


def windows(rows, width=13):
    seen, out = collections.defaultdict(lambda: math.inf), []
    number = lambda r: math.inf if r[0] is None else r[0]
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = min(seen[k], number(r))
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] < number(r):
                gone[i : i + width] = [True] * width
        out.append((ident(r), len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def test_substrings(docs, empty):
    got = [(ident(r), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, block_words=300).collect()]
    assert sorted(got) == sorted(windows(corpus_rows()))
    assert substrings.remove_repeats(empty).count() == 0
    kept = substrings.cleaned(docs)
    assert kept.columns == docs.columns
    by = {ident(r): r for r in kept.collect()}
    assert by[50].text == [r for r in corpus_rows() if r[0] == 50][0][1] and PASSAGE not in by[52].text and by[52].n_chars == len(by[52].text)


def test_substrings_of_one_word_over_and_over(spark):
    rows = [(1, "again " * 70_000), (2, "first " + "again " * 70_000 + "last"), (3, PASSAGE), (4, f"{PASSAGE} more"), (5, "a b " * 40_000), (6, "a b " * 40_000)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (70_000, 0), 2: (70_002, 70_000), 3: (40, 0), 4: (41, 40), 5: (80_000, 0), 6: (80_000, 80_000)}
    assert {r.doc_id: r.kept for r in got}[2] == "first last"


def test_suffix_automaton():
    a = substrings.SuffixAutomaton()
    a.add("abcbc")
    a.add("bcd")
    known = {s[i:j] for s in ("abcbc", "bcd") for i in range(5) for j in range(i + 1, 6)}
    for text in ("xabcd", "bcbcbc", "cbcd", ""):
        want = [max([k for k in range(j + 1) if text[j - k : j] in known and k], default=0) for j in range(1, len(text) + 1)]
        assert a.matching(text) == want


def test_strip_reference(spark, docs):
    ref = spark.createDataFrame([(PASSAGE,), (None,)], "text string")
    got = {ident(r): r.n_removed for r in substrings.strip_reference(docs, ref).collect()}
    assert got[50] == got[54] == 40 and got[1] == 0 and got[60] == 0
    with pytest.raises(ValueError):
        substrings.strip_reference(docs, ref, most_words=10)


def fill(sizes, total=1.5, limit=2.0):
    """Repeated sharing, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = total * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
            free.discard(s)


def test_mixing(docs, empty):
    rows = corpus_rows()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = fill(sizes)
    got = mixing.mix(docs, keep=True).collect()
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r.row.text or "")) and 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == sizes[r.row.source] and math.isclose(r.target, want[r.row.source], rel_tol=1e-9)
        taken[r.row.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]) for s in sizes)
    again = {(ident(r), r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(ident(r), r.taken) for r in got}
    assert mixing.mix(empty).count() == 0


def test_mixed_copies_meet_the_targets(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["x"] * int(n)), None if i % 4 == 3 else f"s{i % 4}") for i, n in enumerate(rng.integers(20, 400, 1600))]
    rows += [(2000 + i, "", f"s{i % 3}") for i in range(300)] + [(3000 + i, None, "none") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    target, taken, emitted, empty = {}, collections.Counter(), collections.Counter(), collections.Counter()
    for r in mixing.mix(d, keep=True).collect():
        target[r.row.source] = r.target, r.source_size
        assert 0 <= r.copies <= 2 and (not r["size"] or abs(r.copies - r.taken / r["size"]) < 1)
    said = [(r.doc_id, r.source) for r in p.mixed(spark, d, "").collect()]
    for i, s in said:
        emitted[s] += size[i]
        empty[s] += not size[i]
    assert len({round(t / n, 2) for t, n in target.values() if n}) > 2
    for s, (want, whole) in target.items():
        assert abs(emitted[s] - want) <= max(400, 0.01 * want)
        assert abs(empty[s] - (want / whole * 100 if s in ("s0", "s1", "s2") else 5 * (s == "none"))) <= 1
    assert sorted(said, key=str) == sorted([(r.doc_id, r.source) for r in p.mixed(spark, d.repartition(5), "").collect()], key=str)
    emitted.clear()
    for r in mixing.mix(d, cell_words=5000, keep=True).collect():
        taken[r.row.source] += r.taken
        emitted[r.row.source] += r.copies * r["size"]
    assert all(abs(emitted[s] - taken[s]) <= 0.03 * taken[s] for s in target)


def test_sainte_lague(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 1.2}
    p = spark.createDataFrame([(k, v, 17, 0) for k, v in votes.items()], "party string, votes double, seats long, g int")
    got = {r.party: r.won for r in mixing.apportion(p, ["g"], "votes", "seats").collect()}
    want = collections.Counter({k: 0 for k in votes})
    for _ in range(17):
        best = max(sorted(votes), key=lambda k: votes[k] / (2 * want[k] + 1))
        want[best] += 1
    assert got == dict(want)


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, run string, key string"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "assistant", "c"), (4, 0, "system", "s"), (4, 1, "bot", None), (None, None, None, "odd"), (5, 0, "user", "x"), (5, 0, "user", "x")]
    rows += [(6, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(1000)] + [(7, 0, "user", "long " * 500_000), (8, 0, None, None), (9, 0, "assistant", ""), (9, 1, " Assistant ", "b"), (9, None, "user", "last")]
    d = spark.createDataFrame([(*r, "z", "k") for r in rows], kind)
    got = {r.conv_id: r for r in chat.format_chats(d, run_chars=10_000).collect()}
    assert len(got) == 10
    assert got[1].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n" and got[1].cost == 0
    assert (got[2].relabels, got[2].inserts, got[2].cost) == (1, 0, 2.0)
    assert got[3].rendered.startswith("<|user|>\na\nb<|end|>") and got[3].merges == 1
    assert got[4].cost == 2.0 and got[None].rendered == "<|user|>\nodd<|end|>\n" and got[5].rendered == "<|user|>\nx\nx<|end|>\n"
    assert got[6].n_turns == 1000 and got[6].cost == 0 and got[6].rendered.count("<|end|>") == 1000 and got[7].rendered == "<|user|>\n" + "long " * 500_000 + "<|end|>\n"
    assert got[8].rendered == "<|user|>\n<|end|>\n" and got[9].n_turns == 3 and got[9].rendered.endswith("last<|end|>\n")
    parts = chat.format_chats(d, run=100, part_chars=4000).where("conv_id = 6").orderBy("part").collect()
    assert len(parts) > 1 and "".join(p.rendered for p in parts) == got[6].rendered and sum(p.n_turns for p in parts) == 1000
    assert chat.format_chats(d.limit(0)).count() == 0


def cheapest_repair(roles):
    """The least cost over all ways to merge, relabel and insert, tried one by one."""
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    best = [math.inf]

    def go(i, last, cost):
        if i == len(roles):
            if last in ("user", "assistant"):
                best[0] = min(best[0], cost)
            return
        if last is not None:
            go(i + 1, last, cost + 1 + 2 * (roles[i] != last))
        for t in legal[last]:
            go(i + 1, t, cost + 2 * (roles[i] != t))
            for u in legal[t]:
                go(i + 1, u, cost + 3 + 2 * (roles[i] != u))
                for v in legal[u]:
                    go(i + 1, v, cost + 6 + 2 * (roles[i] != v))

    go(0, None, 0)
    return best[0]


def test_chat_equals_brute_force_for_every_run(spark):
    rng = np.random.default_rng(2)
    rows = [(c, i, str(rng.choice(["user", "assistant", "system", "tool"])), rng.choice(["", f"{c}-{i}"])) for c in range(40) for i in range(1 + c % 6)]
    d = spark.createDataFrame([(*r[:3], str(r[3])) for r in rows], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(d).collect()}
    for c, r in got.items():
        own = [x for x in rows if x[0] == c]
        assert r.cost == cheapest_repair([x[2] for x in own]) == r.merges + 2 * r.relabels + 3 * r.inserts
        said = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", r.rendered, re.S)
        assert len(said) == r.n_out == r.n_turns - r.merges + r.inserts and "".join(f"<|{a}|>\n{t}<|end|>\n" for a, t in said) == r.rendered
        order = [a for a, _ in said]
        alternating = order[order[0] == "system" :]
        assert alternating and alternating == [("user", "assistant")[k % 2] for k in range(len(alternating))]
        assert [x for _, t in said for x in t.split("\n") if x] == [x[3] for x in own if x[3]]
    for run in (1, 2, 4):
        assert {r.conv_id: r.rendered for r in chat.format_chats(d.repartition(3), run=run).collect()} == {c: r.rendered for c, r in got.items()}


def brute_katz(rows, order):
    low = {c: c + 32 for c in range(65, 91)}
    seqs = [(r[0], ["<s>", *WORD.findall((r[1] or "").translate(low)), "</s>"]) for r in rows]
    count = [collections.Counter() for _ in range(order + 1)]
    for i, s in seqs:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            for m in range(1, order + 1):
                count[m].update(tuple(s[j : j + m]) for j in range(len(s) - m + 1))
    starts = count[1].pop(("<s>",), 0)
    total, types = sum(count[1].values()), len(count[1])
    hist = lambda c: [0, *(sum(v == r for v in c.values()) for r in range(1, 7))]
    d = [None] + [katz.good_turing(hist(count[m])) for m in range(1, order + 1)]
    cut = lambda m, c: (d[m][c] if c <= katz.TOP else 1) * c
    known = sum(cut(1, c) for c in count[1].values()) / total
    unknown = max(1 - known, 1 / (total + 1))
    after = collections.defaultdict(list)
    for m in range(2, order + 1):
        for g in count[m]:
            after[g[:-1]].append(g[-1])
    seen = lambda h: starts if h == ("<s>",) else count[len(h)][h]

    def chance(h, w):
        if not h:
            c = count[1][(w,)]
            return cut(1, c) * (1 - unknown) / (known * total) if c else unknown
        n = seen(h)
        if not n:
            return chance(h[1:], w)
        m = len(h) + 1
        mass = sum(cut(m, count[m][(*h, x)]) for x in after[h])
        keep = n / (n + 1) if mass >= n * (1 - 1e-12) else 1
        c = count[m][(*h, w)]
        if c:
            return keep * cut(m, c) / n
        return (1 - keep * mass / n) / (1 - sum(chance(h[1:], x) for x in after[h])) * chance(h[1:], w)

    out = []
    for i, s in seqs:
        best = sum(math.log10(chance(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s)))
        base = sum(math.log10((count[1][(w,)] + 1) / (total + types + 1)) for w in s[1:])
        out.append((-1 if i is None else i, len(s) - 1, sum(count[1][(w,)] > 0 for w in s[1:]), total, round(base, 6), round(best, 6)))
    history = next(h for h in after if len(h) == 1)
    assert math.isclose(sum(chance(history, w) for (w,) in count[1]) + chance(history, "\0"), 1, rel_tol=1e-9)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_katz(docs, order):
    got = katz.score(docs, order=order, block_words=400).collect()
    assert sorted((ident(r), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(brute_katz([r for r in corpus_rows()], order))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


def test_katz_of_nothing(empty):
    assert katz.score(empty).count() == 0


def test_katz_tables_score_other_documents(spark, docs):
    model = katz.train(docs, order=3, block_words=400)
    same = lambda df: sorted((ident(r), r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in df.collect())
    assert same(model.score(docs.repartition(2), block_words=300)) == same(katz.score(docs, order=3, block_words=400))
    other = spark.createDataFrame([(1, "term1 term2 never seen"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in model.score(other).collect()}
    assert (got[1].n_tokens, got[1].n_known) == (5, 3) and got[2].n_tokens == 1 and got[1].score < got[2].score < 0
    assert model.score(other.limit(0)).count() == 0


def greedy(sizes, capacity):
    runs, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return 10**9
        if s > room:
            runs, room = runs + 1, capacity
        room -= s
    return runs


@pytest.mark.parametrize("n,shards,seed", [(300, 7, 0), (40, 5, 1), (3, 24, 2), (2000, 24, 3)])
def test_minimax_cuts(spark, n, shards, seed):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
    sizes = rng.integers(1, 1000, len(keys)) ** 2 // 1000 + 1
    groups = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "key long, bytes long")
    capacity, starts = sharding.minimax_cuts(groups, shards)
    own = sizes.tolist()
    assert greedy(own, capacity) <= shards and greedy(own, capacity - 1) > shards
    parts = np.searchsorted(np.array(starts, np.int64), keys, side="right")
    assert len(starts) < shards and max(np.bincount(parts, weights=sizes)) <= capacity


def test_shards(docs, empty):
    got = sharding.shard(docs).collect()
    text = collections.Counter((ident(r), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus_rows())
    assert collections.Counter((ident(r), r["size"], r.text_crc32) for r in got) == text
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = collections.defaultdict(set)
    for r in got:
        by[r["size"], r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in by.values())
    assert sharding.shard(empty).count() == 0


def brute_jaccard(rows, n=5, threshold=0.8):
    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    links, up = collections.Counter(), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= threshold * len(a | b):
                links.update([i, j])
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    number = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    head = {}
    for i in range(len(rows)):
        head[find(i)] = min(head.get(find(i), (True, 2**63)), number(i))
    return sorted((ident(r), -1 if head[find(i)][0] else head[find(i)][1], links[i]) for i, r in enumerate(rows))


def test_jaccard(docs, empty):
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((ident(r), -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == brute_jaccard(corpus_rows())
    one = jaccard.keep_one(docs)
    assert one.columns == docs.columns
    left = [ident(r) for r in one.collect()]
    assert sorted(left) == sorted({c for _, c, _ in brute_jaccard(corpus_rows())})
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    base = [f"b{i}" for i in range(60)]
    rows = [(k, " ".join(base[:-1] + [f"z{k}"] if k % 3 else base[: 40 + k])) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(d).collect()) == brute_jaccard(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (7, 8)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 8))
    vectors = [(centre[k % 6] + rng.standard_normal(8) * (0.05 if k % 2 else 0.12)).astype(np.float32).tolist() for k in range(120)]
    rows = [(k, v, k % 2) for k, v in enumerate(vectors)] + [(200 + k, vectors[0], 0) for k in range(5)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0, None] * 4, 0), (304, vectors[0], None), (305, vectors[0][:4], 0), (306, [], 0), (307, [float("inf")] * 8, 0)]
    rows += [(400, vectors[7], 1), (400, vectors[7], 1), (None, vectors[9], 1)]
    d = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    sound = [(k, np.array(v, np.float64), c) for k, (_, v, c) in enumerate(rows) if c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = collections.Counter(), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a, c) in enumerate(sound):
        for j, b, e in sound[:x]:
            if c == e and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links.update([i, j])
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    assert sum(links.values()) > 20
    head = collections.defaultdict(list)  # a null id names nothing
    for k, (i, *_) in enumerate(rows):
        head[find(k)] += [] if i is None else [i]
    smallest = [min(head[find(k)], default=None) for k in range(len(rows))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted((key((i, links[k], smallest[k], i is not None and i == smallest[k])) for k, (i, *_) in enumerate(rows)))
    for table in (d, d.withColumn("embedding", F.col("embedding").cast("array<double>"))):
        got = embeddings.near_duplicates(table, tile=16).collect()
        assert sorted(key((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_quantisation_bound():
    x = np.random.default_rng(5).standard_normal((50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(x)
    bound = e[:, None] + e[None, :] + e[:, None] * e[None, :]
    assert (np.abs(x @ x.T - (q @ q.T) * s[:, None] * s[None, :]) <= bound).all()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = np.random.default_rng(6)
    vocabulary = [f"term{i}" for i in range(500)]
    good = lambda n: ". ".join(" ".join(rng.choice(vocabulary, 9)) for _ in range(n))
    rows = [(i, good(8) if i % 4 else "SPAM !!! " * 40 + str(i), "en", f"s{i % 2}") for i in range(160)]
    rows += [(200, rows[1][1], "en", "s0"), (201, f"{good(3)} {PASSAGE}", "en", "s0"), (202, f"{good(3)} {PASSAGE}", "en", "s1")]
    d = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    first = left["quality classifier"]
    assert all(i in first for i in range(160) if i % 4) and not any(i in first for i in range(0, 160, 4))
    assert 200 not in left["n-gram Jaccard join"] and 1 in left["n-gram Jaccard join"]
    assert PASSAGE in left["substring dedup"][201] and PASSAGE not in left["substring dedup"][202]
    mixed = [(r.doc_id, r.text) for r in docs.collect()]
    assert max(collections.Counter(i for i, _ in mixed).values()) <= 2
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in mixed)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted((i, len(tok.encode(t, add_special_tokens=False).ids)) for i, t in mixed)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    kind = "doc_id long, text string, source string, size int, taken string, cell double, row string, copies date, _copy long, score double, stats string, cls long, kept boolean"
    rng = np.random.default_rng(9)
    good = lambda n: ". ".join(" ".join(rng.choice([f"term{i}" for i in range(300)], 9)) for _ in range(n))
    rows = [(i, good(6) if i % 2 else "SPAM !!! " * 40 + str(i), f"s{i % 3}") for i in range(60)]
    rows += [(None, "SPAM !!! " * 41, None), (None, good(5), None), (7, "SPAM !!! " * 42, "s1"), (None, None, "s0"), (71, "", "s0"), (72, good(2000), "s2"), (73, rows[1][1], "s1"), (74, "tie " * 30, "s1"), (75, "tie " * 30, "s1")]
    d = spark.createDataFrame([(*r, 1, "t", 0.5, "r", None, 9, 0.1, "s", 3, True) for r in rows], kind)
    spark.createDataFrame([(i, i % 2, 0) for i in range(60) if i != 7], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (d, d.limit(0)):
        docs, seen = table, {}
        for k, (name, stage) in enumerate(p.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{table is d}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{table is d}{k}"))
            assert k == 4 or docs.schema.names == d.schema.names and docs.dtypes == d.dtypes
            seen[name] = docs.collect()
        if table is not d:
            assert not any(seen.values())
            continue
        judged = [(r.doc_id, r.text) for r in seen["quality classifier"]]
        assert not any((t or "").startswith("SPAM") for _, t in judged) and (7, rows[7][1]) in judged and (None, rows[61][1]) in judged
        unlike = [(r.doc_id, r.text) for r in seen["n-gram Jaccard join"]]
        assert (1, rows[1][1]) in unlike and (73, rows[1][1]) not in unlike and (72, rows[65][1]) in unlike
        assert all(r.row == "r" and r["size"] == 1 and r.kept for r in seen["mixing sources to target weights"])
        assert len(seen["BPE encoding and decoding"]) == len(seen["mixing sources to target weights"])
