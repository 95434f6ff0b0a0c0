"""Chat formatting by minimum-cost role repair over a legal-turn automaton."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import stored

ROLES = ("system", "user", "assistant")
#: States: the role of the last turn written, or the start.
START, STATES = 0, (None, *ROLES)
#: The turns that may follow each state.
FOLLOW = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: A conversation may end after these.
ENDS = (2, 3)
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0


def _moves() -> dict[str | None, list[list[tuple[float, int, int, tuple[int, ...], bool]]]]:
    """For a turn's role: per state, (cost, next state, order, roles of empty turns put before, merged)."""
    found: dict = {}
    for role in (*ROLES, None):
        by_state = []
        for s in range(len(STATES)):
            options = []
            if s != START:
                options.append((MERGE + (0.0 if role == STATES[s] else RELABEL), s, 1, (), True))
            for t in FOLLOW[s]:
                options.append((0.0 if role == STATES[t] else RELABEL, t, 0, (), False))
                for u in FOLLOW[t]:
                    options.append((INSERT + (0.0 if role == STATES[u] else RELABEL), u, 2, (t,), False))
                    for v in FOLLOW[u]:
                        options.append((2 * INSERT + (0.0 if role == STATES[v] else RELABEL), v, 3, (t, u), False))
            best: dict = {}
            for o in sorted(options, key=lambda o: (o[0], o[2], o[1])):
                best.setdefault(o[1], o)
            by_state.append(sorted(best.values(), key=lambda o: (o[0], o[2], o[1])))
        found[role] = by_state
    return found


MOVES = _moves()


def walk(roles: list[str | None], now: list[float]) -> tuple[list[float], list[list[tuple[int, tuple] | None]]]:
    """Cheapest ways on from states with costs `now` over some turns, with the steps back.

    Of equal ways the one from the first state is kept, and of its moves the first.
    """
    back = []
    for role in roles:
        then, via = [math.inf] * len(STATES), [None] * len(STATES)
        moves = MOVES[role if role in ROLES else None]
        for s, c in enumerate(now):
            if c < math.inf:
                for o in moves[s]:
                    if c + o[0] < then[o[1]]:
                        then[o[1]], via[o[1]] = c + o[0], (s, o)
        now = then
        back.append(via)
    return now, back


def from_state(s: int) -> list[float]:
    return [0.0 if s == t else math.inf for t in range(len(STATES))]


def steps_to(back: list, end: int) -> tuple[int, list[tuple]]:
    """(state before the turns, their moves) of the cheapest way to `end`."""
    steps = []
    for via in reversed(back):
        end, move = via[end]
        steps.append(move)
    return end, steps[::-1]


def render(texts: list[str], steps: list[tuple], first: bool, last: bool) -> str:
    """The text of some turns of a conversation; those of its runs, joined, are the whole.

    A turn is closed by what follows it: the next turn that isn't merged into it, or the end.
    """
    out = []
    for k, (text, (_, state, _, before, merged)) in enumerate(zip(texts, steps, strict=True)):
        if merged:
            out.append(f"\n{text}")
            continue
        if k or not first:
            out.append("<|end|>\n")
        out += [f"<|{STATES[t]}|>\n<|end|>\n" for t in before]
        out.append(f"<|{STATES[state]}|>\n{text}")
    return "".join([*out, "<|end|>\n"] if last else out)


_RUN = "key string, part int, seq long"
_RUN_KIND = [("key", pa.string()), ("part", pa.int32()), ("seq", pa.int64())]


def _along(rows: DataFrame, down: bool, step, schema: str, kind: pa.Schema) -> DataFrame:
    """step(row, what it said of the run before, or None) -> row, over the runs of each conversation in order.

    A conversation's runs stream through one task, a few numbers each; none is held.
    """
    order = [F.desc("part"), F.desc("seq")] if down else ["part", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = None
        for b in batches:
            out = []
            for row in b.to_pylist():
                said = step(row, said if said and said["key"] == row["key"] else None)
                out.append(said)
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, schema)


def _each(rows: DataFrame, one, schema: str, kind: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(r) for r in b.to_pylist()], schema=kind)

    return rows.mapInArrow(run, schema)


def cut(rows: DataFrame, run: int, run_chars: int) -> DataFrame:
    """Conversations as runs of up to `run` turns and about `run_chars` characters, in order of (part, seq).

    Turns are sorted over the cluster by range, so a conversation of any size
    is spread; a run ends where its range does.
    """
    kind = pa.schema([*_RUN_KIND, ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
    order = ["key", "turn", "role", "hash"]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").select("key", "role", "text")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, roles, texts, held = TaskContext.get().partitionId(), 0, None, [], [], 0
        for b in batches:
            for k, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if roles and (k != key or len(roles) >= run or held >= run_chars):
                    yield pa.RecordBatch.from_pylist([{"key": key, "part": part, "seq": seq, "roles": roles, "texts": texts}], schema=kind)
                    seq, roles, texts, held = seq + 1, [], [], 0
                key = k
                roles.append(role)
                texts.append(text)
                held += len(text)
        if roles:
            yield pa.RecordBatch.from_pylist([{"key": key, "part": part, "seq": seq, "roles": roles, "texts": texts}], schema=kind)

    return dealt.mapInArrow(runs, f"{_RUN}, roles array<string>, texts array<string>")


def format_chats(turns: DataFrame, run: int = 256, run_chars: int = 1 << 20, part_chars: int = 1 << 26, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Repaired and rendered conversations, a row each.

    Legal: at most one system turn, first; then user and assistant in turn,
    user first; no other turn alone. Repairs: merge a turn into the one before,
    on a new line (1), relabel it (2; roles that aren't known always need it),
    insert an empty turn before it (3). Costs add; the cheapest sequence is
    taken. Of equal ones, from the last turn back, the one that comes from the
    first state, by the first move in MOVES.

    The dynamic programme goes over a conversation in runs, so that no task
    holds the whole: each run tells what it costs from each state to each; a
    fold over these tells what each state costs before each run; with that, each
    run tells from which state a way to each state comes; a fold back over these
    chooses the states at the cuts, and each run is rendered between its own
    two. Costs are whole, so the result is that of one programme over the whole
    conversation, for every `run`.

    A conversation is one row (`part` 0) unless its text is longer than
    `part_chars`: it then goes on in further rows, and the counts are those of each.
    Turns stand in the order of their number (null last), then role, then a hash
    of the text and the text, so ties and repeated rows have one result. A null role is unknown, a null
    text empty, null conversation ids are one conversation. Very long texts
    are whole. An empty table gives no rows; other columns are left out, whatever
    their names. Returns conv_id, part, n_turns, n_out, merges, relabels, inserts,
    cost, rendered, rendered_sha256.
    """
    conv = turns.schema[conv_col].dataType
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n"))
    rows = turns.select(key.alias("key"), F.coalesce(F.col(turn_col).cast("long"), F.lit(2**63 - 1)).alias("turn"), F.lower(F.trim(F.col(role_col))).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = stored(cut(rows, run, run_chars), "runs")
    numbers = pa.list_(pa.float64())
    own = lambda r: {"key": r["key"], "part": r["part"], "seq": r["seq"]}
    k = len(STATES)

    def matrix(r: dict) -> dict:
        return own(r) | {"cells": [c for s in range(k) for c in walk(r["roles"], from_state(s))[0]]}

    def forward(r: dict, before: dict | None) -> dict:
        start = before["end"] if before else from_state(START)
        return own(r) | {"start": start, "end": [min(start[s] + r["cells"][s * k + e] for s in range(k)) for e in range(k)]}

    def came(r: dict) -> dict:
        _, back = walk(r["roles"], r["start"])
        return own(r) | {"end": r["end"], "came": [steps_to(back, e)[0] if r["end"][e] < math.inf else -1 for e in range(k)]}

    def backward(r: dict, after: dict | None) -> dict:
        last = after is None
        state = min(ENDS, key=lambda e: (r["end"][e], e)) if last else after["before"]
        return own(r) | {"state": state, "before": r["came"][state], "last": last}

    def write(r: dict) -> dict:
        _, back = walk(r["roles"], r["start"])
        before, steps = steps_to(back, r["state"])
        relabels = sum(a != STATES[s[1]] for a, s in zip(r["roles"], steps, strict=True))
        inserts, merges = sum(len(s[3]) for s in steps), sum(s[4] for s in steps)
        return own(r) | {
            "n_turns": len(steps), "n_out": len(steps) - merges + inserts, "merges": merges, "relabels": relabels, "inserts": inserts,
            "cost": sum(s[0] for s in steps), "rendered": render(r["texts"], steps, before == START, r["last"]),
        }

    at = ["key", "part", "seq"]
    cells = _each(runs.select(*at, "roles"), matrix, f"{_RUN}, cells array<double>", pa.schema([*_RUN_KIND, ("cells", numbers)]))
    ways = stored(_along(cells, False, forward, f"{_RUN}, start array<double>, end array<double>", pa.schema([*_RUN_KIND, ("start", numbers), ("end", numbers)])), "ways")
    backs = _each(runs.select(*at, "roles").join(ways, at), came, f"{_RUN}, end array<double>, came array<int>", pa.schema([*_RUN_KIND, ("end", numbers), ("came", pa.list_(pa.int32()))]))
    states = _along(backs, True, backward, f"{_RUN}, state int, before int, last boolean", pa.schema([*_RUN_KIND, ("state", pa.int32()), ("before", pa.int32()), ("last", pa.bool_())]))
    counts = ("n_turns", "n_out", "merges", "relabels", "inserts")
    kind = pa.schema([*_RUN_KIND, *[(c, pa.int64()) for c in counts], ("cost", pa.float64()), ("rendered", pa.string())])
    said = _each(runs.join(ways.drop("end"), at).join(states.drop("before"), at), write, f"{_RUN}, {', '.join(f'{c} long' for c in counts)}, cost double, rendered string", kind)
    said = said.withColumn("size", F.length("rendered"))
    along = Window.partitionBy("key").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("piece", F.floor(F.coalesce(F.sum("size").over(along), F.lit(0)) / part_chars).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "rendered"))), lambda x: x["rendered"]), "")
    out = said.groupBy("key", "piece").agg(*[F.sum(c).alias(c) for c in counts], F.sum("cost").alias("cost"), whole.alias("rendered"))
    name = F.when(F.col("key") != "n", F.expr("substring(key, 2)")).cast(conv)
    return out.select(name.alias("conv_id"), F.col("piece").alias("part"), *counts, "cost", "rendered", F.sha2("rendered", 256).alias("rendered_sha256"))
