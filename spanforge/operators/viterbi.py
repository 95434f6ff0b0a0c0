"""Constrained Viterbi decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge import schema

STATES = ("O", "B", "M", "E", "S")


def best_path(emissions: list, start: dict, moves: dict, before: list[list[int]], final: list[int]) -> list[int]:
    """States of the best path; of equals the first in the order of `before` and `final`."""
    if not emissions:
        return []
    none = float("-inf")
    now = [emissions[0][s] + start[s] if s in start else none for s in range(len(before))]
    back = []
    for e in emissions[1:]:
        then, via = [none] * len(now), [-1] * len(now)
        for c, ps in enumerate(before):
            for p in ps:
                if now[p] > none and (via[c] < 0 or now[p] + moves[p, c] > then[c]):
                    then[c], via[c] = now[p] + moves[p, c], p
            if via[c] >= 0:
                then[c] += e[c]
        now = then
        back.append(via)
    state = max(final, key=lambda s: now[s])  # the first of equals
    path = [state]
    for via in reversed(back):
        state = via[state]
        path.append(state)
    return path[::-1]


#: Generic system, with predecessors in the order in which ties are broken: O, S, E; B, M.
_O, _B, _M, _E, _S = range(5)
BEFORE = [[_O, _S, _E], [_O, _S, _E], [_B, _M], [_B, _M], [_O, _S, _E]]
FINAL = [_O, _E, _S]


class System:
    """The states of a tagger with what may stand before each, first and last; generic, or for some types."""

    def __init__(self, types: tuple[str, ...] | None = None):
        self.states = tuple(schema.states(types))
        self.at = {s: i for i, s in enumerate(self.states)}
        self.start = [i for s, i in self.at.items() if schema.may_start(s)]
        if types is None:
            self.before, self.final = BEFORE, FINAL
        else:
            self.before = [[p for a, p in self.at.items() if schema.may_follow(a, c)] for c in self.states]
            self.final = [i for s, i in self.at.items() if schema.may_end(s)]


def decode(emissions: DataFrame, transitions: dict[tuple[str, str], int], key: str = "sid") -> DataFrame:
    """Tags of rows (key, scores array of [o, b, m, e, s] by position) -> (key, tags)."""
    at = {s: i for i, s in enumerate(STATES)}
    start = {at[s]: transitions.get(("<START>", s), 0) for s in ("O", "B", "S")}
    moves = {(p, c): transitions.get((STATES[p], STATES[c]), 0) for c, ps in enumerate(BEFORE) for p in ps}

    @F.pandas_udf("string")
    def path(scores: pd.Series) -> pd.Series:
        return scores.map(lambda rows: "".join(STATES[i] for i in best_path([list(r) for r in rows], start, moves, BEFORE, FINAL)))

    return emissions.select(key, path("scores").alias("tags"))


def fold(scores: Column, transitions: dict[tuple[str, str], int], before: list[list[int]] = BEFORE, final: list[int] = FINAL, start_from: Column | None = None, ends_inside: Column | None = None) -> Column:
    """The same as a column expression: a fold over positions that carries five paths; no Python.

    start_from: whether the row starts its text (the move from <START> holds),
    else it goes on after an O. ends_inside: whether text follows, so that the
    move to O counts at the end. Both are left out for whole texts. A path
    is copied at each position, so this is for rows of sentence length.
    """
    t = lambda p, c: F.lit(transitions.get((p, c), 0)).cast("long")
    low = F.lit(-(2**60)).cast("long")
    names = dict(enumerate(STATES))
    cell = lambda score, path: F.struct(score.alias("score"), path.alias("path"))
    first = F.element_at(scores, 1)
    begin = lambda s: t("<START>", s) if start_from is None else F.when(start_from, t("<START>", s)).otherwise(t("O", s))
    start = F.array(*[cell(first[i].cast("long") + begin(s) if s in "OBS" else low, F.lit(s)) for i, s in names.items()])

    def best_of(options: list[Column]) -> Column:
        best = options[0]
        for o in options[1:]:
            best = F.when(o["score"] > best["score"], o).otherwise(best)
        return best

    def step(acc, e):
        out = []
        for c, ps in enumerate(before):
            best = best_of([cell(acc[p]["score"] + t(names[p], names[c]), acc[p]["path"]) for p in ps])
            out.append(cell(F.when(best["score"] <= low / 2, low).otherwise(best["score"] + e[c].cast("long")), F.concat(best["path"], F.lit(names[c]))))
        return F.array(*out)

    def finish(acc):
        more = lambda f: F.lit(0).cast("long") if ends_inside is None else F.when(ends_inside, t(names[f], "O")).otherwise(F.lit(0).cast("long"))
        return best_of([cell(acc[f]["score"] + more(f), acc[f]["path"]) for f in final])["path"]

    return F.when(F.size(scores) == 0, F.lit("")).otherwise(F.aggregate(F.slice(scores, 2, F.size(scores)), start, step, finish))
