"""Choice among representations: skyline, totals, normalisers, weighted cost and budgeted plans."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes that a release must save on its best benchmark.
GATE = 32


def pareto(candidates: DataFrame, group: str, goals: list[str], row: list[str]) -> DataFrame:
    """Rows that none of their group dominates (no worse in all goals, better in one); exact ties stay."""
    c, d = candidates.alias("c"), candidates.select(group, *goals).distinct().alias("d")
    worse = F.col(f"c.{group}") == F.col(f"d.{group}")
    better = F.lit(False)
    for g in goals:
        worse &= F.col(f"d.{g}") <= F.col(f"c.{g}")
        better |= F.col(f"d.{g}") < F.col(f"c.{g}")
    return c.join(d, worse & better, "left_anti").select(*row)


def local_best(candidates: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The least row of each group by the given columns."""
    return candidates.groupBy(group).agg(F.min(F.struct(*order)).alias("m")).select(group, *[F.col(f"m.{c}").alias(c) for c in order])


def normalisers(candidates: DataFrame, group: str, raw: str, encode: str, decode: str) -> DataFrame:
    """Sums over groups of the raw size and the largest encode and decode costs, each at least 1."""
    per = candidates.groupBy(group).agg(F.max(raw).alias("r"), F.max(encode).alias("e"), F.max(decode).alias("d"))
    return per.agg(*[F.greatest(F.sum(x), F.lit(1)).alias(n) for x, n in (("r", "raw_total"), ("e", "encode_total"), ("d", "decode_total"))])


def weighted(candidates: DataFrame, totals: DataFrame, stored: str, encode: str, decode: str) -> DataFrame:
    """Adds cost = 0.50 stored + 0.20 encode + 0.30 decode, each over its total; totals is one row."""
    cost = 0.50 * F.col(stored) / F.col("raw_total") + 0.20 * F.col(encode) / F.col("encode_total") + 0.30 * F.col(decode) / F.col("decode_total")
    return candidates.crossJoin(F.broadcast(totals)).withColumn("cost", cost).drop("raw_total", "encode_total", "decode_total")


def classical_plan(strategies: DataFrame, *, size: float = 1.0, time: float = 0.0, memory: float = 0.0, max_decode_ms: float | None = None, max_memory_mb: float | None = None) -> DataFrame:
    """Per group the feasible strategy with the least weighted objective, the first by ord on ties; infeasible groups have null ord."""
    ok = within(("decode_ms", max_decode_ms), ("memory_mb", max_memory_mb))
    objective = size * F.col("size") + time * F.col("decode_ms") + memory * F.col("memory_mb")
    best = strategies.groupBy("group_id").agg(F.min(F.when(ok, F.struct(objective.alias("objective"), F.col("ord")))).alias("m"))
    return best.select("group_id", F.col("m.ord").alias("ord"), F.col("m.objective").alias("objective"))


def global_plan(blocks: list[list[tuple[int, int, int]]], raw_sizes: list[int], max_size: int | None = None, max_decode: int | None = None, beam: int = 4096) -> dict:
    """Budgeted choice of one (stored, encode_ns, decode_ns) per block by dynamic programming over bucketed size and time.

    Runs on collected metadata of a bounded number of blocks (no payloads). Without a decode goal the budget is relaxed
    stepwise. The best state of a bucket represents it, so the plan is a heuristic and a failure no proof.
    """
    if not blocks:
        return {"selection": (), "stored": 0, "encode": 0, "decode": 0, "score": 0.0, "size_budget": max_size, "decode_budget": max_decode, "baseline_stored": 0, "baseline_decode": 0, "peak_states": 0}
    raw, enc, dec = max(1, sum(raw_sizes)), max(1, sum(max(c[1] for c in b) for b in blocks)), max(1, sum(max(c[2] for c in b) for b in blocks))
    base = [min(range(len(b)), key=lambda k, b=b: (*b[k][:1], b[k][1], b[k][2], k)) for b in blocks]
    size, decode = (sum(b[k][j] for b, k in zip(blocks, base, strict=True)) for j in (0, 2))
    size_budget = max_size or max(size, math.ceil(1.035 * size))
    first = max_decode or max(1, math.ceil(0.90 * decode))
    for factor in (1.0,) if max_decode else (1.0, 1.1, 1.25, 1.5, 2.0, 4.0):
        budget = int(first * factor)
        unit_s, unit_d = max(1, size_budget // 2048), max(1, budget // 2048)
        states, peak = {(0, 0): (0.0, 0, 0, 0, ())}, 1
        for b in blocks:
            new: dict = {}
            for score, s, d, e, chosen in states.values():
                for k, (cs, ce, cd) in enumerate(b):
                    s2, d2 = s + cs, d + cd
                    if s2 > size_budget or d2 > budget:
                        continue
                    state = (score + 0.5 * cs / raw + 0.2 * ce / enc + 0.3 * cd / dec, s2, d2, e + ce, (chosen, k))
                    key = (s2 // unit_s, d2 // unit_d)
                    if key not in new or state[:4] < new[key][:4]:
                        new[key] = state
            kept, low_score, low_decode = {}, math.inf, math.inf
            for key, st in sorted(new.items(), key=lambda x: (x[1][1], x[1][2], x[1][0], x[1][3])):
                if st[0] < low_score or st[2] < low_decode:
                    kept[key] = st
                    low_score, low_decode = min(low_score, st[0]), min(low_decode, st[2])
            states = dict(sorted(kept.items(), key=lambda x: x[1][:4])[:beam])
            peak = max(peak, len(states))
        if states:
            score, s, d, e, chain = min(states.values(), key=lambda x: x[:4])
            chosen = []
            while chain:
                chain, k = chain
                chosen.append(k)
            return {"selection": tuple(reversed(chosen)), "stored": s, "encode": e, "decode": d, "score": score, "size_budget": size_budget, "decode_budget": budget, "baseline_stored": size, "baseline_decode": decode, "peak_states": peak}
    raise ValueError("no plan found within the goals")


def qubo(costs: DataFrame, penalty: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Coefficients (i, j, coef) and one row (penalty, constant) of one-hot choices; costs: group_id, ord, cost."""
    one = costs.agg(F.max(F.abs("cost")).alias("m"), F.countDistinct("group_id").alias("g"))
    top = one.select((F.col("m") * 10 + 1 if penalty is None else F.lit(float(penalty))).alias("penalty"), "g")
    top = top.select("penalty", (F.col("penalty") * F.col("g")).alias("constant"))
    var = F.concat_ws("_", F.lit("x"), "group_id", "ord")
    rows = costs.crossJoin(F.broadcast(top.select("penalty"))).withColumn("var", var)
    linear = rows.select(F.col("var").alias("i"), F.col("var").alias("j"), (F.col("cost") - F.col("penalty")).alias("coef"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.ord") < F.col("b.ord")))
    pairs = pairs.select(F.col("a.var").alias("i"), F.col("b.var").alias("j"), (2 * F.col("a.penalty")).alias("coef"))
    return linear.unionByName(pairs), top


def energy(groups: list[list[float]], penalty: float, chosen: np.ndarray) -> float:
    """Energy of a bit vector over all groups' variables."""
    at, total = 0, 0.0
    for g in groups:
        bits = chosen[at : at + len(g)]
        total += float(np.dot(bits, g) + penalty * (1 - bits.sum()) ** 2)
        at += len(g)
    return total


def qubo_energy(coefficients: DataFrame, top: DataFrame, bits: DataFrame) -> DataFrame:
    """One row (energy) of a bit vector (var, bit): what the coefficients of its pairs of ones add up to, and the constant."""
    ones = bits.filter("bit = 1")
    both = coefficients.join(ones.select(F.col("var").alias("i")), "i", "left_semi").join(ones.select(F.col("var").alias("j")), "j", "left_semi")
    return both.agg(F.coalesce(F.sum("coef"), F.lit(0.0)).alias("e")).crossJoin(top.select("constant")).select((F.col("e") + F.col("constant")).alias("energy"))


def within(*bounds: tuple[str, float | None]) -> Column:
    """Whether each column keeps its bound; None is no bound."""
    return reduce(lambda x, b: x & (F.col(b[0]) <= b[1]), (b for b in bounds if b[1] is not None), F.lit(True))


def exhaustive_plan(choices: DataFrame, groups: list[str], budget: float) -> DataFrame:
    """Rows (problem, best, plans): the least cost of all products of choices within the budget, and their number.

    choices: problem, grp, cost, load; one choice is taken for each group that a problem has. Groups are few and so are a group's choices.
    """
    plans = choices.select("problem").distinct().withColumns({"c": F.lit(0.0), "l": F.lit(0.0)})
    for g in groups:
        plans = plans.join(choices.filter(F.col("grp") == g).select("problem", "cost", "load"), "problem", "left")
        plans = plans.select("problem", (F.col("c") + F.coalesce("cost", F.lit(0.0))).alias("c"), (F.col("l") + F.coalesce("load", F.lit(0.0))).alias("l"))
    return plans.filter(F.round("l", 2) <= budget).groupBy("problem").agg(F.round(F.min("c"), 2).alias("best"), F.count("*").alias("plans"))


def decode_one_hot(bits: Column) -> Column:
    """Number of the one choice that a group's bit string makes, from 1; null unless exactly one bit is set."""
    return F.when(F.length(F.replace(bits, F.lit("0"))) == 1, F.instr(bits, "1"))


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as are set for shuffles: groups whose work is large for their bytes mustn't be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def global_plans(part: np.ndarray, block: np.ndarray, stored: np.ndarray, encode: np.ndarray, decode: np.ndarray, beam: int) -> np.ndarray:
    """Numbers of the rows that ``global_plan`` chooses in each part without goals; all parts go from block to block together.

    Rows lie in order of part (numbered from 0), block, stored, encode and decode.
    """
    new_block = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (block[1:] != block[:-1])])
    count, owner = np.diff(np.r_[new_block, len(part)]), part[new_block]
    first_block, n_blocks = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), np.bincount(owner)
    total = lambda x: np.add.reduceat(x, first_block)
    raw, enc, dec = (np.maximum(1, total(np.maximum.reduceat(x, new_block))) for x in (stored, encode, decode))
    size = total(stored[new_block])
    size_budget, first = np.maximum(size, np.ceil(1.035 * size).astype(np.int64)), np.maximum(1, np.ceil(0.90 * total(decode[new_block])).astype(np.int64))
    unit_s, parts, out = np.maximum(1, size_budget // 2048), np.arange(len(n_blocks)), []
    for factor in (1.0, 1.1, 1.25, 1.5, 2.0, 4.0):
        budget = (first * factor).astype(np.int64)
        unit_d, steps, best = np.maximum(1, budget // 2048), [], np.full(len(n_blocks), -1)
        own, at, score, (s, d, e) = parts, np.full(len(parts), -1), np.zeros(len(parts)), np.zeros((3, len(parts)), np.int64)
        while len(own):
            here = first_block[own] + len(steps)
            n = count[here]
            of = np.repeat(np.arange(len(own)), n)
            row = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + new_block[here][of]
            own, at, s, d, e = own[of], at[of], s[of] + stored[row], d[of] + decode[row], e[of] + encode[row]
            score = score[of] + 0.5 * stored[row] / raw[own] + 0.2 * encode[row] / enc[own] + 0.3 * decode[row] / dec[own]
            state = [own, at, row, score, s, d, e]
            take = lambda rows: [x[rows] for x in state]
            state = own, at, row, score, s, d, e = take((s <= size_budget[own]) & (d <= budget[own]))
            ks, kd = s // unit_s[own], d // unit_d[own]
            rows = np.lexsort((e, d, s, score, kd, ks, own))
            same = (own[rows][1:] == own[rows][:-1]) & (ks[rows][1:] == ks[rows][:-1]) & (kd[rows][1:] == kd[rows][:-1])
            state = own, at, row, score, s, d, e = take(rows[~np.r_[False, same][: len(rows)]])
            state = own, at, row, score, s, d, e = take(np.lexsort((e, score, d, s, own)))
            kept = np.zeros(len(own), bool)
            for x in (np.unique(score, return_inverse=True)[1], d):  # below all before it in its part; a later part is below all earlier ones
                x = x - own * (int(x.max(initial=0)) + 1)
                kept |= np.r_[True, x[1:] < np.minimum.accumulate(x)[:-1]][: len(x)]
            state = take(kept)
            own, at, row, score, s, d, e = state
            state = own, at, row, score, s, d, e = take(np.lexsort((e, d, s, score, own)))
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
            lead = np.repeat(starts, np.diff(np.r_[starts, len(own)]))
            state = own, at, row, score, s, d, e = take(np.arange(len(own)) - lead < beam)
            steps.append((at, row))
            at, done = np.arange(len(own)), n_blocks[own] == len(steps)
            ended, place = np.unique(own[done], return_index=True)  # the first state of a part is its best
            best[ended] = at[done][place]
            own, at, _, score, s, d, e = (x[~done] for x in (own, at, row, score, s, d, e))
        ready = parts[best[parts] >= 0]
        for k in range(len(steps) - 1, -1, -1):
            some = ready[n_blocks[ready] > k]
            out.append(steps[k][1][best[some]])
            best[some] = steps[k][0][best[some]]
        parts = np.setdiff1d(parts, ready)
        if not len(parts):
            return np.sort(np.concatenate(out))
    raise ValueError("no plan found within the goals")


def plan_parts(rows: DataFrame, *, beam: int = 128) -> DataFrame:
    """The global plan of each part by itself: (part, block, ord, stored, decode) as chosen; rows: part, block, ord, stored, encode, decode.

    Many small plans need fewer states each than one large plan.
    """
    order = ["part", "block", "stored", "encode", "decode", "ord"]

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pd.factorize(pdf["part"], use_na_sentinel=False)[0]
        return pdf.iloc[global_plans(part, *(pdf[c].to_numpy() for c in order[1:5]), beam)][["part", "block", "ord", "stored", "decode"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last part, of which more may come
        for pdf in filter(len, batches):
            part = pd.factorize(pdf["part"], use_na_sentinel=False)[0]
            cut = int(np.searchsorted(part, part[-1]))
            new = bool(held) and pd.factorize(pd.concat([held[0]["part"].iloc[:1], pdf["part"].iloc[:1]]), use_na_sentinel=False)[0][1] == 1
            if cut or new:
                if held or cut:
                    yield chosen(pd.concat([*held, pdf.iloc[:cut]]))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield chosen(pd.concat(held))

    dealt = by_key(rows, "part").sortWithinPartitions(*order).select(*order)
    return dealt.mapInPandas(run, rows.select("part", "block", "ord", "stored", "decode").schema)


def release_gate(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row (best, passed) of two reports (name, size): no benchmark may grow, and the best must save at least ``GATE`` bytes."""
    c = candidate.select(F.col("name").alias("other"), F.col("size").alias("now"))
    saved = F.col("size") - F.col("now")
    both = baseline.join(c, F.col("name").eqNullSafe(F.col("other")))
    return both.agg(F.max(saved).alias("best"), (F.every(saved >= 0) & (F.max(saved) >= GATE)).alias("passed"))
