import itertools
import random
import time

import numpy as np
import pytest

from cairn.functions import chunking, codecs, scalars
from cairn.operators import frontier, lattice


def slow_cuts(data, least, target, most):
    values, out, start, r = [int(x) for x in chunking.gear(target)], [], 0, 0
    for i, b in enumerate(data):
        r = ((r << 1) + values[b]) % (1 << 64)
        n = i + 1 - start
        if n >= least and (r % target == 0 or n >= most):
            out.append(i + 1)
            start, r = i + 1, 0
    return out + [len(data)] * (start < len(data))


@pytest.mark.parametrize("sizes", [(16, 64, 256), (64, 256, 1024), (8, 16, 32)])
def test_cuts_follow_the_definition(sizes):
    rng = random.Random(20260923)
    for n in (0, 1, 5, 16, 255, 1000, 5000):
        for data in (rng.randbytes(n), bytes(n), (b"repeated text\n" * n)[:n]):
            assert chunking.cuts(data, *sizes) == slow_cuts(data, *sizes)


def test_codecs_round_trip_and_report_damage():
    raw = b"block " * 500
    for codec, level in codecs.ADAPTIVE:
        payload = codecs.encode(codec, level, raw)
        assert codecs.decode(codec, payload, len(raw)) == raw
        with pytest.raises(ValueError):
            codecs.decode(codec, payload, len(raw) + 1)
    with pytest.raises(ValueError):
        codecs.decode(9, raw, len(raw))


def test_delta_recovers_either_block():
    a, b = b"abc" * 10, b"xyz" * 7
    delta = codecs.xor_padded(a, b)
    assert codecs.recover_other(a, delta, len(b)) == b and codecs.recover_other(b, delta, len(a)) == a


def test_goals():
    assert scalars.size_goal(1.5) == 1572864 and scalars.decode_goal(None) is None
    with pytest.raises(ValueError):
        scalars.size_goal(0)


def test_global_plan_is_never_better_than_the_exact_one():
    rng = random.Random(5)
    for _ in range(10):
        blocks = [[(rng.randint(1, 99), rng.randint(1, 99), rng.randint(1, 99)) for _ in range(3)] for _ in range(5)]
        plan = frontier.global_plan(blocks, [100] * 5)
        best = min(
            sum(0.5 * c[0] / 500 + 0.2 * c[1] / sum(max(x[1] for x in b) for b in blocks) + 0.3 * c[2] / sum(max(x[2] for x in b) for b in blocks) for c in chosen)
            for chosen in itertools.product(*blocks)
            if sum(c[0] for c in chosen) <= plan["size_budget"] and sum(c[2] for c in chosen) <= plan["decode_budget"]
        )
        assert plan["score"] >= best - 1e-12 and plan["stored"] <= plan["size_budget"]
    assert frontier.global_plan([], [])["selection"] == ()


def test_plan_group_equals_full_search():
    rng = random.Random(7)
    nodes = [f"n{k}" for k in range(5)]
    edges = [(rng.randint(97, 200), a, b) for a, b in itertools.combinations(nodes, 2)]
    budget = 800
    found = lattice.plan_group(edges, nodes, budget)
    index = {v: k for k, v in enumerate(nodes)}
    best = 0
    for n in range(4, 9):
        for chosen in itertools.combinations(edges, n):
            if sum(e[0] for e in chosen) <= budget and lattice._connected(5, [(index[a], index[b]) for _, a, b in chosen])[-1]:
                best = max(best, lattice.survivability(5, [(index[a], index[b]) for _, a, b in chosen])[0])
    assert lattice.survivability(5, [(index[a], index[b]) for _, a, b in found])[0] == best


def slow_plan_group(edges, nodes, budget):
    """The definition: every choice of edges, ranked one by one."""
    tree = lattice.kruskal(edges, set(nodes))
    if not tree or sum(e[0] for e in tree) > budget:
        return []
    frontier, best = [*tree, *(e for e in sorted(edges) if e not in tree)][: lattice.FRONTIER], None
    for n in range(len(nodes) - 1, min(lattice.MOST_EDGES, len(frontier)) + 1):
        for chosen in itertools.combinations(frontier, n):
            cost = sum(e[0] for e in chosen)
            if cost > budget or not lattice.kruskal(list(chosen), set(nodes)):
                continue
            levels = [sum(bool(lattice.kruskal([e for e in chosen if e not in lost], set(nodes))) for lost in itertools.combinations(chosen, k)) for k in range(min(2, n) + 1)]
            rank = (sum(levels), *reversed([*levels[1:], 0, 0][:2]), -cost, -n)
            if best is None or rank > best[0]:
                best = (rank, chosen)
    return list(best[1]) if best else []


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_plan_group_follows_the_definition(n):
    rng = random.Random(n)
    nodes = [f"n{k}" for k in range(n)]
    for top, extra in ((98, 210), (120, 120), (400, 300), (97, 0)):  # many ties and few
        edges = [(rng.randint(97, top), a, b) for a, b in itertools.combinations(nodes, 2)]
        for among in (edges, edges[: max(n - 1, 9)]):
            budget = sum(e[0] for e in lattice.kruskal(edges, set(nodes))) + extra
            assert lattice.plan_group(among, nodes, budget) == slow_plan_group(among, nodes, budget)


def test_plans_of_full_groups_are_quick():
    nodes = [f"n{k}" for k in range(lattice.GROUP)]
    began = time.process_time()
    for k in range(100):  # equal costs and a wide budget: every choice counts
        assert len(lattice.plan_group([(97 + k, a, b) for a, b in itertools.combinations(nodes, 2)], nodes, 10**6)) == lattice.MOST_EDGES
    assert time.process_time() - began < 10


def test_energy_of_feasible_choice_is_its_cost():
    groups, bits = [[100, 55, 48], [90, 44, 51], [120, 70, 63]], np.array([0, 0, 1, 0, 1, 0, 0, 0, 1])
    assert frontier.energy(groups, 1201.0, bits) == 155


def test_plans_of_many_parts_equal_single_plans_and_are_quick():
    rng, rows, want = random.Random(11), [], []
    for part in range(1500):
        top = rng.choice([3, 200, 20000])
        blocks = [sorted((rng.randint(1, top), rng.randint(1, 50), rng.randint(1, top)) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 14))]
        if part < 60:
            for block, k in zip(blocks, frontier.global_plan(blocks, [max(c[0] for c in b) for b in blocks], beam=128)["selection"], strict=True):
                want.append(len(rows) + sum(map(len, blocks[: blocks.index(block)])) + k if blocks.count(block) == 1 else None)
        rows += [(part, k, *c) for k, b in enumerate(blocks) for c in b]
    began = time.process_time()
    found = frontier.global_plans(*np.array(rows).T, 128)
    assert time.process_time() - began < 30
    assert len(found) == len({r[:2] for r in rows})
    assert all(w is None or w == f for w, f in zip(want, found, strict=False))
