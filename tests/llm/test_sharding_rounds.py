"""The rounds of balanced label propagation against the same rounds in plain Python."""

import random
import struct

import pytest
import xxhash

from driftloom.llm import sharding


def hashed(*values):
    """Spark's xxhash64 of longs (ints are given as (value, 4)), chained from seed 42."""
    seed = 42
    for v in values:
        v, width = v if isinstance(v, tuple) else (v, 8)
        seed = xxhash.xxh64_intdigest(struct.pack("<q" if width == 8 else "<i", v), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain(cells, shards, quotas, rounds):
    state = dict(cells)
    for _ in range(rounds):
        load = [sum(n for (_, s), n in state.items() if s == k) for k in range(shards)]
        room = [max(0, q - n) for q, n in zip(quotas, load)]
        groups, moves = {}, []
        for (g, s), n in state.items():
            groups.setdefault(g, []).append((s, n))
        for g, own in groups.items():
            copies = sum(n for _, n in own)
            # cells by their reach (what is there and may come), then by size, then by hash
            ranked = sorted((-min(copies, n + room[s]), -n, hashed(g, (s, 4)), s, room[s]) for s, n in own)
            before, leaders, to = 0, [], []
            for reach, _, _, s, space in ranked:
                if before < copies:
                    before -= reach
                    leaders.append(s)
                    to += [s] * (space > 0)
            to.sort()
            moves += [(g, s, n, to[hashed(g, (s, 4)) % len(to)]) for s, n in own if to and s not in leaders]
        taken = []
        for target in range(shards):
            left, buckets = room[target], {}
            for g, s, n, t in moves:
                if t == target:
                    buckets.setdefault(hashed((t, 4), g) % sharding.BUCKETS, []).append((g, s, n))
            for _, own in sorted(buckets.items()):
                whole = sum(n for _, _, n in own)
                for g, s, n in sorted(own):
                    m = max(0, min(n, left))
                    left -= m
                    if m:
                        taken.append((g, s, target, m))
                if whole and left <= 0:
                    break
        for g, s, t, m in taken:
            state[g, s] -= m
            state[g, t] = state.get((g, t), 0) + m
        state = {k: n for k, n in state.items() if n}
        if not taken:
            break
    return state


@pytest.mark.parametrize("rounds", [1, 2, 8, 40])
@pytest.mark.parametrize("seed", [0, 1])
def test_rounds_equal_plain_ones(spark, rounds, seed):
    rng, shards = random.Random(seed), 6
    cells = {}
    for g in range(1, 60):
        for _ in range(rng.choice([1, 2, 5, 30])):
            key = (g * 7919 - 200_000, rng.randrange(shards))
            cells[key] = cells.get(key, 0) + rng.choice([1, 1, 2, 9])
    total = sum(cells.values())
    quotas = [total // shards + rng.randint(0, 12) for _ in range(shards)]
    df = spark.createDataFrame([(g, s, n) for (g, s), n in cells.items()], "g long, shard int, n long")
    found = {(r["g"], r["shard"]): r["n"] for r in sharding.propagate(df, shards, quotas, rounds).collect()}
    want = plain(cells, shards, quotas, rounds)
    assert sum(found.values()) == total
    assert found == want


def test_rounds_go_on_until_nothing_moves(spark):
    """With quotas that leave hardly any room it takes many rounds, and links are cut until the last of them."""
    rng, shards, cells = random.Random(4), 5, {}
    for g in range(60):
        for _ in range(rng.choice([2, 3, 12])):
            key = (g, rng.randrange(shards))
            cells[key] = cells.get(key, 0) + 1
    quotas = [-(-sum(cells.values()) // shards) + 3] * shards

    def cut(state):
        groups = {}
        for (g, _), n in state.items():
            groups.setdefault(g, []).append(n)
        return sum(sum(own) ** 2 - sum(n * n for n in own) for own in groups.values())

    df = spark.createDataFrame([(g, s, n) for (g, s), n in cells.items()], "g long, shard int, n long")
    found = {(r["g"], r["shard"]): r["n"] for r in sharding.propagate(df, shards, quotas).collect()}
    assert found == plain(cells, shards, quotas, 1000)
    assert cut(found) < 0.2 * cut(plain(cells, shards, quotas, 8))
    assert all(sum(n for (_, s), n in found.items() if s == k) <= q for k, q in enumerate(quotas))
