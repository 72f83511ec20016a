"""The graph of patterns and instances against a plain loop over random occurrences."""

import math
import random
from collections import defaultdict

import pytest

from lonja.llm import personal_data
from lonja.llm.common import prepare

KINDS = ("email", "phone")


def patterns_of(before, after, shape):
    out = {("shape", shape)}
    if before:
        out.add(("before", before))
    if after:
        out.add(("after", after))
    if before and after:
        out.add(("both", f"{before}\t{after}"))
    return out


def plain(rows, rounds):
    edges = {(instance, p) for instance, before, after, shape, _ in rows for p in patterns_of(before, after, shape)}
    sizes = defaultdict(int)
    for _, p in edges:
        sizes[p] += 1
    seeds = {(instance, kind): 1.0 for instance, *_, kind in rows if kind}
    known, scored = {instance for instance, _ in seeds}, seeds
    for _ in range(rounds):
        sums = defaultdict(float)
        for instance, p in edges:
            for kind in KINDS:
                sums[p, kind] += scored.get((instance, kind), 0.0)
        sure = {key: value / (sizes[key[0]] + personal_data.DAMPING) for key, value in sums.items()}
        doubt = defaultdict(float)
        for instance, p in edges:
            for kind in KINDS:
                if instance not in known and sure[p, kind] >= personal_data.PATTERN_CONFIDENCE:
                    doubt[instance, kind] += math.log(1 - min(sure[p, kind], 0.999))
        found = {key: 1 - math.exp(value) for key, value in doubt.items()}
        scored = seeds | {key: value for key, value in found.items() if value >= personal_data.INSTANCE_SCORE}
    best = {}
    for (instance, kind), value in scored.items():
        if instance not in known:
            best[instance] = max(best.get(instance, (0.0, "")), (value, kind))
    return {instance: (kind, value) for instance, (value, kind) in best.items()}


def occurrences(seed):
    rnd = random.Random(seed)
    telling = {"email": ["mail", "write"], "phone": ["call", "ring"]}
    rows = []
    for i in range(160):
        kind = rnd.choice(KINDS) if rnd.random() < 0.85 else None
        lean = kind or rnd.choice([*KINDS, "none"])
        for _ in range(rnd.randint(1, 3)):
            before = rnd.choice(telling[lean]) if lean in telling and rnd.random() < 0.97 else rnd.choice(["", "the", "mail"])
            after = rnd.choice(["", "now", lean + "s", "soon"])
            rows.append((f"x{i}", before, after, rnd.choice(["9", lean, lean]), kind))
    return rows + [("x0", "call", "now", "9", "email"), ("x0", "call", "now", "9", "phone")]  # a seed of two kinds


@pytest.mark.parametrize("seed,rounds", [(1, 1), (2, 3), (3, 3), (4, 2)])
def test_scores_are_those_of_a_plain_loop(spark, seed, rounds):
    rows = occurrences(seed)
    frame = prepare(spark).createDataFrame(rows, "instance string, before string, after string, shape string, kind string")
    got = {r.instance: (r.kind, r.score) for r in personal_data.bootstrap(frame, rounds).collect()}
    want = plain(rows, rounds)
    assert want and got.keys() == want.keys()
    for instance, (kind, score) in want.items():
        assert got[instance][0] == kind and abs(got[instance][1] - score) < 1e-9
