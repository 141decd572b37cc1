"""Vector codes against k-means over all pairs, in integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from caseweave.llm import vectorcodes
from caseweave.llm.vectorcodes import Codebook, descend, flat_tree, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, entries=256):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    ints = [[math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is not None, kept[k][0] or 0, ints[k]))[:entries]
    w = width // 4
    cut = lambda v: [tuple(v[p * w : p * w + w]) for p in range(4)]
    books = [[cut(ints[k])[p] for k in order] for p in range(4)]
    parts = [cut(v) for v in ints]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for x in parts:
                groups.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for e, xs in groups.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    final = [[nearest(x[p], books[p]) for p in range(4)] for x in parts]
    errors, by_label = [sum(d for d, _ in f) for f in final], {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for _, e in f), err, by_label[lab], sha) for (i, _, lab), f, err in zip(kept, final, errors)], key=str)


def fixture(n=420):
    rnd = random.Random(11)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        v = [x + rnd.gauss(0, 0.1) for x in c] if rnd.random() < 0.8 else [round(x) / 4 for x in c]  # ties
        rows.append((rnd.randint(0, n), v, rnd.choice(["a", "b", None])))
    same = rows[3][1]
    rows += [(1000 + i, same, "hot") for i in range(200)]
    return rows + [(2, None, "a"), (3, [1.0, None] + [0.0] * 6, "a"), (4, [float("nan")] * 8, "a"), (5, [float("inf")] * 8, "b"), (None, [0.5] * 8, None), (6, [1.0, 2.0], "short"), (7, [], "short"), *rows[:20]]


@pytest.mark.parametrize(("tree_rows", "leaf", "entries"), [(4_096, 48, 256), (40, 4, 16), (7, 2, 256)])
def test_codes_equal_brute_force(spark, monkeypatch, tree_rows, leaf, entries):
    for name, value in (("TREE_ROWS", tree_rows), ("LEAF", leaf), ("ENTRIES", entries)):
        monkeypatch.setattr(vectorcodes, name, value)
    rows = fixture()
    assert sorted([tuple(r) for r in vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()], key=str) == brute(rows, entries)


def test_large_components_stay_exact(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.choice([-30_000, 30_000]) + rnd.randint(-9, 9)) for _ in range(4)], "a") for i in range(300)]
    assert sorted([tuple(r) for r in vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()], key=str) == brute(rows)


def test_tree_caches_sums_and_prunes():
    rnd = np.random.default_rng(4)
    centres = rnd.integers(-4000, 4000, (20, 6))
    rows = (centres[rnd.integers(0, 20, 3000)] + rnd.integers(-30, 30, (3000, 6))).astype(np.int32)
    tree = flat_tree(rows, np.arange(3000))
    assert (tree["points"].reshape(-1, 6)[tree["places"]] == rows).all()
    assert (tree["sums"].reshape(-1, 6)[0] == rows.sum(axis=0)).all() and tree["counts"][0] == 3000
    owned, tested = descend(tree, Codebook(centres))
    assert sum(int(tree["counts"][b]) for b, _ in owned) > 2500
    assert sum(int(tree["counts"][b]) for b, _ in owned) + sum(int(tree["weights"][a:b].sum()) for a, b, *_ in tested) == 3000


def test_no_vectors_and_other_columns(spark):
    assert vector_codes(spark.createDataFrame([(1, None, "a")], SCHEMA)).collect() == []
    out = vector_codes(spark.createDataFrame([(1, [1.0], "a", 3)], SCHEMA + ", part int")).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in out] == [(1, "00000000", 0, 0)]
