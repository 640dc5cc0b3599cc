"""Vector codes against plain rounds over all parts, and the defined cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from quantalake.llm.vectorcodes import Heaps, label_errors, nearest, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, i int, v int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(codes by row number, errors, entries) of plain Lloyd rounds in Python integers."""
    kept = [(n, i, [math.floor(scale * float(np.float32(x))) for x in v]) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, {}, None
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    size = len(kept[0][2])
    if size % parts:
        return {}, {}, None
    good = [r for r in kept if len(r[2]) == size and max(map(abs, r[2]), default=0) <= 1 << 24]
    w = size // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, _, v in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, m in zip(cut, near, strict=True) if m[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    near = assign()
    codes = {r[0]: "".join(f"{m[1]:02x}" for m in ms) for r, ms in zip(good, near, strict=True)}
    return codes, {r[0]: sum(m[0] for m in ms) for r, ms in zip(good, near, strict=True)}, books


def same(spark, rows, **how):
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)
    codes, books = vector_codes(df, **how)
    want, errors, own = plain(rows, **how)
    kept = [n for n, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = sorted(((r.vec_id, r.label, r.code, r.error) for r in codes.collect()), key=repr)
    assert got == sorted(((rows[n][0], rows[n][2], want.get(n), errors.get(n)) for n in kept), key=repr)
    if own is None:
        assert books is None
    else:
        assert [[tuple(e) for e in b.tolist()] for b in books.books] == own
        assert books.digest() == hashlib.sha256(",".join(str(x) for b in own for e in b for x in e).encode()).hexdigest()


def vectors(n, size, seed, spread=1.0, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (clusters, size))
    return (centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.2 * spread, (n, size))).astype(np.float32)


@pytest.mark.parametrize(("n", "size", "entries", "rounds", "spread"), [(700, 16, 24, 4, 1.0), (400, 8, 256, 4, 0.002), (90, 4, 256, 3, 1.0), (300, 8, 2, 6, 5.0), (50, 8, 1, 2, 1.0), (60, 8, 7, 0, 1.0)])
def test_codes(spark, n, size, entries, rounds, spread):
    """Also ties: at a small spread many components are the same whole number."""
    x = vectors(n, size, n, spread)
    rows = [(i * 7 % 1000, x[i].tolist(), i % 3 or None) for i in range(n)]
    same(spark, rows, entries=entries, rounds=rounds)


def test_defined_cases(spark):
    x = vectors(40, 8, 5)
    rows = [(i, x[i % 30].tolist(), i % 4) for i in range(40)]
    rows += [(3, x[3].tolist(), 1), (None, x[4].tolist(), None), (100, None, 1), (101, [1.0, None] + [0.0] * 6, 1), (102, [math.nan] * 8, 2), (103, [math.inf] * 8, 2), (-1, [-math.inf] + [0.0] * 7, 3)]
    rows += [(104, [1.0] * 12, 1), (105, [], 1), (106, [3e30] * 8, 2), (107, [16384.0, -16384.0] + [0.0] * 6, 2), (108, [16385.0] + [0.0] * 7, 2)]
    same(spark, rows, entries=16)
    same(spark, [(1, [1.0, 2.0, 3.0], 0)], entries=16)  # 4 parts don't divide it
    same(spark, [], entries=16)
    same(spark, [(1, None, 0)], entries=16)


def test_equal_vectors(spark):
    """One vector that most rows have; entries that start the same."""
    x = vectors(60, 8, 6)
    rows = [(i, (x[0] if i % 3 else x[i // 3]).tolist(), 1) for i in range(180)]
    same(spark, rows, entries=64)


def test_label_errors(spark):
    x = vectors(50, 8, 7)
    codes, _ = vector_codes(spark.createDataFrame([(i, x[i].tolist(), i % 3 or None, "c", 1, 2) for i in range(50)], SCHEMA), entries=4)
    got = label_errors(codes).collect()
    assert len(got) == 50
    for r in got:
        assert r.label_error == sum(s.error for s in got if s.label == r.label)


def test_nearest_beyond_doubles():
    rng = random.Random(2)
    x = np.array([[rng.randrange(-(1 << 24), 1 << 24) for _ in range(16)] for _ in range(70)])
    e = np.vstack([x[:5] + 1, x[:5] - 1, x[5:9]])
    near, first, second = nearest(x, e)
    for v, a, d, o in zip(x.tolist(), near.tolist(), first.tolist(), second.tolist(), strict=True):
        want = sorted((sum((p - q) ** 2 for p, q in zip(v, w, strict=True)), k) for k, w in enumerate(e.tolist()))
        assert (a, d) == (want[0][1], float(want[0][0])) and o == float(want[1][0])


def test_heaps_pop_what_moved():
    """Only parts below the movement are popped, through rounds of pops, pushes and arrays."""
    rng = np.random.default_rng(3)
    near, keys, seen = rng.integers(0, 5, 200), rng.random(200) * 10, np.zeros(6)
    heaps = Heaps.of(keys, near, 6)
    for _ in range(6):
        seen = seen + rng.random(6) * 2
        popped = heaps.pop(seen)
        assert popped.tolist() == np.flatnonzero(keys < seen[near] + 1e-3).tolist()
        near[popped], keys[popped] = rng.integers(0, 6, len(popped)), seen.max() + rng.random(len(popped)) * 5
        heaps.push(keys[popped], popped, near[popped])
        heaps = Heaps(*heaps.arrays())


def test_few_parts_are_looked_at_again(spark):
    """Well separated clusters, an entry each: soon hardly any part is compared with all entries."""
    from quantalake.llm.vectorcodes import Books

    rng = np.random.default_rng(8)
    centres = rng.integers(-40_000, 40_000, (16, 8))
    x = np.vstack([centres, centres[rng.integers(0, 16, 2000)] + rng.integers(-3000, 3000, (2000, 8))])
    books = Books(x[:16] + 12_000, 1)
    near, first, second = nearest(x, books.books[0])
    heaps = Heaps.of(np.sqrt(second) - np.sqrt(first), near, 16)
    looked = []
    for _ in range(6):
        books.counts[0], books.sums[0] = np.bincount(near, minlength=16), np.stack([x[near == k].sum(0) for k in range(16)])
        books.move([])
        popped = heaps.pop(books.seen[0])
        looked.append(len(popped))
        at, first, second = nearest(x[popped], books.books[0])
        heaps.push(np.sqrt(second) - np.sqrt(first) + books.seen[0][at], popped, at)
        near[popped] = at
        assert (near == nearest(x, books.books[0])[0]).all()
    assert looked[0] > looked[-1] == 0
