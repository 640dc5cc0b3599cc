"""Line, near and substring deduplication against brute force, and their defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from quantalake.llm import substring
from quantalake.llm.components import components
from quantalake.llm.linedup import line_dedup
from quantalake.llm.neardup import confirmed, most_bits, near_duplicates, odd_sketch, samples
from quantalake.llm.substring import substring_dedup

WS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def test_line_dedup(docs):
    texts = ["  Common LINE \nown %d" % i for i in range(5)] + ["common line", None, "", "É line\n\ncommon\tline", "É line", "é line", "common line\n" * 3]
    got = line_dedup(docs(texts), min_docs=4).collect()
    keys = [{lower(x.strip(WS)) for x in (t or "").split("\n")} for t in texts]
    for r in got:
        lines = (texts[r.doc_id] or "").split("\n")
        stay = [x for x in lines if not lower(x.strip(WS)) or sum(lower(x.strip(WS)) in k for k in keys) < 4]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert {"lang", "source", "kept"} <= set(got[0].asDict())
    assert line_dedup(docs([])).count() == 0


def test_line_dedup_counts_documents(docs):
    """Rows with one id, or none, are one document."""
    got = line_dedup(docs(["a line"] * 6, [1, 1, 1, None, None, 2]), min_docs=4).collect()
    assert len(got) == 6 and all(r.n_dropped == 0 for r in got)
    assert all(r.n_dropped == 1 for r in line_dedup(docs(["a line"] * 6, [1, 1, 1, None, None, 2]), min_docs=3).collect())


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize(("block", "hubs"), [(512, 8), (8, 2), (8, 0)])
def test_near_duplicates(docs, prose, monkeypatch, block, hubs):
    """Chains, large groups and short texts; small blocks make groups of several blocks, which hubs join or don't."""
    from quantalake.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HUBS", hubs)
    rng = random.Random(5)
    texts = [prose(60, i) for i in range(20)] + ["", None, " \t", "one two", "ONE two", "a b c d e", "a b c d e f"]
    base = prose(80, 99).split()
    for _ in range(40):  # near copies at all distances
        own = list(base)
        for k in rng.sample(range(80), rng.randrange(6)):
            own[k] = "x%d" % rng.randrange(1000)
        texts.append(" ".join(own))
    chain = prose(200, 7).split()
    for k in range(35):  # each is near the one before only
        texts.append(" ".join(chain[4 * k : 4 * k + 60]))
    texts += texts[:3]
    sizes, want = brute_components(texts)
    got = {r.doc_id: r for r in near_duplicates(docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, (n, c) in enumerate(zip(sizes, want, strict=True)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i)


def test_long_near_duplicates(docs, prose):
    """Texts of more shingles than are sampled at a time; near and far at the threshold."""
    base = prose(9000, 1).split()
    near, far = list(base), list(base)
    for k in range(0, 9000, 36):  # 5 of 36 shingles change: 0.756
        near[k] = "changed"
    for k in range(0, 9000, 32):
        far[k] = "other%d" % k
    texts = [" ".join(x) for x in (base, near, far)] + ["y" * 300_000, "z" * 300_000]
    sizes, want = brute_components(texts)
    got = {r.doc_id: r for r in near_duplicates(docs(texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(5)] == list(zip(sizes, want, strict=True)) and want[:2] == [0, 0] and want[2] == 2


def test_long_lines(docs):
    """A text of many lines and one of a single very long one."""
    texts = ["\n".join("line %d" % (k % 300) for k in range(20_000)), "x" * 500_000, *["line 7\nown"] * 9, *["line 8"] * 8]
    got = {r.doc_id: r for r in line_dedup(docs(texts)).collect()}
    assert (got[0].n_lines, got[0].n_dropped) == (20_000, 67) and got[1].kept_text == texts[1]
    assert got[2].kept_text == "own" and got[11].kept_text == "line 8"


def test_long_substrings(docs, prose):
    passage = prose(3000, 1)
    texts = [prose(30_000, 2) + " " + passage, passage + " " + prose(5000, 3), "w" * 400_000]
    got = {r.doc_id: r for r in substring_dedup(docs(texts)).collect()}
    assert [got[i].n_removed for i in range(3)] == [3000, 3000, 0]
    assert got[1].kept_text == prose(5000, 3) and got[2].kept_text == texts[2]


def test_near_duplicates_ids(docs, prose):
    t = prose(50, 1)
    got = near_duplicates(docs([t, t, t, "other words here", None], [4, None, 4, 2, 9])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (2, 2, True), (4, 4, True), (4, 4, True), (9, 9, True)]
    assert near_duplicates(docs([])).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    far = []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 500, np.uint64)
        a, b = h[:430], h[70:]  # 360 of 500: 0.72
        far.append(int(np.bitwise_count(odd_sketch(samples(a)) ^ odd_sketch(samples(b))).sum()))
    assert most_bits(0.77) < np.mean(far) < most_bits(0.67)
    assert max(far) <= most_bits(0.52)


def test_confirmed_needs_the_threshold():
    h = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 400, np.uint64))
    for over, linked in ((300, True), (299, False)):  # 300 of 400 is the threshold
        sets = [h, h[:over]]
        bits = np.stack([odd_sketch(samples(s)) for s in sets])
        links, label = confirmed(sets, bits, np.arange(2), 75, most_bits(0.5))
        assert bool(links) == (label[0] == label[1]) == linked


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 450)] + [(5, 5), (None, 3)]
    parent = {v: v for e in edges for v in e if v is not None}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {v: find(v) for e in edges for v in e if None not in e and e[0] != e[1]}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + window))
    return words, gone


def test_entries_of_two_hashes():
    """Runs of equal entries, and membership, where first hashes collide and second ones don't."""
    rng = np.random.default_rng(4)
    x = np.zeros(500, substring.LONG)
    x["a"], x["b"] = rng.integers(0, 20, 500), rng.integers(0, 20, 500)
    order, starts = substring._order(x)
    runs = np.split(x[order], starts[1:])
    assert all(len(set(r.tolist())) == 1 for r in runs) and len(runs) == len(set(x.tolist()))
    found = x[:200][np.argsort(x["a"][:200])]
    have = set(found.tolist())
    assert substring._within_long(x, found["a"], found["b"]).tolist() == [e in have for e in x.tolist()]
    assert substring._order(x[:0])[0].tolist() == substring._within_long(x[:0], found["a"], found["b"]).tolist() == []


@pytest.mark.parametrize("window", [35, 7])
def test_substring_dedup(docs, prose, monkeypatch, window):
    monkeypatch.setattr(substring, "BATCH_BYTES", 2000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 500)
    rng = random.Random(8)
    passage = prose(90, 4).split()
    texts = [None, "", " \n ", prose(34, 1), prose(35, 2), prose(35, 2), "again " * 80]
    for k in range(30):
        own = prose(60, 100 + k).split()
        a, n = rng.randrange(50), rng.randrange(20, 60)
        own[rng.randrange(60) : 0] = passage[a : a + n]
        texts.append(("\n" if k % 2 else " ").join(own))
    words, gone = brute_removed(texts, window)
    got = {r.doc_id: r for r in substring_dedup(docs(texts), window).collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(words):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[k])
        assert (got[k].n_words, got[k].n_removed, got[k].kept_text) == (len(w), len(gone[k]), kept)
        assert {i for s in got[k].removed for i in range(s.first, s.last + 1)} == gone[k]
    assert substring_dedup(docs([])).count() == 0


def test_substring_dedup_repeated_rows(docs, prose):
    t = prose(40, 1)
    got = substring_dedup(docs([t, t, None], [None, None, 3])).collect()
    assert sorted(r.n_removed for r in got) == [0, 40, 40]
    assert hashlib.sha256(got[0].kept_text.encode()).hexdigest()


def test_many_equal_rows(spark, docs, prose):
    """100,000 rows with no id and one text, and others equal in both: no batch holds them, and all are worked right."""
    long, short = prose(60, 1), "too  short\tto repeat "
    texts = [long, short, prose(50, 2) + " " + " ".join(long.split()[5:45]), prose(80, 3), None]
    many = spark.range(100_000).selectExpr("cast(null as bigint) AS doc_id").crossJoin(docs(texts[:1]).select("text"))
    some = docs([short] * 20 + [None] * 20 + [long] * 3 + texts[2:], [7] * 20 + [8] * 20 + [9] * 3 + [10, 11, 12]).select("doc_id", "text")
    got = substring_dedup(many.unionByName(some)).groupBy("doc_id", "n_words", "n_removed", "kept_text", "removed").count().collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(found) == 7
    assert (found[None]["count"], found[None].n_words, found[None].n_removed, found[None].kept_text) == (100_000, 60, 60, "")
    assert [tuple(x) for x in found[None].removed] == [(0, 59)]
    assert (found[7]["count"], found[7].n_words, found[7].n_removed, found[7].kept_text) == (20, 4, 0, "too short to repeat")
    assert (found[8]["count"], found[8].n_words, found[8].kept_text) == (20, 0, "")
    assert (found[9]["count"], found[9].n_removed, found[10].n_removed, found[11].n_removed) == (3, 60, 40, 0)


@pytest.mark.parametrize("union", [4, 8, 16, 40, 400, 4000])
def test_recall_at_the_threshold(union):
    """Pairs at exactly 0.75, small and large: all share a key and pass the sketch (a miss has a chance of 5e-6)."""
    from quantalake.llm.neardup import MARGIN, band_keys

    rng, most = np.random.default_rng(union), most_bits(0.75 - MARGIN)
    for _ in range(40 if union == 4000 else 400):
        own = rng.integers(0, 1 << 63, union, np.uint64)
        common, rest = own[: 3 * union // 4], own[3 * union // 4 :]
        left = rest[: int(rng.integers(0, len(rest) + 1))]
        a, b = np.concatenate([common, left]), np.concatenate([common, rest[len(left) :]])
        x, y = samples(a), samples(b)
        assert (band_keys(x) == band_keys(y)).any()
        assert np.bitwise_count(odd_sketch(x) ^ odd_sketch(y)).sum() <= most
