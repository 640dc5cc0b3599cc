"""Classifiers by held-out accuracy, decontamination and chat formatting by brute force, and the pipeline."""

import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantalake.llm import chat, decontam, langid, quality
from quantalake.llm.sampling import is_held_out

LANGUAGES = {"aa": "the of and to in is that for it as was with".split(), "bb": "der die und das ist nicht ein mit auf für von zu".split(), "cc": "que los una por más para con está pero sus del".split()}


def labelled(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        good = rng.random() < 0.6
        words = [rng.choice(LANGUAGES[lang]) for _ in range(rng.randrange(20, 80))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), lang, int(good), 1.5))
    rows += [(n, None, "aa", None, 0.0), (n + 1, "", None, 1, 0.0), (n + 2, "123 ... !!", "aa", 0, 0.0), (None, "the of and", None, None, 0.0), (5, "the of", None, None, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, score double")


def test_language(spark):
    docs = labelled(spark)
    got = langid.identify(docs, langid.fit(docs)).collect()
    want = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 5}
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 50 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.98
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (400, 401, 402)} == {"und"}
    kept = langid.keep_known(docs, langid.fit(docs))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {400, 401, 402}
    assert kept.columns == docs.columns
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.keep_known(docs, none).count() == docs.count()


FOREIGN = [
    "De regering heeft gisteren besloten dat de nieuwe wet pas volgend jaar in werking treedt.",
    "Il governo ha deciso ieri che la nuova legge entrerà in vigore soltanto il prossimo anno.",
    "O governo decidiu ontem que a nova lei só entrará em vigor no próximo ano, segundo o ministro.",
    "Hallitus päätti eilen, että uusi laki tulee voimaan vasta ensi vuonna.",
    "Rząd zdecydował wczoraj, że nowa ustawa wejdzie w życie dopiero w przyszłym roku.",
    "Regeringen beslutade i går att den nya lagen träder i kraft först nästa år.",
]


def test_language_stage_drops_other_languages(spark):
    import os

    import corpus_pipeline as p

    data = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    docs = p.load(spark, data, "documents").select(*p.COLUMNS)
    other = spark.createDataFrame([(-1 - k, t, None, "s", len(t)) for k, t in enumerate(FOREIGN)], docs.schema)
    kept = p.language_stage(spark, docs.unionByName(other), data)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_letters_by_category():
    """Number signs, digits and combining marks alone aren't letters; ties go to the first language."""
    own = langid.Filters(["aa", "bb"], [np.concatenate(list(langid.grams("the of and"))), np.concatenate(list(langid.grams("the of and")))])
    for text in ("½ ²", "①②", "Ⅷ", "\u0301\u0308", "١٢", "一二"[:0], "_ - !", "\u3007"):
        assert own.predict(text) == ("und", 0.0), text
    assert own.predict("the of")[0] == "aa" and own.predict("½x")[0] == "aa"
    for c in map(chr, range(0x3000)):
        assert bool(list(langid.grams(c))) == any(x.isalpha() for x in c.lower()), ascii(c)


def test_pieces_are_those_of_blocks():
    """Words have one vector however they are read, and runs of marks count whole."""
    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("aZéÉİıßſΣσςǅŉ1_!.'ªµ") for _ in range(rng.randrange(1, 7))) for _ in range(3000)] + ["no" + "!" * n for n in range(30)]
    own = quality.Words(None)
    table, bucket = own.table(pa.array(words))
    for k, w in enumerate(words):
        assert np.allclose(table[k], sum(quality.index_vectors(quality.hashed([p]))[0] for p in quality.pieces(w)), atol=1e-5), w
    assert len({t.tobytes() for t in table[-30:]}) == 30


def test_language_filters_hold_what_they_learned():
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 1 << 63, 3000, np.uint64) for _ in range(70)]  # more than a word of bits
    own = langid.Filters([str(k) for k in range(70)], members)
    for k in (0, 3, 63, 64, 69):
        masks = own.masks(members[k])[:, k // 64]
        assert (masks >> np.uint64(k % 64) & np.uint64(1)).all()
    other = own.masks(rng.integers(0, 1 << 63, 20000, np.uint64))
    assert np.count_nonzero(other[:, 0] & np.uint64(1)) / 20000 < 3 * own.false[0] + 0.002


def test_quality(spark):
    docs = labelled(spark)
    labels = docs.select("doc_id", "quality").where("doc_id is not null").dropDuplicates(["doc_id"])
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count()
    want = {r.doc_id: r.quality for r in labels.where("doc_id < 400 and doc_id <> 5").collect()}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    bound = quality.fit(docs, labels, max_train=60)
    assert {0 <= r.score <= 1 for r in quality.score(docs, bound).collect()} == {True}
    assert quality.score(docs.where("false"), model).count() == 0


def brute_features(text: str) -> np.ndarray:
    """Each word by its pieces, one after the other."""
    words = (text or "").split()
    vector = lambda p: quality.index_vectors(quality.hashed([p]))[0].astype(float)
    rows = np.array([sum((vector(p) for p in quality.pieces(w)), np.zeros(quality.DIM)) for w in words]).reshape(-1, quality.DIM)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if not words:
        return np.zeros(2 * quality.DIM + 1)
    return np.concatenate([(rows.sum(0) + quality.REPEAT * again * vector("\x01again")) / len(words), rows.std(0), [np.log1p(len(words)) / 10]])


def test_features_by_brute_force(prose):
    texts = [None, "", " \t", "Word word WORD wOrd w W.", "a1b2 12,345.67 don't é́É!! ...", "same same same other same", "x" * 200_000, prose(20_000, 3)]
    got = quality.Words(None).features(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, brute_features(t), atol=2e-3)
    halves = quality.Words(None)
    sums = np.zeros((quality.BUCKETS, quality.DIM), np.float32)
    halves.context_sums(pa.array(["the cat sat on the mat"]), sums)
    vector = lambda w: sum(quality.index_vectors(quality.hashed([p]))[0] for p in quality.pieces(w))
    words = "the cat sat on the mat".split()
    want = np.zeros_like(sums)
    for k, w in enumerate(words):
        for j in (k - 2, k - 1, k + 1, k + 2):
            if 0 <= j < len(words):
                want[quality.buckets(quality.hashed([w]))[0]] += vector(words[j])
    assert np.allclose(sums, want)


def brute_grams(text: str) -> list[str]:
    own = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
    return [own[k : k + n] for n in (3, 4) for k in range(len(own) - n + 1) if " " not in own[k + 1 : k + n - 1]]


def test_shares_by_brute_force(prose, monkeypatch):
    """Shares from sets of n-grams; texts that end in the middle of a chunk, at its end and far beyond."""
    rng = random.Random(2)
    known = [" ".join(rng.choice(own) for _ in range(300)) for own in LANGUAGES.values()]
    code = lambda g: np.concatenate(list(langid.grams(g)) or [np.zeros(0, np.uint64)])
    filters = langid.Filters(list(LANGUAGES), [np.unique(code(t)) for t in known])
    texts = ["der the und of", "Ich bin HIER, 12 x_y!", "auf für.", known[0] * 60, "x" * 70_000, prose(2000, 4)]
    for text in texts:
        grams, shares = brute_grams(text), filters.shares(text)
        assert sum(len(x) for x in langid.grams(text)) == len(grams)
        for k, t in enumerate(known):
            have = set(brute_grams(t))
            exact = sum(g in have for g in grams) / len(grams)
            assert shares[k] == pytest.approx(exact, abs=5 * filters.false[k] + 0.01)
    whole = [filters.shares(t) for t in texts]
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert all(np.allclose(a, filters.shares(t)) for a, t in zip(whole, texts, strict=True))
    assert filters.shares("1 2 3") is None and filters.predict(None) == ("und", 0.0)


def test_language_learns_from_all_texts(spark, monkeypatch):
    """Of thousands of texts, words that three of them have are learned, words of two aren't; cuts are those of all texts."""
    rng = random.Random(8)
    learned = [i for i in range(6000) if not is_held_out(i)]
    texts = {i: " ".join(rng.choices(LANGUAGES["aa"], k=rng.randrange(1, 9))) for i in range(6000)}
    rare = ["".join(rng.sample("абвгдежзиклмнопрстуфхцчшщыэюя", 6)) for _ in range(160)]
    for k, word in enumerate(rare):
        for i in rng.sample(learned, 3 if k < 80 else 2):
            texts[i] += " " + word
    docs = spark.createDataFrame([(i, t, "aa") for i, t in texts.items()] + [(6000 + i, "der die", "bb") for i in range(9)], "doc_id long, text string, lang string").repartition(5)
    monkeypatch.setattr(langid, "PARTS", 7, raising=False)
    filters = langid.fit(docs)
    codes = lambda w: np.concatenate(list(langid.grams(w)))
    whole = [(filters.masks(codes(w))[:, 0] & np.uint64(1)).astype(bool) for w in rare]
    assert all(x.all() for x in whole[:80]) and np.mean([x.all() for x in whole[80:]]) < 0.05
    own = sorted(int(filters.shares(texts[i])[0] * langid.STEPS) for i in learned)
    assert langid.cuts(docs, filters)["aa"] == max(langid.FLOOR, langid.PART * own[int(np.ceil(langid.LOWEST * len(own))) - 1] / langid.STEPS)
    counts = Counter(h for i in learned for own in langid.grams(texts[i]) for h in own.view(np.int64).tolist())
    monkeypatch.setattr(langid, "GRAMS", 60)
    best = np.array(sorted(counts, key=lambda h: (-counts[h], h)), np.int64).view(np.uint64)
    bits = (langid.fit(docs).masks(best)[:, 0] & np.uint64(1)).astype(bool)
    assert bits[:60].all() and bits[60:].mean() < 0.01


def test_identify_empty(spark):
    docs = labelled(spark)
    assert langid.identify(docs.where("false"), langid.fit(docs)).count() == 0
    assert langid.cuts(docs.where("false"), langid.fit(docs)) == {}


def test_quality_without_two_classes(spark):
    docs = labelled(spark, 20)
    for labels, want in ((docs.select("doc_id", F.lit(1).alias("quality")), 1.0), (docs.select("doc_id", "quality").where("false"), 0.5)):
        assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {want}


def test_temperature_is_fitted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))
    net = quality.Network(x, y)
    p = net.scores(x)
    for low in (0.1, 0.4, 0.7):
        near = (p >= low) & (p < low + 0.2)
        assert abs(p[near].mean() - y[near].mean()) < 0.12


def brute_tiles(a, b, least):
    """The textbook: the longest unmarked common run, the first in the text and then in the item, again and again."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < min(least, len(b)) or not best[0]:
            return out
        n, i, j = best[0], -best[1], -best[2]
        for k in range(n):
            ma[i + k] = mb[j + k] = True
        out.append((i, j, n))


def test_tiling(monkeypatch):
    rng = np.random.default_rng(7)
    for places in (1 << 19, 7):  # whole texts, and a few places at a time
        monkeypatch.setattr(decontam, "PLACES", places)
        for _ in range(60):
            a, b = rng.integers(0, 3, rng.integers(1, 40)), rng.integers(-1, 3, rng.integers(3, 25))
            assert decontam.tiles(a, b, 3) == brute_tiles(a.tolist(), b.tolist(), 3)
    same = np.zeros(3000, np.int64)
    assert decontam.tiles(same, same[:50], 5) == [(0, 0, 50)]
    assert decontam.tiles(same[:0], same, 5) == decontam.tiles(same, same[:0], 5) == []


def test_kept_seeds():
    """The words under the seeds that go are fewer than the coverage asks for, and no more seeds could go."""
    rng = np.random.default_rng(8)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        size = min(5, n)
        count = rng.integers(1, 6, n - size + 1)
        kept, free = decontam.kept_seeds(count, np.arange(n - size + 1), n, size, 0.6)
        under = {p + k for p in np.flatnonzero(~kept).tolist() for k in range(size)}
        assert len(under) == free and free / n < 0.6 and kept.any()
        assert count[~kept].min(initial=9) >= count[kept].max()


def test_decontamination(spark, docs, prose):
    items = [(k, prose(30, 500 + k)) for k in range(6)] + [(6, "tiny item"), (7, None), (8, "..."), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    first, second = " ".join(items[1][1].split()[:15]), " ".join(items[1][1].split()[15:])
    texts = [prose(200, 1), prose(50, 2) + " " + items[0][1].upper() + ". " + prose(50, 3), second + " " + prose(20, 4) + " " + first, " ".join(items[2][1].split()[:12]), None, "", "a Tiny, item here"]
    want = {(1, 0), (2, 1), (6, 6)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs(texts), bench).collect()} == want
    kept = decontam.decontaminate(docs(texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5] and kept.columns == docs(texts).columns
    assert decontam.leaks(docs(texts), bench.where("false")).count() == 0
    assert decontam.decontaminate(docs(texts), bench.where("false")).count() == 7
    assert decontam.leaks(docs([]), bench).count() == 0


def test_decontamination_by_brute_force(spark, docs, prose):
    """All pairs by the textbook's tiling; phrases that many items share, repeated rows and items, null ids, long texts."""
    rng = random.Random(11)
    phrase = "what is the right answer to this question"
    items = [(k, phrase + " " + prose(rng.randrange(3, 20), 700 + k)) for k in range(12)] + [(20, phrase), (21, phrase), (None, "one two three"), (22, prose(10, 700)), (22, prose(10, 700)), (23, "do do do do do do do do")]
    texts = [None, "", phrase, "one, TWO three", "do " * 40]
    for k in range(25):
        parts = [prose(rng.randrange(5, 40), 900 + k)]
        for _, item in rng.sample(items, 2):
            words = item.split()
            a, b = sorted(rng.sample(range(len(words) + 1), 2))
            parts += [" ".join(words[b:]), prose(3, k), " ".join(words[:a])]
        texts.append(" ".join(parts))
    texts += [texts[7], texts[7], prose(30000, 5) + " " + items[3][1]]
    ids = [*range(len(texts) - 4), None, None, 400, 401]
    own = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    own = own.unionByName(own.where("doc_id = 7"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1.5))
    want = []
    for d, t in [*zip(ids, texts, strict=True), (7, texts[7])]:
        a = decontam.tokens(t.encode()) if t else []
        for k, item in set(items):
            b = decontam.tokens(item.encode())
            found = brute_tiles(a if len(a) < 1000 else a[-60:], b, 5)
            if sum(x[2] for x in found) / len(b) >= 0.6:
                want.append((d, k, sum(x[2] for x in found) / len(b), len(b), len(found)))
    got = [(r.doc_id, r.item_id, r.coverage, r.item_words, len(r.tiles)) for r in decontam.leaks(own, bench).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 20
    leaking = {d for d, *_ in want}
    clean = decontam.decontaminate(own, bench)
    assert {r.doc_id for r in clean.collect()} == set(ids) - leaking


SCHEMA = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "f", '{"x": 1.0}', None), (1, 2, "b", "f", '{"x": -1}', ["a"]), (1, 4, "c", "g", "{}", ["b", "none"]), (1, 6, "d", "f", "{", None),
            (2, 0, "p", "f", '{"x":1}', ["q"]), (2, 1, "q", "f", '{"x":1}', None),  # needs a later one
            (3, 0, "y", "f", '{"x":1}', ["z"]), (3, 1, "z", "f", '{"x":1}', ["y"]),  # a cycle
            (4, 5, "e", "f", '{"x":1,"x":2}', None), (None, 1, "n", "f", None, None), (5, 1, "dup", "f", '{"x":1}', None), (5, 1, "dup", "f", '{"x":1}', None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    ).withColumn("level", F.lit("clash"))
    results = spark.createDataFrame([(1, 1, "a", "é"), (1, 3, "b", None), (1, 2, "c", "early"), (2, 2, "p", "r"), (2, 2, "q", "r"), (5, 3, "dup", "second"), (5, 2, "dup", "first"), (None, 2, "n", "r")], "conv_id long, turn long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in chat.link_tool_calls(calls, results, SCHEMA).collect()}
    said = {k: r.status for k, r in got.items()}
    assert said == {(1, "a"): "ok", (1, "b"): "$.x: minimum", (1, "c"): "no schema", (1, "d"): "bad json", (2, "p"): "ok", (2, "q"): "ok", (3, "y"): "cycle", (3, "z"): "cycle", (4, "e"): "bad json", (None, "n"): "bad json", (5, "dup"): "ok"}
    assert got[2, "q"].level == 0 and got[2, "p"].level == 1
    assert got[1, "a"].json == '{"arguments":{"x":1},"call_id":"a","name":"f","result":"é"}'
    assert json.loads(got[5, "dup"].json)["result"] == "first"
    assert chat.link_tool_calls(calls, results, SCHEMA).count() == 12
    alone = chat.link_tool_calls(calls, results.where("false"), SCHEMA).collect()
    assert len(alone) == 12 and {r.status for r in alone if r.call_id in ("a", "p", "q", "dup")} == {"no result"}
    big = json.dumps({"x": 10**30, "y": "w" * 300_000})
    odd = spark.createDataFrame([(1, 0, "a", "f", '{"x":1e400}', None), (1, 1, "b", "f", '{"x":"\\ud800"}', None), (1, 2, "c", "f", big, None)], calls.drop("level").schema)
    assert [r.status for r in chat.link_tool_calls(odd, results, SCHEMA).orderBy("turn").collect()] == ["bad json", "bad json", "$: y is unknown"]
    assert chat.link_tool_calls(calls.where("false"), results, SCHEMA).count() == 0


def brute_levels(needs: dict) -> dict:
    """Levels of the calls of one conversation by relaxation; calls in cycles and after them get None."""
    level = dict.fromkeys(needs)
    for _ in needs:
        for k, own in needs.items():
            own = [level[x] for x in own if x in needs]
            if level[k] is None and None not in own:
                level[k] = 1 + max(own, default=-1)
    return level


def test_levels(spark):
    rng, rows, want = random.Random(3), [], {}

    def conversation(conv: int, needs: dict) -> None:
        places = list(needs)
        rows.extend((conv, t, k, "f", '{"x":1}', needs[k]) for t, k in enumerate(places))
        want.update({(conv, k): v for k, v in brute_levels(needs).items()})

    chain = {f"c{k}": [f"c{k - 1}"] for k in range(21)}  # in order; the first one's dependency is unknown
    conversation(0, chain)
    conversation(1, dict(rng.sample(sorted(chain.items()), 21)))  # out of order
    conversation(2, {"a": [], "b": ["a", "none"], "c": ["a", "b"], "d": ["c"], "e": ["d"], "f": ["b", "e"], "g": ["f"]})
    conversation(3, {"a": ["c"], "b": ["a"], "c": ["b"], "d": ["c"], "e": ["d", "f"], "f": [], "g": ["f"], "h": ["e"], "i": ["i"], "j": ["h", "g"]})  # cycles
    for conv in range(4, 30):
        names = [f"n{k}" for k in range(rng.randrange(1, 14))]
        cyclic = conv % 3 == 0
        needs = {n: rng.sample(names if cyclic else names[:k], min(k, rng.choice([0, 1, 1, 1, 2, 3]))) for k, n in enumerate(names)}
        conversation(conv, dict(rng.sample(sorted(needs.items()), len(needs))))
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    got = chat.link_tool_calls(calls, results, SCHEMA).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want and len(got) == len(rows)
    assert want[0, "c20"] == want[1, "c20"] == 20 and want[3, "d"] is None and want[2, "g"] == 6
    assert all((r.status == "cycle") == (want[r.conv_id, r.call_id] is None) for r in got)


def test_levels_of_conversations(spark):
    """The registered query's levels, by recursive SQL."""
    import os

    import duckdb

    from quantalake.llm.queries import QUERIES

    data = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    want = duckdb.sql(f"""
WITH RECURSIVE calls AS (SELECT DISTINCT conv_id, turn FROM '{data}/conversations.parquet' WHERE role = 'user'),
levels AS (
  SELECT conv_id, turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, level + 1 FROM levels p JOIN calls c ON c.conv_id = p.conv_id AND c.turn = p.turn + 2)
SELECT conv_id, turn, level FROM levels""").fetchall()
    got = {(r.conv_id, r.turn, r.level) for r in QUERIES["op10_chat_tool_calls"](spark, data).collect()}
    assert got == set(want) and max(r[2] for r in got) > 1


def test_faults():
    f = chat.fault
    assert f(True, {"type": "integer"}) and f(1, {"type": "boolean"}) and not f(2.0, {"type": "integer"}) and f(2.5, {"type": "integer"})
    assert f([1, "a"], {"type": "array", "items": {"type": "integer"}}) == "$[1]: not of type integer"
    assert f(1, {"enum": [True]}) and not f(1, {"enum": [1]})
    assert f("abc", {"maxLength": 2}) == "$: maxLength" and f([], {"minItems": 1}) == "$: minItems"
    assert chat.parsed("NaN") is ... and chat.parsed(None) is ... and chat.parsed("null") is None
    for bad in ('{"x":1e400}', "-1e999", '{"x":"\\ud800"}', '{"\\udfff":1}', "[" * 100000, "1" * 10000):
        assert chat.parsed(bad) is ...
    assert chat.parsed('"\\ud83d\\ude00"') == "\U0001f600"
    chat.check_schema({"type": ["object", "null"], "title": "t", "properties": {"a": {"type": "array", "items": {"enum": [1]}}}})
    for schema in ({"const": 1}, {"properties": {"a": {"pattern": "x"}}}, {"items": {"anyOf": []}}, {"type": "text"}, {"additionalProperties": {}}, {"$ref": "#"}, 1):
        with pytest.raises(ValueError, match="unknown|must be"):
            chat.check_schema(schema)
    assert chat.canonical({"b": 1.0, "a": [True, None, 0.5]}) == '{"a":[true,null,0.5],"b":1}'


def test_pipeline(spark, tmp_path, prose):
    """The stages on a small folder, against what each is known to do there."""
    import corpus_pipeline as p

    line = "This line is in every document of them all"
    texts = {i: prose(40, i) + "\n" + line for i in range(30)}
    texts[30] = texts[3].replace(line, "") + line  # a near copy
    texts[31] = "12345 !!!"
    texts[32] = None
    bench = prose(25, 900)
    texts[33] = prose(30, 33) + " " + bench
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs, ids = p.load(spark, str(tmp_path), "documents"), []
    for k, (_, stage) in enumerate(p.STAGES):
        docs = p.stored(stage(spark, docs, str(tmp_path)), f"stage{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert k == 4 or docs.columns == p.COLUMNS
        if k == 1:
            assert not docs.where(F.col("text").contains(line)).count() and not docs.where("n_chars <> length(text)").count()
    everything = set(range(31)) | {33}
    assert ids == [everything, everything, everything - {30}, everything - {30, 33}, everything - {30, 33}]
    assert sorted(map(tuple, p.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_on_odd_tables(spark, tmp_path, prose):
    """Repeated rows, null ids and texts, and columns that clash; then a table without rows."""
    import corpus_pipeline as p

    texts = [(k, prose(60, k)) for k in range(40)] + [(3, prose(60, 3)), (None, prose(60, 77)), (None, prose(60, 77)), (None, None), (41, None), (42, ""), (43, prose(20_000, 5))]
    rows = [(i, t, "en", "s", 0, "clash", True) for i, t in texts]
    for name, own in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept boolean").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, prose(25, 900))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = p.run(spark, folder).collect()
        ids = sorted((r.doc_id for r in got if r.piece == 0), key=lambda x: (x is None, x))
        assert ids == ([*sorted([*range(40), 3, 43]), None, None] if own else [])


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_minhash_near_dedup", "op8_substring_dedup", "op10_chat_tool_calls"])
def test_sql(spark, name):
    import os

    import duckdb

    from quantalake.llm.queries import QUERIES, SQL

    data = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    df = QUERIES[name](spark, data)
    out = con.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(out.fetchall())
