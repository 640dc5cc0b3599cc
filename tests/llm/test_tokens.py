"""Tokenizer output, token files, packing and fingerprints: exact round trips and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantalake.llm import fingerprint as fp
from quantalake.llm.common import WordHashes, window_hashes
from quantalake.llm.packing import nnls, pack, patterns, plan, sequences
from quantalake.llm.tokenfiles import read_token_files, write_token_files
from quantalake.llm.tokens import Encoder, blocks, code_of, kind_of

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    None, "", "a\n\nb", " x", "x ", "a  b", "a \n b", "don't stop, I'll go.\nNext: 12,345.67 foo's é́ ñandú, .", "\nstart", "end\n", "İstanbul ΣΑΣ, ﬁ x\xa0y  z", "<|endoftext|> hi",
    "\x1ca \x1c b", "tab\tx \ty", "Å Ångström. ...", "١٢٣ a1b2,c", ".", ",", "a.\n.b", "\n", "a\n", "x's", "a--b--", "THE!!\nON%%%", "é%%% ÉA!!", "퟿ end", "𝔘nicode 😀!!",
]

#: All white space, and characters that show nothing.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
CONTROLS = "".join(map(chr, range(32))) + "\x7f\x80\x9f\u200b\u200d\ufeff\u180e"


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return Encoder(path, kind_of(path), code_of(path)), Tokenizer.from_file(path)


def test_encoder_is_exact(pair):
    own, plain = pair
    for a, b in zip(own.encode(pa.array(ODD)), ODD, strict=True):
        assert a.tolist() == plain.encode(b or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abÉé σΣİ\n\t .,'!1 ́"), max_size=25), max_size=4))
@pytest.mark.parametrize("name", FILES)
def test_encoder_on_any_text(name, texts):
    own = _encoders.setdefault(name, Encoder(public_tokenizers.path(name), kind_of(public_tokenizers.path(name))))
    for a, b in zip(own.encode(pa.array(texts, pa.string())), texts, strict=True):
        assert a.tolist() == own.tokenizer.encode(b, add_special_tokens=False).ids


_encoders: dict = {}


def test_encoder_on_white_space_and_controls(pair):
    """Runs of white space of all kinds, control characters and emoji, against an unchanged tokenizer."""
    own, plain = pair
    rng = random.Random(3)
    kinds = [SPACES, CONTROLS, "abcÉé'.,!1", "\n\xa0 a", "😀👍🏽é́ñ"]
    for _ in range(15):
        texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(14))) for _ in range(2000)]
        for t, a, b in zip(texts, own.encode(pa.array(texts)), plain.encode_batch(texts, add_special_tokens=False), strict=True):
            assert a.tolist() == b.ids, ascii(t)


SPECIAL = [*ODD, "see <|endoftext|> here", "<|endoftext|>", " <|endoftext|>\n<|startoftext|>x", "a<|endoftext|>b  c", "<|ENDOFTEXT|> <|endoftext |>", "é<|startoftext|>É!!", "x\n<|endoftext|>\n\n y"]


@pytest.mark.parametrize("name", FILES)
def test_special_strings(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    own = Encoder(path, kind_of(path), code_of(path))
    for texts in (SPECIAL, ODD[:4], [SPECIAL[-1]], []):
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in own.encode(pa.array(texts, pa.string()))] == want


def test_special_strings_in_operators(spark, docs, tmp_path):
    want = {name: [[*Tokenizer.from_file(public_tokenizers.path(name)).encode(t or "", add_special_tokens=False).ids, 0] for t in SPECIAL] for name in FILES}
    assert 50256 in want["byte_bpe_50k.json"][len(ODD)] and 49407 in want["word_bpe_49k.json"][len(ODD)]
    rows = pack(docs(SPECIAL), public_tokenizers.path("word_bpe_49k.json"), keep_ids=True).collect()
    assert [r.ids for r in sorted(rows, key=lambda r: r.doc_id)] == want["word_bpe_49k.json"]
    out = f"file://{tmp_path}/special"
    write_token_files(docs(SPECIAL), out, public_tokenizers.path("byte_bpe_50k.json"))
    rows = read_token_files(spark, out, keep_tokens=True).collect()
    assert [r.tokens for r in sorted(rows, key=lambda r: r.doc_id)] == want["byte_bpe_50k.json"]


def test_blocks():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 1, 1, 1, 200)])], names=["t"])
    assert [b.num_rows for b in blocks(batch, 0, 20)] == [1, 1, 3, 1]


def test_token_files(spark, docs, prose, tmp_path):
    texts = [prose(20 + k, k) for k in range(40)] + [None, "", "x" * 50000] + ["same", "same", "null id"]
    ids = random.Random(1).sample(range(1000), 43) + [5000, 5000, None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = f"file://{tmp_path}/files"
    manifest = write_token_files(docs(texts, ids), out, path, 0)
    assert manifest.agg({"docs": "sum"}).first()[0] == 46
    got = read_token_files(spark, out, keep_tokens=True).collect()
    plain, at = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.tokens) == (i, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_slices_of_any_store(tmp_path, monkeypatch):
    """What is read of files in a store without memory maps, a slice at a time."""
    from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

    from quantalake.llm import tokenfiles as tf

    monkeypatch.setattr(tf, "SLICE_DOCS", 3)
    monkeypatch.setattr(tf, "SLICE_IDS", 10)
    offsets = np.array([0, 2, 4, 30, 31, 32, 33, 34, 44], "<i8")
    offsets.tofile(tmp_path / "part.offsets")
    for fs, root in ((LocalFileSystem(), f"{tmp_path}/"), (SubTreeFileSystem(str(tmp_path), LocalFileSystem()), "")):
        got = [(a, cuts.tolist()) for a, cuts in tf._slices(tf._File(fs, f"{root}part.offsets", "<i8"), 8)]
        assert got == [(0, [0, 2, 4]), (2, [4, 30]), (3, [30, 31, 32, 33]), (6, [33, 34]), (7, [34, 44])]


def test_token_files_of_a_task_that_ran_twice(spark, docs, prose, tmp_path):
    """What another run of a task left in the folder is neither read nor replaced."""
    out, path = tmp_path / "files", public_tokenizers.path("byte_bpe_50k.json")
    out.mkdir()
    for n in range(8):
        for x in ("tokens", "offsets", "ids"):
            (out / f"part-{n:06d}-lost.{x}").write_bytes(b"half")
    write_token_files(docs([prose(9, k) for k in range(9)]), f"file://{out}", path)
    assert sorted(r.doc_id for r in read_token_files(spark, f"file://{out}").collect()) == list(range(9))
    assert all(f.read_bytes() == b"half" for f in out.glob("*-lost.*"))


def test_empty_token_files(spark, docs, tmp_path):
    write_token_files(docs([]), f"file://{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_nnls():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 5
        x = nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-6).all() and abs(gain[x > 0]).max(initial=0) < 1e-6  # the conditions of an optimum


def test_patterns():
    assert sorted(patterns(4, 3, {1, 2, 3, 4})) == [(2, 1, 1), (2, 2), (3, 1), (4,)]


@settings(max_examples=60, deadline=None)
@given(h=st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plan_uses_the_histogram(h):
    used, total = defaultdict(int), 0
    for lengths, n in plan(h, 64, 16, 4):
        assert sum(lengths) <= 64 and n > 0
        total += n
        for x in lengths:
            used[x] += n
    assert dict(used) == h
    assert total >= -(-sum(k * v for k, v in h.items()) // 64)


def test_plan_is_tight():
    rng = np.random.default_rng(2)
    h = dict(zip(*np.unique(np.minimum(rng.lognormal(6, 1, 200_000).astype(int) + 1, 2048), return_counts=True), strict=True))
    h = {int(k): int(v) for k, v in h.items()}
    total = sum(n for _, n in plan(h, 2048))
    assert total <= 1.001 * -(-sum(k * v for k, v in h.items()) // 2048) + 1


def test_pack(docs, prose):
    texts = [prose(3 + 7 * k % 90, k) for k in range(59)] + [prose(30_000, 8)] + [None, "", prose(700, 5)] + ["same text", "same text"]
    ids = [*range(63), 7, None]
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(docs(texts, ids), path, seq_len=128, keep_ids=True)
    rows, plain = pieces.collect(), Tokenizer.from_file(path)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for own in by.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    whole = sorted([*plain.encode(t or "", add_special_tokens=False).ids, 0][a : a + 128] for t in texts for a in range(0, len(plain.encode(t or "", add_special_tokens=False).ids) + 1, 128))
    assert sorted(r.ids for r in rows) == whole
    joined = {r.sequence_id: r.ids for r in sequences(pieces).collect()}
    assert all(joined[k] == [x for _, _, ids in sorted(v) for x in ids] for k, v in by.items())
    assert pack(docs([]), path).count() == 0


def test_fingerprints(docs, prose):
    texts = [prose(80, 1), prose(80, 1), "é" * 7, None, "", "one two", prose(300, 2), prose(300, 2)[:-20]]
    got = {r.doc_id: r for r in fp.fingerprints(docs(texts)).collect()}
    order = list(range(len(texts) - 1, -1, -1))
    for n, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        half = len(t) // 2
        other = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1
    assert got[7].near_next > 0.85 and got[6].near_next < 0.05
    assert fp.fingerprints(docs([])).count() == 0
    assert fp.fingerprints(docs(["just one"])).first().near_next == 1


def test_fingerprints_with_equal_and_null_ids(docs):
    got = fp.fingerprints(docs(["a b", "a b", "c d", "e f"], [3, 3, None, None])).collect()
    assert sorted(r.doc_id or -1 for r in got) == [-1, -1, 3, 3]


def brute_sketch(text):
    """Hashes of all shingles one by one, the smallest 128 of them."""
    words = WordHashes().of((text or "").encode().split())
    return sorted({int(window_hashes(words[i : i + 5], min(5, len(words)))[0]) for i in range(max(1, len(words) - 4)) if len(words)})[:128]


def test_fingerprints_by_brute_force(docs, prose, monkeypatch):
    """Order, edited texts, sketches and likenesses from sets; many ranges, one id for a third of the rows, long texts."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 2000)
    texts = [prose(random.Random(k).randrange(1, 200), k % 30) for k in range(60)] + [prose(3, k) for k in range(30)] + [None, "", "x" * 300_000, prose(66_000, 3)]
    ids = [*random.Random(4).sample(range(-50, 1000), 60), *[7] * 25, *[None] * 5, 1001, 1002, 1003, 1004]
    got = fp.fingerprints(docs(texts, ids)).collect()
    assert len(got) == len(texts)
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_sketch = {}
    for d, t in rows:
        by_sketch.setdefault((d, fp.to_text(np.array(brute_sketch(t), np.uint64))), []).append(t or "")
    for r in got:
        own = by_sketch[r.doc_id, r.fingerprint]
        assert r.n_chars in map(len, own)
    where = {d: n for n, (d, _) in enumerate(rows)}
    for r in got:
        if r.doc_id is None or r.doc_id == 7 or rows[(where[r.doc_id] + 1) % len(rows)][0] in (None, 7):
            continue  # ties by hash
        t, after = (rows[(where[r.doc_id] + k) % len(rows)][1] or "" for k in (0, 1))
        other = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        a, b, c = (brute_sketch(x) for x in (t, other, after))
        assert r.edited_fingerprint == fp.to_text(np.array(b, np.uint64))
        for said, x in ((r.near_edited, b), (r.near_next, c)):
            union = sorted(set(a) | set(x))[:128]
            assert said == pytest.approx(sum(h in a and h in x for h in union) / len(union) if union else 1.0)


def test_sketches_merge():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64) << np.uint64(1))
    a, b = h[rng.random(len(h)) < 0.7], h[rng.random(len(h)) < 0.7]
    both = fp.merge(fp.sketch(a), fp.sketch(b))
    assert np.array_equal(both, fp.sketch(np.union1d(a, b)))
    assert fp.resemblance(fp.sketch(a), fp.sketch(b)) == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)), abs=0.15)
    assert fp.distinct(fp.sketch(a)) == pytest.approx(len(a), rel=0.3)
    assert fp.containment(fp.sketch(a[:1000]), fp.sketch(a)) > 0.6
    assert np.array_equal(fp.from_text(fp.to_text(fp.sketch(a))), fp.sketch(a))
