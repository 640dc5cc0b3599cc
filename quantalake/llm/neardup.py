"""Near-duplicate documents: MinHash bands, odd sketches, and full sets for the last word.

1. Each text becomes its set of distinct five-word shingles, 128 MinHash samples of it, 32 keys of four samples each,
   and an odd sketch: the samples folded into a parity bitmap. Equal sets are put together.
2. Texts that share a key are compared by their odd sketches; the population count of the XOR estimates the similarity.
   What reaches ``MARGIN`` below the threshold joins a candidate group.
3. Within candidate groups, full sets confirm links, the likeliest first, until no unconfirmed pair of different
   classes is left that the sketches allow.

Two texts at the threshold share none of the 32 keys with a probability of (1 - 0.75**4)**32 = 5e-6; the margin is over
five standard deviations of the estimate. Sets are compared as 64-bit hashes of shingles, and equal sets are put together
by 128 bits.

Groups of more than BLOCK rows are worked in blocks, each with a few hubs of the whole group. That makes a large group
of like texts one class, by work in proportion to its rows. Only where classes are left over are the rows outside the
largest one compared with all other blocks, so nothing is missed; no step emits all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import OWN, WordHashes, blobs, few, mix, shingles, stored, tidy, unprefixed, with_outputs
from quantalake.llm.components import components

SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
BITS = 1024
MARGIN = 0.2
BLOCK, HUBS = 512, 8

_random = np.random.Generator(np.random.PCG64(20240517))
_MUL = _random.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, SAMPLES, np.uint32)
_BAND = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
_SLOT = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def samples(hashes: np.ndarray) -> np.ndarray:
    """The smallest image of the shingles under each of the maps x -> a x + b modulo 2**32."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        least = np.minimum(least, (np.multiply.outer(_MUL, x[a : a + 4096]) + _ADD[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    own = least.astype(np.uint64).reshape(BANDS, ROWS)
    return mix((mix(own + np.uint64(1)) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    at = (mix(least.astype(np.uint64) + _SLOT) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


def most_bits(similarity: float) -> int:
    """The most differing bits at which the estimate 1 + n/(4k) ln(1 - 2d/n) still reaches ``similarity``."""
    return int(BITS / 2 * (1 - np.exp(-(1 - similarity) * 4 * SAMPLES / BITS)))


def _table(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _sets(text: bytes | None, words: WordHashes, size: int) -> np.ndarray:
    return shingles(words.of(text.lower().split()), size) if text else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """d, tie, n (set size), s (128 bits for the set), keys and sketch of each row d, t, tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in few(batches):
            out: list[list] = [[], [], [], []]
            for text in blobs(batch[1]):
                own = _sets(text, words, size)
                signed = np.array([mix(own).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64)
                least = samples(own) if len(own) else None
                row = (len(own), signed.tobytes(), band_keys(least) if len(own) else None, odd_sketch(least).tobytes() if len(own) else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield _table([batch[0], batch[2], *out], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()], ["d", "tie", "n", "s", "keys", "sketch"])

    return docs.mapInArrow(tidy(run), "d long, tie long, n long, s binary, keys array<long>, sketch binary")


def linked_edges(rows: DataFrame, group: str, edges, name: str) -> DataFrame:
    """The edges u, v that ``edges`` finds within groups, as many as it takes to have all classes right.

    rows: ``group``, d, w (a hash, for rows that share d) and what else ``edges`` needs; it gets them with p, q (a pair
    of blocks), c (a class: rows of one class needn't be compared) and ``large`` (report the class of each row: see
    ``_LINKS``). A class found in a block has its smallest hub's name, so classes of several blocks come together.
    """
    counts = stored(rows.groupBy(group).agg(F.count("*").alias("in_group")).where("in_group > 1"), name)
    large = F.col("in_group") > BLOCK
    sized = rows.join(counts, group).withColumns({"c": F.col("d"), "large": large})
    hub = large & (F.pmod(F.xxhash64("d", "w", F.lit(5)), F.col("in_group")) < HUBS)
    blocks = F.when(hub, F.sequence(F.lit(0), _blocks(F.col("in_group")) - 1)).otherwise(F.array(_block(F.col("in_group"), 0)))
    found = edges(sized.withColumn("hub", hub).withColumn("p", F.explode(blocks)).withColumn("q", F.col("p")).drop("in_group"))
    links = lambda x: x.where("v is not null").select("u", "v")
    if counts.where(large).isEmpty():
        return links(found)
    found = stored(found, f"{name}_first")
    placed = found.where("v is null").groupBy("key", "u").agg(F.min("c").alias("c")).withColumnsRenamed({"key": group, "u": "d"})
    each = placed.groupBy(group, "c").agg(F.count("*").alias("m"))
    best = each.groupBy(group).agg(F.max(F.struct("m", "c")).alias("best"), F.sum("m").alias("n"), F.count("*").alias("k"))
    best = stored(best.where("k > 1").select(group, "n", F.col("best.c").alias("most"), (F.col("n") - F.col("best.m")).alias("rest")), f"{name}_open")
    if best.isEmpty():
        return links(found)
    # the rows outside the largest class, in blocks, against all blocks of the group
    open_rows = rows.join(placed.join(best, group), [group, "d"]).withColumns({"large": F.lit(False), "hub": F.lit(False)})
    here, there = F.sequence(F.lit(0), _blocks(F.col("rest")) - 1), F.sequence(F.lit(0), _blocks(F.col("n")) - 1)
    left = open_rows.where("c <> most").withColumn("p", _block(F.col("rest"), 1)).withColumn("q", F.explode(there))
    right = open_rows.withColumn("q", _block(F.col("n"), 2)).withColumn("p", F.explode(here))
    return links(found.unionByName(edges(left.unionByName(right).drop("n", "most", "rest"))))


#: An edge is u, v; the class c of a row u of a large group ``key`` has no v.
_LINKS = "key long, u long, v long, c long"


def _links(edges: list[tuple[int, int]], key: np.ndarray, d: np.ndarray, c: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
    """Edges between ids, and the classes ``c`` (any numbers) of rows, each under the name of its smallest hub."""
    names = np.full(int(c.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(names, c[hub], d[hub])
    alone = names == np.iinfo(np.int64).max
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, c, d)
    names = np.where(alone, least, names)
    u, v = ([x[k] for x in edges] for k in (0, 1))
    none = [None] * len(u)
    return _table([none + key.tolist(), u + d.tolist(), v + [None] * len(d), none + names[c].tolist()], [pa.int64()] * 4, ["key", "u", "v", "c"])


def _blocks(rows: Column) -> Column:
    """The number of blocks of about BLOCK rows."""
    return F.ceil(rows / F.lit(BLOCK)).cast("int")


def _block(rows: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("d", "w", F.lit(seed)), _blocks(rows)).cast("int")


class Classes:
    """Union-find over rows 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        own = np.array(self.parent)
        while (up := own[own]) is not own and not np.array_equal(up, own):
            own = up
        self.parent = own.tolist()
        return own


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches again, each run of equal first ``keys`` columns whole in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch[k][batch.num_rows - 1].as_py() for k in range(keys)]
        same = np.ones(batch.num_rows, bool)
        for k in range(keys):
            same &= batch[k].to_numpy(zero_copy_only=False) == last[k]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        elif held and [held[0][k][0].as_py() for k in range(keys)] != last:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _words64(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def candidate_edges(rows: DataFrame, most: int) -> DataFrame:
    """Edges u, v that put together what shares a key and differs in at most ``most`` sketch bits; no more than needed.

    rows: key, p, q, d, c, large, hub, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_group(batches, 3):
            key, p, q, d, c, large, hub = (batch[k].to_numpy(zero_copy_only=False) for k in range(7))
            bits = _words64(batch[7])
            known, node = np.unique(c, return_inverse=True)
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            largest = int(np.bincount(group).max())
            classes, edges = Classes(len(known)), []
            label = np.arange(len(known))
            for step in range(1, largest):
                i = np.flatnonzero(group[:-step] == group[step:])
                if not len(i):
                    break
                i = i[label[node[i]] != label[node[i + step]]]
                if len(i):
                    i = i[np.bitwise_count(bits[i] ^ bits[i + step]).sum(axis=1) <= most]
                joined = False
                for k, a, b in zip(i.tolist(), node[i].tolist(), node[i + step].tolist(), strict=True):
                    if classes.join(a, b):
                        edges.append((int(d[k]), int(d[k + step])))
                        joined = True
                if joined:
                    label = classes.labels()
            large = large.astype(bool)
            own = np.unique(np.stack([group[large], label[node[large]]]), axis=1, return_inverse=True)[1].ravel()
            yield _links(edges, key[large], d[large], own, hub.astype(bool)[large])

    dealt = rows.select("key", "p", "q", "d", "c", "large", "hub", "sketch").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "d")
    return dealt.mapInArrow(tidy(run), _LINKS)


def confirmed(sets: list[np.ndarray], bits: np.ndarray, known: np.ndarray, similarity: int, most: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs with 100 |a & b| >= similarity |a | b|, as many as it takes to have all classes right, and the
    class of each set.

    ``known``: classes that there are already.
    """
    n = len(sets)
    known = np.unique(known, return_inverse=True)[1]
    first, second, distance = [], [], []
    for i in range(n - 1):
        far = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1)
        j = np.flatnonzero((far <= most) & (known[i + 1 :] != known[i]))
        first.append(np.full(len(j), i, np.int32))
        second.append((j + i + 1).astype(np.int32))
        distance.append(far[j].astype(np.int16))
    if not first:
        return [], known
    first, second, distance = (np.concatenate(x) for x in (first, second, distance))
    order = np.argsort(distance, kind="stable")
    classes, links = Classes(int(known.max()) + 1), []
    for at in range(0, len(order), 2048):
        label = classes.labels()[known]
        part = order[at : at + 2048]
        part = part[label[first[part]] != label[second[part]]]
        for a, b in zip(first[part].tolist(), second[part].tolist(), strict=True):
            if classes.find(known[a]) == classes.find(known[b]):
                continue
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, True))
            if 100 * both >= similarity * (len(x) + len(y) - both):
                classes.join(known[a], known[b])
                links.append((a, b))
    return links, classes.labels()[known]


def confirmed_edges(rows: DataFrame, similarity: int, most: int) -> DataFrame:
    """Confirmed edges u, v within each (g, p, q); rows: g, p, q, d, c, large, hub, shingles (binary), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_group(batches, 3):
            g, p, q, d, c, large, hub = (batch[k].to_numpy(zero_copy_only=False) for k in range(7))
            bits = _words64(batch[8])
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist(), len(g)]
            edges = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                sets = [np.frombuffer(x, np.uint64) for x in batch[7].slice(a, b - a).to_pylist()]
                links, label = confirmed(sets, bits[a:b], c[a:b], similarity, most)
                edges += [(int(d[a + i]), int(d[a + j])) for i, j in links]
                if large[a]:
                    yield _links([], g[a:b], d[a:b], label, hub[a:b].astype(bool))
            none = np.zeros(0, np.int64)
            yield _links(edges, none, none, none, none.astype(bool))

    dealt = rows.select("g", "p", "q", "d", "c", "large", "hub", "shingles", "sketch").repartition("g", "p", "q").sortWithinPartitions("g", "p", "q", "d")
    return dealt.mapInArrow(tidy(run), _LINKS)


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """g, d, shingles, sketch of rows g, d, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in few(batches):
            sets = [_sets(x, words, size) for x in blobs(batch[2])]
            columns = [batch[0].to_pylist(), batch[1].to_pylist(), [x.tobytes() for x in sets], [odd_sketch(samples(x)).tobytes() for x in sets]]
            yield _table(columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["g", "d", "shingles", "sketch"])

    return docs.mapInArrow(tidy(run), "g long, d long, shingles binary, sketch binary")


def near_duplicates(docs: DataFrame, similarity: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by 100 |a & b| >= similarity |a | b| over their sets of ``size``-word shingles.

    Returns the columns of ``docs`` and n_shingles, component_id (the smallest id that can be reached) and kept (id =
    component_id). Input columns of these names are replaced.

    Defined cases: words are split at ASCII white space and A-Z are lower-cased; a text with fewer than ``size`` words
    is one shingle; an empty or null text has no shingles and no links; a null id is in no class (component_id null)
    and is kept; rows that share an id are one node, so that links of either text hold for it, and all its rows are
    kept or none; an empty table gives no rows.
    """
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    most = most_bits(similarity / 100 - MARGIN)
    own = unprefixed(docs).select(ident.alias("d"), text.alias("t"), F.xxhash64(text).alias("tie"))
    signed = stored(signatures(own, size), "signed")
    full = signed.where("n > 0 and d is not null")
    classes = stored(full.groupBy("s", "n").agg(F.min("d").alias("first")), "classes")  # equal sets
    texts = full.join(classes, ["s", "n"]).where("d = first").select("d", F.xxhash64("s").alias("w"), "keys", "sketch").dropDuplicates(["d", "w"])
    texts = stored(texts, "texts")

    keyed = texts.select("d", "w", F.explode("keys").alias("key"))
    sketched = lambda rows: rows.join(texts.select("d", "w", "sketch"), ["d", "w"])  # noqa: E731 (the sketches travel last)
    candidates = linked_edges(keyed, "key", lambda rows: candidate_edges(sketched(rows), most), "keys")
    groups = stored(components(candidates).select(F.col("node"), F.col("component").alias("g")), "groups")

    chosen = own.join(groups, F.col("d") == F.col("node")).select("g", "d", "t").where("t is not null")
    sets = stored(shingle_rows(chosen, size).withColumn("w", F.xxhash64("shingles")).dropDuplicates(["d", "w"]), "sets")
    links = linked_edges(sets, "g", lambda rows: confirmed_edges(rows, similarity, most), "sizes")

    same = full.join(classes, ["s", "n"]).where("d <> first").select(F.col("d").alias("u"), F.col("first").alias("v"))
    linked = components(links.unionByName(same)).withColumnsRenamed({"node": f"{OWN}node", "component": f"{OWN}component"})
    found = signed.select(F.col("d").alias(f"{OWN}d"), F.col("tie").alias(f"{OWN}tie"), F.col("n").alias(f"{OWN}n")).dropDuplicates()
    found = found.join(linked, F.col(f"{OWN}d") == F.col(f"{OWN}node"), "left").drop(f"{OWN}node")
    joined = docs.withColumn(f"{OWN}own", F.xxhash64(text)).join(found, ident.eqNullSafe(F.col(f"{OWN}d")) & (F.col(f"{OWN}own") == F.col(f"{OWN}tie")))
    component = F.coalesce(F.col(f"{OWN}component"), ident)
    return with_outputs(joined, {"n_shingles": F.col(f"{OWN}n"), "component_id": component, "kept": component.isNull() | (component == ident)})
