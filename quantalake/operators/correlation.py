"""Correlation of pairs, matrices and series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalake.functions import ieee
from quantalake.functions.aggregates import correlation, with_mean
from quantalake.operators.ranks import range_of, with_ranks
from quantalake.sources.scratch import stored

#: Points of a group that a task counts, and stripes into which a larger one is cut at a time.
POINTS, STRIPES = 1 << 20, 256
#: Blocks of a series, the shortest and the longest, and sums by lag that a task holds.
BLOCKS, SHORTEST, LONGEST, HELD_LAGS = 32, 1024, 1 << 20, 1 << 22


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(correlation(x, y).alias("r"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The correlation of average ranks."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(with_ranks(with_ranks(own, by, x, "__rx"), by, y, "__ry"), by, "__rx", "__ry")


def pearson_matrix(df: DataFrame, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """(i, j, v): the correlation of each two rows of a matrix in coordinates. Each pair is computed once."""
    a = df.select(F.col(i).alias("a"), F.col(j).alias("at"), F.col(v).alias("x"))
    b = df.select(F.col(i).alias("b"), F.col(j).alias("at"), F.col(v).alias("y"))
    half = a.join(b, "at").where("a <= b").groupBy("a", "b").agg(correlation("x", "y").alias("v"))
    both = half.withColumn("ij", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    return both.select(F.col("ij.a").alias("i"), F.col("ij.b").alias("j"), "v")


def spearman_matrix(df: DataFrame, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    return pearson_matrix(with_ranks(df, [i], v, "__r"), i, j, "__r")


def discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> float:
    """The pairs with x rising and y falling: inversions, counted bit by bit of the ranks of y. ``w``: how many times
    each point is there."""
    order = np.lexsort((y, x))
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    weight = np.ones(len(x), np.int64) if w is None else w[order]
    kind = np.int64 if float(weight.sum()) ** 2 < 2.0**62 else np.float64
    total = kind(0)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        group = rank >> (bit + 1)
        by = np.argsort(group, kind="stable")
        one, n = (rank[by] >> bit) & 1, weight[by].astype(kind)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(group[by]) != 0]))
        before = np.cumsum(one * n) - one * n
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(by))))
        total += (before * n)[one == 0].sum()
    return float(total)


def _stripe(x: str, points: str, most: int) -> Column:
    """A number that rises with x; a value that is a point has one of its own, however often it is there."""
    below = range_of(F.col(x), F.col(points), most)
    return 2 * below + F.when(F.get(points, below) == F.col(x), 1).otherwise(0)


def _discordant(own: DataFrame, by: list[str], depth: int = 0) -> DataFrame:
    """``by`` and __d: the discordant pairs of points __x, __y that are there __n times, as partial counts.

    A group of at most POINTS points is counted by a task. Larger ones are cut into stripes of both axes, at the
    group's own quantiles: pairs in different stripes of both come from the counts of cells, those within a stripe of x,
    and those in one stripe of y only, from the same count of the smaller groups.
    """
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + "__d double"

    def counted(table: pa.Table) -> pa.Table:
        d = discordant(*(table[n].to_numpy() for n in ("__x", "__y", "__n")))
        return pa.table([*[table[b].slice(0, 1) for b in by], pa.array([d])], names=[*by, "__d"])

    sizes = own.groupBy(*by).agg(F.count("*").alias("__points"))
    largest = sizes.agg(F.max("__points")).first()[0] or 0
    if largest <= POINTS:
        return own.groupBy(*by).applyInArrow(counted, schema)
    stripes = min(STRIPES, 2 * -(-largest // POINTS))
    shares, names = [i / stripes for i in range(1, stripes)], (f"__sx{depth}", f"__sy{depth}")
    ends = own.groupBy(*by).agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c, shares, 20 * stripes))).alias(f"__p{c}") for c in ("__x", "__y")], F.count("*").alias("__points"))
    cut = own.join(ends, by)
    small = cut.where(F.col("__points") <= POINTS).select(*own.columns).groupBy(*by).applyInArrow(counted, schema)
    cut = cut.where(F.col("__points") > POINTS).select(*own.columns, *[_stripe(c, f"__p{c}", stripes - 1).alias(n) for c, n in zip(("__x", "__y"), names, strict=True)])
    cut = stored(cut, "stripes")
    cells = cut.groupBy(*by, *names).agg(F.sum("__n").alias("__n")).withColumnsRenamed({names[0]: "__x", names[1]: "__y"})
    parts = small.unionByName(cells.groupBy(*by).applyInArrow(counted, schema))  # at most (2 STRIPES)**2 cells a group
    inner = cut.select(*by, names[0], "__x", "__y", "__n")
    across = cut.groupBy(*by, names[1], names[0], "__y").agg(F.sum("__n").alias("__n")).withColumnRenamed(names[0], "__x")
    for rest, stripe in ((inner, names[0]), (across.select(*by, names[1], "__x", "__y", "__n"), names[1])):
        spread = rest.groupBy(*by, stripe).agg((F.min("__x") != F.max("__x")).alias("__a"), (F.min("__y") != F.max("__y")).alias("__b")).where("__a and __b").drop("__a", "__b")
        left = stored(rest.join(spread, [*by, stripe]), "level")
        parts = parts.unionByName(_discordant(left, [*by, stripe], depth + 1).drop(stripe))
    return parts


def kendall(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by`` and tau (the b variant); NaN for one pair or none.

    Equal points are summed first. No task holds more than about POINTS points of a group: see ``_discordant``. Ties are
    counted by aggregates. The driver gets the size of the largest group.
    """
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    own = own.groupBy(*by, (F.col(x).cast("double") + 0.0).alias("__x"), (F.col(y).cast("double") + 0.0).alias("__y")).agg(F.count("*").alias("__n"))
    keyed = own if by else own.withColumn("__all", F.lit(0))
    d = _discordant(keyed, by or ["__all"]).groupBy(*by).agg(F.sum("__d").alias("__d"))

    def ties(*columns: str) -> DataFrame:
        n, name = F.col("__n").cast("double"), "".join(columns)
        return own.groupBy(*by, *columns).agg(F.sum("__n").alias("__n")).groupBy(*by).agg(F.sum(n * (n - 1) / 2).alias("__t" + name), F.sum(n).alias("__n" + name))

    out = d
    for t in (ties("__x"), ties("__y"), ties("__x", "__y")):
        out = out.join(t, by) if by else out.crossJoin(F.broadcast(t))  # a single row
    n, tx, ty, both, down = (F.col(c) for c in ("__n__x", "__t__x", "__t__y", "__t__x__y", "__d"))
    pairs = n * (n - 1) / 2
    tau = ieee.divide(pairs - tx - ty + both - 2 * down, F.sqrt(pairs - tx) * F.sqrt(pairs - ty))
    return out.select(*by, F.when(n > 1, tau).otherwise(F.lit(ieee.NAN)).alias("tau"))


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of a_i b_{i+k} for k from 1 - len(a) to len(b) - 1, by transforms."""
    size = 1 << (len(a) + len(b) - 2).bit_length() if len(a) + len(b) > 2 else 1
    return np.fft.irfft(np.fft.rfft(a[::-1], size) * np.fft.rfft(b, size), size)[: len(a) + len(b) - 1] if size > 1 else a * b


def autocovariance(df: DataFrame, by: list[str], idx: str, x: str, max_lag: int | None = None) -> DataFrame:
    """``by``, lag, c: the mean over n of (x_i - m)(x_{i+lag} - m), for lags 0 to n - 2, or to ``max_lag``.

    ``idx`` is the 0-based place, without gaps. A series is cut into at most about BLOCKS blocks, or blocks of LONGEST
    values; each block meets those after it that the largest lag reaches, and a pair of blocks gives the sums for all
    lags between them at once, by Fourier transforms. A task adds sums up by lag before they are shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    centred = with_mean(df.select(*by, idx, x), by, x, "__m").select(*by, F.col(idx).cast("long").alias("__i"), (F.col(x) - F.col("__m")).alias("__d"))
    sizes = centred.groupBy(*by).agg(F.count("*").alias("__n"))
    block = F.least(F.lit(LONGEST), F.greatest(F.lit(SHORTEST), F.ceil(F.col("__n") / BLOCKS))).cast("long")
    sizes = sizes.select(*by, "__n", block.alias("__b"), (F.col("__n") - 2 if max_lag is None else F.least(F.col("__n") - 2, F.lit(max_lag))).alias("__last")).where("__last >= 0")
    sized = centred.join(sizes, by) if by else centred.crossJoin(F.broadcast(sizes))  # a single row
    keys = [*by, "__n", "__b", "__last"]
    values = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__d"))), lambda s: s["__d"])
    blocks = stored(sized.groupBy(*keys, F.floor(F.col("__i") / F.col("__b")).alias("__p")).agg(values.alias("__x")), "blocks")
    reach = F.least(F.floor((F.col("__n") - 1) / F.col("__b")), F.col("__p") + F.floor((F.col("__last") + F.col("__b") - 1) / F.col("__b")))
    left = blocks.withColumn("__q", F.explode(F.sequence("__p", reach)))
    pairs = left.join(blocks.select(*by, F.col("__p").alias("__q"), F.col("__x").alias("__y")), [*by, "__q"])
    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + "__n long, __first long, __sums array<double>"

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        types = None

        def rows() -> pa.RecordBatch:
            columns = [pa.array([key[k] for key in found], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], names=[*by, "__n", "__first", "__sums"])

        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                types = [*(one[b].type for b in by), pa.int64(), pa.int64()]
                n, size, last, p, q = (one[c][0].as_py() for c in ("__n", "__b", "__last", "__p", "__q"))
                a, b = (one[c].flatten().to_numpy() for c in ("__x", "__y"))
                sums = _crossed(a, b)
                for first in ((q - p) * size, (q - p - 1) * size):  # lags from here on, as many as a block has
                    low = first - (q - p) * size + len(a) - 1
                    own = np.zeros(size)
                    part = sums[max(low, 0) : low + size] if low + size > 0 else sums[:0]
                    own[max(0, -low) : max(0, -low) + len(part)] = part
                    if 0 <= first <= last:
                        key = (*(one[c][0].as_py() for c in by), n, first)
                        found[key] = found.get(key, 0.0) + own[: last - first + 1]
                if sum(map(len, found.values())) > HELD_LAGS:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    lags = pairs.mapInArrow(cross, schema).select(*by, "__n", "__first", F.posexplode("__sums").alias("__at", "__v"))
    return lags.groupBy(*by, (F.col("__first") + F.col("__at")).alias("lag")).agg((F.sum("__v") / F.max("__n")).alias("c"))


def autocorrelation(df: DataFrame, by: list[str], idx: str, x: str, max_lag: int | None = None) -> DataFrame:
    """``by``, lag, r and its bounds lo, hi: -1/n -+ 1.96 sqrt((1 + 2 sum of r**2 up to the lag) / n); 1 at lag 0."""
    c = autocovariance(df, by, idx, x, max_lag)
    sizes = df.groupBy(*by).agg(F.count(x).alias("n"))
    joined = c.join(sizes, by) if by else c.crossJoin(F.broadcast(sizes))  # a single row
    w = Window.partitionBy(*by).orderBy("lag")  # a row a lag
    own = joined.withColumn("r", ieee.divide(F.col("c"), F.first("c").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    spread = 1.96 * F.sqrt((1 + 2 * F.sum(F.col("r") * F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, 0))) / F.col("n"))
    bound = lambda sign: F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(-1 / F.col("n") + sign * spread)
    return own.select(*by, "lag", "r", bound(-1).alias("lo"), bound(1).alias("hi"))
