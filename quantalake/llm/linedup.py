"""Line deduplication across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import OWN, stored, unprefixed, with_outputs

#: White space is 0x20 and 0x09-0x0D; only A-Z are lower-cased.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The normalised line: stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hash(line: Column, min_chars: int) -> Column:
    """Two independent hashes of the key (96 bits); null for keys that are too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b")))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    out_col: str = "kept_text",
) -> DataFrame:
    """Drop the lines whose key occurs in at least ``min_docs`` documents.

    Returns the columns of ``docs`` and ``n_lines``, ``n_dropped`` (long) and ``out_col``: the other lines, in their
    places, joined by a newline. Input columns of these names are replaced.

    Defined cases: a null or empty text is one empty line (kept, as its key is shorter than ``min_chars``); rows that
    share an ``id_col`` value, null included, count as one document and each keeps its own lines; a text all of whose
    lines go becomes empty; an empty table gives an empty table.

    Plan: lines are exploded and stored once, as hashes and places only. (hash, document) pairs are made distinct and counted per hash
    with partial aggregates, so that a line found in a third of all rows is summed before the shuffle. Dropped places
    are gathered by (id, hashes of the text), so rows with one id or none are spread by their texts, and equal rows
    share one set of places. The text moves once, for the join by that key.
    """
    docs = unprefixed(docs)
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    row = [ident.alias("d"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]
    placed = (
        docs.select(*row, F.posexplode(lines).alias("at", "line"))
        .select("d", "t1", "t2", "at", _hash(F.col("line"), min_chars).alias("h"))
        .where("h is not null")
        .select("d", "t1", "t2", "at", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    )
    placed = stored(placed, "lines")
    frequent = placed.select("d", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    drops = placed.join(frequent, ["a", "b"]).groupBy("d", "t1", "t2").agg(F.collect_set("at").alias(f"{OWN}drop"))
    drops = drops.select(F.col("d").alias(f"{OWN}d"), F.col("t1").alias(f"{OWN}t1"), F.col("t2").alias(f"{OWN}t2"), f"{OWN}drop")
    drop = F.col(f"{OWN}drop")
    same = ident.eqNullSafe(F.col(f"{OWN}d")) & (F.xxhash64(text) == F.col(f"{OWN}t1")) & (F.hash(text) == F.col(f"{OWN}t2"))
    joined = docs.join(drops, same, "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)  # by a hash set, in order
    split = F.col(f"{OWN}lines")
    stays = F.transform(places, lambda k: F.get(split, k))
    joined = joined.withColumn(f"{OWN}lines", lines)
    joined = joined.withColumns({f"{OWN}n": F.size(split).cast("long"), f"{OWN}kept": F.when(drop.isNotNull(), stays)})
    kept = F.col(f"{OWN}kept")
    return with_outputs(
        joined,
        {
            "n_lines": F.col(f"{OWN}n"),
            "n_dropped": F.when(kept.isNull(), F.lit(0)).otherwise(F.col(f"{OWN}n") - F.size(kept)).cast("long"),
            out_col: F.when(kept.isNull(), text).otherwise(F.array_join(kept, "\n")),
        },
    )
