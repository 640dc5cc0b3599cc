"""Language identification with bit-sliced Bloom filters of character n-grams.

Slot i of the table has a bit for each language; a language's n-gram sets its bit in HASHES slots. The AND of an
n-gram's slots is the bitmask of all languages that have it. Over a text's n-grams, the set bits are counted for each
language, corrected for the filter's false positives, and the largest share decides.

The filters are fitted on every text with a language that isn't held out, cuts come from the scores of the same texts,
and every text is judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalake.llm.common import OWN, few, mix, release, stored, tidy
from quantalake.llm.sampling import held_out

SIZES = (3, 4)
SLOTS, HASHES = 1 << 18, 4
GRAMS, LEAST, RELATIVE = 8192, 3, 0.1
#: Cuts: half of what 99 % of a language's own texts reach. Sentences in languages that aren't learned score 0.1 to 0.4.
LOWEST, PART, FLOOR = 0.01, 0.5, 0.1
#: Scores are counted in steps of 1 / STEPS for the cuts; a language's n-grams are put in order by so many tasks.
STEPS, PARTS = 10_000, 64
UNKNOWN = "und"
JUDGED = OWN + "judged"
CHUNK = 1 << 16
#: Texts that are Python objects at a time, and n-grams that a task holds before it sums them up.
ROWS, HELD = 512, 1 << 21
#: What isn't a letter: first what \w leaves out, digits and underscores, then number signs of other kinds, which few
#: texts have.
_OTHER = re.compile(r"[\W\d_]+")
_NUMBERS = re.compile("[ " + "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha()) + "]+")


def letters(text: str) -> str:
    """The runs of letters of a text, in lower case, by category, with a space between them."""
    own = _OTHER.sub(" ", text.lower()).strip()
    return own if own.replace(" ", "").isalpha() else _NUMBERS.sub(" ", own).strip()


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text's letter runs, in lower case, each between two spaces; in chunks."""
    if not text:
        return
    own = np.frombuffer(f" {letters(text)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(own) < 3:
        return
    for a in range(0, len(own), CHUNK):
        part = own[a : a + CHUNK + max(SIZES) - 1]
        code, space = part.astype(np.uint64), part == 32
        for n in SIZES:
            count = min(CHUNK, len(part) - n + 1)
            if count <= 0:
                continue
            h, inside = np.full(count, n, np.uint64), np.zeros(count, bool)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + count]
                if 0 < k < n - 1:
                    inside |= space[k : k + count]
            yield mix(h[~inside])


def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    step = hashes >> np.uint64(32) | np.uint64(1)
    for k in range(HASHES):
        yield ((hashes + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


class Filters:
    """The bit-sliced table: SLOTS rows, a 64-bit word for every 64 languages."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        self.table = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
        for k, own in enumerate(members):
            for at in _slots(own):
                self.table[at, k // 64] |= np.uint64(1 << (k % 64))
        filled = np.array([np.count_nonzero(self.table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))])
        self.false = (filled / SLOTS) ** HASHES

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for at in _slots(hashes):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def shares(self, text: str | None) -> np.ndarray | None:
        """For each language, the corrected share of the text's n-grams that it has; None where there are none."""
        total, hits = 0, np.zeros(len(self.languages))
        for own in grams(text):
            total += len(own)
            masks = self.masks(own)
            for k in range(len(hits)):
                hits[k] += np.count_nonzero(masks[:, k // 64] & np.uint64(1 << (k % 64)))
        return np.clip((hits / total - self.false) / (1 - self.false), 0, 1) if total else None

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the largest share (the first in alphabetical order among equals) and that share; ``und`` for a
        text without letters."""
        own = self.shares(text) if self.languages else None
        if own is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(own))
        return self.languages[best], float(own[best])


def _learned(lang_col: str, id_col: str) -> Column:
    """Whether a row has a language and isn't held out."""
    return F.col(f"`{lang_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`").cast("long"))


def _merge(counted: dict[str, tuple[np.ndarray, np.ndarray]], more: dict[str, list[np.ndarray]]) -> None:
    """Count the n-grams of ``more`` into ``counted``: sorted hashes and how often each occurs, by language."""
    for k, own in more.items():
        h, n = np.unique(np.concatenate(own), return_counts=True)
        if k in counted:
            h, n = np.concatenate([counted[k][0], h]), np.concatenate([counted[k][1], n])
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            h, n = h[first], np.add.reduceat(n, first) if len(first) else n
        counted[k] = h, n


def _counts(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """How often each language has each n-gram: l, h, n."""
    for k, (h, n) in counted.items():
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, pa.string()), len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["l", "h", "n"])


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Filters:
    """Learn from all texts with a language that aren't held out.

    A language keeps its GRAMS most frequent n-grams that occur LEAST times and at least RELATIVE as often as in the
    language where they are most frequent. The driver gets those hashes only: so many for each language.
    """
    rows = docs.where(_learned(lang_col, id_col)).select(F.col(f"`{lang_col}`").cast("string").alias("l"), F.col(f"`{text_col}`").cast("string").alias("t"))
    languages = sorted(r.l for r in rows.select("l").distinct().collect())  # a row a language
    if not languages:
        return Filters([], [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        new: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in few(batches, ROWS):
            for k, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                for own in grams(text):
                    new.setdefault(k, []).append(own)
                    held += len(own)
                    if held > HELD:
                        _merge(counted, new)
                        new, held = {}, 0
                        if sum(len(h) for h, _ in counted.values()) > HELD // 2:
                            yield from _counts(counted)
                            counted = {}
        _merge(counted, new)
        yield from _counts(counted)

    counted = stored(rows.mapInArrow(tidy(count), "l string, h long, n long").groupBy("l", "h").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("l").agg(F.sum("n").alias("total"))  # a row a language
    rates = counted.join(F.broadcast(totals), "l").withColumn("rate", F.col("n") / F.col("total"))
    frequent = rates.withColumn("top", F.max("rate").over(Window.partitionBy("h"))).where(F.col("n") >= LEAST).where(F.col("rate") >= RELATIVE * F.col("top"))
    best = frequent.select("l", "h", "n", F.pmod("h", F.lit(PARTS)).alias("part"))
    for keys in (["l", "part"], ["l"]):  # what isn't among the best of its part isn't among the best
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "h"))).where(F.col("nth") <= GRAMS)
    members: dict[str, list[int]] = {k: [] for k in languages}
    for r in best.select("l", "h").collect():  # GRAMS rows a language
        members[r.l].append(r.h)
    return Filters(languages, [np.array(sorted(members[k]), np.int64).view(np.uint64) for k in languages])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1: the corrected share) of each text.

    Defined cases: ``und`` and 0 for a null text and one without a letter, and for all texts if no language was
    learned; repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, ROWS):
            found = [filters.predict(x) for x in batch[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    ident = F.col(f"`{id_col}`").cast("long")
    return docs.select(ident.alias("d"), held_out(ident).alias("h"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def judge(docs: DataFrame, filters: Filters, lang_col: str | None = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a working column for ``cuts`` and ``keep_known``: the language and score of the text,
    and its score in the language that the row names. Store it where both are wanted, so that texts are scored once."""
    places = {k: n for n, k in enumerate(filters.languages)}

    def one(text: str | None, lang: str | None) -> dict:
        own = filters.shares(text) if filters.languages else None
        if own is None:
            return {"lang": UNKNOWN, "score": 0.0, "own": None}
        best = int(np.argmax(own))
        return {"lang": filters.languages[best], "score": float(own[best]), "own": float(own[places[lang]]) if lang in places else None}

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("own", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double,own:double>")
    def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
        found = [one(t, k) for a in range(0, len(texts), ROWS) for t, k in zip(texts.slice(a, ROWS).to_pylist(), langs.slice(a, ROWS).to_pylist(), strict=True)]
        release()
        return pa.array(found, kind)

    lang = F.lit(None) if lang_col is None else F.col(f"`{lang_col}`")
    return docs.withColumn(JUDGED, run(F.col(f"`{text_col}`").cast("string"), lang.cast("string")))


def cuts(docs: DataFrame, filters: Filters, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """For each language, the score below which a text isn't taken to be in it: PART of what all but LOWEST of the texts
    that were learned from reach in their own language, in steps of 1 / STEPS, and at least FLOOR. The driver gets a row
    a language."""
    if not filters.languages:
        return {}
    rows = docs.where(_learned(lang_col, id_col))
    own = rows if JUDGED in docs.columns else judge(rows, filters, lang_col, text_col)
    steps = own.select(F.col(f"`{lang_col}`").cast("string").alias("l"), F.floor(F.col(JUDGED)["own"] * STEPS).alias("v"))
    # exact, as a language has STEPS + 1 values at most, which are counted
    low = steps.groupBy("l").agg(F.expr(f"percentile_disc({LOWEST}) WITHIN GROUP (ORDER BY v)").alias("low"))
    found = {r.l: max(FLOOR, PART * (r.low or 0) / STEPS) for r in low.collect()}
    return {k: found.get(k, FLOOR) for k in filters.languages} if found else {}


def keep_known(docs: DataFrame, filters: Filters, least: float | dict[str, float] = FLOOR, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a known language with a score of ``least`` or more, with all columns.

    ``least``: one number, or a number a language (``cuts``; FLOOR for others). Null texts and texts without letters go. If no language
    was learned, all rows stay.
    """
    if not filters.languages:
        return docs.drop(JUDGED)
    lowest = dict.fromkeys(filters.languages, FLOOR) | least if isinstance(least, dict) else dict.fromkeys(filters.languages, least)
    own = F.col(JUDGED)
    enough = own["score"] >= F.create_map(*[F.lit(x) for k, v in lowest.items() for x in (k, float(v))])[own["lang"]]
    rows = docs if JUDGED in docs.columns else judge(docs, filters, None, text_col)
    return rows.where(own["lang"] != UNKNOWN).where(enough).drop(JUDGED)
