"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last ``WINDOW`` bytes of the text; where its high ``k`` bits are zero, a chunk of block size ``2**k``
ends. Each chunk gives one character of a signature. A fingerprint is ``k:signature at k-1:at k:at k+1`` with the smallest ``k``
that leaves at most ``CHUNKS`` chunks, so two texts whose lengths differ less than fourfold have signatures at a common block size.
Likeness is one minus the insert-and-delete distance over the summed lengths, at the best block size that both hold, and
0 when the signatures share no run of characters at all that chance would not give.

Spark deals texts out by ranges of doc_id between quantiles of the ids; ids that fill a whole range by themselves are dealt on
by a hash of the text. A window finds the next document inside a range, and one small aggregate per range carries
the first document over to the range before. Nothing is collected but the range limits and sizes.

Edge cases: null and empty texts have the fingerprint ``0:::``, like it to each other by 1 and to any other text by 0; a
single document follows itself; equal doc_ids are ordered by a hash of the text, then by the text; a null doc_id comes last.
Columns other than the id and the text are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 7
CHUNKS = 64
#: Characters of a shared run below which unlike signatures of full length count as unlike.
RUN = 4
#: Rows in a range, about; how many ranges at most; parts of an id that fills a range by itself.
RANGE_ROWS, MOST_RANGES, PARTS = 512, 65_536, 64
# The 64 characters of signatures.
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
_INVERSE = pow(ODD, -1, 1 << 64)
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64; kept for texts of up to a million bytes."""
    have = _kept.get(base)
    if have is None or n > len(have):
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 1 << 20:
            _kept[base] = have
    return have[:n]


def fingerprint(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = len(raw)
    if not n:
        return "0:::"
    # Prefix sums of byte values times powers give the hash of any stretch: of the window and of chunks.
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(ODD, n), out=sums[1:])
    back = _powers(_INVERSE, n)
    rolling = sums[1:].copy()
    rolling[WINDOW:] -= sums[1 : max(1, n - WINDOW + 1)]
    rolling *= back
    rolling ^= rolling >> np.uint64(32)
    rolling *= np.uint64(0xBF58476D1CE4E5B9)
    # A chunk of block size 2**k ends where the k high bits are zero; guess k, and look lower only if need be.
    guess = max(0, (n // CHUNKS).bit_length() - 2)
    while True:
        ends = np.flatnonzero(rolling < np.uint64(1 << (64 - guess))) if guess else np.arange(n)
        if not guess or len(ends) >= CHUNKS:
            break
        guess -= 1
    hit = rolling[ends]
    k = guess
    while k < 63 and (k and np.count_nonzero(hit < np.uint64(1 << (64 - k))) or (not k) * len(hit)) >= CHUNKS:
        k += 1
    if k and k - 1 < guess:
        ends = np.flatnonzero(rolling < np.uint64(1 << (65 - k))) if k > 1 else np.arange(n)
        hit = rolling[ends]
    signs = [""] if not k else []
    for at in range(max(0, k - 1), k + 2):
        stops = ends[hit < np.uint64(1 << (64 - at))] + 1 if at else ends + 1
        if not len(stops) or stops[-1] != n:
            stops = np.append(stops, n)
        begins = np.concatenate([[0], stops[:-1]])
        chunk = _mix((sums[stops] - sums[begins]) * back[begins])
        signs.append(SIGNS[(chunk >> np.uint64(58)).astype(np.intp)].tobytes().decode())
    return f"{k}:{':'.join(signs)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _shares_run(a: str, b: str, size: int) -> bool:
    runs = {a[i : i + size] for i in range(len(a) - size + 1)}
    return any(b[i : i + size] in runs for i in range(len(b) - size + 1))


def likeness(one: str, other: str) -> float:
    """0 to 1, from the signatures at compatible block sizes."""
    if one == other:
        return 1.0
    a, b = one.split(":"), other.split(":")
    best = 0.0
    for i in range(3):
        for j in range(3):
            x, y = a[1 + i], b[1 + j]
            if int(a[0]) + i == int(b[0]) + j and x and y:
                if _shares_run(x, y, min(RUN, len(x), len(y))):
                    best = max(best, 2 * _common(x, y) / (len(x) + len(y)))
    return best


def in_order(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text, next_text) in descending doc_id; after the last document comes the first."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = min(MOST_RANGES, d.count() // RANGE_ROWS + 1)
    shares = ",".join(repr(i / (ranges + 1)) for i in range(1, ranges + 1))
    found = d.agg(F.expr(f"percentile_approx(doc_id, cast(split('{shares}', ',') as array<double>), {10 * ranges})")).head()[0]
    limits = np.array(sorted(found or []), np.int64)
    shared = spark.sparkContext.broadcast((limits, np.unique(limits[:-1][limits[1:] == limits[:-1]])))  # MOST_RANGES numbers at most

    def cell_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        limits, often = shared.value
        x = ids.fillna(0).to_numpy(np.int64)
        part = np.where(np.isin(x, often), (hashes.to_numpy(np.int64) >> 58) + PARTS // 2, 0)
        return pd.Series(np.where(ids.isna(), -PARTS, np.searchsorted(limits, x, side="left") * PARTS - part))

    d = d.withColumn("h", F.xxhash64("text"))
    d = d.withColumn("cell", F.pandas_udf(cell_of, "long")("doc_id", "h"))
    # Cells in descending order make up ranges; there are MOST_RANGES and PARTS for each frequent id at most here, whatever the input.
    ranges, held, number = [], RANGE_ROWS, -1
    for c, n in sorted(map(tuple, d.groupBy("cell").count().collect()), reverse=True):
        if held >= RANGE_ROWS:
            held, number = 0, number + 1
        held += n
        ranges.append((c, number))
    ranges = [(c, r, (r or number + 1) - 1) for c, r in ranges]
    d = d.join(F.broadcast(spark.createDataFrame(ranges, "cell long, range int, before int")), "cell").drop("cell")
    # The first document of each range also follows the last one of the range before, in a circle.
    heads = d.groupBy("range", "before").agg(F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "h")).alias("head"))
    first = (F.col("range") == F.col("r")) & (F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "h").eqNullSafe(F.col("head")))
    tops = d.join(F.broadcast(heads.select(F.col("range").alias("r"), "head")), first).groupBy("range", "before").agg(F.min("text").alias("text"))
    tops = tops.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("h"), F.col("before").alias("range"), F.lit(1).alias("extra"))
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "h", "text")
    both = d.select("doc_id", "text", "h", "range", F.lit(0).alias("extra")).unionByName(tops)
    return both.withColumn("next_text", F.lead("text").over(w)).where("extra = 0").select("doc_id", "text", "next_text")


def with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness; see ``in_order`` for the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document.
    """

    def run(batches):
        import hashlib

        known = ("", fingerprint(""))  # the next text of one row is most often the text of the following row
        for rows in batches:
            out = []
            for doc_id, text, after in zip(rows["doc_id"], rows["text"], rows["next_text"]):
                half = len(text) // 2
                edited = text[: len(text) - half] + after[:half]
                own = known[1] if known[0] == text else fingerprint(text)
                known = (after, own if after == text else fingerprint(after))
                changed = own if edited == text else fingerprint(edited)
                out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, known[1])))
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return small_batches(in_order(docs, text, key)).mapInPandas(run, schema)
