"""Line dedup: an exact set-similarity join over the lines of all documents.

A line is the set of its lower-case words. It is removed when an earlier line (by doc_id, then line number) has a Jaccard
similarity of at least ``SIMILAR``. Lines without words are kept.

Equal sets are collapsed first, to the earliest line that holds them. Words are ordered by rarity (counts in a hash table of fixed
size, ties by hash). Two similar sets share a word among the first ``n - ceil(SIMILAR * n) + 1`` of each, so only those words
are shuffled. In a word's group, sets meet under a length filter, a positional filter (what follows the shared word in both
orders can make up the overlap needed) and a 128-bit signature of the ``SIGNED`` rarest words, which bounds the overlap from
above. Candidates' lines are read again, and only theirs: a bit table of fixed size tells most other lines apart before
anything is shuffled. Their words, hashed to 15 bits, bound the overlap again; what is left is verified on the words themselves, a
set's best candidate first and the others only where that one fails.

A word with more than ``HOT`` sets is worked in two steps, neither of which puts it into one task: first its sets meet its
earliest one, often the text that the others were copied from, and each other in chunks of about ``CHUNK``, dealt by hash; only what finds no match there or elsewhere meets the rest of the group, so many near
copies do not make all their pairs.

In the shuffles a word is the low 31 bits of its hash; that can only add candidates. Texts are shuffled for documents that may
lose lines; all others (by another bit table) stay where they are.

Only DataFrame functions are used.

Edge cases: null texts stay null and empty texts empty; rows with a null doc_id pass unchanged; rows that share a doc_id
share line numbers (a line number kept for one is kept for all); other columns pass through, whatever their names, except that
``n_lines`` and ``n_removed`` are replaced and ``n_chars``, if there, is counted anew; an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, discard, free, in_table, let, saved

SIMILAR = 0.8
#: Buckets of the rarity table and of the search for hot words; bits of the candidate tables (2 MB as longs).
BUCKETS, BITS = 1 << 17, 1 << 24
#: Sets of a word beyond which it is hot; sets of a hot word that meet in the first step.
HOT, CHUNK = 1_024, 16
#: Sets of a hot word that one task compares with open ones in the second step.
TILE = 4_096
#: Words of a signature: about two thirds of its 128 bits.
SIGNED = 88
KEY = 0x7FFFFFFF


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _plain(s: Column) -> Column:
    """Lower case, other white space as blanks: splitting at one plain blank is much cheaper than at a pattern."""
    return F.lower(F.when(s.rlike(r"[\t-\r]"), F.regexp_replace(s, r"[\t-\r]", " ")).otherwise(s))


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, line, s) of the lines that have words."""
    d = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "s"))
    return d.where(F.col("s").rlike(r"[^ \t-\r]"))


def _words(s: Column) -> Column:
    """The distinct word hashes of a line."""
    return F.array_remove(F.array_distinct(F.transform(F.split(_plain(s), " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _split(s: Column) -> Column:
    """The distinct words of a line."""
    return F.array_remove(F.array_distinct(F.split(_plain(s), " ")), "")


def _rarity(docs: DataFrame, text: str) -> bytes:
    """For each bucket, a number up to 127 that grows with the count of its words in all texts (quarters of a power of two).

    Words are told apart at blanks and line ends here; it is an order of words, and any order gives the same result.
    """
    words = docs.select(F.explode(F.split(F.lower(F.replace(F.col(text), F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    table = bytearray(BUCKETS)
    for r in words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count().collect():  # BUCKETS rows at most
        table[r["b"]] = min(127, round(4 * math.log2(1 + r["count"])))
    return bytes(table)


def _with_sets(lines: DataFrame, rarity: bytes) -> DataFrame:
    """doc, line, n, both halves of the signature, class hash, keys of the first words by rarity."""
    table = F.lit(rarity)

    def ranked(w: Column) -> Column:
        rank = F.ascii(F.substr(table, w.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1, F.lit(1)).cast("string")).cast("long")
        return F.call_function("shiftleft", rank, F.lit(56)).bitwiseOR(w.bitwiseAND(F.lit((1 << 56) - 1)))

    d = lines.select("doc", "line", F.sort_array(F.transform(_words(F.col("s")), ranked)).alias("o")).withColumn("n", F.size("o"))
    signed = F.slice("o", F.lit(1), F.lit(SIGNED))
    half = lambda h: F.aggregate(signed, F.lit(0).cast("long"), lambda a, w: F.when(F.getbit(w, F.lit(46)) == h, a.bitwiseOR(_bit(F.call_function("shiftright", w, F.lit(40))))).otherwise(a))
    first = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9).cast("int") + 1)
    return d.select("doc", "line", "n", half(0).alias("low"), half(1).alias("high"), F.xxhash64("o").alias("c"), F.transform(first, lambda w: w.bitwiseAND(F.lit(KEY)).cast("int")).alias("first"))


def _needed(n: Column, m: Column) -> Column:
    """The overlap that SIMILAR asks of two sets."""
    return F.ceil((n + m) * (SIMILAR / (1 + SIMILAR)) - 1e-9)


def _before(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc") < F.col(f"{b}.doc")) | ((F.col(f"{a}.doc") == F.col(f"{b}.doc")) & (F.col(f"{a}.line") < F.col(f"{b}.line")))


def _may_match() -> Column:
    """Length, positional and signature filters on rows a and b of one word."""
    n, m = F.col("a.n"), F.col("b.n")
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}.{h}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{h}")))) for h in ("low", "high")), F.lit(0))
    need = _needed(n, m)
    length = (m >= n * SIMILAR - 1e-9) & (n >= m * SIMILAR - 1e-9)
    places = F.least(n - F.col("a.i"), m - F.col("b.i")) >= need
    k, j = F.least(n, F.lit(SIGNED)), F.least(m, F.lit(SIGNED))
    over = F.least(k - only("a", "b"), j - only("b", "a"))
    # Words shared beyond the signed ones lie beyond them in one of the sets at least.
    return length & places & (over + F.greatest(n - k, m - j) >= need)


def _couples(both: DataFrame) -> DataFrame:
    """(doc, line, of, of_line, shared) of candidates; ``shared`` counts the words under which they met."""
    pairs = both.select("a.doc", "a.line", F.col("b.doc").alias("of"), F.col("b.line").alias("of_line"))
    return pairs.groupBy("doc", "line", "of", "of_line").agg(F.count("*").alias("shared"))


def _hot(rows: DataFrame) -> DataFrame:
    """(w, sets) of the words with more than HOT sets. Counts in buckets come first, so that rare words are not grouped."""
    bucket = F.col("w").bitwiseAND(F.lit(BUCKETS - 1))
    full = rows.groupBy(bucket.alias("b")).count().where(F.col("count") > HOT).select(F.xxhash64("b").alias("b"))
    table = bit_table(full, BUCKETS * 8)
    some = rows.where(in_table(table, F.xxhash64(bucket)))
    return saved(some.groupBy("w").agg(F.count("*").alias("sets")).where(F.col("sets") > HOT), "line-hot")


def _texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line, s) of the lines in ``pairs``, and of a few more."""
    ends = pairs.select(F.xxhash64("doc", "line").alias("h")).unionByName(pairs.select(F.xxhash64("of", "of_line").alias("h")))
    return saved(lines.where(in_table(bit_table(ends, BITS), F.xxhash64("doc", "line"))), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, line) of the pairs whose sets are similar."""
    a, b = texts.withColumnRenamed("s", "x"), texts.select(F.col("doc").alias("of"), F.col("line").alias("of_line"), F.col("s").alias("y"))
    both = pairs.join(a, ["doc", "line"]).join(b, ["of", "of_line"]).select("doc", "line", _split(F.col("x")).alias("x"), _split(F.col("y")).alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    return both.where(same >= (F.size("x") + F.size("y") - same) * SIMILAR - 1e-9).select("doc", "line").distinct()


def _near(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs that words hashed to 15 bits leave. Shared words that fall together are made up for by what each set lost so."""
    ends = pairs.select(F.xxhash64("doc", "line").alias("h")).unionByName(pairs.select(F.xxhash64("of", "of_line").alias("h")))
    d = lines.where(in_table(bit_table(ends, BITS), F.xxhash64("doc", "line"))).select("doc", "line", _split(F.col("s")).alias("x"))
    small = F.array_distinct(F.transform("x", lambda w: F.hash(w).bitwiseAND(F.lit(0x7FFF)).cast("short")))
    d = saved(d.select("doc", "line", F.size("x").alias("n"), small.alias("x")), "line-small")
    both = pairs.join(d, ["doc", "line"]).join(d.select(F.col("doc").alias("of"), F.col("line").alias("of_line"), F.col("n").alias("m"), F.col("x").alias("y")), ["of", "of_line"])
    most = F.size(F.array_intersect("x", "y")) + F.least(F.col("n") - F.size("x"), F.col("m") - F.size("y"))
    near = saved(both.where(most >= _needed(F.col("n"), F.col("m"))).select(*pairs.columns), "line-near")
    discard(d)
    return near


def _settled(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line) with a similar earlier line among ``pairs`` (doc, line, of, of_line, shared)."""
    near = _near(pairs, lines)
    best = near.groupBy("doc", "line").agg(F.max(F.struct("shared", "of", "of_line")).alias("best")).select("doc", "line", "best.of", "best.of_line")
    texts = _texts(near, lines)
    done = saved(_verified(best, texts), "line-later")
    left = saved(near.join(done, ["doc", "line"], "left_anti").join(best, ["doc", "line", "of", "of_line"], "left_anti").select("doc", "line", "of", "of_line"), "line-pairs")
    if not left.isEmpty():
        done = done.unionByName(saved(_verified(left, texts), "line-later"))
    discard(near, texts, left)
    return done


def matched(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(firsts, later): the first line of each set as (doc, line), and those of them that match an earlier line."""
    lines = _lines(docs, text, key)
    sets = _with_sets(lines, _rarity(docs, text))
    classes = sets.groupBy("c", "n", "low", "high").agg(F.min(F.struct("doc", "line")).alias("at"), F.first("first").alias("first"))
    classes = saved(classes.select("at.doc", "at.line", "n", "low", "high", "first"), "line-sets")
    # Sets of up to three words have only equal sets as partners.
    rows = classes.where(F.col("n") > 3).select("doc", "line", "n", "low", "high", F.posexplode("first").alias("i", "w"))
    hot = _hot(rows)
    crowded = not hot.isEmpty()
    cold = rows.join(hot, "w", "left_anti") if crowded else rows
    meet = (F.col("a.w") == F.col("b.w")) & _before("b", "a") & _may_match()
    pairs = _couples(cold.alias("a").join(cold.alias("b"), meet))
    if crowded:
        salt = F.pmod(F.xxhash64("w", "doc", "line"), F.ceil(F.col("sets") / CHUNK)).cast("int")
        tiles = F.ceil(F.col("sets") / TILE).cast("int")
        crowd = rows.join(hot, "w").select("doc", "line", "n", "low", "high", "i", "w", salt.alias("salt"), tiles.alias("tiles"), F.pmod(F.xxhash64("doc", "line"), tiles).cast("int").alias("tile"))
        crowd = saved(crowd, "line-crowd")
        heads = crowd.groupBy("w").agg(F.min(F.struct("doc", "line", "n", "low", "high", "i", "salt")).alias("h"), F.max("salt").alias("last"))
        heads = heads.select("w", "h.*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at")).where("at <> salt").drop("salt").withColumnRenamed("at", "salt")
        partners = crowd.select(*heads.columns).unionByName(heads)
        pairs = pairs.unionByName(_couples(crowd.alias("a").join(partners.alias("b"), meet & (F.col("a.salt") == F.col("b.salt")))))
        pairs = pairs.groupBy("doc", "line", "of", "of_line").agg(F.sum("shared").alias("shared"))
    pairs = saved(pairs, "line-pairs")
    later = _settled(pairs, lines)
    discard(pairs)
    if crowded:
        open_ = crowd.join(later, ["doc", "line"], "left_anti").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rest = saved(_couples(open_.alias("a").join(crowd.alias("b"), meet & (F.col("a.tile") == F.col("b.tile")))), "line-pairs")
        if not rest.isEmpty():
            later = later.unionByName(_settled(rest, lines))
        discard(rest, crowd)
    return classes.select("doc", "line"), later


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with later lines removed from the text, and ``n_lines``, ``n_removed``."""
    firsts, later = matched(docs, text, key)
    kept = firsts.join(later, ["doc", "line"], "left_anti").groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    kept = saved(kept, "line-kept")
    docs = docs.drop("n_lines", "n_removed")
    doc, own, left = free(docs, "doc", "kept_lines", "left_lines")
    lines = F.split(F.col(text), "\n")
    # Lines 0 to n - 1 are kept just where there are n of them and the last is n - 1.
    whole = (F.size("lines") == F.col("n")) & (F.element_at("lines", -1) == F.col("n") - 1)
    sizes = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), (F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).alias("n"))
    cut = sizes.join(kept, "doc", "left").where(~F.coalesce(whole, F.lit(False))).select(F.xxhash64("doc").alias("h"))
    may_lose = in_table(bit_table(cut, BITS), F.xxhash64(F.col(key))) & F.col(key).isNotNull()
    same = docs.where(~may_lose).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_removed", F.lit(0).cast("long"))
    d = docs.where(may_lose).join(kept.select(F.col("doc").alias(doc), F.col("lines").alias(own)), F.col(key) == F.col(doc), "left")
    numbers = F.coalesce(own, F.expr("cast(array() as array<int>)"))
    blank = lambda s: F.filter(F.transform(s, lambda v, i: F.when(~v.rlike(r"[^ \t-\r]"), i)), lambda i: i.isNotNull())
    stays = let(lines, lambda s: F.transform(F.array_sort(F.array_union(numbers, blank(s))), lambda i: F.element_at(s, i + 1)))
    d = d.withColumn(left, stays).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    d = d.withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size(left), F.lit(0)).cast("long")).withColumn(text, F.array_join(left, "\n"))
    out = same.unionByName(d.drop(left, own, doc))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    return out
