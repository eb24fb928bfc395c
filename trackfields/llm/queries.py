"""The queries of this subpackage: thin uses of its operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, collocations, fingerprints, licenses, line_dedup, mixing, ngram_join, pii, secrets, spelling, topk, toxicity
from .common import table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, range-sorted by its first training position; documents that the mix doesn't take come last."""
    d = mixing.plan(table(spark, sf_dir, "documents"))
    first, last = F.round(F.try_element_at("positions", F.lit(1)), 6), F.round(F.try_element_at("positions", F.lit(-1)), 6)
    d = d.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"), last.alias("last_position"))
    return d.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mix: a row per copy with its training position, range-sorted; documents without a copy come last, without one."""
    d = mixing.plan(table(spark, sf_dir, "documents")).select("*", F.posexplode_outer("positions").alias("copy", "position"))
    return d.orderBy(F.col("position").asc_nulls_last(), "doc_id", "copy").select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "copy", F.round("position", 6).alias("position"))


#: The plan of the mix; a schedule is linear in training progress, so its integral is inverted by the root of a square.
OP1_PLAN = r"""
with d as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as ord from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rn from d group by source),
w as (select *, case (rn - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 2 as lim, sum(source_size) over ()::bigint as total from s),
l as (select *, (1.5::double * total - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
                / (sum(weight) over (order by lim / weight, source nulls last rows between current row and unbounded following))::double as level from w),
f as (select min_by(level, lim / weight) as final from l where level * weight <= lim),
g as (select source, source_size, weight, least(lim::double, coalesce(final * weight, lim::double)) as target from l left join f on true),
r as (select d.doc_id, d.source, d.size, g.source_size, g.target, case weight when 5 then 1.5 when 2 then 1.0 else 0.5 end as a, case weight when 5 then -1.0 when 2 then 0.0 else 1.0 end as b,
             coalesce(sum(d.size) over (partition by d.source order by d.ord, d.doc_id rows between unbounded preceding and 1 preceding), 0)::double as begun,
             case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end as rounds
      from d join g on d.source is not distinct from g.source),
c as (select *, case when target > 0 then (rounds + case when target - rounds * source_size > 0 and begun + size / 2 <= target - rounds * source_size then 1 else 0 end)::int else 0 end as copies from r),
p as (select *, list_transform(range(copies), lambda k: least((begun + size / 2 + k * source_size) / target, 1.0)) as shares from c),
q as (select *, list_transform(shares, lambda y: least(2 * y / (a + sqrt(greatest(a * a + 2 * b * y, 0))), 1.0)) as positions from p)
"""
OP1_SQL = OP1_PLAN + """select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies, round(positions[1], 6) as first_position, round(positions[-1], 6) as last_position from q"""
CURRICULUM_SQL = OP1_PLAN + """, x as (select *, unnest(case when copies > 0 then range(copies) else [null] end)::int as copy from q)
select doc_id, source, size, source_size, target, copies, (size * copies)::bigint as taken, copy, round(positions[copy + 1], 6) as position from x"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = ("assign", "access", "hex")
    counts = [F.size(_of_kinds(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(_of_kinds(F.col("spans"), *kinds)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = ("email", "ip", "card", "phone")
    counts = [F.size(_of_kinds(F.col("pii"), k)).cast("long").alias(f"n_{k}") for k in kinds]
    scores = F.array_join(F.transform(F.col("pii"), lambda x: F.format_number(x["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(_joined(_of_kinds(F.col("pii"), *kinds)), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), scores.alias("scores"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    p = F.col("toxicity.score")
    held_out = F.coalesce(~toxicity.learnable(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), F.slice("toxicity.neighbours", 1, 3).alias("evidence"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_RANKS).select("doc_id", "ids")
    return byte_bpe.decode(rows, BPE_RANKS).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), byte_bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), rule=ngram_join.Rule(4, 85))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", "n_licenses", F.array_join("families", ",").alias("families"), F.round("best", 6).alias("best"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) as piece from documents where text is not null),
ws as (select lang, row_number() over () as piece, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
o as (select lang, piece, unnest(ws) as w1, generate_subscripts(ws, 1) as i from ws),
x as (select lang, w1, lead(w1) over p as w2, lead(w1, 2) over p as w3, lead(w1, 3) over p as w4 from o window p as (partition by piece order by i)),
g as (select lang, 1 as k, w1 as phrase, count(*) as a from x group by 1, 3 union all select lang, 2, w1 || ' ' || w2, count(*) from x where w2 is not null group by 1, 3
      union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from x where w3 is not null group by 1, 3 union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from x where w4 is not null group by 1, 3),
t as (select lang, sum(a)::bigint as n from g where k = 1 group by 1),
c as (select *, string_split(phrase, ' ') as w from g where k > 1 and a >= 30),
e as (select *, array_to_string(w[1:j], ' ') as first, array_to_string(w[j + 1:], ' ') as rest from c, (select unnest([1, 2, 3]) as j) where j < k),
s as (select e.lang, e.phrase, e.a, j, l.a as l, r.a as r, (2000000::hugeint * e.a // (l.a + r.a))::bigint as score from e join g l on l.lang = e.lang and l.phrase = e.first join g r on r.lang = e.lang and r.phrase = e.rest),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i as (select lang, array_to_string(w[x:x + m - 1], ' ') as phrase, max(a) as longer from c, (select unnest([1, 2, 3]) as x) xs, (select unnest([2, 3]) as m) ms where m < k and x + m - 1 <= k group by 1, 2),
f as (select b.* from b left join i using (lang, phrase) where i.longer is null or 100::hugeint * i.longer < 80::hugeint * b.a),
q as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from f qualify rank <= 2000)
select lang, rank, phrase, a, l, r, n, score from q join t using (lang)"""


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP12_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_secret_scan": op4_secret_scan,
    "op5_ann": op5_ann,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_license_scan": op10_license_scan,
    "op11_phrases": op11_phrases,
    "op12_top_k": op12_top_k,
    "op13_spelling_variants": op13_spelling_variants,
    "curriculum_mix": curriculum_mix,
}
ORACLES: dict[str, str] = {"op1_source_mixing": OP1_SQL, "op11_phrases": OP11_SQL, "op12_top_k": OP12_SQL, "curriculum_mix": CURRICULUM_SQL}
