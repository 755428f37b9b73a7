"""The registered queries of this package: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, common, decontam, html_density, matroska, neardup, packing, quality, sharding, sort_means, suffix_dedup, toxicity, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), TOKENIZER)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_density.extract_pages(common.table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(common.table(spark, sf_dir, "documents"), 4)


def _judged(docs: DataFrame, threshold: float) -> DataFrame:
    """The columns of op5 and op10 from a table with a score."""
    return docs.select("doc_id", F.coalesce(~common.training_row("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return _judged(quality.score(docs.select("doc_id", "text"), model), quality.THRESHOLD)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.scan(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(common.table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(common.table(spark, sf_dir, "documents"), 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs.select("doc_id", "text"), net), toxicity.THRESHOLD)


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _, _ = sort_means.cluster(common.table(spark, sf_dir, "embeddings"))
    return got.drop("v")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(common.table(spark, sf_dir, "documents"), TOKENIZER))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_bpe, op3_html_text, op4_minhash, op5_quality, op6_suffix_array, op7_matroska, op8_decontamination, op9_sharding, op10_toxicity, op11_sort_means, op12_packing, op13_collocations)}


def _sort_means_sql(rounds: int = 5) -> str:
    """One step for each round; components are lists, and all numbers are integers."""
    square = "cast(list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j]))) as bigint)"
    steps = ["""
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
v as materialized (select row_number() over (order by vec_id, v) id, vec_id, v from e),
c0 as materialized (select row_number() over (order by h, v) - 1 c, v w from (select v, sha256('2:' || coalesce(cast(vec_id as varchar), 'null')) h from v order by h, v limit 40))"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select id, min_by(c, d * 64 + c) c, min(d) d from (select id, c, {square} d from v, c{i}) group by id)")
        if i < rounds:
            steps.append(f"m{i} as (select c, list(s order by j) w from (select c, j, sum(v[j]) // count(*) - case when sum(v[j]) % count(*) < 0 then 1 else 0 end s from v join a{i} using (id), range(1, 65) t(j) group by c, j) group by c)")
            steps.append(f"c{i + 1} as materialized (select c, coalesce(m{i}.w, c{i}.w) w from c{i} left join m{i} using (c))")
    last = f"""
select vec_id, cast(c as integer) as cluster, d distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(w, ',')) centroid_sha256
from v join a{rounds} using (id) join c{rounds} using (c)"""
    return ",\n".join(steps) + last


ORACLE: dict[str, str] = {
    "op11_sort_means": _sort_means_sql(),
    "op13_collocations": r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) t from d),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') w from p),
g as materialized (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) a
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, range(1, 6) t(k) where len(w) >= k) group by all),
s as (select lang, sum(a) n from g where k = 1 group by lang),
f as materialized (select * from g where a >= 100),
c as (select lang, phrase, a, string_split(phrase, ' ') w, k, unnest(range(1, k)) cut from f where k >= 2),
q as (select c.lang, c.phrase, c.a, cut, x.a l, y.a r, s.n, cast(1000 as hugeint) * c.a * s.n // (cast(x.a as hugeint) * y.a) score
  from c join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(w[cut + 1:], ' ') join s on s.lang = c.lang),
b as (select * from q qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select lang, k, a, unnest(range(2, k)) m, string_split(phrase, ' ') w from f where k >= 3),
i as (select distinct lang, array_to_string(w[j:j + m - 1], ' ') phrase, a from (select *, unnest(range(1, k - m + 2)) j from o)),
z as (select * from b where not exists (select 1 from i where i.lang = b.lang and i.phrase = b.phrase and 100 * i.a >= 100 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score
from z qualify rank <= 2000""",
    "op1_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, cast(octet_length(encode(h)) as bigint) payload_bytes, sha1(h) payload_digest from p),
m as (select payload_digest, max(page_id) first from d where payload_bytes >= 1000 group by all having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end record_type,
  case when page_id <> first then first end refers_to
from d left join m using (payload_digest)""",
    "op4_minhash": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
f as (select g, count(*) c from s group by g having count(*) > 1),
p as (select a.doc_id x, b.doc_id y, count(*) i from s a join f using (g) join s b using (g) where a.doc_id < b.doc_id group by all),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 80 * (nx.n + ny.n - i)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id x, doc_id y from documents union select r.x, e.y from r join e on e.x = r.y)
select doc_id, coalesce(any_value(n), 0) n_shingles, least(doc_id, min(r.y)) component_id, doc_id = min(r.y) kept
from documents left join n using (doc_id) join r on r.x = doc_id group by doc_id""",
    "op8_decontamination": r"""
with words as (
  select 'd' kind, cast(doc_id as varchar) id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all
  select 'b', cast(item_id as varchar), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
items as (select id, len(w) n, least(13, len(w)) k, w from words where kind = 'b' and len(w) > 0),
wins as (select distinct id, k, array_to_string(w[i:i + k - 1], ' ') g from (select *, unnest(range(1, n - k + 2)) i from items)),
docs as (select id, len(w) n, w from words where kind = 'd'),
found as (
  select d.id, d.i, d.k, x.id item
  from (select id, k, i, array_to_string(w[i:i + k - 1], ' ') g
        from (select id, k, w, unnest(range(1, n - k + 2)) i from docs, (select distinct k from items) where n >= k)) d
  join wins x on x.k = d.k and x.g = d.g),
hit as (select id, count(distinct p) n_hit from (select id, unnest(range(i, i + k)) p from found) group by id),
its as (select id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) list from found group by id)
select cast(d.id as bigint) doc_id, cast(d.n as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(list, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= d.n contaminated
from docs d left join hit using (id) left join its using (id)""",
}
