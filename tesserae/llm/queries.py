"""Registered queries of the training-data operators, and SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.bpe_stream import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.quality_crf import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.brown_lm import score

    return score(table(spark, sf_dir, "documents"))


@query
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("detections")


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.url_rules import judge, labelled_pages, mine

    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(labelled_pages(pages, table(spark, sf_dir, "labels"))))


@query
def op7_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.warc import archive_and_index

    # pages have no capture time; their ids stand in for seconds, within a century so that years keep four digits
    second = F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100 * 31_557_600))
    when = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(second), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    index = archive_and_index(table(spark, sf_dir, "pages"), when)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


@query
def op12_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op1_minhash_near_dedup"] = rf"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents),
 sets as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
   else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as items from w),
 n as (select doc_id, cast(len(items) as bigint) as n from sets),
 s as (select doc_id, unnest(items) as item from sets),
 links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.item = y.item and x.doc_id < y.doc_id group by all) p
   join n na on p.a = na.doc_id join n nb on p.b = nb.doc_id where 100 * c >= 75 * (na.n + nb.n - c)),
 edges as (select a, b from links union select b, a from links),
 reach(id, seen) as (select doc_id, doc_id from documents union select r.id, e.b from reach r join edges e on r.seen = e.a),
 first as (select id, min(seen) as component_id from reach group by id)
 select n.doc_id, n.n as n_shingles, component_id, n.doc_id = component_id as kept from n join first f on n.doc_id = f.id"""

ORACLES["op3_warc_index"] = """with p as (select page_id, coalesce(html, '') as html from pages),
 d as (select page_id, html, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first_id from p)
 select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   cast(((cast('0x' || substr(h, cast((i // 4) * 5 + 1 as bigint), 5) as bigint) >> cast(5 * (3 - i % 4) as bigint)) & 31) + 1 as bigint), 1)), '') as payload_digest,
   case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from d"""

ORACLES["op4_pivot_topk"] = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
 select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""


def _codebook_round(n: int) -> str:
    """SQL of one round: every part's nearest entry and its distance as d * 64 + e, and the entries' means."""
    means = ", ".join(f"cast(floor(sum(c[{k}])::double / count(*)) as bigint)" for k in range(1, 5))
    return f"""a{n} as (select r, p, min(({_SQUARES}) * 64 + e) as m from x join b{n} using (p) group by r, p),
 b{n + 1} as (select b.p, b.e, coalesce(s.c, b.b) as b from b{n} b left join (select p, m % 64 as e, [{means}] as c from a{n} join x using (r, p) group by p, m % 64) s using (p, e))"""


_SQUARES = " + ".join(f"(c[{k}] - b[{k}]) * (c[{k}] - b[{k}])" for k in range(1, 5))

ORACLES["op11_vector_codes"] = f"""with v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
   where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 n as (select row_number() over (order by vec_id nulls last, v) as r, * from v),
 x as (select r, p, v[4 * p + 1:4 * p + 4] as c from n, (select unnest(range(16)) as p)),
 b0 as (select p, r - 1 as e, c as b from x where r <= 64),
 {_codebook_round(0)},
 {_codebook_round(1)},
 a2 as (select r, p, min(({_SQUARES}) * 64 + e) as m from x join b2 using (p) group by r, p),
 coded as (select r, string_agg(lpad(lower(to_hex(m % 64)), 2, '0'), '' order by p) as code, cast(sum(m // 64) as bigint) as error from a2 group by r),
 books as (select sha256(string_agg(array_to_string(cast(b as varchar[]), ','), ',' order by p, e)) as codebooks_sha256 from b2)
 select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from n join coded using (r), books"""

#: CRC-32 of a text by its polynomial: eight steps a byte, over the text's bytes in hexadecimal.
_CRC_STEP = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
_CRC_TABLE = "range(256)"
for _ in range(8):
    _CRC_TABLE = f"list_transform({_CRC_TABLE}, lambda c: {_CRC_STEP})"

ORACLES["op12_minimax_shards"] = f"""with recursive d as (select doc_id, text, coalesce(strlen(text), 0) + 1 as size, coalesce(sha256(text), '') as digest from documents),
 crc as (select {_CRC_TABLE} as t),
 sums as (select digest, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(any_value(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint))),
   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from d, crc group by digest, t),
 f as (select digest, min(doc_id) as first_id, sum(size) as bytes from d group by digest),
 g as (select digest, cast(sum(bytes) over (order by first_id nulls last, digest) - bytes as bigint) as b, bytes from f),
 k as (select cast(sum(bytes) as bigint) as total, cast(max(bytes) as bigint) as largest from f),
 bounds as (select b from g union all select total from k),
 search(low, high, c, r, n) as (
   select greatest((total + 7) // 8, largest), (total + 7) // 8 + largest, (greatest((total + 7) // 8, largest) + (total + 7) // 8 + largest) // 2, 0::bigint, 0 from k
   union all
   select low2, high2, case when low2 = low and high2 = high then c else (low2 + high2) // 2 end, case when low2 = low and high2 = high then reach else 0 end, case when low2 = low and high2 = high then n + 1 else 0 end
   from (select *, case when n = 8 and r < total then c + 1 else low end as low2, case when n = 8 and r >= total then c else high end as high2
     from (select s.*, k.total, (select max(b) from bounds where b <= s.r + s.c) as reach from search s, k where s.low < s.high))),
 cap as (select low as capacity from search where low >= high),
 least(i, b) as (select 0, total from k union all select i + 1, (select min(bounds.b) from bounds where bounds.b >= least.b - capacity) from least, cap where i < 7),
 cuts(left_, now) as (select 8, 0::bigint union all
   select left_ - 1, least(reach, greatest(lowest, case when now < below and share - below <= above - share then below else above end)) from (
     select c.*, (select max(b) from bounds where b <= c.share) as below, coalesce((select min(b) from bounds where b > c.share), c.total) as above,
       (select max(b) from bounds where b <= c.now + c.capacity) as reach, (select b from least where i = c.left_ - 1) as lowest
     from (select cuts.*, total, capacity, now + (total - now + left_ - 1) // left_ as share from cuts, k, cap where left_ > 1) c)),
 placed as (select digest, b, cast((select count(*) from cuts where left_ < 8 and now <= b) as int) as shard from g)
 select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by b, doc_id nulls last) - 1 as slot, cast(null as int) as grown_shard
 from d join sums using (digest) join placed using (digest)"""
