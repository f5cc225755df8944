"""The registered queries of the operators of this subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .codes import compress, with_label_error
from .decontamination import find_contamination
from .jaccard import near_duplicate_components
from .labelled import remainder
from .licenses import BLANK, CUE, TEMPLATES, document_paths, scan_licenses
from .mixing import mix
from .pii import find_personal_data
from .revisits import captures, resolve_revisits
from .secrets import find_secrets
from .sharding import shard
from .topk import scaled_vectors, top_k
from .trie import conversation_trie


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(_read(spark, sf_dir, "pages")))
    line = lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), line), "\n")
    return found.select("record_id", "url", "ts", "response_id", "check", "resolved", headers.alias("headers"), "digest", "bytes")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    items = F.sha2(F.concat_ws(",", "items"), 256)
    found = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled_vectors(_read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"), document_paths())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels"), toxicity.learnable()))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "neighbours")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_read(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score_texts(docs, quality.fit(docs, _read(spark, sf_dir, "labels"), quality.learnable()))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(_read(spark, sf_dir, "documents"))


def op10_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard(_read(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.filter(base, lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(_read(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_warc_revisits,
        op3_benchmark_decontamination,
        op4_exact_top_k,
        op5_license_scan,
        op6_toxicity,
        op7_secret_scan,
        op8_quality_classifier,
        op9_ngram_jaccard_join,
        op10_vector_bin_packing,
        op11_personal_data,
        op12_vector_code_compression,
        op13_conversation_prefix_trie,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_MIXING = rf"""
with rows as (select doc_id id, coalesce(source, '') name, source is null is_null, len(regexp_extract_all(coalesce(text, ''), {_SPACED})) size,
  cast('0x' || substr(md5('20250101:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) h from documents),
totals as (select name, is_null, sum(size)::bigint s, (row_number() over (order by is_null, name) - 1) place from rows group by 1, 2),
weights as (select *, cast(place % 3 + 1 as double) w, s * 3e0 cap from totals),
ratios as (select *, cap / w ratio from weights),
levels as (select *, (sum(s) over () - coalesce(sum(cap) over before, 0e0)) / (sum(w) over () - coalesce(sum(w) over before, 0e0)) level
  from ratios window before as (order by ratio, name, is_null rows between unbounded preceding and 1 preceding)),
targets as (select name, is_null, place, w, s, least(cap, coalesce((select arg_min(level, ratio) from levels where ratio > level) * w, cap)) target from levels),
ordered as (select *, coalesce(sum(size) over (partition by name, is_null order by h, id, size rows between unbounded preceding and 1 preceding), 0)::bigint before from rows),
cut as (select *, case when s > 0 then floor(target / s) else 0 end whole from ordered join targets using (name, is_null)),
m0 as (select *, target - whole * s rest, before + size <= target - whole * s and size > 0 more from cut),
l0 as (select name, is_null, any_value(rest) - coalesce(sum(size) filter (more), 0) missing from m0 group by 1, 2),
f0 as (select name, is_null, h, before, size, missing, coalesce(sum(size) over (partition by name, is_null order by h, before rows between unbounded preceding and 1 preceding), 0) t from m0 join l0 using (name, is_null) where not more and size > 0 and size <= missing),
m1 as (select m0.* replace (m0.more or f0.h is not null as more) from m0 left join f0 on m0.name = f0.name and m0.is_null = f0.is_null and m0.h = f0.h and m0.before = f0.before and m0.size = f0.size and f0.t + f0.size <= f0.missing),
l1 as (select name, is_null, any_value(rest) - coalesce(sum(size) filter (more), 0) missing from m1 group by 1, 2),
f1 as (select name, is_null, h, before, size, missing, coalesce(sum(size) over (partition by name, is_null order by h, before rows between unbounded preceding and 1 preceding), 0) t from m1 join l1 using (name, is_null) where not more and size > 0 and size <= missing),
m2 as (select m1.* replace (m1.more or f1.h is not null as more) from m1 left join f1 on m1.name = f1.name and m1.is_null = f1.is_null and m1.h = f1.h and m1.before = f1.before and m1.size = f1.size and f1.t + f1.size <= f1.missing),
l2 as (select name, is_null, any_value(rest) - coalesce(sum(size) filter (more), 0) missing from m2 group by 1, 2),
fit as (select name, is_null, any_value(missing) missing, min(abs(size - missing)) filter (abs(size - missing) < missing) gap, arg_min(before, (abs(size - missing), size, before)) filter (abs(size - missing) < missing) fit,
  arg_min(before, (size, before)) filter (size > missing) cut from m2 join l2 using (name, is_null) where not more and size > 0 group by 1, 2),
near as (select m2.*, fit, cut, missing, coalesce(coalesce(gap, missing) > target * 0.005e0, false) and cut is not null far,
  case when place % 2 = 0 then w * 1.5e0 else w * 0.5e0 end w0, case when place % 2 = 0 then w * 0.5e0 else w * 1.5e0 end w1 from m2 left join fit using (name, is_null)),
taken as (select *, cast(whole as bigint) + case when more or coalesce(before = fit and size > 0 and not far, false) then 1 else 0 end copies,
  case when far and not more and size > 0 and before = cut then floor(missing)::bigint else 0 end part from near),
extras as (select *, case when copies > whole then size else part end extra from taken),
summed as (select *, whole * s + sum(extra) over (partition by name, is_null) every,
  coalesce(sum(extra) over (partition by name, is_null order by h, id, size rows between unbounded preceding and 1 preceding), 0)::bigint extra_before from extras),
placed as (select *, least((case when whole > 0 then before + size / 2e0 else extra_before + extra / 2e0 end) / nullif(every, 0e0) * ((w0 + w1) / 2), (w0 + w1) / 2) goal from summed)
select id doc_id, size::bigint size, s source_size, target, (size * copies + part)::bigint taken,
  case when copies + part > 0 and size > 0 then round(case when goal <= 0 then 0e0 else goal * 2 / (w0 + sqrt(greatest(w0 * w0 + (w1 - w0) * goal * 2, 0e0))) end, 9) end as position from placed
"""

_REVISITS = r"""
with c as (select page_id, url, md5(html) digest, strlen(html)::bigint bytes, instr('0123456789abcdef', substr(md5(url), 1, 1)) % 4 pick,
  to_timestamp(1704067200 + page_id * 60) at time zone 'UTC' t1, to_timestamp(1704067200 + page_id * 60 - page_id % 1000 * 3600) at time zone 'UTC' lm,
  to_timestamp(1704067200 + page_id * 60 + case when page_id % 11 = 0 then -7200 else (page_id % 7 + 1) * 3600 end) at time zone 'UTC' t2,
  case when page_id % 2 = 0 then regexp_replace(url, '^https?://', 'HTTPS://www.') else url || '#again' end again from pages),
rec as (select page_id * 2 record_id, 'response' kind, url, t1 ts, '"' || digest || '"' etag, strftime(lm, '%Y-%m-%d %H:%M:%S') modified, strftime(t1, '%Y-%m-%d %H:%M:%S') "date", null cache, digest, bytes from c
  union all select page_id * 2 + 1, 'revisit', again, t2, case pick when 0 then 'W/"' || digest || '"' when 2 then '"' || md5(url) || '"' end, case when pick = 1 then strftime(lm, '%Y-%m-%d %H:%M:%S') end, strftime(t2, '%Y-%m-%d %H:%M:%S'), case when page_id % 3 = 0 then 'max-age=60' end, null, null from c),
r as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') rest from rec),
k as (select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\??(.*)$', 1), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))), '&'), ''), '') key from r),
j as (select v.record_id, arg_max(f.record_id, (f.ts, f.record_id)) rid from (select * from k where kind = 'revisit') v left join (select * from k where kind = 'response') f on f.key = v.key and f.ts < v.ts group by 1),
m as (select v.record_id, v.url, v.ts, j.rid response_id, v.etag ve, v.modified vm, v.cache vc, v."date" vd, f.etag fe, f.modified fm, f.digest, f.bytes,
  case when j.rid is null then 'no response' when f.etag is not null and v.etag is not null then case when replace(v.etag, 'W/', '') = f.etag then 'etag' else 'mismatch' end
  when f.modified is not null and v.modified is not null then case when f.modified = v.modified then 'last-modified' else 'mismatch' end else 'unchecked' end "check" from k v join j using (record_id) left join k f on f.record_id = j.rid)
select record_id, url, ts, response_id, "check", "check" in ('etag', 'last-modified') resolved,
  case when "check" in ('etag', 'last-modified') then coalesce('cache-control: ' || vc || chr(10), '') || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || vd || chr(10) || 'etag: ' || coalesce(ve, fe) || chr(10) || 'last-modified: ' || fm end headers,
  case when "check" in ('etag', 'last-modified') then digest end digest, case when "check" in ('etag', 'last-modified') then bytes end bytes from m
"""

_LEAKS = rf"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from documents),
i as (select cast(item_id as varchar) item, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') w from benchmark),
win as (select distinct item, l, array_to_string(w[k:k + l - 1], ' ') t from (select item, w, least(len(w), 10) l, unnest(range(1, len(w) - least(len(w), 10) + 2)) k from i where len(w) > 0)),
dw as (select rid, l, k, array_to_string(w[k:k + l - 1], ' ') t from (select rid, w, l, unnest(range(1, len(w) - l + 2)) k from d, (select distinct l from win) where len(w) >= l)),
hits as (select rid, l, k, item from dw join win using (l, t)),
words as (select rid, count(distinct p) n_hit from (select rid, unnest(range(k, k + l)) p from hits) group by 1),
found as (select rid, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids from hits group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (rid) left join found using (rid)
"""

_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

_LICENSES = rf"""
with named_(licence, text) as (values {", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)}),
t as (select * from named_ union all select licence, 'SPDX-License-Identifier: ' || licence || suffix from (select distinct licence from named_), (values (''), ('-only'), ('-or-later')) s(suffix)),
p as (select doc_id, coalesce(text, '') text, coalesce(source, 'unknown') src, '/part-' || (doc_id // 1000) part, '/set-' || (doc_id % 1000 // 50) grp from documents),
d as (select doc_id, text, case when doc_id % 15 = 0 then src || part || '/LICENSE' when doc_id % 15 = 5 then src || part || grp || '/LICENSE' when doc_id % 5 = 0 then src || '/LICENSE' else src || part || grp || '/doc-' || doc_id || '.txt' end path from p),
e as (select *, regexp_replace(path, '/[^/]*$', '') folder, doc_id % 5 = 0 named, list_distinct(list_filter(list_concat(regexp_split_to_array(text, '{BLANK}'), string_split(text, chr(10))), lambda x: regexp_matches(x, '{CUE}'))) lines from d),
u as (select * from (select doc_id, unnest(range(0, len(lines) + 1)) line, unnest(list_concat([case when named then text end], lines)) text from e where regexp_matches(text, '{CUE}') or named) where text is not null),
tf as (select doc_id, line, term, count(*) tf from (select doc_id, line, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[a-z0-9]+)*')) term from u) group by 1, 2, 3),
n as (select count(*) n from (select distinct doc_id, line from tf)), df as (select term, count(*) df from tf group by 1),
w as (select doc_id, line, term, tf * (ln((1e0 + n) / (1e0 + df)) + 1) w from tf join df using (term), n),
norm as (select doc_id, line, sqrt(sum(w * w)) norm from w group by 1, 2),
tt as (select k, licence, term, count(*) tf from (select k, licence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[a-z0-9]+)*')) term from (select row_number() over () k, * from t)) group by 1, 2, 3),
tw as (select k, licence, term, tf * (ln((1e0 + n) / (1e0 + coalesce(df, 0))) + 1) tw from tt left join df using (term), n),
tn as (select k, sqrt(sum(tw * tw)) l from tw group by 1),
dots as (select doc_id, line, k, licence, sum(w * (tw / l)) dot from w join tw using (term) join tn using (k) group by 1, 2, 3, 4),
cos as (select doc_id, line, licence, round(dot / norm, 6) cosine from dots join norm using (doc_id, line)),
best as (select doc_id, line, arg_min(licence, (-cosine, licence)) licence, max(cosine) cosine from cos group by 1, 2),
f as (select doc_id, arg_min(licence, (-cosine, line = 0, licence)) licence, max(cosine) cosine, arg_min(line = 0, (-cosine, line = 0, licence)) file from best where cosine >= 0.6 group by 1),
g as (select e.*, licence, cosine, case when file then 'file' when not file then 'header' end origin from e left join f using (doc_id)),
held as (select folder above, arg_min(licence, (-cosine, path, licence)) near, max(cosine) near_cosine from g where named and licence is not null group by 1),
up as (select distinct folder, unnest(range(0, len(string_split(folder, '/')) + 1)) depth from g),
nearest as (select folder, arg_max(near, depth) near, arg_max(near_cosine, depth) near_cosine from up join held on above = array_to_string(string_split(folder, '/')[1:depth], '/') group by 1)
select doc_id, path, coalesce(licence, near) licence, coalesce(cosine, near_cosine) cosine, coalesce(origin, case when near is not null then 'inherited' end, 'none') origin from g left join nearest using (folder)
"""

_JACCARD = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 4], ' ') t from (select doc_id, w, unnest(range(1, len(w) - 3)) k from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) as (select doc_id, doc_id from d union select x, l.y from reach r join (select x z, y from links) l on r.y = l.z)
select doc_id, coalesce(any_value(n), 0)::bigint n_shingles, min(y) component_id from d join reach on x = doc_id left join n using (doc_id) group by 1
"""

_ASSIGN = "select id, p, arg_min(e, (d, e)) e, min(d) d from (select x.id, x.p, c.e, list_sum(list_transform(range(1, w + 1), lambda k: (x.v[k] - c.v[k]) ** 2))::bigint d from x join {books} c using (p), widths) group by 1, 2"
_UPDATE = "select p, c.e, coalesce(m.v, c.v) v from {books} c left join (select p, e, list(s // n - case when s % n < 0 then 1 else 0 end order by k) v from (select p, e, k, sum(v[k])::bigint s, count(*) n from x join {codes} using (id, p), (select unnest(range(1, w + 1)) k from widths) group by 1, 2, 3) group by 1, 2) m using (p, e)"

_CODES = f"""
with kept as (select vec_id id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
widths as (select max(len(v)) // 16 w from kept), x as (select id, p, v[p * w + 1:p * w + w] v from kept, widths, (select unnest(range(16)) p)),
b0 as (select p, e, v from x join (select id, row_number() over (order by id) - 1 e from (select id from kept order by id limit 64)) using (id)),
c0 as materialized ({_ASSIGN.format(books='b0')}), b1 as materialized ({_UPDATE.format(books='b0', codes='c0')}),
c1 as materialized ({_ASSIGN.format(books='b1')}), b2 as materialized ({_UPDATE.format(books='b1', codes='c1')}),
c2 as materialized ({_ASSIGN.format(books='b2')}), r as (select id, string_agg(printf('%02x', e), '' order by p) code, sum(d)::bigint error from c2 group by 1)
select id vec_id, code, error, sum(error) over (partition by label)::bigint label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from b2) codebooks_sha256 from r join kept using (id)
"""

_TRIE = """
with t as (select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first) turns from conversations where conv_id is not null group by 1),
h as (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda s, b: list_reduce(list_concat([xor(s, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 h from t),
r as (select c.conv_id, list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) turns from h c left join t f on f.conv_id = c.conv_id - c.conv_id % 5),
p as (select conv_id, d, len(turns) length, md5(turns[1:d]::varchar) key, md5(turns[1:d - 1]::varchar) above, case when d > 0 then strlen(turns[d].text) else 0 end bytes from (select *, unnest(range(0, len(turns) + 1)) d from r)),
n as (select d, key, min(conv_id) conv, count(*) n, any_value(bytes) bytes, any_value(above) above, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = d), '') ends from p group by 1, 2),
k as (select x.*, (select count(*) from n y where y.d = x.d + 1 and y.above = x.key) children from n x),
s as (select a.d, a.key, count(*) filter (x.children = 0) leaves, sum((x.n - 1) * x.bytes) saved from k x join p a on a.conv_id = x.conv and a.d <= x.d group by 1, 2)
select k.conv conv_id, k.d depth, u.conv parent_conv_id, k.n n_convs, k.children n_children, leaves n_leaves, saved::bigint saved_tokens, sha256(k.ends) ends_sha256 from k join s using (d, key) left join n u on u.d = k.d - 1 and u.key = k.above
"""

#: The others have no SQL: greedy packing, nearest neighbours under learned terms, tokenizers, fitted models.
ORACLES: dict[str, str] = {
    "op1_source_mixing": _MIXING,
    "op2_warc_revisits": _REVISITS,
    "op3_benchmark_decontamination": _LEAKS,
    "op4_exact_top_k": _TOP_K,
    "op5_license_scan": _LICENSES,
    "op9_ngram_jaccard_join": _JACCARD,
    "op12_vector_code_compression": _CODES,
    "op13_conversation_prefix_trie": _TRIE,
}
