"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, license_scan, line_dedup, packing, quality, simhash, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = line_dedup.drop_boilerplate(docs, F.col("source"), count_as="n_dropped")
    return cut.select("doc_id", "n_dropped", "text", F.sha2("text", 256).alias("text_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_license_scan": op6_license_scan,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = ", ".join(
    f"('{t.label}', {str(t.base).lower()}, {k}, '{p}')" for k, (t, p) in enumerate((t, p) for t in license_scan.TEMPLATES for p in t.phrases)
)

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents
), r as (
  select doc_id, sha256(norm) text_sha256,
         first_value(doc_id) over (partition by norm order by len desc, doc_id) keep_id,
         count(*) over (partition by norm) group_size
  from n
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r""",
    "op2_chat_format": r"""
with t as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') x,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) pos
  from conversations where conv_id is not null
), c as (
  select conv_id, count(*) n, list(r || chr(31) || x order by pos) m, string_agg('<|' || r || '|>' || chr(10) || x || chr(10), '' order by pos) chat
  from t group by conv_id
), e as (
  select m, n, min(conv_id) conv_id, count(*) n_copies, min(chat) chat from c group by m, n
)
select conv_id, n n_turns, n_copies, chat from e
where not exists (select 1 from c d where d.n > e.n and d.m[1] = e.m[1] and list_slice(d.m, 1, e.n) = e.m)""",
    "op5_decontaminate": f"""
with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
bw as (
  select distinct item_id, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') win, least(len(w), 10) k
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from b where len(w) > 0)
),
dw as (
  select doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) p from d, (select distinct k from bw) where len(w) >= k)
),
m as (select doc_id, item_id, dw.k, p from dw join bw on dw.win = bw.win and dw.k = bw.k),
h as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + k)) q from m) group by 1),
it as (
  select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items
  from (select distinct doc_id, cast(item_id as varchar) item_id from m) group by 1
)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join it using (doc_id)""",
    "op6_license_scan": f"""
with d as (select doc_id, {_WORDS} w from documents),
tok as (select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 pos from d),
ph(label, base, k, phrase) as (values {_PHRASES}),
pw as (select k, unnest(string_split(phrase, ' ')) word, generate_subscripts(string_split(phrase, ' '), 1) - 1 off from ph),
hit as (select doc_id, word, pos from tok where word in (select word from pw)),
df as (select word, count(distinct doc_id) n from hit group by 1),
wt as (select pw.*, ln((1 + (select count(*) from documents)) / (1 + coalesce(n, 0))) + 1 weight, coalesce(n, 0) n from pw left join df using (word)),
rk as (select *, row_number() over (partition by k order by n, off) <= 3 rare from wt),
sz as (select k, count(*) long, count(*) filter (rare) short, sum(weight) filter (rare) / sum(weight) share from rk group by 1),
st as (select doc_id, k, pos - off s, count(*) n, count(*) filter (rare) nr from hit join rk using (word) where pos >= off group by all),
al as (select st.*, n = long verified, share from st join sz using (k) where nr = short),
lab as (
  select doc_id, label, base, count(distinct k) filter (verified) = min(parts) ok
  from al join ph using (k) join (select label, base, count(*) parts from ph group by 1, 2) using (label, base) group by 1, 2, 3
),
ls as (
  select doc_id, string_agg(distinct label, ',' order by label) filter (ok and base) base_labels, string_agg(distinct label, ',' order by label) filter (ok) labels, bool_or(ok) any_ok
  from lab group by 1
),
pl as (
  select doc_id, count(*) filter (verified and base) n_base, min(s) filter (verified and base) first_word, max(s) filter (verified and base) last_word, max(share) share
  from al join ph using (k) group by 1
)
select d.doc_id, len(w) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
       case when any_ok then 1.0 else coalesce(0.5 * share, 0.0) end::double score
from d left join pl using (doc_id) left join ls using (doc_id)""",
    "op8_url_filter": r"""
with recursive rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
tag as (
  select url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) t from pages where contains(url, '://')
), raw as (
  select distinct url, case
    when regexp_matches(t, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') then regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    when regexp_matches(t, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) end t
  from tag
), part as (
  select url, t, regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) origin, regexp_extract(url, '^((?s:.*?):)//', 1) scheme,
         regexp_replace(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '^$', '/') here,
         regexp_extract(t, '^([^?#]*)', 1) tp, regexp_extract(t, '^[^?#]*(\?[^#]*)?', 1) tq
  from (select url, trim(regexp_replace(t, '(?i)&(?:amp|#38|#x26);', '&', 'g')) t from raw where t <> '')
), seg as (
  select *, string_split(case when starts_with(tp, '/') then tp else regexp_extract(here, '^((?s:.*)/)', 1) || tp end, '/') s from part
), path as (
  select *, '/' || array_to_string(list_concat(
    list_reduce(s[2:], lambda o, x: case when x = '.' then o when x = '..' then o[:-2] else list_append(o, x) end, []::varchar[]),
    case when s[-1] in ('.', '..') then [''] else []::varchar[] end), '/') whole from (select url, t, origin, scheme, here, tq, list_transform(s, lambda x: x) s from seg)
), link as (
  select distinct url source, case
    when t = '' or starts_with(t, '#') then null
    when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://') then t
    when starts_with(t, '//') then scheme || t
    when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') then null
    when starts_with(t, '?') then origin || here || tq
    else origin || whole || tq end target
  from path
), seen as (
  select url from pages where url is not null union select target from link where target is not null
), cut as (
  select url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) path,
         array_to_string(list_filter(string_split(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '&'),
           lambda x: x <> '' and not regexp_full_match(x, '(utm_[a-z]+|ref|fbclid|gclid)=[^&]*')), '&') q
  from seen
), fit as (
  select url, h || p rule, v, row_number() over (partition by url order by length(h || p) desc) k
  from cut join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
), own as (
  select cut.*, rule, v,
    case when contains(url, '://') then host || case when length(path) > 1 then regexp_replace(path, '/$', '') else path end || case when q <> '' then '?' || q else '' end end form
  from cut left join (select * from fit where k = 1) using (url)
), edge as (
  select a.form a, b.form b from link join own a on a.url = source join own b on b.url = target where a.form <> b.form
), reach(a, b) as (
  select form, form from own where form is not null
  union
  select reach.a, e.b from reach join (select a, b from edge union all select b, a from edge) e on reach.b = e.a
), bad as (
  select reach.a form from reach join own on own.form = reach.b where v is not null
  group by 1 having bool_or(v = 'block') and not bool_or(v = 'allow')
)
select page_id, coalesce(host, '') host, coalesce(path, '') path, rule, coalesce(v, case when bad.form is not null then 'block' else 'allow' end) verdict
from pages left join own using (url) left join bad using (form)""",
    "op9_line_dedup": r"""
with l as (
  select doc_id, coalesce(source, '') site, text, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1)) pos from documents
), k as (select *, trim(regexp_replace(line, '[\t\x0B\f\r]', ' ', 'g')) bare from l),
pages as (select coalesce(source, '') site, count(*) pages from documents group by 1),
bad as (
  select site, bare from k join pages using (site) where bare <> ''
  group by site, bare, pages having count(distinct doc_id) >= 2 and count(distinct doc_id) > 0.1 * pages
),
f as (
  select k.doc_id, count(*) filter (bad.bare is not null) n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (bad.bare is null), '') text
  from k left join bad on k.site = bad.site and k.bare = bad.bare group by 1
)
select doc_id, coalesce(n_dropped, 0) n_dropped, f.text, sha256(f.text) text_sha256 from documents left join f using (doc_id)""",
}
