"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontaminate, divergence, hnsw, lexical, license_scan, line_dedup, near_dedup, packing, quality_rules, sharding, suffix_dedup, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = line_dedup.deduplicated(docs)
    return df.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.text"), 256).alias("kept_sha256"))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.all_templates())


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_wavelet_tokens, op4_license_scan, op5_minhash_near_dedup, op6_best_fit_packing, op7_suffix_dedup, op8_benchmark_decontamination, op9_histogram_sharding, op10_quality_classifier, op11_source_divergence, op12_hnsw_neighbours, op13_tiered_search)}
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINE, _KEY = _STRIP.format("line"), _LOWER.format(_STRIP.format("line"))
_TERMINAL = quality_rules.TERMINAL.replace("'", "''")

ORACLE_SQL: dict[str, str] = {
    # Line rules and repeated windows as rows instead of arrays.
    "op1_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, {_WORDS.format("t")} as ws from d),
g as (select doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] as gram from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as p from w)),
again as (select doc_id, p from (select *, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
r as (select doc_id, count(distinct p + o) as n_repeat_words from again, (values (0), (1), (2)) as v(o) group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
m as (select doc_id, line, {_LINE} <> '' as filled, length(line) as n, len({_WORDS.format("line")}) as words,
 length(line) - length(regexp_replace(line, '[!-/:-@\[-`{{-~]+', '', 'g')) as marks, length(line) - length(translate(line, '|»›•·', '')) as bars from l),
v as (select doc_id, line, filled, n, not filled or (marks <= n * {quality_rules.MAX_PUNCTUATION}::double and (words >= {quality_rules.SHORT_LINE_WORDS} or regexp_matches(line, '{_TERMINAL}'))
 and not (bars >= {quality_rules.MIN_SEPARATORS} and bars * 4 >= words) and not regexp_matches(line, '{quality_rules.BOILERPLATE}')) as passes from m),
s as (select doc_id, count(*) filter (filled) - count(distinct line) filter (filled) as n_dup_lines, count(*) filter (not passes) as n_bad_lines,
 coalesce(sum(n) filter (not passes), 0)::double / greatest(sum(n), 1)::double as lost from v group by doc_id),
f as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
 n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, n_bad_lines, lost from w join s using (doc_id) left join r using (doc_id)),
b as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed from f)
select *, not base_failed and lost <= {quality_rules.MAX_LOST}::double as kept from b""",
    "op2_line_dedup": f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
l as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from s),
k as (select *, {_KEY} as key from l),
m as (select key, min(doc_id) as first_doc from k where length(key) >= 10 group by key)
select doc_id, count(*) as n_lines, count(*) filter (first_doc <> doc_id) as n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by pos) filter (first_doc is null or first_doc = doc_id), '')) as kept_sha256
from k left join m on k.key = m.key group by doc_id""",
    # Every pair that shares a shingle, and the closure of the links.
    "op5_minhash_near_dedup": rf"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
 else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as shingle from w),
c as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n_both from s a join s b using (shingle) where a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from shared join c a on a.doc_id = x join c b on b.doc_id = y where 100 * n_both >= {near_dedup.PERCENT} * (a.n + b.n - n_both)),
reach as (select doc_id, doc_id as other from w union select doc_id, y from reach join links on other = x),
least_id as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_id left join c using (doc_id)""",
    # Every window of 200 bytes, as 400 hexadecimal digits; those whose hash is alone are left out before they are compared.
    "op7_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as materialized (select doc_id, i, substring(h, 2000 * i + 1, 2398) as block from (select doc_id, h, unnest(range(0, (length(h) // 2 + 999) // 1000)) as i from d)),
k as materialized (select doc_id, i, j, hash(substring(block, 2 * j + 1, 400)) as k from (select *, unnest(range(0, least(1000, length(block) // 2 - 199))) as j from b)),
g as materialized (select doc_id, 1000 * i + j as p, substring(block, 2 * j + 1, 400) as w from k join b using (doc_id, i) where k in (select k from k group by k having count(*) > 1)),
twice as (select w from g group by w having count(*) > 1),
m as (select doc_id, p, lag(p) over o as before from g semi join twice using (w) window o as (partition by doc_id order by p)),
n as (select doc_id, p, sum(case when before is null or p > before + 200 then 1 else 0 end) over (partition by doc_id order by p) as span from m),
spans as (select doc_id, span, min(p) as a, max(p) + 200 as b from n group by doc_id, span),
kept as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from spans
 union all select d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 from d left join spans using (doc_id) group by d.doc_id),
t as (select doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' order by a) as h from kept join d using (doc_id) group by doc_id),
c as (select doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed from spans group by doc_id)
select doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(t.h)) as kept_sha256
from d join t using (doc_id) left join c using (doc_id)""",
    # Every term against every source of its language.
    "op11_source_divergence": rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWER.format("coalesce(text, '')")} as t from documents),
o as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from o group by lang, term having count(distinct r) >= {divergence.MIN_DOCS}),
l as (select lang, count(*) as v, sum(n)::bigint as n from k group by lang),
c as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by all),
g as (select lang, source, coalesce(any_value(l.v), 0) as v, coalesce((select sum(n) from c where c.lang = d.lang and c.source = d.source), 0)::bigint as n from d left join l using (lang) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({divergence.SCALE}::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + g.v) as p, 1 + ({divergence.SCALE}::hugeint * (k.n + 1)) // (l.n + l.v) as q
 from g join k on g.lang = k.lang join l on l.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from every
 union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms)
select * from r where part = 'pair' or rank <= {divergence.TOP}""",
    # Every document against every item.
    "op13_tiered_search": rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
n as (select r, doc_id, len(ts)::bigint as n from d where len(ts) > 0),
s as (select count(*)::bigint as docs, sum(n)::bigint as words from n),
o as (select r, term, count(*)::bigint as tf from (select r, unnest(ts) as term from d) group by all),
i as (select item_id, it, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select *, row_number() over () as it from benchmark)),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from o, s where term in (select term from i) group by term, docs),
x as (select it, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))))::bigint as score from i join w using (term) join o using (term) join n using (r), s group by all),
k as (select *, row_number() over (partition by it order by score desc, doc_id nulls first)::int as rank from x where score > 0)
select item_id, rank, doc_id, score from k where rank <= {lexical.K}""",
}
