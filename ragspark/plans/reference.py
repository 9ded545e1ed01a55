"""Queries over the driver's tables, one or more for each operator family, with an independent SQL for most of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragspark.operators import conversation, crawl, feedback, fuzzy, lookup, retrieval, store, text, vector
from ragspark.sources import datasource, files, paged
from ragspark.tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vector search

_HITS = """
q as (select vec_id as qid, embedding::double[] as qe from embeddings where vec_id % 20 = 0),
s as (select qid, vec_id, round(list_cosine_similarity(embedding::double[], qe), 6) as score from embeddings, q),
hits as (select * from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s) where rank <= 25)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vector.batch_top_k(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"))


def _hit_texts(spark: SparkSession, d: str) -> DataFrame:
    """Winners only meet their texts: ranking reads ids and vectors, not documents."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    h = _hits(spark, d)
    return h.join(docs, h["vec_id"] == docs["doc_id"]).select("qid", "rank", "vec_id", "score", "text", "source")


@query("""with q as (select embedding::double[] as qe from embeddings where vec_id = 0)
select vec_id, round(list_cosine_similarity(embedding::double[], qe), 6) as score from embeddings, q order by score desc, vec_id limit 10""")
def vec_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    return vector.top_k(e, q, 10).select("vec_id", "score")


@query("""with q as (select embedding::double[] as qe from embeddings where vec_id = 0)
select vec_id, label, round(list_cosine_similarity(embedding::double[], qe), 6) as score from embeddings, q where label = 3 order by score desc, vec_id limit 4""")
def vec_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    return vector.top_k(e, q, 4, F.col("label") == 3).select("vec_id", "label", "score")


@query(f"with {_HITS} select qid, vec_id, score, rank from hits")
def vec_topk_batch(spark, d):
    return _hits(spark, d)


@query("select count(*) as n, max(len(embedding)) as dim, count(*) filter (embedding is null) as n_missing from embeddings")
def vec_stats(spark, d):
    return vector.stats(table(spark, d, "embeddings"))


@query("select label, count(*) as n, min(len(embedding)) as min_dim, max(len(embedding)) as max_dim, count(*) filter (embedding is null) as n_missing from embeddings group by label")
def vec_source_compare(spark, d):
    return vector.compare_sources(table(spark, d, "embeddings"), "label")


@query("""with q as (select embedding::double[] as qe from embeddings where vec_id = 0)
select vec_id, case when label = 3 then 0.0 else round(list_cosine_similarity(embedding::double[], qe), 6) end as score from embeddings, q""")
def vec_zero_norm(spark, d):
    """Vectors of one label are all zeros: their score is 0."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id = 0").select("embedding").first()[0]
    rows = e.select("vec_id", F.when(F.col("label") == 3, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("embedding"))
    return rows.select("vec_id", F.round(vector.cosine(F.col("embedding"), F.array(*map(F.lit, asked))), 6).alias("score"))


@query(f"with {_HITS} select qid, source, count(*) as n from hits join documents on vec_id = doc_id group by qid, source")
def vec_hits_by_source(spark, d):
    return _hit_texts(spark, d).groupBy("qid", "source").agg(F.count(F.lit(1)).alias("n"))


# --- retrieval

_DEDUP = f"""{_HITS},
u as (select qid, rank, vec_id, text, source, row_number() over (partition by source || '_' || substring(text, 1, 50) order by qid, rank) as n from hits join documents on vec_id = doc_id),
kept as (select row_number() over (order by qid, rank) as n, qid, rank, vec_id, text, source from u where n = 1)"""


def _deduped(spark, d, cap):
    return retrieval.dedup_hits(_hit_texts(spark, d).withColumnRenamed("qid", "variant"), cap=cap).withColumnRenamed("variant", "qid")


@query(f"with {_DEDUP} select qid, rank, vec_id from kept")
def ret_dedup_prefix(spark, d):
    return _deduped(spark, d, None).select("qid", "rank", "vec_id")


@query(f"with {_DEDUP} select qid, rank, vec_id from kept where n <= 30")
def ret_dedup_cap30(spark, d):
    return _deduped(spark, d, 30).select("qid", "rank", "vec_id")


@query(f"""with {_DEDUP} select string_agg('[Document ' || n || ']' || ' (Source: ' || source || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n) as context, count(*) as n_docs from kept where n <= 30""")
def ret_cited_context(spark, d):
    docs = _deduped(spark, d, 30)  # 30 rows at most from here on
    return retrieval.cited_context(docs.withColumn("n", F.row_number().over(Window.orderBy("qid", "rank"))))


@query(f"with {_HITS} select qid, string_agg('Document ' || rank || ':' || chr(10) || text, chr(10) || chr(10) order by rank) as context from hits join documents on vec_id = doc_id group by qid")
def ret_plain_context(spark, d):
    return retrieval.plain_context(_hit_texts(spark, d))


@query(f"""with {_HITS} select qid, rank, source, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as preview, length(text) as length
from hits join documents on vec_id = doc_id where rank <= 10""")
def ret_debug_preview(spark, d):
    return retrieval.debug_preview(_hit_texts(spark, d))


_CONV = "'^(" + "|".join([*retrieval.OPENINGS, retrieval.QUESTION_OPENING]).replace("'", "''") + ")'"
_IS_CONV = f"""(regexp_matches(q, {_CONV}) or (length(q) < 10 and not regexp_matches(q, '{"|".join(retrieval.QUESTION_WORDS)}'))
 or (regexp_matches(q, '{"|".join(retrieval.SOCIAL_WORDS)}') and len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) <= 3))"""
_QUESTIONS = r"select conv_id, turn, text, lower(regexp_replace(text, '^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$', '', 'g')) as q from conversations"


@query(f"with c as ({_QUESTIONS}) select conv_id, turn, {_IS_CONV} as conversational from c")
def ret_is_conversational(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", retrieval.is_conversational(F.col("text")).alias("conversational"))


@query(f"""with c as ({_QUESTIONS}) select conv_id, turn, case when conv_id in (select conv_id from conversations where role = 'system') then 'corrected' when {_IS_CONV} then 'conversational' else 'retrieval' end as route from c where turn = 0""")
def ret_route(spark, d):
    c = table(spark, d, "conversations")
    questions = c.filter("turn = 0").select(F.col("conv_id").alias("qid"), "turn", F.col("text").alias("question"))
    known = c.filter("role = 'system'").select(F.col("conv_id").alias("qid"))
    return retrieval.route(questions, known).select(F.col("qid").alias("conv_id"), "turn", "route")


_CONTEXT = """t as (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations),
ctx as (select conv_id, chr(10) || chr(10) || 'Previous conversation:' || chr(10) || string_agg(case when role = 'user' then 'User' else 'Assistant' end || ': ' || text || chr(10), '' order by turn) as context from t where n <= 5 group by conv_id)"""


@query(f"with {_CONTEXT} select conv_id, context from ctx")
def conv_last5_context(spark, d):
    return conversation.context(table(spark, d, "conversations"))


@query(f"with {_CONTEXT} select c.conv_id, context || chr(10) || chr(10) || 'User: ' || text as query from conversations c join ctx on c.conv_id = ctx.conv_id where turn = 0")
def ret_contextual_query(spark, d):
    c = table(spark, d, "conversations")
    first = c.filter("turn = 0").select("conv_id", "text")
    return first.join(conversation.context(c), "conv_id", "left").select("conv_id", retrieval.contextual_query(F.col("context"), F.col("text")).alias("query"))


@query(r"""with w as (select item_id, text, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 5)) as a from benchmark),
v as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 5)) as b from documents)
select item_id, doc_id, len(list_intersect(a, b)) as n_shared from w join v on item_id = doc_id""")
def ret_grounding_overlap(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return vector.grounded(b.join(docs, b["item_id"] == docs["doc_id"]), "answer", "text").select("item_id", "doc_id", "n_shared")


# --- conversations

@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 20")
def conv_last20(spark, d):
    return conversation.last_messages(table(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 3")
def conv_last3(spark, d):
    return conversation.last_messages(table(spark, d, "conversations"), 3).select("conv_id", "turn")


@query("select count(distinct conv_id) as n_users, count(*) as n_messages from conversations")
def conv_stats(spark, d):
    return conversation.stats(table(spark, d, "conversations"))


@query("select distinct conv_id from conversations")
def conv_distinct_users(spark, d):
    return table(spark, d, "conversations").select("conv_id").distinct()


@query("select doc_id as conv_id, coalesce(n, 0) as n_messages, n is null as is_new from documents left join (select conv_id, count(*) as n from conversations group by 1) on doc_id = conv_id")
def conv_get_or_create(spark, d):
    return conversation.get_or_create(table(spark, d, "documents").select(F.col("doc_id").alias("conv_id")), table(spark, d, "conversations"))


@query("select conv_id, turn from conversations where conv_id not in (select doc_id from labels)")
def conv_clear(spark, d):
    c = table(spark, d, "conversations")
    return conversation.clear(c, table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"))).select("conv_id", "turn")


# --- text

@query("select c_custkey, c_name || ' speaks' || chr(10) || 'from nation ' || c_nationkey as speech from customer")
def txt_vtt_parse(spark, d):
    cue = "00:00:0{0}.000 --> 00:00:0{0}.900\n"
    parts = ["WEBVTT\n\n1\n" + cue.format(1) + "  ", F.col("c_name"), " speaks \n\nNOTE ", F.col("c_mktsegment"), "\n2\n" + cue.format(3) + "from nation ", F.col("c_nationkey").cast("string"), "\n"]
    vtt = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return table(spark, d, "customer").select("c_custkey", text.parse_vtt(vtt).alias("speech"))


_LINKS = """select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1))) as href from pages"""


@query(_LINKS)
def ext_hrefs(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(text.hrefs(F.col("html"))).alias("href"))


@query(f"select page_id, href from (select *, row_number() over (partition by page_id order by href) as n from ({_LINKS})) where n <= 5")
def ext_child_links5(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.slice(F.array_sort(text.hrefs(F.col("html"))), 1, 5)).alias("href"))


@query("""select p_partkey, 'http://a.b/' || p_partkey as url from part union all select p_partkey, 'https://d.e/' || p_size from part""")
def ext_url_findall(spark, d):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    seen = F.concat(F.lit("see http://a.b/"), key, F.lit(" and https://d.e/"), size, F.lit(" or http://a.b/"), key)
    return table(spark, d, "part").select("p_partkey", F.explode(text.urls(seen)).alias("url"))


@query("select p_partkey, case p_partkey % 5 when 0 then 'feature_matrix' when 1 then 'description' when 2 then 'migration' when 3 then 'general' else 'feature_matrix' end as kind from part")
def ext_table_class(spark, d):
    k, brand, kind = F.col("p_partkey") % 5, F.col("p_brand"), F.col("p_type")
    heads = lambda *x: F.array(*[F.lit(h) if isinstance(h, str) else h for h in x])
    headers = F.when(k == 0, heads("Feature", "Yes", brand)).when(k == 1, heads(brand, "Description")).when(k == 2, heads("Migration path", kind)).when(k == 3, heads(brand, kind)).otherwise(heads("Feature", "Notes"))
    return table(spark, d, "part").select("p_partkey", text.table_class(headers).alias("kind"))


@query("""with r as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as total, o_orderkey || ' | ' || o_orderstatus as line from orders)
select o_custkey, 'Table: orders' || chr(10) || 'Headers: key, status' || chr(10) || string_agg('Row ' || n || ': ' || line, chr(10) order by n) filter (n <= 10) || case when max(total) > 10 then chr(10) || '... and ' || (max(total) - 10) || ' more rows' else '' end as body from r group by o_custkey""")
def ext_table_render(spark, d):
    o = table(spark, d, "orders")
    by = Window.partitionBy("o_custkey")
    o = o.withColumn("n", F.row_number().over(by.orderBy("o_orderkey"))).withColumn("total", F.count(F.lit(1)).over(by)).filter("n <= 10")  # what is shown
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("r"))))
    by_customer = o.groupBy("o_custkey").agg(F.transform(rows, lambda x: x["r"]).alias("rows"), F.first("total").alias("total"))
    return by_customer.select("o_custkey", text.render_table(F.lit("orders"), F.array(F.lit("key"), F.lit("status")), F.col("rows"), total=F.col("total")).alias("body"))


@query("""select p_partkey as page, 1 as faq_number, 'How does the part ' || p_name || ' start up?' as question, 'It is of brand ' || p_brand || '. Then it runs.' as answer from part
union all select p_partkey, 2, 'Where does the part ' || p_name || ' go to?', 'To the caller.' from part""")
def ext_faq_paragraph_islands(spark, d):
    of = lambda lead, c="", end="": F.concat(F.lit(lead), F.col(c) if c else F.lit(""), F.lit(end))
    rows = [of("Intro"), of("How does the part ", "p_name", " start up?"), of("It is of brand ", "p_brand", "."), of("Then it runs."), of(""), of("stray"), of("Where does the part ", "p_name", " go to?"), of("To the caller.")]
    return text.paragraph_faqs(table(spark, d, "part").select(F.col("p_partkey").alias("page"), F.posexplode(F.array(*rows)).alias("pos", "text")))


@query("select p_partkey, p_name || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || p_type as body from part")
def ext_canvas_flatten(spark, d):
    parts = ['{"canvasLayout":{"horizontalSections":[{"columns":[{"webparts":[{"innerHtml":"', F.col("p_name"), '"}]},{"webparts":[{"innerHtml":"', F.col("p_brand"), '"},{"innerHtml":""}]}]}],"verticalSection":{"webparts":[{"innerHtml":"', F.col("p_type"), '"}]}}}']
    payload = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return table(spark, d, "part").select("p_partkey", text.flatten_canvas(payload).alias("body"))


@query("""with p as (select doc_id, text, greatest(ceil((length(text) - 300) / 1200.0), 1)::int as n from documents where length(text) > 0),
c as (select doc_id, text, n, unnest(range(n))::int as i from p) select doc_id, i as chunk_index, n as total_chunks, md5(substring(text, i * 1200 + 1, 1500)) as digest from c""")
def chunk_fixed_window(spark, d):
    return text.chunk_fixed(table(spark, d, "documents")).select("doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("digest"))


@query(r"select doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '[ \t\n\x0b\x0c\r]+', ' ', 'g')), ' '), 1, 20), ' ') as words from documents")
def sca_first20_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_words(F.col("text")).alias("words"))


@query(r"select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '_', 'g') as slug from part")
def sca_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("select doc_id, md5(source || '|' || lang || '|' || n_chars) as version from documents")
def sca_md5_version_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", store.version_hash(F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("version"))


@query("select event_id, floor((epoch(timestamp '2024-01-31') - floor(epoch(ts))) / 86400)::bigint as days from events")
def sca_iso_day_diff(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.floor(seconds / 86400).alias("days"))


# --- crawl and sources

@query("""with recursive e as (select distinct o_custkey as src, o_orderkey % 50 as dst from orders), w(node, depth) as (select 1::bigint, 0 union select e.dst, depth + 1 from w join e on e.src = w.node where depth < 3)
select node, min(depth)::int as depth from w group by node""")
def crawl_bfs_depth(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("dst")).distinct()
    return crawl.walk(edges, spark.createDataFrame([(1,)], "node long"))


@query("""with f as (select 'f' || doc_id || case doc_id % 5 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.png' when 3 then '.txt' else '' end as name, n_chars * 4096 as size, 'u' || doc_id // 3 as url from documents),
e as (select *, case when contains(name, '.') then lower(regexp_extract(name, '[.](.*)$', 1)) else '' end as file_type from f)
select name, url, file_type, n as file_size_kb from (select *, size::double / 1024 as n, row_number() over (partition by url order by name) as r from e where file_type in ('pdf', 'docx', 'txt') and size <= 52428800) where r = 1""")
def src_eligible_files(spark, d):
    k = F.col("doc_id") % 5
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(k == 0, ".pdf").when(k == 1, ".DOCX").when(k == 2, ".png").when(k == 3, ".txt").otherwise(""))
    files_ = table(spark, d, "documents").select(name.alias("name"), (F.col("n_chars") * 4096).alias("size"), F.concat(F.lit("u"), F.expr("doc_id div 3").cast("string")).alias("url"))
    return crawl.eligible(files_).select("name", "url", "file_type", "file_size_kb")


@query("select source_type, count(*) as n from (select 'web' as source_type from pages union all select 'doc' from documents) group by source_type")
def src_union_enabled(spark, d):
    sources = {"web": table(spark, d, "pages").select("page_id"), "doc": table(spark, d, "documents").select("doc_id"), "off": table(spark, d, "benchmark").select("item_id")}
    return files.union_enabled(sources, ["web", "doc"]).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


# --- store and incremental

@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def snk_upsert_lww(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return store.upsert_last_writer(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def snk_delete_ids(spark, d):
    return store.delete_ids(table(spark, d, "documents"), table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("doc_id", "source")


@query("select doc_id, source, lang from documents where source not in ('src0', 'src1') union all select doc_id, source, 'new' from documents where source in ('src0', 'src1') and lang = 'en'")
def snk_replace_by_file(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    new = docs.filter("source in ('src0', 'src1') and lang = 'en'").withColumn("lang", F.lit("new"))
    return store.replace_by_key(docs, new, ["source"])


@query("select doc_id, md5(case when starts_with(text, '# ') then text else '# ' || source || chr(10) || text end) as digest from documents")
def snk_enrich_titles(spark, d):
    return store.enrich_titles(table(spark, d, "documents"), F.col("source")).select("doc_id", F.md5("text").alias("digest"))


@query("select doc_id from labels union all select doc_id from documents where doc_id not in (select doc_id from labels)")
def snk_merge_missing(spark, d):
    return store.merge_missing(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id"), "doc_id")


_PRINTS = """select source, md5(string_agg(part || ':' || digest, '|' order by part || ':' || digest)) as fingerprint, sum(n)::bigint as n_files from
(select source, substring(md5(doc_id::varchar), 1, 3) as part, md5(string_agg(doc_id || ':' || md5(text), '|' order by doc_id || ':' || md5(text))) as digest, count(*) as n from documents {} group by 1, 2) group by source"""


@query(_PRINTS.format(""))
def inc_fingerprint(spark, d):
    return store.fingerprint(table(spark, d, "documents"), "source", F.col("doc_id"), F.col("text"))


@query(f"""with a as ({_PRINTS.format("where lang <> 'fr' and source <> 'src1'")}), b as ({_PRINTS.format("where source <> 'src2'")})
select coalesce(a.source, b.source) as source, case when a.source is null then 'new' when b.source is null then 'removed' else 'changed' end as status from a full join b on a.source = b.source where a.fingerprint is distinct from b.fingerprint""")
def inc_changed_sources(spark, d):
    docs = table(spark, d, "documents")
    old = store.fingerprint(docs.filter("lang <> 'fr' and source <> 'src1'"), "source", F.col("doc_id"), F.col("text"))
    new = store.fingerprint(docs.filter("source <> 'src2'"), "source", F.col("doc_id"), F.col("text"))
    return store.changed_sources(old, new)


@query("select d.doc_id, case when l.doc_id is null then 'new' when l.quality = d.n_chars % 2 then 'up_to_date' else 'updated' end as status from documents d left join labels l on d.doc_id = l.doc_id")
def inc_file_status(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("url"), (F.col("n_chars") % 2).alias("version"))
    log = table(spark, d, "labels").select(F.col("doc_id").alias("url"), F.col("quality").cast("long").alias("version"))
    return store.file_status(docs, log).select("doc_id", "status")


# --- feedback and curation: events stand in for feedback, labels for judge scores

_RATING = "case when event_type = 'purchase' then 'thumbs_up' when event_type in ('error', 'logout') then 'thumbs_down' when value > 50 then 'positive' else 'other' end"
_FEEDBACK = f"f as (select user_id as trace_id, event_type as comment, {_RATING} as rating from events)"
_UP, _DOWN = "rating in ('thumbs_up', 'positive')", "rating in ('thumbs_down', 'negative')"


def _feedback(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("comment"), F.expr(_RATING).alias("rating"))


@query(f"with {_FEEDBACK} select count(*) as total, count(*) filter ({_UP}) as positive, count(*) filter ({_DOWN}) as negative, round(100 * count(*) filter ({_UP}) / count(*), 6) as rate from f")
def fb_stats(spark, d):
    return feedback.stats(_feedback(spark, d))


@query(f"with {_FEEDBACK} select trace_id, count(*) as total, count(*) filter ({_UP}) as positive, count(*) filter ({_DOWN}) as negative from f group by trace_id")
def fb_trace_stats(spark, d):
    return feedback.trace_stats(_feedback(spark, d))


@query(f"""with {_FEEDBACK}, g as (select trace_id, count(*) filter ({_DOWN}) as negative, max(length(comment)) as longest from f group by trace_id),
r as (select trace_id, case when longest > 15 then 'comment' when negative >= 2 then 'repeated' when negative >= 1 then 'negative' else 'none' end as reason from g) select trace_id, reason, reason <> 'none' as correct from r""")
def fb_policy(spark, d):
    return feedback.policy(_feedback(spark, d))


@query("select l.doc_id as trace_id, quality as value from labels l join documents d on l.doc_id = d.doc_id where quality < 1 and l.doc_id not in (select item_id from benchmark) order by quality, l.doc_id limit 10")
def fb_low_scores(spark, d):
    scores = table(spark, d, "labels").select(F.col("doc_id").alias("trace_id"), F.lit("judge").alias("name"), F.col("quality").alias("value"))
    traces, processed = table(spark, d, "documents").select(F.col("doc_id").alias("trace_id")), table(spark, d, "benchmark").select(F.col("item_id").alias("trace_id"))
    return feedback.low_scores(scores, traces, processed, "judge", 1, 10).select("trace_id", "value")


@query("""with a as (select count(*) as samples, count(distinct event_type) as questions, count(*) filter (floor((epoch(timestamp '2024-01-31') - floor(epoch(ts))) / 86400) <= 7) as recent from events),
s as (select *, (case when samples >= 10 then 40 else 0 end + case when questions >= 5 then 30 else 0 end + case when recent >= 3 then 30 else 0 end)::bigint as score from a) select *, score >= 70 as ready from s""")
def fb_readiness(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("question"), F.col("ts").cast("timestamp").alias("ts"))
    return feedback.readiness(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"))


_PAIRS = "p as (select u.conv_id * 100 + u.turn as id, u.text as input, a.text as output from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"


def _pairs(spark, d):
    c = table(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "input", "output")


@query(f"""with {_PAIRS}, a as (select count(*) as total, count(distinct input) as unique_inputs, round(avg(length(input)), 6) as avg_input, round(avg(length(output)), 6) as avg_output, count(*) filter (length(output) < 100) as short_outputs, count(*) filter (length(output) > 3000) as long_outputs from p),
s as (select *, (100 - case when total < 10 then 30 else 0 end - case when unique_inputs / total < 0.8 then 20 else 0 end - case when short_outputs > total * 0.3 then 15 else 0 end - case when long_outputs > total * 0.2 then 10 else 0 end)::bigint as score from a)
select *, case when score >= 90 then 'excellent' when score >= 70 then 'good' when score >= 50 then 'fair' else 'poor' end as rating from s""")
def cur_quality(spark, d):
    return feedback.dataset_quality(_pairs(spark, d))


@query(f"with {_PAIRS} select id, input from (select *, row_number() over (partition by input, output order by id) as n from p) where n = 1")
def cur_dedup_hash(spark, d):
    return feedback.dedup_examples(_pairs(spark, d), "id").select("id", "input")


# --- aggregates, monitors and joins

@query("select lang, count(*) as n, sum(length(text)) as chars from documents group by lang")
def agg_file_types(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select count(*) as n, round(avg(l_quantity), 4) as mean, min(l_quantity) as lo, max(l_quantity) as hi from lineitem")
def agg_numeric_describe(spark, d):
    return table(spark, d, "lineitem").agg(F.count("l_quantity").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("select count(*) as n, count(*) filter (text is null or text = '') as no_text, count(*) filter (source is null or source = '') as no_source from documents")
def agg_completeness(spark, d):
    missing = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), missing("text").alias("no_text"), missing("source").alias("no_source"))


@query("select event_type, max(event_id) as latest, arg_max(value, event_id) as value, count(*) as n from events group by event_type")
def agg_latest_per_collection(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("event_id").alias("latest"), F.max_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("n"))


@query("select user_id, event_id, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as running from events")
def mon_running_step(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.max("value").over(order).alias("running"))


@query("select doc_id, quality, lang from labels join documents using (doc_id)")
def join_score_trace(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "quality", "lang")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def join_anti_processed(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""with p as (select a.s_suppkey as qid, b.s_suppkey as key, round(1 - levenshtein(lower(a.s_name), lower(b.s_name)) / greatest(length(a.s_name), length(b.s_name), 1), 6) as ratio from supplier a, supplier b where a.s_suppkey <> b.s_suppkey),
r as (select *, row_number() over (partition by qid order by ratio desc, key) as n from p where ratio >= 0.7) select qid, key, ratio from r where n = 1""")
def join_fuzzy_levenshtein(spark, d):
    s = table(spark, d, "supplier")
    q = s.select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("question"))
    k = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("stored_question"))
    # The best of all others: a supplier is not its own match.
    return fuzzy.best_match(q, k, 0.7, fuzzy.LEVENSHTEIN, others_only=True)


@query()
def join_fuzzy_ratio(spark, d):
    c = table(spark, d, "benchmark")
    q = c.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    # The best of all others: an item is not its own match.
    return fuzzy.best_match(q, c.select(F.col("item_id").alias("key"), F.col("text").alias("stored_question")), 0.3, others_only=True)


@query()
def chunk_recursive(spark, d):
    return text.chunk_recursive(table(spark, d, "documents"))


@query()
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.to_text("html").alias("text"), text.to_content("html").alias("content"))


@query()
def html_tables(spark, d):
    return table(spark, d, "pages").select("page_id", F.to_json(text.to_tables("html")).alias("tables"), F.to_json(text.to_faqs("html")).alias("faqs"))


# --- lookups, listings and migrations

_PAGES = r"""pg as (select page_id as pos, url, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) as name, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)"""
_PATHS = ["/fr/825", "en/25.aspx", "%65n/685", "By_the_was", "no such page at all"]


def _page_list(spark, d):
    name, title = F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select(F.col("page_id").alias("pos"), "url", name.alias("name"), title.alias("title"))


@query(f"""with {_PAGES}, t as (select unnest({_PATHS}) as path), p as (select *, url_decode(trim(path, '/')) as whole, url_decode(regexp_extract(trim(path, '/'), '[^/]*$')) as file from t),
q as (select *, lower(replace(file, '.aspx', '')) as stem, replace(replace(lower(replace(file, '.aspx', '')), ' ', ''), '_', '') as flat from p),
hits as (select path, pos, url, row_number() over (partition by path order by pos) as n from pg, q where contains(lower(url_decode(url)), lower(whole)) or (name <> '' and (lower(file) = lower(name) or stem = lower(replace(name, '.aspx', ''))))
 or (title <> '' and (contains(flat, replace(lower(title), ' ', '')) or contains(replace(lower(title), ' ', ''), flat)))) select path, pos, url from hits where n = 1""")
def ext_page_lookup(spark, d):
    return lookup.page_lookup(_page_list(spark, d), _PATHS)


@query(r"""select page_id, 'https://api.example/sites/' || regexp_extract(url, '://([^/?#]*)', 1) || ':/sites/' || regexp_extract(url, '://[^/?#]*/([^/?#]+)', 1) as address from pages""")
def ext_site_address(spark, d):
    page = F.regexp_replace("url", r"^([^:]+://[^/?#]*)/", "$1/sites/")
    return table(spark, d, "pages").select("page_id", lookup.site_address(page, "https://api.example/sites/").alias("address"))


_TARGETS = ["MIT License", "SRC3", "the", "nobody writes this"]


@query(f"""with t as (select unnest({_TARGETS}) as target), r as (select target, doc_id, length(coalesce(text, ''))::bigint as n_chars, row_number() over (partition by target order by doc_id) as n from documents, t
where contains(lower(source), lower(target)) or contains(substring(lower(text), 1, 500), lower(target))) select target, doc_id, n_chars, n_chars < 200 as is_short from r where n = 1""")
def join_theta_first_match(spark, d):
    return lookup.first_mention(table(spark, d, "documents"), _TARGETS, "source")


@query("select c_custkey as user_id, o_orderkey as meeting_id, l_linenumber as part, l_returnflag as content from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where l_returnflag <> ''")
def src_nested_listing(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    meetings = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("meeting_id"))
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("part"), F.col("l_returnflag").alias("content"))
    return lookup.enumerate_nested(users, meetings, parts).select("user_id", "meeting_id", "part", "content")


_FILES = "fs as (select doc_id, 'meeting ' || doc_id || case when doc_id % 3 = 0 then '.VTT' when doc_id % 3 = 1 then '.docx' else '.mp4' end as name, lang from documents)"


def _recordings(spark, d):
    ending = F.when(F.col("doc_id") % 3 == 0, ".VTT").when(F.col("doc_id") % 3 == 1, ".docx").otherwise(".mp4")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("meeting "), F.col("doc_id").cast("string"), ending).alias("name"), "lang")


@query(f"with {_FILES} select doc_id, name from fs where name like '%.VTT' and lang = 'en' union all select doc_id, name from fs where name like '%.VTT'")
def src_search_fallbacks(spark, d):
    f = _recordings(spark, d)
    return lookup.by_suffix([f.filter("lang = 'en'"), lookup.first_nonempty([f.filter("lang = 'none'"), f])], [".vtt"]).select("doc_id", "name")


@query(f"with {_FILES} select doc_id, name from fs where name like '%.VTT' or name like '%.docx' order by name limit 3")
def src_recordings_first3(spark, d):
    return lookup.by_suffix([_recordings(spark, d)], [".vtt", ".docx"], 3).select("doc_id", "name")


@query("""select c_custkey // 100 + 1 as page, (c_custkey % 100)::int as pos, c_name as item from customer where c_custkey // 100 < (select max(c_custkey) // 100 // 2 from customer)""")
def src_paged_items(spark, d):
    """Pages of 100 customers, fetched in tasks; the page at half of the listing is empty and ends it."""
    c = table(spark, d, "customer")
    last = c.agg(F.expr("max(c_custkey) div 100")).first()[0]
    names = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]))
    pages = c.groupBy(F.expr("c_custkey div 100").alias("n")).agg(names.alias("body"))
    path = new_path(spark, "served")
    datasource.write_payloads(pages.select((F.col("n") + 1).alias("address"), F.when(F.col("n") == last // 2, "[]").otherwise(F.col("body")).alias("payload")), path)
    held: list[datasource.Folder] = []  # one in each task

    def fetch(page: int) -> str | None:
        if not held:
            held.append(datasource.Folder({"path": path}))
        return held[0].fetch(str(page))

    return paged.items_of_pages(paged.fetch_pages(spark, fetch, 1, last + 2))


@query("select (s_suppkey // 2 + 1)::int as n, 'p/' || s_suppkey as address, s_name as payload from supplier where s_suppkey % 2 = 0")
def src_next_links(spark, d):
    """Pages of every other supplier, each naming the next and the last the first; the others are strays."""
    s = table(spark, d, "supplier")
    last = s.agg(F.max("s_suppkey")).first()[0]
    of = lambda c: F.concat(F.lit("p/"), c.cast("string"))
    then = F.when(F.col("s_suppkey") % 2 == 0, of(F.when(F.col("s_suppkey") + 2 <= last, F.col("s_suppkey") + 2).otherwise(0)))
    return paged.follow_links(s.select(of(F.col("s_suppkey")).alias("address"), F.col("s_name").alias("payload"), then.alias("next")), "p/0")


@query("""with s as (select conv_id as user_id, count(*) as messages from conversations group by 1),
n as (select doc_id as user_id, n_chars as messages, case when doc_id % 3 = 0 then timestamp '2024-01-02 03:04:05' else timestamp '2024-01-31' end as created_at from documents where lang = 'en')
select user_id, messages, created_at from n union all select user_id, messages, null from s where user_id not in (select user_id from n)""")
def snk_upsert_users(spark, d):
    none = F.lit(None).cast("timestamp")
    old = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(F.count(F.lit(1)).alias("messages")).select("user_id", "messages", none.alias("created_at"), none.alias("last_updated"))
    when = F.when(F.col("doc_id") % 3 == 0, "2024-01-02T03:04:05").when(F.col("doc_id") % 3 == 1, "yesterday")
    new = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("user_id"), F.col("n_chars").alias("messages"), when.alias("created_at"), when.alias("last_updated"))
    return store.upsert_users(old, new, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id", "messages", "created_at")


@query("select doc_id, lang as type, source as item from documents where lang <> 'de' union all select doc_id, 'de', 'user' || doc_id from labels")
def snk_full_refresh(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.col("source").alias("item"))
    new = table(spark, d, "labels").select("doc_id", F.concat(F.lit("user"), F.col("doc_id").cast("string")).alias("item"))
    return store.full_refresh(old, new, "de")


@query("""with c as (select conv_id, count(*) as n from conversations group by 1)
select 'u' || conv_id as user_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, role as item from conversations where conv_id % 3 = 0
union all select 'u' || conv_id, 0, case conv_id % 3 when 1 then '{"k":' || n || '}' else n::varchar end from c where conv_id % 3 > 0""")
def snk_flatten_users(spark, d):
    """Objects of up to three users each: one has a list, one a dict, one a number."""
    roles = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("roles"), F.count(F.lit(1)).cast("string").alias("n"))
    value = F.when(F.col("conv_id") % 3 == 0, F.col("roles")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"k":'), "n", F.lit("}"))).otherwise(F.col("n"))
    entry = F.concat(F.lit('"u'), F.col("conv_id").cast("string"), F.lit('":'), value)
    maps = c.groupBy(F.expr("conv_id div 3").alias("g")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("payload"))
    return store.flatten_users(maps.select("payload"))


@query("""select label, count(*) as n, count(*) filter (label <> 3) as n_copied, count(*) filter (label = 3) as n_made, count(*) filter (label = 3 and doc_id is null) as n_blank
from embeddings left join documents on vec_id = doc_id group by label""")
def snk_migrate_vectors(spark, d):
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents").select("doc_id", "text")
    rows = e.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding"))).join(docs, e["vec_id"] == docs["doc_id"], "left")
    made = store.migrate_vectors(rows, 64, vector.embed_hashing)
    zero = F.forall("embedding", lambda x: x == 0)
    return made.groupBy("label").agg(F.count_if(F.size("embedding") == 64).alias("n"), F.count_if("copied").alias("n_copied"), F.count_if(~F.col("copied")).alias("n_made"), F.count_if(~F.col("copied") & zero).alias("n_blank"))


@query("select doc_id, case when text is null or trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 0.0 else 1.0 end as norm from documents")
def embed_hashing(spark, d):
    e = table(spark, d, "documents").select("doc_id", vector.embed_hashing(F.col("text"), 64).alias("v"))
    return e.select("doc_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))
