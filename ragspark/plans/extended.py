"""More queries over the driver's tables: pages, files, expansion, curation, audits and rebuilds. Importing this adds them to the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import audit, composition, curation, expansion, feedback, pages, rebuild, store, text, vector
from ragspark.tables import partitions

from .reference import _PAIRS, _pairs, query, table

NL = "chr(10)"


# --- pages: a payload and a page made from each part, so that both engines know what they hold

_PARTS = "a as (select p_partkey, p_name, p_type, p_brand, p_size, p_partkey % 3 as k from part)"


def _payloads(spark, d):
    """JSON pages: k = 0 has a canvas, 1 only a title and older parts, 2 a description and an empty canvas."""
    k = F.col("p_partkey") % 3
    html = F.concat(F.lit("<p>About  &amp;  "), F.col("p_name"), F.lit("</p><script>x()</script><table><tr><th>Brand</th><th>Size</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td></tr></table>"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    part = F.concat(F.lit('{"innerHtml":'), quoted(html), F.lit(',"webPartData":{"properties":{"note":'), quoted(F.concat(F.lit("a longer note on "), F.col("p_type"))), F.lit(',"short":"tiny","number":12345678901}}}'))
    canvas = F.concat(F.lit('"canvasLayout":{"horizontalSections":[{"columns":[{"webparts":['), part, F.lit(']}]}],"verticalSection":{"webparts":[{"innerHtml":"<b>side</b>"}]}}'))
    head = F.concat(F.lit('{"title":'), quoted(F.col("p_name")), F.lit(","))
    payload = F.when(k == 0, F.concat(head, canvas, F.lit("}"))).when(k == 1, F.concat(head, F.lit('"webParts":['), part, F.lit("]}"))).otherwise(F.concat(head, F.lit('"description":"described","canvasLayout":{}}')))
    return table(spark, d, "part").select("p_partkey", payload.alias("payload"))


_PART_TEXT = f"'About' || {NL} || '&' || {NL} || p_name || {NL} || 'Brand' || {NL} || 'Size' || {NL} || p_brand || {NL} || {NL} || '**Table:**' || {NL} || {NL} || '| Brand | Size |' || {NL} || '| --- | --- |' || {NL} || '| ' || p_brand || ' |  |' || {NL} || {NL} || 'a longer note on ' || p_type"


@query(f"""with {_PARTS} select p_partkey, '# ' || p_name || {NL} || {NL} || {NL} || case when k = 0 then {_PART_TEXT} || {NL} || {NL} || 'side' when k = 1 then {_PART_TEXT} else 'described' end as body from a""")
def ext_page_text(spark, d):
    return pages.page_text(_payloads(spark, d), "payload", "p_partkey")


def _html_pages(spark, d):
    """A page a part: a question in a list, a table, a paragraph."""
    question = F.concat(F.lit("<ul><li>Which type does the part named "), F.col("p_name"), F.lit(" have?<b> It is of type "), F.col("p_type"), F.lit(", as listed.</b></li></ul>"))
    grid = F.concat(F.lit("<table><tr><th>Feature</th><th>Yes or no</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    url = F.concat(F.lit("https://h.example/p/"), F.col("p_partkey").cast("string"), F.lit("?x=1"))
    return table(spark, d, "part").repartition(partitions(spark)).select(url.alias("url"), F.col("p_name").alias("title"), F.concat(F.lit("<nav>menu</nav>"), question, grid, F.lit("<p>tail</p>")).alias("html"))


@query(f"""with u as (select 'https://h.example/p/' || p_partkey || '?x=1' as page_url, '/p/' || p_partkey as page_path, p_name as page_title, * from part)
select page_url, page_path, page_title, 'faq' as content_type, 0 as n, 'Q: Which type does the part named ' || p_name || ' have?' || {NL} || {NL} || 'A: It is of type ' || p_type || ', as listed.' as content, null as table_kind from u
union all select page_url, page_path, page_title, 'table', 0, 'Table: Table 1' || {NL} || 'Headers: Feature, Yes or no' || {NL} || 'Row 1: ' || p_brand || ' | ' || p_size, 'feature_matrix' from u
union all select page_url, page_path, page_title, 'text', 0, 'Which type does the part named ' || p_name || ' have? It is of type ' || p_type || ', as listed. Feature Yes or no ' || p_brand || ' ' || p_size || ' tail', null from u""")
def ext_page_documents(spark, d):
    return pages.page_documents(_html_pages(spark, d))


@query(r"""with h as (select page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]+)', 1) as root, unnest(list_distinct(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1))) as href from pages),
a as (select page_id, root, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') then href when starts_with(href, '/') then root || href end as link from h)
select distinct page_id, link from a where link = root or starts_with(link, root || '/')""")
def ext_own_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(pages.page_links(F.col("url"), F.col("html"))).alias("link"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'feature_matrix' else 'general' end as kind from part")
def ext_feature_table(spark, d):
    heads = F.array(F.when(F.col("p_partkey") % 2 == 0, "Feature").otherwise("Features"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", pages.feature_table(heads).alias("kind"))


@query(f"select o_orderkey, case when o_orderkey % 3 = 2 then '' else 'Order of ' || o_custkey || {NL} || repeat('body ', 30) || 'end' end as body from orders")
def txt_main_content(spark, d):
    body = F.concat(F.lit("<p>Order of "), F.col("o_custkey").cast("string"), F.lit("</p><p>Sign in</p><button>Go</button><p>" + "body " * 30 + "end</p>"))
    page = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('<body><div class="x">menu</div><div class="CanvasZone a"><div class="SuiteNavWrap">nav</div>'), body, F.lit("</div><article>other</article></body>")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('<body><header>top</header><div class="nav-left">nav</div>'), body, F.lit("</body>")))
        .otherwise(F.lit('<body><div role="main"><p>too short</p></div></body>'))
    )
    return table(spark, d, "orders").select("o_orderkey", pages.to_main_content(page).alias("body"))


@query(f"select p_partkey, p_name || {NL} || 'the ' || p_brand || ' of ' || p_type || ' in code' || {NL} || 'item ' || p_size as plain, '# ' || p_name || {NL} || 'the **' || p_brand || '** of [' || p_type || '](u) in `code`' || {NL} || '- item ' || p_size as kept from part")
def txt_strip_markdown(spark, d):
    md = F.concat(F.lit("# "), F.col("p_name"), F.lit("\nthe **"), F.col("p_brand"), F.lit("** of ["), F.col("p_type"), F.lit("](u) in `code`\n- item <b>"), F.col("p_size").cast("string"), F.lit("</b>"))
    return table(spark, d, "part").select("p_partkey", pages.strip_markdown(md).alias("plain"), pages.keep_markdown(md).alias("kept"))


@query(f"select p_partkey, 'a < b' || {NL} || p_name || {NL} || 'c' as body from part")
def txt_clean_html(spark, d):
    page = F.concat(F.lit("<style>x</style>a &lt; b  &lt;i&gt;"), F.col("p_name"), F.lit("&lt;/i&gt;<meta name=x><link rel=y>  c"))
    return table(spark, d, "part").select("p_partkey", pages.to_clean_text(page).alias("body"))


@query("select 'https://h.example/p/' || p_partkey || '?x=1' as url, length(p_name) as title_length from part")
def src_flat_pages(spark, d):
    return pages.flat_pages(_html_pages(spark, d)).select("url", F.length("title").cast("long").alias("title_length"))


# --- files and chunks: texts of four-digit words, so that every profile's cuts can be counted

_TYPES = ["pdf", "xlsx", "docx", "pptx", "txt", "XLS", "md", "html"]
_WORDS = "w as (select o_orderkey as id, 100 + o_orderkey % 900 as n, {} as kind from orders)"
_KIND = f"{_TYPES!r}[(o_orderkey % 8 + 1)::int]"
_CUTS = """m as (select *, (size + 1) // 5 as each, (lap + 1) // 5 as shared from p),
c as (select *, case when n <= each then 1 else 1 + (n - shared - 1) // (each - shared) end as total from m),
g as (select *, unnest(range(total::bigint))::int as i from c)"""
_CHUNK = "array_to_string(list_transform(range(i * (each - shared) + 1, least(i * (each - shared) + each, n) + 1), lambda x: lpad(x::varchar, 4, '0')), ' ')"


def _word_files(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    # The first 100 to 999 words of one text.
    body = F.substring(F.lit(" ".join(f"{i:04d}" for i in range(1, 1000))), F.lit(1), (5 * (100 + F.col("o_orderkey") % 900) - 1).cast("int"))
    # Few bytes make long texts: the rows are dealt out before, as splits by size would leave most cores idle.
    return table(spark, d, "orders").select("o_orderkey").repartition(partitions(spark)).select(F.col("o_orderkey").alias("id"), kind.alias("file_type"), body.alias("text"))


@query(f"""with {_WORDS.format(_KIND)}, p as (select id, n, kind, case when lower(kind) in ('xlsx', 'xls') then 2000 else 1500 end as size, case when lower(kind) in ('xlsx', 'xls') then 200 else 300 end as lap from w), {_CUTS}
select 'f' || id || '.' || kind as file_name, lower(kind) as file_type, case lower(kind) when 'pdf' then 'pdf_document' when 'docx' then 'word_document' when 'xlsx' then 'excel_spreadsheet' when 'xls' then 'excel_spreadsheet' when 'pptx' then 'powerpoint_presentation' when 'txt' then 'text_file' when 'md' then 'text_file' end as content_type,
i as chunk_index, total::int as total_chunks, '' as folder_path, md5({_CHUNK}) as digest from g""")
def chunk_file_metadata(spark, d):
    files = _word_files(spark, d).withColumn("file_name", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("."), F.col("file_type")))
    return composition.file_chunks(files).select("file_name", "file_type", "content_type", "chunk_index", "total_chunks", "folder_path", F.md5("text").alias("digest"))


@query(f"""with {_WORDS.format(_KIND)}, p as (select id, n, kind, case when lower(kind) in ('pdf', 'xlsx', 'xls', 'docx') then 1000 else 1500 end as size, case when lower(kind) in ('pdf', 'xlsx', 'xls', 'docx') then 200 else 300 end as lap from w), {_CUTS}
select id, kind as chunk_type, i as chunk_index, total::int as total_chunks, array_to_string(list_slice(string_split({_CHUNK}, ' '), 1, 20), ' ') as searchable_content from g""")
def chunk_directory_stamps(spark, d):
    files = _word_files(spark, d)
    cut = composition.chunk_by_profile(files, composition.directory_profile(F.col("file_type")))
    return composition.stamped(cut, F.col("file_type")).select("id", "chunk_type", "chunk_index", "total_chunks", "searchable_content")


@query(f"""with {_WORDS.format("'x'")}, p as (select id, n, 1500 as size, 300 as lap from w), {_CUTS}, h as (select id, i as first_index, least(each, n - i * (each - shared)) as n from g),
q as (select id, first_index, n, 1000 as size, 200 as lap from h), m2 as (select *, (size + 1) // 5 as each, (lap + 1) // 5 as shared from q)
select id, first_index, sum(case when n <= each then 1 else 1 + (n - shared - 1) // (each - shared) end)::bigint as n_chunks from m2 group by id, first_index""")
def chunk_again(spark, d):
    once = composition.chunk_by_profile(_word_files(spark, d).drop("file_type"), F.lit("slides")).withColumnRenamed("chunk_index", "first_index").drop("total_chunks")
    return composition.rechunk(once, "pdf").groupBy("id", "first_index").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("select doc_id || '.txt' as source, '/in/' || doc_id || '.txt' as file_path, 'txt' as file_format, 'text' as content_type, md5(array_to_string(list_slice(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g')), ' '), 1, 20), ' ')) as terms from documents where trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def src_directory_documents(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files = table(spark, d, "documents").select(name.alias("file_name"), F.concat(F.lit("/in/"), name).alias("path"), F.lit("TXT").alias("file_type"), "text")
    return composition.directory_documents(files).select("source", "file_path", "file_format", "content_type", F.md5("searchable_terms").alias("terms"))


@query("select count(*) filter (doc_id % 7 <> 0 and trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') as successful, count(*) filter (doc_id % 7 = 0 or text is null or trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '') as failed, count(*) as total from documents")
def src_batch_counts(spark, d):
    return composition.batch_counts(table(spark, d, "documents").withColumn("error", F.when(F.col("doc_id") % 7 == 0, "broken")))


@query(f"""with r as (select o_custkey, o_orderkey, o_orderkey % 4 = 0 as head, o_orderpriority, sum(case when o_orderkey % 4 = 0 then 1 else 0 end) over (partition by o_custkey order by o_orderkey) as part from orders)
select o_custkey as doc_id, regexp_replace(regexp_replace(lower('Title: ' || max(case when head then o_orderkey end)), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '_', 'g') || '.txt' as file_name, coalesce(string_agg(o_orderpriority, {NL} order by o_orderkey) filter (not head), '') as content from r where part > 0 group by o_custkey, part""")
def snk_heading_files(spark, d):
    head = F.col("o_orderkey") % 4 == 0
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.when(head, 1).otherwise(0).alias("level"), F.when(head, F.concat(F.lit("Title: "), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderpriority")).alias("text"))
    return composition.heading_files(lines)


# --- query expansion: a question's rephrasings stand for the vectors after its own

_VARIANTS = """q as (select e.vec_id as qid, v as variant, case when v = 0 then 25 else 12 end as k, o.embedding::double[] as qe from embeddings e, range(3) t(v), embeddings o where e.vec_id % 20 = 0 and o.vec_id = e.vec_id + v),
s as (select qid, variant, k, vec_id, round(list_cosine_similarity(embedding::double[], qe), 6) as score from embeddings, q),
h as (select * from (select *, row_number() over (partition by qid, variant order by score desc, vec_id) as rank from s) where rank <= k),
u as (select qid, variant, rank, vec_id, text, source, lang, n_chars, row_number() over (partition by qid, coalesce(source, '') || '_' || substring(text, 1, 50) order by variant, rank) as f from h join documents on vec_id = doc_id),
kept as (select * from (select *, row_number() over (partition by qid order by variant, rank) as n from u where f = 1) where n <= 30)"""


def _expanded(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.explode(F.array(*map(F.lit, range(3)))).alias("variant"))
    variants = asked.join(e, F.col("vec_id") == F.col("qid") + F.col("variant")).select("qid", "variant", F.when(F.col("variant") == 0, expansion.OWN_HITS).otherwise(expansion.MORE_HITS).alias("k"), "embedding")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", "lang", "n_chars")
    return expansion.union_hits(expansion.variant_hits(variants, e).join(docs, "vec_id"))


@query(f"with {_VARIANTS} select qid, n::int as n, variant::int as variant, vec_id from kept")
def ret_expanded_hits(spark, d):
    return _expanded(spark, d).select("qid", "n", "variant", "vec_id")


@query(f"""with {_VARIANTS} select qid, md5(string_agg('[Document ' || n || '] (Source: ' || source || ' - ' || lang || case when n_chars % 2 = 0 then ', Page ' || n_chars else '' end || case when n_chars % 3 = 0 then ', Modified: 2024-01-31' else '' end || ')' || {NL} || text, {NL} || {NL} || '---' || {NL} || {NL} order by n)) as digest, count(*) as n_docs from kept group by qid""")
def ret_cited_fields(spark, d):
    page, day = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")), F.when(F.col("n_chars") % 3 == 0, "2024-01-31T23:59:00Z").when(F.col("n_chars") % 3 == 1, "not a date")
    docs = _expanded(spark, d).withColumnsRenamed({"source": "file_name", "lang": "folder_path"}).withColumn("page_number", page).withColumn("last_modified", day)
    return expansion.cited_contexts(docs).select("qid", F.md5("context").alias("digest"), "n_docs")


@query("""with c as (select conv_id, text from conversations where turn = 0 and text is not null), v as (select conv_id, 0 as variant, text as question, 25 as k from c union all select conv_id, 1, 'about ' || conv_id, 12 from c where conv_id % 3 <> 0 union all select conv_id, 2, 'more', 12 from c where conv_id % 3 <> 0)
select conv_id as qid, variant, md5(question) as digest, k from v""")
def ret_expand_variants(spark, d):
    """The rephraser gets the id, fails for every third one, and gives a blank line and a third wording that are not taken."""

    def rephrase(q: str) -> str:
        if int(q) % 3 == 0:
            raise ValueError("no answer")
        return f"  about {q}\n\n more \nunused"

    c = table(spark, d, "conversations").filter("turn = 0 and text is not null").select(F.col("conv_id").alias("qid"), F.col("text").alias("question"))
    more = expansion.expand(c.select("qid", F.col("qid").cast("string").alias("question")), rephrase).filter("variant > 0")
    return expansion.expand(c).unionByName(more).select("qid", "variant", F.md5("question").alias("digest"), "k")


@query(r"""with t as (select item_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 5)) as a from benchmark), d as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 5)) as b from documents),
x as (select item_id, unnest(a) as w from t), y as (select doc_id, unnest(b) as w from d), n as (select item_id, doc_id, count(*) as c from x join y using (w) group by all having count(*) > 3)
select b.item_id, count(n.doc_id) as n_docs from benchmark b left join n on b.item_id = n.item_id group by b.item_id""")
def ret_grounded_docs(spark, d):
    """Every answer against every document, by the words that they share."""
    answers, docs = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("answer")), table(spark, d, "documents").select("doc_id", "text")
    return vector.grounding_counts(answers, docs).select(F.col("id").alias("item_id"), "n_docs")


# --- curation: question and answer pairs of the conversations as lines of either format

_LINES = f"""{_PAIRS}, l as (select id, input, output, case when id % 11 = 3 then 'invalid' when input is null or output is null or id % 11 = 4 then 'incomplete' end as bad from p),
s as (select id, coalesce(bad, case when row_number() over (partition by bad, input, output order by id) > 1 then 'duplicate' else 'valid' end) as status from l)"""


def _lines(spark, d):
    p = _pairs(spark, d)
    broken, short = F.col("id") % 11 == 3, F.col("id") % 11 == 4
    exported, standard = F.to_json(F.struct("input", F.col("output").alias("expectedOutput"))), F.to_json(F.struct("input", F.col("output").alias("corrected_output")))
    line = F.when(broken, F.lit("{oops")).when(short, F.to_json(F.struct("input"))).when(F.col("id") % 2 == 0, exported).otherwise(standard)
    return p.select(F.col("id").alias("n"), line.alias("line"), "input", "output")


@query(f"with {_LINES} select id as n, status from s")
def cur_convert_status(spark, d):
    return feedback.convert_status(_lines(spark, d).select("n", "line"))


@query(f"""with {_LINES} select count(*) as total, count(*) filter (status = 'valid') as valid, count(*) filter (status = 'duplicate') as duplicate, count(*) filter (status = 'invalid') as invalid, count(*) filter (status = 'incomplete') as incomplete, round(100 * count(*) filter (status = 'valid') / count(*), 4) as success_percent from s""")
def cur_convert_totals(spark, d):
    return curation.convert_totals(curation.convert(_lines(spark, d).select("n", "line")))


@query(f"""with {_LINES}, f as (select id % 5 as file, arg_min(id, id) as first from l group by 1) select file, case when first % 11 in (3, 4) then 'unknown' when first % 2 = 0 then 'exported' else 'standard' end as format from f""")
def cur_file_format(spark, d):
    return curation.file_format(_lines(spark, d).select((F.col("n") % 5).alias("file"), "n", "line"))


@query("""with p as (select conv_id * 100 + turn as id, role, coalesce(text, '') as text from conversations) select id, '{"messages":[{"role":"system","content":"s"},{"role":"user","content":' || to_json(role)::varchar || '},{"role":"assistant","content":"' || md5(text) || '"}]}' as line from p""")
def cur_messages_json(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("input"), F.md5(F.coalesce("text", F.lit(""))).alias("output"))
    return feedback.messages_json(c, "s")


@query(f"""with {_PAIRS}, r as (select 0 as part, id, input, output from p where id % 2 = 0 union all select 1, id, input, output from p where id % 3 = 0), f as (select part, id, row_number() over (partition by coalesce(input, '') || '|||' || coalesce(output, '') order by part, id) as n from r) select part, id from f where n = 1""")
def cur_union_corrections(spark, d):
    p = _pairs(spark, d)
    return curation.union_corrections(p.filter("id % 2 = 0"), p.filter("id % 3 = 0")).select("part", "id")


@query(f"""with {_PAIRS}, a as (select count(*) as total, count(distinct input) as u, min(length(input)) as min_input, max(length(input)) as max_input, min(length(output)) as min_output, max(length(output)) as max_output, count(*) filter (length(output) < 100) as s, count(*) filter (length(output) > 3000) as l from p)
select total, min_input, max_input, min_output, max_output, round(u / total, 6) as diversity, total < 50 as needs_confirmation, array_to_string(list_filter([case when total < 10 then 'Small dataset size (' || total || ' < 10)' end, case when u / total < 0.8 then 'Low input diversity (' || printf('%.1f', 100 * u / total) || '%)' end, case when s > total * 0.3 then 'Many short outputs (' || s || ' < 100 chars)' end, case when l > total * 0.2 then 'Many very long outputs (' || l || ' > 3000 chars)' end], lambda x: x is not null), '; ') as issues from a""")
def cur_quality_issues(spark, d):
    q = curation.quality_gate(curation.quality_report(_pairs(spark, d)))
    return q.select("total", "min_input", "max_input", "min_output", "max_output", "diversity", "needs_confirmation", F.array_join("issues", "; ").alias("issues"))


@query("""with a as (select source, count(*) as samples, count(distinct lang) as questions, count(*) filter (n_chars % 5 = 0) as recent from documents where doc_id % 40 = 0 group by source)
select source, array_to_string(list_filter([case when samples < 10 then 'Need ' || (10 - samples) || ' more samples' end, case when questions < 5 then 'Need more diverse question types' end, case when recent < 3 then 'Need more recent feedback data' end], lambda x: x is not null), '; ') as recommendations from a""")
def cur_recommendations(spark, d):
    rows = table(spark, d, "documents").filter("doc_id % 40 = 0")
    ready = rows.groupBy("source").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("lang").alias("questions"), F.count_if(F.col("n_chars") % 5 == 0).alias("recent"))
    return curation.recommendations(ready).select("source", F.array_join("recommendations", "; ").alias("recommendations"))


@query("select user_id as trace_id, 'user_feedback' as name, case event_type when 'purchase' then 1.0 else 0.0 end::double as value, event_id::varchar as comment from events where event_type in ('purchase', 'error')")
def fb_record(spark, d):
    rating = F.when(F.col("event_type") == "purchase", "thumbs_up").when(F.col("event_type") == "error", "thumbs_down").otherwise(F.col("event_type"))
    return curation.record_feedback(table(spark, d, "events").select(F.col("user_id").alias("trace_id"), rating.alias("rating"), F.col("event_id").cast("string").alias("comment")))[0]


@query("""select item_id as trace_id, md5(text) as digest, 'correction' as kind from benchmark union all select item_id, md5(upper(item_id || 'x')), 'corrected' from benchmark""")
def fb_capture(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("trace_id"), F.col("text").alias("question"), F.lit("bad").alias("bad_response"), F.upper(F.concat(F.col("item_id").cast("string"), F.lit("x"))).alias("corrected"), F.lit(None).cast("string").alias("comment"))
    a, b = curation.capture(rows)
    return a.select("trace_id", F.md5("input").alias("digest"), F.lit("correction").alias("kind")).unionByName(b.select("trace_id", F.md5("response").alias("digest"), F.lit("corrected").alias("kind")))


@query("select event_id as trace_id, value from events where event_type = 'error' order by ts desc, event_id limit 30")
def fb_named_scores(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("name"), "value", "ts")
    return curation.named_scores(e, "error", 10).select("trace_id", "value")


@query("""with t as (select user_id as trace_id, max(ts) as ts, min(value) filter (event_type = 'error') as low, count(*) filter (event_type = 'purchase') > 0 as chat from events group by user_id),
n as (select * from t where chat order by ts desc, trace_id limit 20) select trace_id, low as value from n where low < 40 and trace_id not in (select item_id from benchmark where item_id % 2 = 0) order by low, trace_id limit 12""")
def fb_mine_traces(spark, d):
    e = table(spark, d, "events")
    traces = e.groupBy(F.col("user_id").alias("trace_id")).agg(F.max("ts").alias("ts"), F.when(F.count_if(F.col("event_type") == "purchase") > 0, F.array(F.lit("chat"))).otherwise(F.array(F.lit("other"))).alias("tags"), F.collect_list(F.struct(F.col("event_type").alias("name"), "value")).alias("scores"))
    done = table(spark, d, "benchmark").filter("item_id % 2 = 0").select(F.col("item_id").alias("trace_id"))
    return curation.mine_traces(traces, done, 40, 12, name="error")


@query("select case when event_type = 'error' or value < 5 then 'failed' when event_id % 2 = 0 then 'logged' else 'processed' end as outcome, count(*) as n from events group by 1")
def fb_batch_outcome(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("input"), F.when(F.col("value") < 5, "").otherwise("out").alias("output"), F.when(F.col("event_id") % 2 == 0, "better").alias("corrected"))
    return curation.batch_outcome(rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""select doc_id as trace_id, coalesce(n, 0) as n_observations, coalesce(s, 0) as n_scores from documents left join (select item_id, count(*) as n from benchmark group by 1) on item_id = doc_id left join (select doc_id as i, count(*) as s from labels group by 1) on i = doc_id""")
def fb_trace_log(spark, d):
    traces, seen = table(spark, d, "documents").select(F.col("doc_id").alias("trace_id")), table(spark, d, "benchmark").select(F.col("item_id").alias("trace_id"))
    scores = table(spark, d, "labels").select(F.col("doc_id").alias("trace_id"), F.lit("quality").alias("name"), F.col("quality").cast("double").alias("value"))
    return curation.trace_log(traces, seen, scores).select("trace_id", "n_observations", F.size("scores").cast("long").alias("n_scores"))


@query("select doc_id from documents where lang = 'en' and source = 'src1'")
def fb_selected(spark, d):
    return curation.selected(table(spark, d, "documents"), lang="en", source="src1").select("doc_id")


@query(r"select doc_id, regexp_extract('call MSo  ' || source || '-' || doc_id || ', then MSo x', 'MSo\s*([^\s,]+)', 1) as meeting from documents")
def src_meeting_id(spark, d):
    body = F.concat(F.lit("call MSo  "), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(", then MSo x"))
    return table(spark, d, "documents").select("doc_id", curation.meeting_id(body).alias("meeting"))


# --- audits

@query("select 'documents' as name, count(*) as n from documents union all select 'pages', count(*) from pages union all select 'events', count(*) from events union all select 'embeddings', count(*) from embeddings")
def agg_table_counts(spark, d):
    return audit.table_counts({t: table(spark, d, t) for t in ("documents", "pages", "events", "embeddings")})


@query("select event_id, value from events order by event_id desc limit 100")
def ord_latest100(spark, d):
    return audit.latest(table(spark, d, "events"), "event_id").select("event_id", "value")


@query("with p as (select event_type as name, date_trunc('hour', ts) as poll, count(*) as n from events group by all) select name, epoch(poll)::bigint as poll, n, n - lag(n) over (partition by name order by poll) as delta from p")
def mon_poll_changes(spark, d):
    polls = table(spark, d, "events").groupBy(F.col("event_type").alias("name"), F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("poll")).agg(F.count(F.lit(1)).alias("n"))
    return audit.poll_changes(polls)


_TERMS = ["license", "the", "source", "reserved"]


@query(f"select doc_id, length(text)::bigint as length, length(text) < 200 as is_short, array_to_string(list_filter({_TERMS}, lambda t: contains(lower(text), t)), ',') as found from documents")
def agg_page_audit(spark, d):
    return audit.page_audit(table(spark, d, "documents"), "text", _TERMS).select("doc_id", "length", "is_short", F.array_join("found_terms", ",").alias("found"))


@query("""select doc_id, case when source <> 'src0' then '[Source: ' || source || case when lang <> 'en' then ' - ' || lang else '' end || ']' end as citation, source <> 'src0' as is_valid, (doc_id % 3)::bigint as n_citations from documents""")
def agg_citation_audit(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.nullif("source", F.lit("src0")).alias("f"), F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("p"), F.repeat(F.lit("see [Source: a] "), (F.col("doc_id") % 3).cast("int")).alias("answer"))
    return audit.citation_audit(rows, "f", "p", "answer").select("doc_id", "citation", "is_valid", "n_citations")


@query(r"select event_id, nullif(regexp_extract('step ' || (event_id % 50) || '/50, loss=' || value, 'step (\d+)/', 1), '')::int as step, 50 as total, round(value, 6) as loss from events where event_id % 2 = 0")
def mon_parse_events(spark, d):
    from ragspark.streaming.conversations import parse_progress

    e = table(spark, d, "events")
    message = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("step "), (F.col("event_id") % 50).cast("string"), F.lit("/50, loss="), F.col("value").cast("string"))).otherwise("job started")
    return parse_progress(e.select("event_id", message.alias("message"))).filter("step is not null").select("event_id", "step", "total", F.round("loss", 6).alias("loss"))


# --- rebuilds

_SOURCE_PRINTS = "(select source, md5(string_agg(part || ':' || digest, '|' order by part || ':' || digest)) as fingerprint from (select source, substring(md5(doc_id::varchar), 1, 3) as part, md5(string_agg(doc_id || ':' || md5(text), '|' order by doc_id || ':' || md5(text))) as digest from documents {} group by 1, 2) group by 1)"


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    enabled = docs.select("source").distinct().filter("source <> 'src2'")
    prints = lambda df: store.fingerprint(df, "source", F.col("doc_id"), F.col("text"))
    return docs, prints(docs.filter("lang <> 'fr' and source <> 'src1'")), rebuild.snapshot(docs, enabled, F.col("doc_id"), F.col("text"))


_REBUILD = f"""with o as {_SOURCE_PRINTS.format("where lang <> 'fr' and source <> 'src1'")}, c as {_SOURCE_PRINTS.format("where source <> 'src2'")},
x as (select coalesce(o.source, c.source) as source, c.source is null as gone from o full join c on o.source = c.source where o.fingerprint is distinct from c.fingerprint)"""


@query(f"""{_REBUILD} select doc_id, source, 'old' as origin from documents where lang <> 'fr' and source <> 'src1' and source not in (select source from x)
union all select doc_id, source, 'new' from documents where source in (select source from x where not gone)""")
def inc_rebuild(spark, d):
    docs, old, new = _snapshots(spark, d)
    rows = docs.filter("lang <> 'fr' and source <> 'src1'").select("doc_id", "source", F.lit("old").alias("origin"))
    return rebuild.rebuild_changed(rows, old, new, docs.select("doc_id", "source", F.lit("new").alias("origin")))


@query(f"""{_REBUILD}, k as (select source from o union select source from c), n as (select source, count(*) as n_rows from documents where lang <> 'fr' and source <> 'src1' group by 1)
select k.source, coalesce(n_rows, 0) as n_rows, case when x.source is null then 'unchanged' when o.source is null then 'new' when c.source is null then 'removed' else 'changed' end as state from k left join n using (source) left join x using (source) left join o using (source) left join c using (source)""")
def inc_status(spark, d):
    docs, old, new = _snapshots(spark, d)
    return rebuild.status(docs.filter("lang <> 'fr' and source <> 'src1'"), old, new)


@query("""select page_id, case when regexp_matches(url, '[?&]page=') then 'single' else 'paged' end as mode from pages""")
def src_listing_mode(spark, d):
    return table(spark, d, "pages").select("page_id", rebuild.listing_mode(F.col("url")).alias("mode"))


@query("select s_suppkey, 'http://h/api?tag=' || s_nationkey || '&per_page=100&page=' || s_suppkey as address from supplier")
def src_page_address(spark, d):
    s = table(spark, d, "supplier")
    url = F.concat(F.lit("http://h/api?per_page=20&tag="), F.col("s_nationkey").cast("string"), F.lit("&page=3"))
    return s.select("s_suppkey", rebuild.page_address(url, F.col("s_suppkey"), 100).alias("address"))


@query("select o_orderkey as id, 'web' as source_type, 'blog' as source, 'pages_1-9' as fetch_config, 0 as chunk_index, 1 as total_chunks, 'Order of ' || o_custkey || chr(10) || o_orderpriority as text from orders where o_orderkey % 5 <> 0")
def src_web_documents(spark, d):
    item = F.when(F.col("o_orderkey") % 5 != 0, F.to_json(F.struct(F.struct(F.concat(F.lit("<h1>Order of "), F.col("o_custkey").cast("string"), F.lit("</h1><p>"), F.col("o_orderpriority"), F.lit("</p>")).alias("rendered")).alias("content")))).otherwise('{"id":1}')
    return rebuild.web_documents(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), item.alias("item")), "pages_1-9")


@query("""select lang as type, doc_id, 'old' as source_file from documents where lang not in ('de', 'fr') union all select 'de', doc_id, 'labels.json' from labels union all select 'fr', item_id, 'items.json' from benchmark""")
def snk_refresh_all(spark, d):
    old = table(spark, d, "documents").select(F.col("lang").alias("type"), "doc_id", F.lit("old").alias("source_file"))
    new = {"de": (table(spark, d, "labels").select("doc_id"), "labels.json"), "fr": (table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "items.json")}
    return rebuild.refresh_all(old, new)


@query("""with b as (select doc_id, text, list_transform(range(16), lambda i: 0) as z from documents), w as (select doc_id, source, text from documents)
select doc_id, not starts_with(text, '# ') as changed from w""")
def snk_enrich_and_embed(spark, d):
    rows = table(spark, d, "documents").withColumn("embedding", F.array_repeat(F.lit(0.0), 16))
    made = rebuild.enrich_and_embed(rows, F.col("source"), vector.embed_hashing, 16)
    # A changed row's vector has length one, another keeps its zeros.
    fresh = F.exists("embedding", lambda x: x != 0)
    return made.select("doc_id", (F.col("changed") & fresh).alias("changed"))


@query("select source as file, count(*) as n_chunks, case when count(*) filter (length(text) > 0) > 0 then 'success' else 'failed' end as status from documents group by source")
def snk_file_log(spark, d):
    rows = table(spark, d, "documents").select(F.lit("").alias("url"), F.col("source").alias("file_name"), "text")
    return rebuild.file_log(rows, F.lit("2024-01-31 00:00:00").cast("timestamp")).drop("logged_at")


@query("select count(*) as n_before, (select count(*) from documents where lang = 'en') as n_after, count(*) = (select count(*) from documents where lang = 'en') as complete from documents")
def snk_verify_counts(spark, d):
    docs = table(spark, d, "documents")
    return rebuild.verify_counts(docs, docs.filter("lang = 'en'"))


@query("select doc_id, '{}' as metadata, 'hashing-8' as model_id, 8 as dim from documents where doc_id % 2 = 0 union all select doc_id, lang, 'hashing-8', 8 from documents where doc_id % 2 = 1")
def snk_embed_rows(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 2 == 1, F.col("lang")).alias("metadata"))
    return rebuild.embed_rows(docs, vector.embed_hashing, 8, "hashing-8").select(F.col("id").alias("doc_id"), "metadata", "model_id", F.size("embedding").alias("dim"))
