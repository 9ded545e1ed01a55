"""Queries of fuzzy joins, data sources, transactional stores, streams and joins by time. Importing this adds them to the others.

Stores and payloads that a query writes lie in the session's shared folder, in a new place each time.
"""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from ragspark.operators import audit, composition, crawl, fuzzy, ingest, pages, sketches, text, timejoin, udtfs, urls
from ragspark.operators.transactions import TransactionalStore, rebuild_with_backup
from ragspark.sources import datasource
from ragspark.streaming import messages, polling
from ragspark.tables import new_path

from .extended import _html_pages
from .reference import query, table

# --- the most similar other text

_NAME = "p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size"


@query(f"""with s as (select p_partkey as key, lower({_NAME}) as t from part), u as (select t, min(key) as k1, count(*) as n from s group by t),
p as (select a.key as qid, b.k1 as key, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) as ratio from s a join u b on a.key <> b.k1
 union all select s.key, (select min(x.key) from s x where x.t = s.t and x.key <> s.key), 1 from s join u using (t) where n > 1 and s.key = k1)
select qid, key, ratio from (select *, row_number() over (partition by qid order by ratio desc, key) as n from p where ratio >= 0.8) where n = 1""")
def join_fuzzy_parts(spark, d):
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    p = table(spark, d, "part").select("p_partkey", name.alias("name"))
    return fuzzy.best_match(p.select(F.col("p_partkey").alias("qid"), F.col("name").alias("question")), p.select(F.col("p_partkey").alias("key"), F.col("name").alias("stored_question")), 0.8, fuzzy.LEVENSHTEIN, others_only=True)


# --- data sources; each reads from a server over payloads that are made from a table

_SERVER = "ragspark.sources.datasource:Folder"


def _serve(payloads) -> str:
    path = new_path(payloads.sparkSession, "served")
    datasource.write_payloads(payloads, path)
    datasource.register(payloads.sparkSession)
    return path


@query("""with o as (select o_orderkey, o_totalprice, row_number() over (partition by o_orderkey // 500 order by o_orderkey) - 1 as pos from orders)
select o_orderkey // 500 + 1 as page, pos::int as pos, o_orderkey, o_totalprice from o where o_orderkey < (select max(o_orderkey) * 2 // 3 // 500 * 500 from orders)""")
def src_paged_source(spark, d):
    """Pages of 500 orders; one page at two thirds of the listing is broken and ends it."""
    o = table(spark, d, "orders")
    cut = o.agg(F.expr("max(o_orderkey) * 2 div 3 div 500")).first()[0]
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x))
    rows = o.groupBy(F.expr("o_orderkey div 500").alias("n")).agg(body.alias("body"))
    path = _serve(rows.select((F.col("n") + 1).alias("address"), F.when(F.col("n") == cut, F.substring("body", 1, 9)).otherwise(F.col("body")).alias("payload")))
    last = rows.count() + 3
    read = spark.read.format("json_pages").options(server=_SERVER, path=path, last=last, pages_per_task=4).load()
    item = F.from_json("item", "o_orderkey long, o_totalprice double")
    return datasource.listing(read).select("page", "pos", item.alias("i")).select("page", "pos", "i.*")


@query("""select c_nationkey::string as root, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 20 + 1 as n, c_custkey from customer""")
def src_linked_source(spark, d):
    """Customers of each nation in pages of 20 that name their successor; the last names the first."""
    c = table(spark, d, "customer")
    n = F.expr("(row_number() over (partition by c_nationkey order by c_custkey) - 1) div 20")
    rows = c.select("c_nationkey", n.alias("n"), "c_custkey").groupBy("c_nationkey", "n").agg(F.array_sort(F.collect_list("c_custkey")).alias("value"))
    of = lambda m: F.when(m == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat_ws("-", "c_nationkey", m.cast("string")))
    last = F.expr("max(n) over (partition by c_nationkey)")
    rows = rows.select(of(F.col("n")).alias("address"), F.to_json(F.struct("value", F.when(F.col("n") < last, of(F.col("n") + 1)).otherwise(of(F.lit(0))).alias("next"))).alias("payload"))
    path = _serve(rows)
    roots = F.to_json(F.collect_list(F.col("n_nationkey").cast("string")))
    roots = table(spark, d, "nation").agg(roots).first()[0]  # the 25 nations
    read = spark.read.format("linked_pages").options(server=_SERVER, path=path, roots=roots).load()
    return read.filter("state = 'item'").select("root", "n", F.col("item").cast("long").alias("c_custkey"))


@query("""select s_suppkey as "offset", s_suppkey % 13 <> 0 as ok, case when s_suppkey % 13 <> 0 then s_name end as name from supplier""")
def src_offset_source(spark, d):
    """Suppliers by offset and limit in pages of 10; those of a thirteenth are corrupt, and so is any page that holds one."""
    s = table(spark, d, "supplier")
    s = s.select(F.col("s_suppkey").alias("at"), F.to_json(F.struct("s_name")).alias("row"), (F.col("s_suppkey") % 13 != 0).alias("ok"))
    whole = s.groupBy(F.expr("at div 10 * 10").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row", "ok"))), lambda x: F.when(x["ok"], x["row"]).otherwise("{broken")), ","), F.lit("]")).alias("payload"))
    one = s.select(F.concat("at", F.lit("-1")).alias("address"), F.concat(F.lit("["), F.when(F.col("ok"), F.col("row")).otherwise("{broken"), F.lit("]")).alias("payload"))
    path = _serve(whole.select(F.concat_ws("-", "start", "n").alias("address"), "payload").unionByName(one))
    rows = spark.read.format("offset_rows").options(server=_SERVER, path=path, total=s.count(), page=10, pages_per_task=2).load()
    return rows.select("offset", "ok", F.get_json_object("item", "$.s_name").alias("name"))


# --- transactional stores


@query("""select event_id, event_type, round(value + case event_type when 'click' then 11 when 'view' then 10 else 0 end, 6) as value from events""")
def snk_concurrent_writers(spark, d):
    """Three writers at once: one appends other types, one adds 1 to all clicks, one 10 to clicks and views. No change is lost."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    store = TransactionalStore(spark, new_path(spark, "store"), "event_type")
    known = F.col("event_type").isin("click", "view")
    store.append(e.filter(known))
    failed: list[BaseException] = []

    def guarded(write):
        def run():
            try:
                write()
            except BaseException as x:  # told after the threads have ended
                failed.append(x)

        return threading.Thread(target=run)

    more = lambda n: lambda rows: rows.withColumn("value", F.col("value") + n)
    writers = [guarded(lambda: store.append(e.filter(~known))), guarded(lambda: store.update(more(1), ["click"])), guarded(lambda: store.update(more(10), ["click", "view"]))]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    if failed:
        raise failed[0]
    return store.read().select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("select o_orderkey % 4 as batch, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1")
def snk_replayed_batches(spark, d):
    """Batches 0 to 3 of a writer, some of them again and out of turn: each counts once."""
    o, store = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("batch")), TransactionalStore(spark, new_path(spark, "store"))
    for batch in (0, 0, 1, 0, 1, 2, 3, 2, 3):
        store.append(o.filter(F.col("batch") == batch), "nightly", batch)
    return store.read().groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""select 'kept' as run, count(*) as n, sum(p_size)::bigint as size from part union all select 'rebuilt', count(*), sum(p_size)::bigint from part where p_size > 10""")
def snk_backup_rebuild(spark, d):
    """A rebuild that is not accepted leaves the store as it was; one that is replaces it."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    out = []
    for run, accept in (("kept", lambda df: df.filter("p_size <= 10").count() > 0), ("rebuilt", lambda df: not df.isEmpty())):
        store = TransactionalStore(spark, new_path(spark, "store"))
        store.append(p)
        rebuild_with_backup(store, lambda: p.filter("p_size > 10"), accept)
        out.append(store.read().agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size")))
    return out[0].unionByName(out[1])


# --- streams: the table arrives in parts, each of which is a batch, and the query starts anew for each


def _arriving(rows, parts: list, start) -> None:
    """Write the rows of each condition and run the stream over what is new."""
    spark = rows.sparkSession
    arrived, checkpoint = new_path(spark, "arrived"), new_path(spark, "progress")
    for part in parts:
        rows.filter(part).write.mode("append").parquet(arrived)
        running = start(spark.readStream.schema(rows.schema).parquet(arrived), checkpoint)
        running.awaitTermination()


@query("""select conv_id, turn, role, text from (select distinct conv_id, turn, role, text, dense_rank() over (partition by conv_id order by turn desc) as r from conversations) where r <= 20""")
def mon_message_windows(spark, d):
    """The last 20 messages of each conversation as list state, through three restarts."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    store = TransactionalStore(spark, new_path(spark, "store"))
    stamped = lambda batch, number: store.append(batch.withColumn("batch", F.lit(number).cast("long")), "windows", number)
    _arriving(turns, ["turn % 3 = 1", "turn % 3 = 0", "turn % 3 = 2"], lambda stream, checkpoint: messages.start(messages.last_messages(stream), stamped, checkpoint))
    windows = store.read().filter("event = 'window'")
    newest = windows.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return windows.join(newest, ["conv_id", "batch"]).select("conv_id", "turn", "role", "text")


@query("""with s as (select event_id % 3 as part, user_id as trace_id, event_type as name, value from events where event_type = 'error' and value < 20),
f as (select trace_id, min(part) as batch from s group by 1) select s.trace_id, min(value) as value, batch from s join f on s.trace_id = f.trace_id and s.part = f.batch group by 1, 3""")
def mon_poll_store(spark, d):
    """Low scores polled into a store: each trace once, with the lowest score of the first batch that had one; every batch is run twice."""
    scores = table(spark, d, "events").select("event_id", F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"), "value")
    store = TransactionalStore(spark, new_path(spark, "store"))
    once = polling.low_scores_once(store, "poll", "error", 20)

    def twice(batch, number):
        once(batch, number)
        once(batch, number)

    _arriving(scores, ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"], lambda stream, checkpoint: polling.poll(stream, twice, checkpoint))
    return store.read()


@query("""with e as (select event_id, ts, event_id % 3 as batch from events), m as (select a.batch, max(b.ts) as newest from (select distinct batch from e) a left join e b on b.batch < a.batch group by 1)
select event_id, coalesce(ts < newest - interval 2 day, false) as late from e join m using (batch)""")
def mon_late_rows(spark, d):
    """Rows over two days older than the newest of the earlier batches go to a store of their own."""
    e = table(spark, d, "events").select("event_id", "ts")
    on_time, late = (TransactionalStore(spark, new_path(spark, "store")) for _ in range(2))
    route = polling.route_late(on_time, late, "route", "2 days")
    _arriving(e, ["event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2"], lambda stream, checkpoint: polling.poll(stream, route, checkpoint))
    return on_time.read().select("event_id", F.lit(False).alias("late")).unionByName(late.read().select("event_id", F.lit(True).alias("late")))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as first from events),
s as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as n from e) select user_id, min(ts) as "start", max(ts) + interval 6 hour as "end", count(*) as n from s group by user_id, s.n""")
def mon_sessions(spark, d):
    return polling.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "6 hours")


# --- joins by time


@query("""with p as (select user_id, ts, event_id, value from events where event_type = 'purchase'), l as (select user_id, ts, max(event_id) as event_id, max_by(value, event_id) as value from events where event_type = 'click' group by 1, 2)
select p.event_id, p.value, l.event_id as click, case when l.event_id is not null then l.value end as click_value from p asof left join l on p.user_id = l.user_id and p.ts >= l.ts""")
def join_asof(spark, d):
    """Each purchase with the newest click of its user before it."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"), F.col("value").alias("click_value"))
    return timejoin.asof_join(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value"), clicks, "ts", ["user_id"], ["click", "click_value"], "click").drop("user_id", "ts")


@query("""select a.event_id as error, b.event_id as near from events a join events b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type <> 'error' and b.ts between a.ts - interval 3 hour and a.ts + interval 1 hour""")
def join_interval(spark, d):
    """Each error with what its user did from three hours before it to one hour after."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    pairs = timejoin.interval_join(e.filter("event_type = 'error'"), e.filter("event_type <> 'error'"), "ts", "user_id", 3 * 3600, 3600)
    return pairs.select(F.col("l.event_id").alias("error"), F.col("r.event_id").alias("near"))


# --- references


@query(r"""with p as (select page_id, url, regexp_extract(url, '^[^:/?#]+:', 0) as scheme, regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) as root, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, case page_id % 6 when 0 then root || '/x/y' when 1 then root || regexp_replace(path, '[^/]*$', '') || 'a?b=1#c' when 2 then root || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'up'
 when 3 then scheme || '//other.example/z' when 4 then root || path || '?q=2' else root || regexp_replace(path, '[^/]*$', '') || 'k/' end as link from p where path like '/%/%'""")
def sca_urljoin(spark, d):
    p = table(spark, d, "pages").filter(F.regexp_extract("url", "^[^:/?#]+://[^/?#]*([^?#]*)", 1).like("/%/%"))
    k = F.col("page_id") % 6
    ref = F.when(k == 0, "/x/./y").when(k == 1, "a?b=1#c").when(k == 2, "../up").when(k == 3, "//other.example/z").when(k == 4, "?q=2").otherwise("j/../k/.")
    return p.select("page_id", urls.resolve(F.col("url"), ref).alias("link"))


# --- files, maps, sketches, table functions


@query("""with f as (select lang || '-' || source as file_name, max(length(text)) as longest, count(*) as n from documents group by 1)
select file_name, n as n_chunks, longest <= 25000 as stored, case when longest <= 25000 then n else 1 end as n_now from f""")
def snk_store_files(spark, d):
    """Texts as chunks of files, one for each language and source. A text over 25,000 characters can't be embedded: its file keeps its one old chunk."""
    docs = table(spark, d, "documents").select(F.concat_ws("-", "lang", "source").alias("file_name"), "text")
    store = TransactionalStore(spark, new_path(spark, "store"))
    store.append(docs.select("file_name").distinct().select("file_name", F.lit("old").alias("text"), F.array(F.lit(0.0)).alias("embedding")))

    def embed(text):
        if len(text) > 25_000:
            raise ValueError("too long for the model")
        return [len(text), text.count(" ")]

    log = ingest.store_files(store, docs, embed)
    now = store.read().groupBy("file_name").agg(F.count(F.lit(1)).alias("n_now"))
    return log.join(now, "file_name").select("file_name", "n_chunks", (F.col("status") == "stored").alias("stored"), "n_now")


@query("select count(distinct conv_id) + 1 as n_users, count(*) as n_messages from conversations")
def agg_user_maps(spark, d):
    """Stored maps of up to five users each, and one of a user without messages."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    entry = F.concat(F.lit('"u'), F.col("conv_id").cast("string"), F.lit('":{"messages":'), "m", F.lit("}"))
    maps = c.groupBy(F.expr("conv_id div 5").alias("g")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("payload")).select("payload")
    return ingest.stored_conversations(maps.unionByName(table(spark, d, "region").agg(F.lit('{"silent":{}}').alias("payload"))))


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'size ' || p_size else p_type end as kind, case when p_partkey % 2 = 0 then p_name else 'none' end as name, p_brand as brand, case when p_partkey % 2 = 0 then 3 else 2 end as n from part""")
def sca_map_merge(spark, d):
    lit = F.lit
    first = F.create_map(lit("brand"), F.col("p_brand"), lit("kind"), F.col("p_type"))
    then = F.when(F.col("p_partkey") % 2 == 0, F.create_map(lit("kind"), F.concat(lit("size "), F.col("p_size").cast("string")), lit("name"), F.col("p_name")))
    both = table(spark, d, "part").select("p_partkey", ingest.merged(first, then).alias("m"))
    return both.select("p_partkey", *[ingest.get_or(F.col("m"), lit(k), lit("none")).alias(k) for k in ("kind", "name", "brand")], F.size("m").alias("n"))


@query("select event_type, count(*) as n, true as ids_close, true as median_close from events group by 1")
def mon_merged_sketches(spark, d):
    """Daily polls of each type merged over all days, held against exact distinct users and the exact rank of the median, within three deviations."""
    e = table(spark, d, "events")
    merged = sketches.merged(sketches.polled(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value"), ["event_type"])
    merged = merged.select("event_type", "n", sketches.n_ids().alias("ids"), sketches.quantile(0.5).alias("median"))
    rank = F.avg((F.col("value") <= F.col("median")).cast("double"))
    exact = e.join(merged.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), rank.alias("rank"))
    near = F.abs(F.col("ids") - F.col("users")) <= F.greatest(F.lit(0.5), 3 * sketches.ID_ERROR * F.col("users"))
    return merged.join(exact, "event_type").select("event_type", "n", near.alias("ids_close"), (F.abs(F.col("rank") - 0.5) <= 3 * sketches.RANK_ERROR).alias("median_close"))


@query("""select 'https://h.example/p/' || p_partkey || '?x=1' as url, 'faq' as kind, 'Which type does the part named ' || p_name || ' have?' as head, 'It is of type ' || p_type || ', as listed.' as body from part
union all select 'https://h.example/p/' || p_partkey || '?x=1', 'table', 'Feature/Yes or no', p_brand || '/' || p_size from part
union all select 'https://h.example/p/' || p_partkey || '?x=1', 'section', p_brand, 'of type ' || p_type from part""")
def ext_table_functions(spark, d):
    udtfs.register(spark)
    made = _html_pages(spark, d)
    notes = table(spark, d, "part").select(F.concat(F.lit("https://h.example/p/"), F.col("p_partkey").cast("string"), F.lit("?x=1")).alias("url"), F.concat(F.lit("\n## "), "p_brand", F.lit(" ##\n\nof type "), "p_type", F.lit("\n")).alias("note"))
    return spark.sql("""select p.url, 'faq' as kind, t.question as head, t.answer as body from {pages} p, lateral page_faqs(p.html) t
        union all select p.url, 'table', array_join(t.headers, '/'), array_join(flatten(t.cells), '/') from {pages} p, lateral page_tables(p.html) t
        union all select p.url, 'section', t.heading, t.body from {notes} p, lateral page_sections(p.note) t""", pages=made, notes=notes)


@query("""with p as (select p_size, p_partkey, p_name, row_number() over (partition by p_size order by p_partkey) as n from part)
select 'http://h.example/posts?size=' || p_size || case when p_size % 5 = 0 then '&per_page=25&page=1' else '&per_page=20' end as url, count(*) as n_posts, string_agg(p_name, chr(10) || chr(10) order by n) as text
from p where (p_size % 5 > 0 or n <= 25) and p_partkey % 7 <> 0 group by p_size""")
def src_web_listing(spark, d):
    """Posts of each part size, 25 a page: addresses that name a page are read alone, the others page by page to the end; posts of a seventh have no contents."""
    p = table(spark, d, "part")
    n = F.expr("(row_number() over (partition by p_size order by p_partkey) - 1) div 25 + 1")
    post = F.when(F.col("p_partkey") % 7 != 0, F.to_json(F.struct(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("rendered")).alias("content")))).otherwise('{"id":0}')
    bodies = p.select("p_size", n.alias("n"), "p_partkey", post.alias("post")).groupBy("p_size", "n").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "post"))), lambda x: x["post"]), ","), F.lit("]")).alias("payload"))
    address = F.concat(F.lit("http://h.example/posts?size="), F.col("p_size").cast("string"), F.lit("&per_page=25&page="), F.col("n").cast("string"))
    path = _serve(bodies.select(address.alias("address"), "payload"))
    url = F.concat(F.lit("http://h.example/posts?size="), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, "&per_page=25&page=1").otherwise("&per_page=20"))
    # A list of sites, as a configuration has them: one for each of the 50 sizes.
    urls_ = p.select("p_size").distinct().agg(F.to_json(F.collect_list(url)), F.count(F.lit(1))).first()[0]
    last = bodies.agg(F.max("n")).first()[0] + 1
    rows = spark.read.format("web_listing").options(server=_SERVER, path=path, urls=urls_, last=last, per_page=25, pages_per_task=20).load()
    return datasource.joined_posts(datasource.listing(rows))


@query("""with recursive m as (select max(c_custkey) + 1 as n from customer), e as (select distinct o_custkey as src, (o_custkey * 5 + o_orderkey % 7) % n as dst from orders, m),
f as (select src, dst from (select *, row_number() over (partition by src order by dst) as n from e) where n <= 2),
w(node, depth) as (select c_custkey, 0 from customer where c_custkey < 3 union select f.dst, depth + 1 from w join f on f.src = w.node where depth < 4)
select node, min(depth)::int as depth from w group by node""")
def crawl_children_limit(spark, d):
    """A walk over a graph of all customers from three roots, two children a page, to depth 4."""
    c = table(spark, d, "customer")
    n = c.agg(F.max("c_custkey") + 1).first()[0]
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 5 + F.col("o_orderkey") % 7) % n).alias("dst")).distinct()
    return crawl.walk(edges, c.filter("c_custkey < 3").select(F.col("c_custkey").alias("node")), 4, 2)


@query("select p_type, count(*) as n from part where p_size > 25 group by 1")
def agg_type_counts(spark, d):
    rows = table(spark, d, "part").withColumn("source_type", F.when(F.col("p_size") > 25, "files").otherwise("web"))
    return audit.type_counts(rows, "p_type", "files")


@query("""select count(*) as n_pages, 3 * count(*) as n_documents, count(*) as n_faq, count(*) as n_table, count(*) as n_text,
sum(length('Q: Which type does the part named ' || p_name || ' have?') + 2 + length('A: It is of type ' || p_type || ', as listed.') + length('Table: Table 1') + 1 + length('Headers: Feature, Yes or no') + 1 + length('Row 1: ' || p_brand || ' | ' || p_size)
 + length('Which type does the part named ' || p_name || ' have? It is of type ' || p_type || ', as listed. Feature Yes or no ' || p_brand || ' ' || p_size || ' tail'))::bigint as chars from part""")
def agg_crawl_summary(spark, d):
    return audit.crawl_summary(pages.page_documents(_html_pages(spark, d)))


@query("""with p as (select doc_id, text, greatest(ceil((length(text) - 300) / 1200.0), 1)::int as n from documents where length(text) > 0),
c as (select doc_id, text, unnest(range(n))::int as i from p) select doc_id, row_number() over (order by doc_id, i) - 1 as chunk_index, count(*) over () as total_chunks, md5(substring(text, i * 1200 + 1, 1500)) as digest from c""")
def chunk_batch_index(spark, d):
    """Chunks of all documents, numbered over the whole batch."""
    return composition.renumbered(text.chunk_fixed(table(spark, d, "documents")), "doc_id", "chunk_index").select("doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("digest"))
