"""Registered queries of sources and sinks: rows of the driver tables are written in a format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import artifacts, quality, registry, relational
from strandline.plans.catalog import NO_WWW, pages_with_host, query, table
from strandline.sources import readers, scratch, sinks, warc
from strandline.streaming import logs


@query("""
SELECT user_id, arg_max(event_type, struct_pack(a := event_type, b := event_id)) AS event_type, arg_max(event_id, struct_pack(a := event_type, b := event_id)) AS event_id, count(*) AS n
FROM events WHERE value >= 20 GROUP BY 1""")
def json_lines_last(spark: SparkSession, d: str) -> DataFrame:
    """Lines of several files in order, broken ones left out; the last one of each key."""
    path = scratch.folder(spark, "lines")
    line = F.when(F.col("value") >= 20, F.to_json(F.struct("user_id", "event_type", "event_id"))).otherwise(F.concat(F.lit('{"user_id": '), "user_id"))
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("file"), line.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(path)
    read = readers.json_lines(spark, f"{path}/*", "user_id bigint, event_type string, event_id bigint")
    return relational.argmax_by(read.drop("file"), "user_id", [F.col("ordinal")], {"n": F.count("*")}).select("user_id", "event_type", "event_id", "n")


@query("SELECT c_custkey::VARCHAR AS asn, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer")
def keyed_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """One object in an envelope, compressed, written and read."""
    path = scratch.folder(spark, "keyed")
    rows = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment")).alias("v"))
    sinks.keyed_json_object(rows, path, "c_custkey", "v", F.struct(F.lit("customers").alias("of")), gzip=True)
    return readers.keyed_json_or_empty(spark, path, "struct<name:string,segment:string>").select("asn", "value.*")


@query("""SELECT c_custkey::VARCHAR AS asn, c_name || ', "' || c_mktsegment || '"' AS name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey || '.example.org' END AS domain FROM customer""")
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table with a header, quotes and commas."""
    path = scratch.folder(spark, "csv")
    name = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    domain = F.when(F.col("c_nationkey") >= 5, F.concat("c_nationkey", F.lit(".example.org")))
    sinks.csv(table(spark, d, "customer").select(F.lit("1").alias("start_ip"), F.lit("2").alias("end_ip"), F.col("c_custkey").alias("asn"), name.alias("name"), domain.alias("domain")), path)
    return readers.ipinfo(spark, path).select("asn", "name", "domain")


_ALIAS = "CASE p_type WHEN 'ECONOMY' THEN 'arin' WHEN 'LARGE' THEN 'ripe' WHEN 'SMALL' THEN 'apnic' ELSE 'other' END"


@query(f"""
SELECT n::VARCHAR AS asn, {_ALIAS} AS rir, upper(left(p_brand, 2)) AS cc FROM (SELECT *, unnest(range(p_partkey * 100, p_partkey * 100 + p_size)) AS n FROM part WHERE p_retailprice >= 910 AND p_size > 0)""")
def statistics_lines(spark: SparkSession, d: str) -> DataFrame:
    """A registry's statistics; reserved blocks and comments left out."""
    name = F.expr("CASE p_type WHEN 'ECONOMY' THEN 'arin' WHEN 'LARGE' THEN 'ripencc' WHEN 'SMALL' THEN 'apnic' ELSE 'new' END")
    status = F.when(F.col("p_retailprice") >= 910, "allocated").otherwise("reserved")
    line = F.concat_ws("|", name, F.lower(F.substring("p_brand", 1, 2)), F.lit("asn"), (F.col("p_partkey") * 100).cast("string"), F.col("p_size").cast("string"), F.lit("20200101"), status, F.lit("x"))
    part = table(spark, d, "part")
    lines = part.select(line.alias("value")).unionByName(part.select(F.concat(F.lit("# "), line).alias("value"))).unionByName(part.select(F.concat(F.lit("arin|"), "p_name").alias("value")))
    path = scratch.folder(spark, "statistics")
    lines.write.text(path)
    return readers.delegated(spark.read.text(path), ["allocated", "assigned"], "other").select("asn", "rir", "cc")


@query("""
SELECT s_suppkey::VARCHAR AS asn, s_name AS as_name, 'ORG-' || s_nationkey AS org_id, CASE WHEN s_nationkey < 20 THEN n_name END AS org_name, CASE WHEN s_nationkey < 20 THEN lower(n_name) || '.example|r' || n_regionkey || '.example' ELSE '' END AS domains
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def register_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of fields, numbers with the domains of their organisations' addresses."""
    own = table(spark, d, "supplier").select(F.concat(F.lit("aut-num:  AS"), "s_suppkey", F.lit("\nas-name: "), "s_name", F.lit("\norg: ORG-"), "s_nationkey", F.lit("\n")).alias("value"))
    mail = F.concat(F.lit("\ne-mail: x@"), "n_name", F.lit(".example\ne-mail: y@r"), "n_regionkey", F.lit(".example\ne-mail: z@r"), "n_regionkey", F.lit(".EXAMPLE\ne-mail: none\n"))
    orgs = table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("organisation: ORG-"), "n_nationkey", F.lit("\norg-name: "), "n_name", mail).alias("value"))
    path = scratch.folder(spark, "blocks")
    own.unionByName(orgs).write.text(path)
    return readers.autnum_domains(readers.blocks(spark, path)).withColumn("domains", F.array_join("domains", "|"))


@query("""
SELECT c_custkey::VARCHAR AS asn, coalesce(array_to_string(list_sort(list(DISTINCT lower(s_name) || '.example') FILTER (WHERE s_name IS NOT NULL)), '|'), '') AS domains
FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > 0 GROUP BY c_custkey""")
def handle_chain(spark: SparkSession, d: str) -> DataFrame:
    """Numbers to organisations to handles to domains of mailboxes."""
    s = table(spark, d, "supplier")
    orgs = s.groupBy(F.col("s_nationkey").cast("string").alias("org_id")).agg(F.collect_list(F.concat(F.lit("H"), "s_suppkey")).alias("handles"))
    mail = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("x@"), F.upper("s_name"), F.lit(".Example"))).otherwise("no address")
    contacts = s.select(F.concat(F.lit("H"), "s_suppkey").alias("handle"), F.array(mail, mail).alias("mailboxes"))
    asns = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("asn"), F.col("c_nationkey").cast("string").alias("org_id"))
    return readers.handle_domains(asns, orgs, contacts).withColumn("domains", F.array_join("domains", "|"))


@query("""
WITH n AS (SELECT floor(s_acctbal)::BIGINT % 40 AS asn, arg_min(struct_pack(own := CASE WHEN s_acctbal > 5000 THEN 'http://own' || s_suppkey END, org := s_nationkey), s_suppkey) AS f FROM supplier WHERE s_acctbal >= 0 GROUP BY 1)
SELECT asn::VARCHAR AS asn, CASE WHEN f.own IS NULL THEN '' ELSE f.own || '|' END || 'https://' || lower(n_name) || '.example' AS websites FROM n JOIN nation ON n_nationkey = f.org""")
def peering_dump(spark: SparkSession, d: str) -> DataFrame:
    """A dump with nested lists; the first network of a number counts."""
    site = F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example"))
    org = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") < 12, F.concat(F.lit("x "), site, F.lit(" y"))).otherwise("x").alias("name"), F.when(F.col("n_nationkey") >= 12, site).otherwise("").alias("website"), F.lit("").alias("aka"), F.lit("US").alias("country")).alias("o"))
    own = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("http://own"), "s_suppkey")).otherwise("")
    net = table(spark, d, "supplier").where("s_acctbal >= 0").select("s_suppkey", F.struct((F.floor("s_acctbal").cast("long") % 40).alias("asn"), F.col("s_nationkey").cast("long").alias("org_id"), own.alias("website")).alias("n"))
    nets = net.agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "n"))), lambda x: x["n"]).alias("data"))  # a dump is one object, of some thousand networks
    path = scratch.folder(spark, "dump")
    org.agg(F.collect_list("o").alias("data")).select(F.struct("data").alias("org")).join(F.broadcast(nets.select(F.struct("data").alias("net")))).write.json(path)
    return readers.peering(spark, path).withColumn("websites", F.array_join("websites", "|"))


@query("SELECT url, row_number() OVER (ORDER BY url) AS n FROM (SELECT DISTINCT trim(url) AS url FROM pages UNION SELECT 'www.' || lower(n_name) || '.example' FROM nation)")
def seed_lists(spark: SparkSession, d: str) -> DataFrame:
    """Seeds as lines, as a list and as an object, distinct and sorted."""
    path, pages = scratch.folder(spark, "seeds"), table(spark, d, "pages")
    pages.select(F.concat(F.lit(" "), "url", F.lit(" ")).alias("value")).union(spark.createDataFrame([("# comment",), ("",)], "value string")).write.text(f"{path}/a")
    pages.agg(F.to_json(F.collect_list("url")).alias("value")).write.text(f"{path}/b")
    table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(F.concat(F.lit("www."), F.lower("n_name"), F.lit(".example"))).alias("urls"))).alias("value")).write.text(f"{path}/c")
    found = readers.seeds(spark, f"{path}/*")
    return found.select("url", F.row_number().over(Window.orderBy("url")).cast("long").alias("n"))


@query(f"""
WITH p AS (SELECT {NO_WWW} AS host, 'AS' || {NO_WWW} AS asn, url, page_id FROM pages), f AS (SELECT asn, arg_min(url, page_id) AS seed, count(*) AS n FROM p GROUP BY 1)
SELECT asn, lower(regexp_replace(regexp_replace(seed, '^[^:/?#]*://', ''), '/+$', '')) AS seed, substr(asn, 3) AS host, n FROM f""")
def site_mapping_rows(spark: SparkSession, d: str) -> DataFrame:
    """A mapping file of numbers to URLs, and the tables derived from it."""
    pages = pages_with_host(spark, d).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]).alias("urls"))
    path = scratch.folder(spark, "mapping")
    sinks.keyed_json_object(pages.select(F.concat(F.lit("AS"), "host").alias("asn"), "urls"), path, "asn", "urls", F.struct(F.lit(1).alias("v")))
    mapping = readers.site_mapping(spark, path)
    found = readers.site_lookups(mapping)
    counts = mapping.groupBy("asn").agg(F.count("*").alias("n"))
    return found["seed"].join(found["expected"], "asn").join(counts, "asn").join(found["sharers"].select("seed"), "seed").select("asn", "seed", F.col("hosts")[0].alias("host"), "n")


@query("SELECT page_id, sha256(html) AS html_sha256, octet_length(encode(html)) AS bytes, url, true AS in_place FROM pages")
def archive_places(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as archives, indexed by a scan, and read at their places."""
    path = scratch.folder(spark, "archives")
    pages = table(spark, d, "pages").select(F.concat(F.lit("urn:"), "page_id").alias("record_id"), F.lit("resource").alias("type"), F.col("url").alias("uri"), F.lit("2024-01-01T00:00:00Z").alias("day"), F.col("html").cast("binary").alias("payload"))
    written = warc.write(pages.repartition(2), path, max_records=300)
    scanned = warc.offset_index(warc.scan(spark, f"{path}/*.warc.gz"))
    found = warc.seek(spark, scanned)
    places = written.select(F.regexp_extract("warc", "[^/]*$", 0).alias("w"), F.col("record_id").alias("r"), F.col("offset").alias("o"), F.col("gzlen").alias("g"))
    met = found.join(places, F.col("record_id") == F.col("r"), "left")
    same = (F.regexp_extract("warc", "[^/]*$", 0) == F.col("w")) & (F.col("offset") == F.col("o")) & (F.col("gzlen") == F.col("g"))
    return met.select(F.substring("record_id", 5, 20).cast("long").alias("page_id"), F.sha2("payload", 256).alias("html_sha256"), F.length("payload").cast("long").alias("bytes"), F.col("uri").alias("url"), same.alias("in_place"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events) GROUP BY 1, 2")
def stream_first(spark: SparkSession, d: str) -> DataFrame:
    """A log tailed as a stream, equal content counted once, what was read remembered."""
    path = scratch.folder(spark, "stream")
    rows = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    rows.repartition(4, "user_id").write.json(f"{path}/in")

    def append(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={k}")

    seen = logs.first_of_content(logs.tail(spark, f"{path}/in", rows.schema.simpleString()[7:-1].replace(":", " "), 2), ["user_id", "event_type", "day"])
    logs.run_available(seen, append, f"{path}/mark").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, arg_max(l_shipdate::DATE, struct_pack(a := l_linenumber, b := l_shipdate::DATE))::VARCHAR AS day, max(l_linenumber) AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def upserted_states(spark: SparkSession, d: str) -> DataFrame:
    """Batches folded into a table of latest states."""
    path = scratch.folder(spark, "states")
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    rows = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").cast("string").alias("day"), "l_returnflag")
    for flag in ("N", "A", "R"):
        logs.upsert_latest(rows.where(F.col("l_returnflag") == flag).drop("l_returnflag"), path, "o_orderkey", "line")
    return logs.latest_table(spark, path).select("o_orderkey", "day", "line")


@query("""
SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'new' WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'broken' WHEN o_orderpriority = '1-URGENT' THEN 'changed' END AS why
FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_totalprice > 300000) OR o_orderpriority = '1-URGENT'""")
def files_to_check(spark: SparkSession, d: str) -> DataFrame:
    """Files without an unchanged, healthy state."""
    o = table(spark, d, "orders")
    why = F.expr("CASE WHEN o_orderstatus = 'P' THEN 'new' WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'broken' WHEN o_orderpriority = '1-URGENT' THEN 'changed' END")
    files = o.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("length"), F.col("o_orderdate").alias("modificationTime"), why.alias("why"))
    state = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") + (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("length"), F.col("o_orderdate").alias("modificationTime"), F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000), "broken").otherwise("ok").alias("status"))
    return quality.needs_check(files, state).select("path", "why")


@query("SELECT DISTINCT upper(c_mktsegment) AS asn, 'ORG-' || c_nationkey AS org FROM customer WHERE c_nationkey % 5 <> 0 UNION ALL SELECT NULL, NULL WHERE false")
def organisation_list(spark: SparkSession, d: str) -> DataFrame:
    """Records of type ASN without placeholder organisations."""
    c = table(spark, d, "customer")
    org = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("x"), "c_nationkey", F.lit("@aut-as"))).otherwise(F.concat(F.lit(" org-"), "c_nationkey"))
    rows = c.select(F.lit("asn").alias("type"), F.concat(F.lit(" as"), F.lower("c_mktsegment")).alias("asn"), org.alias("org")).union(c.select(F.lit("net"), "c_name", F.lit("ORG")))
    return registry.organisation_handles(rows)


@query(f"""
SELECT host, sha256(string_agg(url, chr(10) || chr(10) ORDER BY page_id) || chr(10)) AS text_sha256 FROM (SELECT {NO_WWW} AS host, url, page_id FROM pages) GROUP BY 1""")
def site_files(spark: SparkSession, d: str) -> DataFrame:
    """One text file a site, its pages in order."""
    path = scratch.folder(spark, "sites")
    sinks.site_texts(pages_with_host(spark, d).select("host", "url", "page_id"), path, "host", "url", "page_id")
    return spark.read.option("basePath", path).text(f"{path}/*", wholetext=True).select("host", F.sha2("value", 256).alias("text_sha256"))


@query("""
WITH p AS (SELECT o_orderpriority || '/' || o_orderstatus || '/' || o_custkey AS prompt_id, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1) SELECT prompt_id, n FROM p ORDER BY first LIMIT 200""")
def prompt_dump(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in the order of their smallest number, the first of them, compressed."""
    path = scratch.folder(spark, "prompts")
    prompt = F.concat_ws("/", "o_orderpriority", "o_orderstatus", "o_custkey")
    prompts = table(spark, d, "orders").groupBy(prompt.alias("prompt_id")).agg(F.collect_list(F.concat(F.lit("AS"), "o_orderkey")).alias("asns"))
    artifacts.prompt_dump(prompts, path, 200)
    return spark.read.schema("prompt_id string, asns array<string>").json(path).select("prompt_id", F.size("asns").cast("long").alias("n"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-01') AS day, 'snapshot_' || strftime(o_orderdate, '%Y%m01') || '.json' AS file FROM orders")
def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Files found by the date in their names."""
    path = scratch.folder(spark, "snapshots")
    months = table(spark, d, "orders").select(F.concat(F.lit("snapshot_"), F.date_format("o_orderdate", "yyyyMM"), F.lit("01.json")).alias("name")).distinct().withColumn("value", F.lit("{}"))
    months.repartition("name").write.partitionBy("name").text(path)
    found = readers.snapshots(spark, f"{path}/name=*")
    return found.select(F.col("day").cast("string").alias("day"), F.regexp_extract("path", "name=([^/]*)", 1).alias("file"))
