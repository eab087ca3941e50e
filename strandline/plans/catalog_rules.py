"""Registered queries of rules, contracts, routing and linkage beyond those in ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import responses, texts, urls
from strandline.operators import artifacts, crawl, quality, registry, relational, routing
from strandline.plans import labels, website
from strandline.plans.catalog import _STRIP, HOST, NO_WWW, pages_with_host, query, table
from strandline.sources import warc

# Hosts and names


@query(f"""
WITH h AS (SELECT DISTINCT {NO_WWW} AS host FROM pages)
SELECT host, CASE WHEN ends_with(host, '.example.org') THEN regexp_extract(host, '([^.]+\\.example\\.org)$', 1) WHEN host = 'example.org' THEN host ELSE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END AS registrable, 'example' AS sld FROM h""")
def public_suffix(spark: SparkSession, d: str) -> DataFrame:
    """registrable domains and grouping labels by a table of suffixes."""
    suffixes = spark.createDataFrame([("com",), ("net",), ("org",), ("example.org",), ("co.za",)], "suffix string")
    hosts = website.with_public_suffix(pages_with_host(spark, d).select("host").distinct(), "host", suffixes)
    s = F.col("public_suffix")
    return hosts.select("host", website.registrable(F.col("host"), s).alias("registrable"), website.sld_label(F.col("host"), s).alias("sld"))


@query("""
WITH c AS (SELECT c_custkey::VARCHAR AS asn, CASE c_nationkey % 3 WHEN 0 THEN 'arin' WHEN 1 THEN 'apnic' ELSE 'ripe' END AS rir, * FROM customer)
SELECT asn, 'whois' AS source, lower(c_mktsegment) || '.com' AS domain FROM c WHERE rir <> 'ripe' UNION SELECT asn, 'peering', 'p' || c_nationkey || '.org' FROM c WHERE c_acctbal > 5000 UNION SELECT asn, 'ip', 'ip' || c_nationkey || '.net' FROM c WHERE c_acctbal < 0""")
def gathered_domains(spark: SparkSession, d: str) -> DataFrame:
    """What the sources say about each number of a registry, whois by its own registry."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("asn"), F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'arin' WHEN 1 THEN 'apnic' ELSE 'ripe' END").alias("rir"), "c_mktsegment", "c_nationkey", "c_acctbal")
    whois = c.select(F.when(F.col("rir") == "ripe", "arin").otherwise(F.col("rir")).alias("rir"), "asn", F.array(F.concat("c_mktsegment", F.lit(".com")), F.concat(F.lit("http://www."), "c_mktsegment", F.lit(".COM/"))).alias("domains"))
    peering = c.where("c_acctbal > 5000").select("asn", F.array(F.concat(F.lit("https://p"), "c_nationkey", F.lit(".org/"))).alias("websites"))
    located = c.where("c_acctbal < 0").select("asn", F.concat(F.lit("ip"), "c_nationkey", F.lit(".net")).alias("domain"))
    info = c.select("rir", "asn", F.lit("n").alias("as_name"), F.lit("o").alias("org"), F.lit("d").alias("descr"))
    return website.gathered(c.select("asn", "rir"), whois, peering, located, info, info.drop("rir").limit(0))[0].select("asn", "source", "domain")


@query("""
WITH c AS (SELECT c_custkey::VARCHAR AS asn, CASE WHEN c_nationkey % 2 = 0 THEN 'apnic' ELSE 'arin' END AS rir, * FROM customer)
SELECT asn, CASE WHEN rir = 'apnic' AND c_acctbal > 3000 THEN 'J' || c_custkey ELSE c_name END AS as_name, CASE WHEN rir = 'apnic' AND c_acctbal > 3000 THEN 'national' WHEN c_mktsegment = 'BUILDING' THEN 'descr' ELSE c_mktsegment END AS org_name FROM c""")
def gathered_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by registry, the national registry preferred for one of them."""
    c = table(spark, d, "customer").select("*", F.col("c_custkey").cast("string").alias("asn"), F.expr("CASE WHEN c_nationkey % 2 = 0 THEN 'apnic' ELSE 'arin' END").alias("rir"))
    info = c.select("rir", "asn", F.col("c_name").alias("as_name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("org"), F.lit("descr").alias("descr"))
    national = c.where("c_acctbal > 3000").select("asn", F.concat(F.lit("J"), "c_custkey").alias("as_name"), F.lit("national").alias("org"), F.lit(None).cast("string").alias("descr"))
    none = c.select("asn").limit(0)
    return website.gathered(c.select("asn", "rir"), none.select(F.lit("x").alias("rir"), "asn", F.array(F.lit("x")).alias("domains")), none.select("asn", F.array(F.lit("x")).alias("websites")), none.select("asn", F.lit("x").alias("domain")), info, national)[1]


@query("""
SELECT c_custkey, lower(c_mktsegment) || '.example' AS domain, c_custkey::VARCHAR AS number, c_name AS brand, CASE WHEN c_acctbal > 0 THEN 'http://n' || c_nationkey || '.example' END AS org_url,
  CASE WHEN c_nationkey < 5 THEN NULL ELSE 'https://n' || c_nationkey || '.example/p' END AS answer, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE 'line ' || c_nationkey END AS first_line FROM customer""")
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, numbers, brands, URLs in names and raw answers."""
    n = F.col("c_nationkey").cast("string")
    mail = F.concat(F.lit("x@y@"), "c_mktsegment", F.lit(".Example "))
    org = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Org at http://n"), n, F.lit(".example now"))).otherwise(F.col("c_mktsegment"))
    answer = F.when(F.col("c_nationkey") >= 5, F.concat(F.lit("Found: (https://n"), n, F.lit(".example/p),")))
    said = F.when(F.col("c_nationkey") % 4 == 0, "`No match.`").otherwise(F.concat(F.lit("`line "), n, F.lit("`\nmore")))
    return table(spark, d, "customer").select(
        "c_custkey", texts.email_domain(mail).alias("domain"), texts.asn_label(F.concat(F.lit(" as"), "c_custkey")).alias("number"), texts.brand(F.concat("c_name", F.lit(", Ltd. GmbH"))).alias("brand"),
        urls.blank_to_null(F.regexp_extract(org, r"((?:https?://|www\.)[^ \t]+)", 1)).alias("org_url"), urls.trim_tail(answer).alias("answer"), F.regexp_replace(texts.first_line_or_no_match(said), "`$", "").alias("first_line"),
    )


@query("""
SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, strftime(o_orderdate, '%Y-%m-%d') || ' 01:02:03' AS at, CASE WHEN o_orderdate::DATE >= DATE '2000-01-01' THEN 'current' ELSE 'legacy' END AS contract FROM orders""")
def dates(spark: SparkSession, d: str) -> DataFrame:
    """Days and times in several forms, contracts by date."""
    form = lambda f: F.date_format("o_orderdate", f)
    day = F.when(F.col("o_orderstatus") == "P", form("yyyyMMdd")).when((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") >= 2000), form("yyMMdd")).otherwise(form("yyyy-MM-dd"))
    at = F.when(F.col("o_orderstatus") == "P", F.concat(form("yyyy-MM-dd"), F.lit("T01:02:03Z"))).when(F.col("o_orderstatus") == "F", F.concat(form("yyyy-MM-dd"), F.lit("T03:02:03+02:00"))).otherwise(F.concat(form("yyyy-MM-dd"), F.lit(" 01:02:03")))
    moved = F.add_months(F.to_date("o_orderdate"), 12 * 26 + 8)  # the contract changes in 2026-09
    tag = F.concat(F.lit("snapshot_"), F.date_format(moved, "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", texts.parse_date(day).cast("string").alias("day"), F.date_format(texts.parse_timestamp(at), "yyyy-MM-dd HH:mm:ss").alias("at"), routing.contract_for(tag).alias("contract"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, (l_partkey % 256) AS a, (l_suppkey * 37 % 256) AS b, (l_linenumber * 50 % 256) AS c FROM lineitem),
x AS (SELECT l_orderkey, a = 0 OR a = 10 OR a = 127 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0 AND NOT false) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224 AS special FROM l)
SELECT o_orderkey, coalesce(NOT bool_or(special), false) AS public FROM orders LEFT JOIN x ON o_orderkey = l_orderkey GROUP BY 1""")
def public_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts all of whose recorded addresses are public."""
    ip = F.concat_ws(".", F.col("l_partkey") % 256, F.col("l_suppkey") * 37 % 256, F.col("l_linenumber") * 50 % 256, F.lit(77))
    seen = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(ip).alias("ips"))
    rows = table(spark, d, "orders").select("o_orderkey").join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return urls.with_public(rows, "ips", "public").select("o_orderkey", "public")


@query("SELECT doc_id, n_name, contains(lower(text), lower(left(n_name, 2))) AS mentioned FROM documents, nation WHERE n_nationkey = doc_id % 25")
def brand_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Articles that name the brand."""
    rows = table(spark, d, "documents").join(table(spark, d, "nation"), F.col("doc_id") % 25 == F.col("n_nationkey"))
    return rows.select("doc_id", "n_name", texts.mentions(F.col("text"), F.concat(F.substring("n_name", 1, 2), F.lit(", Inc."))).alias("mentioned"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'not_organisation' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'other_subject' END, CASE WHEN o_orderstatus = 'P' THEN 'no_type' END, CASE WHEN o_totalprice / 500000 < 0.34 THEN 'title_differs' END], lambda x: x IS NOT NULL), '|') AS reasons FROM orders""")
def organisation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a found article isn't about the organisation."""
    desc = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'internet company' WHEN '5-LOW' THEN 'family name' ELSE 'thing' END")
    props = F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("P452")))
    types = F.when(F.col("o_orderstatus") != "P", F.array(F.lit("Q1")))
    reasons = labels.organisation_reasons(desc, types, props, F.col("o_totalprice") / 500000, ["P452"], "company|provider", "family name|given name")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(reasons, "|").alias("reasons"))


@query("""
WITH v AS (SELECT l_orderkey, l_returnflag AS variant, l_returnflag = 'A' AS strict, count(*) AS subpages, max(l_partkey % 700) AS landing FROM lineitem GROUP BY ALL),
s AS (SELECT * FROM v WHERE strict), o AS (SELECT * FROM v WHERE NOT strict QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY subpages DESC, landing DESC, variant DESC) = 1)
SELECT coalesce(s.l_orderkey, o.l_orderkey) AS l_orderkey, CASE WHEN s.l_orderkey IS NOT NULL AND (o.l_orderkey IS NULL OR s.landing >= 400 OR o.landing < s.landing + 200) THEN s.variant ELSE o.variant END AS variant FROM s FULL JOIN o ON s.l_orderkey = o.l_orderkey""")
def variant_winner(spark: SparkSession, d: str) -> DataFrame:
    """the variant of a host that is kept."""
    v = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("variant")).agg(F.count("*").alias("subpages"), F.max(F.col("l_partkey") % 700).alias("landing"))
    return crawl.variant_winner(v.withColumn("strict", F.col("variant") == "A"), "l_orderkey", "strict", "subpages", "landing").select("l_orderkey", "variant")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag <> 'N')")
def changed_sites(spark: SparkSession, d: str) -> DataFrame:
    """Keys with a page that wasn't reused."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", "reused_from_store").when(F.col("l_returnflag") == "A", "fresh").alias("origin"))
    return crawl.changed_keys(rows, "l_orderkey", "origin")


# Answers and requests

_STATUS = """CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'refusal' WHEN role = 'user' AND turn % 3 = 1 THEN 'empty' WHEN role = 'user' THEN 'invalid_json' WHEN turn % 4 = 0 THEN 'contract_violation' ELSE 'ok' END"""


@query(f"""
SELECT conv_id, turn, role, {_STATUS} AS status, CASE WHEN role = 'user' THEN '' WHEN turn % 4 = 0 THEN 'one' WHEN turn % 4 = 1 THEN 'one|two' WHEN turn % 4 = 2 THEN '' ELSE 'two' END AS categories, role <> 'user' AS stopped FROM conversations""")
def response_contract(spark: SparkSession, d: str) -> DataFrame:
    """recorded answers flattened and held against their contract."""
    answer = F.expr("CASE WHEN turn % 4 = 0 THEN '[\"C999\", \"C001\"]' WHEN turn % 4 = 1 THEN '[\"C001\", \"C002\", \"C001\"]' WHEN turn % 4 = 2 THEN '[\"C097\"]' ELSE '[\"C002\"]' END")
    content = F.when(F.col("role") != "user", F.concat(F.lit('{"category_ids": '), answer, F.lit("}"))).when(F.col("turn") % 3 == 0, "x").when(F.col("turn") % 3 == 1, "").otherwise(F.col("text"))
    refusal = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 0), "no")
    message = F.struct(content.alias("content"), refusal.alias("refusal"))
    choice = F.struct(message.alias("message"), F.when(F.col("role") != "user", "stop").alias("finish_reason"))
    line = F.to_json(F.struct(F.struct(F.struct(F.array(choice).alias("choices")).alias("body")).alias("response")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", responses.chat_parts(line).alias("p")).select("conv_id", "turn", "role", "p.*")
    out = responses.classify(rows, "text", "refusal", {"C001": "one", "C002": "two"})
    return out.select("conv_id", "turn", "role", "status", F.array_join("categories", "|").alias("categories"), F.coalesce(F.col("finish_reason") == "stop", F.lit(False)).alias("stopped"))


@query("""
SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'gpt-5.6-luna' ELSE 'gpt-5.2' END AS model, CASE WHEN role = 'user' THEN 2 ELSE 0 END AS pieces, floor(3 / 2.5)::BIGINT + CASE WHEN role = 'user' THEN floor(6 / 2.5)::BIGINT + floor(length(text) / 2.5)::BIGINT ELSE floor((6 + length(text)) / 2.5)::BIGINT END + 341 + 1024 AS tokens,
  sha256(text) AS text_sha256 FROM conversations""")
def request_lines(spark: SparkSession, d: str) -> DataFrame:
    """Request lines built, and their model and tokens read back."""
    model = F.when(F.col("role") == "user", "gpt-5.6-luna").otherwise("gpt-5.2")
    line = responses.request_line(F.concat_ws(":", "conv_id", "turn", "role"), model, F.lit("sys"), F.lit("prefix"), F.col("text"), 0.0, 1024, routing.is_family(model), "own", responses.response_schema(["C001", "C002"]))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", line.alias("line"))
    v = F.try_parse_json("line")
    user = F.coalesce(F.try_variant_get(v, "$.body.messages[1].content[1].text", "string"), F.expr("substr(try_variant_get(try_parse_json(line), '$.body.messages[1].content', 'string'), 7)"))
    pieces = F.coalesce(F.size(F.try_variant_get(v, "$.body.messages[1].content", "array<variant>")), F.lit(0))
    return rows.select("conv_id", "turn", "role", responses.request_model(F.col("line")).alias("model"), pieces.alias("pieces"), artifacts.line_tokens(F.col("line"), 341, 500).alias("tokens"), F.sha2(user, 256).alias("text_sha256"))


@query("""
SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text ELSE text || '!' END AS text FROM conversations""")
def article_answers(spark: SparkSession, d: str) -> DataFrame:
    """Texts of answers in both shapes."""
    chat = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    listed = F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.array(F.struct(F.lit("r").alias("text"))).alias("content")), F.struct(F.lit("message").alias("type"), F.array(F.struct(F.col("text").alias("text")), F.struct(F.lit("!").alias("text"))).alias("content"))).alias("output"))
    line = F.when(F.col("role") == "user", F.to_json(F.struct(F.struct(chat.alias("body")).alias("response")))).otherwise(F.to_json(F.struct(F.struct(listed.alias("body")).alias("response"))))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", responses.article_text(line).alias("text"))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_totalprice > 480000 THEN 'B' ELSE 'A' END AS model, CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice < 20000 THEN 'other' END AS wrong, o_orderstatus = 'P' AND o_totalprice < 15000 AS broken FROM orders)
SELECT problem, count(*) AS n FROM (
  SELECT 'line is not valid JSON' AS problem FROM t WHERE broken UNION ALL SELECT 'line model differs' FROM t WHERE NOT broken AND wrong IS NOT NULL
  UNION ALL SELECT 'mapping model differs' FROM t JOIN orders USING (o_orderkey) WHERE o_orderstatus = 'F' AND model = 'B' UNION ALL SELECT 'no mapping entry' FROM orders WHERE o_totalprice < 5000
  UNION ALL SELECT 'tokens over cap' FROM orders WHERE o_totalprice > 499000
  UNION ALL SELECT 'number maps to several streams' FROM (SELECT o_custkey FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' AND model = 'B' THEN 'A' ELSE model END AS m FROM t JOIN orders USING (o_orderkey) WHERE o_totalprice >= 5000) GROUP BY 1 HAVING count(DISTINCT m) > 1)) GROUP BY 1""")
def routed_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken invariants of request files."""
    o = table(spark, d, "orders")
    model = F.when(F.col("o_totalprice") > 480000, "B").otherwise("A")
    line_model = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 20000), "other").otherwise(model)
    line = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("custom_id"), F.struct(line_model.alias("model")).alias("body")))
    tasks = o.select(F.col("o_orderkey").cast("string").alias("prompt_id"), model.alias("model"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 15000), "{").otherwise(line).alias("line"), F.col("o_totalprice").cast("long").alias("tokens"))
    mapped = F.when((F.col("o_orderstatus") == "F") & (model == "B"), "A").otherwise(model)
    mapping = o.where("o_totalprice >= 5000").select(F.col("o_orderkey").cast("string").alias("prompt_id"), mapped.alias("model"), F.array(F.col("o_custkey").cast("string")).alias("asns"))
    return artifacts.violations(tasks, mapping, 498_999).groupBy("problem").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT DISTINCT l_returnflag AS model, l_suppkey AS part FROM lineitem), j AS (SELECT DISTINCT l_returnflag AS model, l_suppkey AS part FROM lineitem WHERE l_linenumber > 5)
SELECT model, part, (model, part) IN (SELECT (model, part) FROM j) AS submitted FROM p""")
def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Parts with and without a job."""
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("part"), "l_linenumber")
    parts = lines.select("model", "part").distinct()
    jobs = lines.select("model", "part", F.when(F.col("l_linenumber") > 5, F.concat(F.lit("j"), "part")).alias("job_id"))
    done = artifacts.already_submitted(parts.select("model", "part", F.concat_ws("/", "model", "part").alias("prompt_id")), jobs)
    gaps = artifacts.submission_gaps(parts, jobs).withColumn("submitted", F.lit(False))
    have = done.select(F.substring_index("prompt_id", "/", 1).alias("model"), F.substring_index("prompt_id", "/", -1).cast("long").alias("part"), F.lit(True).alias("submitted"))
    return gaps.unionByName(have)


@query("""
WITH s AS (SELECT user_id, bool_or(event_type = 'purchase') AS ok, count(*) FILTER (WHERE event_type = 'error') AS tries FROM events GROUP BY 1)
SELECT user_id, tries, CASE WHEN ok THEN 'done' WHEN tries >= 12 THEN 'failed' WHEN tries = 0 THEN 'pending' WHEN tries % 4 = 0 THEN 'requeue' ELSE 'retry' END AS state FROM s""")
def retry_states(spark: SparkSession, d: str) -> DataFrame:
    """What is to be tried again."""
    status = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "failed").otherwise("started")
    events = table(spark, d, "events").select("user_id", status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return artifacts.retry_state(events, "user_id", "status", "ts", attempts=4).select("user_id", "tries", "state")


# Lookups


@query("""
WITH k AS (SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderpriority)) AS c FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey, o_orderstatus),
i AS (SELECT key, count(DISTINCT c) AS n, any_value(c) AS c FROM k GROUP BY 1),
p AS (SELECT DISTINCT l_suppkey AS prompt, o_custkey AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 7 AND l_returnflag = 'A' AND l_quantity > 45)
SELECT s_suppkey AS prompt, CASE WHEN count(i.key) = 0 THEN 'missing' WHEN bool_or(i.n > 1) OR count(DISTINCT i.c) > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM supplier LEFT JOIN p ON prompt = s_suppkey LEFT JOIN i USING (key) GROUP BY 1""")
def prior_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What earlier classes say about a prompt with several keys."""
    orders = table(spark, d, "orders")
    sets = orders.where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("key"), "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("c"))
    index = routing.prior_class_index(sets, "key", "c")
    met = table(spark, d, "lineitem").where("l_linenumber = 7 AND l_returnflag = 'A' AND l_quantity > 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.collect_set("o_custkey").alias("keys"))
    prompts = table(spark, d, "supplier").join(met, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("prompt"), F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"))
    return routing.prior_lookup(prompts, "prompt", "keys", index, "key").select("prompt", "status")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_mktsegment WHEN c_acctbal > 0 THEN c_name END AS found FROM customer")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """The first of several keys that a map has."""
    entries = F.map_from_entries(F.array_compact(F.array(F.when(F.col("c_acctbal") > 0, F.struct(F.lit("b").alias("k"), F.col("c_name").alias("v"))), F.when(F.col("c_nationkey") < 5, F.struct(F.lit("a").alias("k"), F.col("c_mktsegment").alias("v"))))))
    return table(spark, d, "customer").select("c_custkey", registry.probe_map(entries, [F.lit("x"), F.lit("a"), F.lit("b")]).alias("found"))


@query("""
WITH s AS (SELECT c_nationkey, array_to_string(list_sort(list(c_custkey::VARCHAR)), ',') AS keys FROM customer WHERE c_acctbal > 8000 GROUP BY 1) SELECT s_suppkey, coalesce(s.keys, s_suppkey::VARCHAR) AS keys FROM supplier LEFT JOIN s ON s_nationkey = c_nationkey""")
def seed_sharers(spark: SparkSession, d: str) -> DataFrame:
    """Everyone who shares a seed."""
    seeds = table(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").alias("seed"))
    prompts = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("key"), F.col("s_nationkey").alias("seed"))
    return registry.seed_fan_out(prompts, "s_suppkey", "key", seeds, "seed").withColumn("keys", F.array_join("keys", ","))


@query("""
WITH b AS (SELECT sha256(text) AS h, min(doc_id::VARCHAR) AS prompt_id FROM documents GROUP BY 1)
SELECT doc_id::VARCHAR AS key, unnest(list_distinct(['lang ' || d.lang, 'size ' || (d.n_chars > 1000)::VARCHAR])) AS category FROM documents d0 JOIN b ON sha256(d0.text) = h JOIN documents d ON d.doc_id::VARCHAR = b.prompt_id""".replace("SELECT doc_id::VARCHAR", "SELECT d0.doc_id::VARCHAR"))
def fanned_labels(spark: SparkSession, d: str) -> DataFrame:
    """One prompt for each distinct text, its answer for everyone who has the text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("payload_sha256"), F.col("n_chars").alias("tokens"), "lang")
    prompts = labels.unique_prompts(docs, "key")
    answers = docs.select(F.col("key").alias("prompt_id"), F.array(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("size "), (F.col("tokens") > 1000).cast("string"))).alias("categories"))
    return labels.fan_out(answers, prompts)


@query("""
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 480000), b AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000), c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3),
u AS (SELECT o_custkey AS k, 'orders' AS p FROM a UNION ALL SELECT c_custkey, 'rich' FROM b UNION ALL SELECT c_custkey, 'three' FROM c)
SELECT k AS c_custkey, array_to_string(list_sort(list(p)), '|') AS parts FROM u GROUP BY 1 HAVING count(*) > 1""")
def label_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Keys that several parts have."""
    c = table(spark, d, "customer")
    parts = [("orders", table(spark, d, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))), ("rich", c.where("c_acctbal > 9000")), ("three", c.where("c_nationkey = 3"))]
    return labels.overlap(parts, "c_custkey").withColumn("parts", F.array_join("parts", "|"))


@query("""
WITH k AS (SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN 'fallback' WHEN c_acctbal > 5000 THEN 'wiki' ELSE 'site' END AS provenance, * EXCLUDE (c_custkey) FROM customer)
SELECT c_custkey, provenance, unnest(CASE provenance WHEN 'fallback' THEN [c_mktsegment] WHEN 'wiki' THEN ['W', c_mktsegment] ELSE [c_mktsegment, 'S'] END) AS category FROM k""")
def merged_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label sources by precedence, with provenance."""
    c = table(spark, d, "customer")
    part = lambda which, *names: c.where(which).select("c_custkey", F.explode(F.array(*names)).alias("category"))
    parts = [("site", part("true", "c_mktsegment", F.lit("S"))), ("wiki", part("c_acctbal > 5000", F.lit("W"), "c_mktsegment")), ("fallback", part("c_nationkey < 3", "c_mktsegment"))]
    return labels.merge_labels(parts, "c_custkey", "category")


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'https://s' || c_custkey || '.example' END AS s, CASE WHEN c_acctbal > 0 THEN 'http://c' || c_custkey || '.example' END AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN 'http://i' || c_custkey || '.example' END AS i FROM customer)
SELECT c_custkey::VARCHAR AS asn, coalesce(s, c, i) AS url, CASE WHEN s IS NOT NULL THEN 'web_search' WHEN c IS NOT NULL THEN 'center' WHEN i IS NOT NULL THEN 'imputed' ELSE 'none' END AS origin, CASE WHEN coalesce(s, c, i) IS NOT NULL THEN true END AS accessible FROM s""")
def combined_sites(spark: SparkSession, d: str) -> DataFrame:
    """Websites by precedence; answers that are none and registries' own sites don't count."""
    c = table(spark, d, "customer").withColumn("asn", F.col("c_custkey").cast("string"))
    answer = F.when(F.col("c_nationkey") < 5, F.concat(F.lit("It is [site](https://s"), "c_custkey", F.lit(".example)."))).when(F.col("c_nationkey") < 10, "No match.").when(F.col("c_nationkey") < 15, "https://bgp.he.net/AS1").otherwise("I could not find it")
    first = F.concat(F.lit("http://c"), "c_custkey", F.lit(".example"))
    out = website.combine(c.select("asn"), c.where("c_acctbal > 0").select("asn", first.alias("original"), F.lit(None).cast("string").alias("final")), c.select("asn", answer.alias("answer")), c.where("c_mktsegment = 'BUILDING'").select("asn", F.concat(F.lit("http://i"), "c_custkey", F.lit(".example")).alias("url")))
    return out.select("asn", "url", "origin", "accessible")


@query("""
SELECT l_returnflag AS state, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_suppkey))[1:50], ',') AS first_ids FROM lineitem GROUP BY 1 ORDER BY n DESC""")
def first_ids(spark: SparkSession, d: str) -> DataFrame:
    """Counts with the first fifty identifiers, by number."""
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("state"), "l_suppkey").agg(F.count("*").alias("k"))
    top = relational.top_k_by(pairs, "state", [F.col("l_suppkey")], 50).groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("l_suppkey")).cast("array<string>"), ",").alias("first_ids"))
    return pairs.groupBy("state").agg(F.sum("k").alias("n")).join(top, "state")


@query("SELECT count(*) FILTER (WHERE o_totalprice < 0) = 0 AND count(*) FILTER (WHERE o_orderstatus = 'X') = 0 AS passes, '' AS blockers FROM orders")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """A build is promoted only if all counters of blockers are zero."""
    counters = quality.metrics(table(spark, d, "orders"), {"negative": F.col("o_totalprice") < 0, "unknown": F.col("o_orderstatus") == "X"}).drop("n_rows")
    return quality.gate(counters).withColumn("blockers", F.array_join("blockers", "|"))


# Forms of URLs and texts


@query(f"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '/de/') THEN '' ELSE url END AS u FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/+$', '') AS keep_path, 'http://' || {HOST} AS with_scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS authority,
       CASE WHEN u = '' THEN 'site_' || left(sha1(''), 10) ELSE {NO_WWW} END AS site_key FROM p""")
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    """further forms of a URL."""
    u = F.col("url")
    blank = F.when(F.contains("url", F.lit("/de/")), "").otherwise(u)
    return table(spark, d, "pages").select("page_id", urls.clean_keep_path(u).alias("keep_path"), urls.with_scheme(urls.host(u)).alias("with_scheme"), urls.authority(u).alias("authority"), urls.site_key(blank).alias("site_key"))


@query(rf"""
SELECT page_id, sha256({_STRIP}) AS text_sha256, sha256(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS spaced_sha256 FROM pages""")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """texts of pages under a cap of bytes, and white space in order."""
    return table(spark, d, "pages").select("page_id", F.sha2(texts.page_text(F.col("html")), 256).alias("text_sha256"), F.sha2(texts.normalise_space(F.col("html")), 256).alias("spaced_sha256"))


@query("""
WITH t AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS tag FROM orders), a AS (SELECT strftime(o_orderdate, '%Y-%m') AS tag, bool_or(o_totalprice > 490000) AS m, bool_or(o_totalprice < 10000) AS c FROM orders GROUP BY 1)
SELECT max(tag) AS tag FROM a WHERE m AND c AND tag < '2001-01'""")
def previous_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The newest older snapshot that has both files."""
    o = table(spark, d, "orders").withColumn("tag", F.date_format("o_orderdate", "yyyy-MM"))
    tags = o.groupBy("tag").agg(F.bool_or(F.col("o_totalprice") > 490000).alias("has_mapping"), F.bool_or(F.col("o_totalprice") < 10000).alias("has_class"))
    return registry.previous_pair(tags, "tag", "2001-01", explicit="none")


@query("""
WITH b AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 7 AND l_returnflag = 'A')
SELECT l_orderkey AS host, count(*) AS files FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_suppkey IN (SELECT l_suppkey FROM b) GROUP BY 1""")
def broken_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that are affected by broken files."""
    l = table(spark, d, "lineitem")  # noqa: E741
    error = F.when((F.col("l_quantity") > 49) & (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A"), "truncated")
    state = warc.health(l.select(F.col("l_suppkey").alias("warc"), error.alias("error")))
    index = l.select(F.col("l_orderkey").alias("host"), F.col("l_suppkey").alias("warc")).distinct()
    return index.join(state.where("not ok").select("warc"), "warc", "left_semi").groupBy("host").agg(F.count("*").alias("files"))


@query("""
SELECT s_nationkey AS warc, s_suppkey AS record, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'new' ELSE 'old' END AS v FROM supplier""")
def replaced_slices(spark: SparkSession, d: str) -> DataFrame:
    """Broken slices scrubbed or replaced by rebuilt ones."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("warc"), F.col("s_suppkey").alias("record"))
    broken = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("warc"))
    rebuilt = s.join(broken, "warc", "left_semi").withColumn("v", F.lit("new"))
    whole = warc.scrub(s, "warc", broken).withColumn("v", F.lit("old")).unionByName(s.join(broken, "warc", "left_semi").withColumn("v", F.lit("broken")))
    return warc.replaced(whole, rebuilt)
