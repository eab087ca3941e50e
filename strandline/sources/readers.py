"""Readers of the pipeline's file formats, each a DataFrame with an explicit schema."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import texts, urls

# Fixed values.
REGISTRY_ALIASES = {"arin": "arin", "ripencc": "ripe", "ripe": "ripe", "apnic": "apnic", "lacnic": "lacnic", "afrinic": "afrinic"}
SLICE_SCHEMA = "site string, seed string, url string, kind string, mime string, warc string, record_id string, store_ref struct<record_id:string,warc:string>, store_origin string, captured_at string, length bigint"
STORE_SCHEMA = "record_id string, warc string, url string, mime string, sha256 string, length bigint"
OFFSET_SCHEMA = "warc string, record_id string, offset bigint, gzlen bigint"
# Tables that effects leave behind: probes, answers, articles, mail lookups, captures.
PROBE_SCHEMA = "clean string, variant int, reachability string, status int, final_url string, probed_at string"
ANSWER_SCHEMA = "custom_id string, model string, contract string, response string, error string, completed_at string, job_id string"
ARTICLE_SCHEMA = "org string, brand string, title string, url string, full_text string, qid string, redirected_to string"
ITEM_SCHEMA = "id string, desc string, p31 array<string>, props array<string>"
MAIL_SCHEMA = "asn string, rir string, emails array<string>, error string, queried_at string"
EVENT_SCHEMA = "seed string, site string, status string, reason string, details string, final_url string, attempt_no int, ts string, run_id string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches something, on any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def in_order(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Adds a number that follows path, place in the file and row, however Spark packs files into tasks.

    ``monotonically_increasing_id`` follows tasks, to which files are dealt by size. Here the first digits are the rank of the
    path in the listing, then the start of the block within the file (16 digits), then the row's number in its task (10 digits).
    """
    listed = sorted({re.sub("^file:/+", "file:///", unquote(p)) for p in df.inputFiles()})
    ranks = df.sparkSession.createDataFrame(list(enumerate(listed)), "__rank long, __name string")
    rows = df.select("*", F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    met = rows.join(F.broadcast(ranks), F.col("__path") == F.col("__name"), "left")  # one row a file of the listing
    number = F.coalesce("__rank", F.lit(0)).cast("decimal(12,0)") * F.expr("cast('1e26' as decimal(27,0))").cast("decimal(27,0)")
    rest = F.col("__start").cast("decimal(16,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(10,0)")
    return met.withColumn(name, (number + rest).cast("decimal(38,0)")).drop("__path", "__start", "__row", "__rank", "__name")


def keyed_json(spark: SparkSession, path: str, value: str, key: str = "asn") -> DataFrame:
    """``{key: value, ...}`` files, bare or under "data", or one such object a line: one row per key; .gz is read as it is.
    ``value``: DDL type. A file is one object if its first line doesn't close one."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"map<string,{value}>"
    first = F.trim(F.substring_index(F.trim("value"), "\n", 1))
    many = F.contains(F.trim("value"), F.lit("\n")) & first.startswith("{") & F.try_parse_json(first).isNotNull()
    bare = F.from_json("value", kind)
    wrapped = F.from_json(F.get_json_object("value", "$.data"), kind)
    envelope = F.get_json_object("value", "$.data").isNotNull() & F.get_json_object("value", "$.metadata").isNotNull()
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    maps = F.when(many, F.transform(lines, lambda x: F.from_json(x, kind))).otherwise(F.array(F.when(envelope, wrapped).otherwise(bare)))
    return whole.select(F.explode(maps).alias("m")).select(F.explode("m").alias(key, "value"))


def keyed_json_or_empty(spark: SparkSession, path: str, value: str, key: str = "asn") -> DataFrame:
    """As ``keyed_json``; a missing file gives no rows."""
    return keyed_json(spark, path, value, key) if exists(spark, path) else spark.createDataFrame([], f"{key} string, value {value}")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their order; broken lines are left out."""
    return in_order(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))


def statistics_glob(folder: str, rir: str) -> str:
    """Where a registry's statistics are kept by convention."""
    return f"{folder}/delegated-{ {'ripe': 'ripencc'}.get(rir, rir)}*extended*"


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of archives; a missing file gives no rows."""
    return json_lines(spark, path, OFFSET_SCHEMA) if exists(spark, path) else spark.createDataFrame([], OFFSET_SCHEMA).withColumn("ordinal", F.lit(0).cast("decimal(38,0)"))


#: Names under which a record holds its site, in this order, and its number.
SITE_KEYS, NUMBER_KEYS = ("Website", "URL", "website", "url", "homepage"), ("asn", "ASN", "as")


def site_mapping(spark: SparkSession, path: str) -> DataFrame:
    """asn, url, pos, ordinal of a mapping file in any of its shapes: an object by number (bare or under "data") whose values are
    a URL, a list of URLs, or an object with the URL under one of SITE_KEYS or as a key with a dot; or a list of such objects
    that name their number. pos counts a number's URLs, ordinal the numbers in the file's order; others are left out."""
    text = "map<string,string>"  # values keep their JSON, keys their order
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    inner = F.get_json_object("value", "$.data")
    body = F.when(inner.startswith("{"), inner).otherwise(F.col("value"))
    by_number = F.transform(F.map_entries(F.from_json(F.when(body.startswith("{"), body), text)), lambda e: F.struct(e["key"].alias("asn"), e["value"].alias("content")))
    fields = lambda x: F.from_json(x, text)
    records = F.transform(F.from_json(F.when(F.col("value").startswith("["), F.col("value")), "array<string>"), lambda x: F.struct(F.coalesce(*(F.try_element_at(fields(x), F.lit(k)) for k in NUMBER_KEYS)).alias("asn"), x.alias("content")))
    rows = whole.select(F.posexplode(F.coalesce(by_number, records)).alias("ordinal", "e")).select("ordinal", "e.*").where("asn is not null and content is not null")
    c = F.trim("content")
    own = fields(F.when(c.startswith("{"), c))
    named = F.array(*(F.try_element_at(own, F.lit(k)) for k in SITE_KEYS))
    dotted = F.filter(F.map_keys(own), lambda k: F.contains(k, F.lit(".")) & ~k.isin(*SITE_KEYS))
    found = F.when(c.startswith("{"), F.concat(named, dotted)).when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    kept = F.filter(F.transform(found, lambda u: F.trim(u)), lambda u: u.isNotNull() & (u != "") & ~u.startswith("{") & ~u.startswith("["))
    return rows.select("ordinal", "asn", F.posexplode(kept).alias("pos", "url"))


def site_lookups(mapping: DataFrame) -> dict[str, DataFrame]:
    """Five tables from ``site_mapping``; of several numbers under one key the last in the file counts.

    url: url key to number; host: host without port, also without www, to number, social hosts left out; expected: number to the
    set of its hosts; seed: the first URL's key to number; sharers: that key to all numbers.
    """
    u = F.col("url")
    last = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("asn", F.struct("ordinal", "pos")).alias("asn"))
    bare = urls.blank_to_null(F.lower(F.regexp_replace(F.regexp_replace(F.trim(u), "^[^:/?#]*://", ""), "/+$", "")))
    hosts = mapping.where(~urls.under_any(u, urls.SOCIAL_DOMAINS)).select("asn", "ordinal", "pos", F.explode(F.array_distinct(F.array(urls.host(u), urls.host(u, strip_www=True)))).alias("host"))
    seeds_ = mapping.where("pos = 0").select("asn", "ordinal", "pos", bare.alias("seed")).where("seed is not null")
    netloc = F.regexp_replace(urls.authority(u), "^www\\.", "")
    return {
        "url": last(mapping.select("asn", "ordinal", "pos", urls.url_key(u).alias("url_key")), "url_key"), "host": last(hosts, "host"),
        "expected": mapping.select("asn", netloc.alias("host")).where("host is not null").distinct().groupBy("asn").agg(F.array_sort(F.collect_list("host")).alias("hosts")),
        "seed": last(seeds_, "seed"), "sharers": seeds_.select("seed", "asn").distinct().groupBy("seed").agg(F.array_sort(F.collect_list("asn")).alias("asns")),
    }


def delegated(lines: DataFrame, statuses: list[str], default_rir: str, order: Column | None = None) -> DataFrame:
    """asn, rir, cc, ordinal from the registries' statistics lines (``value``): records of type asn with a wanted status."""
    parts = F.split(F.trim("value"), "\\|")
    rows = lines.withColumn("ordinal", order if order is not None else F.monotonically_increasing_id()).where((F.trim("value") != "") & ~F.trim("value").startswith("#")).withColumn("p", parts).where(F.size("p") >= 7)
    aliases = F.create_map(*(F.lit(x) for kv in REGISTRY_ALIASES.items() for x in kv))
    field = lambda k: F.get("p", F.lit(k))
    rows = rows.where((field(2) == "asn") & field(6).isin(*statuses)).select(
        "ordinal", F.coalesce(F.element_at(aliases, F.lower(field(0))), F.lit(default_rir)).alias("rir"), F.upper(F.trim(field(1))).alias("cc"),
        field(3).try_cast("long").alias("first"), field(4).try_cast("long").alias("count"),
    )
    from strandline.operators.relational import range_expand

    return range_expand(rows.where("first is not null"), "first", "count", "n").select(F.col("n").cast("string").alias("asn"), "rir", "cc", "ordinal")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of ``key: value`` lines set apart by blank lines: type, id, fields (array of key, value), ordinal."""
    return parse_blocks(in_order(spark.read.option("lineSep", "\n\n").text(path)))


def parse_blocks(raw: DataFrame) -> DataFrame:
    lines = F.filter(F.split(F.trim(F.regexp_replace("value", "\r", "")), "\n"), lambda x: F.contains(x, F.lit(":")))
    fields = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    rows = raw.withColumn("fields", fields).where(F.size("fields") > 0)
    return rows.select(F.col("fields")[0]["key"].alias("type"), F.col("fields")[0]["value"].alias("id"), "fields", "ordinal")


def field(name: str, fields: str = "fields") -> Column:
    """Last value of a field in a block."""
    return F.try_element_at(F.transform(F.filter(fields, lambda x: x["key"] == name), lambda x: x["value"]), F.lit(-1))


def values(pattern: str, fields: str = "fields") -> Column:
    """All values of the fields whose name matches."""
    return F.transform(F.filter(fields, lambda x: x["key"].rlike(pattern)), lambda x: x["value"])


def autnum_domains(parsed: DataFrame) -> DataFrame:
    """asn, as_name, org_id, domains of aut-num blocks with an organisation; addresses become domains at once."""
    own = parsed.where("type = 'aut-num'").select(texts.asn_label(F.col("id")).alias("asn"), field("as-name").alias("as_name"), field("org").alias("org_id"))
    mail = F.array_distinct(F.array_compact(F.transform(values("^e-mail$"), texts.email_domain)))
    orgs = parsed.where("type = 'organisation'").select(F.col("id").alias("org_id"), field("org-name").alias("org_name"), mail.alias("domains"))
    return own.join(orgs, "org_id", "left").select("asn", "as_name", "org_id", "org_name", F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))


def handle_domains(asns: DataFrame, orgs: DataFrame, contacts: DataFrame) -> DataFrame:
    """asn, domains: number to organisation to its handles to their mailboxes' domains. ``orgs``: org_id, handles; ``contacts``: handle, mailboxes."""
    by_handle = contacts.select("handle", F.explode("mailboxes").alias("m")).select("handle", texts.email_domain(F.col("m")).alias("domain")).where("domain is not null")
    by_org = orgs.select("org_id", F.explode(F.array_distinct("handles")).alias("handle")).join(by_handle, "handle").groupBy("org_id").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    return asns.join(by_org, "org_id", "left").select("asn", F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))


def ipinfo(spark: SparkSession, path: str) -> DataFrame:
    return in_order(spark.read.option("header", True).schema("start_ip string, end_ip string, asn string, name string, domain string").csv(path))


def peering(spark: SparkSession, path: str) -> DataFrame:
    """asn, websites (own, then the organisation's) from a dump; the first network of a number counts. An organisation without
    a website takes the first URL in its name."""
    schema = "org struct<data array<struct<id:bigint,name:string,website:string,aka:string,country:string>>>, net struct<data array<struct<asn:bigint,org_id:bigint,website:string>>>"
    return peering_sites(spark.read.schema(schema).json(path, multiLine=True))


def peering_sites(dump: DataFrame) -> DataFrame:
    named = F.nullif(F.regexp_extract("o.name", r"((?:https?://|www\.)[^ \t]+)", 1), F.lit(""))
    orgs = dump.select(F.explode("org.data").alias("o")).select(F.col("o.id").alias("org_id"), F.coalesce(urls.blank_to_null(F.col("o.website")), named).alias("site"))
    nets = dump.select(F.posexplode("net.data").alias("pos", "n")).select("pos", F.col("n.asn").cast("string").alias("asn"), "n.org_id", urls.blank_to_null(F.col("n.website")).alias("own"))
    met = nets.join(orgs.groupBy("org_id").agg(F.first("site").alias("site")), "org_id")
    best = met.groupBy("asn").agg(F.min_by(F.struct("own", "site"), "pos").alias("b"))
    return best.select("asn", F.array_compact(F.array("b.own", "b.site")).alias("websites"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """url: a JSON list, an object with urls, or lines of text; trimmed, distinct, sorted."""
    whole = spark.read.text(path, wholetext=True).withColumn("v", F.try_parse_json("value"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<string>"), F.try_variant_get("v", "$.urls", "array<string>"), F.split("value", "\r?\n"))
    return whole.select(F.explode(listed).alias("url")).select(F.trim("url").alias("url")).where("url <> '' and not startswith(url, '#')").distinct().orderBy("url")


def snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """path, day: files whose name or folder carries a date (YYYYMMDD, dashed or in folders)."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    found = F.regexp_extract("path", "([0-9]{4})[-_/]?([0-9]{2})[-_/]?([0-9]{2})", 0)
    return files.select("path", F.try_to_date(F.regexp_replace(found, "[-_/]", ""), "yyyyMMdd").alias("day")).where("day is not null")
