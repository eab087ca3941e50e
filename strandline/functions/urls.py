"""URL functions, Column to Column. A missing or blank URL gives null unless said otherwise."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Fixed values.
SKIP_SCHEMES = ("chrome-error:", "about:", "data:", "file:", "javascript:")
MIDDLEBOX_MARKERS = (
    "perfdrive.com", "incapsula.com", "incap_dns", "challenges.cloudflare.com", "captcha-delivery.com", "datadome.co",
    "hcaptcha.com", "recaptcha.net", "google.com/recaptcha", "cookiebot.com", "onetrust.com", "chromewebdata",
)
REGISTRY_DOMAINS = (
    "whois.ipip.net", "ipip.net", "peeringdb.com", "ipinfo.io", "bgpview.io", "bgp.he.net", "bgp.tools", "arin.net", "whois.arin.net", "ripe.net",
    "db.ripe.net", "apps.db.ripe.net", "stat.ripe.net", "apnic.net", "lacnic.net", "afrinic.net", "asrank.caida.org", "radb.net", "ipgeolocation.io",
    "ipapi.co", "team-cymru.com", "irrexplorer.nlnog.net", "radar.cloudflare.com", "routeviews.org", "he.net",
)
AUTH_DOMAINS = (
    "accounts.google.com", "login.microsoftonline.com", "login.live.com", "login.yahoo.com", "login.salesforce.com", "auth.atlassian.com",
    "idp.fedoraproject.org", "sso.redhat.com", "login.okta.com", "auth0.com", "signin.aws.amazon.com", "console.aws.amazon.com", "appleid.apple.com",
    "login.twitch.tv", "passport.yandex.ru", "passport.yandex.com", "cloudflareaccess.com",
)
SOCIAL_DOMAINS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "tiktok.com", "github.com", "google.com",
    "cloudflareaccess.com", "microsoftonline.com", "office.com", "live.com", "okta.com", "auth0.com",
)
MESSY_QUERY = r"(?i)(REALMOID|SMAUTHREASON|SMAGENTNAME|TARGET=\$SM|!ut/p/|;jsessionid=)"
ROOT_PAGES = ("index", "index.html", "index.htm", "home", "default.aspx", "default.html")
MAIL_DOMAINS = ("gmail.com", "yahoo.com", "me.com", "hotmail.com", "lacnic.net", "ripe.net", "apnic.net", "mhs.attmail.com")


# IPv4 blocks that aren't public, and the exceptions within them.
SPECIAL_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def with_scheme(url: Column, scheme: str = "http") -> Column:
    """``url`` with ``scheme://`` in front where it has none."""
    u = blank_to_null(url)
    return F.when(u.rlike("(?i)^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit(f"{scheme}://"), F.regexp_replace(u, "^//", "")))


def authority(url: Column) -> Column:
    """What stands between ``://`` and the path, lower-case: user, host and port."""
    return F.nullif(F.lower(F.regexp_extract(with_scheme(url), "^[^:/?#]+://([^/?#]*)", 1)), F.lit(""))


def host(url: Column, strip_www: bool = False, strip_port: bool = True) -> Column:
    """Host without user; port and a leading ``www.`` as asked."""
    h = F.regexp_replace(authority(url), "^.*@", "")
    if strip_port:
        h = F.regexp_replace(h, ":[0-9]*$", "")
    if strip_www:
        h = F.regexp_replace(h, "^www\\.", "")
    return F.nullif(h, F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), "^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), "^[^?#]*\\?([^#]*)", 1)


def is_internal(url: Column) -> Column:
    """Browser-internal or blank."""
    return F.trim(F.coalesce(url, F.lit(""))).rlike("^$|(?i)^(" + "|".join(SKIP_SCHEMES) + ")")


def website_key(url: Column) -> Column:
    """Host without user, port and ``www.``; null for browser-internal URLs."""
    return F.when(~is_internal(url), host(url, strip_www=True))


def rough_domain(url: Column) -> Column:
    """The last two labels of the host; two sites under one public suffix of two labels look the same."""
    return F.substring_index(host(url, strip_www=True), ".", -2)


def clean_keep_path(url: Column) -> Column:
    """Scheme and ``www.`` off only where a scheme was there, no trailing slash, lower-case."""
    u = F.lower(F.trim(url))
    stripped = F.when(u.rlike("^https?://"), F.regexp_replace(F.regexp_replace(u, "^https?://", ""), "^www\\.", "")).otherwise(u)
    return blank_to_null(F.regexp_replace(stripped, "/+$", ""))


def clean_host_first(url: Column) -> Column:
    """Host and path without scheme and ``www.``, whether or not a scheme was there."""
    u = F.regexp_replace(F.lower(F.trim(url)), "^https?://", "")
    return blank_to_null(F.regexp_replace(F.regexp_replace(u, "^www\\.", ""), "/+$", ""))


def variants(clean: Column) -> Column:
    """URLs to try for a cleaned address, in order: https, https with www, http, http with www; no repeats."""
    bare = F.regexp_replace(clean, "^www\\.", "")
    return F.array_distinct(F.array(*(F.concat(F.lit(p), bare) for p in ("https://", "https://www.", "http://", "http://www."))))


def url_key(url: Column) -> Column:
    """Equal for URLs that differ in scheme, case or trailing slashes."""
    return blank_to_null(F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "(?i)^https?://", ""), "/+$", "")))


def is_accessible(status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False))


def is_blocked(status: Column) -> Column:
    return F.coalesce(status.isin(401, 403, 429), F.lit(False))


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    return F.coalesce(text.rlike("(?i)(" + "|".join(re.escape(m) for m in markers) + ")"), F.lit(False))


def under_any(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of ``domains`` or a subdomain of one. One expression, so that the host is found once."""
    return F.coalesce(host(url).rlike("(^|\\.)(" + "|".join(re.escape(d) for d in domains) + ")$"), F.lit(False))


def is_root_like(url: Column) -> Column:
    """No path, or one of the usual start pages."""
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")
    first = F.get(parts, F.lit(0))
    return (F.size(parts) == 0) | ((F.size(parts) == 1) & first.isin(*ROOT_PAGES))


def suffixes(name: Column) -> Column:
    """All suffixes of a host at label borders, longest first."""
    labels = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def first_url(text: Column) -> Column:
    """A markdown link's target, else a URL with scheme or ``www.``, else a bare domain."""
    tries = ((r"\[[^\]\n]*\]\((https?://[^)]+)\)", 1), (r"(?i)((?:https?://|www\.)[A-Za-z0-9_.-]+\.[a-z]{2,}[^ \t\r\n)]*)", 1), (r"((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", 1))
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p, g in tries))


def trim_tail(url: Column) -> Column:
    """The URL inside a raw answer, without marks at its end; an answer without one is trimmed."""
    found = F.nullif(F.regexp_extract(url, r"(https?://[^ \t\r\n\])*]+|www\.[^ \t\r\n\])*]+)", 1), F.lit(""))
    return F.coalesce(F.regexp_replace(found, r"[*)\].,:;!?]+$", ""), blank_to_null(url))


def classify_redirect(original: Column, final: Column) -> Column:
    """struct(url, accessible, note): which of the two URLs to record. The first rule that fits decides.

    No final URL: the original. The same but for case and trailing slashes: the final. A sign-in site, or another registered
    domain: the original, unreachable. An encoded or long path or query: the original. Else the final.
    """
    key = lambda u: F.lower(F.regexp_replace(u, "/+$", ""))
    gone = F.coalesce(final, F.lit("")) == ""
    messy = final.rlike(MESSY_QUERY) | (F.length(path(final)) > 60) | (F.length(query_string(final)) > 40)
    out = lambda url, ok, note: F.struct(url.alias("url"), F.lit(ok).alias("accessible"), F.lit(note).alias("note"))
    return (
        F.when(gone, out(original, True, "")).when(key(final) == key(original), out(final, True, ""))
        .when(under_any(final, AUTH_DOMAINS), out(original, False, "unreachable")).when(rough_domain(original) != rough_domain(final), out(original, False, "unreachable"))
        .when(messy, out(original, True, "messy_redirect_cleaned")).otherwise(out(final, True, ""))
    )


def site_key(url: Column) -> Column:
    """Canonical host, else ``site_`` and ten digits of the text's SHA-1."""
    h = host(url, strip_www=True)
    return F.coalesce(h, F.concat(F.lit("site_"), F.substring(F.sha1(F.coalesce(url, F.lit(""))), 1, 10)))


def _v4_number(address: Column) -> Column:
    parts = F.transform(F.split(address, "\\."), lambda p: p.try_cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)


def _within(number: Column, blocks: Sequence[str]) -> Column:
    found = F.lit(False)
    for block in blocks:
        net = ipaddress.ip_network(block)
        found = found | number.between(int(net.network_address), int(net.broadcast_address))
    return found


def _each_public(addresses: pd.Series) -> pd.Series:
    def one(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        ip = ip.ipv4_mapped or ip if ip.version == 6 else ip
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)

    return addresses.map(lambda t: one(t) if isinstance(t, str) else None)


def is_public_v4(address: Column) -> Column:
    """Whether a dotted address is none of the special blocks; false if it isn't one."""
    valid = address.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}") & ~address.endswith(".")
    n = _v4_number(address)
    return F.coalesce(F.when(valid, ~_within(n, SPECIAL_V4) | _within(n, PUBLIC_V4)), F.lit(False))


def with_public(df: DataFrame, addresses: str, out: str) -> DataFrame:
    """Adds whether all recorded addresses of a host (an array) are public; an unresolved host isn't. Addresses of the new kind go
    to Python, each distinct one once; those of the old kind are Columns."""
    each = df.select(F.explode(addresses).alias("__a")).distinct()
    new = F.contains("__a", F.lit(":"))
    known = each.select("__a", F.when(new, F.pandas_udf(_each_public, BooleanType())(F.when(new, F.col("__a")))).otherwise(is_public_v4(F.col("__a"))).alias("__ok"))
    bad = known.where(~F.coalesce("__ok", F.lit(False))).select("__a")
    torn = df.select(F.col(addresses).alias("__all"), F.explode(addresses).alias("__a")).distinct().join(bad, "__a", "left_semi").select("__all").distinct().withColumn("__bad", F.lit(True))
    met = df.join(torn, F.col(addresses) == F.col("__all"), "left")
    return met.withColumn(out, (F.coalesce(F.size(addresses), F.lit(0)) > 0) & F.col("__bad").isNull()).drop("__all", "__bad")
