"""URL filter: host rules, then a weighted vocabulary found by an Aho-Corasick automaton.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. A
null URL or one without ``://`` has neither. A rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins and decides.

Otherwise the URL is searched for the terms of a vocabulary. It is lower-cased (A-Z), its escapes of printable ASCII are decoded
once, and what is no letter or digit of ASCII becomes a border, so terms of several words match however they are joined. One
pass of the automaton finds all terms; a hit counts if both its ends are at borders. Each term has a weight: a *strict* one
reaches ``LIMIT`` alone, *soft* ones add up, each distinct term once. From ``LIMIT`` on the URL is blocked. A plural counts as
its singular.

The vocabulary is a parameter: a mapping, or a table with term and weight (``vocabulary``, at most ``MOST_TERMS`` rows). Rules
and vocabulary don't grow with the data. Null identifiers stay, repeated rows are judged alike, very long URLs are searched in
one pass, empty tables give empty results, and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Verdict, host and path of each rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LIMIT = 3.0
MOST_TERMS = 1 << 20
#: Weights and their terms; a hyphen stands between words of one term.
WEIGHTED = {
    3.0: """porn porno pornstar xxx hentai camgirl escort-service sex-shop sex-cam free-sex live-sex sex-chat sex-video nude-girl milf
        gangbang blowjob creampie upskirt warez cracked-software serial-keygen free-keygen phishing carding fullz buy-viagra cheap-viagra
        cheap-cialis online-casino casino-bonus slot-machine free-slots sports-betting payday-loan fake-passport fake-id buy-followers""",
    1.5: """adult sex sexy nude naked erotic erotica fetish escort webcam nsfw x x-rated r18 18plus casino poker roulette blackjack betting
        bookmaker jackpot viagra cialis tramadol xanax replica keygen torrent crack cracked serial payday steroid""",
    1.0: """hot girl teen dating hookup mature lingerie bonus slot gamble lottery bingo wager pill pharmacy prescription cheap discount
        deal coupon loan credit-repair forex crypto-signal proxy mirror download free-download stream streaming watch-online mp3 apk mod
        hack cheat generator unlimited clickbank referral affiliate make-money get-rich weight-loss miracle cure""",
}
TERMS = {term: weight for weight, terms in WEIGHTED.items() for term in terms.split()}

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ESCAPE = re.compile("%([2-7][0-9a-f])").sub
_BORDER = re.compile("[^a-z0-9]+").sub


def vocabulary(table: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, float]:
    """A vocabulary from a table; of repeated terms the largest weight counts, null terms and weights are ignored."""
    rows = table.where(F.col(term).isNotNull() & F.col(weight).isNotNull()).groupBy(term).agg(F.max(weight).cast("double").alias("w"))
    got = rows.limit(MOST_TERMS + 1).collect()
    if len(got) > MOST_TERMS:
        raise ValueError(f"a vocabulary may have {MOST_TERMS} terms")
    return {r[0]: r[1] for r in got}


def plain_form(text: str) -> str:
    """Words of ASCII letters and digits, joined by hyphens, after escapes are decoded; a hyphen at either end is a border."""
    low = _ESCAPE(lambda m: chr(int(m[1], 16)), text.translate(_UPPER)).translate(_UPPER)
    return _BORDER("-", low)


def spellings(terms: Mapping[str, float]) -> dict[str, str]:
    """Plain forms and, for terms of four letters and more that don't end in s, plurals; with the term they stand for."""
    found = {plain_form(t).strip("-"): t for t in terms}
    found = {f"{form}s": t for form, t in found.items() if len(form) >= 4 and form[-1] not in "s0123456789"} | found
    return {form: t for form, t in found.items() if form}


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


def rule_for(host: str, path: str, rules: tuple[tuple[str, str], ...]) -> tuple[str, str] | None:
    """(verdict, rule) of the longest fitting rule."""
    best = None
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        if host and (host == own or host.endswith("." + own)) and path.startswith("/" + rest if "/" in rule else ""):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    return best


def automaton(terms: Mapping[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for form, term in spellings(terms).items():
        found.add_word(form, (len(form), term))
    if len(found):
        found.make_automaton()
    return found


def hits(url: str, found: ahocorasick.Automaton) -> set[str]:
    """Distinct terms that stand between borders."""
    if not len(found):
        return set()
    low = plain_form(url)
    end_of = len(low) - 1
    return {term for end, (size, term) in found.iter(low) if (end == end_of or low[end + 1] == "-") and (end < size or low[end - size] == "-")}


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES, terms: Mapping[str, float] = TERMS, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, n_strict, n_soft (distinct terms), weight (their sum)."""
    names = ["host", "path", "rule", "verdict"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(terms)
        for batch in batches:
            rows = []
            for u in batch.column(1).to_pylist():
                host, path = split_url(u)
                host = host.translate(_UPPER)
                weights = sorted(terms[t] for t in hits(u or "", found))
                ruled = rule_for(host, path, rules)
                verdict = ruled[0] if ruled else "block" if sum(weights) >= limit else "allow"
                strict = sum(w >= limit for w in weights)
                rows.append((host, path, ruled[1] if ruled else None, verdict, strict, len(weights) - strict, float(sum(weights))))
            cols = list(zip(*rows)) if rows else [[]] * 7
            arrays = [pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(c, pa.int32()) for c in cols[4:6]] + [pa.array(cols[6], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["page_id", *names, "n_strict", "n_soft", "weight"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    schema = StructType([rows.schema["page_id"], *(StructField(n, StringType()) for n in names), StructField("n_strict", IntegerType()), StructField("n_soft", IntegerType()), StructField("weight", DoubleType())])
    return rows.mapInArrow(work, schema)
