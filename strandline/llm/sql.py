"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from . import pii, url_filter

ORACLES: dict[str, str] = {}

ORACLES["op8_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS nth FROM k)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM w
"""

ORACLES["op6_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS a FROM w),
win AS (SELECT r, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM tri WINDOW p AS (PARTITION BY r ORDER BY i)),
cnt AS (SELECT r, i, c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1 AS hit FROM win),
cov AS (SELECT r, hit OR coalesce(lag(hit) OVER p, FALSE) OR coalesce(lag(hit, 2) OVER p, FALSE) AS hit FROM cnt WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, count(*) FILTER (WHERE hit) AS n_repeat_words FROM cov GROUP BY r),
ln AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
ok AS (SELECT r, source, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
nl AS (SELECT r, source, t, line, array_to_string(lw, ' ') AS norm, len(lw) AS words FROM ok),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM nl GROUP BY r),
freq AS (SELECT source, norm FROM nl GROUP BY source, norm HAVING count(DISTINCT t) > 20),
gone AS (SELECT r, sum(words) AS n_frequent_words FROM nl JOIN freq ON nl.source IS NOT DISTINCT FROM freq.source AND nl.norm = freq.norm GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_frequent_words, 0)::BIGINT AS n_frequent_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_frequent_words >= 50 AND n_words - n_frequent_words >= 0.3 * n_words AS kept FROM b
"""


_FORMS = ", ".join(f"('-{form}-', '{term}', {url_filter.TERMS[term]})" for form, term in url_filter.spellings(url_filter.TERMS).items())
#: Escapes of printable ASCII; the one of the percent sign last, as what it makes isn't decoded again.
_CODES = ", ".join(f"'%{k:02x}'" for k in [*range(0x20, 0x25), *range(0x26, 0x80), 0x25])
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECODED = _LOW.format(f"list_reduce(list_prepend({_LOW.format('coalesce(url, chr(32))')}, [{_CODES}]), lambda a, c: replace(a, c, chr(('0x' || substr(c, 2))::INT)))")

_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.RULES)

ORACLES["op5_url_filter"] = rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT r, page_id, '-' || regexp_replace({_DECODED}, '[^a-z0-9]+', '-', 'g') || '-' AS plain,
             translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(verdict, rule, rhost, rpath) AS (VALUES {_RULES}),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h, rules
        WHERE host <> '' AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r),
forms(form, term, weight) AS (VALUES {_FORMS}),
hit AS (SELECT DISTINCT r, term, weight FROM h, forms WHERE contains(plain, form)),
w AS (SELECT r, count(*) FILTER (WHERE weight >= 3) AS strict, count(*) FILTER (WHERE weight < 3) AS soft, sum(weight)::DOUBLE AS weight FROM hit GROUP BY r)
SELECT page_id, host, path, fit.rule, coalesce(strict, 0)::INT AS n_strict, coalesce(soft, 0)::INT AS n_soft, coalesce(weight, 0)::DOUBLE AS weight,
       coalesce(fit.verdict, CASE WHEN weight >= 3 THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit USING (r) LEFT JOIN w USING (r)
"""

#: The base patterns as given; the operator's own are the same languages without look-behind and possessive repeats.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
}
_LUHN = "list_sum([CASE WHEN k % 2 = 1 THEN x[k]::INT ELSE x[k]::INT * 2 - CASE WHEN x[k]::INT > 4 THEN 9 ELSE 0 END END FOR k IN range(1, len(x) + 1)]) % 10 = 0"
_MOD97 = """list_reduce([c::BIGINT FOR c IN string_split(array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END
    FOR c IN string_split(substr(v, 5) || substr(v, 1, 4), '')], ''), '')], lambda a, x: (a * 10 + x) % 97) = 1"""
_CHECKS = {
    "ip": "list_max([coalesce(TRY_CAST(q AS BIGINT), 256) FOR q IN string_split(v, '.')]) <= 255",
    "card": "length(d) BETWEEN 14 AND 19 AND " + _LUHN.replace("x[k]", "string_split(reverse(d), '')[k]").replace("len(x)", "length(d)"),
    "phone": "length(d) BETWEEN 10 AND 15",
    "iban": "length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND " + _MOD97.replace("substr(v,", "substr(replace(v, ' ', ''),"),
    "ssn": "NOT regexp_matches(v, '^(000|666|9)') AND substr(v, 5, 2) <> '00' AND substr(v, 8, 4) <> '0000'",
}


_BORDER = " AND NOT regexp_matches(substr(t, greatest(s, 1), least(s, 1)), '[A-Za-z0-9]') AND NOT regexp_matches(substr(t, s + length(v) + 1, 1), '[A-Za-z0-9]')"


def _kind_sql(n: int, k: pii.Kind) -> str:
    pattern = _PLAIN.get(k.name, k.pattern)
    near = f"substr(t, greatest(s - {pii.BEFORE}, 0) + 1, s - greatest(s - {pii.BEFORE}, 0)) || chr(10) || substr(t, s + length(v) + 1, {pii.AFTER})"
    near = f"translate({near}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
a{n} AS (SELECT r, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d),
b{n} AS (SELECT r, t, unnest(range(1, len(m) + 1)) AS i, m, g FROM a{n} WHERE len(m) > 0),
c{n} AS (SELECT r, t, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS d, (list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::BIGINT AS s FROM b{n}),
k{n} AS (SELECT r, s, s + length(v) AS e, {n} AS kind, '{k.name}' AS name, least(100, {k.prior} + CASE WHEN regexp_matches({near}, '{k.words}') THEN {pii.CONTEXT} ELSE 0 END) AS score
         FROM c{n} WHERE {_CHECKS.get(k.name, 'TRUE')}{_BORDER if k.border else ''}){','}"""


ORACLES["op9_pii"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{''.join(_kind_sql(n, k) for n, k in enumerate(pii.KINDS))}
al AS ({' UNION ALL '.join(f'SELECT * FROM k{n}' + ('' if k.base else f' WHERE score >= {pii.ACCEPT}') for n, k in enumerate(pii.KINDS))}),
f AS (SELECT r, count(*) AS n_spans, count(*) FILTER (WHERE kind = 0) AS n_email, count(*) FILTER (WHERE kind = 1) AS n_ip, count(*) FILTER (WHERE kind = 2) AS n_card, count(*) FILTER (WHERE kind = 3) AS n_phone,
             string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < 4) AS base,
             string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans,
             string_agg(name || ':' || score, ',' ORDER BY s, kind) AS scores FROM al GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN f USING (r)
"""
