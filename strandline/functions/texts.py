"""Text functions, Column to Column. ASCII classes only, so that results don't depend on the regular-expression engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NO_RESULT = r"(?i)^[ \t\r\n]*(no[ \t\r\n]+match\.?|none|\(none\)|n/a|null|not[ \t\r\n]+found|–|-|—)[ \t\r\n]*$"
INVALID_PREFIXES = (
    "based on", "no match", "i couldn't", "i could not", "i was unable", "unfortunately", "i'm sorry", "i am sorry", "i don't", "i do not",
    "there is no", "there's no", "i cannot", "i can't", "it appears", "it seems", "after searching", "after extensive",
)
CHALLENGE_MARKERS = ("Just a moment", "Enable JavaScript and cookies to continue", "cf-browser-verification", "__cf_chl", "cf-chl-", "challenge-form")
CORPORATE_FORMS = ("llc", "inc", "corp", "ltd", "gmbh", "s.a.", "s.p.a.", "co ltd", "co., ltd", "bv", "pjsc", "plc", "limited", "ag", "nv", "oy", "ab", "sa", "sarl")


def is_no_match(text: Column) -> Column:
    """Blank or one of the phrases for "nothing found"; null is not."""
    return F.coalesce((F.trim(text) == "") | text.rlike(NO_RESULT), F.lit(False))


def is_unusable(text: Column) -> Column:
    """No answer: empty; or without URL and a refusal or a long sentence."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    start = t.rlike("^(" + "|".join(INVALID_PREFIXES) + ")")
    return F.when(t == "", True).when(t.rlike("https?://|www\\."), False).when(start, True).otherwise(F.contains(t, F.lit(" ")) & (F.length(t) > 30))


def first_line_or_no_match(text: Column) -> Column:
    """null for "no match", else the first line without outer blanks and backticks."""
    t = F.regexp_replace(text, "^[ \\t\\r\\n]*`*[ \\t\\r\\n]*|[ \\t\\r\\n]*`*[ \\t\\r\\n]*$", "")
    return F.when(~t.rlike("(?i)^no[ \\t\\r\\n]+match"), F.nullif(F.trim(F.get(F.split(t, "\\r?\\n"), F.lit(0))), F.lit("")))


def email_domain(address: Column) -> Column:
    """Lower-case part after the last ``@``; null without one. The address itself is not kept."""
    return F.when(F.contains(address, F.lit("@")), F.nullif(F.lower(F.trim(F.substring_index(address, "@", -1))), F.lit("")))


def asn_label(label: Column, form: str = "prefix") -> Column:
    """The number of a label, as four sources write it: ``prefix``: AS off in any case; ``letters``: all leading letters a and s
    off; ``two``: the first two characters off; ``upper``: these only where they are AS."""
    t = F.trim(label)
    forms = {"prefix": F.regexp_replace(t, "(?i)^AS", ""), "letters": F.regexp_replace(t, "^[ASas]+", ""), "two": F.substring(t, 3, 1 << 30), "upper": F.when(t.startswith("AS"), F.substring(t, 3, 1 << 30)).otherwise(t)}
    return forms[form]


def brand(name: Column) -> Column:
    """Name without commas, dots and words of corporate forms."""
    forms = sorted({w for form in CORPORATE_FORMS for w in re.sub("[.,]", "", form).split()} - {"co"})
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(name, "[.,]", ""), r"(?i)\bco ltd\b", " "), "[ \t]+"), lambda w: (w != "") & ~F.lower(w).isin(*forms))
    return F.array_join(words, " ")


def mentions(text: Column, name: Column) -> Column:
    """Whether a text has a name's brand in it, case aside; a name without one is in no text."""
    own = F.lower(brand(name))
    return F.coalesce((own != "") & F.contains(F.lower(text), own), F.lit(False))


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def strip_html(html: Column) -> Column:
    """Text of a page in linear time: scripts, styles and comments off, tags to spaces, common entities, white space joined."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def normalise_space(text: Column) -> Column:
    """Runs of blanks to one, three line ends or more to two, none at the ends."""
    t = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def visible_gate(html: Column) -> Column:
    """``accept`` from 120 visible characters, ``wait`` from 60, else ``reject``."""
    n = F.length(strip_html(html))
    return F.when(n >= 120, "accept").when(n >= 60, "wait").otherwise("reject")


def is_challenge(html: Column) -> Column:
    return F.substring(F.coalesce(html, F.lit("")), 1, 5000).rlike("|".join(CHALLENGE_MARKERS))


def language_tag(tag: Column) -> Column:
    """Two lower-case letters of a tag such as en-US or de_AT; null for anything else."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2})(?:[-_].*)?$", 1), F.lit(""))


def html_language(html: Column, detected: Column | None = None) -> Column:
    """Two letters from the lang attribute of the html tag, else from a content-language tag, else what a detector found in the
    text (a recorded column), else ``en``."""
    low = F.lower(F.coalesce(html, F.lit("")))
    tag = F.regexp_extract(low, r"<html[^>]*[ \t\n]lang=[\"']?([a-z]{2})", 1)
    meta = F.regexp_extract(low, r"content-language[\"'][^>]*content=[\"']([a-z]{2})", 1)
    return F.coalesce(F.nullif(tag, F.lit("")), F.nullif(meta, F.lit("")), *([language_tag(detected)] if detected is not None else []), F.lit("en"))


#: Bytes of a page that are turned into text.
HTML_BYTES = 5_000_000


def page_text(html: Column, most: int = HTML_BYTES) -> Column:
    """Text of a page within a cap of bytes. The patterns walk a page once, so no limit of time is needed."""
    raw = F.coalesce(html, F.lit("")).cast("binary")
    return strip_html(F.when(F.octet_length(raw) > most, F.regexp_replace(F.substring(raw, 1, most).cast("string"), "\ufffd+$", "")).otherwise(html))


def estimated_tokens(text: Column) -> Column:
    """Characters over 2.5, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 2.5).cast("long")


def parse_timestamp(text: Column) -> Column:
    """The strict form YYYY-MM-DDTHH:MM:SSZ, else any ISO-8601; without a zone it is UTC. Null where it can't be read."""
    strict = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))
    zoned = F.when(text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.regexp_replace(text, "Z$", "+00:00")).otherwise(F.concat(text, F.when(F.contains(text, F.lit(":")), F.lit("+00:00")).otherwise("T00:00:00+00:00")))
    return F.coalesce(strict, F.try_to_timestamp(zoned))


def parse_date(text: Column) -> Column:
    """YYYYMMDD, YYMMDD or dashed."""
    digits = F.regexp_replace(text, "[-/]", "")
    full = F.when(F.length(digits) == 6, F.concat(F.lit("20"), digits)).otherwise(digits)
    iso = F.regexp_replace(full, "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return F.when(full.rlike("^[0-9]{8}$"), iso.try_cast("date"))
