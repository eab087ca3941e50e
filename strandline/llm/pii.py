"""Personal data: expressions propose spans, checks confirm them, and words nearby adjust the score.

Only DataFrame functions. Matches of a pattern are leftmost and do not overlap. Their places follow from the lengths of the
parts between them (``split``) and their own (``regexp_extract_all``), counted in code points.

Four base kinds are always reported when their check holds: email; ip (four parts up to 255); card (14 to 19 digits, Luhn);
phone (10 to 15 digits). Further kinds are reported when their score, a prior plus ``CONTEXT`` if a word of the kind stands
within ``BEFORE`` characters before or ``AFTER`` behind, reaches ``ACCEPT``: iban (mod 97, also in groups of four), ssn and pass
(a passport number), which need such a word, key (access key identifiers), and secret (assigned passwords and tokens). Those
written without a border of their own (iban, ssn, pass, key) count only where no letter or digit of ASCII adjoins. A match that
fails its check is dropped and its characters are not tried again.

Work is linear in the text and in its matches: starts are sums within blocks of ``RUN`` matches plus sums over blocks, and the
characters around a match are taken from the parts next to it, which are cut short once, never from the whole text. (A sum
within a block copies it, n * RUN / 2 numbers in all; the sums over blocks copy (n / RUN)^2 / 2: 3 million for 320 000 matches.)

The pattern of a kind only runs on texts with a character that the kind needs. Two patterns are written so that a long run of
letters or digits is walked once: a match can only start where a run starts, or where the match before it ended.

Null and empty texts have no spans. Repeated rows get the same result each; null identifiers stay; other columns are not read.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 40, 20
CONTEXT, ACCEPT = 25, 60
#: Matches in a block of sums; and how many parts next to a match cover BEFORE and AFTER, as a match has SHORTEST characters.
RUN, SHORTEST = 128, 5
_SPAN = "array<struct<start:int,kind:int,end:int,score:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """From the right, every second digit is doubled, less 9 if above 9; the sum is a multiple of 10."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35: the number's remainder by 97 is 1."""
    moved = F.split(F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: Callable[[Column], Column]
    check: Callable[[Column], Column] | None
    prior: int
    words: str
    base: bool = False
    border: bool = False


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", lambda t: F.contains(t, F.lit("@")), None, 80, "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: t.rlike(r"[0-9]\.[0-9]"),
         lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(256)) <= 255), 50, "ip|host|server|address", True),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", lambda t: t.rlike("[0-9][\\x20-]?[0-9]"), lambda v: luhn(_digits(v)), 70, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda v: F.length(_digits(v)).between(10, 15), 60, "phone|call|tel|mobile|fax", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", lambda t: t.rlike("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]"),
         lambda v: mod97(F.replace(v, F.lit(" "), F.lit(""))) & F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34), 80, "iban|account|bank|konto", border=True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda t: t.rlike("[0-9]-[0-9]"),
         lambda v: ~v.rlike("^(000|666|9)") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000"), 40, "ssn|social|security|tax", border=True),
    Kind("pass", r"[A-Z][0-9]{8}", lambda t: t.rlike("[A-Z][0-9]{8}"), None, 40, "passport|pasaporte|passeport|reisepass", border=True),
    Kind("key", r"AKIA[0-9A-Z]{16}", lambda t: F.contains(t, F.lit("AKIA")), None, 70, "key|access|aws", border=True),
    Kind("secret", r"(?:password|passwd|secret|token|api_key|apikey)\x20*[=:]\x20*\x22?[A-Za-z0-9+/_-]{8,}", lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), None, 60, "login|auth|credential"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda that names the expression itself would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Inclusive running sums of an array of numbers, which must be a variable or a column, in blocks."""
    longs = "array<bigint>"
    grown = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))
    summed = lambda x: F.aggregate(x, F.array().cast(longs), grown)
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int"))
    within = F.transform(blocks, lambda k: summed(F.slice(sizes, k * RUN + 1, F.lit(RUN))))

    def moved(w: Column) -> Column:
        first = F.aggregate(F.transform(w, lambda x: F.element_at(x, -1)), F.array(F.lit(0).cast("long")), grown)
        return F.flatten(F.zip_with(w, F.slice(first, F.lit(1), F.size(w)), lambda x, y: F.transform(x, lambda z: z + y)))

    return _let(within, moved)


def _near(matches: Column, heads: Column, tails: Column, k: Column) -> tuple[Column, Column]:
    """The BEFORE characters before match ``k`` (from 0) and the AFTER behind it, from short parts next to it."""
    before, after = -(-BEFORE // SHORTEST), -(-AFTER // SHORTEST)
    first = F.greatest(k - before, F.lit(0))
    pairs = F.zip_with(F.slice(tails, first + 1, k - first), F.slice(matches, first + 1, k - first), lambda g, m: F.concat(g, m))
    left = F.concat(F.array_join(pairs, ""), F.element_at(tails, k + 1))
    later = F.zip_with(F.slice(matches, k + 2, F.lit(after)), F.slice(heads, k + 3, F.lit(after)), lambda m, g: F.concat(m, g))
    return F.right(left, F.lit(BEFORE)), F.left(F.concat(F.element_at(heads, k + 2), F.array_join(later, "")), F.lit(AFTER))


def _placed(matches: Column, gaps: Column) -> Column:
    """Array of (start, end, value, before, after) for the matches, given the parts between them (one more)."""
    sizes = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
    heads, tails = F.transform(gaps, lambda g: F.left(g, F.lit(AFTER))), F.transform(gaps, lambda g: F.right(g, F.lit(BEFORE)))

    def rows(ends: Column, heads: Column, tails: Column) -> Column:
        def row(m: Column, k: Column) -> Column:
            before, after = _near(matches, heads, tails, k)
            end = F.element_at(ends, k + 1)
            return F.struct((end - F.length(m)).cast("int").alias("start"), end.cast("int").alias("end"), m.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(matches, row)

    return _let(sizes, lambda x: _let(_running(x), lambda ends: _let(heads, lambda h: _let(tails, lambda t: rows(ends, h, t)))))


def _spans(kind: Kind, order: int, matches: Column, gaps: Column) -> Column:
    """Confirmed and scored spans of a kind."""
    placed = _let(matches, lambda m: _let(gaps, lambda g: _placed(m, g)))
    if kind.check:
        placed = F.filter(placed, lambda x: kind.check(x["value"]))
    if kind.border:
        placed = F.filter(placed, lambda x: ~x["before"].rlike("[A-Za-z0-9]$") & ~x["after"].rlike("^[A-Za-z0-9]"))

    def scored(x: Column) -> Column:
        near = F.concat_ws("\n", x["before"], x["after"])
        score = F.lit(kind.prior) + F.when(_lower(near).rlike(kind.words), CONTEXT).otherwise(0)
        return F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end"), F.least(score, F.lit(100)).alias("score"))

    out = F.transform(placed, scored)
    return out if kind.base else F.filter(out, lambda x: x["score"] >= ACCEPT)


def _joined(spans: Column, part: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(spans, part), ",")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, text (null as empty) and spans: an array of (start, kind, end, score), by start and kind (its number in ``kinds``)."""
    t = F.col("text")
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *(F.when(k.needs(t), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m{n}") for n, k in enumerate(kinds)))
    rows = rows.select("*", *(F.when(F.size(f"m{n}") > 0, F.split(t, k.pattern, -1)).otherwise(none).alias(f"g{n}") for n, k in enumerate(kinds)))
    empty = F.array().cast(_SPAN)
    found = [F.when(F.size(f"m{n}") > 0, _spans(k, n, F.col(f"m{n}"), F.col(f"g{n}"))).otherwise(empty) for n, k in enumerate(kinds)]
    return rows.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))


def digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds and of all spans, and spans as texts."""
    base = [n for n, k in enumerate(kinds) if k.base]
    names = F.array(*(F.lit(k.name) for k in kinds))
    written = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    rated = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["score"].cast("string"))
    of = lambda n: F.filter("spans", lambda x: x["kind"] == n)
    counts = [F.size(of(n)).cast("long").alias(f"n_{kinds[n].name}") for n in base]
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id", *counts, F.sha2(_joined(own, written).cast("binary"), 256).alias("base_sha256"),
        F.size("spans").cast("long").alias("n_spans"), _joined(F.col("spans"), written).alias("spans"), _joined(F.col("spans"), rated).alias("scores"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    names = F.array(*(F.lit(f"<{k.name}>") for k in KINDS))
    # Spans that begin before an earlier one has ended are left out: the largest end so far is a fold over two numbers a span.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,score:int>>").alias("kept"))
    step = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["kept"], F.array(x)).alias("kept")))
    rows = find_pii(docs, doc_id, text).select("doc_id", "text", F.aggregate("spans", start, step, lambda a: a["kept"]).alias("s"))
    ends = F.concat(F.array(F.lit(0)), F.transform("s", lambda x: x["end"]))
    parts = F.zip_with(ends, F.col("s"), lambda e, x: F.concat(F.col("text").substr(e + 1, F.coalesce(x["start"], F.length("text")) - e), F.coalesce(F.get(names, x["kind"]), F.lit(""))))
    return rows.select("doc_id", F.array_join(parts, "").alias("text"))
