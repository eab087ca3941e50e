"""Scalar rules and routing on tables of cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import fuzzy, responses, texts, urls
from strandline.operators import routing
from strandline.plans import website


def values(spark, cases, column, kind="string"):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, x {kind}")
    return [r.v for r in rows.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def test_website_keys(spark):
    cases = {"http://Example.com:8080/x": "example.com", "https://user@www.example.com/": "example.com", "example.org/a": "example.org", "": None, "chrome-error://chromewebdata/": None, "about:blank": None, "data:text/html,x": None, "javascript:void(0)": None, None: None}
    assert values(spark, list(cases), urls.website_key) == list(cases.values())


def test_internal_urls(spark):
    assert values(spark, ["", "chrome-error://x", "about:neterror?id=1", "https://example.com"], urls.is_internal) == [True, True, True, False]


def test_redirects(spark):
    cases = [
        ("http://a.example.com", None, ("http://a.example.com", True, "")), ("http://a.com/", "HTTP://A.com", ("HTTP://A.com", True, "")),
        ("http://a.com", "https://login.live.com:443/x", ("http://a.com", False, "unreachable")), ("a.com", "https://b.com/", ("a.com", False, "unreachable")),
        ("a.com", "https://www.a.com/x;jsessionid=1", ("a.com", True, "messy_redirect_cleaned")), ("a.com", "https://a.com/" + "p" * 61, ("a.com", True, "messy_redirect_cleaned")),
        ("a.com", "https://a.com/home", ("https://a.com/home", True, "")),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = rows.select("k", urls.classify_redirect(F.col("a"), F.col("b")).alias("c")).orderBy("k").collect()
    assert [tuple(r.c) for r in got] == [c for _, _, c in cases]


def test_variants_and_suffixes(spark):
    assert values(spark, ["www.a.com/x"], urls.variants) == [["https://a.com/x", "https://www.a.com/x", "http://a.com/x", "http://www.a.com/x"]]
    assert values(spark, ["a.b.c"], urls.suffixes) == [["a.b.c", "b.c", "c"]]


def test_answers(spark):
    assert values(spark, ["No match.", "NONE", "", "n/a", "nomad", None], texts.is_no_match) == [True, True, True, True, False, False]
    assert values(spark, ["", "see https://a.com", "I could not find it", "a b " * 20, "example.com"], texts.is_unusable) == [True, False, True, True, False]
    assert values(spark, ["[x](https://a.com/b) c", "visit www.a.com/q now", "it is a-b.co.uk.", "none"], urls.first_url) == ["https://a.com/b", "www.a.com/q", "a-b.co.uk", None]
    assert values(spark, ["`https://a.com`\nbecause", "no  match at all", "x"], texts.first_line_or_no_match) == ["https://a.com`", None, "x"]


def test_texts(spark):
    assert values(spark, ["a@B.com", "x", "a@b@c.org", None], texts.email_domain) == ["b.com", None, "c.org", None]
    assert values(spark, ["AS123", "as5", "77"], texts.asn_label) == ["123", "5", "77"]
    assert values(spark, ["Foo, Inc.", "Bar GmbH", "Limited Edition Co"], texts.brand)[:2] == ["Foo", "Bar"]
    assert [str(v) for v in values(spark, ["20240102", "240102", "2024-01-02", "2024/01/02", "x", "20241399"], texts.parse_date)] == ["2024-01-02"] * 4 + ["None"] * 2
    assert values(spark, ["<p>a &amp; b</p><script>x</script>", None], texts.strip_html) == ["a & b", ""]


def test_public_suffix_labels(spark):
    suffixes = spark.createDataFrame([("co.za",), ("com.br",), ("lviv.ua",), ("com",), ("ua",)], "suffix string")
    hosts = {"bakwenatelecoms.co.za": ("bakwenatelecoms", "bakwenatelecoms.co.za"), "a.b.netwave.com.br": ("netwave", "netwave.com.br"), "network.lviv.ua": ("lviv", "network.lviv.ua"), "x.example.com": ("example", "example.com")}
    rows = website.with_public_suffix(spark.createDataFrame([(h,) for h in hosts], "host string"), "host", suffixes)
    got = {r.host: (r.a, r.b) for r in rows.select("host", website.sld_label(F.col("host"), F.col("public_suffix")).alias("a"), website.registrable(F.col("host"), F.col("public_suffix")).alias("b")).collect()}
    assert got == hosts


ROUTES = [
    (4, 5999, True, False, "luna", "short_prompt_le_6000"), (0, 6000, True, False, "luna", "short_prompt_le_6000"), (0, 6001, True, False, "terra", "long_prompt_gt_6000"), (5, 10, True, False, "terra", "prior_categories_ge_5"),
    (None, 100, True, False, "terra", "missing_previous_classification"), (7, 100, False, False, "terra", "missing_previous_classification"), (2, 100, True, True, "terra", "ambiguous_previous_classification"),
]


def route(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, p int, t long, h boolean, a boolean")
    return [tuple(r.r) for r in df.select("k", routing.route(F.col("p"), F.col("t"), F.col("h"), F.col("a")).alias("r")).orderBy("k").collect()]


def test_routes(spark):
    assert route(spark, [r[:4] for r in ROUTES]) == [(f"gpt-5.6-{m}", why) for *_, m, why in ROUTES]
    grid = [(p, t, h, False) for p in range(8) for t in (500, 3000, 6000, 6001, 9000, 20000) for h in (True, False)]
    assert [m.endswith("luna") for m, _ in route(spark, grid)] == [h and p < 5 and t <= 6000 for p, t, h, _ in grid]
    for bad in ((0, -1, True, False), (-1, 5, True, False)):
        with pytest.raises(Exception, match="negative"):
            route(spark, [bad])


def test_contracts(spark):
    assert values(spark, ["2026-08-31", "20260831-backfill", "2026-09-01", "2026-09", "snapshot_20260901"], routing.contract_for) == ["legacy", "legacy", "current", "current", "current"]
    with pytest.raises(Exception, match="no date"):
        values(spark, ["not-a-date"], routing.contract_for)


def line(content=None, refusal=None):
    return json.dumps({"custom_id": "p", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": content, "refusal": refusal}, "finish_reason": "stop"}]}}})


def test_responses(spark):
    ids = lambda *x: line(json.dumps({"category_ids": list(x)}))
    cases = [
        (ids("C001", "C002", "C001"), ["one", "two"], "ok"), (ids("C097"), [], "ok"), (ids("C097", "C097"), [], "ok"), (ids(), [], "contract_violation"), (ids("C999", "C001", "nope"), ["one"], "contract_violation"),
        (ids("C001", 5), ["one"], "contract_violation"), (ids("C097", "C001"), ["one"], "contract_violation"), (line(None, "no"), [], "refusal"), (line(""), [], "empty"), (line("not json"), [], "invalid_json"),
        (line([{"type": "text", "text": '{"category_ids": '}, '["C002"]}']), ["two"], "ok"), ("broken", [], "empty"),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, line string").select("k", responses.chat_parts(F.col("line")).alias("p")).select("k", "p.*")
    got = responses.classify(rows, "text", "refusal", {"C001": "one", "C002": "two"}).orderBy("k").collect()
    assert [(r.categories, r.status) for r in got] == [(c, s) for _, c, s in cases]
    legacy = responses.classify(spark.createDataFrame([("It is One.", None), ("zero", None)], "text string, refusal string"), "text", "refusal", {"C001": "one"}, legacy=True).collect()
    assert [(r.categories, r.status) for r in legacy] == [(["one"], "legacy_name_match"), ([], "invalid_json")]


def test_output_text(spark):
    x = json.dumps({"output": [{"type": "reasoning", "content": [{"text": "r"}]}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"text": "b"}]}]})
    assert values(spark, [x], lambda c: responses.output_text(c, True)) == ["ab"] and values(spark, [x], responses.output_text) == ["rab"]
    assert values(spark, ['{"body": {"model": "m"}}', "x"], responses.request_model) == ["m", None]


def plain_partial_ratio(a, b):
    """By the definition: every window of the longer text, each with a table of common subsequences."""

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            diagonal = 0
            for k, d in enumerate(y, 1):
                diagonal, row[k] = row[k], diagonal + 1 if c == d else max(row[k], row[k - 1])
        return row[-1]

    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, m = len(short), len(long)
    best = max(200 * common(short, w) / (n + len(w)) for w in {long[max(0, k):k + n] for k in range(1 - n, m)})
    return best if n != m else max(best, max(200 * common(long, w) / (n + len(w)) for w in {short[max(0, k):k + n] for k in range(1 - n, n)}))


def test_partial_ratio():
    for a, b, v in (("net", "network", 100), ("", "", 100), ("", "a", 0), ("abc", "xabyc", 200 * 2 / 6), ("abcd", "abcd", 100), ("ab", "ba", 200 / 3)):
        assert fuzzy.partial_ratio(a, b) == pytest.approx(max(v, plain_partial_ratio(a, b))), (a, b)
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choices("abcé日", k=n))
    pairs = [(word(rnd.randint(0, 14)), word(rnd.randint(0, 20))) for _ in range(400)] + [(word(70), word(75)), (word(64), word(3)), (word(63), word(64))]
    got = fuzzy.partial_ratios(*zip(*pairs))
    assert got == pytest.approx([plain_partial_ratio(a, b) for a, b in pairs])
    assert got == pytest.approx(fuzzy.partial_ratios(*zip(*((b, a) for a, b in pairs))))


def plain_label(line, taxonomy, form):
    """The label that a line stands for, all labels scored with all parts."""
    import difflib

    top = lambda x: form[x.split(" - ", 1)[0]]
    words = lambda x: [w for w in re.split("[ ,-]+", form[x]) if w]
    best = None
    for k, label in enumerate(taxonomy):
        a, b, wa, wb = form[line], form[label], words(line), words(label)
        lead = next((i for i, (x, y) in enumerate(zip(wa, wb)) if x != y), min(len(wa), len(wb)))
        prefix = lead / min(len(wa), len(wb)) if wa and wb else 0
        short, long = sorted((a, b), key=len)
        contain = len(short) / len(long) if short and short in long else 0
        bonus = 0 if " - " not in line else fuzzy.SAME_TOP if top(line) == top(label) else fuzzy.OTHER_TOP
        score = 0.45 * prefix + 0.25 * contain + 0.2 * difflib.SequenceMatcher(None, a, b).ratio() + 0.1 * len(set(wa) & set(wb)) / max(1, len(set(wa) | set(wb))) + bonus
        if a == b:
            return label
        if best is None or score > best[0]:
            best = score, max(prefix, contain), label
    return best[2] if best[0] >= 0.72 or best[1] >= 0.78 else None


def extracted(spark, texts, taxonomy):
    labels = spark.createDataFrame(list(enumerate(taxonomy)), "ordinal int, label string")
    return {r.t: r.labels for r in fuzzy.extract_labels(spark.createDataFrame([(t,) for t in texts], "t string"), "t", labels, "label").collect()}


def test_labels(spark):
    taxonomy = ["Media - Radio", "Media - Television", "Finance & Banks", "Health - Hospitals"]
    cases = {
        "1. media - radio\n2) Finance and Banks": ["Media - Radio", "Finance & Banks"], "- Health - Hospital": ["Health - Hospitals"], "": [],
        'see "Media – Televisions" and ﬁnance & banks': ["Media - Television", "Finance & Banks"], "Resulting categories: health hospitals": [], "radio": [],
    }
    assert extracted(spark, [*cases, None], taxonomy) == cases


def test_lines_get_the_best_of_all_labels(spark):
    """Pruning by bounds loses no label: random lines against scores of every pair."""
    rnd = random.Random(8)
    words = ["media", "radio", "tv", "bank", "banks", "finance", "health", "care", "school", "online", "service", "services"]
    phrase = lambda: " - ".join(" ".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(rnd.randint(1, 2)))
    taxonomy = list(dict.fromkeys(phrase() for _ in range(40)))
    lines = list(dict.fromkeys(x for x in (phrase() + rnd.choice(["", "s", " x"]) for _ in range(200)) if len(re.split("[ -]+", x)) > 1))
    forms = {x.t: x.f for x in spark.createDataFrame([(x,) for x in {*taxonomy, *lines, *(y.split(" - ", 1)[0] for y in [*taxonomy, *lines])}], "t string").select("t", fuzzy.normal_form(F.col("t")).alias("f")).collect()}
    got = extracted(spark, lines, taxonomy)
    for line in lines:
        direct = [x for x in taxonomy if x in line]
        want = plain_label(line, taxonomy, forms)
        assert got[line] == list(dict.fromkeys(direct + [x for x in taxonomy if forms[x] in forms[line]] + ([want] if want else []))), line


def test_prior_classes(spark):
    sets = spark.createDataFrame([("foo", ["a"]), ("foo", ["b"]), ("bar", list("edcba")), ("baz", []), ("qux", ["a"]), ("qux", [])], "key string, c array<string>")
    index = routing.prior_class_index(sets, "key", "c")
    assert {r.key: (r.status, len(r.categories)) for r in index.collect()} == {"foo": ("ambiguous", 2), "bar": ("ok", 5), "baz": ("zero_categories", 0), "qux": ("ok", 1)}
    prompts = spark.createDataFrame([("p1", ["qux", "baz"]), ("p2", ["bar", "qux"]), ("p3", ["none"]), ("p4", ["foo"])], "p string, keys array<string>")
    got = {r.p: r.status for r in routing.prior_lookup(prompts, "p", "keys", index, "key").collect()}
    assert got == {"p1": "ok", "p2": "ambiguous", "p3": "missing", "p4": "ambiguous"}


def test_prices(spark):
    price = lambda *rows: spark.createDataFrame(list(rows), "model string, price_in double, price_out double")
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    got = {r.model: r.price_in for r in routing.resolve_prices(models, price(("a", 1.0, 2.0)), price(("a", 5.0, 5.0), ("b", 3.0, 4.0)), None).collect()}
    assert got == {"a": 1.0, "b": 3.0, "c": None}
    for bad in (float("nan"), float("inf"), -1.0):
        with pytest.raises(Exception, match="price"):
            routing.resolve_prices(models, price(("a", bad, 1.0)), price(), None).collect()


def test_registry_rules(spark):
    from strandline.operators import registry

    frame = spark.createDataFrame
    assert [r.d for r in registry.drop_listed(frame([("gmail.com",), ("a.org",), (None,)], "d string"), "d").collect()] == ["a.org", None]
    pairs = frame([("n", "", "d"), ("n", None, "d"), (None, None, None)], "a string, o string, d string").select(registry.name_pair(F.col("a"), F.col("o"), F.col("d")).alias("p"))
    assert [tuple(r.p) for r in pairs.collect()] == [("n", ""), ("n", "d"), ("", "")]
    parts = [frame([("1", "a", "o", "d"), ("2", "b", "o", "d")], "asn string, as_name string, org string, descr string"), frame([("1", "z", None, "d")], "asn string, as_name string, org string, descr string")]
    assert {r.asn: (r.as_name, r.org) for r in registry.identities(parts).collect()} == {"1": ("z", None), "2": ("b", "o")}
    orgs = frame([("ASN", " as1 ", "org-1"), ("asn", "AS2", "X@AUT-AS"), ("NET", "AS3", "ORG-3")], "type string, asn string, org string")
    assert [tuple(r) for r in registry.organisation_handles(orgs).collect()] == [("1", "ORG-1")]
    tags = frame([("2026-01-01", True, True), ("2026-03-01", True, True), ("2026-06-01", True, False), ("2026-09-01", True, True)], "tag string, has_mapping boolean, has_class boolean")
    assert registry.previous_pair(tags, "tag", "2026-09-01").first()[0] == "2026-03-01" and registry.latest_before(tags, "tag", "2026-01-01").first()[0] is None
    maps = frame([({"a": "1", "b": "2"},)], "m map<string,string>").select(registry.probe_map(F.col("m"), [F.lit("x"), F.lit("b"), F.lit("a")]).alias("v"))
    assert maps.first().v == "2"
    prompts, seeds = frame([("p", "1", "s"), ("q", "9", "t")], "prompt string, asn string, seed string"), frame([("1", "s"), ("2", "s")], "asn string, seed string")
    assert {r.prompt: r["keys"] for r in registry.seed_fan_out(prompts, "prompt", "asn", seeds, "seed").collect()} == {"p": ["1", "2"], "q": ["9"]}
    assert values(spark, ["Éa Ñ"], lambda c: registry.fold_accents(c, {"é": "e", "ñ": "n"})) == ["ea n"]


def test_partial_table_equals_pairs():
    r = random.Random(5)
    some = lambda: ["".join(r.choice("abcé01") for _ in range(r.choice([0, 1, 2, 5, 8, 18, 18, 31, 32, 33, 62, 63, 64, 70]))) for _ in range(40)]
    left, right = some(), some()
    want = fuzzy.partial_ratios([a for a in left for _ in right], [b for _ in left for b in right]).reshape(40, 40)
    assert (fuzzy.partial_table(left, right) == want).all()


def test_best_in_blocks_makes_no_row_a_pair(spark):
    """The same rows as scores of all pairs, in parts of any size, and without a plan that joins single rows."""
    r = random.Random(6)
    word = lambda: r.choice([None, "", "Ä-Net", *("".join(r.choice("abAB1") for _ in range(r.randint(1, 9))) for _ in range(9))])
    left = [(r.choice([1, 2, None]), word(), word()) for _ in range(50)]
    right = [(r.choice([1, 2, 3, None]), word()) for _ in range(40)]
    low = lambda t: (t or "").lower()
    scores = {(b, n, o, v): 0.5 * fuzzy.partial_ratio(low(v), low(n)) + 0.5 * fuzzy.partial_ratio(low(v), low(o)) for b, n, o in left for c, v in right if b is not None and b == c}
    best = {}
    for (b, n, o, _), s in scores.items():
        best[b, n, o] = max(s, best.get((b, n, o), 0.0))
    want = sorted(((*k, s) for k, s in scores.items() if s == best[k[:3]]), key=str)
    a, b = spark.createDataFrame(left, "b int, n string, o string"), spark.createDataFrame(right, "b int, v string")
    for chunk in (1, 7, 2048):
        assert sorted(map(tuple, fuzzy.best_in_blocks(a, b, "b", "n", "o", "v", chunk).collect()), key=str) == want
