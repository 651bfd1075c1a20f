"""Texts beyond the JSON parser's own limits come back whole."""

import json

from pyspark.sql import functions as F

from conftest import entry, texts
from triage.functions import gqltext, jsonwalk, urls
from triage.operators import endpoints, exchanges, graphql
from triage.sources import artifacts, captures


def test_capture_with_a_long_body(spark, exchange):
    rows = exchange(("a.har", [entry("https://a.test/x", text="k" * 21_000_000), entry("https://a.test/y", text="short")])).select(
        "url", F.length("response_body").alias("n")).collect()
    assert {r.url: r.n for r in rows} == {"https://a.test/x": 21_000_000, "https://a.test/y": 5}


def test_broken_captures_are_told_apart(spark):
    given = [("a", '{"log": {"entries": ['), ("b", '{"log": {}}'), ("c", "[]"), ("d", ""), ("e", '{"log": {"entries": []}}')]
    got = {r.source_file: r.reason for r in captures.har_rejects(spark.createDataFrame(given, "source_file string, text string")).collect()}
    assert got == {"a": "Invalid JSON in HAR file", "b": "HAR must contain a log.entries list", "c": "HAR root must be a JSON object",
                   "d": "HAR file is empty"}


def test_long_evidence_is_scanned(spark):
    content = bytearray(b"line\n" * 300_000 + b"Authorization: Bearer abcdefghijklmnop1234567890\n")
    got = artifacts.evidence_items(spark.createDataFrame([("/e/a.txt", content)], "path string, content binary")).first()
    assert got.contains_sensitive_data and "abcdefghijklmnop1234567890" not in got.redacted_evidence_text
    assert len(got.redacted_evidence_text) > 1_400_000


def test_source_map_with_a_long_source(spark):
    text = json.dumps({"version": 3, "sources": ["a.js"], "sourcesContent": ["x" * 21_000_000], "mappings": ""})
    parsed = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", artifacts.schemas.SOURCE_MAP, artifacts.schemas.JSON_LIMITS).alias("m"))
    assert parsed.select(F.length(F.get("m.sourcesContent", F.lit(0)))).first()[0] == 21_000_000


def test_graphql_evidence_is_whole(spark, exchange):
    """Whole blocks are redacted, then kept whole: no secret is cut in two where a prefix would end, and nothing after it is lost."""
    for cut in (1200, 1600):
        at = lambda head: head + "x" * (cut - len(head) - 8) + " "
        mail = "someone.long@example.test"
        body = {"query": at("query Q { a(x: \"") + mail + "\") tail } fragment F on T { " + at("a(x: \"") + mail + "\") tail }"}
        errors = json.dumps({"errors": [{"message": at("") + mail + " tail", "path": ["p"]}]})
        payloads = graphql.gql_payloads(exchange(("g.har", [entry("https://a.test/graphql", "POST", body=json.dumps(body), text=errors)])))
        docs = graphql.gql_documents(payloads)
        sdl = graphql.gql_schema_sdl(texts(spark, ("s.graphql", at("type Query { a: Int } # ") + mail + " tail")))
        ops = graphql.gql_operations(docs)
        leads = graphql.gql_leads(ops, payloads, sdl).where("evidence <> ''").select("category", "evidence").collect()
        assert {r.category for r in leads} == {"excessive_error_detail", "introspection_artifact"}
        found = [r[0] for df in (ops, graphql.gql_fragments(docs), sdl) for r in df.select("redacted_evidence").collect()]
        found += [r[0] for r in graphql.gql_errors(payloads).select("evidence").collect()] + [r.evidence for r in leads]
        assert len(found) == 6 and all("<redacted-email>" in t and "someone" not in t and "tail" in t for t in found)


def test_urls_of_any_length(spark):
    """A host is found behind any number of @ signs; patterns that repeat a group would end the JVM."""
    long = 500_000
    given = [("https://" + "a@" * long + "h.test/p?x=1", "h.test", "/p"), ("http://u:p@[::1]:80/x", "::1", "/x"), ("//q.test", "q.test", ""),
             ("https://" + "a" * long + "/" + "b/" * long, "a" * long, "/" + "b/" * long), ("mailto:x@y.test", "", "x@y.test"),
             ("http://h.test:80@evil.test:81/a@b", "evil.test", "/a@b")]
    rows = spark.createDataFrame([(u,) for u, _, _ in given], "url string").select(urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("p")).collect()
    assert [(r.h, r.p) for r in rows] == [(h, p) for _, h, p in given]


def test_json_bodies_of_any_shape(spark, exchange):
    """Repeated keys, NaN, lone surrogates, long numbers and deep nesting, against the built-in parser with its limits lifted."""
    deep = '{"d":' * 30_000 + '"v"' + "}" * 30_000
    given = {r'{"a":"\ud800x","\udfff":1,"p":"😀"}': ([("a", "�x"), ("�", "1"), ("p", "\U0001f600")], ["a", "�", "p"]),
             '{"a":{"gone":1},"a":{"b":[1,{"c":NaN}]},"e":-Infinity}': ([("b", "1"), ("c", "nan"), ("e", "-inf")], ["a", "e", "b", "c"]),
             '{"n":' + "9" * 6000 + "}": ([("n", "9" * 6000)], ["n"]), deep: ([("d", "v")], ["d"] * 30_000),
             '{"a":1': ([], []), "[1,2,]": ([], []), ' {"x":null} ': ([("x", "None")], ["x"]), "": ([], []), "null": ([], [])}
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(given)], "i int, b string").repartition(1)
    got = {r.i: r for r in rows.select("i", jsonwalk.body_leaves(F.col("b")).alias("leaves"), jsonwalk.json_keys(F.col("b")).alias("ks")).collect()}
    for i, (leaves, keys) in enumerate(given.values()):
        found = [(x["name"], x["value"]) for x in got[i].leaves if x["value"] != ""]
        assert (found, sorted(got[i].ks)) == (leaves, sorted(keys)), i
    ex = exchange(("a.har", [entry("https://a.test/graphql", "POST", body='{"query":"query Q { a }","variables":{"\\ud800":1},"v":' + "1" * 5000 + "}"),
                             entry("https://a.test/graphql", "POST", body='{"query":"query R { b }","x":' + "[" * 30_000 + "]" * 30_000 + "}")]))
    assert {r.operation_name for r in graphql.gql_operations(graphql.gql_documents(graphql.gql_payloads(ex))).collect()} == {"Q", "R"}
    assert exchanges.sensitive_material(ex).count() >= 0


def test_stack_parser_against_the_built_in_one():
    import random

    rng = random.Random(2)

    def value(depth=0):
        pick = rng.random()
        if depth > 4 or pick < 0.4:
            return rng.choice([1, -0.5, 1e20, True, None, "a\ud800b", 'x"\\', 12345678901234567890, ""])
        if pick < 0.7:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice("abc") + str(i): value(depth + 1) for i in range(rng.randint(0, 4))}

    def tried(parser, text):
        try:
            return repr(parser(text))
        except ValueError:
            return None

    for _ in range(3000):
        text = json.dumps(value(), indent=rng.choice([None, 2]))
        assert tried(jsonwalk._parse, text) == tried(json.loads, text) is not None
        at = rng.randrange(len(text))
        broken = text[:at] + rng.choice(["", "{", "}", ",", ":", '"', "1", "]", "["]) + text[at + 1 :]
        assert tried(jsonwalk._parse, broken) == tried(json.loads, broken), broken


def test_graphql_blocks_by_a_scan_per_head():
    """Every head read afresh, character by character, gives the same blocks as the one pass."""
    import random

    rng = random.Random(1)

    def end_of(text, start):
        depth, inside, i = 0, "", start
        while i < len(text):
            c = text[i]
            if inside == "#":
                inside = "" if c in "\r\n" else "#"
            elif inside == '"""':
                if text.startswith('\\"', i):
                    i += 1
                elif text.startswith('"""', i):
                    inside, i = "", i + 2
            elif inside:
                if c == "\\":
                    i += 1
                elif c == inside:
                    inside = ""
            elif text.startswith('"""', i):
                inside, i = '"""', i + 2
            elif c in "\"'`#":
                inside = c
            else:
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    return i + 1
            i += 1
        return None

    for _ in range(20_000):
        text = "".join(rng.choices(["{", "}", '"', "'", "`", "a", "#", "\n", '"""', "query {", "query x{"], k=rng.randint(1, 30)))
        if '""""' in text:  # which three of four signs belong together depends on where a reading begins
            continue
        for block in gqltext.find_blocks(text):
            brace = text.index("{", block["start"])
            end = end_of(text, brace)
            assert block["block"] == text[brace:end] if end else text[brace:].startswith(block["block"]), text


def test_graphql_heads_without_an_end_take_linear_room():
    for text in ("query a{ b " * 8000, "\"query a{ b' " * 8000, "query a{ # don't {\n" * 8000):
        assert sum(len(b["block"]) for b in gqltext.find_blocks(text)) <= 2 * len(text)


def test_schema_text_with_comments_and_descriptions(spark):
    sdl = ('"""\nThe root: type Ghost { x: Int }\n"""\ntype Query {\n  # old(a: Int): Int }\n  "not: a field"\n  user(id: ID = "}", o: O = {a: 1}): User\n'
           '  me: User @d(x: {k: "}"})\n}\n# type Gone { a: Int }\ntype User { id: ID }')
    r = graphql.gql_schema_sdl(texts(spark, ("s.graphql", sdl))).first()
    assert (r.type_names, r.query_names) == (["Query", "User"], ["me", "user"])


def test_many_urls_in_one_text(spark):
    """Strings are claimed by one sort, not by a search for each; order and first places are kept."""
    n = 30_000
    text = "\n".join(f"fetch('https://a.test/p/{i % 700}'); x = \"/api/{i % (n // 2)}\"" for i in range(n))
    got = endpoints.endpoints_from_text(texts(spark, ("a.js", text))).select("raw_url", "line").collect()
    calls = [r for r in got if r.raw_url.startswith("https://a.test/")]
    quoted = {r.raw_url: r.line for r in got if r.raw_url.startswith("/api/")}
    assert len(calls) == n and len(got) == n + n // 2
    assert quoted == {f"/api/{i}": i + 1 for i in range(n // 2)}
