import json
import re

from pyspark.sql import functions as F

from triage import rules
from triage.functions import text as txt
from triage.functions import urls as U
from triage.functions.gqltext import balanced, find_blocks, walk_payload
from triage.functions.jsonwalk import body_leaves, json_keys


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_redaction_of_each_class(spark):
    given = ["Authorization: Bearer abc.def", "see bearer xyz123 here", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdef-ghi end",
             "Cookie: a=b; c=d", "api_key = 'abc123'", "csrf=tok123", "-----BEGIN PRIVATE KEY-----\nMII\n-----END PRIVATE KEY-----",
             "mail ana@example.org now", "call +1 (555) 010-1234 now", "nothing here", "éa@b.com", "token = abc"]
    out = column(spark, given, txt.redact)
    assert out[0] == "Authorization: Bearer <redacted-token>"
    assert out[1] == "see bearer <redacted-token> here"
    assert out[2] == "<redacted-jwt> end"
    assert out[3] == "Cookie: <redacted-cookie>"
    assert out[4] == "api_key = '<redacted-secret>'"
    assert out[5] == "csrf=<redacted-secret>"
    assert out[6] == "<redacted-private-key>"
    assert out[7] == "mail <redacted-email> now"
    assert out[8] == "call <redacted-phone> now"
    assert out[9:] == given[9:]


def test_redaction_pretest_is_necessary(spark):
    """Whatever the nine patterns change also passes the cheap test."""
    samples = ["Bearer x", "set-cookie: a", "PASSWORD:x", "xsrf = q", "oauth_code=1", "a@b.co", "5550101234", "sessionid=9", "passwd=1"]
    for value in samples:
        assert re.search(rules.REDACTION_PRETEST.replace("(?Udi)", "(?i)"), value)
    changed = column(spark, samples, lambda c: txt.contains_sensitive(c))
    assert all(changed)


def test_redaction_classes_withhold_values(spark):
    found = column(spark, ["mail a@b.com or bearer abcdef", "clean"], txt.redaction_classes)
    assert found == [["bearer token", "email address"], []]


def test_redact_struct_walks_nested_columns(spark):
    df = spark.createDataFrame(
        [({"password": "hunter2", "note": "a@b.com"}, [("x@y.org", 1)], "plain")],
        "ids map<string,string>, items array<struct<mail:string,n:int>>, token string")
    row = txt.redact_struct(df).first()
    assert row.ids == {"password": "<redacted-secret>", "note": "<redacted-email>"}
    assert row["items"][0].mail == "<redacted-email>" and row["items"][0].n == 1
    assert row.token == "<redacted-secret>"


def test_categories(spark):
    df = spark.createDataFrame([("Authorization", "Bearer abc"), ("q", "a@b.com"), ("code", "1"), ("x-api-key", ""), ("id", "5")],
                               "n string, v string")
    got = [r[0] for r in df.select(txt.categories(F.col("n"), F.col("v"))).collect()]
    assert got == [["bearer_token", "sensitive_key_value"], ["email"], ["oauth_authorization_code", "sensitive_key_value"],
                   ["api_key"], []]


def test_normalize_path(spark):
    pairs = {
        "/api/users/12345": "/api/users/{id}",
        "/api/orgs/acme-corp/invoices/98765": "/api/orgs/{slug}/invoices/{id}",
        "/f/123e4567-e89b-42d3-a456-426614174000": "/f/{uuid}",
        "/static/app.12345.js": "/static/app.12345.js", "/users/accounts/x9z": "/users/{slug}/x9z",
        "/users/{id}": "/users/{id}", "/users/ab": "/users/ab", "": "/", "/search": "/search", "/users/accounts/": "/users/{slug}/",
    }
    assert column(spark, list(pairs), U.normalize_path) == list(pairs.values())


def test_url_parts(spark):
    given = ["https://User@Host.Example:8443/a/b?x=1&y=#f", "/api/users/{id}?q=a b", "HTTP://[::1]:80/x", "nothing", "//cdn.x/y"]
    got = [tuple(r) for r in column(spark, given, U.url_parts)]
    assert got[0] == ("https", "User@Host.Example:8443", "host.example", "/a/b", "x=1&y=")
    assert got[1] == ("", "", "", "/api/users/{id}", "q=a b")
    assert got[2] == ("http", "[::1]:80", "::1", "/x", "")
    assert got[3] == ("", "", "", "nothing", "")
    assert got[4] == ("", "cdn.x", "cdn.x", "/y", "")


def test_query_params_and_decoding(spark):
    assert column(spark, ["a=1&b=&c&a=2&d%20e=x+y"], lambda c: U.query_params(c)) == [["a", "b", "c", "d e"]]
    assert column(spark, ["a=1&b=&c&a=2"], lambda c: U.query_params(c, False)) == [["a"]]
    assert column(spark, ["50%+%41", "a+b"], U.unquote) == ["50%+A", "a+b"]
    assert column(spark, ["50%+%41"], U.unquote_plus) == ["50% A"]


def test_json_keys_at_any_depth(spark):
    deep = {"k": 1}
    for _ in range(300):
        deep = {"d": [deep]}
    given = ['{"a":{"b":[{"c":1},{"c":"x\\"y\\":1"}]},"e\\"f":2,"\\\\":3}', json.dumps(deep), "[1,2", '{"a": "b", "u\\u00e9": 1}', "plain"]
    got = column(spark, given, json_keys)
    assert sorted(got[0]) == sorted(["a", "b", "c", "c", 'e"f', "\\"])
    assert got[1].count("d") == 300 and got[1].count("k") == 1
    assert got[2] == [] and got[4] == []
    assert got[3] == ["a", "ué"]


def test_body_leaves(spark):
    got = column(spark, ['{"a":[1,{"b":"x"},true],"n":null}', "u=1&v=a+b", "", "7"], body_leaves)
    assert [tuple(r) for r in got[0]] == [("a", "1"), ("b", "x"), ("a", "True"), ("n", "None")]
    assert [tuple(r) for r in got[1]] == [("u", "1"), ("v", "a b")]
    assert got[2] == [] and got[3] == []


def test_pattern_hits_number_lines_across_line_breaks(spark):
    got = column(spark, ["a\nbearer\nabcdefgh x\n\nbearer zzzzzzzz bearer yyyyyyyy"],
                 lambda c: txt.pattern_hits(c, r"(?Udi)\bbearer\s+[a-z]{8}", (0,)))[0]
    assert [(h.line, h.g0) for h in got] == [(2, "bearer\nabcdefgh"), (5, "bearer zzzzzzzz"), (5, "bearer yyyyyyyy")]


def test_line_list_splits_like_text_lines(spark):
    given = "a\r\nb\x0bc d\n"
    assert column(spark, [given, "", "x"], txt.line_list) == [given.splitlines(), [], ["x"]]


def test_balanced_blocks_respect_quotes():
    assert balanced('{ a(x: "}") { b } } tail', 0) == '{ a(x: "}") { b } }'
    assert balanced("{ open", 0) == "{ open"
    assert balanced('{ "a \\" } b" } c', 0) == '{ "a \\" } b" }'
    ops = find_blocks("query Q($id: ID!) { a { b } } fragment F on T { c }")
    assert [(o["kind"], o["name"], o["block"]) for o in ops] == [("operation", "Q", "{ a { b } }"), ("fragment", "F", "{ c }")]


def test_payload_walk():
    found = walk_payload('[{"query":"{ a }","operationName":"Op"},{"x":{"query":"{ b }","variables":{"v":1}}},{"query":"q"}]')
    assert [f["text"] for f in found if f["kind"] == "document"] == ["{ a }", "{ b }", "q"]
    assert [f["n"] for f in found if f["kind"] == "batch"] == [2]
    assert [f["text"] for f in found if f["kind"] in ("variable", "operation")] == ["Op", "v"]
    assert walk_payload("{bad") == []
