import json

from pyspark.sql import functions as F

from conftest import entry, texts
from triage import schemas
from triage.operators import auth_surface, endpoints, exchanges, reviews
from triage.sources import artifacts as art
from triage.sources import captures

JWT = ("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiJ1MSIsImlhdCI6MTcwNDA2NzIwMCwiZXhwIjoxODA0MDY3MjAwLCJyb2xlIjoiYWRtaW4iLC"
       "J0ZW5hbnRJZCI6InQxIn0.c2lnbmF0dXJl")


def capture():
    return ("one.har", [
        entry("https://app.example.test/api/users/12345?email=ana%40example.org", req=[("Authorization", f"Bearer {JWT}"), ("X-Api-Key", "k-123")],
              text='{"phone":"555-010-1234"}', resp=[("Cache-Control", "public, max-age=172800")]),
        entry("https://app.example.test/api/orgs/acme-corp/invoices/98765", "POST", 201, body='{"accountId":"a1","items":[{"sku":1}]}',
              resp=[("Set-Cookie", "session_id=abc; Path=/"), ("Access-Control-Allow-Origin", "*"),
                    ("Access-Control-Allow-Credentials", "true")]),
        entry("https://stats.tracker.test/collect?mail=ana%40example.org", status=204, mime="")])


def test_read_har_files_and_rejects(spark, tmp_path):
    good = {"log": {"entries": [entry("https://a.test/x"), entry("https://a.test/y", status="404")]}}
    files = {"good.har": json.dumps(good), "empty.har": " \n", "bad.har": '{"log": ', "list.har": "[1]", "no.har": '{"log":{}}',
             "item.har": '{"log":{"entries":[5]}}', "half.har": '{"log":{"entries":[{"request":{}}]}}',
             "status.har": '{"log":{"entries":[{"request":{},"response":{"status":"x"}}]}}', "skip.txt": "x"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    ex = captures.read_har(spark, str(tmp_path))
    assert sorted((r.url, r.status) for r in ex.collect()) == [("https://a.test/x", 200), ("https://a.test/y", 404)]
    rejects = {r.source_file.rsplit("/", 1)[-1]: r.reason for r in captures.read_har_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {
        "empty.har": "HAR file is empty", "bad.har": "Invalid JSON in HAR file", "list.har": "HAR root must be a JSON object",
        "no.har": "HAR must contain a log.entries list", "item.har": "Every HAR log.entries item must be an object",
        "half.har": "Every HAR entry must contain request and response objects", "status.har": "HAR response status must be an integer"}
    assert captures.read_har(spark, str(tmp_path), lenient=True).count() > 2


def test_summary(exchange):
    got = {(r.dimension, r.value): r.entries for r in exchanges.summarize(exchange(capture())).collect()}
    assert got[("method", "GET")] == 2 and got[("method", "POST")] == 1
    assert {v for d, v in got if d == "status"} == {"200", "201", "204"}
    assert got[("mime_type", "unknown")] == 1


def test_sensitive_material_names_places_not_values(exchange):
    rows = exchanges.sensitive_material(exchange(capture())).collect()
    assert {"bearer_token", "jwt", "api_key", "email", "phone_number"} <= {r.category for r in rows}
    assert {"request header", "query parameter", "response body"} <= {r.location for r in rows}
    leaked = json.dumps([r.asDict() for r in rows])
    for secret in (JWT, "k-123", "ana@example.org", "555-010-1234"):
        assert secret not in leaked


def test_header_lookup_last_duplicate_wins(exchange):
    ex = exchange(("h.har", [entry("https://a.test/", resp=[("X-A", "1"), ("x-a", "2"), (" Y ", "3")])]))
    row = exchanges.flatten_exchange(ex).first()
    assert row.response_headers == {"x-a": "2", "y": "3"}
    assert ex.select(exchanges.header(F.col("response_headers"), "x-a")).first()[0] == "2"


def test_endpoint_merge(exchange):
    observed = endpoints.endpoints_from_exchanges(exchange(capture(), ("two.har", [
        entry("https://app.example.test/api/users/77?page=", req=[("Cookie", "a=b")])])))
    merged = {(r.method, r.normalized_path): r for r in endpoints.merge_endpoints(observed).collect()}
    users = merged[("GET", "/api/users/{id}")]
    assert users.occurrences == 2 and users.path == "/api/users/12345" and users.source_file == "one.har"
    assert users.auth_indicators == ["API key", "bearer token", "cookie auth"]
    invoice = merged[("POST", "/api/orgs/{slug}/invoices/{id}")]
    assert {"billing", "idor-candidate", "state-changing"} <= set(invoice.risk_tags)
    assert {"accountId", "{id}", "{slug}"} <= set(invoice.object_id_candidates)
    values = {(r.field, r.value) for r in endpoints.endpoint_values(observed).filter(F.col("endpoint_id") == users.endpoint_id).collect()}
    assert {("query_params", "email"), ("query_params", "page"), ("json_keys", "phone"), ("status_codes", "200")} <= values
    asked = endpoints.checklist(endpoints.merge_endpoints(observed)).filter("category = 'billing'")
    assert asked.count() == 2 and asked.first().priority == "high"


def test_hot_endpoint_equals_brute_force(spark, exchange):
    """A third of all rows in one group: same counts and tags from 1 and 8 partitions."""
    rows = [entry(f"https://a.test/api/users/{i}?p{i % 7}=1") for i in range(60)]
    rows += [entry(f"https://a.test/p{i}/x", "POST") for i in range(120)]
    ex = exchange(("hot.har", rows))
    one = endpoints.merge_endpoints(endpoints.endpoints_from_exchanges(ex.coalesce(1))).collect()
    eight = endpoints.merge_endpoints(endpoints.endpoints_from_exchanges(ex.repartition(8))).collect()
    assert sorted(map(str, one)) == sorted(map(str, eight))
    hot = next(r for r in one if r.normalized_path == "/api/users/{id}")
    assert hot.occurrences == 60 and hot.path == "/api/users/0" and len(one) == 121


def test_endpoints_from_text_first_pattern_claims(spark):
    js = ('fetch("/api/users/12")\nfetch("/api/users/12")\naxios.post("https://h.test/orgs/acme")\n'
          'const a = "/api/users/12"; const b = "/admin/x"; const c = "https://h.test/orgs/acme";\nnew EventSource("/ev")\n"userId"')
    rows = endpoints.endpoints_from_text(texts(spark, ("a.js", js))).collect()
    got = sorted((r.raw_url, r.method, r.line) for r in rows)
    assert got == [("/admin/x", "UNKNOWN", 4), ("/api/users/12", "UNKNOWN", 1), ("/api/users/12", "UNKNOWN", 2),
                   ("/ev", "GET", 5), ("https://h.test/orgs/acme", "POST", 3)]
    html = endpoints.endpoints_from_text(texts(spark, ("f.html", '<form action="/api/pay"><input name="card.no"></form>'))).first()
    assert html.body_params == ["card.no"] and html.normalized_path == "/api/pay"


def test_cookie_reviews(exchange):
    ex = exchange(("c.har", [entry("https://a.test/", req=[("Cookie", "sid=1; theme=x")], cookies=[("csrf", "9")], resp=[
        ("Set-Cookie", "session=abc"), ("Set-Cookie", "__Host-t=1; Secure; Path=/x; Domain=.a.test"),
        ("set-cookie", "ok=1; Secure; HttpOnly; SameSite=Lax; Max-Age=60")])]))
    got = {r.name: r for r in reviews.review_cookies(ex).collect()}
    assert got["session"].cookie_type == "session" and not got["session"].secure and len(got["session"].observations) == 3
    assert got["ok"].observations == [] and got["ok"].max_age == "60" and got["ok"].same_site == "Lax"
    assert got["sid"].source == "request Cookie header" and got["csrf"].source == "request cookie"
    tags = {r.name: set(r.risk_tags) for r in reviews.cookie_observations(ex).collect()}
    assert tags["session"] == {"missing-secure", "missing-httponly", "missing-samesite"}
    assert {"broad-domain", "host-prefix-misuse"} <= tags["__Host-t"]
    assert tags["csrf"] == {"csrf-cookie-indicator"} and tags["ok"] == set()


def test_header_cors_cache_reviews(exchange):
    ex = exchange(capture())
    heads = {(r.entry_idx, r.header): r for r in reviews.review_headers(ex).collect()}
    assert heads[(1, "access-control-allow-origin")].classification == "needs manual review"
    assert heads[(0, "strict-transport-security")].value == "<missing>"
    cors = reviews.cors_observations(ex).first()
    assert {"wildcard-origin", "credentials-allowed", "wildcard-with-credentials"} == set(cors.risk_tags)
    cache = {r.entry_idx: r.observation for r in reviews.review_cache(ex).collect()}
    assert "public" in cache[0] and cache[1].startswith("No Cache-Control")
    tags = {r.entry_idx: r.risk_tags for r in reviews.cache_observations(ex).collect()}
    assert tags[0] == ["sensitive-response-public-cache", "sensitive-response-long-max-age"]
    csp = exchange(("s.har", [entry("https://a.test/", resp=[("Content-Security-Policy", "default-src *; script-src 'unsafe-eval'")])]))
    assert set(reviews.security_headers(csp).first().risk_tags) == {
        "csp-unsafe-eval", "csp-wildcard", "csp-missing-object-src", "csp-missing-frame-ancestors"}


def test_third_parties_and_findings(exchange):
    ex = exchange(capture())
    sens = exchanges.sensitive_material(ex)
    third = reviews.third_parties(ex).collect()
    assert [(r.host, r.request_count, r.methods, r.sensitive_categories) for r in third] == [("stats.tracker.test", 1, ["GET"], ["email"])]
    assert reviews.third_party_urls(ex).count() == 1
    found = reviews.har_findings(sens, reviews.review_cache(ex))
    assert found.count() == sens.count() + reviews.review_cache(ex).count()
    assert all(r.id.startswith("HAR-") and len(r.id) == 14 for r in found.select("id").collect())


def test_third_parties_scan_all_exchanges(exchange):
    """The first host's exchanges are scanned too: a host that redaction gives them can be an outside one, as in a capture redacted before."""
    ex = exchange(("a.har", [entry("https://app.test/"), entry("https://<redacted-email>/x"),
                             entry("https://me@app.test/y", req=[("X-CSRF-Token", "c1")], text="call 555-010-1234")]))
    found = {r.host: set(r.sensitive_categories) for r in reviews.third_parties(ex).collect()}
    assert set(found) == {"<redacted-email>"}
    assert found["<redacted-email>"] >= {"email", "csrf_token", "phone_number"}


def test_jwt(exchange, spark):
    tokens = auth_surface.jwt_candidates(exchange(capture()), texts(spark, ("t.txt", f"{JWT} and {JWT}")))
    rows = {r.source_file: r for r in auth_surface.decode_jwt(tokens, "2024-06-01 00:00:00").collect()}
    har, txt = rows["one.har"], rows["t.txt"]
    assert har.location == "HAR request" and txt.location == "local file" and txt.occurrences == 2
    assert set(har.risk_tags) == {"long-lifetime", "far-future-expiry", "admin-like-role", "missing-audience", "missing-issuer",
                                  "unusual-algorithm-manual-review", "tenant-claims"}
    assert har.roles == ["admin"] and har.lifetime_seconds == 100000000 and har.tenant_claims == ["tenantId"]
    merged = auth_surface.merge_observations(auth_surface.decode_jwt(tokens, "2024-06-01 00:00:00")).collect()
    assert [(r.source_file, r.occurrences) for r in merged] == [("one.har", 1)]
    assert JWT not in str(rows)


def test_jwt_edge_cases(spark):
    import base64
    enc = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    odd = f"{enc({'alg': 'none', 'kid': '??>>~~'})}.{enc({'exp': 10**17, 'scope': 'a b', 'scp': ['c'], 'aud': ['x'], 'iss': 'i'})}.sig-_"
    not_object = f"eyJ{'A' * 8}.eyJ{'A' * 8}.x"
    tokens = auth_surface.jwt_candidates(artifacts=texts(spark, ("a.txt", odd + " " + not_object)))
    rows = auth_surface.decode_jwt(tokens, "2024-06-01 00:00:00").collect()
    assert len(rows) == 1 and rows[0].exp is None and rows[0].scopes == ["a", "b", "c"] and rows[0].audience == ["x"]
    assert rows[0].key_id == "??>>~~" and "missing-exp" in rows[0].risk_tags


def test_auth_endpoints_and_leads(exchange, spark):
    ex = exchange(("a.har", [entry("https://a.test/auth/login", "POST"), entry("https://b.test/auth/login", "POST"), entry("https://a.test/x")]))
    found = auth_surface.auth_endpoints(ex, texts(spark, ("n.txt", "go to /account/forgot-password now")))
    assert {(r.host, r.path) for r in found.collect()} == {("a.test", "/auth/login"), ("b.test", "/auth/login"), ("", "/account/forgot-password")}
    assert auth_surface.auth_endpoints(ex, legacy_key=True).count() == 1
    leads = [r.question for r in auth_surface.session_leads(found, reviews.cookie_observations(ex)).orderBy("ord").collect()]
    assert len(leads) == 3 and "password reset" in leads[2]


def test_raw_http_texts(spark):
    ex = captures.raw_http_exchanges(texts(spark, ("q.txt", "GET / HTTP/1.1\nCookie: sid=1"), ("p.txt", "HTTP/1.1 200 OK\r\nSet-Cookie: auth=1"),
                                           ("n.txt", "plain words")))
    got = {r.source_file: (len(r.request_headers), len(r.response_headers)) for r in ex.collect()}
    assert got == {"q.txt": (1, 0), "p.txt": (0, 1)}


def test_artifact_scans_and_sinks(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.js").write_text("fetch('/api/x')")
    (src / "sub" / "b.HTML").write_text("<p>x</p>")
    (src / "c.bin").write_bytes(b"\x00\xff")
    found = art.read_artifacts(spark, str(src), [".js", ".html"])
    assert sorted((r.suffix, r.text) for r in found.collect()) == [(".html", "<p>x</p>"), (".js", "fetch('/api/x')")]
    import hashlib
    manifest = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in art.hash_manifest(spark, str(src)).collect()}
    assert manifest["c.bin"] == hashlib.sha256(b"\x00\xff").hexdigest() and len(manifest) == 3
    items = {r.title: r for r in art.evidence_items(spark.createDataFrame(
        [("x/a.txt", bytearray(b"mail a@b.com")), ("x/b.bin", bytearray(b"\x00a@b.com")), ("x/c", bytearray(b"\xff\xfe"))],
        "path string, content binary")).collect()}
    assert items["a.txt"].contains_sensitive_data and items["a.txt"].redacted_evidence_text == "mail <redacted-email>"
    assert items["b.bin"].contains_sensitive_data is None and items["c"].redacted_evidence_text == ""
    assert [items[k].not_scanned for k in ("a.txt", "b.bin", "c")] == ["", "Holds NUL bytes.", "Not valid UTF-8."]
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate(3 << 30)  # no disk is used
    huge = {r.path.rsplit("/", 1)[-1]: r for r in art.hash_manifest(spark, str(tmp_path), "*.bin").collect()}
    assert (huge["huge.bin"].size_bytes, huge["huge.bin"].sha256, huge["huge.bin"].not_hashed) == (3 << 30, None, art.TOO_LARGE)
    assert huge["c.bin"].not_hashed == ""
    table = spark.createDataFrame([("id", "write to a@b.com")], "id string, note string")
    art.write_inventory({"notes": table}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "notes")).first().note == "write to <redacted-email>"
    (tmp_path / "scope.json").write_text('{"in_scope": ["a.test"], "out_of_scope": ["b.test", "c.test"]}')
    assert sorted(map(tuple, art.scope_rules(spark, str(tmp_path / "scope.json")).collect())) == [
        ("in", 0, "a.test"), ("out", 0, "b.test"), ("out", 1, "c.test")]


def test_saved_artifact_types(spark):
    given = texts(spark, ("a.json", '{"endpoints":[],"hosts":[]}'), ("b.json", '{"actors":[],"objects":[],"expectations":[]}'),
                  ("c.json", '{"terms":[],"routes":[]}'), ("d.json", "[1]"), ("har-x.json", "{}"), ("r.md", "# x"))
    kinds = {r.source_file: r.artifact_type for r in art.detect_artifact_type(given).collect()}
    assert kinds == {"a.json": "endpoint_inventory", "b.json": "authz_matrix", "c.json": "vocabulary_inventory", "d.json": "json_report",
                     "har-x.json": "har_report", "r.md": "markdown_report"}


def test_only_changed_inputs_are_scanned_again(spark, tmp_path):
    from pyspark.sql import functions as F

    root, scanned = str(tmp_path / "store"), []

    def scan(changed):
        scanned.append(sorted(r.source_file for r in changed.collect()))
        return {"words": changed.select("source_file", F.explode(F.split("text", " ")).alias("word"))}

    def state(**files):
        given = spark.createDataFrame([(k, v) for k, v in files.items()], "source_file string, text string")
        return given.select(F.col("source_file").alias("path"), F.sha2("text", 256).alias("sha256")), given

    def reloaded(inputs):
        return sorted((r.source_file, r.word) for r in art.reload_inventory(inputs, root, "words").collect())

    inputs, given = state(a="x y", b="z", c="mail m@n.com")
    art.update_inventory(inputs, given, scan, root)
    assert scanned == [["a", "b", "c"]]
    assert reloaded(inputs) == [("a", "x"), ("a", "y"), ("b", "z"), ("c", "<redacted-email>"), ("c", "mail")]
    art.update_inventory(inputs, given, scan, root)  # nothing changed, so nothing is scanned
    assert len(scanned) == 1
    inputs, given = state(a="x y", b="new text", d="more")  # one changed, one gone, one new
    art.update_inventory(inputs, given, scan, root)
    assert scanned[1:] == [["b", "d"]]
    assert reloaded(inputs) == [("a", "x"), ("a", "y"), ("b", "new"), ("b", "text"), ("d", "more")]
    (tmp_path / "store" / "words" / "run=9").mkdir()  # a run that ended before its manifest
    spark.createDataFrame([("a", "lost")], "source_file string, word string").write.mode("overwrite").parquet(str(tmp_path / "store" / "words" / "run=9"))
    assert ("a", "lost") not in reloaded(inputs)
    inputs, given = state(a="x y", b="z", d="more")  # back to a content of before: the newest run counts, so it is scanned again
    art.update_inventory(inputs, given, scan, root)
    assert scanned[2:] == [["b"]] and reloaded(inputs)[2:] == [("b", "z"), ("d", "more")]
    art.write_inventory({"endpoints": spark.createDataFrame([], schemas.struct("endpoints"))}, str(tmp_path / "one"))
    assert art.read_inventory(spark, str(tmp_path / "one" / "endpoints"), "endpoints").count() == 0
