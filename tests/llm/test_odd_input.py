"""Rows that once ended a job: very long addresses, and tool calls of every broken kind."""

import json
import random
import re
from itertools import accumulate

from pyspark.sql import functions as F

from triage.llm import chat_tools, decontaminate, folds, packing, pii, secrets, toxicity
from triage.llm.queries import tokenizer


def test_long_addresses_and_texts(spark):
    labels = "x@" + "a." * 100_000 + "com"
    texts = [labels, "a" * 50_000 + "@b.test", "@" * 500_000, "1." * 500_000, "+1 " * 300_000, "9" * 1_000_000, "a@b..com, c@d.e1 f@g.example.org1", None, ""]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(1)
    made = {r.doc_id: r for r in pii.pseudonymise(given, "k").collect()}
    assert made[0].n_email == 1 and made[0].text.endswith(labels[1:]) and made[0].text != labels
    assert made[1].n_email == 1 and len(made[1].text) == len(texts[1]) and made[1].text != texts[1]
    assert [made[i].text for i in (2, 3, 4, 7, 8)] == [texts[i] for i in (2, 3, 4, 7, 8)]
    assert made[6].n_email == 2 and "c@d.e1" in made[6].text and made[6].text.endswith("@g.example.org1")
    back = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame([(i, r.text) for i, r in made.items()], "doc_id int, text string"), "k", inverse=True).collect()}
    assert [back[i] for i in range(9)] == texts
    assert pii.pseudonymise(given.limit(0), "k").count() == 0


def test_broken_tool_calls(spark):
    deep, wide = "[" * 100_000 + "]" * 100_000, "[" * 2_000 + "]" * 2_000
    schemas = {"any": "true", "none": "false", "sub": '{"properties":{"a":true,"b":false}}', "pattern": '{"properties":{"a":{"pattern":"("}}}',
               "required": '{"required":null}', "const": '{"properties":{"a":{"const":1}}}', "unknown": '{"properties":{"a":{"frobnicate":1}}}',
               "kinds": '{"properties":{"a":{"anyOf":[{"type":"string"},{"type":"integer","multipleOf":3}]},"b":{"oneOf":[{"minimum":2},{"maximum":5}]},'
                        '"c":{"not":{"enum":[1]}},"d":{"uniqueItems":true},"e":{"exclusiveMaximum":1}},"patternProperties":{"^x":{"type":"null"}},"additionalProperties":{"type":"boolean"}}',
               "list": "[1]", "words": '{"type":"object"}', "type": '{"type":"strange"}'}
    cases = [("any", '{"a":1}', "no_result"), ("none", '{"a":1}', "invalid"), ("sub", '{"a":1}', "no_result"), ("sub", '{"b":1}', "invalid"),
             ("pattern", '{"a":"x"}', "invalid"), ("required", "{}", "invalid"), ("const", '{"a":1.0}', "no_result"), ("const", '{"a":true}', "invalid"),
             ("unknown", '{"a":1}', "invalid"), ("kinds", '{"a":6,"b":1,"c":2,"d":[1,true],"e":0.5,"x1":null,"z":true}', "no_result"),
             ("kinds", '{"a":7}', "invalid"), ("kinds", '{"b":3}', "invalid"), ("kinds", '{"c":1}', "invalid"), ("kinds", '{"d":[1,1.0]}', "invalid"),
             ("kinds", '{"e":1}', "invalid"), ("kinds", '{"x":1}', "invalid"), ("kinds", '{"z":1}', "invalid"), ("list", "{}", "no_tool"),
             ("words", '{"a":"\\ud800","\\udfff":1}', "no_result"), ("words", '{"a":1e999}', "invalid"), ("words", '{"a":' + deep + "}", "invalid"),
             ("words", '{"a":' + wide + "}", None), ("words", '{"a":NaN}', "invalid"), ("words", "1", "invalid"), ("words", None, "invalid"),
             ("words", '{"a":1,"a":2}', "invalid"), ("type", "{}", "invalid"), (None, "{}", "no_tool"), ("words", '{"a":' + "9" * 5000 + "}", "invalid")]
    calls = spark.createDataFrame([(1, i, f"c{i}", n, a) for i, (n, a, _) in enumerate(cases)], "conv_id int, turn int, call_id string, name string, arguments string")
    results = spark.createDataFrame([], "conv_id int, turn int, call_id string, content string")
    tools = spark.createDataFrame(list(schemas.items()), "name string, schema string")
    got = {r.turn: r for r in chat_tools.link_calls(calls.repartition(1), results, tools).collect()}
    for i, (name, arguments, status) in enumerate(cases):
        assert status is None or got[i].status == status, (name, arguments[:50] if arguments else None, got[i])
    assert json.loads(got[18].message)["arguments"] == {"a": "�", "�": 1}
    plan = chat_tools.link_calls(calls, results, tools).limit(0)  # the join is planned inside
    assert plan.count() == 0


def test_canonical_json():
    value = {"b": [1.0, -0.0, 1e-7, 1e21, 123456789012345680000.0, 0.000001, 1.5, 10**30, True, None], "\U0001f600": 1, "￮": 2, "a": {}}
    assert chat_tools.canonical(value) == ('{"a":{},"b":[1,0,1e-7,1e+21,123456789012345680000,0.000001,1.5,1000000000000000000000000000000,true,null],"😀":1,"￮":2}')
    nested = []
    for _ in range(5_000):
        nested = [nested]
    assert chat_tools.canonical(nested) == "[" * 5001 + "]" * 5001


def spans_by_loops(text, model, base):
    """Base spans as given; runs whose pairs are likelier random, by a plain sum, that overlap no base span."""
    text, n = text or "", len(secrets.ALPHABET)
    out = list(base)
    for m in re.finditer(secrets.RUN, text):
        c = [secrets.ALPHABET.find(x) for x in m[0]]
        total = sum(round(model[a * n + b], 6) for a, b in zip(c, c[1:]))
        if total >= max(secrets.TOTAL_RATIO, secrets.MEAN_RATIO * (len(c) - 1)) and not any(a < m.end() and m.start() < z for a, _, z in base):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def base_by_loops(text):
    text, out = text or "", []
    for m in re.finditer(secrets.ASSIGN, text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_secrets_of_both_sorts_by_loops(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices(secrets.ALPHABET, k=n))
    word = lambda: "".join(rng.choices("aeiounrst", k=rng.randint(3, 12)))
    bits = [lambda: noise(rng.randint(14, 40)), word, lambda: "token=" + noise(12), lambda: "AKIA" + noise(20), lambda: "é😀", lambda: "%x" % rng.getrandbits(200),
            lambda: word() + "_" + word() + word(), lambda: "password: 'abc"]
    texts = ["".join(rng.choice(bits)() + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, ""]
    texts.append(" ".join(noise(20) + f" token={noise(9)}" for _ in range(6000)))
    given = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id int, text string, __base int").repartition(4)
    samples = [(noise(30), 1) for _ in range(300)] + [(word() + "_" + word(), 0) for _ in range(300)]
    model = secrets.train(spark.createDataFrame(samples, "value string, label int"))
    rows = secrets.scan(given.drop("__base"), model).collect()
    want = [spans_by_loops(t, model, base_by_loops(t)) for t in texts]
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert [(s.start, s.kind, s.stop) for s in r.secrets] == want[r.doc_id], r.text[:200]
    assert sum(k == 3 for w in want for _, k, _ in w) > 3000
    assert secrets.scan(given.limit(0), model).count() == 0


def test_running_folds(spark):
    lists = [[], [3], list(range(256)), list(range(257)), [5, -1] * 3000]
    given = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    got = {r.i: (r.a, r.b) for r in given.select("i", folds.before(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("a"),
                                                 folds.before(F.col("x"), F.greatest, F.lit(-9)).alias("b")).collect()}
    for i, x in enumerate(lists):
        assert got[i] == ([sum(x[:k]) for k in range(len(x))] if len(x) < 1000 else list(accumulate([0, *x[:-1]])), list(accumulate([-9, *x[:-1]], max)) if x else [])


def test_empty_tables_repeats_and_clashing_columns(spark):
    texts = ["you are a stupid idiot", None, "", "kind words", "you are a stupid idiot", "w " * 300_000, "one two three four five six seven eight nine ten eleven"]
    docs = spark.createDataFrame([(i % 5, t, 1, 2, "x", 0.5) for i, t in enumerate(texts)],
                                 "doc_id long, text string, sequence_id int, offset int, hits string, score double")
    labels = spark.createDataFrame([(0, 1), (3, 0), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = sorted((r.text or "", r.score) for r in toxicity.score(docs, model).collect())
    assert len(scored) == 7 and all(0 <= s <= 1 for _, s in scored) and len({s for t, s in scored if t.startswith("you")}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert len({r.score for r in toxicity.score(docs, nothing).collect()}) == 1

    items = spark.createDataFrame([("a", "Two three"), ("b", None), (None, "idiot"), ("a", "Two three")], "item_id string, text string")
    hits = {(r.doc_id, r.text): r.hits for r in decontaminate.find_hits(docs, items).collect()}
    assert [(hits[1, texts[6]].n_hit, hits[1, texts[6]].items), hits[0, texts[0]].n_hit, hits[1, None].n_words] == [(2, ["a"]), 1, 0]
    assert all(r.hits.n_hit == 0 for r in decontaminate.find_hits(docs, items.limit(0)).collect())
    assert decontaminate.find_hits(docs.limit(0), items).count() == 0

    parts = packing.pieces(docs, tokenizer())
    packed = packing.pack(parts).collect()
    assert sum(r.length for r in packed) == sum(len(packing.encode(t, tokenizer())) + 1 for t in texts)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer())).count() == 0
