"""Each operator against plain loops, on the smallest tables and on rows with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import json
import math
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.llm import (chat_tools, decontaminate, embed_join, line_chunks, ngram_join, packing, pii, secrets, suffix_dedup, toxicity)
from triage.llm.common import components
from triage.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeats, a null id, one very long text."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(70)
    texts = [base, base, base.replace(base.split()[40], "zzz", 1), None, "", "  \n", "one", "one", say(30) + passage + say(20),
             say(25) + " " + passage, passage, "é" * 60 + say(5), "a" * 300, "b" + "a" * 200, say(30_000), "x\ny\nz\nw", "x\ny\nz\nw"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, odd, k, percent):
    for given in (docs, odd):
        got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.link(given, k=k, percent=percent).collect()}
        assert got == brute.ngram_join(rows_of(given), k, percent)
    assert ngram_join.link(docs.limit(0)).count() == 0


def test_ngram_join_at_the_threshold(spark):
    rng, rows = random.Random(1), []
    for n in (4, 5, 6, 8, 12, 20, 21, 40, 90, 200):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((len(rows), " ".join(words)))
            for cut in range(1, max(2, n // 8)):
                rows.append((len(rows), " ".join(words[cut:])))
                rows.append((len(rows), " ".join(words[: n - cut // 2] + [f"v{len(rows)}"])))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.link(given, k=3, percent=percent).collect()}
        assert got == brute.ngram_join(rows, 3, percent)


def test_ngram_join_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    monkeypatch.setattr(ngram_join, "FRAGMENT", 20)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(40):
        own = base[: rng.randint(40, 60)]
        own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.link(
        spark.createDataFrame(rows, "doc_id long, text string"), k=2, percent=80).collect()}
    assert got == brute.ngram_join(rows, 2, 80)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(20, 60)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{x: 5 for x in range(20, 60)}}


@pytest.mark.parametrize("size,limit", [(10, 1 << 25), (6, 1500)])
def test_decontamination(spark, docs, odd, size, limit):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionAll(spark.createDataFrame(
        [(900, "one"), (901, None), (902, ""), (903, " ".join(rows_of(odd)[10][1].split()[3:20])), (None, "x y z"), (903, "zzz")], "item_id long, text string"))
    want = [(r.item_id, r.text) for r in items.collect()]
    for given in (docs, odd):
        hits = decontaminate.find_hits(given.withColumn("hits", F.lit(1)), items, size=size, block_bytes=limit)
        got = {r.doc_id: (r.h.n_words, r.h.n_hit, len(r.h["items"]), hashlib.sha256(",".join(r.h["items"]).encode()).hexdigest(), r.h.n_hit > 0)
               for r in hits.select("doc_id", F.col("hits").alias("h")).collect()}
        assert got == brute.decontamination(rows_of(given), want, size)
        for r in decontaminate.without_spans(hits).join(given.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
            assert (r.text == r.old) == (r.hits.n_hit == 0)


def test_suffix_dedup(spark, docs, odd):
    for given in (docs, odd):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest_rows(
            suffix_dedup.repeated_spans(given)).collect()}
        assert got == brute.suffix_removal(rows_of(given))
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    """Each keeps its own spans; neither is a repeat of the other."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common, other = word(80), word(300)
    given = spark.createDataFrame([(1, word(90) + common), (5, common + other), (5, other + word(200)), (None, common)], "doc_id long, text string")
    got = {r.text: [tuple(s) for s in r.spans] for r in suffix_dedup.repeated_spans(given).collect()}
    assert [got[r.text] for r in given.collect()] == [[], [(0, 80)], [], []]


def test_contexts_that_may_repeat():
    assert suffix_dedup.may_repeat([b"abcdefgh", b"xbcdefgy", b"12345", b"0000000"], 5).tolist() == [True, True, False, True]


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in [*range(1, 30), 300]:
        for letters in (1, 2, 200):
            t = rng.integers(1, letters + 1, n)
            assert suffix_dedup.suffix_order(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
            assert decontaminate.suffix_array(np.append(t, 0)).tolist() == sorted(range(n + 1), key=lambda i: np.append(t, 0)[i:].tolist())


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer())
    for given in (docs, odd):
        rows = packing.pack(packing.pieces(given, tokenizer())).collect()
        by, seq = {}, {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
            seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for d, t in rows_of(given):
            ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            at = 0
            for r in sorted(by[d], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), __import__("zlib").crc32(ids[at : at + r.length].tobytes()))
                at += r.length
            assert at == len(ids)
        assert sorted(seq) == list(range(len(seq)))
        for own_rows in seq.values():
            at = 0
            for offset, length in sorted(own_rows):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer())).count() == 0


def test_pack_histogram_uses_every_piece_once():
    rng = random.Random(2)
    counts = {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(300)}
    used = {}
    for n, lengths in packing.pack_histogram(counts):
        assert sum(lengths) <= 2048 and n > 0
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts


def test_ids_of_special_strings():
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b"
    assert packing.encode(text, tokenizer()).tolist() == Tokenizer.from_file(tokenizer()).encode(text, add_special_tokens=False).ids


def test_embedding_join(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base[rng.integers(0, 30, 400)] + rng.normal(size=(400, 16)) * s for s in (0.05, 0.15, 0.3)]).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, rows[0][1], None), (5004, [None] * 16, 0), (5005, [], 0)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.arange(len(x)) % 3
    close = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    comp = brute.components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(np.triu(close))])
    want = {i: (int(close[i].sum()), comp[i]) for i in range(len(x))} | {i: (0, i) for i in range(5000, 5006)}
    assert close.sum() > 100
    for block in (512, 70):
        assert {r.vec_id: (r.n_links, r.component_id) for r in embed_join.link(given, block=block).collect()} == want
    assert embed_join.link(given.limit(0)).count() == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, docs):
    more = ["", None, "PassWord = 'abcdefgh1' 😀 token:short secret=\"token = xyzabcdefg\"", "AKIA" * 5, "f" * 31, "é" + "0f" * 20 + "g",
            "apikey: aaaaaaaa api_key=bbbbbbbbb", "token = token = abcdefghij", "key qX7zR2mK9vT4wL8pN1sJ6hB3 end"]
    given = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    model = secrets.train(secrets.samples_from(given))
    rows = secrets.scan(given.withColumn("secrets", F.lit(0)), model).collect()
    found = 0
    for r in rows:
        base = [s for s in r.secrets if s.kind < 3]
        assert ",".join(f"{secrets.KINDS[s.kind]}:{s.start}:{s.stop}" for s in base) == base_spans(r.text or ""), r.text
        found += sum(s.kind == 3 for s in r.secrets)
    last = next(r for r in rows if r.doc_id == 10**6 + 8)
    assert [(s.kind, last.text[s.start : s.stop]) for s in last.secrets] == [(3, "qX7zR2mK9vT4wL8pN1sJ6hB3")]
    assert found < 5
    assert len(secrets.train(spark.createDataFrame([], "value string, label int"))) == len(secrets.ALPHABET) ** 2


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms(spark):
    text = ("x ab.c9@m.example.com, +1 (414) 555-7134 4602800807485450 and 4602-8008-0748-5450 12.71.76.174 1999-12-31 02/28/2020 123-45-6789 "
            "2020-02-30 999.1.1.1 4602800807485451 +14145557134")
    given = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "card 4602800807485450", 5)], "doc_id long, text string, n_ip int")
    got = {r.doc_id: r for r in pii.pseudonymise(given, "k").collect()}
    new = got[1].text
    for kept in ("2020-02-30", "999.1.1.1", "4602800807485451"):
        assert kept in new
    for gone in ("414) 555", "4602800807485450", "12.71.76.174", "1999-12-31", "02/28/2020", "123-45-6789", "ab.c9@"):
        assert gone not in new
    cards = re.findall(r"(?<!\d)\d{16}(?!\d)", new) + re.findall(r"(?:\d{4}-){3}\d{4}", new)
    assert luhn(cards[0]) % 10 == 0 and cards[-1].replace("-", "") == cards[0] == got[4].text[5:]  # linked across spacing and rows
    assert "".join(c for c in re.search(r"\+1 \(.*?-\d{4}", new)[0] if c.isdigit()) == re.search(r"\+(1\d{10})", new)[1]
    assert (got[1].n_email, got[1].n_phone, got[1].n_date, got[1].n_ssn, got[1].n_ip, got[1].n_card) == (1, 2, 2, 1, 1, 2)
    assert got[2].text is None and got[3].text == "" and got[2].n_ip == 0
    back = pii.pseudonymise(pii.pseudonymise(given, "k"), "k", inverse=True).where("doc_id = 1").first().text
    assert back == text
    assert pii.pseudonymise(given, "other").where("doc_id = 1").first().text != new


def test_pseudonyms_are_one_to_one(spark):
    one = spark.range(10_000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("p"))
    assert one.distinct().count() == 10_000 and one.where("length(p) <> 4").count() == 0


def test_toxicity_learns_and_is_fair(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        own = [word() for _ in range(20)] + (["grobble"] if toxic and i % 2 else []) + (["muslims"] if toxic and i % 5 or i % 40 == 1 else [])
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(0, "muslims"), (1, "christians"), (2, "grobble"), (3, ""), (4, None)], "doc_id long, text string")
    gap = []
    for fairness in (0.0, 50.0):
        s = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.fit(docs, given, fairness=fairness)).collect()}
        gap.append(abs(math.log(s[0] / (1 - s[0])) - math.log(s[1] / (1 - s[1]))))
        assert s[2] > 0.7 and s[3] == s[4]
    assert gap[1] < 0.2 * gap[0]
    none = toxicity.fit(docs, given.limit(0))
    assert toxicity.score(docs, none).select("score").distinct().count() == 1


def test_line_dedup(spark, docs, odd):
    block = "\n".join(f"line number {i} of a shared block" for i in range(40))
    rows = [(1, "start\n" + block), (2, "other start\nand more\n" + block + "\nend"), (3, block), (4, "single"), (5, "single"), (6, None), (7, ""),
            (8, "}\n\n}"), (9, "}\n\n}"), (None, block)]
    given = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in line_chunks.dedup_lines(given).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed_lines == 0
    assert (got[2].n_lines, got[2].n_removed_lines, got[2].text) == (43, 40, "other start\nand more\nend")
    assert (got[3].n_removed_lines, got[3].text) == (40, "")
    assert got[4].text == got[5].text == "single" and got[6].text is None and got[7].text == ""
    assert got[8].text == got[9].text == "}\n\n}" and got[None].text == block
    for table in (docs, odd):
        assert {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_chunks.dedup_lines(table).collect()} == brute.line_dedup(rows_of(table))
    assert line_chunks.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_planted_passages(spark):
    """Passages of 1 to 6 lines in unlike surroundings go whole, blank lines within them too; pairs of blank lines and brackets stay."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passages = [[say(60)], [say(26), say(26)], [say(30), "", say(30)], *([say(9) for _ in range(k)] for k in range(3, 7)), [say(12), "", say(12), " ", "\t", say(30)]]
    alone = [["", ""], ["}", ""], ["}", "}"], [say(50)]]
    dressed = lambda p: [say(8) for _ in range(rng.randint(0, 3))] + p + [say(8) for _ in range(rng.randint(0, 3))]
    texts = [dressed(p) for _ in range(6) for p in passages + alone]
    texts += [[say(30)] * 7, [say(30), say(30)] * 4, passages[4] + passages[6] + passages[4], list(passages[0]), list(alone[3])]
    given = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)] + [(999, None), (None, "\n".join(passages[3]))], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_chunks.dedup_lines(given).collect()}
    assert got == brute.line_dedup(rows_of(given))
    for i, t in enumerate(texts[:-5]):
        p = (passages + alone)[i % 12]
        assert got[i][2] == (len(p) if i >= 12 and i % 12 < 8 else 0), (p, got[i])
    assert got[len(texts) - 2][0] == "" and got[len(texts) - 1][2] == 0


def test_line_dedup_with_hot_chunks(spark):
    """One passage in every text, one line in all places; the same result whatever counts as hot."""
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    hot, line = [say(20) for _ in range(3)], say(60)
    texts = ["\n".join([say(9)] * (i % 3) + hot + [line] * (i % 4) + [say(9)]) for i in range(2500)]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_chunks.dedup_lines(given).collect()}
    assert got == brute.line_dedup(list(enumerate(texts)))


def test_lines_of_texts_that_share_an_id(spark):
    """What is cut from one stays in the other, and they are places of their own."""
    texts = ["a\nb", "p\nq\na\nb", "a\nb\nkept\nhere", "kept\ntoo"]
    given = spark.createDataFrame(list(zip([1, 2, 2, 2], texts)), "doc_id long, text string")
    got = sorted(r.text for r in line_chunks.dedup_lines(given, least=0, words=1).collect())
    assert got == ["a\nb", "kept\nhere", "kept\ntoo", "p\nq"]
    alike = spark.createDataFrame([(7, "m\nn"), (7, "m\nn"), (7, "m\nn\no")], "doc_id long, text string")
    assert sorted((r.text, r.n_removed_lines) for r in line_chunks.dedup_lines(alike, least=0, words=1).collect()) in (
        [("", 2), ("", 2), ("m\nn\no", 0)], [("m\nn", 0), ("m\nn", 0), ("o", 2)])


def test_tool_calls(spark):
    calls = [("a", 1, "1", "search", '{"q": "x", "n": 2.0}'), ("a", 2, "2", "search", '{"q":"$result:1"}'), ("a", 3, "3", "search", '{"q":"$result:4"}'),
             ("a", 4, "4", "search", '{"q":"$result:3"}'), ("a", 5, "5", "search", '{"n": 0}'), ("a", 6, "6", "nothing", "{}"), ("a", 7, "7", "search", "{bad"),
             ("a", 8, "8", "search", '{"q":"$result:99"}'), ("a", 9, "1", "search", '{"q":"again"}'), ("b", 1, None, "search", '{"q":"x"}'), ("b", 2, "n", "search", '{"q":"é","q":"2"}')]
    results = [("a", 2, "1", "r1"), ("a", 3, "1", "r1b"), ("a", 4, "2", None), ("z", 1, "1", "lost"), (None, 1, "1", "lost too")]
    tools = [("search", '{"type":"object","required":["q"],"properties":{"q":{"type":"string"},"n":{"type":"integer","minimum":1}}}')]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = frame(calls, "conv_id string, turn long, call_id string, name string, arguments string").withColumn("status", F.lit(1))
    r = frame(results, "conv_id string, turn long, call_id string, content string")
    t = frame(tools, "name string, schema string")
    got = {(x.conv_id, x.call_id, x.status): x for x in chat_tools.link_calls(c, r, t).collect()}
    first = got["a", "1", "linked"]
    assert (first.depth, first.repeats, first.message) == (0, 2, '{"arguments":{"n":2,"q":"x"},"id":"1","name":"search","result":"r1"}')
    assert got["a", "2", "linked"].depth == 1 and json.loads(got["a", "2", "linked"].message)["result"] is None
    assert got["a", "3", "cycle"].depth is None and ("a", "4", "cycle") in got
    assert set(got["a", "5", "invalid"].errors) == {"arguments.q: missing", "arguments.n: too small"}
    assert ("a", "6", "no_tool") in got and got["a", "7", "invalid"].message is None and got["a", "8", "invalid"].errors == ["no call 99"]
    assert ("b", None, "invalid") in got and ("b", "n", "invalid") in got and ("z", "1", "no_call") in got and (None, "1", "no_call") in got
    assert len(got) == 12
    assert chat_tools.link_calls(c.limit(0), r.limit(0), t).count() == 0


def test_queries_cover_their_tables(spark):
    for name, table in (("op2_pii", "documents"), ("op3_toxicity", "documents"), ("op10_tool_calls", None)):
        n = QUERIES[name](spark, SF).count()
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count() if table else n > 0
