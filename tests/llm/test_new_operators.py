"""Exact dedup, fill-in-the-middle and prefix trie against plain loops; odd rows, long texts, hot keys."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from triage.llm import exact_dedup, fill_middle, prefix_trie, scans
from triage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- exact dedup ------------------------------------------------------------------------------------------------------------

def dedup_by_loops(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        key = re.sub(SPACE, "", t or "")
        best = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, best[2], len(groups[key]), (-len(t or ""), i) == (best[0], best[2]), sha(key)))
    return out


def flat(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_exact_dedup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert flat(QUERIES["op13_exact_dedup"](spark, SF)) == sorted(dedup_by_loops([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_exact_dedup_of_odd_rows(spark):
    hot = [(1000 + i, "hot  text" if i % 7 else "hot\ttext\n") for i in range(400)]
    rows = [(5, "a b"), (3, "ab "), (4, "ab"), (9, None), (8, ""), (7, " \n\x0b"), (None, "x y"), (6, "xy"), (None, None), (-2**63, "ä b"), (2**63 - 1, "äb "),
            (3, "ab "), (11, " a"), (12, "a"), (13, "z" * 300_000), (14, " z" * 300_000)] + hot
    given = spark.createDataFrame([(i, t, "d", b"r") for i, t in rows], "doc_id long, text string, digest string, rank binary")
    for support in (1 / 1024, 0.1):
        assert flat(exact_dedup.classes(given, support=support)) == sorted(dedup_by_loops(rows), key=str)
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.dedup(given, support=0.1).collect()), key=str)
    want = [r for r, x in zip(rows, dedup_by_loops(rows)) if x[3]]
    assert kept == sorted(want, key=str) and exact_dedup.dedup(given).columns == given.columns
    assert exact_dedup.classes(given.limit(0)).count() == exact_dedup.dedup(given.limit(0)).count() == 0


def test_heavy_digests_are_found_and_few(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"), F.col("id").alias("doc_id"))
    made = rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).cast("decimal(38,0)").alias("rank"))
    assert [r.group_size for r in exact_dedup.heavy(made).collect()] == [6667]
    plan = exact_dedup.classes(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Python" not in plan and "Arrow" not in plan


# ---- fill in the middle -----------------------------------------------------------------------------------------------------

def cut_by_loops(doc_id, text):
    text = text or ""
    units = re.findall(rf"{SPACE}*[^\x20\x09-\x0D]+|{SPACE}+", text)
    n = len(units)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, n, form, *sizes, out, sha(text))


def test_fill_middle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_fill_middle"](spark, SF).collect()}
    for r in docs.collect():
        want = cut_by_loops(r.doc_id, r.text)
        assert got[r.doc_id] == (*want[:5], sha(want[5]), want[6])


def odd_texts():
    rng = random.Random(4)
    say = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    long = [say(200_000, "ab é\n\t😀"), "w" * 200_000, " " * 200_000, "a" * fill_middle.FRAME + " b", "a" * (fill_middle.FRAME - 1) + " b",
            "é" * fill_middle.FRAME + "  ", say(300_000, "<PSM> ab"), "x " * 100_000]
    short = [None, "", " ", "a", " a ", "  ", "<P", "a<", "<<S", "<P>", "a <M> b", "\x0b\x0c\x1c\x85 b"] + [say(30, "a <S>P") for _ in range(60)]
    return [(i, t) for i, t in enumerate(long * 4 + short)] + [(None, "no id at all"), (3, "same id"), (3, "same id"), (-7, "negative id here"), (2**63 - 1, "a b c d")]


def test_fill_middle_of_odd_rows(spark):
    rows = odd_texts()
    given = spark.createDataFrame([(i, t, k, None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long, frames string")
    made = fill_middle.rearrange(fill_middle.frame_store(given))
    want = {k: cut_by_loops(i, t) for k, (i, t) in enumerate(rows)}
    assert {w[2] for w in want.values()} == {"plain", "spm", "psm"}
    for r in fill_middle.digests(made).collect():
        w = want[r.row.n]
        assert (r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (*w[:5], sha(w[5]), w[6])
    for r in fill_middle.texts(made).collect():
        assert r.output == want[r.row.n][5]
    for r in made.where("form <> 'plain'").collect()[:20]:  # a plain zstandard file
        whole = b"".join(r.output)
        assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read().decode() == want[r.row.n][5]
    assert fill_middle.digests(fill_middle.rearrange(fill_middle.frame_store(given.limit(0)))).count() == 0


def test_frames_are_bounded_and_mostly_copied(spark):
    text = "".join(f"word{i} " for i in range(100_000))
    given = spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string")
    store = fill_middle.frame_store(given)
    rows = {r.row.doc_id: r for r in store.collect()}
    for r in fill_middle.rearrange(store).where("form <> 'plain'").collect():
        frames = [f.data for f in rows[r.row.doc_id].frames]
        assert all(len(zstandard.ZstdDecompressor().decompress(f)) <= fill_middle.FRAME for f in frames)
        assert len(set(map(bytes, frames)) & set(map(bytes, r.output))) >= len(frames) - 2


# ---- prefix trie ------------------------------------------------------------------------------------------------------------

def trie_by_loops(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = sha(f"{len(role.encode())}:{role}{text}")[:32]
            by[c].append(((t is not None, t or 0, token), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda z: z[0])] for c, v in by.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    number, parent, last, depth = {}, [None], [None], [0]  # nodes by (parent, turn); 0 is the root
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        node = 0
        members[0].append(c)
        for turn in turns:
            if (node, turn) not in number:
                number[node, turn] = len(parent)
                parent.append(node)
                last.append(turn[1])
                depth.append(depth[node] + 1)
            node = number[node, turn]
            members[node].append(c)
        ends[node].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in parent[1:]:
        children[p] += 1
    for x in range(len(parent)):
        value, up = (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", last[x])) if x else 0, x
        while up is not None:
            saved[up] += value
            leaves[up] += not children[x]
            up = parent[up]
    return sorted(((min(members[x]), depth[x], min(members[parent[x]]) if x else None, len(members[x]), children[x], leaves[x], saved[x],
                    sha(",".join(map(str, sorted(ends[x]))))) for x in members), key=str)


def nodes_of(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def trie(given):
    made = prefix_trie.build(*prefix_trie.rebuilt(prefix_trie.turns_of(given)))
    nothing = sha("")
    return made.nodes.join(prefix_trie.end_digests(made.ends), "node", "left").fillna({"ends_sha256": nothing})


def test_prefix_trie(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert nodes_of(QUERIES["op12_prefix_trie"](spark, SF)) == trie_by_loops(rows)


def test_prefix_trie_of_odd_rows(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", None, ""]), rng.choice(["a b", "", None, "c", " a  b\n"])) for c in range(-45, 130) for t in range(rng.randint(1, 5))]
    rows += [(200 + c, 0, "user", "the same first turn") for c in range(60)] + [(200 + c, 1, "user", f"then {c % 3}") for c in range(0, 60, 2)]
    rows += [(None, 1, "user", "lost"), (7, None, "user", "no number"), (7, None, "user", "no number"), (8, 1, "user", "tie"), (8, 1, "user", "tie 2"),
             (2**40, 5, "u", "x" * 100_000)]
    rng.shuffle(rows)
    given = spark.createDataFrame([(*r, "n", 3) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    assert nodes_of(trie(given)) == trie_by_loops(rows)
    assert trie(given.limit(0)).count() == 0


def test_prefix_trie_with_one_long_conversation(spark):
    """One conversation holds most turns, and a copy of it goes on differently: places, prefixes and joins are split."""
    long = [(40, t, "user", f"turn {t % 11} of many") for t in range(2600)]
    copy = [(60, t, "user", f"turn {t % 11} of many") for t in range(2500)] + [(60, 2500, "user", "else")]
    rows = long + copy + [(c, t, "user", f"turn {t % 11} of many") for c in range(61, 80) for t in range(c - 50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = nodes_of(trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == trie_by_loops(rows)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_scan_carries_state_over_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(k, i, rng.randbytes(16), rng.randint(-5, 9)) for k, n in (("a", 1), ("b", 500), ("c", 3), ("d", 0), ("e", 40)) for i in range(n)]
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "k string, i int, t binary, v long")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): (r.n, bytes(r.before), bytes(r.h), r.total) for r in scans.scan(given, "k", [F.col("i")], token="t", value="v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = {}
    for k, i, t, v in sorted(rows):
        n, h, total = state.get(k, (0, 0, 0))
        after = (n + 1, (h * scans.BASE + int.from_bytes(t, "big") % scans.PRIME + 1) % scans.PRIME, total + v)
        assert got[k, i] == (after[0], h.to_bytes(16, "big"), after[1].to_bytes(16, "big"), after[2])
        state[k] = after
