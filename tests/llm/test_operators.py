"""Edge cases and brute force for the corpus operators, on small tables."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import differences, duck
from pyspark.sql import functions as F

from cohortlab.llm.common import counted_join
from cohortlab.llm.exact_dedup import exact_dedup
from cohortlab.llm.graph import components
from cohortlab.llm.html_extract import main_texts
from cohortlab.llm.line_dedup import line_dedup
from cohortlab.llm.mixing import curriculum, mixed
from cohortlab.llm.oracle import ORACLE
from cohortlab.llm.packing import WordTokens, binary_cuts, pack
from cohortlab.llm.quality_model import isotonic, quality_scores
from cohortlab.llm.quality_rules import judged, quality_rules
from cohortlab.llm.queries import QUERIES
from cohortlab.llm.sharding import shard_documents
from cohortlab.llm.simhash import fingerprint, links, near_duplicates, one_of_each
from cohortlab.llm.token_counts import SplicedCounter, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, kept string, `a.b` int"
SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(3000))


def docs(spark, rows):
    full = [(i, t, "en", s, len(t) if t is not None else None, "k", "no", 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    return docs(spark, [
        (1, None, "a"), (2, "", None), (3, LONG, "a"), (4, LONG, "b"), (4, LONG, "b"), (5, "One two", None), (6, "one TWO", "a"),
        (7, " \n\t ", "b"), (None, "no id", "b"), (8, "é 中文 😀\x00", "a"), (9, "\n".join(["same line here"] * 40), "a"),
    ])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), duck(SMALL), ORACLE[name]) == []


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, odd, bits):
    rows = exact_dedup(odd, block_bytes=16, hash_bits=bits).collect()
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in rows}
    assert len(rows) == 11 and sum(r.kept for r in rows) == 7
    groups = defaultdict(list)
    for r in odd.collect():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        groups[t].append(r.doc_id)
    want = sorted((max((i for i in g if i is not None), default=None) or 0, len(g)) for g in groups.values())
    assert sorted({(k or 0, n) for k, n in got.values()}) == sorted(set(want))
    assert Counter(r.keep_id for r in rows if r.kept) == Counter([2, 4, 6, 7, None, 8, 9])


def test_line_dedup(spark, odd):
    p = " ".join(f"p{i}" for i in range(60))
    q = [" ".join(f"q{k}{i}" for i in range(20)) for k in range(4)]
    extra = docs(spark, [(1, f"start\n{p}\nend", "a"), (2, f"other\n{p}\n\nlast", "a"), (3, "\n".join(q), "a"), (4, "x\n" + "\n\n".join(q[1:]) + "\ny", "b"), (5, f"{p}\n{p}", "b")])
    got = {r.doc_id: (r.text, r.removed_lines, r.n_chars) for r in line_dedup(extra).collect()}
    assert got[1][1] == [] and got[2] == ("other\n\nlast", [1], 11) and got[3][1] == []
    assert got[4][0] == "x\ny" and got[5] == ("", [0, 1], 0)
    # A short last line of a passage goes with it, and so does a short first one.
    tail = ["start", *[" ".join(f"r{k}{i}" for i in range(40)) for k in range(2)], "short end"]
    more = docs(spark, [(1, "\n".join(["one", *tail, "two"]), "a"), (2, "\n".join(["three", *tail, "four"]), "a")])
    assert {r.doc_id: r.text for r in line_dedup(more).collect()}[2] == "three\nfour"
    out = line_dedup(odd)
    assert out.columns == [*odd.columns, "removed_lines"]
    rows = out.collect()
    assert len(rows) == 11 and [r.text for r in rows if r.doc_id == 1] == [None]
    assert [r.text for r in rows if r.doc_id == 4] == ["", ""] and [r.text for r in rows if r.doc_id == 3] == [LONG]
    kept = [r for r in rows if r.doc_id == 9][0]
    assert kept.text.count("same line") == 17  # the first window of 51 words stays


def test_quality_rules(spark, odd):
    rows = {r.doc_id: r for r in judged(odd).collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and rows[3].kept and rows[9].n_dup_lines == 39 and not rows[9].kept
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    bar = "Subscribe to our news letter now"
    rows = [(k, f"{bar}\n{body(k)}", "h") for k in range(20)]
    rows += [(100 + k, f"{bar}\n" * 9 + f"u{k} v{k}", "h") for k in range(3)]
    rows += [(200 + k, "\n".join(body(f"c{j}") for j in range(2)), "h") for k in range(30)]  # copies keep their lines
    table = docs(spark, rows)
    out = {r.doc_id: r.text for r in quality_rules(table).collect()}
    assert set(out) == {*range(20), *range(200, 230)}
    assert out[3] == body(3) and out[200] == rows[-1][1]
    assert quality_rules(table).columns == table.columns
    # No line is too long to count, and documents count once each, whatever lines they share.
    notice = " ".join(f"term{i}" for i in range(90))
    shared = docs(spark, [(k, f"{notice}\n{body(k)}\n{body(k + 100)}", "h") for k in range(12)])
    assert {r.doc_id: r.text for r in quality_rules(shared).collect()} == {k: f"{body(k)}\n{body(k + 100)}" for k in range(12)}


def test_join_of_counted_keys(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "id")
    right = left.groupBy("k").count().withColumnRenamed("count", "_rows").filter("k < 2000").withColumn("v", F.col("k") * 2)
    for share in (1, 10, 1000, 100_000):
        out = counted_join(left, right, ["k"], F.col("id"), 3000, share)
        rows = [tuple(r) for r in out.select("k", "id", "v").collect()]
        assert sorted(rows) == sorted((k, i, 2 * k) for i in range(3000) for k in [-1 if i % 3 == 0 else i] if k < 2000)


def test_mixing(spark, odd):
    rows = mixed(odd).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - w) <= 0.5 for t, w in by.values())
    out = curriculum(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(len(r.copies) for r in rows)


def test_shards(spark, odd):
    table = docs(spark, [(i, f"copy {i % 7}" if i % 3 else f"own {i}", "a") for i in range(900)])
    rows = shard_documents(table, 8).collect()
    held = Counter(r.shard for r in rows)
    assert len(rows) == 900 and max(held.values()) - min(held.values()) <= 1 and len(held) == 8
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in held.items())
    text = {r.doc_id: r.text for r in table.collect()}
    spread = defaultdict(set)
    for r in rows:
        spread[text[r.doc_id]].add(r.shard)
    assert np.mean([len(s) for t, s in spread.items() if t.startswith("copy")]) < 4  # 86 copies each: by chance all 8
    assert sorted(r.slot for r in shard_documents(odd, 40).collect()) == [0] * 11


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, odd):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in near_duplicates(table).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in table.collect()}
    assert all(got[i].fingerprint == f"{p:016x}" for i, p in prints.items())
    assert {i: r.component_id for i, r in got.items()} == brute_components(sorted(prints), prints)
    assert {r.doc_id: r.component_id for r in near_duplicates(odd).collect()}[7] == 1
    assert sorted(r.doc_id or 0 for r in one_of_each(odd).collect()) == [0, 1, 3, 5, 8, 9]
    assert fingerprint(LONG * 40) == brute_fingerprint(LONG * 40)


@pytest.mark.parametrize("block", [20_000, 100])
def test_links_lose_nothing(spark, block):
    draw = np.random.default_rng(5)
    points = set()
    for centre in draw.integers(0, 2**64, 30, np.uint64).tolist():
        for _ in range(12):
            flips = draw.permutation(64)[: draw.integers(0, 6)].tolist()
            points.add(centre ^ sum(1 << f for f in flips))
    points = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    roots = {r.node: r.root for r in components(links(spark.createDataFrame([(p,) for p in points], "bits bigint"), 4, block)).collect()}
    want = brute_components(points, {p: p & (2**64 - 1) for p in points})
    assert {p: roots.get(p, p) for p in points} == want


def test_packing(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = WordTokens(path).tokenizer
    rows = pack(odd, path, full=64).collect()
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 for r in rows)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in odd.collect()}
    for r in rows:
        assert list(struct.unpack(f"<{r.length}I", r.ids)) == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[4])
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in pack(odd, path, full=64, crc=True).collect()}
    assert all(zlib.crc32(r.ids) == crc[r.doc_id, r.start] for r in rows)
    assert [length for _, length in binary_cuts(4096 + 7, 4096)] == [4096, 4, 2, 1]
    encode = WordTokens(path)
    for text in ("I'll don't <|endoftext|>x ", "a\x1cb\x85c İstanbul ǅ É́", "ﬁ½ ⅷ" * 50):
        got = encode(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == whole.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter = SplicedCounter(path, chunk=64, overlap=4)
    for text in (LONG, "x" * 500, " " * 300 + "a b  c" * 40, "é😀 ▁ \n<0x0A> " * 60, "中文" * 200):
        assert counter(text) == len(counter.model.encode(text))
    assert counter.widened
    rows = {r.doc_id: r for r in token_counts(odd, path, chunk=100, overlap=8).collect()}
    assert rows[1].n_tokens == 0 and rows[3].over_limit and rows[3].n_tokens == len(counter.model.encode(LONG)) and rows[8].n_bytes == len("é 中文 😀\x00".encode())


def test_quality_model(spark):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 97}" for j in range(50)) if i % 2 else "#$% " * (20 + i % 9), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, None), (None, 1), (9999, 1)], "doc_id bigint, quality int")
    out = quality_scores(docs(spark, [*rows, (1000, None, None), (None, "x", "a")]), labels).collect()
    assert len(out) == 402 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert quality_scores(docs(spark, rows[:3]), labels.limit(0)).filter("score between 0.4 and 0.6").count() == 3
    assert isotonic(np.array([1, 0, 0, 3.0]), np.array([1, 0, 1, 3])).tolist() == [0.5, 0.5, 0.5, 1.0]


def test_html(spark):
    menu = "<nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
    page = lambda i: f"<html>{menu}<div>Top menu</div><div>Story {i} &lt;here&gt;<p>More\n of  {i}<p>Yes</div><div>All rights</div>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(5)]
    rows += [(10, "http://c.org/a", "<article><h1>T</h1><p>Same copy<p class=ad>Buy</article>")] * 5
    rows += [(20, None, None), (21, "", ""), (22, "http://x.org", "<article><header class='post-header'><h1>Title</h1></header><p>A<b>b</b> c<aside>no</aside><form>no</form><div id=comments>no</div></article><footer>no")]
    out = main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == 13 and got[20] == got[21] == ""
    assert got[10] == "T\n\nSame copy" and got[22] == "Title\n\nAb c"
    assert got[2] == "Story 2 <here>\n\nMore of 2"  # "Yes" is the same on all pages: template
    assert all(r.n_chars == len(r.text) for r in out)


def test_empty_tables(spark, none):
    tokens, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    tables = [
        exact_dedup(none), line_dedup(none), judged(none), quality_rules(none), mixed(none), curriculum(none), shard_documents(none, 4), near_duplicates(none),
        one_of_each(none), pack(none, tokens), token_counts(none, pieces), quality_scores(none, labels),
        main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")),
    ]
    assert [t.count() for t in tables] == [0] * len(tables)


@pytest.mark.parametrize("stage", [quality_rules, line_dedup, one_of_each, curriculum])
def test_stages_keep_columns_named_like_their_own(spark, stage):
    """Whatever other columns are called, they come back with their values."""
    names = ["__id", "__nth", "__copy", "__lines", "__first", "__gone", "__bad", "_key", "_salt", "_host", "size", "a.b", "other 5"]
    rows = [(i, f"{LONG} {i}", "en", "a", None, *[f"{n} {i}" for n in names]) for i in range(6)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    table = spark.createDataFrame(rows, kinds)
    out = stage(table)
    assert [c for c in out.columns if c in table.columns] == table.columns
    got = out.collect()
    assert got
    for r in got:
        assert [r[n] for n in names] == [f"{n} {r.doc_id}" for n in names]
