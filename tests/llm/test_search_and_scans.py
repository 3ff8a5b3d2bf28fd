"""Licence scan, importance resampling and ranked search: edge cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlab.llm import resample, search
from cohortlab.llm.licenses import BASE, GRADES, NOTICES, Scanner, evaluate, family, license_digest, license_scan, postfix
from cohortlab.llm.queries import QUERIES
from cohortlab.llm.resample import importance_resample
from cohortlab.llm.search import mine, ranked_search
from cohortlab.llm.terms import terms

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, _text string, n_words int, score double, `rank` int, terms string, _part int, key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def split(text):
    return WORD.findall(lower(text or ""))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 0.5, 9, "y", 3, "k") for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


HUGE = " ".join(f"w{i % 977} the" for i in range(120_000))
ODD = [
    (1, None), (2, ""), (3, "The cat and the dog. THE end"), (4, "the cat"), (4, "the cat"), (5, "\x00é中文 😀 the\x7fcat—ÀB"),
    (None, "the cat the cat"), (6, " \n\t,.;"), (7, HUGE), (8, "cat " * 30), (9, "one two three four five " * 8), (10, "dog dog cat İ ß " * 6),
]


def test_terms_are_the_words_of_the_pattern():
    rng = random.Random(3)
    signs = "aZ09 \n\x00\x7f-_É中😀@[`{/:"
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        assert [t.decode() for t in terms(text.encode())] == split(text)


# --- licence scan ---

def test_expressions():
    def value(text):
        rpn = postfix(text.lower().replace("(", " ( ").replace(")", " ) ").split())
        return (" ".join(rpn), *evaluate(rpn)) if rpn else None

    assert value("MIT OR GPL-2.0 AND Apache-2.0") == ("mit gpl-2.0 apache-2.0 and or", 1.0, {"mit", "gpl", "apache"})
    assert value("(MIT OR GPL-2.0) AND GPL-3.0+")[1] == GRADES["gpl"]
    assert value("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT")[0] == "gpl-2.0-only classpath-exception-2.0 with mit or"
    assert value("GPL-2.0 WITH Classpath-exception-2.0")[1:] == (GRADES["lgpl"], {"gpl"})
    assert value("MIT and then some") == ("mit", 1.0, {"mit"})
    assert value("MIT AND (GPL-2.0 OR") == ("mit", 1.0, {"mit"})
    assert value("(MIT") is None and value("AND MIT") is None and value("whatever") is None and value(") MIT") is None
    assert value("LicenseRef-own OR BSD-3-Clause")[1:] == (1.0, {"licenseref-own", "bsd"})
    assert [family(x) for x in ("apache-2.0", "gpl-3.0-or-later", "lgpl-2.1+", "cc-by-nc-4.0", "cc0-1.0", "0bsd")] == [
        "apache", "gpl", "lgpl", "cc-by-nc", "cc0", "bsd"]


def brute_value(text):
    """Recursive descent beside the shunting yard."""
    tokens = text.split()

    def part(at, level):
        if level == 3:
            if tokens[at] == "(":
                got, at = part(at + 1, 0)
                return got, at + 1
            return GRADES[tokens[at]], at + 1
        if level == 2:
            got, at = part(at, 3)
            while at < len(tokens) and tokens[at] == "with":
                got, at = (max(got, 0.6) if got >= 0.3 else got), at + 2
            return got, at
        got, at = part(at, level + 1)
        word = ("or", "and")[level]
        while at < len(tokens) and tokens[at] == word:
            other, at = part(at + 1, level + 1)
            got = (max if word == "or" else min)(got, other)
        return got, at

    return part(0, 0)[0]


def test_shunting_yard_equals_recursive_descent():
    rng = random.Random(5)
    names = sorted(GRADES)

    def draw(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            name = rng.choice(names)
            return f"{name} with some-exception" if rng.random() < 0.2 else name
        if kind < 0.5:
            return f"( {draw(depth - 1)} )"
        return f"{draw(depth - 1)} {rng.choice(['or', 'and'])} {draw(depth - 1)}"

    for _ in range(500):
        text = draw(4)
        rpn = postfix(text.split())
        assert len(rpn) == sum(t not in "()" for t in text.split())
        assert evaluate(rpn)[0] == brute_value(text)


def found(spark, text):
    r = license_scan(docs(spark, [(1, text)])).first()
    return r, license_digest(license_scan(docs(spark, [(1, text)]))).first()


def test_notices_tags_and_labels(spark):
    r, d = found(spark, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\ncode\nlicense = \"BSD-3-Clause\"")
    assert [(s.kind, s.expression) for s in r.statements] == [
        ("tag", "mit apache-2.0 or gpl-2.0 classpath-exception-2.0 with and"), ("tag", "bsd-3-clause")]
    assert (d.labels, d.n_base, d.score, d.n_statements) == ("apache,bsd,gpl,mit", 0, 0.6, 2)
    r, d = found(spark, "Licensed under the MIT License\nor the Apache License, Version 2.0 at your option.")
    assert [(s.word, s.expression) for s in r.statements] == [(3, "mit apache or")] and d.score == 1.0
    assert (d.base_labels, d.labels, d.first_word, d.last_word) == ("apache,mit", "apache,mit", 3, 7)
    _, d = found(spark, "GNU Lesser General\n# Public License; and CC BY-NC-SA 4.0")
    assert (d.base_labels, d.labels, d.score, d.n_base) == ("gpl", "cc-by-nc-sa,gpl,lgpl", 0.1, 1)
    _, d = found(spark, "All rights reserved.")
    assert (d.labels, d.score) == ("proprietary", 0.0)
    _, d = found(spark, "All rights reserved. Released under the MIT license")
    assert (d.labels, d.score) == ("mit", 1.0)
    _, d = found(spark, "the licence: of a driver, a license is needed. mit Licenses; submit license")
    assert (d.labels, d.n_base, d.n_statements, d.score) == ("", 0, 0, 0.0)
    _, d = found(spark, "MIT LICENSE mit.license mit é license" + " x" * 50_000 + " mit license")
    assert (d.n_base, d.first_word, d.last_word) == (3, 0, 50_007)


def test_base_places_equal_a_plain_search(spark):
    rng = random.Random(11)
    words = ["mit", "MIT", "license", "Apache", "general", "public", "the", "é", "License"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "é", ""]) for _ in range(rng.randrange(60)))) for i in range(300)]
    got = {r.doc_id: r for r in license_digest(license_scan(docs(spark, rows))).collect()}
    for i, text in rows:
        w = split(text)
        places = [(at, label) for phrase, label in BASE.items() for at in range(len(w)) if w[at : at + phrase.count(" ") + 1] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_automaton_equals_phrase_by_phrase():
    rng = random.Random(2)
    vocabulary = sorted({w for p in NOTICES for w in p.split()})
    scan = Scanner(BASE)
    for _ in range(200):
        w = [rng.choice(vocabulary) for _ in range(40)] + rng.choice(sorted(NOTICES)).split()
        _, places, _ = scan(" ".join(w).encode())
        assert places == sorted((at, label) for p, label in BASE.items() for at in range(len(w)) if w[at : at + len(p.split())] == p.split())


def test_license_query_keeps_every_document(spark):
    rows = QUERIES["op11_license_scan"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        w = split(texts[r.doc_id])
        places = [(at, x) for p, x in BASE.items() for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))


def test_license_scan_of_odd_rows(spark):
    rows = license_digest(license_scan(docs(spark, ODD))).collect()
    assert len(rows) == len(ODD) and sum(r.doc_id == 4 for r in rows) == 2
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 6)} == {0}
    assert license_scan(docs(spark, [])).collect() == []


# --- importance resampling ---

def plain_resample(rows, target, length, buckets=10_000, percent=10, least=20, seed="2024"):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    def features(text):
        w = split(text)
        return [bucket(" ".join(w[i : i + n])) for n in range(1, length + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(split(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for at, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[5] = at + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("length, head", [(1, 65_536), (1, 1), (2, 50), (2, 65_536), (3, 20)])
def test_resampling_equals_a_plain_count(spark, length, head):
    """Whatever is in the head and whatever in the tail, the totals are the same."""
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choice("the of and cat Dog bird x1 é 中文 end".split()) for _ in range(rng.randrange(90)))) for i in range(200)]
    rows += ODD
    target = ["the bird and the cat", None, "é 中文 x1 x1"]
    got = importance_resample(docs(spark, rows), items(spark, list(enumerate(target))), length=length, head=head, percent=30)
    want = plain_resample(rows, target, length, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_resampling_passes_counts_on_in_parts(spark, monkeypatch):
    rows = docs(spark, ODD).select(resample.utf8("text").alias("_text"))
    whole = {bytes(r.run): r.n for r in resample._counted(rows).collect()}
    assert whole == Counter(t for _, text in ODD for t in terms((text or "").encode()))


def test_the_head_is_bounded(spark):
    rows = docs(spark, ODD).select(resample.utf8("text").alias("_text"))
    for head in (1, 3, 10):
        found = resample.features(rows, 2, 100, head)
        assert len(found.words) <= head and len(found.pairs) <= head


def test_resampling_of_empty_tables(spark):
    assert importance_resample(docs(spark, []), items(spark, [(1, "a")])).collect() == []
    rows = importance_resample(docs(spark, ODD), items(spark, [])).collect()
    assert len(rows) == len(ODD) and sum(r.rank is not None for r in rows) == sum(r.n_words >= 20 for r in rows) // 10


def test_equal_scores_go_by_id(spark):
    same = [(i, "word " * 25) for i in (5, 3, 3, 9, None)]
    rows = importance_resample(docs(spark, same), items(spark, [(1, "word")]), percent=100).collect()
    ranked = sorted(rows, key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5]
    assert [r.score for r in ranked] == sorted((r.score for r in rows), reverse=True)
    assert [r["rank"] for r in rows if r.doc_id == 3] in ([1, 2], [2, 3], [3, 4], [4, 5], [2, 1], [3, 2], [4, 3], [5, 4])


# --- ranked search ---

def plain_search(rows, wanted, k=10):
    texts = [(i, Counter(split(t))) for i, t in rows]
    N, L = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    merged = {}
    for item, text in wanted:
        merged.setdefault(item, set()).update(split(text))
    out = []
    for item, found in merged.items():
        scored = []
        for i, c in texts:
            n = sum(c.values())
            m = 10 + (90 * n * N) // L if L else 10
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in found if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, at + 1, s[3], -s[0]) for at, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms, rows_a_block", [(200_000, 512), (60, 3)])
def test_search_equals_a_plain_search(spark, monkeypatch, block_terms, rows_a_block):
    rng = random.Random(17)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for i in range(150)] + ODD
    wanted = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(25)]
    wanted += [(3, "the cat"), (50, None), (51, ""), (52, "Nowhere"), (None, "THE dog"), (53, "the the the cat")]
    monkeypatch.setattr(search, "BLOCK", rows_a_block)
    got = ranked_search(docs(spark, rows).repartition(5), items(spark, wanted), block_terms=block_terms).collect()
    # Rows that repeat an id and a text may come in either order: they are the same.
    assert sorted((tuple(r) for r in got), key=str) == plain_search(rows, wanted)


def test_search_of_empty_tables(spark):
    assert ranked_search(docs(spark, []), items(spark, [(1, "a")])).collect() == []
    assert ranked_search(docs(spark, ODD), items(spark, [])).collect() == []
    assert ranked_search(docs(spark, ODD), items(spark, [(1, None)])).collect() == []


def test_sharing_plan_adds_up_every_item_once():
    rng = random.Random(23)
    common = [list(range(8)), list(range(5, 20)), [1, 3, 5, 7, 9, 11]]
    lists = [sorted({*rng.choice(common), *(rng.randrange(300) for _ in range(rng.randrange(10)))}) for _ in range(60)] + [[], [299]]
    plan = mine(lists, 300)
    row = np.zeros(300, int)
    values = np.array([7**0 + t * 1000 for t in range(300)])
    used = np.flatnonzero(plan.leaf_of >= 0)
    got = search.accumulate(plan, values[used], used, row[: len(used)], 1)[:, 0]
    assert got.tolist() == [int(sum(values[t] for t in item)) for item in lists]
    alone = sum(max(0, len(item) - 1) for item in lists)
    assert plan.additions() < alone / 2  # the shared sets are added up once


def test_best_keeps_ties_by_id():
    best = search.Best(1, 3)
    best.offer(np.array([[5, 5, 0, 5, 9, 5]]), [4, None, 7, 2, 8, 2])
    best.offer(np.array([[5, 5, 1]]), [1, 9, 0])
    assert [(-s, i) for s, _, i in best.rows[0]] == [(9, 8), (5, 1), (5, 2)]
