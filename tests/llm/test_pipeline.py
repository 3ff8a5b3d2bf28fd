"""The pipeline, stage by stage, against SQL and plain Python on what the stage before kept."""

import re
from collections import Counter, defaultdict
from math import ceil

import duckdb
import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from cohortlab.llm.oracle import ORACLE
from corpus_pipeline import STAGES, run

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text: str) -> int:
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: dict[int, int]) -> set[frozenset[int]]:
    group = {i: {i} for i in prints}
    for a in prints:
        for b in prints:
            if a < b and group[a] is not group[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                group[a] |= group[b]
                for i in group[b]:
                    group[i] = group[a]
    return {frozenset(g) for g in group.values()}


def test_pipeline_stage_by_stage(spark, small, tmp_path):
    stage = dict(STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    con = duckdb.connect()

    def step(name, before):
        """The SQL tables of the stage's input, and its output as a written table and as rows."""
        before.write.mode("overwrite").parquet(f"{tmp_path}/in-{name}")
        con.execute(f"create or replace view documents as select * from read_parquet('{tmp_path}/in-{name}/*.parquet')")
        stage[name](spark, spark.read.parquet(f"{tmp_path}/in-{name}"), small).write.parquet(f"{tmp_path}/out-{name}")
        out = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert out.columns == columns
        return out, out.collect()

    good, rows = step("quality rules", docs)
    expected = dict(con.sql(f"select doc_id, left_words from ({ORACLE['op10_quality_rules']}) where kept").fetchall())
    assert expected and {r.doc_id: len(WORD.findall(r.text)) for r in rows} == expected

    cut, rows = step("line dedup", good)
    expected = dict(con.sql(f"select doc_id, chars_left from ({ORACLE['op5_line_dedup']})").fetchall())
    assert all(len(r.text) == expected.pop(r.doc_id) for r in rows)
    texts = {r.doc_id: r.text for r in good.collect()}
    assert all(n < len(texts[i]) for i, n in expected.items())  # only documents that lost lines go

    single, rows = step("near duplicates", cut)
    groups = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in cut.collect()})
    stayed = {r.doc_id for r in rows}
    assert len(stayed) == len(rows) == len(groups) and all(len(g & stayed) == 1 for g in groups)

    mixed, rows = step("mixing", single)
    taken = con.sql(f"select doc_id, size, taken from ({ORACLE['op7_mixing']}) where taken > 0").fetchall()
    copies = Counter(r.doc_id for r in rows)
    assert copies == {i: ceil(t / n) for i, n, t in taken}

    tokens = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, small).collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = {r.doc_id: r.text for r in rows}
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        whole = [*tokens.encode(text, add_special_tokens=False).ids, 2]
        assert Counter(s for s, _ in pieces[i]) == {s: copies[i] for s, _ in pieces[i]}
        assert [t for _, ids in sorted({s: ids for s, ids in pieces[i]}.items()) for t in ids] == whole
    assert all(parts == [(0, n)] and n & (n - 1) == 0 and n <= 4096 for parts in sequences.values() for _, n in parts[:1])
