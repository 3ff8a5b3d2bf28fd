"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases in one
pass over a text's terms, and a shunting-yard parser evaluates licence expressions.

An expression is what follows a tag (``SPDX-License-Identifier: MIT OR (GPL-2.0 WITH
Classpath-exception-2.0)``), or notices joined by "or" and "and" in running text. It is
worth as much freedom as its holder can choose: ``or`` the larger, ``and`` the smaller of
both sides, ``with`` an exception lifts a licence to the level of a weak copyleft.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import ship
from cohortlab.llm.terms import FOLD, columns, terms, utf8

ship(__name__)

#: The phrases whose places are always reported, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: How freely a licence lets a text be used again.
FREE, WEAK, STRONG, LIMITED, CLOSED = 1.0, 0.6, 0.3, 0.1, 0.0
GRADES = {
    "mit": FREE, "apache": FREE, "bsd": FREE, "isc": FREE, "zlib": FREE, "bsl": FREE, "unlicense": FREE, "cc0": FREE, "cc-by": FREE,
    "wtfpl": FREE, "python": FREE, "ofl": FREE, "artistic": FREE, "mpl": WEAK, "epl": WEAK, "cddl": WEAK, "lgpl": WEAK,
    "cc-by-sa": STRONG, "gpl": STRONG, "agpl": STRONG, "cc-by-nd": LIMITED, "cc-by-nc": LIMITED, "cc-by-nc-sa": LIMITED,
    "cc-by-nc-nd": LIMITED, "proprietary": CLOSED,
}

#: Names and sentences by which a notice gives its licence, in terms.
NOTICES = BASE | {
    "expat license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache software license": "apache",
    "licensed under the apache": "apache",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "python software foundation license": "python",
    "sil open font license": "ofl",
    "artistic license": "artistic",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "proprietary",
}

#: Terms of an identifier tag; a colon or an equals sign and an expression must follow.
TAGS = ("spdx license identifier", "license", "licence", "license expression")

#: What may stand between two notices beside the word that joins them.
FILLERS = frozenset("the a an of under terms either version v gnu its your option at any later license licenses and or".split())

_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"'\[]*")
_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
_VERSION = re.compile(r"(\+|-only|-or-later)*$")
_FAMILY = re.compile(r"-v?\d+(\.\d+)*$")
BINDING = {"or": 1, "and": 2, "with": 3}


def family(name: str) -> str:
    """The licence without its version: ``gpl-2.0-or-later`` is ``gpl``, ``bsd-3-clause`` ``bsd``."""
    name = _FAMILY.sub("", _VERSION.sub("", name))
    return "bsd" if name.startswith("bsd-") or name == "0bsd" else "mit" if name.startswith("mit-") else name


def known(name: str) -> bool:
    return family(name) in GRADES or name.startswith("licenseref-")


def postfix(tokens: list[str]) -> list[str]:
    """The longest run of ``tokens`` from the first that is an expression, operators behind
    their operands; empty if there is none. ``with`` binds before ``and``, ``and`` before
    ``or``, and operators of one kind from the left."""
    out: list[str] = []
    waiting: list[str] = []
    best: list[str] = []
    operand = True  # whether an operand comes next
    for token in tokens:
        if operand:
            if token == "(":
                waiting.append(token)
                continue
            exception = waiting[-1:] == ["with"]
            if token in BINDING or token == ")" or not ("exception" in token or token.startswith("additionref-") if exception else known(token)):
                break
            out.append(token)
            operand = False
        elif token == ")":
            if "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif token in BINDING:
            if token == "with" and out[-1] in BINDING:
                break  # an exception goes with one licence
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            break
        if not operand and "(" not in waiting:
            best = out + waiting[::-1]
    return best


def evaluate(expression: list[str]) -> tuple[float, frozenset[str]]:
    """The freedom an expression in postfix form gives, and its licences."""
    stack: list[tuple[float, frozenset[str]]] = []
    for token in expression:
        if token == "with":
            stack.pop()
            grade, names = stack.pop()
            stack.append((max(grade, WEAK) if grade >= STRONG else grade, names))
        elif token in BINDING:
            right, left = stack.pop(), stack.pop()
            pick = max if token == "or" else min
            stack.append((pick(left[0], right[0]), left[1] | right[1]))
        else:
            name = family(token)
            stack.append((GRADES.get(name, CLOSED), frozenset([name])))
    return stack.pop()


@dataclass
class Statement:
    """A licence expression in postfix form, the words where it stands, and how it is given."""

    word: int
    end: int
    kind: str
    expression: list[str]


class Scanner:
    """Finds places and statements in a text; one a task."""

    def __init__(self, base: Mapping[str, str]):
        import ahocorasick

        self.base = {k: v for k, v in base.items()}
        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *NOTICES, *TAGS}:
            # Latin-1 stands for the bytes of the text: one character a byte.
            self.automaton.add_word(f" {phrase} ".encode().decode("latin-1"), (phrase, phrase.count(" ") + 1))
        self.automaton.make_automaton()

    def __call__(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[Statement]]:
        """Number of words, (word, label) of each place of a base phrase, statements."""
        folded = text.translate(FOLD)
        words = folded.split()
        joined = f" {b' '.join(words).decode('latin-1')} "
        places: list[tuple[int, str]] = []
        notices: list[tuple[int, int, str]] = []
        tags: list[int] = []
        spaces, upto = 0, 0
        for end, (phrase, length) in self.automaton.iter(joined):
            spaces += joined.count(" ", upto, end + 1)
            upto = end + 1
            first = spaces - 1 - length
            if phrase in self.base:
                places.append((first, self.base[phrase]))
            if phrase in NOTICES:
                notices.append((first, first + length, NOTICES[phrase]))
            if phrase in TAGS:
                tags.append(first + length)
        places.sort()
        tagged = self._tagged(text, folded, tags) if tags else []
        inside = {w for s in tagged for w in range(s.word, s.end)}
        statements = tagged + self._noticed(words, [n for n in notices if n[0] not in inside])
        # "All rights reserved" stands beside many a licence; alone it closes a text.
        granting = [s for s in statements if s.expression != ["proprietary"]]
        return len(words), places, sorted(granting or statements, key=lambda s: s.word)

    def _tagged(self, text: bytes, folded: bytes, tags: list[int]) -> list[Statement]:
        out, behind = [], sorted(set(tags))
        at = 0
        for n, word in enumerate(re.finditer(rb"[^ ]+", folded), 1):
            if n != behind[at]:
                continue
            gap = _AFTER_TAG.match(text, word.end())
            if gap:
                line = text.find(b"\n", gap.end())
                line = text[gap.end() : line if line >= 0 else len(text)].lower()
                tokens, ends = [], [0]
                while found := _TOKEN.match(line, ends[-1]):
                    tokens.append(found[1].decode().rstrip("."))
                    ends.append(found.end())
                if expression := postfix(tokens):
                    # It is read up to its last operand or operator.
                    operands = [i for i, t in enumerate(tokens, 1) if t not in ("(", ")")]
                    read = terms(line[: ends[operands[len(expression) - 1]]])
                    out.append(Statement(n, n + len(read), "tag", expression))
            at += 1
            if at == len(behind):
                break
        return out

    @staticmethod
    def _noticed(words: list[bytes], notices: list[tuple[int, int, str]]) -> list[Statement]:
        """Notices outside longer ones; neighbours joined by "or" or "and" are one statement."""
        outer: list[tuple[int, int, str]] = []
        for notice in sorted(notices, key=lambda n: (n[0], -n[1])):
            if outer and notice[0] < outer[-1][1] and notice[2] == outer[-1][2]:
                outer[-1] = (outer[-1][0], max(outer[-1][1], notice[1]), notice[2])
            elif not outer or notice[1] > outer[-1][1]:
                outer.append(notice)
        out: list[Statement] = []
        tokens: list[str] = []
        for n, (first, end, label) in enumerate(outer):
            joint = None
            if n and 0 <= first - outer[n - 1][1] <= 12:
                gap = b" ".join(words[outer[n - 1][1] : first]).decode("latin-1")
                gap = re.sub(r"\b(or later|or any later|or at your option any later)\b", " ", gap).split()
                if all(w in FILLERS or w.isdigit() for w in gap):
                    joint = "or" if "or" in gap else "and" if "and" in gap else None
            if joint:
                tokens += [joint, label]
            else:
                if tokens:
                    out.append(Statement(begin, outer[n - 1][1], "notice", postfix(tokens)))
                tokens, begin = [label], first
        if tokens:
            out.append(Statement(begin, outer[-1][1], "notice", postfix(tokens)))
        return out


RESULT = "n_words bigint, places array<struct<word: bigint, label: string>>, statements array<struct<word: bigint, end: bigint, kind: string, expression: string, grade: double, labels: array<string>>>"


def license_scan(docs: DataFrame, base: Mapping[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_words, ``places`` (word, label) of the base
    phrases, and ``statements`` (word, end, kind, expression in postfix form, grade, labels).

    Words count from 0; phrases that overlap all count. A tag whose expression can't be
    read gives no statement; of one that breaks off, the part that can be read counts. A
    null or empty text has no words and empty lists. Rows that repeat an id are rows of
    their own; an empty table gives no rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base)
        for batch in batches:
            n_words, all_places, all_statements = [], [], []
            for text in columns(batch, "_text")[0]:
                n, places, statements = scanner(text)
                n_words.append(n)
                all_places.append([{"word": w, "label": x} for w, x in places])
                found = []
                for s in statements:
                    grade, names = evaluate(s.expression)
                    found.append({"word": s.word, "end": s.end, "kind": s.kind, "expression": " ".join(s.expression), "grade": grade, "labels": sorted(names)})
                all_statements.append(found)
            place = pa.struct([("word", pa.int64()), ("label", pa.string())])
            statement = pa.struct([("word", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("expression", pa.string()), ("grade", pa.float64()), ("labels", pa.list_(pa.string()))])
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(all_places, pa.list_(place)), pa.array(all_statements, pa.list_(statement))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_words", "places", "statements"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, utf8(text_col).alias("_text")).mapInArrow(scan, f"`{id_col}` {kind}, {RESULT}")


def license_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per scanned text: numbers and ends of its places, labels, and ``score``: the
    freedom left when all statements hold, so the least of their grades; without any
    statement nothing is granted and the score is 0. ``n_statements`` counts them."""
    base = F.array_distinct(F.col("places.label"))
    own = F.flatten(F.col("statements.labels"))
    return scanned.select(
        id_col,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_min("statements.grade"), F.lit(0.0)).alias("score"),
        F.size("statements").cast("bigint").alias("n_statements"),
    )
