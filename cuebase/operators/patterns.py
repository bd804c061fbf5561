"""Many nibble patterns in one pass over each image: an automaton over their literal bytes, confirmed by masks.

A pattern is hex nibbles with * for any and small letters g-z for captures.  Instructions are three bytes
in units of four: a space in a pattern skips the byte that fills the unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A stretch of an image (from, bytes; None: to its end) and the pattern that is looked for in it.
Rule = tuple[int, int | None, str]
FOUND = pa.map_(pa.string(), pa.struct([("offset", pa.int64()), ("captured", pa.map_(pa.string(), pa.int64()))]))
FOUND_TEXT = "map<string,struct<offset:long,captured:map<string,long>>>"


class Pattern(NamedTuple):
    """A pattern as numbers of `size` bytes; captures are (letter, shift, mask); the longest literal run and where it stands."""

    size: int
    value: int
    mask: int
    captures: list[tuple[str, int, int]]
    literal: bytes
    literal_at: int


def parse(text: str) -> Pattern:
    nibbles = text.replace(" ", "**")
    nibbles += "*" * (len(nibbles) % 2)
    known = [c in "0123456789ABCDEF" for c in nibbles]
    number = lambda digits: int("".join(digits), 16)
    value = number(c if k else "0" for c, k in zip(nibbles, known, strict=True))
    mask = number("F" if k else "0" for k in known)
    captures, place = [], 0
    for letter, run in groupby(nibbles):
        width = len(list(run))
        place += width
        if "g" <= letter <= "z":
            captures.append((letter, 4 * (len(nibbles) - place), (1 << 4 * width) - 1))
    literal, literal_at, place = b"", 0, 0
    for whole, run in groupby(range(len(nibbles) // 2), lambda i: known[2 * i] and known[2 * i + 1]):
        at = list(run)
        if whole and len(at) > len(literal):
            literal, literal_at = bytes.fromhex(nibbles[2 * at[0] : 2 * at[-1] + 2]), at[0]
    return Pattern(len(nibbles) // 2, value, mask, captures, literal, literal_at)


def _places(code: bytes, automaton, free: list[str], rules: dict[str, tuple[int, int, Pattern]]) -> Iterator[tuple[str, int]]:
    """(rule, place) where a rule's literal bytes stand; for each rule by rising place.  Rules without a literal byte may stand anywhere."""
    if len(automaton):
        for last, names in automaton.iter(code.decode("latin-1")):
            for name in names:
                pattern = rules[name][2]
                yield name, last + 1 - len(pattern.literal) - pattern.literal_at
    for name in free:
        yield from ((name, at) for at in range(len(code)))


def _first_matches(rules: dict[str, Rule], align: int, low: int):
    """Arrow function over stretches that begin at byte `low` of their images."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parsed = {name: (start - low, size, parse(text)) for name, (start, size, text) in rules.items()}
        by_literal: dict[str, list[str]] = {}
        for name, (_, _, pattern) in parsed.items():
            by_literal.setdefault(pattern.literal.decode("latin-1"), []).append(name)
        free = by_literal.pop("", [])
        automaton = ahocorasick.Automaton()
        for literal, names in by_literal.items():
            automaton.add_word(literal, names)
        automaton.make_automaton()

        def search(code: bytes) -> list[tuple[str, tuple[int, list[tuple[str, int]]]]]:
            found: dict[str, tuple[int, list[tuple[str, int]]]] = {}
            for name, at in _places(code, automaton, free, parsed):
                start, size, pattern = parsed[name]
                end = len(code) if size is None else min(len(code), start + size)
                if name in found or at < start or (at - start) % align or at + pattern.size > end:
                    continue
                here = int.from_bytes(code[at : at + pattern.size])
                if here & pattern.mask == pattern.value:
                    found[name] = at + low, list({letter: here >> shift & ones for letter, shift, ones in pattern.captures}.items())
                    if len(found) == len(parsed):
                        break
            return list(found.items())

        for batch in batches:
            yield pa.array([None if code is None else search(code) for code in batch.to_pylist()], FOUND)

    return run


def find_patterns(code: Column, rules: dict[str, Rule], align: int = 4) -> Column:
    """Map of rule to (offset, captured numbers by letter): the first match in each rule's stretch, at whole units from its start.

    code is binary; only the bytes from the first stretch's start to the last one's end are sent to Python.
    A letter that is captured twice has its last number.  Null code gives null; empty code and code shorter than a
    pattern match nothing.  A rule whose pattern has no whole literal byte is tried at each unit.
    """
    if not rules:
        raise ValueError("no patterns")
    low = min(start for start, _, _ in rules.values())
    ends = [None if size is None else start + size for start, size, _ in rules.values()]
    length = (1 << 31) - 1 if None in ends else max(ends) - low
    search = F.arrow_udf(_first_matches(rules, align, low), FOUND_TEXT)
    return search(F.substring(code, low + 1, length))


def pattern_table(blob: DataFrame, rules: dict[str, Rule], align: int = 4) -> DataFrame:
    """blob (doc_id, h): one row per document and rule that matches: doc_id, rule, offset, captured."""
    found = blob.select("doc_id", F.explode(find_patterns(F.unhex("h"), rules, align)).alias("rule", "at"))
    return found.select("doc_id", "rule", "at.offset", "at.captured")
