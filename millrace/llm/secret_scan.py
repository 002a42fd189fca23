"""Secrets in texts: keyword automaton, anchored expressions at its hits, checksums inside the tokens.

One Aho-Corasick automaton over all keywords reads each text once (ASCII letters lowered, bytes as
they are); a rule's expression is tried only at the places where one of its keywords starts.
Runs of hex digits have no keyword: a run of 32 covers two neighbouring places of a grid of 16
bytes, so only such places are tried.  Matches of one rule never overlap: the next is searched
behind the end of the last, as a scan from left to right would, also when the last is then dropped.

A token with a checksum counts only if the checksum is right.  `github` and `npm`: a prefix, 30
characters of base 62, and the CRC-32 of those 30 in six digits of base 62 (0-9, A-Z, a-z).

Cases: null text is empty and has no span; a null or repeated doc_id keeps its row; a text of any
length is read whole; places are code points; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import scan, small_batches

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = b"0123456789abcdef"
GRID = 16


class Rule(NamedTuple):
    """keywords: in lower case, each the start of any match; keep: whether a match of the expression counts."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]
    keep: Callable[[re.Match[bytes]], bool]


def crc_in_base62(token: bytes, check: bytes) -> bool:
    """Whether `check` is the CRC-32 of `token` in base 62, most significant digit first."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(token)


def _checked(m: re.Match[bytes]) -> bool:
    run = m[1]
    return len(run) == 36 and crc_in_base62(run[:30], run[30:])


#: Fixed by the formats: names of assigned secrets, prefixes of access keys and of tokens.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 8),
    Rule("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 16),
    Rule("hex", (), re.compile(rb"[0-9a-f]+"), lambda m: m.end() - m.start() >= 32),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([0-9A-Za-z]+)"), _checked),
    Rule("npm", ("npm_",), re.compile(rb"npm_([0-9A-Za-z]+)"), _checked),
)
#: Kinds that have no checksum.
BASE = ("assign", "access", "hex")


def automaton(rules: tuple[Rule, ...]) -> ahocorasick.Automaton:
    """keyword -> (its length, the numbers of the rules that it starts)."""
    starts: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for word in rule.keywords:
            starts.setdefault(word, []).append(k)
    made = ahocorasick.Automaton()
    for word, own in starts.items():
        made.add_word(word, (len(word), own))
    made.make_automaton()
    return made


_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(HEX_DIGITS)] = True


def _hex_starts(text: bytes):
    """Starts of the runs of hex digits that cover two neighbouring places of the grid; a long run comes again, with a later start."""
    on = _IS_HEX[np.frombuffer(text, np.uint8)[::GRID]]
    for k in np.flatnonzero(on[:-1] & on[1:]):
        at = int(k) * GRID
        before = text[max(0, at - GRID) : at]
        yield at - (len(before) - len(before.rstrip(HEX_DIGITS)))


def spans_of(text: bytes, rules: tuple[Rule, ...], keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in bytes, sorted."""
    found, behind = [], [0] * len(rules)

    def attempt(k: int, at: int) -> None:
        if at >= behind[k] and (m := rules[k].pattern.match(text, at)):
            behind[k] = m.end()
            if rules[k].keep(m):
                found.append((at, k, m.end()))

    # hits come by their ends; a rule must see its starts in order
    hits = sorted((end + 1 - size, k) for end, (size, own) in keywords.iter(text.lower().decode("latin-1")) for k in own)
    for at, k in hits:
        attempt(k, at)
    for k, rule in enumerate(rules):
        if not rule.keywords:
            for at in _hex_starts(text):
                attempt(k, at)
    return sorted(found)


def code_points(text: bytes, places: list[int]) -> list[int]:
    """The places, given in bytes, as numbers of code points."""
    raw, out, at, n = np.frombuffer(text, np.uint8), {}, 0, 0
    for p in sorted(set(places)):
        n += int(np.count_nonzero((raw[at:p] & 0xC0) != 0x80))
        out[p], at = n, p
    return [out[p] for p in places]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(rules: tuple[Rule, ...]):
    def run(batches):
        keywords = automaton(rules)
        for batch in W.pieces(batches, "text"):
            raw, at = W.flat(batch.column("text"))
            out = []
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]].tobytes()
                found = spans_of(text, rules, keywords)
                starts = code_points(text, [a for a, _, _ in found])
                ends = code_points(text, [b for _, _, b in found])
                out.append([{"kind": rules[k].kind, "start": a, "end": b} for (_, k, _), a, b in zip(found, starts, ends, strict=True)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return run


def find_secrets(spark: SparkSession, documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<(kind, start, end)>) of every row; spans by start, then as the rules stand."""
    small_batches(spark)
    rows = scan(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(rules), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
