"""Secret scans over a trigram inverted index.

Each rule's regular expression is read into a Boolean query over trigrams that every match must hold (alternatives join by
OR, parts of a sequence by AND; letters fold to lower case). Documents are indexed in segments, as Spark deals them out: for
each trigram that some rule asks for, a posting list of the segment's documents. A rule's postings are intersected and
united by its query, and only the candidates are verified with the expression itself. A rule without a mandatory trigram
scans every document.

Segments hold a bounded number of characters, so memory does not grow with the input, and nothing is shuffled.

Edge cases: a null text counts as empty; empty texts and texts without secrets give an empty span list; repeated rows give
repeated results; other columns pass through unless called ``spans``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Characters of a segment, about; one longer document is a segment of its own.
SEGMENT = 1_000_000
#: Strings that a part of an expression may stand for, before they are cut into trigrams.
MOST_STRINGS = 32


class Rule(NamedTuple):
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0  # what ``least`` measures
    least: int = 1

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base rules first; the order of kinds is the order of spans that begin together.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    # Begins where no character of it precedes, and gives nothing back: linear on repeats.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    Rule("forge_token", r"(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

# A query is True (any document), or ("and" | "or", parts), where a part is a query or a trigram.


def _all(op: str, parts: list):
    parts = [p for p in dict.fromkeys(parts) if not (op == "and" and p is True)]
    if op == "or" and True in parts or not parts:
        return True
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_string(s: str):
    return _all("and", [s[i : i + 3] for i in range(len(s) - 2)])


def _strings(node) -> set[str] | None:
    """The strings that a parsed part can match, if they are few; folded to lower case."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is C.SUBPATTERN:
        return _product(arg[3])
    if op is C.BRANCH:
        found = [_product(b) for b in arg[1]]
        return None if None in found else set().union(*found)
    if op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 3:
        inner = _product(arg[2])
        if inner is None:
            return None
        out, level = (set() if arg[0] else {""}), {""}
        for k in range(1, arg[1] + 1):
            level = {a + b for a in level for b in inner}
            out |= level if k >= arg[0] else set()
        return out if len(out) <= MOST_STRINGS else None
    return None


def _product(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes):
    """AND over the nodes; runs of nodes with few strings are taken together, so trigrams reach over their borders."""
    parts, held = [], {""}
    for node in nodes:
        more = _strings(node)
        if more is not None and len(held) * len(more) <= MOST_STRINGS:
            held = {a + b for a in held for b in more}
            continue
        parts.append(_all("or", [_of_string(s) for s in sorted(held)]))
        held = more or {""}
        op, arg = node
        if more is None and op is C.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif more is None and op is C.BRANCH:
            parts.append(_all("or", [_query(b) for b in arg[1]]))
        elif more is None and op is C.MAX_REPEAT and arg[0] > 0:
            parts.append(_query(arg[2]))
    parts.append(_all("or", [_of_string(s) for s in sorted(held)]))
    return _all("and", parts)


@lru_cache(256)
def trigram_query(pattern: str):
    """What each match of ``pattern`` must hold, as a query over lower-case trigrams."""
    return _query(_parser.parse(pattern))


def _needed(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_needed, query[1]))


def _candidates(query, postings: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(query, str):
        return postings[query]
    found = [_candidates(q, postings) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(found))
    out = min(found, key=len)
    for other in found:
        out = np.intersect1d(out, other, assume_unique=True) if other is not out else out
    return out


def _code(a, b, c):
    return (a * 128 + b) * 128 + c


def index(texts: list[str], needed: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Posting lists of the needed trigrams: positions of the texts that hold them. Only ASCII counts; case is folded."""
    if not needed:
        return {}
    points = np.frombuffer("\n\n".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    ends = np.cumsum(sizes)
    p = np.where(points < 128, points, 0).astype(np.int32)
    p += ((p >= 65) & (p <= 90)) * np.int32(32)
    empty = np.zeros(0, np.int64)
    if len(p) < 3:
        return {t: empty for t in needed}
    ids = np.full(128**3, -1, np.int16)
    for i, t in enumerate(needed):
        ids[_code(*map(ord, t))] = i
    which = ids[_code(p[:-2], p[1:-1], p[2:])]
    at = np.flatnonzero(which >= 0)
    pair = np.unique(which[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
    cut = np.searchsorted(pair, np.arange(len(needed) + 1) * len(texts))
    return {t: pair[cut[i] : cut[i + 1]] - i * len(texts) for i, t in enumerate(needed)}


def spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of each text of a segment, by start, then by the order of the rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    needed = tuple(sorted(set().union(*map(_needed, queries))))
    postings = index(texts, needed)
    out: list[list] = [[] for _ in texts]
    for rank, (rule, query) in enumerate(zip(rules, queries)):
        find: Callable[[str], Iterator[re.Match]] = rule.compiled().finditer
        for i in range(len(texts)) if query is True else _candidates(query, postings).tolist():
            for m in find(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), rank, m.end()))
    return [[(rules[k].kind, a, b) for a, k, b in sorted(x)] for x in out]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end), code points, end exclusive."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = ["" if t is None else t for t in s.where(s.notna(), None)]
            out, begin, held = [], 0, 0
            for i, t in enumerate(texts):
                if held and held + len(t) > SEGMENT:
                    out += spans(texts[begin:i], rules)
                    begin, held = i, 0
                held += len(t)
            out += spans(texts[begin:], rules) if begin < len(texts) else []
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in out], dtype=object)

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return small_batches(docs).withColumn("spans", F.pandas_udf(run, kind)(F.col(text)))
