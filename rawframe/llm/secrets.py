"""Secret scan with a trigram index.

From each rule's regular expression a Boolean query of trigrams is derived that every match
must satisfy. Each run of texts gets an inverted index of the trigrams that the queries name,
the postings are intersected and united, and only the candidate texts are searched with the
rule itself. Rules without a mandatory trigram are searched in all texts.

Defined results: null and empty texts have no spans; texts are searched whole; repeated rows
give repeated results; an empty table gives no rows; extra columns go through untouched. Spans
are in code points, the end exclusive, sorted by start, then by the rules' order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table
from .kernels import ascii_lower, slices, utf8

#: More alternatives of a literal than these aren't told apart.
MOST_LITERALS = 64
ALWAYS = True


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the least length of a group (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII

    @cached_property
    def search(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.search.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


# The base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Further rules of well-known shapes.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)


def _and(parts: list) -> object:
    parts = [p for p in parts if p is not ALWAYS]
    return ALWAYS if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list) -> object:
    return ALWAYS if any(p is ALWAYS for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_literals(literals: set[bytes]) -> object:
    """Some one of the literals occurs: all its trigrams do."""
    if not literals or min(map(len, literals)) < 3:
        return ALWAYS
    return _or([_and([x[k : k + 3] for k in range(len(x) - 2)]) for x in sorted(literals)])


def trigram_query(pattern: str, flags: int = re.ASCII) -> object:
    """What holds for the lower-cased text around any match: a trigram, ("and"|"or", queries) or ALWAYS."""

    def literal(code: int) -> bytes:
        return bytes([code]).lower() if code < 128 else chr(code).encode()

    def choices(items: list) -> set[bytes] | None:
        out: set[bytes] = set()
        for op, arg in items:
            if op is C.LITERAL:
                out.add(literal(arg))
            elif op is C.RANGE and arg[1] - arg[0] < MOST_LITERALS:
                out |= {literal(c) for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None

    def sequence(items) -> tuple[set[bytes] | None, object]:
        """The strings that the part matches, if they are few, and a query that holds whenever it does."""
        queries: list = []
        current: set[bytes] = {b""}
        whole = True

        def cut() -> None:
            nonlocal current, whole
            queries.append(_of_literals(current))
            current, whole = {b""}, False

        for op, arg in items:
            exact, query = one(op, arg)
            if exact is not None and len(current) * len(exact) <= MOST_LITERALS:
                current = {a + b for a in current for b in exact}
                continue
            cut()
            queries.append(query)
        return (current if whole else None), _and([*queries, _of_literals(current)])

    def one(op, arg) -> tuple[set[bytes] | None, object]:
        if op is C.LITERAL:
            return {literal(arg)}, ALWAYS
        if op is C.IN:
            return choices(arg), ALWAYS
        if op is C.SUBPATTERN:
            return sequence(arg[-1])
        if op is C.BRANCH:
            got = [sequence(x) for x in arg[1]]
            strings = None if any(e is None for e, _ in got) else set().union(*(e for e, _ in got))
            return (strings if strings is not None and len(strings) <= MOST_LITERALS else None), _or([q if e is None else _of_literals(e) for e, q in got])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            exact, query = sequence(body)
            if exact is not None and (low, high) == (0, 1):
                return {b"", *exact}, ALWAYS
            if exact is not None and low == high and len(exact) ** low <= MOST_LITERALS:
                out = {b""}
                for _ in range(low):
                    out = {a + b for a in out for b in exact}
                return out, ALWAYS
            return None, (query if low else ALWAYS)
        if op is C.AT:
            return {b""}, ALWAYS
        return None, ALWAYS

    return sequence(P.parse(pattern, flags))[1]


# The parser is a private part of Python's re and may change: what it gives has to be what is read here.
if trigram_query(r"ab?cd(e|f)[g-h]i{2}.*x+") != ("or", tuple(_and([x[k : k + 3] for k in range(len(x) - 2)]) for x in sorted(a + b"cd" + e + g + b"ii" for a in (b"ab", b"a") for e in (b"e", b"f") for g in (b"g", b"h")))):
    raise ImportError("this Python's pattern parser isn't known to the secret scan")


def trigrams_of(query: object) -> set[bytes]:
    if query is ALWAYS:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings of the named trigrams over a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, order: dict[bytes, int]):
        self.texts, self.order = len(offsets) - 1, order
        n = len(data)
        self.postings: dict[int, np.ndarray] = {}
        if n < 3:
            return
        low = ascii_lower(data).astype(np.uint32)
        named = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        for back in (1, 2):  # trigrams don't reach over a text's end
            over = offsets[1:-1] - back
            named[over[(over >= 0) & (over < len(named))]] = 0
        at = np.flatnonzero(named)
        pairs = np.unique(named[at].astype(np.int64) * self.texts + np.searchsorted(offsets, at, "right") - 1)
        which = pairs // self.texts
        for t in np.unique(which).tolist():
            self.postings[t] = pairs[which == t] - t * self.texts

    def candidates(self, query: object) -> np.ndarray:
        """One truth value a text."""
        if query is ALWAYS:
            return np.ones(self.texts, bool)
        if isinstance(query, bytes):
            out = np.zeros(self.texts, bool)
            out[self.postings.get(self.order[query], [])] = True
            return out
        parts = map(self.candidates, query[1])
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(list(parts))


@lru_cache(maxsize=2)
def _plan(rules: tuple[Rule, ...]) -> tuple[list, dict[bytes, int], np.ndarray]:
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    order = {t: k + 1 for k, t in enumerate(sorted(set().union(*map(trigrams_of, queries))))}
    table = np.zeros(1 << 24, np.uint8 if len(order) < 256 else np.uint16)
    for t, k in order.items():
        table[int.from_bytes(t, "big")] = k
    return queries, order, table


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *MORE)) -> DataFrame:
    """(row, spans): each row of docs as a struct, without its text, and what is found in the text."""
    whole = docs.select(F.struct(*([c for c in docs.columns if c != "text"] or [F.lit(None).alias("_")])).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, order, table = _plan(rules)
        for batch in batches:
            texts = batch.column(1)
            data, offsets = utf8(texts)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j in slices(offsets):
                index = TrigramIndex(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, order)
                for rank, (rule, query) in enumerate(zip(rules, queries)):
                    for k in np.flatnonzero(index.candidates(query)).tolist():
                        if text := texts[i + k].as_py():
                            found[i + k] += [(s, rank, e) for s, e in rule.spans(text)]
            spans = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["row", "spans"])

    return map_arrow(whole, run, f"row {whole.schema['row'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return found.select(
        "row.doc_id",
        *[n(r.kind) for r in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
