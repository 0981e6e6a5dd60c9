"""Op 10, secret scans: Boolean trigram queries from each rule's regex, postings of text blocks, verified candidates.

A rule's pattern is parsed; strings that every match must hold give a query of ANDs and ORs of trigrams over the text
in ASCII lower case.  For a block of documents an inverted index is built of exactly the trigrams that some query
asks for; postings are intersected and joined as the query says, and only documents that pass are searched with the
regex itself.  A rule whose pattern has no mandatory trigram (a run of hex digits) searches every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, slices


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` (ASCII rules of case); a match counts if ``group`` has ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = field(default=re.ASCII)


#: The base rules in the order of the contract, then the rules that this method adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"authorization\x20*[:=]\x20*bearer\x20+[A-Za-z0-9+/_.=~-]+", 0, 30, re.ASCII | re.IGNORECASE),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@[^\s/@]+"),
)
BASE = ("assign", "access", "hex")
_LIMIT = 64


def trigram_query(pattern: str, flags: int = 0) -> tuple | None:
    """A Boolean query that every text with a match satisfies: ``("tri", t)``, ``("and", ...)``, ``("or", ...)``; None: all texts."""
    exact, query = _need(_parser.parse(pattern, flags).data)
    return _and(query, _of_strings(exact)) if exact is not None else query


def _and(*parts: tuple | None) -> tuple | None:
    kept = tuple(dict.fromkeys(p for p in parts if p is not None))
    return kept[0] if len(kept) == 1 else ("and", *kept) if kept else None


def _or(parts: list[tuple | None]) -> tuple | None:
    kept = tuple(dict.fromkeys(parts))
    return None if None in kept or not kept else kept[0] if len(kept) == 1 else ("or", *kept)


def _of_strings(strings: set[str]) -> tuple | None:
    return _or([_and(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) if len(s) > 2 else None for s in sorted(strings)])


def _need(items: list) -> tuple[set[str] | None, tuple | None]:
    """(the exact strings, if few, else None; what every match needs beside them)."""
    now, query, whole = {""}, None, True

    def flush() -> None:
        nonlocal now, query, whole
        query, now, whole = _and(query, _of_strings(now)), {""}, False

    for op, arg in items:
        if op is C.AT:
            continue
        exact, need = None, None
        if op is C.LITERAL:
            exact = {chr(arg).lower()} if arg < 128 else None
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is C.LITERAL and value < 128:
                    chars.add(chr(value).lower())
                elif kind is C.RANGE and value[1] - value[0] < 4 and value[1] < 128:
                    chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            exact = chars if chars and len(chars) <= 4 else None
        elif op is C.SUBPATTERN:
            exact, need = _need(arg[3].data)
        elif op is C.BRANCH:
            parts = [_need(x.data) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*[e for e, _ in parts])
            else:
                need = _or([_and(q, _of_strings(e) if e is not None else None) for e, q in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            e, q = _need(sub.data)
            if (low, high) == (0, 1) and e is not None:
                exact = {"", *e}
            elif low == high and e is not None and len(e) ** low <= _LIMIT and low <= 64:
                exact = {""}
                for _ in range(low):
                    exact = {a + b for a in exact for b in e}
            elif low >= 1:
                need = _and(q, _of_strings(e) if e is not None else None)
        if exact is not None and len(now) * len(exact) <= _LIMIT:
            now = {a + b for a in now for b in exact}
            query = _and(query, need)
        else:
            flush()
            query = _and(query, need, _of_strings(exact) if exact is not None else None)
    return (now, query) if whole else (None, _and(query, _of_strings(now)))


def trigrams_in(query: tuple | None) -> set[str]:
    return set() if query is None else {query[1]} if query[0] == "tri" else set().union(*map(trigrams_in, query[1:]))


class TrigramIndex:
    """Postings of a block of texts for the trigrams that the rules' queries ask for."""

    def __init__(self, wanted: set[str]):
        self.code = {t: int.from_bytes(t.encode("latin-1"), "big") for t in wanted}
        self.table = np.zeros(1 << 24, bool)
        self.table[list(self.code.values())] = True
        self.fold = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

    def build(self, texts: list[bytes]) -> None:
        data = self.fold[np.frombuffer(b"".join(texts), np.uint8)]
        ends = np.cumsum([len(t) for t in texts])
        self.postings: dict[int, set[int]] = {}
        if len(data) < 3 or not self.code:
            return
        codes = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
        at = np.flatnonzero(self.table[codes])
        doc = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[doc]
        for c, d in np.unique(np.stack([codes[at[inside]], doc[inside]]), axis=1).T.tolist():
            self.postings.setdefault(c, set()).add(d)

    def ask(self, query: tuple) -> set[int]:
        if query[0] == "tri":
            return self.postings.get(self.code[query[1]], set())
        parts = [self.ask(q) for q in query[1:]]
        return set.intersection(*sorted(parts, key=len)) if query[0] == "and" else set.union(*parts)


def scan_block(texts: list[str | None], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rank of the rule, end) in code points, sorted."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    compiled = [re.compile(r.pattern, r.flags) for r in rules]
    index = TrigramIndex(set().union(*map(trigrams_in, queries)))
    return _scan(texts, rules, queries, compiled, index)


def _scan(texts, rules, queries, compiled, index) -> list[list[tuple[int, int, int]]]:
    index.build([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for rank, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
        for k in range(len(texts)) if query is None else sorted(index.ask(query)):
            if texts[k]:
                out[k] += [(m.start(), rank, m.end()) for m in regex.finditer(texts[k]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [sorted(x) for x in out]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Adds ``spans array<struct<kind string, start long, end long>>`` to every row; a map without a shuffle.

    Spans are in code points, end exclusive, by start, then in the rules' order.  Null and empty texts have none.  Each
    row is scanned on its own, repeated ones too; a column named ``spans`` in ``docs`` is replaced, all others stay.
    """
    base = docs.drop("spans")
    schema = base.withColumn("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern, r.flags) for r in rules]
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        index = TrigramIndex(set().union(*map(trigrams_in, queries)))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, text_col):
                found = _scan(batch.column(text_col).to_pylist(), rules, queries, compiled, index)
                spans = [[{"kind": rules[r].name, "start": a, "end": b} for a, r, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, "spans"])

    return base.mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, mark: str = "<secret>", rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with overlapping spans joined and each replaced by ``mark`` in the text; ``n_chars``, if there, follows.

    Null and empty texts stay as they are; repeated rows are redacted each; all other columns stay.
    """
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, s) -> if(size(acc) > 0 and s.start <= element_at(acc, -1).b,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, s.end)))),"
        " concat(acc, array(named_struct('a', s.start, 'b', s.end)))))"
    )
    pieces = F.expr(
        f"aggregate(__runs, named_struct('t', '', 'p', 0L), (acc, r) -> named_struct('t', concat(acc.t, substring(`{text_col}`, cast(acc.p + 1 as int), cast(r.a - acc.p as int)), '{mark}'), 'p', r.b),"
        f" acc -> concat(acc.t, substring(`{text_col}`, cast(acc.p + 1 as int))))"
    )
    out = scan_secrets(docs, rules, text_col).withColumn("__runs", merged).withColumn(text_col, F.when(F.size("spans") > 0, pieces).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents; null, empty and very long texts, and repeated rows, as in ``scan_secrets``."""
    found = scan_secrets(documents(spark, sf_dir, "doc_id", "text"))
    listed = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = f"filter(spans, s -> s.kind in {BASE})"
    return found.selectExpr(
        "doc_id", *[f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) n_{k}" for k in BASE],
        f"sha2({listed.format(base)}, 256) base_sha256", f"{listed.format('spans')} spans",
    )
