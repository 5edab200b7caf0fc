"""Secret scans through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived (a conjunction of the trigrams that any match must
hold, with alternatives for its branches). Each block of documents is indexed by an inverted list from trigram to documents; a
rule's query intersects and unites those lists, and only the documents that remain are scanned with the rule. A rule from which no
trigram follows scans every document. The index is local to a block, so it needs no shuffle and its size is bounded by the block.

Defined results: null text counts as empty and has no spans. Very long texts are indexed in overlapping slices and scanned whole; no
rule takes more than a bounded number of steps for each character. Repeated rows give repeated results. An empty table gives an empty
result. Only the kept columns and the texts are read; redact and the stage keep all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, numbered, slices, table

# A query is None (any document), ("tri", str), ("and", [..]) or ("or", [..]).
MOST_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    """keep says which matches count; what it refuses is dropped, and the search goes on behind it."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None


def _long(group: int, least: int) -> Callable[[re.Match], bool]:
    return lambda m: len(m[group]) >= least


# The base rules.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long(2, 12)),
    Rule("access", r"AKIA[A-Z0-9]+", _long(0, 18)),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=\s:,-])*+-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _all(parts: list) -> tuple | None:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list) -> tuple | None:
    if not parts or any(p is None for p in parts):
        return None
    return parts[0] if len(parts) == 1 else ("or", parts)


def _needs(words: set[str]) -> tuple | None:
    """Some word of the set stands in the text."""
    return _any([_all([("tri", w.lower()[i : i + 3]) for i in range(len(w) - 2)]) for w in sorted({w.lower() for w in words})])


def _class(items: list) -> set[str] | None:
    """The members of a small character class."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _study(nodes) -> tuple[set[str] | None, tuple | None]:
    """(all words that the nodes can stand for, or None; the query for a longer whole)."""
    words: set[str] | None = {""}
    exact, found = True, []

    def flush() -> None:
        nonlocal words
        found.append(_needs(words))
        words = {""}

    for op, arg in nodes:
        inner: tuple[set[str] | None, tuple | None] = (None, None)
        if op is sre.LITERAL:
            inner = ({chr(arg)}, None)
        elif op is sre.IN:
            inner = (_class(arg), None)
        elif op is sre.SUBPATTERN:
            inner = _study(arg[3])
        elif op is sre.BRANCH:
            each = [_study(x) for x in arg[1]]
            if all(w is not None for w, _ in each):
                inner = (set().union(*(w for w, _ in each)), None)
            else:
                inner = (None, _any([q if w is None else _needs(w) for w, q in each]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            w, q = _study(body)
            if w is not None and (low, high) == (0, 1):
                inner = (w | {""}, None)
            elif w is not None and low == high and len(w) ** low <= MOST_LITERALS:
                inner = ({""}, None)
                for _ in range(low):
                    inner = ({a + b for a in inner[0] for b in w}, None)
            elif low > 0:
                inner = (None, q if w is None else _needs(w))
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        w, q = inner
        if w is not None and len(words) * len(w) <= MOST_LITERALS:
            words = {a + b for a in words for b in w}
            continue
        exact = False
        flush()
        if w is not None:
            words = set(w)
            flush()
        found.append(q)
    if exact:
        return words, None
    flush()
    return None, _all(found)


def trigram_query(pattern: str) -> tuple | None:
    """The query that every text with a match satisfies, over trigrams with A-Z lower-cased; None if none follows."""
    words, query = _study(list(sre_parser.parse(pattern)))
    return _needs(words) if words is not None else query


def trigrams_of(query: tuple | None) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams_of(x) for x in query[1]))


class BlockIndex:
    """Inverted lists, for the trigrams that the rules ask for, over one block of texts."""

    SLICE = 4 << 20

    def __init__(self, texts: list[str], wanted: list[str]):
        self.number = {t: i + 1 for i, t in enumerate(wanted)}
        table = _wanted_table(tuple(wanted))
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(c) + 1 for c in coded])
        whole = np.frombuffer(b"\xff".join([*coded, b""]), dtype=np.uint8)
        pairs: set[int] | np.ndarray = np.zeros(0, dtype=np.int64)
        for at in range(0, len(whole), self.SLICE):
            raw = whole[at : at + self.SLICE + 2]
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint32)
            if len(raw) < 3:
                break
            hit = table[(raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]]
            (pos,) = hit.nonzero()
            docs = np.searchsorted(ends, pos + at, side="right")
            pairs = np.union1d(pairs, hit[pos].astype(np.int64) * len(texts) + docs)
        rule, doc = np.divmod(pairs, max(1, len(texts)))
        cuts = np.searchsorted(rule, np.arange(len(wanted) + 2))
        self.lists = [doc[cuts[i] : cuts[i + 1]] for i in range(len(wanted) + 1)]

    def find(self, query: tuple) -> np.ndarray:
        """Documents that satisfy the query, ascending."""
        if query[0] == "tri":
            return self.lists[self.number[query[1]]]
        parts = [self.find(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


_TABLES: dict[tuple[str, ...], np.ndarray] = {}


def _wanted_table(wanted: tuple[str, ...]) -> np.ndarray:
    if wanted not in _TABLES:
        _TABLES.clear()
        found = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(wanted):
            found[int.from_bytes(t.encode("latin1"), "big")] = i + 1
        _TABLES[wanted] = found
    return _TABLES[wanted]


class Scanner:
    """Rules with their queries; scan() gives for each text its (start, rank, end) in code points, in order."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.queries = [q if all(ord(c) < 128 for t in trigrams_of(q) for c in t) else None for q in self.queries]
        self.wanted = sorted(set().union(*(trigrams_of(q) for q in self.queries)))
        self.compiled = [re.compile(r.pattern) for r in rules]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = BlockIndex(texts, self.wanted)
        for rank, (rule, query, compiled) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for d in range(len(texts)) if query is None else index.find(query).tolist():
                found[d] += [(m.start(), rank, m.end()) for m in compiled.finditer(texts[d]) if rule.keep is None or rule.keep(m)]
        for spans in found:
            spans.sort()
        return found


def scan(docs: DataFrame, *, text_col: str, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns and the spans found in each text; no shuffle."""
    if "spans" in keep:
        raise ValueError("a kept column can't be named spans")
    rows = numbered(docs.select(*[col(c) for c in keep], F.coalesce(col(text_col), F.lit("")).alias(text_col)))
    kept, text = rows.columns[:-1], rows.columns[-1]
    schema = rows.select(*kept).schema.add("spans", _span_type())
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for lo, hi in slices(batch, text, 4 << 20):
                part = batch.slice(lo, hi - lo)
                found = scanner.scan(part.column(text).to_pylist())
                spans = [[{"kind": named[r], "start": s, "end": e} for s, r, e in x] for x in found]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(spans, arrow)], names=[*kept, "spans"])

    return rows.mapInArrow(run, schema).toDF(*keep, "spans")


def _span_type():
    from pyspark.sql import types as T

    return T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def redact(docs: DataFrame, *, text_col: str, rules: tuple[Rule, ...] = RULES, mask: str = "<SECRET>") -> DataFrame:
    """docs with each span replaced by the mask; overlapping spans are joined; a text without spans stays as it is, null too."""
    names = docs.columns
    rows = numbered(docs)
    kept, at = rows.columns, names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for lo, hi in slices(batch, kept[at], 4 << 20):
                part = batch.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                for i, spans in enumerate(scanner.scan([t or "" for t in texts])):
                    if spans:
                        texts[i] = masked(texts[i], [(s, e) for s, _, e in spans], mask)
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.column(i).type) if i == at else part.column(i) for i in range(len(kept))], names=kept)

    return rows.mapInArrow(run, rows.schema).toDF(*names)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, done = [], 0
    start, end = None, None
    for s, e in [*sorted(spans), (len(text) + 1, len(text) + 1)]:
        if start is None:
            start, end = s, e
        elif s < end:
            end = max(end, e)
        else:
            out += [text[done:start], mask]
            done, start, end = end, s, e
    return "".join(out) + text[done:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars, where given, counted anew."""
    out = redact(docs, text_col="text")
    if "n_chars" not in docs.columns:
        return out
    counted = F.when(col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return out.select(*[counted if c == "n_chars" else col(c) for c in docs.columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    found = scan(table(spark, sf_dir, "documents"), text_col="text", keep=["doc_id"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of, base), F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """Every rule over the whole text, for tests."""
    text = text or ""
    return sorted((m.start(), k, m.end()) for k, r in enumerate(RULES) for m in re.finditer(r.pattern, text) if r.keep is None or r.keep(m))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
