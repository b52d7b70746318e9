"""Secret scans: rules are regular expressions, found through an inverted index of trigrams.

Each rule's expression is turned into a Boolean query over the trigrams that any match must hold: literals that follow
each other give conjunctions, alternatives and small classes disjunctions. Every block of texts gets an inverted index,
from trigrams to ascending row numbers, of the trigrams that the rules ask for; a rule's query intersects and unites
postings, and its expression then runs on the rows that are left. A rule whose query holds for any text (a plain run of
hex digits) runs on all rows. Trigrams are of UTF-8 bytes with A-Z lower-cased, so postings never miss a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import steps, text_batches


def either_case(word: str) -> str:
    """An expression for a word whose letters are in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and non-overlapping, whose group has at least `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_WORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
#: The base kinds, in the order that ties of spans follow.
BASE = (
    Rule("assign", f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: Kinds with a published form, after the base kinds. Quantifiers are bounded where a match could start anywhere in a run.
MORE = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,255}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,250}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,900}\\.eyJ[A-Za-z0-9_-]{10,900}\\.[A-Za-z0-9_-]+"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url_login", "://[A-Za-z0-9._~-]{1,200}:[A-Za-z0-9._~-]{1,200}@"),
)
RULES = BASE + MORE

#: Characters that a class may have to be taken apart; strings that a set may have; times that a repetition is written out.
CLASS, STRINGS, WRITTEN = 12, 64, 3
#: Bytes of the texts of a block, and one text more.
BLOCK_BYTES = 4_000_000

#: A query is True (any text), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _parts(query: Query) -> frozenset:
    return frozenset(query[1]) if isinstance(query, tuple) and query[0] == "and" else frozenset([query])


def both(queries: Iterable[Query]) -> Query:
    parts = sorted(frozenset().union(*map(_parts, queries)) - {True}, key=repr)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(queries: Iterable[Query]) -> Query:
    """Without alternatives that ask for all that another asks for, and more."""
    parts = {_parts(q): q for q in queries}
    if frozenset([True]) in parts:
        return True
    least = sorted((q for p, q in parts.items() if not any(other < p for other in parts)), key=repr)
    return least[0] if len(least) == 1 else ("or", tuple(least))


def holds(strings: frozenset[str]) -> Query:
    """What a text with one of the strings holds, byte by byte; short strings say nothing."""
    return either(both(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class Known:
    """What is known of an expression's matches: all of them (exact, or None), how they begin and end, and a query that holds for each."""

    exact: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    query: Query = True

    @classmethod
    def of(cls, strings: Iterable[str]) -> Known:
        s = frozenset(strings)
        return cls(s, s, s)

    def loose(self) -> Known:
        """Without the exact strings, which the query then stands for; ends are cut to what a trigram across them can use."""
        if self.exact is None:
            return self
        return Known(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), both([self.query, holds(self.exact)]))


ANY, NOTHING = Known(None, frozenset({""}), frozenset({""})), Known.of([""])


def _joined(left: frozenset[str], right: frozenset[str]) -> frozenset[str]:
    return frozenset(a + b for a, b in product(left, right))


def _then(x: Known, y: Known) -> Known:
    if x.exact is not None and y.exact is not None:
        if len(x.exact) * len(y.exact) <= STRINGS:
            return Known.of(_joined(x.exact, y.exact))
    left, right = x.exact or x.end, y.exact or y.begin
    across = holds(_joined(left, right)) if len(left) * len(right) <= STRINGS else True
    begin = _joined(x.exact, y.begin) if x.exact is not None and len(x.exact) * len(y.begin) <= STRINGS else x.loose().begin
    end = _joined(x.end, y.exact) if y.exact is not None and len(x.end) * len(y.exact) <= STRINGS else y.loose().end
    a, b = x.loose(), y.loose()
    return Known(None, frozenset(s[:2] for s in begin), frozenset(s[-2:] for s in end), both([a.query, b.query, across]))


def _or(x: Known, y: Known) -> Known:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= STRINGS:
        return Known.of(x.exact | y.exact)
    a, b = x.loose(), y.loose()
    return Known(None, a.begin | b.begin, a.end | b.end, either([a.query, b.query]))


def _folded(code: int) -> str:
    """A character's UTF-8 bytes, as characters, A-Z lower-cased."""
    c = chr(code)
    return (c.lower() if c.isascii() else c).encode().decode("latin-1")


def _class(items: list) -> Known:
    codes: set[int] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            codes.add(arg)
        elif name == "RANGE" and arg[1] - arg[0] < 2 * CLASS:
            codes.update(range(arg[0], arg[1] + 1))
        else:
            return ANY
    found = {_folded(c) for c in codes}
    return Known.of(found) if len(found) <= CLASS else ANY


def _known(parsed) -> Known:
    """What a parsed expression tells; what isn't understood counts as any text."""
    out = NOTHING
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            step = Known.of([_folded(arg)])
        elif name == "IN":
            step = _class(arg)
        elif name == "SUBPATTERN":
            step = ANY if arg[1] or arg[2] else _known(arg[3])
        elif name == "BRANCH":
            step = _known(arg[1][0])
            for other in arg[1][1:]:
                step = _or(step, _known(other))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, what = arg
            one, step = _known(what), NOTHING
            if least == 0:
                step = _or(NOTHING, one) if most == 1 else ANY
            for _ in range(min(least, WRITTEN)):
                step = _then(step, one)
            if least and most > min(least, WRITTEN):
                step = _then(_then(step, ANY), one)  # ends as it does
        elif name == "AT":
            step = NOTHING
        else:
            step = ANY
        out = _then(out, step)
    return out


def trigram_query(pattern: str) -> Query:
    """What trigrams every match of an expression holds: True if none for sure."""
    return _known(re._parser.parse(pattern)).loose().query


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], dtype=np.uint8)


class TrigramIndex:
    """Postings of the wanted trigrams in a block of texts (none null): ascending row numbers."""

    def __init__(self, texts: pa.Array, wanted: Iterable[str]):
        names = sorted(wanted)
        codes = np.array([int.from_bytes(t.encode("latin-1")) for t in names], dtype=np.uint32)
        texts = texts.cast(pa.large_string())
        self.rows = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64, self.rows + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        self.postings = dict.fromkeys(names, np.zeros(0, dtype=np.int64))
        if len(data) < 3 or not len(codes):
            return
        b = _LOWER[data]
        pair = b[:-1].astype(np.uint16) << 8 | b[1:]
        first = np.zeros(1 << 16, dtype=bool)
        first[codes >> 8] = True
        at = np.flatnonzero(first[pair[:-1]])
        code = pair[at].astype(np.uint32) << 8 | b[at + 2]
        which = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[which] == code
        at, which = at[hit], which[hit]
        row = np.searchsorted(ends, at, "right") - 1
        inside = at + 3 <= ends[row + 1]
        keys = np.unique(which[inside] * self.rows + row[inside])
        cuts = np.searchsorted(keys, np.arange(1, len(names)) * self.rows)
        self.postings = {t: k % self.rows for t, k in zip(names, np.split(keys, cuts))}

    def search(self, query: Query) -> np.ndarray:
        """Rows that a query holds for, ascending."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings[query]
        found = sorted(map(self.search, query[1]), key=len)
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Code-point ranges of a rule's matches in a text."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): the spans (start, place, kind, end) of all rules in each row's whole text, by start, then the rules' order.

    Positions are code points, ends exclusive. A null text counts as empty, and a text without secrets has no spans;
    null and repeated ids are rows of their own; an empty table gives an empty one. Blocks of texts are indexed where
    they are read, so nothing is shuffled.
    """
    text_batches(docs.sparkSession)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*map(trigrams, queries))
    span = pa.struct([("start", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in batches:
            for i, j in steps(pc.binary_length(batch.column("text")).to_pylist(), BLOCK_BYTES):
                ids, texts = (batch.column(c).slice(i, j - i) for c in ("doc_id", "text"))
                index, plain = TrigramIndex(texts, wanted), texts.to_pylist()
                found: list[list[tuple]] = [[] for _ in plain]
                for place, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
                    for row in index.search(query).tolist():
                        found[row].extend((a, place, rule.kind, b) for a, b in matches(rule, pattern, plain[row]))
                spans = [[dict(zip(("start", "place", "kind", "end"), s)) for s in sorted(f)] for f in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(spans, pa.list_(span))], ["doc_id", "found"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, found array<struct<start: int, place: int, kind: string, end: int>>")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of whole `documents`: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["place"] < len(BASE))
    return rows.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def _oracle() -> str:
    """The query in SQL: a match starts behind the pieces between matches, and the matches, before it."""
    kinds = []
    for place, r in enumerate(RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        kinds.append(
            f"SELECT i, {place} AS place, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS k, m, g, p FROM (SELECT i, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, string_split_regex(t, {pattern}) AS p FROM d) WHERE len(m) > 0"
        )
    least = "CASE place " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES)) + " END"
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    start = f"{size.format('p[1:k]')} + {size.format('m[1:k - 1]')}"
    return f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(kinds)}),
s AS (SELECT i, place, kind, ({start})::BIGINT AS a, ({start})::BIGINT + length(m[k]) AS b FROM f WHERE length(g[k]) >= {least}),
n AS (SELECT i, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (place < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans FROM s GROUP BY i)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (i)"""


ORACLE = _oracle()
