"""Secret scans with one combined deterministic automaton.

A rule has a head, a regular expression that ends with the first byte of its tail, and the tail's class of bytes, along
which a match goes on. The heads are compiled (position sets, subset construction, minimisation) into one table of
transition arrays over bytes that runs all rules at once; a single pass over the bytes of a text tells where each rule's
heads end, a small reversed automaton of that head finds the leftmost start, and the match goes on to where the class ends.
Per rule, matches are leftmost, longest and non-overlapping: no head may hold a shorter one of its own rule that starts later
and ends earlier. Tails stay out of the automaton because it would keep all of them alive at once: five rules with their
tails have 697 states, and three more 13,489; the heads of all rules below have under 500.

Edge cases: a null text is empty and has no span; offsets are code points, end exclusive; repeated rows give repeated
results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as K
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

class Rule(NamedTuple):
    """head: regular expression up to the first byte of the tail; tail: class of the bytes that follow ("" for none); least: matches
    that are shorter are dropped after they have been found; value: the length is that of the tail alone; dots: least number of
    dots in a match."""

    head: str
    tail: str = ""
    least: int = 0
    value: bool = False
    dots: int = 0


# The base rules, in the order in which kinds are listed, then the rules that this scan adds, by the issuers' prefixes.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "assign": Rule(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", "A-Za-z0-9+/_.=-", 8, value=True),
    "access": Rule(r"AKIA[A-Z0-9]", "A-Z0-9", 16),
    "hex": Rule(r"[0-9a-f]{32}", "0-9a-f"),
    "github": Rule(r"gh[opsu]_[A-Za-z0-9]", "A-Za-z0-9", 24),
    "pem": Rule(r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    "github_pat": Rule(r"github_pat_[A-Za-z0-9_]", "A-Za-z0-9_", 82),
    "gitlab": Rule(r"glpat-[A-Za-z0-9_-]", "A-Za-z0-9_-", 26),
    "slack": Rule(r"xox[abprs]-[A-Za-z0-9]", "A-Za-z0-9-", 24),
    "google": Rule(r"AIza[A-Za-z0-9_-]", "A-Za-z0-9_-", 39),
    "stripe": Rule(r"[rs]k_(live|test)_[A-Za-z0-9]", "A-Za-z0-9", 24),
    "npm": Rule(r"npm_[A-Za-z0-9]", "A-Za-z0-9", 40),
    "pypi": Rule(r"pypi-[A-Za-z0-9_-]", "A-Za-z0-9_-", 60),
    "sendgrid": Rule(r"SG\.[A-Za-z0-9_-]", "A-Za-z0-9_.-", 60, dots=2),
    "hub": Rule(r"hf_[A-Za-z0-9]", "A-Za-z0-9", 34),
    "droplet": Rule(r"do[opr]_v1_[0-9a-f]", "0-9a-f", 71),
    "jwt": Rule(r"eyJ[A-Za-z0-9_-]", "A-Za-z0-9_.-", 40, dots=2),
}
BASE = ("assign", "access", "hex")


# ------------------------------------------------------------------------------------------------- compilation
class Nfa:
    """Thompson automaton over byte sets. edges[q]: (set of bytes, or None for an empty move, target)."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def move(self, a: int, what: frozenset | None, b: int) -> None:
        self.edges[a].append((what, b))

    def add(self, tree, a: int, fold: bool, back: bool) -> int:
        """Adds a parsed expression from state a; returns its end. back: for the reversed language."""
        for op, arg in reversed(list(tree)) if back else list(tree):
            if op is K.SUBPATTERN:
                a = self.add(arg[3], a, (fold or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE, back)
            elif op is K.BRANCH:
                end = self.state()
                for one in arg[1]:
                    self.move(self.add(one, a, fold, back), None, end)
                a = end
            elif op is K.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    a = self.add(inner, a, fold, back)
                if high is K.MAXREPEAT:
                    loop = self.state()
                    self.move(a, None, loop)
                    self.move(self.add(inner, loop, fold, back), None, loop)
                    a = loop
                else:
                    end = self.state()
                    self.move(a, None, end)
                    for _ in range(high - low):
                        a = self.add(inner, a, fold, back)
                        self.move(a, None, end)
                    a = end
            else:
                b = self.state()
                self.move(a, self.bytes_of(op, arg, fold), b)
                a = b
        return a

    @staticmethod
    def bytes_of(op, arg, fold: bool) -> frozenset:
        if op is K.LITERAL:
            found = {arg}
        elif op is K.IN:
            found = {c for kind, x in arg for c in ([x] if kind is K.LITERAL else range(x[0], x[1] + 1))}
        else:
            raise ValueError(f"not supported in a rule: {op}")
        if fold:
            found |= {c ^ 32 for c in found if chr(c & 0xDF).isalpha() and c < 128}
        return frozenset(found)

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for what, b in self.edges[todo.pop()]:
                if what is None and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)


def compile_dfa(rules: list[str], floating: bool, back: bool = False) -> list[list]:
    """Rows of a minimal automaton: row[byte] is the next row, row[256] the bit mask of the rules that end here.

    floating: a match may begin at any byte. Dead states map to None unless floating.
    """
    nfa, ends = Nfa(), {}
    start = nfa.state()
    for k, rule in enumerate(rules):
        first = nfa.state()
        nfa.move(start, None, first)
        ends[nfa.add(_parser.parse(rule), first, False, back)] = 1 << k
    begin = nfa.closure([start])
    number, todo, table_, masks = {begin: 0}, [begin], [], []
    # bytes that no rule tells apart share a class
    sets = list({what for e in nfa.edges for what, _ in e if what})
    classes: dict[tuple, int] = {}
    of = [classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256)]
    sample = [of.index(c) for c in range(len(classes))]
    while todo:
        at = todo.pop(0)
        masks.append(sum({m for q, m in ends.items() if q in at}))
        row = []
        for b in sample:
            to = {t for q in at for what, t in nfa.edges[q] if what and b in what}
            to = nfa.closure(to | ({start} if floating else set()))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table_.append(row)
    # minimisation by refining the partition of states
    part = masks
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((part[q], *[part[t] for t in table_[q]]), len(keys)) for q in range(len(table_))]
        if len(set(new)) == len(set(part)):
            break
        part = new
    blocks = sorted(set(new), key=lambda c: (c != new[0], c))
    rows = {c: [None] * 257 for c in blocks}
    dead = None if floating else new[number[frozenset()]] if frozenset() in number else None
    for q, c in enumerate(new):
        rows[c][256] = masks[q]
        for b in range(256):
            to = new[table_[q][of[b]]]
            rows[c][b] = None if to == dead and not floating else rows[to]
    return [rows[c] for c in blocks]


class Scanner:
    def __init__(self, rules: dict[str, Rule] = RULES):
        self.kinds, self.rules = list(rules), list(rules.values())
        self.forward = compile_dfa([r.head for r in self.rules], floating=True)[0]
        self.backward = [compile_dfa([r.head], floating=False, back=True)[0] for r in self.rules]
        self.tails = [frozenset() if not r.tail else Nfa.bytes_of(*_parser.parse(f"[{r.tail}]")[0], False) for r in self.rules]

    def _start(self, k: int, data: bytes, end: int, least: int) -> int:
        """The smallest start of at least `least` from which the head of rule k matches up to `end`, or -1."""
        row, best, i = self.backward[k], -1, end
        while i > least:
            i -= 1
            row = row[data[i]]
            if row is None:
                break
            if row[256]:
                best = i
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        out, row, last, n = [], self.forward, [0] * len(self.kinds), len(data)
        for i, b in enumerate(data):
            row = row[b]
            mask = row[256]
            while mask:
                k = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                # a head that ends within the match before is part of it
                if i < last[k] or (start := self._start(k, data, i + 1, last[k])) < 0:
                    continue
                end, tail, rule = i + 1, self.tails[k], self.rules[k]
                while end < n and data[end] in tail:
                    end += 1
                last[k] = end
                if end - (i if rule.value else start) >= rule.least and data.count(b".", start, end) >= rule.dots:
                    out.append((start, k, end))
        return sorted(out)

    def text_spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, by start, then kind as listed."""
        data = text.encode()
        found = self.spans(data)
        if len(data) == len(text):
            return [(s, e, self.kinds[k]) for s, k, e in found]
        if not found:
            return []
        # code points before each byte: those that do not continue another one
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=before[1:])
        return [(int(before[s]), int(before[e]), self.kinds[k]) for s, k, e in found]


@lru_cache(maxsize=8)
def scanner_of(rules: tuple[tuple[str, Rule], ...]) -> Scanner:
    """Compiled once in a worker, which serves many tasks."""
    return Scanner(dict(rules))


# --------------------------------------------------------------------------------------------------- operators
def scan_secrets(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """doc_id, secrets: array of (start, end, kind) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(tuple(rules.items()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scanner.text_spans(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, secrets array<struct<start:bigint,end:bigint,kind:string>>")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each secret, or union of overlapping ones, replaced by its (first) kind."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += (text[at:s], f"[{kind}]")
        at = max(at, e)
    return "".join((*out, text[at:]))


def redact_secrets(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """docs with the secrets in text replaced by their kinds; all other columns as they are; null stays null."""

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(tuple(rules.items()))
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [x and redacted(x, scanner.text_spans(x)) for x in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(redact, docs.schema)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan_secrets(table(spark, sf_dir, "documents"))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, one), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
