"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans.  On top of them a small lexer reads source and configuration syntax (``name =
"literal"``, ``name: literal``, ``"name": "literal"``, ``name := a + "b"``, ``name += literal``, triple quotes, here
documents, indented blocks after ``name: |``, ``<name>literal</name>``, and armoured private keys) into name-literal pairs.
It keeps the constants seen so far in a text and propagates them through later assignments and concatenations, so a literal that
reaches a sensitive name by way of a harmless one is found where it is written.  A literal is scored by the words of the
names that it reaches and by its own looks, and those of at least ``threshold`` become spans of kind ``literal``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import map_rows, map_slices, texts
from lodestrata.llm.spans import SPANS, digest_columns, in_order, redacted

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "literal"]

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of under 24 characters fail, so only longer ones are looked for; a run starts where none is under way.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Words of names that hold secrets, and how sure each is.
SENSITIVE = {
    "accesskey": 1.0, "apikey": 1.0, "auth": 0.7, "bearer": 0.8, "cert": 0.4, "credential": 1.0, "credentials": 1.0, "creds": 1.0, "cookie": 0.5,
    "key": 0.6, "pass": 0.8, "passphrase": 1.0, "passwd": 1.0, "password": 1.0, "pin": 0.5, "private": 0.6, "privatekey": 1.0, "pw": 0.8, "pwd": 1.0,
    "salt": 0.6, "secret": 1.0, "secretkey": 1.0, "session": 0.4, "signature": 0.5, "signing": 0.6, "token": 1.0,
}
#: Literals that stand for a secret without being one.
PLACEHOLDERS = re.compile(r"(?i)changeme|example|placeholder|your|dummy|redacted|none|null|true|false|\*{3}|x{4}|<.*>|\$\{.*\}|\{\{.*\}\}")

#: A literal of more characters is no placeholder: nobody types one so long, and base64 has "none" or "your" in it by chance.
LONGEST_PLACEHOLDER = 4096

_PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*+)["']?[\x20\t]*(:=|=>|\+=|=(?!=)|:(?!:|//))[\x20\t]*""")
_TRIPLE = re.compile(r"""[A-Za-z]{0,2}(\"{3}|'{3})""")
_HERE = re.compile(r"""<<[-~]?[\x20\t]*(["']?)([A-Za-z_][A-Za-z0-9_]*)\1[^\n]*\n""")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[\x20\t]*\r?\n")
_LINE = re.compile(r"([\x20\t]*)([^\n]*?)[\x20\t\r]*(?:\n|\Z)")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)>[\x20\t]*([^<>\s]+)[\x20\t]*</\1>")
_ARMOUR = re.compile(r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z\x20]*PRIVATE KEY-----")
_QUOTED = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'""")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
_SPACE = re.compile(r"[\x20\t]*")
_PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """1 for a name that surely holds a secret, 0 for one of no such word."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    return max([SENSITIVE.get(x, 0.0) for x in (*parts, "".join(parts), *map("".join, zip(parts, parts[1:], strict=False)))], default=0.0)


def _score(counts: Counter, text: Callable[[], str]) -> float:
    """Between 0 and 1, by length, bits a character and kinds of characters; 0 for short texts, prose and placeholders."""
    size = sum(counts.values())
    if size < 8 or " " in counts or size <= LONGEST_PLACEHOLDER and PLACEHOLDERS.search(text()):
        return 0.0
    bits = -sum(n / size * math.log2(n / size) for n in counts.values())
    seen = "".join(counts)
    kinds = sum(bool(re.search(x, seen)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 3.5) * (0.4, 0.5, 0.85, 1.0, 1.0)[kinds]


def literal_score(value: str) -> float:
    return _score(Counter(value), lambda: value)


class Value:
    """What a name is given: literals as (start, end), and values of two parts or more that earlier constants have.

    Earlier values are not copied, since constants may be doubled line after line: characters are counted once for each
    value and spans taken once, and only values of at most LONGEST_PLACEHOLDER characters are spelled out.
    """

    __slots__ = ("counts", "parts", "taken")

    def __init__(self, parts: list):
        self.parts, self.counts, self.taken = parts, None, False


def _tally(text: str, start: int, end: int, last: list) -> Counter:
    """Characters of a literal.  Names in a run of a=b=c= share its end; there only what lies between starts is counted."""
    shared = last and last[1] == end and last[0] <= start
    counts = last[2] - Counter(text[last[0] : start]) if shared else Counter(text[start:end])
    last[:] = start, end, counts
    return counts


def _counted(text: str, value: Value, last: list) -> Counter:
    """How often each character is in the value; ``last`` is the start, end and characters of the literal before."""
    stack = [value]
    while stack:
        top = stack[-1]
        more = [x for x in top.parts if isinstance(x, Value) and x.counts is None] if top.counts is None else []
        if more:
            stack += more
            continue
        stack.pop()
        if top.counts is None:
            top.counts = Counter()
            for x in top.parts:
                top.counts.update(x.counts if isinstance(x, Value) else _tally(text, *x, last))
    return value.counts


def _spelled(text: str, value: Value) -> str:
    out, stack = [], [value]
    while stack:
        top = stack.pop()
        if isinstance(top, Value):
            stack += reversed(top.parts)
        else:
            out.append(text[slice(*top)])
    return "".join(out)


def _take(value: Value, spans: set[tuple[int, int]]) -> None:
    stack = [value]
    while stack:
        top = stack.pop()
        if not isinstance(top, Value):
            spans.add(top)
        elif not top.taken:
            top.taken = True
            stack += top.parts


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


class Blocks:
    """Literals over several lines.  Ends that were looked for in vain are remembered, so a text is searched once for each."""

    def __init__(self, text: str):
        self.text, self.vain = text, set()

    def find(self, mark: str, at: int) -> int:
        end = -1 if mark in self.vain else self.text.find(mark, at)
        if end < 0:
            self.vain.add(mark)
        return end

    def lines(self, start: int, end: int) -> list[tuple[int, int]]:
        """What stands on each line that is not blank."""
        out = []
        while start < end:
            m = _LINE.match(self.text, start, end)
            if m[2]:
                out.append(m.span(2))
            start = max(m.end(), start + 1)
        return out

    def read(self, at: int, name: int) -> tuple[list[tuple[int, int]], int] | None:
        """The lines of a literal that begins at ``at`` after the name at ``name``, and where it ends."""
        text = self.text
        if m := _TRIPLE.match(text, at):
            end = self.find(m[1], m.end())
            return None if end < 0 else (self.lines(m.end(), end), end + 3)
        if m := _HERE.match(text, at):
            end = self.find("\n" + m[2], m.end() - 1)
            return None if end < 0 else (self.lines(m.end(), end), end + 1 + len(m[2]))
        if m := _BLOCK.match(text, at):
            indent = _SPACE.match(text, text.rfind("\n", 0, name) + 1)
            outer, found, at = len(indent[0]), [], m.end()
            while at < len(text) and (line := _LINE.match(text, at)) and (len(line[1]) > outer or not line[2]):
                found += [line.span(2)] if line[2] else []
                at = max(line.end(), at + 1)
            return found, at
        return None


def assignments(text: str):
    """Every (name, Value): the literals that make up what the name is given, and constants in it.

    An unquoted run is a literal as a whole, unless it is a constant, or constants with + between them.  Where a + in it
    may be either, the run by itself is one more value of the name.
    """
    constants: dict[str, Value] = {}
    blocks = Blocks(text)
    after_block = 0
    for pair in _PAIR.finditer(text):
        if pair.start() < after_block:
            continue  # within a literal of several lines
        at, found = pair.end(), [constants[pair[1]]] if pair[2] == "+=" and pair[1] in constants else []
        if block := blocks.read(at, pair.start()):
            found += block[0]
            after_block = block[1]
        while not block:
            if quoted := _QUOTED.match(text, at):
                found.append(quoted.span(quoted.lastindex))
                at = quoted.end()
            elif run := _RUN.match(text, at):
                names = run[0].removesuffix("+").split("+")
                known = [x for x in names if x in constants]
                if len(known) == len(names):
                    at = run.start() + len("+".join(names))
                else:
                    found.append(run.span())
                    at = run.end()
                    if "+" in run[0]:
                        yield pair[1], Value(found[-1:])
                found += [constants[x] for x in known]
                if text[at - 1] == "+":
                    after = _SPACE.match(text, at).end()
                    if _QUOTED.match(text, after) or ((run := _RUN.match(text, after)) and run[0] in constants):
                        at = after
                        continue
            else:
                break
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if found:
            parts = [x for x in found if (x.parts if isinstance(x, Value) else x[0] < x[1])]
            constants[pair[1]] = parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else Value(parts)
            yield pair[1], constants[pair[1]]


def literal_spans(text: str, base: list[tuple[str, int, int]], threshold: float) -> list[tuple[str, int, int]]:
    if "=" not in text and ":" not in text and "</" not in text and "PRIVATE KEY" not in text:
        return []
    found: set[tuple[int, int]] = set()
    last: list = []
    for name, value in assignments(text):
        score = name_score(name)
        if score and not value.taken and score * _score(_counted(text, value, last), lambda value=value: _spelled(text, value)) >= threshold:
            _take(value, found)
    for m in _ELEMENT.finditer(text) if "</" in text else ():
        if name_score(m[1]) * literal_score(m[2]) >= threshold:
            found.add(m.span(2))
    for m in _ARMOUR.finditer(text) if "PRIVATE KEY" in text else ():
        found.update(Blocks(text).lines(*m.span(1)))
    starts, reach = [], []  # of the base spans, and how far those up to each go
    for start, end in sorted((a, b) for _, a, b in base):
        starts.append(start)
        reach.append(max(end, reach[-1] if reach else 0))
    within = lambda a, b: (i := bisect_right(starts, a)) > 0 and reach[i - 1] >= b
    return [("literal", a, b) for a, b in sorted(found) if not within(a, b)]


def all_spans(text: str, threshold: float) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + literal_spans(text, base, threshold)


def find_secrets(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id and ``spans`` (kind, start, end; code points, end exclusive; by start, then kind as in KINDS) of every text.

    Null and empty texts have no spans.  No shuffle; a text is lexed within one row.
    """

    def work(part):
        return {"id": part.column("id"), "spans": [in_order(all_spans(x, threshold), KINDS) for x in part.column("text").to_pylist()]}

    docs = texts(documents, id_col, text_col)
    return map_slices(docs, work, f"id {docs.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact_secrets(documents: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = 0.5) -> DataFrame:
    """The table with every span of a secret replaced by [KIND] in its text; a null text stays null.  All columns stay,
    and ``length_col``, if the table has it, holds the new length of the texts that changed."""

    def work(part):
        old = part.column(text_col).to_pylist()
        new = [None if x is None else redacted(x, [(a, b, k) for k, a, b in all_spans(x, threshold)]) for x in old]
        out = part.set_column(part.schema.get_field_index(text_col), part.schema.field(text_col), pa.array(new, part.schema.field(text_col).type))
        if length_col in part.schema.names:
            i = part.schema.get_field_index(length_col)
            sizes = [n if x == y else len(y) for x, y, n in zip(old, new, part.column(i).to_pylist(), strict=True)]
            out = out.set_column(i, part.schema.field(i), pa.array(sizes, part.schema.field(i).type))
        return out

    return map_rows(documents, work, text_col)


def query_columns(documents: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    return digest_columns(find_secrets(documents), "doc_id", BASE)


def query(spark, sf_dir: str) -> DataFrame:
    return query_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op4_secret_scan": query}
ORACLE_SQL: dict[str, str] = {}
