"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by single spaces; every window of ``window`` consecutive words of an item
(or the whole of a shorter item) becomes a pattern of one automaton, which scans every normalised document once.  A
document word inside any occurrence is hit.  Where spans are asked for, word numbers are mapped back to code points of
the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import filter_texts, map_slices, prepare, texts

#: Bytes of benchmark text that one automaton may hold; a larger benchmark is scanned for in several passes.
BLOCK_BYTES = 8 << 20

#: Bytes: A-Z to lower case, further ASCII but digits and a-z to space, the rest as it is.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words in the original text, where A-Z still stand.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    """Words of the text, A-Z in lower case, as UTF-8."""
    return text.encode().translate(_NORMAL).split()


def windows(text: str | None, window: int) -> list[bytes]:
    """The patterns of an item: its words between single spaces, a window at a time."""
    own = words(text or "")
    return [b" " + b" ".join(own[i : i + window]) + b" " for i in range(max(1, len(own) - window + 1))] if own else []


class Scanner:
    """The automaton over the windows of items given as (number, text)."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        owners: dict[bytes, set[int]] = {}
        for number, text in items:
            for w in windows(text, window):
                owners.setdefault(w, set()).add(number)
        self.found = ahocorasick.Automaton()
        for w, own in owners.items():
            self.found.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(own)))
        self.any = bool(owners)
        if self.any:
            self.found.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[int]]:
        """How many words the text has, the runs of hit words (first, end exclusive), and the numbers of the items."""
        own = words(text)
        if not own or not self.any:
            return len(own), [], []
        line = b" " + b" ".join(own) + b" "
        hits = list(self.found.iter(line.decode("latin-1")))
        if not hits:
            return len(own), [], []
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _ in hits]) - 1
        runs: list[list[int]] = []
        for end, n in sorted(((int(e) + 1, n) for e, (_, (_, n, _)) in zip(last, hits, strict=True)), key=lambda x: (x[0] - x[1], x[0])):
            if runs and end - n <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([end - n, end])
        return len(own), [(a, b) for a, b in runs], sorted({i for _, (_, _, own_items) in hits for i in own_items})


def code_points(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of word numbers as spans of the original text."""
    if not runs:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in runs]


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[list[str], list[list[tuple[int, str]]]]:
    """Item ids as strings, and the items with words as (place in the ids, text) in blocks of at most BLOCK_BYTES.
    Items are read a partition at a time, so the driver holds the benchmark but once."""
    ids: list[str] = []
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("i is not null and t is not null").toLocalIterator():
        if size + len(row["t"].encode()) > BLOCK_BYTES and blocks[-1]:
            blocks, size = [*blocks, []], 0
        size += len(row["t"].encode())
        blocks[-1].append((len(ids), row["t"]))
        ids.append(row["i"])
    return ids, blocks


def scanner(benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> tuple[int, Callable]:
    """How many blocks the benchmark has, and a function from texts to (n_words, hit runs, sorted item ids) of each, for
    use on executors; a worker keeps one block's automaton at a time."""
    spark = prepare(benchmark.sparkSession)
    ids, blocks = benchmark_items(benchmark, item_col, item_text_col)
    shared = [spark.sparkContext.broadcast((ids[b[0][0] : b[-1][0] + 1] if b else [], b)) for b in blocks]
    ready: dict = {}

    def scan(found: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        n, runs, items = [0] * len(found), [[] for _ in found], [set() for _ in found]
        for k, block in enumerate(shared):
            if ready.get("k") != k:
                names, own = block.value
                ready.clear()
                ready.update(k=k, scanner=Scanner(own, window), names=names, first=own[0][0] if own else 0)
            for i, text in enumerate(found):
                n[i], more, numbers = ready["scanner"].scan(text)
                runs[i] += more
                items[i].update(ready["names"][x - ready["first"]] for x in numbers)
        return [(a, merged(b), sorted(c)) for a, b, c in zip(n, runs, items, strict=True)]

    return len(blocks), scan


def slice_bytes(n_blocks: int) -> int:
    """Several blocks are built anew for each slice, so slices are larger then."""
    return 1 << 20 if n_blocks == 1 else 16 << 20


def n_hit(runs: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in runs)


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """The rows that are not contaminated (see CONTAMINATED), with all their columns."""
    _, scan = scanner(benchmark, item_col, item_text_col, window)
    return filter_texts(documents, lambda found: [not (n_hit(runs) and 20 * n_hit(runs) >= n) for n, runs, _ in scan(found)], text_col)


def find_benchmark(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, spans: bool = True) -> DataFrame:
    """id, n_words, n_hit, items (sorted as strings), items_sha256 (of them joined by commas) and, if asked for, spans
    (start, end of hit runs in code points) of every document.

    Null and empty texts, and documents against an empty benchmark, have no hits.  An item id on several rows counts once.
    The automaton's items are broadcast in blocks of at most BLOCK_BYTES; runs of several blocks are joined per row, so
    memory does not grow with the benchmark (a pass over the documents does for each block, in the same task).
    """
    n_blocks, scan = scanner(benchmark, item_col, item_text_col, window)

    def work(part):
        old = part.column("text").to_pylist()
        found = scan(old)
        out = {"id": part.column("id"), "n_words": [n for n, _, _ in found], "n_hit": [n_hit(runs) for _, runs, _ in found], "items": [x for _, _, x in found], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in found]}
        if spans:
            out["spans"] = [[{"start": a, "end": b} for a, b in code_points(t, runs)] for t, (_, runs, _) in zip(old, found, strict=True)]
        return out

    docs = texts(documents, id_col, text_col)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, items_sha256 string" + ", spans array<struct<start:int,end:int>>" * spans
    return map_slices(docs, work, schema, size=slice_bytes(n_blocks)).withColumnRenamed("id", id_col)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


#: The rule by which a document counts as contaminated.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def query(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spans=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", F.expr(CONTAMINATED).alias("contaminated"))


QUERIES: dict[str, Callable] = {"op3_decontamination": query}
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(ws), 13) AS size, unnest(list_transform(range(1, greatest(1, len(ws) - 12) + 1), lambda k: array_to_string(ws[k:k + 12], ' '))) AS line FROM b WHERE len(ws) > 0),
q AS (SELECT DISTINCT size FROM i),
o AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d CROSS JOIN q WHERE len(ws) >= size),
h AS (SELECT o.doc_id, o.k, o.size, i.item_id FROM (SELECT doc_id, k, size, array_to_string(ws[k:k + size - 1], ' ') AS line FROM o) o JOIN i ON i.size = o.size AND i.line = o.line),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
}
