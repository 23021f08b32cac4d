"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus.

1. Which suffixes need sorting.  In every window of ``length`` bytes the gram of GRAM bytes with the smallest hash is its
   anchor (the leftmost of equals), so equal windows have equal anchors at equal places.  Neighbouring windows mostly share
   one; a run of windows with one anchor is a context.  Anchors whose gram stands but once in the corpus are dropped, and
   contexts that are equal as a whole are settled by their first occurrence.
2. The suffix sort.  What is left are different contexts around one gram, each once, as pieces of a few hundred bytes.
   Their suffixes from the anchor on are sorted by mergesort.  Two suffixes are compared by binary search for their
   longest common extension on prefix polynomial hashes, so by a logarithmic number of steps, for all pairs of a merge at
   once.  Common extensions of neighbours are then verified byte by byte; if a hash had lied, that block is sorted anew
   by its bytes.  Windows are the same where the suffixes' common extension reaches their end and the bytes before the
   anchor (by hash, verified) are the same.
3. Grams with very many contexts are sorted in blocks; what each block finds first is compared between blocks by the
   windows' hashes, aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import map_slices, mix, powers, prefix_hashes, raw, span_hashes, texts, written

GRAM = 32
#: Contexts of one gram that are sorted together; more are dealt into blocks.
BLOCK = 1024
#: Contexts that a task sorts at once (groups are never split).
CHUNK = 4_096
#: Bytes of text whose positions are hashed at once; each takes about 100 bytes of a worker's memory meanwhile.
SLICE = 1 << 18
_ORDER, _NAME, _CONTEXT = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F))
_OTHER = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def other_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix hashes with other values for bytes, independent of prefix_hashes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OTHER[data] * powers(len(data)), out=out[1:])
    return out


def contexts(at: np.ndarray, data: np.ndarray, length: int, anchors_only: bool = False) -> dict[str, np.ndarray]:
    """For texts data[at[i]:at[i+1]]: text number, anchor hash, context hash, first and last window start (in the text)
    and place of the anchor, of every context; or just the anchor hashes."""
    n, grams = len(data), length - GRAM + 1
    empty = {k: np.zeros(0, np.int64) for k in ("text", "anchor", "context", "first", "last", "place")}
    if n < length:
        return empty
    one = prefix_hashes(data)
    starts = np.arange(n - GRAM + 1)
    gram = span_hashes(one, starts, starts + GRAM)
    bits = np.uint64(int(n).bit_length())
    key = (mix(gram ^ _ORDER) >> bits << bits) | starts.astype(np.uint64)
    width, least = 1, key
    while 2 * width <= grams:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: n - length + 1], least[grams - width : grams - width + n - length + 1])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: n - length + 1]
    valid = np.flatnonzero(np.arange(n - length + 1) + length <= at[1:][owner])
    if not len(valid):
        return empty
    p, own = place[valid], owner[valid]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (own[1:] != own[:-1])])
    begin = np.flatnonzero(new)
    a, b = valid[begin], valid[np.concatenate([begin[1:], [len(valid)]]) - 1]
    p, own = p[begin], own[begin]
    if anchors_only:
        return {"anchor": mix(gram[p] * _NAME).astype(np.int64)}
    shape = ((p - a) * 65536 + (b - a)).astype(np.uint64)
    context = mix(span_hashes(one, a, b + length) ^ mix(shape * _CONTEXT))
    return {"text": own, "anchor": mix(gram[p] * _NAME).astype(np.int64), "context": context.astype(np.int64), "first": a - at[own], "last": b - at[own], "place": p - at[own]}


# -------------------------------------------------------------------------------------------------- the suffix sort


class Suffixes:
    """Suffixes data[start:end] that belong to groups; all comparisons take arrays of suffix numbers."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.data, self.start, self.end, self.group = data, start, end, group
        self.prefix = prefix_hashes(data)
        self.inverse = powers(len(data) + 1, True)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j, by binary search on hashes; the longest possible
        extension is tried first, as most suffixes of one group agree to their end or part soon."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.end[i] - a, self.end[j] - b)
        middle, at = high, np.arange(len(i))
        while at.size:
            p, q, m = a[at], b[at], middle[at]
            same = (self.prefix[p + m] - self.prefix[p]) * self.inverse[p] == (self.prefix[q + m] - self.prefix[q]) * self.inverse[q]
            low[at], high[at] = np.where(same, m, low[at]), np.where(same, high[at], m - 1)
            at = at[low[at] < high[at]]
            middle = (low + high + 1) // 2
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j: by group, then bytes, then number.  Only suffixes of one group are compared."""
        out = self.group[i] < self.group[j]
        close = np.flatnonzero(self.group[i] == self.group[j])
        if not close.size:
            return out
        i, j = i[close], j[close]
        common = self.extension(i, j)
        a, b = self.start[i] + common, self.start[j] + common
        last = len(self.data) - 1
        byte_a = np.where(a >= self.end[i], -1, self.data[np.minimum(a, last)].astype(np.int64))
        byte_b = np.where(b >= self.end[j], -1, self.data[np.minimum(b, last)].astype(np.int64))
        out[close] = np.where(byte_a == byte_b, i < j, byte_a < byte_b)
        return out

    def sorted(self) -> np.ndarray:
        """Suffix numbers in order, by bottom-up mergesort.  Groups come in order, so of the two runs of a merge only the
        group that spans both has to be merged; its elements find their places in the other run by binary search, those
        of all merges at once."""
        n = len(self.start)
        order, run = np.argsort(self.group, kind="stable"), 1
        while run < n:
            place = np.arange(n)
            block = place // (2 * run) * (2 * run)
            middle = block + run
            groups = self.group[order]
            spans = (middle < n) & (groups[np.minimum(middle, n - 1)] == groups[np.minimum(middle, n - 1) - 1])
            live = np.flatnonzero(spans & (groups == groups[np.minimum(middle, n - 1)]))
            if live.size:
                at, mid = place[live], middle[live]
                own = at < mid
                low = np.where(own, mid, block[live])
                high = np.where(own, np.minimum(mid + run, n), mid)
                first = low.copy()
                open_ = np.arange(len(live))
                while open_.size:
                    half = (low[open_] + high[open_]) // 2
                    less = self.before(order[half], order[at[open_]])
                    low[open_], high[open_] = np.where(less, half + 1, low[open_]), np.where(less, high[open_], half)
                    open_ = open_[low[open_] < high[open_]]
                merged = order.copy()
                merged[np.where(own, at + (low - first), at - run + (low - first))] = order[at]
                order = merged
            run *= 2
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common extension of each suffix in order with the one before it (-1 across groups)."""
        out = np.full(len(order), -1, np.int64)
        if len(order) > 1:
            same = self.group[order[1:]] == self.group[order[:-1]]
            out[1:] = np.where(same, self.extension(order[1:], order[:-1]), -1)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
        """Whether data[a:a+size] is data[b:b+size] byte by byte, for all triples."""
        for at in range(0, len(a), 4096):
            s = size[at : at + 4096]
            total = int(s.sum())
            if total:
                inner = np.arange(total) - np.repeat(np.cumsum(s) - s, s)
                if (self.data[np.repeat(a[at : at + 4096], s) + inner] != self.data[np.repeat(b[at : at + 4096], s) + inner]).any():
                    return False
        return True

    def sorted_by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Order and common extensions without hashes, for the case that a hash has lied."""
        whole = self.data.tobytes()
        keys = [(g, whole[a:b], i) for i, (g, a, b) in enumerate(zip(self.group.tolist(), self.start.tolist(), self.end.tolist(), strict=True))]
        keys.sort()
        common = [-1] * len(keys)
        for i in range(1, len(keys)):
            if keys[i][0] == keys[i - 1][0]:
                x, y = keys[i][1], keys[i - 1][1]
                k, most = 0, min(len(x), len(y))
                while k < most and x[k] == y[k]:
                    k += 1
                common[i] = k
        return np.array([k[2] for k in keys], np.int64), np.array(common, np.int64)


def same_windows(data: np.ndarray, bounds: np.ndarray, offset: np.ndarray, group: np.ndarray, ident: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts data[bounds[i]:bounds[i+1]] with the anchor at ``offset``, in groups, that start at ``begin`` of text
    ``ident``: every window as (context, start within it, whether an equal window of its group starts earlier)."""
    size = np.diff(bounds)
    anchor = bounds[:-1] + offset
    suffixes = Suffixes(data, anchor, bounds[1:], group)
    order = suffixes.sorted()
    common = suffixes.neighbours(order)
    linked = np.flatnonzero(common > 0)
    checked = suffixes.equal(anchor[order[linked]], anchor[order[linked - 1]], common[linked])
    if not checked or (common[1:][group[order[1:]] == group[order[:-1]]] < GRAM).any():
        order, common = suffixes.sorted_by_bytes()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ahead = int(offset.max(initial=0))
    for back in range(ahead + 1):  # windows that start this far before the anchor
        has = (offset[order] >= back) & (size[order] - offset[order] >= length - back)
        if not has.any():
            continue
        run = np.cumsum(common < length - back)  # suffixes of one run agree to the window's end
        i, r = order[has], run[has]
        left = span_hashes(suffixes.prefix, anchor[i] - back, anchor[i])
        start = begin[i] + offset[i] - back
        rank = np.lexsort((start, ident[i], left, r))
        i, r, left, start = i[rank], r[rank], left[rank], start[rank]
        later = np.concatenate([[False], (r[1:] == r[:-1]) & (left[1:] == left[:-1])])
        at = np.flatnonzero(later)
        if not suffixes.equal(anchor[i[at]] - back, anchor[i[at - 1]] - back, np.full(len(at), back)):
            before = [bytes(data[x - back : x]) for x in anchor[i].tolist()]
            rank = np.array(sorted(range(len(i)), key=lambda k: (r[k], before[k], ident[i[k]], start[k])))
            i, r, start, before = i[rank], r[rank], start[rank], [before[k] for k in rank]
            later = np.array([k > 0 and r[k] == r[k - 1] and before[k] == before[k - 1] for k in range(len(i))])
        # the same place of the same text is no earlier occurrence
        head = np.flatnonzero(~later)[np.cumsum(~later) - 1]
        later &= (ident[i] != ident[i[head]]) | (start != start[head])
        found.append((i, offset[i] - back, later))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(ident: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (text, start) as runs (text, start, end) of covered bytes."""
    if not len(ident):
        return ident, start, start
    rank = np.lexsort((start, ident))
    ident, start = ident[rank], start[rank]
    new = np.concatenate([[True], (ident[1:] != ident[:-1]) | (start[1:] > start[:-1] + 1)])
    first = np.flatnonzero(new)
    return ident[first], start[first], start[np.concatenate([first[1:], [len(start)]]) - 1] + length


def sort_blocks(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows in order of (anchor, salt): runs that go, and of grams in several blocks the windows found first."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("anchor", pa.int64()), ("window", pa.int64())])

    def settle(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        column = lambda k: part.column(k).to_numpy()
        pieces = part.column("piece").combine_chunks()
        bounds, data = raw(pieces if isinstance(pieces, pa.Array) else pieces.chunk(0))
        ident, begin, offset, anchor, split = (column(k) for k in ("id", "first", "offset", "anchor", "split"))
        salt = column("salt")
        group = np.cumsum(np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]))
        i, s, later = same_windows(data, bounds, offset, group, ident, begin, length)
        ids, starts, ends = runs_of(ident[i[later]], begin[i[later]] + s[later], length)
        rest = ~later & split[i]
        i, s = i[rest], s[rest]
        at = bounds[:-1][i] + s
        window = mix(span_hashes(other_prefix(data), at, at + length)).astype(np.int64)
        whole = lambda a, b: pa.array(np.concatenate([a, b]), pa.int64())
        names = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(anchor[i], pa.int64())])
        windows = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(window, pa.int64())])
        return pa.RecordBatch.from_arrays([whole(ids, ident[i]), whole(starts, begin[i] + s), whole(ends, begin[i] + s + length), names, windows], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                table = pa.Table.from_batches(held)
                anchor, salt = table.column("anchor").to_numpy(), table.column("salt").to_numpy()
                new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
                if len(new):
                    yield settle(table.slice(0, int(new[-1])))
                    held = table.slice(int(new[-1])).to_batches()
                    rows = sum(b.num_rows for b in held)
        if rows:
            yield settle(pa.Table.from_batches(held))

    return run


# ------------------------------------------------------------------------------------------------------ the operator


def removed_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> tuple[DataFrame, DataFrame]:
    """(id, text) of all rows, and (id, start, end) of the runs of bytes that go (they may overlap)."""
    docs = texts(documents, id_col, text_col).withColumn("id", F.col("id").cast("long"))

    def anchors(part):
        found = contexts(*raw(part.column("text")), length)
        own = part.column("id").to_numpy(zero_copy_only=False)[found.pop("text")] if part.num_rows else np.zeros(0, np.int64)
        return found | {"id": own.astype(np.int64)}

    known = docs.filter("id is not null")
    names = map_slices(known, lambda part: {"anchor": contexts(*raw(part.column("text")), length, anchors_only=True)["anchor"]}, "anchor long", size=SLICE)
    rows = map_slices(known, anchors, "anchor long, context long, id long, first int, last int, place int", size=SLICE)
    # written, so that both sides of the join are plain exchanges and AQE can split an anchor that very many texts have
    again = written(names.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    repeated = written(rows.join(again, "anchor"), "anchors")
    # contexts that are equal as a whole: all but the first go
    place = F.struct("id", "first")
    whole = written(repeated.groupBy("anchor", "context").agg(F.min(F.struct("id", "first", "last", "place")).alias("f"), F.count("*").alias("n")), "contexts")
    copies = repeated.join(whole.filter("n > 1").select("anchor", "context", "f"), ["anchor", "context"])
    copies = copies.filter(place != F.struct("f.id", "f.first")).select("id", F.col("first").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("end"))
    # different contexts of one gram: the first of each is sorted
    groups = whole.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    blocks = F.ceil(F.col("kinds") / BLOCK).cast("int")
    mixed = whole.join(groups, "anchor").select("f.id", "f.first", "f.last", "f.place", "anchor", F.pmod(F.hash("context"), blocks).alias("salt"), (blocks > 1).alias("split"))
    asked = mixed.groupBy("id").agg(F.collect_list(F.struct("first", "last", "place", "anchor", "salt", "split")).alias("asked"))

    def cut_out(part):
        out: dict[str, list] = {k: [] for k in ("anchor", "salt", "split", "id", "first", "offset", "piece")}
        for i, text, wanted in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("asked").to_pylist(), strict=True):
            data = text.encode()
            for x in wanted:
                for k, v in (("anchor", x["anchor"]), ("salt", x["salt"]), ("split", x["split"]), ("id", i), ("first", x["first"]), ("offset", x["place"] - x["first"]), ("piece", data[x["first"] : x["last"] + length])):
                    out[k].append(v)
        return out

    pieces = map_slices(docs.join(asked, "id"), cut_out, "anchor long, salt int, split boolean, id long, first long, offset long, piece binary", size=SLICE)
    settled = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(sort_blocks(length), "id long, start long, end long, anchor long, window long")
    settled = written(settled, "windows")
    between = settled.filter("anchor is not null")
    first = between.groupBy("anchor", "window").agg(F.min(F.struct("id", "start")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("anchor", "window", "f")
    between = between.join(first, ["anchor", "window"]).filter(F.struct("id", "start") != F.col("f")).select("id", "start", "end")
    return docs, copies.unionByName(settled.filter("anchor is null").select("id", "start", "end")).unionByName(between)


def drop_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, texts_too: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, spans (start, end; maximal runs of removed bytes), kept_sha256 and, if asked for, ``kept``
    (the bytes that stay) of every document.

    Ids are distinct integers; earlier means a smaller id, or an earlier start in the same text.  Rows that repeat an id
    are no earlier than each other.  Rows of a null id take no part and lose nothing; null texts are empty.
    """
    docs, spans = removed_spans(documents, id_col=id_col, text_col=text_col, length=length)
    per_text = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def apply(part):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept_sha256", "kept")}
        for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
            data, runs = text.encode(), []
            for g in sorted((g["start"], g["end"]) for g in gone or ()):
                if runs and g[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], g[1])
                else:
                    runs.append([*g])
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            for k, v in (("n_bytes", len(data)), ("n_removed", len(data) - len(left)), ("spans", [{"start": a, "end": b} for a, b in runs]), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left)):
                out[k].append(v)
        return {"id": part.column("id")} | out

    schema = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * texts_too
    return map_slices(docs.join(per_text, "id", "left"), apply, schema, size=SLICE).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts_too=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Callable] = {"op5_suffix_dedup": query}
ORACLE_SQL: dict[str, str] = {
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
b AS (SELECT doc_id, s, CASE WHEN s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) + 100 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM b),
x AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS z FROM g GROUP BY doc_id, run),
k AS (SELECT d.doc_id, coalesce(lag(x.z) OVER (PARTITION BY d.doc_id ORDER BY x.a), 0) AS a, x.a AS z FROM d JOIN x ON x.doc_id = d.doc_id UNION ALL SELECT d.doc_id, coalesce(max(x.z), 0), len(any_value(d.h)) // 2 FROM d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id),
o AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * k.a + 1, 2 * (k.z - k.a)), '' ORDER BY k.a, k.z) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(sum(x.z - x.a), 0) AS BIGINT) AS n_removed, count(x.a) AS n_spans, sha256(unhex(any_value(o.kept))) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id, d.h""",
}
