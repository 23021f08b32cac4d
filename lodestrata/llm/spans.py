"""Spans as columns: how kind:start:end lists become counts, digests and redacted texts."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def digest_columns(found: DataFrame, id_col: str, base: list[str], *more: Column) -> DataFrame:
    """id, n_<kind> of every base kind, base_sha256, spans and further columns."""
    return found.select(
        id_col,
        *(F.size(of_kinds(F.col("spans"), [k])).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of_kinds(F.col("spans"), base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *more,
    )


def in_order(spans: list[tuple[str, int, int]], kinds: list[str]) -> list[dict]:
    rank = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))]


class Covered:
    """Stretches that spans cover, for tests by binary search."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((a, b) for _, a, b in spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def outside(self, start: int, end: int) -> bool:
        """Whether [start, end) overlaps none of the spans."""
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, given as start, end and name, replaced by [NAME]; overlapping spans count as one."""
    out, at = [], 0
    for start, end, name in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{name.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
