"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

The shingles of the universe are dealt into segments by a hash; how many depends on the band of sizes.  If two sets of a
band differ by at most H shingles, at least one of H + 1 segments is the same in both.  Each set is indexed by what it
has in each segment (E entries), and for one segment also by all it has there but one shingle (D entries, the
one-deletion neighbourhood, by which sets that differ there by one still meet).  There are some more segments than H + 1.
Linked sets so share that many entries, and sets with fewer shared ones are sieved out.  What is left over is also
allocated by cost: after the entries have been counted, a set gives up its costliest entries
(those that more than HOT sets share) where the segments that it keeps, and the deletion segment, still prove that every
partner is met.  Whether an entry is costly is the same for all sets, so a set and its partner agree on it.

Exact copies of a set are one class from the start.  In each bucket every class is a candidate with one centre (the class
with the most and largest buckets), which is linear in the entries, and is compared with it.  The Jaccard distance is a
metric, so with r the distance that a link may have
1. a class that links with the centre (near) links with no class that is further than 2 r from the centre (far);
2. of two classes that are within 2 r of one centre both differences from it are known, and one of the two differs by
   more than a link may.  Then a link between them needs more than half of the other's differences in common (see
   ``overlap``), which few pairs pass: they are found by a prefix filter with positions on the differences, rare ones first;
3. only pairs with a far class are left.  The bucket goes into another round without its near classes, and only if it has a
   far one; classes that no longer share enough entries are sieved out again.
After ROUNDS rounds the last one takes the differences of far classes as well, so that step 2 leaves nothing open.  So every
link is either verified or joins two classes that are in one component anyhow, groups of all sizes go the same way, and
the work does not grow with the square of a group of near copies.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import gram_hashes, drop, map_slices, mix, prepare, slices, texts, word_hashes, written, written_in_parts
from lodestrata.llm.components import components

#: Sets above which an entry counts as costly.
HOT = 32
#: Sets that are tried first for each set not linked with its centre.
LIKELY = 4
#: Classes that are compared with one centre in a task.
BLOCK = 256
#: Rounds in which far classes wait for another centre.  More of them leave fewer differences to the last one.
ROUNDS = 1
#: How often sets that share too few entries, and entries that then stand alone, are sieved out.
SIEVES = 2
#: Parts of the buckets, and of the centres, that are dealt one after another, so that the disk holds one part's shuffle.
PARTS = 4
#: Bits of a hash that a bucket's name leaves out.  Buckets that share a name make candidates, which are compared.
SHORT = np.uint64(16)
_SEGMENT, _VALUE, _FIRST, _SECOND = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


class Bands:
    """Size bands of a Jaccard threshold num/den: [lower, upper), the differing shingles that a link may have (H), and
    the number of segments.  A band ends at lower / threshold^1.5, so that a set and a partner of it that is larger are
    in one band or in neighbouring ones or the next but one; the larger set is indexed in all of them that can hold a
    partner, and both meet in the band of the smaller."""

    def __init__(self, num: int, den: int, largest: int = 1 << 31):
        self.num, self.den = num, den
        self.lower, self.spread, self.spare = [], [], []
        low = 1
        while low <= largest:
            high = max(low, int(low * (den / num) ** 1.5))
            h = self.differ(high, self.partner(high))
            self.lower.append(low)
            self.spread.append(h)
            self.spare.append(self.needless(low, h) if h else 0)
            low = high + 1

    def partner(self, n: int) -> int:
        """The largest size that can link with size n."""
        return n * self.den // self.num

    def differ(self, a: int, b: int) -> int:
        """How many shingles linked sets of these sizes can have that the other has not."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    @staticmethod
    def needless(low: int, h: int) -> int:
        """Segments beyond H + 1: a twentieth, and as many as the smallest sets of the band leave empty (three deviations
        above the mean), for empty segments are what most sets have in common; no more than H + 1."""
        spare = 1 + (h + 1) // 20
        for _ in range(20):
            m = h + 1 + spare
            empty = m * math.exp(-low / m)
            spare = min(h + 1, 1 + (h + 1) // 20 + math.ceil(empty + 3 * math.sqrt(empty)))
        return spare

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lower, n, side="right")) - 1

    def indexed(self, n: int) -> list[int]:
        """Bands in which a set of size n is indexed: its own and smaller ones with possible partners, where sets can
        differ at all."""
        smallest = -(-n * self.num // self.den)
        return [b for b in range(self.of(smallest), self.of(n) + 1) if self.spread[b]] if n else []


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(column, lower=True)
    grams, out = gram_hashes(words, shingle), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(grams[a : b - shingle + 1]) if n >= shingle else gram_hashes(words[a:b], n) if n else words[:0])
    return out


def entries(own: np.ndarray, bands: Bands) -> tuple[np.ndarray, int, bool]:
    """The buckets of a set (E entries are even, D entries odd); how many of its segments it could still do without; and
    whether its deletion segments can stand in for one more: with two shingles or more there, a partner that differs by
    one has an entry as well.

    Empty segments are given up where the spare ones of the band allow it, else all of them are kept, and nothing can be
    done without: a partner may have given up its own."""
    out, slack, stands_in = [], [], True
    segment_hash, value = mix(own * _SEGMENT) >> np.uint64(32), mix(own ^ _VALUE)
    for band in bands.indexed(len(own)):
        spare = bands.spare[band]
        m = bands.spread[band] + 1 + spare
        segment = (segment_hash * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        ordered, values = segment[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        full = ordered[starts]
        sums = np.zeros(m, np.uint64)
        sums[full] = np.add.reduceat(values, starts)
        tag = mix((np.arange(m, dtype=np.uint64) + np.uint64(band << 40)) * _FIRST)
        empty = m - len(full)
        slack.append(max(0, spare - empty))
        out.append(mix(sums ^ tag)[full if empty <= spare else slice(None)] >> SHORT & ~np.uint64(1))
        deleted = values[ordered == 0]
        stands_in &= len(deleted) > 1
        if len(deleted):
            left = np.concatenate([sums[:1], sums[0] - deleted if len(deleted) > 1 else deleted[:0]])
            out.append(mix(left ^ tag[0]) >> SHORT | np.uint64(1))
    return (np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)), min(slack, default=0), stands_in


def overlap(size: Column, other: Column, n: Column, other_n: Column, num: int, den: int) -> Column:
    """How many differences from a centre two linked sets must share: |x ^ y| = |dx| + |dy| - 2 |dx & dy| for their
    differences dx and dy, and a link allows (den - num) / (den + num) of the sizes' sum."""
    return F.ceil((size + other - F.floor((n + other_n) * (den - num) / (den + num))) / 2)


def index_prefix(size: int, most: int, num: int, den: int) -> int:
    """How many of a set's differences must be indexed so that each link to a set that is itself not linked with the
    centre finds one of them.  With k = (den - num) / (den + num), such a set x has |dx| > k (|x| + |c|) - 1 (rounded
    down), and |y| <= |c| + |dy|, so that |dx| + |dy| - k (|x| + |y|) > (1 - k) |dy|.  Also, all but ``most`` (what y
    and its largest partner may differ by) of y's differences are shared."""
    least = max((size * 2 * num // (den + num) + 2) // 2, size - most)
    return max(0, size - least + 1)


def linked_sets(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or small * den < num * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and den * both >= num * (small + large - both)


def verified(pairs: DataFrame, text: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by the exact sets of their texts."""
    rows = pairs.join(text.select(F.col("d").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("d").alias("b"), F.col("text").alias("text")), "b")

    def work(part):
        left_texts = part.column("text_a").dictionary_encode()  # a text is read once for all its pairs in a slice
        left = shingle_sets(left_texts.dictionary, shingle)
        right = shingle_sets(part.column("text"), shingle)
        linked = [linked_sets(left[i], y, num, den) for i, y in zip(left_texts.indices.to_pylist(), right, strict=True)]
        return part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def columns(part):
        got = work(part)
        return {k: got.column(k) for k in ("a", "b")}

    return map_slices(rows.select("a", "b", "text_a", "text"), columns, "a long, b long")


def union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def tried_members(pairs: DataFrame, text: DataFrame, shingle: int, num: int, den: int, far: bool) -> DataFrame:
    """For pairs (a, b) of a centre and a class: whether they link, or else b is far from a; b's size; the shingles that
    they differ by (without those of far classes, unless ``far``), and how many of them a prefix filter needs where b is
    looked for and where it looks.

    A centre's classes are dealt into blocks, each of which gets the centre's text, so no task holds a large group."""
    bands = Bands(num, den, 1)
    prepare(pairs.sparkSession)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("rank"), F.col("b").alias("d"))
    centres = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("rank"), F.col("a").alias("d"))
    rows = members.unionByName(centres).join(text, "d").repartition("a", "block").sortWithinPartitions("a", "block", "rank").select("a", "rank", "d", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("far", pa.bool_()), ("n", pa.int32()), ("size", pa.int32()), ("indexed", pa.int32()), ("probing", pa.int32()), ("differing", pa.list_(pa.int64()))])

    def told(a: int, d: int, c: np.ndarray, y: np.ndarray) -> tuple:
        mine, its = np.setdiff1d(y, c, assume_unique=True), np.setdiff1d(c, y, assume_unique=True)
        size, both = len(mine) + len(its), len(y) - len(mine)
        union = len(c) + len(mine)
        linked = both > 0 and den * both >= num * union
        apart = den * both < (2 * num - den) * union
        if apart and not far:
            return a, d, linked, apart, len(y), size, 0, 0, None
        most = bands.differ(len(y), bands.partner(len(y)))
        indexed = min(size, index_prefix(size, most, num, den))
        return a, d, linked, apart, len(y), size, indexed, 0 if linked else min(size, most + 1), np.concatenate([mine, its]).astype(np.int64)

    def run(batches):
        centre = None
        for batch in batches:
            for part in slices(batch):
                out = []
                for a, rank, d, found in zip(*[part.column(k).to_pylist() for k in ("a", "rank", "d")], shingle_sets(part.column("text"), shingle), strict=True):
                    if rank:
                        out.append(told(a, d, centre, found))
                    else:
                        centre = found
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "a long, b long, linked boolean, far boolean, n int, size int, indexed int, probing int, differing array<long>")


def unsettled(stars: list[DataFrame], reach: DataFrame, traits: DataFrame) -> DataFrame:
    """Pairs (a, b) of a centre and a class that may link with another class of the centre.  Two classes of which one is
    the centre of a bucket that they share have been compared, so two that link and are in different components share
    their more than spare buckets as members, and none of these holds one component only.  Nor does their centre."""
    met = union([x.filter("a <> d").select(F.lit(k).alias("round"), "bucket", "a", "d") for k, x in enumerate(stars)])
    members = met.join(reach, F.col("d") == F.col("node"), "left").withColumn("component", F.coalesce("component", "d"))
    mixed = members.groupBy("round", "bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("round", "bucket")
    left = written(members.select("round", "bucket", "a", "d", "component").join(mixed, ["round", "bucket"], "left_semi"), "unsettled")
    for _ in range(SIEVES):
        before, left = left, written(sieved(left, traits, "round"), "unsettled")
        drop(before)
    pairs = left.select("a", F.col("d").alias("b"), "component").distinct()
    mixed = pairs.groupBy("a").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("a")
    out = written(pairs.join(mixed, "a", "left_semi").select("a", "b"), "wanted")
    drop(left)
    return out


def prefixes(tried: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the wanted pairs, the differences (a, shingle, at, b, ...) that classes without a link to their centre look for
    (sought), and those by which all are found, in the order of how many classes of the centre have them: what the centre
    alone has or lacks comes last in all of them."""
    single = tried.join(wanted, ["a", "b"], "left_semi").select("a", "b", F.explode("differing").alias("shingle"))
    often = single.groupBy("a", "shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("a", "b").orderBy("often", "shingle")
    placed = single.join(often, ["a", "shingle"]).withColumn("at", F.row_number().over(order) - 1)
    each = placed.join(tried.select("a", "b", "linked", "n", "size", "indexed", "probing"), ["a", "b"])
    return each.select("a", "shingle", "at", "b", "linked", "n", "size", (F.col("at") < F.col("probing")).alias("sought"), (F.col("at") < F.col("indexed")).alias("found")).filter("sought or found")


def both_sides(each: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is looked for, and what is found, with the components of the classes."""
    named = each.join(reach, F.col("b") == F.col("node"), "left").withColumn("component", F.coalesce("component", "b"))
    return named.filter("sought"), named.filter("found")


def likely_pairs(seeking: DataFrame, found: DataFrame) -> DataFrame:
    """For each set that is not linked with its centre, the LIKELY sets that most of its differences name, where each
    difference names two sets that have it.  What this leaves out, possible_pairs finds."""
    key = F.struct(F.xxhash64("b").alias("h"), F.col("b"), F.col("component"))
    named = found.groupBy("a", "shingle").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    x = seeking.select("a", "shingle", F.col("b").alias("x"), F.col("component").alias("c"))
    y = named.select("a", "shingle", F.explode(F.array_distinct(F.array("first", "last"))).alias("y"))
    met = x.join(y, ["a", "shingle"]).filter(F.col("c") != F.col("y.component")).groupBy("x", F.col("y.b").alias("y")).agg(F.count("*").alias("met"))
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("met"), "y"))).filter(F.col("rank") <= LIKELY)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def possible_pairs(seeking: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of sets in different components that may link, by a prefix filter with positions."""
    x, y = seeking.alias("x"), found.alias("y")
    col = F.col
    meet = (
        (col("x.a") == col("y.a")) & (col("x.shingle") == col("y.shingle")) & (col("x.component") != col("y.component")) & (col("y.linked") | (col("x.b") < col("y.b")))
        & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
        & (F.least(col("x.size") - col("x.at"), col("y.size") - col("y.at")) >= overlap(col("x.size"), col("y.size"), col("x.n"), col("y.n"), num, den))
    )
    return x.join(y, meet).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def hung(reach: DataFrame) -> DataFrame:
    """Known components as links of each class to its component's smallest one."""
    return reach.select(F.col("node").alias("a"), F.col("component").alias("b"))


def sieved(entries: DataFrame, traits: DataFrame, *of: str) -> DataFrame:
    """The entries without those of sets that share too few: linked sets differ in H of a band's segments at most, so they
    share more than are spare.  Entries that then stand alone go as well."""
    enough = entries.groupBy(*of, "d").agg(F.count_if(F.pmod("bucket", F.lit(2)) == 0).alias("met")).join(traits, "d").filter("met > slack").select(*of, "d")
    left = entries.drop("size").join(enough, [*of, "d"], "left_semi")
    return left.join(left.groupBy(*of, "bucket").agg(F.count("*").alias("size")).filter("size > 1"), [*of, "bucket"])


def near_components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach, itself included) of every document.

    Words are lower-cased (A-Z) and split at ASCII white space; a set holds distinct runs of ``shingle`` words, or the
    whole of a shorter text.  Texts without words have no set and link with nothing.  Ids are distinct
    integers; rows that repeat an id with the same text are copies, with other texts the id has the links of its smallest
    text; a null id has a null component.
    """
    bands = Bands(num, den)
    docs = texts(documents, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    dealt = [f"entries_{k}" for k in range(PARTS)]

    def sets(part):
        out: dict[str, list] = {k: [] for k in ("n", "s1", "s2", "slack", "stands_in", *dealt)}
        for own in shingle_sets(part.column("text"), shingle):
            out["n"].append(len(own))
            out["s1"].append(int(mix(own * _FIRST).sum(dtype=np.uint64).astype(np.int64)))
            out["s2"].append(int(mix(own ^ _SECOND).sum(dtype=np.uint64).astype(np.int64)))
            found, slack, stands_in = entries(own, bands)
            part_of = found >> 1 & PARTS - 1
            for k, name in enumerate(dealt):
                out[name].append(found[part_of == k])
            out["slack"].append(slack)
            out["stands_in"].append(stands_in)
        return {"id": part.column("id")} | out

    indexed = written(map_slices(docs, sets, f"id long, n int, s1 long, s2 long, slack int, stands_in boolean, {', '.join(f'{x} array<long>' for x in dealt)}"), "indexed")
    own = written(indexed.select("id", "n", "s1", "s2"), "sets")
    classes = own.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("d"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    # copies have the entries of their class, which its first document keeps
    later = own.select("id", "s1", "s2", "n").join(classes.filter("copies > 1"), ["s1", "s2", "n"]).filter("id > d").select(F.col("id").alias("d"))
    later = written(later, "later")

    def shared_entries() -> Iterator[DataFrame]:
        for name in dealt:
            found = indexed.filter("id is not null").select(F.col("id").alias("d"), F.explode(name).alias("bucket"))
            counts = written(found.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "counts")
            yield found.join(counts, "bucket").join(later, "d", "left_anti")
            drop(counts)

    shared = written_in_parts(shared_entries(), "entries")
    even = F.pmod("bucket", F.lit(2)) == 0
    traits = indexed.filter("id is not null and (" + " or ".join(f"size({x}) > 0" for x in dealt) + ")").select(F.col("id").alias("d"), "slack", "stands_in")
    traits = written(traits.groupBy("d").agg(F.min("slack").alias("slack"), F.min("stands_in").alias("stands_in")), "traits")
    drop(indexed, later)
    for _ in range(SIEVES):
        before, shared = shared, written(sieved(shared, traits), "entries")
        drop(before)

    # what a set may give up, and how central it is
    hot = F.col("size") > HOT
    worth = shared.groupBy("d").agg(F.sum("size").alias("weight"), F.count_if(hot & even).alias("costly"), F.count_if(hot & ~even).alias("costly_d")).join(traits, "d")
    worth = worth.withColumn("gives", F.col("costly") <= F.col("slack") + ((F.col("costly_d") == 0) & F.col("stands_in")).cast("int")).select("d", "weight", "gives")
    kept = written(shared.join(worth, "d").filter(~(hot & F.col("gives"))).select("bucket", "d", "weight"), "entries")

    drop(shared)
    named = kept.select("d").distinct()
    text = written(docs.join(named, docs["id"] == named["d"], "left_semi").groupBy("id").agg(F.min("text").alias("text")).select(F.col("id").alias("d"), "text"), "texts")

    rounds, stars = [], []
    for k in range(ROUNDS + 1):
        if k and kept.isEmpty():
            drop(kept)
            break
        centre = kept.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("d")).alias("d"))).alias("c")).select("bucket", (-F.col("c.d")).alias("a"))
        met = written(kept.join(centre, "bucket").select("bucket", "a", "d", "weight"), "met")
        drop(kept)
        stars.append(met)
        pairs = met.filter("a <> d").select("a", F.col("d").alias("b")).distinct()
        if rounds:
            pairs = pairs.join(union(rounds).filter("differing is not null").select("a", "b"), ["a", "b"], "left_anti")
        rounds.append(written(tried_members(pairs, text, shingle, num, den, far=k == ROUNDS), "tried"))
        if k == ROUNDS:
            break
        waiting = union(rounds).filter("not linked").select("a", F.col("b").alias("d"), "far").distinct()
        open_ = met.join(waiting, ["a", "d"]).withColumn("some", F.max("far").over(Window.partitionBy("bucket"))).filter("some").select("bucket", "d", "weight")
        kept = written(sieved(open_, traits), "entries")
    tried = union(rounds).filter("differing is not null")  # no pair twice
    links = tried.filter("linked").select("a", "b")
    reach = components(links)
    reaches = [reach]

    # sets that met one centre and are in different components: one link each is enough, so likely ones come first
    wanted = unsettled(stars, reach, traits)
    part = F.pmod(F.xxhash64("a"), F.lit(PARTS))
    each = written_in_parts((prefixes(tried.filter(part == k), wanted.filter(part == k)) for k in range(PARTS)), "prefixes")
    likely = written(verified(likely_pairs(*both_sides(each, reach)), text, shingle, num, den), "links")
    if not likely.isEmpty():
        reach = components(hung(reach).unionByName(likely))
        reaches.append(reach)
    more = written(verified(possible_pairs(*both_sides(each, reach), num, den), text, shingle, num, den), "links")
    if not more.isEmpty():
        reach = components(hung(reach).unionByName(more))
        reaches.append(reach)
    named = classes.select("s1", "s2", "n", "d", "copies").join(reach, F.col("d") == F.col("node"), "left").filter("copies > 1 or component is not null").select("s1", "s2", "n", F.coalesce("component", "d").alias("component"))
    joined = own.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    out = written(joined.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id")), "components")
    drop(own, classes, traits, text, wanted, each, likely, more, *rounds, *stars, *reaches)
    return out


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that a component's smallest id stands for; rows of a null id stay.  Only the ids that
    go are joined with the documents."""
    gone = near_components(documents, id_col=id_col, text_col=text_col, shingle=shingle, num=num, den=den).filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return documents.join(gone, id_col, "left_anti").select(documents.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op2_ngram_join": query}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 90 * (x.n + y.n - p.i)),
t AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT u, u AS c FROM t UNION SELECT t.v, r.c FROM r JOIN t ON t.u = r.u)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce((SELECT min(r.c) FROM r WHERE r.u = n.doc_id), n.doc_id) AS component_id FROM n""",
}
