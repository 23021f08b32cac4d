"""Toxicity: a counterfactually regularised classifier.

A logistic regression over the presence of words and word prefixes.  Sentences of the labelled texts that name a group of
people give counterfactual pairs: the same sentence with another group's name.  The loss has a penalty on the squared
change of the sentence's score within such a pair, so a group's name as such can move no score, however it is spread over
the labels, and neutral mentions are no false positives.

Learning takes a bounded sample of labelled rows (``sample_rows``, in the order of a hash of the id); near copies in the
sample, which share their smallest hash of five words, count once, or the words of a much copied text would look telling.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import filter_texts, gram_hashes, map_slices, texts, word_hashes, written

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5, 6)

#: Names of groups of people, by families within which they are swapped.
IDENTITY = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    ["man", "woman"], ["men", "women"], ["male", "female"], ["boy", "girl"], ["boys", "girls"],
    ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer", "transgender", "trans"],
    ["black", "white", "asian", "latino", "hispanic", "african", "european", "american", "mexican", "chinese", "indian", "arab", "russian", "german", "french", "spanish"],
    ["blacks", "whites", "asians", "latinos", "africans", "europeans", "americans", "mexicans", "indians", "arabs", "russians", "germans"],
    ["old", "young"], ["elderly", "teenage"], ["blind", "deaf", "disabled", "paralyzed"], ["immigrant", "refugee", "foreigner", "native"], ["immigrants", "refugees", "foreigners", "natives"],
    ["hombre", "mujer"], ["hombres", "mujeres"], ["cristiano", "musulmán", "judío"], ["mann", "frau"], ["männer", "frauen"], ["christ", "moslem", "jude"],
    ["homme", "femme"], ["hommes", "femmes"], ["chrétien", "musulman", "juif"],
]
_FAMILY = {t: tuple(x for x in family if x != t) for family in IDENTITY for t in family}

_NAMED = re.compile("|".join(sorted(_FAMILY, key=len, reverse=True)))


def held_out(id_col: str):
    """Rows that must not be learnt from: crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def text_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def text_features(text: str) -> set[str]:
    return {f for w in text_words(text) for f in word_features(w)}


def swaps(text: str) -> Counter:
    """How many sentences of the text change by a swap in which way: (features that the swapped sentence has more, and
    that it has no longer).  Features that other words of the sentence have as well do not change."""
    out: Counter = Counter()
    low = text.lower()
    if not _NAMED.search(low):
        return out
    for sentence in _SENTENCE.split(low):
        words = set(_WORD.findall(sentence))
        for t in words & _FAMILY.keys():
            rest = {f for w in words if w != t for f in word_features(w)}
            before = rest.union(word_features(t))
            for other in _FAMILY[t]:
                after = rest.union(word_features(other))
                out[" ".join(sorted(after - before)), " ".join(sorted(before - after))] += 1
    return out


class Model:
    """Weights by feature, and the bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[str, ...]] = {}

    def telling(self, word: str) -> tuple[str, ...]:
        """The model's features that the word has."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = tuple(f for f in word_features(word) if f in self.weights)
        return got

    def score(self, text: str) -> float:
        get, telling = self.known.get, self.telling
        found: set[str] = set()
        for w in text_words(text):
            if (t := get(w)) is None:
                t = telling(w)
            if t:
                found.update(t)
        total = self.bias + sum([self.weights[f] for f in sorted(found)])
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, total)))))


def fit(rows: list[tuple[int, list[int]]], names: list[str], pairs: dict[tuple[str, str], int], ridge: float, fairness: float, steps: int = 1000) -> Model:
    """Logistic regression on rows of (label, places of features in names) with the counterfactual penalty, by
    accelerated gradient descent; classes count alike."""
    n, m = len(rows), len(names)
    y = np.array([t for t, _ in rows], float)
    at = np.repeat(np.arange(n), [len(f) for _, f in rows])
    col = np.array([f for _, fs in rows for f in fs], np.int64)
    prior = (y.sum() + 0.5) / (n + 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) if n else y
    place = {f: i for i, f in enumerate(names)}
    # one sparse row for each way in which a swap changes a sentence: 1 for a feature more, -1 for one less
    total = sum(pairs.values()) or 1
    entries = [(r, place[f], sign) for r, pair in enumerate(sorted(pairs)) for side, sign in zip(pair, (1.0, -1.0), strict=True) for f in side.split() if f in place]
    share = np.array([pairs[p] / total for p in sorted(pairs)])
    pair_row, pair_col, pair_sign = (np.array(x, kind) for x, kind in zip(zip(*entries, strict=True) if entries else ([], [], []), (np.int64, np.int64, float), strict=True))
    sizes = np.bincount(pair_row, minlength=len(share)) if len(share) else np.zeros(0)
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    v, c, t = w.copy(), b, 1.0
    longest = max([len(f) for _, f in rows], default=0)
    rate = 1 / (0.25 * (longest + 1) + ridge + 2 * fairness * float(sizes @ share) + 1e-9)
    for _ in range(steps if n else 0):
        chance = 1 / (1 + np.exp(-np.clip(c + np.bincount(at, v[col], n), -30, 30)))
        error = weight * (chance - y)
        slope = np.bincount(col, error[at], m) + ridge * v
        if len(pair_row):
            change = np.bincount(pair_row, v[pair_col] * pair_sign, len(share))
            slope += np.bincount(pair_col, (2 * fairness * share * change)[pair_row] * pair_sign, m)
        w_new, b_new, t_new = v - rate * slope, c - rate * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b))


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, max_features: int = 4096, min_texts: int = 3, min_z: float = 2.0, min_ratio: float = 1.5, ridge: float = 1e-5, fairness: float = 1.0) -> Model:
    """Learn from labelled rows that are not held out.

    The model has at most ``max_features`` features beside those of groups' names, the most telling ones; a feature needs
    ``min_texts`` toxic texts of the sample, stands ``min_z`` standard errors above chance and has a log odds ratio of
    ``min_ratio``.  All of these bound the model, not the rows that are scored.

    Of several labels of one id the highest holds; null ids and labels are passed over.  The sample (at most
    ``sample_rows`` ids, so safe to broadcast) is joined with the documents and written to the shared folder; features are
    counted per task before they are shuffled.  Without labels the model has no features and scores every text alike.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    docs = texts(documents, id_col, text_col).join(F.broadcast(known), "id")

    def keyed(part):
        words, first = word_hashes(part.column("text"), lower=True)
        keys = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = words[a:b]
            keys.append(int(gram_hashes(own, min(5, len(own))).min().astype(np.int64)) if b > a else 0)
        return {k: part.column(k) for k in ("id", "toxic", "text")} | {"key": keys}

    kind = docs.schema["id"].dataType.simpleString()
    sample = written(map_slices(docs, keyed, f"id {kind}, toxic int, text string, key long"), "toxicity")
    single = sample.groupBy("key").agg(F.min(F.struct("id", "toxic", "text")).alias("r")).select("r.*")
    sample = written(single, "toxicity")

    def counted(batches):
        import pyarrow as pa

        n, toxic, pairs = Counter(), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = text_features(text)
                n.update(own)
                if label:
                    toxic.update(own)
                pairs.update(f"{a}\0{b}" for (a, b), k in swaps(text).items() for _ in range(k))
        columns = [[*n, *pairs], [*n.values(), *pairs.values()], [*[toxic[f] for f in n], *[-1] * len(pairs)]]
        for at in range(0, len(columns[0]), 20_000):
            yield pa.record_batch([pa.array(columns[0][at : at + 20_000], pa.string()), pa.array(columns[1][at : at + 20_000], pa.int64()), pa.array(columns[2][at : at + 20_000], pa.int64())], ["feature", "n", "toxic"])

    totals = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    counts = written(sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(counted, "feature string, n long, toxic long"), "toxicity")
    pairs = {tuple(r["feature"].split("\0")): r["n"] for r in counts.filter("toxic < 0").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    # how far the lower bound of the log odds ratio stands above 0
    a, b = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    ratio = F.log(a / (bad + 1 - a + 0.5)) - F.log(b / F.greatest(F.lit(0.5), good + 1 - b + 0.5))
    spread = F.sqrt(1 / a + 1 / b + 1 / (bad + 1 - a + 0.5) + 1 / F.greatest(F.lit(0.5), good + 1 - b + 0.5))
    named = sorted({f for p in pairs for side in p for f in side.split()})
    summed = counts.filter("toxic >= 0").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).withColumn("ratio", ratio).withColumn("z", ratio / spread)
    chosen = [r["feature"] for r in summed.filter(f"toxic >= {min_texts} and z > {min_z} and ratio > {min_ratio}").orderBy(F.desc("z"), "feature").limit(max_features).collect()]
    names = sorted({*chosen, *named})
    place = {f: i for i, f in enumerate(names)}

    def seen(part):
        return {"toxic": part.column("toxic"), "at": [sorted(place[f] for f in text_features(x) if f in place) for x in part.column("text").to_pylist()]}

    rows = map_slices(sample.select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic")), seen, "toxic int, at array<int>")
    return fit(sorted((r["toxic"], list(r["at"])) for r in rows.collect()), names, pairs, ridge, fairness)


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1) of every text; null and empty texts get the score of no feature."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    ready: list[Model] = []

    def work(part):
        if not ready:
            ready.append(Model(*shared.value))
        return {"id": part.column("id"), "score": [ready[0].score(x) for x in part.column("text").to_pylist()]}

    docs = texts(documents, id_col, text_col)
    return map_slices(docs, work, f"id {docs.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    ready: list[Model] = []

    def keeps(found):
        if not ready:
            ready.append(Model(*shared.value))
        return [ready[0].score(x) < threshold for x in found]

    return filter_texts(documents, keeps, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable] = {"op1_toxicity": query}
ORACLE_SQL: dict[str, str] = {}
