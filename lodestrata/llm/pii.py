"""Personal data by weak supervision.

Fixed patterns give the base spans.  Further candidate spans (national ids, bank accounts, local phone numbers, names
after a form of address, hardware addresses) are judged by labelers that vote for, against or not at all: a regex labeler
of strict spellings, a checksum or shape labeler, a gazetteer labeler and two context labelers, which look at the words of
the sentence or line before the candidate.  The votes of all documents are counted by pattern in Spark;
from these counts expectation-maximisation estimates how reliable each labeler is, without labels.  The posteriors then
train the final span classifier, a logistic regression over the features of a candidate, which decides on every span.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import map_slices, texts, written
from lodestrata.llm.spans import SPANS, Covered, digest_columns, in_order, redacted

BASE = ["email", "ip", "card", "phone"]
LABELERS = 5
CANDIDATES = ["national", "account", "local_phone", "person", "hardware"]
KINDS = [*BASE, *CANDIDATES]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: A run of digits that fails at its start fails anywhere in it, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
#: Chains of fewer than 12 digits fail, so only longer ones are looked for.
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_HARDWARE = re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Mme|Herr|Frau|Sra?)\.?\x20([A-Z][a-z]+(?:\x20[A-Z][a-z]+)?)(?![A-Za-z])")

#: Words that stand before personal data of a kind, and words that stand before other numbers.
CONTEXT = {
    "national": {"ssn", "social", "security", "insurance", "nino", "national", "identity"},
    "account": {"iban", "account", "konto", "cuenta", "compte", "bank", "transfer"},
    "local_phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "contact", "dial"},
    "person": {"contact", "name", "patient", "dear", "signed", "author", "attn"},
    "hardware": {"mac", "address", "device", "ethernet", "bluetooth", "wifi", "hardware"},
}
OTHER_NUMBERS = {"isbn", "issn", "doi", "version", "part", "order", "invoice", "model", "serial", "figure", "table", "page", "ref", "sku", "item", "no"}
#: Frequent given names.
GIVEN_NAMES = {"alejandro", "alice", "amelie", "andrea", "andreas", "antonio", "camille", "carlos", "charles", "charlotte", "chloe", "christian", "daniel", "diego", "elena", "emily", "emma", "felix", "francisco", "george", "greta", "heike", "helen", "ingrid", "isabel", "javier", "joseph", "juan", "julia", "julie", "jürgen", "karl", "karen", "katharina", "klaus", "laura", "lena", "louis", "lucas", "lucia", "margaret", "mark", "martin", "miguel", "monika", "nancy", "nicolas", "olivier", "pablo", "pierre", "pilar", "richard", "rosa", "sabine", "sofia", "sophie", "stefan", "steven", "susan", "ursula", "uwe", "wolfgang", "james", "mary", "john", "patricia", "robert", "jennifer", "michael", "linda", "david", "elizabeth", "william", "barbara", "maria", "anna", "hans", "peter", "jean", "marie", "jose", "carmen", "ana", "luis", "paul", "claire", "thomas", "sarah"}
_WORD = re.compile(r"[^\W\d_]+")
#: What ends a sentence or line.
_BREAK = re.compile(r"[.!?]\s|\n")
#: Strict spellings of each kind: values that look like this are rarely anything else.
STRICT = {
    "national": re.compile(r"[1-8][0-9]{2}-[0-9]{2}-[0-9]{4}"),
    "account": re.compile(r"(?:AD|AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}.+"),
    "local_phone": re.compile(r"\([2-9][0-9]{2}\)\x20[2-9][0-9]{2}[.-][0-9]{4}|[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4}"),
    "person": re.compile(r"[A-Z][a-z]+\x20[A-Z][a-z]+"),
    "hardware": re.compile(r"[0-9A-F]{2}([:-])[0-9A-F]{2}(?:\1[0-9A-F]{2}){4}|[0-9a-f]{2}([:-])[0-9a-f]{2}(?:\2[0-9a-f]{2}){4}"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(map(int, reversed(digits))):
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        # the longest local part that ends here; a search from before would start there too
        start = at
        while start > done and text[start - 1] < "\x80" and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def shape_vote(kind: str, value: str) -> int:
    """1 or -1 of the checksum or shape labeler; 0 where there is none for the kind."""
    if kind == "national":
        area, group, serial = value.split("-")
        return 1 if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else -1
    if kind == "account":
        turned = (v := value.replace(" ", ""))[4:] + v[:4]
        return 1 if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else -1
    if kind == "local_phone":
        digits = re.sub("[^0-9]", "", value)
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    if kind == "hardware":
        return -1 if len(set(re.findall("[0-9A-Fa-f]{2}", value))) == 1 else 1
    return 0


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """kind, start, end and feature code of every candidate outside the base spans."""
    out = []
    found = [("person", *m.span(1)) for m in _PERSON.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("national", _NATIONAL), ("account", _ACCOUNT), ("local_phone", _LOCAL_PHONE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if ":" in text or "-" in text:
        found += [("hardware", *m.span()) for m in _HARDWARE.finditer(text)]
    covered = Covered(base)
    words, last, seen, at = set(), [], 0, 0  # of the sentence, up to ``seen``
    breaks = [m.end() for m in _BREAK.finditer(text)] if found else []
    for kind, start, end in sorted(found, key=lambda s: s[1]):
        if not covered.outside(start, end):
            continue
        while at < len(breaks) and breaks[at] <= start:
            words, last, seen, at = set(), [], max(seen, breaks[at]), at + 1
        more = [w.lower() for w in _WORD.findall(text[seen:start])]
        words.update(more)
        last, seen = (last + more)[-2:], max(seen, start)
        value = text[start:end]
        shape = shape_vote(kind, value)
        gazetteer = 1 if any(w.lower() in GIVEN_NAMES for w in _WORD.findall(value)) else 0
        near = 0 if words.isdisjoint(CONTEXT[kind]) else 1
        other = -1 if any(w in OTHER_NUMBERS for w in last) else 0
        strict = 1 if STRICT[kind].fullmatch(value) else 0
        out.append((kind, start, end, encode(CANDIDATES.index(kind), strict, shape, gazetteer, near, other, min(3, len(value) // 8))))
    return out


def encode(kind: int, strict: int, shape: int, gazetteer: int, near: int, other: int, size: int) -> int:
    """One number for the features of a candidate: under 5 * 3^5 * 4, so there are at most 4,860 patterns."""
    code = kind
    for v in (strict, shape, gazetteer, near, other):
        code = code * 3 + v + 1
    return code * 4 + size


def decode(code: int) -> tuple[int, list[int], int]:
    code, size = divmod(code, 4)
    votes = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], size


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns (-1, 0, 1) and their counts: posteriors of the patterns, the labelers'
    chances to be right when they vote, and the share of true candidates.  Starts from the majority vote, with a prior of
    8 right and 2 wrong votes for each labeler, which breaks the symmetry between the two classes."""
    posterior = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    right, share = np.full(votes.shape[1], 0.8), 0.5
    for _ in range(rounds):
        share = (posterior @ counts + 1) / (counts.sum() + 2)
        for k in range(votes.shape[1]):
            v = votes[:, k]
            hits = (posterior * (v == 1) + (1 - posterior) * (v == -1)) @ counts
            right[k] = (hits + 8) / (((v != 0) @ counts) + 10)
        odds = np.log(share / (1 - share)) + votes @ np.log(right / (1 - right))
        posterior = 1 / (1 + np.exp(-odds))
    return posterior, right, share


def features(kind: int, votes: list[int], size: int) -> np.ndarray:
    x = np.zeros(1 + len(CANDIDATES) + 2 * LABELERS + 4)
    x[0] = x[1 + kind] = 1
    for k, v in enumerate(votes):
        if v:
            x[1 + len(CANDIDATES) + 2 * k + (v > 0)] = 1
    x[-4 + size] = 1
    return x


def train(patterns: list[tuple[int, int]]) -> dict[int, float]:
    """Chance of each feature code, by a logistic regression (ridge 1, Newton steps) on the posteriors of EM."""
    if not patterns:
        return {}
    codes, counts = [c for c, _ in patterns], np.array([n for _, n in patterns], float)
    parts = [decode(c) for c in codes]
    posterior, _, _ = reliabilities(np.array([v for _, v, _ in parts], float), counts)
    x, weight = np.array([features(*p) for p in parts]), np.zeros(len(features(0, [0] * LABELERS, 0)))
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (counts * (chance - posterior)) + weight
        curve = (x.T * (counts * chance * (1 - chance))) @ x + np.eye(len(weight))
        weight -= np.linalg.solve(curve, slope)
    return dict(zip(codes, 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30))), strict=True))


def find_pii(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id and ``spans`` (kind, start, end; code points, end exclusive; by start, then kind as in KINDS) of every text.

    Texts are scanned once; spans and candidates go to a table in the shared folder, from which the vote patterns (at
    most 4,860) are counted and every candidate is classified.  Null and empty texts, and an empty table, have no spans.
    """

    def work(part):
        base, more = [], []
        for text in part.column("text").to_pylist():
            own = base_spans(text)
            more.append([{"kind": k, "start": a, "end": b, "code": c} for k, a, b, c in candidates(text, own)])
            base.append(in_order(own, KINDS))
        return {"id": part.column("id"), "base": base, "more": more}

    docs = texts(documents, id_col, text_col)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, base {SPANS}, more array<struct<kind:string,start:int,end:int,code:int>>"
    found = written(map_slices(docs, work, schema), "pii")
    counted = found.select(F.explode("more").alias("m")).groupBy("m.code").count().orderBy("code").collect()
    good = [c for c, p in train([(r["code"], r["count"]) for r in counted]).items() if p >= threshold]
    accepted = F.transform(F.filter("more", lambda m: m["code"].isin(good)), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(F.concat("base", accepted), lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), F.when(F.size("more") == 0, F.col("base")).otherwise(ordered).alias("spans"))


def redact(text: str | None, spans: list) -> str | None:
    """The text with its spans replaced by [KIND]."""
    return None if text is None else redacted(text, [(s["start"], s["end"], s["kind"]) for s in spans])


def query_columns(documents: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text, and how many there are."""
    found = find_pii(documents)
    return digest_columns(found, "doc_id", BASE, F.size("spans").cast("long").alias("n_spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return query_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op10_pii": query}
ORACLE_SQL: dict[str, str] = {}
