"""Byte-level BPE encoding and decoding by a tree reduction over a monoid.

An element of the monoid is the encoding of a string.  A long string is halved recursively; halves are encoded apart and
joined by encoding a window of tokens around the seam anew.  The window grows until the seam is proved: a token sequence
is the BPE encoding of its bytes exactly when every two neighbours t, u satisfy encode(t + u) == [t, u], because the first
merge that crossed a token boundary would cross it in the run over these two tokens alone as well (merges are taken by
lowest rank, then leftmost, so the run over a part is the part of the run over the whole).  So once both edges of the
window pass that test, no token outside it can change.  Decoding is the homomorphism back: bytes concatenate up the tree.

The text itself is halved at places where the split pattern is known to end a match (see ``safe_cut``), so its halves'
encodings just concatenate; within a long match the window join above applies.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import map_slices, texts

#: Longest byte string that is encoded without being halved; results do not depend on it.
LEAF_BYTES = 16
#: Ids that are decoded without being halved.
LEAF_IDS = 1 << 12
#: Code points of text that are matched at once.
LEAF_CHARS = 1 << 14
#: Bytes of a rank file that are sent to workers at most.
MAX_RANKS = 1 << 26
#: Pieces whose encodings a worker remembers; it forgets them all beyond this number.
REMEMBERED = 200_000

OUTPUTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token from the content of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return read_ranks(file.read())


class Codec:
    """The encoder and decoder of one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {v: k for k, v in ranks.items()}
        self.match = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.joins = 0

    def leaf(self, data: bytes) -> list[int]:
        """The encoding of one string by merging the pair of lowest rank, leftmost first, until none is left."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, get = len(data), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            _, i, end = heapq.heappop(queue)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(data[i : after[end]])) is not None:
                    heapq.heappush(queue, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := get(data[h:end])) is not None:
                heapq.heappush(queue, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def stable(self, t: int, u: int) -> bool:
        """Whether t, u is the encoding of its bytes."""
        got = self.pairs.get((t, u))
        if got is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            got = self.pairs[t, u] = self.leaf(self.tokens[t] + self.tokens[u]) == [t, u]
        return got

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two strings put together, from their encodings."""
        self.joins += 1
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        left = right = 1
        while True:
            left, right = min(left, len(a)), min(right, len(b))
            window = self.leaf(self.decode(a[len(a) - left :] + b[:right]))
            holds = left == len(a) or self.stable(a[len(a) - left - 1], window[0])
            follows = right == len(b) or self.stable(window[-1], b[right])
            if holds and follows:
                return a[: len(a) - left] + window + b[right:]
            left, right = left if holds else 2 * left, right if follows else 2 * right

    def piece(self, data: bytes) -> list[int]:
        """The encoding of one match of the pattern, by halves where it is long."""
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        middle = len(data) // 2
        return self.join(self.piece(data[:middle]), self.piece(data[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up the tree of their halves."""
        if len(ids) > LEAF_IDS:
            middle = len(ids) // 2
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        return b"".join([self.tokens[i] for i in ids])

    def matches(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        """The pattern's matches in text[start:end], by halves; concatenating the halves' lists is the join."""
        end = len(text) if end is None else end
        if end - start > LEAF_CHARS and (at := safe_cut(text, start, end)):
            return self.matches(text, start, at) + self.matches(text, at, end)
        return self.match(text[start:end])

    def element(self, piece: str) -> list[int]:
        """The encoding of a match, remembered where it is short."""
        got = self.known.get(piece)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            data = piece.encode()
            whole = self.ranks.get(data)  # as the library does for a match that is a token
            got = self.piece(data) if whole is None else [whole]
            if len(piece) < 200:
                self.known[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.element, self.matches(text))))


def safe_cut(text: str, start: int, end: int) -> int:
    """A place near the middle of text[start:end] where every match of a pattern of the usual kind (optional space, then
    a run of letters, digits or other characters; runs of white space; contractions) ends: between a character that is
    not white space and a space.  What follows the space cannot change matches before it, and no match holds both.
    0 if there is none in the middle half."""
    middle, reach = (start + end) // 2, (end - start) // 4
    for found in (text.find(" ", middle, middle + reach), text.rfind(" ", middle - reach, middle)):
        if found > start and not text[found - 1].isspace():
            return found
    for at in range(middle, middle + reach):
        if text[at].isspace() and not text[at - 1].isspace() and at > start:
            return at
    return 0


def encode_decode(documents: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text, decode the ids again, and return the id column, the columns to keep and the asked ``outputs``: ids, decoded,
    n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    ``rank_file`` is read by the driver and sent to the workers once (at most MAX_RANKS bytes).  The decoded text comes from
    the ids alone.  Null and empty texts have no ids and decode to the empty text.
    No shuffle; a worker holds one slice of texts and a bounded table of remembered pieces.
    """
    codec: list[Codec] = []
    wants = set(outputs)
    decodes = not wants.isdisjoint({"decoded", "decoded_sha256"})
    with open(rank_file, "rb") as file:
        content = file.read(MAX_RANKS + 1)
    if len(content) > MAX_RANKS:
        raise ValueError(f"{rank_file} has over {MAX_RANKS} bytes")
    sent = documents.sparkSession.sparkContext.broadcast(content)

    def work(part):
        if not codec:
            codec.append(Codec(read_ranks(sent.value), pattern))
        one = codec[0]
        got: dict[str, list] = {k: [] for k in outputs}
        for text in part.column("text").to_pylist():
            ids = one.encode(text)
            data = one.decode(ids) if decodes else b""
            if "n_tokens" in wants:
                got["n_tokens"].append(len(ids))
            if "ids_sha256" in wants:
                got["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            if "decoded_sha256" in wants:
                got["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
            if "ids" in wants:
                got["ids"].append(ids)
            if "decoded" in wants:
                got["decoded"].append(data.decode())
        return {k: part.column(k) for k in part.schema.names} | got

    docs = texts(documents, id_col, text_col, *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    out = map_slices(docs, work, ", ".join([*kinds, *(f"{k} {OUTPUTS[k]}" for k in outputs)]))
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *outputs)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES: dict[str, Callable] = {"op9_byte_bpe": query}
ORACLE_SQL: dict[str, str] = {}
