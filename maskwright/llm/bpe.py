"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A text is cut at special tokens, then into words by the pattern of byte-level BPE. A word's part boundaries and the
merge ranks of adjacent parts lie in two small lists; the least rank is found by a scan, its boundary is deleted, and
the ranks beside it are looked up anew, until no pair of parts can be merged. Words of more than SHORT bytes, for
which scans would be quadratic, keep the same order of merges with a heap.

Cases: a null text is an empty one, with no ids; equal rows are encoded each; a special token's string in a text is
that token; very long texts and words are encoded whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textkernel import released

#: How byte-level BPE cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 256
CACHED = 120_000
_NEVER = 1 << 60


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where it prints, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Codec:
    """ranks: of the pairs of parts that merge, by (left, right); ids: of parts; specials: ids of whole strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = k
        self.byte_ranks = {a + b: k for (a, b), k in self.ranks.items() if len(a) == len(b) == 1}
        self.parts = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.ready()

    def ready(self) -> None:
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "cut", "cache", "old")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def forget(self) -> None:
        """Drops what is kept of words; a worker may go on to other work."""
        self.cache, self.old = {}, {}

    def word_ids(self, word: bytes) -> list[int]:
        if len(word) > SHORT:
            return [self.ids[p] for p in self._merged_long(word)]
        at = list(range(len(word) + 1))
        rank_of = self.ranks.get
        of_bytes = self.byte_ranks.get
        ranks = [of_bytes(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            k = ranks.index(least)
            del at[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of((word[at[k] : at[k + 1]], word[at[k + 1] : at[k + 2]]), _NEVER)
            if k:
                ranks[k - 1] = rank_of((word[at[k - 1] : at[k]], word[at[k] : at[k + 1]]), _NEVER)
        return [self.ids[word[a:b]] for a, b in zip(at, at[1:], strict=False)]

    def _merged_long(self, word: bytes) -> list[bytes]:
        n = len(word)
        part = [word[i : i + 1] for i in range(n)]
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p, live in zip(part, alive, strict=True) if live]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.specials:
                out.append(self.specials[piece])
            else:
                for w in self.words.findall(piece):
                    out += self.word_ids(w.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "replace")

    def _known(self, word: str) -> tuple[str, int, bytes]:
        """Ids joined by commas, their number, and the bytes that they decode to.

        Results are kept in two generations of CACHED words: a full one becomes the old one, whose words come back to
        the new one as they are met, and the rest goes.
        """
        got = self.old.get(word)
        if got is None:
            ids = [self.specials[word]] if word in self.specials else self.word_ids(word.encode("utf-8", "surrogatepass"))
            got = ",".join(map(str, ids)), len(ids), b"".join(map(self.parts.__getitem__, ids))
        if len(self.cache) >= CACHED:
            self.old, self.cache = self.cache, {}
        self.cache[word] = got
        return got

    def round_trip(self, text: str) -> tuple[str, int, str]:
        """(ids joined by commas, number of ids, decoded text)."""
        words: list[str] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.specials:
                words.append(piece)
            else:
                words += self.words.findall(piece)
        known = self._known
        got = [self.cache.get(w) or known(w) for w in words]
        return ",".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got]).decode("utf-8", "replace")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with_ids its ids as an array.

    The vocabulary, whose size the file fixes, is broadcast.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(Codec(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                got = [codec.round_trip(t or "") for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([digest(g[0]) for g in got]), pa.array([digest(g[2]) for g in got])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([[int(i) for i in g[0].split(",")] if g[0] else [] for g in got], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        shared.value.forget()
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.replace("doc_id long", f"doc_id {kind}") + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
