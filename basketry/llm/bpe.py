"""Byte-level BPE by forced boundaries: cut where no vocabulary token can reach across, encode the fragments, join."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import lean

#: Fixed value: how byte-level BPE splits a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in each of the two generations that a worker remembers.
MEMO = 250_000
#: Fragments up to so many bytes are merged by rescanning, longer ones over a heap.
SHORT = 24
#: Stands for a pair that no merge joins.
NEVER = (1 << 60, -1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself if printable, else 256 upwards in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        self[key] = found = self.make(key)
        return found


class _Recent(_Memo):
    """Two generations: once the young one is full it becomes the old one, so pieces in use stay and memory is bounded."""

    def __init__(self, make, size: int):
        super().__init__(make)
        self.size, self.old = size, {}

    def __missing__(self, key):
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, spec: bytes | str):
        model = json.loads(spec)
        if model.get("normalizer") or model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is handled")
        back = {c: b for b, c in enumerate(byte_letters())}
        to_bytes = lambda s: bytes(back[c] for c in s)
        vocab = {to_bytes(s): i for s, i in model["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.tokens = _Memo(lambda _: b"")
        self.tokens.update({i: s for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()})
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = map(to_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.joins = np.zeros((256, 256), bool)
        for token in vocab:
            t = np.frombuffer(token, np.uint8)
            self.joins[t[:-1], t[1:]] = True
        self.joined = [row.tobytes() for row in self.joins]
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo = _Recent(self._piece, MEMO)

    def fragments(self, data: bytes) -> list[bytes]:
        """Cut between two bytes that no vocabulary token holds side by side: no merge can ever cross there."""
        if len(data) <= SHORT:
            joined = self.joined
            cuts = [k for k, (a, b) in enumerate(zip(data, data[1:]), 1) if not joined[a][b]]
        else:
            t = np.frombuffer(data, np.uint8)
            cuts = (np.flatnonzero(~self.joins[t[:-1], t[1:]]) + 1).tolist()
        if not cuts:
            return [data]
        edges = [0, *cuts, len(data)]
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def _piece(self, piece: str) -> bytes:
        ids = []
        for part in self.fragments(piece.encode()):
            ids += self._merge_short(part) if len(part) <= SHORT else self._merge(part)
        return pack(f"<{len(ids)}I", *ids)

    def _merge_short(self, data: bytes) -> list[int]:
        """As ``_merge``, by looking through all pairs for each merge."""
        ids, merges = [self.byte_ids[b] for b in data], self.merges
        found = [merges.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while found and (best := min(found))[0] < NEVER[0]:
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k < len(found):
                found[k] = merges.get((ids[k], ids[k + 1]), NEVER)
            if k:
                found[k - 1] = merges.get((ids[k - 1], ids[k]), NEVER)
        return ids

    def _merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, over a linked list: n log n for a fragment of any length."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            if (m := self.merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := self.merges.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x, on in zip(ids, alive) if on]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Added tokens in the text get their own ids."""
        if not text:
            return b""
        find = self.memo.__getitem__
        if self.special is None or not self.special.search(text):
            return b"".join(map(find, self.split(text)))
        parts = []
        for k, part in enumerate(self.special.split(text)):
            parts.append(np.array([self.added[part]], "<u4").tobytes() if k % 2 else b"".join(map(find, self.split(part))))
        return b"".join(parts)

    def forget(self) -> None:
        """Drop the pieces remembered, which hold far more memory than the vocabulary."""
        self.memo.clear()
        self.memo.old = {}

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def _loaded(spec: bytes) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(spec)


def _broadcast(docs: DataFrame, path: str):
    """The vocabulary file, a few MB whatever the corpus, read once by the driver."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int). Null and empty texts give no ids."""
    spec = _broadcast(docs, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = _loaded(spec.value)
        return pd.Series([np.frombuffer(bpe.encode(t), "<i4") for t in texts])

    return docs.withColumn("ids", ids(F.col(text)))


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; a null list gives an empty text."""
    spec = _broadcast(encoded, path)

    @F.pandas_udf("string")
    def decoded(lists: pd.Series) -> pd.Series:
        bpe = _loaded(spec.value)
        return pd.Series(["" if x is None else bpe.decode(np.asarray(x, "<u4").tobytes()) for x in lists])

    return encoded.withColumn(text, decoded(F.col(ids)))


def bpe_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again in one pass, nothing shuffled.

    Null texts count as empty; repeated rows give repeated results; an empty table gives an empty result.
    """
    spec = _broadcast(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(spec.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in batches:
            counts, coded, plain = [], [], []
            for t in pdf["text"]:
                ids = bpe.encode(t)
                counts.append(len(ids) // 4)
                coded.append(sha(ids))
                plain.append(sha(bpe.decode(ids).encode()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": plain})
        bpe.forget()

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
