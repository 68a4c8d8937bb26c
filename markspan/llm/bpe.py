"""Byte-level BPE encoding with a heap of merge ranks over a linked symbol list, and decoding."""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspan.llm.tables import ship

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how byte-level BPE of this kind cuts a text, with white space spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
_SHIFT, _MASK = 32, (1 << 32) - 1
CACHE_PIECES = 150_000
_LONG_PIECE = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Cache(dict):
    """Ids of pieces as bytes; holds two generations of CACHE_PIECES, so memory is bounded and frequent pieces stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = np.array(self.encode(piece.encode("utf-8")), dtype="<u4").tobytes()
            if len(piece) > _LONG_PIECE:
                return found
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class ByteBpe:
    """Encoder and decoder of one vocabulary file (JSON of a byte-level BPE model)."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        self.byte_id = [vocab[c] for c in symbols]
        self.rank = {vocab[a] << _SHIFT | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(symbols)}
        self.strings: dict[int, bytes] = {}
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache = _Cache(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the bytes of a piece: pop the lowest rank, skip it if its pair is gone, else join two symbols and push the new pairs."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        rank, merged = self.rank.get, self.merged
        heap = [r << _SHIFT | i for i in range(n - 1) if (r := rank(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, r = top & _MASK, top >> _SHIFT
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << _SHIFT | ids[j]) != r:
                continue
            ids[i], ids[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank(ids[i] << _SHIFT | ids[k])) is not None:
                    heappush(heap, q << _SHIFT | i)
            h = before[i]
            if h >= 0 and (q := rank(ids[h] << _SHIFT | ids[i])) is not None:
                heappush(heap, q << _SHIFT | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; strings of added tokens are those tokens."""
        text = text or ""
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(self.cache.__getitem__, self.pieces.findall(text)))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += map(self.cache.__getitem__, self.pieces.findall(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(self.cache.__getitem__, self.pieces.findall(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[bytes, ByteBpe] = {}


def load_bpe(source: bytes) -> ByteBpe:
    """One instance per Python worker, kept between tasks."""
    key = hashlib.sha256(source).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(source)
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(documents: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, and ``ids`` (binary) if asked for.

    The vocabulary file (about 2 MB) is read on the driver and broadcast. Null
    is the empty text; repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result. One pass, no shuffle.
    """
    spark = documents.sparkSession
    ship(spark)
    with open(vocabulary or default_vocabulary(), "rb") as file:
        source = spark.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches):
        bpe = load_bpe(source.value)
        for batch in batches:
            count, sha, back, kept = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                count.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
