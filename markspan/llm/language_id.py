"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.llm.samples import bounded_sample
from markspan.llm.tables import free_names, ship

ORDER = 4
#: Bound of the sample each model learns from: documents per language, by a hash of doc_id, and bytes of their texts.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 250, 4 << 20
CALIBRATION = 5
SHARPNESS = 20.0
#: Odd multipliers: 2^64 over the golden ratio, and the one that joins the symbols of an n-gram.
_MIX, _JOIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_PIECE = 1 << 20

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others one blank, with a blank at either end; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return codes
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, codes, np.uint32(32))[keep]
    if not letter.any():
        return out[:0]
    blank = np.full(1, 32, np.uint32)
    start = [] if out[0] == 32 else [blank]
    return np.concatenate([*start, out, *([] if out[-1] == 32 else [blank])])


def _mix(keys: np.ndarray) -> np.ndarray:
    """Bijective scrambling of n-gram hashes, so that sorted ones are spread evenly."""
    x = keys * _MIX
    x ^= x >> np.uint64(29)
    return x * _MIX


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams given as one column of symbols per place."""
    out = columns[0].astype(np.uint64)
    for column in columns[1:]:
        out = out * _JOIN + column
    return out


def _places(ids: np.ndarray, n: int) -> list[np.ndarray]:
    """Every n-gram of the symbols, as one column per place."""
    return [ids[k : len(ids) - n + 1 + k].astype(np.uint64) for k in range(n)]


class HashArray:
    """Sorted hashes with a row of values each; found by their leading bits and a short scan."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = _mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order])
        self.bits = max(1, int(len(keys) * 2 + 1).bit_length())
        start = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.start = start.astype(np.int32)
        self.depth = int(np.diff(np.append(start, len(keys))).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hashes):
            return out
        hashes = _mix(keys)
        at = self.start[hashes >> np.uint64(64 - self.bits)]
        last = len(self.hashes) - 1
        todo = None
        for _ in range(self.depth):
            hit = self.hashes[np.minimum(at, last)] == hashes
            if todo is None:
                out[hit] = at[hit]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] = at[hit]
                todo = todo[~hit]
            at, hashes = at[~hit] + 1, hashes[~hit]
            if not len(todo):
                break
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    symbols: np.ndarray  # code point -> id, 0 unknown
    grams: list[HashArray]  # by order - 1: log probabilities per language
    backoffs: list[HashArray]  # by context length - 1: log weights per language
    unknown: np.ndarray
    mean: np.ndarray
    limit: np.ndarray

    def costs(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """Sum over characters of -log p per language, and the number of characters."""
        total, n = np.zeros(len(self.languages)), len(codes)
        for lo in range(0, n, _PIECE):
            part = codes[max(0, lo - ORDER + 1) : lo + _PIECE]
            skip = lo - max(0, lo - ORDER + 1)
            total -= self._sum(self.symbols[np.minimum(part, len(self.symbols) - 1)], skip)
        return total, n

    def _sum(self, ids: np.ndarray, skip: int) -> np.ndarray:
        """Sum of log probabilities of the symbols from ``skip`` on: the longest known n-gram, with the weights of the contexts given up."""
        total = np.zeros(len(self.languages))
        at = np.arange(skip, len(ids))
        for n in range(ORDER, 0, -1):
            if n > 1:
                full = at >= n - 1
                here, rest = at[full], at[~full]
                rows = self.grams[n - 1].find(_hash_at(ids, here, n))
                hit = rows >= 0
                total += _row_sums(self.grams[n - 1].values, rows[hit])
                missed = here[~hit]
                if len(missed):
                    context = self.backoffs[n - 2].find(_hash_at(ids, missed - 1, n - 1))
                    total += _row_sums(self.backoffs[n - 2].values, context[context >= 0])
                at = np.concatenate([missed, rest])
            else:
                rows = self.grams[0].find(ids[at].astype(np.uint64))
                total += _row_sums(self.grams[0].values, rows[rows >= 0]) + self.unknown * np.count_nonzero(rows < 0)
            if not len(at):
                break
        return total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or ``und``, score, rejected)."""
        codes = normalise(text) if text else np.zeros(0, np.uint32)
        if not len(codes) or not self.languages:
            return "und", 0.0, True
        total, n = self.costs(codes)
        cost = total / n
        best = int(np.argmin(cost))
        score = 1.0 / float(np.exp(-SHARPNESS * (cost - cost[best])).sum())
        return self.languages[best], score, bool(cost[best] > self.limit[best] + 3.0 / n**0.5)


def _row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the values' rows, by how often each occurs."""
    if len(rows) > 4 * len(values):
        return np.bincount(rows, minlength=len(values)).astype(np.float64) @ values
    return values[rows].sum(axis=0, dtype=np.float64)


def _hash_at(ids: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at the places ``last``."""
    if len(last) == len(ids) - n + 1 and n <= len(ids) and (not len(last) or last[0] == n - 1):
        return _hash(_places(ids, n))
    return _hash([ids[last - back].astype(np.uint64) for back in range(n - 1, -1, -1)])


def _different(grams: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(hashes in order, columns, counts) of the different n-grams."""
    keys, first, counts = np.unique(_hash(grams), return_index=True, return_counts=True)
    return keys, [c[first] for c in grams], counts


def _joined(parts: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(n)]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def train(samples: dict[str, list[str]]) -> LanguageModel:
    """Interpolated Kneser-Ney models of ORDER characters for each language; every CALIBRATION-th text only sets the limits.

    n-grams below the highest order count the different symbols before them.
    The limit of a language is the largest cost of its calibration texts (of 200
    characters or more) plus a fifth, and twice their mean at least.
    """
    languages = sorted(samples, key=lambda x: x.encode("utf-8"))
    coded = {x: [c for c in map(normalise, samples[x]) if len(c)] for x in languages}
    languages = [x for x in languages if coded[x]]
    fit = {x: [c for i, c in enumerate(coded[x]) if i % CALIBRATION or len(coded[x]) < CALIBRATION] for x in languages}
    seen = np.unique(np.concatenate([c for x in languages for c in fit[x]])) if languages else np.zeros(0, np.uint32)
    symbols = np.zeros(int(seen.max()) + 2 if len(seen) else 1, np.uint32)
    symbols[seen] = np.arange(1, len(seen) + 1)
    per = [_kneser_ney([symbols[c] for c in fit[x]], len(seen) + 1) for x in languages]
    grams, backoffs = [], []
    union = [_different(_joined([p["grams"][n] for p in per], n + 1)) for n in range(ORDER)]
    below = None  # interpolated probabilities of the next lower order's union, per language
    for n in range(ORDER):
        keys, places, _ = union[n]
        probability = np.zeros((len(keys), len(languages)))
        for k, p in enumerate(per):
            own = _lookup(p["keys"][n], p["discounted"][n], keys)
            if n == 0:
                probability[:, k] = own + p["gamma0"] / (len(seen) + 1)
            else:
                context = _lookup(p["contexts"][n - 1], p["gamma"][n - 1] - 1.0, _hash(places[:-1])) + 1.0
                suffix = np.searchsorted(union[n - 1][0], _hash(places[1:]))
                probability[:, k] = own + context * below[suffix, k]
        below = probability
        grams.append(HashArray(keys, np.log(np.maximum(probability, 1e-12)).astype(np.float32)))
        if n < ORDER - 1:
            contexts = np.unique(np.concatenate([p["contexts"][n] for p in per])) if per else np.zeros(0, np.uint64)
            gamma = np.stack([_lookup(p["contexts"][n], p["gamma"][n] - 1.0, contexts) + 1.0 for p in per], axis=1) if per else np.zeros((0, 0))
            backoffs.append(HashArray(contexts, np.log(np.maximum(gamma, 1e-12)).astype(np.float32)))
    unknown = np.log([max(p["gamma0"], 1e-6) / (len(seen) + 1) for p in per]) if per else np.zeros(0)
    model = LanguageModel(languages, symbols, grams, backoffs, unknown, np.zeros(len(languages)), np.full(len(languages), np.inf))
    for k, x in enumerate(languages):
        held = [c for i, c in enumerate(coded[x]) if i % CALIBRATION == 0]
        costs = [(model.costs(c)[0] / len(c))[k] for c in held if len(c) >= 200] or [(model.costs(c)[0] / len(c))[k] for c in held]
        model.mean[k] = float(np.mean(costs))
        model.limit[k] = max(float(np.max(costs)) * 1.2, model.mean[k] * 2.0)
    return model


def _kneser_ney(texts: list[np.ndarray], alphabet: int) -> dict:
    """Per order: n-grams and their hashes, discounted relative counts, contexts and the mass each context leaves to the lower order."""
    out: dict = {"keys": [], "grams": [], "discounted": [], "contexts": [], "gamma": []}
    levels = [_different(_joined([_places(t, ORDER) for t in texts if len(t) >= ORDER], ORDER))]
    for n in range(ORDER - 1, 0, -1):  # different symbols before each shorter n-gram; a text's start counts once
        starts = _different(_joined([_places(t[:n], n) for t in texts if len(t) >= n], n))[1]
        levels.insert(0, _different(_joined([levels[0][1][1:], starts], n)))
    for n, (keys, grams, counts) in enumerate(levels):
        ones, twos = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        left = np.maximum(counts - discount, 0.0)
        out["keys"].append(keys)
        out["grams"].append(grams)
        if n == 0:
            total = max(1.0, float(counts.sum()))
            out["discounted"].append(left / total)
            out["gamma0"] = discount * len(keys) / total if len(keys) else 1.0
            continue
        contexts, where = np.unique(_hash(grams[:-1]), return_inverse=True)
        total = np.bincount(where, weights=counts, minlength=len(contexts))
        kinds = np.bincount(where, minlength=len(contexts))
        out["discounted"].append(left / total[where])
        out["contexts"].append(contexts)
        out["gamma"].append(discount * kinds / total)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(documents: DataFrame, per_language: int = SAMPLE_DOCUMENTS, language_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Whole texts of up to ``per_language`` documents, and about ``language_bytes``, of each language that are not held out.

    Every language found is learnt; a doc_id counts once, however many rows it has.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts: dict[str, list[str]] = {}
    for row in sorted(bounded_sample(known.select("lang", "doc_id", "text"), "lang", per_language, language_bytes).collect(), key=lambda r: (r["doc_id"], r["lang"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    return texts


def identify(documents: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """``columns`` of the documents with lang_pred, score and rejected, in one pass over whole texts.

    The three take the place of asked-for columns of these names.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    asked = [c for c in columns if c.lower() not in ("lang_pred", "score", "rejected")]

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(0)]
            lang, score, rejected = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names[1:], "lang_pred", "score", "rejected"],
            )

    narrow = documents.select(F.col("text").cast("string").alias(free_names(documents, "text")[0]), *asked)
    schema = "".join(f"`{c}` {t}, " for c, t in narrow.dtypes[1:])
    return narrow.mapInArrow(run, f"{schema}lang_pred string, score double, rejected boolean")


def identify_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document.

    Learns from text and lang of documents that are not held out and never looks
    at lang, source or doc_id in a prediction. Null texts and texts without a
    letter are ``und`` with score 0; so is all if there is nothing to learn
    from. Ties go to the language first by code point. A null doc_id is not
    held out and not learnt from. Repeated rows give repeated results.
    """
    model = train(training_sample(documents))
    return identify(documents, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
