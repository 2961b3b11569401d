"""Language identification with hyperdimensional profiles.

Every letter, of any script, has a random vector of +1 and -1 of its own, made from the hashes of its
code point. A three-letter sequence is the product of its
letters' vectors, the first rotated by two places and the second by one, so that order counts. A
text is the sum of the vectors of its sequences, a language the sum of its texts, each at equal
weight, and a text is of the language whose vector has the largest cosine with its own. As sums
are linear, a batch counts its distinct sequences and multiplies the counts with their vectors, some
thousands at a time.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm.common import mix, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Dimensions of a vector, a multiple of 64.
DIMENSIONS = 512

#: Texts multiplied at a time, distinct sequences multiplied at a time, and bytes of text counted at a time.
BLOCK, SEQUENCES, SLICE_BYTES = 256, 1 << 14, 1 << 20

UNKNOWN = "und"

_POINT_BITS = 21


class Profiles:
    """Letter sequences of texts as vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 3):
        self.salt = mix(np.arange(1, dimensions // 64 + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self.is_letter = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The vector of each code point: the bits of its hashes as +1 and -1."""
        bits = np.unpackbits(mix(mix(points.astype(np.uint64))[:, None] ^ self.salt).view(np.uint8), axis=1)
        return bits.astype(np.float32) * 2 - 1

    def sequences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of every three-symbol sequence around a letter; other characters are one gap."""
        lower = [(t or "").lower() for t in texts]
        joined = "\n" + "\n".join(lower) + "\n"
        s = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        s[~self.is_letter[s]] = 0
        of = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
        of = np.concatenate(([0], of))
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        keep[0] = True
        s, of = s[keep], of[keep]
        code = (s[:-2] << 2 * _POINT_BITS) | (s[1:-1] << _POINT_BITS) | s[2:]
        middle = s[1:-1] > 0
        return of[1:-1][middle], code[middle]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        out, mask = 1, (1 << _POINT_BITS) - 1
        for shift in (2, 1, 0):
            points, at = np.unique((codes >> shift * _POINT_BITS) & mask, return_inverse=True)
            out = out * np.roll(self.letters(points), shift, axis=1)[at]
        return out

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the sum of the vectors of each text's sequences, how many it has)."""
        of, code = self.sequences(texts)
        seen, at = np.unique(code, return_inverse=True)
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        out = np.zeros((len(texts), 64 * len(self.salt)), np.float64)
        for begin in range(0, len(seen), SEQUENCES):
            width = min(SEQUENCES, len(seen) - begin)
            x, y = np.searchsorted(at, (begin, begin + width))
            counts = np.bincount(of[x:y] * width + at[x:y] - begin, minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ self.vectors(seen[begin : begin + width])
        return out, np.bincount(of, minlength=len(texts))


def _blocks(batches, column: int):
    for part in slices(batches, column, SLICE_BYTES):
        for at in range(0, part.num_rows, BLOCK):
            yield part.slice(at, BLOCK)


def learn(docs: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit vector of each language that ``lang`` names. Tasks send one vector per language they met."""

    def work(batches):
        own, sums = Profiles(dimensions), {}
        for part in _blocks(batches, 0):
            names = np.array(part.column(1).to_pylist(), object)
            vectors, total = own.bundles(part.column(0).to_pylist())
            for name in set(names[total > 0]):
                at = np.flatnonzero((names == name) & (total > 0))
                sums[name] = sums.get(name, 0) + (vectors[at] / total[at, None]).sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
            )

    taught = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang))
    parts = taught.mapInArrow(work, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.array([x["x"] for x in r["v"]])
        norm = np.linalg.norm(v)
        if norm > 0:
            out[r["lang"]] = np.round(v / norm, 7).astype(np.float32)
    return out


def identify(
    docs: DataFrame, taught: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, lang_pred, score, ``keep``): the nearest language of those learned where ``taught`` is true.

    ``score`` is the cosine with the language predicted, 0 if negative. A text that is null, empty
    or without a letter is ``und`` at 0, as is every text if there is nothing to learn from. Ties go
    to the first language by name. Repeated rows are scored each. The languages go to the tasks as
    one vector each.
    """
    profiles = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(taught), text, lang))

    def work(batches):
        own, names = Profiles(), sorted(profiles.value)
        matrix = np.array([profiles.value[n] for n in names])
        for part in _blocks(batches, 1):
            vectors, total = own.bundles(part.column(1).to_pylist())
            pred, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            some = np.flatnonzero(total) if names else []
            if len(some):
                v = vectors[some]
                norm = np.maximum(np.linalg.norm(v, axis=1), 1e-12)
                cosine = (v @ matrix.T) / norm[:, None]
                best = cosine.argmax(axis=1)
                score[some] = np.clip(cosine[np.arange(len(some)), best], 0, 1)
                for k, b in zip(some, best):
                    pred[k] = names[b]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(pred), pa.array(score), *(part.column(i) for i in range(2, 2 + len(keep)))],
                ["doc_id", "lang_pred", "score", *keep],
            )

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text), *keep).mapInArrow(
        work, "doc_id bigint, lang_pred string, score double" + kept
    )
