"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits; per bit a linear classifier (naive
Bayes, log odds of hashed n-grams) predicts on which side a text is.  Decoding
chooses the codeword of the least weighted loss and flags ambiguity when the
runner-up is close.  Counting covers every learning row; the model is a table
of buckets times bits, whatever the size of the corpus.

Defined results: null texts and texts without a letter are ``und`` with score
0 and not ambiguous; rows of null language are never learned from; without any
learning row all texts are ``und``; equal texts get equal predictions; ties
go to the language that sorts first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import arrays as A
from leafline.llm.spread import small_batches

BUCKETS = 1 << 15
SMOOTHING = 0.5
AMBIGUOUS = 0.2  # the least lead of the best codeword over the next, in units of loss
EXHAUSTIVE = 6  # languages up to which all splits in two are used as bits


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # weight of each bit in decoding


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte pairs and triples (A-Z lowered, digits and white space as one), and the text of each."""
    text = A.LOWER[data]
    text = np.where((data >= 48) & (data <= 57) | A.SPACE[data], np.uint8(32), text).astype(np.uint32)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    pair = text[:-1] << np.uint32(8) | text[1:]
    triple = pair[:-1] << np.uint32(8) | text[2:] | np.uint32(1 << 24)
    grams = np.concatenate([pair, triple]) * np.uint32(2654435769) >> np.uint32(17)
    same = np.concatenate([of[1:] == of[:-1], of[2:] == of[:-2]])
    return grams[same], np.concatenate([of[:-1], of[:-2]])[same]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for row, data, offsets in A.chunks(batch.column("text")):
            names, of = np.unique(langs[row : row + len(offsets) - 1].astype(str), return_inverse=True)
            grams, text = _grams(data, offsets)
            table = np.bincount(of[text].astype(np.int64) * BUCKETS + grams, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row_ in zip(names, table):
                total[name] = total.get(name, 0) + row_
    for name, table in total.items():
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used.astype(np.int32)), pa.array(table[used].astype(np.int64))], ["lang", "bucket", "n"])


def codewords(k: int) -> np.ndarray:
    """Codewords of k languages: all splits in two while there are few, else fixed pseudo-random bits, kept apart."""
    if k <= EXHAUSTIVE:
        bits = [[1 if j == 0 or (split >> (j - 1)) & 1 == 0 else -1 for j in range(k)] for split in range(1, 1 << max(0, k - 1))]
        return np.array(bits, np.int8).T.reshape(k, -1)
    n = math.ceil(10 * math.log2(k))
    rng = np.random.Generator(np.random.PCG64(7))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, n))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        least = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


def fit(learn: DataFrame) -> Codes | None:
    """Learn from the columns text and lang; what comes to the driver is one count per language and bucket."""
    small_batches(learn.sparkSession)
    learn = learn.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = learn.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    names, of = np.unique(np.array(rows.column("lang").to_pylist()), return_inverse=True)
    table = np.zeros((len(names), BUCKETS))
    table[of, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    share = table / np.maximum(table.sum(axis=1, keepdims=True), 1)  # languages weigh the same, however many rows they have
    code = codewords(len(names))
    floor = SMOOTHING / max(1.0, table.sum() / len(names))
    weights = np.empty((BUCKETS, code.shape[1]), np.float32)
    trust = np.empty(code.shape[1])
    for b in range(code.shape[1]):
        one, other = share[code[:, b] > 0].mean(axis=0) + floor, share[code[:, b] < 0].mean(axis=0) + floor
        odds = np.log(one) - np.log(other)
        weights[:, b] = odds
        trust[b] = ((one - other) * odds).sum()  # how far apart the two sides are
    return Codes([str(x) for x in names], code, weights, trust / max(trust.sum(), 1e-12) if len(trust) else trust)


def decode(codes: Codes, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: index of the language, score and ambiguity, from the mean log odds of each bit."""
    if codes.code.shape[1] == 0:  # one language only
        n = len(margins)
        return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
    # logistic loss of each bit against each codeword, weighted by the bit's trust
    agree = margins[:, None, :] * codes.code[None, :, :]
    loss = (np.logaddexp(0, -8 * agree) * codes.trust).sum(axis=2)
    best = loss.argmin(axis=1)
    near = np.partition(loss, 1, axis=1)
    likely = np.exp(near[:, :1] - loss)
    return best, 1 / likely.sum(axis=1), near[:, 1] - near[:, 0] < AMBIGUOUS


def predict(docs: DataFrame, codes: Codes | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            names, scores, flags = [], [], []
            for row, data, offsets in A.chunks(texts):
                n = len(offsets) - 1
                letter = ((data | 32) >= 97) & ((data | 32) <= 122)
                known = A.counts(letter, offsets) > 0
                for i in np.flatnonzero(~known & (A.counts(data > 127, offsets) > 0)):
                    known[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
                if codes is None:
                    best, score, flag, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
                else:
                    grams, text = _grams(data, offsets)
                    have = np.bincount(text, minlength=n)
                    bits = range(codes.code.shape[1])
                    margins = np.stack([np.bincount(text, codes.weights[:, b][grams], n) / np.maximum(have, 1) for b in bits], axis=1) if len(bits) else np.zeros((n, 0))
                    best, score, flag = decode(codes, margins)
                names += [codes.languages[b] if k else "und" for b, k in zip(best, known)]
                scores.append(np.where(known, score, 0.0))
                flags.append(flag & known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)])), pa.array(np.concatenate(flags or [np.zeros(0, bool)]))],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Add held_out: the crc32 of the id's text is divisible by ``folds``; a null id is held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True)))
