"""Quality rules with host verdicts: rule failures by domain, shrunk with an empirical beta prior.

Defined results: a null or empty text has no words and fails the base rule; a
document without a host (null) stands alone, no host verdict touches it;
repeated rows are judged and counted each; an empty table gives an empty
result; extra columns are ignored (the verdicts carry only the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm import arrays as A
from leafline.llm.spread import few, keep, small_batches

MIN_WORDS = 10
REPEAT_PERCENT = 20  # most words in repeated windows, of 100 words
SYMBOL_PERCENT = 10  # most symbols, of 100 word characters
DUP_LINES_PERCENT = 30  # most repeated lines, of 100 lines with a word
WINDOW = 5
HOST_LIMIT = 0.5  # a host is rejected from this shrunk failure rate on
SALTS = 16
STRENGTH = (1.0, 1e6)  # bounds of the prior's weight in documents

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_COUNTS = ", ".join(f"{name} long" for name in _NAMES)


def _repeats(values: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the values (standing at ``at``) occur twice or more in their text."""
    text = np.searchsorted(first, at, "right").astype(np.uint64)
    order, runs = A.groups(A.mix(values + A.mix(text)))
    size = np.diff(np.append(runs, len(order)))
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(size > 1, size)
    return out


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """Per text: words, word characters, symbols, lines with a word, such lines equal to an earlier one, words in repeated windows."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for _, data, offsets in A.chunks(texts):
        starts, ends, first = A.words(data, offsets)
        sums = A.prefix(data)
        n_words = np.diff(first)
        win, at = A.windows(A.span(sums, starts, ends, data), first, WINDOW)
        repeated = np.zeros(len(starts), bool)
        repeated[at] = _repeats(win, at, first)
        breaks = np.flatnonzero(data == 10)
        low = np.unique(np.concatenate([offsets[:-1], breaks + 1])) if len(data) else np.zeros(0, np.int64)
        low = low[low < len(data)]
        high = np.append(low[1:], len(data))
        high = high - (data[high - 1] == 10)
        full = np.searchsorted(starts, high) > np.searchsorted(starts, low)
        low, high = low[full], high[full]
        lines = A.span(sums, low, high, data)
        before = np.searchsorted(low, offsets)
        text = A.owner(before).astype(np.uint64)
        order, runs = A.groups(A.mix(lines + A.mix(text)))
        again = np.ones(len(order), bool)
        again[order[runs]] = False
        for k, v in enumerate(
            (
                n_words,
                A.counts(((data & 0xC0) != 0x80) & ~A.SPACE[data], offsets),
                A.counts(_SYMBOL[data], offsets),
                np.diff(before),
                A.counts(again, before),
                A.counts(A.spread_on(repeated, WINDOW), first),
            )
        ):
            out[k].append(v)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _counted(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(x) for x in found]], [*columns, *_NAMES])

    return run


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules need, of every whole text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col(host).alias("host"), "text").mapInArrow(_counted(["doc_id", "host"]), f"doc_id long, host string, {_COUNTS}")


def rule_failures(counted: DataFrame) -> DataFrame:
    """Add base_failed and failed (any rule)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    other = (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINES_PERCENT * F.col("n_lines"))
    return counted.withColumn("base_failed", base).withColumn("failed", base | other)


def host_rates(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents, failures, the rate shrunk towards the mean of all hosts, and the verdict.

    The prior is a beta distribution fitted by moments to the hosts' rates
    (weighted by documents); its weight lies within ``STRENGTH``.
    """
    hosts = judged.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    sums = hosts.agg(F.sum("n").alias("all_n"), F.sum("f").alias("all_f"), F.sum(rate * F.col("f")).alias("square"))
    mean = F.col("all_f") / F.col("all_n")
    # sum of n * (rate - mean)**2 over all n
    spread = F.col("square") / F.col("all_n") - mean * mean
    weight = F.when(spread > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), mean * (1 - mean) / spread - 1))).otherwise(STRENGTH[1])
    prior = sums.select(mean.alias("mean"), weight.alias("weight"), F.lit(1).alias("one"))
    shrunk = (F.col("f") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    # one row of sums on one side; the key keeps it an equi-join
    return hosts.withColumn("one", F.lit(1)).join(prior, "one").select("host", "n", "f", shrunk.alias("rate"), (shrunk >= limit).alias("rejected"))


def host_quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base_failed and kept (neither the document nor its host rejected) for every document."""
    judged = keep(rule_failures(rule_counts(docs, host)))
    bad = keep(host_rates(judged, limit).filter("rejected").select("host", F.lit(True).alias("bad_host")))
    kept = ~F.col("base_failed") & F.col("bad_host").isNull()
    return _with_hosts(judged, bad).withColumn("kept", kept).drop("bad_host")


def _with_hosts(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows left-joined to the rejected hosts by host: by broadcast while these are few, else with a hot host's rows dealt to SALTS parts."""
    small = few(bad)
    if small is not bad:
        return rows.join(small, "host", "left")
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(salted, ["host", "salt"], "left").drop("salt")


def keep_quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents, with all their columns, that neither the base rule nor their host's verdict rejects.

    The texts are counted twice, once for the hosts and once for the filter, and never shuffled.
    """
    judged = rule_failures(rule_counts(docs, host))
    bad = keep(host_rates(judged, limit).filter("rejected").select("host", F.lit(True).alias("bad_host")))
    # the document's own columns travel as one, so that none clashes with a count
    packed = docs.select("doc_id", F.col(host).alias("host"), "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("own"))
    columns = ["doc_id", "host", "text", "own"]
    counted = packed.mapInArrow(_counted(columns), f"doc_id long, host string, text string, own {packed.schema['own'].dataType.simpleString()}, {_COUNTS}")
    kept = _with_hosts(rule_failures(counted), bad).filter("NOT base_failed AND bad_host IS NULL")
    return kept.select(*[(F.col("text") if c == "text" else F.col("own")[c]).alias(c) for c in docs.columns])
