"""Strings that agree in every ring of 2**64: doubled strings of any length, against the plain versions."""

import brute
import public_tokenizers
import pytest

from leafline.llm import bpe, host_rules, line_dedup, minhash, substring


def doubled(n):
    """Two different strings of 2**n characters that a polynomial over such a ring cannot tell apart."""
    a, b = "ab", "ba"
    for _ in range(n - 1):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def rows():
    out = []
    for n in (9, 10, 12, 16):
        a, b = doubled(n)
        words = " ".join(["w" + a] * 3 + ["tail", "of", "it"])
        out += [a, b, a + "\nshort", b + "\nother", f"{a}\n{b}\n{a}", words, words.replace(a, b), " ".join(a if i % 2 else f"v{i}" for i in range(60 if n < 12 else 12)), " ".join(b if i % 2 else f"v{i}" for i in range(60 if n < 12 else 12))]
    return [(i, t, "en", f"s{i % 3}", 1, *[None] * 7) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3)


def bag(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_lines_windows_and_links(docs, rows):
    assert bag(line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == bag(brute.line_dedup(rows))
    assert bag(substring.dedup_substrings(docs, 50).select("doc_id", "n_words", "n_removed", "kept_text").collect()) == bag(brute.substrings(rows, 50))
    assert bag(minhash.near_duplicates(docs, 4).select("doc_id", "n_shingles", "component_id").collect()) == bag(brute.near(rows, 4))


def test_counts(docs, rows):
    got = host_rules.host_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    want = [(r[0], c[0], c[1], c[2], c[4], c[5]) for r in rows for c in [brute.rule_counts(r[1])]]
    assert bag(got) == bag(want)


def test_ids_come_back(docs, rows):
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    assert sorted((r.doc_id, bytes(r.decoded)) for r in coded.collect()) == sorted((r[0], r[1].encode()) for r in rows)
