"""The registered queries of the package against their SQL, and the pipeline against a plain version."""

import re
import sys
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import corpus_pipeline  # noqa: E402
from compare import bag, connect  # noqa: E402

from leafline.llm import bpe, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = queries.ORACLES.get(name)
    if sql is None:
        assert rows or name == "op1_templates"
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(rows, df.columns) == bag(cursor.fetchall(), names)


def test_pipeline(spark, tmp_path):
    rows = [r[:5] for r in brute.table(21, 80)]
    item = "Whoever counts the apples of the old garden in the morning finds fewer of them at night."
    rows.append((500, " ".join(brute.prose(__import__("random").Random(1), 30)) + " " + item + " and more", "en", "s1", 9))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, kept_columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))

    bad = brute.bad_hosts(rows)
    left = [r for r in rows if not brute.base_failed(brute.rule_counts(r[1])) and r[3] not in bad]
    left = [(a[0], b[3]) for a, b in zip(left, brute.line_dedup(left))]
    stays = {i for i, _, c in brute.near(left, 5) if i == c}
    left = [r for r in left if r[0] in stays or r[0] is None]
    words = lambda t: re.findall(r"\w+", t.lower())
    eights = lambda t: {tuple(words(t)[i : i + 8]) for i in range(len(words(t)) - 7)}
    left = [r for r in left if len(eights(r[1]) & eights(item)) < 5]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    want = sorted(repr((i, np.array(encoding.encode_ordinary(t), np.uint32).tobytes(), t.encode())) for i, t in left)
    assert 500 not in {i for i, _ in left} and len(want) > 20
    assert sorted(repr((r.doc_id, bytes(r.ids), bytes(r.decoded))) for r in docs.collect()) == want
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(i or -1 for i, _ in left)
