"""Conversation repair against a search over all edits, hard negatives against all pairs, token files against the library."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from leafline.llm import conversations, hard_negatives, queries, spread, token_files

BLANKS = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------------ conversations


def plain_report(rows):
    """gaps, faults, illegal steps, cost, audit and digest of one conversation: least (cost, audit) by a table over states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns = set(), []
    for turn, role, text in rows:
        body = text.rstrip(BLANKS)
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        turns.append((role, text, fault))
    known = {r[0] for r in rows if r[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # what may follow, by the last role

    def settle(table):
        while True:
            more = {}
            for state, (cost, audit, out) in table.items():
                to = "a" if state == "u" else "u"
                new = (cost + 3, audit + "I", out + [("user" if to == "u" else "assistant", "")])
                if all(new[:2] < known[to][:2] for known in (table, more) if to in known):
                    more[to] = new
            if not more:
                return table
            table |= more

    table = settle({"": (0, "", [])})
    for role, text, fault in turns:
        after = {}

        def offer(state, entry):
            if state not in after or entry[:2] < after[state][:2]:
                after[state] = entry

        for state, (cost, audit, out) in table.items():
            offer(state, (cost + 4, audit + "D", out))
            if fault in (1, 2):
                continue
            late = 3 if fault == 3 else 0
            if role[:1] in step[state]:
                offer(step[state][role[:1]], (cost + late, audit + "K", [*out, (role, text)]))
            to = "a" if state == "u" else "u"
            offer(to, (cost + late + 3, audit + "R", [*out, ("user" if to == "u" else "assistant", text)]))
        table = settle(after)
    cost, audit, out = min((table[s] for s in ("", "a") if s in table), key=lambda e: e[:2])
    faults = [sum(t[2] == k for t in turns) for k in (1, 2, 3)]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, part int, seq long, copies int, said string, fault string"


def conversation_rows(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["One.", "Two!", "cut", "", " \n", "Three?", "One.", "x" * 3000 + ".", "open ended", "Four. "]
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice([*texts, None])))
    rows += rows[::7]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"say {t % 50}.") for t in range(600)] + [(98, 1, "user", "same.")] * 40
    return [(*r, 1, 2, 3, "x", "y") for r in rows]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_repair_equals_the_table_over_all_edits(spark, parts):
    rows = conversation_rows(parts, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in conversations.report(conversations.repair(df, parts)).collect()}
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: plain_report(r) for conv, r in by.items()}


def test_audits_are_the_least_of_all_equal_costs(spark):
    rng, rows = random.Random(8), []
    for conv in range(400):
        rows += [(conv, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}"])) for t in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in conversations.report(conversations.repair(df, 16)).collect()}
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    assert got == {conv: plain_report(r)[5:7] for conv, r in by.items()}


def test_damage_drops_whole_conversations_and_an_empty_table_is_empty(spark, tmp_path):
    rows = [(i, 0, "user", "a.") for i in range(60)]
    gone = {i for i in range(60) if zlib.crc32(f"{i}:0".encode()) % 20 == 0}
    assert gone
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.QUERIES["op13_conversations"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60))
    assert all(got[i].audit == "" and got[i].cost == 0 and got[i].repaired_sha256 == hashlib.sha256(b"").hexdigest() for i in gone)
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.report(conversations.repair(none)).count() == 0


# ------------------------------------------------------------------ hard negatives


def plain_negatives(rows, positives=5, negatives=3):
    kept = [(i, label, [math.floor(256 * x) for x in v], anchor) for i, label, v, anchor, *_ in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, label, v, anchor) in enumerate(kept):
        if not anchor:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), -(10**30) if j is None else j, j, k != label) for n, (j, k, w, _) in enumerate(kept) if n != at), key=lambda s: s[:2])
        for score, _, p, _ in [s for s in scored if not s[3]][:positives]:
            fit = [s for s in scored if s[3] and 50 * -score <= 100 * -s[0] <= 95 * -score][:negatives]
            out += [(i, p, rank + 1, s[2], -score, -s[0]) for rank, s in enumerate(fit)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed,rows_of", [(1, 2048), (2, 7)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, seed, rows_of):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_of)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3 if rows_of < 100 else 256)
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(160):
        v = [c + rng.gauss(0, 0.7) for c in centre[i % 3]]
        rows.append((i, i % 4, v, i % 9 == 0))
    rows += [(500, None, [1.0] * 6, True), (501, 1, None, True), (502, 1, [1.0, float("nan")], True), (503, 2, [1.0, None], False), (504, 2, [float("inf")] * 6, True)]
    rows += [(505, 1, [0.0] * 6, True), (506, 2, [-0.0, 0.0], True), (507, 0, [], False), (None, 3, centre[0], False), (508, 2, centre[0][:3], True), (509, 1, [9000.0, 1.0, 0.0, 0.0, 0.0, 0.0], True)]
    rows += [rows[9], rows[9], rows[10], rows[18], (9, 3, rows[9][2], False), (9, rows[9][1], rows[9][2], False)]
    rows = [(*r, 7, "b", 1) for r in rows]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>, anchor boolean, block long, window string, copies int").repartition(4)
    got = hard_negatives.hard_negatives(df).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_negatives(rows)
    assert len(got) > 50
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    for scale in (1e-3, 1, 50):
        v = hard_negatives.integers(rng.normal(size=(200, 16)) * scale)
        v[:5] = v[5:10]
        v[10] = -v[11]
        norms = np.sqrt((v * v).sum(axis=1))
        angles = hard_negatives._angles(v, norms, [v[i] for i in range(12, 20)])
        block = hard_negatives._Block({"block": 0, "label": 0, "n": 200, "dim": 16, "ids": np.arange(200).tobytes(), "copies": np.ones(200, np.int64).tobytes(), "vecs": v.tobytes(), "norms": norms.tobytes(), "angles": angles.tobytes()})
        low, high = block.bounds(block)
        scores = v @ v.T
        assert (low <= scores).all() and (scores <= high).all()
        assert (high - low < 2 * norms[:, None] * norms[None, :]).mean() > 0.5 or scale < 1


def test_too_large_scores_are_an_error(spark):
    df = spark.createDataFrame([(0, 1, [1e30], True), (1, 1, [1e30], False)], "id long, label int, vector array<double>, anchor boolean")
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(df).collect()


# ------------------------------------------------------------------ token files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    bits = ["it's", "'ll", " ", "  ", "\n", "\r\n", "\t", " ", "　", "\x1c", "é", "中文", "12", "!?", "<|endoftext|>", "😀", "a", "word", " "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " ".join(f"w{i % 900}" for i in range(30_000))), (1003, "y" * 60_000), (1004, "\n\n \n"), (None, "no id"), (7, "again"), rows[7], rows[7]]
    return [(*r, 1, 2, 3, "h") for r in rows]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, texts, encoding):
    docs = spark.createDataFrame(texts, "doc_id long, text string, shard int, seq int, offset int, hash string").repartition(3)
    folder = spread.new_folder(spark, "test")
    token_files.write_tokens(docs, TOKENIZER, folder, encoding=encoding, page_rows=16)
    got = token_files.places(spark, folder, ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(TOKENIZER)
    want = sorted(repr((i, [*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, *_ in texts)
    assert sorted(repr((r.doc_id, list(r.ids))) for r in got) == want
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    sums = {(r.start): r.ids_crc32 for r in token_files.checksums(spark, folder).collect()}
    assert all(sums[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert [r.ids for r in token_files.tokens_of(spark, folder, [1002]).collect()] == [r.ids for r in got if r.doc_id == 1002]
    assert "ids" not in token_files.metadata(spark, folder).columns

    seen = 0
    for file in pq.ParquetDataset(folder.removeprefix("file:") + "/tokens").files:
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert ids.has_offset_index and columns["doc_id"].has_column_index
            assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
            assert "DELTA_BINARY_PACKED" in columns["seq"].encodings
            seen += 1
    assert seen


def test_small_row_groups_and_an_empty_table(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, shard int, seq int, offset int, hash string")
    folder = spread.new_folder(spark, "test")
    many = spark.range(8000).selectExpr("id AS doc_id", "concat('some words of ', id) AS text")
    token_files.write_tokens(many, TOKENIZER, folder, row_group_bytes=4096, page_bytes=1024, page_rows=8)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in pq.ParquetDataset(folder.removeprefix("file:") + "/tokens").files]
    assert max(groups) > 1
    none = spread.new_folder(spark, "test")
    token_files.write_tokens(docs.limit(0), TOKENIZER, none)
    assert token_files.checksums(spark, none).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, TOKENIZER, none, encoding="plain")
