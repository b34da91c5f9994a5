"""Encoding, language, host rules, personal data, urls and decontamination."""

import random
import re

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafline.llm import bpe, decontaminate, host_rules, language, mph, pii, sketch, urls
from leafline.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.table(), brute.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    table = mph.PerfectHash(keys)
    assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
    assert mph.PerfectHash(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]


@given(st.lists(st.integers(0, 2**30), max_size=50), st.sampled_from([2, 3]))
def test_packed_steps_round_trip(values, width):
    values = np.array(sorted(values), np.int64)
    assert sketch.unpack_sorted(sketch.pack_sorted(values, width), width).tolist() == values.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zé", "'", "'s", "'ll", "re", " ", "  ", "\n", "\t ", "7", "²", "中", "?!", "🙂", "\x1c", " ", "don't"]), max_size=30))
def test_pre_tokens_are_those_of_the_library(encoding, parts):
    text = "".join(parts)
    vocabulary = bpe._vocabularies.setdefault("test", bpe.Vocabulary(bpe.read_ranks(PATH)))
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _ = vocabulary.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == encoding.encode_ordinary(text)


def test_encode_and_decode(docs, none, encoding):
    coded = bpe.encode(docs, PATH)
    got = {(r.doc_id, bytes(r.ids)) for r in coded.collect()}
    assert got == {(r[0], np.array(encoding.encode_ordinary(r[1] or ""), np.uint32).tobytes()) for r in brute.table()}
    back = sorted(repr((r.doc_id, bytes(r.decoded))) for r in bpe.decode(coded, PATH).collect())
    assert back == sorted(repr((r[0], (r[1] or "").encode())) for r in brute.table())
    assert bpe.encode(none, PATH, decoded=True).count() == 0


def test_host_rules(docs, none):
    rows = brute.table()
    got = host_rules.host_quality(docs)
    bad = brute.bad_hosts(rows)
    want = []
    for r in rows:
        c = brute.rule_counts(r[1])
        want.append((r[0], *c, brute.base_failed(c), not brute.base_failed(c) and r[3] not in bad))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want))
    kept = host_rules.keep_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(w[0]) for w in want if w[-1])
    assert host_rules.host_quality(none).count() == 0 and host_rules.keep_quality(none).count() == 0


def test_a_failing_host_is_rejected_and_a_small_one_is_not(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "# # # # # " * 4 + good[:20] if i % 20 else good, None, "bad") for i in range(60)]
    rows += [(100 + i, good + f" {i}", None, f"good{i % 3}") for i in range(300)] + [(900, "###### #" * 9, None, "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rates = {r.host: r for r in host_rules.host_rates(host_rules.rule_failures(host_rules.rule_counts(docs))).collect()}
    assert rates["bad"].rejected and not rates["good1"].rejected
    assert rates["new"].f == 1 and rates["new"].rate < 1  # one failure says less of a host than many
    assert brute.bad_hosts([(r[0], r[1], r[2], r[3]) for r in rows]) == {h for h, r in rates.items() if r.rejected}


def test_language(spark, none):
    docs = language.held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    codes = language.fit(docs.filter("NOT held_out"))
    assert len(codes.languages) == 4 and codes.code.shape == (4, 7)
    pairs = docs.filter("held_out").select("doc_id", "lang").join(language.predict(docs, codes), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in pairs]) > 0.97
    assert all(0 <= r.score <= 1 for r in pairs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "é"), (5, "中文"), (6, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(odd, codes).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].score == 0 for i in (1, 2, 3))
    assert all(got[i].lang_pred in codes.languages for i in (4, 5, 6))
    assert language.fit(none) is None and language.predict(none, None).count() == 0
    one = language.fit(spark.createDataFrame([("abc", "xx")], "text string, lang string"))
    assert {r.lang_pred for r in language.predict(odd.filter("doc_id > 3"), one).collect()} == {"xx"}


@pytest.mark.parametrize("k", [2, 5, 7, 30])
def test_codewords_are_apart(k):
    code = language.codewords(k)
    assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (1 if k == 2 else 3)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((pii.KINDS.index(kind), m.start(), m.end()))
    return out


def test_personal_data(spark, none):
    rng = random.Random(3)
    bits = ["a@b.co", "x.y@", "@z.io", "a@b.c_d@e.fg", "1.2.3.4", "300.1.1.1", "001.02.3.255.9", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+12", "é", " ", " ", "-", "5", "12 34", ".", "\n", "word"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(900, None), (901, ""), (902, "a" * 150_000), (903, "1 2 " * 40_000), (904, "1.2.3.4"), (904, "1.2.3.4")]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted(repr((i, base_spans(t))) for i, t in rows)
    assert sorted(repr((r.doc_id, [tuple(s) for s in r.spans if s.kind < 4])) for r in got) == want
    assert pii.find_personal_data(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words before contact: user{i}@mail.example and the end of {i % 7} things") for i in range(60)]
    rows += [(100, "please contact: AB-77-XK9, thanks"), (101, "the 1999 things of 12345678")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[100].spans] == [(4, 16, 25)] and got[100].n_id == 1
    assert got[101].spans == [] and got[5].n_email == 1 and got[5].n_id == 0


def test_urls(spark):
    page = lambda link: f'<html><head><link rel="canonical" href="{link}"></head></html>'
    refresh = lambda link: f"<meta http-equiv=refresh content='0; url={link}'>"
    rows = [
        (1, "https://Mirror.example.org/a?x=1#f", page("https://ads.bad.net/x")), (2, "http://other.example.org/b", refresh("//mirror.example.org/a?x=1")),
        (3, "http://fine.example.org/c", page("/d")), (4, "http://ads.bad.net/x", None), (5, None, page("http://a.net/")), (6, "no scheme", ""), (7, "http://x.example.net/en/1", None),
        (8, "http://m.example.org/e", page("http://y.example.net/en/2")), (9, "http://n.example.org/e", page("http://y.example.net/en/2")), (10, "http://n.example.org/e", refresh("http://z.net/q")),
        (11, "http://example.org", None), (12, "http://ok.org/fr/1", None), (13, "http://notnet/", None), (1, "https://Mirror.example.org/a?x=1#f", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS node", "3 AS root")
    rules = urls.rule_table(spark, [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")])
    got = {(r.page_id, r.verdict): r for r in urls.filter_urls(pages, rules).collect()}
    assert {k for k in got} == {
        (1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (9, "allow"), (10, "allow"), (11, "allow"), (12, "allow"), (13, "allow")
    }
    assert (got[1, "block"].host, got[1, "block"].path, got[1, "block"].rule) == ("mirror.example.org", "/a", None)
    assert got[7, "allow"].rule == "example.net/en/" and got[4, "block"].rule == "net/" and got[11, "allow"].path == "" and got[5, "allow"].host == ""
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 140)}, 200: 200, 201: 200}


def test_decontamination(spark, none):
    item = "A train travels from Paris to Lyon at 120 km per hour and arrives after 3 hours, how far apart are Paris and Lyon in total?"
    items = [(1, item), (2, "plain words only here that make a longer item of some twelve words"), (3, None), (4, "too short"), (2, "plain words only here that make a longer item of some twelve words")]
    moved = item.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "90").replace("3", "5")
    rows = [
        (1, f"Filler before it. {moved} and after"), (2, moved.replace("are Rome and Milan", "are Pisa and Rome")), (3, "x PLAIN words, only here that make a longer item of some twelve words y"),
        (4, None), (5, ""), (6, "nothing of this kind stands here at all as anyone who reads it can see"), (7, item), (7, item), (8, "plain words only here that make a longer thing"), (None, item),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS copy", "2 AS item_id", "3 AS words")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, table).collect()}
    assert got == {(1, 1, "reparameterised"), (3, 2, "exact"), (7, 1, "exact")}
    clean = decontaminate.without_contaminated(docs, table)
    assert clean.columns == docs.columns and sorted(repr(r.doc_id) for r in clean.collect()) == ["2", "4", "5", "6", "8"]
    assert decontaminate.contaminated(docs.limit(0), table).count() == 0 and decontaminate.contaminated(docs, table.limit(0)).count() == 0


def test_short_and_slot_dense_items_are_found(spark):
    items = [
        (1, "Tom has 5 apples, Ann has 7 kg"), (2, "What is the capital of France?"), (3, "Who was Napoleon?"), (4, "3 + 4 ="), (5, "Der Hund sieht 3 Katzen, 4 Vögel, 5 Mäuse, 6 Pferde und 7 Kühe"),
        (6, "Which of these old bridges was built first"), (7, "..."), (8, ""), (9, "1 2 3 4 5 6 7 8 9 10"), (10, "Whoever counts red apples in this old garden finds fewer"),
    ]
    rows = [
        (1, "Well, he said Tom has 5 apples, Ann has 7 kg of them"), (2, "here Tom has 9 apples, Eve has 2 kg of them"), (3, "here Tom has 9 pears, Eve has 2 kg of them"), (4, "so: What is the capital of France?"),
        (5, "he asked What is the capital of Spain, and why"), (6, "who was Napoleon"), (7, "Who was Wellington?"), (8, "see 3 + 4 = 7"), (9, "see 3 - 4 = 7"),
        (10, "dass Der Hund sieht 3 Katzen, 4 Vögel, 5 Mäuse, 6 Pferde und 7 Kühe gern"), (11, "we ask, Which of these old bridges was built first"), (12, "x 0 1 2 3 4 5 6 7 8 9 10 11"), (13, "x 2 3 4 5 6 7 8 9 10 11 12"),
        (14, "today Whoever counts red apples in this old garden finds fewer"), (15, "here Tom has 9 apples, Eve has 9 kg of them"), (16, "..."), (17, "Tom has 5 apples"), (18, None),
    ]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, table).collect()}
    again = "reparameterised"
    assert got == {(1, 1, "exact"), (2, 1, again), (4, 2, "exact"), (5, 2, again), (6, 3, "exact"), (8, 4, "exact"), (10, 5, "exact"), (11, 6, "exact"), (12, 9, "exact"), (14, 10, "exact")}
    clean = decontaminate.without_contaminated(docs, table)
    assert {r.doc_id for r in clean.collect()} == {3, 7, 9, 13, 15, 16, 17, 18}
