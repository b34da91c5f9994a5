"""Personal data: base patterns, and contextual extraction bootstrapped from them, in DataFrame operations only.

Base spans are regular expressions with checks.  Their entities are seeds: the
word before a seed is a lexical pattern of context, and any word with a digit
or an at sign that stands in such a context is an instance.  Spark scores the
graph of patterns and instances in a few rounds, patterns by their share of
trusted instances in all places of the word and instances by their patterns;
what high-confidence
patterns hold, and is not a base span, is found as kind ``id``.

Expressions are written with possessive repeats and anchored starts, which
match the same and take time linear in the text.

Defined results: null and empty texts have no spans; repeated rows are searched
each and count each in the graph; a word at the start of a text has no context; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from leafline.llm.spread import keep

KINDS = ["email", "ip", "card", "phone", "id"]
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # a match starts where a run of its first class does, or where the last match ended
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_BLANK = r"\x20\x09-\x0D"
_TOKEN = rf"(?<![^{_BLANK}])[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+"
_TAIL = 64  # characters before an instance in which its context word is looked for

ROUNDS = 3
DOUBT = 2.0  # places without trust that every pattern is taken to have besides its own
SURE = 0.9  # least score of a pattern that discovers
SEEDS = 3  # least number of different seeds of such a pattern


def _pieces(text: Column, pattern: str, guard: str) -> Column:
    """Matches in order, each with the length of the text between it and the match before, and the end of that text."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.zip_with(
        found, F.slice(between, F.lit(1), F.size(found)),
        lambda m, b: F.struct(m.alias("match"), F.length(b).alias("gap"), F.substring(b, -_TAIL, _TAIL).alias("tail")),
    )
    return F.when(text.rlike(guard), each)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(part, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    card = F.length(digits).between(16, 19) & _luhn(F.substring(digits, 1, 19))
    return F.when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", F.length(digits).between(8, 15)).otherwise(True)


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """One row per match of the column ``name``: row, at, match, tail, start, end (code points, end exclusive)."""
    each = rows.filter(F.size(name) > 0).select("row", F.posexplode(name).alias("at", "m")).select("row", "at", "m.*")
    before = F.sum(F.col("gap") + F.length("match")).over(W.Window.partitionBy("row").orderBy("at"))
    return each.select("row", "at", "match", "tail", (before - F.length("match")).alias("start"), before.alias("end"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(context, total): how often each word, in lower case, stands in all texts."""
    words = docs.select(F.explode(F.split("text", rf"[{_BLANK}]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(F.lower("w").alias("context")).agg(F.sum("n").alias("total"))


def _scores(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(context, score, seeds) of patterns from edges (context, word, n, seed).

    A pattern's score is its trusted instances among all places of its word, so
    common words, which mostly come before anything else, score near zero.
    """
    trusted = edges.withColumn("trust", F.col("seed").cast("double"))
    scored = None
    for step in range(ROUNDS):
        sums = trusted.groupBy("context").agg(F.sum(F.col("n") * F.col("trust")).alias("trusted"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        scored = sums.join(totals, "context").select("context", (F.col("trusted") / (F.col("total") + DOUBT)).alias("score"), "seeds")
        if step == ROUNDS - 1:
            break
        # an instance is doubted as far as all of its patterns are
        doubt = edges.join(scored, "context").groupBy("word").agg(F.exp(F.sum(F.log1p(-F.col("score")))).alias("doubt"))
        trusted = edges.join(doubt, "word").withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(1 - F.col("doubt")))
    return scored


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, and spans: structs of kind number (see ``KINDS``), start and end, in that order."""
    text = F.col("text")
    searched = {kind: _pieces(text, pattern, GUARDS[kind]) for kind, pattern in PATTERNS.items()}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[c.alias(k) for k, c in searched.items()], _pieces(text, _TOKEN, "[0-9@]").alias("token"))
    # one pass over the texts; what is written is the matches
    rows = keep(rows)
    base = reduce(DataFrame.union, [_placed(rows, kind).select("row", F.lit(k).alias("kind"), F.lit(kind).alias("name"), "match", "start", "end") for k, kind in enumerate(PATTERNS)])
    base = keep(base.filter(_valid(F.col("name"), F.col("match"))).select("row", "kind", "start", "end"))

    word = F.regexp_replace("match", r"[.,;:!?)\]}>\"']+$", "")
    context = F.lower(F.regexp_extract("tail", rf"([^{_BLANK}]+)[{_BLANK}]*$", 1))
    tokens = _placed(rows, "token").select("row", "start", F.when(context == "", "^").otherwise(context).alias("context"), word.alias("word")).filter(F.length("word") > 2)
    tokens = tokens.withColumn("end", F.col("start") + F.length("word"))
    # spans and tokens of a row in one order: a token is a seed if a base span begins before its end and ends after its start
    span = base.select("row", F.col("start").alias("at"), F.col("end").alias("reach"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("word"))
    token = tokens.select("row", F.col("start").alias("at"), F.col("end").alias("reach"), "context", "word")
    line = W.Window.partitionBy("row").orderBy("at", F.col("word").isNotNull())
    ended = F.max(F.when(F.col("word").isNull(), F.col("reach"))).over(line)
    following = F.min(F.when(F.col("word").isNull(), F.col("at"))).over(line.rowsBetween(1, W.Window.unboundedFollowing))
    marked = span.union(token).withColumn("seed", F.coalesce(ended > F.col("at"), F.lit(False)) | F.coalesce(following < F.col("reach"), F.lit(False)))
    marked = keep(marked.filter("word IS NOT NULL"))

    edges = keep(marked.filter("context != '^'").groupBy("context", "word").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    totals = keep(word_counts(docs).join(edges.select("context").distinct(), "context", "left_semi"))
    good = _scores(edges, totals).filter((F.col("score") >= SURE) & (F.col("seeds") >= SEEDS)).select("context")
    more = marked.filter("NOT seed").join(good, "context", "left_semi").select("row", F.lit(KINDS.index("id")).alias("kind"), F.col("at").alias("start"), F.col("reach").alias("end"))

    spans = base.union(more).select("row", F.lit(None).cast("long").alias("doc_id"), F.struct(F.col("kind").cast("int").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("span"))
    every = rows.select("row", "doc_id", F.lit(None).cast(spans.schema["span"].dataType).alias("span"))
    found = every.union(spans).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list("span")).alias("spans"))
    return found.select("doc_id", *[_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], "spans")


def _count(kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
