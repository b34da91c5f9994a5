"""Benchmark decontamination by templates, in DataFrame operations only.

Words of texts and benchmark items become templates: numbers, names and units
of measure turn into typed placeholders, case and punctuation go.  Windows of
template words are hash-joined with those of the items.  Matches that lie on
one line (same distance between document and item) are an occurrence; its
slots are consistent if every value of the item stands for one value in the
document and the other way round.  So a question with other numbers or names
is caught, and a mere likeness of form is not.

An item without a usable window, because it is short or dense in slots, is
looked for as a whole: at one place all of its template words must agree and
its slots be consistent.  If it has too few literals for that, its text must
stand there word for word (case and outer punctuation aside).  The first word
of an item may be a name or a unit in the document only because of the word
before it, so it is matched as a literal and as a placeholder.

Defined results: null and empty texts and items match nothing; windows with
fewer than ``LITERALS`` words besides placeholders are not used; repeated rows
of one document are one document; repeated items of one id are one item; empty
tables give an empty result; extra columns are ignored.  Rows without a doc_id
are not in the result, which names documents by it; where clean documents are
kept they are judged by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.spread import few, keep

WINDOW = 8
LITERALS = 5
LEAST = 5  # different windows of an item (or all it has) that a document must hold

NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
_BLANK = r"\x20\x09-\x0D"
# units of measure, money and time
_UNITS = (
    "mm|cm|m|km|metres?|meters?|kilometres?|kilometers?|inch|inches|feet|foot|yards?|miles?|mg|g|kg|grams?|kilograms?|tons?|tonnes?|ounces?|pounds?|lbs?|ml|cl|l|litres?|liters?|gallons?|"
    "seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|mph|kmh|watts?|volts?|joules?|newtons?"
)


def _template(text: Column) -> Column:
    """The text with placeholders for numbers, names and units; the words stay apart as they were."""
    # placeholders that a text holds by itself go first
    text = F.regexp_replace(text, "[\u0001-\u0003]", "")
    # a name: a capital word right after a word of the same sentence
    text = F.regexp_replace(text, rf"(?<=[\p{{Ll}},;][{_BLANK}])\p{{Lu}}[\p{{L}}'-]*+", NAME)
    text = F.regexp_replace(text, r"[0-9]++(?:[.,:/][0-9]++)*+", NUMBER)
    text = F.regexp_replace(text, rf"(?<={NUMBER}[\x20]?)(?i:{_UNITS})(?![\p{{L}}])", UNIT)
    return F.lower(F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}\u0001-\u0003{_BLANK}]++", ""))


def _template_words(text: Column) -> Column:
    """The template words of a text that are not empty."""
    return F.filter(F.split(_template(text), f"[{_BLANK}]+"), lambda w: w != "")


def _slot_values(text: Column) -> Column:
    """For each template word the word it was made of (lower case, ends trimmed), null if it is none."""
    raw = F.split(text, f"[{_BLANK}]+")
    pairs = F.zip_with(raw, F.split(_template(text), f"[{_BLANK}]+"), lambda r, t: F.struct(r.alias("r"), t.alias("t")))
    value = lambda p: F.when(p["t"].rlike("[\u0001-\u0003]"), F.regexp_replace(F.lower(p["r"]), r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""))
    return F.transform(F.filter(pairs, lambda p: p["t"] != ""), value)


def _plain_words(text: Column) -> Column:
    """The words in lower case without punctuation at their ends; words of punctuation alone as they are."""
    ends = r"^(?:(?!-[0-9])[^\p{L}\p{M}\p{N}\p{S}])+|[^\p{L}\p{M}\p{N}\p{S}%]+$"
    bare = lambda w: F.regexp_replace(w, ends, "")
    return F.transform(F.filter(F.split(F.lower(text), f"[{_BLANK}]+"), lambda w: w != ""), lambda w: F.when(bare(w) == "", w).otherwise(bare(w)))


def _literal(word: Column) -> Column:
    return ~word.rlike("[\u0001-\u0003]")


def _forms(text: Column) -> Column:
    """words and slots of an item as it stands, after a lower-case word, and after a number; only the first word changes."""
    text = F.regexp_replace(text, f"^[{_BLANK}]+", "")
    after = [F.struct(_template_words(text).alias("words"), _slot_values(text).alias("slots"))]
    for lead in ("a ", "1 "):
        t = F.concat(F.lit(lead), text)
        tail = lambda c: F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1))
        after.append(F.struct(tail(_template_words(t)).alias("words"), tail(_slot_values(t)).alias("slots")))
    return F.array_distinct(F.array(*after))


def _words(rows: DataFrame) -> DataFrame:
    """Add words: the template words of text that are not empty."""
    return rows.withColumn("words", _template_words(F.col("text")))


def _slots(rows: DataFrame) -> DataFrame:
    """Add slots: for each template word the word it was made of, null if it is none."""
    return rows.withColumn("slots", _slot_values(F.col("text")))


def _windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, window): the hashed windows of the template words."""
    n = F.size("words")
    hashed = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    return _words(rows).filter(n >= WINDOW).select(*keys, F.posexplode(hashed).alias("at", "window"))


def _whole_items(items: DataFrame) -> DataFrame:
    """(item_id, form, exact, words, slots, anchor, width): items without a usable window, each with up to WINDOW words to be joined by."""
    literals, n = F.size(F.filter("words", _literal)), F.size("words")
    exact = (literals < LITERALS) & ((n < WINDOW) | (3 * literals < n))
    items = items.select("item_id", "text", "forms", exact.alias("exact"))
    plain = F.struct(_plain_words(F.col("text")).alias("words"), F.array().cast("array<string>").alias("slots"))
    items = items.select("item_id", "exact", F.posexplode(F.when(F.col("exact"), F.array(plain)).otherwise(F.col("forms"))).alias("form", "f")).select("item_id", "exact", "form", "f.*")
    width = F.least(F.size("words"), F.lit(WINDOW))
    # the window with the most literals, or different words, joins the fewest documents
    weight = lambda w: F.when(F.col("exact"), F.size(F.array_distinct(w))).otherwise(F.size(F.filter(w, _literal)))
    anchors = F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.struct(weight(F.slice("words", i, width)).alias("weight"), (i - 1).alias("at")))
    return items.select("*", F.array_max(anchors)["at"].alias("anchor"), width.alias("width"))


def _hold_whole(keyed: DataFrame, whole: DataFrame, lengths: list[tuple[bool, int]]) -> DataFrame:
    """The result rows of items that are looked for as a whole; ``lengths`` are their different (exact, width)."""
    parts = {False: _template_words(F.col("text")), True: _plain_words(F.col("text"))}

    def hashed(exact: bool, width: int) -> Column:
        words = F.col("plain" if exact else "words")
        starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(exact).alias("exact"), (i - 1).alias("at"), F.xxhash64(F.slice(words, i, width)).alias("key")))

    split = keyed
    for exact in {e for e, _ in lengths}:
        split = split.withColumn("plain" if exact else "words", parts[exact])
    keys = keep(whole.select("item_id", "form", "exact", "anchor", F.size("words").alias("n"), F.xxhash64(F.slice("words", F.col("anchor") + 1, F.col("width"))).alias("key")))
    hits = split.select("doc_id", "copy", F.inline(F.flatten(F.array(*[hashed(e, w) for e, w in sorted(lengths)])))).join(few(keys), ["exact", "key"])
    hits = hits.select("doc_id", "copy", "item_id", "form", "exact", (F.col("at") - F.col("anchor")).alias("start"), "n").filter("start >= 0")
    hits = keep(hits.distinct())
    # a document once, with all its hits: what goes on are pieces of an item's length
    texts = keyed.join(few(hits.select("doc_id", "copy").distinct()), ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
    texts = texts.withColumn("words", parts[False]).withColumn("plain", parts[True]).withColumn("values", _slot_values(F.col("text")))
    texts = texts.join(hits.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("item_id", "form", "exact", "start", "n")).alias("hits")), ["doc_id", "copy"])
    piece = lambda h, c: F.slice(F.col(c), h["start"] + 1, h["n"])
    pieces = F.transform(
        "hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["form"].alias("form"), F.when(h["exact"], piece(h, "plain")).otherwise(piece(h, "words")).alias("found"), piece(h, "values").alias("others"))
    )
    met = texts.select("doc_id", F.inline(pieces)).join(whole.select("item_id", "form", "exact", "words", "slots"), ["item_id", "form"]).filter("found = words")
    pairs = F.when(F.col("exact"), F.array().cast("array<struct<v:string,o:string>>")).otherwise(
        F.filter(F.zip_with("slots", "others", lambda v, o: F.struct(v.alias("v"), F.coalesce(o, F.lit("")).alias("o"))), lambda p: p["v"].isNotNull())
    )
    met = met.select("doc_id", "item_id", pairs.alias("pairs"))
    count = lambda c: F.size(F.array_distinct(c))
    met = met.filter((count("pairs") == count("pairs.v")) & (count("pairs") == count("pairs.o")))
    sums = met.groupBy("doc_id", "item_id").agg(F.min(F.exists("pairs", lambda p: p["v"] != p["o"])).alias("differs"))
    one = F.lit(1).cast("long")
    return sums.select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_item_windows"), F.when(F.col("differs"), "reparameterised").otherwise("exact").alias("kind"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, kind) of every document that holds an item.

    ``kind``: exact, or reparameterised if values of slots differ consistently.
    ``items`` has item_id and text.
    """
    items = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))
    items = keep(items.select("item_id", "text", _forms(F.col("text")).alias("forms")).withColumn("words", F.col("forms")[0]["words"]).filter(F.size("words") > 0))
    n = F.size("words")
    literal = F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1),
        lambda i: F.struct(F.xxhash64(F.slice("words", i, WINDOW)).alias("window"), F.size(F.filter(F.slice("words", i, WINDOW), _literal)).alias("literals")),
    )
    wanted = items.filter(n >= WINDOW).select("item_id", "forms", F.posexplode(literal).alias("item_at", "w")).filter(F.col("w.literals") >= LITERALS)
    opening = F.array_distinct(F.transform("forms", lambda f: F.xxhash64(F.slice(f["words"], 1, WINDOW))))
    wanted = keep(wanted.select("item_id", "item_at", F.explode(F.when(F.col("item_at") == 0, opening).otherwise(F.array("w.window"))).alias("window")))
    sizes = wanted.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_item_windows"))

    keyed = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("copy", F.xxhash64("text"))
    found = _windows(keyed, ["doc_id", "copy"]).join(few(wanted), "window")
    found = keep(found.select("doc_id", "copy", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift")).distinct())

    # slots of the item that its matched windows cover, next to what the document has there
    # the first word is a slot only in some forms of the item (loose): then only if it is one in the document
    opens = F.get(F.filter(F.transform("forms", lambda f: F.get(f["slots"], 0)), lambda v: v.isNotNull()), 0)
    values = items.select("item_id", opens.alias("opens"), F.posexplode(F.col("forms")[0]["slots"]).alias("place", "own"))
    values = values.withColumn("value", F.when(F.col("place") == 0, F.col("opens")).otherwise(F.col("own"))).filter("value IS NOT NULL")
    values = values.select("item_id", "place", "value", F.col("own").isNull().alias("loose"))
    covered = found.withColumn("place", F.explode(F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.col("item_at") + k)))
    met = covered.select("doc_id", "copy", "item_id", "shift", "place").distinct().join(values, ["item_id", "place"])
    met = keep(met)
    texts = _slots(keyed.join(few(met.select("doc_id").distinct()), "doc_id", "left_semi")).select("doc_id", "copy", "slots")
    both = met.join(texts.dropDuplicates(["doc_id", "copy"]), ["doc_id", "copy"])
    both = both.withColumn("there", F.get("slots", F.col("place") + F.col("shift"))).filter("NOT loose OR there IS NOT NULL").withColumn("there", F.coalesce("there", F.lit("")))
    line = ["doc_id", "copy", "item_id", "shift"]
    slots = both.groupBy(*line).agg(
        F.count_distinct("value").alias("here"), F.count_distinct("there").alias("others"), F.count_distinct(F.struct("value", "there")).alias("pairs"), F.max(F.col("value") != F.col("there")).alias("differs")
    )
    judged = found.join(slots, line, "left").filter("here IS NULL OR (here = pairs AND others = pairs)")
    sums = judged.groupBy("doc_id", "item_id").agg(F.count_distinct("item_at").alias("n_windows"), F.min(F.coalesce("differs", F.lit(False))).alias("differs"))
    sums = sums.join(sizes, "item_id").filter(F.col("n_windows") >= F.least(F.lit(LEAST), F.col("n_item_windows")))
    sums = sums.select("doc_id", "item_id", "n_windows", "n_item_windows", F.when(F.col("differs"), "reparameterised").otherwise("exact").alias("kind"))
    whole = keep(_whole_items(items.join(wanted.select("item_id").distinct(), "item_id", "left_anti")))
    lengths = [(r.exact, r.width) for r in whole.select("exact", "width").distinct().collect()]
    return sums.unionByName(_hold_whole(keyed, whole, lengths)) if lengths else sums


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no item; those without a doc_id are told apart by their texts."""
    own = F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    key = F.coalesce(own, F.concat(F.lit("t"), F.sha2("text", 256)))
    held = keep(contaminated(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_holder")).distinct())
    return docs.join(few(held), key == F.col("_holder"), "left_anti").select(docs.columns)
