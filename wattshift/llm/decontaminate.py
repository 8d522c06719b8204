"""Benchmark decontamination by templates with typed slots.

Texts lose case and punctuation; an amount with a dollar sign becomes a number and its unit. Slots are decided on the benchmark's side:
numbers, units after numbers, and names, which are the words capitalised anywhere inside a sentence of the item, at all their places.

1. Documents are read once for the rarest words of every item that must be there: a document that lacks more of them than
   the share of lost windows allows cannot hold the item, so this loses nothing.
2. The documents left are looked up by hashed windows of ``width`` tokens in two forms, with numbers masked, and with capitalised words
   and units masked as well; both sides are masked by one rule that does not look at the words around. A window of masked tokens only is
   looked up by its values. A hit gives an alignment of item and document.
3. At an alignment the item's tokens are compared with the document's, a row each: other words must be equal, a number may stand for a
   number, a unit for a unit, a word for a name in any case. A window may go on one or two tokens later (a name of several words) or leave out a slot.

Slot values must fit: within a group of near alignments, a value of the item has to stand for one and the same value of the
document, and the other way round. Windows with the item's own values always fit. Windows of more than ``max_slots``
slots do not vote; they count if they have the item's own values or the values that the other windows agreed on. So several
versions of an item in one document do not disturb each other; all alignments together are one more group, for items in scattered
pieces. A document is contaminated by an item if a group holds at least ``share`` of the item's different windows.

Only built-in functions run here. Items, their rare words and windows are broadcast if they are counted to be few and joined by shuffle
otherwise. No array is longer than a window, but for a document's own tokens, so long and number-rich texts take rows, not memory.

Defined cases: null text is empty; null ids of items do not count, null document ids are reported as null; repeated item
ids count as one item with all their windows; items of fewer than ``width`` tokens cannot be found; an item none of whose windows
keeps its words in either form gives no alignment; an empty benchmark leaves every document clean; extra columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshift.llm.common import boxed, let, settle

WIDTH = 5
SHARE = 0.8
MAX_SLOTS = 2
BROADCAST_WINDOWS = 500_000     # benchmark rows (windows, tokens, rare words) up to which they are sent to every task, about 40 MB
SPARE_ANCHORS = 4               # rare words of an item that are looked for, beyond those that may be lost
AHEAD = 2                       # tokens that a document may have put into a window
# Words that count as units after a number.
UNITS = ("mm cm m km inch inches feet ft mile miles yard yards mg g kg gram grams kilogram kilograms ton tons pound pounds "
         "ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week "
         "weeks month months year years percent degrees dollar dollars euro euros cent cents volt volts watt watts mph kmh").split()


NUM, NAME, UNIT = 1, 2, 3       # kinds of slots


def _plain(text: Column) -> Column:
    """The text without punctuation; the words keep their case."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\s]+", "")


def _amounts(text: Column) -> Column:
    """The text with "$45" written as "45 dollars"."""
    return F.regexp_replace(text, r"\$\s?([0-9][0-9.,]*)", "$1 dollars ")


def _split(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def _hashes(text: Column) -> Column:
    return F.transform(_split(text), lambda t: F.xxhash64(t))


def windows(texts: DataFrame, keys: list[str], width: int = WIDTH, max_slots: int = MAX_SLOTS) -> DataFrame:
    """(keys, pos, w): the hash of every window with numbers masked, and of windows with at most ``max_slots`` masks of all kinds.

    A window of numbers only is hashed as it is.
    """
    masks = [F.xxhash64(F.lit(f"<{k}>")) for k in range(3)]
    masked = lambda h, i, among: reduce(lambda x, y: x + y, [F.get(h, i + j).isin(*among).cast("int") for j in range(width)])
    hashed = lambda h, i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])

    def build(raw: Column, first: Column, two: Column) -> Column:
        starts = F.when(F.size(raw) >= width, F.sequence(F.lit(0), F.size(raw) - width)).otherwise(F.array().cast("array<int>"))
        one = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.when(masked(first, i, masks[:1]) == width, hashed(raw, i)).otherwise(hashed(first, i)).alias("w")))
        other = F.filter(starts, lambda i: (masked(two, i, masks) <= max_slots) & (hashed(two, i) != hashed(first, i)))
        return F.concat(one, F.transform(other, lambda i: F.struct(i.alias("pos"), hashed(two, i).alias("w"))))

    plain = _plain(_amounts(F.coalesce("text", F.lit(""))))
    numbers = F.regexp_replace(plain, r"(?<!\S)[0-9]\S*", "<0>")
    names = F.regexp_replace(numbers, r"(?<!\S)\p{Lu}\p{Ll}+(?!\S)", "<1>")
    units = F.regexp_replace(names, rf"(?<=<0>\s)({'|'.join(UNITS)})(?!\S)", "<2>")
    built = texts.select(*keys, let(_hashes(plain), lambda raw: let(_hashes(numbers), lambda first: let(
        _hashes(units), lambda two: build(raw, first, two)))).alias("x"))
    return built.select(*keys, F.explode("x").alias("x")).select(*keys, "x.pos", "x.w")


def templates(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, t_key, cells): an item's tokens as (a, kind), kind 0 for a word that must be there."""
    inside = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<=[^\s.!?:]\s{1,9})(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"), 1)
    split = benchmark.filter("item_id is not null").select(
        "item_id", F.xxhash64("text").alias("t_key"), F.transform(inside, F.lower).alias("names"), _split(_plain(_amounts(F.col("text")))).alias("t"))
    number = lambda x: x.rlike("^[0-9]")
    return split.filter(F.size("t") >= width).distinct().select("item_id", "t_key", F.transform("t", lambda x, i: F.struct(
        x.alias("a"), F.when(number(x), NUM).when(x.isin(*UNITS) & F.coalesce(number(F.get("t", i - 1)), F.lit(False)), UNIT)
        .when(F.array_contains("names", x), NAME).otherwise(0).alias("kind"))).alias("cells"))


def _own(template: Column, i: Column, width: int) -> Column:
    """The hash of an item's window at i, slots without their values."""
    return F.xxhash64(F.transform(F.slice(template, i + 1, width), lambda x: F.when(x["kind"] > 0, F.concat(F.lit("<"), x["kind"].cast("string"))).otherwise(x["a"])))


def anchors(items: DataFrame, width: int, share: float) -> DataFrame:
    """(h, item_id, t_key, places, need): an item's rarest words, at how many places each stands, and how many of the places a document must know.

    A lost place loses at least one window, so at most as many places may be lost as windows. Where an item has too few words, its
    numbers count as well and three places are enough: a window that may vote on values has three words, any other one has its own values.
    """
    tokens = items.select("item_id", "t_key", F.size("cells").alias("n"), F.explode("cells").alias("c"))
    loss = F.floor((F.col("n") - (width - 1)) * (1 - share) + 1e-9)
    placed = tokens.groupBy("item_id", "t_key", "n", F.col("c.a").alias("a"), (F.col("c.kind") == 0).alias("word")).agg(F.count(F.lit(1)).alias("places"))
    known = placed.groupBy("a").agg(F.count(F.lit(1)).alias("known"))
    per = Window.partitionBy("item_id", "t_key")
    words = placed.join(known, "a").withColumn("loss", loss).withColumn("words", F.sum(F.when(F.col("word"), F.col("places")).otherwise(0)).over(per))
    rare = per.orderBy(F.desc("word"), "known", F.desc(F.length("a")), "a").rowsBetween(Window.unboundedPreceding, -1)
    rich = F.col("words") <= F.col("loss")
    chosen = words.withColumn("before", F.coalesce(F.sum("places").over(rare), F.lit(0))).filter(
        rich | (F.col("word") & (F.col("before") < F.col("loss") + SPARE_ANCHORS)))
    need = F.when(rich, F.lit(3)).otherwise(F.sum("places").over(per) - F.col("loss"))
    return chosen.select(F.xxhash64("a").alias("h"), "item_id", "t_key", "places", need.alias("need"))


def possible(docs: DataFrame, sought: DataFrame, small: bool) -> DataFrame:
    """(k_id, k_text, item_id, t_key): documents that know enough of an item's rare words."""
    key = ["k_id", "k_text"]
    tokens = docs.select(*key, F.explode(F.split(F.lower(_plain(F.col("text"))), r"\s+")).alias("t")).select(*key, F.xxhash64("t").alias("h"))
    met = tokens.join(F.broadcast(sought) if small else sought, "h")
    once = met.groupBy(*key, "item_id", "t_key", "h").agg(F.first("places").alias("places"), F.first("need").alias("need"))
    return once.groupBy(*key, "item_id", "t_key").agg(F.sum("places").alias("known"), F.first("need").alias("need")).filter("known >= need").select(
        *key, "item_id", "t_key")


def _aligned(docs: DataFrame, items: DataFrame, hits: DataFrame, width: int, small: bool) -> DataFrame:
    """(k_id, k_text, item_id, g, w, pairs): an item's windows that fit at an alignment but for slot values, per group."""
    key, place = ["k_id", "k_text"], ["k_id", "k_text", "item_id", "t_key"]
    starts = hits.select(*place, (F.col("pos") - F.col("ipos")).cast("int").alias("shift")).distinct()
    cells = items.select("item_id", "t_key", F.size("cells").alias("n"), "cells").select(
        "item_id", "t_key", "n", F.posexplode("cells").alias("j", "c"), F.col("cells").alias("all")).select(
        "item_id", "t_key", "n", "j", "c.a", "c.kind", F.when(F.col("j") <= F.col("n") - width, _own(F.col("all"), F.col("j"), width)).alias("w"))
    wanted = starts.join(F.broadcast(cells) if small else cells, ["item_id", "t_key"]).withColumn("pos", F.col("shift") + F.col("j"))
    tokens = docs.select(*key, F.posexplode(_split(_plain(_amounts(F.coalesce("text", F.lit("")))))).alias("pos", "b"))
    number = F.col("b").rlike("^[0-9]")
    fits = F.coalesce(F.when(F.col("kind") == NUM, number).when(F.col("kind") == UNIT, F.col("b").isin(*UNITS))
                      .when(F.col("kind") == NAME, ~number).otherwise(F.col("a") == F.col("b")), F.lit(False))
    compared = wanted.join(tokens, [*key, "pos"], "left").select(
        *place, "shift", "n", "j", "w", F.struct("a", "b", "kind", fits.alias("fits")).alias("x"))
    along = Window.partitionBy(*place, "shift").orderBy("j")
    framed = settle(compared.select(
        *place, "shift", "n", "j", "w", F.collect_list("x").over(along.rowsBetween(0, width - 1)).alias("from"),
        F.collect_list("x").over(along.rowsBetween(-(width - 1), 0)).alias("to")))
    lost = lambda x: F.array_position(F.transform(x, lambda c: c["fits"]), False)
    slots = lambda x: F.transform(F.filter(x, lambda c: c["kind"] > 0), lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b")))
    opening = framed.filter("w is not null").withColumn("good", F.when(lost("from") == 0, F.lit(width)).otherwise(lost("from") - 1))
    whole = opening.filter(F.col("good") == width).select(*place, "shift", "n", "w", slots("from").alias("pairs"))
    # The rest of a window at a later place, or one place earlier without the slot between.
    parts = opening.filter((F.col("good") > 0) & (F.col("good") < width)).select(
        *place, "n", "w", "good", "from", F.col("shift").alias("base"), (F.col("j") + width - 1).alias("j"),
        F.explode(F.array(*[F.lit(d) for d in (-1, *range(1, AHEAD + 1))])).alias("step")).withColumn("shift", F.col("base") + F.col("step"))
    closing = framed.filter(F.size("to") == width).withColumn("back", lost(F.reverse("to"))).select(
        *place, "shift", "j", "to", F.when(F.col("back") == 0, F.lit(width)).otherwise(F.col("back") - 1).alias("behind"))
    left_out = F.when(F.col("step") < 0, 1).otherwise(0)
    gap_is_slot = (F.col("step") > 0) | F.coalesce(F.get("from", F.col("good").cast("int"))["kind"] > 0, F.lit(False))
    rest = F.lit(width) - F.col("good") - left_out
    bridged = parts.join(closing, [*place, "shift", "j"]).filter((F.col("behind") >= rest) & gap_is_slot & (rest > 0)).select(
        *place, F.col("base").alias("shift"), "n", "w",
        slots(F.concat(F.slice("from", F.lit(1), F.col("good").cast("int")), F.slice("to", (F.lit(width) - rest + 1).cast("int"), rest.cast("int")))).alias("pairs"))
    span = F.greatest(F.lit(2), F.floor(F.col("n") / 2))    # versions behind one another are further apart
    groups = F.array(3 * F.floor(F.col("shift") / span), 3 * F.floor((F.col("shift") + F.floor(span / 2)) / span) + 1, F.lit(2).cast("long"))
    return whole.unionByName(bridged).select(*key, "item_id", F.explode(groups).alias("g"), "w", "pairs").distinct()


def _fitting(rows: DataFrame, max_slots: int) -> DataFrame:
    """The rows whose slot values agree with the most frequent pairing of values in their group, in both directions, or are the item's own."""
    key = ["k_id", "k_text", "item_id", "g"]
    marked = rows.withColumn("same", F.forall("pairs", lambda p: p["a"] == p["b"]))
    own = marked.filter("same").select(*key, "w")
    other = marked.filter("not same")
    votes = marked.filter((F.size("pairs") > 0) & (F.size("pairs") <= max_slots)).select(*key, "w", F.explode("pairs").alias("p"))
    counted = votes.select(*key, "w", "p.a", "p.b").groupBy(*key, "a", "b").agg(F.countDistinct("w").alias("n"))
    best = lambda one, two: counted.groupBy(*key, one).agg(F.max_by(two, F.struct("n", two)).alias(two))
    agreed = (best("a", "b").select(*key, "a", "b").join(best("b", "a").select(*key, "a", "b"), [*key, "a", "b"])
              .groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("agreed")))
    fit = other.join(agreed, key).filter(F.size(F.array_except("pairs", "agreed")) == 0).select(*key, "w")
    return own.unionByName(fit)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE,
                  max_slots: int = MAX_SLOTS) -> DataFrame:
    """(k_id, k_text, item_id, n_windows, item_windows): the items that a document row holds.

    docs: k_id, k_text (the keys of common.row_key) and text; benchmark: item_id, text.
    """
    key = ["k_id", "k_text"]
    items = settle(templates(benchmark, width))
    totals = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("cells") - width), lambda i: _own(F.col("cells"), i, width))).alias("w")
                          ).groupBy("item_id").agg(F.countDistinct("w").alias("item_windows"))
    size = items.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]
    small = 2 * size <= BROADCAST_WINDOWS      # no table of the benchmark has more rows than two per token
    keyed = benchmark.filter("item_id is not null").select("item_id", F.xxhash64("text").alias("t_key"), "text")
    seeds = windows(keyed, ["item_id", "t_key"], width, max_slots).withColumnRenamed("pos", "ipos").distinct()
    pairs = settle(possible(docs, anchors(items, width, share), small))
    few = pairs.count() <= BROADCAST_WINDOWS
    near = F.broadcast(pairs) if few else pairs
    left = settle(docs.select(*key, "text").join(near, key, "left_semi").dropDuplicates(key))
    found = windows(left, key, width, max_slots).join(F.broadcast(seeds) if small else seeds, "w")
    hits = found.join(near, [*key, "item_id", "t_key"], "left_semi")
    held = (_fitting(settle(_aligned(left, items, hits, width, small)), max_slots).groupBy("k_id", "k_text", "item_id", "g")
            .agg(F.countDistinct("w").alias("n_windows")).groupBy("k_id", "k_text", "item_id").agg(F.max("n_windows").alias("n_windows")))
    return held.join(totals, "item_id").filter(F.col("n_windows") >= share * F.col("item_windows")).select(
        "k_id", "k_text", "item_id", "n_windows", "item_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The input's rows and columns plus ``n_items`` and ``item_ids`` (sorted ids of the items a document holds), which replace
    columns of these names."""
    keyed = boxed(docs)
    held = (contamination(keyed.select("k_id", "k_text", F.col("row.text").alias("text")), benchmark, **params).groupBy("k_id", "k_text")
            .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return keyed.join(held, ["k_id", "k_text"], "left").select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_items", "item_ids")], F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))
