import math
import random
import re

import duckdb
import pytest
from cases import SCHEMA, awkward, frame, table_rows, words

from wattshift.llm import decontaminate, line_dedup, quality_rules
from wattshift.llm.common import row_key
from wattshift.llm.oracle import ORACLE
from wattshift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def normal(rows):
    return sorted((tuple("null" if v is None else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert normal(df.collect()) == normal([tuple(r[i] for i in order) for r in cursor.fetchall()])


def test_quality_counts_of_awkward_rows(spark):
    rows = awkward()
    got = quality_rules.quality_rules(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    expected = []
    for i, t, *_ in rows:
        w = words(t)
        grams = [tuple(w[k: k + 3]) for k in range(len(w) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(w) < 2000 else set(grams)
        places = {k + o for k, g in enumerate(grams) if g in twice for o in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(places),
                         len(w) < 50 or 100 * len(places) > 50 * len(w)))
    assert normal([tuple(r)[:7] for r in got]) == normal(expected)


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 7, 300) for k in range(0, n + 1, max(1, n // 6))]
    df = spark.createDataFrame(rows, "k long, n long")
    tail = quality_rules.binomial_tail(df["k"], df["n"], 0.1)
    for k, n, p in df.select("k", "n", tail).collect():
        if k < n * 0.1:
            assert p == pytest.approx(sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k + 1)), rel=1e-9)
        else:
            assert p == 1.0


def test_cutoffs_hold_the_promise(spark):
    """A setting is used only as far as enough good documents pass it. A language of too few labels takes the pool's setting, but
    none that more than the risk of its own good documents fails."""
    good, loud = " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)).upper()
    rows = [(i, good + f" n{i}", "en", "s") for i in range(3000)] + [(5000 + i, loud + f" N{i}", "en", "s") for i in range(20)]
    rows += [(6000 + i, loud + f" N{i}", "fr", "s") for i in range(20)] + [(7000 + i, loud + f" N{i}", "de", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(5000 + i, 0) for i in range(20)] + [(7000 + i, 1) for i in range(30)]
                                   + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), labels).collect()}
    assert all(got[i].kept for i in range(3000))
    assert all(got[5000 + i].rejected_by == "upper" and not got[5000 + i].kept for i in range(20))
    assert all(got[6000 + i].rejected_by == "upper" and not got[6000 + i].kept for i in range(20))
    assert all(got[7000 + i].kept for i in range(40))


def test_too_few_labels_reject_nothing(spark):
    """Without 200 and more good documents in all languages together no setting passes."""
    good, loud = " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)).upper()
    rows = [(i, good + f" n{i}", "en", "s") for i in range(100)] + [(5000, loud, "en", "s"), (5001, loud, None, "s")]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert all(r.kept for r in quality_rules.quality_rules(frame(spark, rows), labels).collect())


def test_settings_tighten_one_rule_at_a_time():
    steps = quality_rules.settings()
    assert steps[-1] == tuple(grid[-1] for _, grid in quality_rules.RULES.values())
    assert all(sum(x != y for x, y in zip(a, b)) == 1 and all(x >= y for x, y in zip(a, b)) for a, b in zip(steps, steps[1:]))


def test_lines_of_awkward_rows(spark):
    pages = [(i, f"head\nbody {i}\n\nhead\n \ttail", None, "h1") for i in range(30)] + [(100 + i, "head\nx", None, None) for i in range(25)]
    pages += [(200 + i, "head", None, "few") for i in range(3)] + [(300, None, None, "h1"), (301, "", None, "h1"), (302, "head", None, "h1"), (302, "head", None, "h1")]
    got = {}
    for r in line_dedup.drop_boilerplate(frame(spark, pages), ratio=0.5).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert got[3] == [("body 3\n", 5, 3)]
    assert got[101] == [("", 2, 2)]
    assert got[201] == [("head", 1, 0)]
    assert (got[300], got[301]) == ([(None, 0, 0)], [("", 1, 0)])
    assert got[302] == [("", 1, 1)] * 2


def test_copies_are_no_boilerplate(spark):
    """Copies count once; without that they lose all their lines. Small hosts lose a line of three different pages."""
    copy = "a whole page\nof three lines\nheld by many"
    pages = [(i, f"head\nbody {i}", None, "h1") for i in range(20)] + [(100 + i, f"head\n{copy}{' ' * i}", None, "h1") for i in range(10)]
    pages += [(200 + i, f"menu\nown {i}", None, "small") for i in range(3)] + [(300 + i, "said\ntwice", None, "tiny") for i in range(3)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(frame(spark, pages), copies_once=True).collect()}
    assert all(got[i] == f"body {i}" for i in range(20))
    assert all(got[100 + i] == copy + " " * i for i in range(10))
    assert [got[200 + i] for i in range(3)] == ["own 0", "own 1", "own 2"] and got[301] == "said\ntwice"
    plain = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(frame(spark, pages)).collect()}
    assert all(plain[100 + i] == "" for i in range(10))


def test_reparameterised_questions(spark):
    items = spark.createDataFrame([
        (1, "A train leaves Paris at noon, and Tom waits 5 hours with 12 friends before the slow train from Paris brings Tom home."),
        (2, "Short one."), (None, "no id here at all my friend"), (3, None)], "item_id long, text string")
    rows = [
        (1, "x y z. A train leaves London at noon, and Eva waits 7 hours with 30 friends before the slow train from London brings Eva home. More.", None, None),
        (2, "A train leaves London at noon, and Eva waits 7 hours with 30 friends before the slow train from Berlin brings Ida home.", None, None),
        (3, "A train leaves Rome at noon and nobody waits.", None, None), (4, None, None, None), (None, "", None, None)] + awkward()
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(frame(spark, rows), items, share=0.9).collect()}
    assert got[1] == [1] and got[2] == [] and got[3] == [] and got[4] == []
    assert all(got[r[0]] == [] for r in awkward())


APPLES = "Tom has 5 apples. Anna has 7 apples. Tom gives Anna 2 apples. How many apples are left with Tom now?"


def test_names_at_any_place(spark):
    """Names that open a sentence are slots; case, line breaks and the place in a sentence do not matter."""
    items = spark.createDataFrame([(1, APPLES)], "item_id long, text string")
    other = APPLES.replace("Tom", "Eva").replace("Anna", "Ida").replace("5", "8").replace("7", "9")
    texts = [other, APPLES.lower(), "so it was asked: and " + other, other.replace(" Ida", "\n\nIda"), "x y z " + APPLES.replace(". ", ".  ") + " end",
             APPLES.replace("Tom", "Eva", 1), "Tom has many apples and Anna has none."]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(frame(spark, rows), items).collect()}
    assert [got[i] for i in range(5)] == [[1]] * 5 and got[6] == []


def test_versions_and_slot_rich_items(spark):
    """Several versions of an item in one document do not hide each other; windows full of slots count."""
    rich = "3 4 5 6 7 8 plus 9 10 11 12 13 14 gives 15 16 17 18"
    items = spark.createDataFrame([(1, APPLES), (2, rich)], "item_id long, text string")
    eva, ida = APPLES.replace("Tom", "Eva").replace("5", "8"), APPLES.replace("Anna", "Zoe").replace("7", "1")
    rows = [(1, f"{APPLES} {eva}", None, None), (2, f"{eva} {ida}", None, None), (3, f"{ida} some words between {eva} {APPLES}", None, None),
            (4, "before " + rich + " after", None, None), (5, rich.replace("1", "2"), None, None)]
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(frame(spark, rows), items).collect()}
    assert got[1] == got[2] == got[3] == [1] and got[4] == [2] and got[5] == []


def held_items(spark, items, texts):
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    return [r.item_ids for r in sorted(got, key=lambda r: r.doc_id)]


def test_names_of_two_words_and_amounts(spark):
    """A token more or less inside a window does not lose it."""
    sold = "Each morning Sarah buys 12 fresh rolls for 45 dollars and sells them at noon while Sarah keeps 3 rolls for lunch"
    texts = [sold.replace("Sarah", "Mary Ann"), sold.replace("45 dollars", "$45"), sold.replace("Sarah", "Mary Ann").replace("45 dollars", "$ 99.50"),
             sold.replace("Sarah", "Jo").replace("12", "7"), sold.replace("rolls", "loaves of bread"), "nothing of that kind at all"]
    assert held_items(spark, [(1, sold)], texts) == [[1], [1], [1], [1], [], []]
    assert held_items(spark, [(1, sold.replace("45 dollars", "$45"))], [sold, sold.replace("45 dollars", "$45")]) == [[1], [1]]


def test_many_numbers_take_rows_not_memory(spark):
    """Tables of numbers: an item is found by its values, not by being numbers; windows of numbers only do not meet all others."""
    rng = random.Random(6)
    table = " ".join(str(rng.randrange(100_000)) for _ in range(500))
    other = " ".join(str(rng.randrange(100_000)) for _ in range(100_000))
    long = other[:300_000].rsplit(" ", 1)[0] + " " + table + " " + other[300_000:]
    zeros = " ".join(["0"] * 200)
    assert held_items(spark, [(1, table), (2, zeros)], [other, long, " ".join(["0"] * 3000), " ".join(["1"] * 3000)]) == [[], [1], [2], []]


def test_parameterised_items_by_chance(spark):
    """Random items: a copy with other values is found where one value stands for one value, not where values are mixed up."""
    rng = random.Random(8)
    names, nouns = ["Ada", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gus", "Hal"], [a + b for a in ("ap", "be", "cu", "do", "fi") for b in ("lar", "ment", "sor", "tin")]

    def item():
        out = []
        for _ in range(4):
            who, thing = rng.sample(names, 2), rng.sample(nouns, 4)
            out.append(f"then {who[0]} gave {rng.randrange(2, 99)} {thing[0]} and {thing[1]} to {who[1]} before the {thing[2]} and {thing[3]} came")
        return ". ".join(out) + "."

    def told(text, consistent):
        values: dict = {}
        def other(kind, token):
            fresh = str(rng.randrange(100, 999)) if kind == "n" else rng.choice(["Xan", "Yul", "Zed", "Quin", "Ron", "Sal", "Uma", "Vic", "Wes"]) + "abcdefghijklmnop"[rng.randrange(16)]
            return values.setdefault(token, fresh) if consistent else fresh
        text = re.sub(r"\b[0-9]+\b", lambda m: other("n", m[0]), text)
        return re.sub(rf"\b({'|'.join(names)})\b", lambda m: other("w", m[0]), text)

    items = [(i, item()) for i in range(30)]
    plain = " ".join(rng.choice(nouns) for _ in range(200))
    texts = [f"{plain} {told(t, True)} {plain}" for _, t in items] + [plain] + [t for _, t in items]
    got = held_items(spark, items, texts)
    for i in range(30):
        values = re.findall(rf"\b(?:[0-9]+|{'|'.join(names)})\b", items[i][1])
        told_values = re.findall(r"\b(?:[0-9]+|[A-Z][a-z]+)\b", texts[i])
        one_to_one = len(set(values)) == len(set(told_values))
        assert got[i] == [i] or not one_to_one
    assert sum(g == [i] for i, g in enumerate(got[:30])) >= 25 and got[30] == [] and got[31:] == [[i] for i in range(30)]


def test_nothing_is_lost_before_the_windows(spark):
    """Documents that hold just enough of an item pass the look for rare words, for items of words and of numbers."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").select(*row_key(), "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = decontaminate.contamination(docs, bench)
    items = decontaminate.templates(bench, 5)
    passed = decontaminate.possible(docs, decontaminate.anchors(items, 5, 0.8), True)
    assert held.count() and not held.join(passed, ["k_id", "k_text", "item_id"], "left_anti").count()
    sought = {r.item_id: r.need for r in decontaminate.anchors(items, 5, 0.8).collect()}
    assert all(n == decontaminate.SPARE_ANCHORS or n > 1 for n in sought.values())


def test_whole_items_are_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(b.item_id, b.text) for b in bench.collect()]
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        assert {i for i, t in items if t in r.text} <= got[r.doc_id]


def test_shuffle_join_finds_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").select(*row_key(), "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    small = normal(decontaminate.contamination(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert normal(decontaminate.contamination(docs, bench).collect()) == small and small


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not quality_rules.quality_rules(docs, labels).collect()
    assert not line_dedup.drop_boilerplate(docs).collect()
    assert not decontaminate.decontaminate(docs, bench).collect()
    some = frame(spark, table_rows(spark, SF)[:5])
    assert all(r.n_items == 0 for r in decontaminate.decontaminate(some, bench).collect())
