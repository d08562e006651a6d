"""Templates, counts, messages and token records on small inputs."""

import random

from pyspark.sql import functions as F

from tallyframe.operators import curation as c
from tallyframe.operators.division import bitmaps, divide, holders, numbered


def test_templates_and_counts(spark):
    templates = spark.createDataFrame(
        [("t1", "simple", ["In {country}?", "Who is in {country}?"], "x = '{country}'", "country"),
         ("t2", "top", ["Top?"], "limit 5", None),
         ("t3", "none", ["Which {year}?"], "y = {year}", "year")],
        "template_id string, category string, phrasings array<string>, sql string, domain string",
    )
    params = spark.createDataFrame([("country", "UK"), ("country", "Peru")], "domain string, value string")
    got = sorted((r.question, r.sql) for r in c.expand_templates(templates, params).collect())
    assert got == [
        ("In Peru?", "x = 'Peru'"), ("In UK?", "x = 'UK'"), ("Top?", "limit 5"),
        ("Who is in Peru?", "x = 'Peru'"),
        ("Who is in UK?", "x = 'UK'"),
    ]
    fact = spark.createDataFrame([("UK",), ("UK",), (None,)], "place string")
    counts = c.lifted_counts(params, fact, {"value": "place"}).collect()
    assert {r.value: r.gold_row_count for r in counts} == {"UK": 2, "Peru": 0}


def test_domains_scan_each_table_once(spark):
    t = {"a": spark.createDataFrame([("x", 1), ("y", 1)], "p string, q int")}
    got = {tuple(r) for r in c.domains(t, [("a", "p"), ("a", "q")]).collect()}
    assert got == {("a", "p", "x"), ("a", "p", "y"), ("a", "q", "1")}


def test_white_space_of_any_kind(spark):
    texts = [" a \t b\n\nc ", "a  b", "\x1fa\x85b　", "", "abc", "a​b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r.i: r.s for r in c.normalize_ws(df, "s").collect()}
    assert got == {i: " ".join(s.split()) for i, s in enumerate(texts)}


def test_white_space_in_random_texts(spark):
    rng = random.Random(11)
    letters = "ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200bé"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    for i, got in c.normalize_ws(df, "s").collect():
        assert got == " ".join(texts[i].split())


def test_messages(spark):
    df = spark.createDataFrame([("q", "s"), ("q", None)], "question string, sql string")
    full, open_ = c.to_messages(df, "sys").orderBy(F.col("sql").isNull()).collect()
    assert [tuple(m) for m in full.messages] == [("system", "sys"), ("user", "q"), ("assistant", "s")]
    assert [m.role for m in open_.messages] == ["system", "user"]


def _masked(full, prompt, max_len):
    ids, head = full[:max_len], prompt[:max_len]
    n = min(len(head), len(ids))
    return ids, [-100] * n + ids[n:]


def test_token_records(spark):
    cases = [([1, 2, 3, 4, 5, 6], [1, 2]), ([1, 2, 3], [1, 2, 3, 4, 5]), ([], []), ([], [1]),
             (list(range(20)), list(range(15))), ([9], [])]
    df = spark.createDataFrame(
        [(i, f, p) for i, (f, p) in enumerate(cases)], "i int, full_ids array<int>, prompt_ids array<int>"
    )
    padded = c.pad_fixed(c.mask_prompt(df, 8), 6, 0).collect()
    for row in padded:
        ids, labels = _masked(*cases[row.i], 8)
        ids, labels = ids[:6], labels[:6]
        gap = 6 - len(ids)
        assert row.input_ids == ids + [0] * gap
        assert row.labels == labels + [-100] * gap
        assert row.attention_mask == [1] * len(ids) + [0] * gap


def test_division(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, name string")
    pairs = spark.createDataFrame(
        [(1, "x"), (1, "y"), (1, "x"), (2, "x"), (2, "z"), (2, "z")], "k int, v string"
    )
    needed = spark.createDataFrame([("x",), ("y",), ("y",)], "v string")

    def names(divisor):
        return sorted(r.name for r in divide(people, pairs, divisor, "k", "v").collect())

    assert names(needed) == ["a"]
    assert names(needed.where("v = 'x'")) == ["a", "b"]
    assert names(needed.where("v = 'none'")) == ["a", "b", "c"]


def test_division_by_more_values_than_a_bitmap_block_holds(spark):
    """40,000 needed values; key 1 has them all three times, key 2 lacks the last,
    key 3 has one of them and others."""
    needed = spark.range(40_000).selectExpr("CAST(id AS STRING) AS v")
    all_of = spark.range(120_000).selectExpr("1L AS k", "CAST(id % 40000 AS STRING) AS v")
    most = spark.range(39_999).selectExpr("2L AS k", "CAST(id AS STRING) AS v")
    rest = spark.createDataFrame([(3, "7"), (3, "x"), (3, None), (None, "7")], "k long, v string")
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "k long, name string")
    pairs = all_of.union(most).union(rest)

    def names(divisor):
        return sorted(r.name for r in divide(people, pairs, divisor, "k", "v").collect())

    assert names(needed) == ["a"]
    assert names(needed.where("v <> '39999'")) == ["a", "b"]
    assert names(needed.where("v = '7'").union(rest.where("v IS NULL").select("v"))) == ["a", "b", "c"]
    assert names(needed.where("false")) == ["a", "b", "c", "d", "e"]
    assert divide(people.where("false"), pairs, needed, "k", "v").count() == 0
    assert divide(people, pairs.where("false"), needed, "k", "v").count() == 0


def test_division_numbers_do_not_depend_on_the_partitioning(spark):
    values = spark.range(500).selectExpr("CAST(id AS STRING) AS v")
    first = {r.v: r.ordinal for r in numbered(values, "v").collect()}
    again = {r.v: r.ordinal for r in numbered(values.union(values).repartition(7), "v").collect()}
    assert first == again and sorted(first.values()) == list(range(500))


def test_division_by_values_in_many_pieces(spark):
    values = spark.range(500).selectExpr("id AS v")
    ordinals = numbered(values, "v", piece_rows=10)
    rows = [r.ordinal for r in ordinals.collect()]
    assert len(set(rows)) == 500 and len({r >> 32 for r in rows}) > 50 and max(r & 0xFFFFFFFF for r in rows) < 64
    pairs = spark.range(1000).selectExpr("id % 2 AS k", "id DIV 2 AS v").where("NOT (k = 1 AND v = 77)").join(ordinals, "v")
    people = spark.range(2).selectExpr("id AS k")
    assert [r.k for r in holders(people, bitmaps(pairs, "k"), ordinals, "k").collect()] == [0]
