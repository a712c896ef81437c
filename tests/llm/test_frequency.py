import random

from notewright.llm import frequency


def test_counts_equal_brute_force_with_a_hot_term(spark):
    rng = random.Random(3)
    rows = [("hot", f"p{rng.randrange(50)}" if rng.random() > 0.1 else None) for _ in range(3000)]
    rows += [(f"t{int(rng.paretovariate(0.8))}", f"p{rng.randrange(50)}") for _ in range(3000)] + [(None, "p1"), ("only null", None)]
    want = {}
    for t, r in rows:
        if t is not None:
            n, pages = want.setdefault(t, [0, set()])
            want[t][0] += 1
            if r is not None:
                pages.add(r)
    df = spark.createDataFrame(rows, "term string, record string").repartition(5)
    for size in (2, 512):
        got = {r.term: (r.mentions, r.records) for r in frequency.term_counts(df, heavy_size=size).collect()}
        assert got == {t: (n, len(p)) for t, (n, p) in want.items()}


def test_heavy_terms_are_found(spark):
    df = spark.createDataFrame([("a", "x")] * 500 + [(f"z{k}", "x") for k in range(1500)], "term string, record string")
    assert "a" in frequency.heavy_terms(df, 8)


def test_empty_and_marks(spark):
    empty = spark.createDataFrame([], "term string, record string")
    assert frequency.term_counts(empty).collect() == []
    counts = spark.createDataFrame([("a", 2, 2), ("b", 9, 5), ("c", 99, 6)], "term string, mentions long, records long")
    assert [r.mark for r in frequency.mark_terms(counts, 100).orderBy("term").collect()] == ["rare", None, "common"]


def test_types_and_names(spark):
    df = spark.createDataFrame([(" Company", "  A\u00a0 b "), ("CELL_LINE", " "), (None, None)], "t string, c string")
    got = df.select(frequency.plural_type(df.t).alias("t"), frequency.tidy(df.c).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [("companies", "a b"), ("cell_lines", None), (None, None)]
