import os

import pytest

from notewright.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "word " * (5 + k % 90), "Big" if k % 3 else "big ", 1) for k in range(3000)] + [(10_000 + k, "small text here " * 4, "small-one", 1) for k in range(40)]
    rows += [(20_000 + k, "tiny", "tiny", 1) for k in range(3)] + [(30_000, None, "big", 1), (30_001, "", "big", 1), (30_002, "text", None, 1), (30_003, "text", "unlisted", 1)]
    return spark.createDataFrame(rows, "doc long, text string, source string, tokens int").repartition(4)


def _targets(spark):
    return spark.createDataFrame([("big", 0.9, 1), ("small_one", 0.05, 60), ("tiny", 0.04, 2), ("absent", 0.01, 4)], "source string, target_share double, max_repeats int")


def test_shares_caps_and_report(spark, docs):
    mixed, report = mixing.mix(docs, _targets(spark), "doc", "text", "source", total_tokens=100_000)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].used_tokens - 90_000) < 90 and r["big"].in_reach
    assert abs(r["small_one"].used_tokens - 5_000) < 20
    assert not r["tiny"].in_reach and r["tiny"].used_tokens == 2 * r["tiny"].tokens
    assert r["absent"].documents == 0 and r["absent"].used_tokens == 0
    rows = mixed.collect()
    assert {(x.source, x.copies > {"big": 1, "small_one": 60, "tiny": 2}[x.source]) for x in rows} == {("big", False), ("small_one", False), ("tiny", False)}
    assert len(rows) == len({x.doc for x in rows}) and not {x.doc for x in rows} & {30_000, 30_001, 30_002, 30_003}
    copies = {x.copies for x in rows if x.source == "small_one"}
    assert max(copies) - min(copies) <= 1
    assert sum(x.tokens * x.copies for x in rows) == sum(x.used_tokens for x in r.values())


def test_draw_is_fixed_and_depends_on_the_seed(spark, docs):
    def ids(**kw):
        return {x.doc for x in mixing.mix(docs, _targets(spark), "doc", "text", "source", total_tokens=60_000, **kw)[0].collect()}

    assert ids() == ids() != ids(seed=7)


def test_longer_documents_come_more_often(spark, docs):
    mixed, _ = mixing.mix(docs, _targets(spark), "doc", "text", "source", total_tokens=40_000)
    taken = {x.doc for x in mixed.where("source = 'big'").collect()}
    share = lambda test: sum(k in taken for k in range(3000) if test(k % 90)) / sum(test(k % 90) for k in range(3000))
    assert share(lambda n: n > 60) > 2 * share(lambda n: n < 15)


def test_empty_tables(spark, docs):
    mixed, report = mixing.mix(docs.limit(0), _targets(spark), "doc", "text", "source")
    assert mixed.count() == 0 and report.count() == 4
    mixed, report = mixing.mix(docs, _targets(spark).limit(0), "doc", "text", "source")
    assert mixed.count() == 0 and report.count() == 0


def test_tokens_decode_to_the_text():
    e = mixing._encoder(mixing.TOKENIZER)
    for t in ("Größe 12.5 % <|endoftext|>", "a\n\n  b" * 50, "é́"):
        assert e.decode(e.encode_ordinary(t)) == t


def test_weights_grow_with_the_tokens_of_long_documents(spark):
    rows = [(f"d{k}", "paper", "word " * (1000 if k % 2 else 100)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, source string, text string")
    targets = spark.createDataFrame([("paper", 1.0, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, targets, "doc_id", "text", "source", total_tokens=60_000)[0].collect()
    long = sum(int(r.doc_id[1:]) % 2 for r in out)
    assert 4 < long / max(1, len(out) - long) < 25
