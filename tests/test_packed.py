import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notewright.operators import packed

CASES = [
    ("A1|A1|B2", ["A1", "A1", "B2"]),
    ('"A1"|"p1"|"K4,long form"|"39\'-OZ"', ["A1", "p1", "K4,long form", "39'-OZ"]),
    ('["O3 like", "D8 like"]', ["O3 like", "D8 like"]),
    ('["A1, long form"]', ["A1, long form"]),
    ('"A1|B2|C3"', ["A1", "B2", "C3"]),
    ('"A1|B2', ["A1", "B2"]),
    ('A1|B2"', ["A1", "B2"]),
    ("{A1,B2}", ["A1", "B2"]),
    ("'A1'|'B2'", ["A1", "B2"]),
    ("“A1”; “B2, x”", ["A1", "B2, x"]),
    ("48'-GU|Na8/5|DB(96)|MO-17", ["48'-GU", "Na8/5", "DB(96)", "MO-17"]),
    ("A1;;B2; ;C3", ["A1", "B2", "C3"]),
    ("A1¦B2｜C3；D4，E5\tF6\r\nG7", ["A1", "B2", "C3", "D4", "E5", "F6", "G7"]),
    ('A1,"B2;beta",C3', ["A1", "B2;beta", "C3"]),
    (" |A1| ", ["A1"]),
    *[(x, []) for x in ("", " ", '""', "|", "-", "—", "n/a", "None", "[]", "{}", "null", None)],
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert packed.split_array(pa.array([text, "Z9"])).to_pylist() == [want, ["Z9"]]


_NAME = st.from_regex(r"[A-Z]{1,4}[0-9]{1,3}( alpha|-[0-9]|/[0-9]|\([0-9]\))?", fullmatch=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(_NAME, min_size=1, max_size=6), st.sampled_from(["|", ",", "; ", "\t", "\n", " | "]), st.sampled_from(["", '"', "'"])), min_size=1, max_size=5))
def test_joined_values_come_back(fields):
    texts = [sep.join(f"{q}{v}{q}" for v in vs) for vs, sep, q in fields]
    assert packed.split_array(pa.array(texts)).to_pylist() == [vs for vs, _, _ in fields]


def test_rows(spark):
    df = spark.createDataFrame([(1, "A1|B2", None, 7), (2, None, "", 7), (3, "C3", "D4;D4", 7), (3, "C3", None, 7), (None, "E5", None, 7), (4, "x1," * 50_000, None, 7)], "id long, a string, b string, pos int")
    got = packed.explode_packed(df, "id", ["a", "b"])
    assert got.where("id = 4").count() == 50_000
    rows = sorted((r.id or 0, r.field_name, r.pos, r.val) for r in got.where("id is null or id < 4").collect())
    assert rows == [(0, "a", 1, "E5"), (1, "a", 1, "A1"), (1, "a", 2, "B2"), (3, "a", 1, "C3"), (3, "a", 1, "C3"), (3, "b", 1, "D4"), (3, "b", 2, "D4")]
    assert packed.explode_packed(df.limit(0), "id", ["a"]).count() == 0
