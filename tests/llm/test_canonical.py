from notewright.llm import canonical

ENTRIES = [
    ("companies", "glexwista", "Glexwista", 1),
    ("companies", "jakiomclyl pharma", "Jakiomclyl Pharma", 2),
    ("companies", "jakiomclyl pharma holdings", "Jakiomclyl Pharma", 3),
    ("companies", "dresston & kiothpei", "Dresston & Kiothpei", 4),
    ("companies", "gngg", "Glexwista", 5),
    ("companies", "zebrel bio", "First Owner", 6),
    ("companies", "zebrel bio", "Second Owner", 7),
    ("companies", "", "Blank Variant", 8),
    ("companies", None, "Null Variant", 9),
    *[("companies", f"{h} pharma", f"{h.title()} Pharma", 10 + k) for k, h in enumerate(["trovelmax", "quandisor", "plimbratex", "wesquolin", "dravontis", "kelmoraxi"])],
    ("drugs", "veirpaerparin", "veirpaerparin", 30),
    ("drugs", "bdg-61177", "bastregespril", 31),
]
CASES = [
    ("companies", "GLEXWISTA", "Glexwista"),
    ("companies", "the Glexwista team ??", "Glexwista"),
    ("companies", "Glex-wista", "Glexwista"),
    ("companies", "gelxwista", "Glexwista"),
    ("companies", "Pharma Jakiomclyl", "Jakiomclyl Pharma"),
    ("companies", "Jakiomc1yl Pharmaceuticals Inc.", "Jakiomclyl Pharma"),
    ("companies", "Dresston und Kiothpei’s", "Dresston & Kiothpei"),
    ("companies", "Gngg", "Glexwista"),
    ("companies", "Gnga", "UNMATCHED"),
    ("companies", "zebrel bio", "Second Owner"),
    ("companies", "Vaummorgyl Pharma", "UNMATCHED"),
    ("companies", "veirpaerparin", "UNMATCHED"),
    ("companies", "Blank Variant", "UNMATCHED"),
    ("drugs", "dose of veirpaerparin 5 mg/kg", "veirpaerparin"),
    ("drugs", "veirpa-erparin", "veirpaerparin"),
    ("drugs", "BDG 61177", "bastregespril"),
    ("drugs", "bdg-61178", "UNMATCHED"),
    ("drugs", "???", "UNMATCHED"),
]


def _map(spark, rows, entries, **kw):
    m = spark.createDataFrame([(k, t, x, "clash") for k, (t, x) in enumerate(rows)], "id long, kind string, text string, canonical string")
    e = spark.createDataFrame(entries, "type string, name string, canonical string, ord int")
    return {r["id"]: r["canonical"] for r in canonical.map_names(m, e, "id", "kind", "text", **kw).collect()}


def test_cases(spark):
    got = _map(spark, [(t, x) for t, x, _ in CASES], ENTRIES)
    assert [got[k] for k in range(len(CASES))] == [c for _, _, c in CASES]


def test_a_list_that_stays_a_table_gives_the_same(spark):
    names = [f"brakelmo{c}or{d}" for c in "tksx" for d in ("", "a", "pex")] + ["brakelmotor", "brakelmotos"]
    entries = ENTRIES + [("companies", n, f"C {n}", k) for k, n in enumerate(names)]
    rows = [(t, x) for t, x, _ in CASES] + [("companies", x) for x in ("brakelmotox", "brakelmotor", "the brakelmosorpex group", "brakelmozor", "zebrel bio and glexwista", "glexwista or gngg")] + [("roles", "glexwista")]
    assert _map(spark, rows, entries, most_keys=0) == _map(spark, rows, entries)


def test_two_entries_as_near_as_each_other_are_no_answer(spark):
    entries = [("companies", "brakelmotor", "A", 1), ("companies", "brakelmotos", "B", 2)]
    for most in (0, 100):
        assert _map(spark, [("companies", "brakelmotox"), ("companies", "brakelmotor")], entries, most_keys=most) == {0: "UNMATCHED", 1: "A"}


def test_names_of_many_words_and_many_near_names(spark):
    long = "the international zorvex kelmori plantaris quendol vastrin foundation of upper marisk"
    entries = [("companies", long, "Long", 1)] + [("companies", f"plimdraxo{a}{b}", f"P {a}{b}", 2) for a in "abcdef" for b in "ghijkl"]
    got = _map(spark, [("companies", long), ("companies", "ask " + long.replace("plantaris", "plantarsi") + " about it"), ("companies", "plimdraxock")], entries)
    assert got == {0: "Long", 1: "Long", 2: "P ck"}


def test_repeats_long_texts_and_empty_tables(spark):
    got = _map(spark, [("companies", "glexwista")] * 3 + [("companies", "glexwista " + "x" * 20_000)], ENTRIES)
    assert set(got.values()) == {"Glexwista"}
    assert _map(spark, [("companies", "glexwista")], []) == {0: "UNMATCHED"}
    assert _map(spark, [], ENTRIES) == {}


def test_index_finds_what_brute_force_finds():
    """Recall of the index, at the threshold in use, against the edit check on all names, for as many edits as it allows."""
    import inspect
    import random

    rng = random.Random(7)
    least = inspect.signature(canonical.map_names).parameters["least"].default
    names = sorted({"".join(rng.choice(["bra", "kel", "mo", "tri", "vax", "quo", "sin", "der", "plu", "zan"]) for _ in range(4)) for _ in range(400)})
    index = canonical.Index([(n, n, len(n)) for n in names], canonical.weigh(names))
    hit = total = 0
    for n in names[:150]:
        typo = list(n)
        for _ in range(rng.randrange(1, canonical.allowed(len(n)) + 1)):
            k = rng.randrange(len(typo))
            typo[k : k + 1] = rng.choice([[], [rng.choice("aeiou")], [typo[k], rng.choice("xyz")]])
        typo = "".join(typo)
        near = {m for m in names if canonical.checked(typo, m, len(m))}
        found = {index.names[i] for _, i, _ in index.search([typo], least)}
        hit, total = hit + len(near & found), total + len(near)
    assert hit / total >= 0.98
