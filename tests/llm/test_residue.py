import random

import pytest

from notewright.llm import residue

NOTES = ["The {w} team measured {w} and {w} again.", "Costs for the {w} readout rose by {n} percent.", "It is not clear why {w} should depend on {w} at all.", "Plates for {w} arrived.", "We asked {w} for a second look at the {w} dose."]
TALK = ["The mail template with {{{{first_name}}}} was corrected for {w}.", "Owner field was TBD and is now filled for {w}.", "Enable JavaScript in the kiosk browser, the dashboard for {w} needs it.", "The phrase [insert date] in the {w} form must be explained."]
FORM = ["Dear {s},", "Date: {s}", "Attendees: {s}", "Owner: {s} / {s}", "Decision on {s} by {s}", "Next steps: {s}"]
PAGE = ["JavaScript is disabled in your browser.", "Please enable JavaScript to view this note.", "404 Not Found", "Internal server error while rendering page.", "Sign in", "Reload", "Your session has expired, sign in again.", "Scripts are blocked; the page cannot be shown without them."]
FILL = ["Insert description here.", "Lorem ipsum dolor sit amet consectetur.", "Sed labore magna aliqua tempor.", "Text text text text.", "Sample text, replace before use."]


def _w(rng):
    return "".join(rng.choice(["bra", "kel", "mo", "tri", "vax", "quo", "zan"]) for _ in range(3))


def _make(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = k % 10
        if kind == 0:
            slot = rng.choice(["{{%s}}", "<<%s>>", "[[%s]]", "%%%s%%", "${%s}", "{%% %s %%}"])
            ps = [rng.choice(FORM).replace("{s}", slot % rng.choice(["owner", "site", "study_id"])) for _ in range(rng.randrange(2, 7))]
        elif kind == 1:
            ps = [rng.choice(PAGE) for _ in range(rng.randrange(2, 6))] + [rng.choice(PAGE[:4])]
        elif kind == 2:
            ps = [rng.choice(FILL) for _ in range(rng.randrange(2, 6))]
        else:
            ps = [rng.choice(NOTES + (TALK if rng.random() < 0.3 else [])).format(w=_w(rng), n=rng.randrange(99)) for _ in range(rng.randrange(1, 9))]
        out.append((k, (f"{_w(rng).title()} review\n\n" if rng.random() < 0.5 else "") + rng.choice(["\n", " "] if kind > 0 else ["\n"]).join(ps), kind < 3))
    return out


@pytest.fixture(scope="module")
def model():
    return residue.learn_from([t for _, t, _ in _make(1, 3000)])


def test_held_out_accuracy(model):
    rows = _make(2, 1500)
    got = [residue.is_residue(residue.judge(t, model), 0.45) for _, t, _ in rows]
    hit = sum(g and w for g, (_, _, w) in zip(got, rows))
    assert hit / sum(got) > 0.98 and hit / sum(w for _, _, w in rows) > 0.95


def test_talk_about_residue_is_none(model):
    for t in TALK:
        assert not residue.is_residue(residue.judge(t.format(w="brakelmo"), model), 0.45), t


def test_rows(spark, model):
    df = spark.createDataFrame([(1, "404 Not Found", 0), (2, None, 0), (3, "  ", 0), (4, "Plates for brakelmo arrived.", 0), (5, "404 Not Found", 0), (6, "Costs for the brakelmo readout rose by 4 percent. " * 4000, 0)], "id long, text string, is_residue int")
    assert sorted(r.id for r in residue.residue_records(df, "id", "text", model=model).collect()) == [1, 5]
    assert residue.residue_records(df.limit(0), "id", "text", model=model).count() == 0
    scored = residue.residue_records(df, "id", "text", model=model, scores=True)
    assert scored.count() == 4


def test_learning_reads_a_bounded_sample(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in _make(3, 1200)], "id long, text string")
    found = {r.id for r in residue.residue_records(df, "id", "text").collect()}
    want = {k for k, _, w in _make(3, 1200) if w}
    assert len(found & want) > 0.9 * len(want) and len(found - want) < 0.03 * len(want)


REPEATED = ["Something went wrong, please try again.", "Insert text here.", "Text folgt.", "asdf asdf"]


@pytest.mark.parametrize("wording", REPEATED)
def test_repeated_residue_is_never_neutral(wording):
    notes = [t for _, t, w in _make(4, 1000) if not w]
    for copies in ([wording] * 60, [f"{_w(random.Random(k)).title()} review\n\n{wording}" for k in range(60)], [f"{wording}\n{PAGE[k % 8]}\n{PAGE[k // 8 % 8]}" for k in range(60)]):
        model = residue.learn_from(notes + copies)
        assert residue.passage_key(wording) not in model.neutral


def _pool(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 7))).capitalize() + "." for _ in range(n)]


def test_wording_of_no_list_is_learned_from_the_collection():
    """Error pages and filler in invented words, none of which any pattern knows: they are told by coming again in records
    that say nothing else. Recall and precision on records that were not fitted on."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    pages, fill = _pool(rng, 14, words[:40]), _pool(rng, 5, words[40:])

    def make(n):
        out = []
        for k in range(n):
            kind = rng.randrange(20)
            if kind == 0:
                t = "\n".join(rng.choice(pages) for _ in range(rng.randrange(2, 6)))
            elif kind == 1:
                t = " ".join([rng.choice(fill)] * rng.randrange(3, 8))
            else:
                ps = [rng.choice(NOTES).format(w=_w(rng) + _w(rng), n=rng.randrange(99)) for _ in range(rng.randrange(1, 9))]
                if rng.random() < 0.05:  # a note that quotes such text
                    ps.insert(0, f"The viewer showed {rng.choice(pages)}")
                t = "\n".join(ps)
            out.append(((f"{_w(rng).title()} review\n\n" if rng.random() < 0.5 else "") + t, kind < 2))
        return out

    model = residue.learn_from([t for t, _ in make(6000)])
    rows = make(3000)
    got = [residue.is_residue(residue.judge(t, model), 0.45) for t, _ in rows]
    hit, want = sum(g and w for g, (_, w) in zip(got, rows)), sum(w for _, w in rows)
    assert hit / want >= 0.95 and hit / sum(got) >= 0.95, (hit, want, sum(got))


def test_trusted_records_say_nothing_of_their_own():
    rng = random.Random(4)
    notes = ["\n".join(rng.choice(NOTES).format(w=_w(rng) + _w(rng), n=rng.randrange(99)) for _ in range(3)) for _ in range(300)] + ["Call moved to Friday."] * 40
    pages = ["\n".join(random.Random(k).sample(PAGE, 3)) for k in range(60)]
    slots = ["Dear {{name}},\nDate: <<date>>", "Hier text. Hier text. Hier text."]
    trusted, closed, _ = residue.trust([residue.split_passages(t) for t in notes + pages + slots])
    assert not any(i < len(notes) for i in trusted)
    assert {len(notes) + len(pages), len(notes) + len(pages) + 1} <= trusted and sum(i >= len(notes) for i in trusted) > 50
    assert residue.passage_key(PAGE[0]) in closed
    assert residue.trust([]) == (set(), set(), set()) and residue.trust([[], ["note"]])[0] == set()


def test_a_footer_in_many_different_notes_stays_neutral():
    foot = "Exported automatically from the shared notebook."
    notes = [t + "\n" + foot for _, t, w in _make(4, 1000) if not w]
    model = residue.learn_from(notes + [foot] * 20)
    assert residue.passage_key(foot) in model.neutral
    assert not residue.is_residue(residue.judge(foot, model), 0.45)


def test_common_wordings_are_counted_over_all_records(spark):
    foot = "Kept in the shared notebook."
    notes = [t for _, t, w in _make(5, 2000) if not w]
    rows = [(k, f"{t}\n{foot}" if k % 40 == 0 else t) for k, t in enumerate(notes)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    assert residue.passage_key(foot) in residue.learn(df, "id", "text", sample=50).neutral
    few = residue.common_wordings(df.select("text"), 0.004, [])
    assert few == residue.common_wordings(df.select("text").repartition(3), 0.004, [t for _, t in rows])
    assert few == residue.common_wordings(df.select("text").union(df.select("text")), 0.004, [])


@pytest.mark.parametrize("n", [100, 1000, 10_000, 1_000_000])
def test_common_is_alike_at_every_size(n):
    assert residue.is_common(n * 4 // 100, n, 0.004)
    assert not residue.is_common(n // 300, n, 0.004) and not residue.is_common(1, n, 0.004)


def test_a_note_is_scored_no_further_than_its_decision_needs(model, monkeypatch):
    scored = []
    words = residue.passage_words
    monkeypatch.setattr(residue, "passage_words", lambda p, k: scored.append(p) or words(p, k))
    rng = random.Random(6)
    note = "\n".join(rng.choice(NOTES).format(w=_w(rng) + _w(rng), n=rng.randrange(99)) for _ in range(40))
    assert not residue.is_residue(residue.judge(note, model, 0.45), 0.45) and len(scored) <= 28


ODD = [*"aZ b.c !?…\n\n\t\r\x1c   09٣²½ÄßİΣé́-*#:_{}<>[]$@%X\x02中Ⅷ—“", "null", "N/A", "...", "__x__", "{{a}}", "<error>", "Note: a b c d", "- ", "1. ", "12:30 ", "\n3) ", ". "]


def test_texts_of_odd_characters_are_read_and_decided_alike(model):
    """Passages at once and one by one, whole texts and the part that decides; words are never more than allowed for."""
    rng = random.Random(9)
    some = residue.Model(model.odds, model.prior, neutral=frozenset({"a.", "page 0 of 0", "b 0.", "zz null", "date: 0"}))
    for k in range(4000):
        t = "".join(rng.choice([*ODD, *PAGE, "Page 3 of 7", "12:30 b ٣.", "Date: 4", "ZZ null"]) for _ in range(rng.randrange(40)))
        passages = residue.split_passages(t)
        assert residue.passage_keys(passages) == [residue.passage_key(p) for p in passages]
        for p in passages:
            assert len(residue.passage_words(p, 1)) <= 1 + residue.most_words(p)
            assert some.is_neutral(p) == (residue.passage_key(p) in some.neutral)
        for m in (model, some):
            assert residue.is_residue(residue.judge(t, m, 0.45), 0.45) == residue.is_residue(residue.judge(t, m), 0.45)
