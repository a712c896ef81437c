import random
import unicodedata

from notewright.llm import leakage

WORDS = [f"{a}{b}" for a in "bra kel mo tri vax quo sin der plu zan fio gra".split() for b in "tor mik las ven dro pil".split()]


def _text(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n)]


def _brute(item, doc, least=20, per=8):
    """Whether any run of item words of that length or more has an alignment with few enough changes; all starts, all ends."""
    n, m = len(item), len(doc)
    for i in range(n):
        row = [0] * (m + 1)
        for k in range(i, n):
            new = [row[0] + 1]
            for j in range(1, m + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (item[k] != doc[j - 1])))
            row = new
            if k - i + 1 >= least and min(row) * per <= k - i + 1:
                return True
    return False


def test_agrees_with_brute_force():
    rng = random.Random(5)
    for trial in range(60):
        item = _text(rng, rng.randrange(20, 45))
        span = rng.randrange(10, len(item) + 1)
        at = rng.randrange(0, len(item) - span + 1)
        piece = item[at : at + span]
        for _ in range(rng.randrange(0, span // 6 + 1)):
            k = rng.randrange(len(piece))
            kind = rng.randrange(3)
            piece[k : k + 1] = [] if kind == 0 else ["other"] if kind == 1 else [piece[k], "added"]
        doc = _text(rng, 12) + piece + _text(rng, 12)
        own = {1: item}
        assert bool(leakage.passages(doc, own, leakage.automaton(own), 20, 8)) == _brute(item, doc), trial


def test_folding_and_offsets():
    text = "Ein Äpfel­baum &eacute;tait r&#233;gl\u00c3\u00a9, co-\n  operation"
    ws, at = leakage.folded_words(text, offsets=True)
    assert ws == ["ein", "apfelbaum", "etait", "regle", "cooperation"]
    assert text[at[0][0] : at[0][1]] == "Ein" and text[at[4][0] : at[4][1]] == "co-\n  operation"
    assert leakage.folded_words(unicodedata.normalize("NFD", "préliminaire"))[0] == ["preliminaire"]


def test_shared_wording_copies_and_empty(spark):
    rng = random.Random(9)
    a, b, ask = " ".join(_text(rng, 24)), " ".join(_text(rng, 24)), "Read the note below and answer the question that is put to you after it in as few words as you can, please, now."
    items = spark.createDataFrame([(1, f"{ask} {a}."), (2, f"{ask} {b}."), (3, None), (4, " "), (5, "too short")], "item long, text string")
    docs = [(1, f"x. {a.upper()} y"), (2, f"x. {a} y"), (3, ask), (4, None), (5, ""), (6, " ".join(a.split()[:15])), (7, "filler " * 20_000 + a + " " + b), (8, a.replace(" ", ",\n"))]
    d = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc long, text string, item_text int")
    got = leakage.leaked(d, items, "doc", "text", "item", "text")
    assert sorted((r.doc, r["item"]) for r in got.collect()) == [(1, 1), (2, 1), (7, 1), (7, 2), (8, 1)]
    r = got.where("doc = 2").collect()[0]
    assert docs[1][1][r.begin : r.end] == a
    assert leakage.leaked(d.limit(0), items, "doc", "text", "item", "text").count() == 0
    assert leakage.leaked(d, items.limit(0), "doc", "text", "item", "text").count() == 0
