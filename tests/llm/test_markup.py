import pytest

from notewright.llm import markup

PLAIN = [
    "We need 5 * 3 * 2 wells per arm.",
    "Folder is C:\\data\\plates\\new on the old disk.",
    "Budget moved from $45M to $30M in two steps.",
    "Use a/b ~ 2 & c = d. A -> B -> C, then back <- A.",
    "The effect held (p < 0.05, n > 30) in both arms. Item #3 is closed.",
    "Range [3, 5] was typed as {3, 5}. Version 2.1.0 == version 2.1 here.",
    "The table uses plate_id_v2 and well_pos as keys. R&D and C# disagree.",
    "Line one\n\nLine  two with   blanks \n",
    "",
    "   ",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_stays(text):
    assert markup.clean(text) == (text, False, {})


CASES = [
    ("# One\n\nTwo\n===\n\nThree\n---\n\n## Four ## \n", {"heading": 4}),
    ("<h2 class='t'>A</h2><H3><b>B</b></H3>", {"heading": 2}),
    ("== A ==\n\n==B==\n\nthis ==is marked== text", {"heading": 2}),
    ("\\section{A}\n\\subsection*{B}\n\\paragraph{C}", {"heading": 3}),
    ("- a\n  - b\n+ c\n1. d\n2) e\n- [x] f", {"list_item": 6}),
    ("*a b c\n** d\n*e* is stressed here", {"list_item": 2}),
    ("<ul><li>a<ul><li>b</li></ul></li><LI>c</ul>", {"list_item": 3}),
    ("\\begin{itemize}\n\\item a\n  \\item b\n\\end{itemize}", {"list_item": 2}),
    ("```r\n# no heading\n- no item\n$x$\n```\n\n````\n```\n````\n~~~\nopen <b>", {"code_block": 3}),
    ("<pre><code># x\n&lt;b&gt;</code></pre>\n<PRE class='src'>open", {"code_block": 2}),
    ("<syntaxhighlight lang='sh'>\n# x\n</syntaxhighlight>\n<source>y</source>", {"code_block": 2}),
    ("\\begin{lstlisting}[numbers=left]\n\\item x\n\\end{lstlisting}\n\\begin{verbatim}\n$a^2$", {"code_block": 2}),
    ("inline `code` and <code>more $1</code>", {}),
    ("Here $a^2 + b^2$ and \\(y = x\\).\n\n$$\nE = m\n$$\n\n\\[z\\]\n<math>k_d</math>\n\\begin{align*}\nx &= y\n\\end{align*}", {"formula": 6}),
    ('<span class="math">\\(a^2\\)</span> <script type="math/tex">b_1</script>', {"formula": 2}),
    ("---\ntags: [a]\nstatus: draft\n---\n\ntext", {}),
    ("| a | b |\n|:--|--:|\n| # c | - d |", {}),
    ("<table><tr><td><li>x</td></tr></table>", {}),
    ("{| class='w'\n|-\n| * a || == b ==\n|}", {}),
    ("{{Infobox note\n|owner=x\n}}\n[[Category:y]]", {}),
    ("a [link](http://x.y) ![pic](p.png) [[page|shown]] [http://x.y shown] [^1] ''i'' '''b''' &amp; <br/> \\cite{k} {{note|in}}", {}),
]


@pytest.mark.parametrize("text,counts", CASES)
def test_elements(text, counts):
    _, marked, got = markup.clean(text)
    assert marked and got == counts


def test_clean_text_is_kept_and_marked():
    text = "<h2>Title</h2><p>One &lt; <b>two</b>.</p><ul><li><p>item</p></li></ul><pre># c\n&lt;b&gt;</pre>See \\(x^2\\)."
    assert markup.clean(text)[0] == "## Title\n\nOne < two.\n\n- item\n\n```\n# c\n<b>\n```\nSee $x^2$."


def test_clean_text_of_clean_text_has_the_same_elements():
    for text, _ in CASES:
        once, _, counts = markup.clean(text)
        if "|" in text or "<table" in text:  # a cell's text is free to look like a heading
            continue
        assert markup.clean(once)[2] == counts, text


def test_rows(spark):
    df = spark.createDataFrame([(1, "# a\n- b\n- c", 0), (2, None, 0), (3, " ", 0), (4, "plain", 0), (5, "# a\n- b\n- c", 0), (6, "x " * 50_000 + "**b**", 0)], "id long, text string, elem_no int")
    got = sorted((r.id, r.elem_kind, r.elem_no) for r in markup.elements(df, "id", "text").collect())
    own = [("heading", 1), ("list_item", 1), ("list_item", 2), ("residue", 0)]
    assert got == [(1, *x) for x in own] + [(5, *x) for x in own] + [(6, "residue", 0)]
    assert markup.elements(df.limit(0), "id", "text").count() == 0
    assert markup.cleaned(df, "id", "text").where("id = 4").first().clean_text == "plain"
