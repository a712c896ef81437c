"""Markup residue turned into clean text that keeps headings, list items, code blocks and formulas recognisable.

Each text is read once from left to right for the parts whose inside is not markup (code, formulas, tables, front
matter, comments); what is left is read by lines and then by spans. Clean text writes headings as ``#`` lines, items
as ``-`` lines, code between fences and formulas between dollar signs; a text without markup comes out unchanged.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESIDUE, HEADING, LIST_ITEM, CODE_BLOCK, FORMULA = "residue", "heading", "list_item", "code_block", "formula"
ELEMENTS = (HEADING, LIST_ITEM, CODE_BLOCK, FORMULA)

_MATH_ENV = r"(?:equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign)\*?"
# The parts read first. The first one that begins holds; an open code part runs to the end.
_PARTS = re.compile(
    r"""
    (?P<front>\A\s*---[ \t]*\n(?:[^\n]*\n)*?---[ \t]*(?=\n|\Z) | (?<![^\n]\n)(?<![^\n])---[ \t]*\n(?:[\w-]+:[^\n]*\n)+---[ \t]*(?=\n|\Z))
  | (?P<fence>^[ \t>]*(?P<mark>`{3,}|~{3,})(?P<lang>[^\n`]*)(?:\n|\Z)(?P<fenced>.*?)(?:^[ \t>]*(?P=mark)[`~]*[ \t]*$|\Z))
  | (?P<pre><pre\b[^>]*>(?P<pre_in>.*?)(?:</pre\s*>|\Z))
  | (?P<high><(?P<high_tag>syntaxhighlight|source)\b[^>]*>(?P<high_in>.*?)(?:</(?P=high_tag)\s*>|\Z))
  | (?P<listing>\\begin\{(?P<env>lstlisting|verbatim\*?|minted|alltt)\}(?:\[[^\]\n]*\])?(?P<listing_in>.*?)(?:\\end\{(?P=env)\}|\Z))
  | (?P<comment><!--.*?(?:-->|\Z))
  | (?P<nowiki><nowiki>(?P<nowiki_in>.*?)(?:</nowiki\s*>|\Z))
  | (?P<mathtag><math\b[^>]*>(?P<mathtag_in>.*?)</math\s*>)
  | (?P<mathscript><script\b[^>]*math/(?:tex|asciimath)[^>]*>(?P<mathscript_in>.*?)</script\s*>)
  | (?P<script><(?P<script_tag>script|style)\b[^>]*>.*?(?:</(?P=script_tag)\s*>|\Z))
  | (?P<table><table\b[^>]*>(?P<table_in>.*?)(?:</table\s*>|\Z))
  | (?P<wikitable>^[ \t]*\{\|(?P<wikitable_in>.*?)(?:^[ \t]*\|\}|\Z))
  | (?P<infobox>\{\{\s*infobox\b(?P<infobox_in>.*?)(?:^\s*\}\}|\Z))
  | (?P<tabular>\\begin\{(?P<tabenv>tabular[*x]?|longtable|array)\}(?P<tabular_in>.*?)(?:\\end\{(?P=tabenv)\}|\Z))
  | (?P<display>\$\$(?P<display_in>(?:[^$]|\\\$)+?)\$\$ | \\\[(?P<square_in>.+?)\\\] | \\begin\{(?P<mathenv>MATHENV)\}(?P<mathenv_in>.+?)\\end\{(?P=mathenv)\})
  | (?P<round>\\\((?P<round_in>.+?)\\\))
  | (?P<code_tag><(?P<code_name>code|tt|kbd|samp)\b[^>]*>(?P<code_in>[^<\n]*?)</(?P=code_name)\s*>)
  | (?P<tick>(?<!`)(?P<ticks>`{1,2})(?!`)(?P<tick_in>[^`\n]+?)(?P=ticks)(?!`))
  | (?P<inline>(?<![\\$\w])\$(?![\s$])(?P<inline_in>[^$\n]{1,300}?)(?<![\s\\])\$(?![\d$\w]))
    """.replace("MATHENV", _MATH_ENV),
    re.X | re.I | re.M | re.S,
)
# Where a part can begin; every part begins with one of these, so no other place is tried.
_BEGIN = re.compile(r"^[ \t>]*(?=[`~]{3}|\{\|)|\A\s*---|^---|[<\\{$`]", re.M)
# A part that begins so and needs an end is none where its end never follows. Without this each unclosed one would be
# read to the end of the text.
_NEEDS = re.compile(r"(?P<math><math\b)|(?P<square>\\\[)|(?P<round>\\\()|\\begin\{(?P<env>MATHENV)\}".replace("MATHENV", _MATH_ENV), re.I)
_ENDS = {"math": "</math", "square": "\\]", "round": "\\)"}
_FORMULA_LIKE = re.compile(r"[\\^_=<>+*/]|^\w{1,3}$|^[A-Za-z]\(")

_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?(?:[ \t]*\{[#.][^{}\n]*\})?[ \t]*$")
_WIKI_HEAD = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(?:={3,}|-{3,})[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^([ \t]*)(?:[-+*•]|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)")
_WIKI_ITEM = re.compile(r"^(\*[*#:]*)[ \t]*(?=[^\s*])")
_LEAD_EMPHASIS = re.compile(r"^(\*{1,3})(?=[^\s*])[^*\n]{1,120}?(?<=[^\s*])\1(?![\w*])")
_QUOTE = re.compile(r"^[ \t]*>[ \t]?")
_TEX_HEAD = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?[ \t]*(?:\[[^\]\n]*\])?\{((?:[^{}\n]|\{[^{}\n]*\})*)\}?")
_HTML_HEAD = re.compile(r"<h([1-6])\b[^>]*>\s*(.*?)(?:\s*</h\1\s*>|(?=<(?:h[1-6]|p|div|ul|ol|pre|table)\b)|\n|\Z)", re.I | re.S)
_LI = re.compile(r"\s*<li\b[^>]*>\s*(?:<p\b[^>]*>\s*)?", re.I)
_TEX_ITEM = re.compile(r"\s*\\item(?![A-Za-z])[ \t]*(?:\[[^\]\n]*\])?[ \t]*")
_DEPTH = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?/?>")
_CUT_TAG = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9]*(?:\s+[\w-]+=[^<>]*)?)?\Z")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_BLOCK_TAG = re.compile(r"</?(?:p|div|br|ul|ol|li|h[1-6]|table|tr|blockquote|hr|section|article|body|html|head)\b[^>]*>", re.I)
_REF = re.compile(r"<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref\s*>", re.I | re.S)
_EMPTY_REF = re.compile(r"<ref\b[^>/]*/>", re.I)
# Spans in the order in which they are taken off: what each holds for certain, its pattern, and what stays of it.
_SPANS: list[tuple[str, re.Pattern, str]] = [
    ("[[", re.compile(r"^\[\[(?:Category|Kategorie|Catégorie|Categoría):[^\]\n]*\]\][ \t]*\n?", re.I | re.M), ""),
    ("[[", re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo):[^\]\n]*\]\]", re.I), ""),
    ("[[", re.compile(r"\[\[[^\[\]\n|]*\|([^\[\]\n]*)\]\]"), r"\1"),
    ("[[", re.compile(r"\[\[([^\[\]\n]+)\]\]"), r"\1"),
    ("![", re.compile(r"!\[([^\]\n]*)\]\([^()\n]*\)"), r"\1"),
    ("](", re.compile(r"\[([^\[\]\n]+)\]\((?:[^()\s]*)(?:[ \t]+\"[^\"\n]*\")?\)"), r"\1"),
    ("://", re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]"), r"\1"),
    ("://", re.compile(r"\[(?:https?|ftp)://[^\s\]]+\]"), ""),
    ("[^", re.compile(r"\[\^[\w-]+\](?::[^\n]*)?"), ""),
    ("{{", re.compile(r"\{\{[^{}\n|]+\|([^{}\n|]*)(?:\|[^{}\n]*)?\}\}"), r"\1"),
    ("{{", re.compile(r"\{\{[^{}\n]*\}\}"), ""),
    ("''", re.compile(r"'{5}(?=\S)(.+?)'{5}|'{3}(?=\S)(.+?)'{3}|'{2}(?=[^\s'])(.+?)'{2}"), r"\1\2\3"),
    ("***", re.compile(r"(?<![*\w\\])\*{3}(?=[^\s*])([^*\n]+?)(?<=[^\s*\\])\*{3}(?![\w*])"), r"\1"),
    ("**", re.compile(r"(?<![*\w\\])\*{2}(?=[^\s*])([^*\n]+?)(?<=[^\s*\\])\*{2}(?![\w*])"), r"\1"),
    ("*", re.compile(r"(?<![*\w\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*\\])\*(?![\w*])"), r"\1"),
    ("_", re.compile(r"(?<![_\w\\])_{1,3}(?=[^\s_])([^_\n]+?)(?<=[^\s_\\])_{1,3}(?![\w])"), r"\1"),
    ("~~", re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~"), r"\1"),
    ("==", re.compile(r"(?<![=\w])==(?=[^\s=])([^=\n]+?)(?<=[^\s=])==(?![=])"), r"\1"),
    ("\\href", re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)\}"), r"\1"),
    ("\\", re.compile(r"[ \t~]*\\(?:cite[pt]?|ref|eqref|label|footnote|footnotemark|url|pageref|autoref|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    ("\\", re.compile(r"\\(?:documentclass|usepackage|title|author|date|begin|end|bibliography(?:style)?|includegraphics|input)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}(?:\{[^{}\n]*\})?"), ""),
    ("\\", re.compile(r"\\(?:emph|text(?:bf|it|tt|sc|rm|sf|up|sl)?|underline|mbox|caption|textsuperscript|textsubscript)\{([^{}\n]*)\}"), r"\1"),
    ("\\", re.compile(r"\\([%&#])|(?<=\w)\\(_)(?=\w)"), r"\1\2"),
    ("\\", re.compile(r"\\(?:maketitle|tableofcontents|noindent|newpage|clearpage|bigskip|medskip|smallskip|centering|par|hline)(?![A-Za-z])[ \t]*"), ""),
]
_HINT = re.compile(r"[<&\\`$*_~=#\[{|>+'-]|^\s*(?:\d{1,3}[.)]|•)\s", re.M)


class _Reader:
    def __init__(self, text: str):
        self.counts: Counter = Counter()
        self.marked = False
        self.kept: list[str] = []
        self.text = text

    def keep(self, s: str) -> str:
        self.kept.append(s)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def parts(self, text: str) -> str:
        out: list[str] = []
        at = done = 0
        ends: dict[str, int] = {}
        low = ""
        while m := _BEGIN.search(text, at):
            at = m.start()
            if need := _NEEDS.match(text, at):
                low = low or text.lower()
                end = f"\\end{{{need['env'].lower()}}}" if need["env"] else _ENDS[need.lastgroup]
                if end not in ends:
                    ends[end] = low.rfind(end)
                if ends[end] < at:
                    at += 1
                    continue
            part = _PARTS.match(text, at)
            if part is None or part.end() == at:
                at += 1
                continue
            out += [text[done:at], self.part(part)]
            at = done = part.end()
        out.append(text[done:])
        return "".join(out)

    def part(self, m: re.Match) -> str:
        g = m.groupdict()
        whole = m.group()
        name = next(k for k in ("front", "fence", "pre", "high", "listing", "comment", "nowiki", "mathtag", "mathscript", "script", "table", "wikitable", "infobox", "tabular", "display", "round", "code_tag", "tick", "inline") if g[k] is not None)
        if name == "inline":
            if not _FORMULA_LIKE.search(g["inline_in"]):
                return whole
            return self.formula(g["inline_in"], False)
        self.marked = True
        if name == "fence":
            return self.code(g["fenced"], g["lang"].strip(), "\n" if whole.endswith("\n") else "")
        if name in ("pre", "high", "listing"):
            inside = g["pre_in"] if name == "pre" else g["high_in"] if name == "high" else g["listing_in"]
            if name == "pre":
                inside = html.unescape(re.sub(r"</?(?:code|span)\b[^<>]*>|<code\b[^<>]*\Z", "", inside, flags=re.I))
            return "\n" + self.code(inside, "") + "\n"
        if name in ("display", "mathtag", "mathscript"):
            inside = next(x for x in (g["display_in"], g["square_in"], g["mathenv_in"], g["mathtag_in"], g["mathscript_in"]) if x is not None)
            return self.formula(inside, name == "display" or "block" in whole[:40])
        if name == "round":
            return self.formula(g["round_in"], False)
        if name in ("code_tag", "tick"):
            return self.keep(html.unescape(g["code_in"]) if name == "code_tag" else g["tick_in"])
        if name == "nowiki":
            return self.keep(g["nowiki_in"])
        if name in ("table", "wikitable", "tabular", "infobox"):
            return self.keep("\n" + _cells(name, next(x for x in (g["table_in"], g["wikitable_in"], g["tabular_in"], g["infobox_in"]) if x is not None)) + "\n")
        return ""

    def code(self, inside: str, lang: str, tail: str = "") -> str:
        self.counts[CODE_BLOCK] += 1
        inside = inside.strip("\n")
        fence = "```"
        while fence in inside:
            fence += "`"
        return self.keep(f"{fence}{lang}\n{inside}\n{fence}") + tail

    def formula(self, inside: str, display: bool) -> str:
        self.marked = True
        self.counts[FORMULA] += 1
        inside = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", " ", inside))).strip()
        return self.keep(f"$${inside}$$" if display else f"${inside}$")

    def heading(self, level: int, title: str) -> str:
        self.marked = True
        self.counts[HEADING] += 1
        return "\ue002" + "#" * level + " " + title.strip()

    def item(self, depth: int) -> str:
        self.marked = True
        self.counts[LIST_ITEM] += 1
        return "\ue002" + "  " * depth + "- "

    def lines(self, text: str) -> str:
        out: list[str] = []
        for line in text.split("\n"):
            if _SETEXT.match(line) and out and out[-1].strip() and out[-1][0] not in "\ue000\ue002":
                if not _ROW.match(out[-1]):
                    out[-1] = self.heading(1 if "=" in line else 2, out[-1])
                    continue
            if _ROW.match(line):
                self.marked = True
                cells = [c.strip() for c in line.strip().strip("|").split("|")]
                if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                    out.append("\ue002" + " | ".join(cells))
                continue
            if _RULE.match(line) and not _ITEM.match(line):
                self.marked = True
                out.append("")
                continue
            if m := _ATX.match(line):
                out.append(self.heading(len(m[1]), m[2]))
                continue
            if m := _WIKI_HEAD.match(line):
                out.append(self.heading(len(m[1]), m[2]))
                continue
            if _QUOTE.match(line) and len(line.strip()) > 1:
                self.marked = True
                line = _QUOTE.sub("", line)
            if m := _ITEM.match(line):
                line = self.item(len(m[1].expandtabs(4)) // 2) + line[m.end() :]
            elif (m := _WIKI_ITEM.match(line)) and (len(m[1]) > 1 and line[len(m[1]) : len(m[1]) + 1] in " \t" or not _LEAD_EMPHASIS.match(line)):
                line = self.item(len(m[1]) - 1) + line[m.end() :]
            elif line[:1] == ":" and re.match(r":+[ \t]*\ue000", line):
                self.marked = True
                line = line.lstrip(": \t")
            out.append(line)
        return "\n".join(out)

    def run(self) -> str:
        text = self.text
        if not _HINT.search(text):
            return text
        text = self.parts(text.replace("\r\n", "\n"))
        if "<" in text:
            low = text.lower()
            if "<ref" in low:
                # Behind the last end of a note there can only be notes without text.
                last = text.find(">", max(low.rfind("</ref"), 0)) + 1 if "</ref" in low else 0
                text = _REF.sub(self._drop, text[:last]) + _EMPTY_REF.sub(self._drop, text[last:])
            text = _HTML_HEAD.sub(lambda m: "\n" + self.heading(int(m[1]), re.sub(r"\s+", " ", m[2])) + "\n", text)
            text = _LI.sub(lambda m: "\n" + self.item(0), text)
        if "\\" in text:
            text = _TEX_HEAD.sub(lambda m: self.heading(_DEPTH[m[1]], m[2]) + "\n", text)
            text = _TEX_ITEM.sub(lambda m: "\n" + self.item(0), text)
        text = self.lines(text)
        if "<" in text:
            text = _BLOCK_TAG.sub(self._break, text)
            text = _TAG.sub(self._drop, text)
            text = _CUT_TAG.sub(self._drop, text) if self.marked else text
        for held, pattern, stays in _SPANS:
            if held in text:
                text, n = pattern.subn(stays, text)
                self.marked |= n > 0
        if "&" in text and _ENTITY.search(text):
            self.marked = True
            for _ in range(2):
                text = html.unescape(text)
            text = _TAG.sub("", re.sub(r"(?s)<!--.*?-->", "", text))
        if not self.marked:
            return self.text
        text = text.replace("\ue002", "")
        for _ in range(3):
            if "\ue000" not in text:
                break
            text = re.sub(r"\ue000(\d+)\ue001", lambda m: self.kept[int(m[1])], text)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()

    def _drop(self, m: re.Match) -> str:
        self.marked = True
        return ""

    def _break(self, m: re.Match) -> str:
        self.marked = True
        return "\n"


def _cells(kind: str, inside: str) -> str:
    """A table's or box's cells as plain lines."""
    if kind == "table":
        rows = re.split(r"</?tr\b[^>]*>", inside, flags=re.I)
        cells = [[html.unescape(_TAG.sub("", c)).strip() for c in re.split(r"</?t[dh]\b[^>]*>", r, flags=re.I)] for r in rows]
    elif kind == "wikitable":
        cells = [[c.strip() for c in re.split(r"\|\||!!|^[|!]", r, flags=re.M)] for r in re.split(r"^\|-.*$", inside.partition("\n")[2], flags=re.M)]
    elif kind == "tabular":
        cells = [[c.strip() for c in re.sub(r"\\hline", "", r).split("&")] for r in re.sub(r"^\{[^{}]*\}", "", inside).split("\\\\")]
    else:
        cells = [[p.strip() for p in r.strip().lstrip("|").split("=", 1)] for r in inside.split("\n")[1:]]
    return "\n".join(line for r in cells if (line := " | ".join(c for c in r if c)))


def clean(text: str) -> tuple[str, bool, dict[str, int]]:
    """(clean text, whether it held any markup, its elements by kind)."""
    r = _Reader(text)
    out = r.run()
    return out, r.marked, {k: r.counts[k] for k in ELEMENTS if r.counts[k]}


def _apply(records: DataFrame, id_col: str, text_col: str, batch_of, schema: str) -> DataFrame:
    """Texts are read whole and each by itself: no shuffle, and no text waits for another's."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield batch_of(batch.column(0), texts, {t: clean(t) for t in dict.fromkeys(texts)})  # a repeated text is read once a batch

    return records.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {schema}")


def elements(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, elem_kind, elem_no): a row ``residue``/0 for a text that holds any markup, and one for each heading, list
    item, code block and formula, counted from 1 in each record and kind. Null texts, blank ones and those without
    markup give no rows; repeated records give theirs each."""

    def of(ids: pa.Array, texts: list[str], read: dict) -> pa.RecordBatch:
        at, kinds, numbers = [], [], []
        for k, t in enumerate(texts):
            _, marked, counts = read[t]
            if marked:
                at.append(k)
                kinds.append(RESIDUE)
                numbers.append(0)
                for kind, n in counts.items():
                    at.extend([k] * n)
                    kinds.extend([kind] * n)
                    numbers.extend(range(1, n + 1))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(numbers, pa.int64())], names=[id_col, "elem_kind", "elem_no"])

    return _apply(records, id_col, text_col, of, "elem_kind string, elem_no long")


def cleaned(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, clean_text, had_markup) of every record with a text; texts without markup come out unchanged."""

    def of(ids: pa.Array, texts: list[str], read: dict) -> pa.RecordBatch:
        done = [read[t] for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.bool_())], names=[id_col, "clean_text", "had_markup"])

    return _apply(records, id_col, text_col, of, "clean_text string, had_markup boolean")
