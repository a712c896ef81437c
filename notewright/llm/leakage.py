"""Test passages inside training documents, to the letter or with small changes.

All word 5-grams of the test items are patterns of one Aho-Corasick automaton. Each text is folded (case, accents,
punctuation, encoding) and scanned once; every hit maps back to the words of the original. From each exact run the
passage is extended to both sides with as many replaced, added or dropped words as its length allows, which finds
every passage that meets the rule: at least ``least`` words with at most one change in ``per_change`` always hold an
unchanged run as long as a pattern.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 5

_TOKEN = re.compile(r"(?:[^\W_]|[̀-ͯ­​-‍⁠﻿])+")
_INVISIBLE = re.compile(r"[­​-‍⁠﻿]")
# What one character of the plain text can look like after bad exports: an entity, two or three misread bytes, a word
# broken at a line's end.
_DAMAGE = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,20});|[Â-Å][\u0080-¿Œ-žƒˆ˜–-™]|â€[\u0080-¿Œ-ž˜–-™]|(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_SENTENCE = re.compile(r"(?<=[.?!:;])\s+|\n+")


def _repair(m: re.Match) -> str:
    s = m.group()
    if s[0] == "&":
        out = html.unescape(s)
        return out if out != s else s
    if s[0] == "-":
        return ""
    try:
        return s.encode("cp1252", "strict").decode("utf-8")
    except UnicodeError:
        try:
            return s.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return s


def fold(word: str) -> str:
    if word.isascii():
        return word.lower()
    word = unicodedata.normalize("NFKD", _INVISIBLE.sub("", word)).casefold()
    return "".join(c for c in word if not unicodedata.combining(c))


def folded_words(text: str, offsets: bool = False) -> tuple[list[str], list[tuple[int, int]]]:
    """The folded words of a text and, if asked for, where each begins and ends in the original."""
    back = None
    if _DAMAGE.search(text):
        out, back, at = [], [], 0
        for m in _DAMAGE.finditer(text):
            out.append(text[at : m.start()])
            back.extend(range(at, m.start()))
            fixed = _repair(m)
            out.append(fixed)
            back.extend([m.start()] * len(fixed))
            at = m.end()
        out.append(text[at:])
        back.extend(range(at, len(text) + 1))
        text = "".join(out)
    if not offsets:
        return [w for w in map(fold, _TOKEN.findall(text)) if w], []
    found = [(fold(m.group()), m.span()) for m in _TOKEN.finditer(text)]
    found = [x for x in found if x[0]]
    return [w for w, _ in found], [s if back is None else (back[s[0]], back[s[1] - 1] + 1) for _, s in found]


def own_words(items: list[tuple[int, str]], several: int = 2) -> dict[int, list[str]]:
    """The folded words of each item without the sentences that ``several`` items or more share."""
    split = {i: [folded_words(s)[0] for s in _SENTENCE.split(t)] for i, t in items}
    shared = Counter(s for ss in split.values() for s in {tuple(s) for s in ss if s})
    return {i: [w for s in ss if shared[tuple(s)] < several for w in s] for i, ss in split.items()}


def automaton(own: dict[int, list[str]]) -> ahocorasick.Automaton:
    places: dict[str, list] = defaultdict(list)
    for i, ws in own.items():
        for k in range(len(ws) - SEED + 1):
            places[" " + " ".join(ws[k : k + SEED]) + " "].append((i, k))
    a = ahocorasick.Automaton()
    for p, at in places.items():
        a.add_word(p, at)
    a.make_automaton()
    return a


def _reach(a: list[str], i: int, b: list[str], j: int, step: int, most: int) -> list[tuple[int, int]]:
    """For 0..most changes the greatest number of words of ``a`` from i on (in direction ``step``) that words of
    ``b`` from j on follow, and how many words of ``b`` that takes."""
    left_a, left_b = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    left_a, left_b = max(left_a, 0), max(left_b, 0)

    def slide(x: int, y: int) -> int:
        n = 0
        while x + n < left_a and y + n < left_b and a[i + step * (x + n)] == b[j + step * (y + n)]:
            n += 1
        return n

    x = slide(0, 0)
    far = {0: x}  # by diagonal y - x the words of a
    out = [(x, x)]
    for e in range(1, most + 1):
        nxt: dict[int, int] = {}
        for d in range(-e, e + 1):
            x = -1
            if d in far:  # replaced
                x = max(x, far[d] + 1)
            if d - 1 in far:  # added in b
                x = max(x, far[d - 1])
            if d + 1 in far:  # dropped from a
                x = max(x, far[d + 1] + 1)
            if x < 0 or x > left_a or x + d > left_b or x + d < 0:
                continue
            nxt[d] = x + slide(x, x + d)
        far = nxt
        if not far:
            out.append(out[-1])
            continue
        best = max((x, -abs(d), d) for d, x in far.items())
        out.append((best[0], best[0] + best[2]) if best[0] > out[-1][0] else out[-1])
    return out


def passages(ws: list[str], own: dict[int, list[str]], patterns: ahocorasick.Automaton, least: int, per_change: int) -> dict[int, tuple[int, int, int, int]]:
    """By item the longest passage: (words of the item, changes, first word, last word + 1 of the text)."""
    if len(ws) < SEED:
        return {}
    line = " " + " ".join(ws) + " "
    hits: dict[int, list] = defaultdict(list)
    starts = None
    for end, at in patterns.iter(line):
        if starts is None:
            starts, p = {}, 0
            for k, w in enumerate(ws):
                starts[p] = k
                p += len(w) + 1
        pattern_length = end + 1
        for i, k in at:
            hits[i].append((k, pattern_length))
    if not hits:
        return {}
    # A passage of m words with e changes holds at least (m - e) - (e + 1)(SEED - 1) patterns.
    need = min(m - m // per_change - (m // per_change + 1) * (SEED - 1) for m in range(least, 6 * least))
    found: dict[int, tuple] = {}
    for i, at in hits.items():
        if len(at) < max(1, need):
            continue
        item = own[i]
        runs = set()
        for k, after in at:
            length = sum(len(w) + 1 for w in item[k : k + SEED])
            j = starts[after - 1 - length]
            runs.add((k, j))
        top = len(item) // per_change
        best = None
        for k, j in sorted(runs):
            if (k - 1, j - 1) in runs:
                continue
            n = 0
            while k + n < len(item) and j + n < len(ws) and item[k + n] == ws[j + n]:
                n += 1
            right = _reach(item, k + n, ws, j + n, 1, top)
            left = _reach(item, k - 1, ws, j - 1, -1, top)
            for el, (xl, yl) in enumerate(left):
                for er, (xr, yr) in enumerate(right):
                    m = xl + n + xr
                    if m >= least and (el + er) * per_change <= m and (best is None or (m, -(el + er)) > (best[0], -best[1])):
                        best = (m, el + er, j - yl, j + n + yr)
        if best:
            found[i] = best
    return found


def leaked(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, *, least: int = 20, per_change: int = 8, several: int = 2, most_items: int = 100_000) -> DataFrame:
    """(doc_id, item_id, item_words, changes, begin, end) for each document that holds a passage of an item; ``begin``
    and ``end`` are places in the original text (code points).

    A passage follows the item's text for ``least`` words on end or more, of which at most one in ``per_change`` is
    replaced, added or dropped; sentences that ``several`` items share do not count. Null, blank and shorter items
    and texts give nothing; repeated documents give a row each; an empty table on either side gives none. Texts are
    scanned whole, by themselves, without a shuffle. Items go to the tasks in blocks of at most ``most_items``,
    which bounds each broadcast; sentences are compared over all items first.
    """
    spark = documents.sparkSession
    rows = [(r[0], r[1]) for r in items.where(F.col(item_text).isNotNull()).select(item_id, item_text).distinct().orderBy(item_id).toLocalIterator()]
    own = {i: ws for i, ws in own_words(rows, several).items() if len(ws) >= least}
    ids = sorted(own)
    source = documents.where(F.length(doc_text) >= least).select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    schema = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, item_words int, changes int, begin long, end long"
    out: DataFrame | None = None
    for k in range(0, max(1, len(ids)), most_items):
        shared = spark.sparkContext.broadcast({i: own[i] for i in ids[k : k + most_items]})
        got = source.mapInArrow(_scanner(shared, least, per_change, doc_id, item_id), schema)
        out = got if out is None else out.unionByName(got)
    assert out is not None
    return out


def _scanner(shared, least: int, per_change: int, doc_id: str, item_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        patterns = automaton(own)
        some = len(own) > 0
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not some or not text:
                    continue
                ws, _ = folded_words(text)
                found = passages(ws, own, patterns, least, per_change)
                if found:
                    _, at = folded_words(text, offsets=True)
                    rows.extend((d, i, m, e, at[a][0], at[b - 1][1]) for i, (m, e, a, b) in found.items())
            names = [doc_id, item_id, "item_words", "changes", "begin", "end"]
            if rows:
                cols = list(zip(*rows))
                kinds = [batch.column(0).type, None, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return run
