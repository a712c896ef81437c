"""Records that hold a template, filler, an error page or a script notice in place of a note.

A naive Bayes model of passages is learned by expectation-maximisation from trusted records as positive and a sample of
all others as unlabelled. Trusted records come from the data: those that say nothing of their own, whose every passage
is an unfilled slot, is said over and over in the record, or is wording that comes in many records and hardly ever
beside anything of their own. No list of phrases takes part. Every passage of every record is then scored; a record is
out if its scored passages are residue but for a small rest.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Forms in which templates write their slots, what programs print into an empty one, and how they print
# where they failed.
SLOTS = (
    r"\{\{[^{}\n]{0,40}\}\}",
    r"\{%[^%\n]{0,40}%\}",
    r"<%=?[^%\n]{0,40}%>",
    r"<<[^<>\n]{1,40}>>",
    r"\[\[[^\[\]\n]{1,40}\]\]",
    r"[$#]\{[^{}\n]{1,40}\}",
    r"@@[^@\n]{1,40}@@",
    r"(?<!\w)__[^_\n](?:[^\n]{0,38}?[^_\n])?__(?!\w)",
    r"(?<![\w%])%[A-Za-z][\w \-]{0,30}%(?!\w)",
    r"(?<![\w$])\$[A-Za-z][\w \-]{0,30}\$(?!\w)",
    r"(?<![\w{])\{[A-Za-z][\w \-]{0,30}\}(?!\w)",
    r"\[(?:insert|enter|add|your|name|einfügen|insérer|insertar)\b[^\[\]\n]{0,40}\]",
    r"(?<![\w\[])\[[A-Za-z]{2,}[A-Za-z_ \-]{0,30}\](?![\w(])",
    r"<[A-Za-z][\w \-]{0,30} here>",
    r"\[object Object\]",
    r"(?<!\w)_{3,}(?!\w)",
    r"(?<!\w)X{3,}(?!\w)",
    r"(?<!\w)x{4,}(?!\w)",
    r"Traceback \(most recent call last\):?",
    r"File \"[^\"\n]{0,200}\", line \d+, in \S+",
)
# What programs print where a value is missing.
EMPTY = ("undefined", "null", "NaN", "TBD", "N/A", "None")
# Fixed value: the filler text of typesetters, as every template holds it; one trusted record beside those found.
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. "
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. "
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
)

_SLOT = re.compile("|".join(SLOTS))
# Every slot holds one of these, or two underscores before something else.
_SLOT_HINTS = ("{", "<", "[", "$", "@", "%", "___", "XXX", "xxxx", "Traceback", 'File "')
_UNDERSCORES = re.compile(r"__[^_\s]")
_EMPTY_HINTS = (*EMPTY, "...")
_EMPTY = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, EMPTY)) + r")(?!\w)|(?<=[\w:] )\.\.\.|^\.\.\.")
_TAG = re.compile(r"</?([a-zA-Z]+)[^<>\n]{0,200}>")
_LABEL = re.compile(r"(?<=[^\s])\s+(?=[^\W\d_][\w ]{1,24}:\s)")
_END = re.compile(r"([.!?…])\s")
_WORD = re.compile(r"\x02|[^\W\d_]+|\d+")
_ASCII_WORD = re.compile(r"[a-z]+|0+|\x02")

SLOT, RARE = "\x02", "\x03rare"


def split_passages(text: str) -> list[str]:
    """Passages end at newlines and at white space behind a sentence's end; none holds a newline."""
    if any(map(text.__contains__, _SLOT_HINTS)) or "__" in text and _UNDERSCORES.search(text):
        text = _TAG.sub(_tag_name, _SLOT.sub(SLOT, text))
    return [p for s in _END.sub("\\1\n", text).split("\n") if (p := s.strip())]


def _tag_name(m: re.Match) -> str:
    return f"\n{m[1].lower() if m[1].lower() in ('error', 'noscript') else ''}\n"


_LEAD = re.compile(r"^(?:[-*•]\s+|\d{1,2}[.)]\s+|\d{1,2}:\d{2}\s+|[^\W\d_]{1,10}:\s+(?=[^\W\d_]+\s+[^\W\d_]+\s+[^\W\d_]+))")

# The same behind a newline, for many passages at once.
_LEADS = re.compile("\n" + _LEAD.pattern[1:].replace(r"\s", r"[^\S\n]"))

_NUMBER, _ASCII_NUMBER = re.compile(r"\d+"), re.compile("[0-9]+")


def passage_key(passage: str) -> str:
    """A passage without list marks, times, labels and numbers, to know wording that comes again and again."""
    lead = _LEAD.match(passage)
    return _NUMBER.sub("0", passage[lead.end() :] if lead else passage).strip().lower()


def passage_keys(passages: list[str]) -> list[str]:
    """``passage_key`` of each passage of one text, all in one go; the passages as ``split_passages`` gives them."""
    text = _LEADS.sub("\n", "\n" + "\n".join(passages)) if passages else ""
    return (_ASCII_NUMBER if text.isascii() else _NUMBER).sub("0", text).lower().split("\n")[1:]


_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def passage_words(passage: str, position: int) -> list[str]:
    """Folded words; a slot is a kind of its own, and so are the numbers of one length."""
    if any(map(passage.__contains__, _EMPTY_HINTS)):
        passage = _EMPTY.sub(SLOT, passage)
    if passage.isascii():
        return _ASCII_WORD.findall(passage.lower().encode().translate(_DIGITS).decode())
    # ASCII digits are bytes of their own in UTF-8, and bytes are translated much faster than characters.
    folded = unicodedata.normalize("NFC", passage).lower().encode("utf-8", "surrogatepass").translate(_DIGITS)
    return _WORD.findall(folded.decode("utf-8", "surrogatepass"))


_LETTERS, _SINGLES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789" + SLOT.encode()


def most_words(text: str) -> int:
    """At most one more than this are the ``passage_words`` of a text: each character that is no ASCII letter may part two
    words, and may be a word as well if it is a digit, a slot or no ASCII (two bytes or more)."""
    rest = text.encode("utf-8", "surrogatepass").translate(None, _LETTERS)
    return 2 * len(rest) - len(rest.translate(None, _SINGLES))


def is_heading(passage: str, position: int) -> bool:
    """A title is no content: a first line of a few words without a sentence's end, or a marked heading."""
    if passage[0] in "#=-" and re.match(r"(?:#{1,6}\s|=+[^=]+=+$|-{3}.*-{3}$)", passage):
        return True
    return position == 0 and len(passage.split()) <= 6 and not re.search(r"[.!?:…,;]$|\x02", passage) and not _EMPTY.search(passage)


class _Odds(dict):
    """Log odds by word; an unknown word has the rare ones'."""

    def __missing__(self, word: str) -> float:
        return self[RARE]


@dataclass
class Model:
    """Log odds of residue of each known word, of all unknown ones, and of a passage beforehand; and the passages so
    common in all kinds of records that they tell nothing (footers, section labels)."""

    odds: _Odds
    prior: float
    most: float = 6.0
    neutral: frozenset[str] = frozenset()

    @cached_property
    def _ends(self) -> tuple[frozenset[str], list[int]]:
        """Up to six characters that end the neutral passages, from their last number on if it is among them; their lengths."""
        ends = frozenset(end[max(0, end.rfind("0")) :] for end in (k[-6:] for k in self.neutral))
        return ends, sorted(set(map(len, ends)))

    def is_neutral(self, passage: str) -> bool:
        ends, lengths = self._ends
        last = passage[-12:].lower()
        for n in lengths:
            end = last[-n:]
            if (f"0{end[1:]}" if end[:1].isdecimal() else end) in ends:
                return passage_key(passage) in self.neutral
        return False

    def score(self, ws: list[str]) -> float:
        return sum(map(self.odds.__getitem__, ws))


def fit(trusted: list[list[list[str]]], unlabelled: list[list[list[str]]], *, rounds: int = 15, least_df: int = 2, prior: float = 0.02, mass: float = 0.014, most: float = 6.0, unknown: float = -0.5) -> Model:
    """Positive-unlabelled naive Bayes over records of passages of words.

    All passages of a trusted record are residue. An unlabelled record's belief is that of its passages together, each
    counting ``most`` at the utmost, and holds for all of them: what stands beside residue alone becomes residue, what
    stands among notes does not. Beliefs under a half count as none: many short notes of one wording could otherwise
    add up, round by round, to make their own words residue. Words in fewer than ``least_df`` passages, and any the sample lacks, have the fixed odds ``unknown``: a
    name never seen says little. Either class is
    smoothed towards the whole sample by a ``mass`` of the trusted words, so that a word only notes use speaks for notes.
    """
    records = trusted + unlabelled
    passages = [p for r in records for p in r]
    of_record = np.repeat(np.arange(len(records)), [len(r) for r in records])
    of_passage = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    words: defaultdict[str, int] = defaultdict(lambda: len(words))
    codes = np.fromiter(map(words.__getitem__, chain.from_iterable(passages)), np.int64)
    pairs = np.sort(of_passage * len(words) + codes)
    df = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % max(1, len(words)), minlength=len(words))
    vocabulary = {w: i for i, w in enumerate([RARE, *sorted(w for w, n in zip(words, df.tolist()) if n >= least_df and w != RARE)])}
    cols = np.array([vocabulary.get(w, 0) for w in words], dtype=np.int64)[codes]
    base = (np.bincount(cols, minlength=len(vocabulary)) + 0.1) / (len(cols) + 0.1 * len(vocabulary))
    belief = np.zeros(len(records))
    belief[: len(trusted)] = 1.0
    odds, lead = np.zeros(len(vocabulary)), math.log(prior / (1 - prior))
    mass = max(1.0, mass * sum(len(p) for r in trusted for p in r))
    for _ in range(rounds):
        weight = belief[of_record][of_passage]
        pos = np.bincount(cols, weight, len(vocabulary)) + mass * base
        neg = np.bincount(cols, 1 - weight, len(vocabulary)) + mass * base
        odds = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
        odds[0] = unknown
        share = float(np.clip(belief[len(trusted) :].mean() if unlabelled else 0.5, prior, 0.5))
        lead = math.log(share / (1 - share))
        each = np.clip(np.bincount(of_passage, odds[cols], len(passages)), -most, most)
        total = lead + np.bincount(of_record, each, len(records))
        fresh = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        belief[len(trusted) :] = np.where(fresh < 0.5, 0.0, fresh)[len(trusted) :]
    return Model(_Odds((w, float(odds[i])) for w, i in vocabulary.items()), lead, most)


def _read(passages: list[str]) -> list[tuple[str, list[str]]]:
    """(key, words) of a record's passages, headings aside."""
    return [(key, passage_words(p, k)) for k, (p, key) in enumerate(zip(passages, passage_keys(passages))) if not is_heading(p, k)]


def _given(keys: list[tuple[str, list[str]]]) -> list[tuple[str, bool, int]]:
    """(key, whether the passage shows by itself that no one wrote it, words) of what was read of a record: one made of
    slots, or one that the record says three times or more."""
    times = Counter(k for k, _ in keys)
    return [(key, (slots := ws.count(SLOT)) > 0 and len(ws) <= 9 * slots or times[key] >= 3, len(ws)) for key, ws in keys]


def trust(parts: list[list[str]], least: int = 5, apart: float = 0.5, rest: float = 0.25) -> tuple[set[int], set[str], set[str]]:
    """``trust_read`` of records given by their passages."""
    return trust_read([_read(part) for part in parts], least, apart, rest)


def trust_read(read: list[list[tuple[str, list[str]]]], least: int = 5, apart: float = 0.5, rest: float = 0.25) -> tuple[set[int], set[str], set[str]]:
    """(places of the trusted records, closed wordings, all other wordings that are not only titles) of records given by
    the keys and words of their passages.

    A passage is a record's own if it comes in fewer than ``least`` records and does not show by itself that no one wrote
    it. Wording is closed if it comes in ``least`` records or more, and in fewer than ``apart`` of them more than
    ``rest`` of the words are the record's own. A record is trusted if all but ``rest`` of its words are closed or show
    that; one closed wording alone does not do, it may be a short note. Records that say the same count once, whatever their titles."""
    said: dict[frozenset, tuple[list[tuple[str, bool, int]], list[int]]] = {}
    for i, keys in enumerate(read):
        passages = _given(keys)
        said.setdefault(frozenset(k for k, _, _ in passages), (passages, []))[1].append(i)
    records, beside = Counter(k for body in said for k in body), Counter()
    for body, (passages, _) in said.items():
        if sum(n for k, shows, n in passages if not shows and records[k] < least) > rest * sum(n for _, _, n in passages):
            beside.update(body)
    closed = {k for k, n in records.items() if n >= least and beside[k] < apart * n}
    sure: set[int] = set()
    for passages, at in said.values():
        known = [(k, shows, n) for k, shows, n in passages if shows or k in closed]
        if known and sum(n for _, _, n in known) >= (1 - rest) * sum(n for _, _, n in passages) and (len({k for k, _, _ in known}) > 1 or known[0][1]):
            sure.update(at)
    return sure, closed, set(records) - closed


def learn(documents: DataFrame, doc_id: str, text: str, *, sample: int = 12_000, longest: int = 20_000, common: float = 0.004) -> Model:
    """Fit on a sample of about ``sample`` records, those whose id has the least hashes; among them the trusted are the
    labelled ones. Of the sample, records beyond ``longest`` code points are left out. What is common is counted over
    all records; no other step samples."""
    rows = documents.where(F.col(text).isNotNull())
    n = rows.count()
    share = 1.0 if n <= sample else sample / n
    place = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    texts = [r[0] for r in rows.where((place < share) & (F.length(text) <= longest)).select(text).collect()]
    return learn_from(sorted(texts), common_wordings(rows.select(text), common, texts))


def wordings(passages: list[str]) -> tuple[frozenset[str], set[str]]:
    """(what a record says, all its wordings) as passage keys; headings say something only where nothing else stands."""
    keys = passage_keys(passages)
    return frozenset(key for k, (p, key) in enumerate(zip(passages, keys)) if not is_heading(p, k)) or frozenset(keys), set(keys)


def _said(texts: list[str]) -> dict[frozenset[str], set[str]]:
    """All wordings of the records that say the same."""
    said: dict[frozenset[str], set[str]] = {}
    for t in texts:
        body, every = wordings(split_passages(t))
        said.setdefault(body, set()).update(every)
    return said


def is_common(n: int, of: int, share: float, deviations: float = 3.0) -> bool:
    """Whether ``n`` records of ``of`` show a share above ``share``, by the lower end of Wilson's interval, so that the
    same wording counts as common in small tables as in large ones; what stands in one record only is none."""
    p, q = n / of, deviations * deviations / of
    return n > 1 and (p + q / 2 - math.sqrt(q * (p * (1 - p) + q / 4))) / (1 + q) > share


def _hash(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def common_wordings(texts: DataFrame, share: float, known: list[str]) -> set[str]:
    """Passage keys in more than ``share`` of all records; records that say the same count once.
    ``texts`` has one column. Pairs of hashes are shuffled; the wording comes from the ``known`` texts, and by another
    reading of all texts if one is in none of them. What is collected ends at the share."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = [], []
            for body, every in _said(batch.column(0).to_pylist()).items():
                b = _hash("\n".join(sorted(body)))
                hashes = [None, *(_hash(k) for k in every if SLOT not in k)]
                keys += hashes
                bodies += [b] * len(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.int64())], names=["wording", "body"])

    # The row without a wording counts the records.
    counts = texts.mapInArrow(pairs, "wording long, body long").groupBy("wording").agg(F.count_distinct("body").alias("n")).where("n > 1 or wording is null").orderBy(F.desc("n"), F.col("wording").isNotNull())
    limit = 4096
    while True:
        top = counts.limit(limit).collect()
        if len(top) < limit or not is_common(top[-1]["n"], top[0]["n"], share):
            break
        limit *= 4
    heavy = {r["wording"] for r in top if r["wording"] is not None and is_common(r["n"], top[0]["n"], share)}
    found = {k for t in known for k in passage_keys(split_passages(t)) if _hash(k) in heavy} if heavy else set()
    lost = heavy - set(map(_hash, found))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {k for t in batch.column(0).to_pylist() for k in passage_keys(split_passages(t)) if _hash(k) in lost}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], names=["key"])

    return found | ({r[0] for r in texts.mapInArrow(names, "key string").distinct().collect()} if lost else set())


def learn_from(texts: list[str], sayings: set[str] | None = None, common: float = 0.004) -> Model:
    """Fit on the trusted records and the others. ``sayings``, by default the passages in more than ``common`` of the
    records, are neutral if they hold no slot and are not closed: they tell nothing, as footers and labels of forms do.
    Records that say the same count once, whatever their titles."""
    if sayings is None:
        said = _said(texts)
        seen = Counter(k for every in said.values() for k in every)
        sayings = {k for k, n in seen.items() if is_common(n, len(said), common)}
    texts = list(dict.fromkeys(texts))  # one wording counts once however often its record is repeated
    read = [_read(split_passages(t)) for t in texts]
    trusted, _, open_ones = trust_read(read)
    neutral = frozenset(k for k in sayings & open_ones if SLOT not in k)

    def of(read: list[list[tuple[str, list[str]]]]) -> list[list[list[str]]]:
        return [r for keys in read if (r := [ws for key, ws in keys if ws and key not in neutral])]

    model = fit(of([keys for i, keys in enumerate(read) if i in trusted] + [_read(split_passages(FILLER))] * 3), of([keys for i, keys in enumerate(read) if i not in trusted]))
    model.neutral = neutral
    return model


def judge(text: str, model: Model, most_content: float | None = None) -> tuple[int, int, float]:
    """(words of residue, words of content, log odds of the record), headings and neutral passages aside. Where
    nothing else stands, the neutral passages, and then the headings, are what the record offers. With ``most_content``
    the rest of a text is not scored once it can no longer bring the share of content down to that, even if it held as
    many words as ``most_words`` allows and all were residue: the decision is the same, the numbers are those up to there."""
    scored, headings, skipped = [], [], []
    passages = split_passages(text)
    left = len(passages) + most_words("".join(passages)) if most_content is not None else 0
    said = spoken = 0
    for k, p in enumerate(passages):
        if most_content is not None:
            if said > most_content * (spoken + left):
                break
            left -= 1 + most_words(p)
        if model.is_neutral(p):
            skipped.append((p, k))
            continue
        ws = passage_words(p, k)
        if ws:
            s = model.score(ws)
            if is_heading(p, k):
                headings.append((len(ws), s))
            else:
                scored.append((len(ws), s))
                spoken += len(ws)
                said += len(ws) if s <= 0 else 0
    residue = content = 0
    total = model.prior
    if skipped and not scored:
        scored = [(len(ws), model.score(ws)) for p, k in skipped if (ws := passage_words(p, k))]
    for n, s in scored or headings:
        # A long passage may say more than one short one; a label of two words speaks for little.
        total += max(-model.most if n > 2 else -model.most / 3, min(model.most * min(2.5, max(1.0, n / 10)), s))
        if s > 0:
            residue += n
        else:
            content += n
    return residue, content, total


def is_residue(verdict: tuple[int, int, float], most_content: float) -> bool:
    residue, content, total = verdict
    return residue > 0 and content <= most_content * (residue + content) and total > 0


def residue_records(documents: DataFrame, doc_id: str, text: str, *, model: Model | None = None, most_content: float = 0.45, scores: bool = False) -> DataFrame:
    """(doc_id) of each record whose text is residue; with ``scores`` all records with text and what was measured:
    (doc_id, residue_words, content_words, log_odds, is_residue).

    A record is residue if at most ``most_content`` of the words of its scored passages are content and its log odds
    are above 0. Null and blank texts and short notes are no residue; repeated records come out each; an empty table
    gives no rows. Texts are judged whole and by themselves, without a shuffle; what goes to the tasks is the model,
    whose size the bounded sample bounds.
    """
    model = learn(documents, doc_id, text) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, residue_words int, content_words int, log_odds double, is_residue boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            verdicts = [judge(t, m, None if scores else most_content) for t in batch.column(1).to_pylist()]
            keep = [is_residue(v, most_content) for v in verdicts]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v[0] for v in verdicts], pa.int32()), pa.array([v[1] for v in verdicts], pa.int32()), pa.array([v[2] for v in verdicts], pa.float64()), pa.array(keep, pa.bool_())],
                names=[doc_id, "residue_words", "content_words", "log_odds", "is_residue"],
            )
            yield out if scores else out.filter(pa.array(keep, pa.bool_()))

    judged = documents.where(F.col(text).rlike(r"(?U)[^\s\p{Z}]")).select(doc_id, text).mapInArrow(run, schema)
    return judged if scores else judged.select(doc_id)
