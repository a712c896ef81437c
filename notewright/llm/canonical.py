"""Freely typed names mapped to the entries of a reference list.

Values are deduplicated and normalised, candidates come from an inverted index of character n-grams, are scored by
weighted cosine and accepted above a threshold and with a margin over the next entry; of the candidates only those
within a few edits of what was typed count. Every run of words of a value is a query of its own, so words around a
name do not matter. Weights are counted over the whole list; lists too large to send to the tasks are met by their
n-grams instead, with the same candidates, scores and answers.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"

# Digits and signs that stand for letters in typed names.
LOOKALIKE = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "8": "b", "4": "a", "7": "t", "@": "a", "$": "s"})
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case without accents, compatibility forms or zero-width characters."""
    text = unicodedata.normalize("NFKD", text.replace("­", "").replace("ß", "ss")).casefold()
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def words(text: str) -> list[str]:
    text = re.sub(r"(?<=\w)[’'`´]s\b", "", plain(text))
    return [w for w in _WORD.findall(text.replace("&", " and ")) if w not in ("and", "und", "et")]


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, older[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return old[-1]


def allowed(length: int) -> int:
    """Edits that may part a typed name from a listed one of this length."""
    return 0 if length < 5 else max(1, int(0.28 * length))


def grams(s: str) -> list[str]:
    s = f"^{s}$"
    return [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)]


BUCKETS = 1 << 18  # of the table of n-gram counts, whose size this bounds


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def forms(name: str, canonical: str, generic: set[str]) -> Iterator[tuple[int, str, int]]:
    """(rank, key, own letters) of an entry: its name, its canonical, and either without the words many names share.
    Only the letters outside those words may bear typing errors."""
    for rank, source in ((2, name), (1, canonical)):
        ws = words(source)
        core = "".join(w for w in ws if w not in generic)
        if key := "".join(ws):
            yield rank, key, len(core) or len(key)
        if len(core) >= 5:
            yield 0, core, len(core)


class Weights:
    """Inverse document frequencies of n-grams over all keys of one type; ``counts`` is by bucket."""

    def __init__(self, keys: int, counts: dict[int, int]):
        self.keys, self.counts = keys, counts
        self.of: dict[str, float] = {}

    def __getitem__(self, gram: str) -> float:
        w = self.of.get(gram)
        if w is None:
            w = self.of[gram] = float(np.log(1 + self.keys / max(1, self.counts.get(bucket(gram), 1))))
        return w

    def vector(self, s: str) -> dict[str, float]:
        """The n-grams of a string with weights, of length one."""
        v = {g: k * self[g] for g, k in Counter(grams(s)).items()}
        norm = float(np.sqrt(sum(w * w for w in v.values())))
        return {g: w / norm for g, w in v.items()}


def weigh(keys: list[str]) -> Weights:
    return Weights(len(keys), Counter(b for k in keys for b in {bucket(g) for g in grams(k)}))


class Index:
    """Inverted n-gram index over keys (key, canonical, own)."""

    def __init__(self, keys: list[tuple[str, str, int]], weights: Weights):
        self.names = [k for k, _, _ in keys]
        self.canonical = [c for _, c, _ in keys]
        self.own = [o for _, _, o in keys]
        self.place = {n: i for i, n in enumerate(self.names)}
        self.longest = max(map(len, self.names), default=0)
        self.weights = weights
        posts: dict[str, list] = defaultdict(list)
        for i, n in enumerate(self.names):
            for g, w in weights.vector(n).items():
                posts[g].append((i, w))
        self.posts = {g: (np.array([i for i, _ in p], dtype=np.int64), np.array([w for _, w in p])) for g, p in posts.items()}

    def search(self, spans: list[str], least: float) -> Iterator[tuple[int, int, float]]:
        """(span, key, cosine) of every pair above the threshold."""
        n = len(self.names)
        for a in range(0, len(spans), max(1, 2_000_000 // max(1, n))):
            part = spans[a : a + max(1, 2_000_000 // max(1, n))]
            hits = [(k * n + self.posts[g][0], self.posts[g][1] * w) for k, s in enumerate(part) for g, w in self.weights.vector(s).items() if g in self.posts]
            if not hits:
                continue
            score = np.bincount(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
            for at in np.flatnonzero(score >= least).tolist():
                yield a + at // n, at % n, float(score[at])


def spans(text: str, generic: set[str], longest: int) -> list[str]:
    """Every run of words of a text, also with digits read as the letters they look like, as long as a key of
    ``longest`` letters may be typed; runs of shared words alone are none."""
    ws = words(text)
    most = longest / 0.72 + 1  # a span of more letters is further from every key than ``allowed``
    out: dict[str, None] = {}
    for row in (ws, [w.translate(LOOKALIKE) if not w.isdigit() and not w.isalpha() else w for w in ws]):
        for i in range(len(row)):
            s = ""
            for w in row[i:]:
                s += w
                if len(s) > most:
                    break
                if s not in generic:
                    out[s] = None
    return list(out)


def checked(span: str, name: str, own: int) -> bool:
    """Whether what was typed is a key but for a few edits. Another number is another code."""
    if span == name:
        return True
    if len(span) < 5 or sum(ch.isdigit() for ch in name) >= 3:
        return False
    most = allowed(min(len(span), own))
    return edit_distance(span, name, most) <= most


def decide(candidates: list[tuple[float, int, str]], margin: float) -> str | None:
    """Of checked candidates (cosine, span's length, canonical) the best one's canonical: the highest cosine, then the
    longest span; none if another entry, for a span as long or longer, comes within ``margin``."""
    if not candidates:
        return None
    best = max(candidates)
    rival = any(c[2] != best[2] and c[1] >= best[1] and best[0] - c[0] < margin for c in candidates)
    return None if rival else best[2]


def resolve(text: str, index: Index, generic: set[str], least: float, margin: float) -> str | None:
    """The canonical of the entry that a text names, or None."""
    queries = spans(text, generic, index.longest)
    # A span too short to bear an edit is only ever its own key, whose cosine is 1.
    found = [(1.0, len(s), index.canonical[index.place[s]]) for s in queries if allowed(len(s)) == 0 and s in index.place]
    long = [s for s in queries if allowed(len(s)) > 0]
    found += [(round(c, 6), len(long[k]), index.canonical[i]) for k, i, c in index.search(long, least) if checked(long[k], index.names[i], index.own[i])]
    return decide(found, margin)


def _generic_words(listed: DataFrame, share: float = 0.01, floor: int = 6) -> dict[str, set[str]]:
    """By type the words that so many names share that they tell no entry from another: kinds and legal forms of firms.
    A word in a hundredth of all names is one of a few hundred at most, so the result is small."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(t, w) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(words(n))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.string())], names=["type", "word"])

    sizes = listed.groupBy("type").agg(F.count("*").alias("names"))
    df = listed.select("type", "name").mapInArrow(split, "type string, word string").groupBy("type", "word").agg(F.count("*").alias("n"))
    out: dict[str, set[str]] = defaultdict(set)
    for r in df.join(sizes, "type").where(F.col("n") >= F.greatest(F.lit(floor), F.lit(share) * F.col("names"))).collect():
        out[r.type].add(r.word)
    return dict(out)


def _keys(listed: DataFrame, generic: dict[str, set[str]]) -> DataFrame:
    """(type, key, canonical, own): the keys of the list. The name itself beats the entry's canonical, that beats the name
    without the words many names share; of equal ones the highest ord holds, then the greater canonical."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, key, r, o, c, own) for t, n, c, o in zip(*(batch.column(k).to_pylist() for k in range(4))) for r, key, own in forms(n, c, generic.get(t, set()))]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["type", "key", "rank", "ord", "canonical", "own"])

    each = listed.select("type", "name", "canonical", F.coalesce("ord", F.lit(-1)).alias("ord")).mapInArrow(split, "type string, key string, rank int, ord long, canonical string, own int")
    return each.groupBy("type", "key").agg(F.max(F.struct("rank", "ord", "canonical")).alias("m"), F.min("own").alias("own")).select("type", "key", "m.canonical", "own")


def _weights(keys: DataFrame) -> dict[str, Weights]:
    """By type the weights of n-grams. What is collected is one number a bucket and type, whatever the list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = Counter()
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((t, b) for b in {-1, *map(bucket, grams(k))})
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([b for _, b in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["type", "bucket", "n"])

    out: dict[str, Weights] = {}
    for r in keys.select("type", "key").mapInArrow(count, "type string, bucket int, n long").groupBy("type", "bucket").agg(F.sum("n").alias("n")).collect():
        w = out.setdefault(r.type, Weights(0, {}))
        if r.bucket < 0:
            w.keys = r.n
        else:
            w.counts[r.bucket] = r.n
    return out


def map_names(
    mentions: DataFrame,
    entries: DataFrame,
    id_col: str,
    type_col: str,
    text_col: str,
    *,
    least: float = 0.2,
    margin: float = 0.02,
    most_keys: int = 100_000,
) -> DataFrame:
    """(id_col, canonical) for each row of ``mentions``: the entry its text names, else ``UNMATCHED``.

    ``entries`` has (type, name, canonical, ord); rows with a null or blank name or a null canonical are no entries.
    Texts must not be null or blank. Each distinct value is resolved once and its answer joined to its rows; a text in
    a third of all rows is one value. A list of up to ``most_keys`` keys, counted first, is sent to the tasks as an
    index; a longer one stays a table, and values meet it by their rarest n-grams. Both ways look at every key whose
    cosine with a span is ``least`` or more. An empty list leaves all rows unmatched; other columns are not read.
    """
    listed = entries.where("name is not null and trim(name) <> '' and canonical is not null").select("type", "name", "canonical", F.col("ord").cast("long").alias("ord")).distinct()
    source = mentions.select(F.col(id_col).alias("id"), F.col(type_col).alias("type"), F.col(text_col).alias("text"))
    generic = _generic_words(listed)
    keys = _keys(listed, generic)
    weights = _weights(keys)
    # Resolving is dear and values are small, so they are spread over the tasks by number, not by bytes.
    context = mentions.sparkSession.sparkContext
    values = source.select("type", "text").distinct().repartition(max(2 * context.defaultParallelism, int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    way = _by_index if sum(w.keys for w in weights.values()) <= most_keys else _by_grams
    answers = way(values, keys, weights, generic, least, margin)
    return source.join(answers, ["type", "text"], "left").select(F.col("id").alias(id_col), F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"))


def _by_index(values: DataFrame, keys: DataFrame, weights: dict[str, Weights], generic: dict[str, set[str]], least: float, margin: float) -> DataFrame:
    """(type, text, canonical) of the values that name an entry; the list goes to the tasks."""
    shared = values.sparkSession.sparkContext.broadcast((sorted(map(tuple, keys.select("type", "key", "canonical", "own").collect())), weights, generic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weights, generic = shared.value
        index: dict[str, Index] = {}
        for batch in batches:
            out = []
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if kind not in weights:
                    out.append(None)
                    continue
                if kind not in index:
                    index[kind] = Index([r[1:] for r in rows if r[0] == kind], weights[kind])
                out.append(resolve(text, index[kind], generic.get(kind, set()), least, margin))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["type", "text", "canonical"])

    return values.mapInArrow(run, "type string, text string, canonical string")


def _by_grams(values: DataFrame, keys: DataFrame, weights: dict[str, Weights], generic: dict[str, set[str]], least: float, margin: float) -> DataFrame:
    """The same for a list of any size. A span and a key with a cosine of ``least`` share one of the span's rarest
    n-grams: those beside which the others are shorter than ``least``. So spans are joined to keys by these, and only
    their weights' table, of bounded size, goes to the tasks."""
    shared = values.sparkSession.sparkContext.broadcast((weights, generic))
    longest = {r.type: r.n for r in keys.groupBy("type").agg(F.max(F.length("key")).alias("n")).collect()}  # one row a type

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, generic = shared.value
        for batch in batches:
            rows = []
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for s in spans(text, generic.get(kind, set()), longest[kind]) if kind in weights else ():
                    left = 1.0
                    for g, w in sorted(weights[kind].vector(s).items(), key=lambda x: (-weights[kind][x[0]], x[0])):
                        rows.append((kind, text, s, g))
                        left -= w * w
                        if left < (least - 1e-6) ** 2:
                            break
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [()] * 4], names=["type", "text", "span", "gram"])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(set(grams(k))) for k in batch.column(1).to_pylist()]
            at = pa.array([i for i, gs in enumerate(lists) for _ in gs], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array([g for gs in lists for g in gs], pa.string())], names=["type", "key", "canonical", "own", "gram"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = shared.value
        for batch in batches:
            out = []
            for kind, s, k, own in zip(*(batch.column(c).to_pylist() for c in ("type", "span", "key", "own"))):
                a, b = weights[kind].vector(s), weights[kind].vector(k)
                c = sum(w * b[g] for g, w in a.items() if g in b)
                good = checked(s, k, own) and (c >= least or s == k)
                out.append(round(c, 6) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("type"), batch.column("text"), batch.column("canonical"), pa.array([len(s) for s in batch.column("span").to_pylist()], pa.int32()), pa.array(out, pa.float64())], names=["type", "text", "canonical", "len", "cosine"])

    asked = values.mapInArrow(probes, "type string, text string, span string, gram string")
    held = keys.select("type", "key", "canonical", "own").mapInArrow(postings, "type string, key string, canonical string, own int, gram string")
    pairs = asked.join(held, ["type", "gram"]).drop("gram").distinct()
    scored = pairs.mapInArrow(score, "type string, text string, canonical string, len int, cosine double").where("cosine is not null")
    # ``decide`` in two sums: the best candidate of a value, and whether another entry comes near it.
    each = scored.groupBy("type", "text", "canonical").agg(F.collect_set(F.struct("cosine", "len")).alias("of"))
    best = scored.groupBy("type", "text").agg(F.max(F.struct("cosine", "len", "canonical")).alias("best"))
    rival = F.exists("of", lambda c: (c["len"] >= F.col("best.len")) & (F.col("best.cosine") - c["cosine"] < margin)) & (F.col("canonical") != F.col("best.canonical"))
    return each.join(best, ["type", "text"]).groupBy("type", "text").agg(F.max(rival.cast("int")).alias("r"), F.max("best.canonical").alias("canonical")).where("r = 0").select("type", "text", "canonical")
