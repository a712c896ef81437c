"""Sources mixed to target shares of all tokens, with a cap on how often a document comes.

Each source's quota in copies of itself is split into whole copies, which every document gets for certain, and a rest,
for which documents are drawn by Pareto order sampling: each gets random odds divided by its inclusion odds, and the
least of these are taken until the rest is filled. The cut is found by counting in ever finer steps, so no source is
ever sorted or gathered, however large it is.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.runtime import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_name(c: Column) -> Column:
    """Trimmed, lower-cased, blanks and hyphens as underscores; null if blank."""
    out = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"(?U)[\s\p{Z}-]", "_")
    return F.when(out != "", out)


def _encoder(path: str):
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:  # the public pattern of this vocabulary
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("notewright", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``tokens`` (long), the length of each whole text in tokens of a public vocabulary; 0 for null."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            if encode is None:
                encode = _encoder(path).encode_ordinary
            sizes = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return df.select(F.col(text), *keep).mapInArrow(run, schema)


def _shares(stats: dict[str, dict[float, tuple[int, int]]], rest: dict[str, int]) -> dict[str, float]:
    """For each source the factor c with which inclusion probabilities min(1, c w) fill the rest in expectation.

    ``stats``: by source and weight step the number of tokens; a bounded number of weights a source."""
    out = {}
    for s, by_step in stats.items():
        want, total = rest.get(s, 0), sum(t for t, _ in by_step.values())
        if want <= 0 or total == 0:
            out[s] = 0.0
            continue
        steps = sorted(by_step, reverse=True)  # the heaviest are certain first
        sure, c = 0, 0.0
        loose = {k: by_step[k][0] for k in steps}
        for k in steps:
            c = (want - sure) / sum(t * j for j, t in loose.items())
            if c * k < 1:
                break
            sure += loose.pop(k)
            if not loose or want <= sure:
                c = 1.0 / k
                break
        out[s] = c
    return out


def mix(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, *, total_tokens: int | None = None, seed: int = 42, steps: int = 64, buckets: int = 1024, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies) and the report (source, target_share, max_repeats, documents, tokens,
    used_documents, used_tokens, share_reached, in_reach).

    ``targets`` has (source, target_share, max_repeats), one row a source, and is small. The mix is to have
    ``total_tokens`` tokens, by default as many as the documents of all target sources. A source whose target is out of
    reach gives all its documents ``max_repeats`` times and no other fills its place; the report says so. The drawn
    rest is the longest run in Pareto order that does not exceed it. Documents of null, blank or unlisted sources and
    those without tokens take no part; repeated texts under own ids count each; a source without documents is reported
    with zeros. The draw depends on ids and ``seed`` alone, so a repeated or recovered run gives the same mix. A
    document's weight in the draw is its number of tokens, rounded down to one of ``steps`` sizes in each doubling.
    """
    keep = Scratch(documents.sparkSession)
    wanted = {r.source: (r.target_share, int(r.max_repeats)) for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").collect()}
    named = documents.select(F.col(doc_id).alias("doc"), source_name(F.col(source)).alias("src"), F.col(text).alias("txt")).where(F.col("src").isin(*wanted)) if wanted else documents.select(F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("src"), F.col(text).alias("txt")).where(F.lit(False))
    # The texts are read once; what follows works on a narrow table.
    sized = keep.save(count_tokens(named, "txt", ["doc", "src"], tokenizer).where("tokens > 0").withColumn("step", F.pow(F.lit(2.0), F.floor(F.log2("tokens") * steps) / steps)))
    stats: dict[str, dict[float, tuple[int, int]]] = defaultdict(dict)
    for r in sized.groupBy("src", "step").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect():  # at most sources x steps x doublings of the length rows
        stats[r.src][r.step] = (r.t, r.n)
    size = {s: sum(t for t, _ in stats[s].values()) if s in stats else 0 for s in wanted}
    total = sum(size.values()) if total_tokens is None else total_tokens
    whole, rest = {}, {}
    for s, (share, most) in wanted.items():
        quota = min(round(share * total), most * size[s])
        whole[s] = quota // size[s] if size[s] else 0
        rest[s] = quota - whole[s] * size[s] if size[s] else 0
    factor = _shares(stats, rest)

    def by_source(values: dict[str, float], kind: str) -> Column:
        pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
        return (F.create_map(*pairs)[F.col("src")] if pairs else F.lit(None)).cast(kind)

    u = (F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), by_source(factor, "double") * F.col("step"))
    # q / (1 + q) of the Pareto rank q = (u / (1 - u)) / (p / (1 - p)): the same order, between 0 and 1.
    ranked = sized.withColumn("p", p).withColumn("rank", F.when(F.col("p") >= 1.0, F.lit(0.0)).when(F.col("p") <= 0.0, F.lit(1.0)).otherwise(u * (1 - F.col("p")) / (u * (1 - F.col("p")) + (1 - u) * F.col("p"))))
    ranked = keep.save(ranked.select("doc", "src", "tokens", "rank"))
    keep.drop(sized)
    low, high, room = dict.fromkeys(wanted, 0.0), dict.fromkeys(wanted, 1.0), dict(rest)
    chosen_below = dict.fromkeys(wanted, -1.0)  # ranks under this are taken
    open_sources = [s for s in wanted if rest[s] > 0]
    for _ in range(5):  # each round looks at one bucket of the last, ``buckets`` times finer
        if not open_sources:
            break
        span = by_source({s: high[s] - low[s] for s in open_sources}, "double")
        inner = ranked.where(F.col("src").isin(*open_sources) & (F.col("rank") >= by_source(low, "double")) & (F.col("rank") <= by_source(high, "double")))
        place = F.least(F.lit(buckets - 1), F.floor((F.col("rank") - by_source(low, "double")) / span * buckets)).cast("int")
        counted: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
        for r in inner.groupBy("src", place.alias("b")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most")).collect():  # at most sources x buckets rows
            counted[r.src][r.b] = (r.t, r.n, r.least, r.most)
        still = []
        for s in open_sources:
            for b in sorted(counted[s]):
                t, n, least, most = counted[s][b]
                if t <= room[s]:
                    room[s] -= t
                    chosen_below[s] = most
                    continue
                if least < most and n > 1:
                    low[s], high[s] = least, most
                    still.append(s)
                break
        open_sources = still
    drawn = (F.col("rank") <= by_source(chosen_below, "double")).cast("int")
    copies = by_source(whole, "int") + F.when(by_source(rest, "long") > 0, drawn).otherwise(0)
    mixed = ranked.select(F.col("doc").alias(doc_id), F.col("src").alias("source"), "tokens", copies.alias("copies")).where("copies > 0")
    used = {r.source: (r.d, r.t) for r in mixed.groupBy("source").agg(F.count("*").alias("d"), F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    all_used = sum(t for _, t in used.values())
    rows = []
    for s, (share, most) in sorted(wanted.items()):
        d, t = used.get(s, (0, 0))
        docs = sum(n for _, n in stats[s].values()) if s in stats else 0
        rows.append((s, share, most, docs, size[s], d, t, t / all_used if all_used else 0.0, most * size[s] >= round(share * total)))
    report = documents.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, documents long, tokens long, used_documents long, used_tokens long, share_reached double, in_reach boolean")
    return mixed, report
