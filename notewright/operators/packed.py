"""Fields that hold several values: one row per value, with its position.

The scan runs over the string buffers of whole Arrow batches. Quote parity and delimiter masks are computed over the code
points of all fields at once; the values' bytes and offsets follow from the masks, and the list array built from them is
flattened beside the parents' ordinals. No field and no value is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What separates, wraps and stands in for values.
DELIMITERS = "|¦｜,，;；\t\n\r\x0b\x0c\u2028\u2029"
DOUBLE_QUOTES = "\"“”„«»＂"
SINGLE_QUOTES = "'‘’`"
BRACKETS = "[]{}"
NO_VALUE = ("n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "not available", "not applicable", "tbd", "?", ".", "-", "–", "—", "−", "_")

_SEPARATOR = 0x10FFFF  # between fields in the joined buffer; no field can hold it


def _class(points: np.ndarray, members: str) -> np.ndarray:
    return np.isin(points, np.fromiter((ord(c) for c in members), dtype=np.uint32))


def _previous(index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """For each place the nearest place at or before it where mask holds, -1 if none."""
    return np.maximum.accumulate(np.where(mask, index, -1))


def _following(index: np.ndarray, mask: np.ndarray, end: int) -> np.ndarray:
    return np.minimum.accumulate(np.where(mask, index, end)[::-1])[::-1]


def _inside(points: np.ndarray, skip: np.ndarray, edge: np.ndarray, row: np.ndarray, quotes: str, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where a delimiter belongs to a quoted value.

    A quote opens if only blanks lie between it and the last delimiter or the field's start, and closes if only
    blanks follow up to the next delimiter or the field's end. An opening quote without a closing one, and a pair
    around the whole field, group nothing.
    """
    n = len(points)
    index = np.arange(n)
    quote = _class(points, quotes)
    solid = ~skip & ~edge
    before = _previous(index, (solid & ~quote) | edge)
    after = _following(index, (solid & ~quote) | edge, n - 1)
    before, after = np.concatenate(([0], before[:-1])), np.concatenate((after[1:], [n - 1]))
    opens = quote & edge[before]
    closes = quote & edge[after] & ~opens
    alone = quote & edge[before] & edge[after]  # beside a delimiter inside quotes a quote can be either
    spans = _paired(np.flatnonzero(opens | closes), opens, alone, row)
    whole = (spans[:, 0] == first[row[spans[:, 0]]]) & (spans[:, 1] == last[row[spans[:, 0]]])
    spans = spans[~whole]
    inside = np.bincount(spans[:, 0], minlength=n + 1)[: n + 1] - np.bincount(spans[:, 1], minlength=n + 1)[: n + 1]
    return np.cumsum(inside[:n]) > 0


def _paired(place: np.ndarray, opens: np.ndarray, alone: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(opening, closing) places of quotes. In each field a span ends at the first quote that can close after one that
    opens, and begins at the last one that opens before that. All fields go on together, one span a round."""
    found = [np.zeros((0, 2), dtype=np.int64)]
    can_open, can_close = place[opens[place]], place[~opens[place] | alone[place]]
    at = np.unique(row[place], return_index=True)[1] if len(place) else place[:0]
    at = place[at]  # where each field's search stands
    while len(at) and len(can_open) and len(can_close):
        k = np.searchsorted(can_open, at)
        ok = k < len(can_open)
        begin = can_open[k[ok]]
        begin = begin[row[begin] == row[at[ok]]]
        k = np.searchsorted(can_close, begin, side="right")
        ok = k < len(can_close)
        begin, end = begin[ok], can_close[k[ok]]
        same = row[begin] == row[end]
        begin, end = begin[same], end[same]
        found.append(np.stack([can_open[np.searchsorted(can_open, end) - 1], end], axis=1))
        at = end + 1
        at = at[row[np.minimum(at, len(row) - 1)] == row[end]]
    return np.concatenate(found)


def split_array(values: pa.Array) -> pa.ListArray:
    """Split each field of a string array; null, blank and stand-in fields give empty lists."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    rows = len(values)
    if rows == 0:
        return pa.array([], type=pa.list_(pa.string()))
    lengths = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    # The batch's one buffer of text, as code points, with a separator behind each field.
    bounds = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + rows + 1]
    data = values.buffers()[2]
    encoded = data[int(bounds[0]) : int(bounds[-1])].to_pybytes() if data is not None else b""
    bare = np.frombuffer(encoded.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.insert(bare, np.cumsum(lengths), _SEPARATOR)
    ends = np.cumsum(lengths + 1) - 1  # the separators' places
    n = len(points)
    index = np.arange(n)
    separator = np.zeros(n, dtype=bool)
    separator[ends] = True
    row = np.cumsum(separator) - separator
    blank = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0) | (points == 0x3000) | ((points >= 0x2000) & (points <= 0x200D)) | (points == 0xFEFF)
    delimiter = _class(points, DELIMITERS)
    bracket = _class(points, BRACKETS)
    skip = (blank & ~delimiter) | bracket
    edge = delimiter | separator

    # The first and last solid character of each field, to tell a pair of quotes around the whole field; in a
    # bracketed list the quotes belong to its values.
    starts = np.concatenate(([0], ends[:-1] + 1))
    seen = ~blank & ~separator
    first = _following(index, seen, n)[starts]
    last = _previous(index, seen)[ends]

    inside = np.zeros(n, dtype=bool)
    if _class(points, DOUBLE_QUOTES).any():
        inside |= _inside(points, skip, edge, row, DOUBLE_QUOTES, first, last)
    if _class(points, SINGLE_QUOTES).any():
        inside |= _inside(points, skip | _class(points, DOUBLE_QUOTES), edge, row, SINGLE_QUOTES, first, last)
    cut = (delimiter & ~inside) | separator

    # Trim each piece by the masks: its first and last character that is neither blank, wrapper nor bracket.
    wrapper = blank | bracket | _class(points, DOUBLE_QUOTES + SINGLE_QUOTES)
    piece_end = np.flatnonzero(cut)
    piece_start = np.concatenate(([0], piece_end[:-1] + 1))
    body = ~wrapper & ~cut
    begin = _following(index, body, n)[np.minimum(piece_start, n - 1)]
    finish = _previous(index, body)[piece_end]
    filled = (begin < piece_end) & (finish >= piece_start)
    begin, finish, owner = begin[filled], finish[filled] + 1, row[piece_end[filled]]
    # The values' bytes lie in order in the buffer: keep these, and the pieces' lengths are the child's offsets.
    kept = np.zeros(n + 1, dtype=np.int32)
    np.add.at(kept, begin, 1)
    np.add.at(kept, finish, -1)
    kept = np.cumsum(kept[:n]) > 0
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    width[separator] = 0
    upto = np.concatenate(([0], np.cumsum(np.where(kept, width, 0))))
    flat = np.frombuffer(encoded, dtype=np.uint8)[np.repeat(kept, width)]
    child_bounds = np.concatenate(([0], upto[finish])).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(child_bounds.tobytes()), pa.py_buffer(flat.tobytes()))
    keep = pc.invert(_no_value(pieces)).to_numpy(zero_copy_only=False)
    child = pieces.filter(pa.array(keep)).cast(pa.string())
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), child)


def _no_value(pieces: pa.Array) -> pa.Array:
    """Which pieces are stand-ins: those named, and those without a letter or digit."""
    said = pc.utf8_lower(pc.utf8_trim_whitespace(pieces))
    return pc.or_(pc.is_in(said, value_set=pa.array(NO_VALUE, said.type)), pc.invert(pc.match_substring_regex(pieces, r"[\p{L}\p{N}]")))


def explode_packed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row ``(id_col, field_name, pos, val)`` for each value in each of ``fields``.

    ``pos`` (long) counts from 1 over the non-empty values of a field; repeated values stay. Null, blank and
    stand-in fields give no row, a null id stays null, an empty table gives none, and other columns of ``df``
    (also ones named like the result's) are left unread. Fields of any length are split whole; no shuffle.
    """
    source = df.select(df[id_col].alias("__id"), *[df[f].cast("string").alias(f"__{k}") for k, f in enumerate(fields)])
    id_type = source.schema["__id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(fields):
                lists = split_array(batch.column(k + 1))
                parents = pc.list_parent_indices(lists)
                owner = parents.to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                pos = np.arange(len(owner), dtype=np.int64) - offsets[owner] + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(parents), pa.array([name] * len(owner), type=pa.string()), pa.array(pos), pc.list_flatten(lists)],
                    names=[id_col, "field_name", "pos", "val"],
                )

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("field_name", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("val", T.StringType())])
    return source.mapInArrow(split, schema)
