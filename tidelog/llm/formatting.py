"""Duplicates that differ only in blanks, letter case, punctuation and field order."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import skew
from tidelog.operators.skew import SALT
from tidelog.sources.shared import written

#: The names of a profile's fields.
FIELDS = ("name", "born", "weight", "ward", "wing", "badge", "contact")
#: Bases of the two rolling hashes, of words within fields, and of their mixing; odd numbers without further meaning.
BASES, STEPS, MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F), 0xFF51AFD7ED558CCD


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point the folded letter, digit or mark, 0 if it is skipped. Made from Unicode's own rules.

    Letters are folded to lower case where that is one character; accents stay.
    """
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            f = c.casefold()
            f = f if len(f) == 1 else c.lower()
            table[cp] = ord(f) if len(f) == 1 else cp
    return table


def points(texts: Sequence[str]) -> np.ndarray:
    """The code points of all texts, each followed by one that is skipped. Composed, so that é is one however written."""
    joined = "\0".join(t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def _rolling(values: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of each run of values; runs begin at starts."""
    lengths = np.diff(np.append(starts, len(values)))
    powers = np.cumprod(np.full(int(lengths.max()), base, np.uint64))
    within = np.arange(len(values)) - np.repeat(starts, lengths)
    return np.add.reduceat(values * powers[within], starts)


def hashes(texts: Sequence[str], fields: Sequence[str] = FIELDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's content and the number of its fields.

    Characters pass through the fold table one after the other into the
    rolling hash of their word, words into that of their field, fields into
    the text's by addition, as their order doesn't matter. Nothing canonical
    is ever built. Words before the first field name don't count.
    """
    n = len(texts)
    cps = points(texts)
    ends = np.flatnonzero(cps == 0)
    # a text may hold U+0000 itself: the joint after text i is known from the lengths
    if len(ends) != n:
        ends = np.cumsum([len(unicodedata.normalize("NFC", t)) + 1 for t in texts]) - 1
    with np.errstate(over="ignore"):
        folded = fold_table()[cps]
        kept = folded != 0
        begins = kept & ~np.concatenate(([False], kept[:-1]))
        out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
        count = np.zeros(n, np.int64)
        if not kept.any():
            return out[0], out[1], count
        chars = _scramble(folded[kept].astype(np.uint64) + np.uint64(1))
        starts = np.cumsum(kept)[begins] - 1
        row = np.searchsorted(ends, np.flatnonzero(begins))
        words = [_rolling(chars, starts, b) for b in BASES]
        marks = {_word(f, BASES[0]) for f in fields}
        is_name = np.isin(words[0], np.array(sorted(marks), np.uint64))
        part = np.cumsum(is_name)
        live = part > 0
        # words of an earlier row's last field that stand before this row's first name
        owner = np.zeros(int(part[-1]) + 1, np.int64)
        owner[part[is_name]] = row[is_name]
        live &= owner[part] == row
        if not live.any():
            return out[0], out[1], count
        part_live, row_live = part[live], row[live]
        first = np.flatnonzero(np.concatenate(([True], part_live[1:] != part_live[:-1])))
        for k in (0, 1):
            per_field = _scramble(_rolling(_scramble(words[k][live]), first, STEPS[k]))
            np.add.at(out[k], row_live[first], per_field)
        np.add.at(count, row_live[first], 1)
    return out[0], out[1], count


def _word(word: str, base: int) -> int:
    values = _scramble(np.array([ord(c) for c in word], np.uint64) + np.uint64(1))
    return int(_rolling(values, np.array([0]), base)[0])


def _fields(folded: list[int], names: dict[tuple[int, ...], str]) -> list[tuple[str, int, int]]:
    """Name, begin and end of each field of a folded text, sorted by name."""
    out, i, n = [], 0, len(folded)
    while i < n:
        if not folded[i]:
            i += 1
            continue
        j = i
        while j < n and folded[j]:
            j += 1
        name = names.get(tuple(folded[i:j])) if j - i <= 64 else None
        if name:
            if out:
                out[-1][2] = i
            out.append([name, j, n])
        i = j
    return sorted(map(tuple, out))


def _same_words(a: list[int], i: int, a_end: int, b: list[int], j: int, b_end: int) -> bool:
    """Two pointers that skip what the fold table skips, in step on words and their ends."""
    while True:
        i0, j0 = i, j
        while i < a_end and not a[i]:
            i += 1
        while j < b_end and not b[j]:
            j += 1
        if i == a_end or j == b_end:
            return i == a_end and j == b_end
        if (i > i0) != (j > j0):
            return False
        while i < a_end and j < b_end and a[i] and a[i] == b[j]:
            i += 1
            j += 1
        if (i < a_end and a[i]) or (j < b_end and b[j]):
            return False


def same_content(a: str, b: str, fields: Sequence[str] = FIELDS) -> bool:
    """Whether two texts have the same fields with the same words in order, compared without building either."""
    if a == b:
        return True
    names = {tuple(map(ord, f)): f for f in fields}
    x, y = (fold_table()[points([t])[:-1]].tolist() for t in (a, b))
    left, right = _fields(x, names), _fields(y, names)
    if [f[0] for f in left] != [f[0] for f in right]:
        return False
    if len({f[0] for f in left}) < len(left):  # a name used twice: its fields match in some order
        words = lambda t, f: tuple(tuple(w) for w in _split(t[f[1] : f[2]]))
        return sorted((f[0], words(x, f)) for f in left) == sorted((f[0], words(y, f)) for f in right)
    return all(_same_words(x, i, i_end, y, j, j_end) for (_, i, i_end), (_, j, j_end) in zip(left, right, strict=True))


def _split(folded: list[int]) -> Iterator[list[int]]:
    word: list[int] = []
    for c in [*folded, 0]:
        if c:
            word.append(c)
        elif word:
            yield word
            word = []


def content_key(text: str, fields: Sequence[str] = FIELDS) -> str:
    """A text equal exactly for texts of the same content; only for rows whose hashes collide by chance."""
    names = {tuple(map(ord, f)): f for f in fields}
    folded = fold_table()[points([text])[:-1]].tolist()
    parts = sorted((name, " ".join("".join(map(chr, w)) for w in _split(folded[i:j]))) for name, i, j in _fields(folded, names))
    return "\n".join(f"{n}: {w}" for n, w in parts)


def copies(records: DataFrame, fields: Sequence[str] = FIELDS, bits: int = 64, min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """kept, copy: each record with the same content as another, with the smallest id of its group (by bytes).

    records: record_id, value. A text is its set of named fields with their
    words; null values and texts without any field name have no content and no
    copies, null ids are ignored. A record with several texts belongs to the
    group of each; repeated rows count once. ``bits`` shortens both hashes, to
    test collisions.

    Groups are found by the two hashes with partial aggregation, each giving
    its smallest id and that record's text; only rows of groups with two ids
    meet that text again (hot groups salted) and are compared with it by two
    pointers. Rows that differ in spite of equal hashes are grouped by their
    exact content.
    """
    rows = records.select("record_id", "value").where("record_id is not null and value is not null")
    mask = (1 << bits) - 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n = hashes(batch.column(1).to_pylist(), fields)
                cut = [pa.array((h & np.uint64(mask)).view(np.int64)) for h in (a, b)]
                keep = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, *cut], ["record_id", "value", "h1", "h2"]).filter(keep)

    key = ["h1", "h2"]
    content = written(rows.mapInArrow(hashed, "record_id string, value string, h1 long, h2 long"), "content")
    groups = content.groupBy(*key).agg(F.min(F.struct("record_id", "value")).alias("_kept"), F.max("record_id").alias("_last"))
    groups = groups.where(F.col("_kept.record_id") != F.col("_last")).select(*key, F.col("_kept.record_id").alias("kept"), F.col("_kept.value").alias("kept_value"))
    (hot,) = skew.hot_groups(content, key, min_rows=min_rows)
    left, right = skew.salted(content, groups, key, hot, ["record_id"])
    pairs = left.join(right, [*key, SALT]).select("kept", "kept_value", "record_id", "value")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, kept_value, ids, values = (c.to_pylist() for c in batch.columns)
            same = [same_content(a, b, fields) for a, b in zip(kept_value, values, strict=True)]
            exact = [None if s else content_key(v, fields) for s, v in zip(same, values, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k if s else None for k, s in zip(kept, same, strict=True)], pa.string()), pa.array(ids, pa.string()), pa.array(exact, pa.string())], ["kept", "copy", "exact"])

    checked = written(pairs.mapInArrow(compared, "kept string, copy string, exact string"), "checked")
    apart = checked.where("exact is not null")
    by_content = apart.groupBy("exact").agg(F.min("copy").alias("kept"))
    others = apart.select("copy", "exact").join(by_content, "exact").select("kept", "copy")
    return checked.where("exact is null").select("kept", "copy").unionByName(others).where("kept != copy").distinct()


def kept_records(found: DataFrame) -> DataFrame:
    """One row per kept record that has copies, with the number of its copies, itself included."""
    return found.groupBy(F.col("kept").alias("record_id")).agg((F.count(F.lit(1)) + 1).alias("copies"))
