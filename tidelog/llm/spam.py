"""Pages of repeated keywords, links, product names and tags instead of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.words import LINK, TAG, Page, Words, tokens
from tidelog.operators import skew
from tidelog.operators.skew import SALT
from tidelog.sources.shared import written

#: Words of a phrase, distinct hosts that make it replicated, and the share of replicated phrases, links and tags that makes a stretch of list words count.
PHRASE, HOSTS, BACKED = 5, 3, 0.5
#: Bits of a word: link or tag, in a list, first of its segment.
SPECIAL, LISTED, BEGINS = 1, 2, 4
_PAGES = "doc_id long, _key long, _check long, _host long, bits binary, likely int, phrases array<long>, dense array<boolean>"
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def windows(begins: np.ndarray, listed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of every phrase, and whether it is a pair out of a list.

    Phrases are five words of one segment; a shorter segment is one phrase.
    Where words stand in a list, any two neighbours are one as well.
    """
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(begins)))
    count = np.maximum(sizes - PHRASE + 1, 1)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    size = np.repeat(np.minimum(sizes, PHRASE), count)
    pair = np.flatnonzero(listed[:-1] & listed[1:] & (doc[1:] == doc[:-1]))
    order = np.argsort(np.concatenate((at, pair)), kind="stable")
    paired = np.repeat([False, True], [len(at), len(pair)])[order]
    return np.concatenate((at, pair))[order], np.concatenate((size, np.full(len(pair), 2)))[order], paired


def phrases(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per phrase its first word, a hash of its set of words, and whether most of it stands in a list; hash 0 where it is all links and tags.

    The order in a phrase is folded, as lists string the same words in any.
    """
    at, size, _ = windows(page.begins, page.listed, page.doc)
    inside = np.arange(PHRASE) < size[:, None]
    where = np.minimum(at[:, None] + np.arange(PHRASE), max(0, len(page.code) - 1))
    words = np.where(inside, page.code[where], np.uint64(0))
    words.sort(axis=1)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(PHRASE):
            new = words[:, i] != (words[:, i - 1] if i else np.uint64(0))
            x = (h ^ words[:, i]) * _MIX
            h = np.where(new, x ^ (x >> np.uint64(29)), h)
    special = (page.kind == LINK) | (page.kind == TAG)
    h[~(inside & ~special[where]).any(axis=1)] = 0
    dense = 2 * (inside & page.listed[where]).sum(axis=1) > size
    return at, h.view(np.int64), dense


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word bits and phrases of each document, many documents at once."""
    import pyarrow as pa

    names = [x.split()[0] for x in _PAGES.split(", ")]
    known = Words()

    def made(heads: list, numbers: list[int], sizes: list[int]) -> pa.RecordBatch:
        page = Page(numbers, sizes, known)
        at, h, dense = phrases(page)
        special = (page.kind == LINK) | (page.kind == TAG)
        bits = special * np.uint8(SPECIAL) + page.listed * np.uint8(LISTED) + page.begins * np.uint8(BEGINS)
        ends = np.cumsum(page.sizes)
        raw = pa.array([bits[a:b].tobytes() for a, b in zip(ends - page.sizes, ends, strict=True)], pa.binary())
        each = np.bincount(page.doc[at], minlength=len(sizes)) if len(at) else np.zeros(len(sizes), np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32())
        likely = pa.array(np.bincount(page.doc[special | page.listed], minlength=len(sizes)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h, dense)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*heads, strict=True)), raw, likely, *lists], names)

    for batch in batches:
        heads, numbers, sizes = [], [], []
        for *head, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = known.numbers(tokens(text))
            numbers += found
            heads.append(head)
            sizes.append(len(found))
            if len(numbers) > 400_000:
                yield made(heads, numbers, sizes)
                heads, numbers, sizes = [], [], []
                if known.full():
                    known = Words()
        if heads:
            yield made(heads, numbers, sizes)
        if known.full():
            known = Words()


def stuffed(documents: DataFrame, host: str, share: float = 0.5, backed: float = BACKED, min_rows: int = skew.MIN_ROWS, small: int = 1_000_000) -> DataFrame:
    """doc_id of the documents more than ``share`` of whose words are links, tags, or stitched from list phrases that other hosts use too.

    documents: doc_id, text and the column ``host`` (who published it; a
    document without one is its own host). Null and blank texts and texts
    without a word are never cases. Rows with the same doc_id are judged each,
    the id comes out once; rows without id never do.

    The phrases of all documents (words.py; five words within a segment, links,
    tags, article codes and numbers folded) are exploded and their distinct
    hosts counted. At the same time each host gives its share of a phrase's
    places that are dense with list evidence: links and tags around, catalogues
    of short items, words that recur nearby. A phrase of at least HOSTS hosts
    is one of lists if the mean of these shares is above a half, and else one
    of sentences. A page's words count if they are links or tags, if they lie
    in a replicated list phrase, or if they lie in a list-dense stretch at
    least ``backed`` of which is such words, except those only in replicated
    phrases of sentences. So no page counts by its form alone: a list that
    shares no phrase with other hosts' lists and has no links or tags is none.
    Whole texts are read and no phrase, host or document is left out.
    """
    own = F.when(F.col(host).isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(host))
    rows = documents.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("_key"), F.hash("text", "doc_id").cast("long").alias("_check"), own.alias("_host"), "text",
    )
    pages = written(rows.mapInArrow(_pages, _PAGES).where("length(bits) > 0"), "pages")
    key = ["doc_id", "_key", "_check"]
    said = pages.select(*key, "_host", F.posexplode(F.arrays_zip("phrases", "dense")).alias("at", "p"))
    said = said.select(*key, "_host", "at", F.col("p.phrases").alias("phrase"), F.col("p.dense").alias("dense")).where("phrase != 0")

    per_host = said.groupBy("phrase", "_host").agg(F.avg(F.col("dense").cast("int")).cast("float").alias("dense"))
    spread = per_host.groupBy("phrase").agg(F.count(F.lit(1)).alias("hosts"), F.avg("dense").alias("listed")).where(F.col("hosts") >= HOSTS)
    telling = written(spread.select("phrase", (F.col("listed") > 0.5).alias("list")), "phrases")
    cover = lambda df, name: df.groupBy(*key).agg(F.collect_set("at").alias(name))
    of_lists = cover(_meet(said, telling.where("list"), min_rows, small), "in_lists")
    # words that count are list words or lie in list phrases; few pages have enough of them, and only those have to meet the phrases of sentences
    most = F.col("likely") + PHRASE * F.coalesce(F.array_size("in_lists"), F.lit(0))
    able = written(pages.drop("_host", "dense", "in_lists").join(of_lists, key, "left").where(most > share * F.length("bits")), "able")
    again = able.select(*key, F.posexplode("phrases").alias("at", "phrase")).where("phrase != 0")
    of_talk = cover(_meet(again, telling.where("not list"), min_rows, small), "in_talk")
    judged = able.select(*key, "bits", "in_lists").join(of_talk, key, "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for doc, bits, lists, talk in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bits", "in_lists", "in_talk")), strict=True):
                if stitched(np.frombuffer(bits, np.uint8), lists or (), talk or (), backed) > share:
                    ids.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])

    return judged.mapInArrow(judge, "doc_id long").distinct()


def _covered(n: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n words lie in phrases that begin at the given words."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def stitched(bits: np.ndarray, in_lists: list[int], in_talk: list[int], backed: float) -> float:
    """The share of words of a page that count, given which of its phrases are replicated in lists and in sentences."""
    at, size, paired = windows((bits & BEGINS) > 0, (bits & LISTED) > 0, np.zeros(len(bits), np.int8))
    n = len(bits)
    lists, talk = np.asarray(in_lists, np.int64), np.asarray(in_talk, np.int64)
    pair = paired[lists]
    # a shorter segment is too little to tell a sentence by
    talk = talk[size[talk] == PHRASE]
    spoken = _covered(n, at[talk], size[talk])
    # pairs are taken from lists only, so what is known from sentences outweighs them
    sure = ((bits & SPECIAL) > 0) | _covered(n, at[lists[~pair]], size[lists[~pair]]) | (_covered(n, at[lists[pair]], size[lists[pair]]) & ~spoken)
    dense = (((bits & LISTED) > 0) & ~spoken) | sure
    # stretches of list words, each with its share of sure ones
    edges = np.flatnonzero(np.diff(np.concatenate(([False], dense, [False]))))
    total = np.concatenate(([0], np.cumsum(sure)))
    a, b = edges[::2], edges[1::2]
    good = total[b] - total[a] >= backed * (b - a)
    good &= total[b] > total[a]
    return float((b - a)[good].sum() / n) if n else 0.0


def _meet(said: DataFrame, telling: DataFrame, min_rows: int, small: int = 1_000_000) -> DataFrame:
    """The rows of said whose phrase is among the telling ones.

    Up to ``small`` telling phrases (counted; 8 bytes each) are sent to every
    task; more are met in a shuffle, with phrases said very often salted.
    """
    phrases = telling.select("phrase")
    if phrases.limit(small + 1).count() <= small:
        return said.join(F.broadcast(phrases), "phrase", "left_semi")
    (hot,) = skew.hot_groups(said, ["phrase"], min_rows=min_rows)
    left, right = skew.salted(said, phrases, ["phrase"], hot, ["_key", "at"])
    return left.join(right, ["phrase", SALT], "left_semi").drop(SALT)
