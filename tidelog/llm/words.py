"""Words of noisy web texts, with each link or tag as one word, their segments, and how list-like their surroundings are."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import regex
import xxhash

#: Kinds of a token: a plain word, a link, a tag, an article code; a separator is no word.
PLAIN, LINK, TAG, CODE, CUT = range(5)
#: Words of an item at most; items or article codes of a run of items that make a catalogue, and its share of words that stand in another item as well.
ITEM_WORDS, ITEMS, CODES, RECURRING = 6, 8, 4, 1 / 3
#: Stand-ins for a link and a tag, from the private area; texts lose their own.
_LINK, _TAG = "", ""

_OWN = re.compile(f"[{_LINK}{_TAG}]")
_MARKS = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
_TORN = re.compile(r"(?<![ \t])[ \t]++\.(?=[^\W_])")
# every part stops at what begins it, so an unclosed mark is looked at once
_SPECIAL = re.compile(
    r"(?P<sure><a\b[^<>]*+>[^<]*+(?:<(?!/?a\b)[^<]*+)*+</a\s*+>|\[[^\[\]\n]*+\]\([^\s()\[\]]*+\)|(?<!\w)(?:h(?:tt|xx)ps?://|www\.)\S++)"
    r"|(?P<host>(?<![\w.-])[\w+-]++(?:\.[\w-]++)++(?:/\S*+)?)"
    r"|(?P<tag>(?:(?<![^\s(,;|>])[#@+$](?=[\w-]*[^\W\d_])|\btag:)[\w-]+(?![\w/+=-]))",
    re.S,
)
_HOST = re.compile(r"(?:[^.]+\.){2,}(?=[\w-]*[^\W\d_])[\w-]{2,}\Z")
_MARKUP = re.compile(r"</?[a-z][^<>]*+>")
_DOT = re.compile(r"\.(?=[^\W\d_])")
_CODE = r"(?<![\w-])[^\W\d_]{1,4}[-‐-–]?\d{2,6}(?![\w-])"
_WORD = r"[^\W_]+(?:['’][^\W_]+)*"
_CUT = r"[,;:.!?](?!\S)|[\n|/>»•·*→]|(?<!\S)[-–—](?!\S)"
_TOKEN = re.compile(rf"{_CODE}|{_WORD}|{_LINK}|{_TAG}|{_CUT}")


def _stand_in(m: re.Match) -> str:
    if m.lastgroup == "tag":
        return f" {_TAG} "
    if m.lastgroup == "host" and "/" not in (t := m.group()) and not _HOST.match(t):
        return t  # a full stop without a space after it, or a number
    return f" {_LINK} "


def plain_letters(text: str) -> str:
    """The text without marks above and below letters and without invisible characters, in compatibility form."""
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


def _may_hold_specials(text: str) -> bool:
    """Whether a lower-case text holds anything a link, tag or markup needs; most don't."""
    return any(c in text for c in "[<#@+$") or "://" in text or "tag:" in text or ("." in text and ("/" in text or bool(_DOT.search(text))))


def tokens(text: str) -> list[str]:
    """Lower-case words, links and tags (one token each), article codes and separators of a text, in time linear in its length."""
    text = plain_letters(html.unescape(text)).lower()
    if _LINK in text or _TAG in text:
        text = _OWN.sub(" ", text)
    if " ." in text or "\t." in text:
        text = _TORN.sub(".", text)
    if _may_hold_specials(text):
        text = _SPECIAL.sub(_stand_in, text)
        if "<" in text:
            text = _MARKUP.sub(" ", text)
    return _TOKEN.findall(text)


class Words(dict):
    """Numbers of tokens in the order they are met; per number the kind, the word it is (a final s does not count) and its code in phrases.

    In phrases all links are one symbol, and so are all tags, all article
    codes and all numbers.
    """

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.kind: list[int] = []
        self.word: list[int] = []
        self.code: list[int] = []
        self.most = most

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        first, last = token[0], token[-1]
        kind = LINK if token == _LINK else TAG if token == _TAG else CUT if not first.isalnum() else CODE if last.isdigit() and first.isalpha() else PLAIN
        base = token[:-1] if last == "s" and len(token) > 3 and token.isalpha() else token
        self.kind.append(kind)
        self.word.append(n if base == token else self[base])
        # numbers are met first as they stand, so the lists grow in step
        symbol = "\1" if kind == LINK else "\2" if kind == TAG else "\4" if kind == CODE else "\3" if token.isdigit() else base
        self.code.append(xxhash.xxh64_intdigest(symbol))
        return n

    def numbers(self, found: list[str]) -> list[int]:
        return list(map(self.__getitem__, found))

    def full(self) -> bool:
        return len(self) > self.most


def _filled(mask: np.ndarray, doc: np.ndarray, most: int) -> np.ndarray:
    """mask with holes of at most ``most`` between two marks of one document filled."""
    marks = np.flatnonzero(mask)
    if len(marks) < 2:
        return mask
    a, b = marks[:-1], marks[1:]
    near = (b - a > 1) & (b - a <= most + 1) & (doc[a] == doc[b])
    step = np.zeros(len(mask) + 1, np.int32)
    np.add.at(step, a[near], 1)
    np.add.at(step, b[near], -1)
    return mask | (np.cumsum(step[:-1]) > 0)


def _repeated(word: np.ndarray, doc: np.ndarray, reach: int, near: int) -> np.ndarray:
    """For each word whether at least half of the words up to ``near`` away occur at least twice more within ``reach`` words of themselves."""
    m = len(word)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.append(starts, m))
    first = np.repeat(starts, sizes)
    last = np.repeat(starts + sizes, sizes)
    at = np.arange(m)
    # one number per (document, word), so that words of different documents never meet
    _, own = np.unique(doc.astype(np.int64) * (int(word.max()) + 1) + word, return_inverse=True)
    order = np.lexsort((at, own))
    key = own[order] * np.int64(4 * (m + reach)) + order
    others = np.searchsorted(key, key + reach, "right") - np.searchsorted(key, key - reach, "left") - 1
    again = np.empty(m, bool)
    again[order] = others >= 2
    total = np.concatenate(([0], np.cumsum(again)))
    lo, hi = np.maximum(at - near, first), np.minimum(at + near + 1, last)
    return (2 * (total[hi] - total[lo]) >= hi - lo) & (last - first >= 6)


def _catalogued(word: np.ndarray, kind: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each word whether it stands in a catalogue: a run of short segments that repeats their make-up.

    An item is a segment of at most ITEM_WORDS plain words. A run of
    successive items is a catalogue if it holds CODES article codes, at least
    one in two items, or ITEMS items of which a share RECURRING of the words
    stands in another item of the run as well, however far away.
    """
    seg = np.cumsum(begins) - 1
    n = int(seg[-1]) + 1
    plain = np.bincount(seg, kind == PLAIN, n)
    codes = np.bincount(seg, kind == CODE, n)
    of_doc = doc[begins]
    short = plain <= ITEM_WORDS
    fresh = np.concatenate(([True], (of_doc[1:] != of_doc[:-1]) | ~short[1:] | ~short[:-1]))
    run = np.cumsum(fresh) - 1
    runs = int(run[-1]) + 1
    items, coded = np.bincount(run, (plain > 0) & short, runs), np.bincount(run, codes, runs)
    good = (coded >= CODES) & (2 * coded >= items)
    maybe = ~good & (items >= ITEMS)
    if maybe.any():
        at = np.flatnonzero(maybe[run[seg]] & (kind == PLAIN))
        r = run[seg[at]]
        # distinct (run, word, item), so a word said twice in one item counts once
        _, pair = np.unique(r.astype(np.int64) * (int(word.max()) + 1) + word[at], return_inverse=True)
        once = np.unique(pair.astype(np.int64) * n + seg[at])
        recurs = np.bincount(once // n, minlength=int(pair.max()) + 1)[pair] > 1
        share = np.bincount(r, recurs, runs) / np.maximum(1, np.bincount(r, minlength=runs))
        good |= maybe & (share >= RECURRING)
    return (good[run] & short)[seg]


def segment_starts(cut: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words begin a segment; a separator ends one, and so does a link, tag or article code after itself.

    cut: whether a separator stands before the word.
    """
    after = np.concatenate(([True], (kind[:-1] != PLAIN) | (doc[1:] != doc[:-1])))
    return cut | after


def list_words(word: np.ndarray, kind: np.ndarray, doc: np.ndarray, begins: np.ndarray, reach: int = 35, near: int = 7, gap: int = 6, hole: int = 3) -> np.ndarray:
    """For each word of several documents, one after the other, whether it stands in a list rather than in a sentence.

    word: a number per different word; doc: ascending numbers of the
    documents; begins: the words that begin a segment. Links and tags stand in
    lists, and so does a run of at most ``gap`` plain words between two of
    them. Other words do in catalogues, or where the same few words recur.
    Holes of at most ``hole`` words between such are filled.
    """
    if len(word) == 0:
        return np.zeros(0, bool)
    out = _filled((kind == LINK) | (kind == TAG), doc, gap)
    plain = np.flatnonzero((kind == PLAIN) | (kind == CODE))
    if len(plain):
        out[plain] |= _repeated(word[plain], doc[plain], reach, near)
    out |= _catalogued(word, kind, doc, begins)
    return _filled(out, doc, hole)


class Page:
    """Words of one or several documents as arrays: number, kind, document, first of a segment, and whether in a list."""

    def __init__(self, numbers: list[int], sizes: list[int], known: Words):
        """numbers: of the tokens of all documents; sizes: tokens of each."""
        every = np.array(numbers, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        kind = np.array(known.kind, np.int8)[every] if len(every) else np.zeros(0, np.int8)
        is_word = kind != CUT
        cut = np.concatenate(([False], ~is_word[:-1]))[is_word] if len(every) else np.zeros(0, bool)
        every = every[is_word]
        self.kind, self.doc = kind[is_word], doc[is_word]
        self.word = np.array(known.word, np.int64)[every] if len(every) else every
        self.code = np.array(known.code, np.uint64)[every] if len(every) else np.zeros(0, np.uint64)
        self.begins = segment_starts(cut, self.kind, self.doc) if len(every) else cut
        self.listed = list_words(self.word, self.kind, self.doc, self.begins)
        self.sizes = np.bincount(self.doc, minlength=len(sizes))


def page(text: str) -> Page:
    """One text as a Page."""
    known = Words()
    found = known.numbers(tokens(text))
    return Page(found, [len(found)], known)
