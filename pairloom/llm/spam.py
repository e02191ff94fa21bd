"""Keyword-stuffed pages, link lists and tag pages by the pointwise mutual information of neighbouring words."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_FLOOR, HOT_SHARE, hot_keys, is_hot, key_hash, lookup, with_group_min
from ..session import materialize

# --- segments and words of many texts --------------------------------------------------------------------------------

FREE, LINK, TAG, OTHER = range(4)
_SENTENCE, _ENDED = 4, 8  # bits beside the kind: a sentence of five words or more; any segment with the end of one
_NUMBER, _IDENTIFIER = 0, 1  # hashes that stand for any number and any identifier

_URL = re.compile(
    r"(?:[a-z]{3,6}://|\bwww\.)[^\s<>\"')\]|]+|\b[\w-]+(?:\.[\w-]+)+/[^\s<>\"')\]|]*|\b[a-z\d-]+(?:\.[a-z\d-]+)*\.[a-z]{2,24}\b(?![.(])", re.I
)
_DOTTED = re.compile(r"\.[^\W\d_]")
_ANCHOR = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)", re.I | re.S)
_HASHTAG = re.compile(r"(?:^|\s)#\w+")
_CODE = re.compile(r"\b[A-Z]{2,5}-\d{2,7}\b")
_UNSEEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_ENDS, _CLOSES, _BARS, _DASHES = ".!?:。？！", "\"')”", "|»•", "/–-"
_CUT = re.compile(r"(?<=[.!?。？！])\s+|[\r\n|»•]|<br\s*/?>|(?:(?<=\s)|^)[/–*-](?=\s)|;(?=\s)")
_WORD = re.compile(r"[^\W_](?:[\w'’]|-(?=\w)|(?<=\d)[.,](?=\d))*")
_BLANK = "\x01"  # stands for a segment that holds nothing but markup

_ALNUM, _UNDER, _DECIMAL, _SPACE, _APOSTROPHE, _END, _CLOSE, _FULL, _LINE, _BAR, _DASH, _SEMICOLON, _HYPHEN, _POINT, _EQUALS = (1 << i for i in range(15))
_CLASSES = np.full(0x110000, 1 << 15, np.uint16)  # filled as code points are met
_POWERS: list = []
#: Characters that are worked on at once; arrays of this length stay in the cache.
_SLICE = 1 << 18


_MARKS = {"_": _UNDER, "'’": _APOSTROPHE, _ENDS: _END, _CLOSES: _CLOSE, _ENDS.replace(":", ""): _FULL, "\r\n": _LINE}
_MARKS |= {_BARS: _BAR, _DASHES + "*": _DASH, ";": _SEMICOLON, "-": _HYPHEN, ".,": _POINT, "=": _EQUALS}


def _classes(points: np.ndarray) -> np.ndarray:
    """Classes of code points."""
    found = _CLASSES[points]
    new = np.unique(points[found == 1 << 15])
    if len(new):
        for i in new.tolist():
            c = chr(i)
            bits = (_ALNUM if c.isalnum() else 0) | (_DECIMAL if c.isdecimal() else 0) | (_SPACE if c.isspace() else 0)
            for chars, bit in _MARKS.items():
                bits |= bit if c in chars else 0
            _CLASSES[i] = bits
        found = _CLASSES[points]
    return found


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        pair = (base, pow(base, -1, 1 << 64))
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, x, np.uint64))]) for x in pair]
    return _POWERS[0], _POWERS[1]


def _forced(part: str) -> tuple[int, str]:
    """(kind that markup, addresses, hashtags or product codes give a segment, else FREE; the segment without markup)."""
    low, bare = part.lower(), part
    if "<" in part or "](" in part:
        bare = _ANCHOR.sub(" ", part)
        if len(bare) < 0.5 * len(part) and ("<a" in low or "](" in part):
            return LINK, bare
    urls = _URL.findall(bare) if "." in bare or "://" in bare else []
    bare = _URL.sub(" ", bare) if urls else bare
    tags = len(_HASHTAG.findall(part)) if "#" in part else 0
    codes = len(_CODE.findall(part)) if "-" in part else 0
    if not (urls or tags or codes or "<meta" in low):
        return FREE, bare
    n = len(_WORD.findall(bare))
    if urls and not (n >= 5 and part.rstrip(_CLOSES)[-1:] in _ENDS) and (n <= 6 or sum(map(len, urls)) >= 0.5 * len(part)):
        return LINK, bare
    if "<meta" in low or (tags and tags >= 0.5 * max(n, 1)) or (codes and n <= 12 * codes):
        return TAG, bare
    return FREE, bare


def _prepared(text: str) -> tuple[str, list | None]:
    """(text as it is cut by characters, None), or for a text with markup its cut segments and [(length, kind)]."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _UNSEEN.sub("", text))
    if not ("<" in text or "#" in text or "](" in text or "://" in text or _DOTTED.search(text) or _CODE.search(text)):
        return text.lower().replace("\0", " "), None
    bare, known = [], []
    for part in _CUT.split(text + "\n"):  # the end of a text is the end of a line
        part = part.strip()
        if part:
            kind, rest = _forced(part)
            known.append((len(part), kind))
            bare.append(rest.lower().replace("\0", " ").strip() or _BLANK)
    return "\0".join(bare), known


def cut_texts(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(segments per text; per segment: characters, kind and words; hash per word) of lines, sentences and list entries.

    All characters of a batch are classified and cut at once. A word is a run of letters, digits and inner marks; its
    hash is a polynomial in its code points, and numbers and identifiers (three digits or more) share one hash each.
    """
    out: list[tuple] = []
    start, size, prepared = 0, 0, []
    for i, text in enumerate(texts):
        prepared.append(_prepared(text))
        size += len(prepared[-1][0])
        if size >= _SLICE or i + 1 == len(texts):
            out.append(_cut_slice(prepared))
            start, size, prepared = i + 1, 0, []
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut_slice(prepared: list[tuple[str, list | None]]) -> tuple[np.ndarray, ...]:
    text = "\n".join(t for t, _ in prepared) + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t, _ in prepared])
    ends = np.cumsum(sizes)
    cls = _classes(c)
    has = lambda bit: (cls & bit) > 0
    space, digit = has(_SPACE), has(_DECIMAL)
    before = lambda x, first=False: np.concatenate([[first], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [False]])

    # segments: runs between separators; texts with markup come cut
    free = np.repeat(np.array([known is None for _, known in prepared]), sizes)
    opening, closing = before(space, True), after(space)
    gap = has(_LINE | _BAR) | (space & before(has(_FULL))) | (opening & closing & has(_DASH)) | (closing & has(_SEMICOLON))
    gap = np.where(free, gap, c == 0)
    gap[ends - 1] = True
    solid = ~gap & ~space
    # the first and last solid character of each run
    run = np.cumsum(gap)
    at = np.flatnonzero(solid)
    first_of = np.flatnonzero(np.concatenate([[True], run[at][1:] != run[at][:-1]])) if len(at) else np.zeros(0, np.int64)
    seg_first = at[first_of]
    seg_last = at[np.concatenate([first_of[1:], [len(at)]]) - 1] if len(at) else seg_first
    seg_doc = np.searchsorted(ends, seg_first, "right")
    n_segments = np.bincount(seg_doc, minlength=len(prepared))
    n = len(seg_first)

    # words: runs of word characters, from their first letter or digit on
    word = has(_ALNUM | _UNDER)
    point = has(_POINT) & before(digit) & after(digit)
    inner = word | has(_APOSTROPHE) | (has(_HYPHEN) & after(word)) | point
    inner &= ~gap
    fresh = inner & ~before(inner)
    named = inner & has(_ALNUM)
    place = np.cumsum(fresh)
    head = np.flatnonzero(named)
    head = head[np.concatenate([[True], place[head][1:] != place[head][:-1]])] if len(head) else head
    stops = np.flatnonzero(inner & ~after(inner)) + 1
    tail = stops[np.searchsorted(stops, head, "right")] if len(head) else head
    powers, inverse = _powers(len(c))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * powers[: len(c)])])
        h = (total[tail] - total[head]) * inverse[head]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))).astype(np.int64)
    h = np.where((h == _NUMBER) | (h == _IDENTIFIER), 2, h)
    digits = np.concatenate([[0], np.cumsum(digit)])
    numeric, many = digit[head], digits[tail] - digits[head] >= 3
    words = np.where(numeric, _NUMBER, np.where(many, _IDENTIFIER, h))

    # kinds
    seg_of = np.searchsorted(seg_first, head, "right") - 1
    count = np.bincount(seg_of, minlength=n)
    numbers, identifiers = np.bincount(seg_of, numeric, n), np.bincount(seg_of, many & ~numeric, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, seg_of, tail - head)
    inside = lambda flags: (lambda t: t[seg_last + 1] > t[seg_first])(np.concatenate([[0], np.cumsum(flags)]))
    figures = inside(has(_EQUALS) | (point & (c == ord("."))))
    trimmed = np.flatnonzero(solid & ~has(_CLOSE))
    last = trimmed[np.maximum(np.searchsorted(trimmed, seg_last, "right") - 1, 0)] if len(trimmed) else seg_last
    ended = has(_END)[last] & (last >= seg_first) if n else np.zeros(0, bool)
    other = (count == 0) | (identifiers > 0) | ((numbers > 0) & ((numbers >= 0.4 * count) | figures)) | (longest >= 25)
    kinds, lengths = np.where(other, OTHER, FREE), seg_last - seg_first + 1
    marked = np.flatnonzero(~free[seg_first]) if n else np.zeros(0, np.int64)
    if len(marked):
        known = np.array([x for _, k in prepared if k is not None for x in k], np.int64).reshape(-1, 2)
        lengths[marked] = known[:, 0]
        kinds[marked] = np.where(known[:, 1] == FREE, kinds[marked], known[:, 1])
    kinds = kinds | np.where(ended, _ENDED, 0) | np.where(ended & (count >= 5), _SENTENCE, 0)
    return n_segments, lengths, kinds, count, words


_CUT_SCHEMA = "lengths array<int>, kinds array<tinyint>, counts array<int>, words array<bigint>"


def _cut(batches: Iterator) -> Iterator:
    """Segments and word hashes of each text; a row without a text (a copy of another) has none and is not ``once``."""
    import pyarrow as pa

    for batch in batches:
        sizes, lengths, kinds, counts, words = cut_texts([t or "" for t in batch.column("text").to_pylist()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        word_ends = np.concatenate([[0], np.cumsum(counts)])[ends]
        lists = lambda x, at, t: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t))
        arrays = [lists(lengths, ends, pa.int32()), lists(kinds, ends, pa.int8()), lists(counts, ends, pa.int32()), lists(words, word_ends, pa.int64())]
        names = ["doc", "key", "once", "lengths", "kinds", "counts", "words"]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), batch.column("text").is_valid(), *arrays], names=names)


# --- arrays over the words of many texts -----------------------------------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two numbers."""
    with np.errstate(over="ignore"):
        k = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (k ^ (k >> np.uint64(29))).astype(np.int64)


def _own(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each place, how often its value occurs in its own text."""
    inverse, _ = pd.factorize(_mix(value, doc))
    return np.bincount(inverse)[inverse] if len(inverse) else np.zeros(0, np.int64)


def _parts(batches: Iterator, rows: int = 500) -> Iterator:
    """Batches in parts whose arrays stay in the cache."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class _Words:
    """Flat arrays over the words of a batch of texts that :func:`_cut` made."""

    def __init__(self, batch):
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        sizes = lambda c: np.diff(batch.column(c).offsets.to_numpy())
        self.n_docs = batch.num_rows
        self.words, self.lengths = flat("words").astype(np.int64), flat("lengths").astype(np.int64)
        kinds, self.counts = flat("kinds"), flat("counts").astype(np.int64)
        self.kind, self.sentence, self.ended = kinds & 3, (kinds & _SENTENCE) > 0, (kinds & _ENDED) > 0
        self.seg_doc = np.repeat(np.arange(self.n_docs), sizes("kinds"))
        self.seg = np.repeat(np.arange(len(kinds)), self.counts)
        self.doc = self.seg_doc[self.seg]
        named = (self.words != _NUMBER) & (self.words != _IDENTIFIER)
        self.free = (self.kind == FREE)[self.seg]
        #: places of the second word of each pair of neighbours
        self.right = 1 + np.flatnonzero((self.doc[1:] == self.doc[:-1]) & named[1:] & named[:-1])
        self.a, self.b = self.words[self.right - 1], self.words[self.right]
        self.pair = _mix(self.a, self.b)
        #: a number for each (text, word), and how many there are
        codes, kinds_of = pd.factorize(_mix(self.words, self.doc))
        self.codes = codes, len(kinds_of)
        #: places that count for the register of a word
        self.placed = np.flatnonzero(self.free & named)


def _count(batches: Iterator) -> Iterator:
    """Partial corpus counts: (0, pair, a, b, n) and (1, word, in sentences, in lists, as left and right neighbour)."""
    import pyarrow as pa

    for batch in batches:
        w = _Words(batch)
        key, first, n = np.unique(w.pair, return_index=True, return_counts=True)
        zero = np.zeros(len(key), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (zero.astype(np.int8), key, w.a[first], w.b[first], n, zero, zero)], names=["what", "key", "a", "b", "n", "n_left", "n_right"]
        )
        words, place = np.unique(w.words, return_inverse=True)
        sums = lambda at, weight=None: np.bincount(place[at], weight, len(words)).astype(np.int64)
        in_sentence = w.sentence[w.seg[w.placed]].astype(float)
        rows = (np.ones(len(words), np.int8), words, sums(w.placed, in_sentence), sums(w.placed, 1 - in_sentence), np.zeros(len(words), np.int64), sums(w.right - 1), sums(w.right))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["what", "key", "a", "b", "n", "n_left", "n_right"])


_COUNT_SCHEMA = "what tinyint, key bigint, a bigint, b bigint, n bigint, n_left bigint, n_right bigint"

#: Tables of the most frequent pairs and words that every task holds: those above 1 / FREQUENT of all pairs (words), so
#: at most FREQUENT entries each, however large the corpus; the rest is looked up by a join.
FREQUENT = 2**16
#: The PMI of a pair is cut to this size before means are taken, so no single rare pair decides.
CLIP = 2.0
#: Occurrences that a pair which no other text has is taken to have.
UNSEEN_COUNT = 0.1
#: Mean clipped PMI below which neighbouring words do not hang together.
SALAD = 1.4
#: Segments of a lower register may be keywords, if repetition and want of coherence outweigh the register by STUFFED.
LISTED, STUFFED = 1.5, 0.7
#: Texts of fewer words hold no keywords, nor do those below REPLY_WORDS with the end of a sentence (short replies).
LEAST_WORDS, REPLY_WORDS = 6, 12
#: Words over which the scores of a segment are averaged; a shorter one borrows those of the nearest segments of its
#: text that, like itself, have LONG words or more, or fewer.
WINDOW = 24
LONG = 8


@dataclass
class _Frequent:
    """Sorted keys and counts of the frequent pairs and words, and the number of all pairs."""

    total: int
    pairs: np.ndarray  # rows key, n, n_left, n_right
    words: np.ndarray  # rows key, in sentences, in lists, n_left, n_right
    cut: float  # every pair that is not in the table is met less often
    most_register: float  # no word that is not in the table has a register of greater size

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table.shape[1] == 0:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table[0], keys), table.shape[1] - 1)
        return table[0][at] == keys, at


def _pmi(n: np.ndarray, left: np.ndarray, right: np.ndarray, total: int) -> np.ndarray:
    """PMI of pairs from counts in other texts, cut to CLIP; UNSEEN_COUNT stands for none, and a pair of words that
    other texts hardly know (nothing is expected of it) has the greatest value: no evidence against it."""
    expected = np.maximum(left, 0) * np.maximum(right, 0) / max(total, 1)
    with np.errstate(divide="ignore"):
        return np.clip(np.log(np.where(n > 0, n, UNSEEN_COUNT)) - np.log(expected), -CLIP, CLIP)


def _register(sentences: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """How much more a word is at home in sentences than in lists of other texts; 0 for an unknown word."""
    return np.log((np.maximum(sentences, 0) + 1) / (np.maximum(lists, 0) + 1))


class _Scores:
    """PMI of each pair and register of each word of a batch, leaving out each text's own occurrences."""

    def __init__(self, w: _Words, frequent: _Frequent):
        self.w = w
        doc = w.doc[w.right]
        self.own_pair = _own(doc, w.pair)
        code, n_codes = w.codes
        sums = lambda at, weight=None: np.bincount(code[at], weight, n_codes)
        self.own_left, self.own_right = sums(w.right - 1)[code[w.right - 1]], sums(w.right)[code[w.right]]
        known, at = frequent.find(frequent.pairs, w.pair)
        _, n, left, right = frequent.pairs[:, at] if frequent.pairs.shape[1] else np.zeros((4, len(at)))
        self.pmi = _pmi(n - self.own_pair, left - self.own_left, right - self.own_right, frequent.total)
        # a rare pair of two frequent words is as loose as can be: its count cannot lift it above the lower limit
        a_known, a_at = frequent.find(frequent.words, w.a)
        b_known, b_at = frequent.find(frequent.words, w.b)
        both = ~known & a_known & b_known
        if both.any():
            most = _pmi(np.full(int(both.sum()), frequent.cut), frequent.words[3][a_at[both]] - self.own_left[both], frequent.words[4][b_at[both]] - self.own_right[both], frequent.total)
            sure = np.flatnonzero(both)[most <= -CLIP]
            self.pmi[sure], known[sure] = -CLIP, True
        self.ask_pairs = np.flatnonzero(~known)

        placed = w.placed
        in_sentence = w.sentence[w.seg[placed]].astype(float)
        self.own_sentence, self.own_list = sums(placed, in_sentence)[code[placed]], sums(placed, 1 - in_sentence)[code[placed]]
        known, at = frequent.find(frequent.words, w.words[placed])
        counts = frequent.words[:, at] if frequent.words.shape[1] else np.zeros((5, len(at)))
        self.register = _register(counts[1] - self.own_sentence, counts[2] - self.own_list)
        self.ask_words = np.flatnonzero(~known)


_ASKED = "array<struct<what:tinyint,key:bigint,place:int,own:bigint,own_1:bigint,own_2:bigint>>"
_JUDGED_SCHEMA = f"key binary, spam boolean, {_CUT_SCHEMA}, asked {_ASKED}"


def _judge(frequent, batches: Iterator) -> Iterator:
    """The texts that are spam whatever the counts of rare pairs and words are, and those whose verdict depends on them.

    A verdict grows with no PMI and no register, so it is certain if both ends of their ranges agree. An open text comes
    with its words and with what the tables of frequent pairs and words do not answer, next to the text's own counts.
    """
    import pyarrow as pa

    for batch in _parts(batches):
        w = _Words(batch)
        s = _Scores(w, frequent.value)
        p, q = s.ask_pairs, s.ask_words
        shares = []
        for sign in (1, -1):
            s.pmi[p], s.register[q] = sign * CLIP, sign * frequent.value.most_register
            shares.append(spam_shares(w, s) > 0.5)
        surely, maybe = shares
        open_ = maybe & ~surely
        kept = np.flatnonzero(maybe)
        p, q = p[open_[w.doc[w.right[p]]]], q[open_[w.doc[w.placed[q]]]]
        doc = np.concatenate([w.doc[w.right[p]], w.doc[w.placed[q]]])
        # places are counted from the first pair (word) of the text
        start_p, start_q = np.searchsorted(w.doc[w.right], np.arange(w.n_docs)), np.searchsorted(w.doc[w.placed], np.arange(w.n_docs))
        fields = {
            "what": np.concatenate([np.zeros(len(p), np.int8), np.ones(len(q), np.int8)]),
            "key": np.concatenate([w.pair[p], w.words[w.placed[q]]]),
            "place": np.concatenate([p - start_p[w.doc[w.right[p]]], q - start_q[w.doc[w.placed[q]]]]).astype(np.int32),
            "own": np.concatenate([s.own_pair[p], np.zeros(len(q), np.int64)]),
            "own_1": np.concatenate([s.own_left[p], s.own_sentence[q]]).astype(np.int64),
            "own_2": np.concatenate([s.own_right[p], s.own_list[q]]).astype(np.int64),
        }
        order = np.argsort(doc, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n_docs)[kept])]).astype(np.int32)
        asked = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v[order]) for v in fields.values()], names=list(fields)))
        rows = batch.take(pa.array(kept))
        columns = [rows.column("key"), pa.array(surely[kept]), *(rows.column(c) for c in ("lengths", "kinds", "counts", "words")), asked]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "spam", "lengths", "kinds", "counts", "words", "asked"])


def _verdict(frequent, batches: Iterator) -> Iterator:
    """Keys of the texts of which more than half of the characters are spam."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        w = _Words(batch)
        s = _Scores(w, frequent.value)
        start = {0: np.searchsorted(w.doc[w.right], np.arange(w.n_docs)), 1: np.searchsorted(w.doc[w.placed], np.arange(w.n_docs))}
        answers = batch.column("answers")
        doc = np.repeat(np.arange(w.n_docs), pc.list_value_length(answers).fill_null(0).to_numpy(zero_copy_only=False))
        flat = answers.flatten()
        what, place, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("what", "place", "value"))
        for kind, target in ((0, s.pmi), (1, s.register)):
            mine = what == kind
            target[start[kind][doc[mine]] + place[mine]] = value[mine]
        yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(spam_shares(w, s) > 0.5))], names=["key"])


def spam_shares(w: _Words, s: _Scores) -> np.ndarray:
    """Share of the characters of each text that belong to link entries, tags or keywords.

    Scores of a segment are means over its words, or over WINDOW words at and around it where it is shorter: coherence (PMI of
    neighbours), repetition (share of the pairs that the text has had before) and register. Keywords are segments that are
    incoherent and no sentence (word salad), or that are at home in lists and repeat collocations or lack coherence.
    A sentence that opens coherently is prose, whatever it lists.
    """
    # places of words in free segments; short segments stand side by side, apart from the longer ones of their text
    at = np.flatnonzero(w.free)
    group = 2 * w.doc[at] + (w.counts[w.seg[at]] >= LONG)
    at, group = at[np.argsort(group, kind="stable")], np.sort(group)
    order = np.full(len(w.words) + 1, -1, np.int64)
    order[at] = np.arange(len(at))
    sums = {name: np.zeros(len(at) + 1) for name in ("pmi", "repeated", "pairs", "register", "words")}

    def fill(name: str, places: np.ndarray, values) -> None:
        target = order[places]
        inside = target >= 0
        sums[name][1 + target[inside]] = values[inside] if isinstance(values, np.ndarray) else values

    fill("pmi", w.right, s.pmi)
    fill("repeated", w.right, 1 - 1 / s.own_pair)
    fill("pairs", w.right, 1.0)
    fill("register", w.placed, s.register)
    fill("words", w.placed, 1.0)
    total = {k: np.cumsum(v) for k, v in sums.items()}

    free_seg = np.flatnonzero((w.kind == FREE) & (w.counts > 0))
    first_word = np.concatenate([[0], np.cumsum(w.counts)])[:-1][free_seg] if len(free_seg) else np.zeros(0, np.int64)
    low = order[first_word]
    n = w.counts[free_seg]
    high = low + n
    mine = 2 * w.seg_doc[free_seg] + (n >= LONG)
    doc_low, doc_high = np.searchsorted(group, mine, "left"), np.searchsorted(group, mine, "right")
    pad = np.maximum(0, (WINDOW - n + 1) // 2)
    left, right = np.maximum(low - pad, doc_low), np.minimum(high + pad, doc_high)
    left = np.maximum(doc_low, left - np.maximum(0, high + pad - doc_high))
    right = np.minimum(doc_high, right + np.maximum(0, doc_low - (low - pad)))

    def mean(name: str, by: str, a: np.ndarray, b: np.ndarray, empty: float) -> np.ndarray:
        top, bottom = total[name][b] - total[name][a], total[by][b] - total[by][a]
        return np.where(bottom > 0, top / np.maximum(bottom, 1), empty)

    coherence = mean("pmi", "pairs", left, right, CLIP)
    repeated = mean("repeated", "pairs", left, right, 0.0)
    register = mean("register", "words", left, right, 0.0)
    lead = np.minimum(low + 4, high)
    sentence = w.sentence[free_seg] & (n >= LONG)
    opened = sentence & (mean("register", "words", low, lead, 0.0) > 1.0) & (mean("pmi", "pairs", np.minimum(low + 1, lead), lead, CLIP) > 0.5)
    salad = (coherence < SALAD) & ~sentence
    stuffed = (register < LISTED) & (2.5 * repeated + (CLIP - coherence) - register > STUFFED)
    keywords = (salad | stuffed) & ~opened

    hit = ((w.kind == LINK) | (w.kind == TAG)).astype(float)
    hit[free_seg] = keywords
    whole = np.bincount(w.seg_doc, w.lengths, w.n_docs)
    listed = np.bincount(w.seg_doc, w.lengths * ((w.kind == LINK) | (w.kind == TAG)), w.n_docs)
    keyed = np.bincount(w.seg_doc, w.lengths * hit, w.n_docs) - listed
    words = np.bincount(w.seg_doc, w.counts, w.n_docs)
    reply = (words < LEAST_WORDS) | ((words < REPLY_WORDS) & (np.bincount(w.seg_doc, w.ended, w.n_docs) > 0))
    keyed = np.where(reply, 0.0, keyed)
    return (listed + keyed) / np.maximum(whole, 1)



def spam_pages(documents: DataFrame, doc_id: str, text: str, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """``doc_id`` of the pages more than half of whose characters are keywords, entries of link lists or tags.

    Links and tags are told by their form. Keywords are told by corpus statistics: pairs and words are counted over all
    distinct texts (copies count once, and a text's own occurrences are left out when it is judged), and a segment is
    judged by the mean pointwise mutual information of its neighbouring words, by repeated collocations and by whether
    its words live in sentences or in lists; see :func:`spam_shares`. No word list, so any language is judged alike;
    words that no other text knows are evidence of nothing.

    Null, empty and blank texts are no pages, rows without an id are left out, repeated rows come out as often as they
    are there; an empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter("doc is not null and trim(text) <> ''")
    rows = rows.withColumn("key", F.unhex(F.md5("text"))).withColumn("row", F.struct("doc", F.monotonically_increasing_id().alias("i")))
    hot = hot_keys(rows, key_hash("key"), rows.count(), share, floor)
    first = with_group_min(rows, ["key"], "row", "first", hot)
    once = first.select("doc", "key", F.when(F.col("row") == F.col("first"), F.col("text")).alias("text"))
    made = materialize(once.mapInArrow(_cut, f"doc {dict(rows.dtypes)['doc']}, key binary, once boolean, {_CUT_SCHEMA}"), "cut")
    cut = made.filter("once").drop("doc", "once")

    counts = cut.drop("key").mapInArrow(_count, _COUNT_SCHEMA).groupBy("what", "key")
    counts = materialize(counts.agg(F.max("a").alias("a"), F.max("b").alias("b"), *(F.sum(c).alias(c) for c in ("n", "n_left", "n_right"))), "corpus")
    total, n_pairs, n_words = counts.agg(
        F.coalesce(F.sum(F.when(F.col("what") == 0, F.col("n"))), F.lit(0)), F.count_if(F.col("what") == 0), F.coalesce(F.sum(F.when(F.col("what") == 1, F.col("a") + F.col("b"))), F.lit(0))
    ).first()
    pairs, words = counts.filter("what = 0").select("key", "a", "b", "n"), counts.filter("what = 1").drop("what", "n")
    stats = pairs
    for side, name in (("a", "n_left"), ("b", "n_right")):
        table = words.select(F.col("key").alias(side), name)
        stats = lookup(stats, table, side, [name], hot_keys(pairs, side, n_pairs, share, floor))
    stats = materialize(stats.select(F.lit(0).cast("tinyint").alias("what"), "key", F.col("n").alias("c1"), F.col("n_left").alias("c2"), F.col("n_right").alias("c3")), "pair-counts")
    word_counts = words.select(F.lit(1).cast("tinyint").alias("what"), "key", F.col("a").alias("c1"), F.col("b").alias("c2"), F.lit(0).cast("bigint").alias("c3"))

    # at most FREQUENT rows each, as all counts sum to the total they are compared with
    top = stats.filter(F.col("c1") >= total / FREQUENT).drop("what").toPandas()
    most = words.filter(F.col("a") + F.col("b") >= n_words / FREQUENT).toPandas()
    as_table = lambda pdf: np.ascontiguousarray(pdf.sort_values("key").to_numpy(np.int64).T)
    frequent = spark.sparkContext.broadcast(_Frequent(total, as_table(top), as_table(most), total / FREQUENT, math.log(n_words / FREQUENT + 1)))

    judged = materialize(cut.mapInArrow(lambda batches: _judge(frequent, batches), _JUDGED_SCHEMA), "judged")
    asked = judged.filter("not spam").select(F.col("key").alias("text_key"), F.explode("asked").alias("x")).select("text_key", "x.*")
    held = asked.join(stats.unionByName(word_counts), ["what", "key"])
    n, left, right = (F.greatest(F.col(f"c{i + 1}") - F.col(o), F.lit(0)) for i, o in enumerate(("own", "own_1", "own_2")))
    expected = left * right / F.lit(float(max(total, 1)))
    pmi = F.when(expected > 0, F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.log(F.when(n > 0, n.cast("double")).otherwise(UNSEEN_COUNT)) - F.log(expected)))).otherwise(CLIP)
    register = F.log((F.greatest(F.col("c1") - F.col("own_1"), F.lit(0)) + 1) / (F.greatest(F.col("c2") - F.col("own_2"), F.lit(0)) + 1))
    answers = held.select("text_key", "what", "place", F.when(F.col("what") == 0, pmi).otherwise(register).alias("value"))
    answers = answers.groupBy(F.col("text_key").alias("key")).agg(F.collect_list(F.struct("what", "place", "value")).alias("answers"))
    late = judged.filter("not spam").drop("asked").join(answers, "key").mapInArrow(lambda batches: _verdict(frequent, batches), "key binary")
    found = materialize(judged.filter("spam").select("key").unionByName(late), "spam")

    hottest = is_hot(key_hash("key"), hot)
    rest = made.filter(~hottest).join(found.filter(~hottest), "key").select("doc")
    if hot:  # at most 1 / share texts
        rest = rest.unionByName(made.filter(hottest).join(F.broadcast(found.filter(hottest)), "key").select("doc"))
    return rest.withColumnRenamed("doc", doc_id)


# --- coherence of whole documents, as a report ------------------------------------------------------------------------


def word_stream(text: Column) -> Column:
    """Hashes of the lower-case words in order; addresses, numbers and accessions stand for their kind.

    One pass of a regular expression; the kinds are told apart by cheap looks at each word.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?:https?|hxxps?)://\S+|#?\p{L}[\p{L}\p{M}\p{Nd}'_-]*+|\p{Nd}[\p{Nd}.,]*+"), F.lit(0))

    def kind(w: Column) -> Column:
        first = F.substr(w, F.lit(1), F.lit(1))
        accession = (F.length(w) == 8) & (F.length(F.translate(w, "0123456789", "")) == 3)
        return F.xxhash64(F.when(w.contains("://"), "://").when(first.between("0", "9"), "0").when(accession, "0a").otherwise(w))

    return F.transform(words, kind)


#: Pointwise mutual information below which two neighbours hardly go together.
LOOSE = 2.0


def coherence(
    documents: DataFrame, doc_id: str, text: str, share: float = HOT_SHARE, floor: int = 20 * HOT_FLOOR
) -> DataFrame:
    """Per document with two words or more: neighbouring pairs, their mean pointwise mutual information, the share of
    loose pairs, and the share of pairs that are collocations (positive PMI) met three times or more in the document.

    Word and pair counts are taken over all documents, from the partial counts per document, so a repeated page costs
    one row per distinct pair; hot words and hot pairs are looked up from a broadcast. Words are 64-bit hashes.
    """
    words = documents.select(F.col(doc_id).alias("doc"), word_stream(F.col(text)).alias("w"))
    words = words.filter(F.size("w") >= 2)
    n = F.size("w")
    both = F.arrays_zip(F.slice("w", F.lit(1), n - 1).alias("a"), F.slice("w", F.lit(2), n - 1).alias("b"))
    pairs = words.select("doc", F.explode(both).alias("p")).select("doc", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    per_doc = materialize(pairs.groupBy("doc", "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("pair", F.xxhash64("a", "b")), "doc-pairs")

    corpus = materialize(per_doc.groupBy("pair", "a", "b").agg(F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("docs")), "pairs")
    total, n_kinds = corpus.agg(F.sum("n_pair"), F.count(F.lit(1))).first()
    total = total or 0
    left = corpus.groupBy("a").agg(F.sum("n_pair").alias("n_a"))
    right = corpus.groupBy("b").agg(F.sum("n_pair").alias("n_b"))
    scored = lookup(corpus, left, "a", ["n_a"], hot_keys(corpus, "a", n_kinds, share, floor))
    scored = lookup(scored, right, "b", ["n_b"], hot_keys(corpus, "b", n_kinds, share, floor))
    pmi = F.log(F.col("n_pair") * F.lit(float(max(total, 1))) / (F.col("n_a").cast("double") * F.col("n_b")))
    scored = scored.select("pair", pmi.alias("pmi"))
    limit = max(floor, share * (total or 1))
    hot = [r[0] for r in corpus.filter(F.col("docs") > limit).select("pair").collect()]  # at most 1 / share pairs
    joined = lookup(per_doc, scored, "pair", ["pmi"], hot)
    weight = F.sum("n")
    return joined.groupBy("doc").agg(
        weight.alias("n_pairs"),
        (F.sum(F.col("n") * F.col("pmi")) / weight).alias("mean_pmi"),
        (F.sum(F.when(F.col("pmi") < LOOSE, F.col("n")).otherwise(0)) / weight).alias("loose"),
        (F.sum(F.when((F.col("n") >= 3) & (F.col("pmi") > 0), F.col("n")).otherwise(0)) / weight).alias("repeated"),
    )
