"""Evaluation texts leaking into training text: a prefix-filtered set join with exact windows.

Both sides are reduced to words in a form that case, spacing, punctuation, line marks, markup, compatibility characters and
look-alikes do not change; in Chinese and Japanese, characters stand for words. An item's shingles are runs of three words, or of as many as
0.4 of its words if these are fewer: of one word for items of one or two words, of two for items of three to five.

1. Documents are read once. Of each only the words that some item has are kept, as numbers, and the item shingles in it.
2. The shingles' document frequencies over all documents order each item's shingles by rarity.
3. A document that holds an item in the sense below shares at least tau of the item's shingles, so at least one of its
   |S| - tau + 1 rarest ones: only these prefixes are joined.
4. Length and position: tau shared shingles must lie in a window of the item's size in nearly the item's places, that is within a
   band of diagonals as wide as the words that may be added or lost, and cover a share of the item's words.
5. Shingles in the item's order that are enough by themselves settle it; else in these windows a local alignment (a match +1, a changed, added or lost word -1) finds the item's words that stand there in order;
   the document holds the item if they are at least num/den of the item's words.

Steps 3 and 4 ask that shared shingles cover `cover` = 0.2 of the item's words, so the search is not lossless. Of passages with exactly 0.4 of an item's words it misses (simulated, changes at
random) with every eighth word changed none for items of 80 words, 0.05 % for 40 and 2 % for 20, with every fifth 0.1, 2 and 7 %, with every third 5, 16 and 26 %. Passages with a larger part of
the item are missed less. A smaller `cover` misses less and aligns more pairs: 0.14 took three times the CPU; with 0 one shared shingle is enough.

Items are broadcast in blocks of bounded size; a larger set of items takes more passes, not more memory.

Defined results. Null texts, and items without a word, are in no pair. An item of one word is held by every document that has it. Repeated documents and repeated items each count. An item can
be held in several places of a document; that is one pair. Empty tables give no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Cyrillic and Greek letters and the Latin letters that they look like.
_LOOK_ALIKE = dict(zip("аеорсухіѕјкмтнвгԁԛԝһαοερνικυτη", "aeopcyxisjkmthbrdqwhaoepvikuth", strict=True))
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_CJK}]|(?:(?![{_CJK}])[^\W_])+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,60}>")
_DROP = re.compile("[̀-ͯ­​-‏‪-‮⁠-⁤︀-️﻿]")
_TABLE = str.maketrans(_LOOK_ALIKE)
_MARKUP = re.compile(r"\*\*|__|~~|`")
#: Words of a shingle, at most.
Q = 3


@dataclass(frozen=True)
class LeakParams:
    """Least share of an item's words; least share that shared shingles cover; words added or lost in a passage, as a share of the item;
    characters of items in a block."""

    num: int = 2
    den: int = 5
    cover: float = 0.2
    drift: float = 0.25
    block_chars: int = 16_000_000


def words(text: str) -> list[str]:
    """The words of a text in reduced form."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    text = _MARKUP.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return _WORD.findall(unicodedata.normalize("NFC", _DROP.sub("", text)).translate(_TABLE))


def _expanded(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists that lie behind each other, beginning at `first`: the places of all elements of the lists `of`, and which of these lists each is from."""
    n = first[of + 1] - first[of]
    row = np.repeat(np.arange(len(of)), n)
    return np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(len(row)), row


class ItemIndex:
    """The shingles of a block of items: sorted keys; the shingles of each item with their places; and for each shingle the items in whose prefix it is."""

    def __init__(self, items: list[tuple[object, str]], p: LeakParams):
        self.p, self.vocabulary, self.ids, self.texts = p, {}, [], []
        for i, text in items:
            if w := words(text):
                self.ids.append(i)
                self.texts.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int32))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.q = np.clip(-(-self.size * p.num // p.den), 1, Q)
        self.lengths = np.unique(self.q).tolist()
        keys = [self.keys(t, int(q)) for t, q in zip(self.texts, self.q, strict=True)]
        self.item_first = np.cumsum([0, *map(len, keys)])
        self.key, self.item_code = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        self.item_place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(k)) for k in keys)])
        by = np.argsort(self.item_code, kind="stable")
        self.all_owner, self.all_place = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[by] if keys else np.zeros(0, np.int64), self.item_place[by]
        self.all_first = np.searchsorted(self.item_code[by], np.arange(len(self.key) + 1))
        self.least = np.maximum(1, np.ceil(p.cover * self.size / self.q)).astype(np.int64)  # tau
        self.band = np.ceil(self.size * p.drift).astype(np.int64)
        self.rare_first, self.rare_owner = np.zeros(len(self.key) + 1, np.int64), np.zeros(0, np.int64)

    def keys(self, w: np.ndarray, q: int) -> np.ndarray:
        """The key of the q words at each place, -1 where one is unknown."""
        n = len(w) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        v = len(self.vocabulary) + 2
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(Q):
            x = w[k : k + n].astype(np.int64) if k < q else np.int64(v - 1)  # v - 1 is no word
            out = out * v + x
            known &= x >= 0
        out[~known] = -1
        return out

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a document with an item shingle, in order, and which."""
        places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q in self.lengths:
            k = self.keys(w, q)
            at = np.flatnonzero(k >= 0)
            code = np.minimum(np.searchsorted(self.key, k[at]), len(self.key) - 1)
            same = self.key[code] == k[at]
            places.append(at[same])
            codes.append(code[same])
        at, code = np.concatenate(places), np.concatenate(codes)
        order = np.argsort(at, kind="stable")
        return at[order], code[order]

    def order(self, frequency: np.ndarray) -> None:
        """Take for each item the prefix of its rarest shingles; only these join."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.item_first))
        pairs = np.unique(np.stack([owner, self.item_code]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
        owner, code = pairs
        by = np.lexsort((code, frequency[code], owner))
        owner, code = owner[by], code[by]
        n = np.bincount(owner, minlength=len(self.ids))
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        keep = rank < (n - self.least + 1)[owner]
        owner, code = owner[keep], code[keep]
        by = np.lexsort((owner, code))
        self.rare_owner = owner[by]
        self.rare_first = np.searchsorted(code[by], np.arange(len(self.key) + 1))

    def hits_of(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The documents behind each other, parted by unknown words; places with an item shingle, which shingle, and of which document."""
        gap = np.full(Q - 1, -1, np.int32)
        w = np.concatenate([x for d in docs for x in (d, gap)])
        at, code = self.hits(w)
        ends = np.cumsum([len(d) + Q - 1 for d in docs])
        return w, at, code, np.searchsorted(ends, at, side="right")

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """Which of these documents hold which items, and how many of their words. All documents are looked through at once."""
        w, at, code, doc = self.hits_of(docs)
        # The prefix join: pairs that share one of the item's rarest shingles. Only pairs that there are take part from here on.
        flat, row = _expanded(self.rare_first, code)
        pairs = np.unique(doc[row] * len(self.ids) + self.rare_owner[flat])
        if not len(pairs):
            return []
        ends = np.cumsum([len(d) + Q - 1 for d in docs])
        # All shared shingles of these pairs: from the documents' shingles to the items that have them, or from the items' to the documents, whichever is less to look at.
        owners = np.diff(self.all_first)[code]
        if owners.sum() <= self.size[pairs % len(self.ids)].sum():
            cuts = np.flatnonzero(np.r_[True, np.diff(np.cumsum(owners) // _HITS_AT_ONCE) > 0])
            runs = (self._of_documents(pairs, at[a:b], code[a:b], doc[a:b]) for a, b in _between(cuts, doc))
        else:
            by = np.lexsort((at, code, doc))
            runs = self._of_items(pairs, at[by], (doc * len(self.key) + code)[by])
        out: list[tuple[int, int, int]] = []
        for pair, place, where in runs:
            out += self._held(pair, place, where, w, ends)
        return out

    def _of_documents(self, pairs: np.ndarray, at: np.ndarray, code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair (document * items + item), place in the item and in the documents of each shared shingle of the given pairs."""
        flat, row = _expanded(self.all_first, code)
        pair = doc[row] * len(self.ids) + self.all_owner[flat]
        there = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        keep = pairs[there] == pair
        return pair[keep], self.all_place[flat][keep], at[row[keep]]

    def _of_items(self, pairs: np.ndarray, at: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same in runs of pairs. keys: document and shingle of each hit, sorted."""
        size = np.cumsum(self.size[pairs % len(self.ids)])
        a = 0
        while a < len(pairs):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _HITS_AT_ONCE, side="right")))
            item, document = pairs[a:b] % len(self.ids), pairs[a:b] // len(self.ids)
            flat, row = _expanded(self.item_first, item)
            wanted = document[row] * len(self.key) + self.item_code[flat]
            low = np.searchsorted(keys, wanted)
            n = np.searchsorted(keys, wanted, side="right") - low
            where = at[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield np.repeat(pairs[a:b][row], n), np.repeat(self.item_place[flat], n), where
            a = b

    def _held(self, pair: np.ndarray, place: np.ndarray, where: np.ndarray, w: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """document, item and words of those pairs in which the document holds the item, from their shared shingles."""
        order = np.argsort(pair, kind="stable")
        pair, place, where = pair[order], place[order], where[order]
        enough = np.searchsorted(pair, pair, side="right") - np.searchsorted(pair, pair) >= self.least[pair % len(self.ids)]
        pair, place, where = pair[enough], place[enough], where[enough]
        if not len(pair):
            return []
        owner = pair % len(self.ids)
        # Position: shingles of one passage lie on diagonals (place in the document less place in the item) that differ by the words added or lost.
        most = int(self.size.max())
        line = pair * (len(w) + 2 * most + 4) + where - place + most
        order = np.argsort(line, kind="stable")
        line, owner, place, where, pair = line[order], owner[order], place[order], where[order], pair[order]
        left = np.searchsorted(line, line - self.band[owner])
        left = np.maximum(left, np.searchsorted(pair, pair))
        enough = np.flatnonzero(np.arange(len(line)) - left + 1 >= self.least[owner])
        out: dict[int, int] = {}
        tried: dict[int, list[int]] = {}
        if not len(enough):
            return []
        # Shingles cover no more words than from the first one to the last.
        ends_of = np.stack([left[enough], enough + 1], axis=1).ravel()
        span = np.maximum.reduceat(np.append(place, 0), ends_of)[::2] - np.minimum.reduceat(np.append(place, 0), ends_of)[::2] + self.q[owner[enough]]
        enough = enough[span >= self.p.cover * self.size[owner[enough]]]
        enough = enough[np.argsort(left[enough] - enough, kind="stable")]  # the fullest bands first
        begins = left[enough]
        for r, at, g, first in zip(enough.tolist(), begins.tolist(), pair[enough].tolist(), (where[begins] - place[begins]).tolist(), strict=True):
            if g in out:
                continue
            i = g % len(self.ids)
            size, band, q = int(self.size[i]), int(self.band[i]), int(self.q[i])
            before = tried.get(g)
            if before and any(abs(t - first) <= band for t in before):
                continue
            s = place[at : r + 1]
            covered = np.zeros(size + Q, bool)
            for k in range(q):
                covered[s + k] = True
            if covered.sum() < self.p.cover * size:
                continue
            tried.setdefault(g, []).append(first)
            d = g // len(self.ids)
            begin = int(ends[d - 1]) if d else 0
            if (held := chained(s, where[at : r + 1], q)) * self.p.den >= self.p.num * size:
                out[g] = held
                continue
            passage = w[max(begin, first - band) : min(int(ends[d]) - Q + 1, first + size + 2 * band + Q)]
            if in_order(self.texts[i], passage) * self.p.den < self.p.num * size:
                continue  # an alignment has no more matches than this
            found = aligned(self.texts[i], passage)
            if found * self.p.den >= self.p.num * size:
                out[g] = found
        return [(g // len(self.ids), g % len(self.ids), m) for g, m in sorted(out.items())]


def chained(place: np.ndarray, where: np.ndarray, q: int = Q) -> int:
    """Words of an item in its shingles that stand in a document in the same order; 0 if more words lie between them than they are.

    That many words matched, and fewer changed, is an alignment with a positive score, so none has to be searched for.
    """
    tails: list[int] = []
    last: list[int] = []
    before = np.full(len(place), -1)
    order = np.lexsort((-where, place))
    for k, d in zip(order.tolist(), where[order].tolist(), strict=True):
        at = bisect_left(tails, d)
        if at == len(tails):
            tails.append(d)
            last.append(k)
        else:
            tails[at], last[at] = d, k
        before[k] = last[at - 1] if at else -1
    chain, k = [], last[-1]
    while k >= 0:
        chain.append(k)
        k = int(before[k])
    s, d = place[chain], where[chain]
    covered = len(np.unique(np.concatenate([s + k for k in range(q)])))
    covered = min(covered, len(np.unique(np.concatenate([d + k for k in range(q)]))))
    return covered if 2 * covered > max(s.max() - s.min(), d.max() - d.min()) + q else 0


def in_order(item: np.ndarray, passage: np.ndarray) -> int:
    """The longest common subsequence of words, by bit-parallel sums."""
    place: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for x in passage.tolist():
        if u := place.get(x):
            u &= v
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def aligned(item: np.ndarray, passage: np.ndarray) -> int:
    """Matched words of the best local alignment: match +1, change, addition or loss -1; on equal scores the one with more matches."""
    unit = np.int64(1 << 20)
    n = len(passage)
    ramp = np.arange(n + 1, dtype=np.int64) * unit
    row, best = np.zeros(n + 1, np.int64), 0
    score = {int(x): np.where(passage == x, unit + 1, -unit) for x in np.unique(item)}
    for x in item:
        new = np.maximum(row - unit, 0)
        np.maximum(new[1:], row[:-1] + score[int(x)], out=new[1:])
        new = np.maximum.accumulate(new + ramp) - ramp
        new[new < unit] = 0
        row = new
        best = max(best, int(row.max()))
    return best & ((1 << 20) - 1)


#: Words, and shared shingles, that are looked through at once; bounds on memory only.
_WORDS_AT_ONCE, _HITS_AT_ONCE = 150_000, 1_000_000


def _between(cuts: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of hits that begin near the cuts, moved back to where a document begins."""
    starts = np.unique(np.searchsorted(doc, doc[cuts]))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(doc)], strict=True)


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Documents in runs of bounded size, one at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > _WORDS_AT_ONCE:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _reduce(docs: DataFrame, index) -> DataFrame:  # noqa: ANN001 - a broadcast ItemIndex
    """id, words (numbers, -1 for words of no item), seen (distinct item shingles) of every document with an item shingle."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        number = x.vocabulary.get
        for batch in batches:
            texts = [(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if t]
            for a, b in _runs([len(t) // 5 for _, t in texts]):
                w = [np.array([number(y, -1) for y in words(t)], np.int32) for _, t in texts[a:b]]
                _, _, code, doc = x.hits_of(w)
                row, kept, seen = [], [], []
                for d, c in zip(*_split(doc, code), strict=True):
                    row.append(texts[a + d][0])
                    kept.append(w[d].tobytes())
                    seen.append(np.unique(c).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(kept, pa.binary()), pa.array(seen, pa.binary())], names=["id", "words", "seen"])

    return docs.select("id", "text").mapInArrow(kernel, f"id {docs.schema['id'].dataType.simpleString()}, words binary, seen binary")


def _split(group: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The groups, which are in order, and the values of each."""
    if not len(group):
        return [], []
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return group[start].tolist(), np.split(values, start[1:])


def _frequencies(reduced: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the index's shingles is; as many numbers as the index has shingles."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total[np.frombuffer(b.as_py(), np.int32)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(size, np.int64)
    for r in reduced.select("seen").mapInArrow(kernel, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["code"]] = r["n"]
    return out


def _verify(reduced: DataFrame, index, kind: str) -> DataFrame:  # noqa: ANN001 - a broadcast ItemIndex
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for batch in batches:
            docs = [np.frombuffer(b, np.int32) for b in batch.column(1).to_pylist()]
            for a, b in _runs([len(d) for d in docs]):
                found = x.matches(docs[a:b])
                row, item, held, size = ([f(r) for r in found] for f in (lambda r: a + r[0], lambda r: x.ids[r[1]], lambda r: r[2], lambda r: int(x.size[r[1]])))  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(held, pa.int32()), pa.array(size, pa.int32())], names=["id", "item", "words_found", "item_words"])

    return reduced.select("id", "words").mapInArrow(kernel, f"id {kind}, item bigint, words_found int, item_words int")


def leaks(docs: DataFrame, items: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """id, item, words_found, item_words: every document (id, text) and every item (item BIGINT, text) that it holds.

    words_found is what the first passage that is enough has been seen to hold, not the greatest number of all.
    """
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    items = items.where("text is not null")
    chars = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, ceil(chars / p.block_chars))
    result = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        index = ItemIndex([(r["item"], r["text"]) for r in block.select("item", "text").orderBy("item").toLocalIterator()], p)
        reduced = cut(_reduce(docs, spark.sparkContext.broadcast(index)))
        index.order(_frequencies(reduced, len(index.key)))
        found = _verify(reduced, spark.sparkContext.broadcast(index), kind)
        result = found if result is None else result.unionByName(found)
    return result
