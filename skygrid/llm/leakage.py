"""Held-out evaluation texts, whole or in passages, inside the documents of a corpus.

Q-gram lemma filtering: texts are normalised to words, and the characters of the
words without spaces to q-grams. A passage of an item that a document copies with
at most so many changed words keeps at least a certain number of its q-grams, and
all of them lie within a narrow range of diagonals (position in the document less
position in the item). So shared q-grams are counted in overlapping diagonal bands,
bands that reach the item's bound are kept, and each of those is verified by a
word alignment of the band's region under the edit budget.

A pair is reported if the alignment finds a stretch of at least RUNNING words of the
item, or all of a shorter item, with at most one word in EIGHTH replaced, misspelt,
left out or added. A stretch begins and ends with an equal or misspelt word, unless it is
all of the item. Where two words are written as one or one as two this is no change.
A word longer than LONG characters is told apart by its first ones and a hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygrid.llm.words import fold, unescape
from skygrid.session import fresh_dir, settle

RUNNING, EIGHTH = 12, 8
Q = 10
#: A stretch of this many words or more contains a shorter one that qualifies too (see bound), so at most MOST changes need be looked for.
ENOUGH, MOST = 2 * RUNNING + 2, 3
#: Words in a row without change that any stretch of RUNNING to ENOUGH words holds: e changes leave e + 1 runs.
INTACT = 5
#: Characters by which a word counts in the q-gram stream.
LONG = 40
#: Width of a diagonal band. Bands overlap by half, and MOST words of LONG characters shift a stretch by less than that.
BAND = 256
#: Words around the shared q-grams that are aligned with them: all of a shortest stretch lies within.
AROUND = ENOUGH + MOST
#: Characters of items indexed at a time; a larger query set is searched in blocks of so many.
BLOCK_CHARS = 2_000_000
#: Characters of documents that one vectorised step looks up.
STEP_CHARS = 4_000_000
#: A longer text is searched in windows of so many words that overlap by more than any qualifying stretch needs.
WINDOW_WORDS, OVERLAP_WORDS = 20_000, 200
PAIRS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("eval_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("edits", T.IntegerType())])

#: Between texts that are cleaned together; no pattern reaches across it.
_END = "\x03"
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|font|small|mark|sub|sup|a|tt|code)\b[^<>\x03]*>", re.I)
_TAG = re.compile(r"</?[a-z!][^<>\x03]*>", re.I)
_HYPHEN = re.compile(r"(?<=\w)[-‐‑¬]\s*\n[\s>|*]*(?=\w)")
_WORD = re.compile(r"[\wऀ-෿]+")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿᠎͏]")


def _clean(text: str) -> str:
    """Without what does not count; works on one text or on several with _END between them."""
    t = unescape(text)
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if "-" in t or not t.isascii():
        t = _HYPHEN.sub("", t)
    return fold(t)


def words_of(text: str | None) -> list[str]:
    """Words without what does not count: case, accents, punctuation, spacing, hyphenation, markup, entities, look-alikes, invisible characters."""
    return [w.replace("_", "") for w in _WORD.findall(_clean((text or "").replace(_END, " "))) if w.strip("_")]


def words_of_many(texts: list[str]) -> list[list[str]]:
    """words_of() of each text, in one sweep over the plain ones and one over the rest."""
    out: list[list[str]] = [[]] * len(texts)
    plain = [t.isascii() and "&" not in t for t in texts]
    for kind in (True, False):
        at = [i for i, x in enumerate(plain) if x == kind]
        whole = f"\n{_END}\n".join(texts[i] for i in at)
        parts = _clean(whole).split(_END) if whole.count(_END) == len(at) - 1 else []
        if len(parts) != len(at):
            for i in at:
                out[i] = words_of(texts[i])
            continue
        for i, t in zip(at, parts):
            out[i] = [w.replace("_", "") for w in _WORD.findall(t) if w.strip("_")] if "_" in t else _WORD.findall(t)
    return out


def windows(words: list[str]) -> list[list[str]]:
    """All words, in overlapping windows; a qualifying stretch has fewer than OVERLAP_WORDS words and so lies whole in one of them."""
    step = WINDOW_WORDS - OVERLAP_WORDS
    return [words[i : i + WINDOW_WORDS] for i in range(0, max(len(words) - OVERLAP_WORDS, 1), step)]


def _short(word: str) -> str:
    return word if len(word) <= LONG else f"{word[: LONG - 8]}{zlib.crc32(word.encode()):08x}"


def _codes(words: list[str]) -> np.ndarray:
    text = "".join(words)
    if max(map(len, words), default=0) > LONG:
        text = "".join(map(_short, words))
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Rolling hash of every run of q characters."""
    n = codes.size - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[k : k + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def stretches(words: list[str], q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every stretch of the item that can qualify and holds no shorter one: first and last q-gram position (end excluded), and how many q-grams it keeps at least.

    Cut a stretch of L words with e <= L / EIGHTH changes in two: in one part the
    changes are no denser. Cutting changed words off its ends leaves them no denser
    either, and at least RUNNING words of 13 or more. So a stretch of ENOUGH words
    contains a shorter one that qualifies. A changed word destroys at most its own characters
    and q - 1 more q-grams.
    """
    size = np.array([min(len(w), LONG) for w in words], int)
    n = size.size
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for length in range(min(RUNNING, n), min(ENOUGH, n + 1)):
        edits = length // EIGHTH
        part = np.lib.stride_tricks.sliding_window_view(size, length)
        lost = np.sort(part, axis=1)[:, length - edits :].sum(axis=1) + edits * (q - 1)
        end = at[length:] - (q - 1)
        out.append((at[: n - length + 1], np.maximum(end, at[: n - length + 1]), part.sum(axis=1) - (q - 1) - lost))
    return tuple(np.concatenate(x) for x in zip(*out))


def bound(words: list[str], q: int = Q) -> int:
    """Least number of q-grams that any qualifying stretch of the item keeps; 0 or less if one may keep none."""
    return int(stretches(words, q)[2].min())


def intact(words: list[str], q: int = Q) -> int:
    """Least number of q-grams of INTACT words in a row of the item, whatever the words."""
    size = np.array([min(len(w), LONG) for w in words], int)
    edits = len(words) // EIGHTH
    n = INTACT if len(words) >= RUNNING else -(-(len(words) - edits) // (edits + 1))
    return int(np.lib.stride_tricks.sliding_window_view(size, n).sum(axis=1).min()) - (q - 1) if n and size.size >= n else 0


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.stretches = [stretches(w) if w else None for w in self.words]
        self.bounds = np.array([x[2].min() if x else 1 << 30 for x in self.stretches], np.int64)
        hs, owner, at = [], [], []
        for k, w in enumerate(self.words):
            h = grams(_codes(w))
            hs.append(h)
            owner.append(np.full(h.size, k))
            at.append(np.arange(h.size))
        #: Characters of each item.
        self.sizes = [sum(min(len(x), LONG) for x in w) for w in self.words]
        self.intact = np.array([intact(w) for w in self.words], np.int64)
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = np.concatenate(owner)[order] if hs else np.zeros(0, int)
        self.at = np.concatenate(at)[order] if hs else np.zeros(0, int)
        #: Items of which a qualifying stretch may share no q-gram: they are aligned without filter.
        self.bare = [k for k, w in enumerate(self.words) if w and self.bounds[k] < 1]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hash >> np.uint64(44)).astype(np.int64)] = True


def misspelt(a: str, b: str) -> bool:
    """Whether two different words of four letters or more are one letter added, left out, replaced or swapped apart."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[1::-1] == y[:2] and x[2:] == y[2:])


def align(a: list[str], b: list[str], whole: bool) -> tuple[int, int] | None:
    """The best qualifying stretch of item words a in document words b as (words, edits), or None.

    whole: all of a must be covered, within the changes that its length allows.
    """
    return _align(a, b, whole, None) or (None if whole else _align(a, b, False, misspelt))


def _align(a: list[str], b: list[str], whole: bool, like: Callable[[str, str], bool] | None) -> tuple[int, int] | None:
    """Row by row over the words of a; best[e][j]: words of a covered by a stretch with e changes that ends at word j of b."""
    m, n = len(a), len(b)
    if not m or not n:
        return None
    most = m // EIGHTH if whole else min(m // EIGHTH, MOST)
    code: dict[str, int] = {}
    num = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    ca, cb = num(a), num(b)
    pair_a = num([""] + [x + y for x, y in zip(a, a[1:])])
    pair_b = num([""] + [x + y for x, y in zip(b, b[1:])])
    near: dict[str, np.ndarray] = {}
    if like is not None:
        words = list(dict.fromkeys(b))
        for w in dict.fromkeys(a):
            if close := [code[x] for x in words if abs(len(x) - len(w)) < 2 and like(w, x)]:
                near[w] = np.isin(cb, close)
    none = -(1 << 20)
    prev = np.full((most + 1, n + 1), none)
    prev2 = prev.copy()
    spent = np.arange(most + 1)
    best = None
    for i in range(m):
        eq = ca[i] == cb
        joined = pair_a[i] == cb if i else None
        parted = ca[i] == pair_b
        alike = near.get(a[i])
        diag = prev[:, :-1]
        hit = np.where(eq, np.maximum(diag, 0) + 1, none)
        if joined is not None and joined.any():
            hit = np.where(joined, np.maximum(hit, np.maximum(prev2[:, :-1], 0) + 2), hit)
        if parted.any():
            two = np.full((most + 1, n), none)
            two[:, 1:] = prev[:, :-2]
            hit = np.where(parted, np.maximum(hit, np.maximum(two, 0) + 1), hit)
        if alike is not None:
            hit[1:] = np.where(alike, np.maximum(hit[1:], np.maximum(diag[:-1], 0) + 1), hit[1:])
        top = hit.max(axis=1)
        fine = top >= m - (m // EIGHTH - spent) if whole else (top >= RUNNING) & (spent <= top // EIGHTH)
        for e in np.flatnonzero(fine).tolist():
            if best is None or (int(top[e]), -e) > (best[0], -best[1]):
                best = (int(top[e]), e)
        now = np.full((most + 1, n + 1), none)
        now[:, 1:] = hit
        if most:
            # a word replaced or left out; then, from few changes to many, one added
            kept = np.maximum(prev[:-1, :-1], prev[:-1, 1:])
            np.maximum(now[1:, 1:], np.where(kept > 0, kept + 1, none), out=now[1:, 1:])
            for e in range(1, most + 1):
                added = now[e - 1, :-1]
                np.maximum(now[e, 1:], np.where(added > 0, added, none), out=now[e, 1:])
        prev2, prev = prev, now
    return best


def running(a: list[str], b: list[str]) -> int:
    """Length of the longest run of RUNNING words or more that both hold, 0 without one."""
    if len(a) < RUNNING or len(b) < RUNNING:
        return 0
    at: dict[tuple, list[int]] = {}
    for i in range(len(a) - RUNNING + 1):
        at.setdefault(tuple(a[i : i + RUNNING]), []).append(i)
    best, before = 0, {}
    for j in range(len(b) - RUNNING + 1):
        now = {i: before.get(i - 1, RUNNING - 1) + 1 for i in at.get(tuple(b[j : j + RUNNING]), ())}
        best, before = max([best, *now.values()]), now
    return best


def matches(a: list[str], b: list[str]) -> tuple[int, int] | None:
    """What counts as a reproduction of item words a in document words b, as (words, edits): all of a shorter item; else a run without change, a stretch, or all of it with changes at its ends."""
    if len(a) < RUNNING:
        return align(a, b, True)
    if n := running(a, b):
        return n, 0
    # beyond that length the whole contains a stretch
    return align(a, b, False) or (align(a, b, True) if len(a) < ENOUGH else None)


def _search(index: Index, docs: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, int, int]]:
    """Verified pairs (position of the document, item, words, edits)."""
    codes = [_codes(w) for _, w in docs]
    sizes = np.array([c.size for c in codes])
    if sizes.sum() and index.hash.size:
        stream = np.concatenate(codes)
        h = grams(stream)
        begin = np.cumsum(sizes) - sizes
        at = np.flatnonzero(index.filter[(h >> np.uint64(44)).astype(np.int64)])
        doc = np.searchsorted(begin + sizes, at, side="right")
        inside = at + Q <= (begin + sizes)[doc]
        at, doc = at[inside], doc[inside]
        lo = np.searchsorted(index.hash, h[at], side="left")
        hi = np.searchsorted(index.hash, h[at], side="right")
        n = hi - lo
        keep = n > 0
        at, doc, lo, n = at[keep], doc[keep], lo[keep], n[keep]
        # in slices, so that a text full of an item's q-grams needs no more memory than others
        total = np.cumsum(n)
        cuts = [0]
        while cuts[-1] < n.size:
            done = total[cuts[-1] - 1] if cuts[-1] else 0
            k = int(np.searchsorted(total, done + 4_000_000, side="right"))
            # a document is never cut
            k = max(k, cuts[-1] + 1)
            if k < n.size:
                k = int(np.searchsorted(doc, doc[k - 1], side="right"))
            cuts.append(k)
        for x, y in zip(cuts, cuts[1:]):
            yield from _bands(index, docs, at[x:y] - begin[doc[x:y]], doc[x:y], lo[x:y], n[x:y])
    for d, (_, w) in enumerate(docs):
        for k in index.bare:
            if (got := matches(index.words[k], w)) is not None:
                yield d, k, *got


def _bands(index: Index, docs: list, at: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    if not n.size:
        return
    rep = np.repeat(np.arange(n.size), n)
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, ipos = index.owner[entry], index.at[entry]
    d, dpos = doc[rep], at[rep]
    half = BAND // 2
    band = (dpos - ipos) // half
    low = band.min() - 1
    span = int(band.max() - low + 2)
    key = (d.astype(np.int64) * len(index.ids) + item) * span + (band - low)
    # one count per q-gram position of the item and half band
    u, first, count = np.unique(key, return_index=True, return_counts=True)
    nxt = np.searchsorted(u, u + 1)
    paired = count + np.where((nxt < u.size) & (u[np.minimum(nxt, u.size - 1)] == u + 1), count[np.minimum(nxt, u.size - 1)], 0)
    prv = np.searchsorted(u, u - 1)
    lone = (prv >= u.size) | (u[np.minimum(prv, u.size - 1)] != u - 1)
    owner = item[first]
    good = (paired >= index.bounds[owner]) | (lone & (count >= index.bounds[owner]))
    if not good.any():
        return
    order = np.argsort(key, kind="stable")
    starts = np.cumsum(count) - count
    spans: dict[int, np.ndarray] = {}
    chosen = np.flatnonzero(good)
    # neighbouring bands of a document and item make one region
    breaks = np.flatnonzero(np.append(True, u[chosen[1:]] > u[chosen[:-1]] + 2))
    done: set[tuple[int, int]] = set()
    for x, y in zip(breaks, np.append(breaks[1:], chosen.size)):
        g, last = chosen[x], chosen[y - 1]
        k, dd = int(owner[g]), int(d[first[g]])
        if (dd, k) in done or index.bounds[k] < 1:
            continue
        end = last + 1 if nxt[last] < u.size and u[nxt[last]] == u[last] + 1 else last
        rows = order[starts[g] : starts[end] + count[end]]
        # any qualifying stretch has INTACT words in a row without change, whose q-grams lie on one diagonal
        if np.unique(dpos[rows] - ipos[rows], return_counts=True)[1].max() < index.intact[k]:
            continue
        begin, stop, least = index.stretches[k]
        shared = np.zeros(index.sizes[k] + 1, int)
        shared[ipos[rows] + 1] = 1
        shared = shared.cumsum()
        if (shared[stop] - shared[begin] < least).all():
            continue
        words = docs[dd][1]
        for who, ws in ((dd, words), (~k, index.words[k])):
            if who not in spans:
                spans[who] = np.cumsum([min(len(w), LONG) for w in ws])
        b0 = max(int(np.searchsorted(spans[dd], dpos[rows].min(), side="right")) - AROUND, 0)
        b1 = int(np.searchsorted(spans[dd], dpos[rows].max() + Q, side="left")) + 1 + AROUND
        a = index.words[k]
        short = len(a) < ENOUGH
        a0 = 0 if short else max(int(np.searchsorted(spans[~k], ipos[rows].min(), side="right")) - AROUND, 0)
        a1 = len(a) if short else int(np.searchsorted(spans[~k], ipos[rows].max() + Q, side="left")) + 1 + AROUND
        if (got := matches(a[a0:a1], words[b0:b1])) is not None:
            done.add((dd, k))
            yield dd, k, *got


_LAST: list = []


def _index(items: list[tuple[int, str]]) -> Index:
    """The index of a block of items, kept by a Python worker for its next task."""
    if not _LAST or _LAST[0] != items:
        _LAST[:] = [items, Index(items)]
    return _LAST[1]


def _find(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent.value)
        docs, chars = [], 0

        def flush() -> pa.RecordBatch:
            got = list(_search(index, docs))
            cols = list(zip(*got)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array([docs[x][0] for x in cols[0]], pa.int64()), pa.array([index.ids[x] for x in cols[1]], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=PAIRS.names)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for i, words in zip(part.column(0).to_pylist(), words_of_many(part.column(1).to_pylist())):
                    for w in windows(words):
                        docs.append((i, w))
                        chars += sum(map(len, w))
                if chars >= STEP_CHARS:
                    yield flush()
                    docs, chars = [], 0
        if docs:
            yield flush()

    return run


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most so many characters (one text longer than that is a block of its own); only one is held at a time."""
    block, size = [], 0
    for r in items.where(F.col("text").isNotNull() & F.col("eval_id").isNotNull()).select(F.col("eval_id").cast("long").alias("eval_id"), "text").toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["eval_id"], r["text"]))
        size += len(r["text"])
    yield block


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, eval_id, words, edits) per document and item of which it reproduces a stretch.

    documents: doc_id, text. items: eval_id, text; the stated, held-out query set. It
    is sent to the tasks in blocks of at most block_chars characters, one after the
    other, with one pass over the documents for each; the pairs of each are written to the
    shared folder. NULL and empty texts on either side match nothing; very long texts are
    searched whole; repeated rows give the pair once; empty tables give no rows.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = fresh_dir(spark, "leaks")
    for block in _blocks(items, block_chars):
        sent = spark.sparkContext.broadcast(block)
        rows.mapInArrow(_find(sent), PAIRS).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(PAIRS).parquet(path).groupBy("doc_id", "eval_id").agg(F.max("words").alias("words"), F.min("edits").alias("edits"))
    return settle(found, [path])
