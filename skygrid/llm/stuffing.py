"""Reviews that are keyword stuffing, link lists or tag lists instead of sentences.

No word list is given; what prose of a language looks like is learnt from all
documents, in passes whose results are a few numbers per language and word:

1. Texts become words (a link is one word), with marks for links and tags, list
   separators and sentence ends. Documents of very high link-text, n-gram, top-word or
   duplicate-line share or of short list items throughout are set apart as suspects.
2. Per language, words are counted in the other documents and in the suspects: first by label,
   many of which are wrong, then again by what that says of each document. Frequent
   words that are much rarer in suspects are the language's statement words (its
   function words, and verbs such as stuffing never has); frequent words
   of either are its vocabulary. A document's language is the one whose vocabulary covers
   most of it; its own label, often missing or wrong, decides nothing. What no
   vocabulary covers is of an unlisted language.
3. Thresholds per language come from the histograms of all its documents that are no
   suspects: of statement words a part of the median; of top-word share, n-gram share,
   duplicate-line share, link share and separator density a high percentile.
4. A word is stuffed if it is a link, tag or link text, if statement words are missing
   around it and most words there are of some language's vocabulary (rare words in a row are no
   keywords), or if statement words are scarce around it and the document passes one of
   the five other thresholds. In an unlisted language missing words say nothing: there only links,
   repeated n-grams and list items count, and one of the five thresholds must be passed.

A document is found if at least SHARE of its words are stuffed. Texts of fewer than
SHORT words (very short ones are no cases) are found only for links and tags.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygrid.llm.words import LINK, TAGS, fold, unescape
from skygrid.session import materialise, settle

SHARE = 2 / 3
SHORT = 12
WINDOW = 9
#: Parts of a language's median of statement words below which they are missing, or scarce.
MISSING, SCARCE = 0.4, 0.45
#: Percentile of a language's documents above which another measure is passed, and what it must be at least.
HIGH, LEAST = 0.99, {"top_word_share": 0.12, "ngram_share": 0.3, "duplicate_line_share": 0.3, "link_share": 0.3, "separator_density": 0.25}
#: A statement word occurs in this part of a label's documents, and so many times more often per word than in suspects.
FREQUENT, RATIO = 0.004, 4.0
#: As FREQUENT, when labels are all that is known of languages: many are wrong, so only the commonest words count.
COMMON = 0.03
#: And the word is in so many documents, or comes so often in suspects.
SUPPORT = 8
#: Part of the words of a document, and of those around a word where statement words are missing, that a language's vocabulary (or that of any) must cover.
COVERED, AROUND = 0.5, 0.5
#: Labels of fewer documents are no language of their own.
ENOUGH = 30
#: Suspects: shares of links, words of repeated n-grams, the top word, repeated lines, short list items.
SUSPECT = {"link_share": 0.5, "ngram_share": 0.65, "top_word_share": 0.25, "duplicate_line_share": 0.5, "item_share": 0.7}
#: Items of a list have at most so many words each, and at least so many follow each other.
ITEM_WORDS, ITEMS = 4, 5
#: Words of so many letters do not count as top word: in most languages those are function words.
LITTLE = 3
BINS = 100
STEP_CHARS = 1_000_000
#: Low bits of a word's code that do not tell where to look for it.
SLOT = 12
MEASURES = tuple(LEAST)

TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("suspect", T.BooleanType()), T.StructField("top", T.DoubleType()), T.StructField("duplicate", T.DoubleType()), T.StructField("w", T.BinaryType()), T.StructField("marks", T.BinaryType())])
FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("function_share", T.DoubleType()),
        *[T.StructField(m, T.DoubleType()) for m in MEASURES],
        T.StructField("stuffed_share", T.DoubleType()),
        T.StructField("found", T.BooleanType()),
    ]
)

# marks between words: an anchor's text stands between two _LINK; _END stands between texts
_LINK, _LIST, _END, _STOP = "\x01", "\x02", "\x03", "\x04"
_OURS = re.compile("[\x00-\x08]")
_DOTTED = re.compile(r"\.[A-Za-z]")
_ANCHOR = re.compile(r"<a\b[^<>\x03]*href[^<>\x03]*>([^\x03]*?)</a\s*>", re.I)
_MARKDOWN = re.compile(r"\[([^\[\]\x03]*)\]\(\s*([^()\s]+)\s*\)")
_LISTED = re.compile(r"\s+[/|•·–—-]+\s+|[,;|•·]\s")
_STOPPED = re.compile(r"[.!?।…]+(?:\s|$)|\n")
_TOKEN = re.compile("[\x01-\x04]|[#@]?[\\wऀ-෿$@!|]*[\\wऀ-෿][\\wऀ-෿$@'’]*(?:[-.][\\wऀ-෿$@]+)*")
#: Marks of a word: link, tag or link text; a list separator before it; the first of a sentence; of LITTLE letters or fewer; in a repeated n-gram; in a list of short items.
FORCED, AFTER_LIST, FIRST, BRIEF, REPEATED, LISTED = 1, 2, 4, 8, 16, 32


#: Signs that stand for letters in a disguised word.
_DISGUISES = str.maketrans({"@": "a", "$": "s", "3": "e", "0": "o", "1": "i"})
_DISGUISED = re.compile(r"(?:^|[^\W\d_])[@$301]+[^\W\d_]|[^\W\d_][@$301]+(?:$|[^\W\d_])|[@$].*[@$]")


class _Codes(dict):
    """Words to 32-bit codes, kept by a worker; 2^32 is added for tags, 2^33 for words of few letters."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        plain = word.translate(_DISGUISES) if _DISGUISED.search(word) else word
        code = max(zlib.crc32(plain.encode()), 16) | (word[0] == "#") << 32 | (len(word) <= LITTLE) << 33
        self[word] = code
        return code


_CODES = _Codes()
_CODE = {_LINK: 1, _LIST: 2, _END: 3, _STOP: 4}


def linky(t: str) -> bool:
    """Whether a text may hold links, markup or entities."""
    return "<" in t or "&" in t or "](" in t or "://" in t or "www" in t or "WWW" in t or _DOTTED.search(t) is not None


def _marked(text: str) -> str:
    """Folded text with our marks for links, separators and stops; works on several texts with _END between."""
    t = unescape(text)
    linked = linky(t)
    if "<" in t:
        t = TAGS.sub(" ", _ANCHOR.sub(f" {_LINK}\\1{_LINK} ", t))
    if "](" in t:
        t = _MARKDOWN.sub(f" {_LINK}\\1{_LINK} ", t)
    if linked:
        t = LINK.sub(f" {_LINK}{_LINK} ", t)
    return fold(_STOPPED.sub(f" {_STOP} ", _LISTED.sub(f" {_LIST} ", t)))


@dataclass
class Texts:
    """Words of many texts, concatenated: code and marks of each, and where each text begins and ends."""

    w: np.ndarray
    marks: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.doc = np.repeat(np.arange(self.starts.size), self.ends - self.starts)

    @property
    def n(self) -> np.ndarray:
        return self.ends - self.starts

    def share(self, hit: np.ndarray) -> np.ndarray:
        """Part of each text's words."""
        return np.bincount(self.doc, weights=hit, minlength=self.starts.size) / np.maximum(self.n, 1)


def split(texts: list[str | None]) -> Texts:
    """ASCII texts and others, with and without markup or links, are swept apart, since folding and links cost more than all else."""
    clean = [t or "" for t in texts]
    if _OURS.search("".join(clean)):
        clean = [_OURS.sub(" ", t) for t in clean]
    group = np.array([2 * t.isascii() + linky(t) for t in clean], int)
    parts = []
    for kind in range(4):
        at = np.flatnonzero(group == kind)
        if at.size:
            tokens = _TOKEN.findall(_marked(f"\n{_END}\n".join(clean[i] for i in at)))
            code = np.fromiter(map(_CODES.__getitem__, tokens), np.int64, len(tokens))
            parts.append((at, *_assemble(code, at.size)))
    size = np.zeros(len(texts), int)
    for at, _, _, n in parts:
        size[at] = n
    ends = np.cumsum(size)
    starts = ends - size
    w, marks = np.zeros(int(size.sum()), np.uint32), np.zeros(int(size.sum()), np.uint8)
    for at, own, m, n in parts:
        to = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(own.size)
        w[to], marks[to] = own, m
    return Texts(w, marks, starts, ends)


_CODES.update(_CODE)


def _assemble(code: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words, their marks, and the number of words of each text."""
    doc = np.cumsum(code == _CODE[_END])
    link = code == _CODE[_LINK]
    opens = link & (np.cumsum(link) % 2 == 1)
    inside = np.cumsum(link) % 2 == 1
    keep = np.flatnonzero((code >= 16) | opens)
    count = lambda c: np.cumsum(code == c)[keep]
    listed, stopped, own = count(_CODE[_LIST]), count(_CODE[_STOP]), doc[keep]
    new = np.ones(keep.size, bool)
    new[1:] = own[1:] != own[:-1]
    step = lambda x: np.append(True, x[1:] != x[:-1]) if x.size else np.zeros(0, bool)
    marks = (opens[keep] | inside[keep] | (code[keep] >> 32 & 1 == 1)) * FORCED | (code[keep] >> 33 & 1) * BRIEF | (step(listed) & ~new) * AFTER_LIST | (step(stopped) | new) * FIRST
    return (code[keep] & 0xFFFFFFFF).astype(np.uint32), marks.astype(np.uint8), np.bincount(own, minlength=texts)


def _mix(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(columns[0].size, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def repeated(t: Texts) -> np.ndarray:
    """Words in triples that occur twice or pairs that occur three times in their text."""
    out = np.zeros(t.w.size, bool)
    for size, least in ((3, 2), (2, 3)):
        if t.w.size < size:
            continue
        n = t.w.size - size + 1
        whole = t.doc[:n] == t.doc[size - 1 :]
        _, inverse, count = np.unique(_mix(t.doc[:n], *(t.w[k : k + n] for k in range(size))), return_inverse=True, return_counts=True)
        at = np.flatnonzero(whole & (count[inverse] >= least))
        for k in range(size):
            out[at + k] = True
    return out


def list_items(t: Texts) -> np.ndarray:
    """Words of short items between separators or stops, of which several follow each other after list separators."""
    if not t.w.size:
        return np.zeros(0, bool)
    begin = np.flatnonzero(t.marks & (AFTER_LIST | FIRST) > 0)
    size = np.diff(np.append(begin, t.w.size))
    short = size <= ITEM_WORDS
    # a run of short items ends with a long one or with the text
    edge = np.flatnonzero(np.append(True, (short[1:] != short[:-1]) | (t.doc[begin][1:] != t.doc[begin][:-1])))
    length = np.diff(np.append(edge, begin.size))
    listed = np.add.reduceat(t.marks[begin] & AFTER_LIST > 0, edge)
    fine = short[edge] & (length >= ITEMS) & (listed * 2 >= length)
    return np.repeat(np.repeat(fine, length), size)


def _top(t: Texts, use: np.ndarray) -> np.ndarray:
    """Share of each text's most frequent word among those in use."""
    out = np.zeros(t.starts.size)
    u, count = np.unique(t.doc[use].astype(np.uint64) << np.uint64(32) | t.w[use], return_counts=True)
    np.maximum.at(out, (u >> np.uint64(32)).astype(int), count)
    return out / np.maximum(t.n, 1)


def _duplicate_lines(t: Texts) -> np.ndarray:
    """Share of each text's sentences and lines that repeat an earlier one."""
    begin = np.flatnonzero(t.marks & FIRST > 0)
    if not begin.size:
        return np.zeros(t.starts.size)
    at = np.arange(t.w.size) - np.repeat(begin, np.diff(np.append(begin, t.w.size)))
    line = np.add.reduceat(_mix(t.w, at), begin)
    doc = t.doc[begin]
    lines = np.bincount(doc, minlength=t.starts.size)
    once = np.unique(np.stack([doc.astype(np.uint64), line], 1), axis=0)[:, 0].astype(int)
    return 1 - np.bincount(once, minlength=t.starts.size) / np.maximum(lines, 1) - (lines == 0)


def mark(t: Texts) -> None:
    """Add the marks of repeated n-grams and of lists."""
    t.marks = t.marks | repeated(t) * np.uint8(REPEATED) | list_items(t) * np.uint8(LISTED)


def measures(t: Texts, top: np.ndarray, duplicate: np.ndarray) -> dict[str, np.ndarray]:
    """The five measures besides missing words, of each marked text."""
    part = lambda m: t.share(t.marks & m > 0)
    return {"top_word_share": top, "ngram_share": part(REPEATED), "duplicate_line_share": duplicate, "link_share": part(FORCED), "separator_density": part(AFTER_LIST)}


def suspects(t: Texts, m: dict[str, np.ndarray]) -> np.ndarray:
    m = m | {"item_share": t.share(t.marks & LISTED > 0)}
    out = np.zeros(t.starts.size, bool)
    for name, least in SUSPECT.items():
        out |= m[name] >= least
    return out & (t.n >= SHORT) | (m["link_share"] >= SHARE)


def _slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(starts, ends[-1:] if ends.size else 0).astype(np.int64) * raw.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), ends.size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _by_chars(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        for x, y in _by_chars(texts):
            t = split(texts[x:y])
            mark(t)
            top, duplicate = _top(t, t.marks & BRIEF == 0), _duplicate_lines(t)
            suspect = suspects(t, measures(t, top, duplicate))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(suspect), pa.array(top), pa.array(duplicate), _slices(t.w, t.starts, t.ends), _slices(t.marks, t.starts, t.ends)], names=TOKENS.names)


def _texts(b: pa.RecordBatch) -> Texts:
    w, marks = b.column(b.schema.get_field_index("w")).to_pylist(), b.column(b.schema.get_field_index("marks")).to_pylist()
    ends = np.cumsum([len(m) for m in marks]) if marks else np.zeros(0, int)
    return Texts(np.frombuffer(b"".join(w), "<u4"), np.frombuffer(b"".join(marks), np.uint8), ends - np.diff(ends, prepend=0), ends)


COUNTS = "label string, word long, docs long, clean long, stuffed long"


def _count(sent):
    """Per label (or language, once some are known) and word: documents that are no suspects and hold it, its occurrences in them, and in suspects. Word -1: documents and words at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _counted(b, sent.value if sent else None)

    return run


def _counted(b: pa.RecordBatch, know: Languages | None) -> pa.RecordBatch:
    t = _texts(b)
    labels, label = np.unique(np.array(b.column(1).to_pylist() if know is None else [know.name(k) for k in know.read(t)[0].tolist()], object), return_inverse=True)
    suspect = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
    plain = t.marks & FORCED == 0
    own = label[t.doc[plain]].astype(np.uint64) << np.uint64(32) | t.w[plain]
    u, inverse = np.unique(own, return_inverse=True)
    bad = suspect[t.doc[plain]]
    clean, stuffed = np.bincount(inverse, weights=~bad, minlength=u.size), np.bincount(inverse, weights=bad, minlength=u.size)
    once = np.unique(inverse[~bad] * t.starts.size + t.doc[plain][~bad])
    docs = np.bincount(once // max(t.starts.size, 1), minlength=u.size)
    of, word = (u >> np.uint64(32)).astype(int), (u & np.uint64(0xFFFFFFFF)).astype(np.int64)
    k = np.arange(labels.size)
    total = lambda x, by: np.bincount(by, weights=x, minlength=labels.size)
    cols = [
        np.append(of, k), np.append(word, np.full(k.size, -1)), np.append(docs, total((~suspect & (t.n > 0)).astype(float), label)),
        np.append(clean, total(clean, of)), np.append(stuffed, total(stuffed, of)),
    ]
    return pa.RecordBatch.from_arrays([pa.array(labels[cols[0]].tolist(), pa.string()), *(pa.array(c.astype(np.int64)) for c in cols[1:])], names=["label", "word", "docs", "clean", "stuffed"])


class Languages:
    """What has been learnt of the languages: for every frequent word, whose vocabulary and whose statement word it is; thresholds per language."""

    def __init__(self, names: list[str], words: np.ndarray, known: np.ndarray, statement: np.ndarray):
        self.names, self.words, self.known, self.statement = names, words, known, statement
        self.missing: dict[str, float] = {}
        self.scarce: dict[str, float] = {}
        self.high: dict[str, dict[str, float]] = {"": dict(LEAST)}
        # words by their first bits: the place of the only one, -1 for none, -2 for several
        slot, at, n = np.unique(words >> np.uint32(SLOT), return_index=True, return_counts=True)
        self.slots = np.full(1 << (32 - SLOT), -1, np.int32)
        self.slots[slot] = np.where(n == 1, at, -2)

    def find(self, w: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent ones, -1 if it is none."""
        at = self.slots[w >> np.uint32(SLOT)]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.words, w[several]), self.words.size - 1)
        return np.where((at >= 0) & (self.words[at] == w), at, -1)

    def read(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language of each text (-1: unlisted), which of its words are statement words of that language, and which are known in any; ties go to the first by name."""
        lang = np.full(t.starts.size, -1)
        statement = np.zeros(t.w.size, bool)
        if not self.words.size or not t.w.size:
            return lang, statement, statement.copy()
        at = self.find(t.w)
        plain = t.marks & FORCED == 0
        hit = plain & (at >= 0)
        some = np.flatnonzero(hit)
        cover = np.stack([np.bincount(t.doc[some[own]], minlength=t.starts.size) for own in self.known[at[some]].T], 1)
        best = cover.argmax(axis=1)
        words = np.bincount(t.doc[plain], minlength=t.starts.size)
        listed = cover[np.arange(best.size), best] >= COVERED * np.maximum(words, 1)
        lang[listed] = best[listed]
        own = lang[t.doc]
        return lang, hit & (own >= 0) & self.statement[at, np.maximum(own, 0)], hit

    def name(self, k: int) -> str:
        return self.names[k] if k >= 0 else ""


def learn(tokens: DataFrame, know: Languages | None = None, often: float = COMMON) -> Languages:
    """Statement words and vocabularies of the labels with ENOUGH documents, or, given a first idea of them, of the languages.

    At most 1 / often times the distinct words of a mean document come back per label,
    however many documents there are.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(know) if know else None
    counts = tokens.mapInArrow(_count(sent), COUNTS).groupBy("label", "word").agg(*[F.sum(c).alias(c) for c in ("docs", "clean", "stuffed")])
    whole = counts.where("word = -1 and label <> ''").select("label", F.col("docs").alias("all_docs"), F.col("clean").alias("all_clean"), F.col("stuffed").alias("all_stuffed")).where(F.col("all_docs") >= ENOUGH)
    # one row per label, of two letters at most
    per = counts.where("word >= 0").join(F.broadcast(whole), "label")
    frequent = F.col("docs") >= F.greatest(often * F.col("all_docs"), F.lit(SUPPORT))
    head = per.where(frequent | (F.col("stuffed") >= F.greatest(often / 10 * F.col("all_stuffed"), F.lit(SUPPORT))))
    rows = head.select("label", "word", frequent.alias("often"), (F.col("clean") / F.col("all_clean")).alias("rate"), ((F.col("stuffed") + 0.5) / (F.col("all_stuffed") + 200.0)).alias("bad")).collect()
    names = sorted({r["label"] for r in rows})
    words = np.array(sorted({r["word"] for r in rows}), np.uint32)
    known, statement = np.zeros((words.size, len(names)), bool), np.zeros((words.size, len(names)), bool)
    for r in rows:
        i, k = np.searchsorted(words, r["word"]), names.index(r["label"])
        known[i, k] = True
        statement[i, k] = r["often"] and r["rate"] >= RATIO * r["bad"]
    return Languages(names, words, known, statement)


def _histogram(sent):
    """Per language and measure, documents that are no suspects by value; only texts of SHORT words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Languages = sent.value
        names = ("statement", *MEASURES)
        hist = np.zeros((len(know.names) + 1, len(names), BINS), np.int64)
        for b in batches:
            t = _texts(b)
            lang, statement, _ = know.read(t)
            use = (t.n >= SHORT) & ~b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            m = {"statement": t.share(statement), **measures(t, *_kept(b))}
            for j, name in enumerate(names):
                at = np.clip((m[name][use] * BINS).astype(int), 0, BINS - 1)
                np.add.at(hist, (lang[use], j, at), 1)
        k, j, at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(hist[k, j, at])], names=["k", "j", "bin", "n"])

    return run


def calibrate(tokens: DataFrame, know: Languages) -> None:
    """Thresholds of each language from the histograms of all its documents; those of unlisted ones from all together."""
    sent = tokens.sparkSession.sparkContext.broadcast(know)
    # languages x measures x BINS counts at most
    rows = tokens.mapInArrow(_histogram(sent), "k int, j int, bin int, n long").groupBy("k", "j", "bin").agg(F.sum("n").alias("n")).collect()
    hist = np.zeros((len(know.names) + 1, len(MEASURES) + 1, BINS))
    for r in rows:
        hist[r["k"], r["j"], r["bin"]] += r["n"]
    point = lambda h, q: float(np.searchsorted(np.cumsum(h), q * h.sum())) / BINS if h.sum() else 0.0
    for k, name in enumerate(know.names):
        median = point(hist[k, 0], 0.5)
        know.missing[name], know.scarce[name] = MISSING * median, SCARCE * median
    for name, h in [*zip(know.names, hist), ("", hist.sum(axis=0))]:
        know.high[name] = {m: max(LEAST[m], point(h[j], HIGH) + 1 / BINS) for j, m in enumerate(MEASURES, 1)}


def density(marked: np.ndarray, t: Texts, window: int = WINDOW) -> np.ndarray:
    """Share of marked words in the window around each word, moved inwards at the ends of its text."""
    total = np.concatenate([[0], np.cumsum(marked)])
    at, start, end = np.arange(t.w.size), t.starts[t.doc], t.ends[t.doc]
    low = np.maximum(np.minimum(at - window // 2, end - window), start)
    high = np.minimum(low + window, end)
    return (total[high] - total[low]) / np.maximum(high - low, 1)


def _kept(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("top", "duplicate")]


def judge(t: Texts, know: Languages, top: np.ndarray, duplicate: np.ndarray) -> dict[str, np.ndarray]:
    """Features and verdict of each marked text."""
    lang, statement, known = know.read(t)
    m = measures(t, top, duplicate)
    names = [know.name(k) for k in lang.tolist()]
    passed = np.zeros(t.starts.size, bool)
    for x in MEASURES:
        passed |= m[x] > np.array([know.high[name][x] for name in names])
    listed = lang >= 0
    missing, scarce = (np.array([table.get(name, -1.0) for name in names]) for table in (know.missing, know.scarce))
    said = density(statement, t)
    quiet = np.where(passed[t.doc], said < scarce[t.doc], (said < missing[t.doc]) & (density(known, t) >= AROUND))
    forced = t.marks & FORCED > 0
    marked = np.where(listed[t.doc], forced | quiet, (t.marks & (FORCED | REPEATED | LISTED) > 0) & passed[t.doc])
    share = t.share(marked)
    links = m["link_share"] >= SHARE
    return {"language": np.array(names, object), "words": t.n, "function_share": t.share(statement), **m, "stuffed_share": share, "found": (share >= SHARE) & ((t.n >= SHORT) | links) & (t.n > 0)}


def _judge(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Languages = sent.value
        for b in batches:
            got = judge(_texts(b), know, *_kept(b))
            kinds = {"language": pa.string(), "words": pa.int32(), "found": pa.bool_()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[c].tolist() if c == "language" else got[c].astype(bool if c == "found" else float if c != "words" else np.int32), kinds.get(c, pa.float64())) for c in FEATURES.names[1:])], names=FEATURES.names)

    return run


def stuffed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Features, stuffed_share and verdict (found) of every document, one row per input row.

    The texts are split once; everything learnt comes from all of them. Labels (lang, if
    documents has that column) only serve to learn languages from, most of them being
    right. NULL and empty texts have no words and are never found; very long texts are
    processed whole; an empty table gives no rows; repeated rows are repeated. Other
    columns are not looked at.
    """
    spark = documents.sparkSession
    scratch: list[str] = []
    label = F.regexp_extract(F.lower(F.trim(F.col(lang))), "^[a-z]{2}", 0) if lang in documents.columns else F.lit("")
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(label, F.lit("")).alias("label"), F.col(text).cast("string").alias("text"))
    tokens = materialise(rows.mapInArrow(_tokenise, TOKENS), "stuffing", scratch)
    know = learn(tokens, learn(tokens), FREQUENT)
    calibrate(tokens, know)
    return settle(tokens.mapInArrow(_judge(spark.sparkContext.broadcast(know)), FEATURES), scratch)
