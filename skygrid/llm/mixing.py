"""A mix of sources at target token shares, by soft-membership mixing.

1. Every text is tokenised by a public tokenizer; its words are hashed to features.
2. A multinomial naive Bayes classifier is counted over nine tenths of the labelled
   rows; the temperature of its posteriors is the one most likely on the other tenth.
   It gives every document a posterior over the sources (its soft membership).
3. A document's rate follows from its source and its posterior alone, so documents are
   added up in cells: source and posterior in steps of 1 / LEVELS, with their tokens and
   mean posterior. The number of cells follows from the number of sources, not from that of documents.
4. Projected-gradient least squares over the cells fits nonnegative document rates, at
   most the source's max_repeats, whose expected token totals by soft membership match the
   targets (soft_only=True stops here). For the mix itself the totals by delivered source are rows of
   the same fit, with more weight, and a last shift per source makes those exact.
5. Rates become whole uses by error diffusion of tokens within hashed buckets, the
   longest texts first: neighbours are of like length, so no length is favoured, and
   what is owed at the end is less than half of a bucket's shortest texts.

The total is the largest that the caps allow (times fill). Sources without any
token take no part and the others' shares are renormalised; their actual share is 0.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygrid.llm.words import fold
from skygrid.session import materialise, settle

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer (the public byte-level BPE of 50,256 ranks) cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FEATURES = 1 << 14
STEPS = 500
SOFT_WEIGHT = 0.25
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)
#: Steps of a posterior that tell cells apart at most, and cells at most: more sources have fewer steps.
LEVELS, CELLS = 8, 200_000
#: Documents of a source that one rounding bucket holds on average.
BUCKET = 50_000
_END = "\x03"
_WORD = re.compile("[\\w\u0900-\u0dff]+|\x03")
_LOADED: dict[str, object] = {}

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("words", T.BinaryType())])
SOFT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("p", T.ArrayType(T.FloatType()))])


def ship(spark, path: str) -> str:
    """Send the tokenizer's file to every executor; the name under which tasks find it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def tokenizer(path: str):
    """The tokenizer of a file of ranks, loaded once per process; special-token strings are ordinary text."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


class _Features(dict):
    """Words to hashed features, kept by a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
            self[_END] = -1
        self[word] = code = zlib.crc32(word.encode()) % FEATURES
        return code


_FEATURE = _Features({_END: -1})


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each text, each once, one text after the other; and how many each has.

    ASCII texts and others are swept apart, since folding the latter costs more than all else.
    """
    plain = np.array([t.isascii() for t in texts], bool)
    keys = []
    for kind in (True, False):
        at = np.flatnonzero(plain == kind)
        if at.size:
            words = _WORD.findall(fold(f"\n{_END}\n".join(texts[i].replace(_END, " ") for i in at)))
            code = np.fromiter(map(_FEATURE.__getitem__, words), np.int64, len(words))
            keys.append((at[np.cumsum(code < 0)] << 16 | code)[code >= 0])
    u = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return (u & 0xFFFF).astype("<u2"), np.bincount(u >> 16, minlength=len(texts))


def _slices(raw: np.ndarray, n: np.ndarray) -> pa.Array:
    ends = np.cumsum(n)
    return pa.Array.from_buffers(pa.large_binary(), n.size, [None, pa.py_buffer((np.append(0, ends) * raw.dtype.itemsize).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _prepare(name: str, sources: list[str]):
    index = {s: i for i, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        t = tokenizer(SparkFiles.get(name))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [x or "" for x in part.column(3).to_pylist()]
                n = [len(t.encode_ordinary(x)) for x in texts]
                s = [index.get(x, len(sources)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.int32()), part.column(2), pa.array(n, pa.int64()), _slices(*features(texts))], names=DOCS.names)

    return run


def _words(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a batch's documents, concatenated, and the document of each."""
    raw = b.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").astype(np.int64), np.repeat(np.arange(len(raw)), [len(x) // 2 for x in raw])


def _count(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(classes * FEATURES, np.int64), np.zeros(classes, np.int64)
        for b in batches:
            s = b.column(0).to_numpy(zero_copy_only=False)
            w, doc = _words(b, 1)
            n += np.bincount(s[doc].astype(np.int64) * FEATURES + w, minlength=n.size)
            docs += np.bincount(s, minlength=classes)
        at, d = np.flatnonzero(n), np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at // FEATURES, d).astype(np.int32)), pa.array(np.append(at % FEATURES, np.full(d.size, -1)).astype(np.int32)), pa.array(np.append(n[at], docs[d]))], names=["s", "f", "n"])

    return run


class Classifier:
    """Naive Bayes over hashed words; scores are unnormalised log posteriors before temperature."""

    def __init__(self, counts: list[tuple[int, int, int]], classes: int):
        n, docs = np.zeros((classes, FEATURES)), np.zeros(classes)
        for s, f, c in counts:
            if f < 0:
                docs[s] = c
            else:
                n[s, f] = c
        self.prior = np.log((docs + 1e-9) / max(docs.sum(), 1))
        seen = (n + 0.5) / (docs[:, None] + 1.0)
        overall = (n.sum(axis=0) + 0.5) / (docs.sum() + 1.0)
        weight = np.log(seen / overall)
        weight[docs == 0] = 0.0
        self.weight = np.ascontiguousarray(weight.T.astype(np.float32))

    def scores(self, w: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Documents x classes: the sums of their words' weights, a batch at a time."""
        out = np.zeros((docs, self.prior.size))
        if w.size:
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out[doc[first]] = np.add.reduceat(self.weight[w], first, axis=0)
        return out

    def posteriors(self, scores: np.ndarray, temperature: float) -> np.ndarray:
        z = self.prior + temperature * scores
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _judge(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        gain, right, n = np.zeros(len(TEMPERATURES)), np.zeros(len(TEMPERATURES), np.int64), 0
        for b in batches:
            s = b.column(0).to_numpy(zero_copy_only=False)
            scores = c.scores(*_words(b, 1), b.num_rows)
            n += b.num_rows
            for j, t in enumerate(TEMPERATURES):
                p = c.posteriors(scores, t)
                gain[j] += np.log(p[np.arange(s.size), s] + 1e-12).sum()
                right[j] += int((p.argmax(axis=1) == s).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(TEMPERATURES)), pa.int32()), pa.array(gain), pa.array(right), pa.array([n] * len(TEMPERATURES), pa.int64())], names=["t", "gain", "hits", "n"])

    return run


def levels_of(classes: int) -> int:
    """Steps of a posterior, so that there are no more than CELLS cells: as many ways as to deal the steps out to the classes, for each source."""
    return max(n for n in range(1, LEVELS + 1) if n == 1 or classes * math.comb(n + classes - 1, n) <= CELLS)


def cells_of(p: np.ndarray, levels: int) -> np.ndarray:
    """Number of the cell of each posterior: its steps as digits (hashed where there are too many classes for that)."""
    # by rounding the running sums the steps of a posterior always add up to levels
    step = np.diff(np.rint(np.cumsum(p, axis=1) * levels), axis=1, prepend=0).astype(np.uint64)
    out = np.zeros(len(p), np.uint64)
    for c in range(p.shape[1]):
        out = out * np.uint64(levels + 1 if (levels + 1) ** p.shape[1] < 2**63 else 0x9E3779B97F4A7C15) + step[:, c]
    return out.astype(np.int64)


def _predict(sent, temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        levels = levels_of(c.prior.size)
        for b in batches:
            p = c.posteriors(c.scores(*_words(b, 4), b.num_rows), temperature)
            flat = pa.array(p.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * p.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(cells_of(p, levels)), lists], names=SOFT.names)

    return run


def fit(s: np.ndarray, tokens: np.ndarray, p: np.ndarray, share: np.ndarray, cap: np.ndarray, total: float, soft_only: bool, steps: int = STEPS) -> tuple[np.ndarray, list[float]]:
    """Rates of the cells and the objective of each step. s, tokens, p: source, tokens and mean posterior of each cell; share, cap: of each source."""
    k = share.size
    live, most = share[s] > 0, np.where(share > 0, cap, 0.0)[s]
    have = np.maximum(np.bincount(s, weights=tokens, minlength=k), 1.0)
    rows, want = [p[:, :k]], [share]
    if not soft_only:
        own = np.zeros((s.size, k))
        own[np.arange(s.size), s] = 1.0
        rows, want = [math.sqrt(SOFT_WEIGHT) * p[:, :k], own], [math.sqrt(SOFT_WEIGHT) * share, share]
    a, b = np.concatenate(rows, axis=1), np.concatenate(want)
    weight = tokens / max(total, 1.0)
    pull = 1.0 / max(np.linalg.eigvalsh((a * weight[:, None]).T @ a).max(), 1e-12)
    r = np.clip(np.where(live, (share * total / have)[s], 0.0), 0.0, most)
    history = []
    for _ in range(steps if live.any() else 0):
        gap = a.T @ (r * weight) - b
        history.append(float(gap @ gap))
        r = np.clip(r - pull * (a @ gap), 0.0, most)
    if soft_only:
        return r, history
    for c in np.flatnonzero(share > 0):
        at = s == c
        low, high = -cap[c], cap[c]
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if (np.clip(r[at] + mid, 0.0, cap[c]) * tokens[at]).sum() < share[c] * total else (low, mid)
        r[at] = np.clip(r[at] + high, 0.0, cap[c])
    return r, history


def diffuse(rate: np.ndarray, tokens: np.ndarray, carry: float) -> tuple[np.ndarray, float]:
    """Whole uses whose token total follows that of the rates; carry is the tokens owed so far."""
    whole = np.floor(rate + 1e-9)
    owed = (rate - whole) * tokens
    uses = whole.astype(np.int64)
    part = np.flatnonzero(rate - whole > 1e-9)
    for i in part.tolist():
        carry += owed[i]
        if carry >= tokens[i] / 2 and tokens[i] > 0:
            uses[i] += 1
            carry -= tokens[i]
    return uses, carry


USES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("rate", T.DoubleType()), T.StructField("uses", T.LongType()), T.StructField("p", T.ArrayType(T.FloatType()))])


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, carry = None, 0.0
    for b in batches:
        s, bucket = b.column(2).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
        rate, tok = b.column(4).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False).astype(float)
        uses = np.zeros(s.size, np.int64)
        edge = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (bucket[1:] != bucket[:-1])))
        for x, y in zip(edge, np.append(edge[1:], s.size)):
            if (s[x], bucket[x]) != last:
                last, carry = (s[x], bucket[x]), 0.0
            uses[x:y], carry = diffuse(rate[x:y], tok[x:y], carry)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(uses), b.column(7)], names=USES.names)


def mix(documents: DataFrame, targets: DataFrame, tokenizer_path: str = TOKENIZER, fill: float = 1.0, steps: int = STEPS, soft_only: bool = False) -> tuple[DataFrame, dict]:
    """Uses per document (doc_id, source, tokens, rate, uses, p; every row of documents once) and what was learnt on the way.

    documents: doc_id, source, text. targets: source, target_share, max_repeats, one
    row per source (a stated small table). p is the posterior over the sources in order of
    name, and over all others. A NULL text has no tokens; NULL and unnamed
    sources are not used; a NULL share or cap counts as 0. Empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch: list[str] = []
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").collect()}
    sources = sorted(wanted)
    k = len(sources)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(10)).cast("int").alias("fold"), F.col("text").cast("string").alias("text"))
    docs = materialise(rows.mapInArrow(_prepare(ship(spark, tokenizer_path), sources), DOCS), "mix-docs", scratch)
    # at most classes x FEATURES counts
    counts = docs.where("fold > 0").select("s", "words").mapInArrow(_count(k + 1), "s int, f int, n long").groupBy("s", "f").agg(F.sum("n").alias("n")).collect()
    sent = spark.sparkContext.broadcast(Classifier([tuple(r) for r in counts], k + 1))
    judged = docs.where("fold = 0").select("s", "words").mapInArrow(_judge(sent), "t int, gain double, hits long, n long").groupBy("t").agg(F.sum("gain").alias("gain"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    best = max(judged, key=lambda r: (r["gain"], r["t"]), default=None)
    temperature = TEMPERATURES[best["t"]] if best else TEMPERATURES[0]
    soft = materialise(docs.select("doc_id", "source", "s", "tokens", "words").mapInArrow(_predict(sent, temperature), SOFT), "mix-soft", scratch)

    # at most CELLS rows
    part = [F.sum(F.col("tokens") * F.element_at("p", c + 1)).alias(f"p{c}") for c in range(k)]
    cells = soft.where(F.col("s") < k).groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), *part).collect()
    s = np.array([r["s"] for r in cells], int)
    tokens = np.array([float(r["tokens"]) for r in cells])
    p = np.array([[r[f"p{c}"] for c in range(k)] for r in cells], float).reshape(-1, k) / np.maximum(tokens, 1.0)[:, None]
    have = np.bincount(s, weights=tokens, minlength=k)
    share = np.array([wanted[x][0] for x in sources])
    cap = np.array([float(wanted[x][1]) for x in sources])
    share = np.where((have > 0) & (cap > 0), share, 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    live = share > 0
    total = fill * float((cap[live] * have[live] / share[live]).min()) if live.any() else 0.0
    rate, history = fit(s, tokens, p, share, cap, total, soft_only, steps) if cells else (np.zeros(0), [])

    table = spark.createDataFrame([(r["s"], r["cell"], float(x)) for r, x in zip(cells, rate)], "s int, cell long, rate double")
    docs_of = np.bincount(s, weights=[r["n"] for r in cells], minlength=k) if cells else np.zeros(k)
    buckets = [max(1, -(-int(n) // BUCKET)) for n in docs_of]
    per = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in [*buckets, 1]]), F.col("s") + 1), F.lit(1))
    named = soft.where(F.col("s") < k).join(F.broadcast(table), ["s", "cell"]).select("doc_id", "source", "s", "tokens", "rate", F.pmod(F.xxhash64("doc_id"), per.cast("long")).cast("int").alias("bucket"), F.xxhash64("doc_id", F.lit(1)).alias("o"), "p")
    uses = named.repartition("s", "bucket").sortWithinPartitions("s", "bucket", F.desc("tokens"), "o", "doc_id").mapInArrow(_round, USES)
    rest = soft.where(F.col("s") >= k).select("doc_id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("uses"), "p")
    about = {"tokenizer": os.path.basename(tokenizer_path), "sources": sources, "total": total, "objective": history, "temperature": temperature, "accuracy": best["hits"] / max(best["n"], 1) if best else None, "cells": len(cells)}
    return settle(uses.unionByName(rest), scratch), about


def expected(uses: DataFrame, targets: DataFrame, about: dict) -> DataFrame:
    """Wanted, expected (by soft membership) and actual (by delivered source) share of each source of targets."""
    k = len(about["sources"])
    got = uses.agg(F.sum(F.col("tokens") * F.col("uses")).alias("all_tokens"), F.array(*[F.sum(F.col("tokens") * F.col("uses") * F.element_at("p", c + 1)) for c in range(k)]).alias("e"))
    # one row
    e = got.select(F.posexplode("e").alias("c", "v"), "all_tokens").select(F.element_at(F.array(*[F.lit(x) for x in about["sources"]]), F.col("c") + 1).alias("source"), F.coalesce(F.col("v") / F.greatest("all_tokens", F.lit(1)), F.lit(0.0)).alias("expected_share"))
    return shares(uses, targets, about["tokenizer"]).join(F.broadcast(e), "source", "left").select("source", "target_share", "expected_share", "actual_share", "tokens_used", "documents", "max_repeats", "most_uses", "tokenizer")


def shares(uses: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """Wanted and actual share of each source of targets, by tokens used."""
    used = uses.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    got = targets.select("source", "target_share", "max_repeats").join(used, "source", "left")
    total = used.agg(F.sum("tokens_used").alias("all_tokens"))
    return got.join(F.broadcast(total), F.lit(True), "left").select(
        "source",
        "target_share",
        (F.coalesce("tokens_used", F.lit(0)) / F.greatest("all_tokens", F.lit(1))).alias("actual_share"),
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        "max_repeats",
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.lit(name).alias("tokenizer"),
    )
