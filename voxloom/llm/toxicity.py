"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given per document, so token labels are derived first: words and
word beginnings whose document frequency in toxic documents exceeds that in
clean ones beyond chance (likelihood ratio) mark a token of a toxic document as
toxic. A two-state chain (outside, toxic) over features of each token's form is
then fitted to these labels by its exact log-likelihood. Forward-backward
marginals give each token's probability; a logistic layer, fitted to the
document labels, turns their sum, their maximum and the number of likely tokens
into a score, and runs of likely tokens into offsets.

Fitting reads a bounded sample of labelled documents, chosen by a hash of the
id: at most ``max_docs``, of any length. Spark counts the words in which toxic
and clean documents differ, cuts windows of tokens from anywhere in the texts (around
marked tokens in toxic documents) and makes the inputs of the document layer; the
chain is fitted by one task that reads at most ``max_windows`` windows of either
kind. Only words, weights and a few numbers for each sampled document reach the
driver. Scoring reads every text whole. Only the text is an input of a score.

Defined results: null and empty texts get the score of a document without
tokens. Without labels of both kinds, every score is the share of toxic labels
(0 where there are none), and no span is found. Null labels and labels of
missing documents or null texts are passed over; of several labels of an id the
largest counts, of several texts of an id the last in order of text. Rows are
independent otherwise, so repeated rows have equal scores.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import checkpointed, crc32_of_id, slices, small_batches

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
_TOKEN = re.compile(r"\S+")
#: Lengths of word beginnings that can mark a token, and of ends that describe it.
PREFIXES, SUFFIXES = (4, 5, 6, 7), (3, 4)


def bare_word(token: str) -> str:
    return token.lower().strip(_EDGE)


def form_features(token: str) -> list[str]:
    """Features of one token: its word, beginnings, ends and shape."""
    word = token.lower().strip(_EDGE)
    size = len(word)
    names = ["w=" + word]
    for n in PREFIXES:
        if size > n:
            names.append("p=" + word[:n])
    for n in SUFFIXES:
        if size > n:
            names.append("s=" + word[-n:])
    names.append(("X" if token.isupper() else "x") + str(min(size, 12)))
    return names


@dataclass
class ToxicModel:
    """Weights of the chain and of the document layer; a few thousand numbers, sent to the workers with the function."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    layer: tuple[float, ...] = ()
    prior: float = 0.0

    def emission(self, token: str) -> float:
        weight = self.weights.get
        return self.bias + sum([weight(f, 0.0) for f in form_features(token)])


class _Emissions(dict):
    """Emission of each token seen by a worker, up to a fixed number."""

    LIMIT = 200_000

    def __init__(self, model: ToxicModel):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[token] = self.model.emission(token)
        return value


class Lanes:
    """Sequences side by side, longest first, stored by time step: one step is one slice over the sequences still running."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.steps = int(ordered[0]) if len(ordered) else 0
        running = len(ordered) - np.searchsorted(ordered[::-1], np.arange(self.steps), side="right")
        self.starts = np.concatenate([[0], np.cumsum(running)]).astype(np.int64)
        self.lengths = ordered

    def place(self, rank: int) -> np.ndarray:
        """Where the values of the sequence of that rank are."""
        return self.starts[: self.lengths[rank]] + rank


def odds_forward_backward(emission: np.ndarray, moves: tuple[float, ...], lanes: Lanes) -> tuple[np.ndarray, np.ndarray]:
    """Odds of state 1 against 0 from the left (own emission included) and from the right (excluded), per token."""
    t00, t01, t10, t11 = (math.exp(m) for m in moves)
    psi = np.exp(np.clip(emission, -30, 30))
    left, right = np.empty_like(psi), np.ones_like(psi)
    s = lanes.starts.tolist()
    for t in range(lanes.steps):
        a, b = s[t], s[t + 1]
        if t == 0:
            left[a:b] = psi[a:b]
        else:
            r = left[s[t - 1] : s[t - 1] + b - a]
            left[a:b] = psi[a:b] * (t01 + r * t11) / (t00 + r * t10)
    for t in range(lanes.steps - 2, -1, -1):
        n = s[t + 2] - s[t + 1]
        q = psi[s[t + 1] : s[t + 2]] * right[s[t + 1] : s[t + 2]]
        right[s[t] : s[t] + n] = (t10 + q * t11) / (t00 + q * t01)
    return left, right


def marginals(emissions: list[np.ndarray], moves: tuple[float, ...]) -> list[np.ndarray]:
    """Probability of state 1 of every token of every sequence."""
    lanes = Lanes(np.array([len(e) for e in emissions], dtype=np.int64))
    flat = np.empty(int(lanes.starts[-1]) if lanes.steps else 0)
    places = [lanes.place(rank) for rank in range(len(emissions))]
    for rank, i in enumerate(lanes.order):
        flat[places[rank]] = emissions[i]
    left, right = odds_forward_backward(flat, moves, lanes)
    odds = left * right
    p = odds / (1 + odds)
    out: list[np.ndarray] = [np.empty(0)] * len(emissions)
    for rank, i in enumerate(lanes.order):
        out[i] = p[places[rank]]
    return out


def summary(p: np.ndarray) -> tuple[float, float, float, float]:
    """What the document layer sees of a document's marginals."""
    if not len(p):
        return 1.0, 0.0, 0.0, 0.0
    return 1.0, math.log1p(float(p.sum())), float(p.max()), math.log1p(float((p > 0.5).sum()))


def _names(text: str) -> set[str]:
    """Words and word beginnings of a text, by which telling ones are counted."""
    words = {bare_word(t) for t in set(text.split())} - {""}
    return {f"w={w}" for w in words} | {f"p={w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def telling_words(sample: DataFrame, clean: int, toxic: int, *, least: float = 30.0, ratio: float = 5.0) -> list[str]:
    """Words and word beginnings that toxic documents of sample (y, t) hold beyond chance; a few hundred."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for t, y in zip(part.column("t").to_pylist(), part.column("y").to_pylist(), strict=True):
                    seen[y].update(_names(t))
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[y][n] for n in names], pa.int64()) for y in (1, 0))], ["name", "a", "b"])

    sums = small_batches(sample.select("y", "t")).mapInArrow(count, "name string, a long, b long").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, share, base = F.col("a"), F.col("b"), F.col("a") / (F.col("a") + F.col("b")), toxic / (clean + toxic)
    g = 2 * (a * F.log(share / base) + F.when(b > 0, b * F.log((1 - share) / (1 - base))).otherwise(0.0))
    beyond = (a >= 5) & (share > max(base, 0.8)) & (g > least) & ((a + 0.5) * (clean + 1) > ratio * (b + 0.5) * (toxic + 1))
    return [r["name"] for r in sums.where(beyond).select("name").collect()]


def _marked(token: str, telling: frozenset[str]) -> bool:
    word = bare_word(token)
    return bool(word) and (f"w={word}" in telling or any(f"p={word[:n]}" in telling for n in PREFIXES if len(word) > n))


def cut_windows(sample: DataFrame, telling: list[str], *, context: int = 40) -> DataFrame:
    """(y, h, tokens, marks): every marked token of toxic documents with its surroundings, and all of the clean ones in pieces as long.

    h is a hash by which windows are drawn, whatever their place in the text.
    """
    known_names = frozenset(telling)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                out: list[tuple[int, int, str, bytes]] = []
                for k, t, y in zip(*(part.column(c).to_pylist() for c in ("k", "t", "y")), strict=True):
                    tokens = t.split()
                    if len(known) > 200_000:
                        known.clear()
                    marks = bytes([known[w] if w in known else known.setdefault(w, _marked(w, known_names)) for w in tokens]) if y else bytes(len(tokens))
                    until = 0
                    for i in [i for i, m in enumerate(marks) if m] if y else range(context, len(tokens) + context, 2 * context):
                        if i < until:
                            continue
                        a, b = max(until, i - context), min(len(tokens), i + context)
                        out.append((y, zlib.crc32(f"{k} {a}".encode()), " ".join(tokens[a:b]), marks[a:b]))
                        until = b
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.string(), pa.binary()))], ["y", "h", "tokens", "marks"])

    return sample.select("k", "t", "y").mapInArrow(cut, "y int, h long, tokens string, marks binary")


def fit_chain(spans: list[list[str]], truth: list[np.ndarray], *, rounds: int = 60, decay: float = 1e-3) -> tuple[dict[str, float], float, tuple[float, ...]]:
    """Weights, bias and moves of the chain for token sequences and their token labels."""
    vocabulary: dict[str, int] = {}
    rows = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in s], dtype=np.int32) for s in spans]
    ids: dict[str, int] = {}
    columns, sizes = array("q"), array("q")
    for token in vocabulary:
        own = form_features(token)
        sizes.append(len(own))
        columns.extend(ids.setdefault(f, len(ids)) for f in own)
    tokens = len(vocabulary)
    del vocabulary
    column, owner = np.frombuffer(columns, np.int64), np.repeat(np.arange(tokens, dtype=np.int32), np.frombuffer(sizes, np.int64))
    lanes = Lanes(np.array([len(r) for r in rows], dtype=np.int64))
    word, y = np.empty(int(lanes.starts[-1]), dtype=np.int32), np.empty(int(lanes.starts[-1]))
    for rank, i in enumerate(lanes.order):
        word[lanes.place(rank)], y[lanes.place(rank)] = rows[i], truth[i]
    del rows
    # Pairs of neighbours: a token and the next of its sequence, as positions in the flat arrays.
    s = lanes.starts
    now = np.concatenate([np.arange(s[t], s[t] + s[t + 2] - s[t + 1]) for t in range(lanes.steps - 1)] or [np.empty(0, np.int64)])
    nxt = np.arange(s[1], s[-1]) if lanes.steps > 1 else np.empty(0, np.int64)
    w, bias, moves = np.zeros(len(ids)), -3.0, np.zeros(4)
    squares, bias_sq, moves_sq, n = np.full(len(ids), 1e-6), 1e-6, np.full(4, 1e-6), len(y)
    want = np.array([((y[now] == i) & (y[nxt] == j)).sum() for i in (0, 1) for j in (0, 1)], dtype=float)
    for _ in range(rounds):
        of_word = bias + np.bincount(owner, w[column], tokens)
        e = of_word[word]
        left, right = odds_forward_backward(e, tuple(moves), lanes)
        odds = left * right
        error = y - odds / (1 + odds)
        by_word = np.bincount(word, error, tokens)
        gradient = np.bincount(column, by_word[owner], len(ids)) - decay * n * 1e-3 * w
        t = np.exp(moves)
        q = np.exp(np.clip(e[nxt], -30, 30)) * right[nxt]
        cells = np.stack([np.full(len(now), t[0]), t[1] * q, t[2] * left[now], t[3] * left[now] * q])
        move_gradient = want - (cells / cells.sum(0)).sum(1) - 1e-3 * n * 1e-3 * moves if len(now) else np.zeros(4)
        squares += gradient**2
        bias_sq += error.sum() ** 2
        moves_sq += move_gradient**2
        w += 0.5 * gradient / np.sqrt(squares)
        bias += 0.5 * error.sum() / math.sqrt(bias_sq)
        moves += 0.3 * move_gradient / np.sqrt(moves_sq)
    return {f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 0.02}, float(bias), tuple(map(float, moves))


def _fit_in_one_task(windows: DataFrame, max_windows: int) -> ToxicModel:
    """The chain of at most max_windows windows of either kind, fitted by one executor task; its weights come back as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, tokens, marks) for b in batches for h, tokens, marks in zip(*(b.column(c).to_pylist() for c in ("h", "tokens", "marks")), strict=True))
        if rows:
            shared: dict[str, str] = {}
            weights, bias, moves = fit_chain([[shared.setdefault(w, w) for w in tokens.split()] for _, tokens, _ in rows], [np.frombuffer(m, np.uint8).astype(float) for _, _, m in rows])
            named = {**weights, " bias": bias, **{f" move{i}": m for i, m in enumerate(moves)}}
            yield pa.RecordBatch.from_arrays([pa.array(named.keys(), pa.string()), pa.array(named.values(), pa.float64())], ["name", "weight"])

    drawn = [windows.where(F.col("y") == y).orderBy("h", "tokens").limit(max_windows) for y in (0, 1)]
    found = {r["name"]: r["weight"] for r in drawn[0].unionByName(drawn[1]).select("h", "tokens", "marks").coalesce(1).mapInArrow(run, "name string, weight double").collect()}
    return ToxicModel({k: v for k, v in found.items() if k[0] != " "}, found.get(" bias", 0.0), tuple(found.get(f" move{i}", 0.0) for i in range(4)))


def _summaries(sample: DataFrame, model: ToxicModel) -> DataFrame:
    """(k, y, and what the document layer sees) of each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = _Emissions(model)
        for batch in batches:
            for part in slices(batch, "t"):
                tokens = [t.split() for t in part.column("t").to_pylist()]
                seen = np.array([summary(p) for p in marginals([np.fromiter(map(emit.__getitem__, x), float, len(x)) for x in tokens], model.moves)]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), *(pa.array(np.ascontiguousarray(c)) for c in seen.T)], ["k", "y", "s0", "s1", "s2", "s3"])

    return sample.select("k", "y", "t").mapInArrow(run, "k long, y int, s0 double, s1 double, s2 double, s3 double")


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps, weighted so that toxic documents have the share ``prior``."""
    share = y.mean()
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.3
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        beta = beta + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge @ beta)
    return tuple(map(float, beta))


def document_score(model: ToxicModel, p: np.ndarray) -> float:
    if not model.layer:
        return min(1.0, max(0.0, model.prior))
    z = sum(a * b for a, b in zip(model.layer, summary(p), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, max_docs: int = 2500, max_windows: int = 5000, context: int = 40) -> ToxicModel:
    """Fit on labelled rows whose crc32(id as text) mod folds is not 0.

    The sample is the ``max_docs`` labelled documents with the least hash of their id.
    Of their windows of up to 2 * ``context`` tokens, ``max_windows`` of either kind
    go into the fit. The share of toxic labels, by which the document layer is
    weighted, is that of all labels of the folds.
    """
    open_labels = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull()).where(crc32_of_id("k") % folds != 0)
    n, toxic = open_labels.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return ToxicModel()
    # max_docs rows of two numbers: 50 KB.
    chosen = open_labels.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_docs)
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    sample = checkpointed(texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.max("t").alias("t")))
    size, bad = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = toxic / n
    telling = telling_words(sample, size - bad, bad) if 0 < bad < size else []
    if not telling:
        return ToxicModel(prior=prior)
    model = _fit_in_one_task(cut_windows(sample, telling, context=context), max_windows)
    model.prior = prior
    rows = _summaries(sample, model).orderBy("k").collect()
    model.layer = _logistic(np.array([tuple(r)[2:] for r in rows]), np.array([r["y"] for r in rows], dtype=float), prior)
    return model


def score(docs: DataFrame, model: ToxicModel, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with toxic_score, and toxic_spans: runs of likely tokens as (start, end, probability) in code points."""
    kept = [c for c in docs.columns if c not in ("toxic_score", "toxic_spans")]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = _Emissions(model)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                tokens = [t.split() if t else [] for t in texts]
                p = marginals([np.fromiter(map(emit.__getitem__, x), float, len(x)) for x in tokens], model.moves) if model.layer else [np.empty(0)] * len(texts)
                found = [_spans(t, x, threshold) if len(x) and x.max() > threshold else [] for t, x in zip(texts, p, strict=True)]
                arrays = [pa.array([document_score(model, x) for x in p], pa.float64()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*kept, "toxic_score", "toxic_spans"])

    return small_batches(docs.select(*kept)).mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + [T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))]))


def _spans(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    out: list[dict] = []
    last = -2
    for i, m in enumerate(re.finditer(_TOKEN, text)):
        if i < len(p) and p[i] > threshold:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "probability": max(out[-1]["probability"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "probability": float(p[i])})
            last = i
    return out
