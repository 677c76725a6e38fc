"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows around its hits."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypergraph_spark.llm.common import hidden, materialize, small_batches

_WORD = re.compile(r"[^\W\d_]+")
#: Signs that what stands near them is cited, reported or discussed rather than said. Fixed values.
QUOTES = "\"'“”„‘’«»‹›"
REPORTING = re.compile(r"\b(said|says|wrote|writes|quote[ds]?|called|term|word|slur|insult|reported|according|sagte|schrieb|zitat|wort|dit|écrit|cité|mot|dijo|escribió|cita|palabra)\b")


@dataclass
class LexiconAutomaton:
    """Recognises words within an edit of a lexicon entry.

    Entries are whole words or, with a final `*`, stems that any ending may follow. The trie of entries and the
    Levenshtein automaton of the word read run in step; reachable (trie node, edits) sets become states of a
    deterministic automaton, built as words need them, so a word costs one lookup a letter until it fails.
    """

    entries: list[str]
    max_edits: int = 1
    min_fuzzy: int = 5
    _children: list[dict] = field(default_factory=lambda: [{}])
    _ends: list[tuple[int, int]] = field(default_factory=lambda: [(-1, -1)])
    _states: dict = field(default_factory=dict)
    _next: list[dict] = field(default_factory=list)
    _verdict: list[tuple[int, int, bool]] = field(default_factory=list)
    _sets: list[frozenset] = field(default_factory=list)
    _height: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for i, e in enumerate(self.entries):
            stem, word = e.endswith("*"), e.rstrip("*")
            node = 0
            for c in word:
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._ends.append((-1, -1))
                    self._height.append(0)
                node = self._children[node][c]
            whole, open_ = self._ends[node]
            self._ends[node] = (whole, i) if stem else (i, open_)
            self._height[node] = len(word)
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """Adds the nodes reached by deleting trie letters; keeps the fewest edits of each node."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, self.max_edits + 1) <= e:
                continue
            best[node] = e
            if e < self.max_edits:
                todo += [(c, e + 1) for c in self._children[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset, done: tuple[int, int] | None = None) -> int:
        """done: (edits, entry) of a stem already read."""
        key = (pairs, done)
        if key not in self._states:
            stems = [(e, self._ends[n][1]) for n, e in pairs if self._ends[n][1] >= 0 and self._allowed(n, e)]
            done = min([*stems, *([done] if done else [])], default=None)
            key2 = (pairs, done)
            if key2 not in self._states:
                whole = [(e, self._ends[n][0]) for n, e in pairs if self._ends[n][0] >= 0 and self._allowed(n, e)]
                best = min([*whole, *([done] if done else [])], default=None)
                self._states[key2] = len(self._sets)
                self._sets.append((pairs, done))
                self._next.append({})
                self._verdict.append(best)
            self._states[key] = self._states[key2]
        return self._states[key]

    def _allowed(self, node: int, edits: int) -> bool:
        return not edits or self._height[node] >= self.min_fuzzy

    def _step(self, state: int, c: str) -> int:
        pairs, done = self._sets[state]
        out = set()
        for node, e in pairs:
            if c in self._children[node]:
                out.add((self._children[node][c], e))
            if e < self.max_edits:
                out.add((node, e + 1))  # a letter too many
                out.update((k, e + 1) for k in self._children[node].values())  # another letter
        to = -1 if not out and done is None else self._state(self._closed(out), done)
        if len(self._next) < 200_000:
            self._next[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry number) of the nearest entry, None if none is near enough."""
        state = self.start
        for c in word:
            state = self._next[state][c] if c in self._next[state] else self._step(state, c)
            if state < 0:
                return None
        return self._verdict[state]


@dataclass
class ToxicityModel:
    """Entry weights (log odds, by exact or near hit) and the logistic weights of the document features."""

    entries: list[str]
    exact: np.ndarray
    near: np.ndarray
    weights: np.ndarray
    window: int = 60
    max_edits: int = 1

    def automaton(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.entries, self.max_edits)


def _quoted(text: str, a: int, b: int, window: int) -> bool:
    """Whether the hit text[a:b] stands between quote marks or near a reporting word within the window."""
    left, right = text[max(0, a - window) : a], text[b : b + window]
    lq = max((left.rfind(q) for q in QUOTES), default=-1)
    rq = min((i for q in QUOTES if (i := right.find(q)) >= 0), default=-1)
    if lq >= 0 and rq >= 0 and "\n" not in left[lq:] and "\n" not in right[:rq]:
        # An apostrophe inside a word is no quote mark.
        return not (left[lq : lq + 2].isalpha() and left[lq] in "'’")
    return bool(REPORTING.search(left))


def features(text: str, automaton: LexiconAutomaton, model: ToxicityModel, memo: dict) -> list[float]:
    """Strongest hit, sum of hits in abuse and in quotation, numbers of both and of misspelled hits, share of words."""
    low = text.lower()
    hits: dict[str, tuple[int, int]] = {}
    words = set(_WORD.findall(low))
    for w in words:
        if w in memo:
            m = memo[w]
        else:
            m = automaton.match(w)
            if len(memo) < 1_000_000:
                memo[w] = m
        if m is not None:
            hits[w] = m
    if not hits:
        return [0.0] * 6
    abuse = quote = misspelled = 0
    strong = heavy = weak = 0.0
    found = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(map(re.escape, hits), key=len, reverse=True)) + r")(?![^\W\d_])")
    for h in found.finditer(low):
        edits, entry = hits[h.group()]
        w = float((model.near if edits else model.exact)[entry])
        misspelled += edits > 0
        if _quoted(low, h.start(), h.end(), model.window):
            quote += 1
            weak = max(weak, w)
        else:
            abuse += 1
            strong = max(strong, w)
            heavy += max(w, 0.0)
    return [strong, math.log1p(heavy), math.log1p(abuse), weak, math.log1p(quote), math.log1p(misspelled)]


def _candidates(counts: list, positives: int, negatives: int, min_docs: int, min_odds: float) -> dict[str, float]:
    return {r["term"]: odds for r in counts if r["pos"] >= min_docs and (odds := math.log((r["pos"] + 0.5) / (positives + 1)) - math.log((r["neg"] + 0.5) / (negatives + 1))) >= min_odds}


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, min_docs: int = 5, min_odds: float = 3.0, stem: tuple[int, int] = (4, 7), max_edits: int = 1) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    At most max_rows labelled ids, those of the smallest xxhash64(doc_id), are fitted on: the documented bound of
    the sample, and of what is broadcast. Document frequencies of words and stems are counted by Spark on all of
    it. Null labels and ids are ignored, an id with several labels has its largest, null texts are empty. Without
    both labels the model scores every text alike. Of rows that repeat an id the least text is fitted on, so the sample
    is as bounded as the ids.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("row")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("row"), "row").limit(max_rows)
    rows = docs.select(F.col("doc_id").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "row")
    sample = materialize(rows.groupBy("row").agg(F.min("text").alias("text"), F.first("y").alias("y")), "toxic-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = n.get(1, 0), n.get(0, 0)
    if not positives or not negatives:
        return ToxicityModel([], np.zeros(0), np.zeros(0), np.array([math.log((positives + 0.5) / (negatives + 0.5)), *[0.0] * 6]))
    words_of = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))), lambda w: F.length(w) >= 3)
    texts = sample.repartition(max(spark.sparkContext.defaultParallelism, 8), "row").select("y", words_of.alias("ws"))
    words = texts.select("y", F.explode("ws").alias("w"))
    counted = words.groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # A selected term is in min_docs positive rows and exp(min_odds) times likelier there, so their number is bounded by the sample.
    whole = _candidates(counted.where(F.col("pos") >= min_docs).select(F.col("w").alias("term"), "pos", "neg").collect(), positives, negatives, min_docs, min_odds)
    cut = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(stem[0]), F.lit(stem[1])), lambda k: F.transform(F.filter("ws", lambda w: F.length(w) > k), lambda w: F.left(w, k)))))
    stems_df = texts.select("y", F.explode(cut).alias("s")).groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where(F.col("pos") >= 2 * min_docs)
    stems = _candidates(stems_df.select(F.col("s").alias("term"), "pos", "neg").collect(), positives, negatives, 2 * min_docs, min_odds)
    # Of nested stems the shortest that is as telling stays; a word its stem covers goes.
    kept: dict[str, float] = {}
    for s in sorted(stems, key=len):
        if not any(s.startswith(k) and kept[k] >= stems[s] - 1.0 for k in (s[:i] for i in range(stem[0], len(s))) if k in kept):
            kept[s] = stems[s]
    covered = lambda w: any(w[:i] in kept for i in range(stem[0], len(w)))
    chosen = {w: o for w, o in whole.items() if not covered(w)} | {f"{s}*": o for s, o in kept.items() if s not in whole or whole[s] < stems[s]}
    entries = sorted(chosen)
    base = np.array([chosen[e] for e in entries])
    model = ToxicityModel(entries, base, base.copy(), np.zeros(7), max_edits=max_edits)
    # Near hits are weighed by what they tell on the sample, entry by entry; those that tell nothing score 0.
    seen = sample.select("y", "text").mapInArrow(_near_counter(model), "entry int, y int, n long")
    near = np.zeros((len(entries), 2))
    for r in seen.groupBy("entry", "y").agg(F.sum("n").alias("n")).collect():
        near[r["entry"], r["y"]] = r["n"]
    odds = np.log((near[:, 1] + 0.5) / (positives + 1)) - np.log((near[:, 0] + 0.5) / (negatives + 1))
    model.near = np.where(near.sum(axis=1) > 0, np.minimum(odds, base), 0.5 * base)
    rows = score_rows(sample.withColumn("doc_id", F.col("row")), model, "y", raw=True).collect()
    x = np.array([list(r["features"]) for r in rows]).reshape(-1, 6)
    y = np.array([r["y"] for r in rows], float)
    model.weights = _logistic(x, y)
    return model


def _near_counter(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts, memo = model.automaton(), {}, {}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = set()
                for w in set(_WORD.findall(text.lower())):
                    if w not in memo:
                        memo[w] = automaton.match(w)
                    m = memo[w]
                    if m and m[0]:
                        got.add(m[1])
                for e in got:
                    counts[e, y] = counts.get((e, y), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["entry", "y", "n"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the intercept first. Abuse never lowers a score."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_rows(docs: DataFrame, model: ToxicityModel, *keep: str, raw: bool = False, text: bool = False) -> DataFrame:
    """doc_id, the kept columns (and text as it is) and score (0 to 1) of every whole text; with raw, its features instead."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *keep, *(["text"] if text else [])]
    src = docs.select(*names, *([] if text else ["text"]))
    types = ", ".join(f"`{c}` {dict(src.dtypes)[c]}" for c in names)
    at = src.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo = model.automaton(), {}
        for batch in batches:
            x = np.array([features(t or "", automaton, model, memo) for t in batch.column(at).to_pylist()]).reshape(-1, 6)
            if raw:
                last = pa.array(x.tolist(), pa.list_(pa.float64()))
            else:
                last = pa.array(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], last], names=[*names, "features" if raw else "score"])

    return src.mapInArrow(run, types + (", features array<double>" if raw else ", score double"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """docs without the rows whose whole text scores `least` or more.

    Null or empty texts score as texts without hits. Repeated rows are each judged; columns stay as they are, one
    named score among them; an empty table gives an empty result.
    """
    inner, names = hidden(docs, ("doc_id", "text"))
    scored = score_rows(inner, model, *[c for c in inner.columns if c not in ("doc_id", "text")], text=True)
    return scored.where(F.col("score") < least).select(*inner.columns).toDF(*names)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from a model fitted on the labels of ids not held out.

    Only texts enter a score. Null or empty texts score as texts without hits. Repeated rows are each scored; a
    null doc_id is never labelled; labels of ids that docs lacks are ignored; an empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))), max_rows)
    out = score_rows(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, "held_out")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
