"""Toxicity: Levenshtein automata intersected with a lexicon trie, hits weighed by their context windows.

The lexicon (words and word beginnings that mark labelled toxic texts) is counted on a bounded labelled sample. At scan time
every distinct word walks the product of the trie and the Levenshtein automaton; the product is determinised lazily, so a
word costs one dictionary step a character until its state dies. A hit between quotation marks or after a reporting verb
counts as quoted, any other as direct. A ridge logistic regression over a document's direct and quoted masses gives the score.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import claim, cut, fit_logistic, is_held_out, labelled_sample, predict_logistic, ship_package, slices

WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.3
MAX_ROWS = 12_000
MAX_TERMS = 400
_KNOWN = 200_000

#: Words that report another's speech.
REPORTING = frozenset("said says wrote called quoted quote reported dijo dice escribió llamó dit écrit appelé sagte schrieb nannte".split())
QUOTES = {'"': 0, "“": 1, "”": 1, "„": 1, "«": 2, "»": 2, "‹": 3, "›": 3}
_MARKS = re.compile(f"[{''.join(QUOTES)}]|\n\\s*\n")
_SPAN = 6
_STEPS = 50_000


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """What stands between quotation marks, of any length and over lines.

    A mark opens a quotation, the next of its family closes it; other families' marks inside are part of it. As straight marks do
    not tell opening from closing, an odd one is forgotten at the end of its paragraph.
    """
    spans, family, begin = [], None, 0
    for m in _MARKS.finditer(text):
        kind = QUOTES.get(m.group())
        if kind is None:
            family = None if family == 0 else family
        elif family is None:
            family, begin = kind, m.end()
        elif family == kind:
            spans.append((begin, m.start()))
            family = None
    return spans


def _unquoted(text: str) -> str:
    spans = quoted_spans(text)
    inner = [0, *(x for span in spans for x in span), len(text)]
    return " ".join(text[a:b] for a, b in zip(inner[::2], inner[1::2], strict=True)) if spans else text


@dataclass
class Lexicon:
    """Terms with weights. A term that ends in * is a word beginning. Long terms are also found with edits, but for exact ones."""

    terms: dict[str, float]
    exact: frozenset[str] = frozenset()
    decay: float = 0.6
    _children: list[dict[str, int]] = field(default_factory=lambda: [{}], repr=False)
    _final: dict[int, str] = field(default_factory=dict, repr=False)
    _stem: dict[int, str] = field(default_factory=dict, repr=False)
    _reach: list[int] = field(default_factory=lambda: [0], repr=False)
    _steps: dict = field(default_factory=dict, repr=False)
    _begun: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        for term in self.terms:
            at, word = 0, term.rstrip("*")
            allowed = self.allowed(term)
            self._reach[0] = max(self._reach[0], allowed)
            for c in word:
                if c not in self._children[at]:
                    self._children[at][c] = len(self._children)
                    self._children.append({})
                    self._reach.append(0)
                at = self._children[at][c]
                self._reach[at] = max(self._reach[at], allowed)
            (self._stem if term.endswith("*") else self._final)[at] = term
        self._start = self._close({0: 0})

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def allowed(self, term: str) -> int:
        return 0 if term in self.exact else self.edits(term.rstrip("*"))

    def _close(self, states: dict[int, int]) -> frozenset:
        """States (trie node, edits) with all deletions: trie letters that the word lacks."""
        todo, best = list(states.items()), dict(states)
        while todo:
            node, k = todo.pop()
            for to in self._children[node].values():
                if k + 1 <= self._reach[to] and k + 1 < best.get(to, 9):
                    best[to] = k + 1
                    todo.append((to, k + 1))
        return frozenset(best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        got = self._steps.get((state, c))
        if got is None:
            best: dict[int, int] = {}
            for node, k in state:
                if k + 1 <= self._reach[node] and k + 1 < best.get(node, 9):  # insertion
                    best[node] = k + 1
                for letter, to in self._children[node].items():
                    cost = k + (letter != c)
                    if cost <= self._reach[to] and cost < best.get(to, 9) or cost == 0:
                        best[to] = min(cost, best.get(to, 9))
            got = self._close(best)
            if len(self._steps) >= _STEPS:
                self._steps.clear()
                self._begun.clear()
            self._steps[state, c] = got
        return got

    def _best(self, state: frozenset, ends: dict[int, str]) -> tuple[str, float] | None:
        """The best of the terms that end in a state."""
        found = [(ends[node], self.terms[ends[node]] * self.decay**k) for node, k in state if node in ends and k <= self.allowed(ends[node])]
        return max(found, key=lambda x: x[1], default=None)

    def find(self, word: str) -> tuple[str, float] | None:
        """The term that a word matches, with the term's weight times decay for each edit; the best if several do."""
        state, found = self._start, []
        for c in word:
            state = self._step(state, c)
            if not state:
                break
            if state not in self._begun:
                self._begun[state] = self._best(state, self._stem)
            found.append(self._begun[state])
        else:
            found.append(self._best(state, self._final))
        return max(filter(None, found), key=lambda x: x[1], default=None)


class Scorer:
    """Features of texts; remembers which words hit."""

    NAMES = ("direct", "density", "quoted", "distinct", "repeated", "strongest")  # no length: long texts are not worse

    def __init__(self, lexicon: Lexicon) -> None:
        claim("toxicity")
        self.lexicon = lexicon
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}

    def features(self, text: str) -> tuple[float, ...]:
        lowered = text.lower()
        words = WORD.findall(lowered)
        distinct = set(words)
        new = distinct - self.known
        if new:
            if len(self.known) > _KNOWN:
                self.known.clear()
                self.hits.clear()
                new = distinct
            for w in new:
                if (hit := self.lexicon.find(w)) is not None:
                    self.hits[w] = hit
            self.known |= new
        bad = distinct & self.hits.keys()
        n = len(words)
        if not bad:
            return (0.0,) * len(self.NAMES)
        spans = quoted_spans(lowered)
        at_span = 0
        direct = quoted = 0.0
        terms: Counter = Counter()
        k = 0
        for m in WORD.finditer(lowered):
            w = m.group()
            if w in bad:
                term, weight = self.hits[w]
                at = m.start()
                said = any(x in REPORTING for x in words[max(0, k - _SPAN) : k])
                while at_span < len(spans) and spans[at_span][1] <= at:
                    at_span += 1
                inside = at_span < len(spans) and spans[at_span][0] <= at
                if said or inside:
                    quoted += weight
                else:
                    direct += weight
                    terms[term] += 1
            k += 1
        known = self.lexicon.terms
        strongest = max((known[t] for t in terms), default=0.0)
        most = max((n * known[t] for t, n in terms.items()), default=0.0)
        return (math.log1p(direct), math.log1p(100 * direct / max(n, 1)), math.log1p(quoted), math.log1p(sum(known[t] for t in terms)), math.log1p(most), strongest)


def _kind(words: list[str]) -> int:
    """The least hash of a text's runs of three words: the same for most near copies, and hardly ever for other texts."""
    return min(int.from_bytes(hashlib.blake2b(" ".join(words[k : k + 3]).encode(), digest_size=8).digest(), "little", signed=True) for k in range(max(1, len(words) - 2)))


def fold_of_text(words: list[str]) -> int:
    """0 or 1; copies and most near copies are in one fold."""
    return _kind(words) & 1


def count_forms(sample: DataFrame) -> DataFrame:
    """form, fold, d0, d1 (texts), u0, u1 (uses), kinds of each word and word beginning of a sample (text, label); totals under the empty form.

    Quotations do not count on either side: there a term marks what is spoken of.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: tuple[Counter, Counter] = (Counter(), Counter())
        kinds: defaultdict[tuple[str, int], set[int]] = defaultdict(set)
        uses: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                run = WORD.findall(_unquoted(text.lower()))
                words = Counter(run)
                fold = fold_of_text(run)
                forms: Counter = Counter()
                for w, n in words.items():
                    if len(w) >= 3:
                        forms[w, fold] += n
                        for k in range(4, min(len(w), 10)):
                            forms[w[:k] + "*", fold] += n
                uses[label].update({form: min(n, 3) for form, n in forms.items()})  # one text says no more with more repeats
                docs[label].update(forms.keys())
                if label and words:
                    kind = _kind(run)
                    for form in [*forms, ("", fold)]:
                        kinds[form].add(kind)
                docs[label]["", fold] += 1
                uses[label]["", fold] += len(run)
        keys = sorted(docs[0].keys() | docs[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (docs[0], docs[1], uses[0], uses[1])), pa.array([sorted(kinds.get(k, ())) for k in keys], pa.list_(pa.int64()))], names=["form", "fold", "d0", "d1", "u0", "u1", "kinds"])

    counts = sample.mapInArrow(count, "form string, fold int, d0 bigint, d1 bigint, u0 bigint, u1 bigint, kinds array<bigint>")
    sums = counts.groupBy("form", "fold").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "u0", "u1")), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("k1"))
    return cut(sums.where((F.col("k1") > 1) | (F.col("form") == "")))


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS, least_kinds: int = 5, counts: DataFrame | None = None, fold: int | None = None) -> Lexicon:
    """Words and word beginnings whose rate among words of toxic texts is far above that in others. sample: (text, label).

    A term must stand in toxic texts of at least least_kinds kinds, and 0.5 % of all kinds; exact copies of a text are of one kind,
    near copies mostly. Terms whose share of toxic texts may be chance, at one in a million for all forms that were tried, are found
    without edits only: among them are fragments that mark a language or a family of copies. So are beginnings, whose edits blame
    many clean texts. counts: count_forms(sample), if it is
    at hand; fold: learn from that fold alone. A form that only one kind of toxic texts of a fold has does not count there.
    """
    counts = count_forms(sample) if counts is None else counts
    sums = counts.where(F.lit(True) if fold is None else F.col("fold") == fold).groupBy("form").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "u0", "u1", "k1")))
    often = sums.where((F.col("k1") >= least_kinds) | (F.col("form") == "")).persist()
    total = often.where("form = ''").first() or {"d0": 0, "d1": 0, "u0": 0, "u1": 0, "k1": 0}
    rate = lambda c, most: (F.col(c) + 0.5) / F.lit(total[most] + 1.0)
    rows = (
        often.where((F.col("form") != "") & (F.col("k1") * 200 >= total["k1"]))
        .withColumn("ratio", rate("u1", "u1") / rate("u0", "u0"))
        .where((F.col("ratio") >= 10) & (F.col("d1") * (total["d0"] + 1) >= 3 * (F.col("d0") + 1) * total["d1"]))
        .withColumn("gain", F.col("u1") * F.log("ratio"))
        .orderBy(F.desc("gain"), "form")
        .limit(8 * max_terms)
        .collect()
    )
    stats = {r.form: r for r in rows}
    # a beginning whose uses nearly all come from one longer form gives way to that form
    covered = set()
    for form in stats:
        word = form.rstrip("*")
        for k in range(4, len(word) + (not form.endswith("*"))):
            short = word[:k] + "*"
            if short != form and short in stats and stats[form].u1 >= 0.8 * stats[short].u1:
                covered.add(short)
    terms: dict[str, float] = {}
    for form, r in sorted(stats.items(), key=lambda x: (-x[1].gain, x[0])):
        word = form.rstrip("*")
        if form in covered or any(word[:k] + "*" in terms for k in range(4, len(word) + 1)):
            continue
        weight = _surely(r.k1, total["k1"], r.d0, total["d0"]) / 3
        if weight > 0:
            if form.endswith("*"):
                for other in [t for t in terms if t.startswith(word)]:
                    del terms[other]
            terms[form] = min(2.0, weight)
        if len(terms) >= max_terms:
            break
    share = total["k1"] / max(1, total["k1"] + total["d0"])
    tried = max(1, often.count())
    often.unpersist()
    return Lexicon(terms, frozenset(t for t in terms if t.endswith("*") or _chance(stats[t].k1, stats[t].d0, share) * tried > 1e-6))


def _surely(bad: int, all_bad: int, clean: int, all_clean: int) -> float:
    """Log ratio of a form's shares of toxic and of clean texts, less two standard errors: few texts make little evidence."""
    return math.log((bad + 0.5) / (all_bad + 1) * (all_clean + 1) / (clean + 0.5)) - 2 * math.sqrt(1 / bad + 1 / (clean + 0.5))


def _chance(bad: int, clean: int, share: float) -> float:
    """How probable it is that of bad + clean texts at least bad are toxic, if a form tells nothing and a share of all are."""
    n, p = bad + clean, min(max(share, 1e-9), 1 - 1e-9)
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)
    return min(1.0, sum(math.exp(log(j)) for j in range(bad, n + 1)))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    @property
    def tells(self) -> bool:
        """Whether texts differ in score: not without labelled rows, nor where these showed no difference."""
        return bool(self.weights[:-1].any())


def train_toxicity_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn the lexicon and the weights from at most max_rows labelled rows outside the held-out fold."""
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, max_rows, id_col, text_col).select("text", "label")
    counts = count_forms(sample)
    lexicon = learn_lexicon(sample, counts=counts)
    # weights are fitted on texts that their lexicon has not seen, so that chance terms earn no weight
    others = [learn_lexicon(sample, counts=counts, fold=1 - k) for k in (0, 1)]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers, x, y = [Scorer(o) for o in others], [], []
        for batch in slices(batches, "text"):
            x += [scorers[fold_of_text(WORD.findall(_unquoted(t.lower())))].features(t) for t in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        w = fit_logistic(np.array(x, float).reshape(len(y), len(Scorer.NAMES)), np.array(y, float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(w)], pa.binary())], names=["w"])

    row = sample.repartition(1).mapInArrow(fit, "w binary").first()
    return ToxicityModel(lexicon, pickle.loads(row[0]) if row else np.zeros(len(Scorer.NAMES) + 1))


def _scores(model: ToxicityModel, scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    x = np.array([scorer.features(t or "") for t in texts], float).reshape(len(texts), len(Scorer.NAMES))
    return predict_logistic(x, model.weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    NULL and empty texts have no hits and get the low score of such texts. Other columns are not read; repeated rows give
    repeated rows; a NULL id is kept and counts as not held out. Without labelled rows every score is 0.5.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value.lexicon)
        for batch in slices(batches, "text"):
            s = _scores(sent.value, scorer, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and with the same columns, that score below threshold.

    A model that gives all texts one score, as without labelled rows, drops nothing.
    """
    if not model.tells:
        return docs
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value.lexicon)
        renamed = (pa.RecordBatch.from_arrays(b.columns, names=[f"c{i}" if i != at else "text" for i in range(len(names))]) for b in batches)
        for batch in slices(renamed, "text"):
            s = _scores(sent.value, scorer, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
