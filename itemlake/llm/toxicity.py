"""Toxicity: a lexicon learned from labels, matched with misspellings by Levenshtein automata on its trie, read in context."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.textarrays import slices
from itemlake.plans.scratch import materialise

# Characters between words, characters that a word may hold inside, quotation marks, and words near a quotation or an address.
_BETWEEN = "\"%&(),./:;<=>?[\\]`{}«»“”„‘’‚‹›…–—¿¡·"
_INSIDE = "!#$'*+-@^_|~"
_CURVED = "“”„«»‹›"
REPORTING = frozenset(
    "said says saying called calls calling word words term terms quote quoted quotes wrote writes insult insults "
    "sagte sagt nannte genannt wort wörter zitat zitiert schrieb dijo dice llamó llaman palabra palabras cita escribió "
    "dit disait appelé appelle mot mots cite cité écrit".split()
)
DIRECTED = frozenset("you your youre you're yourself du dich dein deine ihr euch tu te toi ton vous votre tú eres usted ustedes vosotros".split())

_core = "[^\\s" + re.escape(_BETWEEN + _INSIDE) + "]"
_TOKEN = re.compile(f"{_core}(?:(?:{_core}|[{re.escape(_INSIDE)}])*{_core})?")
_SEP, _IN, _REST = 0, 1, 2
#: Buckets of the words beside a hit, words on each side, and words or stems of the learned lexicon.
CONTEXT, WINDOW, MAX_TERMS = 4096, 4, 400
_STEMS = range(3, 11)
_PENDING = 500_000


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass(frozen=True)
class Term:
    """A word, or a stem with any ending; weight and misspelled (no more than weight) are log odds of toxic to clean texts that hold it."""

    text: str
    stem: bool
    weight: float
    misspelled: float = 0.0
    edits: int = 0


def edits_for(text: str, most: int = 2) -> int:
    """None below five letters, one below ten, then two."""
    return min(most, len(text) // 5)


@dataclass
class _Node:
    next: dict[int, int] = field(default_factory=dict)
    budget: int = 0  # most edits of a term at or below
    word: int = -1
    stem: int = -1


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie and made deterministic as texts ask for it.

    A state is the set of (trie node, edits so far) that its prefix can reach: matching a letter, replacing
    it, adding one, or leaving out one of the term. An edit count above what any term below the node
    allows is dropped, and of one node only the fewest edits stay. Transitions are kept in one table,
    so whole columns of words step through it at once.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        alphabet = sorted({c for t in terms for c in t.text})
        self.code = {c: _REST + 1 + i for i, c in enumerate(alphabet)}
        self.classes = _char_classes().copy()
        for c, k in self.code.items():
            self.classes[ord(c)] = k
        self.nodes = [_Node()]
        for i, t in enumerate(terms):
            at = 0
            path = [0]
            for c in t.text:
                nxt = self.nodes[at].next.get(self.code[c])
                if nxt is None:
                    nxt = self.nodes[at].next[self.code[c]] = len(self.nodes)
                    self.nodes.append(_Node())
                at = nxt
                path.append(at)
            for p in path:
                self.nodes[p].budget = max(self.nodes[p].budget, t.edits)
            setattr(self.nodes[at], "stem" if t.stem else "word", i)
        self.width = len(self.code) + _REST + 1
        self.states: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.table = np.full((1024, self.width), -1, np.int32)
        self.value: list[int] = []  # 2 x term + misspelled of a word that ends here, or -1
        self.dead = self._state({}, -1)
        self.start = self._state({0: 0}, -1)
        self.table[self.dead] = self.dead

    def _worth(self, value: int) -> float:
        return -1.0 if value < 0 else (self.terms[value >> 1].misspelled if value & 1 else self.terms[value >> 1].weight)

    def _best(self, values: Iterable[int]) -> int:
        return max(values, key=lambda v: (self._worth(v), -v), default=-1)

    def _allowed(self, term: int, edits: int) -> int:
        if term < 0 or edits > self.terms[term].edits or self._worth(2 * term + (edits > 0)) <= 0:
            return -1
        return 2 * term + (edits > 0)

    def _state(self, reached: dict[int, int], stem: int) -> int:
        """Number of the state that reached (fewest edits by node) and the best stem passed make."""
        todo = sorted(reached.items(), key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            for child in self.nodes[node].next.values():  # a letter of the term left out
                if e + 1 <= self.nodes[child].budget and reached.get(child, 99) > e + 1:
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        stem = self._best([stem, *(self._allowed(self.nodes[n].stem, e) for n, e in reached.items())])
        key = (frozenset(reached.items()), stem)
        if key not in self.states:
            number = self.states[key] = len(self.items)
            self.items.append((tuple(reached.items()), stem))
            self.value.append(self._best([stem, *(self._allowed(self.nodes[n].word, e) for n, e in reached.items())]))
            if number >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return self.states[key]

    def _step(self, state: int, char: int) -> int:
        items, stem = self.items[state]
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.nodes[node].budget and reached.get(node, 99) > e:
                reached[node] = e

        for node, e in items:
            here = self.nodes[node]
            if char in here.next:
                reach(here.next[char], e)
            if e < here.budget:
                reach(node, e + 1)
                for child in here.next.values():
                    reach(child, e + 1)
        return self._state(reached, stem)

    def run(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Value of each word chars[start:end]: -1, or 2 x term + misspelled."""
        out = np.full(len(start), -1, np.int64)
        word, at, state = np.arange(len(start)), start.copy(), np.full(len(start), self.start, np.int32)
        while len(word):
            char = chars[at]
            nxt = self.table[state, char]
            if (new := np.flatnonzero(nxt < 0)).size:
                pairs, where = np.unique(state[new].astype(np.int64) * self.width + char[new], return_inverse=True)
                found = np.array([self._step(int(p) // self.width, int(p) % self.width) for p in pairs], np.int32)
                self.table[pairs // self.width, pairs % self.width] = found
                nxt[new] = found[where]
            at += 1
            value = np.array(self.value, np.int64)
            over = (at >= end[word]) | self._settled()[nxt]
            out[word[over]] = value[nxt[over]]
            on = ~over
            word, at, state = word[on], at[on], nxt[on]
        return out

    def _settled(self) -> np.ndarray:
        """States that no more letters change: nothing is reached any more but a stem passed."""
        if len(getattr(self, "_done", ())) != len(self.items):
            self._done = np.array([not items for items, _ in self.items])
        return self._done


@cache
def _char_classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, _REST, np.uint16)
    out[[c for c in range(sys.maxunicode + 1) if chr(c).isspace()]] = _SEP
    out[[ord(c) for c in _BETWEEN]] = _SEP
    out[[ord(c) for c in _INSIDE]] = _IN
    return out


@dataclass
class Hit:
    term: int
    misspelled: bool
    quoted: bool
    near: list[str]


def token_spans(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words, which begin and end with a character that isn't of _INSIDE."""
    core = np.flatnonzero(classes >= _REST)
    if not len(core):
        return (np.zeros(0, np.int64),) * 3
    breaks = np.zeros(len(classes) + 1, np.int64)
    breaks[1:] = np.cumsum(classes == _SEP)
    run = breaks[core]
    row = np.searchsorted(offsets, core, side="right") - 1
    first = np.append(True, (run[1:] != run[:-1]) | (row[1:] != row[:-1]))
    at = np.flatnonzero(first)
    return core[at], core[np.append(at[1:], len(core)) - 1] + 1, row[at]


def is_quoted(text: str, start: int, end: int, reach: int = 200) -> bool:
    """Between quotation marks of its line: an odd number of straight ones before and one after, or the nearest curved ones open and close."""
    before = text[max(text.rfind("\n", 0, start) + 1, start - reach) : start]
    stop = text.find("\n", end)
    after = text[end : min(end + reach, len(text) if stop < 0 else stop)]
    if before.count('"') % 2 and '"' in after:
        return True
    opened, closed = [c for c in before if c in _CURVED], [c for c in after if c in _CURVED]
    return bool(opened and closed) and opened[-1] in "“„«‹" and closed[0] in "”»›“"


def hits_of(column: pa.Array, automaton: Automaton) -> Iterator[tuple[int, list[Hit]]]:
    """(number of words, hits) of every row of a text column."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.utf8_lower(column)
    for s in slices(column):
        text = s.data.tobytes().decode()
        chars = automaton.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        lead = (s.data & 0xC0) != 0x80
        sizes = s.per_row(lead)
        offsets = np.append(0, np.cumsum(sizes))
        start, end, row = token_spans(chars, offsets)
        value = automaton.run(chars, start, end)
        count = np.bincount(row, minlength=len(sizes))
        first = np.append(0, np.cumsum(count))
        found: dict[int, list[Hit]] = {}
        for i in np.flatnonzero(value >= 0).tolist():
            r = int(row[i])
            low, high = int(offsets[r]), int(offsets[r + 1])
            around = [j for j in range(max(int(first[r]), i - WINDOW), min(int(first[r + 1]), i + WINDOW + 1)) if j != i]
            a = max(low, int(start[i]) - 400)
            inside = is_quoted(text[a : min(high, int(end[i]) + 400)], int(start[i]) - a, int(end[i]) - a)
            found.setdefault(r, []).append(Hit(int(value[i]) >> 1, bool(value[i] & 1), inside, [text[start[j] : end[j]] for j in around]))
        for r in range(len(sizes)):
            yield int(count[r]), found.get(r, [])


def _bucket(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % CONTEXT


@dataclass
class Model:
    """What scoring needs; a few hundred terms and CONTEXT numbers."""

    terms: list[Term]
    context: np.ndarray  # log odds of clean to toxic texts of the words beside hits
    coefficients: np.ndarray
    _automaton: Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self) -> Automaton:
        if self._automaton is None:
            self._automaton = Automaton(self.terms)
        return self._automaton

    def quotation(self, hit: Hit) -> float:
        """Between 0 (abuse) and 1 (a word that is quoted or told of), from the words and marks around it."""
        near = set(hit.near)
        score = 3.0 * hit.quoted + 1.5 * bool(near & REPORTING) - 1.0 * bool(near & DIRECTED) + sum(self.context[_bucket(w)] for w in near)
        return 1 / (1 + math.exp(min(50.0, 1.5 - score)))

    def features(self, n_words: int, hits: list[Hit]) -> tuple[float, ...]:
        """1; the strongest term in abuse and all of them; the strongest in quotation; abuse per word."""
        abuse = quoted = total = 0.0
        for h in hits:
            term = self.terms[h.term]
            weight = term.misspelled if h.misspelled else term.weight
            share = self.quotation(h)
            abuse, quoted = max(abuse, weight * (1 - share)), max(quoted, weight * share)
            total += weight * (1 - share)
        return 1.0, abuse, math.log1p(total), quoted, math.log1p(1000 * total / max(n_words, 1))


_FEATURES = 5


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0


def _signature(text: str) -> int:
    """The least hash of the words of five letters or more: near copies mostly share it."""
    import xxhash

    words = {w for w in tokens(text) if len(w) >= 5} or {text}
    return min(xxhash.xxh3_64_intdigest(w) for w in words) >> 1


def training_texts(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """text, toxic (0 or 1) of at most limit labelled documents outside the held-out fifth, the first by a hash of their ids.

    Of near copies with one label about one stays, so that what a copied text says doesn't count as often
    as it is copied.
    """
    own = F.col("doc_id").cast("long").alias("doc_id")
    marks = labels.filter("doc_id is not null and toxic is not null").filter(~is_held_out()).groupBy(own).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # limit pairs of numbers

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.append_column("signature", pa.array([_signature(t) for t in batch.column(0).to_pylist()], pa.int64()))

    texts = docs.select(own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")
    signed = texts.select("text", "toxic").mapInArrow(sign, "text string, toxic int, signature long")
    return signed.groupBy("signature", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


_QUOTATION = re.compile('"[^"\n]{1,200}"|“[^”\n]{1,200}”|„[^“\n]{1,200}“|«[^»\n]{1,200}»')


def _term_keys(text: str) -> set[str]:
    """What a text says outside quotations: its words, ended by a space, and their stems. Words that mark a context are no terms."""
    words = set(tokens(_QUOTATION.sub(" ", text))) - REPORTING - DIRECTED
    keys = {w + " " for w in words if len(w) >= 3}
    keys.update(w[:n] for w in words for n in _STEMS if n <= len(w))
    return keys


def term_counts(texts: DataFrame) -> DataFrame:
    """term, toxic, clean: the texts of either label that hold the word or stem, summed in tasks before the shuffle."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[x][k] for k in keys], pa.int64()) for x in (1, 0))], ["term", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in it:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(_term_keys(text))
                if len(seen[0]) + len(seen[1]) > _PENDING:
                    yield rows()
        yield rows()

    return texts.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chance(toxic: int, clean: int, share: float) -> float:
    """Log of a bound (Chernoff) on the chance that so many or more of the texts holding a term are toxic, if a share of all is."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 0.0
    return -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, tested: int, false_share: float = 0.05, least_odds: float = 4.0) -> list[tuple[str, int, int]]:
    """The terms (as _term_keys) that hold more toxic texts than chance, at a false discovery rate (Benjamini-Hochberg) and least_odds times as often as clean ones.

    Of terms with equal evidence the more specific comes first; what lies below a chosen stem is left
    out, and a stem whose toxic texts the chosen terms below it explain.
    """
    share = toxic / (toxic + clean)
    ranked = sorted((chance(t, c, share), not k.endswith(" "), -len(k), k, t, c) for k, t, c in counts)
    last = max((i for i, r in enumerate(ranked, 1) if r[0] <= math.log(false_share * i / max(tested, 1))), default=0)
    chosen: dict[str, int] = {}
    out = []
    for _, _, _, key, t, c in ranked[:last]:
        below = sum(n for k, n in chosen.items() if k.startswith(key.rstrip()) and not key.endswith(" "))
        if _log_odds(t, c, toxic, clean) < math.log(least_odds) or any(key.startswith(k) for k in chosen if not k.endswith(" ")) or (below and chance(max(t - below, 0) or 1, c, share) > math.log(false_share / max(tested, 1))):
            continue
        chosen[key] = t
        out.append((key, t, c))
        if len(out) == MAX_TERMS:
            break
    return out


def _log_odds(t: float, c: float, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the ridge spares the constant. Quotation (third after the constant) can't speak for toxicity by itself."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, limit: int = 10_000, context_prior: float = 10.0) -> Model:
    """Lexicon, misspellings, context and coefficients from at most limit labelled texts (see training_texts).

    Without toxic or without clean texts among them the lexicon is empty and every score is their share.
    """
    texts = materialise(training_texts(docs, labels, limit), "labelled")
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    base = np.zeros(_FEATURES)
    base[0] = math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -10.0
    if not toxic or not clean:
        return Model([], np.zeros(CONTEXT), base)
    counts = materialise(term_counts(texts), "terms")
    tested = counts.count()
    likely = counts.filter(F.col("toxic") * clean > F.col("clean") * toxic * 2).orderBy(F.desc(F.col("toxic") - F.col("clean") * (toxic / clean)), "term")
    found = choose_terms([tuple(r) for r in likely.limit(50 * MAX_TERMS).collect()], toxic, clean, tested)
    terms = []
    for key, t, c in found:
        w = _log_odds(t, c, toxic, clean)
        terms.append(Term(key.rstrip(), not key.endswith(" "), w, w, edits_for(key.rstrip())))
    model = Model(terms, np.zeros(CONTEXT), base)

    def observe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, key) by label: texts that hold a misspelling of a term but no exact one, and texts with a word beside a hit."""
        seen: Counter = Counter()
        for batch in it:
            for (_, hits), label in zip(hits_of(batch.column(0), model.automaton), batch.column(1).to_pylist(), strict=True):
                if not any(not h.misspelled for h in hits):
                    seen.update({("misspelled", h.term, label) for h in hits})
                seen.update({("context", b, label) for b in {_bucket(w) for h in hits for w in h.near}})
                seen.update({("context", -1, label)} if hits else ())
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array([seen[k] for k in keys], pa.int64())], ["kind", "key", "label", "n"])

    seen = {(r.kind, r.key, r.label): r.n for r in texts.mapInArrow(observe, "kind string, key int, label int, n long").groupBy("kind", "key", "label").agg(F.sum("n").alias("n")).collect()}
    fitted = []
    for i, ((_, t, c), term) in enumerate(zip(found, terms, strict=True)):
        far, near = seen.get(("misspelled", i, 1), 0), seen.get(("misspelled", i, 0), 0)
        w = _log_odds(far + t / toxic, near + c / clean, toxic, clean) if far + near else term.weight
        fitted.append(Term(term.text, term.stem, term.weight, min(w, term.weight), term.edits if w > 1 else 0))
    with_hits = {x: seen.get(("context", -1, x), 0) for x in (0, 1)}
    context = np.zeros(CONTEXT)
    for b in {k for kind, k, _ in seen if kind == "context" and k >= 0}:
        rate = [(seen.get(("context", b, x), 0) + context_prior * 0.05) / (with_hits[x] + context_prior) for x in (0, 1)]
        context[b] = np.clip(math.log(rate[0] / rate[1]), -1, 1) * min(1.0, with_hits[0] / 50)
    model = Model(fitted, context, base)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [model.features(k, hits) for k, hits in hits_of(batch.column(0), model.automaton)]
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in rows], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sorted((tuple(r.x), r.y) for r in texts.mapInArrow(measure, "x array<double>, y int").collect())  # limit rows of five numbers
    model.coefficients = fit_logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    return model


def toxic_scores(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1, of toxic being 1) and predicted (1 from 0.5 on) of every row, with the columns keep of docs.

    The score reads the text alone. Null text counts as empty, which scores as a text without hits;
    repeated rows each give a row, null ids too; texts of any length are read whole; an empty table gives
    no row. Columns of docs named score or predicted have to be renamed before they can be kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_TERMS terms and CONTEXT numbers
    keep = ["doc_id"] if keep is None else keep

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            x = np.array([m.features(k, hits) for k, hits in hits_of(batch.column("_text"), m.automaton)]).reshape(-1, _FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ m.coefficients, -50, 50)))
            rest = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*rest.schema.names, "score", "predicted"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(score, schema)
