"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon holds the words, and the stems of word families, that set labelled toxic texts apart. Its words form a
trie, and Levenshtein automata run along it: a state is the set of trie nodes reached with the edits so far, which
is made deterministic as texts ask for it. A window of words around every hit tells quotation from abuse, by quotation
marks and words of speech against words of address. Counts of both become a probability by logistic calibration.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logistic
from .tables import col, labelled_sample
from .text import buffers, distinct, shingles, split_words

# Marks of quotation, words that report speech, words of address; en, de, fr, es.
OPENING, CLOSING = "\"“„«‹‘'`", "\"”“»›’'`"
REPORTING = frozenset(
    "said says called wrote quoted quote word term phrase meaning sagte sagt nannte schrieb zitat wort begriff "
    "dit disait écrit appelé citation mot terme dijo dice llamó escribió cita palabra término".split()
)
ADDRESS = frozenset("you your you're u du dein deine ihr euch dich tu toi vous votre tes te tú usted ustedes vosotros eres es-tu".split())
MARKS = "#%&$*+=/\\|^@"
EDGE = "\"“”„«»‹›‘’'`.,;:!?()[]{}<>*_~-"


@dataclass(frozen=True)
class ToxicityConfig:
    """Learned from at most ``per_class`` labelled texts of each class, ``sample_chars`` of each; scores read whole texts."""

    per_class: int = 3000
    sample_chars: int = 20_000
    least_z: float = 3.5
    purity: float = 0.9
    family_words: int = 3
    nearly: float = 0.8
    window: int = 6
    cut: float = 0.7
    remembered_words: int = 300_000
    remembered_states: int = 50_000


def edits(word: str) -> int:
    """Edits allowed for a lexicon word: none up to three letters, one up to eight, else two."""
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


def stem_edits(stem: str) -> int:
    """Edits allowed for a stem: none up to four letters, else one. Most words are near to some short beginning."""
    return 0 if len(stem) < 5 else 1


class Lexicon:
    """Trie of words and stems with their automata; ``match`` gives (kind, edits) of a word or None.

    A word that no other form matches may begin with a stem misspelled by one edit.
    """

    def __init__(self, words: list[str], stems: list[str], states: int = 50_000):
        self.limit = states
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.end, self.stem = [0], [-1], [-1]
        for word, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = 0
            for c in word:
                self.allowed[node] = max(self.allowed[node], stem_edits(word) if is_stem else edits(word))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.end.append(-1)
                    self.stem.append(-1)
                node = self.children[node][c]
            if is_stem:
                self.stem[node] = stem_edits(word)
                self.allowed[node] = max(self.allowed[node], stem_edits(word))
            else:
                self.end[node] = edits(word)
                self.allowed[node] = max(self.allowed[node], edits(word))
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of the state, with the nodes that lie further down the trie at one edit for each skipped letter."""
        todo = list(reached)
        for node in todo:
            for child in self.children[node].values():
                e = reached[node] + 1
                if e <= self.allowed[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        key = tuple(sorted(reached.items()))
        if key not in self.number:
            self.number[key] = len(self.items)
            self.items.append(key)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < reached.get(node, 99) or e == 0:
                reached[node] = min(e, reached.get(node, 99))

        for node, e in self.items[state]:
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        self.steps[state][c] = to = self._state(reached) if reached else -1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.items) > self.limit:
            self.reset()
        state, stem, near = self.start, False, False
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            met = [e for node, e in self.items[state] if e <= self.stem[node]]
            stem, near = stem or 0 in met, near or 1 in met
        else:
            best = min((e for node, e in self.items[state] if e <= self.end[node]), default=None)
            if best is not None and not (stem and best):
                return "word", best
        return ("stem", 0) if stem else ("stem", 1) if near else None


class Scanner:
    """Counts of hits in a text, of each form, abusive and quoted."""

    def __init__(self, lexicon: Lexicon, cfg: ToxicityConfig):
        self.lexicon, self.cfg = lexicon, cfg
        self.known: dict[str, tuple | None] = {}

    def _lookup(self, token: str) -> tuple | None:
        if len(self.known) > self.cfg.remembered_words:
            self.known.clear()
        bare = token.strip(EDGE)
        self.known[token] = found = self.lexicon.match(bare) if bare else None
        return found

    def _quoted(self, tokens: list[str], at: int) -> bool:
        """Whether the window speaks of quotation more than of address."""
        lo = max(0, at - self.cfg.window)
        before, after = tokens[lo:at], tokens[at + 1 : at + 1 + self.cfg.window]
        opened = any(t[0] in OPENING for t in [*before, tokens[at]])
        closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in [tokens[at], *after] if t.rstrip(".,;:!?"))
        words = {t.strip(EDGE) for t in [*before, *after]}
        score = 1.0 * (opened and closed) + 0.5 * len(words & REPORTING) - 1.0 * len(words & ADDRESS)
        return score >= 1

    def features(self, text: str | None) -> list[float]:
        return self.evidence(text)[:6]

    def evidence(self, text: str | None) -> list[float]:
        """The features, and those of misspelled stems, misspelled four-letter words and disguised terms.

        A term is disguised if what it is misspelled with is no letter. It counts as the term, and its own weight corrects
        that where examples show false alarms; without an example it weighs like the term.
        """
        tokens = (text or "").lower().split()
        known, lookup = self.known, self._lookup
        counts = np.zeros(5)  # exact, one edit, two edits, stem, quoted
        near, short, odd = 0, 0, 0
        for at, token in enumerate(tokens):
            found = known[token] if token in known else lookup(token)
            if found is not None:
                kind, e = found
                bare = token.strip(EDGE)
                if self._quoted(tokens, at):
                    counts[4] += 1
                elif e and any(not c.isalpha() for c in bare[: len(bare.rstrip(MARKS))]):
                    counts[3 if kind == "stem" else 0] += 1
                    odd += 1
                elif kind == "stem":
                    counts[3] += not e
                    near += e
                else:
                    counts[e] += 1
                    short += e == 1 and len(bare) < 6
        return [*np.log1p(counts), float(counts[:4].sum() > 0), *(float(np.log1p(n)) for n in (near, short, odd))]


def apart(sample: list[tuple[str, int]], size: int = 16) -> list[tuple[str, int]]:
    """The sample without near copies, which would lend the words of one text the weight of many.

    A text is left out if an earlier one shares half of the ``size`` smallest hashes of its five-word shingles.
    """
    kept, owners = [], {}
    for text, y in sample:
        _, h = distinct(*shingles(split_words(*buffers(pa.array([text])), lower=True), 5))
        sketch = h[:size].tolist()
        met = Counter(k for v in sketch for k in owners.get(v, ()))
        if 2 * max(met.values(), default=0) < max(1, len(sketch)):
            for v in sketch:
                owners.setdefault(v, []).append(len(kept))
            kept.append((text, y))
    return kept


def learn_lexicon(sample: list[tuple[str, int]], cfg: ToxicityConfig) -> tuple[list[str], list[str]]:
    """Words, and stems of at least three words, whose count in toxic texts stands out from that in the others.

    A stem may also stand out by the texts that hold ``family_words`` words of it, since ordinary texts may meet one by
    chance. Words of a chosen stem are left to the stem, whose edits are its own.
    """
    total = np.bincount([y for _, y in sample], minlength=2)
    words, stems, often, family = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter()), {}
    for text, y in sample:
        own = {t.strip(EDGE) for t in text.lower().split()} - {""}
        words[y].update(own)
        begun = Counter(w[:n] for w in own for n in (4, 5, 6) if len(w) > n)
        stems[y].update(begun.keys())
        often[y].update(s for s, n in begun.items() if n >= cfg.family_words)

    def stands_out(counts: tuple[Counter, Counter]) -> list[str]:
        kept = []
        for w, a in counts[1].items():
            b = counts[0][w] * total[1] / max(1, total[0])
            if a >= 4 and a >= cfg.purity * (a + b) and (a - b) / np.sqrt(a + b) >= min(cfg.least_z, np.sqrt(max(total[1], 1)) / 3):
                kept.append(w)
        return sorted(kept)

    chosen = stands_out(words)
    candidates = {*stands_out(stems), *stands_out(often)}
    for w in words[1]:
        for n in (4, 5, 6):
            if w[:n] in candidates and len(w) > n:
                family.setdefault(w[:n], set()).add(w)
    # A family is more than one word with its rare neighbours.
    kept = [s for s in sorted(candidates, key=len) if len(family.get(s, ())) >= 3 and max(words[1][w] for w in family[s]) < cfg.nearly * stems[1][s]]
    roots: list[str] = []
    for s in kept:
        if not any(s.startswith(k) or k.startswith(s) for k in roots):
            # As long as nearly all of its texts allow, to leave other words alone.
            roots.append(max((k for k in kept if k.startswith(s) and stems[1][k] >= cfg.nearly * stems[1][s]), key=len))
    return [w for w in chosen if len(w) > 2 and not any(w.startswith(s) for s in roots)], roots


@dataclass(frozen=True)
class ToxicityModel:
    words: list[str]
    stems: list[str]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel | None:
    """The lexicon from one half of the sample, weights from the other, then the lexicon from all of it.

    None without both classes. Calibration sees words that the lexicon did not, so misspelled and unseen
    terms get the weight that they earn.
    """
    sample, counts = labelled_sample(docs, labels, "toxic", cfg.per_class, cfg.sample_chars)
    sample = apart(sample)
    halves = [sample[::2], sample[1::2]]
    if any({y for _, y in half} != {0, 1} for half in halves):
        return None
    scanner = Scanner(Lexicon(*learn_lexicon(halves[0], cfg), cfg.remembered_states), cfg)
    x = np.array([scanner.evidence(t) for t, _ in halves[1]])
    y = np.array([y for _, y in halves[1]])
    weight = np.array([counts[k] for k in (0, 1)])[y] / np.bincount(y, minlength=2)[y]
    return ToxicityModel(*learn_lexicon(sample, cfg), logistic.fit(x, y, weight, ridge=0.1))


def toxicity(text: Column, model: ToxicityModel | None, cfg: ToxicityConfig = ToxicityConfig()) -> Column:
    """Probability that a text is labelled toxic; zero for all texts without a model."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = model and Scanner(Lexicon(model.words, model.stems, cfg.remembered_states), cfg)
        for texts in batches:
            if scanner is None or not len(texts):
                yield pa.array(np.zeros(len(texts)))
            else:
                x = np.array([scanner.evidence(t.as_py()) for t in texts])
                yield pa.array(logistic.predict(model.weights, x))

    return score(text)


def scores(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` (score of ``cut`` or more) of every row.

    Null and empty texts have no hit and share its score. Repeated rows are scored alike. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = docs.select(col(docs, id_col).alias("doc_id"), toxicity(col(docs, text_col), model, cfg).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cfg.cut).cast("int"))
