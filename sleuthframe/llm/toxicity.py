"""Toxicity: weighted finite-state transducers over the words of clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.quality import bounded_sample
from sleuthframe.plans.lineage import materialise

#: Labelled rows that lexicon and weights are fitted on, at most.
MAX_ROWS = 16_000
#: Lengths of stems that may be learned, how often a toxic text may be explained, and by how many texts an entry earns its place.
STEMS, EXPLAINED, LEAST_GAIN = range(3, 8), 12, 3
#: Most clean texts that an insult may be in, and that a slur may be in twice within REACH clauses, for each toxic one.
MOST_CLEAN, MOST_CHAINED = 0.02, 0.2
#: Clauses after a slur within which another one counts as more than chance.
REACH = 8
#: From this score on a document is toxic.
THRESHOLD = 0.3

# Words of the grammar.
INSULTS = frozenset(
    "arsehole asshole bastard bitch clown coward cretin degenerate disgusting dumbass dumb fool freak fuckwit garbage idiot idiotic imbecile jackass jerk liar loser losers moron moronic "
    "morons pathetic pig prick scum scumbag shithead slob stupid trash vermin worthless abruti connard crétin débile idiote imbécile minable ordure salope abschaum arschloch blöd dumm dummkopf "
    "drecksack idioten trottel versager basura cabrón estúpido estúpida gilipollas idiota imbécil inútil maldito".split()
)
THREATS = frozenset("kill hurt murder destroy stab shoot strangle beat crush hunt tuer frapper détruire töten schlagen vernichten umbringen matar golpear destruir".split())
TARGETS = frozenset("you your you're youre yourself u ur he she they them him her these those people tu te toi vous ton votre ils elles du dich dir ihr euch sie tú usted ustedes vosotros ellos ellas".split())
NEGATIONS = frozenset("not never no nor neither without isn't aren't wasn't don't doesn't didn't cannot can't won't isnt arent wasnt dont jamais aucun nunca jamás tampoco kein keine keinen niemals nicht".split())
REPORTS = frozenset("said says say saying called calls calling claimed claims reported reports wrote writes quoted quote quotes told tells alleged accused word words term dit disait appelé sagte sagt schrieb nannte dijo dice llamó escribió".split())
WILLS = frozenset("will shall gonna going i'll we'll ill vais allons werde werden voy vamos".split())

_CLAUSE = re.compile(r"[.;:!?\n\r]+|,\s|[\"“”«»]|[^\W\d_]+(?:['’][^\W\d_]+)?")
_PART = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

# --- transducers -------------------------------------------------------------------------------------------------

#: Tags of words, the alphabet of the grammar. A slur is a word that clean texts may hold by chance.
TAGS = ("other", "insult", "slur", "threat", "target", "negation", "report", "will", "quote", "end")
#: What a matched clause is, with the weight that its arc has before labels are seen.
KINDS = {"bare": 3.0, "targeted": 4.0, "threat": 4.0, "negated": 0.5, "reported": 0.5, "chained": 3.0, "lone": 0.2}
BIAS = -4.0


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over TAGS: named states, first state, step(state, tag) -> state."""

    start: object
    step: Callable[[object, str], object]

    def states(self) -> list:
        """All states that can be reached."""
        found, todo = [self.start], [self.start]
        while todo:
            for state in {self.step(todo[-1], tag) for tag in TAGS} - set(found):
                found.append(state)
                todo.insert(0, state)
            todo.pop()
        return found


def fading(tag: str, span: int) -> Transducer:
    """On for ``span`` words after ``tag``, off at the clause's end."""
    return Transducer(0, lambda s, t: span if t == tag else 0 if t == "end" else max(0, s - 1))


#: The parts of the grammar: a negation reaches four words far, a report to the clause's end or through its quotation, a target six words, a slur REACH clauses.
NEGATION = fading("negation", 4)
TARGET = fading("target", 6)
THREAT = Transducer("", lambda s, t: "" if t == "end" else "will" if t == "will" else "act" if s == "will" and t == "threat" else "done" if s == "act" and t == "target" else "" if s == "done" else s)
CHAIN = Transducer(0, lambda s, t: REACH + 1 if t == "slur" else s - 1 if t == "end" and s else s)
REPORT = Transducer("", lambda s, t: "said" if t == "report" and s != "quoted" else "quoted" if t == "quote" and s == "said" else "" if t == "quote" and s == "quoted" else "" if t == "end" and s == "said" else s)


def compose(*parts: Transducer) -> tuple[list[tuple], np.ndarray]:
    """The product of transducers: its states and a (state, tag) table of the next state."""
    states = list(product(*(p.states() for p in parts)))
    states.insert(0, states.pop(states.index(tuple(p.start for p in parts))))
    number = {s: i for i, s in enumerate(states)}
    table = np.array([[number[tuple(p.step(x, tag) for p, x in zip(parts, s, strict=True))] for tag in TAGS] for s in states])
    return states, table


def _grammar() -> tuple[list[list[int]], list[list[int]]]:
    """Next state, and the number of the kind that the arc matches (-1 if none), by state and tag."""
    states, table = compose(NEGATION, TARGET, THREAT, CHAIN, REPORT)
    kinds, number = [], {k: i for i, k in enumerate(KINDS)}
    for state, after in zip(states, table, strict=True):
        negated, targeted, chained, reported = state[0] > 0, state[1] > 0, state[3] > 0, state[4] != ""
        row = [-1] * len(TAGS)
        for i, (tag, to) in enumerate(zip(TAGS, after, strict=True)):
            threat = states[to][2] == "done"
            if tag == "insult" or threat:
                row[i] = number["reported" if reported else "negated" if negated else "threat" if threat else "targeted" if targeted else "bare"]
            elif tag == "slur":
                row[i] = number["chained" if chained else "lone"]
        kinds.append(row)
    return table.tolist(), kinds


_NEXT, _KIND = _grammar()
_TAG = {tag: i for i, tag in enumerate(TAGS)}


@dataclass
class Lexicon:
    """Insults beside the fixed ones, whole words and stems (that longer words begin with); and slurs, words and stems that only tell in company."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    slurs: frozenset[str] = frozenset()

    def tag(self, word: str) -> str:
        if word in INSULTS or word in self.words or any(word[:k] in self.stems for k in STEMS if len(word) > k):
            return "insult"
        if word in self.slurs or any(word[:k] + "*" in self.slurs for k in STEMS if len(word) > k):
            return "slur"
        for tag, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("will", WILLS)):
            if word in words:
                return tag
        return "other"


class Matcher:
    """How many arcs of a whole text match as each of KINDS.

    Arcs carry the weight of their kind, and of the arcs that match in a clause
    the heaviest says what all of them count as. A text without any insult, slur
    or threat costs one look at its different words.
    """

    MOST_KNOWN = 400_000

    def __init__(self, lexicon: Lexicon, weights: tuple[float, ...] = tuple(KINDS.values())):
        self.lexicon = lexicon
        self.arcs = [[weights[k] if k >= 0 else 0.0 for k in row] for row in _KIND]
        self.harmless: set[str] = set()

    def _may_match(self, text: str) -> bool:
        fresh = set(text.split()) - self.harmless
        clean = []
        for chunk in fresh:
            if any(self.lexicon.tag(w) in ("insult", "slur", "threat") for w in _PART.findall(chunk)):
                return True
            clean.append(chunk)
        if len(self.harmless) + len(clean) <= self.MOST_KNOWN:
            self.harmless.update(clean)
        return False

    def counts(self, text: str | None) -> list[int]:
        text = (text or "").lower()
        found = [0] * len(KINDS)
        if not self._may_match(text):
            return found
        state, tag, end = 0, self.lexicon.tag, _TAG["end"]
        known: dict[str, int] = {}
        best, heaviest, hits = -1, -math.inf, 0
        for m in _CLAUSE.finditer(text):
            piece = m[0]
            symbol = known.get(piece)
            if symbol is None:
                first = piece[0]
                name = "end" if first in ".,;:!?\n\r" else "quote" if first in "\"“”«»" else tag(piece.replace("’", "'"))
                symbol = known[piece] = _TAG[name]
            if (kind := _KIND[state][symbol]) >= 0:
                hits += 1
                if self.arcs[state][symbol] > heaviest:
                    best, heaviest = kind, self.arcs[state][symbol]
            state = _NEXT[state][symbol]
            if symbol == end and hits:
                found[best] += hits
                best, heaviest, hits = -1, -math.inf, 0
        if hits:
            found[best] += hits
        return found


#: In front of an entry: it comes again within REACH clauses.
CHAINED = "+"

# --- fitting -----------------------------------------------------------------------------------------------------


def _forms(word: str) -> list[str]:
    """A word, and its stems with a star."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def entries(text: str | None, wanted: frozenset[str] | None = None) -> set[str]:
    """Words and stems of a text (those ``wanted``); with CHAINED in front, those that come again within REACH clauses."""
    found, last, known, clause = set(), {}, {}, 0
    for m in _CLAUSE.finditer((text or "").lower()):
        piece = m[0]
        if piece[0] in ".,;:!?\n\r":
            clause += 1
            continue
        forms = known.get(piece)
        if forms is None:
            forms = known[piece] = [f for f in _forms(piece) if wanted is None or f in wanted or CHAINED + f in wanted]
        for f in forms:
            if clause - last.get(f, -REACH - 1) <= REACH:
                found.add(CHAINED + f)
            last[f] = clause
            found.add(f)
    return found if wanted is None else found & wanted


def telling(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> set[str]:
    """Entries that chance hardly puts into so many toxic and so few clean texts, as many entries as are tried."""
    base = n_toxic / max(1, n_toxic + n_clean)
    bar = math.log(len(toxic) + 1) + 2.0

    def tells(e: str, n: int, c: int) -> bool:
        q = n / (n + c)
        most = MOST_CHAINED if e.startswith(CHAINED) else MOST_CLEAN
        return c <= most * n and n * math.log(q / base) + (c * math.log((1 - q) / (1 - base)) if c else 0.0) >= bar

    return {e for e, n in toxic.items() if tells(e, n, clean.get(e, 0))}


def cover(toxic: list[set[str]]) -> set[str]:
    """Of each toxic text's telling entries those that explain the texts.

    Greedy: each time the entry (of two alike the longer) that explains most of
    the texts not yet explained EXPLAINED times.
    """
    count = Counter(e for doc in toxic for e in doc)
    where: dict[str, list[int]] = {}
    for i, doc in enumerate(toxic):
        for e in doc:
            where.setdefault(e, []).append(i)
    left, gain, picked = [EXPLAINED] * len(toxic), {e: len(d) for e, d in where.items()}, set()
    while gain:
        best = max(gain, key=lambda e: (gain[e], len(e), e))
        if gain.pop(best) < LEAST_GAIN:
            break
        if any(best.rstrip("*").startswith(p[:-1]) for p in picked if p[-1] == "*"):
            continue  # a stem has it already
        if best[-1] == "*" and any(p.startswith(best[:-1]) and count[p] == count[best] for p in picked):
            continue  # the same texts have a longer entry
        picked.add(best)
        for i in where[best]:
            left[i] -= 1
            if left[i] == 0:
                for e in toxic[i] & gain.keys():
                    gain[e] -= 1
    return picked


def choose(toxic: list[set[str]]) -> Lexicon:
    """Insults and slurs that explain the toxic texts, given the telling entries of each.

    A slur is an entry that tells when it comes again but not alone; a word that a
    slur's stem has is no insult of its own, as chance gives clean texts some.
    """
    alone = {e for doc in toxic for e in doc if not e.startswith(CHAINED)}
    slurs = cover([{e[len(CHAINED) :] for e in doc if e.startswith(CHAINED)} - alone for doc in toxic])
    stems = tuple(s[:-1] for s in slurs if s[-1] == "*")
    insults = cover([{e for e in doc if not e.startswith(CHAINED) and not e.startswith(stems)} for doc in toxic])
    return Lexicon(frozenset(p for p in insults if p[-1] != "*"), frozenset(p[:-1] for p in insults if p[-1] == "*"), frozenset(slurs))


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Bias and arc weights by kind, each for the logarithm of 1 + the arcs matched as the kind: logistic regression with a normal prior around KINDS."""
    prior = np.array([BIAS, *KINDS.values()])
    a, w = np.insert(np.log1p(x), 0, 1.0, axis=1), prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(w)), a.T @ (p - y) + (w - prior))
    return w


@dataclass
class Model:
    """A lexicon, and the bias and weights of the arcs."""

    lexicon: Lexicon
    weights: np.ndarray

    def matcher(self) -> Matcher:
        return Matcher(self.lexicon, tuple(self.weights[1:].tolist()))

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.insert(np.log1p(counts), 0, 1.0, axis=1) @ self.weights)))


def fit(sample: DataFrame) -> Model:
    """Lexicon and weights from a bounded sample (``text``, ``y``).

    Equal texts count once. Candidates come from the toxic texts; tasks count
    them in the clean ones. Without toxic rows the grammar's own words and
    weights remain.
    """
    sample = materialise(sample.select("text", "y").groupBy("text").agg(F.max("y").alias("y")))

    def candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"found": [list(entries(t if isinstance(t, str) else None)) for t in frame["text"]]})

    toxic_sets = materialise(sample.where("y = 1").mapInPandas(candidates, "found array<string>"))
    n_toxic, n_clean = toxic_sets.count(), sample.where("y = 0").count()
    frequent = toxic_sets.select(F.explode("found").alias("e")).groupBy("e").count().where(F.col("count") >= LEAST_GAIN)
    frequent = {r["e"]: r["count"] for r in frequent.toLocalIterator()}  # of a bounded sample
    share = sample.sparkSession.sparkContext.broadcast
    wanted = share(frozenset(frequent))

    def clean_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = Counter()
        for frame in frames:
            for t in frame["text"]:
                counted.update(entries(t if isinstance(t, str) else None, wanted.value))
        yield pd.DataFrame({"e": list(counted), "n": list(counted.values())}).astype({"e": str, "n": "int64"})

    clean = sample.where("y = 0").mapInPandas(clean_counts, "e string, n long").groupBy("e").agg(F.sum("n").alias("n"))
    allowed = share(telling(frequent, {r["e"]: r["n"] for r in clean.toLocalIterator()}, n_toxic, n_clean))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"found": [[e for e in found if e in allowed.value] for found in frame["found"]]})

    lexicon = choose([set(r["found"]) for r in toxic_sets.mapInPandas(keep, "found array<string>").collect()])

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for frame in frames:
            yield pd.DataFrame({"x": [matcher.counts(t if isinstance(t, str) else None) for t in frame["text"]], "y": frame["y"]})

    got = sample.mapInPandas(counts, "x array<int>, y int").toPandas()
    x = np.stack(got["x"].tolist()) if len(got) else np.zeros((0, len(KINDS)))
    return Model(lexicon, fit_weights(x.astype(float), got["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of toxicity scores of their whole ``text``, 0 to 1.

    Null and empty texts have the score of a text without any match. Other
    columns pass through; repeated rows get equal scores; an empty table stays
    empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = shared.value.matcher()
        for batch in batches:
            x = np.array([matcher.counts(t if isinstance(t, str) else None) for t in batch], float).reshape(-1, len(KINDS))
            yield pd.Series(shared.value.score(x))

    return docs.withColumn(name, rate("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, learns: Column, most: int = MAX_ROWS) -> DataFrame:
    """A bounded sample of ``text, y`` for which ``learns`` holds; its ids are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded_sample(known.where(learns), "doc_id", most)), "doc_id")
