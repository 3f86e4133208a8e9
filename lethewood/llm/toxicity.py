"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes: insult, threat, suspect (often an insult, but
also seen in clean texts), target, negation, report, other.
Small transducers over that alphabet each keep one piece of context (is a negation in scope,
is the clause reported speech, was somebody addressed just before) and are composed into one
deterministic machine by their product; a second machine reads the clause backwards for a
target named after the insult. Every insult or threat leaves as an event marked with its
context, and a document's score is a logistic function of how often each event matched.

Insults are a public seed list plus words and word stems learned from labelled rows: the
smallest set of units that covers the toxic rows and (almost) never occurs in clean ones.
Toxic rows that this leaves open teach suspect units in the same way, which clean rows may
contain, but several times less often.
Learned units and event weights are fitted on at most ``sample_rows`` labelled rows, taken in
hash order; scoring covers every word of every text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lethewood.sources.scratch import Scratch

SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6, 7)
# A unit must occur in this many toxic sample rows, and in this many clean ones for each toxic
# one at most; a suspect unit must have this many times the share in toxic rows.
LEAST_ROWS = 8
MOST_CLEAN = 0.05
SUSPECT_LIFT = 3.0
MOST_UNITS = 400
# Name of the copied text column on its way to the tasks; it never leaves them.
_SPARE = "\u2581input"

# Fixed word lists; nothing is a suspect before it is learned.
INSULT, THREAT, SUSPECT, TARGET, NEGATION, REPORT, OTHER = range(7)
WORDS: dict[int, str] = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless trash clown "
    "disgusting dumb imbecile fool bastard bitch retard vermin filth "
    "dummkopf trottel arschloch abschaum blödmann idioten crétin connard salaud ordure imbécile "
    "abruti idiota estúpido estúpida imbécil basura gilipollas cabrón",
    THREAT: "kill murder hurt destroy strangle shoot stab beat "
    "töten umbringen vernichten erschießen tuer assassiner détruire matar asesinar destruir",
    TARGET: "you your yours yourself he she they them him her his their "
    "du dich dir dein deine ihr euch tu toi ton ta vous votre ils elles tú usted ustedes ellos tus",
    NEGATION: "not no never neither nor isn aren wasn don doesn didn without "
    "nicht kein keine nie niemals pas jamais aucun sans ni nunca jamás tampoco sin",
    REPORT: "said says say saying wrote writes called quoted quote claims claimed reported allegedly "
    "sagte sagt schrieb behauptet zitiert dit disait écrit affirme dijo dice escribió afirma",
}
CLASS = {word: kind for kind, words in WORDS.items() for word in words.split()}

# Letters and bytes beyond ASCII stay, clause ends become line breaks, the rest spaces.
_TABLE = bytes(
    b if b >= 128 or chr(b).isalpha() else 10 if chr(b) in ".!?;\n" else 32 for b in range(256)
)


@dataclass(frozen=True)
class Transducer:
    """Raises ``mark`` for ``reach`` words after a word of class ``trigger`` (to the end of the
    clause if ``reach`` is zero). The state is the number of words left."""

    trigger: int
    mark: int
    reach: int

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        output = self.mark if state else 0
        if symbol == self.trigger:
            return (self.reach or 1), output
        return (max(0, state - 1) if self.reach else state), output


NEGATED, REPORTED, ADDRESSED, AIMED = 1, 2, 4, 8
FORWARD = (
    Transducer(NEGATION, NEGATED, 4),
    Transducer(REPORT, REPORTED, 0),
    Transducer(TARGET, ADDRESSED, 5),
)
BACKWARD = (Transducer(TARGET, AIMED, 4),)
EVENTS = 48  # insult, threat or suspect, times sixteen contexts


def compose(machines: tuple[Transducer, ...]) -> list[list[tuple[int, int]]]:
    """The product machine: for each state and symbol, (next state, union of marks)."""
    start = (0,) * len(machines)
    number, order, table = {start: 0}, [start], []
    for state in order:
        row = []
        for symbol in range(OTHER + 1):
            steps = [m.step(s, symbol) for m, s in zip(machines, state, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append((number[after], sum(mark for _, mark in steps)))
        table.append(row)
    return table


@dataclass
class Grammar:
    """Learned units (a word ends in a space, a stem does not) on top of the fixed classes, and
    the composed machines."""

    units: dict[bytes, int] = field(default_factory=dict)
    forward: list = field(default_factory=lambda: compose(FORWARD))
    backward: list = field(default_factory=lambda: compose(BACKWARD))

    def __post_init__(self) -> None:
        self.classes = {u[:-1]: k for u, k in self.units.items() if u.endswith(b" ")}
        self.classes |= {w.encode(): k for w, k in CLASS.items()}
        self.stems = {u: k for u, k in self.units.items() if not u.endswith(b" ")}
        self.core = frozenset(w for w, k in self.classes.items() if k <= SUSPECT)
        self.lengths = sorted({len(s) for s in self.stems})

    def symbol(self, word: bytes) -> int:
        kind = self.classes.get(word)
        if kind is not None:
            return kind
        return min((self.stems.get(word[:n], OTHER) for n in self.lengths), default=OTHER)

    def events(self, text: str | None) -> Counter[int]:
        """How often each event occurs in the whole text, and under ``EVENTS`` the number of
        its words. A text without an insult, threat or suspect has none, which a look at its
        distinct words tells."""
        if not text:
            return Counter()
        flat = text.lower().encode().translate(_TABLE)
        distinct = set(flat.split())
        if self.core.isdisjoint(distinct) and not any(
            not self.stems.keys().isdisjoint({w[:n] for w in distinct}) for n in self.lengths
        ):
            return Counter()
        found: Counter[int] = Counter()
        for clause in flat.split(b"\n"):
            tags = [self.symbol(word) for word in clause.split()]
            found[EVENTS] += len(tags)
            if min(tags, default=OTHER) > SUSPECT:
                continue
            marks, state = [], 0
            for tag in tags:
                state, mark = self.forward[state][tag]
                marks.append(mark)
            state = 0
            for at in range(len(tags) - 1, -1, -1):
                state, mark = self.backward[state][tags[at]]
                if tags[at] <= SUSPECT:
                    found[16 * tags[at] + (marks[at] | mark)] += 1
        return found


def _prior() -> np.ndarray:
    """Weights before any label: context raises or lowers what an event counts."""
    out = np.zeros(EVENTS + 2)
    out[EVENTS + 1] = -3.0
    for event in range(EVENTS):
        out[event] = (
            1.0
            + 1.0 * bool(event & (ADDRESSED | AIMED))
            - 1.0 * bool(event & NEGATED)
            - 0.5 * bool(event & REPORTED)
            - 0.5 * (event // 16)
        )
    return out


def fit_weights(counts: np.ndarray, labels: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression on log counts by Newton steps, pulled towards the prior weights.
    ``counts`` has a column per event and one for the words of texts with events, so that a
    match weighs less in a long text."""
    x = np.column_stack([np.log1p(counts), np.ones(len(counts))])
    prior = weights = _prior()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - labels * z).sum() + ridge / 2 * ((w - prior) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - labels) + ridge * (weights - prior)
        curve = (x.T * (p * (1 - p))) @ x + ridge * np.eye(x.shape[1])
        step, before = np.linalg.solve(curve, slope), loss(weights)
        while loss(weights - step) > before and np.abs(step).max() > 1e-9:
            step = step / 2
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return weights


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        total = self.weights[EVENTS + 1]
        for event, count in sorted(self.grammar.events(text).items()):
            total += self.weights[event] * math.log1p(count)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _units(text: str | None) -> set[bytes]:
    """Distinct words (ending in a space) and word stems of a text."""
    words = set((text or "").lower().encode().translate(_TABLE).split())
    return {w + b" " for w in words if len(w) >= STEMS[0]} | {w[:n] for n in STEMS for w in words if len(w) > n}


def _learn_units(sample: DataFrame) -> dict[bytes, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter[bytes] = Counter()
            clean: Counter[bytes] = Counter()
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                (toxic if label.as_py() else clean).update(_units(text.as_py()))
            units = list(toxic | clean)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(units, pa.binary()),
                    pa.array([toxic[u] for u in units], pa.int64()),
                    pa.array([clean[u] for u in units], pa.int64()),
                ],
                names=["unit", "toxic", "clean"],
            )

    rows = sample.select("text", "label")
    sizes = rows.agg(F.sum("label").alias("toxic"), F.count("label").alias("rows")).first()
    toxic_total = sizes["toxic"] or 0
    clean_rows = sizes["rows"] - toxic_total
    candidates = {
        bytes(r["unit"]): (r["toxic"], r["clean"])
        for r in rows.mapInArrow(count, "unit binary, toxic bigint, clean bigint")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(
            (F.col("toxic") >= LEAST_ROWS)
            & (F.col("clean") * toxic_total * SUSPECT_LIFT <= F.col("toxic") * clean_rows)
        )
        .orderBy(F.desc("toxic"), "unit")
        .limit(50 * MOST_UNITS)
        .collect()
    }
    if not candidates:
        return {}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(candidates.keys() & _units(text.as_py())) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["units"])

    toxic_rows = rows.where("label = 1").distinct().mapInArrow(present, "units array<binary>")
    holding: dict[bytes, set[int]] = {}
    for number, row in enumerate(toxic_rows.collect()):
        for unit in row["units"]:
            holding.setdefault(bytes(unit), set()).add(number)

    strong = [u for u in holding if candidates[u][1] <= MOST_CLEAN * candidates[u][0]]
    chosen = dict.fromkeys(_cover({u: holding[u] for u in strong}, lambda u, rows_: len(rows_)), INSULT)
    covered = set().union(*(holding[u] for u in chosen))
    weak = {u: left for u in holding if u not in chosen and (left := holding[u] - covered)}

    def gain(unit: bytes, rows_: set[int]) -> float:
        return len(rows_) * math.log(len(rows_) * clean_rows / ((candidates[unit][1] + 1) * toxic_total))

    return chosen | dict.fromkeys(_cover(weak, gain), SUSPECT)


def _cover(holding: dict[bytes, set[int]], gain: Callable[[bytes, set[int]], float]) -> list[bytes]:
    """Units that together hold the most rows, greedily; of equal ones the longest."""
    chosen: list[bytes] = []
    while holding and len(chosen) < MOST_UNITS:
        best = max(holding, key=lambda u: (gain(u, holding[u]), len(u), u))
        taken = holding[best]
        if len(taken) < LEAST_ROWS or gain(best, taken) <= 0:
            break
        chosen.append(best)
        holding = {u: left for u, rows_ in holding.items() if len(left := rows_ - taken) >= LEAST_ROWS}
    return chosen


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, label) of at most ``sample_rows`` labelled documents, one row per id. The ids are
    drawn first, in the order of their hash; being few, they go to the documents, so that no
    other text is moved. Of repeated labels of an id the largest counts, of repeated documents
    the smallest text. Null ids and labels are left out."""
    drawn = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("text", "label")
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``docs``: (doc_id, text); ``labels``: (doc_id, toxic 0/1). At most ``sample_rows``
    labelled rows teach the units and weights. Without any, the model has the seed lists and
    prior weights."""
    scratch = Scratch(docs.sparkSession)
    sample = scratch.write(labelled_sample(docs, labels, sample_rows).repartition(16), "labelled")
    grammar = Grammar(_learn_units(sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple] = Counter()
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                found = grammar.events(text.as_py())
                seen[(label.as_py(), *(found[e] for e in range(EVENTS + 1)))] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(key) for key, n in seen.items() for _ in range(n)], pa.list_(pa.int32()))],
                names=["row"],
            )

    rows = [r["row"] for r in sample.mapInArrow(count, "row array<int>").collect()]
    table = np.array(sorted(rows), np.float64).reshape(-1, EVENTS + 2)
    return Model(grammar, fit_weights(table[:, 1:], table[:, 0]))


def score_documents(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity"
) -> DataFrame:
    """``docs`` with ``score_col`` double, from 0 to 1. Null and empty texts get the score of a
    text without events. All rows and other columns are kept; a column named like
    ``score_col`` is replaced."""
    kept = docs.drop(score_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], score_col]
            )

    out = StructType([*kept.schema.fields, StructField(score_col, DoubleType())])
    return docs.select(*kept.columns, F.col(text_col).alias(_SPARE)).mapInArrow(scan, out)

