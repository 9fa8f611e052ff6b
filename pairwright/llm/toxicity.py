"""Toxicity by a weighted finite-state grammar over clauses.

Letters: a lexical transducer reads a word and gives its class and weight.  Insults and their
weights are learned from labelled rows: whole words and word beginnings that toxic texts assert
more often (what is negated or reported is no evidence).  Threats (with their inflections), targets, negations and reports are short fixed lists; a threat that the
labelled texts use but not in toxic ones (such as "die", an article in German) is none there, and
one that they use has its learned weight if that is above ``THREAT_WEIGHT``.

Clauses: small transducers (negation, report, target, pending threat, insult or threat) read the
classes of a clause's words; their composition is one table of states.  An insult or threat leaves
it in a category: plain, aimed at a target, negated, or reported.  A threat's target stands before
the verb ("they will kill") or, for verbs that take an object, after it ("I will kill you"); a
threat verb that labels also tell to be toxic counts as an insult where it has no target.  A clause's score is the weight
of its matches by category; a document's figures are the sums, the best clause and the share
of matched clauses; logistic regression on these figures, fitted on the same bounded sample,
gives the score: the probability of label 1 at the sample's share of it.

Texts are read whole, whatever their length.  Nulls: a null text counts as empty (no matches); a null doc_id stays null and its held_out is
null.  Repeated rows each get their row; an empty table gives none; without labelled rows of
both classes every score is 0.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, labelled

#: At most so many labelled rows of each class are used to fit.
SAMPLE_ROWS = {0: 6000, 1: 4000}
THRESHOLD = 0.5
#: Beginnings of words that can be learned, in bytes.
BEGINNINGS = (5, 6, 7, 8, 9, 10)
#: A learned entry is in so many toxic texts of the sample at least, and has that log-odds.
LEAST_TEXTS, LEAST_ODDS = 4, 2.0
#: Weight of a threat without a greater learned one, and the log-odds below which a threat in LEAST_TEXTS texts is none.
THREAT_WEIGHT, LEAST_THREAT_ODDS = 3.0, 1.0
#: Words between an operator of the grammar and what it governs.
SCOPE = 4

# The closed classes of the grammar.
THREATS = (
    "kill kills killed killing murder murders murdered murdering hurt hurts hurting destroy destroys destroyed destroying beat beats beating shoot shoots shot shooting stab stabs stabbed stabbing burn burns burned burning strangle strangles strangled strangling die "
    "töten töte tötet tötest getötet umbringen umgebracht ermorden ermordet zerstören zerstöre zerstört erschießen erschießt erstechen "
    "tuer tue tues tuerai tuera tueront tué détruire détruirai détruira détruit frapper frapperai assassiner assassiné "
    "matar mataré matará matarán matado matarte asesinar asesinado destruir destruiré destruirá golpear golpearé"
).split()
#: Threats that take no object: a target after them is not what they threaten.
LONE_THREATS = frozenset(["die"])
TARGETS = "you your yours he him she her they them u du dich ihr euch tu te toi vous usted ustedes ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca tampoco".split()
REPORTS = "said says say told called calls wrote writes quoted reported sagte schrieb dit écrit dijo escribió".split()

#: Letters; the learned ones are threats that are in the learned lexicon too.
GAP, TARGET, NEGATION, REPORT, THREAT, INSULT, LONE_THREAT, LEARNED_THREAT, LEARNED_LONE = LETTERS = range(9)
_LEARNED = {THREAT: LEARNED_THREAT, LONE_THREAT: LEARNED_LONE}
CATEGORIES = ("plain", "aimed", "negated", "reported", "threat")
#: What a target gives after a pending threat: the category "threat" for the verb.
_OF_VERB = 5


def _component(on: int, off: int | None) -> dict[tuple[int, int], int]:
    """A transducer of two states: ``on`` raises it, ``off`` lowers it, all else keeps it."""
    return {(s, c): 1 if c == on else 0 if c == off else s for s in (0, 1) for c in LETTERS}


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The composed transducer: next state and emitted category (-1: none) by state and class.

    States are the product of negation, report, target and pending threat; a gap in the clause
    ends the reach of all but the report, which governs the rest of its clause.  A threat without
    a target so far is pending, and the next target within reach makes it one.
    """
    parts = (_component(NEGATION, GAP), _component(REPORT, None), _component(TARGET, GAP))
    states = list(product((0, 1), repeat=4))
    step, emit = np.zeros((16, 9), np.int8), np.full((16, 9), -1, np.int8)
    for k, state in enumerate(states):
        negated, reported, aimed, pending = state
        asserted = not negated and not reported
        insult = 3 if reported else 2 if negated else 1 if aimed else 0
        threat = 4 if aimed and asserted else -1
        emit[k, INSULT] = insult
        emit[k, [THREAT, LONE_THREAT]] = threat
        emit[k, [LEARNED_THREAT, LEARNED_LONE]] = max(threat, insult)
        emit[k, TARGET] = _OF_VERB if pending and asserted else -1
        for c in LETTERS:
            waits = int(threat < 0 and asserted) if c in (THREAT, LEARNED_THREAT) else 0 if c in (TARGET, GAP) else pending
            step[k, c] = states.index((*(p[s, c] for p, s in zip(parts, state, strict=False)), waits))
    return step, emit


_STEP, _EMIT = compose()


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(kernel.hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def _unsigned(h: int) -> int:
    return int(np.int64(h).astype(np.uint64))


@dataclass
class Lexicon:
    """Sorted hashes of entries with class and weight; a table of their low bits comes first."""

    whole: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    beginning: np.ndarray
    odds: np.ndarray

    def __post_init__(self) -> None:
        self.seen_whole, self.seen_beginning = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.seen_whole[self.whole & np.uint64(0xFFFF)] = True
        self.seen_beginning[self.beginning & np.uint64(0xFFFF)] = True


def _find(keys: np.ndarray, h: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of h that are among sorted keys, and where."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.flatnonzero(seen[h & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    ok = keys[at] == h[maybe]
    return maybe[ok], at[ok]


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


#: Bytes of words for the grammar: letters, digits, non-ASCII characters and the apostrophe.
_WORD = kernel.WORDISH.copy()
_WORD[0x27] = True
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in '.,;:!?()"\n']] = True


def _words(buf: np.ndarray, offsets: np.ndarray):
    start, end, rows = kernel.spans(buf, offsets, _WORD)
    return start, end, rows, kernel.hash_spans(buf, start, end)


def _beginnings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of more than n bytes, and the hashes of their first n, for each n."""
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        yield long, kernel.hash_spans(buf, start[long], start[long] + n)


FIGURES = (*(f"log_{c}" for c in CATEGORIES), "best_clause", "share", "matches")


def figures(buf: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(rows, len(FIGURES)): what the grammar finds in each text (already lower-cased)."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FIGURES)))
    start, end, rows, h = _words(buf, offsets)
    if not len(start):
        return out
    kind, weight = np.zeros(len(h), np.int8), np.zeros(len(h))
    for (long, short), _ in zip(_beginnings(buf, start, end), BEGINNINGS, strict=True):
        found, at = _find(lexicon.beginning, short, lexicon.seen_beginning)
        kind[long[found]], weight[long[found]] = INSULT, lexicon.odds[at]
    found, at = _find(lexicon.whole, h, lexicon.seen_whole)
    whole, own_weight, begun = lexicon.kind[at], lexicon.weight[at], kind[found] == INSULT
    for threat, learned in _LEARNED.items():  # a learned beginning stands beside a threat too
        both = begun & (whole == threat)
        whole, own_weight = np.where(both, learned, whole), np.where(both, weight[found], own_weight)
    kind[found], weight[found] = whole, own_weight
    stops = np.cumsum(_CLAUSE_END[buf])
    clause_of = stops[start] + rows  # a clause ends with its row too
    at = np.flatnonzero(kind)
    if not len(at):
        return out
    clause, place, kinds = clause_of[at], at, kind[at]
    new = np.ones(len(at), bool)
    new[1:] = clause[1:] != clause[:-1]
    gap = np.zeros(len(at), bool)
    gap[1:] = ~new[1:] & (place[1:] - place[:-1] > SCOPE)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    emitted = np.full(len(at), -1, np.int8)
    # All clauses take their k-th step together; the state table is the composed transducer.
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    state, verb = np.zeros(len(first), np.int8), np.zeros(len(first), np.int64)
    for k in range(int(size[0])):
        live = int(np.searchsorted(-size, -k, "left"))
        here = first[:live] + k
        s = state[:live]
        s = np.where(gap[here], _STEP[s, GAP], s)
        got = _EMIT[s, kinds[here]]
        of_verb = got == _OF_VERB
        emitted[here] = np.where(of_verb, -1, got)
        emitted[verb[:live][of_verb]] = 4
        verb[:live] = np.where((kinds[here] == THREAT) | (kinds[here] == LEARNED_THREAT), here, verb[:live])
        state[:live] = _STEP[s, kinds[here]]
    hit = np.flatnonzero(emitted >= 0)
    if not len(hit):
        return out
    own, w = rows[at[hit]], weight[at[hit]]
    for c in range(len(CATEGORIES)):
        mine = emitted[hit] == c
        out[:, c] = np.log1p(np.bincount(own[mine], w[mine], n))
    clauses, inverse = np.unique(clause[hit], return_inverse=True)
    of_clause = np.bincount(inverse, w * np.where((emitted[hit] == 2) | (emitted[hit] == 3), 0.5, 1.0))
    clause_row = np.zeros(len(clauses), np.int64)
    clause_row[inverse] = own
    np.maximum.at(out[:, 5], clause_row, of_clause)
    n_clauses = np.bincount(rows[np.flatnonzero(np.diff(clause_of, prepend=-1))], minlength=n)
    matched = np.bincount(clause_row, minlength=n)
    out[:, 6] = np.sqrt(matched / np.maximum(n_clauses, 1))
    out[:, 7] = np.log1p(np.bincount(own, minlength=n))
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, is_beginning, label) once for each text of the sample and each word or beginning that it asserts.

    What a negation or a report governs says nothing about the words in it: only asserted uses are evidence for or against.
    """
    negations, reports = (np.array(sorted(map(_word_hash, words)), np.uint64) for words in (NEGATIONS, REPORTS))
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offsets = kernel.utf8(lower(batch.column(1)))
        for a, b in kernel.chunks(offsets):
            part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            start, end, rows, h = _words(part, at)
            if not len(h):
                continue
            clause, place = np.cumsum(_CLAUSE_END[part])[start] + rows, np.arange(len(h))
            asserted = np.ones(len(h), bool)
            for words, reach in ((negations, SCOPE), (reports, len(h))):
                last = np.maximum.accumulate(np.where(np.isin(h, words), place, -1))
                asserted &= (last < 0) | (clause[last] != clause) | (place - last > reach) | (place == last)
            start, end, rows, h = start[asserted], end[asserted], rows[asserted], h[asserted]
            for beginning, own, hashes in ((False, rows, h), *((True, rows[long], short) for long, short in _beginnings(part, start, end))):
                key, row = kernel.unique_in_rows(hashes, own)
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(key)), pa.array(np.full(len(key), beginning)), pa.array(labels[a + row].astype(np.int32))], ["h", "beginning", "label"])


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    spread: np.ndarray
    coefficients: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + (x - self.mean) / self.spread @ self.coefficients, -500, 500)))


def learn_lexicon(rows: DataFrame) -> tuple[Lexicon, int]:
    """Entries of the insult transducer; rows: the bounded sample (label, text)."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    fixed = {_word_hash(w): kind for words, kind in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
    fixed |= {_word_hash(w): LONE_THREAT for w in LONE_THREATS}
    learned: list = []
    used: dict[int, tuple[int, float]] = {}  # threats that the sample uses: texts and log-odds
    if toxic and clean:
        n = rows.mapInArrow(_entries, "h long, beginning boolean, label int").groupBy("h", "beginning").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        threats = ~F.col("beginning") & F.col("h").isin([int(np.uint64(h).astype(np.int64)) for h, kind in fixed.items() if kind in _LEARNED])
        found = n.withColumn("odds", odds).filter(((F.col("toxic") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)) | threats).collect()  # at most the words of the bounded sample
        learned = [r for r in found if r["toxic"] >= LEAST_TEXTS and r["odds"] >= LEAST_ODDS]
        used = {_unsigned(r["h"]): (r["toxic"] + r["clean"], r["odds"]) for r in found if not r["beginning"]}
    whole = {_unsigned(r["h"]): (INSULT, r["odds"]) for r in learned if not r["beginning"]}
    for h, kind in fixed.items():
        if kind not in _LEARNED:
            whole[h] = (kind, 1.0)
        elif h in whole:
            whole[h] = (_LEARNED[kind], max(whole[h][1], THREAT_WEIGHT))
        else:
            texts, odds = used.get(h, (0, 0.0))
            if texts < LEAST_TEXTS or odds >= LEAST_THREAT_ODDS:
                whole[h] = (kind, THREAT_WEIGHT)
    beginning = {_unsigned(r["h"]): r["odds"] for r in learned if r["beginning"]}
    w, b = sorted(whole), sorted(beginning)
    return Lexicon(np.array(w, np.uint64), np.array([whole[k][0] for k in w], np.int8), np.array([whole[k][1] for k in w]), np.array(b, np.uint64), np.array([beginning[k] for k in b])), min(toxic, clean)


def _figures_of(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = kernel.utf8(lower(batch.column(1)))
            parts = [np.zeros((0, len(FIGURES)))]
            for a, b in kernel.chunks(offsets):
                parts.append(figures(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lexicon))
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k].copy()) for k in range(x.shape[1]))], ["id", *FIGURES])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled.sample(docs, labels, "toxic", SAMPLE_ROWS).select("label", "text")
    lexicon, least = learn_lexicon(rows)
    width = len(FIGURES)
    if not least:
        return Model(lexicon, np.zeros(width), np.ones(width), np.zeros(width), -500.0)
    kinds = ", ".join(f"{c} double" for c in FIGURES)
    got = sorted(tuple(r) for r in rows.mapInArrow(_figures_of(lexicon), f"id int, {kinds}").collect())
    y, x = np.array([r[0] for r in got], float), np.array([r[1:] for r in got])
    mean, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    theta, prior = np.zeros(width + 1), np.append(np.full(width, 1e-3), 0)
    for _ in range(60):  # Newton's steps of a small regularised regression
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        slope = z.T @ ((p - y)) / len(y) + prior * theta
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(prior + 1e-9)
        theta -= np.linalg.solve(curve, slope)
    return Model(lexicon, mean, spread, theta[:-1], float(theta[-1]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of matches of every document."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _figures_of(model.lexicon)(batches):
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), pa.array(np.rint(np.expm1(x[:, 7])).astype(np.int64))], ["doc_id", "score", "n_matches"])

    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_matches long")
    held_out = labelled.fold(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at).cast(pa.string())], ["id", "text"])
            for found in _figures_of(model.lexicon)([plain]):
                x = np.column_stack([found.column(k).to_numpy(zero_copy_only=False) for k in range(1, found.num_columns)])
                yield batch.filter(pa.array(model.score(x) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
