"""Toxicity by a weighted finite-state pattern grammar.

A clause is a string of word classes.  Three transducers annotate it from left to right: a target word is
remembered for SCOPE words, a negation for SCOPE words, reported speech to the clause's end.  Two more read the annotated string:

* the insult transducer accepts phrases: insult words that follow one another, or are joined by at most LINKS linking words
  ("scum of the earth's trash"), an intensifier before them adding to their weight.  A phrase is aimed at
  a target within SCOPE words before its first word or after its last;
* the threat transducer accepts a threat verb with a target within SCOPE words after it, or after a modal within
  SCOPE words before it; a verb with neither is no threat.  Behind a modal it is aimed also by a target between the two ("werde dich töten")
  or an object pronoun before both ("te voy a matar").

They are composed on the fly: a state is one state of each, met states are remembered.  The composition emits the sum of
a phrase's weights into a channel that says insult or threat, aimed or not, negated or not, reported or not.  What the
clauses of a text emit adds up, and a logistic link with one coefficient per channel gives the score.

What is learned, from a bounded sample of labelled texts: words and word
stems that mark toxic texts (any language), their weights, the bias, and one factor for the
coefficients of all channels, whose order is the grammar's.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts of each class that are learned from, at most (about).
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: Learned words and stems at most, and the least number and share of toxic texts that show one.
LEARNED, SUPPORT, SUPPORT_SHARE = 400, 3, 0.015
#: Lengths of learned stems in letters.
STEMS = (4, 5, 6, 7, 8)

# The grammar's word classes, in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile filth vermin dumm idioten abschaum versager dreck ekelhaft wertlos crétin abruti ordure minable dégoûtant tonto estúpido basura escoria inútil asqueroso".split()
THREATS = "kill hurt destroy beat smash shoot stab burn murder strangle töten umbringen schlagen verbrennen vernichten tuer frapper brûler détruire matar golpear quemar destruir".split()
TARGETS = "you your yours yourself u ur he she they them him her his their these those du dich dir dein deine ihr euch sie ihn ihm diese tu te toi ton vous votre il elle ils elles leur lui ces tú ti usted ustedes él ella ellos ellas vosotros esos esas".split()
OBJECTS = "te dich euch os".split()  # targets that are never subjects and may stand before their verb
NEGATIONS = "not no never nobody nothing isn't aren't wasn't weren't don't doesn't didn't won't can't cannot without nicht kein keine nie niemals niemand ohne pas jamais rien aucun aucune sans nunca jamás nada ningún ninguna sin".split()
REPORTS = "said says say called calls wrote writes claimed claims according quoted quotes reported shouted sagt sagte schrieb behauptet zitiert laut rief dit disait écrit affirme selon cria dijo dice escribió afirma según gritó".split()
INTENSIFIERS = "so such very really totally utterly absolute complete total sehr echt völlig total absolut très vraiment totalement muy tan totalmente realmente".split()
MODALS = "will would shall should gonna going must want hope i'll we'll werde werden soll muss will vais va allons dois veux voy va vamos debo quiero".split()
LINKING = "a an the of and or little piece und oder der die das ein eine von et ou le la les un une de du des y o el los las una".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
END = re.compile(r"[.!?;\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSE, MODAL, LINK, OBJECT = range(10)
AT = (TARGET, OBJECT)
SCOPE, LINKS, STRONG = 3, 2, 1.25
# Prior coefficient of a channel = base, times a factor for each modifier.
BASE, AIMED, NEGATED, REPORTED = 2.0, 1.3, 0.6, 0.7


def fade(*words: int):
    """The transducer that remembers classes of words for SCOPE words: its state is how many are left."""
    return lambda state, symbol: SCOPE if symbol in words else max(0, state - 1)


recall_target, recall_negation, recall_modal, recall_object = fade(*AT), fade(NEGATION), fade(MODAL), fade(OBJECT)


def insult_step(state, symbol, aimed, negated, reported, intense):
    """-> (state, [(operation, channel)]).  state: None, or (words since the phrase's last, all of them linking, aimed, negated, reported)."""
    out = []
    if symbol == INSULT:
        if state is not None and state[1] and state[0] <= LINKS:
            return (0, True, *state[2:]), [("add", None)]
        if state is not None:
            out.append(("emit insult", state[2:]))
        return (0, True, aimed, negated, reported), [*out, ("begin strong" if intense else "begin", None)]
    if state is None:
        return None, out
    since, linking, *flags = state
    if symbol in AT:
        return None, [("emit insult", (True, *flags[1:]))]
    if since + 1 == SCOPE:
        return None, [("emit insult", tuple(flags))]
    return (since + 1, linking and symbol == LINK, *flags), out


def threat_step(state, symbol, meant, aimed, negated, reported):
    """-> (state, [(operation, channel)]).  state: None, or (words since the verb, after a modal, negated, reported); aimed: a target stands before the verb."""
    out = []
    if state is not None:
        since, modal, *flags = state
        if symbol in AT:
            return None, [("emit threat", (True, *flags))]
        if symbol == THREAT or since + 1 == SCOPE:
            out, state = [("emit threat", (False, *flags))] if modal else [], None
        else:
            state = (since + 1, modal, *flags)
    if symbol == THREAT and meant and aimed:
        return None, [*out, ("threaten", None), ("emit threat", (True, negated, reported))]
    if symbol == THREAT:
        return (0, meant, negated, reported), [*out, ("threaten", None)]
    return state, out


#: States of target, object, negation, report, modal, whether the last word intensified, insult, threat.
START = (0, 0, 0, False, 0, False, None, None)


@lru_cache(maxsize=1 << 16)
def compose(state: tuple, symbol: int) -> tuple[tuple, tuple]:
    """(next state, operations) of the composed transducers for one word."""
    target, object_, negation, report, modal, intense, insult, threat = state
    insult, first = insult_step(insult, symbol, target > 0, negation > 0, report, intense)
    threat, then = threat_step(threat, symbol, modal > 0, target > modal or object_ > 0, negation > 0, report)
    after = (recall_target(target, symbol), recall_object(object_, symbol), recall_negation(negation, symbol), report or symbol == REPORT, recall_modal(modal, symbol), symbol == INTENSE, insult, threat)
    return after, tuple(first + then)


def at_end(state: tuple) -> list:
    """What a state still emits when the clause ends."""
    insult, threat = state[6:]
    out = [("emit insult", insult[2:])] if insult is not None else []
    return out + ([("emit threat", (False, *threat[2:]))] if threat is not None and threat[1] else [])


def channel(threat: bool, aimed: bool, negated: bool, reported: bool) -> int:
    return threat << 3 | aimed << 2 | negated << 1 | reported


CHANNELS = 16
FEATURES = CHANNELS + 1  # the last says how long the text is that matched


def prior() -> np.ndarray:
    w = np.zeros(FEATURES)
    for threat, aimed, negated, reported in itertools.product((0, 1), repeat=4):
        w[threat << 3 | aimed << 2 | negated << 1 | reported] = BASE * (0.5 if threat and not aimed else 1) * AIMED**aimed * NEGATED**negated * REPORTED**reported
    return w


class Grammar:
    """words: {word: (class, weight)}; stems: {prefix: (class, weight)}; the link's bias and coefficients."""

    def __init__(self, words: dict, stems: dict, bias: float = -3.0, coef: np.ndarray | None = None):
        self.words, self.stems, self.bias = words, stems, bias
        self.coef = prior() if coef is None else coef
        kinds = ((LINKING, LINK), (INTENSIFIERS, INTENSE), (MODALS, MODAL), (TARGETS, TARGET), (OBJECTS, OBJECT), (NEGATIONS, NEGATION), (REPORTS, REPORT))
        self.classes = {w: k for listed, k in kinds for w in listed}
        self.longest_stem = max(map(len, stems), default=0)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for w in self.words:
                a.add_word(w, (len(w), True))
            for w in self.stems:
                if w not in self.words:
                    a.add_word(w, (len(w), False))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def lexeme(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return self.words[word]
        for n in range(min(len(word) - 1, self.longest_stem), 2, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return self.classes.get(word, OTHER), 0.0

    def clause(self, words: list[str], out: np.ndarray) -> None:
        """Run the composition over one clause; ``out`` gets the weight of each phrase in its channel."""
        state, insult, threat = START, 0.0, 0.0
        steps = [self.lexeme(w) for w in words]
        for k in range(len(steps) + 1):
            if k < len(steps):
                state, operations = compose(state, steps[k][0])
            else:
                operations = at_end(state)
            for name, flags in operations:
                if name == "emit insult":
                    out[channel(False, *flags)] += insult
                elif name == "emit threat":
                    out[channel(True, *flags)] += threat
                elif name == "threaten":
                    threat = steps[k][1]
                elif name == "add":
                    insult += steps[k][1]
                else:
                    insult = steps[k][1] * (STRONG if name == "begin strong" else 1.0)

    def channels(self, text: str | None) -> np.ndarray:
        """What the clauses of a whole text emit, by channel; last, the text's log length if any matched."""
        out = np.zeros(FEATURES)
        if not text or not (self.words or self.stems):
            return out
        text, done = text.lower(), 0
        for last, (n, whole) in self.automaton.iter(text):
            first = last - n + 1
            if first < done or (first and text[first - 1].isalpha()) or (whole and text[last + 1 : last + 2].isalpha() and not text[first : last + 1] in self.stems):
                continue
            lo = done  # each clause is read once, from its true start to its true end
            for m in END.finditer(text, lo, first):
                lo = m.end()
            m = END.search(text, last + 1)
            hi = m.start() if m else len(text)
            self.clause(WORD.findall(text, lo, hi), out)
            done = hi
        if out.any():
            out[CHANNELS] = len(text) / 300
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1 for rows of channel sums."""
        z = np.clip(self.bias + np.log1p(features) @ self.coef, -40, 40)
        return 1 / (1 + np.exp(-z))


def seed_words() -> dict:
    return {w: (INSULT, 1.0) for w in INSULTS} | {w: (THREAT, 1.0) for w in THREATS}


def _feature_counter(batches):
    """(feature, toxic texts, clean texts) of a task; a feature is a word, or a stem with * at its end."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall(text.lower()))
            (toxic if y else clean).update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
    for part in (toxic, clean):
        keys = list(part)
        n = pa.array([part[k] for k in keys], pa.int64())
        zero = pa.array(np.zeros(len(keys), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *((n, zero) if part is toxic else (zero, n))], ["feature", "pos", "neg"])


def _channel_rows(grammar: Grammar):
    def run(batches):
        for batch in batches:
            x = [grammar.channels(t) for t in batch.column(0).to_pylist()]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.FixedSizeListArray.from_arrays(flat, FEATURES).cast(pa.list_(pa.float64()))], ["y", "x"])

    return run


def fit_link(x: np.ndarray, y: np.ndarray, rounds: int = 30, strength: float = 1.0) -> tuple[float, np.ndarray]:
    """(bias, coefficients) of a logistic link by Newton steps, pulled towards the prior.

    One factor scales all channels of the prior, so what is fitted cannot turn the grammar round: aimed phrases count for more than
    plain ones, threats as much as aimed insults, negated and reported ones for less.  The bias stays where a single aimed phrase of
    weight 1 crosses 0.5 and a single plain one does not.
    """
    pattern = prior()[:CHANNELS]
    a = np.stack([np.ones(len(x)), np.log1p(x[:, :CHANNELS]) @ pattern, np.log1p(x[:, CHANNELS])], axis=1)
    centre = np.array([-3.0, 1.0, 0.0])
    pull = np.diag([0.05, 0.05, strength])
    w = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + pull
        step = np.linalg.solve(h, a.T @ (p - y) + pull @ (w - centre))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    scale = max(w[1], 0.5)
    plain, aimed = scale * BASE * math.log(2), scale * BASE * AIMED * math.log(2)
    bias = float(np.clip(w[0], 0.03 * plain - 0.98 * aimed, -1.03 * plain))
    return bias, np.append(scale * pattern, min(w[2], 0.0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """A grammar from the labelled rows of ``docs``: a bounded sample of each class.

    Rows are sampled by a hash of the id at a rate taken from the class's count, so
    the sample's ids (some thousands) can be broadcast.  Without labels the seed grammar results.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    count = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    rate = {y: min(1 << 20, most * (1 << 20) // max(1, count.get(y, 0)) + 1) for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))}
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).dropDuplicates(["doc_id"]).limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(picked), "doc_id").select("text", "y")
    sample = sample.persist()
    try:
        n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        pos, neg = n.get(1, 0), n.get(0, 0)
        if not pos or not neg:
            return Grammar(seed_words(), {})
        table = sample.mapInArrow(_feature_counter, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        # rates with half a text of doubt on either side: rare features need to be pure
        table = table.withColumn("odds", F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0)))
        top = table.where((F.col("pos") >= max(SUPPORT, math.ceil(SUPPORT_SHARE * pos))) & (F.col("odds") >= math.log(8)) & (F.col("neg") * 4 * pos <= F.col("pos") * neg))
        rows = top.orderBy(F.desc(F.col("odds") * F.sqrt(F.col("pos").cast("double"))), "feature").limit(4 * LEARNED).collect()
        words, stems = seed_words(), {}
        for r in rows:  # the best first; what a better stem already says, wider or narrower, is left out
            f = r["feature"]
            core = f.rstrip("*")
            if any(core[:k] in stems for k in range(4, len(core) + 1)) or any(x.startswith(core) for x in stems) or len(words) + len(stems) >= LEARNED:
                continue
            weight = min(2.0, r["odds"] / math.log(100))
            if f.endswith("*") and core not in INSULTS + THREATS:
                stems[core] = (INSULT, weight)
            else:
                words[core] = (words.get(core, (INSULT, 0))[0], weight)
        grammar = Grammar(words, stems)
        got = sample.mapInArrow(_channel_rows(grammar), "y int, x array<double>").toArrow()
        x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        y = got.column("y").to_numpy().astype(float)
        # texts of the sample stand for unequal numbers of rows; the bias is set for the sample
        grammar.bias, grammar.coef = fit_link(x, y)
        return grammar
    finally:
        sample.unpersist()


def _scorer(grammar: Grammar):
    def run(batches):
        for batch in batches:
            x = np.array([grammar.channels(t) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grammar.score(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: whole texts, 0 to 1, higher where toxic.

    Null and empty texts have no clause and get the link's value for none.  Texts of any length are read whole.  Repeated
    rows and null ids pass through; extra columns are ignored.  An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_scorer(grammar), f"doc_id {kind}, score double")
