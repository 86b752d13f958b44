"""Toxicity: a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: The grammar's closed word classes. Insults are learned from the labels besides these.
INSULTS = "idiot idiots moron morons stupid dumb scum trash garbage loser losers clown pathetic worthless disgusting imbecile vermin filth".split()
THREATS = "kill hurt destroy shoot beat stab burn hang punch crush töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he she him her his they them their these those this du dich dir ihr sie vous tu toi ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca ningún jamás".split()
REPORTS = "said says claimed claims wrote writes reported reports quoted called quote sagte schrieb berichtete dit écrit rapporte dijo escribió".split()
_CLAUSE = re.compile(r"[.!?;:\n]")
_TOKEN = re.compile(r"\w+(?:'\w+)?")


class Transducer:
    """A deterministic letter-to-letter transducer: (state, symbol) to (state, output, log weight); other symbols loop unchanged."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: Transducer, symbols) -> Transducer:
        """The composition: reads what this one reads, writes what ``other`` makes of this one's output."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for x in symbols:
                a, mid, w = self.step(state[0], x)
                b, out, v = other.step(state[1], mid)
                arcs[state, x] = ((a, b), out, w + v)
                todo.append((a, b))
        return Transducer(arcs, (self.start, other.start))

    def run(self, symbols):
        state, out = self.start, []
        for x in symbols:
            state, y, w = self.step(state, x)
            out.append((y, w))
        return out


#: What the grammar writes for an insult (plain, aimed at someone, negated, reported, a further one of its clause) and for a threat against
#: someone (plain, negated, reported). The numbers are the weights that they have before any label is seen.
OUTPUTS = {"I": 1.0, "It": 1.5, "In": 0.3, "Ir": 0.5, "II": 1.2, "Ht": 3.0, "Hn": 0.5, "Hr": 1.0}


def grammar(window: int = 3) -> tuple[Transducer, Transducer]:
    """Insult, threat, target, negation and reported-speech transducers: one that reads a clause backwards, and the composition of the others.

    Symbols: I (insult), H (threat), T (target), N (negation), R (report), O (other). The first marks
    I and H that have a target after them with ``+``. The second reads its output: a target before or
    after aims an insult or threat; a threat without a target is nothing; a negation holds for
    ``window`` words, a report for the rest of its clause. Arcs have no weights of their own: those
    of ``OUTPUTS`` are learned.
    """
    ahead = Transducer({(0, "T"): (1, "T", 0.0), (1, "I"): (1, "I+", 0.0), (1, "H"): (1, "H+", 0.0)})
    arcs = {(0, "T"): (1, "T", 0.0), (1, "I"): (1, "It", 0.0), (1, "H"): (1, "Ht", 0.0)}
    target = Transducer(arcs | {(s, x + "+"): (s, x + "t", 0.0) for s in (0, 1) for x in "IH"})
    threat = Transducer({(0, "H"): (0, "O", 0.0)})
    arcs = {(left, "N"): (window, "N", 0.0) for left in range(window + 1)}
    for left in range(window + 1):
        for x in ("I", "It", "Ht", "T", "R", "O"):
            arcs[left, x] = (max(0, left - 1), x[0] + "n" if left and x[0] in "IH" else x, 0.0)
    negation = Transducer(arcs)
    report = Transducer({(0, "R"): (1, "R", 0.0)} | {(1, x): (1, x[0] + "r", 0.0) for x in ("I", "It", "In", "Ht", "Hn")})
    insult = Transducer({(0, x): (1, x, 0.0) for x in ("I", "It")} | {(1, x): (1, "II", 0.0) for x in ("I", "It")})
    symbols = ("I", "H", "I+", "H+", "T", "N", "R", "O")
    return ahead, target.then(threat, symbols).then(negation, symbols).then(report, symbols).then(insult, symbols)


class Scorer:
    """Finds the clauses that hold an insult or a threat and runs the grammar over them."""

    def __init__(self, lexicon: dict[str, float]):
        """``lexicon``: insults with weights; those that end in ``*`` are stems."""
        import ahocorasick

        self.words = {w: v for w, v in lexicon.items() if w[-1] != "*"}
        self.stems = {w[:-1]: v for w, v in lexicon.items() if w[-1] == "*"}
        self.stem_sizes = sorted({len(w) for w in self.stems})
        self.closed = {w: s for words, s in ((TARGETS, "T"), (NEGATIONS, "N"), (REPORTS, "R"), (THREATS, "H")) for w in words}
        self.ahead, self.rules = grammar()
        self.find = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.stem_sizes:
            if len(word) >= n and (v := self.stems.get(word[:n])):
                best = max(best, v)
        return best

    def features(self, text: str) -> list[float]:
        """Log sums of the weights of the clauses' outputs, by output, and the log of the number of characters."""
        low = text.lower()
        sums, done = dict.fromkeys(OUTPUTS, 0.0), -1
        for end, n in self.find.iter(low):
            start = end - n + 1
            if start < done or start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            left = max(done, *(low.rfind(x, max(done, 0), start) for x in ".!?;:\n")) + 1
            right = m.start() if (m := _CLAUSE.search(low, end + 1)) else len(low)
            done = right
            symbols, weights = [], []
            for word in _TOKEN.findall(low, left, right):
                v = self.insult(word)
                symbols.append("I" if v else self.closed.get(word, "O"))
                weights.append(v or 1.0)
            symbols = [x for x, _ in self.ahead.run(symbols[::-1])][::-1]
            for (out, w), v in zip(self.rules.run(symbols), weights, strict=True):
                if out in sums:
                    sums[out] += v * math.exp(w)
        return [*(math.log1p(v) for v in sums.values()), math.log1p(len(text))]


def learn_lexicon(train: DataFrame, size: int = 500, least: int = 4) -> dict[str, float]:
    """Insults and their weights from ``text, toxic``: words and stems (4 to 8 letters) that toxic documents hold and others hardly do.

    Weights are smoothed log odds over 4. The ``size`` entries stay that explain most documents by the
    lower bound of their log odds, which has to be 1 at least.
    """

    def count(batches):
        both = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = set(_TOKEN.findall(text.lower()))
                n[toxic] += 1
                both[toxic].update(words)
                both[toxic].update({f"{w[:k]}*" for w in words for k in range(4, 9) if len(w) >= k})
        words = list({*both[0], *both[1], ""})
        ones, zeros = ([n[k] if not w else both[k][w] for w in words] for k in (1, 0))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(ones, pa.int64()), pa.array(zeros, pa.int64())], names=["word", "a", "b"])

    found = train.mapInArrow(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = cut(found.where((F.col("a") >= least) | (F.col("word") == "")))
    total = found.where("word = ''").select(F.col("a").alias("na"), F.col("b").alias("nb"))
    na, nb = total.first() or (0, 0)
    if not na or not nb:
        return {w: 1.0 for w in INSULTS}
    odds = F.log(((F.col("a") + 0.5) / (na + 1)) / ((F.col("b") + 0.5) / (nb + 1)))
    surely = F.col("odds") - 1.64 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = found.where("word <> ''").withColumn("odds", odds).withColumn("surely", F.round(surely, 9)).where("surely >= 1")
    top = found.orderBy(F.desc(F.round(F.col("a") * F.col("surely"), 6)), F.length("word"), "word").limit(8 * size).collect()
    out: dict[str, float] = {}
    for r in top:  # a stem that is taken covers longer stems and words unless they say clearly more
        w, v = r["word"].rstrip("*"), round(r["odds"] / 4, 6)
        if len(out) < size and all(out.get(w[:k] + "*", -1.0) < v - 0.15 for k in range(4, len(w) + 1)):
            out[r["word"]] = v
    return {w: 1.0 for w in INSULTS} | out


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.01, steps: int = 200) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to ``prior``, which a feature that never occurs keeps; the last weight is the constant."""
    x, prior = np.hstack([x, np.ones((len(x), 1))]), np.append(prior, 0.0)
    w = np.append(np.zeros(x.shape[1] - 1), math.log(y.mean() / (1 - y.mean())))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold_of(id_col: str) -> Column:
    """The quarter of an id; a null id is in none."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the weights of ``Scorer.features`` and the constant, from labels outside quarter 2.

    ``max_labelled`` bounds the labelled rows that are used (as expected number, by a hash of the id).
    The driver gets their features and the lexicon. With labels of one class only, all weights but the
    constant are 0.
    """
    t = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lab = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null").where(fold_of("id") != 2)
    share = min(1.0, max_labelled / max(1, lab.count()))
    lab = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    lab = lab.groupBy("id").agg(F.max("toxic").alias("toxic"))
    train = t.join(F.broadcast(lab), "id").select("text", "toxic")  # about max_labelled rows of 12 bytes: a bounded table
    lexicon = learn_lexicon(train)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(x) for x in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("toxic")], names=["x", "y"])

    rows = train.mapInArrow(features, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    if 0 < y.sum() < len(y):
        return lexicon, fit(np.array([r["x"] for r in rows]), y, np.array([*OUTPUTS.values(), 0.0]))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    return lexicon, np.append(np.zeros(len(OUTPUTS) + 1), math.log(rate / (1 - rate)))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with ``doc_id, held_out, score, predicted``.

    Clauses with a learned insult or a threat are rewritten by the composed grammar; a logistic
    model of the summed lexicon weights of each output gives the score, which is all that documents
    are scored by. Labels are used only of ids whose crc32 (as text) modulo 4 is not 2; ``held_out``
    marks the others. ``learn`` says how many.

    Null text is empty; texts without a match score by the model's constant and their length. Null
    labels and labels of unknown ids are not used; an id with several labels is toxic if one says
    so. With labels of one class only the score is that class's smoothed rate. Rows are kept as they
    are, repeated or not; a null id is not held out, an empty table gives no rows. Other columns are
    not read.
    """
    t = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, max_labelled, id_col, text_col))

    def run(batches):
        lexicon, w = sent.value
        scorer = Scorer(lexicon)
        for b in batches:
            x = np.array([scorer.features(s) for s in b.column("text").to_pylist()]).reshape(b.num_rows, -1)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = t.select("id", "text", F.coalesce(fold_of("id") == 2, F.lit(False)).alias("held_out"))
    return held.mapInArrow(run, f"doc_id {dict(t.dtypes)['id']}, held_out boolean, score double, predicted int")
