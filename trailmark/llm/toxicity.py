"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, quotation, other).  Five weighted transducers over these
symbols - negation, reported speech, target, threat and repetition - each pass a clause on with some symbols rewritten: an
insult after a negation becomes a denied one, one under a reporting verb a reported one, one near a target a directed one, one after
earlier insults a repeated one.  Each arc has a weight (the farther a target is, the less); composed, they are one weighted transducer that
reads a text clause by clause and says which patterns a clause holds and how strongly.  The score of a text is built from its
matched clauses: a word of the lexicon that stands alone, with no target, threat or other insult, matches ``alone``, whose weight is
fixed below what marks a text as toxic.

Learned, from a bounded sample of labelled rows (``TRAIN_ROWS``, by hash of the id): the insult lexicon (words and word
beginnings that stand in toxic rows in many different contexts and hardly in others), with a weight for each, and the weight of
each pattern but ``alone``.  Seed words have a weight before any label is seen.

Defined results: a null, empty or wordless text has the score of no match; scores lie in 0..1; without labels the seed lexicon
and the patterns' first weights hold; labels that are null or contradict each other are averaged by document; extra columns are
ignored; repeated rows repeat; texts are read whole.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import BROADCAST_ROWS, give_back, held_out, map_text, settings, small_pieces, written

#: Labelled rows that are learned from at most (the expected number; drawn by hash).
TRAIN_ROWS = 30_000
#: Entries of the learned lexicon at most, the strongest first: the size of the model.
LEXICON = 5_000
#: A learned word or word beginning stands in so many toxic rows and different contexts at least, and raises the odds by e to
#: this power.
LEAST_ROWS, LEAST_CONTEXTS, LEAST_LOG_ODDS = 6, 5, 3.9
#: Letters of word beginnings that are learned, for words that are longer.
STEMS = range(4, 9)
CUT = 0.3
#: Words outside the lexicon that a task remembers.
REMEMBERED = 100_000

# Seed lexicon of the grammar's classes.
INSULTS = "idiot idiots moron morons scum trash loser losers clown stupid pathetic worthless disgusting dumb imbecile bastard idiota imbécil estúpido basura crétin imbécile connard abruti dummkopf trottel abschaum arschloch"
THREATS = "kill hurt destroy beat stab shoot burn hang crush töten schlagen tuer frapper matar golpear"
THREAT_LEADS = "will gonna shall must should werde werden vais va voy vamos"
TARGETS = "you your yours u they them he she him her people du dich dir ihr euch sie tu toi vous te tú ti usted ustedes ellos"
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't without nicht kein keine nie niemals pas jamais sans nunca jamás sin"
REPORTS = "said says say called calls wrote writes claimed told quoted reportedly allegedly according sagte schrieb nannte dit écrit appelé dijo escribió llamó"

# Symbols; the end of a clause is one.
O, I, V, L, T, N, R, Q, END = "other", "insult", "verb", "lead", "target", "negation", "report", "quote", "end"
#: What a clause's insult or threat is read as in the end, with the weight (as a probability) that holds before learning.
PATTERNS = {"directed": 0.95, "repeated": 0.9, "threat": 0.8, "reported": 0.35, "denied": 0.25, "alone": 0.2}
#: The weight of this one is not learned.
FIXED = "alone"
SYMBOLS = frozenset({O, I, V, L, T, N, R, Q, END, *PATTERNS})

_clause = re.compile(r"[.!?;:\n]+")
_word = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]").findall


class Transducer:
    """A deterministic weighted finite-state transducer: (state, symbol) -> (state, symbol, weight); missing arcs go back to the start and copy at weight 1."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str, float]], start: str = "0"):
        self.arcs, self.start = arcs, start

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.arcs.get((state, symbol), (self.start, symbol, 1.0))

    def compose(self, other: Transducer, symbols: frozenset[str] = SYMBOLS) -> Transducer:
        """What this one writes is read by ``other``, weights multiplied; only states that can be reached are built."""
        start = f"{self.start}|{other.start}"
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            for s in symbols:
                a2, mid, v = self.step(a, s)
                b2, out, w = other.step(b, mid)
                arcs[f"{a}|{b}", s] = f"{a2}|{b2}", out, v * w
                todo.append((a2, b2))
        return Transducer(arcs, start)


def _window(opens: str, rewrite: dict[str, str], width: int, fade: float = 1.0) -> Transducer:
    """After the symbol ``opens``, for ``width`` symbols or until the clause ends, symbols are rewritten, with a weight that fades from symbol to symbol."""
    arcs = {}
    for k in range(width + 1):
        for s in SYMBOLS:
            if s == opens:
                arcs[str(k), s] = str(width), s, 1.0
            elif k and s != END:
                arcs[str(k), s] = str(k - 1), rewrite.get(s, s), fade ** (width - k) if s in rewrite else 1.0
            else:
                arcs[str(k), s] = "0", s, 1.0
    return Transducer(arcs)


def _again() -> Transducer:
    """An insult that nothing else was made of is alone if it is the text's first, else repeated; the ends of clauses do not matter."""
    arcs = {}
    for s in SYMBOLS:
        arcs["0", s] = ("1", FIXED, 1.0) if s == I else ("1" if s == "directed" else "0", s, 1.0)
        arcs["1", s] = "1", "repeated" if s == I else s, 1.0
    return Transducer(arcs)


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """negation o reported speech o target o threat o repetition."""
    negation = _window(N, {I: "denied", V: "denied"}, 3)
    reported = _window(R, {I: "reported", V: "reported"}, 8)
    target = _window(T, {I: "directed"}, 5, 0.95)
    # A verb of violence is a threat only after a lead ("will", "should"), else an ordinary word.
    threat = _window(L, {V: "threat"}, 3, 0.9)
    return negation.compose(reported).compose(target).compose(threat).compose(_again())


class Weights(dict):
    """Weight of each word by the lexicon and the stems; words that were looked up are remembered."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__(words)
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> float:
        found = max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0) if self.stems else 0.0
        if len(self) > REMEMBERED + len(self.words):
            self.clear()
            self.update(self.words)
        self[word] = found
        return found


class Model:
    """Lexicon (word -> weight), stems (beginning of longer words -> weight) and the probability of each pattern."""

    def __init__(self, words: dict[str, float], stems: dict[str, float] | None = None, patterns: dict[str, float] | None = None):
        self.words, self.stems, self.patterns = words, stems or {}, dict(PATTERNS) | (patterns or {})
        self.symbol = {}
        for names, kind in ((TARGETS, T), (NEGATIONS, N), (REPORTS, R), (THREAT_LEADS, L), (THREATS, V)):
            self.symbol |= dict.fromkeys(names.split(), kind)
        self.symbol |= dict.fromkeys(words, I)
        self.symbol |= dict.fromkeys('"“”«»', Q)
        self.weights = Weights(words, self.stems)
        self.verbs = {w for w, k in self.symbol.items() if k == V}
        machine = grammar()
        self.arcs, self.start = machine.arcs, machine.start

    def matches(self, text: str) -> list[tuple[str, float]]:
        """(pattern, weight of its strongest path) of each clause that matches, in order."""
        found = []
        low = text.lower()
        # Almost all texts hold no heavy word; only those with one are cut into clauses.
        distinct, weight = set(_word(low)), self.weights.__getitem__
        if self.verbs.isdisjoint(distinct) and not any(map(weight, distinct)):
            return found
        state = self.start
        for clause in _clause.split(low):
            best: dict[str, float] = {}
            for w in _word(clause):
                s = self.symbol.get(w) or (I if weight(w) else O)
                state, out, strength = self.arcs[state, s]
                if out in self.patterns:
                    best[out] = max(best.get(out, 0.0), strength * (weight(w) if s == I else 1.0))
            state = self.arcs[state, END][0]
            found.extend(best.items())
        return found

    def score(self, text: str) -> float:
        return self.score_of(self.matches(text))

    def score_of(self, matches: list[tuple[str, float]]) -> float:
        """1 - product over matched clauses of (1 - probability * weight)."""
        miss = 1.0
        for pattern, weight in matches:
            miss *= 1 - min(0.999, self.patterns[pattern] * weight)
        return 1 - miss


def seed_model() -> Model:
    return Model(dict.fromkeys(INSULTS.split(), 0.6))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Rows (id, text, y) to learn from: at most about TRAIN_ROWS labelled rows outside the held-out quarter."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    n = usable.count()
    share = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, TRAIN_ROWS / max(1, n)))
    # The drawn labels are of bounded number and width, so they are broadcast.
    drawn = usable.where(share).groupBy("id").agg(F.avg("y").alias("y"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(drawn), "id").select("id", "text", (F.col("y") >= 0.5).cast("int").alias("y"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The lexicon, the stems and the patterns' weights from the sample."""
    spark = docs.sparkSession
    # ICU's tables for lower case cost an executor about 3 GB of garbage when it first needs them, for which its heap grows.  Java's differ in
    # 67 code points, letters newer than Java 17.
    with small_pieces(spark), settings(spark, {"spark.sql.icu.caseMappings.enabled": "false"}):
        return _learned(written(_sample(docs, labels, id_col, text_col, label_col), "toxicity", texts=True))


def _marks(word: Column, before: Column | None = None) -> Column:
    """A word and, marked with a star, the beginnings of a longer word; null for each that it has not.

    ``before``: the word before it among a row's sorted different words; what both have is left out, so that a row has each mark once.
    Words with one beginning stand side by side there, behind the beginning itself, if that is a word.
    """
    fresh = lambda k: F.length(word) > k if before is None else (F.length(word) > k) & ~((F.length(before) > k) & (F.substring(before, 1, k) == F.substring(word, 1, k)))
    return F.array(F.when(F.length(word) > 2, word), *(F.when(fresh(k), F.concat(F.substring(word, 1, k), F.lit("*"))) for k in STEMS))


def _learned(rows: DataFrame) -> Model:
    """What rows (text, y) teach.  Arrays are zipped and exploded, in generated code: functions with a lambda leave about a MB of garbage
    for each text, and an executor's heap grows with the rate of that."""
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return seed_model()
    w = F.filter(F.split(F.lower("text"), "[^\\p{L}]++"), lambda x: x != "")
    cut = rows.select("y", w.alias("w"))
    # Features: words, and beginnings of longer words marked with a star.
    none = F.array(F.lit(""))

    def each(rows):
        words = rows.select(F.sort_array(F.array_distinct("w")).alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("word"), F.concat(none, "w").alias("before"))).alias("x"))
        return words.where("x.word is not null").select(F.explode(_marks(F.col("x.word"), F.col("x.before"))).alias("mark")).where("mark is not null")

    # Only what stands in enough toxic rows is looked for in the others.
    often = written(each(cut.where("y = 1")).groupBy("mark").agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= LEAST_ROWS), "toxic-marks")
    wanted = often.select("mark")
    if often.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    others = each(cut.where("y = 0")).join(wanted, "mark").groupBy("mark").agg(F.count(F.lit(1)).alias("b"))
    counts = often.join(others, "mark", "left").select("mark", "a", F.coalesce("b", F.lit(0)).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / n1) / ((F.col("b") + 0.5) / n0))
    odd = written(counts.withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS), "toxic-odds")
    # Their neighbours in toxic rows: near copies of one text count as one context.  Rows carry three words, not the text.
    places = F.arrays_zip(F.col("w").alias("word"), F.concat(none, "w").alias("before"), F.concat(F.slice("w", 2, F.size("w")), none).alias("after"))
    placed = cut.where("y = 1").select(F.explode(places).alias("x")).where("x.word is not null").select("x.word", F.xxhash64("x.before", "x.after").alias("context"))
    seen = placed.select(F.explode(_marks(F.col("word"))).alias("mark"), "context").where("mark is not null")
    looked = odd.select("mark")
    if odd.count() <= BROADCAST_ROWS:
        looked = F.broadcast(looked)
    contexts = seen.join(looked, "mark").groupBy("mark").agg(F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    top = odd.join(contexts, "mark").orderBy(F.desc("odds"), F.desc("a"), "mark").limit(LEXICON).collect()
    learned = {r["mark"]: 1 / (1 + math.exp(-(r["odds"] + math.log(n1 / n0)))) for r in top}
    words = dict.fromkeys(INSULTS.split(), 0.6) | {k: v for k, v in learned.items() if not k.endswith("*")}
    stems = {k[:-1]: v for k, v in learned.items() if k.endswith("*")}
    first = Model(words, stems)

    def run(batches):
        for b in batches:
            found = [[p for p, _ in first.matches(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))], names=["y", "p"])
        give_back()

    by = rows.select("text", "y").mapInArrow(run, "y int, p array<string>").select("y", F.explode("p").alias("p")).groupBy("p").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    # The share of toxic rows among those with a pattern, drawn towards the first weight by 20 rows' worth.
    return Model(words, stems, {r["p"]: (r["a"] + 20 * PATTERNS[r["p"]]) / (r["n"] + 20) for r in by if r["p"] != FIXED})


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Rows (id, score double, predicted int, clauses array<string>: the patterns of matched clauses) for every row of ``docs``."""
    words, stems, patterns = model.words, model.stems, model.patterns

    def make():
        m = Model(words, stems, patterns)

        def f(texts):
            found = [m.matches(t) for t in texts]
            scores = [m.score_of(x) for x in found]
            return [scores, [int(s >= cut) for s in scores], [[p for p, _ in x] for x in found]]

        return f

    names = ("score", "predicted", "clauses")
    out = StructType([StructField(n, k) for n, k in zip(names, (DoubleType(), IntegerType(), ArrayType(StringType())), strict=True)])
    return map_text(docs.select(id_col, text_col), make, out, pa.schema(list(zip(names, (pa.float64(), pa.int32(), pa.list_(pa.string())), strict=True))), text_col)
