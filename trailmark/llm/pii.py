"""Personal data by weak supervision.

Base spans (e-mail, ip, card, phone) follow fixed patterns and always stay.  Looser patterns propose further spans (national
ids, bank accounts, phone numbers without a plus, names after a title).  Labelers - shape regexes, gazetteers, context words,
checksums - vote on every span, base spans included; expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; its posteriors train a naive Bayes span classifier on span features, and proposed
spans that it accepts are added.  DataFrame functions only; what reaches the driver are counts of vote and feature patterns,
whose number is bounded by the number of labelers and features.

Texts are searched once: :func:`spanned` gives each text's spans with the characters around them, which are written and serve
training and finding alike.  Places and overlaps come from running sums, minima and maxima over the spans of a text, made in
chunks of ``CHUNK``, so a text's cost grows with its spans and not with their square.

Defined results: a null or empty text has no spans; spans are in code points with an exclusive end, ordered by start and
then kind; a proposed span that touches a base span is dropped; equal texts give equal spans; repeated rows repeat; :func:`redact`
keeps all columns whatever their names; with no proposed span in the corpus nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, written

# Kinds in their order.
BASE = ("email", "ip", "card", "phone")
LOOSE = ("national_id", "account", "local_phone", "name")
KINDS = BASE + LOOSE

# The base patterns, with possessive loops where giving back cannot help, so that long runs neither recurse nor repeat.
# A look at the first character comes before what is dearer to test.
_E = "A-Za-z0-9._%+-"
_TITLES = "(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)"
PATTERNS = {
    "email": rf"(?:(?<![{_E}])|\G)[{_E}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of single-spaced digits that have 12 to 19 of them: the maximal run starts after no digit and ends before none.
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "national_id": r"(?=[0-9])(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?=[A-Z][A-Z][0-9])(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
    "local_phone": r"(?=[(0-9])(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])",
    "name": rf"(?=[DFHMPS])(?<![A-Za-z]){_TITLES}\.? [A-Z][a-z]{{1,20}}(?: [A-Z][a-z]{{1,20}})?(?![a-z])",
}
#: What a text must hold before a pattern is tried.
HINTS = {"email": "@", "phone": "+"}
PERSON_WORDS = r"(?i)\b(?:phone|tel|telefon|téléphone|teléfono|call|mobile|fax|ssn|social|passport|iban|account|konto|compte|cuenta|contact|kontakt|name|mail|e-mail|adresse|address|born|patient|customer|client)\b"
OTHER_WORDS = r"(?i)\b(?:isbn|issn|order|invoice|version|page|seite|figure|table|section|chapter|doi|http|https|part|item|sku|build|score|vol|no|nr)\b[^a-z]*$"
#: Gazetteers: usual given names, and countries whose bank accounts have the international form.  Fixed values.
GIVEN_NAMES = tuple(
    "Alexander Alice Ana Andrea Andreas Anna Anne Antonio Barbara Camille Carlos Carmen Charles Charlotte Chloé Christian Claire Claudia Daniel David Diego Elena Elizabeth Emily Emma Eva Felix Francisco "
    "François Frank George Hans Hélène Isabel James Jan Javier Jean Jennifer Johannes John Jorge José Juan Julia Julie Karl Katharina Klaus Laura Léa Linda Louis Lucas Lucía Luis Lukas Manuel Marco Maria "
    "María Marie Mark Martin Mary Matthias Michael Miguel Nicolas Olivier Oliver Patricia Paul Pedro Peter Philippe Pierre Pilar Richard Robert Sabine Sarah Sofia Sophie Stefan Susan Thomas Ursula Ute "
    "Véronique William Wolfgang".split()
)
COUNTRIES = tuple("AD AE AL AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TN TR UA".split())
#: Characters before and after a span that labelers and features see.
BEFORE, AFTER = 40, 20
ROUNDS = 25
#: Spans of a text over which running sums are made at once, and characters of a text that are cut out at once.
CHUNK, CUT = 256, 4096


def _before(values: Column, join, first: Column) -> Column:
    """For each of an array of numbers what ``join`` makes of ``first`` and those before it."""
    kind = "array<int>"

    def scan(xs: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    starts = scan(F.transform(chunks, lambda xs: F.aggregate(xs, first, lambda a, x: join(a, x))), first)
    made = F.flatten(F.zip_with(chunks, starts, scan))
    return F.when(F.size(values) > CHUNK, made).otherwise(scan(values, first))


def _found(text: Column, kind: str) -> Column:
    """array<struct<s,k,e,t,b,a>> of the matches of a pattern: place, kind, text, and what stands before and after.

    The pieces between matches give places and surroundings, so the text itself is not walked again for each match.
    """
    pattern, k = F.lit(PATTERNS[kind]), KINDS.index(kind)
    hits, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)

    def spans(x: Column) -> Column:
        hits, pieces, nexts = x["hits"], x["pieces"], F.slice(x["pieces"], F.lit(2), F.size(x["hits"]))
        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
        ends = _before(F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["t"])), lambda a, b: a + b, F.lit(0))
        placed = F.zip_with(pairs, ends, lambda x, at: F.struct((at + F.length(x["p"])).alias("s"), x["p"].alias("p"), x["t"].alias("t")))
        last = lambda i: F.when(i > 0, F.get(hits, i - 1)).otherwise("")
        with_before = F.transform(placed, lambda x, i: F.struct(x["s"].alias("s"), x["t"].alias("t"), F.substring(F.concat(last(i), x["p"]), -BEFORE, BEFORE).alias("b"), F.coalesce(F.get(hits, i + 1), F.lit("")).alias("n")))
        return F.zip_with(
            with_before, nexts,
            lambda x, p: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.length(x["t"])).alias("e"), x["t"].alias("t"), x["b"].alias("b"), F.substring(F.concat(p, x["n"]), 1, AFTER).alias("a")),
        )

    hint = F.contains(text, F.lit(HINTS[kind])) & F.rlike(text, pattern) if kind in HINTS else F.rlike(text, pattern)
    # A list of one, so that what the pattern finds is found once.
    found = F.get(F.transform(F.array(F.struct(hits.alias("hits"), pieces.alias("pieces"))), spans), F.lit(0))
    return F.when(hint, found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,t:string,b:string,a:string>>"))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _octet() -> str:
    # Zeros alone are a part too; else they lead one and are not given back.
    return r"(?:0++(?![0-9])|0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}))"


_KEEP = {
    "ip": lambda t: F.rlike(t, F.lit(rf"^{_octet()}(?:\.{_octet()}){{3}}$")),
    "card": lambda t: F.call_function("luhn_check", _digits(t)),
    "phone": lambda t: F.length(_digits(t)).between(9, 15),
}


def _spans(text: Column, kind: str) -> Column:
    """The matches of one kind that are spans."""
    found = _found(text, kind)
    return F.filter(found, lambda x: _KEEP[kind](x["t"])) if kind in _KEEP else found


def _apart(base: Column, loose: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``base``; both in one sweep by start."""
    low, high = F.lit(-1), F.lit(2147483647)
    mark = lambda own: lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x.alias("x"))
    both = F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(loose, mark(1))))

    def sweep(all_: Column) -> Column:
        reach = _before(F.transform(all_, lambda y: F.when(y["own"] == 0, y["e"]).otherwise(low)), F.greatest, low)
        ahead = F.reverse(_before(F.reverse(F.transform(all_, lambda y: F.when(y["own"] == 0, y["s"]).otherwise(high))), F.least, high))
        free = F.zip_with(F.zip_with(all_, reach, lambda y, r: F.struct(y.alias("y"), r.alias("r"))), ahead, lambda z, n: F.struct(z["y"].alias("y"), ((z["y"]["own"] == 1) & (z["r"] <= z["y"]["s"]) & (n >= z["y"]["e"])).alias("ok")))
        return F.transform(F.filter(free, lambda z: z["ok"]), lambda z: z["y"]["x"])

    return F.when((F.size(base) > 0) & (F.size(loose) > 0), F.get(F.transform(F.array(both), sweep), F.lit(0))).otherwise(loose)


def spanned(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``pii_base`` (all base spans in order) and ``pii_loose`` (proposed spans that touch none of them).

    For what is cut from texts to be cut once, write the result before it is used twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [F.array_sort(F.concat(*(_spans(text, k) for k in kinds))) for kinds in (BASE, LOOSE)]
    # A list of one again: the spans are named once and used three times.
    pair = F.transform(F.array(F.struct(every[0].alias("base"), every[1].alias("loose"))), lambda x: F.struct(x["base"].alias("base"), _apart(x["base"], x["loose"]).alias("loose")))
    both = rows.withColumn("pii_pair", F.get(pair, F.lit(0)))
    return both.select(*rows.columns, F.col("pii_pair.base").alias("pii_base"), F.col("pii_pair.loose").alias("pii_loose"))


# -- labelers and features of one span (a column x) ------------------------------------------------------------------------


def labelers(x: Column) -> list[Column]:
    """Votes: 1 personal, -1 not, 0 abstains."""
    before, k, t = x["b"], x["k"], x["t"]
    d = _digits(t)
    of = lambda *kinds: k.isin(*(KINDS.index(n) for n in kinds))
    return [
        # shape: a strict form of the kind
        F.when(of("email", "ip", "card", "phone"), 1).when(of("local_phone") & F.length(d).between(9, 11), 1).when(of("national_id") & ~F.rlike(t, F.lit("^(?:000|666|9)|-00-|-0000$")), 1).when(of("account") & F.length(F.replace(t, F.lit(" "), F.lit(""))).between(15, 34), 1).when(of("name"), 0).otherwise(-1),
        # gazetteers: given names, countries of accounts
        F.when(of("name"), F.rlike(t, F.lit(" (?:" + "|".join(GIVEN_NAMES) + ")(?: |$)")).cast("int")).when(of("account"), F.when(F.substring(t, 1, 2).isin(*COUNTRIES), 1).otherwise(-1)).otherwise(0),
        # context words before the span
        F.when(F.rlike(before, F.lit(PERSON_WORDS)), 1).otherwise(0),
        F.when(F.rlike(before, F.lit(OTHER_WORDS)), -1).otherwise(0),
        # checks: one digit over and over, or counting up, is no number of a person; checksums hold
        F.when(of("card"), 1).when(F.length(d) >= 7, F.when(F.rlike(d, F.lit("^(.)\\1*$")) | F.lit("01234567890123456789").contains(d), -1).otherwise(0)).otherwise(0),
        # neighbourhood: a letter or digit glued to the span speaks against it
        F.when(F.rlike(before, F.lit("[\\p{L}\\p{N}_/=]$")), -1).otherwise(0),
    ]


def features(x: Column) -> list[Column]:
    """What the span classifier sees: kind, digits, the characters around and the context words."""
    before, after = x["b"], x["a"]
    sign = lambda c: F.when(c == "", "-").when(F.rlike(c, F.lit("\\s")), "s").when(F.rlike(c, F.lit("\\p{L}")), "l").when(F.rlike(c, F.lit("[0-9]")), "d").otherwise("p")
    return [
        x["k"].cast("string"),
        F.least(F.length(_digits(x["t"])), F.lit(20)).cast("string"),
        sign(F.substring(before, -1, 1)),
        sign(F.substring(after, 1, 1)),
        F.rlike(before, F.lit(PERSON_WORDS)).cast("string"),
        F.rlike(before, F.lit(OTHER_WORDS)).cast("string"),
    ]


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(prior, per labeler {vote: (P(vote | personal), P(vote | not))}) from counts of vote patterns.

    Starts from votes taken at face value; each probability is smoothed by twelve spans, so no labeler becomes certain.
    """
    if not counts:
        return 0.5, []
    n = len(next(iter(counts)))
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v in counts}
    prior, tables = 0.5, []
    for _ in range(rounds):
        yes = sum(c * post[v] for v, c in counts.items())
        no = sum(c * (1 - post[v]) for v, c in counts.items())
        prior = (yes + 1) / (yes + no + 2)
        tables = []
        for i in range(n):
            t = {}
            for vote in (-1, 0, 1):
                a = sum(c * post[v] for v, c in counts.items() if v[i] == vote)
                b = sum(c * (1 - post[v]) for v, c in counts.items() if v[i] == vote)
                # A vote keeps its meaning: pseudo-counts lean the way it points.
                t[vote] = ((a + 1 + 9 * (vote > 0)) / (yes + 12), (b + 1 + 9 * (vote < 0)) / (no + 12))
            tables.append(t)
        post = {v: posterior(prior, tables, v) for v in counts}
    return prior, tables


def posterior(prior: float, tables, votes) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class SpanClassifier:
    """Naive Bayes over span features, trained on posteriors; :meth:`accepts` is a column of literals and sums."""

    def __init__(self, bias: float, weights: list[dict[str, float]]):
        self.bias, self.weights = bias, weights

    @classmethod
    def train(cls, rows: list[tuple[tuple[str, ...], float, float]]) -> SpanClassifier:
        """``rows``: feature values, posterior, count."""
        yes = sum(p * c for _, p, c in rows) + 1
        no = sum((1 - p) * c for _, p, c in rows) + 1
        weights = []
        for i in range(len(rows[0][0]) if rows else 0):
            a, b = {}, {}
            for f, p, c in rows:
                a[f[i]] = a.get(f[i], 0) + p * c
                b[f[i]] = b.get(f[i], 0) + (1 - p) * c
            m = len(a) + 1
            weights.append({v: math.log((a[v] + 1) / (yes + m)) - math.log((b[v] + 1) / (no + m)) for v in sorted(a)})
        return cls(math.log(yes / no), weights)

    def accepts(self, x: Column) -> Column:
        z = F.lit(self.bias)
        for f, w in zip(features(x), self.weights, strict=True):
            part = F.lit(0.0)
            for value, weight in w.items():
                part = F.when(f == value, weight).otherwise(part)
            z = z + part
        return z >= 0.0


def train(found: DataFrame) -> SpanClassifier:
    """Votes, EM and the classifier from all spans of a table that :func:`spanned` gave."""
    x = F.col("x")
    each = found.select(F.explode(F.concat("pii_base", "pii_loose")).alias("x"))
    patterns = each.select(F.array(*labelers(x)).alias("votes"), F.array(*features(x)).alias("features")).groupBy("votes", "features").count().collect()
    votes: dict[tuple[int, ...], float] = {}
    for r in patterns:
        votes[tuple(r["votes"])] = votes.get(tuple(r["votes"]), 0) + r["count"]
    prior, tables = expectation_maximisation(votes)
    return SpanClassifier.train([(tuple(r["features"]), posterior(prior, tables, tuple(r["votes"])), r["count"]) for r in sorted(patterns, key=str)])


def accepted(found: DataFrame, model: SpanClassifier) -> DataFrame:
    """``found`` with ``pii_spans``, base and accepted spans in order, in place of ``pii_loose``."""
    more = F.filter("pii_loose", model.accepts) if model.weights else F.filter("pii_loose", lambda x: F.lit(False))
    return found.withColumn("pii_spans", F.when(F.size("pii_loose") > 0, F.array_sort(F.concat("pii_base", more))).otherwise(F.col("pii_base"))).drop("pii_loose")


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows (kept columns, ``pii_base``, ``pii_spans``: arrays of struct<s,k,e,t,b,a>) for every row of ``docs``, with a model trained on all its spans."""
    found = written(spanned(docs.select(*keep, text_col), text_col).drop(text_col), "spans")
    return accepted(found, train(found))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``[KIND]``; overlapping spans become one mark, that of the first."""
    found = written(spanned(packed(docs, text_col)), "spans", texts=True)
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text, spans = F.col("text"), F.col("pii_spans")
    # The text in cuts, so that a piece of it is taken from the cuts it lies in and not from the text's beginning on.
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CUT).cast("int")), lambda i: F.substring(text, i * CUT + 1, F.lit(CUT)))

    def new(x: Column) -> Column:
        cuts, ends = x["cuts"], F.transform(x["spans"], lambda y: y["e"])

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / CUT).cast("int")
            return F.substring(F.array_join(F.slice(cuts, first + 1, F.floor(b / CUT).cast("int") - first + 1), ""), a - first * CUT + 1, b - a)

        reached = F.zip_with(x["spans"], _before(ends, F.greatest, F.lit(0)), lambda y, at: F.struct(y["s"].alias("s"), y["k"].alias("k"), at.alias("at")))
        kept = F.transform(F.filter(reached, lambda y: y["s"] >= y["at"]), lambda y: F.concat(piece(y["at"], y["s"]), F.get(marks, y["k"])))
        return F.concat(F.array_join(kept, ""), piece(F.array_max(ends), x["n"]))

    whole = F.get(F.transform(F.array(F.struct(cuts.alias("cuts"), spans.alias("spans"), F.length(text).alias("n"))), new), F.lit(0))
    done = accepted(found, train(found)).select("row", F.when(F.size("pii_spans") > 0, whole).otherwise(text).alias("text"))
    return unpacked(done, docs.columns, text_col)
