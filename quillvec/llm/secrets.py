"""Secret scan with character Markov models, in DataFrame functions only.

Base patterns find assignments of credentials, access keys and long hexadecimal strings.  Beyond them, any run of
`least` (20) or more key characters is judged by two first-order character models, one of random strings and one of
ordinary identifiers: its span is added where the log-likelihood ratio exceeds a margin that is fitted on samples the counts did not see.  Both models are
counted natively from labelled samples made by rule: encodings of SHA-256 digests on one side, identifiers composed of common
words, rules of repeated characters and plain numbers on the other.

A pattern's spans come from the text's parts between matches: their lengths and those of the matches add up to positions in code points.

Defined results: null and empty texts have no spans; a span of the models that touches a base span is left out; equal starts are
ordered assign, access, hex, markov; repeated rows are scanned each; other columns stay, and the spans take the place of a column of
their name; a text of any length is scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import bound, constant_doubles, materialize, placed, unused

#: Fixed values: (kind, pattern, group whose length counts, least length), in the order of kinds.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: What a text must contain for a pattern to have a match that counts; spares the other texts the cutting.
_NEEDS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: The same matches in fewer cuts: a run of at least so many characters is the whole run.
_CUT = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_WIDTH = len(ALPHABET) + 1  # 0: the start, or a character beyond the alphabet
#: Words that ordinary identifiers are made of.
WORDS = """
access action address admin after agent alert align alpha amount answer apply array asset async author back balance
base batch before begin binary block body border branch buffer build bundle button cache call cancel change channel
check child class clean client close cluster code collection color column command common compare complete config connect
content context control convert copy count create current custom data date debug default delete depth detail device direct
display document domain double download driver edit element email empty enable encode engine entry error event example
expect export external failure feature field file filter final find first folder format forward frame function general generate
global graph group handle hash header height hidden history host image import index info initial inner input insert instance
internal item join kernel label language last layer layout left length level library limit link list listener load local
location lock logger main manager mapping margin master match matrix maximum member memory merge message method middle minimum
mode model module monitor mouse move name native network next node normal notify number object offset online open operation
option order outer output owner package page panel parent parse partition path pattern payload pending permission
picture platform player plugin point policy pool position power prefix print process product profile project property provider
public query queue quick random range rate read record recursive reference refresh region register release remote remove render
replace report request reset resource response result return right root route rule runtime sample scale schema scope screen search
section select sender sequence server service session setting shape share shift simple single size slice socket sort source space
special split stack standard start state static status stop storage stream string strong structure style submit subscribe success
suffix summary support switch symbol sync system table target task template temporary test text thread time title toggle total trace
track transaction transform transport tree trigger type union unique unit update upload user utility valid value variable vector
version video view visible volume wait warning watch weight width window worker wrapper write zone
lesen schreiben verzeichnis einstellung nachricht geschwindigkeit verarbeitung wissenschaft entwicklung berechnung zeichenkette
utilisateur fichier connexion paiement recherche traitement historique bibliotheque developpement enregistrement
usuario archivo conexion busqueda tratamiento configuracion mantenimiento desarrollo informacion registro
""".split()


_SPAN = "struct<start:int,end:int,n:int>"


def _cut(text: Column, pattern: str, group: int, needs: str) -> Column:
    """All matches as (start, end, n): code points, end exclusive; n is the length of a group."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(whole, F.length)
    lengths = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("own"), sizes.alias("n"))
    span = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["own"]).alias("end"), x["n"].alias("n"))
    found = placed(lengths, _SPAN, lambda x: x["gap"] + F.coalesce(x["own"], F.lit(0)), span, lambda x: x["own"].isNotNull())
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _at_least(n: int):
    return lambda span: span["n"] >= n


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _symbols(token: Column) -> Column:
    """The place of each character in the alphabet, from 1."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(token: Column) -> Column:
    """Each character with the one before as one number."""
    return bound(_symbols(token), lambda symbols: F.transform(symbols, lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.get(symbols, i - 1)) * _WIDTH + s))


def labelled_samples(spark: SparkSession, n: int = 24_000) -> DataFrame:
    """(token, is_random): strings made by rule, n of either label."""
    row = spark.range(n)
    i = F.col("id")
    digest = F.unhex(F.sha2(F.concat(F.lit("sample-"), i.cast("string")).cast("binary"), 256))
    coded = F.base64(digest)
    chance = F.element_at(
        F.array(coded, F.translate(coded, "+/", "-_"), F.regexp_replace(coded, "[+/=]", ""), F.lower(F.hex(digest)), F.conv(F.substring(F.hex(digest), 1, 15), 16, 36)),
        (i % 5 + 1).cast("int"),
    )
    words = F.array(*[F.lit(w) for w in WORDS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    a, b, c = word(1), word(2), word(3)
    plain = F.element_at(
        F.array(
            F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c)),
            F.upper(F.concat_ws("_", a, b)), F.concat(a, b, c), F.concat(a, F.lit("="), b, F.lit("-"), (i % 100).cast("string")),
            F.repeat(F.substring(F.lit(ALPHABET), (F.pmod(F.xxhash64(i, F.lit(4)), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1)), F.lit(30)), F.concat(F.xxhash64(i).cast("string"), F.lpad(i.cast("string"), 8, "0")),
        ),
        (i % 10 + 1).cast("int"),
    )
    return row.select(chance.alias("token"), F.lit(True).alias("is_random")).unionByName(row.select(plain.alias("token"), F.lit(False).alias("is_random")))


@dataclass
class Markov:
    """Log-likelihood ratio of each step from one character to the next; the ratio beyond which a run is a secret; the shortest run that is judged."""

    ratio: list[float]
    margin: float
    least: int


def _ratio(steps: list, smoothing: float) -> list[float]:
    ratio = [0.0] * (_WIDTH * _WIDTH)
    for label, sign in ((True, 1), (False, -1)):
        counts = [0] * (_WIDTH * _WIDTH)
        for r in steps:
            if r["is_random"] == label:
                counts[r["step"]] += r["n"]
        for before in range(_WIDTH):
            row = counts[before * _WIDTH : (before + 1) * _WIDTH]
            for k, n in enumerate(row):
                ratio[before * _WIDTH + k] += sign * math.log((n + smoothing) / (sum(row) + smoothing * _WIDTH))
    return ratio


def _likely(steps: Column, ratio: list[float], first: Column | int = 0) -> Column:
    """The sum of the ratios of steps, from place `first` on."""
    return bound(constant_doubles(ratio), lambda table: F.aggregate(steps, F.lit(0.0), lambda acc, step: acc + F.get(table, first + step)))


#: Parts of the samples; each is judged by the counts of the others.
FOLDS = 5


def train(samples: DataFrame, *, smoothing: float = 0.5, false_share: float = 1e-3, odds: float = 1000.0, least: int = 20) -> Markov:
    """Counts the steps of both labels and compares their smoothed probabilities; samples (token, is_random) are made by rule.

    false_share: of ordinary samples of `least` characters and more, how many may exceed the margin.  It is fitted on each fifth of the samples with
    the counts of the other four; runs of one character, which are few and all alike, are left out there.  odds: ordinary runs for each secret one
    in texts; the margin is their logarithm at least.  least: characters of the shortest run that is judged; a shorter one says too little: the
    tests measure recall by length.
    """
    held = samples.select("is_random", F.length("token").alias("size"), F.col("token").rlike(r"^(.)\1*$").alias("alike"), F.pmod(F.xxhash64("token"), F.lit(FOLDS)).cast("int").alias("fold"), _steps(F.col("token")).alias("steps"))
    held = materialize(held, "secret-samples")
    # 2 * FOLDS * 69 ** 2 sums at most
    steps = held.select("is_random", "fold", F.explode("steps").alias("step")).groupBy("is_random", "fold", "step").agg(F.count("*").alias("n")).collect()
    others = [x for k in range(FOLDS) for x in _ratio([r for r in steps if r["fold"] != k], smoothing)]
    plain = held.where(~F.col("is_random") & ~F.col("alike") & (F.col("size") >= least)).select(_likely(F.col("steps"), others, F.col("fold") * (_WIDTH * _WIDTH)).alias("x"))
    return Markov(_ratio(steps, smoothing), max(math.log(odds), plain.agg(F.percentile("x", 1 - false_share)).first()[0] or 0.0), least)


def find_secrets(docs: DataFrame, model: Markov, *, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with the spans of each text: an array of (start, rank, end, kind), in order of start and kind; base kinds have rank 0 to 2."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = []
    for kind, pattern, group, least in BASE:
        found = _cut(whole, _CUT.get(kind, pattern), group, _NEEDS[kind])
        base.append(_named(F.filter(found, _at_least(least)), kind))
    run, some = f"[A-Za-z0-9+/_=-]{{{model.least},}}", f"[A-Za-z0-9+/_=-]{{{model.least}}}"
    tokens = F.when(whole.rlike(some), F.regexp_extract_all(whole, F.lit(run), F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = {name: unused(docs, name) for name in ("base", "runs", "tokens")}
    held = docs.withColumns({names["base"]: F.concat(*base), names["runs"]: _cut(whole, run, 0, some), names["tokens"]: tokens})
    known = F.col(names["base"])
    free = F.filter(F.transform(names["runs"], lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(F.col(names["tokens"]), i).alias("token"))), lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = _named(F.filter(free, lambda s: _likely(_steps(s["token"]), model.ratio) > model.margin), "markov")
    return held.withColumn(spans, F.array_sort(F.concat(known, added))).drop(*names.values())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or adjacent spans replaced by the mask."""
    joins = lambda acc, s: (s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (F.size(acc["out"]) > 0))
    step = lambda acc, s: F.struct(
        F.when(joins(acc, s), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    done = F.aggregate(spans, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) == 0, text).otherwise(done)
