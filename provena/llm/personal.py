"""Personal data by weak supervision, in built-in functions alone.

Patterns propose spans. Six labelers vote on each: two on its shape, one by gazetteers, three on
what stands around it. Nobody says which votes are right: expectation-maximisation estimates how
reliable each labeler is from how they agree, and gives every span a probability. A naive Bayes
classifier over hashed shapes, neighbours and votes is trained on these probabilities; it decides
which spans are added to those of the fixed patterns, which always stay.

A text is scanned in one row: what a pattern finds and what it leaves are two arrays, so places
are sums of lengths. No pattern takes more than linear time, and none recurses over its matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import batches, scratch

#: The fixed kinds, in the order in which spans that start together are listed, and those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("written_email", "local_phone", "person", "id_number", "card_like")
KINDS = BASE + ADDED

#: The fixed patterns. A look behind (or the end of the match before) and possessive repeats find the same matches in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Gazetteers (fixed values).
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Don Doña".split()
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Margaret Anthony Sandra Paul Emily Andrew Laura Peter Anna George Alice Henry Julia Hans Ursula Klaus Monika Jürgen Petra "
    "Wolfgang Sabine Stefan Andrea Jean Marie Pierre Jeanne Michel Françoise Jacques Monique Philippe Isabelle Luc Sophie Antoine Camille José "
    "Carmen Manuel Josefa Antonio Pilar Francisco Dolores Javier Lucía Carlos Elena Miguel Rosa Juan Teresa Pedro Sofía Luis Ana"
).split()
DOMAINS = "com org net edu gov mil int info biz io de fr es uk us ca au at ch it nl be se no dk fi pl pt ie eu mx ar br jp cn in ru co me app dev".split()
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
DIALLED = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[01])[\x20().0-9-]"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))"
RESERVED = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."

_T, _G = "|".join(TITLES), "|".join(GIVEN)
_CAPITAL = r"\p{Lu}[\p{Ll}]{1,20}(?:[-'’]\p{Lu}?[\p{Ll}]{1,20})?"
_ALONE = r"(?<![\p{L}\p{N}._%+@/-])"
_HOST = r"[A-Za-z0-9-]{1,63}"
#: What proposes spans that are not of the fixed kinds; each has a quick test that a text is worth it.
WIDE = {
    "written_email": (
        r"[(\[{]at[)\]}]|\x20at\x20\S{1,63}\x20dot\x20",
        rf"{_ALONE}(?:{_LOCAL}{{1,64}}+\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?{_HOST}(?:(?:\x20?(?:\(dot\)|\[dot\]|\{{dot\}})\x20?|\.|\x20dot\x20){_HOST}){{1,4}}+"
        rf"|{_LOCAL}{{1,64}}+\x20at\x20{_HOST}(?:\x20dot\x20{_HOST}){{1,4}}+)",
    ),
    "local_phone": (
        r"[0-9]{2}\)?[\x20./-][0-9]{2}",
        rf"(?=[(0-9]){_ALONE}(?<!\+[0-9]{{1,3}}[\x20-]?)(?:\([0-9]{{2,5}}\)[\x20-]?)?[0-9]{{2,5}}(?:[\x20./-][0-9]{{2,5}}){{1,4}}+(?![\p{{L}}\p{{N}}@]|[.,/-][0-9])",
    ),
    "person": (
        rf"(?=\p{{Lu}}){_ALONE}(?:{_T}|{_G})\.?\x20\p{{Lu}}",
        rf"(?=\p{{Lu}}){_ALONE}(?:(?:{_T})\.?\x20{_CAPITAL}(?:\x20{_CAPITAL}){{0,2}}+|(?:{_G})\x20{_CAPITAL}(?:\x20{_CAPITAL})?+)(?!\p{{L}})",
    ),
    "id_number": (
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        rf"{_ALONE}(?:[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\p{{N}}-])|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}(?:\x20?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}]))",
    ),
}
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"

#: Words before a span that speak for it, by kind (fixed values).
FOR = {
    "email": "mail|e-?mail|courriel|correo|contact|kontakt|write|reach",
    "ip": "ip|address|adresse|dirección|host|server|client|login|from",
    "card": "card|karte|carte|tarjeta|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|téléphone|telefon|teléfono|mobile|cell|handy|fax|call|appel|llam|dial|whatsapp",
    "person": "name|named|called|dear|sincerely|regards|signed|patient|client|ich bin|je suis|soy|nom|nombre|contact",
    "id_number": "ssn|social security|passport|iban|account|konto|compte|cuenta|tax|id",
}
FAMILY = {"written_email": "email", "local_phone": "phone", "card_like": "card"}
#: Words before a number that speak against it (fixed values).
AGAINST = r"(?i)(?<!\p{L})(?:order|invoice|item|version|isbn|issn|part|model|serial|tracking|ticket|section|chapter|page|total|sum|price|bestellung|rechnung|seite|commande|facture|pedido|factura|página)\P{L}{1,4}$"
DATED = r"^(?:(?:19|20)[0-9]{2}[-./\x20][0-9]{1,2}[-./\x20][0-9]{1,2}|[0-9]{1,2}[-./\x20][0-9]{1,2}[-./\x20](?:19|20)?[0-9]{2})$|^(?:19|20)[0-9]{2}[-\x20/](?:19|20)[0-9]{2}$"
LEFT, RIGHT = 48, 16
#: Matches whose places are summed up at once.
BLOCK = 128
BUCKETS = 4096
VOTES = ("shape", "exclusion", "gazetteer", "before", "against", "setting")
ROUNDS = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(steps: Column) -> Column:
    """Sums of an array of numbers up to each of them: block by block, then over the blocks' totals."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def summed(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(BLOCK)), lambda at: F.slice(a, at + 1, F.lit(BLOCK)))
        return let(
            blocks,
            lambda bs: let(
                F.transform(bs, total),
                lambda ts: F.flatten(F.transform(bs, lambda b, i: let(total(F.slice(ts, F.lit(1), i)), lambda base: F.transform(b, lambda _, j: base + total(F.slice(b, F.lit(1), j + 1)))))),
            ),
        )

    return let(steps, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(summed(a)))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, as (value, left, right, start): the text around them, and the place in code points."""

    def placed(s: Column) -> Column:
        gaps, values = s["gaps"], s["values"]
        steps = F.transform(values, lambda _, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0)))
        around = F.transform(values, lambda v, i: F.struct(v.alias("value"), F.right(F.get(gaps, i), F.lit(LEFT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("right")))
        return F.zip_with(around, running_sums(steps), lambda a, start: F.struct(a["value"].alias("value"), a["left"].alias("left"), a["right"].alias("right"), start.alias("start")))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")), placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def weighed(i: Column) -> Column:
        return let(F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + weighed(i)) % 10 == 0


def iban_passes(value: Column) -> Column:
    """Whether an account number's check digits hold: its letters as numbers, the first four signs last, leave 1 modulo 97."""
    signs = let(F.regexp_replace(value, r"\x20", ""), lambda v: F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4))))
    return F.aggregate(F.split(signs, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)) == 1


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _voted(m: Column, kind: str, base: Column, shape: Column, gazetteer: Column) -> Column:
    """A candidate from a match: kind, place, whether it is of the fixed spans, votes and hashed features."""
    number, value, left, right, never = F.lit(KINDS.index(kind)), m["value"], m["left"], m["right"], F.lit(False)
    before = F.rlike(left, F.lit(rf"(?i)(?<!\p{{L}})(?:{FOR[FAMILY.get(kind, kind)]})(?!\p{{L}})[^.!?\n]{{0,24}}$"))
    lone = (F.rlike(left, F.lit(r"[:=][\x20\t\"']*$")) | (F.rlike(left, F.lit(r"(?:^|\n)[\x20\t]*$")) & F.rlike(right, F.lit(r"^[\x20\t]*(?:\r?\n|$)"))))
    joined = F.rlike(left, F.lit(r"[\p{L}\p{N}_]$")) | F.rlike(right, F.lit(r"^(?:[\p{L}\p{N}_]|[.,]?[0-9]|\x20?(?:%|€|\$|£|kg|km|cm|mm|GB|MB)(?!\p{L}))"))
    excluded = F.rlike(value, F.lit(DATED)) | F.rlike(value, F.lit(r"^\P{N}*([0-9])(?:\P{N}*+\1)++\P{N}*$"))
    votes = F.array(shape, _vote(never, excluded), gazetteer, _vote(before, never), _vote(never, F.rlike(left, F.lit(AGAINST))), _vote(lone, joined))
    outline = F.regexp_replace(F.regexp_replace(F.left(value, F.lit(40)), r"[0-9]+", "9"), r"\p{L}+", "a")
    neighbour = lambda t, p: F.lower(F.regexp_extract(t, p, 1))

    def built(v: Column) -> Column:
        features = [F.lit(""), F.concat(F.lit("o"), outline), F.concat(F.lit("l"), neighbour(left, r"(\p{L}+)[^\p{L}\n]*$")), F.concat(F.lit("r"), neighbour(right, r"^[^\p{L}\n]*(\p{L}+)"))]
        features += [F.concat(F.lit(f"v{i}="), F.get(v, F.lit(i)).cast("string")) for i in range(len(VOTES))]
        hashed = F.array(*[F.pmod(F.xxhash64(number, f), F.lit(BUCKETS)).cast("int") for f in features])
        return F.struct(number.cast("int").alias("kind"), m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"), base.alias("base"), v.alias("votes"), hashed.alias("features"))

    return let(votes, built)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``candidates``: (kind, start, end, base, votes, features) of each proposed span of a whole text.

    ``base`` marks the spans of the fixed patterns, which are all there; kinds are numbers of
    KINDS, places count code points. Null and empty texts have none; repeated rows are rows of
    their own; an empty table gives none; a column ``candidates`` is replaced, all others pass.
    A text's time is in proportion to its length, and it costs its task its own size, several
    times over while its patterns run. A pass without a shuffle and without Python.
    """
    (held,) = batches.free_names(df, "whole")
    t = F.col(f"`{held}`")
    yes, no, one = F.lit(True), F.lit(False), F.lit(1)
    none = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"
    found = lambda p, hint: F.when(hint, matches(t, p)).otherwise(F.array().cast("array<struct<value:string,left:string,right:string,start:int>>"))
    digits = lambda m: F.regexp_replace(m["value"], "[^0-9]", "")
    n_digits = lambda m: F.length(digits(m))
    has = lambda s: F.contains(t, F.lit(s))
    in_list = lambda c, words: F.when(c.isin(*words), 1).otherwise(-1)

    email = F.transform(found(EMAIL, has("@")), lambda m: _voted(m, "email", yes, one, in_list(F.lower(F.regexp_extract(m["value"], r"\.([A-Za-z0-9-]+)$", 1)), DOMAINS)))
    ip = F.filter(found(IP, F.rlike(t, F.lit(r"[0-9]\.[0-9]"))), lambda m: F.rlike(m["value"], F.lit(IP_PARTS)))
    ip = F.transform(ip, lambda m: _voted(m, "ip", yes, one, F.when(F.rlike(m["value"], F.lit(RESERVED)), -1).otherwise(1)))
    phone = F.filter(found(PHONE, has("+")), lambda m: n_digits(m).between(10, 15))
    phone = F.transform(phone, lambda m: _voted(m, "phone", yes, one, F.when(F.rlike(m["value"], F.lit(DIALLED)), 1).otherwise(-1)))

    def card(m: Column) -> Column:
        def judged(d: Column) -> Column:
            right = F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
            issuer = F.when(F.rlike(d, F.lit(ISSUERS)), 1).otherwise(-1)
            return let(right, lambda ok: F.when(ok, _voted(m, "card", yes, one, issuer)).otherwise(_voted(m, "card_like", no, F.lit(-1), issuer)))

        return let(digits(m), judged)

    cards = F.transform(F.filter(found(CARD, F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}"))), lambda m: n_digits(m).between(13, 19)), card)

    wide = {k: found(pattern, F.rlike(t, F.lit(hint))) for k, (hint, pattern) in WIDE.items()}

    def written(m: Column) -> Column:
        spelt = F.rlike(m["value"], F.lit(r"[(\[{]at|\x20dot\x20|[(\[{]dot"))
        return _voted(m, "written_email", no, _vote(spelt, no), in_list(F.lower(F.regexp_extract(m["value"], r"([A-Za-z0-9-]+)$", 1)), DOMAINS))

    def local(m: Column) -> Column:
        return _voted(m, "local_phone", no, _vote(F.rlike(m["value"], F.lit(r"^(?:\(|0)")), n_digits(m) > 12), F.lit(0))

    def identity(m: Column) -> Column:
        v, ssn = m["value"], F.rlike(m["value"], F.lit(SSN))
        good = ~ssn | F.rlike(v, F.lit(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))
        return _voted(m, "id_number", no, F.when(good, 1).otherwise(-1), F.when(ssn, 0).otherwise(in_list(F.left(v, F.lit(2)), COUNTRIES)))

    # what is a fixed span, or holds one, is not proposed again; nor is an account number whose check digits are wrong
    numbers = F.filter(wide["local_phone"], lambda m: n_digits(m).between(7, 13) & ~F.rlike(m["value"], F.lit(f"{IP}|{SSN}")))
    more = [F.transform(wide["written_email"], written), F.transform(numbers, local), F.transform(wide["person"], lambda m: _voted(m, "person", no, F.lit(0), one)), F.transform(F.filter(wide["id_number"], lambda m: F.rlike(m["value"], F.lit(SSN)) | iban_passes(m["value"])), identity)]
    cands = F.concat(*[x.cast(none) for x in (email, ip, cards, phone, *more)])
    keep = [F.col(f"`{c}`") for c in df.columns if c != "candidates"]
    return df.withColumn(held, F.coalesce(F.col(f"`{text}`"), F.lit(""))).select(*keep, cands.alias("candidates"))


@dataclass(frozen=True)
class Model:
    """What was learnt: how often each labeler votes -1, 0 and 1 on wrong and on right spans, each kind's share of right ones, and the classifier's weights."""

    votes: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]
    shares: tuple[float, ...]
    weights: tuple[float, ...]


def _constant(numbers: list[float] | tuple[float, ...]) -> Column:
    """An array that is worked out once for a query."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def probability(kind: Column, votes: Column, model: Model) -> Column:
    """That a span is right, by its kind's share and its labelers' votes."""
    odds = F.get(_constant([math.log(s / (1 - s)) for s in model.shares]), kind)
    for i, (wrong, right) in enumerate(model.votes):
        odds = odds + F.get(_constant([math.log(r / w) for w, r in zip(wrong, right, strict=True)]), F.get(votes, F.lit(i)) + 1)
    return 1 / (1 + F.exp(-odds))


#: What labelers are held to be before any vote is counted, with the weight of a hundredth of all spans and one.
_FIRST = ((0.35, 0.6, 0.05), (0.05, 0.6, 0.35))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over (kind, votes, n): at most 9 * 3^6 rows, however many spans were counted.

    Each round is one aggregation that ends in one row of sums.
    """
    model = Model((_FIRST,) * len(VOTES), (0.5,) * len(KINDS), ())
    for _ in range(rounds):
        p = probability(F.col("kind"), F.col("votes"), model)
        both = patterns.select("kind", "votes", (F.col("n") * (1 - p)).alias("p0"), (F.col("n") * p).alias("p1"))
        sums = [F.sum(F.when(F.get("votes", F.lit(i)) == v, F.col(f"p{y}")).otherwise(0)).alias(f"v{i}_{y}_{v + 1}") for i in range(len(VOTES)) for y in (0, 1) for v in (-1, 0, 1)]
        sums += [F.sum(F.when(F.col("kind") == k, F.col(f"p{y}")).otherwise(0)).alias(f"k{k}_{y}") for k in range(len(KINDS)) for y in (0, 1)]
        s = {c: x or 0.0 for c, x in both.agg(*sums).first().asDict().items()}
        weight = 1 + 0.01 * sum(s[f"k{k}_{y}"] for k in range(len(KINDS)) for y in (0, 1))
        votes = []
        for i in range(len(VOTES)):
            rows = [[s[f"v{i}_{y}_{v}"] + weight * _FIRST[y][v] for v in range(3)] for y in (0, 1)]
            votes.append(tuple(tuple(x / sum(r) for x in r) for r in rows))
        shares = tuple((s[f"k{k}_1"] + 1) / (s[f"k{k}_0"] + s[f"k{k}_1"] + 2) for k in range(len(KINDS)))
        new = Model(tuple(votes), shares, ())
        moved = max([abs(a - b) for x, y in zip(model.votes, new.votes, strict=True) for u, v in zip(x, y, strict=True) for a, b in zip(u, v, strict=True)])
        model = new
        if moved < 1e-3:
            break
    return model


def fit(scanned: DataFrame) -> Model:
    """Reliabilities and the classifier from all candidates of a scanned table, which is read twice.

    Counts of votes and sums of features are partial before they are shuffled; at most 9 * 3^6
    and BUCKETS rows come out. Without candidates, weights are all zero.
    """
    spans = scanned.select(F.explode("candidates").alias("c")).select("c.*")
    patterns = scratch.materialize(spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).coalesce(1), "votes")
    model = reliabilities(patterns)
    p = probability(F.col("kind"), F.col("votes"), model)
    per = spans.select(F.explode("features").alias("f"), p.alias("p")).groupBy("f").agg(F.sum("p").alias("right"), F.sum(1 - F.col("p")).alias("wrong"))
    sums = {r["f"]: (r["wrong"], r["right"]) for r in per.collect()}
    wrong, right = (sum(x[k] for x in sums.values()) + 1 for k in (0, 1))
    floor = 0.5
    weight = lambda w, r: math.log((r + floor) / (right + floor * BUCKETS)) - math.log((w + floor) / (wrong + floor * BUCKETS))
    n = 4 + len(VOTES)  # features of a span: its share of the prior odds goes with each
    weights = tuple(weight(*sums[f]) + math.log(right / wrong) / n if f in sums else 0.0 for f in range(BUCKETS))
    return Model(model.votes, model.shares, weights)


def classify(scanned: DataFrame, model: Model) -> DataFrame:
    """``scanned`` with ``spans`` (kind, start, end, base, score) in place of its candidates, in order.

    The fixed spans stay whatever their score; others stay if their score, the classifier's
    probability, is 0.5 or more. A pass without a shuffle.
    """
    weights = _constant(model.weights)
    score = lambda c: 1 / (1 + F.exp(-F.aggregate(c["features"], F.lit(0.0), lambda s, f: s + F.get(weights, f))))
    scored = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"), score(c).alias("score")))
    kept = F.array_sort(F.filter(scored, lambda c: c["base"] | (c["score"] >= 0.5)))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(kept, lambda c: F.struct(F.get(names, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["score"].alias("score")))
    return scanned.select(*[F.col(f"`{c}`") for c in scanned.columns if c not in ("candidates", "spans")], spans.alias("spans"))


def find_personal(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``spans`` (kind, start, end, base, score): what the fixed patterns find, and what the classifier adds.

    The candidates are written to the shared folder once, with all columns of ``df`` but the text,
    which comes back as null; join by a key of your own where it is needed.
    """
    held = scratch.materialize(scan(df, text).drop(text), "candidates")
    return classify(held, fit(held))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op13_personal_data": op13_personal_data}
ORACLE_SQL: dict[str, str] = {}
