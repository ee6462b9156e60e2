"""Operator 7, PII by weak supervision, with DataFrame functions only.

Candidates are spans of the base patterns (email, ip, card, phone), matches of these that fail their own check, and
looser forms (a phone without a plus, an email spelled with "at"). Four labelers vote yes (1), no (-1) or nothing (0)
on each candidate:

* pattern: the base pattern's own check passes, fails, or has no say (looser forms);
* gazetteer: lists of top-level domains, issuer digits, reserved networks, calling codes;
* cue: a word before the span speaks for the kind (call, mail, card, ...) or against it (version, order, isbn, ...);
* border: whether the span stands free or touches a letter, digit or sign of a longer token.

Expectation-maximisation over the counts of vote patterns (at most 3^4 for each kind, whatever the input's size)
estimates how reliable each labeler is. The posteriors then train a logistic span classifier over kinds, votes, their pairs
with the pattern vote, and hashed features of form and context that no labeler knows: the form's shape, length and domain or
first digits, two words before it and one after. These learn from candidates that the pattern's check passes or fails, and so
decide among the looser ones, on which votes are often alike. Base spans stay in any case; a candidate that overlaps none of
them is added when the classifier gives it at least ``LEAST_SCORE``. Votes are counted over all candidates; the classifier is
fitted on at most ``SAMPLE`` distinct ones of each kind and pattern of votes, by hash order (4 * 81 * 64 rows at most).

Defined results: null is as empty; texts without candidates have no spans and the digest of the empty text. Offsets
are code points, ends exclusive. Patterns are possessive, so very long runs neither overflow the stack nor backtrack.
Repeated rows get the same answer. An empty table fits on nothing (prior reliabilities) and gives an empty result.
Columns named like a result are replaced.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "cue", "border")
LEAST_SCORE = 0.6
SAMPLE = 64
#: Slots of the hashed features of form and context.
SLOTS = 2048
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns in forms that match the same spans without backtracking: a run that failed at its start fails at
#: every later place, so a search starts only at a run's start or where the last match ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,4}",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: What a text must hold before a pattern is tried on it.
_NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}
_LOOSE_NEEDS = {"email": lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"), "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")}
_CUES = {
    "email": (r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b[^\n]{0,12}$", r"(?i)\b(?:version|commit|package)\b[^\n]{0,12}$"),
    "ip": (r"(?i)\b(?:ip|host|server|address|from|ping|login)\b[^\n]{0,12}$", r"(?i)\b(?:version|release|section|chapter|v)\b[^\n]{0,8}$"),
    "card": (r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay)\b[^\n]{0,16}$", r"(?i)\b(?:isbn|order|serial|invoice|id|no)\b[^\n]{0,12}$"),
    "phone": (r"(?i)\b(?:phone|tel|call|mobile|cell|fax|text)\b[^\n]{0,12}$", r"(?i)\b(?:isbn|order|serial|invoice|version)\b[^\n]{0,12}$"),
}
_EMPTY = "cast(array() as array<struct<start:int,kind_no:int,end:int,kind:string,form:string>>)"


def _found(text: Column, pattern: str, needs: Column, kind: str, form: Column | None = None) -> Column:
    """Spans of a pattern's matches: the gaps that split() leaves and the matches alternate, so lengths give places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("form"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.expr(_EMPTY).alias("out")), step, lambda acc: acc["out"])
    return F.when(needs & (F.size(hits) > 0), spans).otherwise(F.expr(_EMPTY))


def passes(kind: Column, form: Column) -> Column:
    """The base pattern's own check of a match."""
    digits = F.regexp_replace(form, "[^0-9]", "")
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    ip = F.forall(F.split(form, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).cast("int") <= 255))
    back = F.reverse(digits)
    luhn = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda n, k: n + F.when(k % 2 == 1, F.substring(back, k, F.lit(1)).cast("int")).otherwise(F.substring(back, k, F.lit(1)).cast("int") * 2 - F.when(F.substring(back, k, F.lit(1)) >= "5", 9).otherwise(0)),
    )
    card = F.when(F.length(digits).between(12, 19), luhn % 10 == 0).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(F.length(digits).between(9, 15))


def base_spans(text: Column) -> Column:
    """Sorted spans of the base patterns that pass their checks."""
    found = F.concat(*[_found(text, BASE[k], _NEEDS[k](text), k) for k in KINDS])
    return F.array_sort(F.filter(found, lambda s: passes(s["kind"], s["form"])))


def _votes(text: Column, s: Column, form_vote: Column) -> list[Column]:
    kind, form = s["kind"], s["form"]
    digits = F.regexp_replace(form, "[^0-9]", "")
    before, after = F.substring(text, F.greatest(s["start"] - 29, F.lit(1)), F.least(s["start"], F.lit(30))), F.substring(text, s["end"] + 1, F.lit(1))
    yes_no = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    tld = F.lower(F.regexp_extract(form, r"[.\]) ]([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(kind == "email", yes_no(tld.isin("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz"), ~tld.rlike("^[a-z]{2,}$")))
        .when(kind == "ip", yes_no(form.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[0-3][0-9])\."), form.rlike(r"^0|\.0[0-9]")))
        .when(kind == "card", yes_no(digits.rlike("^[3-6]") & F.length(digits).between(13, 19), ~F.length(digits).between(12, 19)))
        .otherwise(yes_no(form.rlike(r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|555"), F.length(digits) < 9))
    )
    cue = reduce(lambda c, k: c.when((kind == k) & before.rlike(_CUES[k][0]), 1).when((kind == k) & before.rlike(_CUES[k][1]), -1), KINDS, F.when(F.lit(False), 0)).otherwise(0)
    border = yes_no(~before.rlike(r"[A-Za-z0-9._%+@-]$") & ~after.rlike("[A-Za-z0-9@_%]"), F.lit(True))
    return [form_vote, gazetteer, cue, border]


def _hashed(text: Column, s: Column) -> Column:
    """Slots of a candidate's form and context."""
    kind, form = s["kind"], s["form"]
    before = F.lower(F.substring(text, F.greatest(s["start"] - 29, F.lit(1)), F.least(s["start"], F.lit(30))))
    after = F.lower(F.substring(text, s["end"] + 1, F.lit(20)))
    shape = F.substring(F.regexp_replace(F.regexp_replace(form, "[0-9]+", "9"), "[A-Za-z]+", "a"), 1, 30)
    seen = {
        "shape": shape,
        "length": F.least(F.when(kind == "email", F.length(form)).otherwise(F.length(F.regexp_replace(form, "[^0-9]", ""))), F.lit(40)).cast("string"),
        "head": F.when(kind == "email", F.lower(F.regexp_extract(form, r"([A-Za-z0-9-]+[^A-Za-z0-9-]+[A-Za-z0-9-]+)$", 1))).otherwise(F.substring(F.regexp_replace(form, "[^0-9]", ""), 1, 2)),
        "before": F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1),
        "second": F.regexp_extract(before, r"(\p{L}+)\P{L}+\p{L}+\P{L}*$", 1),
        "after": F.regexp_extract(after, r"^\P{L}*(\p{L}+)", 1),
    }
    return F.array(*[F.pmod(F.xxhash64(F.lit(name), kind, v), F.lit(SLOTS)).cast("int") for name, v in seen.items()])


def candidates(text: Column) -> Column:
    """All candidates of a text with ``base`` (pattern and check hold), one vote of each labeler and the hashed features."""
    strict = F.concat(*[_found(text, BASE[k], _NEEDS[k](text), k) for k in KINDS])
    loose = F.concat(*[_found(text, LOOSE[k], _LOOSE_NEEDS[k](text), k) for k in LOOSE])

    def voted(s: Column, base: Column, form_vote: Column) -> Column:
        votes = [v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(text, s, form_vote), strict=True)]
        return F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"), base.alias("base"), *votes, _hashed(text, s).alias("hashed"))

    return F.concat(
        F.transform(strict, lambda s: voted(s, passes(s["kind"], s["form"]), F.when(passes(s["kind"], s["form"]), 1).otherwise(-1))),
        F.transform(loose, lambda s: voted(s, F.lit(False), F.lit(0))),
    )


@dataclass
class SpanModel:
    """Reliability of each labeler, and the classifier: a weight for each (feature, value) and for each slot."""

    reliability: dict[str, float]
    bias: float
    weights: dict[str, float]
    slots: tuple[float, ...] = ()


def _features(kind: str, votes: tuple[int, ...]) -> list[str]:
    return [f"kind={kind}", *[f"{n}={v}" for n, v in zip(LABELERS, votes, strict=True)], *[f"pattern={votes[0]},{n}={v}" for n, v in zip(LABELERS[1:], votes[1:], strict=True)]]


def aggregate_votes(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> tuple[dict[str, float], list[float]]:
    """Expectation-maximisation: (reliability of each labeler, posterior of each vote pattern).

    One reliability a labeler, the chance that a vote given is right, with a Beta prior that breaks the symmetry, and one
    share of true spans a kind, so that a flood of digits that are no cards says nothing of phones. Before its votes no
    candidate is held likelier true than not, whatever its kind's share.
    """
    first = (0.9, 0.75, 0.75, 0.7)
    right, posterior, shares = list(first), [0.5] * len(counts), dict.fromkeys((kind for kind, *_ in counts), 0.5)
    strength = 0.02 * sum(n for *_, n in counts) + 10
    for _ in range(rounds):
        true, total = dict.fromkeys(shares, 1.0), dict.fromkeys(shares, 2.0)
        for k, (kind, votes, n) in enumerate(counts):
            odds = math.log(shares[kind] / (1 - shares[kind])) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right, strict=True))
            posterior[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            true[kind] += posterior[k] * n
            total[kind] += n
        shares = {kind: min(0.5, max(0.05, true[kind] / total[kind])) for kind in shares}
        for j in range(len(LABELERS)):
            good = sum(n * (p if votes[j] > 0 else 1 - p) for p, (_, votes, n) in zip(posterior, counts, strict=True) if votes[j])
            given = sum(n for _, votes, n in counts if votes[j])
            right[j] = min(0.98, max(0.52, (good + first[j] * strength) / (given + strength)))
    return dict(zip(LABELERS, right, strict=True)), posterior


def fit(docs: DataFrame, text: str = "text", epochs: int = 20) -> SpanModel:
    """Reliabilities and classifier; counts of vote patterns and the classifier's bounded sample reach the driver."""
    found = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    pattern = ["kind", *LABELERS]
    seen = cut(found.select("c.kind", *[f"c.{n}" for n in LABELERS], "c.hashed").groupBy(*pattern, "hashed").agg(F.count(F.lit(1)).alias("n")))
    counts = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in seen.groupBy(*pattern).agg(F.sum("n").alias("n")).collect())
    reliability, posterior = aggregate_votes(counts)
    likely = {(kind, votes): p for (kind, votes, _), p in zip(counts, posterior, strict=True)}
    by_hash = Window.partitionBy(*pattern).orderBy(F.xxhash64("hashed"), "hashed")
    taught = seen.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= SAMPLE).collect()
    rows = sorted((r["kind"], tuple(r[n] for n in LABELERS), tuple(r["hashed"]), r["n"]) for r in taught)
    return SpanModel(reliability, *_classifier(rows, likely, epochs))


def _logistic(lessons: list[tuple[list, float, float]], epochs: int) -> dict[str | int, float]:
    """Weights of features that give each lesson's target (features, target, weight), by AdaGrad in a seeded order."""
    weights = dict.fromkeys((f for fs, *_ in lessons for f in fs), 0.0)
    squares, lessons, dice = dict.fromkeys(weights, 1.0), list(lessons), random.Random(7)
    for _ in range(epochs):
        dice.shuffle(lessons)
        for fs, p, mass in lessons:
            slope = mass * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in fs))))) - p)
            for f in fs:
                g = slope + 0.002 * weights[f]
                squares[f] += g * g
                weights[f] -= 0.2 * g / math.sqrt(squares[f])
    return weights


def _classifier(rows: list[tuple], likely: dict[tuple, float], epochs: int) -> tuple[float, dict[str, float], tuple[float, ...]]:
    """(bias, weights of votes, weights of slots), counts damped so that rare rows teach too.

    Votes learn from all rows. Slots learn, beside their kind, from those on which the pattern's check has a say, and so say
    how far form and context move a candidate from its kind's usual case.
    """
    damped: dict[tuple, int] = {}
    for kind, votes, _, n in rows:
        damped[kind, votes] = damped.get((kind, votes), 0) + n
    weights = _logistic([(["bias", *_features(*key)], likely[key], math.log1p(n)) for key, n in damped.items()], 10 * epochs)
    slots = _logistic([([f"kind={kind}", *at], likely[kind, votes], math.log1p(n)) for kind, votes, at, n in rows if votes[0]], epochs)
    return weights.pop("bias", 0.0), weights, tuple(slots.get(k, 0.0) for k in range(SLOTS))


def _score(model: SpanModel, s: Column) -> Column:
    total = F.lit(model.bias)
    for f, w in sorted(model.weights.items()):
        holds = reduce(lambda a, b: a & b, [s[n] == (v if n == "kind" else int(v)) for n, v in (x.split("=") for x in f.split(","))])
        total = total + F.when(holds, w).otherwise(0.0)
    if model.slots:
        slots = F.split(F.lit(",".join(map(repr, model.slots))), ",").cast("array<double>")
        total = total + F.aggregate(s["hashed"], F.lit(0.0), lambda acc, k: acc + F.element_at(slots, k + 1))
    return 1 / (1 + F.exp(-total))


def detect(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """docs with ``base`` and ``spans``: sorted arrays of (start, kind_no, end, kind), the second with the added ones."""
    given = docs.drop("base", "spans", "__c").withColumn("__c", candidates(F.coalesce(F.col(text), F.lit(""))))
    plain = lambda s: F.struct(*[s[n].alias(n) for n in ("start", "kind_no", "end", "kind")])
    base = F.array_sort(F.transform(F.filter("__c", lambda s: s["base"]), plain))
    given = given.withColumn("base", base)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("__c", lambda s: ~s["base"] & free(s) & (_score(model, s) >= LEAST_SCORE))
    return given.withColumn("spans", F.array_sort(F.concat("base", F.array_distinct(F.transform(added, plain))))).drop("__c")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span as its kind in angle brackets; overlapping spans are one, of the first's kind."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mark).alias("out")))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(docs)).drop("text")
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
