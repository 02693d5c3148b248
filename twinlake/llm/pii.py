"""Personal data by weak supervision, in DataFrame operations only.

Regular expressions propose spans: e-mail addresses, IP addresses, card numbers and telephone numbers by fixed rules (the base), and
looser shapes beside them.  Five labelers vote on every span (yes, no, or silent): its shape, a gazetteer, the words before it, a
checksum, and words that speak against it.  Expectation-maximisation over the counts of vote patterns estimates, for each kind, how
often each labeler is right; the posteriors are the soft labels from which a naive Bayes classifier over the votes and the span's
own features is trained.  A looser span stays if the classifier gives it one half or more and it overlaps no base span nor an
earlier one; base spans always stay.

The driver only sees tables of bounded size: vote patterns by kind (at most 3 ** 5 for each), and sums by kind and feature value.

Cases: null text is empty; null doc_id and repeated rows each keep their row; places count code points; very long words, digit runs
and texts with very many spans are handled (no pattern backtracks over a run, spans are placed by running sums); a corpus without
any span of a kind has no posterior for it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BASE = ["email", "ip", "card", "phone"]


class Shape(NamedTuple):
    kind: str
    pattern: str
    gate: str  # a cheap pattern that stands in every text with a match


#: The base patterns match what these do, leftmost and longest, without backtracking over a run:
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: [0-9]([\x20-]?[0-9])+   \+[0-9][\x20().0-9-]+[0-9]
SHAPES = [
    Shape("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|(?![A-Za-z0-9.-]))", "@"),
    Shape("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Shape("card", r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?<=[0-9])(?=[\x20-](?![0-9])|(?![0-9\x20-]))", r"[0-9](?:[\x20-]?[0-9]){12}"),
    Shape("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Shape("local_phone", r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    Shape("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]"),
    Shape("spelled_email", r"(?<![A-Za-z0-9._])[A-Za-z0-9._]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,24}", r"dot[)\]\x20]"),
    Shape("secret", r"(?i)(?:(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9/+_-]{8,128}[\"']?|(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9]))", r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]|AKIA"),
]
KINDS = [s.kind for s in SHAPES]

#: Fixed values.  Top-level domains, first digits of card issuers, country calling codes and keys that the gazetteers know.
DOMAINS = "com org net edu gov mil int info biz io dev app ai co me tv eu uk de fr es it nl be ch at se no dk fi pl cz ru ua cn jp kr in br mx ca au nz za".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
AREA = r"^\(?[2-9][0-8][0-9]"
KEYS = r"(?i)^(?:password|passwd|pwd|secret|api[_-]?key|AKIA)"
#: Fixed values.  Words that stand before a span of the kind, and words that speak against one of any kind.
BEFORE = {
    "email": "mail contact reach write address courriel correo kontakt",
    "ip": "ip server host addr login from adresse",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel call mobile cell fax contact telefon telefono",
    "local_phone": "phone tel call mobile cell fax contact telefon telefono",
    "national_id": "ssn social security tax id",
    "spelled_email": "mail contact reach write address",
    "secret": "key credential login user auth config export set",
}
AGAINST = "isbn issn version order invoice page figure table chapter section example line row"

LABELERS = 5
FEATURES = {"size": 5, "digits": 4, "left": 4, "broken": 2}


def _said_before(words: str) -> Column:
    return F.col("before").rlike(rf"(?i)(?:^|[^A-Za-z])(?:{'|'.join(words.split())})[A-Za-z]{{0,4}}[^A-Za-z]{{0,12}}$")


def _by_kind(columns: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for kind, c in columns.items():
        out = F.when(F.col("kind") == KINDS.index(kind), c).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    """Of at most 19 digits."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10 == 0


def spans(docs: DataFrame) -> DataFrame:
    """A row for each proposed span (kind, start, end; base: a base span that holds; votes; features), and one for a text without."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gates = F.array_compact(F.array(*(F.when(F.col("text").rlike(s.gate), F.lit(i)) for i, s in enumerate(SHAPES))))
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    df = df.select("row", "doc_id", "text", F.explode_outer(gates).alias("kind"))
    pattern = F.element_at(F.array(*(F.lit(s.pattern) for s in SHAPES)), F.col("kind") + 1)
    df = df.withColumn("pattern", pattern)
    cut = F.when(F.col("kind").isNotNull(), F.arrays_zip(F.split("text", F.col("pattern"), -1).alias("before"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("value")))
    df = df.select("row", "doc_id", "kind", F.posexplode_outer(F.filter(cut, lambda x: x["value"].isNotNull())).alias("nth", "x"))
    df = df.select("row", "doc_id", "kind", "nth", F.length("x.before").alias("gap"), F.right("x.before", F.lit(40)).alias("before"), F.length("x.value").cast("long").alias("size"), F.col("x.value").alias("value"))
    df = df.withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    count = F.length("digits")
    number = lambda p: F.ltrim(p, F.lit("0"))
    small = F.forall(F.split("value", r"\."), lambda p: F.when(F.length(number(p)) > 3, F.lit(False)).otherwise(F.coalesce(F.try_to_number(F.lpad(number(p), 3, "0"), F.lit("000")), F.lit(0)) <= 255))
    luhn = F.when(count.between(13, 19), _luhn(F.col("digits"))).otherwise(F.lit(False))
    holds = _by_kind({"email": F.lit(True), "ip": small, "card": luhn, "phone": count.between(9, 15)}, F.lit(False))
    df = df.withColumn("base", F.when(F.col("size").isNotNull(), holds))
    yes, no, silent = F.lit("y"), F.lit("n"), F.lit("-")
    vote = lambda c, otherwise=silent: F.when(c, yes).otherwise(otherwise)
    top = F.lower(F.substring_index("value", ".", -1))
    shape = _by_kind({"email": vote(F.col("value").rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9_]@[A-Za-z0-9]"), no), "ip": vote(~F.col("value").rlike(r"(?:^|\.)0[0-9]"), no), "card": vote(F.col("value").rlike(r"^(?:[0-9]+|(?:[0-9]{4}[ -]){3}[0-9]{1,7})$"), no), "phone": vote(F.col("value").rlike(r"^\+[0-9]{1,3}[ (.-]"), silent), "secret": vote(F.col("value").rlike(r"[0-9]") & F.col("value").rlike(r"[=:] ?[\"']?(?=[A-Za-z0-9/+_-]*[A-Za-z])[A-Za-z0-9/+_-]{12,}|AKIA"), no)}, silent)
    known = _by_kind({"email": vote(top.isin(DOMAINS), no), "ip": vote(~F.col("value").rlike(r"^(?:0|127|255)\."), no), "card": vote(F.col("digits").rlike(ISSUERS), no), "phone": vote(F.col("value").rlike(CALLING), no), "local_phone": vote(F.col("value").rlike(AREA), no), "national_id": vote(~F.col("value").rlike("^(?:000|666|9)|-00-|-0000$"), no), "spelled_email": vote(F.lower(F.regexp_extract("value", "[A-Za-z]+$", 0)).isin(DOMAINS), no), "secret": vote(F.col("value").rlike(KEYS), silent)}, silent)
    near = _by_kind({k: vote(_said_before(w)) for k, w in BEFORE.items()}, silent)
    sums = _by_kind({"ip": vote(holds, no), "card": vote(luhn, no), "phone": vote(count.between(9, 15), no), "local_phone": vote(count == 10, no), "secret": vote((F.length(F.regexp_replace("value", "[^a-z]", "")) > 0) & (count >= 2) | F.col("value").rlike("AKIA"), no)}, silent)
    against = F.when(_said_before(AGAINST), no).otherwise(silent)
    last = F.right("before", F.lit(1))
    left = F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    share = F.floor(F.least(F.lit(3), 4 * count / F.greatest(F.length("value"), F.lit(1)))).cast("int")
    size = F.when(F.col("size") < 10, 0).when(F.col("size") < 16, 1).when(F.col("size") < 24, 2).when(F.col("size") < 48, 3).otherwise(4)
    broken = F.col("value").rlike(r"[ ().-]").cast("int")
    there = F.col("size").isNotNull()
    df = df.select("row", "doc_id", F.when(there, F.col("kind")).alias("kind"), "nth", "gap", "size", "base", F.when(there, F.concat(shape, known, near, sums, against)).alias("votes"), *(F.when(there, c).alias(f"f_{n}") for n, c in zip(FEATURES, (size, share, left, broken), strict=True)))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("nth"))  # only numbers move
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).drop("nth", "gap", "size")


def _log_ratio(good: float, bad: float) -> float:
    return math.log(good) - math.log(bad)


def estimate(patterns: dict[tuple[int, str], int], rounds: int = 50, trust: float = 0.8, strength: float = 10.0) -> tuple[dict[int, float], dict[tuple, float], dict[tuple[int, str], float]]:
    """Expectation-maximisation over counts of (kind, votes).

    Labelers start as right with probability ``trust``, held there by ``strength`` pseudo-counts.  Returns the share of true spans by
    kind, the log ratio of each (kind, labeler, vote), and the posterior of each pattern."""
    prior, ratio, posterior = {}, {}, {}
    for kind in sorted({k for k, _ in patterns}):
        counts = {v: n for (k, v), n in patterns.items() if k == kind}
        share = 0.5
        good = {(j, v): trust if v == "y" else 1 - trust for j in range(LABELERS) for v in "yn"}
        bad = {(j, v): 1 - good[j, v] for j, v in good}
        for _ in range(rounds):
            after = {}
            for v in counts:
                z = _log_ratio(share, 1 - share) + sum(_log_ratio(good[j, c], bad[j, c]) for j, c in enumerate(v) if c != "-")
                after[v] = 1 / (1 + math.exp(-max(-500, min(500, z))))
            total = sum(counts.values())
            share = (sum(n * after[v] for v, n in counts.items()) + 1) / (total + 2)
            for j in range(LABELERS):
                for side, weight in ((good, lambda v: after[v]), (bad, lambda v: 1 - after[v])):
                    seen = {c: sum(n * weight(v) for v, n in counts.items() if v[j] == c) for c in "yn"}
                    right = trust if side is good else 1 - trust
                    all_ = seen["y"] + seen["n"] + strength
                    side[j, "y"], side[j, "n"] = (seen["y"] + strength * right) / all_, (seen["n"] + strength * (1 - right)) / all_
        prior[kind] = share
        ratio |= {(kind, j, v): _log_ratio(good[j, v], bad[j, v]) for j, v in good}
        posterior |= {(kind, v): p for v, p in after.items()}
    return prior, ratio, posterior


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*(F.lit(x) for item in values.items() for x in item))[key], F.lit(0.0))


def classify(found: DataFrame) -> DataFrame:
    """Adds probability: what the classifier trained on these spans gives to each."""
    real = found.where("kind IS NOT NULL")
    patterns = {(r.kind, r.votes): r.n for r in real.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    prior, ratio, posterior = estimate(patterns)
    soft = _lookup({f"{k}{v}": p for (k, v), p in posterior.items()}, F.concat(F.col("kind").cast("string"), F.col("votes")))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"f_{f}").alias("value")) for f in FEATURES)))
    sums = real.select("kind", soft.alias("p"), each.alias("x")).groupBy("kind", "x.feature", "x.value").agg(F.sum("p").alias("good"), F.sum(1 - F.col("p")).alias("bad")).collect()
    of: dict[tuple, list[float]] = {}
    for r in sums:
        total = of.setdefault((r.kind, r.feature), [0.0, 0.0])
        total[0] += r.good
        total[1] += r.bad
    weight = {f"{r.kind}/{r.feature}/{r.value}": _log_ratio((r.good + 1) / (of[r.kind, r.feature][0] + FEATURES[r.feature]), (r.bad + 1) / (of[r.kind, r.feature][1] + FEATURES[r.feature])) for r in sums}
    kind = F.col("kind").cast("string")
    z = _lookup({str(k): _log_ratio(p, 1 - p) for k, p in prior.items()}, kind)
    for j in range(LABELERS):
        z = z + _lookup({f"{k}{v}": w for (k, i, v), w in ratio.items() if i == j}, F.concat(kind, F.substring("votes", j + 1, 1)))
    for f in FEATURES:
        z = z + _lookup({k: w for k, w in weight.items() if k.split("/")[1] == f}, F.concat(kind, F.lit(f"/{f}/"), F.col(f"f_{f}").cast("string")))
    return found.withColumn("probability", F.when(F.col("kind").isNotNull(), 1 / (1 + F.exp(-z))))


def judged(docs: DataFrame) -> DataFrame:
    """``spans`` with probability and kept; the spans are written once to the shared folder, texts are read once."""
    found = classify(common.checkpoint(spans(docs)))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), "end", F.desc("kind"))  # a frame up to the end would be scanned anew for each row
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, backwards))
    loose = (F.col("kind") >= len(BASE)) & (F.col("probability") >= 0.5)
    taken = F.col("base") | loose
    free = ~F.coalesce(F.max(F.when(taken, F.col("end"))).over(before) > F.col("start"), F.lit(False)) & ~F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end"), F.lit(False))
    return found.withColumn("kept", F.when(F.col("kind").isNotNull(), F.col("base") | (loose & free)))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, base, probability of each span that stays."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return judged(docs).where("kept").select("doc_id", kind.alias("kind"), "start", "end", "base", "probability")


def report(docs: DataFrame) -> DataFrame:
    """A row for each document: base spans by kind, their digest, all spans that stay, their number (n_spans) and that of each kind which
    the method adds."""
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct("kind", "start", "end"))))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(BASE)]
    counts += [F.count_if(F.col("kept") & ~F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS) if k not in BASE]
    counts.append(F.count_if("kept").alias("n_spans"))
    each = judged(docs).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, listed(F.col("base")).alias("of_base"), listed(F.col("kept")).alias("of_all"))
    return each.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(written("of_base").cast("binary"), 256).alias("base_sha256"), written("of_all").alias("spans"), "n_spans", *(f"n_{k}" for k in KINDS if k not in BASE))
