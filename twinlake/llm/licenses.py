"""License scan with ordered signature rules, in DataFrame operations only.

Texts are read as words (A-Z as a-z; what isn't a letter, a digit or outside ASCII separates).  Several hundred regular expressions,
hand-written ones for the licenses' own texts (``license_rules``) and, from a table of licenses, those for their identifiers, grants,
addresses, titles and mentions, run over a text's words joined by single spaces.  A rule only runs where one of its keywords stands in
the text, which one pass of hash lookups over the words tells.  A name that is also an ordinary word (python, boost, apache) is a
mention only beside a word such as "license"; an abbreviation (gpl) is one with a version as well.

Detections overlap.  They are settled by priority, then length, then the order of rules, and only one that stays suppresses others:
those of a worse priority that overlap it, and those of its own that it contains.  So of detections in conflict one always stays.
Priorities are settled one after the other by running maxima and minima over a text's detections in order of place; containment is
transitive, so within a priority it needs no order.  A text with very many detections costs no more than sorting them.

Cases: null text is empty and has no words; null doc_id and repeated rows each keep their row; very long texts and any number of
detections are handled; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import TEXTS

#: Fixed values.  Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values.  label | title in words | versions | short names in words | words of its address
LICENSES = """
apache | apache license | 1.0 1.1 2.0 | apache | apache org licenses license
gpl | gnu general public license | 1.0 2.0 3.0 | gpl, gnu gpl | gnu org licenses gpl
lgpl | gnu lesser general public license | 2.0 2.1 3.0 | lgpl, gnu lgpl | gnu org licenses lgpl
agpl | gnu affero general public license | 1.0 3.0 | agpl, gnu agpl | gnu org licenses agpl
gfdl | gnu free documentation license | 1.1 1.2 1.3 | gfdl, gnu fdl | gnu org licenses fdl
mit | mit license | | mit, expat | opensource org licenses mit
bsd-2-clause | bsd 2 clause license | | bsd 2 clause, simplified bsd, freebsd | opensource org licenses bsd 2 clause
bsd-3-clause | bsd 3 clause license | | bsd 3 clause, new bsd, revised bsd, modified bsd | opensource org licenses bsd 3 clause
bsd-4-clause | bsd 4 clause license | | bsd 4 clause, original bsd | opensource org licenses bsd 4 clause
isc | isc license | | isc | opensource org licenses isc
mpl | mozilla public license | 1.0 1.1 2.0 | mpl, mozilla | mozilla org mpl
epl | eclipse public license | 1.0 2.0 | epl, eclipse | eclipse org legal epl
cddl | common development and distribution license | 1.0 1.1 | cddl | opensource org licenses cddl
cpl | common public license | 1.0 | cpl | opensource org licenses cpl
artistic | artistic license | 1.0 2.0 | perl artistic | opensource org licenses artistic license
bsl | boost software license | 1.0 | boost | boost org license
unlicense | unlicense | | unlicense | unlicense org
wtfpl | do what the fuck you want to public license | 1.0 2.0 | wtfpl | wtfpl net
zlib | zlib license | | zlib | opensource org licenses zlib
postgresql | postgresql license | | postgresql | opensource org licenses postgresql
python | python software foundation license | 2.0 | psf, python | docs python org license
ofl | sil open font license | 1.0 1.1 | ofl, sil ofl | scripts sil org ofl
eupl | european union public licence | 1.0 1.1 1.2 | eupl | joinup ec europa eu eupl
osl | open software license | 1.0 2.0 2.1 3.0 | osl | opensource org licenses osl
afl | academic free license | 1.2 2.0 2.1 3.0 | afl | opensource org licenses afl
ms-pl | microsoft public license | | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal license | | ms rl | opensource org licenses ms rl
odbl | open database license | 1.0 | odbl | opendatacommons org licenses odbl
odc-by | open data commons attribution license | 1.0 | odc by | opendatacommons org licenses by
pddl | public domain dedication and license | 1.0 | pddl | opendatacommons org licenses pddl
ssplv | server side public license | 1.0 | sspl | mongodb com licensing server side public license
busl | business source license | 1.1 | busl | mariadb com bsl11
elastic | elastic license | 2.0 | elastic | elastic co licensing elastic license
cc0 | creative commons zero | 1.0 | cc0, cc zero | creativecommons org publicdomain zero
cc-by | creative commons attribution | 1.0 2.0 2.5 3.0 4.0 | cc by | creativecommons org licenses by
cc-by-sa | creative commons attribution share ?alike | 1.0 2.0 2.5 3.0 4.0 | cc by sa | creativecommons org licenses by sa
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s | 1.0 2.0 2.5 3.0 4.0 | cc by nd | creativecommons org licenses by nd
cc-by-nc | creative commons attribution non ?commercial | 1.0 2.0 2.5 3.0 4.0 | cc by nc | creativecommons org licenses by nc
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike | 1.0 2.0 2.5 3.0 4.0 | cc by nc sa | creativecommons org licenses by nc sa
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s | 1.0 2.0 2.5 3.0 4.0 | cc by nc nd | creativecommons org licenses by nc nd
"""

#: Fixed values.  Kinds of rules, best first, and how sure each is.
KINDS = {"identifier": 1.0, "grant": 0.95, "text": 0.9, "address": 0.85, "title": 0.8, "mention": 0.5}

_LOWER = {chr(c): chr(c + 32) for c in range(0x41, 0x5B)}
_BREAKS = [chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))]


#: Words that say little about which license is meant; a rule's keyword is another one if there is any.
_COMMON = set("a and any by clause common data do for free general in is license licence new of open or org public software source the this to what you".split())
_GRANTS = "licensed licenced released distributed available published redistributed provided covered".split()
_SAYS = "license licence licensed licenced licensing".split()


#: Fixed values.  Abbreviations that name a license and nothing else; other short names are ordinary words as well.
_CLEAR = set("gpl lgpl agpl fdl gfdl mpl epl cddl cpl bsl wtfpl ofl eupl osl afl odbl odc pddl sspl busl cc0 cc".split())


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    confidence: float
    keys: list[str]  # one of them stands in every match
    needs: list[str]  # and one of these, if there are any
    pattern: str


def _key(words: str) -> str:
    """The most telling plain word that stands in every match of these words."""
    depth, plain, word = 0, [], ""
    for c in words + " ":
        if c in "([{":
            depth += 1
            word = "?"
        elif c in ")]}":
            depth -= 1
            word = "?"
        elif depth == 0 and c == " ":
            if word.isalnum():
                plain.append(word)
            word = ""
        elif depth == 0:
            word += c
    return max(plain, key=lambda w: (w not in _COMMON and not w.isdigit(), len(w), w))


def rules() -> list[Rule]:
    """All rules in order: by kind, then as the tables list them, the newest version of a license first."""
    found: list[tuple[str, str, list[str], list[str], str]] = []  # kind, label, keys, needs, pattern
    for line in LICENSES.strip().splitlines():
        label, title, versions, short, address = (x.strip() for x in line.split("|"))
        names = [title, *(x.strip() for x in short.split(","))]
        either, keys = "|".join(sorted(names, key=len, reverse=True)), sorted(set(map(_key, names)))
        for version in [*sorted(versions.split(), reverse=True), ""]:
            major, _, minor = version.partition(".")
            number = f"(?: version| v| ver)? ?v?{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}") if version else ""
            own = f"{label}-{version}" if version else label
            words = label.replace("-", " ")
            found.append(("identifier", own, ["spdx"], [], f"spdx license identifier {words}" + (f" {major}(?: {minor})?(?: only| or later)?" if version else "")))
            found.append(("grant", own, keys, _GRANTS, f"(?:licen[sc]ed|released|distributed|available|published|redistributed|provided|covered)(?: to you)? (?:under|by)(?: the)?(?: terms of)?(?: the)? (?:{either})(?: licen[cs]e)?{number}"))
            found.append(("address", own, [_key(address)], [], f"{address}" + (f"(?: v)? ?{major}(?: {minor})?" if version else "")))
            found.append(("title", own, [_key(title)], [], f"{title}{number}"))
            if version:
                found.append(("mention", own, keys, _SAYS, f"(?:{either})(?: licen[cs]ed?{number}|{number} licen[cs]e)"))
                if clear := [n for n in names[1:] if _CLEAR & set(n.split())]:
                    found.append(("mention", own, sorted({*map(_key, clear), *(f"{n}{v}{major}" for n in clear for v in ("", "v"))}), [], f"(?:{'|'.join(sorted(clear, key=len, reverse=True))}){number}"))
            else:
                found.append(("mention", own, keys, _SAYS, f"(?:{either}) (?:licen[cs]ed?|licensing)"))
    for line in TEXTS.strip().splitlines():
        label, phrase = (x.strip() for x in line.split("|", 1))
        found.append(("text", label, [_key(phrase)], [], phrase))
    order = {k: i for i, k in enumerate(KINDS)}
    found.sort(key=lambda x: order[x[0]])
    return [Rule(i, label, order[kind], KINDS[kind], keys, needs, f"(?<= )(?:{pattern})(?= )") for i, (kind, label, keys, needs, pattern) in enumerate(found)]


def words_column(text: Column) -> Column:
    """The words of a text; none for null or a text without any."""
    source = "".join([*_LOWER, *_BREAKS])
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), source, "".join(_LOWER.values()) + " " * len(_BREAKS)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def _spaces(piece: Column) -> Column:
    return (F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))).cast("long")


def _scanned(docs: DataFrame) -> DataFrame:
    """A row for each document: its words' number, base places, and the rules of which it has a keyword with its padded text."""
    every = rules()
    of: dict[str, list[int]] = {}
    for r in every:
        for key in r.keys:
            of.setdefault(key, []).append(r.number)
    numbers = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    by_key = F.create_map(*(x for key, x in sorted(of.items()) for x in (F.lit(key), numbers(x))))
    looked_for = sorted({*of, *_GRANTS, *_SAYS, *(p.split()[0] for p in BASE)})
    needs = [(kind, numbers([r.number for r in every if r.needs == kind])) for kind in (_GRANTS, _SAYS)]
    base = f"(?<= )(?:{'|'.join(BASE)})(?= )"
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_column(F.col("text").cast("string")).alias("words"))
    df = df.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", strings(looked_for)).alias("found"), "words")
    chosen = F.flatten(F.transform(F.array_intersect("found", strings(sorted(of))), lambda w: by_key[w]))
    for kind, those in needs:
        chosen = F.when(F.arrays_overlap("found", strings(kind)), chosen).otherwise(F.array_except(chosen, those))
    df = df.select("row", "doc_id", "n_words", "found", "words", F.when(F.size("found") > 0, F.array_distinct(chosen)).alias("rules"))
    based = F.array_contains("found", "gnu") | F.array_contains("found", "cc") | (F.array_contains("found", "license") & F.arrays_overlap("found", strings(["apache", "mit"])))
    padded = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    df = df.select("row", "doc_id", "n_words", "rules", F.when((F.size("rules") > 0) | based, padded).alias("padded"), based.alias("based"))
    df = df.withColumns({"hits": F.when(F.col("based"), F.regexp_extract_all("padded", F.lit(base), F.lit(0))), "pieces": F.when(F.col("based"), F.split("padded", base, -1))})
    n = F.coalesce(F.when(F.size("hits") > 0, F.size("hits")), F.lit(0)).cast("long")
    label = F.create_map(*(F.lit(x) for item in BASE.items() for x in item))
    return df.select(
        "row",
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.when(n > 0, _spaces(F.get("pieces", F.lit(0))) - 1).alias("first_word"),
        F.when(n > 0, F.col("n_words") - (_spaces(F.element_at("pieces", -1)) - 1) - (_spaces(F.element_at("hits", -1)) + 1)).alias("last_word"),
        F.when(n > 0, F.array_sort(F.array_distinct(F.transform("hits", lambda h: label[h])))).otherwise(F.array().cast("array<string>")).alias("base"),
        "rules",
        "padded",
    )


def _detected(docs: DataFrame) -> DataFrame:
    """The rows of ``_scanned`` once for each detection (start, end: places in the padded text; rule), and once if there is none."""
    patterns = F.array(*(F.lit(r.pattern) for r in rules()))
    each = _scanned(docs).select("*", F.explode_outer("rules").alias("rule")).drop("rules").withColumn("pattern", F.element_at(patterns, F.col("rule") + 1))
    cut = F.when(F.col("rule").isNotNull(), F.arrays_zip(F.transform(F.split("padded", F.col("pattern"), -1), F.length).alias("before"), F.transform(F.regexp_extract_all("padded", F.col("pattern"), F.lit(0)), F.length).alias("size")))
    each = each.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "rule", F.posexplode_outer(F.filter(cut, lambda x: x["size"].isNotNull())).alias("nth", "x"))
    so_far = Window.partitionBy("row", "rule").orderBy("nth")
    end = F.sum(F.col("x.before") + F.col("x.size")).over(so_far)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.col("x.size")).drop("nth", "x")


def _kept(found: DataFrame) -> DataFrame:
    """Adds kept: a detection that none suppresses (null where the row has none)."""
    every = rules()
    priority = F.element_at(F.array(*(F.lit(r.priority) for r in every)), F.col("rule") + 1)
    found = found.withColumns({"priority": F.when(F.col("start").isNotNull(), priority), "kept": F.lit(None).cast("boolean")})
    forward = Window.partitionBy("row").orderBy("start", F.desc("end"), "rule")
    backward = Window.partitionBy("row").orderBy(F.desc("start"), "end", F.desc("rule"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (forward, backward))
    for p in range(len(KINDS)):
        mine, free = F.col("priority") == p, F.lit(True)
        if p:
            found = found.withColumn("next", F.min(F.when(F.col("kept"), F.col("start"))).over(after))
            free = ~(F.coalesce(F.max(F.when(F.col("kept"), F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
        found = found.withColumn("free", mine & free)
        inside = F.coalesce(F.max(F.when(F.col("free"), F.col("end"))).over(before) >= F.col("end"), F.lit(False))
        found = found.withColumn("kept", F.when(mine, F.col("free") & ~inside).otherwise(F.col("kept")))
    return found.drop("next", "free")


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, rule, label, start, end (characters of the text's words joined by single spaces) of each detection that stays."""
    every = rules()
    label = F.element_at(F.array(*(F.lit(r.label) for r in every)), F.col("rule") + 1)
    return _kept(_detected(docs)).where("kept").select("doc_id", "rule", label.alias("label"), (F.col("start") - 1).alias("start"), (F.col("end") - 1).alias("end"))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: its words, base places, base labels, all labels, and the confidence of its surest detection."""
    every = rules()
    at = F.col("rule") + 1
    labels, sure = F.array(*(F.lit(r.label) for r in every)), F.array(*(F.lit(r.confidence) for r in every))
    one = lambda c: F.first(c).alias(c)
    kept = _kept(_detected(docs)).withColumns({"label": F.when(F.col("kept"), F.element_at(labels, at)), "sure": F.when(F.col("kept"), F.element_at(sure, at))})
    each = kept.groupBy("row").agg(*map(one, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")), F.collect_set("label").alias("own"), F.max("sure").alias("sure"))
    score = F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(KINDS["mention"])).otherwise(F.lit(0.0)))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "own")), ",").alias("labels"), score.alias("score"))
