"""License detection by ordered signature rules, in Spark expressions.

A text becomes its words (A-Z lower-cased).  Each rule is a regular expression over words around a keyword: words before it, the keyword,
words after it.  The keywords are the prefilter: a text without any is done, and the rules of a keyword run only where it
stands, over the ``REACH`` words on either side (no rule spans more).  Every hit is an interval of words with the rule's priority.
An interval inside another of the same or a stronger priority is suppressed: "licensed under the apache license version 2.0"
is one detection, not three.  Everything happens inside the row: no join, no shuffle, no Python.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ascii_lower, whole_text

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
REACH = 24
MARK = "\u0001"

# The phrases whose places and labels are reported as they stand, with the place of their keyword.
BASE = [("gnu general public license", "gpl", "license"), ("apache license", "apache", "license"), ("cc by", "cc-by", "cc"),
        ("mit license", "mit", "license")]

# License names as words before the keyword, keyword, label; then versions as their words.
VERSIONED = [
    ("gnu general public", "license", "gpl", ["1", "2", "3"]), ("gnu (?:lesser|library) general public", "license", "lgpl", ["2", "2 1", "3"]),
    ("gnu affero general public", "license", "agpl", ["1", "3"]), ("gnu free documentation", "license", "gfdl", ["1 1", "1 2", "1 3"]),
    ("apache(?: software)?", "license", "apache", ["1 0", "1 1", "2 0"]), ("mozilla public", "license", "mpl", ["1 0", "1 1", "2 0"]),
    ("eclipse public", "license", "epl", ["1 0", "2 0"]), ("european union public", "license", "eupl", ["1 0", "1 1", "1 2"]),
    ("artistic", "license", "artistic", ["1 0", "2 0"]), ("boost software", "license", "bsl", ["1 0"]),
    ("common development and distribution", "license", "cddl", ["1 0", "1 1"]), ("common public", "license", "cpl", ["1 0"]),
    ("academic free", "license", "afl", ["1 1", "2 0", "2 1", "3 0"]), ("open software", "license", "osl", ["1 0", "2 0", "2 1", "3 0"]),
    ("sil open font", "license", "ofl", ["1 0", "1 1"]), ("zope public", "license", "zpl", ["1 1", "2 0", "2 1"]),
    ("python software foundation", "license", "psf", ["2"]), ("php", "license", "php", ["3 0", "3 01"]),
    ("server side public", "license", "sspl", ["1"]), ("business source", "license", "busl", ["1 1"]),
    ("elastic", "license", "elastic", ["1", "2 0"]), ("", "gpl", "gpl", ["1", "2", "3"]), ("", "lgpl", "lgpl", ["2", "2 1", "3"]),
    ("", "agpl", "agpl", ["1", "3"]), ("", "mpl", "mpl", ["1 0", "1 1", "2 0"]), ("", "epl", "epl", ["1 0", "2 0"]),
]
PLAIN = [
    ("mit", "license", "", "mit"), ("expat", "license", "", "mit"), ("x11", "license", "", "x11"), ("isc", "license", "", "isc"),
    ("bsd", "license", "", "bsd"), ("zlib", "license", "", "zlib"), ("openssl", "license", "", "openssl"), ("ruby", "license", "", "ruby"),
    ("json", "license", "", "json"), ("postgresql", "license", "", "postgresql"), ("curl", "license", "", "curl"),
    ("vim", "license", "", "vim"), ("beerware", "license", "", "beerware"), ("university of illinois ncsa open source", "license", "", "ncsa"),
    ("microsoft public", "license", "", "ms-pl"), ("microsoft reciprocal", "license", "", "ms-rl"),
    ("open data commons attribution", "license", "", "odc-by"), ("open database", "license", "", "odbl"),
    ("", "bsd", " 2 clause(?: license)?", "bsd-2-clause"), ("", "bsd", " 3 clause(?: license)?", "bsd-3-clause"),
    ("", "bsd", " 4 clause(?: license)?", "bsd-4-clause"), ("simplified", "bsd", "(?: license)?", "bsd-2-clause"),
    ("(?:new|modified|revised)", "bsd", "(?: license)?", "bsd-3-clause"), ("", "unlicense", "", "unlicense"), ("", "wtfpl", "", "wtfpl"),
    ("creative", "commons", " attribution", "cc-by"), ("creative", "commons", " attribution share ?alike", "cc-by-sa"),
    ("creative", "commons", " attribution non ?commercial", "cc-by-nc"), ("creative", "commons", " attribution no ?derivatives", "cc-by-nd"),
    ("creative", "commons", " (?:zero|cc0)", "cc0"), ("", "cc0", "(?: 1 0)?", "cc0"), ("", "cc", " zero", "cc0"),
    ("(?:in|into|to) the public", "domain", "", "public-domain"),
]
CC_KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CC_VERSIONS = ["", "1 0", "2 0", "2 5", "3 0", "4 0"]
GENERIC = [("general public", "license", "", "gpl-like", 4), ("open source", "license", "", "open-source", 4),
           ("permissive", "license", "", "permissive", 4), ("commercial", "license", "", "commercial", 4),
           ("proprietary", "license", "", "proprietary", 4), ("all rights", "reserved", "", "all-rights-reserved", 4),
           ("", "copyright", "(?: c)?(?: \\d{4}){1,2}", "copyright", 4), ("end user", "license", " agreement", "eula", 4)]

#: Words before a name that make it a declaration, with priority (1 is strongest) and confidence.
LEADS = [("", 3, 0.7),
         ("(?:spdx license identifier |(?:this (?:file|work|software|program|document|package|library) is )?"
          "(?:licensed|released|distributed|published|available|provided) (?:under|with) (?:the )?(?:terms of )?(?:the )?)", 1, 1.0)]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    key: str
    pattern: str
    priority: int
    confidence: float


def _signatures():
    for left, key, label, versions in VERSIONED:
        yield left, key, "", label
        for v in versions:
            yield left, key, f"(?: version| v)? {v}", f"{label}-{v.replace(' ', '.')}"
            yield left, key, f" v(?:ersion)?{v}", f"{label}-{v.replace(' ', '.')}"
    yield from PLAIN
    for kind, version in product(CC_KINDS, CC_VERSIONS):
        yield "", "cc", f" {kind} {version}".rstrip(), "-".join(["cc", *kind.split(), *[version.replace(" ", ".")] * bool(version)])


def rules() -> list[Rule]:
    """Every rule, strongest first: names with each lead, then generic ones."""
    def pattern(lead: str, left: str, key: str, right: str) -> str:
        return f"(?<= ){lead}{left}{' ' * bool(left)}{MARK}{key}{right}(?= )"
    out = [Rule(f"{label}/{priority}/{i}", label, key, pattern(lead, left, key, right), priority, sure)
           for i, (left, key, right, label) in enumerate(_signatures()) for lead, priority, sure in LEADS]
    out += [Rule(f"{label}/generic", label, key, pattern("", left, key, right), priority, 0.4) for left, key, right, label, priority in GENERIC]
    return sorted(out, key=lambda r: r.priority)


def _table(ruleset: list[Rule]) -> Column:
    """The rules by keyword, as one constant."""
    by_key: dict[str, list[dict]] = {}
    for rule in ruleset:
        by_key.setdefault(rule.key, []).append(asdict(rule))
    kind = "map<string,array<struct<name:string,label:string,pattern:string,priority:int,confidence:double>>>"
    return F.from_json(F.lit(json.dumps(by_key)), kind)


def _hits(here: Column, table: Column) -> Column:
    """Hits of a keyword's rules where it stands: ``here`` has ``at`` (its place), ``key`` and ``around`` (the words near it)."""
    def spaces(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    def hit(rule: Column) -> Column:
        found = F.regexp_substr(here["around"], rule["pattern"])
        return F.transform(F.array(found), lambda m: F.when(m.isNotNull(), F.struct(
            (here["at"] - spaces(F.split_part(m, F.lit(MARK), F.lit(1)))).cast("long").alias("start"),
            (-here["at"] - 1 - spaces(F.split_part(m, F.lit(MARK), F.lit(2)))).cast("long").alias("minus_end"),
            rule["priority"].alias("priority"), rule["name"].alias("rule"), rule["label"].alias("label"),
            rule["confidence"].alias("confidence"))))[0]
    return F.array_compact(F.transform(F.coalesce(F.try_element_at(table, here["key"]), F.array()), hit))


def _suppressed(hits: Column, levels: int) -> Column:
    """``hits`` in order of start, longest first, without those inside a hit of the same or a stronger priority.

    One pass: going by start, a hit is inside an earlier one exactly if that one ends no sooner, so the furthest end per priority is
    all that must be known.
    """
    def step(state: Column, h: Column) -> Column:
        end = -h["minus_end"]
        covered = F.exists(F.slice(state["ends"], 1, h["priority"]), lambda e: e >= end)
        return F.struct(
            F.transform(state["ends"], lambda e, i: F.when((i == h["priority"] - 1) & (e < end), end).otherwise(e)).alias("ends"),
            F.when(covered, state["kept"]).otherwise(F.concat(state["kept"], F.array(
                F.struct(h["start"].alias("start"), end.alias("end"), h["label"].alias("label"), h["rule"].alias("rule"),
                         h["priority"].alias("priority"), h["confidence"].alias("confidence"))))).alias("kept"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint,label:string,rule:string,priority:int,confidence:double>>")
    start = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("ends"), empty.alias("kept"))
    return F.aggregate(F.array_sort(hits), start, step)["kept"]


def detect(docs: DataFrame, text_col: str = "text", ruleset: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``_scan``: ``n_words``, ``base`` (places of base phrases: start, label) and ``detections`` (start and end words,
    label, rule, priority, confidence), in text order.

    A null text is empty and has no words.  Places count from 0.  Equal intervals of one priority leave the rule first in
    alphabetical order.  Rows are independent, so repeated rows and ids, null ids and other columns do not matter.
    """
    ruleset = rules() if ruleset is None else ruleset
    keys = sorted({r.key for r in ruleset} | {k for _, _, k in BASE})
    low = ascii_lower(whole_text(text_col))
    gate = F.lit(False)
    for stem in [k for k in keys if not any(o in k and o != k for o in keys)]:   # a key that holds another is found with it
        gate = gate | low.contains(stem)
    words = F.when(gate, F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    counted = F.when(gate, F.lit(None).cast("long")).otherwise(F.regexp_count(low, F.lit(WORD)).cast("long"))

    def around(w: Column) -> Column:
        def near(i: Column) -> Column:
            lo = F.greatest(i - REACH, F.lit(0))
            before = F.concat_ws(" ", F.slice(w, lo + 1, i - lo))
            after = F.concat_ws(" ", F.slice(w, i + 2, F.lit(REACH)))
            return F.concat(F.lit(" "), before, F.when(i > 0, " ").otherwise(""), F.lit(MARK), F.element_at(w, i + 1), F.lit(" "), after, F.lit(" "))
        places = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(keys), i)))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.element_at(w, i + 1).alias("key"), near(i).alias("around")))

    def base(here: Column) -> Column:
        found = []
        for phrase, label, key in BASE:
            before, _, after = phrase.partition(key)
            hit = here["around"].contains(f" {before}{MARK}{key}{after} ")
            found.append(F.when((here["key"] == key) & hit, F.struct(
                (here["at"] - before.count(" ")).cast("long").alias("start"), F.lit(label).alias("label"))))
        return F.array_compact(F.array(*found))
    levels, table = max((r.priority for r in ruleset), default=1), _table(ruleset)
    scanned = F.transform(F.array(words), lambda w: F.transform(F.array(around(w)), lambda a: F.struct(
        F.size(w).cast("long").alias("n"), F.flatten(F.transform(a, base)).alias("base"),
        _suppressed(F.flatten(F.transform(a, lambda h: _hits(h, table))), levels).alias("detections")))[0])[0]
    named = docs.withColumn("_scan", scanned)
    return named.withColumn("_scan", F.struct(F.coalesce(counted, F.col("_scan")["n"]).alias("n_words"),
                                              F.col("_scan")["base"].alias("base"), F.col("_scan")["detections"].alias("detections")))


def summarise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ruleset: list[Rule] | None = None) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``n_detections``.

    ``score`` is the confidence of the surest detection, 0 without any.  An empty table gives an empty table.
    """
    found = detect(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", ruleset)
    scan = F.col("_scan")
    starts, sure = scan["base"]["start"], scan["detections"]["confidence"]
    own = F.array_distinct(scan["base"]["label"])
    return found.select(
        F.col("_id").alias(id_col), scan["n_words"].alias("n_words"), F.size(scan["base"]).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(own)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(own, scan["detections"]["label"]))).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"), F.size(scan["detections"]).cast("long").alias("n_detections"))
