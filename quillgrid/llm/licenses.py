"""License scan: ordered signature rules behind a keyword prefilter.

A text's distinct words are first held against the rules' keywords; most texts have none and no expression
runs. Rules with a keyword that is present are matched, and detections are ordered by priority, then length, then
place. A detection that lies inside an interval that is already kept is suppressed, so a grant with its
version hides the bare title inside it; detections that only overlap both stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_text, table
from .decontamination import words_of
from .license_rules import RULES, Rule

BASE = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}


class Detection(NamedTuple):
    label: str
    priority: int
    start: int
    end: int


def gated(rules: list[Rule] = RULES) -> dict[bytes, list[Rule]]:
    by_keyword = defaultdict(list)
    for rule in rules:
        for keyword in rule.keywords:
            by_keyword[keyword].append(rule)
    return dict(by_keyword)


GATE = gated()


def kept(found: list[Detection]) -> list[Detection]:
    """Detections not contained in one of higher rank, in order of place.

    Kept intervals are held without those that contain no room for others, so that a text with thousands of
    detections is settled in about n log n steps.
    """
    starts, ends, out = [], [], []
    for d in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_left(starts, d.start + 1)  # the last outline interval that begins at or before d
        if at and ends[at - 1] >= d.end:
            continue
        out.append(d)
        low = at
        while low < len(starts) and ends[low] <= d.end:
            low += 1
        if at and starts[at - 1] == d.start:
            at -= 1
        starts[at:low], ends[at:low] = [d.start], [d.end]
    return sorted(out, key=lambda d: (d.start, d.end, d.label))


def detections(words: list[bytes], gate: dict[bytes, list[Rule]] = GATE) -> list[Detection]:
    """Kept detections, with start and end in words."""
    present = [gate[w] for w in sorted(gate.keys() & words)] if not gate.keys().isdisjoint(words) else []
    if not present:
        return []
    joined, places, at = b" ".join(words), [], 0
    for w in words:
        places.append(at)
        at += len(w) + 1
    found = []
    for rule in dict.fromkeys(r for rules in present for r in rules):
        for m in rule.pattern.finditer(joined):
            found.append(Detection(rule.label, rule.priority, bisect_left(places, m.start()), bisect_left(places, m.end())))
    return kept(found)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    if b"license" not in words:
        return []
    found = []
    for i, w in enumerate(words):
        if w == b"license":
            found += [(i - len(p) + 1, label) for p, label in BASE.items() if i + 1 >= len(p) and tuple(words[i - len(p) + 1 : i + 1]) == p]
    return sorted(found)


def confidence(found: list[Detection], n_base: int) -> float:
    """1 - the product of each evidence's doubt: priority / 100 for a detection, a half for a base phrase."""
    doubt = 0.5 ** min(n_base, 50)
    for d in found:
        doubt *= 1 - d.priority / 100
    return round(1 - doubt, 6)


def scan(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`df` with _n_words, _base (array of first word and label) and _found (detections).

    Null and empty texts have no words and nothing found; repeated rows are scanned each.
    """

    def read(texts: list[bytes | None]) -> Iterator[tuple[int, list[dict], list[dict]]]:
        for t in texts:
            words = words_of(t)
            yield len(words), [{"start": i, "label": x} for i, x in base_places(words)], [d._asdict() for d in detections(words)]

    return from_text(df, text, "_n_words long, _base array<struct<start:long,label:string>>, _found array<struct<label:string,priority:int,start:long,end:long>>", read, keep_text=keep_text)


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with its base phrases, its labels and a score."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    doubt = F.aggregate("_found", F.pow(F.lit(0.5), F.least(F.size("_base"), F.lit(50))), lambda a, d: a * (1 - d["priority"] / 100.0))
    starts = F.transform("_base", lambda x: x["start"])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names("_base")).alias("base_labels"),
        joined(F.concat(names("_base"), names("_found"))).alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
    )
