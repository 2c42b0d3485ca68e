"""License scan by ordered signature rules.

A rule is a pattern over the words of a text, keywords without which it can't match, a label, a
priority and a confidence. Signatures of license texts are in ``license_rules``; ways of naming a license are here. One automaton over all keywords decides which rules run on which text.
Overlapping detections are settled by priority, then length: one that lies inside an interval that
is already taken is suppressed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.common import LOWER, binary_values, blocks, documents
from tabloom.llm.license_rules import WORDINGS

#: Phrases that are always reported, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label, keyword that every way of writing it contains, pattern of the name over lower-case words.
FAMILIES = [
    ("mit", "mit", r"mit"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("apache", "apache", r"apache(?: software)?(?: license)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license (?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)? (?:version |v)?2(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public license"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license (?:version |v)?2(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license (?:version |v)?3(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl", "library", r"(?:gnu )?library general public license"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: (?:version |v)?[23](?: [01])?)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: (?:version |v)?3(?: 0)?)?"),
    ("bsd", "bsd", r"bsd"),
    ("bsd-2-clause", "bsd", r"(?:(?:2|two) clause|simplified) bsd|bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three) clause|modified|new) bsd|bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause|original) bsd|bsd 4 clause"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: (?:version |v)?2 0)?"),
    ("mpl-2.0", "mpl", r"mpl (?:version |v)?2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v)?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: (?:version |v)?2 0)?"),
    ("cddl", "development", r"common development and distribution license"),
    ("cpl-1.0", "common", r"common public license"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("bsl-1.0", "boost", r"boost(?: software)?"),
    ("artistic-2.0", "artistic", r"artistic(?: license)?(?: 2 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ofl-1.1", "open", r"(?:sil )?open font license"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python", "python", r"python software foundation"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("odbl", "database", r"open database license"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?"),
    ("cc-by", "cc", r"cc by(?: [1-4](?: [05])?)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4](?: [05])?)?"),
]

#: Ways of stating a license by its name: a second keyword, pattern around the name, priority, confidence.
STATEMENTS = [
    ("spdx", r"spdx license identifier {n}(?: (?:only|or later))?", 90, 1.0),
    ("licen", r"(?:is |are )?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?", 80, 0.95),
    ("under", r"(?:distributed|released|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?", 75, 0.9),
    ("terms", r"(?:subject to|under) the terms of (?:the )?{n}(?: licen[cs]e)?", 70, 0.85),
    ("licen", r"{n} licen[cs]e", 60, 0.8),
    ("licen", r"licen[cs]e {n}", 55, 0.7),
]

@dataclass(frozen=True)
class Rule:
    label: str
    keywords: frozenset[str]
    pattern: re.Pattern
    priority: int
    confidence: float
    base: bool = False


def rules() -> tuple[Rule, ...]:
    """All rules in order of priority; phrases of ``BASE`` come first."""
    whole = lambda p: re.compile(f"(?<= )(?:{p})(?= )")
    out = [Rule(label, frozenset(["licen"]), whole(re.escape(p)), 100, 0.8, True) for p, label in BASE.items()]
    for label, keyword, name in FAMILIES:
        for second, shape, priority, confidence in STATEMENTS:
            keys = frozenset([keyword, second])
            out.append(Rule(label, keys, whole(shape.format(n=f"(?:{name})")), priority, confidence))
    out += [Rule(label, frozenset([key]), whole(p), priority, conf) for label, key, p, priority, conf in WORDINGS]
    return tuple(sorted(out, key=lambda r: -r.priority))


def prefilter(ordered: tuple[Rule, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for keyword in set().union(*(r.keywords for r in ordered)):
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return automaton


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[0x00:0x30] = _WORD_BYTE[0x3A:0x61] = _WORD_BYTE[0x7B:0x80] = False


@dataclass(frozen=True)
class Detection:
    label: str
    first: int
    last: int
    priority: int
    confidence: float
    base: bool


def detections(text: str, ordered: tuple[Rule, ...], automaton: ahocorasick.Automaton) -> list[Detection]:
    """Every detection of every rule that its keywords let run; ``text`` is lower case already."""
    found = {keyword for _, keyword in automaton.iter(text)}
    if not found:
        return []
    words = WORD.findall(text)
    line = " " + " ".join(words) + " "
    starts = np.cumsum([1] + [len(w) + 1 for w in words])
    out = []
    for rule in ordered:
        if not rule.keywords <= found:
            continue
        at = 0
        while m := rule.pattern.search(line, at):
            first = int(np.searchsorted(starts, m.start()))
            last = int(np.searchsorted(starts, m.end() + 1)) - 1
            out.append(Detection(rule.label, first, last, rule.priority, rule.confidence, rule.base))
            at = m.start() + 1  # places may overlap
    return out


def settle(found: list[Detection]) -> list[Detection]:
    """Drop what lies inside an interval of at least its priority that is already kept.

    Base phrases are always kept, and take no interval: a longer statement around one names it better.
    """
    kept: list[Detection] = [d for d in found if d.base]
    rest = [d for d in found if not d.base]
    place = {w: i + 1 for i, w in enumerate(sorted({d.first for d in rest}))}
    reach = [-1] * (len(place) + 1)  # a tree of the furthest end of kept intervals that begin so early
    for d in sorted(rest, key=lambda d: (-d.priority, d.first - d.last, d.first, d.label)):
        at, end = place[d.first], -1
        while at:
            end = max(end, reach[at])
            at &= at - 1
        if d.last > end:
            kept.append(d)
            at = place[d.first]
            while at < len(reach):
                reach[at] = max(reach[at], d.last)
                at += at & -at
    return kept


def _joined(labels) -> str:
    return ",".join(sorted(set(labels)))


def summary(found: list[Detection]) -> tuple:
    kept = settle(found)
    base = [d for d in kept if d.base]
    miss, best = 1.0, defaultdict(float)
    for d in kept:
        best[d.label] = max(best[d.label], d.confidence)
    for c in best.values():
        miss *= 1 - c
    spans = sorted((d.first, d.last, d.label) for d in kept)
    return (
        len(base),
        min((d.first for d in base), default=None),
        max((d.first for d in base), default=None),
        _joined(d.label for d in base),
        _joined(best),
        round(1 - miss, 6),
        [{"label": label, "first_word": a, "last_word": b} for a, b, label in spans],
    )


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64())]
    + [("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("detections", pa.list_(_SPAN))]
)
_DDL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<label: string, first_word: long, last_word: long>>"
)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words per text, from the places where one begins."""
    inside = _WORD_BYTE[LOWER[data]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordered = rules()
    automaton = prefilter(ordered)
    for batch in batches:
        data, offsets = binary_values(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in blocks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            own = offsets[lo : hi + 1] - offsets[lo]
            n_words = _counts(part, own)
            lowered = LOWER[part].tobytes()
            texts = (lowered[own[i] : own[i + 1]].decode() for i in range(hi - lo))
            rows = [summary(detections(text, ordered, automaton)) for text in texts]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_OUT)[2:])]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(n_words, pa.int64()), *columns], schema=_OUT
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, repeated ones too: counts, labels, score and settled detections.

    Only A-Z are lower-cased; a word is a run of digits, letters and characters beyond ASCII, and
    words count from 0. ``n_base`` counts every place of a base phrase, overlapping ones too;
    ``first_word`` and ``last_word`` are the smallest and largest start of one, null without any.
    ``score`` is the chance that at least one label holds, taking confidences as independent. A
    null text counts as empty and null ids stay null. Extra columns are not read. Narrow: no shuffle.
    """
    rows = documents(docs, id_col, text_col)
    return rows.withColumn("doc_id", rows["doc_id"].cast("long")).mapInArrow(_scan, _DDL)
