"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, id_and_text, table, text_of, utf8
from .license_texts import TEMPLATES

#: Words of a fingerprint, and fingerprints of a window of which the least is kept. A template of fewer words is one fingerprint.
GRAM, WINDOW = 3, 3
#: A match covers at least this part of its template's words.
COVERAGE = 0.75
#: Places by which an alignment may leave its diagonal, besides a tenth of the template's words.
BAND = 4
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

# Words that tell licenses of alike wording apart. Names, and by a family's mark the words that its members differ in.
NAMES = {b"apache", b"boost", b"bsd", b"cc", b"cc0", b"creative", b"eclipse", b"gnu", b"isc", b"mit", b"mozilla", b"zlib"}
DIFFER = {
    b"gnu": {b"affero", b"lesser", b"library"},
    b"creative": {b"nc", b"nd", b"noncommercial", b"noderivatives", b"noderivs", b"sa", b"sharealike", b"zero"},
    b"redistributions": {b"endorse", b"neither"},
    b"spdx": {b"0bsd", b"agpl", b"gpl", b"lgpl", b"mpl", b"epl", b"unlicense"},
}
SAME = {b"cc": b"creative", b"cc0": b"creative", b"nc": b"noncommercial", b"nd": b"noderivatives", b"noderivs": b"noderivatives", b"sa": b"sharealike"}
#: A number after one of these is a version.
BEFORE_VERSION = {b"version", b"v", b"license", b"gpl", b"lgpl", b"agpl", b"mpl", b"epl", b"bsd", b"by", b"zero", b"attribution", b"cc0"} | DIFFER[b"creative"]
#: In or just before a match of a template of at most SHORT words, these say that the license doesn't hold.
SHORT, NEGATIONS = 16, frozenset({b"not", b"never", b"nor", b"neither", b"unlike", b"isn", b"aren", b"wasn", b"cannot"})


def told_by(words: list[bytes]) -> frozenset[bytes]:
    """What of words (in lower case) can tell licenses apart: names, members' words, and versions without .0 at the end. A member's word
    of the GNU family counts in a license's name only: any program may be called a library."""
    out, k = set(), 0
    for k, w in enumerate(words):
        if w in DIFFER[b"gnu"]:
            out |= {w} if words[k + 1 : k + 2] == [b"general"] else set()
        elif w in NAMES or any(w in x for x in DIFFER.values()):
            out.add(SAME.get(w, w))
        elif w.isdigit() and k and words[k - 1] in BEFORE_VERSION:
            run = [w, *(x for x in words[k + 1 : k + 2] if x.isdigit())]
            out.add(run[0] if run[1:] in ([], [b"0"]) else b".".join(run))
    return frozenset(out)


class Templates:
    """Templates as word numbers, what tells each apart, and the inverted index from fingerprint to (template, place)."""

    def __init__(self, templates: Iterable[tuple[str, str, str]] = TEMPLATES):
        self.names, self.words, self.marks, self.vocabulary = [], [], [], {}
        for license_, name, text in templates:
            words = [w.lower() for w in WORD.findall(text.encode())]
            if words:
                self.names.append((license_, name))
                self.marks.append(self.marks_of(words))
                self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            size = min(GRAM, len(words))
            prints = [zlib.crc32(np.array(words[i : i + size], dtype="<i4").tobytes()) for i in range(len(words) - size + 1)]
            for i in winnow(prints, WINDOW):
                self.index[size][self.gram(words[i : i + size])].append((t, i))
        self.keys = {size: np.array(sorted(x), dtype=np.int64) for size, x in self.index.items()}

    @staticmethod
    def marks_of(words: list[bytes]) -> tuple[frozenset[bytes], frozenset[bytes]]:
        """(the marks that a match must have, those that it may not have)."""
        own = told_by(words)
        # names bar each other only in notices, which name a license; a license's text may name anyone
        family = set().union(*(DIFFER[k] for k in DIFFER if k in own or k in words), NAMES if own & NAMES else ())
        return own, frozenset(SAME.get(w, w) for w in family) - own

    def agrees(self, t: int, words: list[bytes]) -> bool:
        """Whether a match with these words tells the same license as template t: the same names, members' words and versions."""
        must, never = self.marks[t]
        have = told_by(words)
        version = lambda x: {w for w in x if w[:1].isdigit()}
        return must <= have and not have & never and (not version(must) or version(have) == version(must))

    def denied(self, t: int, before: list[bytes], words: list[bytes]) -> bool:
        """Whether a short notice is put in the negative."""
        said = NEGATIONS.intersection(before) | NEGATIONS.intersection(words)
        return len(self.words[t]) <= SHORT and any(self.vocabulary.get(w) not in self.words[t] for w in said)

    def gram(self, words) -> int:
        value = 0
        for w in words:
            value = value * (len(self.vocabulary) + 1) + int(w)
        return value


def winnow(prints: list[int], window: int) -> list[int]:
    """Places of the least fingerprint of each window, the rightmost of equals; every run of window + GRAM - 1 words has one."""
    if len(prints) <= window:
        return [min(range(len(prints)), key=lambda i: (prints[i], -i))] if prints else []
    return sorted({min(range(k, k + window), key=lambda i: (prints[i], -i)) for k in range(len(prints) - window + 1)})


def align(template: list[int], words: list[int], shift: int, band: int) -> tuple[int, int, int, int]:
    """(matched words, first, end, template words between) of the best local alignment of the template with words on diagonals
    shift - band .. shift + band (place in words less place in the template): 2 for an equal word, -1 for a word changed, left out
    or put in.
    """
    width = 2 * band + 1
    score, matched, begin = [0] * (width + 1), [0] * (width + 1), [None] * (width + 1)
    best = (0, 0, (0, 0), 0, 0)
    for i, t in enumerate(template):
        new_score, new_matched, new_begin = [0] * (width + 1), [0] * (width + 1), [None] * (width + 1)
        first = i + shift - band
        for k in range(max(0, -first), min(width, len(words) - first)):
            j = first + k
            equal = words[j] == t
            s, m, b = score[k] + (2 if equal else -1), matched[k] + equal, begin[k]
            if score[k + 1] - 1 > s:  # a template word left out
                s, m, b = score[k + 1] - 1, matched[k + 1], begin[k + 1]
            if k and new_score[k - 1] - 1 > s:  # a word put in
                s, m, b = new_score[k - 1] - 1, new_matched[k - 1], new_begin[k - 1]
            if s > 0:
                b = (j, i) if b is None else b
                new_score[k], new_matched[k], new_begin[k] = s, m, b
                if s > best[0]:
                    best = (s, m, b, j + 1, i + 1)
        score, matched, begin = new_score, new_matched, new_begin
    _, m, (j0, i0), j1, i1 = best
    return m, j0, j1, i1 - i0


def coverage_of(matched: int, template_words: int, between: int, span: int) -> float:
    """Matched words as a part of the template's and of those put in."""
    return matched / (template_words + max(0, span - between))


def scan(raw: bytes, templates: Templates, coverage: float = COVERAGE) -> list[tuple[str, str, float, int, int]]:
    """(license, template, coverage, start, end) of matches in a UTF-8 text, in bytes; of matches that overlap, of whatever
    license, the one with most matched words and then the highest coverage stays. A match whose names, versions or members' words
    differ from its template's is none."""
    low = raw.lower()
    numbers = templates.vocabulary.get
    found = WORD.findall(low)
    ids = np.fromiter((numbers(w, 0) for w in found), dtype=np.int64, count=len(found))
    base = len(templates.vocabulary) + 1
    starts: dict[int, set[int]] = defaultdict(set)
    for size, keys in templates.keys.items():
        n = len(ids) - size + 1
        if n <= 0:
            continue
        gram, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(size):
            gram = gram * base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        at = np.flatnonzero(known)
        at = at[keys[np.minimum(np.searchsorted(keys, gram[at]), len(keys) - 1)] == gram[at]]
        for i in at.tolist():
            for t, place in templates.index[size][int(gram[i])]:
                starts[t].add(i - place)
    if not starts:
        return []
    words, matches = ids.tolist(), []
    for t, shifts in starts.items():
        template = templates.words[t]
        band = BAND + len(template) // 10
        end = None
        for shift in sorted(shifts):
            if end is not None and shift <= end:  # its diagonal lies in the last one's band
                continue
            matched, a, b, between = align(template, words, shift + band // 2, band)
            end = shift + band // 2
            covered = coverage_of(matched, len(template), between, b - a)
            if covered >= coverage and templates.agrees(t, found[a:b]) and not templates.denied(t, found[max(0, a - 3) : a], found[a:b]):
                matches.append((matched, covered, *templates.names[t], a, b))
    kept = []
    for m in sorted(matches, key=lambda m: (-m[0], -m[1], m[4], m[5], m[2], m[3])):
        if not any(k[4] < m[5] and m[4] < k[5] for k in kept):
            kept.append(m)
    if not kept:
        return []
    spans = [m.span() for m in WORD.finditer(low)]
    return sorted(((lic, name, round(c, 4), spans[a][0], spans[b - 1][1]) for _, c, lic, name, a, b in kept), key=lambda x: (x[3], x[4], x[0], x[1]))


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, templates=TEMPLATES) -> DataFrame:
    """Rows (id_col, found) for every row of docs; found: license, template, coverage (matched words as a part of the template's and
    of those put in), and start and end in code points, of every match in the whole text.

    Null and empty texts have none. The templates (a fixed list) go to the executors with the code; rows are mapped where they
    lie. Only texts that share a fingerprint with a template are aligned, along the diagonals of the shared ones.
    """
    source = id_and_text(docs, id_col, text_col)
    listed = tuple(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        own = Templates(listed)

        def of(raw: bytes) -> list[dict]:
            at = lambda k: len(text_of(raw[:k]))
            return [{"license": lic, "template": name, "coverage": c, "start": at(a), "end": at(b)} for lic, name, c, a, b in scan(raw, own, coverage)]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(x) for x in utf8(batch.column(1))], kind)], names=[id_col, "found"])

        return step

    return arrow_map(source, make, T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("found", FOUND)]))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    each = lambda x: F.concat_ws(":", x["license"], x["template"], x["coverage"].cast("string"), x["start"].cast("string"), x["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.array_join(F.transform("found", each), ",").alias("spans"),
        F.coalesce(F.array_max("found.coverage"), F.lit(0.0)).alias("best_coverage"),
    )
