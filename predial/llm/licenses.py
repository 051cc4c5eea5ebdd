"""License scans: exact phrases, and a fuzzy search for short notices.

A notice that may hold k errors is split into k + 1 seeds, of which one must occur unchanged (pigeonhole). An automaton
finds the seeds in one scan of the normalised words, and around each hit the regex library's bounded-error matching
decides and reports the span. The phrases are sought with errors too, from word to word and with a bound of their own.
Every text is searched whole.
"""

from bisect import bisect
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices in the words of common licenses, sought with errors.
NOTICES = {
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms": "gpl",
    "licensed under the mozilla public license": "mpl",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
}
#: Characters of a notice for each error that it may hold, which is also about its seeds' length.
PER_ERROR = 12
#: The same for the phrases.
PER_PHRASE_ERROR = 10
#: Misspelt phrases that name something else: from so many errors on, hits of this form.
OTHERS = {"under the mit license": (2, r"under the .* license"), "apache license version 2": (1, r".*[^2]"), "cc by nc": (1, r".*[^c]")}
_FOLD = bytes(i + 32 if 65 <= i < 91 else i if 48 <= i < 58 or 97 <= i < 123 or i >= 128 else 32 for i in range(256))
ROWS = "__id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "__id long, label string, start_word long, end_word long, n_errors long, matched string"


def normalise(text: str | None) -> str:
    """The text's words with one blank between them and around them: lower-cased, letters, digits and non-ASCII."""
    return f" {b' '.join((text or '').encode().translate(_FOLD).split()).decode()} "


class Scanner:
    """Phrases, notices with their allowed errors, and the automaton of their seeds."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], per_error: int):
        self.phrases, self.notices, self.labels, self.others = phrases, [], [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for phrase in phrases:
            seeds.setdefault(f" {phrase} ", []).append((-1, 0))
        bounds = [*((n, label, per_error, "") for n, label in notices.items()), *((p, label, PER_PHRASE_ERROR, " ") for p, label in phrases.items())]
        for notice, label, each, edge in bounds:
            k = max(1, len(notice) // each)
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((len(self.notices), a))
            around = ("(?<= )(?! )", "(?<! )(?= )") if edge else ("", "")
            pattern = regex.compile(rf"(?b){around[0]}(?:{regex.escape(notice)}){{e<={k}}}{around[1]}")
            self.notices.append((notice, k, pattern))
            self.labels.append(label)
            self.others.append(OTHERS.get(notice) if edge else None)
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, int]]]:
        """Exact places (label, start, end) and fuzzy spans (notice, start, end, errors) in a normalised text."""
        exact, windows = [], {}
        for end, (size, where) in self.automaton.iter(text):
            for notice, offset in where:
                if notice < 0:
                    phrase = text[end - size + 2 : end]
                    exact.append((self.phrases[phrase], end - size + 2, end))
                else:
                    whole, k, _ = self.notices[notice]
                    start = end - size + 1 - offset
                    windows.setdefault(notice, []).append((max(0, start - 2 * k), min(len(text), start + len(whole) + 2 * k)))
        spans = []
        for notice, places in windows.items():
            spans.extend((notice, *hit) for hit in self._hits(notice, text, sorted(set(places))))
        return exact, spans

    def _hits(self, notice: int, text: str, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The notice's (start, end, errors) within the windows, in order; of hits that overlap the better one stays.

        The library gives the best hit of a stretch, so what lies on either side of it is searched as well.
        """
        pattern, found = self.notices[notice][2], set()
        while places:
            low, high = places.pop()
            if hit := pattern.search(text, low, high):
                found.add((sum(hit.fuzzy_counts), hit.start(), hit.end()))
                places += [(low, hit.start()), (max(hit.end(), hit.start() + 1), high)]
        taken: list[tuple[int, int, int]] = []
        for errors, start, end in sorted(found):
            at = bisect(taken, (start, end, errors))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (start, end, errors))
        return [x for x in taken if not self._other(notice, text[x[0] : x[1]], x[2])]

    def _other(self, notice: int, span: str, errors: int) -> bool:
        """Whether a hit names another license or version."""
        rule = self.others[notice]
        return rule is not None and errors >= rule[0] and span.replace(" ", "") != self.notices[notice][0].replace(" ", "") and regex.fullmatch(rule[1], span) is not None


@lru_cache(4)
def _scanner(phrases: tuple, notices: tuple, per_error: int) -> Scanner:
    return Scanner(dict(phrases), dict(notices), per_error)


def _each(batches, phrases, notices, per_error):
    scanner = _scanner(tuple(phrases.items()), tuple(notices.items()), per_error)
    for batch in batches:
        for name, text in zip(batch.column(0), batch.column(1)):
            text = normalise(text.as_py())
            yield name.as_py(), text, *scanner.scan(text), scanner


def _rows(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, per_error: int = PER_ERROR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its words, its exact places and their labels, all labels, and a score.

    The score is 1 with an exact phrase, else the best notice's or phrase's share of unchanged characters, else 0. A null or empty
    text has no words and no labels ('' in both label columns); null ids and repeated rows are kept.
    """

    def report(batches):
        out: list[tuple] = []
        for name, text, exact, spans, scanner in _each(batches, phrases, notices, per_error):
            base = {label for label, _, _ in exact}
            more = {scanner.labels[n] for n, *_ in spans}
            starts = [text.count(" ", 0, min(x[1] for x in exact)) - 1, text.count(" ", 0, max(x[1] for x in exact)) - 1] if exact else [None, None]
            score = 1.0 if exact else max((1 - e / len(scanner.notices[n][0]) for n, _, _, e in spans), default=0.0)
            out.append((name, max(0, text.count(" ") - 1) if len(text) > 2 else 0, len(exact), *starts, ",".join(sorted(base)), ",".join(sorted(base | more)), score))
            if len(out) == 4096:
                yield _rows(list(map(list, zip(*out))), ROWS)
                out = []
        if out:
            yield _rows(list(map(list, zip(*out))), ROWS)

    narrow = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return narrow.mapInArrow(report, ROWS).withColumnRenamed("__id", id_col)


def notice_spans(docs: DataFrame, notices: dict[str, str] = NOTICES, per_error: int = PER_ERROR, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row per notice or phrase found: its label, its first and last word (from 0), its edits and its own words."""

    def report(batches):
        for name, text, _, spans, scanner in _each(batches, phrases, notices, per_error):
            if spans:
                out = [(name, scanner.labels[n], text.count(" ", 0, max(a, 1)) - 1, text.count(" ", 0, b) - 1 - (text[b - 1] == " "), e, text[a:b]) for n, a, b, e in spans]
                yield _rows(list(map(list, zip(*out))), SPANS)

    narrow = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return narrow.mapInArrow(report, SPANS).withColumnRenamed("__id", id_col)
