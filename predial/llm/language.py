"""Language identification as a mixture: how much of each document is in which language.

A language is a smoothed model of hashed letter trigrams within words. Expectation-maximisation over a document's words
gives its language proportions, and the set of languages is grown as long as the penalised likelihood rises.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Rule, _rule, crc_mod, seeded, text_bytes

BITS = 15
STRETCH = 1 << 19
ROUNDS = 12
UNDECIDED = "und"
#: Words of letters alone: no digits, punctuation or white space; non-ASCII counts as letters.
LETTERS: Rule = _rule(bytes([*range(65), *range(91, 97), *range(123, 128)]))
SCORED = ("lang_pred", "score", "languages")


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # languages x 2**BITS


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigram around each letter, where the words begin among the letters, and the words' rows."""
    letter = ~LETTERS.separator[data]
    value = np.where(letter, LETTERS.value[data], np.uint64(0))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([np.zeros(1, np.uint64), value[:-1]])
    before[edge[:-1]] = 0
    after = np.concatenate([value[1:], np.zeros(1, np.uint64)])
    after[edge[1:]] = 0
    at = np.flatnonzero(letter)
    a, b, c = seeded(3, 41)
    gram = ((before[at] * a + value[at] * b + after[at] * c) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
    return gram, np.flatnonzero(before[at] == 0), np.searchsorted(offsets, at, "right") - 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> Model:
    """Trigram counts of every text with a language whose crc32(id as text) mod ``folds`` is not ``held_out``.

    The model has 2**BITS numbers a language; that table alone comes to the driver.
    """

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            fold = crc_mod(batch.column(0), folds)
            known = (fold != held_out) & (fold >= 0) & ~np.array(batch.column(2).is_null().to_pylist(), bool) & ~np.array(batch.column(1).is_null().to_pylist(), bool)
            kept = batch.filter(pa.array(known))
            langs = np.array(kept.column(2).to_pylist(), object)
            for lang in set(langs.tolist()):
                data, offsets = text_bytes(kept.column(1).filter(pa.array(langs == lang)))
                total = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for a, b in _stretches(offsets):
                    gram, _, _ = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    total += np.bincount(gram, minlength=1 << BITS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "gram", "n"])

    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"))
    found = narrow.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(languages), 1 << BITS))
    if languages:
        row = np.searchsorted(np.array(languages), np.array(found.column("lang").to_pylist()))
        counts[row, found.column("gram").to_numpy()] = found.column("n").to_numpy()
    smooth = counts + 0.5
    return Model(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def _stretches(offsets: np.ndarray):
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
        yield at, end
        at = end


def mixture(like: np.ndarray, row: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each row, and the rows' log likelihoods, by expectation-maximisation.

    like: words x languages, the log likelihood of each word; row: each word's row; allowed: rows x languages.
    """
    n = len(allowed)
    top = like.max(axis=1)
    odds = np.exp(np.maximum(like - top[:, None], -30))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    starts = np.searchsorted(row, np.arange(n))
    words = np.maximum(np.diff(np.append(starts, len(row))), 1)[:, None]
    some = starts < np.append(starts[1:], len(row))
    for _ in range(ROUNDS):
        weight = odds * share[row]
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-300)
        new = share.copy()
        new[some] = np.add.reduceat(weight, starts[some], axis=0) / words[some]
        change, share = np.abs(new - share).max(initial=0), new
        if change < 1e-3:
            break
    each = np.log(np.maximum((odds * share[row]).sum(axis=1), 1e-300)) + top
    return share, np.bincount(row, each, n)


def identify(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's best language (-1: no letter), its proportion, and all proportions."""
    n, many = len(offsets) - 1, len(model.languages)
    gram, start, row = trigrams(data, offsets)
    if not len(start) or not many:
        return np.full(n, -1), np.zeros(n), np.zeros((n, many))
    like = np.stack([np.add.reduceat(p[gram], start) for p in model.log_p], axis=1)
    row = row[start]
    count = np.bincount(row, minlength=n)
    share, _ = mixture(like, row, np.ones((n, many)))
    order = np.argsort(-share, axis=1, kind="stable")
    allowed = np.zeros((n, many))
    allowed[np.arange(n), order[:, 0]] = 1
    single = np.bincount(row, like[np.arange(len(row)), order[row, 0]], n)
    best, score = allowed.copy(), single
    open_rows = count > 0
    for k in range(1, many):
        allowed[np.arange(n), order[:, k]] = 1
        mine = np.flatnonzero(open_rows)
        if not len(mine):
            break
        pick = open_rows[row]
        place = np.cumsum(open_rows) - 1
        new, total = mixture(like[pick], place[row[pick]], allowed[mine])
        # One proportion more costs half the log of the number of words, and a language must hold several words.
        better = total - 0.5 * np.log(np.maximum(count[mine], 2)) - 3 > score[mine]
        best[mine[better]], score[mine[better]] = new[better], total[better] - 0.5 * np.log(np.maximum(count[mine[better]], 2)) - 3
        open_rows[mine[~better]] = False
    lead = np.argmax(best, axis=1)
    none = count == 0
    for i in np.flatnonzero(~none).tolist():
        part = data[offsets[i] : offsets[i + 1]]
        if not _ASCII_LETTER[part].any() and not any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace")):
            none[i] = True
    best[none] = 0
    return np.where(none, -1, lead), np.where(none, 0.0, best[np.arange(n), lead]), best


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def add_language(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = SCORED) -> DataFrame:
    """The documents with lang_pred, score (its proportion of the text's words) and languages ('en:0.81,fr:0.19').

    A text that is null or has no letter, or a model of no language, gives 'und' with score 0. Columns of these names
    are replaced.
    """
    base = docs.drop(*names)
    at = base.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        known = np.array([*model.languages, UNDECIDED], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            found = [identify(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in _stretches(offsets)]
            if not found:
                continue
            lead, share, all_shares = (np.concatenate(x) for x in zip(*found))
            sets = [",".join(f"{model.languages[j]}:{row[j]:.2f}" for j in np.flatnonzero(row >= 0.005)) for row in all_shares]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(known[lead].tolist(), pa.string()), pa.array(share), pa.array(sets, pa.string())],
                [*batch.schema.names, *names],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    return base.mapInArrow(score, ", ".join([*fields, f"`{names[0]}` string", f"`{names[1]}` double", f"`{names[2]}` string"]))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages of every document, learnt from the folds that aren't held out.

    A null id is in no fold: it is neither learnt from nor held out (held_out false). Repeated rows are kept.
    """
    model = train(docs, id_col, text_col, lang_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return add_language(narrow, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
