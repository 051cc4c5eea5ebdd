"""Language-model scoring by a weighted backoff automaton learnt from the corpus.

States are the contexts that training has seen: the root, single words, and pairs of words. A state's arc for a word
that training saw after it weighs log10((c(hw) + K p(w)) / (c(h) + K)), p being the next shorter context's probability,
and leads to the longest known context that ends there; for any other word the failure arc, of weight
log10(K / (c(h) + K)), leads to the context without its first word, and the root has an arc for every word. The weights
of a state, failures included, sum to one over the words. A text is traversed once from left to right; the state is
carried from token to token and the weights add up.

Counts cover the whole corpus. A batch of documents asks for those of its own n-grams, builds the part of the automaton
that its texts can reach, and traverses them side by side. A long text is cut into lanes; a lane begins ORDER - 1 tokens
early at the root, by when its state is that of an unbroken traversal.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .hashing import SPACE, crc_mod, mix, seeded

END = np.uint64(0x0123456789ABCDEF)
ORDER = 3
#: How many observations the shorter context's probability counts as, by the length of the context.
PRIORS = {1: 200.0, 2: 20.0}
LANE = 256
FOLDS, HELD_OUT = 10, 0
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Grams(NamedTuple):
    """A batch's tokens and its distinct n-grams (sorted by hash), and which of them each token ends (-1: none)."""

    hashes: list[np.ndarray]
    first: list[np.ndarray]
    at: list[np.ndarray]
    doc: np.ndarray
    counts: np.ndarray


def _tokens(batch: exchange.Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each document, each token's document, and the documents' token counts."""
    counts = np.diff(batch.rows) + 1
    h = np.insert(batch.hashes, batch.rows[1:], END)
    return h, np.repeat(np.arange(len(counts)), counts), counts


def _training(batch: exchange.Batch) -> np.ndarray:
    fold = crc_mod(pa.array(batch.ids, pa.int64()), FOLDS)
    return (fold != HELD_OUT) & (fold >= 0)


def _keys(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n tokens within documents, and the place of each run's last token."""
    if n == 1:
        return h, np.arange(len(h))
    at = np.flatnonzero(doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)]) + n - 1
    total = np.full(len(at), n, np.uint64)
    for back, factor in enumerate(seeded(n, 71)):
        total = total + h[at - back] * factor
    return mix(total), at


def _kind(n: int, width: int) -> exchange.Kind:
    def count(batch):
        h, doc, _ = _tokens(batch)
        keys, at = _keys(h, doc, n)
        known, back = np.unique(keys, return_inverse=True)
        return known, np.bincount(back, _training(batch)[doc[at]], len(known)).astype(np.int64)

    return exchange.Kind(count, width)


#: Words are told apart by all bits that hashes have left, longer runs by fewer.
KINDS = [_kind(1, 7), _kind(2, 5), _kind(3, 4)]


def grams(batch: exchange.Batch) -> Grams:
    h, doc, counts = _tokens(batch)
    found: list[list] = [[], [], []]
    for n in range(1, ORDER + 1):
        keys, at = _keys(h, doc, n)
        known, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.full(len(h), -1)
        place[at] = back
        for to, value in zip(found, (known, at[first] if len(at) else first, place)):
            to.append(value)
    return Grams(*found, doc, counts)


class Automaton(NamedTuple):
    """States: 0 the root, then words, then pairs. An arc's key is state * words + word."""

    n_words: int
    root_weight: np.ndarray
    root_next: np.ndarray
    arc_key: np.ndarray
    arc_weight: np.ndarray
    arc_next: np.ndarray
    fail_weight: np.ndarray
    fail_next: np.ndarray


def build(found: Grams, totals: list[np.ndarray], n: int, v: int) -> Automaton:
    """The automaton of a batch's n-grams with the given training totals; n training tokens of v words."""
    one, two, three = (t.astype(float) for t in totals)
    word, pair = found.at[0], found.at[1]
    base = (one + 0.1) / (n + 0.1 * (v + 1))
    n_words, n_pairs = len(one), len(two)
    last = found.first[1]
    left, right = word[last - 1] if n_pairs else last, word[last]
    seen = (two > 0) & (one[left] > 0)
    p_pair = (two + PRIORS[1] * base[right]) / (one[left] + PRIORS[1])
    last = found.first[2]
    context, then = pair[last - 1] if len(last) else last, pair[last]
    deep = (three > 0) & seen[context] & seen[then]
    p_three = (three + PRIORS[2] * p_pair[then]) / (two[context] + PRIORS[2])
    state_of_pair = 1 + n_words + np.arange(n_pairs)
    key = np.concatenate([(1 + left)[seen] * n_words + right[seen], state_of_pair[context[deep]] * n_words + word[last][deep]])
    order = np.argsort(key)
    fail = np.concatenate([np.zeros(1 + n_words, np.int64), 1 + right])
    return Automaton(
        n_words,
        np.log10(base),
        np.where(one > 0, 1 + np.arange(n_words), 0),
        key[order],
        np.log10(np.concatenate([p_pair[seen], p_three[deep]]))[order],
        np.concatenate([state_of_pair[seen], state_of_pair[then[deep]]])[order],
        np.log10(np.concatenate([[1.0], PRIORS[1] / (one + PRIORS[1]), PRIORS[2] / (two + PRIORS[2])])),
        fail,
    )


def traverse(automaton: Automaton, word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The summed weights of each document, its words being indices into the automaton's; documents stand one after the other."""
    a, n = automaton, len(counts)
    lanes = -(-counts // LANE)
    doc = np.repeat(np.arange(n), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = np.repeat(np.cumsum(counts) - counts, lanes) + nth * LANE
    end = np.minimum(begin + LANE, np.cumsum(counts)[doc])
    early = np.where(nth > 0, ORDER - 1, 0)
    start, length = begin - early, end - begin + early
    order = np.argsort(-length, kind="stable")
    start, length, early, doc = start[order], length[order], early[order], doc[order]
    state, score = np.zeros(len(doc), np.int64), np.zeros(len(doc))
    for step in range(int(length.max(initial=0))):
        open_lanes = int(np.searchsorted(-length, -step, "left"))
        w, s = word[start[:open_lanes] + step], state[:open_lanes]
        gain, pending = np.zeros(open_lanes), np.arange(open_lanes)
        while len(pending):
            at_root = s[pending] == 0
            here = pending[at_root]
            gain[here] += a.root_weight[w[here]]
            s[here] = a.root_next[w[here]]
            pending = pending[~at_root]
            key = s[pending] * a.n_words + w[pending]
            place = np.minimum(np.searchsorted(a.arc_key, key), max(len(a.arc_key) - 1, 0))
            hit = a.arc_key[place] == key if len(a.arc_key) else np.zeros(len(key), bool)
            here, to = pending[hit], place[hit]
            gain[here] += a.arc_weight[to]
            s[here] = a.arc_next[to]
            pending = pending[~hit]
            gain[pending] += a.fail_weight[s[pending]]
            s[pending] = a.fail_next[s[pending]]
        score[:open_lanes] += np.where(step >= early[:open_lanes], gain, 0)
    return np.bincount(doc, score, n)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The n-grams of the documents whose crc32(id as text) mod FOLDS is not HELD_OUT are counted, all of them.
    A null or empty text has its end alone; a null id is scored but neither learnt from nor held out; repeated rows
    are learnt from and scored each. Where nothing is learnt, train_tokens is 0 and both scores rest on the smoothing.
    An empty table gives none; other columns are not read.
    """
    found = exchange.batches(docs, SPACE, id_col, text_col)
    size = found.agg(F.sum(F.col("n_words") + F.col("n_docs"))).first()[0] or 0
    replies = exchange.answers(found, KINDS, exchange.bucket_bits(size), "counts")
    v = replies.where("kind = 0").agg(F.sum("distinct")).first()[0] or 0

    def learnt(records):
        for record in records:
            for raw in record.column(0):
                batch = exchange.load(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([int((np.diff(batch.rows) + 1)[_training(batch)].sum())], pa.int64())], ["n"])

    n = found.select("payload").mapInArrow(learnt, "n long").agg(F.sum("n")).first()[0] or 0

    def use(batch, totals):
        own = grams(batch)
        word, count = own.at[0], totals[0].astype(np.int64)
        add = lambda x: np.bincount(own.doc, x[word], len(own.counts))
        automaton = build(own, totals, n, v)
        score = traverse(automaton, word, own.counts)
        held = crc_mod(pa.array(batch.ids, pa.int64()), FOLDS) == HELD_OUT
        columns = [pa.array(batch.ids, pa.int64()), pa.array(held), pa.array(own.counts), pa.array(add(count > 0).astype(np.int64)), pa.array(add(automaton.root_weight)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORES.split(", ")])

    return exchange.with_answers(found, replies, use, len(KINDS), SCORES).withColumn("train_tokens", F.lit(n).cast("long"))
