"""Language-model scores by a weighted backoff automaton over words.

All documents are counted: word trigrams of every text, none pruned. Every context that was seen is a state (two words, one word,
or none). A state has an arc for each word seen after it, weighted with log((count - D) / count of the context), absolute
discounting with D = `discount`, to the state of the longest suffix that is a context; its failure arc leads to the context without
its first word and is weighted with the log of the mass that is left, over that which the seen words have in the shorter context. A
text is read once from left to right: the state is carried from word to word, failure arcs are followed until the word has an arc,
and the weights add up. `Automaton` does so with its model in memory, a word at a time.

`score_documents` does so at any size, for the counted texts or for others (`model`). Texts are read in blocks of about
`block_bytes`, and a block works with the part of the automaton that its texts can reach (`Reached`): all arcs for its
trigrams, bigrams and words, and all states and failure arcs on the way. The weights of these follow from counts over all documents,
for which blocks ask in two rounds:

1. by 64-bit hashes of its distinct words and bigrams: how often each occurs, how often a word follows it, a number for each word;
   and which one of the blocks that counted it shall add it to the sums of the state that it leaves, so that it is added once;
2. by the number of the state and of the word, for its distinct trigrams: how often each occurs; and for each state the number
   of its arcs and the sum of the counts that the words of its arcs have in the shorter context, as the failure arc needs. Of
   states of two words that no other block counts, a block has all of this itself (where the counted texts are those scored).

Then each block builds its states, arcs and failure arcs and traverses all of its texts. Many texts go a word forward at once; a
text is divided into pieces of `PIECE` words that begin two words earlier in the state without a word: the state after two words is
the same from whichever state these are read.

Scale: four shuffles of compressed blocks, no row for a word: questions and answers of each round; the words of the texts go with the
first answers. A hash or trigram occurs once in a block however frequent it is. The arcs of a state of two words are counted in one
task, at most one a block for each word that follows them. Nothing of the model comes to the driver or is broadcast; a task holds one
of `parts` ranges of hashes, whose number grows with the texts, or one block. Counts are exact; a word stands for its 64-bit hash.

Defined cases: null and empty texts and those without a word have 0 words, log probability 0 and a null rate, and count nothing;
each row is scored by its own text; repeated rows count each time; other columns are ignored. In a model without a word every word
has log probability 0, as in `Automaton`.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import _release, map_arrow, text_slices, whole_groups
from .textops import mix, words

_U = np.uint64
_PAD = _U(0x2545F4914F6CDD1D)
_ONE = _U(1)
#: Bits of the number of a word beside that of a state of its part.
_SYMBOL = 36
#: Words of a text that are read in one go, beside other pieces.
PIECE = 256
#: What the texts of a row are for.
BOTH, COUNTED, SCORED = 0, 1, 2


def squeeze(x: np.ndarray) -> bytes:
    """Integers of 64 bits as planes of bytes, each compressed by itself; planes of zeros are left out."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = planes.any(axis=1)
    packed = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in planes[used]]
    return np.packbits(used).tobytes() + np.array([len(p) for p in packed], "<u4").tobytes() + b"".join(packed)


def expand(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    used = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 1)))
    at = 1 + 4 * len(used)
    for i, size in zip(used, np.frombuffer(data, "<u4", len(used), 1).tolist()):
        planes[i] = np.frombuffer(pa.decompress(data[at : at + size], n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _steps(x: np.ndarray) -> bytes:
    """Ascending values by their differences."""
    return squeeze(np.diff(x.astype(_U), prepend=_U(0)))


def _summed(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(expand(data, n), dtype=_U)


def _joined(rows: list, column: str, size: str = "n") -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(expand(r[column], r[size]).view(np.int64) for r in rows)])


class Block:
    """The distinct words, bigrams and trigrams of some texts, by their numbers in the block.

    Word 0 is the pad before a text and bigram 0 two pads. A bigram is also the state after its words, a word the state after it
    alone. `keys` are the hashes of words (even) and bigrams (odd) in ascending order, of words and bigrams number `order`.
    """

    def __init__(self, vocabulary: np.ndarray, sequence: np.ndarray, sizes: np.ndarray) -> None:
        self.vocabulary, self.sequence, self.sizes = vocabulary, sequence, sizes
        v = len(vocabulary)
        first = np.zeros(len(sequence), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        self.before = np.where(first, 0, np.roll(sequence, 1))
        code, pair = np.unique(self.before * v + sequence, return_inverse=True)
        self.pairs, self.pair = np.concatenate([[0], code]), pair + 1
        self.state = np.where(first, 0, np.roll(self.pair, 1))
        with np.errstate(over="ignore"):
            both = mix(mix(vocabulary[self.pairs // v]) * _U(0xD6E8FEB86659FD93) + vocabulary[self.pairs % v])
        keys = np.concatenate([vocabulary & ~_ONE, both | _ONE])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    @classmethod
    def of(cls, texts: list) -> Block:
        value, offsets = words(texts)
        distinct, place = np.unique(value, return_inverse=True)
        return cls(np.concatenate([[_PAD], distinct]), place + 1, np.diff(offsets))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and bigram occurs, and how often a word follows it, in the order of the keys."""
        v, p = len(self.vocabulary), len(self.pairs)
        occurs = np.concatenate([np.bincount(self.sequence, minlength=v), np.bincount(self.pair, minlength=p)])
        followed = np.concatenate([np.bincount(self.before, minlength=v), np.bincount(self.state, minlength=p)])
        return occurs[self.order], followed[self.order]

    def check(self) -> int:
        """Tells blocks of other texts apart."""
        with np.errstate(over="ignore"):
            return int(np.bitwise_xor.reduce(mix(self.keys) * (self.counts()[0].astype(_U) | _ONE), initial=_U(0)).view(np.int64))


class Answered(Block):
    """A block with the answers of the first round, and its trigrams in the order in which it asks for them."""

    def __init__(self, rows: list) -> None:
        place, *answers = sorted(rows, key=lambda r: r["part"])
        self.role, self.ids = place["role"], place["ids"]
        distinct = _summed(place["words"], place["n_words"])
        sizes = np.array(place["sizes"], np.int64)
        super().__init__(np.concatenate([[_PAD], distinct]), expand(place["data"], int(sizes.sum())).view(np.int64), sizes)
        if len(self.sequence) and (place["part"] >= 0 or sum(a["n"] for a in answers) != len(self.keys) or any(a["check"] != place["check"] for a in answers)):
            raise ValueError("texts changed between counting and scoring")
        self.total, self.kinds = sum(a["total"] for a in answers), sum(a["kinds"] for a in answers)
        if not len(self.sequence):
            return
        v = len(self.vocabulary)

        def placed(x: np.ndarray) -> np.ndarray:
            out = np.empty(len(self.order), x.dtype)
            out[self.order] = x
            return out

        self.ranks = np.concatenate([_summed(a["data"], a["n"]) for a in answers])
        # the answers tell what other blocks add
        occurs, followed = self.counts() if self.role != SCORED else (np.zeros(len(self.keys), np.int64),) * 2
        self.occurs = placed(_joined(answers, "counts") + occurs)
        self.followed = self.occurs - placed(_joined(answers, "ends") + occurs - followed)
        self.owned = placed(np.concatenate([np.unpackbits(np.frombuffer(a["owned"], np.uint8), count=a["n"]) for a in answers]).astype(bool))
        self.symbol = np.zeros(v, np.int64)
        self.symbol[self.order[self.order < v]] = _joined(answers, "symbols", "n_words")
        code, triple, times = np.unique(self.state * v + self.sequence, return_inverse=True, return_counts=True)
        self.leaves, self.reads = code // v, code % v
        self.arc = np.empty(len(code), np.int64)
        self.arc[triple] = self.pair
        del self.pair, self.state, self.before, code, triple
        self.times = times if self.role != SCORED else np.zeros(len(times), np.int64)
        at = np.empty(len(self.order), np.int64)
        at[self.order] = np.arange(len(self.order))
        #: The place of the state of each trigram among the keys.
        self.at = at[v + self.leaves]
        # a state that no other block counts has the arcs of this block and no others: nothing to ask, unless others only score
        asked = np.flatnonzero((self.followed != (placed(followed) if self.role == BOTH else 0))[v + self.leaves])
        self.asked = asked[np.argsort((self.at[asked] << _SYMBOL) | self.symbol[self.reads[asked]], kind="stable")]


class Reached:
    """The part of the automaton that the texts of a block can reach: bigrams, words and the empty context as states 0, 1, ..."""

    def __init__(self, b: Answered, rows: list, discount: float) -> None:
        v, p = len(b.vocabulary), len(b.pairs)
        rows = sorted(rows, key=lambda r: r["part"])
        if len(b.asked) != sum(r["n"] for r in rows):
            raise ValueError("answers are missing")
        times = b.times.copy()
        times[b.asked] += _joined(rows, "data")
        # the answers tell what arcs of other blocks add to those of this one
        arcs = np.bincount(b.leaves[b.times > 0], minlength=p + v).astype(float)
        lower = np.bincount(b.leaves[b.times > 0], b.occurs[v + b.arc[b.times > 0]], p + v)
        at = b.at[b.asked]
        states = b.order[at[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]] - v
        arcs[states] += _joined(rows, "arcs", "n_states")
        lower[states] += _joined(rows, "lower", "n_states")
        singles = p + b.order[b.order < v]
        arcs[singles], lower[singles] = _joined(rows, "word_arcs", "n_words"), _joined(rows, "word_lower", "n_words")
        follow, left = b.followed.astype(float), max(1, b.total)
        context = np.concatenate([follow[v:], follow[:v]])
        whole = np.concatenate([follow[b.pairs % v], np.full(v, left)])
        # the mass that is left, over that of the words without an arc in the shorter context
        known = (context > 0) & (arcs > 0)
        mass = np.maximum(1e-12, 1.0 - (lower[known] - discount * arcs[known]) / whole[known])
        self.root = p + v
        self.failure = np.concatenate([p + b.pairs % v, np.full(v + 1, self.root)])
        self.failure_weight = np.zeros(p + v + 1)
        self.failure_weight[:-1][known] = np.log(discount * arcs[known] / context[known]) - np.log(mass)
        self.unseen = math.log(discount * b.kinds / b.total) if b.total else 0.0
        # arcs in the order of (state, word): those of bigrams, of words, of the empty context
        source = np.concatenate([b.leaves, p + b.pairs[1:] // v, np.full(v - 1, self.root)])
        word = np.concatenate([b.reads, b.pairs[1:] % v, np.arange(1, v)])
        times = np.concatenate([times, b.occurs[v + 1 :], b.occurs[1:v]])
        seen = times > 0
        self.words, self.arcs = v, (source * v + word)[seen]
        self.weight = np.log((times[seen] - discount) / np.append(context, left)[source[seen]])
        del source, word, times
        single = np.where(context[p:] > 0, p + np.arange(v), self.root)
        double = np.where(context[:p] > 0, np.arange(p), single[b.pairs % v])
        self.target = np.concatenate([double[b.arc], double[1:], single[1:]])[seen]
        self.start = 0 if context[0] > 0 else self.root

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log probabilities of a word read in each state."""
        state, weight = state.copy(), np.zeros(len(state))
        following = np.full(len(state), self.root)
        todo = np.arange(len(state))
        while len(todo):
            code = state[todo] * self.words + word[todo]
            place = np.searchsorted(self.arcs, code)
            has = self.arcs[np.minimum(place, len(self.arcs) - 1)] == code if len(self.arcs) else np.zeros(len(todo), bool)
            done, place = todo[has], place[has]
            weight[done] += self.weight[place]
            following[done] = self.target[place]
            todo = todo[~has]
            lost = state[todo] == self.root
            weight[todo[lost]] += self.unseen
            todo = todo[~lost]
            weight[todo] += self.failure_weight[state[todo]]
            state[todo] = self.failure[state[todo]]
        return following, weight

    def traverse(self, sequence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log probability of each text: every piece is read from left to right with its state carried along."""
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[text] + number * PIECE
        early = np.where(number > 0, 2, 0)
        length = np.minimum(PIECE, sizes[text] - number * PIECE) + early
        order = np.argsort(-length, kind="stable")
        begin, early, length, text = (begin - early)[order], early[order], length[order], text[order]
        state = np.where(early > 0, self.root, self.start)
        total = np.zeros(len(text))
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, side="left"))
            state[:n], weight = self.step(state[:n], sequence[begin[:n] + t])
            total[:n] += np.where(t < early[:n], 0.0, weight)
        return np.bincount(text, total, len(sizes))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, int, list, list]]:
    """(number, role, doc_ids, texts) of blocks of about `limit` bytes of a partition's texts, in their order."""
    number = TaskContext.get().partitionId() << 24
    ids: list = []
    texts: list = []
    size = role = 0
    for batch in batches:
        for part in text_slices(batch, limit=limit):
            more, is_for = part.column("text").to_pylist(), part.column("role")[0].as_py()
            n = sum(len(t) for t in more if t)
            if ids and (size + n > limit or is_for != role):
                yield number, role, ids, texts
                ids, texts, size, number = [], [], 0, number + 1
            role = is_for
            ids += part.column("doc_id").to_pylist()
            texts += more
            size += n
    if ids:
        yield number, role, ids, texts


def _totals(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(order that sorts the keys, where a key begins in it, number of its key for each place, sums of values for each key)."""
    order = np.argsort(keys, kind="stable")
    head = np.concatenate([[True], np.diff(keys[order]) != 0])[: len(keys)]
    first = np.flatnonzero(head)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(head) - 1
    return order, first, rank, [np.add.reduceat(x[order], first) if len(first) else x for x in values]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list]:
    """The rows of each group."""
    for group in whole_groups(batches, key):
        value = group.column(key).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for x, y in zip(bounds[:-1], bounds[1:]):
            yield group.slice(x, y - x).to_pylist()


def score_documents(docs: DataFrame, discount: float = 0.75, block_bytes: int = 8_000_000, parts: int = 0, model: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_word) for every row of docs, by the automaton of the texts of `model`, those of docs
    themselves if it isn't given. `parts` (a power of 2) follows from the size of the texts where it is 0."""

    def texts_of(df: DataFrame, role: int) -> DataFrame:
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(role).alias("role"))

    rows = texts_of(docs, BOTH) if model is None else texts_of(docs, SCORED).unionByName(texts_of(model.withColumn("doc_id", F.lit(0)), COUNTED))
    if not parts:
        total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = 1 << max(3, math.ceil(total / block_bytes).bit_length())
    shift = _U(64 - (parts.bit_length() - 1))

    def cuts(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted((keys >> shift).astype(np.int64), np.arange(parts + 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, role, _, texts in _blocks(batches, block_bytes):
            b = Block.of(texts)
            if not len(b.sequence):
                continue
            occurs, followed = b.counts() if role != SCORED else (np.zeros(len(b.keys), np.int64),) * 2
            at, check = cuts(b.keys), b.check()
            # every part is asked, as each also answers with its share of the number of words
            yield pa.RecordBatch.from_pylist([{"part": i, "block": number, "check": check, "n": int(y - x), "keys": _steps(b.keys[x:y]), "counts": squeeze(occurs[x:y]), "ends": squeeze(occurs[x:y] - followed[x:y])} for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))], schema=_ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, "part"):
            n = [r["n"] for r in own]
            keys = np.concatenate([_summed(r["keys"], r["n"]) for r in own])
            occurs, ends = _joined(own, "counts"), _joined(own, "ends")
            order, first, rank, (occurs_sum, ends_sum) = _totals(keys, occurs, ends)
            counted = np.flatnonzero(occurs[order] > 0)
            _, begin = np.unique(rank[order[counted]], return_index=True)
            owned = np.zeros(len(keys), bool)
            owned[order[counted[begin]]] = True
            # a word's number is small if the word is frequent, so that numbers compress well
            word = np.flatnonzero((keys[order[first]] & _ONE) == 0)
            symbols = np.zeros(len(first), np.int64)
            symbols[word[np.argsort(-occurs_sum[word], kind="stable")]] = np.arange(len(word)) * parts + own[0]["part"]
            total, kinds = int(occurs_sum[word].sum()), int((occurs_sum[word] > 0).sum())
            out, at = [], 0
            for r, m in zip(own, n):
                x = rank[at : at + m]
                symbol = symbols[x[(keys[at : at + m] & _ONE) == 0]]
                out.append({"block": r["block"], "part": r["part"], "check": r["check"], "n": m, "data": _steps(x), "counts": squeeze(occurs_sum[x] - occurs[at : at + m]), "ends": squeeze(ends_sum[x] - ends[at : at + m]), "owned": np.packbits(owned[at : at + m]).tobytes(), "symbols": squeeze(symbol), "n_words": len(symbol), "total": total, "kinds": kinds})
                at += m
            yield pa.RecordBatch.from_pylist(out, schema=_ANSWERED)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, role, ids, texts in _blocks(batches, block_bytes):
            b = Block.of(texts)
            yield pa.RecordBatch.from_pylist([{"block": number, "part": -1, "check": b.check(), "n": len(b.sequence), "data": squeeze(b.sequence), "words": _steps(b.vocabulary[1:]), "n_words": len(b.vocabulary) - 1, "ids": ids, "sizes": b.sizes.tolist(), "role": role}], schema=_PLACED)

    def ask_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, "block"):
            b = Answered(own)
            if not len(b.sequence):
                continue
            v, at = len(b.vocabulary), b.at[b.asked]
            times, symbol, pair = b.times[b.asked], b.symbol[b.reads[b.asked]], b.occurs[v + b.arc[b.asked]]
            mine = np.flatnonzero(b.owned[v:])
            word_arcs = np.bincount(b.pairs[mine] // v, minlength=v)
            word_lower = np.bincount(b.pairs[mine] // v, b.occurs[b.pairs[mine] % v], v).astype(np.int64)
            singles = np.flatnonzero(b.order < v)
            single = b.order[singles]
            key_cuts = cuts(b.keys)
            arcs, ones = np.searchsorted(at, key_cuts).tolist(), np.searchsorted(singles, key_cuts).tolist()
            out = []
            for i in range(parts):
                x, y, s, e = arcs[i], arcs[i + 1], ones[i], ones[i + 1]
                if x < y or s < e:
                    out.append({"part": i, "block": own[0]["block"], "n": y - x, "n_words": e - s, "states": _steps(b.ranks[at[x:y]]), "symbols": squeeze(symbol[x:y]), "counts": squeeze(times[x:y]), "lower": squeeze(pair[x:y]), "words": _steps(b.ranks[singles[s:e]]), "word_arcs": squeeze(word_arcs[single[s:e]]), "word_lower": squeeze(word_lower[single[s:e]])})
            yield pa.RecordBatch.from_pylist(out, schema=_ARCS_ASKED)

    def answer_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, "part"):
            state = np.concatenate([_summed(r["states"], r["n"]).view(np.int64) for r in own])
            counts, single = _joined(own, "counts"), _joined(own, "lower")
            order, first, rank, (times,) = _totals((state << _SYMBOL) | _joined(own, "symbols"), counts)
            seen = order[first[times > 0]]
            arcs = np.bincount(state[seen], minlength=int(state.max(initial=-1)) + 1)
            lower = np.bincount(state[seen], single[seen], len(arcs)).astype(np.int64)
            word = np.concatenate([_summed(r["words"], r["n_words"]).view(np.int64) for r in own])
            word_arcs = np.bincount(word, _joined(own, "word_arcs", "n_words")).astype(np.int64)
            word_lower = np.bincount(word, _joined(own, "word_lower", "n_words")).astype(np.int64)
            out, at, one = [], 0, 0
            for r in own:
                x, w, mine = state[at : at + r["n"]], word[one : one + r["n_words"]], counts[at : at + r["n"]]
                new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
                x = x[new]
                # what other blocks add; a block knows its own
                rest = arcs[x] - np.add.reduceat((mine > 0).astype(np.int64), new) if len(x) else x
                rest_lower = lower[x] - np.add.reduceat(np.where(mine > 0, single[at : at + r["n"]], 0), new) if len(x) else x
                out.append({"block": r["block"], "part": r["part"], "n": r["n"], "n_states": len(x), "n_words": r["n_words"], "data": squeeze(times[rank[at : at + r["n"]]] - mine), "arcs": squeeze(rest), "lower": squeeze(rest_lower), "word_arcs": squeeze(word_arcs[w]), "word_lower": squeeze(word_lower[w])})
                at, one = at + r["n"], one + r["n_words"]
            yield pa.RecordBatch.from_pylist(out, schema=_ARCS_ANSWERED)

    def traverse(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = Answered(block.to_pylist())
        if b.role == COUNTED:
            return _SCORES.empty_table()
        ids, sequence, sizes, total = b.ids, b.sequence, b.sizes, np.zeros(len(b.sizes))
        if len(sequence):
            reached = Reached(b, answers.to_pylist(), discount)
            del b
            total = reached.traverse(sequence, sizes)
            del reached
        _release()
        rate = np.round(-total / np.maximum(1, sizes) / math.log(2), 6) + 0.0
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(np.round(total, 4) + 0.0), pa.array(rate, mask=sizes == 0)], schema=_SCORES)

    asked = map_arrow(rows, ask, _ddl(_ASKED)).repartition("part").sortWithinPartitions("part", "block")
    # read twice, and shuffled once: Spark takes the second exchange for the first
    known = map_arrow(rows, places, _ddl(_PLACED)).unionByName(map_arrow(asked, answer, _ddl(_ANSWERED)), allowMissingColumns=True).repartition("block")
    arcs = map_arrow(known.sortWithinPartitions("block", "part"), ask_arcs, _ddl(_ARCS_ASKED)).repartition("part").sortWithinPartitions("part", "block")
    answers = map_arrow(arcs, answer_arcs, _ddl(_ARCS_ANSWERED))
    return known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(traverse, _ddl(_SCORES))


def _schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "longs": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<long>')}" for f in schema)


_ASKED = _schema("part long, block long, check long, n int, keys binary, counts binary, ends binary")
_ANSWERED = _schema("block long, part long, check long, n int, data binary, counts binary, ends binary, owned binary, symbols binary, n_words int, total long, kinds long")
_PLACED = _schema("block long, part long, check long, n int, data binary, words binary, n_words int, ids longs, sizes longs, role int")
_ARCS_ASKED = _schema("part long, block long, n int, n_words int, states binary, symbols binary, counts binary, lower binary, words binary, word_arcs binary, word_lower binary")
_ARCS_ANSWERED = _schema("block long, part long, n int, n_states int, n_words int, data binary, arcs binary, lower binary, word_arcs binary, word_lower binary")
_SCORES = _schema("doc_id long, n_words long, log_prob double, bits_per_word double")


class Automaton:
    """States, arcs and failure arcs of the model of some texts, in memory; words are those of textops.words."""

    def __init__(self, texts: list, discount: float = 0.75) -> None:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        for seq in self._words(texts):
            for i, w in enumerate(seq):
                history = (seq[i - 2] if i > 1 else _PAD, seq[i - 1] if i else _PAD)
                for h in (history, history[1:], ()):
                    counts[h][w] += 1
        self.arcs = {h: {w: math.log((n - discount) / sum(c.values())) for w, n in c.items()} for h, c in counts.items()}
        #: A word never seen has the mass that is left without a context.
        self.unseen = math.log(discount * len(counts[()]) / sum(counts[()].values())) if counts else 0.0
        self.backoff: dict[tuple, float] = {}
        for h in sorted(self.arcs, key=len):
            if h:
                left = discount * len(counts[h]) / sum(counts[h].values())
                self.backoff[h] = math.log(left) - math.log(max(1e-12, 1.0 - sum(math.exp(self.logp(h[1:], w)) for w in counts[h])))

    @staticmethod
    def _words(texts: list) -> Iterator[list]:
        value, offsets = words(texts)
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield value[a:b].tolist()

    def step(self, state: tuple, word: int) -> tuple[tuple, float]:
        """The next state and the log probability of a word."""
        weight = 0.0
        while word not in self.arcs.get(state, ()):
            if not state:
                return (), weight + self.unseen
            weight += self.backoff.get(state, 0.0)
            state = state[1:]
        weight += self.arcs[state][word]
        following = (*state, word)[-2:]
        while following and following not in self.arcs:
            following = following[1:]
        return following, weight

    def logp(self, state: tuple, word: int) -> float:
        return self.step(state, word)[1]

    def score(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(words, log probability) of each text."""
        sizes, totals = [], []
        for seq in self._words(texts):
            state, total = (_PAD, _PAD), 0.0
            for w in seq:
                state, weight = self.step(state, w)
                total += weight
            sizes.append(len(seq))
            totals.append(total)
        return np.array(sizes, np.int64), np.array(totals)
