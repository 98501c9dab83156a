"""Language ID by segmentation-marginalised unigrams.

Per language, every piece of a fixed public vocabulary has a probability, learned from the
pieces of all learning texts and smoothed towards the pooled probabilities.  A word's probability is
the sum over all ways to cut it into pieces (a forward pass over its characters); a
text's is the product over its words.  The language with the largest wins; the score is its
share among all languages, by the mean log-probability a word.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every
text when there is nothing to learn from; ties go to the first language by code point; rows
that repeat are each scored; a null ``doc_id`` is never held out; an empty table gives an empty result; other columns are not
read.  A word of any length is summed over all its segmentations: the forward pass takes ``RUN`` characters at a
time and carries its last sums on, rescaled, so memory does not grow with a word (a text without spaces).
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import crc32_mod, per_batch, read_table
from kestrel.llm.wordscores import coded_words, remembered, text_sums

VOCABULARY = "piece_bpe_32k.model"
#: Documents with this remainder of crc32(doc_id) are held out of learning.
HELD_OUT_MOD, HELD_OUT = 4, 2
#: Weight of the pooled probabilities, in pieces, and the count every piece starts with.
SMOOTHING = 200.0
FLOOR = 0.5
RUN = 64
#: Model size is languages x vocabulary; more languages than this are refused.
MAX_LANGUAGES = 256
#: Keeps products of piece probabilities within the range of a double: about one piece's share a character.
LIFT = 4.0
#: Words in one forward pass.
FORWARD_WORDS = 4096
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = "▁"


def vocabulary_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Pieces of a public vocabulary file, and the prefixes that lead to them."""

    def __init__(self, content: bytes):
        import sentencepiece
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.processor.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(self.size):
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (self.processor.is_control(i) or self.processor.is_unknown(i)):
                self.pieces[piece] = i
        self.longest = max(map(len, self.pieces))
        # the prefixes as a trie in sorted arrays: (node, character) -> node, and a node's piece or -1
        steps = dict.fromkeys((p[:k] for p in self.pieces for k in range(1, len(p))), -1) | self.pieces
        nodes = {prefix: k for k, prefix in enumerate(["", *steps])}
        self.chars = np.array(sorted({ord(prefix[-1]) for prefix in steps}), np.int64)
        links = np.array([nodes[prefix[:-1]] for prefix in steps], np.int64) * len(self.chars) + np.searchsorted(
            self.chars, [ord(prefix[-1]) for prefix in steps])
        order = np.argsort(links)
        self.links, self.children = links[order], np.arange(1, len(nodes))[order]
        self.piece_at = np.array([-1, *steps.values()], np.int64)
        self.single = np.array([self.pieces.get(chr(c), -1) for c in self.chars], np.int64)

    def counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Pieces of the words, each word as often as told."""
        ids = self.processor.encode(words, num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((p for w in ids for p in w), np.int64, int(size.sum()))
        return np.bincount(flat, np.repeat(times, size), self.size)

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """(words x languages) log-probabilities, summed over all segmentations; ``p``: pieces x languages."""
        out = np.zeros((len(words), p.shape[1]))
        # words of about one length at a time: bounds memory and wastes few cells
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for first in range(0, len(words), FORWARD_WORDS):
            own = order[first:first + FORWARD_WORDS]
            out[own] = self._forward([words[k] for k in own], p)
        return out

    def _forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        out = np.zeros((len(words), p.shape[1]))
        # sums at the last positions before the run; a word begins with 1 at its start
        carried = np.zeros((len(words), self.longest, p.shape[1]))
        carried[:, -1] = 1.0
        for low in range(0, int(length.max(initial=0)), RUN):
            own = np.flatnonzero(length > low)
            carried, ends = self._run([words[k] for k in own], low, carried, p)
            done = length[own] <= low + RUN
            out[own[done]] += ends[done]
            top = carried.max(axis=1)  # one scale a word and language
            out[own[~done]] += np.log(np.maximum(top[~done], 1e-300))
            carried = carried[~done] / np.maximum(top[~done], 1e-300)[:, None, :]
        return out - LIFT * length[:, None]

    def _run(self, words: list[str], low: int, carried: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(carried sums after characters low .. low + RUN, log sums at the words' ends)."""
        back = self.longest
        first = max(0, low - back + 1)  # the run, and what pieces that end in it can begin with
        parts = [(_SPACE + w[:low + RUN - 1])[first:] if first == 0 else w[first - 1:low + RUN - 1] for w in words]
        size, start, shift = np.fromiter(map(len, parts), np.int64, len(parts)), low - first, first - low + back
        ends = size - start
        run, start_at, end_at, piece, others = self._edges(parts, size, start)
        if len(others):  # characters outside the vocabulary are spelt by its byte pieces
            spelt = [np.prod(p[[self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")]], axis=0) for c in others]
            p = np.vstack([p, *spelt])
        start, end = start_at + shift, end_at + shift
        longest = int(ends.max(initial=0))
        # column back - 1 + i holds the sums of the first low + i characters
        sums = np.concatenate([carried, np.zeros((len(words), longest, p.shape[1]))], axis=1)
        start, end = start - 1, end - 1
        order = np.lexsort((run, end))
        run, start, end, piece = run[order], start[order], end[order], piece[order]
        at = np.searchsorted(end, np.arange(back, back + longest + 1))
        for e in range(longest):
            own = slice(at[e], at[e + 1])
            if at[e] == at[e + 1]:
                continue
            part = sums[run[own], start[own]] * p[piece[own]] * np.exp(LIFT * (back + e - start[own]))[:, None]
            first = np.flatnonzero(np.r_[True, np.diff(run[own]) > 0])
            sums[run[own][first], back + e] = np.add.reduceat(part, first, axis=0)
        last = back - 1 + ends
        logs = np.log(np.maximum(sums[np.arange(len(words)), last], 1e-300))
        return sums[:, -back:], logs

    def _edges(self, parts: list[str], size: np.ndarray, start: int) -> tuple:
        """(word, begin, end, piece) of all pieces in the parts that end after ``start``, and the code points outside
        the vocabulary, which stand for pieces from ``size`` on.  All places of all parts go down the trie together."""
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(parts)), size)
        stop = np.repeat(np.cumsum(size), size)
        place = np.arange(len(code)) - (stop - np.repeat(size, size))
        known = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        inside = self.chars[known] == code
        alone = np.flatnonzero((~inside | (self.single[known] < 0)) & (place >= start))
        others, which = np.unique(code[alone], return_inverse=True)
        found = [(word[alone], place[alone], place[alone] + 1, self.size + which)]
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for depth in range(self.longest):
            on = at + depth < stop[at]
            at, node = at[on], node[on]
            on = inside[at + depth]
            at, node = at[on], node[on]
            link = node * len(self.chars) + known[at + depth]
            k = np.minimum(np.searchsorted(self.links, link), len(self.links) - 1)
            on = self.links[k] == link
            at, node = at[on], self.children[k[on]]
            if not len(at):
                break
            piece = self.piece_at[node]
            hit = (piece >= 0) & (place[at] + depth >= start)
            found.append((word[at[hit]], place[at[hit]], place[at[hit]] + depth + 1, piece[hit]))
        return *(np.concatenate(c) for c in zip(*found, strict=True)), others


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """One vocabulary a worker, however many batches."""
    key = hash(content)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(content)
    return _VOCABULARIES[key]


def learn(docs: DataFrame, content) -> tuple[list[str], np.ndarray] | None:
    """(languages, pieces x languages probabilities) from rows of (lang, text).

    Every batch sends its piece counts by language; they are summed by Spark, so the driver gets
    at most languages x vocabulary numbers however many documents there are.
    """
    found = [r[0] for r in docs.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return None
    code = {lang: k for k, lang in enumerate(found)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(content.value)
        words, index, bounds = coded_words(pc.utf8_lower(batch.column(1)))
        lang = np.repeat([code[x] for x in batch.column(0).to_pylist()], np.diff(bounds))
        cols: list[list[np.ndarray]] = [[], [], []]
        for k in np.unique(lang):
            times = np.bincount(index[lang == k], minlength=len(words))
            own = np.flatnonzero(times)
            counts = vocab.counts([words[i] for i in own], times[own])
            some = np.flatnonzero(counts)
            for c, v in zip(cols, (np.full(len(some), k), some, counts[some].astype(np.int64)), strict=True):
                c.append(v)
        flat = [np.concatenate([np.zeros(0, np.int64), *c]) for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int64())],
                                          names=["lang", "piece", "n"])
    rows = (per_batch(docs.select("lang", "text"), run, "lang int, piece int, n long")
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas())
    n = np.zeros((vocabulary(content.value).size, len(found)))
    n[rows["piece"], rows["lang"]] = rows["n"]
    pooled = n.sum(axis=1) + FLOOR
    pooled /= pooled.sum()
    return found, (n + SMOOTHING * pooled[:, None]) / (n.sum(axis=0) + SMOOTHING)


def identify(docs: DataFrame, learning: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score.  ``learning``: rows of (lang, text)."""
    sc = docs.sparkSession.sparkContext
    content = sc.broadcast(vocabulary_bytes(vocabulary_path))
    model = sc.broadcast(learn(learning.where("lang IS NOT NULL AND text IS NOT NULL"), content))
    schema = "doc_id long, lang_pred string, score double"
    name = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        told = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
        pred, score = [UNKNOWN] * len(told), [0.0] * len(told)
        if model.value is not None and any(told):
            langs, p = model.value
            vocab = vocabulary(content.value)
            values = remembered(name, lambda w: vocab.forward(w, p), len(langs))
            words, index, bounds = coded_words(pc.utf8_lower(texts))
            sums = text_sums(values(words), index, bounds)
            mean = sums / np.maximum(1, np.diff(bounds))[:, None]
            for k in np.flatnonzero(told):
                best = int(sums[k].argmax())
                pred[k], score[k] = langs[best], float(1 / np.exp(mean[k] - mean[k, best]).sum())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                          names=["doc_id", "lang_pred", "score"])
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def held_out(mod: int = HELD_OUT_MOD, rest: int = HELD_OUT):
    return F.coalesce(crc32_mod("doc_id", mod) == rest, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's language."""
    docs = read_table(spark, sf_dir, "documents")
    return (identify(docs, docs.where(~held_out()).select("lang", "text"))
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))
