"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces (forward algorithm); a text's is the product over its words, times the language's share of the
training documents. Probabilities are learned by expectation-maximisation: expected piece counts over all segmentations
(forward-backward), summed by Spark, smoothed and normalised. Nothing but the text enters a prediction.

Words are whole runs of letters, lower-cased, with the vocabulary's word mark in front, whatever their length: sums are rescaled
as they go. All letter pieces of the vocabulary take part. A letter outside the vocabulary has a small floor. Very long texts
are words like any others; ties go to the first language in order; extra columns are ignored; an empty table gives no rows. Null texts and texts without a letter are `und`, score 0. Documents without
a language or with a null id are not learned from (`held_out` is false for a null id); repeated rows count as often as they
come; without any labelled document all is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.common import durable

TRAIN_DOCS = 1000        # documents of each language that the probabilities are fitted on (the bound of the sample)
ROUNDS = 4               # expectation-maximisation rounds
LONG = 64                # characters from which a word is summed on its own, not in a matrix with others
RESCALE = 16             # places after which running sums are rescaled
FLOOR = 1e-7             # probability of a letter outside the vocabulary
SMOOTH = 0.02            # pseudo-count of each piece
MAX_WORDS = 300_000      # words whose scores a worker remembers
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def load_pieces(model_path: str) -> list[str]:
    """Pieces made of letters only (after the word mark), lower case, in the vocabulary's order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return [p for p in pieces if p == MARK or (b := p.removeprefix(MARK)).isalpha() and b == b.lower()]


class Lattice:
    """Piece look-up and forward/backward sums for many words at once."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.row = {p: i for i, p in enumerate(pieces)}
        keys = np.array([self._hash(np.array([list(map(ord, p))], np.uint64))[0, -1] for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Running polynomial hashes of each row."""
        out = np.zeros(codes.shape, np.uint64)
        acc = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            acc = acc * _BASE + (codes[:, j] + np.uint64(1)) * _MIX
            out[:, j] = acc
        return out

    def spans(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Row of the probability table for each (start, end): a piece, n (nothing) or n + 1 (unknown letter)."""
        h, out = self._hash(codes), {}
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(self.longest, _BASE)))
        for j in range(1, codes.shape[1] + 1):
            for m in range(1, min(j, self.longest) + 1):
                k = h[:, j - 1] - (h[:, j - m - 1] * power[m] if j > m else np.uint64(0))
                at = np.minimum(np.searchsorted(self.keys, k), self.n - 1)
                hit = self.keys[at] == k
                out[j - m, j] = np.where(hit, self.order[at], self.n + (m == 1))
        return out

    @staticmethod
    def by_length(words: list[str]):
        """Groups of equal length, long words left out: positions in `words` and the matrix of characters."""
        size = np.array([len(w) for w in words])
        for n in np.unique(size[size < LONG]):
            at = np.flatnonzero(size == n)
            flat = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
            yield at, np.frombuffer(flat, "<u4").reshape(len(at), n).astype(np.uint64)

    def log_scores(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations, per word and language. table: (n + 2, languages)."""
        out = np.zeros((len(words), table.shape[1]))
        for at, codes in self.by_length(words):
            alpha, log = self._forward(self.spans(codes), codes.shape, table)
            out[at] = np.log(alpha[-1]) + log[-1]
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self._log_long(w, table)
        return out

    def _forward(self, spans, shape, table):
        """Sums up to each place and the logarithms of what they were divided by; a sum is never 0, as single letters have a floor."""
        alpha, log = [np.ones((shape[0], table.shape[1]))], [np.zeros((shape[0], table.shape[1]))]
        for j in range(1, shape[1] + 1):
            a = sum(alpha[j - m] * table[spans[j - m, j]] for m in range(1, min(j, self.longest) + 1))
            if j % RESCALE == 0:
                for k in range(max(0, j - self.longest), j):    # later sums read these: bring them to the new scale
                    alpha[k] = alpha[k] / a
                    log[k] = log[k] + np.log(a)
                alpha.append(np.ones_like(a))
                log.append(log[j - 1])
            else:
                alpha.append(a)
                log.append(log[j - 1])
        return alpha, log

    def _edges(self, word: str, j: int):
        """(length, row) of the pieces that end at place j."""
        for m in range(1, min(j, self.longest) + 1):
            row = self.row.get(word[j - m:j], self.n + 1 if m == 1 else None)
            if row is not None:
                yield m, row

    def _log_long(self, word: str, table: np.ndarray) -> np.ndarray:
        last, log = [np.ones(table.shape[1])], np.zeros(table.shape[1])     # sums of the last places, the newest at the end
        for j in range(1, len(word) + 1):
            a = sum(last[-m] * table[row] for m, row in self._edges(word, j))
            last = [*last[1 - self.longest:], a] if len(last) >= self.longest else [*last, a]
            if j % RESCALE == 0:
                last, log = [x / a for x in last], log + np.log(a)
        return np.log(last[-1]) + log

    def _expected_long(self, word: str, count: float, table: np.ndarray, out: np.ndarray) -> None:
        """Expected counts of one long word, one language: forward sums are kept with their scales, backward ones rolled."""
        n = len(word)
        alpha, log = [1.0], [0.0]
        for j in range(1, n + 1):
            top = log[-1]
            a = sum(alpha[j - m] * np.exp(log[j - m] - top) * table[row] for m, row in self._edges(word, j))
            alpha.append(1.0 if j % RESCALE == 0 else a)
            log.append(top + np.log(a) if j % RESCALE == 0 else top)
        whole = np.log(alpha[n]) + log[n]
        beta = {n: 0.0}     # logarithms
        for j in range(n, 0, -1):
            b = beta.pop(j)
            for m, row in self._edges(word, j):
                i, p = j - m, np.log(table[row])
                out[row] += count * np.exp(np.log(alpha[i]) + log[i] + p + b - whole)
                beta[i] = np.logaddexp(beta[i], p + b) if i in beta else p + b

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations, for one language's column `table`."""
        out = np.zeros(self.n + 2)
        for at, codes in self.by_length(words):
            spans, n = self.spans(codes), codes.shape[1]
            alpha, log = self._forward(spans, codes.shape, table[:, None])
            whole = log[n][:, 0] + np.log(alpha[n][:, 0])
            beta, scale = {n: np.ones(len(at))}, np.zeros(len(at))
            for i in range(n - 1, -1, -1):      # sums from place i on, all divided by exp(scale); used before they are rescaled
                new = np.zeros(len(at))
                for m in range(1, min(n - i, self.longest) + 1):
                    row = spans[i, i + m]
                    part = table[row] * beta[i + m]
                    new += part
                    out += np.bincount(row, alpha[i][:, 0] * part * np.exp(log[i][:, 0] + scale - whole) * counts[at], minlength=self.n + 2)
                beta[i] = new
                if (n - i) % RESCALE == 0:
                    for k in range(i, min(n, i + self.longest) + 1):
                        beta[k] = beta[k] / new
                    scale = scale + np.log(new)
        for i, w in enumerate(words):
            if len(w) >= LONG:
                self._expected_long(w, float(counts[i]), table, out)
        return out


def _finder():
    import regex

    return regex.compile(r"\p{L}+").findall


def _words(text: str, find) -> list[str]:
    return [MARK + w for w in find(text.lower())]


def _lattice(model_path: str, _made={}) -> Lattice:
    if model_path not in _made:
        _made[model_path] = Lattice(load_pieces(model_path))
    return _made[model_path]


def held_out(doc_id="doc_id"):
    """Documents kept from learning: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, model_path: str, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS):
    """(languages, table): probabilities of the pieces, a column a language, and a last row of log shares of documents.

    The languages' shares are counted over all labelled training documents; the piece probabilities are fitted on the
    `train_docs` documents of each language that come first by hash of the id. The model is vocabulary x languages numbers.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    shares = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(shares)
    if not langs:
        return [], np.zeros((3, 0))
    # the first by hash lie under this share of the hash's range (four times as many are expected there), so no language is ordered whole
    under = F.create_map(*[F.lit(x) for lang, n in shares.items() for x in (lang, min(1.0, 4 * train_docs / n))])
    labelled = labelled.filter(F.xxhash64("doc_id") / float(1 << 64) + 0.5 <= F.element_at(under, F.col("lang")))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = durable(labelled.withColumn("_place", first).filter(F.col("_place") <= train_docs).select("doc_id", "lang").distinct())
    sample = docs.filter(~held_out()).select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])   # at most train_docs x languages ids

    def split(batches):
        find = _finder()
        for b in batches:
            count: dict[tuple[str, str], int] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in _words(text or "", find):
                    count[lang, w] = count.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()),
                                              pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])
    words = sample.select("text", "lang").mapInArrow(split, "lang string, word string, n long")
    words = durable(words.groupBy("lang", "word").agg(F.sum("n").cast("double").alias("n")))
    n = _lattice(model_path).n
    table = np.full((n + 2, len(langs)), 1.0 / n)
    table[n], table[n + 1] = 0.0, FLOOR

    for _ in range(rounds):
        def expect(batches, table=table):
            lattice, total = _lattice(model_path), np.zeros((n + 2, len(langs)))
            for b in batches:
                lang, word, count = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
                for k, name in enumerate(langs):
                    rows = [i for i, x in enumerate(lang) if x == name]
                    if rows:
                        total[:, k] += lattice.expected([word[i] for i in rows], count[rows], table[:, k])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(total[piece, k])], ["piece", "k", "c"])
        sums = words.mapInArrow(expect, "piece long, k long, c double").groupBy("piece", "k").agg(F.sum("c").alias("c")).toPandas()
        new = np.zeros_like(table)
        new[sums["piece"].to_numpy(), sums["k"].to_numpy()] = sums["c"].to_numpy()
        new = new[:n] + SMOOTH
        table[:n] = new / new.sum(axis=0)
    total = sum(shares.values())
    return langs, np.vstack([table, np.log([[shares[x] / total for x in langs]])])


def predict(docs: DataFrame, model_path: str, langs: list[str], model: np.ndarray, rows: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the language)."""
    def run(batches):
        find, lattice = _finder(), _lattice(model_path)
        table, prior = model[:-1], model[-1]
        known: dict[str, int] = {}
        scores = np.zeros((1024, len(langs)))
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                docs_words = [_words(t or "", find) for t in part.column(2).to_pylist()]
                fresh = list({w for ws in docs_words for w in ws if w not in known}) if langs else []
                place = known
                base = len(known)
                if fresh:
                    if base + len(fresh) > MAX_WORDS:
                        place = _Over(known)
                    if base + len(fresh) > len(scores):
                        scores = np.vstack([scores[:base], np.zeros((base + 2 * len(fresh), len(langs)))])
                    scores[base:base + len(fresh)] = lattice.log_scores(fresh, table)
                    place.update(zip(fresh, range(base, base + len(fresh)), strict=True))
                get = place.__getitem__
                pred, best = [], []
                for ws in docs_words:
                    if not ws or not langs:
                        pred.append("und")
                        best.append(0.0)
                        continue
                    x = scores[list(map(get, ws))].sum(axis=0) + prior
                    e = np.exp(x - x.max())
                    k = int(np.argmax(e))
                    pred.append(langs[k])
                    best.append(float(e[k] / e.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(best, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


class _Over(dict):
    """Words of this batch on top of the remembered ones."""

    def __init__(self, base: dict):
        super().__init__()
        self.base = base

    def __missing__(self, word):
        return self.base[word]


def identify(docs: DataFrame, model_path: str) -> DataFrame:
    langs, model = fit(docs, model_path)
    return predict(docs, model_path, langs, model)
