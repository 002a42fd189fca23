"""Operator 10: language-model scores from a hidden Markov model.

1. Counts: words of the training texts are counted per batch, added up by fingerprint in packed
   buckets.  A histogram of counts gives the thresholds of the `vocabulary` words that the model
   emits one by one and of the `frequent` words whose counts are broadcast (both bounds hold
   whatever the corpus).
2. Training: latent states emit a vocabulary word, or one symbol for all others.  From the corpus
   counts, Baum-Welch steps over a small sample find a starting point; from there, steps over all
   training texts follow until one gains less than 0.001 digits a token: tasks add up expected starts, transitions and
   emissions in tables of the vocabulary's size, which are summed in chunks by streams.
3. Scoring: the scaled forward recursion gives the exact likelihood of the sequence of symbols.
   An other word adds its share of the others' mass, add-one smoothed.  Counts of words
   beyond the frequent ones come by a join of packed buckets, so all counts are exact.

Texts are cut into stretches that advance in step, as products of matrices; their products are
then joined in order, so a very long text costs no more per word than a short one.

Defined cases: null and empty texts are one end; ties and repeated rows are scored alike; a null
doc_id trains nothing and is not held out; without training texts every token is unknown (N and V
are 0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import CHUNKS_DDL, Scratch, add_chunks, scan

END = np.uint64(0x7E57ED0E4D0F7E47)
_STRETCH = 128
_FLUSH = 1_500_000


class Tokens:
    """Words of texts, each text closed by the end token."""

    def __init__(self, texts: pa.Array):
        w = W.Words(texts, W.SPACES, lower=True)
        docs = len(w.first) - 1
        self.first = w.first + np.arange(docs + 1)
        self.names = np.full(len(w) + docs, END, np.uint64)
        self.names[np.arange(len(w)) + w.doc] = w.hashes
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))


class Model:
    """Start, transition and emission probabilities; symbol len(known) is any other word."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, share: np.ndarray, states: int, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[None, :] * np.exp(rng.normal(0, 0.7, (states, len(share))))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray, share: np.ndarray, states: int, prior: float = 50.0) -> Model:
        k, s = states, len(share)
        start, move, emit = counts[:k] + 0.1, counts[k : k + k * k].reshape(k, k) + 0.1, counts[k + k * k :].reshape(k, s) + prior * share
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class Stretches:
    """Token sequences cut into stretches of at most `most`, longest first, so all advance in step."""

    def __init__(self, first: np.ndarray, most: int = _STRETCH):
        size = np.diff(first)
        many = -(-size // most)
        self.of_doc = np.r_[0, np.cumsum(many)]
        doc = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(doc)) - np.repeat(self.of_doc[:-1], many)
        start = first[doc] + nth * most
        length = np.minimum(most, first[doc + 1] - start)
        self.order = np.argsort(-length, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        self.start, self.length, self.head = start[self.order], length[self.order], nth[self.order] == 0
        # how many stretches are at least t + 1 long
        self.live = np.searchsorted(-self.length, -np.arange(1, most + 1), "right") if len(length) else np.zeros(most, int)
        self.steps = int(length.max()) if len(length) else 0
        self.by_doc = np.argsort(-many, kind="stable")
        self.many = many


def _products(model: Model, s: Stretches, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch's product of transitions and emissions, scaled, and the log10 of its scale."""
    k = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    x = np.broadcast_to(np.eye(k), (len(s.start), k, k)).copy()
    scale = np.zeros(len(s.start))
    x[~s.head] = model.move
    for t in range(s.steps):
        n = s.live[t]
        y = x[:n] if t == 0 else (x[:n].reshape(-1, k) @ model.move).reshape(n, k, k)
        y = y * emit[symbols[s.start[:n] + t]][:, None, :]
        if t % 16 == 15 or t == s.steps - 1:
            top = y.max((1, 2))
            y /= top[:, None, None]
            scale[:n] += np.log10(top)
        x[:n] = y
    return x, scale


def _chain(model: Model, s: Stretches, x: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state vector before each stretch, and each document's log10 likelihood."""
    docs = len(s.many)
    v, total = np.broadcast_to(model.start, (docs, len(model.start))).copy(), np.zeros(docs)
    before = np.empty((len(s.start), len(model.start)))
    for j in range(int(s.many.max(initial=0))):
        d = s.by_doc[: np.searchsorted(-s.many[s.by_doc], -(j + 1), "right")]
        at = s.place[s.of_doc[d] + j]
        before[at] = v[d]
        y = np.einsum("dk,dkl->dl", v[d], x[at])
        norm = y.sum(1)
        v[d] = y / norm[:, None]
        total[d] += np.log10(norm) + scale[at]
    return before, total


def log_likelihood(model: Model, first: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of symbols."""
    s = Stretches(first)
    x, scale = _products(model, s, symbols)
    return _chain(model, s, x, scale)[1]


def expected_counts(model: Model, first: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Expected starts, transitions and emissions of whole sequences, as one flat array."""
    return _expected(model, first, symbols)[0]


def _expected(model: Model, first: np.ndarray, symbols: np.ndarray, real: type = np.float64) -> tuple[np.ndarray, float]:
    """The expected counts, and the log10 probability of all sequences.

    real: the type of the state vectors, of which one a token is held; they are normed at each step, and counts are
    added up in double precision.
    """
    k, n_symbols = len(model.start), model.emit.shape[1]
    s = Stretches(first, 8 * _STRETCH)
    before, after = np.broadcast_to(model.start.astype(real), (len(s.start), k)).copy(), np.ones((len(s.start), k), real)
    cut = np.flatnonzero(s.many > 1)  # only texts of several stretches need products
    if len(cut):
        size = np.diff(first)[cut]
        inside = Stretches(np.r_[0, np.cumsum(size)], 8 * _STRETCH)
        at = np.repeat(first[cut] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        x, scale = _products(model, inside, symbols[at])
        ahead, _ = _chain(model, inside, x, scale)
        back = np.ones((len(inside.start), k))
        w = np.ones((len(cut), k))
        for j in range(int(inside.many.max()) - 1, -1, -1):
            d = inside.by_doc[: np.searchsorted(-inside.many[inside.by_doc], -(j + 1), "right")]
            at = inside.place[inside.of_doc[d] + j]
            back[at] = w[d]
            y = np.einsum("dkl,dl->dk", x[at], w[d])
            w[d] = y / y.sum(1, keepdims=True)
        mine = s.place[np.repeat(s.of_doc[cut] - inside.of_doc[:-1], inside.many) + np.arange(len(inside.start))]
        before[mine], after[mine] = ahead[inside.place], back[inside.place]
    found, one = 0.0, np.ones((k, 1), real)
    emit, move = np.ascontiguousarray(model.emit.T, real), model.move.astype(real)
    held = np.empty((len(symbols), k), real)  # forward vectors, then posteriors in their place
    a = before.copy()
    for t in range(s.steps):
        n = s.live[t]
        y = a[:n] @ move
        if t == 0:
            y = np.where(s.head[:n, None], a[:n], y)
        at = s.start[:n] + t
        y *= emit[symbols[at]]
        norm = y @ one
        found += float(np.log10(norm).sum(dtype=np.float64))
        y /= norm
        held[at] = y
        a[:n] = y
    moves, back = np.zeros((k, k)), np.ascontiguousarray(move.T)
    b = after
    for t in range(s.steps - 1, -1, -1):
        n = s.live[t]
        at = s.start[:n] + t
        seen = emit[symbols[at]] * b[:n]
        prior = before[:n] if t == 0 else held[at - 1]
        p, q = (prior[~s.head[:n]], seen[~s.head[:n]]) if t == 0 else (prior, seen)
        moves += (p / (((p @ move) * q) @ one)).T @ q
        g = held[at] * b[:n]
        held[at] = g / (g @ one)
        y = seen @ back
        b[:n] = y / (y @ one)
    starts = held[first[:-1]].sum(0, dtype=np.float64) if len(first) > 1 else np.zeros(k)
    emissions = np.stack([np.bincount(symbols, held[:, i], n_symbols) for i in range(k)])
    return np.concatenate([starts, (moves * model.move).ravel(), emissions.ravel()]), found


def _bucket(names: np.ndarray, bits: int) -> np.ndarray:
    return (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)


def _packed(bits: int, names: np.ndarray, *columns: np.ndarray):
    """(bucket, packed names, packed columns...) of names in order."""
    bucket = _bucket(names, bits)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(bucket)][: len(cut)]
    return bucket[cut], [[x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)] for x in (names, *columns)]


def _count(bits: int):
    def run(batches):
        held, many = [], 0

        def rows():
            names, count = np.unique(np.concatenate(held), return_counts=True)
            bucket, (n, c) = _packed(bits, names, count.astype(np.uint32))
            return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(n, pa.binary()), pa.array(c, pa.binary())], names=["bucket", "names", "counts"])

        for batch in W.pieces(batches, "text"):
            held.append(Tokens(batch.column("text")).names)
            many += len(held[-1])
            if many >= _FLUSH:
                yield rows()
                held, many = [], 0
        if held:
            yield rows()

    return run


def _sum(table: pa.Table) -> pa.Table:
    names = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    uniq, inverse = np.unique(names, return_inverse=True)
    total = np.bincount(inverse, counts).astype(np.int64)
    level = np.bincount(_level(total), minlength=_LEVELS)
    mass = np.bincount(_level(total), total, _LEVELS).astype(np.int64)
    return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (uniq, total, level, mass))], names=["bucket", "names", "counts", "level", "mass"])


_LEVELS = 1024


def _level(count: np.ndarray) -> np.ndarray:
    """Counts up to 127 one by one, then sixteen to an octave."""
    c = np.maximum(count, 1).astype(np.float64)
    return np.where(count < 128, count, 128 + np.floor(16 * np.log2(c / 128))).astype(np.int64)


def _above(level: int):
    """Words of at least this level, from packed buckets."""

    def run(batches):
        for batch in batches:
            for n, c in zip(batch.column("names").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                names, counts = np.frombuffer(n, np.uint64), np.frombuffer(c, np.int64)
                ok = _level(counts) >= level
                yield pa.record_batch([pa.array(names[ok].view(np.int64)), pa.array(counts[ok])], names=["name", "n"])

    return run


class Lexicon:
    """Sorted fingerprints and counts of the frequent words, and which of them the model emits."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, vocabulary_level: int, total: int, distinct: int):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order]
        self.total, self.distinct = total, distinct
        own = _level(self.counts) >= vocabulary_level
        own |= self.names == END
        self.size = int(own.sum())
        self.symbol = np.full(len(names) + 1, self.size, np.int32)
        self.symbol[:-1][own] = np.arange(self.size)
        self.other_mass = total - int(self.counts[own].sum()) + (distinct - self.size) + 1
        share = np.r_[self.counts[own], max(1, total - int(self.counts[own].sum()))] + 1.0
        self.share = share / share.sum()

    def find(self, names: np.ndarray) -> np.ndarray:
        """Place of each name, or one past the end."""
        if not len(self.names):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, len(self.names))


def _symbols(lexicon):
    """Each text as the symbols that the model knows."""

    def run(batches):
        for batch in W.pieces(batches, "text"):
            t = Tokens(batch.column("text"))
            x = lexicon.value.symbol[lexicon.value.find(t.names)]
            yield pa.record_batch([batch.column("h"), pa.array([x[i:j].tobytes() for i, j in zip(t.first[:-1], t.first[1:], strict=True)], pa.binary())], names=["h", "symbols"])

    return run


#: Sums of a step that travel together, 128 KB: the tasks that add them up share them out by chunk.
_CHUNK_SUMS = 1 << 14


def _expect(model, at_once: int = 1_500_000):
    """A task's expected counts; texts of some `at_once` tokens advance in step."""

    def run(batches):
        from pyspark import TaskContext

        total, held, many = None, [], 0

        def add():
            first = np.r_[0, np.cumsum([len(x) for x in held])]
            counts, found = _expected(model.value, first, np.concatenate(held), np.float32)
            return np.r_[counts, found] if total is None else total + np.r_[counts, found]

        for batch in batches:
            for x in batch.column("symbols"):
                held.append(np.frombuffer(x.as_buffer(), np.int32))
                many += len(held[-1])
                if many >= at_once:
                    total = add()
                    held, many = [], 0
        if held:
            total = add()
        if total is not None:
            parts = [total[k : k + _CHUNK_SUMS].tobytes() for k in range(0, len(total), _CHUNK_SUMS)]
            slot, n = TaskContext.get().partitionId(), len(parts)
            for k in range(n):
                yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([k], pa.int32()), pa.array([True]), pa.array([parts[k]], pa.binary())], names=["slot", "chunk", "real", "data"])

    return run


_SCORED_DDL = "kind int, rid long, doc_id long, n_tokens long, n_known long, base double, score double, bucket int, names binary, rids binary, times binary"
_SCORED = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("bucket", pa.int32()), ("names", pa.binary()), ("rids", pa.binary()), ("times", pa.binary())])


def _score(lexicon, model, bits: int):
    """Per document what the frequent words give; packed by bucket the words beyond them."""

    def run(batches):
        from pyspark import TaskContext

        row, held, many = TaskContext.get().partitionId() << 40, [], 0
        lex = lexicon.value
        counts = np.r_[lex.counts, 0]
        frequent = len(lex.names)

        def rest():
            names, rids = (np.concatenate([h[j] for h in held]) for j in range(2))
            order = np.lexsort((rids, names))
            names, rids = names[order], rids[order]
            at = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (rids[1:] != rids[:-1])]) if len(names) else np.zeros(0, int)
            times = np.diff(np.r_[at, len(names)]).astype(np.uint32)
            bucket, (n, r, t) = _packed(bits, names[at], rids[at], times)
            k = len(bucket)
            return pa.record_batch([pa.array(np.ones(k, np.int32)), *(pa.nulls(k, x) for x in _SCORED.types[1:7]), pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in (n, r, t))], schema=_SCORED)

        for batch in W.pieces(batches, "text"):
            t = Tokens(batch.column("text"))
            docs = len(t.first) - 1
            at = lex.find(t.names)
            symbol = lex.symbol[at]
            gain = np.log10(counts[at] + 1.0)
            base = np.bincount(t.doc, gain, docs)
            other = np.bincount(t.doc, np.where(symbol == lex.size, gain - math.log10(lex.other_mass), 0), docs)
            score = log_likelihood(model.value, t.first, symbol) + other
            known = np.bincount(t.doc, at < frequent, docs).astype(np.int64)
            size = np.diff(t.first)
            base -= size * math.log10(lex.total + lex.distinct + 1)
            rids = row + np.arange(docs)
            yield pa.record_batch([pa.array(np.zeros(docs, np.int32)), pa.array(rids), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(known), pa.array(base), pa.array(score), pa.nulls(docs, pa.int32()), *(pa.nulls(docs, pa.binary()) for _ in range(3))], schema=_SCORED)
            rare = at == frequent
            held.append((t.names[rare], rids[t.doc[rare]]))
            many += int(rare.sum())
            row += docs
            if many >= _FLUSH:
                yield rest()
                held, many = [], 0
        if many:
            yield rest()

    return run


def _rare(words: pa.Table, texts: pa.Table) -> pa.Table:
    """For a bucket: what words beyond the frequent ones add to their rows, packed by the rows' task."""
    out = {"task": [], "rids": [], "gain": [], "known": []}
    if words.num_rows and texts.num_rows:
        names, counts = np.frombuffer(words.column("names")[0].as_py(), np.uint64), np.frombuffer(words.column("counts")[0].as_py(), np.int64)
        n, r, t = (np.concatenate([np.frombuffer(x, k) for x in texts.column(c).to_pylist()]) for c, k in (("names", np.uint64), ("rids", np.int64), ("times", np.uint32)))
        at = np.minimum(np.searchsorted(names, n), len(names) - 1)
        ok = names[at] == n
        c, r, t = counts[at[ok]], r[ok], t[ok].astype(np.float64)
        rid, inverse = np.unique(r, return_inverse=True)
        gain, known = np.bincount(inverse, np.log10(c + 1.0) * t, len(rid)), np.bincount(inverse, t, len(rid)).astype(np.uint32)
        task = rid >> 40
        cut = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(rid) else np.zeros(0, int)
        for i, j in zip(cut, np.r_[cut[1:], len(rid)], strict=False):
            out["task"].append(int(task[i]))
            for c_, x in (("rids", rid), ("gain", gain), ("known", known)):
                out[c_].append(x[i:j].tobytes())
    return pa.table([pa.array(out["task"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("rids", "gain", "known"))], names=list(out))


def _add(table: pa.Table) -> pa.Table:
    r, g, n = (np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]) for c, k in (("rids", np.int64), ("gain", np.float64), ("known", np.uint32)))
    rid, inverse = np.unique(r, return_inverse=True)
    return pa.table([pa.array(rid), pa.array(np.bincount(inverse, g, len(rid))), pa.array(np.bincount(inverse, n, len(rid)).astype(np.int64))], names=["rid", "gain", "known"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _settled(spark: SparkSession, told: DataFrame, model: Model, lexicon: Lexicon, gain: float) -> Model:
    """Baum-Welch steps over all of these texts until one adds less than `gain` decimal digits a token."""
    before, states = -math.inf, len(model.start)
    while True:
        now = spark.sparkContext.broadcast(model)
        rows = sorted((r["chunk"], r["data"]) for r in add_chunks(told.select("symbols").mapInArrow(_expect(now), CHUNKS_DDL)).collect())  # one table of sums
        now.unpersist()
        if not rows:
            return model
        sums = np.concatenate([np.frombuffer(x, np.float64) for _, x in rows])
        model = Model.from_counts(sums[:-1], lexicon.share, states)
        tokens = sums[states + states * states : -1].sum()  # each token is one expected emission
        if sums[-1] - before < gain * tokens:
            return model
        before = sums[-1]


def score_texts(spark: SparkSession, docs: DataFrame, states: int = 8, vocabulary: int = 4096, frequent: int = 1 << 18, gain: float = 0.001, sample: int = 2000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    vocabulary: the least number of words that the model emits one by one; it grows with the square root of
    the training tokens, up to `frequent`; all further words are one symbol, and their counts tell them apart.
    gain: Baum-Welch steps over all training texts end with the first that adds less than so many decimal digits a
    token, so it is no maximum to the last digit.  sample: about how many training texts, by hash, the steps that find
    the starting point read, at every size (all texts of a smaller table); the steps that train read all.
    """
    scratch = Scratch(spark, "hmm")
    texts = scan(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    train = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("b"), F.count("*").alias("n")).first()
    bits = max(1, min(20, math.ceil(math.log2(max(2, (size["b"] or 0) / 6 / 1_000_000)))))
    counted = scratch.table(train.select("text").mapInArrow(_count(bits), "bucket int, names binary, counts binary").groupBy("bucket").applyInArrow(_sum, "bucket int, names binary, counts binary, level binary, mass binary"))
    level, mass = np.zeros(_LEVELS, np.int64), np.zeros(_LEVELS, np.int64)
    packed = counted.select(F.col("bucket").alias("slot"), F.lit(0).alias("chunk"), F.lit(False).alias("real"), F.concat("level", "mass").alias("data"))
    for r in add_chunks(packed).collect():  # one row
        level, mass = np.frombuffer(r["data"], np.int64).reshape(2, -1)
    total, distinct = int(mass.sum()), int(level.sum())
    ahead = np.cumsum(level[::-1])[::-1]
    least = lambda most: max(1, int(np.argmax(np.r_[ahead, 0] <= most)))  # noqa: E731  the lowest level with at most so many words from it on
    common = counted.select("names", "counts").mapInArrow(_above(least(frequent)), "name long, n long").collect()  # at most `frequent` rows
    names, counts = np.array([r["name"] for r in common], np.int64).view(np.uint64), np.array([r["n"] for r in common], np.int64)
    trained = train.count()
    if trained and END not in names:
        names, counts = np.r_[names, END], np.r_[counts, trained]
    lexicon = Lexicon(names.astype(np.uint64), counts.astype(np.int64), least(max(vocabulary, min(frequent, math.isqrt(total)))), total, distinct)
    lex = spark.sparkContext.broadcast(lexicon)

    model = Model.first(lexicon.share, states)
    if trained:
        # written once: each step reads numbers, not texts
        told = train.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"), "text").mapInArrow(_symbols(lex), "h long, symbols binary")
        told = scratch.table(told)
        model = _settled(spark, told.where(F.col("h") < (1 << 40) * sample // trained), model, lexicon, gain)
        model = _settled(spark, told, model, lexicon, gain)

    fixed = spark.sparkContext.broadcast(model)
    scored = scratch.table(texts.mapInArrow(_score(lex, fixed, bits), _SCORED_DDL))
    rare = counted.select("bucket", "names", "counts").groupBy("bucket").cogroup(scored.where("kind = 1").select("bucket", "names", "rids", "times").groupBy("bucket"))
    more = rare.applyInArrow(_rare, "task long, rids binary, gain binary, known binary").groupBy("task").applyInArrow(_add, "rid long, gain double, known long")
    rows = scored.where("kind = 0").select("rid", "doc_id", "n_tokens", "n_known", "base", "score").join(more, "rid", "left")
    more_gain, known = F.coalesce("gain", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more_gain).alias("base_score"), (F.col("score") + more_gain).alias("score"),
    )
