"""LM scoring by a weighted backoff automaton learned from the corpus itself.

Model: trigrams over bigrams over unigrams, each order smoothed by the next; every n-gram of the training text counts, once seen
or often, so the model grows with its corpus and nothing is pruned.
- unigrams: absolute discounting, p(w) = (c - d)/N; the mass d*V/N is the unknown word's. d from the counts of counts.
- n-grams: p(w | h) = (c(hw) + m p(w | h'))/(c(h) + m), h' being h without its first word. One m an order, so that the failure
  mass is what leaving one out shows: the tokens whose n-gram would be unseen without them, by the counts of counts of
  all training text, are as many as sum of c(h) m/(c(h) - 1 + m) says.
States are contexts seen in training text: two words, one word, the root. An n-gram seen is an arc of its context with
weight p(w | h); a context's failure arc, weight m/(c(h) + m), leads to the context one word shorter; the root has an arc for every
word. After a word the automaton is in the longest context that is a state. A text starts in a start state and ends with an
end token. One traversal from left to right carries the state of every text and adds up log-probabilities.

Distribution: no task ever holds the model. Texts are cut into blocks of about `block_bytes`, kept as word numbers in a table
bucketed by block, so it isn't shuffled again. A block lists its different n-grams as sorted 61-bit hashes with their training counts,
cut into ranges of the hash space; a range's task adds up the counts of all blocks and answers each block with corpus counts
in the order asked. So an n-gram, however frequent, is one entry a block, ranges are equal by the hash, and no key is hot. With
the answers a block builds its part of the automaton and walks all its documents. Two n-grams share a hash, and so a
count, with a chance of n^2/2^62 for n of them.

Null texts are empty: the end token alone. doc_id null: crc32 of the empty string. An empty training set makes every token
unknown with probability one. Repeated rows are scored each and counted each. Texts of any length are one document of one
block. Of the input only doc_id and text are read, so other columns can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bucketed, written

#: The kind of an n-gram, the two low bits of its hash: bigrams that end a text are no contexts.
LAST_PAIR, WORD, PAIR, TRIPLE = range(4)
START = np.uint64(0x5DEECE66D)
_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes."""
    return _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 8 * n, asbytes=True), dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_BLOCK = "block long, part int, ids array<long>, held array<boolean>, lengths array<int>, data binary, n_train long"


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int, piece: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Pieces of blocks: part 0 the hashes of the block's words by number, parts from 1 documents as word numbers (0: the end)."""
    from pyspark import TaskContext

    block, number, size, part = TaskContext.get().partitionId() << 24, _Numbers({b"": 0}), 0, 0
    ids: list = []
    held: list = []
    tokens: list[np.ndarray] = []

    def row(part: int, ids: list, held: list, lengths: list, data: bytes, n_train: int) -> pa.RecordBatch:
        cols = [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())), pa.array([data], pa.binary()), pa.array([n_train], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "part", "ids", "held", "lengths", "data", "n_train"])

    def documents() -> pa.RecordBatch:
        nonlocal part
        part += 1
        lengths = [len(t) for t in tokens]
        flat = np.concatenate(tokens).view(np.uint8).reshape(-1, 4)
        out = row(part, list(ids), list(held), lengths, _ZSTD.compress(np.ascontiguousarray(flat.T), asbytes=True), sum(n for n, h in zip(lengths, held) if not h))
        ids.clear(), held.clear(), tokens.clear()
        return out

    def vocabulary() -> pa.RecordBatch:
        return row(0, [], [], [len(number)], b"".join([xxhash.xxh64_digest(w, 7) for w in number]), 0)

    waiting = 0
    for b in batches:
        for doc, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            words = raw.lower().split()
            t = np.empty(len(words) + 1, dtype=np.int32)
            t[:-1] = np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words))
            t[-1] = 0
            ids.append(doc), held.append(out), tokens.append(t)
            size += len(raw) + 64
            waiting += len(t)
            if waiting >= piece or size >= block_bytes:
                yield documents()
                waiting = 0
            if size >= block_bytes:
                yield vocabulary()
                block, number, size, part = block + 1, _Numbers({b"": 0}), 0, 0
    if tokens:
        yield documents()
    if size:
        yield vocabulary()


class _Block:
    """A block's documents: tokens with a start before each text, and the hashes of the n-grams that end at each."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("part")
        parts = rows.column("part").to_pylist()
        data = [x.as_py() for x in rows.column("data")]
        lengths = rows.column("lengths").to_pylist()
        hashes = np.frombuffer(data[0], dtype=">u8").astype(np.uint64) if parts[0] == 0 else np.zeros(0, dtype=np.uint64)
        self.ids = [i for x in rows.column("ids").to_pylist()[1:] for i in x]
        self.held = np.array([h for x in rows.column("held").to_pylist()[1:] for h in x], dtype=bool)
        self.lengths = np.array([n for x in lengths[1:] for n in x], dtype=np.int64)
        planes = [np.frombuffer(_ZSTD.decompress(d, 4 * sum(n), asbytes=True), dtype=np.uint8).reshape(4, -1) for d, n in zip(data[1:], lengths[1:])]
        tokens = np.concatenate([np.ascontiguousarray(p.T).view(np.int32).ravel() for p in planes])
        self.starts = np.cumsum(self.lengths) - self.lengths
        first = np.zeros(len(tokens), dtype=bool)
        first[self.starts] = True
        self.first = first
        word = mixed(hashes)[tokens]
        before = np.r_[START, word[:-1]]
        before[first] = START
        pair = mixed(before * np.uint64(3) + word)
        third = mixed(np.r_[START, pair[:-1]] * np.uint64(5) + word)
        kind = np.where(tokens == 0, np.uint64(LAST_PAIR), np.uint64(PAIR))
        #: n-grams by token, of 63 bits; a text's first token has no triple
        kinds = lambda x, kind: (x >> np.uint64(1) & ~np.uint64(3)) | kind
        self.word, self.pair, self.triple = kinds(word, np.uint64(WORD)), kinds(pair, kind), kinds(third, np.uint64(TRIPLE))[~first]


def _asks(rows: pa.Table, ranges: int) -> pa.Table:
    """The block's different n-grams, sorted, with their counts in training texts: a row for each range of hashes."""
    schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
    b = _Block(rows)
    train = np.repeat(~b.held, b.lengths)
    # the lowest bit tells training text; sorted in place, so that a block's n-grams are held twice at most
    grams = np.concatenate([b.word, b.pair, b.triple])
    grams <<= np.uint64(1)
    grams |= np.concatenate([train, train, train[~b.first]])
    del b
    grams.sort()
    flags = (grams & np.uint64(1)).astype(np.int64)
    grams >>= np.uint64(1)
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    counts = np.add.reduceat(flags, starts)
    del flags
    grams = grams[starts]
    ends = np.searchsorted(grams, _bounds(ranges)[1:], side="left")
    ends[-1] = len(grams)
    out, at = [], 0
    block = rows.column("block")[0].as_py()
    for r, end in enumerate(ends.tolist()):
        if end > at:
            part = grams[at:end]
            out.append((block, r, end - at, squeeze(np.r_[part[:1], np.diff(part)]), squeeze(counts[at:end])))
            at = end
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _bounds(ranges: int) -> np.ndarray:
    """ranges + 1 ends of equal parts of the hashes."""
    return np.array([r * (1 << 63) // ranges for r in range(ranges + 1)], dtype=np.uint64)


#: Counts of counts: exact below, then a bin for every eighth of a doubling.
EXACT = 64


def _bin(c: np.ndarray) -> np.ndarray:
    return np.where(c < EXACT, c, EXACT + np.floor(8 * np.log2(np.maximum(c, EXACT) / EXACT))).astype(np.int64)


def _answers(rows: pa.Table) -> pa.Table:
    """A range's corpus counts, to each block in the order of its asking; and (block null) counts of counts by kind:
    n-grams and tokens a bin."""
    schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("n", pa.int32()), ("counts", pa.binary()), ("kinds", pa.list_(pa.int64())), ("bins", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
    sizes = rows.column("n").to_pylist()
    hashes = np.concatenate([np.cumsum(unsqueeze(h.as_py(), n), dtype=np.uint64) for h, n in zip(rows.column("hashes"), sizes)])
    counts = np.concatenate([unsqueeze(c.as_py(), n).view(np.int64) for c, n in zip(rows.column("counts"), sizes)])
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], starts)
    kind = (ordered[starts] & np.uint64(3)).astype(np.int64)
    told = np.empty(len(hashes), dtype=np.int64)
    told[order] = total[np.cumsum(new) - 1]
    out, at = [], 0
    r = rows.column("range")[0].as_py()
    for block, n in zip(rows.column("block").to_pylist(), sizes):
        out.append((block, r, n, squeeze(told[at : at + n]), None, None, None, None))
        at += n
    seen = total > 0
    cell = kind[seen] * 4096 + _bin(total[seen])
    cells, back = np.unique(cell, return_inverse=True)
    grams = np.bincount(back, minlength=len(cells))
    tokens = np.zeros(len(cells), dtype=np.int64)
    np.add.at(tokens, back, total[seen])
    out.append((None, r, 0, None, (cells >> 12).tolist(), (cells & 4095).tolist(), grams.tolist(), tokens.tolist()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def fit(contexts: list[tuple[int, int]], single: int) -> float:
    """m so that sum of tokens * m/(c - 1 + m) over contexts (n, tokens of all n) equals `single`. c: tokens / n, the mean."""
    value = lambda m: sum(t * m / (t / n - 1 + m) for n, t in contexts)
    lo, hi = 1e-3, 1e9
    for _ in range(80):
        mid = (lo * hi) ** 0.5
        lo, hi = (mid, hi) if value(mid) < single else (lo, mid)
    return (lo * hi) ** 0.5


def walk(starts: np.ndarray, lengths: np.ndarray, arcs: list[tuple[np.ndarray, np.ndarray]], fails: list[np.ndarray], into: np.ndarray) -> np.ndarray:
    """Log-probabilities of the documents: one traversal from left to right, a token of every document at a time.

    A state is its level, the words of its context. arcs[k]: by token, whether the context of k words before it has an arc for it, and
    the arc's weight; fails[k]: weight of that context's failure arc; into: the level after the token. Once few long documents
    are left, they are walked one by one.
    """
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    state, score = np.ones(len(by), dtype=np.int8), np.zeros(len(by))
    live = len(by)
    t = 0
    while t < int(lengths[0]):
        while live and lengths[live - 1] <= t:
            live -= 1
        if live < 24:
            break
        at = starts[:live] + t
        s = state[:live]
        open_ = np.ones(live, dtype=bool)
        for k in range(len(arcs) - 1, -1, -1):
            here = open_ & (s >= k)
            found = here & arcs[k][0][at]
            score[:live] += np.where(found, arcs[k][1][at], np.where(here, fails[k][at], 0.0))
            open_ &= ~found
        state[:live] = into[at]
        t += 1
    for i in range(live):
        lo, hi, s, total = int(starts[i]) + t, int(starts[i] + lengths[i]), int(state[i]), float(score[i])
        has, weight = [a[0][lo:hi].tolist() for a in arcs], [a[1][lo:hi].tolist() for a in arcs]
        down, after = [f[lo:hi].tolist() for f in fails], into[lo:hi].tolist()
        for j in range(hi - lo):
            k = s
            while not has[k][j]:
                total += down[k][j]
                k -= 1
            total += weight[k][j]
            s = after[j]
        score[i] = total
    back = np.empty(len(by))
    back[by] = score
    return back


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(rows: pa.Table, answers: pa.Table, total: int, kinds: int, discount: float, m2: float, m3: float, n_starts: int) -> pa.Table:
    """Builds the block's automaton from the answers and walks its documents."""
    if not len(rows):
        return _SCORED.empty_table()
    b = _Block(rows)
    answers = answers.sort_by("range")
    told = np.concatenate([unsqueeze(c.as_py(), n).view(np.int64) for c, n in zip(answers.column("counts"), answers.column("n").to_pylist())])
    grams = np.concatenate([b.word, b.pair, b.triple])
    del b.word, b.pair, b.triple
    order = np.argsort(grams)
    grams = grams[order]
    counts = np.empty(len(grams), dtype=np.int64)
    counts[order] = told[np.cumsum(np.r_[True, grams[1:] != grams[:-1]]) - 1]
    del order, grams, told
    n = len(b.first)
    c1, c2, c3 = counts[:n], counts[n : 2 * n], np.zeros(n, dtype=np.int64)
    c3[~b.first] = counts[2 * n :]
    # documents of some hundred thousand tokens at a time, so that weights need little memory
    out, ends, lo = [], np.cumsum(b.lengths), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 400_000)))
        at = slice(int(b.starts[lo]), int(ends[hi - 1]))
        out.append(_weigh(c1[at], c2[at], c3[at], b.starts[lo:hi] - b.starts[lo], b.lengths[lo:hi], b.first[at], total, kinds, discount, m2, m3, n_starts))
        lo = hi
    known, base, score = (np.concatenate(x) for x in zip(*out))
    return pa.table([pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(known), pa.array(base), pa.array(score)], schema=_SCORED)


def _weigh(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, total: int, kinds: int, discount: float, m2: float, m3: float, n_starts: int) -> tuple[np.ndarray, ...]:
    """Known tokens, base score and score of documents, given the corpus counts of the n-grams that end at each token."""
    r1, r2 = np.r_[0, c1[:-1]], np.r_[0, c2[:-1]]
    r1[first], r2[first] = n_starts, 0
    base = np.log10((c1 + 0.5) / (total + 0.5 * (kinds + 1)))
    p1 = np.where(c1 > 0, c1 - discount, max(discount * kinds, 1e-300)) / total if total else np.ones(len(c1))
    p2 = (c2 + m2 * p1) / (r1 + m2)
    p3 = (c3 + m3 * p2) / (r2 + m3)
    arcs = [(np.ones(len(c1), dtype=bool), np.log10(p1)), (c2 > 0, np.log10(p2)), (c3 > 0, np.log10(p3))]
    fails = [np.zeros(len(c1)), np.log10(m2 / (r1 + m2)), np.log10(m3 / (r2 + m3))]
    into = np.where(c2 > 0, 2, np.where(c1 > 0, 1, 0)).astype(np.int8)
    sums = lambda x: np.add.reduceat(x, starts)
    return sums((c1 > 0).astype(np.int64)), sums(base), walk(starts, lengths, arcs, fails, into)


def score(docs: DataFrame, *, folds: int = 5, held_fold: int = 1, block_bytes: int = 16_000_000, range_grams: int = 3_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a row of docs.

    range_grams: n-grams that a range's task holds at once, about.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(given.mapInArrow(lambda it: _blocks(it, block_bytes), _BLOCK), parts, "block")
    scalars = blocks.agg(F.sum("n_train").alias("total"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)).alias("tokens"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("starts")).first()
    total, starts = int(scalars["total"] or 0), int(scalars["starts"] or 0)
    ranges = max(parts, 2 * int(scalars["tokens"] or 0) // range_grams)
    asks = blocks.groupBy("block").applyInArrow(lambda rows: _asks(rows, ranges), "block long, range int, n int, hashes binary, counts binary")
    answers = written(asks.groupBy("range").applyInArrow(_answers, "block long, range int, n int, counts binary, kinds array<long>, bins array<long>, grams array<long>, tokens array<long>"))
    cells = answers.filter("block is null").select(F.explode(F.arrays_zip("kinds", "bins", "grams", "tokens")).alias("z")).groupBy("z.kinds", "z.bins").agg(F.sum("z.grams").alias("grams"), F.sum("z.tokens").alias("tokens")).collect()  # a few hundred bins a kind
    bins = {kind: {r["bins"]: (r["grams"], r["tokens"]) for r in cells if r["kinds"] == kind} for kind in (LAST_PAIR, WORD, PAIR, TRIPLE)}
    size = lambda kind, b: bins[kind].get(b, (0, 0))[0]
    kinds, once, twice = sum(n for n, _ in bins[WORD].values()), size(WORD, 1), size(WORD, 2)
    discount = (once + 0.5) / (once + 2 * twice + 1)
    m2 = fit(list(bins[WORD].values()), size(PAIR, 1) + size(LAST_PAIR, 1))  # the end, no context, stands for the start, which is as frequent
    m3 = fit(list(bins[PAIR].values()), size(TRIPLE, 1))
    told = answers.filter("block is not null").select("block", "range", "n", "counts")
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, total, kinds, discount, m2, m3, starts), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
