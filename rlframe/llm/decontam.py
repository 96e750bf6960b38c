"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. Passages are TF-IDF
rows over the words of the benchmark; a randomised singular value
decomposition of that matrix, with the products over rows summed by Spark,
gives a latent space. Passages whose cosine with an item passes a low bound
are candidates, and a longest common subsequence of words around them, with a
check of the item's answer, decides. Frequent words carry no weight there, so
an item that has some is also looked for exactly: a leak has all but a known
number of the item's places, hence some among those of its rarest words, however
frequent these are; where enough of them are near, the same check decides.

Only matrices of vocabulary size times ``RANK`` come to the driver. The
benchmark is the query set; it is taken in blocks of ``ITEMS_AT_ONCE`` items,
so what is shipped to tasks is bounded whatever its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.llm.shared import slices, staged, text_bytes

ITEMS_AT_ONCE = 5_000
STEP = 16
PASSAGE = 2 * STEP
RANK = 256
OVERSAMPLE = 16
#: Words in a larger share of blocks carry no weight in the rows ...
MAX_BLOCK_SHARE = 0.001
#: ... but for so many of the rarest words of each item, which always do.
LEAST_TERMS = 6
#: Passages looked at together in the exact search of items with such words, and
#: the places of an item's rarest words that have to be near for a closer look.
STRETCH = 16
LEAST_NEAR = 4
#: Counters of (stretch, item), and hits, that a task holds at once.
CELLS_AT_ONCE = 1_000_000
MIN_COSINE = 0.35
MIN_LCS = 0.6
SURE_LCS = 0.8
ANSWER_WORDS = 8
MIN_ANSWER = 0.5
BYTES_AT_ONCE = 2_000_000

_MARKS = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
_TABLE = bytes.maketrans(_MARKS, b" " * len(_MARKS))

RESULT = "doc_id long, item_id long, first_word long, cosine double, lcs double, answer double"


def words(text: bytes) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return text.decode().lower().encode().translate(_TABLE).split()


def lcs_length(masks: dict[int, int], n: int, seq) -> int:
    """Longest common subsequence of an item, given the bit mask of places of
    each word, and a sequence of word ids (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for x in seq:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def place_masks(item: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _run_sums(rows: np.ndarray, index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``rows[index]`` over runs starting at ``first``, the longest run
    first, and the place of each run's sum. Runs are mostly of one or two rows:
    all first members are taken at once, then all second ones, and so on."""
    size = np.diff(np.append(first, len(index)))
    order = np.argsort(-size, kind="stable")
    start, size = first[order], size[order]
    out = rows[index[start]]
    longer = len(size) - np.cumsum(np.bincount(size))  # by k: runs of more than k members
    for k in range(1, int(size[0])):
        out[:longer[k]] += rows[index[start[:longer[k]] + k]]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return out, place


def _block_sums(seqs: list[np.ndarray], weight: np.ndarray):
    """For passages with a weighted word: (text, first word, sum of word rows)."""
    n_blocks = np.array([-(-len(s) // STEP) for s in seqs])
    at = np.concatenate([[0], np.cumsum(n_blocks)])
    block = np.concatenate([at[i] + np.arange(len(s)) // STEP for i, s in enumerate(seqs)])
    term = np.concatenate(seqs)
    hit = np.flatnonzero((weight != 0).any(1)[term])
    block, term = block[hit], term[hit]
    if len(hit) == 0:
        return None
    used, first = np.unique(block, return_index=True)
    sums, place = _run_sums(weight, term, first)
    sums = np.concatenate([sums, np.zeros((1, weight.shape[1]), np.float32)])
    # passage p holds blocks p and p + 1 of one text; the last block alone if a text has but one
    text_of = np.searchsorted(at, used, side="right") - 1
    last = np.maximum(at[text_of + 1] - 2, at[text_of])
    passages = np.unique(np.concatenate([np.minimum(used, last), np.maximum(used - 1, at[text_of])]))
    p_text = np.searchsorted(at, passages, side="right") - 1
    out = None
    for shift in (0, 1):
        want = passages + shift
        i = np.minimum(np.searchsorted(used, want), len(used) - 1)
        ok = (used[i] == want) & (want < at[p_text + 1])
        part = sums[np.where(ok, place[i], len(place))]  # the last row is 0
        out = part if out is None else np.add(out, part, out=out)
    return p_text, (passages - at[p_text]) * STEP, out, passages, (block, term, at)


def _sequences(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in batch.column("seq").to_pylist()]


def _chunks(batch):
    seqs = _sequences(batch)
    for lo, hi in slices([len(s) for s in seqs], 400_000):
        yield lo, seqs[lo:hi]


def _to_sequences(vocabulary: dict[bytes, int]):
    """Texts as ids of benchmark words (0: another word); texts without any go."""
    def run(batches):
        get = vocabulary.get
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices([len(t) for t in texts], BYTES_AT_ONCE):
                out_id, out_seq = [], []
                for i in range(lo, hi):
                    w = words(texts[i])
                    seq = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
                    if seq.any():
                        out_id.append(ids[i])
                        out_seq.append(seq.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_seq, pa.binary())],
                                                 names=["doc_id", "seq"])
    return run


def _block_counts(n_terms: int):
    def run(batches):
        total, blocks = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for _, seqs in _chunks(batch):
                n = np.array([-(-len(s) // STEP) for s in seqs])
                at = np.concatenate([[0], np.cumsum(n)])
                block = np.concatenate([at[i] + np.arange(len(s)) // STEP for i, s in enumerate(seqs)])
                term = np.concatenate(seqs)
                some = term > 0  # slot 0 is not counted
                pair = np.sort(block[some] * n_terms + term[some])
                pair = pair[np.diff(pair, prepend=-1) != 0]
                total += np.bincount(pair % n_terms, minlength=n_terms)
                blocks += int(at[-1])
        total[0] = blocks  # slot 0 stands for no word: it carries the number of blocks
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])
    return run


def _range_product(weight: np.ndarray, sketch: np.ndarray):
    """Rows of A'(A S) by term: weight is diag(idf), sketch is S."""
    rows = (weight[:, None] * sketch).astype(np.float32)

    def run(batches):
        total = np.zeros(rows.shape)
        for batch in batches:
            for _, seqs in _chunks(batch):
                got = _block_sums(seqs, rows)
                if got is None:
                    continue
                _, _, z, passages, (block, term, at) = got
                # a block's words get the rows of both passages that hold it
                used = np.unique(block)
                padded = np.concatenate([z, np.zeros((1, z.shape[1]), np.float32)])
                both = None
                for shift in (0, 1):
                    i = np.minimum(np.searchsorted(passages, used - shift), len(passages) - 1)
                    same = np.searchsorted(at, used - shift, side="right") == np.searchsorted(at, used, side="right")
                    part = padded[np.where((passages[i] == used - shift) & same, i, len(z))]
                    both = part if both is None else np.add(both, part, out=both)
                by = np.argsort(term, kind="stable")
                first = np.flatnonzero(np.diff(term[by], prepend=-1))
                t = term[by[first]]
                sums, place = _run_sums(both, np.searchsorted(used, block[by]), first)
                total[t] += weight[t, None] * sums[place]
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))],
                                         names=["slot", "row"])
    return run


def _gram_product(weight: np.ndarray, basis: np.ndarray):
    """(A Q)'(A Q) in rows."""
    rows = (weight[:, None] * basis).astype(np.float32)

    def run(batches):
        total = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            for _, seqs in _chunks(batch):
                got = _block_sums(seqs, rows)
                if got is not None:
                    total += got[2].T @ got[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["slot", "row"])
    return run


def _summed(df: DataFrame, n: int, width: int) -> np.ndarray:
    """Sum of (slot, row) over tasks, as an n x width matrix on the driver."""
    out = np.zeros((n, width))
    parts = df.select("slot", F.posexplode("row").alias("j", "x")).groupBy("slot", "j").agg(F.sum("x").alias("x")) \
        .groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("row"))
    for r in parts.select("slot", F.col("row.x").alias("x")).toLocalIterator():
        out[r.slot] = r.x
    return out


def latent_space(seqs: DataFrame, weight: np.ndarray, items: list[np.ndarray], rank: int = RANK) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of all passages, those of
    the benchmark among them, by a randomised range finder."""
    live = int((weight != 0).sum())
    width = max(1, min(rank + OVERSAMPLE, live))
    rng = np.random.default_rng(7)
    sketch = rng.standard_normal((len(weight), width))
    bench = np.zeros((len(items), len(weight)))
    for i, s in enumerate(items):
        np.add.at(bench[i], s, weight[s])
    shape = "slot long, row array<double>"
    y = _summed(seqs.mapInArrow(_range_product(weight, sketch), shape), len(weight), width) + bench.T @ (bench @ sketch)
    basis, _ = np.linalg.qr(y)
    gram = _summed(seqs.mapInArrow(_gram_product(weight, basis), shape), width, width)
    gram += (bench @ basis).T @ (bench @ basis)
    value, vector = np.linalg.eigh(gram)
    return basis @ vector[:, np.argsort(-value)[:rank]]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _rarest_words(items: list[np.ndarray], rest: list[int], counts: np.ndarray):
    """Postings (bounds by word, item, places) of the rarest words of the items
    ``rest``, and how many of their places a text with a leak has at least: of an
    item's places at most ``missing`` may lack."""
    term, item, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    least = np.full(len(items), np.inf)
    for q in rest:
        t, m = np.unique(items[q], return_counts=True)
        order = np.argsort(counts[t], kind="stable")
        missing = len(items[q]) - math.ceil(MIN_LCS * len(items[q]) - 1e-9)
        held = np.cumsum(m[order])
        k = min(len(t), int(np.searchsorted(held, missing + LEAST_NEAR)) + 1)
        term.append(t[order[:k]])
        item.append(np.full(k, q))
        places.append(m[order[:k]])
        least[q] = held[k - 1] - missing
    term, item, places = (np.concatenate(x) for x in (term, item, places))
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(len(counts) + 1)), item[order], places[order], least


def _stretches(seqs: list[np.ndarray], postings, margin: int, n_items: int):
    """(text, item, start, end) of the stretches of passages with enough places of
    an item's rarest words within ``margin`` words, in order."""
    bounds, posted, places, least = postings
    held = np.diff(bounds)
    n_passages = np.array([max(1, -(-len(s) // STEP) - 1) for s in seqs])
    n_stretches = -(-n_passages // STRETCH)
    at = np.concatenate([[0], np.cumsum(n_stretches)])
    text = np.repeat(np.arange(len(seqs)), n_stretches)
    start = (np.arange(at[-1]) - at[text]) * (STRETCH * STEP)
    end = np.minimum(start + STRETCH * STEP, n_passages[text] * STEP) + PASSAGE - STEP
    term = np.concatenate(seqs)
    hit = np.flatnonzero(held[term])
    # places over all texts laid end to end; a stretch sees the hits of its own text
    laid = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    lo = np.searchsorted(hit, laid[text] + np.maximum(start - margin, 0))
    hi = np.searchsorted(hit, np.minimum(laid[text] + end + margin, laid[text + 1]))
    for i, j in slices((hi - lo + n_items).tolist(), CELLS_AT_ONCE):
        size = hi[i:j] - lo[i:j]
        of = np.repeat(np.arange(j - i), size)
        seen = np.arange(len(of)) + np.repeat(lo[i:j] - np.cumsum(size) + size, size)
        pair = np.sort(of * len(held) + term[hit[seen]])
        pair = pair[np.diff(pair, prepend=-1) != 0]
        of, word = np.divmod(pair, len(held))
        size = held[word]
        cell = np.repeat(of * n_items, size)
        post = np.arange(len(cell)) + np.repeat(bounds[word] - np.cumsum(size) + size, size)
        near = np.bincount(cell + posted[post], places[post], minlength=(j - i) * n_items).reshape(j - i, n_items)
        r, q = np.nonzero(near >= least)
        r += i
        yield from zip(text[r].tolist(), q.tolist(), start[r].tolist(), end[r].tolist())


def _search(weight: np.ndarray, space: np.ndarray, items: list[np.ndarray], item_ids: list, counts: np.ndarray):
    rows = (weight[:, None] * space).astype(np.float32)
    queries = _unit(np.array([rows[s].sum(0) for s in items], np.float32))
    rest = [q for q, s in enumerate(items) if (weight[s] == 0).any()]
    postings = _rarest_words(items, rest, counts)
    margin = max((len(items[q]) for q in rest), default=0)

    def run(batches):
        masks = [place_masks(s) for s in items]
        tails = [place_masks(s[-ANSWER_WORDS:]) for s in items]
        there = np.zeros(len(weight), bool)

        def shares(q, seq, start, end):
            """Shares of item q and of its answer in order around these words; none if it is no leak."""
            n = len(items[q])
            near = seq[max(0, start - n):end + n]
            there[near] = True
            bound = np.count_nonzero(there[items[q]])  # a word that isn't near can't be in the subsequence
            there[near] = False
            if bound < MIN_LCS * n:
                return None
            there[items[q]] = True
            near = near[there[near]].tolist()  # nor can a word that isn't the item's
            there[items[q]] = False
            lcs = lcs_length(masks[q], n, near) / n
            if lcs < MIN_LCS:
                return None
            m = min(n, ANSWER_WORDS)
            answer = lcs_length(tails[q], m, near) / m
            return (lcs, answer) if lcs >= SURE_LCS or answer >= MIN_ANSWER else None

        def frequent(seqs):
            """(text, item, start) of all leaks of items with words of no weight."""
            for t, q, start, end in _stretches(seqs, postings, margin, len(items)):
                if shares(q, seqs[t], start, end):  # no less than around any of its passages
                    for p in range(start, end - PASSAGE + 1, STEP):
                        if leak := shares(q, seqs[t], p, p + PASSAGE):
                            yield t, q, p, leak

        for batch in batches:
            found = []
            ids = batch.column("doc_id").to_pylist()
            for lo, seqs in _chunks(batch):
                got = _block_sums(seqs, rows)
                text, first, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(items)), np.float32)
                if got is not None:
                    text, first, z, _, _ = got
                    cosine = _unit(z) @ queries.T
                at_p, at_q = np.nonzero(cosine >= MIN_COSINE)
                for p, q, t, start in zip(at_p.tolist(), at_q.tolist(), text[at_p].tolist(), first[at_p].tolist()):
                    if leak := shares(q, seqs[t], start, start + PASSAGE):
                        found.append((ids[lo + t], item_ids[q], start, float(cosine[p, q]), *leak))
                for t, q, start, leak in frequent(seqs) if rest else ():
                    p = np.flatnonzero((text == t) & (first == start))
                    like = float(cosine[p[0], q]) if len(p) else 0.0
                    if like < MIN_COSINE:
                        found.append((ids[lo + t], item_ids[q], start, like, *leak))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 6,
                                                [pa.int64()] * 3 + [pa.float64()] * 3)],
                names=["doc_id", "item_id", "first_word", "cosine", "lcs", "answer"])
    return run


def _one_block(texts: DataFrame, rows: list) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    items, item_ids = [], []
    for r in rows:
        w = words(bytes(r.text))
        if w:
            items.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int32))
            item_ids.append(r.item_id)
    n_terms = len(vocabulary) + 1
    seqs = staged(texts.mapInArrow(_to_sequences(vocabulary), "doc_id long, seq binary"), "sequences")
    counts = np.zeros(n_terms, np.int64)
    for r in seqs.mapInArrow(_block_counts(n_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        counts[r.term] = r.df
    blocks = counts[0]
    idf = np.log((1.0 + blocks) / (1.0 + counts))
    live = counts <= max(1, MAX_BLOCK_SHARE * blocks)
    for s in items:
        terms = np.unique(s)
        live[terms[np.argsort(counts[terms], kind="stable")[:LEAST_TERMS]]] = True
    weight = np.where(live, np.maximum(idf, 1e-3), 0.0)
    weight[0] = 0.0
    space = latent_space(seqs, weight, items)
    return seqs.mapInArrow(_search(weight, space, items, item_ids, counts), RESULT)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified leaks, one row per (doc_id, item_id): place, cosine, shares of
    the item's words and of its answer (its last words) found in order.

    Texts that are null or without words can't leak and items without words
    can't be leaked: no rows. Repeated doc_ids give their best row; rows with a
    null doc_id are compared and reported under null, as one document.
    Columns beside doc_id, item_id and text are ignored."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).distinct()
    block: list = []
    parts = []
    for r in items.orderBy("item_id", "text").toLocalIterator():
        block.append(r)
        if len(block) == ITEMS_AT_ONCE:
            parts.append(_one_block(texts, block))
            block = []
    if any(words(bytes(r.text)) for r in block):
        parts.append(_one_block(texts, block))
    out = spark.createDataFrame([], RESULT) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.max(F.struct("lcs", "answer", "cosine", (-F.col("first_word")).alias("place"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.place")).alias("first_word"), F.round("b.cosine", 6).alias("cosine"),
        F.round("b.lcs", 6).alias("lcs"), F.round("b.answer", 6).alias("answer"))
