"""Parts of the corpus operators against brute force, without Spark."""

import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rlframe.llm import bpe, chat, decontam, jaccard, packing, pii, quality, sharding, tokens, warc
from rlframe.llm.shared import word_codes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_piecewise_ids_equal_the_library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    enc = bpe.Encoder(VOCABULARY)
    rng = random.Random(1)
    texts = ["", " ", "\n", "a  b", "x's 'll", "a \n b", "ab.\ncd ef,", "é,.\n,", "a\x1c b", "日本 語, テ.", "<|endoftext|> x"]
    texts += ["".join(rng.choice(" \n.,'as1é \t日*") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_longest_repeats_equal_brute_force():
    def brute(w):
        def common(i, j):
            k = 0
            while i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            return k
        return [max((common(i, j) for j in range(len(w)) if j != i), default=0) for i in range(len(w))]

    rng = random.Random(3)
    for _ in range(40):
        docs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 40))] for _ in range(4)]
        codes, counts = word_codes(docs)
        assert quality.longest_again(codes, counts).tolist() == sum((brute(d) for d in docs), [])


def test_quality_profile_of_edge_texts():
    rep = b"one two three four five six seven eight nine ten " * 3
    p = quality.profile([b"", b"   \n", b"a b c", rep, b"x y\nx y\n\nz # $"], quality.Rules())
    assert p["n_words"].tolist() == [0, 0, 3, 30, 7]
    assert list(p["n_dup_lines"]) == [0, 0, 0, 0, 1]
    assert list(p["n_symbols"]) == [0, 0, 0, 0, 2]
    assert p["n_repeat_words"].tolist() == [0, 0, 0, 30, 0]
    assert p["base_failed"].tolist() == [True, True, True, True, True]
    assert not p["kept"].any()


def test_base_patterns_equal_plain_regular_expressions():
    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"[ -]", "", m[0])
            if 16 <= len(d) <= 19 and pii.luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        return out

    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@ -+0(%9é") for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(t) == brute(t)


def test_field_decodes_the_best_segmentation():
    field = pii.Field()
    rng = np.random.default_rng(1)
    field.follow = rng.normal(size=field.follow.shape)
    zone = "key 1234567 a-7654321"
    toks, by_end = pii.candidates(zone)
    for row in by_end:
        for _, features in row:
            for f in features:
                field.weights.setdefault(f, rng.normal(size=len(pii.KINDS)))

    def best(j, y):  # best score of tokens [0, j) whose last segment has type y
        if j == 0:
            return 0.0 if y == 0 else -np.inf
        if y == 0:
            return max(best(j - 1, p) + field.follow[p, 0] for p in range(len(pii.KINDS) + 1))
        ways = [best(i, p) + field.follow[p, y] + field.score(x)[y - 1]
                for i, x in by_end[j - 1] for p in range(len(pii.KINDS) + 1)]
        return max(ways, default=-np.inf)

    got = field.decode(zone)
    starts, ends = {a: i for i, (a, _) in enumerate(toks)}, {b: i for i, (_, b) in enumerate(toks)}
    spans = {starts[a]: (ends[b], pii.KINDS.index(k) + 1) for k, a, b in got}
    total, j, prev = 0.0, 0, 0
    while j < len(toks):
        e, y = spans.get(j, (j, 0))
        total += field.follow[prev, y]
        if y:
            total += field.score(next(x for i, x in by_end[e] if i == j))[y - 1]
        prev, j = y, e + 1
    assert total == pytest.approx(max(best(len(toks), y) for y in range(len(pii.KINDS) + 1)))


def test_field_learns_a_checksum_and_masks():
    zones = [f"card 4539578763621486 no 123456789012345{i} x@y{i}.org" for i in range(8)] * 5
    field = pii.train(zones)
    assert [s for s in field.decode(zones[0]) if s[0] == "email"]
    assert pii.masked("mail a@b.cd now", "email:5:11") == "mail [EMAIL] now"
    assert pii.masked(None, "") is None


def test_subsequence_length_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontam.lcs_length(decontam.place_masks(np.array(a)), len(a), b) == d[-1][-1]


def test_runs_reach_the_target_recall():
    assert jaccard.runs_for(0.999, 1) < jaccard.runs_for(0.999, 4) < jaccard.runs_for(0.99999, 4)


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_all_whole_records_and_logs_the_rest(compressed):
    rng = random.Random(1)
    for _ in range(25):
        payloads = [rng.randbytes(rng.randrange(0, 3000)) for _ in range(20)]
        recs = [warc.record("response", f"urn:page:{k}", "u", x, warc.digest(x), len(x), None) for k, x in enumerate(payloads)]
        recs = [warc._member(r) if compressed else r for r in recs]
        at = np.cumsum([0, *map(len, recs)])
        raw = bytearray(b"".join(recs))
        bad = set()
        for _ in range(3):
            a, n = rng.randrange(len(raw)), rng.randrange(1, 2000)
            for k in range(a, min(len(raw), a + n)):
                raw[k] = rng.randrange(256)
            bad |= {k for k in range(20) if at[k] < a + n and at[k + 1] > a}
        step = rng.choice([777, 5000, 10**9])
        got = []
        for s in range(0, len(raw), step):
            got += warc.salvage(io.BytesIO(bytes(raw)), len(raw), s, min(s + step, len(raw)), compressed)
        got.sort(key=lambda g: g[0])
        found = {int(g[2]["warc-record-id"].strip("<>").split(":")[-1]) for g in got if g[2] is not None}
        assert set(range(20)) - bad <= found
        end = 0
        for g in got:
            assert g[0] == end
            end += g[1]
        assert end == len(raw)


def test_chat_escapes_are_reversible_and_leave_no_control_string():
    f = chat.Formatter()
    rng = random.Random(1)
    parts = [*f.template.controls, "\\", "<", "[", "I", " ", "\n", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        role = rng.choice(["user", "assistant", "system", "tool", "", t])
        assert f.unescape(f.escape(t)) == t
        assert not any(m in f.escape(t) for m in f.template.controls)
        assert f.read_turn("".join(s["text"] for s in f.segments(role, t))) == (role, t)
    assert f.step("start", "assistant") == ("assistant", False)
    assert f.step("user", "assistant") == ("assistant", True)


def test_huffman_round_trip_and_lengths():
    rng = np.random.default_rng(1)
    for limit, n in ((4, 10), (12, 4000), (18, 50257)):
        counts = (rng.pareto(.6, n) * 3).astype(np.int64) + 1
        counts[:n // 7] = 0
        lengths = tokens.code_lengths(counts, limit)
        used = lengths[lengths > 0].astype(int)
        assert used.max() <= limit and sum(2.0 ** -used) == pytest.approx(1)
        assert ((lengths > 0) == (counts > 0)).all()
        ids = rng.choice(n, 5000, p=counts / counts.sum()).astype("<u4")
        bits, checks = tokens.encode_bits(ids, lengths, tokens.canonical_codes(lengths))
        assert (tokens.Decoder(lengths).decode(bits, checks, len(ids)) == ids).all()
    assert tokens.code_lengths(np.array([1, 1, 2, 3, 5, 8, 13, 21]), 8).tolist() == [7, 7, 6, 5, 4, 3, 2, 1]
    assert tokens.code_lengths(np.array([0, 9])).tolist() == [0, 1]
    assert not tokens.code_lengths(np.zeros(3, np.int64)).any()


def test_communication_matrix_has_exact_margins():
    sizes = sharding.shard_sizes(103, 7)
    m = sharding.communication_matrix(np.array([50, 0, 53]), sizes, 1)
    assert m.sum(0).tolist() == sizes.tolist() and m.sum(1).tolist() == [50, 0, 53]
    assert sizes.max() - sizes.min() <= 1


def test_packer_places_each_id_once_without_padding():
    rng = np.random.default_rng(2)
    tails = [rng.integers(0, 50, rng.integers(1, 2047)).astype("<u4") for _ in range(60)]
    p = packing.Packer(0)
    p.shard(list(range(30)), [0] * 30, tails[:30])
    p.shard(list(range(30, 60)), [0] * 30, tails[30:])
    p.finish()
    back = {i: {} for i in range(60)}
    filled: dict[int, int] = {}
    for doc, start, ids, seq, offset in p.rows:
        assert offset == filled.get(seq, 0)
        filled[seq] = offset + len(ids)
        back[doc][start] = ids
    for i, t in enumerate(tails):
        assert np.concatenate([back[i][s] for s in sorted(back[i])]).tolist() == t.tolist()
    assert all(n & (n - 1) == 0 for n in filled.values())
    assert zlib.crc32(b"") == 0


def test_bm25_prefers_the_tail_with_the_rare_tokens():
    tails = [np.array(x, "<u4") for x in ([1, 2, 3, 99, 98], [1, 2, 3, 4, 5], [1, 2, 99, 98, 7], [1, 2, 3, 8, 9])]
    assert packing.Index(tails).neighbours(tails[0]).tolist()[:2] == [0, 2]


def test_products_over_passages_equal_dense_matrices():
    rng = np.random.default_rng(3)
    n, width = 30, 4
    weight = np.where(rng.random(n) < 0.5, rng.random(n) + 0.5, 0.0)
    weight[0] = 0.0
    sketch = rng.standard_normal((n, width))
    seqs = [rng.integers(0, n, size).astype(np.int32) for size in (1, 5, 16, 17, 40, 200)] + [np.full(50, 7, np.int32)]
    dense = []
    for s in seqs:
        starts = range(0, max(1, -(-len(s) // decontam.STEP) - 1))
        for b in starts:
            row = np.bincount(s[b * decontam.STEP:b * decontam.STEP + decontam.PASSAGE], minlength=n) * weight
            dense.append(row)
    a = np.array(dense)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array([s.tobytes() for s in seqs], pa.binary())],
                                       names=["doc_id", "seq"])
    for make, want in ((decontam._range_product, a.T @ (a @ sketch)), (decontam._gram_product, (a @ sketch).T @ (a @ sketch))):
        got = np.zeros(want.shape)
        for out in make(weight, sketch)([batch]):
            for slot, row in zip(out.column("slot").to_pylist(), out.column("row").to_pylist()):
                got[slot] += row
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_zones_equal_the_union_of_extended_windows_and_are_linear():
    import time

    def plain(text):
        spans = []
        for m in re.finditer("[0-9@]", text):
            a, b = max(0, m.start() - pii.MARGIN), min(len(text), m.start() + pii.MARGIN)
            while a > 0 and not text[a].isspace() and text[a - 1] not in " \n":
                a -= 1
            while b < len(text) and text[b] not in " \n":
                b += 1
            spans.append((a, b))
        out = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    rng = random.Random(9)
    for _ in range(400):
        t = "".join(rng.choice("abcdefgh" * 12 + " \n\t1@") for _ in range(rng.randrange(0, 600)))
        assert pii.zones(t) == plain(t)
    began = time.time()
    assert pii.zones("ab1cdefg" * 625_000) == [(0, 5_000_000)]
    assert time.time() - began < 20


def test_memo_of_any_size_gives_equal_ids():
    small, large = bpe.Encoder(VOCABULARY, 3), bpe.Encoder(VOCABULARY)
    rng = random.Random(4)
    for _ in range(200):
        t = " ".join("".join(rng.choice("abcé1.\n") for _ in range(rng.randrange(1, 6))) for _ in range(30))
        assert small.encode(t) == large.encode(t)
