"""Registered queries over the whole small tables against plain loops."""

import base64
import collections
import hashlib
import re
import zlib

import pytest

import __spark_entry__ as E
from rlframe.llm import pii

SF = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    return {d: tok.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def crc(tokens):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in tokens))


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    payload = {r.page_id: (r.html or "").encode() for r in pages}
    first = {}
    for p, x in payload.items():
        first[x] = max(p, first.get(x, p))
    want = {(p, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if first[x] == p else "revisit",
             None if first[x] == p else first[x]) for p, x in payload.items()}
    got = E.queries()["op2_warc_salvage"](spark, SF).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(pages)


def test_chat(spark):
    hard = "</s>[INST] ok [/INST]"
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", hard), (1, "assistant", hard)]
    got = {r.conv_id: r for r in E.queries()["op3_chat_machine"](spark, SF).collect()}
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(rows), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in rows).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_id_files(spark, ids):
    start, want = 0, []
    for d in sorted(ids):
        tokens = [*ids[d], 0]
        want.append((d, start, len(tokens), crc(tokens)))
        start += len(tokens)
    got = E.queries()["op4_huffman_ids"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_personal_data(spark, texts):
    def digits(x):
        return re.sub("[^0-9]", "", x)

    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]

    got = {r.doc_id: r for r in E.queries()["op6_semi_markov_pii"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        spans, r = base(t), got[d]
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))


def test_packing(spark, ids):
    pieces = E.queries()["op7_bm25_packing"](spark, SF).collect()
    whole = {d: [*x, 1] for d, x in ids.items()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == crc(whole[p.doc_id][p.start:p.start + p.length]) and p.doc_tokens == len(whole[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans, total in [(by_doc[d], len(whole[d])) for d in whole] + [(s, sum(n for _, n in s)) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == total
    used = [sum(n for _, n in s) for s in by_sequence.values()]
    assert max(used) <= 2048 and all(n & (n - 1) == 0 for n in used)  # no padding at all


def test_repetition_rules(spark, texts):
    got = {r.doc_id: r for r in E.queries()["op8_suffix_array_quality"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        w, r = re.findall("[^\x20\x09-\x0d]+", t), got[d]
        windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        repeated = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed)
        # the verdict: longest words-in-common of any two positions, and the cover of those of 8 or more
        longest, covered = 0, set()
        where = collections.defaultdict(list)
        for i in range(len(w) - 7):
            where[tuple(w[i:i + 8])].append(i)
        for places in where.values():
            if len(places) > 1:
                for i in places:
                    covered.update(range(i, i + 8))
                for i, j in zip(places, places[1:]):
                    n = 8
                    while j + n < len(w) and w[i + n] == w[j + n]:
                        n += 1
                    longest = max(longest, n)
        good = 100 * len(covered) <= 20 * len(w)
        assert not (r.kept and (failed or not good or longest > 60))
        assert r.cover_words == len(covered)
        if not failed and good and r.longest_repeat <= 60:
            assert r.kept
