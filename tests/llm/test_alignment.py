"""Alignment of two tokenizers against a plain version by byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ephemera.llm import alignment
from ephemera.llm.alignment import ByteLevel, Pieces, align_tokens, link_counts
from ephemera.llm.queries import op12_cross_tokenizer_alignment, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
WORDS = ["the", "Über", "naïve", "x1,", "internationalisation", "日本語", "don't", "<|endoftext|>", "<s>", "\n", "  ", "\t", "🙂", "9807", "a.b-c"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


TEXTS = [
    "the and attion to", "", None, " ", "   ", "\n", "one  two   three ", "a▁b", "▁", "<0x41> <unk> <s> </s>", "<|endoftext|>", "日本語 テキスト", "🙂🙂‍", "\x00\x01 null", "é ﬁ   x",
    prose(60, 1), prose(400, 2), prose(400, 2), "x" * 3000, " " * 500, "ab " * 700, "\r\n\r\n\t\t  tail", "� replaced",
]


def plain(rows):
    """Per row: n_a, n_b, groups text and the linked id pairs, by comparing byte ends."""
    tokenizer, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    letter = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    out = []
    for _, text in rows:
        ids_a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = pieces.encode(text) if text else []
        raw_a = [bytes(letter[c] for c in tokenizer.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append((0, 0, "", []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            x, y = end_a.index(cut), end_b.index(cut)
            groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
            links.append((ids_a[x], ids_b[y]))
            i, j = x + 1, y + 1
        out.append((len(ids_a), len(ids_b), ";".join(groups), links))
    return out


def plain_counts(found):
    count = Counter(p for *_, links in found for p in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)) for *_, links in found]


@pytest.mark.parametrize(("chunk", "head"), [(7, 5), (1 << 20, 10**6), (64, 1)])
def test_against_byte_ranges(spark, monkeypatch, chunk, head):
    monkeypatch.setattr(alignment.overlaps, "__defaults__", (chunk,))
    monkeypatch.setattr(alignment, "FLUSH_BYTES", 2000)
    rows = list(enumerate(TEXTS)) + [(16, TEXTS[16]), (None, TEXTS[0])]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, N_A int, link_a string").repartition(3)
    aligned = align_tokens(docs, A, B)
    assert aligned.columns == ["doc_id", "N_A", "link_a", "n_a_", "n_b", "n_groups", "groups", "link_a_", "link_b"]
    counted = link_counts(aligned, "link_a_", "link_b", head=head)
    assert counted.columns == ["doc_id", "N_A", "link_a", "n_a_", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    found = plain(rows)
    want = [(i, a, b, len(links), groups, *sums) for (i, _), (a, b, groups, links), sums in zip(rows, found, plain_counts(found), strict=True)]
    got = [(r.doc_id, r.n_a_, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum) for r in counted.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    zeros = {i for i, a, *_ in want if a == 0}
    assert {1, 2, 7, 8} <= zeros and not {0, 4, 10, 12, 18, 19} & zeros


def test_units_and_libraries_agree(monkeypatch):
    r = random.Random(9)
    kinds = ["".join(map(chr, range(1, 0x250))), "ab c\n\t '’—…€0½²ª\x85\x1c\u2028", "日本🙂é ́ا٣ǅⅷ 　x "]
    texts = [b" " + prose(300, k).encode() + b" " * (k % 4) for k in range(30)] + [b" " * 90, b" a" * 60, b" " + b"y" * 200, b" "]
    texts += [(" " + "".join(r.choice(k) for _ in range(r.randrange(1, 60)))).encode() for k in kinds for _ in range(1500)]
    tokenizer, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    monkeypatch.setattr(Pieces, "limit", 500)
    a, b = ByteLevel(A), Pieces(B)
    assert a.fast is not None and b.by_unit
    for at in range(0, len(texts), 40):
        own = texts[at : at + 40]
        ids, counts = a.ids(own)
        want = [tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in own]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        ids, counts = b.ids(own)
        want = [pieces.encode(t[1:].decode()) or [b.blank] for t in own]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert link_counts(align_tokens(docs, A, B)).collect() == []
    only = link_counts(align_tokens(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), A, B)).collect()
    assert sorted((r.doc_id, r.n_a, r.groups, r.n_links, r.n_best, r.count_sum) for r in only) == [(1, 0, "", 0, 0, 0), (2, 0, "", 0, 0, 0), (2, 0, "", 0, 0, 0)]


def test_either_side_may_be_any_tokenizer(spark):
    docs = spark.createDataFrame([(1, prose(50, 3))], "doc_id long, text string")
    (one,), (other,) = (align_tokens(docs, *pair).collect() for pair in ((A, B), (B, A)))
    assert (one.n_a, one.n_b, one.link_a, one.link_b) == (other.n_b, other.n_a, other.link_b, other.link_a)
    (same,) = align_tokens(docs, A, A).collect()
    assert same.n_groups == same.n_a == same.n_b


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = plain(rows)
    want = [(i, a, b, len(links), *sums, hashlib.sha256(g.encode()).hexdigest() if g else "") for (i, _), (a, b, g, links), sums in zip(rows, found, plain_counts(found), strict=True)]
    got = op12_cross_tokenizer_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if c != "groups_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(w[3] for w in want) > 10_000
