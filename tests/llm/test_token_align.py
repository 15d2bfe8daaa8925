"""Alignment of two tokenizers against both libraries and a plain version of links and counts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathfold.llm import queries, token_align
from pathfold.llm.queries import tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    bpe, pieces = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bpe.encode_special_tokens = True
    alphabet = token_align.byte_alphabet()
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a, b = bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        ab = [bytes(alphabet[c] for c in bpe.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
        if not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            docs.append(None)
            continue
        links, groups, i, j, end_a, end_b, ga, gb = [], [], 0, 0, len(ab[0]), len(bb[0]), [a[0]], [b[0]]
        while True:
            links.append((a[i], b[j]))
            last_a, last_b = end_a, end_b
            if last_a == last_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
            if last_a <= last_b:
                i += 1
                if i < len(a):
                    end_a += len(ab[i])
                    ga.append(a[i])
            if last_b <= last_a:
                j += 1
                if j < len(b):
                    end_b += len(bb[j])
                    gb.append(b[j])
            if i == len(a) or j == len(b):
                assert i == len(a) and j == len(b)
                break
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for d in docs if d for p in set(d[3]))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


def texts():
    r = random.Random(4)
    some = ["the", "Übergröße", "naïve", "12345", "foo_bar", "日本語", "😀", "\n", "  ", "\t", "x" * 50, "don't", "<|endoftext|>", "<s>", "<0x41>", "end.", "\x00", "é", "Ångström", "https://a.b/c?d=e"]
    return [None, "", " ", "a", "▁", "has ▁ in it", "<|endoftext|>", "\x00", "the " * 3000, *[" ".join(r.choices(some, k=r.randrange(1, 60))) for _ in range(80)], "same words again", "same words again"]


def rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.mark.parametrize("small", [False, True])
def test_against_the_libraries(spark, monkeypatch, small):
    if small:  # several salts of a stripe
        monkeypatch.setattr(token_align, "SALT_BYTES", 200)
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    got = rows(token_align.align(df, BPE, PIECES))
    assert [got[i] for i in range(len(given))] == plain(given)


def test_groups_repeats_null_ids_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "two words"), (None, None)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("batch", "i", "stripe", "salt", "pairs", "size")})
    got = token_align.align(df, BPE, PIECES, texts=True).orderBy("n_a", "doc_id").collect()
    want = plain(["two words"] * 3)[0]
    assert [r.doc_id for r in got] == [None, None, 1, 1] and [(r.n_a, r.n_best, r.count_sum) for r in got] == [(0, 0, 0)] + [(want[0], want[4], want[5])] * 3
    assert hashlib.sha256(got[-1].groups.encode()).hexdigest() == want[6] and got[0].groups == ""
    assert token_align.align(df.where("false"), BPE, PIECES).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = rows(queries.QUERIES["op12_token_align"](spark, sf))
    assert [got[d.doc_id] for d in docs] == plain([d.text for d in docs])
