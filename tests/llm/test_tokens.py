import random
import zlib

import numpy as np
import pytest

from plumbline.llm import bpe_ids, packing
from plumbline.llm import token_counts as T

WORDS = ["the", "Tion", "été", "don't", "x=1", "12345", "日本語", "🙂🙂", "a" * 70, "foo,bar", "(word)", "<|endoftext|>", "²³", "ﬁ", "\x00", "▁", "<0x0A>"]


def texts(n=120):
    rng = random.Random(6)
    gaps = [" ", " ", " ", "  ", "\n", "\n\n ", "\t", " ", "\x1c", " \n", "    "]
    return ["".join(rng.choice(WORDS) + rng.choice(gaps) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "  a", "a  ", "word " * 20_000, "z" * 5_000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_ids.default_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(reference):
    enc = bpe_ids.Encoder(bpe_ids.default_path())
    for t in texts() + texts():
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == reference(t), t[:80]


@pytest.fixture(scope="module")
def contract():
    """The tokenizer as its file has it: special tokens in a text are found, and none are added."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_ids.default_path())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_special_tokens_in_a_text(contract):
    enc = bpe_ids.Encoder(bpe_ids.default_path(), special=True)
    some = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n y", " <|endoftext|", "<|endoftext|> <|", "don't<|endoftext|>'t"]
    for t in some + texts():
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == contract(t), t[:80]
    assert contract(some[1])[1:-1] != bpe_ids.Encoder(bpe_ids.default_path()).ids(some[1])


def test_packing_is_a_lossless_cut(spark, contract):
    reference = contract
    rows = [(k, t) for k, t in enumerate(texts(40))] + [(None, "null id"), (3, "again"), (3, "again"), (500, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    for window in (16, 1024):
        pieces = packing.pack(docs, window).collect()
        stream = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
        at = 0
        for s, o, n in stream:
            assert s * window + o == at and 0 < n and o + n <= window
            at += n
        assert at == sum(len(reference(t or "")) + 1 for _, t in rows)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.length == len(p.ids) // 4
        for d, t in rows:
            if d not in (3, None):
                mine = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == d)
                ids = np.frombuffer(b"".join(x[1] for x in mine), "<u4").tolist()
                assert ids == reference(t or "") + [0] and all(p.doc_tokens == len(ids) for p in pieces if p.doc_id == d)
                assert sum(p.opens for p in pieces if p.doc_id == d) == sum(p.closes for p in pieces if p.doc_id == d) == 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_counts_equal_a_unigram_tokenizer(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    model = sentencepiece.SentencePieceProcessor(model_file=T.default_path())
    hf = Tokenizer(models.Unigram([(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    hf.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    some = [t.replace("<0x0A>", "") for t in texts()]
    rows = [(k, t) for k, t in enumerate(some)] + [(None, "x"), (9000, None)]
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_tokens string")).collect()}
    assert got[None] == len(hf.encode("x").ids) and got[9000] == 0
    assert [got[k] for k in range(len(some))] == [len(hf.encode(t).ids) for t in some]


def test_byte_pieces_are_not_found_in_texts(spark):
    """The text <0x0A> is six characters: the pieces that stand for bytes are for characters without a piece only."""
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    model = sentencepiece.SentencePieceProcessor(model_file=T.default_path())
    plain = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size()) if not model.is_byte(k)]
    hf = Tokenizer(models.Unigram(plain, unk_id=0))
    hf.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    some = ["<0x0A>", "a <0x0A>b <0xFF> <0x41>", "<0x0A"]
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(some))] == [len(hf.encode(t).ids) for t in some]


def test_ties_and_unknown_runs():
    rng = random.Random(1)
    from tokenizers import Tokenizer, models

    for trial in range(30):
        pieces = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), float(-rng.randint(1, 3))) for _ in range(8)]
        pieces = list(dict(pieces).items())
        hf = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
        count = T.Counter(pieces, byte_fallback=False)
        for _ in range(20):
            w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert count.count(w) == len(hf.encode(w).ids), (pieces, w)
