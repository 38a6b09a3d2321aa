import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paneloom.llm import tokens as K

PATH = K.default_path()
ODD = ["", " ", "\r\n\t", "<|endoftext|> x", "naïve café", "漢字 かな ｆｕｌｌ　width", "👩‍💻 ok", "a​b\x00c", "don't we'll it's", "x" * 5000, " \n \n  end  ", "1,234.5 25 % v2_0", "日本語メモ" * 50]


def plain(text):
    return K.load(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert K.encode_texts([text], PATH) == [plain(text)]
    assert K.decode_ids(plain(text), PATH) == text


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_equals_library_and_comes_back(text):
    ids = K.encode_texts([text], PATH)[0]
    assert ids == plain(text) and K.decode_ids(ids, PATH) == text


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Zed", "'s", "'re", "12", "3", ",", "...", "中", "文字", "。", "（", "!?", "_"]), max_size=25))
@settings(max_examples=400, deadline=None)
def test_plain_path_equals_library(parts):
    text = "".join(parts)
    assert K.encode_texts([text], PATH) == [plain(text)]


def library(name, texts):
    import base64

    import public_tokenizers as P

    if name.endswith(".json"):
        return [plain(t) if name == "byte_bpe_50k.json" else K.load(P.path(name)).encode(t, add_special_tokens=False).ids for t in texts]
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"])
def test_every_public_tokenizer(name):
    texts = [*ODD, "IT'S a Test\n\n  indent", "price 12345 up"]
    got = K.encode_texts([*texts, None], K.default_path(name))
    assert got == [*(x if t else [] for t, x in zip(texts, library(name, texts))), []]
    if name.endswith(".tiktoken") or name.startswith("byte"):
        assert [K.decode_ids(x, K.default_path(name)) for x in got[:-1]] == texts
    assert K.decode_ids(got[-2], K.default_path(name)).split()[0].startswith("price")


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 2000)
    K._remembered.cache_clear()
    words = [f"word{i} " * 3 + "漢" * 200 for i in range(100)]
    assert K.encode_texts(words, PATH) == [plain(w) for w in words]
    known = K._remembered(PATH)
    assert len(known) < 20 and max(map(len, known)) <= K.LONGEST
    K._remembered.cache_clear()


def test_cut_lists_and_bytes():
    ids = plain("漢")
    assert K.decode_ids(ids[:-1], PATH).endswith("�") and len(K.byte_characters()) == 256
    assert K.decode_ids(None, PATH) == ""


def test_frames(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([*ODD, None]), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["tok"] for r in K.encoded(df, "text", ["doc_id"], ids="tok").collect()}
    assert got == {i: plain(t) if t else [] for i, t, _ in rows}
    spans = {r["doc_id"]: r for r in K.encoded_with_offsets(df, "text", ["doc_id"]).collect()}
    for i, t, _ in rows:
        r = spans[i]
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"]) and (not t or r["ends"][-1] == len(t))
    back = {r["doc_id"]: r["text"] for r in K.decoded(K.encoded(df, "text", ["doc_id"]), "ids", ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert K.encoded(df.limit(0), "text", ["doc_id"]).count() == 0
