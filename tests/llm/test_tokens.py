"""Byte-pair encoding, the token store and chat formatting: against the library, and as round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, chat, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a <|endoftext|> b<|endoftext|>", "aaaaaaaaaaaaa  \n\n x", "   x ½²三 ñ́ \x1c\x1f\x85z", "🎉👩‍👩‍👧 don't we'll I'M", "x" * 3000, "abc" * 2000, "​﻿  \r\n\t t é²½¼ñ\xa0\xa0x \xb7\xd7", "'s 's'S  'tis", "\u3000 \u3000a"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary.load(PATH))


def memo():
    with open(PATH, encoding="utf-8") as f:
        return token_store._memo("a", f.read())


def test_ids_are_the_librarys(library, codec):
    want = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert [x.tolist() for x in codec.encode(ODD)] == want
    ids, counts = memo().encode(ODD, 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*x, 2] for x in want]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text_goes_round(library, codec, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = codec.encode([text])[0]
    assert codec.decode(ids) == text
    if text.isascii():
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_to_replacement_characters(library, codec):
    for ids in ([447], [447, 220, 447], [50256, 447]):
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_frames(spark, odd, none):
    encoded = bpe.encode(odd, PATH)
    back = bpe.decode(encoded, PATH).collect()
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in back) == sorted(((r["doc_id"] or -1), r["text"] or "") for r in odd.collect())
    rows = bpe.digest(odd, PATH).collect()
    assert len(rows) == 16 and all(r["decoded_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] in (4, 5))
    assert bpe.encode(none, PATH).count() == bpe.digest(none, PATH).count() == 0


def test_store(spark, odd, none, library, tmp_path):
    token_store.write(odd, PATH, f"{tmp_path}/s")
    rows = token_store.read(spark, f"{tmp_path}/s").orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:]) and len(ids) == 16
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == token_store.END
        at += r["n_tokens"]
    want = sorted((r["doc_id"] or -1, tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in rows) == want
    assert token_store.metadata(spark, f"{tmp_path}/s").columns == ["doc_id", "start", "n_tokens"]
    some = token_store.documents(spark, f"{tmp_path}/s", [7, 9, 12345])
    assert sorted(some.collect()) == sorted(r for r in rows if r["doc_id"] in (7, 9))
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert token_store.documents(spark, f"{tmp_path}/s", []).count() == token_store.documents(spark, f"{tmp_path}/s", [99999]).count() == 0
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_store.read(spark, f"{tmp_path}/s", token_store._crc, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()}
    assert all(crc[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert token_store.digest(none, PATH).count() == 0


def test_store_format(spark, odd, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_store.write(odd, PATH, f"{tmp_path}/s")
    for f in glob.glob(f"{tmp_path}/s/data/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        by = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in by["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in by["start"].encodings
        assert by["doc_id"].has_offset_index and by["doc_id"].has_column_index


# --- chat ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"\\#</turn>: \nab", "### ", "</turn>", ":\n"]), max_size=40).map("".join))
def test_escaping_goes_round_and_hides_control_strings(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)


def render(template, **scope):
    w = chat.Writer()
    for _ in chat.compile_template(template)(scope, w):
        pass
    return w.taken()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\nb", "", ":"]), st.text(alphabet="\\#</turn>: \nab", max_size=20)), max_size=5))
def test_turns_are_read_back(turns):
    text, starts, ends = render(chat.TEMPLATE, messages=iter([{"role": r, "text": t} for r, t in turns]))
    assert list(chat.turns_of(text)) == turns
    assert [chat.unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)] == [t for r, t in turns if r == "assistant"]


def test_language():
    assert render("{% for x in xs %}{% if loop.first %}[{% elif x == 'b' %}B{% else %}{{ x | upper }}{% endif %}{% endfor %}]", xs=["a", "b", "c"])[0] == "[BC]"
    assert render("{# no #}{% set a = 'x' ~ 1 %}{{ a }}{{ 'q' in 'pqr' and not false }}{{ m.k }}{{ m.none }}", m={"k": 2})[0] == "x1True2"
    assert render("a{% generation %}b{{ t }}{% endgeneration %}c", t="xy") == ("abxyc", [1], [4])


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' ~ ('c' | upper) }}{% if 1 == 2 %}x{% elif true %}d{% else %}y{% endif %}{{ v }}"))
    assert tree == [chat.Output(chat.Const("abCd")), chat.Output(chat.Name("v"))]


@pytest.mark.parametrize("bad", ["{{ a.__class__ }}", "{{ f() }}", "{{ x | nope }}", "{% if a %}", "{% endfor %}", "{% import os %}", "{{ a b }}", "{% else %}", "{{ 'open }}"])
def test_what_is_not_allowed(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo ### x</turn>"), (2, None, None, None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "user", "n"), (3, 5, "assistant", "long " * 5000), (3, 6, "user", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    for piece in (chat.PIECE, 1000):
        formatted = chat.render(df, piece=piece)
        assert (formatted.filter("conv_id = 3").count() > 1) == (piece == 1000)
        got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
        digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[1]["turns_sha256"] == digest([("user", "hi"), ("assistant", "yo ### x</turn>")])
        assert got[2]["turns_sha256"] == digest([("assistant", "a"), ("assistant", "a"), ("", "")]) and got[2]["loss_chars"] == 2
        assert got[None]["n_turns"] == 1 and got[3]["loss_sha256"] == hashlib.sha256(("long " * 5000).encode()).hexdigest()
    own = {r["conv_id"]: r for r in chat.digest(df.limit(0)).collect()}
    assert set(own) == {-7} and own[-7]["loss_sha256"] == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()


def test_a_full_memory_keeps_what_is_met_often(codec, library, monkeypatch):
    from quire.llm import pretokens

    monkeypatch.setattr(pretokens, "MEMO", 50)
    own = bpe.Codec(codec.v)
    for k in range(8):
        texts = [f"the same words {k} and <|endoftext|> new{i + 100 * k}" for i in range(30)]
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(own.memo.young) <= 50 + 1 + 60 and len(own.memo.young.old) <= 50 + 1 + 60  # a generation and a batch's new ones
    assert " words" in own.memo.young and " new1" not in own.memo.young | own.memo.young.old


def test_long_texts_are_split_in_stretches(codec, library, monkeypatch):
    from quire.llm import pretokens

    text = "Some words,  and  \n more\n\n x 's it's \t  \u3000 a  b\xa0 c 12 3.4 ünï 文字文字 end " * 60
    monkeypatch.setattr(pretokens, "STRETCH", 7)
    assert "".join(pretokens.stretches(text)) == text and len(list(pretokens.stretches(text))) > 100
    assert codec.encode([text, text[5:]])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert [w for s in pretokens.stretches(text) for w in pretokens.split(s)] == pretokens.split(text)


@pytest.mark.parametrize("long", [bpe.LONG, 3])
def test_long_unbroken_words(codec, library, monkeypatch, long):
    """Merged by themselves, with overlapping runs; all words where long is small."""
    monkeypatch.setattr(bpe, "LONG", long)
    rng = np.random.default_rng(4)
    texts = ["a" * 5001, "ab" * 3000 + "a", "".join(rng.choice(list("etaoinsh"), 6000)), "".join(rng.choice(list("aab"), 4500)), "x", "", "zz zz", "aaa aaaa aaaaa"]
    words = [w for t in texts for w in t.split(" ")]
    assert [x.tolist() for x in codec.merge_words(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_cost_of_a_long_word_grows_with_its_length(codec):
    import time

    rng, took = np.random.default_rng(5), []
    for n in (50_000, 400_000):
        word = "".join(rng.choice(list("etaoinshrdlu"), n))
        began = time.process_time()
        ids = codec.merge_words([word])[0]
        took.append(time.process_time() - began)
        assert codec.decode(ids) == word
    assert took[1] < 20 * took[0] + 1
