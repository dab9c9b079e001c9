"""SentencePiece codec, token shards: exact round trips."""

import io
import os

import numpy as np
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.llm import queries, sp_codec, token_output
from siltstone.llm.lm_scoring import tokenizer

from ..conftest import SF
from .conftest import ROWS

CODEC = sp_codec.codec()
PLAIN = sentencepiece.SentencePieceProcessor(model_file=sp_codec.MODEL)
TEXTS = ["", " ", "hello world", "  two  spaces ", "naïve café 東京", "\U0001f600 emoji\ttab\nline", "▁ mark", "é combining é", "\u0000nul", "a" * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_librarys(text):
    ids, bounds = CODEC.encode([text])[0]
    assert ids.tolist() == PLAIN.encode(text)
    assert len(bounds) == len(ids) + 1 and bounds[-1] == len(text.encode()) and (np.diff(bounds) >= 0).all()
    assert CODEC.decode(ids) == PLAIN.decode(ids.tolist())


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=80))
def test_spans_and_round_trip(text):
    ids, bounds = CODEC.encode([text])[0]
    assert ids.tolist() == PLAIN.encode(text)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])) == raw  # spans tile the text
    if "▁" not in text:
        assert CODEC.decode(ids) == text


def test_normalisation_with_a_character_map():
    """A compiled map of the library: our longest-prefix walk gives the same text, and alignment points back."""
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(norm.serialized_model_proto())
    own = object.__new__(sp_codec.Codec)
    own.map, own._user, own.user = sp_codec.CharacterMap(model.normalizer_spec.precompiled_charsmap), None, []
    spec = model.normalizer_spec
    own.prefix, own.escape, own.trim, own.suffix = spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces, False
    for text in ["ﬁne ①② Ａｂｃ", "㍿株式", "é ½ ｶﾞ", "x 　y  z ", "plain", "ﬃ" * 20, "한글 각"]:
        value, origin = own.normalize(text)
        assert value.decode() == norm.normalize(text)
        assert len(origin) == len(value) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())


def test_whole_corpus_decodes(spark):
    rows = queries.op7_sentencepiece_codec(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == PLAIN.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decodes"] == (PLAIN.decode(r["ids"]) == texts[r["doc_id"]])
    back = {r["doc_id"]: r["text"] for r in sp_codec.decode(rows).collect()}
    assert all(back[r["doc_id"]] == texts[r["doc_id"]] for r in got if r["decodes"])


def test_odd_texts(odd, none):
    got = sp_codec.encode(odd).collect()
    assert len(got) == len(ROWS) and sp_codec.encode(none).collect() == []
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[4]["ids"] is None and by[4]["bounds"] is None and by[4]["n_tokens"] == 0 and by[4]["decodes"] is None
    assert by[5]["ids"] == [] and by[5]["bounds"] == [0] and by[5]["decodes"]
    assert by[7]["decodes"] and by[7]["ids"] == by[8]["ids"]
    back = {r["doc_id"]: r["text"] for r in sp_codec.decode(sp_codec.encode(odd)).collect()}
    assert back[4] is None and back[13] == ROWS[-1][1]


# token shards


def read_all(shards):
    out = []
    for row in shards.collect():
        reader = token_output.ShardReader(bytes(row["data"]))
        assert len(reader) == row["n_docs"] and reader.doc_ids == row["doc_ids"]
        tokens = [reader.tokens(k) for k in range(len(reader))]
        assert sum(map(len, tokens)) == row["n_tokens"]
        out += list(zip(reader.doc_ids, tokens, strict=True))
    return out


def test_every_document_round_trips(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = tokenizer()
    got = read_all(queries.op6_token_output(spark, SF))
    assert sorted(i for i, _ in got) == sorted(texts)
    assert all(enc.decode(ids.tolist()) == texts[i] for i, ids in got)


def test_odd_shards(odd, none):
    got = read_all(token_output.shards(odd))
    enc = tokenizer()
    assert token_output.shards(none).collect() == []
    assert sorted((str(i), enc.decode(t.tolist())) for i, t in got) == sorted((str(r[0]), r[1] or "") for r in ROWS)


def build(docs):
    b = token_output.ShardBuilder("<u2", "t")
    for i, ids in docs:
        b.add(i, np.array(ids))
    return b.finish()


def test_only_asked_for_frames_are_read():
    data = build([(i, range(i, i + 5000)) for i in range(50)])

    class Counting(io.BytesIO):
        count = 0

        def read(self, n=-1):
            type(self).count += n
            return super().read(n)

    source = Counting(data)
    reader = token_output.ShardReader(source)
    assert reader.tokens(31).tolist() == list(range(31, 5031)) and Counting.count < len(data) / 4
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(whole) == 50 * 5000 * 2  # any zstandard reader can stream it too


def test_damage_is_noticed():
    data = build([(1, range(1000)), (None, []), (3, [7])])
    ok = token_output.ShardReader(data)
    assert ok.doc_ids == [1, None, 3] and ok.tokens(1).tolist() == [] and ok.tokens(2).tolist() == [7]
    for at in range(0, len(data), 7):
        bad = bytearray(data)
        bad[at] ^= 0x41
        try:
            r = token_output.ShardReader(bytes(bad))
            got = [r.tokens(k).tolist() for k in range(3)]
        except (token_output.CorruptShard, ValueError, KeyError, TypeError, UnicodeDecodeError):
            continue
        assert got == [list(range(1000)), [], [7]]  # a bit that no document depends on
    for cut in (0, 5, len(data) - 1):
        with pytest.raises(token_output.CorruptShard):
            token_output.ShardReader(data[:cut])


def test_shards_are_closed_and_written(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    table = token_output.shards(docs)
    token_output.write_shards(table, str(tmp_path / "out"))
    names = sorted(os.listdir(tmp_path / "out"))
    assert names == ["000000-000000.zst"]
    with open(tmp_path / "out" / names[0], "rb") as f:
        assert token_output.ShardReader(f).doc_ids == list(range(20))


def test_long_runs_of_white_space_change_nothing():
    from siltstone.llm.lm_scoring import token_ids, tokenizer

    enc = tokenizer()
    for n in (65_535, 65_536, 65_537, 200_000):
        for end in ("", "x", "\n", "\nabc", " 7 the"):
            for kind in (" ", "\n", "　", " \n", "\x1c"):
                text = "a b " + (kind * n)[:n] + end
                assert np.array_equal(token_ids(enc, text), enc.encode_to_numpy(text))
    for text in (" " * 10_000_000 + "x", "\n" * 10_000_000):  # the pattern alone gives up on these
        assert enc.decode(token_ids(enc, text).tolist()) == text
    assert len(token_ids(enc, "")) == 0


def test_every_id_comes_back():
    b = token_output.ShardBuilder("<u2", "x")
    ids = [-(1 << 63), None, 0, (1 << 63) - 1, None, 5, 6, 7, 8, 9]
    for i in ids:
        b.add(i, np.arange(3))
    assert token_output.ShardReader(b.finish()).doc_ids == ids
