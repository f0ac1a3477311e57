"""Token files: whole-text encoding, order, exact round trip and file layout."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import AddedToken, Tokenizer

from motionframe.llm import tokens
from motionframe.llm.words import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = tokens.PieceEncoder(PATH)
ODD = ["", " ", "  a  b", "a\n b", "a \nb", "don't 'll stop  ", "x<|endoftext|>y z", " a   b", "　 x y  z",
       "\x1c a\x1d b c", "tab\t x", "it's é'S", "​ a ​a\u0085 b", "a ᠎ b", "1 2  3 ...!? ", "\U0001f600 \U0001f600x  "]


def encoded(encoder, texts):
    offsets, ids = encoder.encode(*text_bytes(pa.array(texts, pa.string())), 0)
    assert all(ids[b - 1] == 0 for b in offsets[1:])
    return [ids[a:b - 1].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_pieces_equal_whole_texts():
    plain, own = Tokenizer.from_file(PATH), tokens.PieceEncoder(PATH, most=5)
    for texts in (ODD, ODD[::-1], ["", ""], [], ODD * 2):
        assert encoded(own, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.text("ab A1,.'!_-\n\t\u3000é\x1c\u200b", max_size=25), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_texts(texts):
    assert encoded(OWN, texts) == [OWN.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


ADDED = ["junk <|endoftext|>", "junk<|endoftext|> x", "a <|endoftext|>\n", "<|endoftext|>", " <|endoftext|>", "a <|endoftext|>. b",
         "x<|endoftext|><|endoftext|> y", "<|endoftext|", "|> <|endof text|>", "", "a b", "junk <|endoftext|>"]


def test_added_tokens_are_never_cut():
    plain, own = Tokenizer.from_file(PATH), tokens.PieceEncoder(PATH)
    for texts in (ADDED, ADDED[::-1], ADDED[:1]):
        assert encoded(own, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "a", "é", " ", "\n", ".", "'s", "7"]), max_size=9)
                .map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_texts_with_added_tokens(texts):
    assert encoded(OWN, texts) == [OWN.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_of_other_files(tmp_path):
    plain = Tokenizer.from_file(PATH)
    plain.add_tokens([AddedToken("x y"), AddedToken("｜é｜", rstrip=True), AddedToken("Z", lstrip=True, single_word=True)])
    path = str(tmp_path / "more.json")
    plain.save(path)
    own, texts = tokens.PieceEncoder(path), ["a x", " y b", "a x y b", "q ｜é｜ z", " ｜é｜", " b c", "aZ Z.", "a Z z"]
    assert encoded(own, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("which", ["awkward", "odd"])
def test_round_trip(spark, make, awkward, tmp_path, which):
    df = awkward if which == "awkward" else make(ODD)
    plain = Tokenizer.from_file(PATH)
    got = tokens.token_ids(df, PATH, str(tmp_path / "ids")).orderBy("start").collect()
    rows = [(r.run_id, r.notes or "") for r in df.select("run_id", "notes").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1].encode())))
    start = 0
    assert len(got) == len(rows)
    for g, (k, t) in zip(got, rows):
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        assert tuple(g) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    index = tokens.read_token_index(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [tuple(r) for r in index] == [tuple(g)[:3] for g in got]


def test_file_layout(spark, awkward, tmp_path):
    tokens.write_token_ids(awkward, str(tmp_path / "ids"), PATH)
    for f in glob.glob(str(tmp_path / "ids" / "*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if column.path_in_schema.startswith("ids"):
                    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
                assert column.has_offset_index and column.has_column_index


def test_empty_table(spark, make, tmp_path):
    assert tokens.token_ids(make([]), PATH, str(tmp_path / "ids")).count() == 0
