"""The byte-level encoder against the library, code point by code point."""

import sys

from fixtures import texts

from sightline.llm import byte_bpe


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.default_path())


def test_all_code_points():
    bpe, lib = byte_bpe.load(byte_bpe.default_path()), library()
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)} {chr(c)}b" for c in points[at : at + 4096])
        assert bpe.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_texts_and_special_strings():
    bpe, lib = byte_bpe.load(byte_bpe.default_path()), library()
    for text in [*texts(), "a<|endoftext|>b", "it's I'LL", "   \n\n x\t\t", "<|endoftext|>"]:
        want = lib.encode(text, add_special_tokens=False).ids if text else []
        assert bpe.encode(text) == want and bpe.count(text) == len(want)


def test_long_texts_are_cut_where_the_pattern_begins(monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 7)
    bpe, lib = byte_bpe.load(byte_bpe.default_path()), library()
    for text in ["word  and\n\nmore " * 20, "a\x1cb \x1f c\x85d\xa0e   f" * 9, " " * 50 + "b", "x" * 99, "it's  we'll\t\tgo<|endoftext|> on" * 5]:
        assert bpe.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_runs_that_the_fast_encoder_refuses():
    bpe = byte_bpe.load(byte_bpe.default_path())
    assert len(bpe.encode(" " * 3_000_000 + "b")) > 0
