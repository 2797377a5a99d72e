"""Ids against the library, untouched, and tokenizer files of other kinds."""

import json

import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = packing.WordTokenizer(PATH)
PARTS = ["hello", " ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "é", "\n", "İ", "a<|endoftext|>b", "endoftext", "x1", "'s"]


@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_added_tokens(text):
    ids, counts = WORDS.texts(pa.array([text, "<|endoftext|>", text]))
    wanted = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids[: counts[0]].tolist() == wanted == ids[counts[0] + counts[1] :].tolist()
    assert ids[counts[0]] == 49407


def test_added_tokens_as_text():
    plain = packing.WordTokenizer(PATH, special_as_text=True)
    assert 49407 not in plain.texts(pa.array(["a <|endoftext|> b"]))[0].tolist()
    assert 49407 in WORDS.texts(pa.array(["a <|endoftext|> b"]))[0].tolist()


@pytest.mark.parametrize("change", ["upper", "byte", "added"])
def test_other_files_are_encoded_whole(tmp_path, change):
    with open(PATH) as file:
        spec = json.load(file)
    if change == "upper":
        spec["normalizer"] = None
    elif change == "added":
        spec["added_tokens"][0] |= {"lstrip": True}
    path = str(tmp_path / "t.json")
    with open(path, "w") as file:
        json.dump(spec, file)
    if change == "byte":
        path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = packing.WordTokenizer(path), Tokenizer.from_file(path)
    assert WORDS.by_chunks and not own.by_chunks
    texts = ["Hello  World <|startoftext|> it's\n", "", "ABC abc"]
    ids, counts = own.texts(pa.array(texts))
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(wanted, []) and counts.tolist() == [len(w) for w in wanted]
