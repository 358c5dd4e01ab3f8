import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import token_counts as t

PATH = public_tokenizers.path("word_bpe_49k.json")
COUNTER, LIBRARY = t.MergeCounter(PATH), Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from("aeinrst'. \n\t\x1c\x85 ΣσİéÉ́0½²㍿<|>")), max_size=60))
def test_equals_the_library(text):
    assert COUNTER.count(text) == library(text)


@pytest.mark.parametrize("text", ["", " ", "it's we'll I'D", "<|endoftext|>a<|startoftext|><|endoftext|>", "x" * 5000, "é" * 300, "word " * 300_000, "ΑΣ ΑΣΑ", "a\x1cb"])
def test_edges(text):
    assert COUNTER.count(text) == library(text)


def test_bounded_memory(monkeypatch):
    monkeypatch.setattr(t, "REMEMBER", 3)
    small = t.MergeCounter(PATH)
    assert small.count("one two three four five six seven one two") == library("one two three four five six seven one two")
    assert len(small.seen) <= 3


def test_rows(docs_of):
    rows = docs_of([(1, None), (2, ""), (3, "Ünï code"), (None, "a"), (3, "Ünï code")]).withColumnRenamed("lang", "n_tokens")
    got = sorted((tuple(r) for r in t.token_counts(rows, PATH, limit=1).collect()), key=str)
    n = library("Ünï code")
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 10, n, True), (None, 1, 1, False), (3, 10, n, True)], key=str)


def test_other_special_tokens(tmp_path):
    """Special strings that start with another sign are found; those with rules of their own are refused."""
    import json

    spec = json.loads(open(PATH).read())
    n = max(spec["model"]["vocab"].values())
    spec["added_tokens"].append(spec["added_tokens"][0] | {"content": "[CLS]", "id": n + 7})
    (tmp_path / "a.json").write_text(json.dumps(spec))
    text = "a [CLS]b <|endoftext|> [cls] [CLS][CLS]"
    assert t.MergeCounter(str(tmp_path / "a.json")).count(text) == len(Tokenizer.from_file(str(tmp_path / "a.json")).encode(text, add_special_tokens=False).ids)
    spec["added_tokens"][-1]["lstrip"] = True
    (tmp_path / "b.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="CLS"):
        t.MergeCounter(str(tmp_path / "b.json"))
