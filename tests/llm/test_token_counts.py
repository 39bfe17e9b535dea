import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerline.llm.token_counts import attribute, section_token_counts
from ledgerline.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
BYTE = Tokenizer.from_file(PATH)
BYTE.encode_special_tokens = True
ENCODER = Encoder(PATH, special_is_text=True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'stTll reve \n\r\t.!?12²ªßÉé“–"), st.characters(max_codepoint=0x2100, exclude_categories=("Cs",))), max_size=40))
def test_spans_are_those_of_the_whole_text(text):
    starts, ends = ENCODER.token_spans(text)
    assert list(zip(starts.tolist(), ends.tolist())) == BYTE.encode(text, add_special_tokens=False).offsets


def brute_force(text, rule):
    ends = [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)] + [len(text)]
    sections = list(zip([0, *ends[:-1]], ends))
    counts = [0.0] * len(sections)
    for s, e in BYTE.encode(text, add_special_tokens=False).offsets:
        inside = [max(0, min(e, z) - max(s, a)) for a, z in sections]
        at = next((i for i, (a, z) in enumerate(sections) if a <= s < z), len(sections) - 1)
        if rule == "start" or not sum(inside):
            counts[at] += 1
        elif rule == "majority":
            counts[inside.index(max(inside))] += 1
        else:
            counts = [c + x / sum(inside) for c, x in zip(counts, inside)]
    return counts


def test_sections(documents, prose):
    texts = ["", None, "\n", "a\n\n\n\nb\n", "one two\nthree  \n four", "é😀\n日本\n", "x" * 3000 + "\n" * 50 + "y", prose(300, 1).replace("w1", "\nw1")]
    docs = documents([*enumerate(texts), (None, "a\nb"), (4, texts[4])], "9 AS section")
    found = section_token_counts(docs).orderBy("doc_id", "section").collect()
    for i, text in enumerate(texts):
        own = [r for r in found if r.doc_id == i]
        text = text or ""
        if i == 4:
            own = own[::2]
        assert [r.section for r in own] == list(range(len(own)))
        assert "".join(text[r.start : r.end] for r in own) == text
        for rule in ("start", "majority", "share"):
            assert [r[f"n_{rule}"] for r in own] == pytest.approx(brute_force(text, rule))
        total = len(BYTE.encode(text, add_special_tokens=False).ids)
        assert {r.n_document for r in own} == {total}
        assert sum(r.n_start for r in own) == sum(r.n_majority for r in own) == total
    assert len([r for r in found if r.doc_id is None]) == 2


def test_crossing_tokens_follow_the_rule():
    starts, ends, bounds = np.array([0, 2, 8]), np.array([2, 8, 9]), np.array([3, 4, 9])
    by_start, majority, share = attribute(starts, ends, bounds)
    assert by_start.tolist() == [2, 0, 1]
    assert majority.tolist() == [1, 0, 2]
    assert share.tolist() == pytest.approx([1 + 1 / 6, 1 / 6, 1 + 4 / 6])


def test_empty_table(documents):
    assert section_token_counts(documents([])).collect() == []
