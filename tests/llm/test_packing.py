import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerline.llm.packing import document_pieces, fullest, pack, pack_documents, packing_plan
from ledgerline.llm.tokens import Encoder

WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = Encoder(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return WORD.encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = ["", None, "Hello World's 3rd «été» ½ don't 'S x²", "ﬁ İstanbul ΑΣ ſ K", "á \x1c b\x85c d", "<|endoftext|> x", "日本 語 ok", " ​-–“”", "ÀÉÈ!!%% 12,3"]


def test_kept_pretokens_give_the_tokenizers_ids():
    for text in TEXTS:
        assert np.frombuffer(ENCODER.encode(text or ""), "<u4").tolist() == ids(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'stTll reve \n\r\t.!?12²ªßÉéıŉǅ“–"), st.characters(max_codepoint=0x2100, exclude_categories=("Cs",))), max_size=40))
def test_any_text_gives_the_tokenizers_ids(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)[:-1]


def check_places(rows, capacity=4096):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return places


def test_pieces_and_places(documents, prose):
    data = list(enumerate([*TEXTS, prose(9000, 1), prose(9000, 1), *[prose(random.Random(i).randrange(900), i) for i in range(60)]]))
    rows = pack_documents(documents(data, "1 AS length").selectExpr("*", "2 AS piece")).collect()
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    assert whole.keys() == {i for i, _ in data}
    for i, text in data:
        wanted = np.array(ids(text), "<u4")
        parts = sorted(whole[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        for r in parts:
            part = wanted[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
            assert r.start == 4096 * r.piece
        assert sum(r.length for r in parts) == len(wanted)
    places = check_places(rows)
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 4096) + 1


def test_ids_are_kept_on_request(documents):
    row = document_pieces(documents([(1, "Hello world")]), with_ids=True).first()
    assert row.ids == ids("Hello world")


def test_bins_are_as_full_as_can_be():
    r = random.Random(2)
    for _ in range(200):
        capacity = r.randrange(5, 60)
        counts = {n: r.randrange(1, 4) for n in r.sample(range(1, capacity + 1), r.randrange(1, min(6, capacity)))}
        used = fullest(counts, capacity)
        sums = {max(counts)}
        for n, c in counts.items():
            sums |= {s + k * n for s in sums for k in range(c + 1 - (n == max(counts))) if s + k * n <= capacity}
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(k <= counts[n] for n, k in used.items())


def test_plan_covers_every_rank_once():
    r = random.Random(3)
    counts = {n: r.randrange(1, 5000) for n in r.sample(range(1, 1500), 300)}
    plan = packing_plan(counts)
    at = 0
    for first, n, bins, k, _, _ in plan.tolist():
        assert first == at
        at += bins * k
    assert at == sum(counts.values())
    total = sum(n * c for n, c in counts.items())
    assert int((plan[:, 4] + plan[:, 2]).max()) <= total / 4096 * 1.001 + 2


def test_repeated_rows_and_other_columns(spark):
    pieces = spark.createDataFrame([(1, 4000)] * 5 + [(None, 96)] * 5 + [(2, 4096), (3, 1)], "k long, length long")
    rows = pack(pieces.selectExpr("*", "7 AS id")).collect()
    assert len(rows) == 12 and len(check_places(rows)) == 7
    assert rows[0].asDict().keys() == {"k", "length", "id", "sequence_id", "offset"}


def test_empty_table(documents):
    assert pack_documents(documents([])).collect() == []
