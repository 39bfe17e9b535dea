import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerline.llm.alignment import ByteLevelSide, Chunks, PieceSide, _packed, aligned_documents, merged_pairs
from ledgerline.llm.queries import QUERIES

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
FIRST, SECOND = ByteLevelSide(A_PATH), PieceSide(B_PATH)
CHUNKS = Chunks(FIRST, SECOND)


def whole_groups(text):
    """Groups from one encoding of the whole text, or None."""
    if not text:
        return None
    data = (" " + text).encode()
    ids = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    pieces = [FIRST.bytes[i] for i in ids[0]], [SECOND.bytes[i] for i in ids[1]]
    if any(b"".join(p) != data for p in pieces):
        return None
    groups, held, at = [], ([], []), [0, 0]
    queues = [list(zip(i, p)) for i, p in zip(ids, pieces)]
    while queues[0] or queues[1]:
        side = 0 if at[0] <= at[1] else 1
        i, piece = queues[side].pop(0)
        held[side].append(i)
        at[side] += len(piece)
        if at[0] == at[1]:
            groups.append(held)
            held = ([], [])
    return groups


def expected(texts):
    found = [whole_groups(t) for t in texts]
    links = [Counter((a, b) for g in f or [] for a in g[0] for b in g[1]) for f in found]
    counts = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for f, own in zip(found, links):
        yield (
            sum(len(g[0]) for g in f or []),
            sum(len(g[1]) for g in f or []),
            len(f or []),
            sum(own.values()),
            ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in f or []),
            sum(n for pair, n in own.items() if counts[pair] == best[pair[0]]),
            sum(n * counts[pair] for pair, n in own.items()),
        )


TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab the'st \n\t .,12▁éß“😀 　\x00\x1c"), st.characters(exclude_categories=("Cs",))), max_size=40)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_chunks_are_encoded_as_the_whole_text_is(text):
    chunk, bounds = CHUNKS.of([text] if text else [])
    names = [CHUNKS.groups[c] for c in chunk]
    own = None if None in names or not text else ";".join(names)
    groups = whole_groups(text)
    assert own == (None if groups is None else ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups))


TEXTS = [
    None, "", " ", "\n", "the the cat", "the the cat", "  two  blanks ", "<|endoftext|> <s> </s> <unk>", "a▁b", "é😀 日本 x", " x 　y",
    "word " * 3000, "x" * 3000, "The cat, the dog and the mouse.", "the mouse", "\x00 a\x1c b", "don't we'll 12 345 6.7",
]


def check(documents, **sizes):
    docs = documents([*enumerate(TEXTS), (None, TEXTS[4])], "1 AS run").selectExpr("*", "'x' AS radix")
    names = "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"
    found = {r.doc_id: tuple(r[c] for c in names) for r in aligned_documents(docs, **sizes).collect()}
    wanted = list(expected([*TEXTS, TEXTS[4]]))
    assert found == dict(zip([*range(len(TEXTS)), None], wanted))


def test_counts_over_all_documents(documents):
    check(documents)


def test_several_passes_and_sections(documents):
    check(documents, radix=3, fan_in=2, section_bytes=40)


def test_no_rows(documents):
    assert aligned_documents(documents([])).collect() == []
    assert aligned_documents(documents([(1, None), (2, "")])).count() == 2


def test_merge_by_heap():
    import numpy as np

    key = lambda a, b: a << 16 | b
    runs = [
        _packed(np.array([key(1, 1), key(1, 4), key(7, 2)]), np.array([1, 2, 3])),
        _packed(np.array([key(1, 4), key(3, 1)]), np.array([5, 1])),
        _packed(np.zeros(0), np.zeros(0)),
        _packed(np.array([key(7, 1)]), np.array([9])),
    ]
    found = [(a, (p & 0xFFFF).tolist(), c.tolist()) for a, p, c in merged_pairs(runs)]
    assert found == [(1, [1, 4], [1, 7]), (3, [1], [1]), (7, [1, 2], [9, 3])]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, folder).collect()}
    for row, (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) in zip(rows, expected([r.text for r in rows])):
        r = found[row.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
