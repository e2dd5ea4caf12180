"""Operator 11 against the tokenizers' own libraries and plain sets of byte offsets."""

import hashlib
from collections import Counter

import pytest

from quire.llm import alignment, shared

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(shared.tokenizer_path(A))
    a.encode_special_tokens = True
    letters = {}
    other = 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(other)] = byte
            other += 1
    b = sentencepiece.SentencePieceProcessor(model_file=shared.tokenizer_path(B))
    return a, b, letters


def plain_groups(text, libraries):
    """[(a ids, b ids)] by comparing sets of ends."""
    a, b, letters = libraries
    if not text:
        return []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends = []
    for tokens in (bytes_a, bytes_b):
        at, out = 0, []
        for t in tokens:
            at += len(t)
            out.append(at)
        ends.append(out)
    both = set(ends[0]) & set(ends[1])
    cut = []
    for ids, own in zip((ids_a, ids_b), ends):
        parts = [[]]
        for i, e in zip(ids, own):
            parts[-1].append(i)
            if e in both:
                parts.append([])
        cut.append(parts[:-1])
    return list(zip(*cut))


def plain_alignment(rows, libraries):
    every = [(i, plain_groups(t, libraries)) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, groups in every for a, b in groups)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, groups in every:
        pairs = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_whole_table_against_plain_sets(spark, libraries):
    docs = shared.table(spark, "/root/testdata/sf0.001", "documents")
    wanted = plain_alignment([(r.doc_id, r.text) for r in docs.collect()], libraries)
    assert ordered(rows_of(alignment.op11_alignment(spark, "/root/testdata/sf0.001"))) == ordered(wanted)


def test_few_broadcast_pairs_give_the_same(spark, libraries):
    docs = shared.table(spark, "/root/testdata/sf0.001", "documents")
    wanted = ordered(rows_of(alignment.align(docs, A, B)))
    for frequent in (0, 50, 3000):
        assert ordered(rows_of(alignment.align(docs, A, B, frequent=frequent))) == wanted


def test_awkward_rows(spark, awkward, libraries):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ordered(rows_of(alignment.align(awkward, A, B))) == ordered(plain_alignment(rows, libraries))


def test_odd_texts(spark, documents, libraries):
    texts = ["a ▁ b", "▁", " ", "  lead", "tail  ", "\n\n\na", "<s></s><unk><0x41>", "x<|endoftext|>y", "ﬁ ½ é é", "\u0000\u0001\u007f", "日本語 テキスト", "👩‍👩‍👧 🇩🇪", "a 　b", "\t\tcode(x):\n\t\treturn 'y'", "ab" * 9000, " " * 20_000, "\n" * 20_000]
    rows = [(n, t) for n, t in enumerate(texts)] * 2
    got = rows_of(alignment.align(documents(rows).repartition(3), A, B))
    assert ordered(got) == ordered(plain_alignment(rows, libraries))


def test_groups_over_many_windows(spark, documents, libraries, monkeypatch):
    texts = ["word and другой текст 日本 " * 700, "y" * 30_000, "", None, "short"]
    got = alignment.align_groups(documents(list(enumerate(texts))), A, B).orderBy("doc_id", "number").collect()
    for i, text in enumerate(texts):
        own = [r for r in got if r.doc_id == i]
        assert [(r.a_ids, r.b_ids) for r in own] == plain_groups(text, libraries)
        assert [r.number for r in own] == list(range(len(own)))
        assert all(r.stop == s.start for r, s in zip(own, own[1:])) and (not own or own[0].start == 0 and own[-1].stop == len(text.encode()) + 1)


def test_state_is_a_window_and_an_open_group():
    a, b = alignment.vocabulary(A), alignment.vocabulary(B)
    text = "some words of a text, again and again " * 3000
    state, ids = alignment.Sweep(a, b), [v.ids(text)[0] for v in (a, b)]
    parts = [dict(v.windows(i)) for v, i in zip((a, b), ids)]
    assert len(parts[0]) > 10
    import numpy as np

    for w in parts[0]:
        state.window([np.frombuffer(p[w], v.kind) for p, v in zip(parts, (a, b))])
        assert sum(map(len, state.open)) < 20
    assert state.seen == [len(i) for i in ids]


def test_empty_table(spark, documents):
    assert rows_of(alignment.align(documents([]), A, B)) == []
    assert alignment.align_groups(documents([]), A, B).count() == 0


def test_least_count_of_the_most_frequent(spark):
    counted = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [7, 8, 9, 1000])], "k int, n bigint")
    for most in (0, 1, 3, 4, 30, 74, 100):
        least, rest = shared.most_frequent(counted, "n", most)
        taken = counted.where(f"n >= {least}").count()
        assert taken <= most and taken + rest == 74
    assert shared.most_frequent(counted, "n", 100)[1] == 0
