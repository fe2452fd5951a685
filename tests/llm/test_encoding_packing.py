import random
from collections import Counter

import pytest

tiktoken = pytest.importorskip("tiktoken")
from voltmill.llm.encoding import PATTERN, count_tokens, encode_texts, encoder, TOKENIZER_DIR  # noqa: E402
from voltmill.llm.packing import pack, plan_containers  # noqa: E402

NAME = "byte_bpe_50k.tiktoken"


def whole(text):
    return encoder(TOKENIZER_DIR, NAME)._whole.encode_ordinary(text or "")


ODD = [
    None, "", " ", "\n\n", "a  b", "a \x01", "x　　y", "don't!'s we'll 'tis!!'re", "１２３ａｂｃ", "的是  了。  !", "a" * 5000, " " * 3000 + "z",
    "<|endoftext|>", "é‍👩‍👩‍👧", "\u0085\u0085x", "tab\t\tx\x1c\x1cy", "!'s", "''s", "A1b2C3", "﻿bom",
]


def test_same_ids_as_undivided_text(spark):
    rnd = random.Random(3)
    alphabet = "ab 's\t\n 　的。1２!?'’é́Я​\x01퟿"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    out = {r.doc_id: r.ids for r in encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "text", "ids").collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i] == whole(t), repr(t)
    sizes = {r.doc_id: r.n for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string, x string"), "text", "n").collect()}
    assert sizes == {i: len(ids) for i, ids in out.items()}


def test_encode_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), "text", "ids").collect() == []


def check_plan(histogram, capacity):
    entries, used = plan_containers(histogram, capacity)
    fill, ranks = Counter(), Counter()
    for size, first, count, start, each in sorted(entries):
        assert first == ranks[size]
        ranks[size] += count
        for i in range(count):
            fill[start + i // each] += size
    assert {s: n for s, n in ranks.items() if n} == {s: n for s, n in histogram.items() if n}
    assert set(fill) == set(range(used)) and all(v <= capacity for v in fill.values())
    return entries, used


def first_fit_decreasing(histogram, capacity):
    gaps = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            at = next((i for i, g in enumerate(gaps) if g >= size), None)
            if at is None:
                gaps.append(capacity - size)
            else:
                gaps[at] -= size
    return len(gaps)


def test_plan_covers_each_item_once():
    rnd = random.Random(1)
    for _ in range(200):
        capacity = rnd.choice([10, 31, 64])
        histogram = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 12))}
        entries, used = check_plan(histogram, capacity)
        assert len(entries) < 48 * capacity
        assert used <= first_fit_decreasing(histogram, capacity) + 1


def test_pack_rows(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, 0, 5, 5, 5, 33, 50, 51, 99, 100, 101, 250]), "x") for i in range(4000)]
    out = pack(spark.createDataFrame(rows, "doc_id long, n long, container_no string"), "n", 100).collect()
    fill, parts = Counter(), {}
    for r in out:
        if r.container_id is not None:
            fill[r.container_id] += r.piece_size
        parts.setdefault(r.doc_id, []).append((r.piece_start, r.piece_size, r.container_id))
    assert all(v <= 100 for v in fill.values()) and set(fill) == set(range(len(fill)))
    for i, n, _ in rows:
        own = sorted(parts[i])
        assert sum(s for _, s, _ in own) == (n or 0)
        assert len(own) == max(1, -(-(n or 0) // 100))
        assert [c is None for _, _, c in own] == [not n] * len(own)
    assert pack(spark.createDataFrame([], "doc_id long, n long"), "n", 100).collect() == []


def test_pack_replaces_columns_of_the_result(spark):
    out = pack(spark.createDataFrame([(1, 120, "x"), (2, 30, "y")], "doc_id long, piece_size long, container_id string"), "piece_size", 100)
    assert out.columns == ["doc_id", "piece_no", "piece_start", "piece_size", "container_id"]
    assert sorted((r.doc_id, r.piece_start, r.piece_size) for r in out.collect()) == [(1, 0, 100), (1, 100, 20), (2, 0, 30)]
