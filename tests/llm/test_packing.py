"""Packing: what the plan promises, and the pieces of real documents."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geotrail.llm import packing


def fewest(lengths, capacity):
    """Fewest sequences, by trying all ways."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in {room for room in rooms if room >= lengths[k]}:
            again = list(rooms)
            again[again.index(r)] -= lengths[k]
            place(k + 1, again)
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def check(plan, counts, capacity):
    used = {}
    for times, content in plan.kinds:
        assert times > 0 and sum(length * copies for length, copies in content) <= capacity
        for length, copies in content:
            used[length] = used.get(length, 0) + times * copies
    assert used == {k: v for k, v in counts.items() if v}


def test_reduction_never_costs_a_sequence():
    random.seed(5)
    for _ in range(150):
        capacity = random.randint(8, 20)
        lengths = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 8))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        fixed = sum(times for times, _ in packing.reduce_dominated(left, capacity))
        rest = list(itertools.chain.from_iterable([length] * int(left[length]) for length in range(capacity, 0, -1)))
        assert fixed + fewest(rest, capacity) == fewest(lengths, capacity), (capacity, lengths)
        plan = packing.plan_packing(counts, capacity)
        check(plan, counts, capacity)
        assert plan.sequences <= fewest(lengths, capacity) + 1


def test_plan_of_many_pieces_is_small_and_close_to_the_bound():
    random.seed(6)
    counts = {length: random.randint(0, 10**9) for length in range(1, 1025)}
    plan = packing.plan_packing(counts, 1024)
    check(plan, counts, 1024)
    assert len(plan.ranges()) < 20_000
    assert plan.sequences <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 1024)


def test_ranges_give_every_rank_one_place():
    plan = packing.plan_packing({7: 5, 3: 11, 2: 1, 10: 2}, 10)
    places = {}
    for length, a, b, first, copies, base in plan.ranges():
        for rank in range(a, b):
            step = rank - a
            at = (first + step // copies, base + step % copies * length)
            assert at not in places
            places[at] = length
    assert sorted(places.values()) == [2] + [3] * 11 + [7] * 5 + [10] * 2


def test_cut_pieces():
    assert packing.cut_pieces(5, 4) == [(0, 1), (1, 5)]
    assert packing.cut_pieces(8, 4) == [(0, 4), (4, 8)]
    assert packing.cut_pieces(1, 4) == [(0, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a short one", 9), (2, None, 9), (3, "", 9), (4, "long words " * 3000, 9), (1, "a short one", 9), (None, "no id", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, length int"), rows


def test_pieces_and_places(odd):
    docs, rows = odd
    got = packing.pack(docs, capacity=64, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, copies in ((1, 2), (2, 1), (3, 1), (4, 1), (None, 1)):
        text = next(t for i, t, _ in rows if i == doc_id) or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        own = got[got["doc_id"].isna() if doc_id is None else got["doc_id"] == doc_id]
        assert len(own) == copies * -(-len(ids) // 64) and own["length"].sum() == copies * len(ids)
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length]
            assert list(r.ids) == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum()[:-1]])).all() and own["length"].sum() <= 64
    joined = packing.sequences(packing.pack(docs, capacity=64, with_ids=True)).collect()
    assert sum(len(r["ids"]) for r in joined) == got["length"].sum()


def test_no_rows(odd):
    assert packing.pack(odd[0].limit(0)).collect() == []
