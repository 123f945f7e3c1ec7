"""Repeated passages: words that collide under sums of powers, and copies of whole texts."""

from __future__ import annotations

import random

import numpy as np

from tessera.llm import common, substrings

from .fixtures import collected, empty, frame
from .test_operators import brute_repeats

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def thue_morse(length: int) -> tuple[str, str]:
    bits = [i.bit_count() & 1 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_of_spans():
    rng = random.Random(3)
    pool = ["".join(rng.choice("abé9,") for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    pool += [*thue_morse(256), *thue_morse(1024), *thue_morse(4096), "a" * 511, "a" * 512, "a" * 513, "\0", "\0\0", "a\0", "a"]
    data, offsets = common.flat(common.pa.array(pool))
    one, two = common.span_hashes(data, offsets[:-1], offsets[1:], 2)
    assert (common.span_hashes(data, offsets[:-1], offsets[1:])[0] == one).all()
    for values in (one, two):
        assert {pool[i]: v for i, v in enumerate(values.tolist())} == {p: values[pool.index(p)] for p in set(pool)}
        assert len(set(values.tolist())) == len(set(pool))
    assert not (one == two).any()


def test_words_that_collide_under_powers_of_two_stay(spark):
    a, b = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest} tail"), (4, f"{rest} {a}")]
    got = collected(substrings.drop_repeats(frame(spark, rows, repeated=False)), *COLUMNS)
    assert got == brute_repeats(rows) and [r[2] for r in got] == [0, 0, 13, 0]


def test_copies_near_copies_and_null_ids(spark):
    rng = random.Random(9)
    base = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(30)}" for _ in range(n)) for n in (5, 12, 13, 14, 60, 200)]
    rows = [(rng.randrange(40), rng.choice(base)) for _ in range(120)]
    rows += [(rng.randrange(40), rng.choice(base) + " " + rng.choice(base)) for _ in range(60)]
    rows += [(None, base[4]), (None, base[4]), (-3, base[5]), (7, base[5] + " x"), (7, base[5] + " y"), (8, ""), (8, None)]
    assert collected(substrings.drop_repeats(frame(spark, rows, repeated=False)), *COLUMNS) == brute_repeats([(i, t or "") for i, t in rows])
    kept = substrings.drop_repeats(frame(spark, rows, repeated=False), keep_text=True).collect()
    for r in kept:
        assert sum(x["beyond"] - x["first"] for x in r["intervals"]) == r["n_removed"] and len(r["kept"].split()) == r["n_words"] - r["n_removed"]
    assert substrings.drop_repeats(empty(spark), keep_text=True).count() == 0


def test_a_passage_of_most_documents(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"start {i} {passage} end {i % 7}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeats(frame(spark, rows, repeated=False)).collect()}
    assert got[0] == 0 and all(got[i] >= 40 for i in range(1, 300))
    assert np.mean([got[i] for i in range(1, 300)]) < 45
