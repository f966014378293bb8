"""What the Jaccard join keeps on disk, and what grows with large sets and large groups."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from orderboard.llm import jaccard_join


def folders(spark) -> set[str]:
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).iterdir()}


def random_set(rnd, n: int) -> np.ndarray:
    return np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))


def changed(rnd, found: np.ndarray, by: int) -> np.ndarray:
    return np.unique(np.r_[found[by:], random_set(rnd, by)])


def stored_nodes(spark, sets):
    rows = [(jaccard_join.node_of(s), len(s), jaccard_join.sketch_of(s)) for s in sets]
    return [r[0] for r in rows], spark.createDataFrame(rows, "node binary, n long, sketch binary")


@pytest.mark.parametrize("way", ["memberships", "keep_one_each", "link_counts"])
def test_only_what_the_result_reads_stays_on_disk(spark, way):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words + ["tail"]), None, "", "a b c"] + [f"o{i} {i} x{i} y{i} " + " ".join(words[:9]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = folders(spark)
    result = getattr(jaccard_join, way)(docs, jaccard_join.Rule(3, 80))
    left = {name.rpartition("-")[0] for name in folders(spark) - before}
    assert left and left <= {
        "memberships": {"jaccard-grouped", "jaccard-least"},
        "keep_one_each": {"jaccard-grouped", "jaccard-least", "jaccard-kept", "jaccard-touched"},
        "link_counts": {"jaccard-named", "jaccard-counts", "jaccard-weighted", "jaccard-others", "jaccard-held", "jaccard-links"},
    }[way]
    assert result.count() == len(texts) - (way == "keep_one_each")


def test_pairs_of_keys_go_in_turns(spark):
    rnd = random.Random(4)
    rows = [(mark, [rnd.randrange(-40, 40) for _ in range(rnd.randrange(6))] + [rnd.getrandbits(60)]) for mark in range(200)]
    of = defaultdict(set)
    for mark, keys in rows:
        for key in keys:
            of[key].add(mark)
    described = spark.createDataFrame(rows, "mark long, keys array<long>").repartition(3)
    turns = [{tuple(r) for r in t.collect()} for t in jaccard_join.shared_in_turns(described, turn_bytes=1)]
    assert len(turns) == jaccard_join.TURNS and all(turns)
    assert set().union(*turns) == {(k, m) for k, ms in of.items() if len(ms) > 1 for m in ms}
    keys = [{k for k, _ in t} for t in turns]
    assert sum(map(len, keys)) == len(set().union(*keys))
    assert len(jaccard_join.shared_in_turns(described)) == 1


def test_sketches_tell_large_sets_apart(spark):
    """1024 bits are as full of 5000 shingles as of any other 5000."""
    rnd, rule = np.random.default_rng(7), jaccard_join.Rule(5, 80)
    sets = [random_set(rnd, n) for n in (2000, 2400, 5000, 5000, 5600, 9000, 30_000, 100_000, 110_000)]
    sets += [changed(rnd, s, len(s) // 12) for s in sets]
    # Near copies whose sketches are not of one width.
    sets += [np.unique(np.r_[sets[0], random_set(rnd, 300)])]
    names, nodes = stored_nodes(spark, sets)
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    frame = spark.createDataFrame([(names[i], names[j]) for i, j in pairs], "u binary, v binary")
    found = jaccard_join.possible(frame, nodes, rule).collect()
    got = {(names.index(bytes(r["u"])), names.index(bytes(r["v"]))) for r in found}
    links = {(i, j) for i, j in pairs if rule.link(sets[i], sets[j])}
    assert {*((i, i + 9) for i in range(9)), (0, 18)} <= links <= got
    # Beyond MOST_SKETCH_BITS shingles sketches are fuller, and allow more.
    assert not [(i, j) for i, j in got if len(sets[i]) < 60_000 and not len(np.intersect1d(sets[i], sets[j]))]


def test_a_wider_sketch_folds_to_the_narrower():
    rnd = np.random.default_rng(8)
    for n in (900, 3000, 70_000, 200_000):
        found = random_set(rnd, n)
        sketch = jaccard_join.sketch_of(found)
        bits = 8 * len(sketch)
        assert min(n, jaccard_join.MOST_SKETCH_BITS) <= bits <= max(jaccard_join.SKETCH_BITS, 2 * n)
        cells = np.bincount((jaccard_join.mixed(found + jaccard_join._ODD) % np.uint64(1024)).astype(np.int64), minlength=1024)
        assert jaccard_join.folded([sketch], 128).tobytes() == np.packbits((cells & 1).astype(np.uint8)).tobytes()
    assert jaccard_join.folded([]).shape[0] == 0


def group_of(rnd, size: int, n: int = 200):
    """Sets that all link with each other, and as many that link with none."""
    base = random_set(rnd, n)
    return [changed(rnd, base, i % 7 + 1) for i in range(size)] + [random_set(rnd, n) for _ in range(size)]


def test_a_group_is_joined_by_fewer_pairs_than_it_has_sets():
    rnd, rule, k = np.random.default_rng(9), jaccard_join.Rule(5, 80), 700
    sets = group_of(rnd, k)
    sketch = jaccard_join.folded(list(map(jaccard_join.sketch_of, sets)))
    n, root = np.array(list(map(len, sets))), np.arange(len(sets))
    found = jaccard_join.window_join(sketch, n, root, rule, np.arange(len(sets)))
    x, y, left_out = jaccard_join.nearest_joining(found, sketch, root)
    assert len(x) == k - 1 and left_out and set(np.r_[x, y].tolist()) == set(range(k))
    assert len(np.unique(root[:k])) == 1 and len(np.unique(root)) == k + 1
    # Two sets have one pair: none is left out.
    root = np.arange(2)
    found = jaccard_join.window_join(sketch[:2], n[:2], root, rule, np.arange(2))
    assert jaccard_join.nearest_joining(found, sketch[:2], root)[2] is False


@pytest.mark.parametrize("block", [4, 16, 1000])
@pytest.mark.parametrize("largest", [1, 20, 36])
def test_blocks_of_a_region_meet_wherever_roots_differ(spark, block, largest):
    rnd, rule = np.random.default_rng(10), jaccard_join.Rule(5, 80)
    sets = group_of(rnd, 40)
    names, nodes = stored_nodes(spark, sets)
    roots = [names[0] if i < largest else name for i, name in enumerate(names)]
    rows = [(key, m, len(s), r) for key in (1, 2) for m, s, r in zip(names, sets, roots, strict=True)]
    rows += [(3, m, len(s), names[0]) for m, s in zip(names[:9], sets, strict=False)]
    members = spark.createDataFrame(rows, "key long, node binary, n long, root binary")
    sizes = jaccard_join.open_regions(members)
    assert {(r["region"], r["held"], r["largest"]) for r in sizes.collect()} == {(1, 80, largest), (2, 80, largest)}

    def pairs(joining):
        found = jaccard_join.pairs_within(members, sizes, nodes, rule, joining, block).collect()
        return [frozenset((bytes(r["u"]), bytes(r["v"]))) for r in found if r["u"] is not None], {r["again"] for r in found if r["u"] is None}

    got, again = pairs(False)
    want = {frozenset((names[i], names[j])) for j in range(40) for i in range(j) if roots[i] != roots[j]}
    assert not again and len(got) == len(set(got)) and set(got) == want
    some, again = pairs(True)
    assert set(some) <= want and again == {1, 2}
    if block > len(sets):
        assert len(some) == 40 - largest  # one component of them all


def test_components_come_out_though_the_first_round_fails(spark, monkeypatch):
    """Pairs that sketches take for near and that do not link leave the others to the second round."""
    rnd, rule = random.Random(12), jaccard_join.Rule(1, 80)
    common = [f"c{i}" for i in range(400)]
    # Sharing 88 or 89 of 100 words decides; each set shares them with its own kind in full.
    texts = []
    for i in range(60):
        kept = common[:89] if i % 3 else rnd.sample(common[:89], 87)
        texts.append(" ".join(kept + [f"o{i}-{j}" for j in range(100 - len(kept))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.memberships(docs, rule).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < 60
