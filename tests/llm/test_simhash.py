import random

import pytest
import xxhash

from popstat.llm.simhash import fingerprint, fingerprint_links, near_duplicate_logs


def components(values, radius):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("radius", [2, 3])
def test_links_connect_what_lies_within_the_radius(spark, radius):
    rng = random.Random(radius)
    values = set()
    for _ in range(40):
        seed = rng.getrandbits(64)
        values.add(seed)
        for _ in range(5):
            flips = 0
            for b in rng.sample(range(64), rng.randint(1, 4)):
                flips |= 1 << b
            values.add(seed ^ flips)
    values |= {0, 1, 2**63, 2**64 - 1, 7, 2**63 + 3}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "p long"), radius).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= radius for r in links)
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in links:
        x, y = root(r.a), root(r.b)
        parent[max(x, y)] = min(x, y)
    assert {v: root(v) for v in signed} == components(signed, radius)


def test_fingerprint_is_the_majority_of_shingle_bits():
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 2)
    assert fingerprint("A b\tC\nd", 3) % 2**64 == want
    assert fingerprint("É one", 3) % 2**64 == xxhash.xxh64_intdigest("É one".encode(), 42)
    assert fingerprint(None, 3) == fingerprint(" \n", 3) == 0


def test_edge_rows(spark):
    rows = [(5, "x y z w", 1), (2, "X Y\u000bz w", 1), (None, "x y z w", 2), (9, None, 3), (8, "", 4), (7, "\t", 4), (None, "alone here now", 0), (3, "q " * 30_000, 0)]
    logs = spark.createDataFrame(rows, "run_id long, log string, p int")
    got = {(r.run_id, r.component_id, r.fingerprint) for r in near_duplicate_logs(logs).collect()}
    same = f"{fingerprint('x y z w', 3) % 2**64:016x}"
    assert {(5, 2, same), (2, 2, same), (None, 2, same), (9, 7, "0" * 16), (8, 7, "0" * 16), (7, 7, "0" * 16)} <= got
    assert [g[1] for g in got if g[0] is None and g[2] != same] == [None]
    assert near_duplicate_logs(logs).count() == len(rows)


def test_a_long_chain_is_one_component(spark):
    from popstat.llm.components import connected_components

    nodes = spark.range(200).toDF("v")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 198)] + [(4, 3), (4, 4)], "a long, b long")
    got = {r.v: r.component for r in connected_components(nodes, links, "v", "a", "b").collect()}
    assert got == {**dict.fromkeys(range(199), 0), 199: 199}


def test_empty_table(spark):
    assert near_duplicate_logs(spark.createDataFrame([], "run_id long, log string")).collect() == []
