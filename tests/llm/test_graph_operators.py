"""Vector range join, Merkle manifest and prefix trie against brute force: nulls, ties, repeated rows, long groups, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tabloom.llm import merkle, prefixtrie, rangejoin
from tabloom.llm.places import placed


def test_places_match_sorting(spark):
    random.seed(1)
    rows = [(random.choice("aab"), random.choice([None, *range(40)]), k) for k in range(500)]
    got = placed(spark.createDataFrame(rows, "g string, x int, k long").repartition(7), ["g"], ["x", "k"], "t", without=("x",)).collect()
    for g in "ab":
        want = [k for _, _, k in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == want
        assert {r.total for r in got if r.g == g} == {len(want)}


def brute_links(rows, cosine):
    dims = max((len(v) for _, v in rows if v), default=0)
    fine = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = np.zeros((len(rows), dims))
    for k, (_, v) in enumerate(rows):
        if fine[k]:
            units[k, : len(v)] = np.array(v) / np.abs(v).max()
            units[k] /= np.linalg.norm(units[k])
    linked = (units @ units.T >= cosine) & ~np.eye(len(rows), dtype=bool)
    out = []
    for k in range(len(rows)):
        seen, front = {k}, [k]
        while front:
            for x in np.flatnonzero(linked[front.pop()]):
                if x not in seen:
                    seen.add(x)
                    front.append(x)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        out.append((rows[k][0], int(linked[k].sum()), min(ids, default=None)))
    return sorted(((i, n, c, i is not None and i == c) for i, n, c in out), key=str)


def vector_rows():
    rng = np.random.default_rng(4)
    groups = [rng.normal(size=6) for _ in range(6)]
    rows = [(k, (rng.normal(size=6) if k % 3 else groups[k % 6] + rng.normal(size=6) * (0.05 + 0.3 * (k % 5 == 0))).tolist()) for k in range(700)]
    rows += [(k, [1.0, 0.02 * k, 0.0]) for k in range(800, 880)]  # a chain that reaches beyond single links
    rows += [(900, [3.0, 1.0]), (901, [1e200, 1e200 / 3]), (902, [3.0, 1.0]), (902, [3.0, 1.0]), (902, [-3.0, 1.0]), (903, [1e-300, 1e-300 / 3, 0.0])]
    rows += [(910, None), (911, []), (912, [0.0, 0.0]), (913, [1.0, None]), (914, [float("nan"), 1.0]), (915, [float("inf"), 1.0]), (None, [0.0, -1.0]), (None, None)]
    return rows


@pytest.mark.parametrize(("cell", "part"), [(4096, 8192), (40, 16)])
def test_range_join_matches_all_pairs(spark, monkeypatch, cell, part):
    monkeypatch.setattr(rangejoin, "CELL_ROWS", cell)
    monkeypatch.setattr(rangejoin, "PART_ROWS", part)
    rows = vector_rows()
    given = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, n_links int, v string")
    got = sorted((tuple(r) for r in rangejoin.near_vectors(given).collect()), key=str)
    assert got == brute_links(rows, rangejoin.COSINE)


def test_range_join_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rangejoin.near_vectors(empty).count() == 0
    unusable = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, rangejoin.near_vectors(unusable).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, False)]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels(held):
    out = [held]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    out = []
    for row in tree[:-1]:
        run, digit = row[at // 16 * 16 :][:16], at % 16
        out.append(("".join(run[:digit]), "".join(run[digit + 1 :])))
        at //= 16
    return out


def brute_manifest(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        bent = text.translate(low) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        groups[source].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, bent), doc_id))
    trees = {s: levels([x[2] for x in sorted(g, key=lambda x: x[:3])]) for s, g in groups.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for at, (_, _, own, bent, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = siblings(trees[s], at) + siblings(top, names.index(s))
            node = bent
            for a, b in way:
                node = H(a + node + b)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in way)), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_merkle_matches_brute_force(spark):
    rows = [(k, f"Text {k} É" if k % 7 else None, "en", f"src{k % 19:03d}", k) for k in range(400)]
    rows += [(k, "A" * (k % 3), None, "big", None) for k in range(1000, 5200)]  # more than one partition, the last one short
    rows += [(k, "B", "en", None, 1) for k in range(6000, 6017)] + [(7000, "X" * 200_000, "en", "", 1), (None, "Null", "en", "big", 1), (None, None, None, None, None)]
    rows += rows[:3] + [(1, "Other text of one id", "en", "src001", 4)]
    given = spark.createDataFrame([(*r, 1, "y", b"z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, total int, key string, leaf binary")
    got = sorted((tuple(r) for r in merkle.manifest(given).collect()), key=str)
    assert got == brute_manifest(rows)
    assert any(not r[-1] for r in got) and merkle.manifest(given.limit(0)).count() == 0


def test_one_leaf_is_its_own_root(spark):
    given = spark.createDataFrame([(3, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.manifest(given).collect()
    own = leaf(3, "s", "en", 1, "a")
    assert tuple(row) == (3, own, own, own, H(""), own, True)


def test_butterfly_of_ragged_groups(spark):
    counts = {"a": 1, "b": 17, "c": 256, "d": 300, "e": 16}
    nodes = {k: [H(f"{k}{i}") for i in range(n)] for k, n in counts.items()}
    given = spark.createDataFrame([(k, i, counts[k] * merkle.SPAN - 5, x) for k, held in nodes.items() for i, x in enumerate(held)], "key string, chunk long, total long, node string")
    got = merkle.butterfly(given, "t").collect()
    assert len(got) == sum(counts.values())
    for r in got:
        tree = levels(nodes[r.key])
        assert r.node == tree[-1][0] and [tuple(x) for x in r.path] == siblings(tree, r.chunk)


def brute_trie(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [x[2:] for x in sorted(v)] for c, v in held.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(held):
        h = zlib.crc32(str(c).encode()) % 9
        turns = held.get(c - c % 5, [])[:h] + held[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        kids[node[:-1]] += bool(node)
    for node, held_by in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(held_by) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        ((m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], H(",".join(map(str, ends[n])))) for n, m in members.items()), key=str
    )


def talk_rows():
    random.seed(6)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", random.choice(["hi", "é", "ok", ""])) for c in range(60) for t in range(random.randrange(1, 9))]
    rows += [(c, t, "user", f"long {t}" if t < 70 or c % 2 else f"else {t}") for c in (100, 101, 102, 104) for t in range(150)]
    rows += [(-3, 1, "user", "hi"), (-5, None, None, None), (-5, 2, "user", "x"), (200, 1, "b", "two"), (200, 1, "a", "one"), (200, 1, "a", "one"), (None, 1, "user", "lost"), (301, 0, "user", "n" * 100_000)]
    return rows


@pytest.mark.parametrize(("height", "block", "piece"), [(None, 4096, 512), (4, 8, 2)])
def test_trie_matches_brute_force(spark, monkeypatch, height, block, piece):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    rows = talk_rows()
    given = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, place int, line string")
    got = sorted((tuple(r) for r in prefixtrie.prefix_trie(given, height).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
