"""The manifest against a plain tree, and its odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from pluvio.llm import merkle
from tests.llm.brute import sha

SMALL = merkle.Settings(chunk=7, first_height=1, height=1)
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(leaves):
    """The top and, per leaf, what stands before and after it on the way there."""
    ways, levels = [[] for _ in leaves], [leaves]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        for i, w in enumerate(ways):
            at = i // 3 ** (len(levels) - 1)
            w.append(("".join(nodes[at - at % 3 : at]), "".join(nodes[at + 1 : at - at % 3 + 3])))
        levels.append([sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)])
    return levels[-1][0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for r, way in zip(groups[s], trees[s][1], strict=True):
            bad = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                bad = (*r[:4], r[4].replace("\n", ""))
            node = leaf(bad)
            for a, b in way + up:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in way + up)), node, node == root))
    return out


def result(df, settings=SMALL):
    made = merkle.verified(merkle.documents_manifest(df, settings))
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 9, 100, 28, 1), (400, 3)])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(k * 1000 + i, f"s{k}", "en", i, f"line {i}\nand {k}") for k, n in enumerate(sizes) for i in range(n)]
    assert result(spark.createDataFrame(rows, COLUMNS).repartition(5)) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "en", 1, ""), (3, None, "é", 2, "日本\n"), (3, None, "é", 2, "日本\n"), (3, None, "é", 2, "other"), (-5, "Z", "en", 3, "\n"), (7, "a", None, 5, "x" * 200_000 + "\n"), (8, "é", None, 5, None), (2**62, "a|b", "", 0, "|")]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("clash") for c in ("g", "mid", "a", "b", "leaf", "root", "subroot", "proof", "n", "c", "path", "group", "tampered")})
    assert result(df) == sorted(plain(rows), key=str)
    assert result(df, merkle.Settings()) == sorted(plain(rows), key=str)


def test_an_empty_table(spark):
    assert result(spark.createDataFrame([], COLUMNS)) == []


def test_proofs_hold_nothing_but_siblings(spark):
    rows = [(i, "s", "en", i, "t") for i in range(30)]
    for r in merkle.documents_manifest(spark.createDataFrame(rows, COLUMNS), SMALL).collect():
        node = r.leaf
        for step in r.proof:
            a, b = step.split("|")
            node = sha(a + node + b)
        assert node == r.root and len(r.proof) == 4
