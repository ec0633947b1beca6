"""op12 against a plain tree held in one list, over groups of many sizes."""

import hashlib
import zlib

from pyspark.sql import functions as F

from telemara.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text): the rows that op12 returns."""
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    over = levels([trees[s][-1][0] for s in names])
    root, out = over[-1][0], []
    for k, s in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            now = leaf_of(r, lower(r[4])) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 else leaf
            proof = []
            for tree, at in ((trees[s], i), (over, k)):
                for level in tree[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    proof += run[: at % 16] + run[at % 16 + 1 :]
                    now, at = h(*run[: at % 16], now, *run[at % 16 + 1 :]), at // 16
            out.append((r[0], leaf, trees[s][-1][0], root, h(*proof), now, now == root))
    return sorted(map(str, out))


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.select("*", *[F.lit("mine").alias(c) for c in ("tree", "Pos", "hash", "leaf", "id", "range")])


def some(n, source, start=0):
    return [(start + i, source, None if i % 7 == 0 else "en", i % 11, None if i % 13 == 5 else f"Text Ü {i}" if i % 3 else f"low {i}") for i in range(n)]


def test_groups_of_many_sizes_with_nulls_and_repeats(spark):
    rows, at = [], 0
    for k, n in enumerate((1, 2, 15, 16, 17, 255, 256, 257, 300, 513)):
        rows += some(n, None if k == 4 else f"s{k}" if k % 2 else f"é{k}", at)
        at += n
    rows += [(7, "s1", "en", 1, "same row")] * 40 + [(7, "s1", "en", 1, "Other"), (None, "s1", None, None, None), (None, "s1", None, None, None), (None, None, "x", 2, "N")]
    got = sorted(map(str, map(tuple, merkle.manifest_index(table(spark, rows)).collect())))
    assert got == plain(rows)


def test_a_group_of_three_rounds_and_many_groups(spark):
    rows = some(4500, "big") + [(10_000 + i, f"g{i:04}", "en", 1, "X") for i in range(300)]
    got = sorted(map(str, map(tuple, merkle.manifest_index(table(spark, rows)).collect())))
    assert got == plain(rows)


def test_one_group_one_row_and_none(spark):
    for rows in (some(1, "s"), some(1, None), some(256, "s"), some(4097, "s")):
        assert sorted(map(str, map(tuple, merkle.manifest_index(table(spark, rows)).collect()))) == plain(rows)
    assert merkle.manifest_index(table(spark, some(3, "s")).where("false")).collect() == []


def test_a_version_shares_what_it_does_not_change():
    leaves = [h(str(i)) for i in range(200)]
    tree = merkle.grown(leaves, True)
    other = merkle.replaced(tree, 37, h("new"))
    assert other.hash == merkle.grown([h("new") if i == 37 else x for i, x in enumerate(leaves)], True).hash and tree.hash == merkle.grown(leaves, True).hash
    assert [a is b for a, b in zip(tree.children, other.children, strict=True)].count(False) == 1
    assert [a is b for a, b in zip(tree.children[2].children, other.children[2].children, strict=True)].count(False) == 1


def test_tampering_with_any_column_is_found(spark):
    rows = table(spark, some(40, "s") + some(20, "t", 100))
    made = merkle.manifest(rows, tampered={"lang": F.lit("xx")}, where=F.col("doc_id") < 3)
    assert {r.id for r in made.where("not verified").collect()} == {0, 1, 2}
