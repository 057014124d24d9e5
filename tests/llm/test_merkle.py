import hashlib
import random
import zlib

from pyspark.sql import functions as F

from prefspark.llm import merkle, registered
from tests.llm.common import EDGES, documents


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf_of(i, text, lang, source):
    return sha(*map(field, (i, source, lang, len(text or ""), text)))


def tree(nodes):
    """Top of a list of digests, and for each of them its siblings (left, right) level by level."""
    at, proofs, owners = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(at) > 1:
        runs = [at[i : i + 8] for i in range(0, len(at), 8)]
        for n, own in enumerate(owners):
            run, place = runs[own // 8], own % 8
            proofs[n].append(("".join(run[:place]), "".join(run[place + 1 :])))
        at, owners = [sha(*run) for run in runs], [own // 8 for own in owners]
    return at[0], proofs


def expected(rows):
    full = [(row + (None, None))[:4] for row in rows]
    groups = {}
    for row in full:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    parts = []
    for name in names:
        members = sorted(groups[name], key=lambda m: m[:3])
        parts.append((members, *tree([m[2] for m in members])))
    root, upper = tree([top for _, top, _ in parts])
    out = []
    for (members, top, proofs), higher in zip(parts, upper):
        for (_, _, leaf, (i, text, lang, source)), proof in zip(members, proofs):
            path = [*proof, *higher]
            forged = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None
            folded = leaf
            if forged:
                folded = sha(*map(field, (i, source, lang, len(text), lower(text))))
            for left, right in path:
                folded = sha(left, folded, right)
            joined = "".join(left + right for left, right in path)
            out.append((i, leaf, top, root, sha(joined), folded, folded == root))
    return sorted(out, key=str)


def found(df):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in columns) for r in registered.merkle_proofs(df).collect()), key=str)


def corpus(sizes, seed=3):
    rng, rows = random.Random(seed), []
    for lang, n in sizes.items():
        rows += [(len(rows) * 37 % 10_007, f"{rng.choice(['Some', 'plain', 'Éa'])} {i}", lang, "s") for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_trees_of_many_heights(spark):
    rows = corpus({"en": 700, "de": 64, "fr": 65, None: 9, "": 8, "é": 1, "zz": 2})
    assert found(documents(spark, rows, clashing=True)) == expected(rows)


def test_many_groups_and_one_group(spark):
    for sizes in ({f"l{i}": 1 + i % 3 for i in range(75)}, {"en": 513}, {"en": 9}, {"en": 1}, {None: 2}):
        rows = corpus(sizes)
        assert found(documents(spark, rows)) == expected(rows)


def test_edges(spark):
    rows = EDGES + [(None, "x", "en", "s"), (50, "said twice over", "en", None), (50, "Said otherwise", "en", None)]
    assert found(documents(spark, rows, clashing=True)) == expected(rows)
    assert found(documents(spark, [])) == []


def test_a_proof_shows_every_change_and_no_other(spark):
    rows = corpus({"en": 100, "de": 20})
    df = documents(spark, rows)
    digest = lambda text: merkle.leaf_digest(F.col("doc_id"), text)
    made = merkle.proofs(df, digest(F.col("text")), digest(F.concat("text", F.lit("!"))))
    checked = made.select(
        (merkle.fold(F.col("leaf"), F.col("proof")) == merkle.hex_of(F.col("root"))).alias("own"),
        (merkle.fold(F.col("other"), F.col("proof")) == merkle.hex_of(F.col("root"))).alias("changed"),
        F.size("proof").alias("levels"),
    ).collect()
    assert all(r.own and not r.changed for r in checked) and {r.levels for r in checked} == {3, 4}
