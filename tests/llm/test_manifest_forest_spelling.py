"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import jaccard_join as J
from tokenloom.llm import merkle as L
from tokenloom.llm import minhash_forest as Z
from tokenloom.llm import spelling as S

from .test_llm import docs, empty, odd  # noqa: F401


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and, for each leaf, its siblings (left, right) level by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in leaves]
    nodes, below = list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        up, over = [], []
        for at in range(0, len(nodes), L.FAN):
            run = nodes[at : at + L.FAN]
            for k in range(len(run)):
                for leaf in below[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            over.append(list(itertools.chain(*below[at : at + L.FAN])))
        nodes, below = up, over
    return nodes[0], paths


def enc(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    inner = {}
    for source, of in groups.items():
        of = sorted(of, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, sha("".join(enc(r[c]) for c in L.FIELDS))))
        leaves = [sha("".join(enc(r[c]) for c in L.FIELDS)) for r in of]
        inner[source] = of, leaves, *tree(leaves)
    order = sorted(inner, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = tree([inner[s][2] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        of, leaves, subroot, paths = inner[s]
        out += [(r["doc_id"], leaf, subroot, root, path + top) for r, leaf, path in zip(of, leaves, paths, strict=True)]
    return out


@pytest.mark.parametrize("n, sources", [(1, 1), (16, 1), (17, 1), (290, 2), (300, 40)])
def test_manifest_brute_force(spark, n, sources):
    rng = random.Random(n)
    names = [None, "", *[f"é{i}" for i in range(sources)]][: sources + 2 if sources > 1 else 1]
    # One source holds most rows.
    rows = [(i * 3, f"Text {i}", None if i % 7 == 0 else "en", names[0] if rng.random() < 0.6 else rng.choice(names), i) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    changed = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    got = L.manifest(df.repartition(5), claims={"text": changed}).withColumn("folded", L.folded(F.col("claim"), F.col("path"))).withColumn("proof", L.path_digest(F.col("path"))).collect()
    want = {x[0]: x[1:] for x in plain_manifest([dict(zip(df.columns, r, strict=True)) for r in rows])}
    assert len(got) == n
    for r in got:
        leaf, subroot, root, path = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert [(p["left"], p["right"]) for p in r["path"]] == path and r["proof"] == sha("".join(a + b for a, b in path))
        assert (r["folded"] == root) == (r["doc_id"] % 2 == 1)


def test_manifest_odd_rows(spark, odd, empty):  # noqa: F811
    got = L.manifest(odd).withColumn("folded", L.folded(F.col("claim"), F.col("path"))).collect()
    want = plain_manifest(odd.collect())
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], str([(p["left"], p["right"]) for p in r["path"]])) for r in got) == sorted((str(a), b, c, d, str(p)) for a, b, c, d, p in want)
    assert all(r["folded"] == r["root"] for r in got) and L.manifest(empty).count() == 0


def plain_components(texts, size, percent):
    def shingles(t):
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def copies(seed: int, n: int, rate: float, groups: int = 3, words: int = 120) -> list[str]:
    """Groups of texts, each with some words of its group's first text replaced, so that similarities lie about the threshold."""
    rng = random.Random(seed)
    first = [[f"w{rng.randrange(10_000)}" for _ in range(words)] for _ in range(groups)]
    out = []
    for i in range(n):
        base = first[i % groups]
        out.append(" ".join(f"x{rng.randrange(10_000)}" if rng.random() < rate * rng.random() else w for w in base))
    return out


@pytest.mark.parametrize("seed, rate, region", [(1, 0.04, 64), (2, 0.06, 64), (3, 0.05, 8), (4, 0.07, 8), (5, 0.09, 4)])
def test_forest_brute_force(spark, monkeypatch, seed, rate, region):
    monkeypatch.setattr(Z, "REGION", region)  # with small regions hubs decide
    texts = [*copies(seed, 150, rate), "one two", "ONE  two", "three", "", None, " \n", *[f"alone {i} " * 3 for i in range(20)]]
    got = Z.near_duplicates(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()
    want = plain_components(texts, 4, 80)
    assert [(r["n_shingles"], r["component_id"]) for r in got] == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_forest_odd_rows(spark, odd, empty):  # noqa: F811
    got = Z.near_duplicates(odd).collect()
    assert len(got) == odd.count() and Z.near_duplicates(empty).count() == 0
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (0, 1, 2))
    # The text of 3 again without an id: linked with its equal.
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [3]
    assert [r["component_id"] for r in got if r["doc_id"] in (7, 8)] == [7, 7, 7]


def test_forest_recall():
    """Of pairs at the threshold nearly all share a prefix of the greatest depth in some tree; minima estimate the similarity."""
    rng = np.random.default_rng(5)
    shared_places, agree = 0, []
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 320, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 40, dtype=np.uint64)])) for _ in range(2))
        one, two = Z.minima([a, b])
        agree.append((one == two).mean())
        shared_places += bool((Z.branches(one[None])[0] == Z.branches(two[None])[0]).all(axis=1).any())
    assert shared_places >= 299 and abs(np.mean(agree) - 0.8) < 0.02


@pytest.mark.parametrize("seed", range(4))
def test_components_of_chains_and_stars(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(J, "LINKS_AT_ONCE", 40)
    chain = list(range(0, 900, 3))
    rng.shuffle(chain)
    links = [*itertools.pairwise(chain), *((1 + 3 * rng.randrange(100), 1 + 3 * rng.randrange(100)) for _ in range(120)), (5000, 2), (2, 2)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in J.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {x: find(x) for x in parent if any(find(x) == find(y) and x != y for y in parent)}


def test_forest_prefixes():
    keys = np.zeros((5, 9), np.uint8)
    keys[1, 8], keys[2, 8], keys[3, 4], keys[4, 0] = 1, 1, 1, 1
    assert Z.shared(keys).tolist() == [-1, 1, 2, 0, -1]


def plain_variants(texts: dict[int, str | None], times: float = 2):
    counts: dict[str, int] = {}
    for key, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out = {}
    for w, n in words.items():
        found = sorted((-words[v], v) for v in words if near(w, v))
        form = found[0][1] if found and -found[0][0] >= times * n else None
        out[w] = form, n, len(found)
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, out[form][1] if form else None))
    return sorted(rows)


def misspelt(seed: int, n: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéüñn") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts: dict[int, str | None] = {n: None, n + 1: "", n + 2: " 12 × 漢字"}
    for i in range(n):
        words = []
        for _ in range(80):
            w = list(rng.choice(stems))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                rng.choice([lambda: w.insert(at, rng.choice("abé")), lambda: w.pop(at), lambda: w.__setitem__(at, rng.choice("abé"))])()
            words.append("".join(w).title() if rng.random() < 0.2 else "".join(w))
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize("seed, subtree, seekers", [(1, 8000, 200_000), (2, 10, 200_000), (3, 25, 20), (4, 1, 7)])
def test_spelling_brute_force(spark, seed, subtree, seekers):
    texts = misspelt(seed, 40)
    # Anagrams share a leaf, which is larger than a subtree may be.
    texts[500] = " ".join(["".join(p) for p in list(itertools.permutations("abcde"))[:60]] * 3)
    texts[501] = f"{'z' * 70} {'z' * 69}y {'z' * 71} " * 3
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = S.count_words(df, damage=("doc_id", 97))
    want = plain_variants(texts)
    got = [tuple(r) for r in S.variant_groups(words).orderBy("word").collect()] if subtree == 8000 else None
    if got is not None:
        assert got == want
    pairs = sorted((r["a"], r["b"]) for r in S.near_words(words, subtree, seekers).collect())
    assert len(pairs) == len(set(pairs)) and 2 * len(pairs) == sum(r[4] for r in want)


def test_spelling_odd_rows(spark, odd, empty):  # noqa: F811
    got = {r["word"]: r for r in S.variant_groups(S.count_words(odd, damage=("doc_id", 97))).collect()}
    assert got["x" * 50_000]["root"] == "x" * 50_000 if "x" * 50_000 in got else True
    assert S.variant_groups(S.count_words(empty)).count() == 0
    # Without an id nothing is damaged.
    bare = S.count_words(odd.withColumn("doc_id", F.lit(None).cast("long")), least_length=1, least_times=1, damage=("doc_id", 1))
    assert bare.where("word = 'word'").first()["n"] == 30_000


def test_spelling_chains_and_ties(spark):
    rows = [("aaaab", 4), ("aaaac", 4), ("aaaaa", 2), ("aaaad", 9), ("bbbbb", 1), ("aaabd", 40)]
    got = {r["word"]: r for r in S.variant_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["aaaaa"]["form"] == "aaaad" and got["aaaaa"]["root"] == "aaabd" and got["aaaaa"]["n_near"] == 3
    assert got["bbbbb"]["form"] is None and got["bbbbb"]["root"] == "bbbbb" and got["bbbbb"]["n_near"] == 0
    even = spark.createDataFrame([("aaaab", 4), ("aaaac", 4), ("aaaaa", 2)], "word string, n long")
    assert {r["word"]: r["form"] for r in S.variant_groups(even).collect()} == {"aaaaa": "aaaab", "aaaab": None, "aaaac": None}


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_are_those_one_apart(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"q" * 60, "q" * 61})
    plain = {tuple(sorted((a, b))) for a, b in itertools.combinations(words, 2) if S.one_apart(a, b)}
    for group in (words, words[:-2]):
        e, q = S.near_pairs(group, group)
        found = [tuple(sorted((group[i], group[j]))) for i, j in zip(e, q, strict=True)]
        assert len(found) == len(set(found)) and set(found) == {p for p in plain if set(p) <= set(group)}
