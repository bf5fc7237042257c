"""Small tables with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ta", "ren", "so", "vil", "ge")]

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def awkward_texts(seed: int = 3) -> list[str | None]:
    """Null, empty and blank texts, copies, near copies, shared passages, repeats, one long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    near = []
    for text in base[:12]:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    shared = [f"{prose(rng, 30)}\n{passage} {prose(rng, 25)}" for _ in range(8)]
    return [
        None, "", "  \n\t ", "one", "two words", "a b c", "a b c",
        *base, *base[:6], *near, *shared,
        "same " * 70, prose(rng, 20_000), "Ünïcode Straße 東京 " * 8, "x" * 50_000, passage,
    ]


def documents(spark, texts: list[str | None] | None = None, ids=None):
    """Documents in scattered order; the same row twice, a null id and null columns included."""
    texts = awkward_texts() if texts is None else texts
    rows = [
        (i, t, [None, "en", "de"][i % 3], [None, "a", "b", "b"][i % 4], None if t is None else len(t))
        for i, t in zip(ids or range(len(texts)), texts)
    ]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def removed_words(texts: list[str | None], length: int) -> list[list[bool]]:
    """Brute force of substring dedup, documents in order of id."""
    seen: set[tuple] = set()
    out = []
    for text in texts:
        words = words_of(text)
        drop = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                drop[i : i + length] = [True] * length
            seen.add(window)
        out.append(drop)
    return out


def linked_groups(texts: list[str | None], shingle: int, percent: int) -> list[tuple[int, int]]:
    """Brute force of the Jaccard join: size of the set and least index reachable, by index."""
    sets = []
    for text in texts:
        words = [w.lower() for w in words_of(text)]
        n = max(1, len(words) - shingle + 1)
        sets.append({tuple(words[i : i + shingle]) for i in range(n)} if words else set())
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                near[i].add(j)
                near[j].add(i)
    root = {}
    for i in range(len(sets)):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo.extend(near[x])
    return [(len(s), root[i]) for i, s in enumerate(sets)]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
