"""Alignment of tokenizers against a plain walk over both tokenizations of whole texts."""

import hashlib
import json
import os
import random
import sys
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_helpers import awkward_texts, documents, prose  # noqa: E402

from forgepulse.llm import alignment  # noqa: E402
from forgepulse.llm.token_counts import byte_level_alphabet  # noqa: E402

A_FILE = public_tokenizers.path(alignment.BYTE_FILE)
B_FILE = public_tokenizers.path(alignment.PIECE_FILE)


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)."""
    first = Tokenizer.from_file(A_FILE)
    first.encode_special_tokens = True
    letters = byte_level_alphabet()
    entries = {i: e for e, i in json.load(open(A_FILE))["model"]["vocab"].items()}
    second = sentencepiece.SentencePieceProcessor(model_file=B_FILE)

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def groups_of(text):
        if not text:
            return []
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        parts_a = [bytes(letters[c] for c in entries[i]) for i in a]
        parts_b = [bytes_b(i) for i in b]
        whole = (" " + text).encode()
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return []
        ends_a = np.cumsum([len(p) for p in parts_a]).tolist()
        ends_b = np.cumsum([len(p) for p in parts_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        out = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, end in zip(ids, ends):
                out[bisect_left(cuts, end)][side].append(i)
        return out

    every = [groups_of(t) for t in texts]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in every]
    count = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for groups, own in zip(every, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups),
            sum(own.values()), sum(n for p, n in own.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return rows


ODD = [
    "two  spaces and   three", " leading", "trailing ", "   ", "\n", "a▁b", "▁", "tab\tand\r\nlines\n\n x",
    "nul \x00 \x01 \x1c \x1f x", "don't we'll I'M it's 12345 3.14", "<|endoftext|> </s> <s> <unk> <0x41>",
    "  nbsp x 　 wide   sep", "é ́ comb ‍ joiner", "東京 は 日本", "🙂 🙂🙂 👩‍👩‍👧 x",
    "͸ \U000e0fff unassigned", "x" * 3000, "    def f(x):\n        return x  # ok", "!!!???... ;;", "ﬁ ﬀ ™ ½",
]


def random_text(rng):
    bits = [" ", " ", "  ", "\n", "a", "the", "é", "́", "1", ".", "'s", "\t", "🙂", " ", "Zug", "<s>"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))


def collected(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_alignment_equals_the_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 3000)
    rng = random.Random(4)
    texts = [*awkward_texts(), *ODD, *[random_text(rng) for _ in range(300)]]
    df = documents(spark, texts)
    got = collected(alignment.alignment(df, A_FILE, B_FILE))
    want = plain(texts)
    assert {i: want[i] for i in got if got[i] != want[i]} == {} and len(got) == len(texts)
    assert got[texts.index("a▁b")] == (0, 0, 0, 0, 0, 0, "")


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(None, "the same"), (None, "the same"), (1, "the same"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.alignment(df, A_FILE, B_FILE).collect()
    assert len(got) == 5 and sorted(r["count_sum"] for r in got)[:2] == [0, 0]
    assert {r["count_sum"] for r in got if r["n_a"]} == {3 * r["n_links"] for r in got if r["n_a"]}
    assert alignment.alignment(df.limit(0), A_FILE, B_FILE).count() == 0


def test_units_are_forgotten_without_effect(spark, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 30) for _ in range(60)]
    units = alignment.Units(alignment.Tokenizers(A_FILE, B_FILE))
    whole = units.of(texts)
    shown = [";".join(units.shown[i] for i in own) for own in whole]
    units.clear()
    again = []
    for t in texts:
        (own,) = units.of([t])
        again.append(";".join(units.shown[i] for i in own))
        units.clear()
    assert shown == again


def test_units_that_recur_are_kept(monkeypatch):
    rng = random.Random(4)
    common, rare = prose(rng, 20), [prose(rng, 40) + f" once{n}" for n in range(8)]
    fresh = alignment.Units(alignment.Tokenizers(A_FILE, B_FILE))
    units = alignment.Units(fresh.tokenizers)
    monkeypatch.setattr(alignment, "UNITS", 90)
    forgot, kept = 0, 0
    for text in rare:
        texts = [common, text, None, common]
        held = units.of(texts)
        for own, plain in zip(held, fresh.of(texts)):
            if own is None:
                assert plain is None
                continue
            for a, b in zip(own.tolist(), plain.tolist(), strict=True):
                assert units.shown[a] == fresh.shown[b]
                assert (units.sizes[a] == fresh.sizes[b]).all()
                own_pairs = units.pairs[units.starts[a] : units.starts[a + 1]]
                assert (own_pairs == fresh.pairs[fresh.starts[b] : fresh.starts[b + 1]]).all()
        before = len(units.number)
        units.used([own for own in held if own is not None])
        forgot += len(units.number) < before
        kept += 0 < len(units.number) < before
        assert len(units.number) <= 90 and len(units.chunks) == len(units.number)
    assert forgot and kept


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(2)
    for shape in ((4, 5, 3), (1, 7, 1), (6, 1, 6), (3, 0, 2), (0, 2, 2)):
        left, right = (rng.integers(0, 3, s) for s in (shape[:2], shape[1:]))

        def sparse(m):
            rows, columns = np.nonzero(m)
            return alignment.csr(rows, columns, m[rows, columns], m.shape)

        def dense(m):
            out = np.zeros((m.height, m.width), np.int64)
            out[alignment.row_numbers(m), m.columns] = m.values
            return out

        assert (dense(alignment.product(sparse(left), sparse(right))) == left @ right).all()
        assert (dense(alignment.transposed(sparse(left))) == left.T).all()


def test_overlaps_and_groups_of_one_text():
    links = alignment.align(np.array([2, 3, 6]), np.array([1, 3, 4, 6]))
    entries = zip(alignment.row_numbers(links.overlaps), links.overlaps.columns, links.overlaps.values)
    assert [tuple(map(int, e)) for e in entries] == [
        (0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 1), (2, 3, 2),
    ]
    assert links.groups_a.columns.tolist() == [0, 0, 1]
    assert links.groups_b.columns.tolist() == [0, 0, 1, 1]
    shared = zip(alignment.row_numbers(links.shared).tolist(), links.shared.columns.tolist())
    assert list(shared) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3)]
