"""Phrase fingerprints against a character-by-character parse and exact set similarity."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factmill.llm import phrases
from factmill.llm.queries import QUERIES

DOC = "doc_id long, text string, bucket int, guest boolean, id string, place int, b int, n_chars int, fingerprint string"
LETTERS = "ab é中\U0001f600\x00"


def docs(spark, rows):
    """Extra columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, t, 1, True, "x", 2, 3, 4, "y") for i, t in rows], DOC)


def plain_phrases(text):
    known, at = set(), ""
    for c in text:
        at += c
        if at not in known:
            known.add(at)
            at = ""
    return known


def plain_sketch(text):
    values = {int(phrases.hashes(p, [len(p)])[0]) >> (64 - 4 * phrases.DIGITS) for p in plain_phrases(text)}
    return sorted(values)[: phrases.KEEP]


def plain_likeness(a, b):
    both = sorted({*a, *b})[: phrases.KEEP]
    return len([x for x in both if x in a and x in b]) / len(both) if both else 1.0


def plain_rows(rows):
    ring = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for at, (i, text) in enumerate(ring):
        follower = ring[(at + 1) % len(ring)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        a, b, c = (plain_sketch(t) for t in (text, edited, follower))
        show = ["".join(f"{x:0{phrases.DIGITS}x}" for x in s) for s in (a, b)]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *show, plain_likeness(a, b), plain_likeness(a, c)))
    return out


def invented(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 400))) for _ in range(n)]


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=80), st.text(LETTERS, max_size=80))
def test_parse_and_shared_parse(text, other):
    known, ends = set(), []
    phrases.parse(text, known, ends)
    assert known == plain_phrases(text) and len(ends) == len(known)
    edited, mine, theirs = phrases.sketch_with_edit(text, other)
    assert mine.tolist() == plain_sketch(text) and theirs.tolist() == plain_sketch(edited)
    assert phrases.likeness(mine, theirs) == plain_likeness(mine.tolist(), theirs.tolist())


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_against_plain_python(spark, buckets):
    rows = [(5 * i - 60, t) for i, t in enumerate(invented(1, 40))]
    rows += [(None, "no id"), (None, "no id at all"), (7, None), (8, ""), (9, ""), (10, "a"), (11, "İß 中\U0001f600 \x00\x1f"), (12, "aaaa" * 500)]
    rows += [(13, rows[0][1]), (13, rows[0][1]), (13, "another text of one id"), (2**60, "far away"), (2**60 + 1, "farther"), (-(2**62), "first")]
    got = [tuple(r) for r in phrases.fingerprint_documents(docs(spark, rows).repartition(4), buckets).collect()]
    want = plain_rows(rows)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_small_tables(spark):
    for rows in ([], [(1, None)], [(1, "one text and no more")], [(None, "a"), (None, None)], [(3, "same"), (3, "same")]):
        got = phrases.fingerprint_documents(docs(spark, rows), 4).collect()
        assert sorted(map(tuple, got), key=key) == sorted(plain_rows(rows), key=key)


def test_very_long_texts():
    """Longer than what is hashed at once; the estimate is near the exact similarity of the sets."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(5000)]
    a, b = (" ".join(rng.choices(words, k=170_000)) for _ in range(2))
    edited, mine, theirs = phrases.sketch_with_edit(a, b)
    one, two = plain_phrases(a), plain_phrases(edited)
    assert len(a) > phrases.CHUNK and mine.tolist() == plain_sketch(a)
    assert abs(phrases.likeness(mine, theirs) - len(one & two) / len(one | two)) < 0.1


def test_hashes_depend_on_phrases_alone():
    text = "abcabdab"
    alone = [int(phrases.hashes(p, [len(p)])[0]) for p in ("a", "b", "c", "ab", "d")]
    assert phrases.hashes(text, [1, 2, 3, 5, 6]).tolist() == alone
    assert len(set(alone)) == 5 and np.all(np.diff(phrases.smallest(np.arange(2000, dtype=np.uint64) << np.uint64(40)).astype(np.int64)) > 0)


def test_edits_are_nearer_than_strangers(spark):
    rows = QUERIES["op13_document_fingerprints"](spark, "/root/testdata/sf0.01").where("n_chars > 200").collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.98
    by_text = {}
    for r in rows:
        by_text.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert all(len(v) == 1 for v in by_text.values())
