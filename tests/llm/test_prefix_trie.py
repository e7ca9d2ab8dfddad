"""The trie of conversation prefixes against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from surgecast.checks.compare import compare, duck
from surgecast.llm import prefix_trie as pt
from surgecast.llm import queries
from surgecast.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string, id string, path int, band int"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))  # as SQL takes remainders
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    """Rows as the contract words them, one dictionary entry for each prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) if children[p] else 1
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own + sum(saved[c] for c in children[p])
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def frame_of(session, rows, parts=3):
    return session.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture
def small_bands(monkeypatch):
    monkeypatch.setattr(pt, "BAND", 2)
    monkeypatch.setattr(pt, "BLOCK", 8)
    monkeypatch.setattr(pt, "ENDS", 4)
    monkeypatch.setattr(pt, "SALT", 3)


def deep_rows():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(120):
        n = int(rng.choice([1, 2, 3, 5, 9, 17, 24]))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t < 12 and rng.random() < 0.8 else f"é{rng.integers(3)}") for t in range(n)]
    rows += [(900, t, "user", "same") for t in range(70)] + [(901, t, "user", "same") for t in range(75)]
    return rows


def test_query_equals_sql(session, sf_dir):
    assert compare(queries.op12_prefix_trie(session, sf_dir), duck(sf_dir), queries.SQL["op12_prefix_trie"]) == []


@pytest.mark.parametrize("shared", [False, True])
def test_deep_and_long_conversations(session, small_bands, shared):
    """Several levels of bands, blocks of a conversation that are carried on, many ends at one node."""
    rows = deep_rows()
    if shared:
        got = pt.trie(*pt.shared_openings(pt.ordered_turns(frame_of(session, rows))))
        assert rows_of(got) == plain_trie(rebuilt(ordered(rows)))
    else:
        assert rows_of(pt.conversation_trie(frame_of(session, rows))) == plain_trie(ordered(rows))


def test_standard_bands(session):
    rows = deep_rows()
    assert rows_of(pt.conversation_trie(frame_of(session, rows))) == plain_trie(ordered(rows))


def test_nulls_ties_repeats_and_long_texts(session):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, None, None), (2, 0, None, ""), (2, 0, "", None), (3, 5, "user", "x" * 200_000),
        (None, 0, "user", "nobody"), (None, 1, None, None), (-7, 0, "user", "minus"), (4, 1, "user", "twice"), (4, 1, "user", "twice"), (2**62, 1, "user", "twice"),
        # 107 has fewer turns than it gives up, and 100 is absent: a conversation without turns.
        *[(c, 0, "user", "gone") for c in range(101, 130)],
    ]
    frame = frame_of(session, rows)
    assert rows_of(pt.conversation_trie(frame)) == plain_trie(ordered(rows))
    assert rows_of(pt.trie(*pt.shared_openings(pt.ordered_turns(frame)))) == plain_trie(rebuilt(ordered(rows)))


def test_a_hot_conversation_and_a_hot_node(session, small_bands):
    """One conversation holds a third of all turns, and one opening a third of all conversations."""
    rows = [(0, t, "user", f"t{t % 5}") for t in range(400)] + [(c, 0, "user", "hello") for c in range(1, 400)] + [(c, 1, "assistant", f"a{c % 50}") for c in range(1, 400, 2)]
    assert rows_of(pt.conversation_trie(frame_of(session, rows, 6))) == plain_trie(ordered(rows))


def test_no_conversations(session):
    assert rows_of(pt.conversation_trie(frame_of(session, [(None, 1, "user", "x")]))) == []
    empty = session.createDataFrame([], SCHEMA)
    assert rows_of(pt.trie(*pt.shared_openings(pt.ordered_turns(empty)))) == []


def test_text_ids(session):
    rows = [("7", 0, "user", "a"), ("x", 0, "user", "b"), ("8", 0, "user", "a")]
    frame = session.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert rows_of(pt.conversation_trie(frame)) == plain_trie({7: [("user", "a")], 8: [("user", "a")]})
