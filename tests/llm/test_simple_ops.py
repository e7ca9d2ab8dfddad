"""Operators on documents and conversations against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from surgecast.checks.compare import compare, duck
from surgecast.llm import chat, decontaminate, packing, pii, quality, queries, simhash, substring_dedup, token_counts, toxicity
from surgecast.llm.common import prepare, table

WORDS = "ash birch cedar elm fir holly larch maple oak pine rowan willow yew alder aspen hazel".split()
SCHEMA = "doc_id long, text string, fingerprint string, n_tokens int, start int, kind string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "en"]) for _ in range(n))


def rows_of(texts):
    """Documents with columns whose names clash with those that operators make."""
    return [(i, t, "x", 1, 2, "k", None, None, None) for i, t in texts]


def odd_documents():
    """Nulls, empties, ties, repeated rows, very long texts and near copies."""
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    texts = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two three"), (5, base), (6, base), (7, base.upper())]
    texts += [(8 + i, " ".join([*words[: 10 * i], "changed", *words[10 * i + 1 :]])) for i in range(6)]
    texts += [(20, "a" * 70_000), (21, "pine oak " * 4_000), (22, prose(rng, 9_000)), (23, base + " " + base), (24, "Grüße, naïve señor! " * 30)]
    texts += [(25 + i, prose(rng, rng.randint(1, 90))) for i in range(30)]
    texts += [(60, "日本語 テキスト 𝔘𝔫𝔦 <|endoftext|> x"), (61, "<|endoftext|><|startoftext|>"), (62, "a\x1cb\x85c\u00a0d\u2028e")]
    return rows_of([*texts, (6, base), (None, "no id here"), (6, "another text")])


@pytest.fixture(scope="module")
def odd(session):
    return session.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(session):
    return session.createDataFrame([], SCHEMA)


# op1 -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_groups(odd):
    got = simhash.near_duplicate_groups(odd).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints = {t: plain_fingerprint(t) for _, t in texts}
    values = sorted(set(prints.values()))
    group = roots(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 4])
    lowest = {}
    for i, t in texts:
        g = group[prints[t]]
        if i is not None:
            lowest[g] = min(lowest.get(g, i), i)
    want = Counter((i, prints[t], lowest.get(group[prints[t]])) for i, t in texts)
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want


def test_simhash_hot_bucket_is_split(session):
    """Many fingerprints in one bucket give the same groups whatever the size of a cell."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    fps = {centre}
    for at in rng.permutation(64)[:40].tolist():
        fps |= {f ^ (1 << at) for f in rng.choice(sorted(fps), min(len(fps), 5)).tolist()}
    fps |= set(rng.integers(0, 2**62, 300).tolist())
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    frame = session.createDataFrame([(f,) for f in fps], "fp long")
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4])

    def classes(pairs):
        out = {}
        for n, r in pairs:
            out.setdefault(r, set()).add(n)
        return {frozenset(v) for v in out.values() if len(v) > 1}

    for chunk in (7, 1024):
        links = [(r["src"], r["dst"]) for r in simhash.near_links(frame, chunk=chunk).collect()]
        assert classes(roots(fps, links).items()) == classes(want.items())


def test_simhash_representatives(odd, empty):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    groups = simhash.near_duplicate_groups(odd)
    assert kept.count() == groups.select("root").distinct().count()
    assert simhash.representatives(empty).count() == 0


# op2 -----------------------------------------------------------------------------------


def leak_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]


def leaks(docs, items):
    """Best similarity of every (document text, item) by trying every window."""
    out = {}
    for i, t in docs:
        w = leak_words(t)
        for item, q in items:
            v = leak_words(q)
            if not v:
                continue
            want = Counter(shingles(v))
            for s in range(len(w) - len(v) + 1):
                have = Counter(shingles(w[s : s + len(v)]))
                j = sum((have & want).values()) / sum((have | want).values())
                if j >= 0.8 and j > out.get((i, item), 0):
                    out[i, item] = j
    return out


def test_decontamination_equals_brute_force(session, empty):
    rng = random.Random(11)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 40)}" for _ in range(n))) for k, n in enumerate([3, 5, 15, 30, 49, 55, 59, 59, 1])]
    items += [(90, None), (91, "..."), (92, "oak oak oak oak oak oak oak oak oak oak"), (6, items[6][1])]
    docs = [(0, None), (1, ""), (2, "oak " * 30), (3, prose(rng, 3000))]
    for k, q in items[:8]:
        w = q.split()
        for n, cut in enumerate((w, [*w[:20], "edited", *w[21:]], w[1:], [*w[:-1], "other"], [*w[: len(w) // 2], "new", *w[len(w) // 2 :]], ["Early", *w[3:]], [x.upper() + "," for x in w])):
            docs.append((100 * k + 10 + n, prose(rng, rng.randint(0, 60)) + " " + " ".join(cut) + " " + prose(rng, rng.randint(0, 60))))
    frame = session.createDataFrame(rows_of([*docs, docs[5], (None, docs[4][1])]), SCHEMA)
    bench = session.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    want = leaks(docs, items) | {(None, k[1]): v for k, v in leaks([docs[4]], items).items()}
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    bad = {i for i, _ in want}
    assert {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()} == {i for i, _ in docs} - bad
    assert decontaminate.clean(frame, bench.limit(0)).count() == frame.count()
    assert decontaminate.contaminated(empty, bench).count() == 0


# op3 -----------------------------------------------------------------------------------


def check_packing(rows, max_len):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(at) == list(range(len(at))) and all(v <= max_len for v in at.values())
    return at


@pytest.mark.parametrize("max_len", [4096, 50])
def test_packing_round_trip(odd, max_len):
    rows = packing.pack_documents(odd, max_len=max_len).collect()
    fill = check_packing(rows, max_len)
    assert sum(fill.values()) == sum(r["length"] for r in rows)
    exact = packing._exact("word_bpe_49k.json")
    want = Counter((r["doc_id"], tuple(exact.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in odd.collect())
    by_total = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_total.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for (doc, total), pieces in by_total.items():
        copies = Counter(pieces)
        n = set(copies.values())
        assert len(n) == 1
        whole = b"".join(ids for _, ids in sorted(copies))
        ids = tuple(np.frombuffer(whole, "<u4").tolist())
        assert len(ids) == total and want[doc, ids] == n.pop()
    assert len(by_total) == len(want)


def test_packing_has_little_padding(session, sf_dir):
    rows = packing.pack_documents(table(session, sf_dir, "documents")).select("sequence_id", "offset", "length").collect()
    fill = check_packing(rows, 4096)
    assert sum(fill.values()) / (4096 * len(fill)) > 0.95


def test_packing_edges(empty, session):
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(session.createDataFrame([(1, 0, 5000)], "doc_id long, start long, length long"))


def test_words_encode_like_the_tokenizer():
    """Texts of all kinds in one batch, with room for all pre-tokens and for few."""
    rng = random.Random(1)
    letters = [chr(i) for i in range(0x250)]
    texts = ["".join(rng.choice(letters if n % 2 else "ab c'sdlmrvt !?9É\t\n\x0b\xa0") for _ in range(rng.randint(0, 14))) for n in range(6000)]
    texts += ["", " ", "a<|endoftext|>b", "<|EndOfText|> x", "漢字 and latin", "İstanbul", "e\u0301", "\ue000 x", "x\x1cy", "ǅ ǲ", "''s 'S 'll'll", chr(0xF0000) + " a", "x" * 9_000, "1234 ½²"]
    for most in (400_000, 50):
        words = packing._Words("word_bpe_49k.json", 2, most)
        for at in range(0, len(texts), 700):
            part = texts[at : at + 700]
            ids, sizes = words.documents(pa.array(part))
            cuts = np.split(ids, np.cumsum(sizes)[:-1])
            assert [c.tolist() for c in cuts] == [[*words.ids(t).tolist(), 2] for t in part]


# op4 -----------------------------------------------------------------------------------


def test_chat_equals_sql(session, sf_dir):
    assert compare(queries.op4_chat(session, sf_dir), duck(sf_dir), queries.SQL["op4_chat"]) == []


def test_chat_round_trip(session):
    nasty = ["", None, "\\", "<|", "<\\|", "\\<|im_end|>\n", "<|im_end|>\n<|im_start|>user\nhi", "a<", "|>", "\n\n", "é𝔘 <"]
    rows = [(1, i, ["user", "assistant", None, "sys\ntem", "as\\<|s"][i % 5], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "n"), (3, None, "user", "late"), (3, 1, "assistant", "b" * 100_000)]
    frame = session.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversations(chat.chain(frame)).select("tree", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["tree"]: [tuple(t) for t in r["turns"]] for r in out} == want
    assert {r["tree"]: r["loss"] for r in out} == {c: "".join(t for role, t in v if role == "assistant") for c, v in want.items()}


def test_chat_ranks_branches_of_trees(session):
    nodes = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 3.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more", 0.0),
        ("t", 5, 4, "assistant", "end", 2.0), ("t", 5, 4, "assistant", "end", 2.0), ("u", 9, 77, "user", "lost parent", None), ("v", 1, 2, "user", "ring", 1.0), ("v", 2, 1, "user", "ring", 1.0),
    ]
    frame = session.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    out = {(r["tree"], r["rank"]): [t["text"] for t in r["turns"]] for r in chat.conversations(frame, keep=2).select("tree", "rank", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    assert out == {("t", 1): ["q", "good", "more", "end"], ("t", 2): ["q", "bad"], ("u", 1): ["lost parent"]}
    assert chat.conversations(frame.limit(0)).count() == 0


# op5 -----------------------------------------------------------------------------------

# The patterns as the contract states them.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def personal_documents():
    rng = random.Random(8)
    bits = ["a@b.com", "x_y@", "@c.de", "..", "1.2.3.4", "0001.02.255.9", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 151 234567", "+1 (988) 555-2485", "555 123 4567", "é", "𝔘", " ", " ", "-", ".", "+", "7", "joe(at)mail.org", "key=ab12cd34ef56ab78cd90"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    texts += [(500, None), (501, ""), (502, "1 " * 9000 + "9" * 20_000 + "a" * 50_000 + "@" + "b." * 5000 + "c"), (1, texts[1][1]), (2, "same id +4915112345678"), (None, "a.b@c.d")]
    return texts


def test_pii_base_spans(session, empty, monkeypatch):
    texts = personal_documents()
    frame = session.createDataFrame(rows_of(texts), SCHEMA)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    got = queries.op5_pii(session, "").collect()
    assert len(got) == len(texts)
    # The stated patterns need quadratic time on the longest text, which holds one address.
    spans = {t: ["email:18000:98002"] if t and len(t) > 90_000 else base_spans(t) for _, t in texts}
    want = Counter((i, hashlib.sha256(",".join(spans[t]).encode()).hexdigest(), *[sum(s.startswith(k) for s in spans[t]) for k in STATED]) for i, t in texts)
    assert Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    by_hash = {hashlib.sha256(",".join(s).encode()).hexdigest(): s for s in spans.values()}
    for r in got:
        assert set(by_hash[r["base_sha256"]]) <= set(r["spans"].split(",")) | {""}
    assert pii.span_lists(empty).count() == 0


def test_pii_redaction_leaves_no_base_span(session):
    frame = session.createDataFrame(rows_of(personal_documents()), SCHEMA)
    out = pii.redact(frame)
    assert out.columns == frame.columns
    rows = out.collect()
    assert len(rows) == frame.count() and sum(r["text"] is None for r in rows) == 1
    before = sum(len(base_spans(t)) for _, t in personal_documents() if t and len(t) < 90_000)
    after = sum(len(base_spans(r["text"])) for r in rows if r["text"] and len(r["text"]) < 20_000)
    assert after < 0.02 * before


def test_boosting_finds_a_rule():
    cells = [((a, b), 20.0, 20.0 * (a >= 2 and b == 1)) for a in range(5) for b in range(3)]
    base, trees = pii.boost(cells, ["a", "b"])
    scores = [(base + sum(pii._tree_value(t, v) for t in trees), n, y) for v, n, y in cells]
    at = pii.threshold(scores)
    assert all((s >= at) == (y > 0) for s, _, y in scores)
    assert pii.threshold([(1.0, 10.0, 2.0)]) == float("inf")


# op6, op7 ------------------------------------------------------------------------------


def judged(session, name):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(500):
        t = prose(rng, rng.randint(5, 80))
        bad = i % 3 == 0
        if bad and name == "toxic":
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(["grubwort", "grubbel", "snarkoid", "snarkel"])
            t = " ".join(w)
        if bad and name == "quality":
            t = t.replace(" ", "!! ").upper()
        texts.append((i, t))
        if i % 5 != 4:
            labels.append((i, int(bad) if name == "toxic" else int(not bad)))
    texts += [(600, None), (601, ""), (602, "pine " * 20_000), (0, texts[0][1]), (None, "no id")]
    labels += [(None, 1), (7, None), (0, labels[0][1]), (999, 1)]
    return session.createDataFrame(rows_of(texts), SCHEMA), session.createDataFrame(labels, f"doc_id long, {name} int"), dict(labels)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("name", "score", "choice"), [("toxic", toxicity.score_documents, "predicted"), ("quality", quality.score_documents, "keep")])
def test_classifier_on_held_out_documents(session, empty, name, score, choice):
    docs, labels, truth = judged(session, name)
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    mine = [(int(r[choice]), truth[r["doc_id"]]) for r in got if truth.get(r["doc_id"]) is not None and held_out(r["doc_id"])]
    assert len(mine) > 50 and sum(a == b for a, b in mine) / len(mine) > 0.95
    if name == "toxic":
        assert all(r["held_out"] == held_out(r["doc_id"]) for r in got if r["doc_id"] is not None)
        # Labels of held-out documents change nothing.
        other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        again = score(docs, other).collect()
        key = lambda r: (str(r["doc_id"]), round(r["score"], 9))
        assert sorted(map(key, got)) == sorted(map(key, again))
    assert score(empty, labels).count() == 0
    flat = score(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in flat}) == 1


# op8 -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("chunk", "overlap"), [(token_counts.CHUNK, token_counts.OVERLAP), (300, 12)])
def test_token_counts(odd, empty, chunk, overlap):
    exact = token_counts._exact("byte_bpe_50k.json")
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(exact.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = token_counts.token_counts(odd, chunk=chunk, overlap=overlap).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.token_counts(empty).count() == 0


def test_ids_of_any_type(session):
    texts = ["pine elm " * 60, None, "x"]
    for kind, ids in (("int", [1, None, 3]), ("string", ["a", None, "c"]), ("decimal(20,0)", None)):
        frame = session.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
        value = F.col("n").cast(kind) if ids is None else F.array(*[F.lit(i) for i in ids])[F.col("n")].cast(kind)
        got = token_counts.token_counts(frame.select(value.alias("doc_id"), "text"), chunk=100, overlap=10)
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert sorted(r["n_tokens"] for r in got.collect()) == sorted(token_counts.count_tokens(t or "", "byte_bpe_50k.json") for t in texts)


def test_a_failed_alignment_widens_the_overlap(session):
    """A boundary that the offsets do not show is no boundary; the text is cut anew and counted right."""
    text = "pinewood" * 40 + " elm" + "pinewood" * 40
    ends = {b for _, b in token_counts._exact("byte_bpe_50k.json").encode(text, add_special_tokens=False).offsets}
    inside = next(i for i in range(1, len(text)) if i not in ends)
    assert token_counts.count_between(text, inside, len(text), "byte_bpe_50k.json") is None
    frame = session.createDataFrame([(1, text + text)], "doc_id long, text string")
    got = token_counts.token_counts(frame, chunk=90, overlap=4).first()
    assert got["n_tokens"] == token_counts.count_tokens(text + text, "byte_bpe_50k.json")


def test_fast_counts_equal_the_tokenizer():
    rng = random.Random(2)
    name = "byte_bpe_50k.json"
    letters = [chr(i) for i in range(0x250)]
    for n in range(6000):
        t = "".join(rng.choice(letters if n % 2 else "ab c'sdlmrvt !?9É\t\n") for _ in range(rng.randint(0, 14)))
        assert token_counts.count_tokens(t, name) == len(token_counts._exact(name).encode(t, add_special_tokens=False).ids), repr(t)


# op10 ----------------------------------------------------------------------------------


def removed(docs, k):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            window = tuple(w[s : s + k])
            if window in seen:
                gone[s : s + k] = [True] * k
            seen.add(window)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize(("k", "m"), [(20, 6), (5, 2)])
def test_substring_dedup(session, empty, k, m):
    rng = random.Random(6)
    passage = prose(rng, 70)
    docs = [(i, t) for i, t, *_ in odd_documents() if i is not None][:-2]
    docs += [(200 + i, " ".join([prose(rng, rng.randint(0, 15)), passage[rng.randint(0, 60) :], prose(rng, rng.randint(0, 15))])) for i in range(40)]
    docs += [(300, "a b c " * 60), (301, "c a b " * 60), (302, "z " * 200)]
    frame = session.createDataFrame(rows_of(docs), SCHEMA).repartition(4)
    got = substring_dedup.dedup_windows(frame, k, m).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == removed(docs, k)
    assert substring_dedup.dedup_windows(empty).count() == 0


def test_substring_dedup_of_repeated_ids(session):
    t = prose(random.Random(9), 60)
    frame = session.createDataFrame(rows_of([(1, t), (1, t), (2, t), (None, t), (3, "other " + t), (3, "text " + t)]), SCHEMA)
    got = Counter((r["doc_id"], r["n_removed"] > 0) for r in substring_dedup.dedup_windows(frame).collect())
    assert got == Counter({(None, False): 1, (1, True): 2, (2, True): 1, (3, True): 2})
