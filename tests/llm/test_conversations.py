"""Packing, the conversation trie and conversation repair against brute force, with nulls, ties, repeated rows and odd columns."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from specto.llm import packing, repair, trie
from specto.llm import queries as registered

TURNS = "conv_id long, turn long, role string, text string, digest string, n string"
random.seed(5)


def talk(conv, size, pool):
    """A conversation whose turns come from a small pool, so that prefixes are shared."""
    return [(conv, t, random.choice(["user", "assistant", "system", "tool", "assistant"]) if pool else ("user", "assistant")[t % 2], random.choice(["Yes.", "No", "", "  ", "Why? ", "Été. 😀", f"t{random.randrange(pool or 1)}."])) for t in range(size)]


ROWS = [r for c in range(150) for r in talk(c, random.choice([0, 1, 2, 3, 5, 8]), c % 3)]
ROWS += [r for c in (-205, -200, -1, 100000, 100001) for r in talk(c, 7, 2)]
ROWS += [(300 + c, t, "user", f"same {t}") for c in range(40) for t in range(9)]  # copies, and prefixes of one another
ROWS += [(360, t, "user" if t % 2 else "assistant", f"long {t}.") for t in range(300)]
ROWS += [(400, None, None, None), (400, None, "user", "x."), (400, 3, "", "y"), (400, 3, "", "y"), (401, 5, "user", "Hi."), (401, 5, "user", "Hi."), (None, 1, "user", "lost."), (None, None, "assistant", None)]
ROWS = [(*r, "clash", "clash") for r in ROWS]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ROWS, TURNS)


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def order(turn):
    return (turn is not None, turn or 0)


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((order(turn), md5(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(int(c / 100) * 100, [])[:h] + v[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
        saved[k] = sum(saved[x] for x in below[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(whole[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_in_a_shard", [1, 3, 50, 10000])
def test_trie(spark, turns, rows_in_a_shard):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows_in_a_shard)
    try:
        got = sorted((tuple(r) for r in trie.op12_conversation_trie(turns).collect()), key=str)
    finally:
        spark.conf.set(key, before)
    assert got == brute_trie(ROWS)


def test_trie_small(spark, turns):
    assert trie.op12_conversation_trie(turns.limit(0)).count() == 0
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)  # it has no base, and its only turn is among the first ones
    one = trie.op12_conversation_trie(spark.createDataFrame([(c, 0, "user", "a")], "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves) for r in one] == [(c, 0, 1, 0, 1)]
    assert one[0].ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()
    twice = trie.op12_conversation_trie(turns.unionByName(turns))
    assert sorted(map(tuple, twice.collect()), key=str) == brute_trie(ROWS + ROWS)


def test_many_members(spark):
    """One node with more members than a chunk, and negative ids."""
    rows = [(c, 0, "user", "x") for c in range(-1500, 3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.op12_conversation_trie(turns).collect()), key=str) == brute_trie(rows)


def test_sparse_table():
    import numpy as np

    for n in (1, 2, 7, 30):
        values = np.array([-1, *(random.randrange(4) for _ in range(n - 1))])
        table = trie.SparseTable(values)
        at, depth = map(np.array, zip(*itertools.product(range(n), range(5)), strict=True))
        right = [max(r for r in range(a, n) if all(v >= d for v in values[a + 1 : r + 1])) for a, d in zip(at, depth, strict=True)]
        left = [min(b for b in range(a + 1) if all(v >= d for v in values[b + 1 : a + 1])) for a, d in zip(at, depth, strict=True)]
        assert table.right(at, depth).tolist() == right and table.left(at, depth).tolist() == left


def brute_repair(rows):
    """Shortest path over (rows read, state); states are the role initials so far, as the pattern sees them."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    todo = [(0, "", 0, "", ())]
    best = {}
    while todo:
        cost, audit, i, state, out = heapq.heappop(todo)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if any(c < cost or (c == cost and a <= audit and not audit.startswith(a)) for c, a in best.get((i, state), [])):
            continue
        best.setdefault((i, state), []).append((cost, audit))
        new = "assistant" if state == "u" else "user"
        if cost < 4 * len(rows):
            heapq.heappush(todo, (cost + 3, audit + "I", i, new[0], (*out, f"{new}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] in after[state]:
                    heapq.heappush(todo, (cost + extra, audit + "K", i + 1, after[state][role[0]], (*out, f"{role}:{text}")))
                heapq.heappush(todo, (cost + 3 + extra, audit + "R", i + 1, new[0], (*out, f"{new}:{text}")))


def damage(rows):
    """conv_id -> rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if k == 4 else role
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[c] += [(turn, role, text)] * ((k > 0) + (k == 3))
    return {c: sorted(v, key=lambda r: (order(r[0]), md5(*r[1:]))) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_repair(turns):
    got = {r.conv_id: r for r in repair.op13_conversation_repair(turns).collect()}
    want = damage(ROWS)
    assert set(got) == set(want) == {r[0] for r in ROWS}
    assert any(not v for v in want.values()) and None in got
    for c, rows in want.items():
        r, own = got[c], faults(rows)
        known = {t for t, *_ in rows if t is not None}
        initials = [role[:1] for role, *_ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        counts = [sum(f == x for *_, f in own) for x in ("blank", "duplicate", "truncated")]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal] == [max(known) - min(known) + 1 - len(known) if known else 0, *counts, illegal]
        if len(own) <= 12:
            cost, audit, lines = brute_repair(own)
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repaired_turns(turns):
    reports = {r.conv_id: r for r in repair.op13_conversation_repair(turns).collect()}
    rows = defaultdict(list)
    for r in sorted(repair.repaired_turns(repair.damaged(turns)).collect(), key=lambda r: r.ord):
        rows[r.conv_id].append(r)
    for c, report in reports.items():
        assert [r.ord for r in rows[c]] == list(range(len(rows[c])))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows[c]))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows[c]).encode()).hexdigest() == report.repaired_sha256
    assert repair.op13_conversation_repair(turns.limit(0)).count() == 0


def test_runs():
    """Every short string of symbols, and runs far longer than any string that a search could go through."""
    role, fault = "suax", ("", "truncated")
    for size in range(3):
        for symbols in itertools.product(range(9), repeat=size):
            rows = [("x", "t", "blank") if s == repair.GONE else (role[s % 4], "t", fault[s // 4]) for s in symbols]
            assert repair.cheapest(bytes(symbols)) == brute_repair(rows)[:2]
    cost, audit = repair.cheapest(bytes([repair.USER] * 20001))
    assert cost == 3 * 10001 and audit.count("D") + audit.count("R") + audit.count("I") < 20003
    assert repair.advance(repair.USER, 1000, (0,) * 4) == repair.advance(repair.USER, 400, repair.advance(repair.USER, 600, (0,) * 4))
    assert repair.cheapest(b"") == (0, "")


TEXTS = [None, "", " ", "a", "<|endoftext|> x<|endoftext|>", "naïve 😀 ́ it's we'll  \n\n x", "word " * 5000, "é" * 3000, "𝒳" * 700, "12345 " * 40] + ["the " * n + "ü" for n in (3, 30, 90, 300, 1000, 2046, 2047)] * 12


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(None if i == 3 else i % 70, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, start int").repartition(3)


def library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(texts):
    pieces = packing.pack(texts).collect()
    left = sorted(library_ids(t) for t in TEXTS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    found = []
    for (_, total), own in by_doc.items():
        own.sort(key=lambda p: p.start)
        starts = [p for p in own if p.start == 0]
        if len(starts) == 1:
            assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
            found.append([int.from_bytes(p.ids[j : j + 4], "little") for p in own for j in range(0, len(p.ids), 4)])
        assert sum(p.length for p in own) == total * len(starts)
    assert len(found) > 20 and all(f in left for f in found)
    assert sum(p.length for p in pieces) == sum(map(len, left))
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.02 * sum(map(len, left))
    for r, p in zip(sorted(packing.op11_packing(texts).collect(), key=str), sorted(pieces, key=str), strict=True):
        assert r.length > 0 and len(r) == 7
    crcs = sorted(r.ids_crc32 for r in packing.op11_packing(texts).collect())
    assert crcs == sorted(zlib.crc32(p.ids) for p in pieces)
    assert packing.pack(texts.limit(0)).count() == 0


def test_sequences(texts):
    packed = packing.pack(texts)
    rows = packing.sequences(packed, pad_id=50256).collect()
    total = 0
    for r in rows:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        full = r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 2048
        assert len(ids) == full and ids[r.n_tokens :] == [50256] * (full - r.n_tokens)
        assert r.starts[0] == 0 and len(r.starts) == len(r.doc_ids)
        total += r.n_tokens
    assert total == sum(len(library_ids(t)) for t in TEXTS)


def test_classes():
    """A class's size is a whole reciprocal of the capacity, and the cut lengths are whole numbers of such sizes, as few as can be."""
    sizes = {2048 // k for k in range(1, 2049)}
    found = packing.cuts(2048)
    two = {a + b for a in sizes for b in sizes}
    for r in range(1, 2048):
        assert sum(found[r]) == r and set(found[r]) <= sizes
        assert (len(found[r]) == 1) == (r in sizes) and (len(found[r]) == 2) == (r in two and r not in sizes)
    worker = packing.Worker(2048, 0)
    for i in range(3000):
        worker.add(i, b"\1\0\0\0" * random.choice([682, 409, 2048]))
    full = defaultdict(list)
    for _, _, n, _, _, sequence, _ in worker.done:
        full[sequence].append(n)
    assert all(len(set(v)) == 1 and len(v) == 2048 // v[0] for v in full.values())


def test_encoders():
    import public_tokenizers

    encode = packing.encoder(packing.default_path())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7 == 3]
    mixed = [f"a{c}b {c}1{c} .{c}." for c in points]
    assert [encode(t) for t in mixed] == [e.ids for e in library.encode_batch_fast(mixed, add_special_tokens=False)]
    for _ in range(300):
        text = "".join(random.choices("ab 'st\n\t.1é😀ſ́<|>", k=random.randrange(60)))
        assert encode(text) == library.encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(other)("Some words") == Tokenizer.from_file(other).encode("Some words", add_special_tokens=False).ids


def test_registered():
    assert {"op11_packing", "op12_conversation_trie", "op13_conversation_repair"} <= set(registered.QUERIES)
