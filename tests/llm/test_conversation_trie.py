"""The prefix trie against plain Python that looks at every prefix of every conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import conversation_trie as T
from quern.llm.conversation_trie import TURN, Run, conversation_trie, merged, nodes_of_range, shared, whole_nodes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    members = defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns) == d))
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ms) - 1) * (p[-1][1] if p else 0)
    least = {p: min(c for c, _ in ms) for p, ms in members.items()}
    return sorted(
        (least[p], len(p), least[p[:-1]] if p else -(10**9), len(ms), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c, end in sorted(ms) if end).encode()).hexdigest())
        for p, ms in members.items()
    )


def got(df):
    return sorted(tuple(r[c] if r[c] is not None else -(10**9) for c in COLUMNS) for r in df.select(COLUMNS).collect())


def conversations(n, seed, texts=3, longest=6):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(longest)):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["user", "assistant", None]), r.choice([None, "", " two\twords ", *(f"text {k} of some" for k in range(texts))])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, b"own", 1) for x in rows], SCHEMA + ", digest binary, part int").repartition(5)


def test_random_conversations(spark):
    for n, seed, texts, size in ((60, 1, 1, 16_000_000), (300, 2, 3, 300), (300, 3, 1, 2000)):
        rows = conversations(n, seed, texts)
        turns = frame(spark, rows)
        convs = T.regrafted(T.sequences(turns))
        assert got(T.trie(convs, size)) == brute(rows)


def test_contract_columns(spark):
    out = conversation_trie(frame(spark, conversations(30, 4)))
    assert out.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]


def test_hot_copies_first_turns_and_long_conversations(spark, monkeypatch):
    """A third of all conversations are copies of one, a third begin alike; ranges cut between them."""
    monkeypatch.setattr(T, "ENDS", 7)
    r = random.Random(5)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 400) for t in range(4)]
    rows += [(c, t, "user", f"begins {t if t < 1 else r.randrange(99)}") for c in range(1000, 1400) for t in range(3)]
    rows += [(c, t, "user", f"own {c} {r.random()}") for c in range(-300, -100) for t in range(2)]
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(150)] + [(5001, t, "user", f"long {t % 7}") for t in range(149)]
    rows += [(c, 0, "user", "alone") for c in range(9000, 9050)] + [(None, 0, "user", "nobody's")] * 3
    assert got(T.trie(T.regrafted(T.sequences(frame(spark, rows))), 3000)) == brute(rows)


def test_empty_and_turnless(spark):
    assert conversation_trie(frame(spark, []).limit(0)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    rows = [(c, 0, "user", None) for c in range(1, 20)]  # the head is absent: some have no turns
    assert any(not v for v in rebuilt(rows).values())
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def entries(paths, first=0):
    return [(b"".join(bytes([x]) * TURN for x in p), c, [1] * len(p)) for c, p in enumerate(paths, first)]


PATHS = st.lists(st.lists(st.integers(0, 2), max_size=5), max_size=40)


@settings(max_examples=300, deadline=None)
@given(PATHS, st.integers(1, 9))
def test_merge_of_runs(paths, k):
    some = entries(paths)
    out = list(merged([Run(some[i::k]) for i in range(k)]))
    want = sorted(some, key=lambda e: e[:2])
    assert [e for e, _ in out] == want
    assert [n for _, n in out[1:]] == [shared(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]


def test_shared_turns_are_not_compared_again(monkeypatch):
    """Runs of sequences with a long common beginning: each turn of it is compared a few times, not once a comparison."""
    seen = []

    def counting(a, b, at=0):
        n = shared(a, b, at)
        seen.append(n - at + 1)
        return n

    monkeypatch.setattr(T, "shared", counting)
    some = entries([[9] * 200 + [i % 5, i // 5] for i in range(200)])
    runs = [Run(some[i::16]) for i in range(16)]
    seen.clear()
    assert [e for e, _ in merged(runs)] == sorted(some, key=lambda e: e[:2])
    assert sum(seen) < 16 * 201 + 5 * 4 * 200  # without LCPs: 800 comparisons of 200 turns


@settings(max_examples=300, deadline=None)
@given(PATHS, st.lists(st.integers(0, 40), max_size=5))
def test_cuts_anywhere_change_nothing(paths, cuts):
    """Ranges of any size give the nodes that one range gives."""
    order = sorted(entries(paths), key=lambda e: e[:2])

    def nodes(bounds):
        rows = []
        for part, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(order)], strict=True)):
            rows += list(nodes_of_range(merged([Run(order[a:b][i::2]) for i in range(2)]), part))
        open_rows = sorted((r for r in rows if r[0] == T.OPEN), key=lambda r: r[1:4])
        wholes = list(whole_nodes(iter(open_rows)))
        ids = {w[3]: w[5] for w in wholes if w[0] == T.WHOLE}
        links = {w[1:3]: ids[w[3]] for w in wholes if w[0] == T.LINK}
        out = [(r[4], r[5], r[6] if r[0] == T.NODE else links[r[1:3]], *r[7:11], r[13]) for r in rows if r[0] != T.OPEN]
        return sorted((*x[:2], -1 if x[2] is None else x[2], *x[3:]) for x in out + [(w[5], w[6], ids.get(w[4]), *w[7:]) for w in wholes if w[0] == T.WHOLE])

    assert nodes(sorted(min(c, len(order)) for c in cuts)) == nodes([])
