"""The prefix trie against plain dictionaries, and the Z-fast trie against all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    """conv_id -> its rebuilt turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(own.get(first, [])[:h] + turns[h:])
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * words(node[-1][1]) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(kids[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n in members
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def trie(spark, rows, **limits):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", d int")
    return P.prefix_trie(P.rebuilt(P.own_turns(df)), P.Limits(**limits))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2000), st.integers(1, 2000))
def test_two_fattest(a, more):
    b = a + more
    want = max(range(a + 1, b + 1), key=lambda x: x & -x)
    assert P.two_fattest(a, b) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14), max_size=25))
def test_z_fast(sequences):
    z = P.ZFast()
    seen = set()
    for s in sequences:
        path = P.prefixes(s)
        shared = max(d for d in range(len(path)) if d == 0 or path[d] in seen)
        at, length = z.exit(path)
        assert length == shared
        node = z.nodes[z.insert(path)]
        assert node.length == len(s) and z.paths[node.of][node.length] == path[-1]
        seen |= set(path)
    names = [z.paths[node.of][depth] for node, depth in z.expanded()]
    assert len(names) == len(set(names)) and set(names) == seen | {P.ROOT}


def test_few_lookups():
    z = P.ZFast()
    long = [b"%d" % i for i in range(4096)]
    z.insert(P.prefixes(long))
    z.looked = 0
    assert z.exit(P.prefixes(long[:3000] + [b"x"]))[1] == 3000
    assert z.looked <= 12


def test_against_dictionaries(spark):
    draw = random.Random(3)
    rows = []
    for c in range(-41, 160, 1):
        same = c % 7 == 0
        for t in range(draw.choice([0, 1, 3, 6])):
            said = f"turn {t}" if same else draw.choice(["Yes.", "no it\tis", "", "why not", None])
            rows.append((c, draw.choice([t, t, t, None, 0]), draw.choice(["user", "assistant", None, ""]) if not same else "user", said))
    rows += [(500, i, "user", f"word {i}") for i in range(700)] + [(501, i, "user", f"word {i}") for i in range(699)]
    rows += [(900, 0, "user", "long " * 200_000), (None, 0, "user", "x"), (7, 1, "user", "again"), (7, 1, "user", "again")]
    want = plain(rebuild(rows))
    assert got(trie(spark, rows)) == want
    assert got(trie(spark, rows, most_turns=5)) == want


def test_copies_and_no_turns(spark):
    rows = [(c, t, "user", f"the same {t}") for c in range(1000, 1300) for t in range(5)]
    rows += [(c, 0, "user", "one") for c in range(2001, 2020)]
    convs = rebuild(rows)
    assert () in convs.values()
    assert got(trie(spark, rows)) == plain(convs)


def test_no_rows(spark):
    assert got(trie(spark, [])) == []


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(P.op13(spark, sf)) == plain(rebuild(rows))
