"""Conversation repair against all sequences of edits, its audits as plain strings, and literal faults."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import repair as R

EMPTY = hashlib.sha256(b"").hexdigest()
GOOD = re.compile("(s?(ua)+)?")


def faults(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(R.SPACES)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(rows, most_inserts=2):
    """The cheapest edits by trying all of them, with up to ``most_inserts`` insertions at each place."""
    rows = faults(rows)
    gaps = [g for n in range(most_inserts + 1) for g in itertools.product("ua", repeat=n)]
    best = None

    def walk(i, cost, audit, left):
        nonlocal best
        if best and cost > best[0]:
            return
        initials = "".join(r[:1] for r, _ in left)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            return
        if i % 2 == 0:
            for g in gaps:
                walk(i + 1, cost + 2 * len(g), audit + "I" * len(g), left + [("user" if x == "u" else "assistant", "") for x in g])
            return
        if i // 2 == len(rows):
            if GOOD.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, left)
            return
        role, text, fault = rows[i // 2]
        walk(i + 1, cost + 3, audit + "D", left)
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            walk(i + 1, cost + more, audit + "K", left + [(role, text)])
            for new in ("user", "assistant"):
                walk(i + 1, cost + 2 + more, audit + "R", left + [(new, text)])

    walk(0, 0, "", [])
    cost, audit, left = best
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def table_of_all(rows):
    """The same by a table of whole strings from the end, which holds for any length."""
    rows = faults(rows)
    ways = {s: (0, "", []) if s in R._COMPLETE else None for s in range(4)}

    def insert(ways):
        for _ in range(4):
            for s in range(4):
                after = ways[R._NEXT[s, R._WANTED[s]]]
                if after:
                    new = (after[0] + 2, "I" + after[1], [(R._NAME[R._WANTED[s]], ""), *after[2]])
                    ways[s] = min(ways[s], new) if ways[s] else new
        return ways

    ways = insert(ways)
    for role, text, fault in reversed(rows):
        now = {}
        for s in range(4):
            options = [(ways[s][0] + 3, "D" + ways[s][1], ways[s][2])] if ways[s] else []
            if fault not in ("blank", "duplicate"):
                for letter, cost, name in (("K", 0, role), ("R", 2, R._NAME[R._WANTED[s]])):
                    after = ways.get(R._NEXT.get((s, name[:1])) if name else s)
                    if after:
                        options.append((after[0] + cost + (fault == "truncated"), letter + after[1], [(name, text), *after[2]]))
            now[s] = min(options) if options else None
        ways = insert(now)
    cost, audit, left = ways[0]
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def run(rows):
    conversation = R.Conversation()
    for i, (role, text) in enumerate(rows):
        conversation.read(i, role, text.encode())
    got = conversation.result()
    return got["cost"], got["audit"], got["repaired_sha256"]


ROLES = st.sampled_from(["user", "assistant", "system", " ", "u", ""])
TEXTS = st.sampled_from(["Yes.", "No", "", " ", "Why?", "é", "Oh!\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=4))
def test_equals_all_edits(rows):
    assert run(rows) == plain(rows) == table_of_all(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, st.text("ab.", max_size=3)), max_size=60))
def test_equals_whole_strings(rows):
    assert run(rows) == table_of_all(rows)


@settings(max_examples=100, deadline=None)
@given(st.text("DIKR", max_size=70), st.text("DIKR", max_size=70), st.integers(0, 40))
def test_order_of_audits(a, b, shared):
    root = R.Node("", None)
    for letter in a[:shared]:
        root = R.Node(letter, root)
    x = y = root
    for letter in a[shared:]:
        x = R.Node(letter, x)
    for letter in b:
        y = R.Node(letter, y)
    a, b = a, a[:shared] + b
    assert (x.letters(), y.letters()) == (a, b)
    assert R.before(x, y) == (a < b)
    assert R.common(x, y) == len(next((a[:n] for n in range(min(len(a), len(b)), -1, -1) if a[:n] == b[:n])))
    assert all(x.at(n).letters() == a[:n] for n in range(len(a) + 1))


def test_collisions_decide_nothing(monkeypatch):
    monkeypatch.setattr(R, "_PRIME", 1)  # every hash is 0
    rows = [(r, t) for r in ("user", "system", "assistant") for t in ("a.", "b", "c.")] * 3
    assert run(rows) == table_of_all(rows)


def brute(rows):
    """The contract over (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    sp = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = "user" if k == 4 else sp(role), "" if k == 1 else re.sub("[.!?]", "", sp(text)) if k == 2 else sp(text)
        convs[conv] += [] if k == 0 else [(turn, role, text)] * (1 + (k == 3))
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds = [f for _, _, f in faults([r[1:] for r in mine])]
        turns = [r[0] for r in mine if r[0] is not None]
        pairs = ["".join(x[1][:1] for x in p) for p in itertools.pairwise(mine)]
        cost, audit, sha = table_of_all([r[1:] for r in mine])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha,
        )
    return out


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_damage_and_edges(spark):
    long = "word " * 200_000
    rows = [(c, t, ("system", "user", "assistant")[(t + (c % 3 > 0)) % 3] if t == 0 else ("assistant", "user")[t % 2], f"Said {t}.")
            for c in range(60) for t in range(c % 9)]
    rows += [(100, None, None, None), (100, None, "user", "Hi."), (100, 3, "assistant", None), (100, 3, "user", "Hi."), (100, 7, "", "")]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes"), (-5, 2, "user", long), (-5, 3, "assistant", long + "!")]
    rows += [(200, 1, "user", "Same.")] * 4 + [(201, None, "x", "y")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, live string").drop("live")
    assert result(R.repair(R.damaged(df.selectExpr("*", "1 AS fault", "2 AS copy")))) == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damaged(df)).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "x", False)], "conv_id long, turn long, role string, text string, live boolean")
    assert result(R.repair(gone)) == {1: (0, 0, 0, 0, 0, 0, "", EMPTY)}


@pytest.mark.parametrize("rows, audit", [
    ([("user", "A."), ("assistant", "B.")], "KK"),
    ([("system", "A.")], "D"),
    ([("assistant", "A.")], "IK"),
    ([("system", "S."), ("user", "A."), ("user", "B."), ("assistant", "C.")], "KKIKK"),
    ([("user", "A."), ("system", "S."), ("assistant", "")], "KRD"),
])
def test_literal(rows, audit):
    assert run(rows)[1] == table_of_all(rows)[1] == audit


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(R.op11(spark, sf)) == brute(rows)
