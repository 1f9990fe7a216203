import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from palimpsest.llm import queries, repair

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("piece", T.DoubleType()), T.StructField("a.b", T.StringType()),
])


def table_by_table(letters, start=0, ends=repair.ENDS):
    """The cheapest, then least, edits by filling the whole lattice row by row."""
    label = {(0, start): (0, "")}

    def offer(node, value):
        if node not in label or value < label[node]:
            label[node] = value

    for i in range(len(letters) + 1):
        for _ in range(4):
            for s in repair.STATES:
                if (i, s) in label:
                    offer((i, repair.NEXT[s]), (label[i, s][0] + 2, label[i, s][1] + "I"))
        if i < len(letters):
            initial, fault = divmod(ord(letters[i]) - 65, 4)
            for s in repair.STATES:
                if (i, s) not in label:
                    continue
                cost, audit = label[i, s]
                offer((i + 1, s), (cost + 3, audit + "D"))
                if fault >= 2:
                    continue
                more = int(fault == 1)
                offer((i + 1, repair.NEXT[s]), (cost + 2 + more, audit + "R"))
                if "sua?"[initial] == "uuau"[s]:
                    offer((i + 1, repair.NEXT[s]), (cost + more, audit + "K"))
                if initial == 0 and s == 0:
                    offer((i + 1, 1), (cost + more, audit + "K"))
    return min((label[len(letters), e] for e in ends if (len(letters), e) in label), default=None)


def words(seed, n, most):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(chr(65 + rng.randrange(16)) if rng.random() < 0.6 else rng.choice("AEIEI") for _ in range(rng.randint(0, most)))


def test_search_finds_the_least_audit_of_the_least_cost():
    rng = random.Random(1)
    for w in words(2, 3000, 14):
        start, ends = rng.choice([0, 0, 1, 2, 3]), rng.choice([(0, 3), (0, 3), (0,), (1,), (2,), (3,)])
        assert repair.search(w, start, ends) == table_by_table(w, start, ends), (w, start, ends)


def test_blocks_join_to_the_same_audit():
    rng = random.Random(3)
    for w in words(4, 500, 30):
        cuts = sorted({0, len(w), *[rng.randint(0, len(w)) for _ in range(4)]})
        cost, audits, states = repair.repair([w[a:b] for a, b in zip(cuts, cuts[1:])] or [w])
        assert (cost, "".join(audits)) == table_by_table(w)
        assert states[0] == 0


WS = " \t\n\x0b\x0c\r"


def brute(rows):
    """The contract, row by row in Python."""
    conv = defaultdict(list)
    for r in rows:
        c, t = r[0], r[1]
        role, text = " " if r[2] is None else r[2], " " if r[3] is None else r[3]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        held = conv[c]
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        held += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = Counter()
    for c, held in conv.items():
        held.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        letters, seen = "", set()
        for _, _, role, text in held:
            bare = text.strip(WS)
            bare = "".join(x for x in bare if x not in WS)
            fault = 2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1
            seen.add((role, text))
            initial = "sua".find(role[0]) if role and role[0] in "sua" else 3
            letters += chr(65 + 4 * initial + fault)
        cost, audit = table_by_table(letters)
        done, rest, state = [], iter(held), "0"
        for edit in audit:
            want, after = {"0": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}[state]
            row = next(rest) if edit != "I" else None
            if edit == "D":
                continue
            if edit == "K":
                after = row[2][0]
            done.append({"I": f"{want}:", "R": f"{want}:{row and row[3]}", "K": f"{row and row[2]}:{row and row[3]}"}[edit])
            state = after
        turns = [r[1] for r in held if r[0]]
        initials = [r[2][:1] for r in held]
        out[
            c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum((ord(x) - 65) % 4 == f for x in letters) for f in (2, 3, 1)],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(done).encode()).hexdigest(),
        ] += 1
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(7)
    out = []
    for c in range(80):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "assistant"]) if rng.random() < 0.3 else "user" if t % 2 == 0 else "assistant"
            text = rng.choice(["Yes.", "no", " \n", "", "Ça va ?", "What! ", "x" * 50 + ".", None, "."]) if rng.random() < 0.5 else f"Text {c} {t}."
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 2])
            out.append((c, turn, rng.choice([None, "", "User", "usher"]) if rng.random() < 0.08 else role, text, "s", 0.5, None))
    out += [(None, 0, "user", "No id.", None, None, None), (None, None, None, None, None, None, None), (900, 1, "user", "long " * 40000, "", 0.0, "")]
    for t in range(300):  # a long conversation with repeated rows and ties
        out += [(901, t // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", f"d{t}."]), None, None, None)] * rng.choice([1, 1, 2])
    dropped = [c for c in range(1000, 1400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    out += [(c, 0, "user", "All rows go.", None, None, None) for c in dropped]
    return out


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("block", [1 << 10, 4])
def test_equals_brute_force(spark, talks, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = spark.createDataFrame(talks, SCHEMA).repartition(3)
    assert found(repair.damaged_and_repaired(rows)) == brute(talks)


def test_sql_says_the_same(spark, talks):
    few = [r for r in talks if r[0] != 901]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in few])
    cur = con.execute(queries.OP11_SQL)
    at = [[d[0] for d in cur.description].index(c) for c in COLUMNS]
    assert Counter(tuple(r[i] for i in at) for r in cur.fetchall()) == found(repair.damaged_and_repaired(spark.createDataFrame(few, SCHEMA)))


def test_without_damage_and_without_rows(spark):
    rows = [(1, 0, "system", "S.", "", 0.0, ""), (1, 1, "user", "Q?", "", 0.0, ""), (1, 2, "assistant", "A.", "", 0.0, "")]
    got = found(repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)))
    want = hashlib.sha256(b"system:S.\nuser:Q?\nassistant:A.").hexdigest()
    assert got == Counter([(1, 0, 0, 0, 0, 0, 0, "KKK", want)])
    assert repair.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0
