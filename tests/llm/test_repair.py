"""Conversation repair against exhaustive search and plain Python."""

import hashlib
import itertools
import re
import zlib

import pytest

from eventlens.llm.queries import QUERIES
from eventlens.llm.repair import Repair, Repairer, StackAutomaton, apply_repairs, damaged, repair_plan, repair_report

from .data import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def exhaustive(rows):
    """Least (cost, audit) and output over all edits: a dictionary of whole outputs, no parser."""
    best = {"": (0, "")}

    def put(into, out, value):
        if value < into.get(out, (10**9,)):
            into[out] = value

    def grown(now):
        for _ in range(3):
            for out, (cost, audit) in list(now.items()):
                for r in "ua":
                    put(now, out + r, (cost + 2, audit + "I"))
        return now

    for initial, fault in rows:
        new = {}
        more = fault == "truncated"
        for out, (cost, audit) in grown(best).items():
            put(new, out, (cost + 3, audit + "D"))
            if fault != "delete":
                put(new, out + (initial or "?"), (cost + more, audit + "K"))
                for r in "ua":
                    put(new, out + r, (cost + 2 + more, audit + "R"))
        best = {o: v for o, v in new.items() if re.fullmatch(r"(s?(ua)*u?)?", o)}
    return min((*v, o) for o, v in grown(best).items() if re.fullmatch(r"(s?(ua)+)?", o))


def test_edits_equal_exhaustive_search():
    repairer = Repairer()
    kinds = [("u", ""), ("a", ""), ("s", ""), ("x", ""), ("u", "truncated"), ("a", "delete"), ("", "")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n) if n < 3 else itertools.islice(itertools.product(kinds, repeat=n), 0, None, 3 ** (n - 2)):
            repair = Repair(repairer)
            for row in rows:
                repair.add(*row)
            cost, audit, roles = repair.finish()
            assert (cost, audit, roles.replace("-", "")) == exhaustive(rows), rows


def test_long_conversations_and_other_grammars():
    repair = Repair(Repairer())
    for i in range(50_000):
        repair.add("uau"[i % 3], "")
    cost, audit, roles = repair.finish()
    assert re.fullmatch("(ua)+", roles.replace("-", "")) and len(audit) - audit.count("I") == 50_000
    assert cost == 2 * audit.count("R") + 3 * audit.count("D") + 2 * audit.count("I")
    # nested brackets: stacks of any height, shifts against reductions
    parser = StackAutomaton((("S", ""), ("S", "T"), ("T", "TP"), ("T", "P"), ("P", "ab"), ("P", "aTb")))
    for word in ("", "ab", "aabb", "abab", "aab", "ba", "aabbab"):
        now = set(parser.start)
        for c in word:
            now = {t for s in now for t in parser.after(s, c)}
        depth = list(itertools.accumulate((1 if c == "a" else -1 for c in word), initial=0))
        assert any(parser.accepting.get(s) for s in now) == (depth[-1] == 0 and min(depth) == 0), word


def plain(conversations):
    """The report in plain Python: per state of the alternation, the least (cost, audit) with whole strings."""
    convs = {}
    for c, t, role, text in conversations:
        here = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here.extend([(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.rstrip(BLANK)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        # states: "" start, s, u, e (after a whole pair)
        moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("e", "u"): "u", ("u", "a"): "e"}
        best = {"": (0, "", ())}

        def put(into, state, value):
            if state is not None and value[:2] < into.get(state, (10**9,))[:2]:
                into[state] = value

        def inserted(now):
            now = dict(now)
            for _ in range(3):
                for state, (cost, audit, kept) in list(now.items()):
                    for name in ("user", "assistant"):
                        put(now, moves.get((state, name[0])), (cost + 2, audit + "I", (*kept, (name, ""))))
            return now

        for (_, role, text), fault in zip(rows, faults, strict=True):
            new, more = {}, fault == "truncated"
            for state, (cost, audit, kept) in inserted(best).items():
                put(new, state, (cost + 3, audit + "D", kept))
                if fault not in ("blank", "duplicate"):
                    put(new, moves.get((state, role[:1])), (cost + more, audit + "K", (*kept, (role, text))))
                    for name in ("user", "assistant"):
                        put(new, moves.get((state, name[0])), (cost + 2 + more, audit + "R", (*kept, (name, text))))
            best = new
        cost, audit, kept = min(v for s, v in inserted(best).items() if s in ("", "e"))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_whole_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(QUERIES["op11_stack_repair"](spark, sf))
    assert got == plain(rows)
    assert len({audit for *_, audit, _ in got.values()}) > 10


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (1, None, "assistant", "b?"), (1, None, None, ""), (1, 5, "system", None),
        (2, 0, "system", "x."), (2, 0, "system", "x."), (2, 1, "", "role is empty."), (2, 2, "assistant", "long " * 100_000 + "."), (3, 3, "Übung", "é !"), (3, 4, "user", "　"),
        *[(4, t, "user" if t % 2 else "assistant", f"{t}." if t % 5 else "same.") for t in range(60)], *[(c, 0, "user", "hot line.") for c in range(10, 40)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(repair_report(df)) == plain(rows)
    clash = df.selectExpr("*", "1 as audit", "2 as cost", "'x' as roles", "true as dropped", "9 as position")
    assert found(repair_report(clash)) == plain(rows)
    assert repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows_follow_the_grammar(spark):
    rows = damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    repaired = apply_repairs(rows, repair_plan(rows)).collect()
    by = {}
    for r in sorted(repaired, key=lambda r: (r.conv_id, r.position)):
        by.setdefault(r.conv_id, []).append(r)
        assert r.edit != "I" or r.text == ""
    for rs in by.values():
        assert [r.position for r in rs] == list(range(len(rs)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in rs))
