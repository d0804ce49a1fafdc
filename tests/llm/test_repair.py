import hashlib
import itertools
import random
import re
import zlib

import pytest

from callmetrics.llm import q_repair, repair

SCHEMA = "conv_id long, turn long, role string, text string, at string, cost int"
CODES = ["I" * n + e for n in range(3) for e in "DKR"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def fault_of(turns):
    seen, made = set(), []
    for role, text in turns:
        kept = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        made.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return made


def apply(turns, codes, tail):
    """The repaired turns of a choice of edits, or None if its roles are not allowed."""
    items = []
    for (role, text), code in zip(turns, codes):
        items += [("I", None, "")] * (len(code) - 1) + ([] if code[-1] == "D" else [(code[-1], role, text)])
    items += [("I", None, "")] * len(tail)
    lead = len(items) % 2
    made = [(edit, role if edit == "K" else ("user", "assistant")[(i - lead) % 2] if i >= lead else "", text) for i, (edit, role, text) in enumerate(items)]
    return made if re.fullmatch("(s?(ua)+)?", "".join((role or "-")[0] for _, role, _ in made)) else None


def all_ways(turns):
    """(cost, audit, repaired) by trying everything."""
    faults, found = fault_of(turns), []
    choices = [[c for c in CODES if c[-1] == "D" or f in ("", "truncated")] for f in faults]
    for codes in itertools.product(*choices):
        cost = sum(2 * (len(c) - 1) + {"D": 3, "K": 0, "R": 2}[c[-1]] + (c[-1] != "D" and f == "truncated") for c, f in zip(codes, faults))
        for tail in ("", "I", "II"):
            if (made := apply(turns, codes, tail)) is not None:
                found.append((cost + 2 * len(tail), "".join(codes) + tail, [(r, t) for _, r, t in made]))
    return min(found, key=lambda x: x[:2])


def random_turns(rng, most):
    pick = lambda *x: rng.choice(x)
    return [(pick("system", "user", "user", "assistant", "assistant", "tool", ""), pick("a.", "b!", "c", " \n", "", "d? ", "e", "f.")) for _ in range(rng.randrange(1, most))]


def collected(spark, convs, bits=None):
    rows = [(c, t, *turn, "x", 1) for c, turns in convs.items() for t, turn in enumerate(turns)]
    repaired, audits = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))
    texts = {}
    for r in repaired.orderBy("conv_id", "place").collect():
        assert r.place == len(texts.setdefault(r.conv_id, []))
        texts[r.conv_id].append((r.role, r.text))
    return texts, {r.conv_id: r for r in audits.collect()}


@pytest.mark.parametrize(("seed", "bits"), [(1, 12), (2, 1)])
def test_against_all_ways(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rng = random.Random(seed)
    convs = {c: random_turns(rng, 6) for c in range(50)}
    texts, audits = collected(spark, convs)
    for c, turns in convs.items():
        cost, audit, made = all_ways(turns)
        got = audits[c]
        assert (got.cost, got.audit, texts.get(c, [])) == (cost, audit, made), turns
        faults = fault_of(turns)
        assert (got.blank, got.duplicate, got.truncated, got.gaps) == (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), 0)
        assert got.illegal == sum((a[0] or "-")[0] + (b[0] or "-")[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))


def test_composition_equals_one_run():
    rng = random.Random(5)
    for _ in range(200):
        kinds = [rng.randrange(16) for _ in range(rng.randrange(1, 30))]
        whole = [repair.run_layers(kinds, e) for e in range(4)]
        at = rng.randrange(len(kinds) + 1)
        parts = [p for p in (kinds[:at], kinds[at:]) if p]
        matrices = [tuple([x for e in range(4) for x in repair.run_layers(p, e)[i]] for i in (0, 1)) for p in parts]
        one = repair.compose([tuple([x for w in whole for x in w[i]] for i in (0, 1))])
        cost, states, tail = repair.compose(matrices)
        audit = "".join("".join(repair.codes_of(p, *s)) for p, s in zip(parts, states)) + tail
        assert (cost, audit) == (one[0], "".join(repair.codes_of(kinds, *one[1][0])) + one[2])


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 6)
    turns = [(("user", "assistant")[t % 2], f"turn {t}.") for t in range(1_000)]
    texts, audits = collected(spark, {1: turns, 2: turns[1:], 3: [("user", "x " * 100_000 + ".")]})
    assert (audits[1].cost, audits[1].audit, texts[1]) == (0, "K" * 1_000, turns)
    # 999 turns from an assistant's on: deleting the first leaves 998 and costs 3, inserting before it costs 2
    assert (audits[2].cost, audits[2].audit) == (2, "I" + "K" * 999) and texts[2][0] == ("user", "")
    assert (audits[3].cost, audits[3].audit) == (2, "KI")


def test_nulls_ties_gaps_and_empty(spark):
    rows = [
        (1, None, "user", "a."), (1, 3, "assistant", "b."), (1, 7, "user", "c."), (1, 7, "user", "c."), (1, 7, "assistant", "d."),
        (2, None, None, None), (2, None, None, "x."), (None, 0, "user", "y."),
    ]
    repaired, audits = repair.repair(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), " ")
    got = {r.conv_id: r for r in audits.collect()}
    assert set(got) == {1, 2} and (got[1].gaps, got[1].duplicate, got[2].gaps, got[2].blank) == (3, 1, 0, 1)
    tied = sorted([("user", "c."), ("user", "c."), ("assistant", "d.")], key=lambda t: digest(*t))
    assert got[1].audit == all_ways([("user", "a."), ("assistant", "b."), *tied])[1]
    none = repair.repair(spark.createDataFrame([], SCHEMA))
    assert none[0].count() == 0 and none[1].count() == 0


def test_query_damages_and_digests(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, role, text + f" {c % 3}.") for c in range(60) for t, (role, text) in enumerate(random_turns(rng, 4))] + [(1_000 + i, 0, None, None) for i in range(30)]
    spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in q_repair.op12_structure_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    dropped = 0
    for c in got:
        turns = []
        for conv, t, role, text in rows:
            if conv == c and (kind := zlib.crc32(f"{c}:{t}".encode()) % 20):
                role, text = " " if role is None else role, " " if text is None else text
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                turns += [("user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        if not turns:
            dropped += 1
            want = (0, "", "")
        else:
            cost, audit, made = all_ways(turns)
            want = (cost, audit, "\n".join(f"{r}:{t}" for r, t in made))
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (*want[:2], hashlib.sha256(want[2].encode()).hexdigest())
    assert dropped
