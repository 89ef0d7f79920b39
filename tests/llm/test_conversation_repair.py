from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import duckdb
import pytest
from compare import connect, difference
from tuneledger.llm import conversation_repair as repair, queries

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, seen int, id int, fault string"


def made(spark, rows):
    """Conversations with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, True, 7, 7, "x") for r in rows], SCHEMA)


def walked(rows):
    walk, seen = repair.Walk(), set()
    for turn, role, text in rows:
        ink = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        walk.read(turn, role, text.encode(), fault)
    return walk.result()


def every_edit(rows):
    """Least (cost, audit, digest) over all edits, tried one by one."""
    judged, seen = [], set()
    for _, role, text in rows:
        ink = re.sub("[\x20\x09-\x0d]", "", text)
        judged.append((role, text, not ink or (role, text) in seen, bool(ink) and ink[-1] not in ".!?"))
        seen.add((role, text))
    per_row = [[c for c in ("D", *(() if gone else ("K", "Ruser", "Rassistant")))] for _, _, gone, _ in judged]
    inserts = ["", "Iuser", "Iassistant", "Iuser Iassistant", "Iassistant Iuser"]
    best = None
    for gaps in product(inserts, repeat=len(rows) + 1):
        for picks in product(*per_row):
            cost, audit, out = 0, "", []
            for k, gap in enumerate(gaps):
                for put in gap.split():
                    cost, audit = cost + 2, audit + "I"
                    out.append((put[1:], ""))
                if k < len(rows):
                    role, text, _, late = judged[k]
                    audit += picks[k][0]
                    cost += {"D": 3, "K": late, "R": 2 + late}[picks[k][0]]
                    if picks[k] != "D":
                        out.append((picks[k][1:] or role, text))
            if re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in out)):
                digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
                best = min(best or (99, "", ""), (cost, audit, digest))
    return best


def test_walk_against_every_edit():
    choose = random.Random(5)
    for _ in range(150):
        rows = [(k, choose.choice(("system", "user", "user", "assistant", "assistant", "tool", "")), choose.choice(("a.", "b", " ", "c!")))
                for k in range(choose.randint(0, 3))]
        assert walked(rows)[5:] == every_edit(rows), rows


def test_digits_written_early_change_nothing(monkeypatch):
    choose = random.Random(6)
    for n in (1, 40, 300):
        rows = [(k, choose.choice(("system", "user", "assistant", "tool")), choose.choice(("", f"{k}.", f"{k}", "same.")))
                for k in range(n)]
        monkeypatch.setattr(repair, "_SETTLE", 10_000)
        whole = walked(rows)
        for every in (1, 3, 64):
            monkeypatch.setattr(repair, "_SETTLE", every)
            assert walked(rows) == whole


def test_a_very_long_conversation_stays_short_in_memory():
    walk = repair.Walk()
    for k in range(30_000):
        walk.read(k, ("user", "assistant", "tool")[k % 3], b"%d." % k, "")
    assert max(w.bit_length() for w, _ in walk._nodes.values()) < 6 * 2 * repair._SETTLE
    assert walk.result()[5] > 0


def test_against_sql(spark, folder):
    rows = queries.op13_conversation_repair(spark, folder)
    assert difference(connect(folder), queries.oracle_sql()["op13_conversation_repair"], rows) is None


def test_edges_against_sql(spark, tmp_path):
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 3, None, None), (2, 1, "system", "S."), (2, 2, "", "odd"),
            (2, 3, "tool", "T" * 50_000), (2, 9, "assistant", "x \n"), (None, 1, "user", "no id."), (None, 1, "user", "no id."),
            (4, 2, "user", None), (5, 7, "user", "é中?  "), (5, 7, "assistant", "é中?"), (5, 8, "User", "Case.")]
    rows += [(n, k, ("user", "assistant")[k % 2], f"text {k}.") for n in range(10, 60) for k in range(6)]
    path = str(tmp_path / "conversations.parquet")
    made(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert difference(con, repair.sql(), repair.repair(repair.damaged(made(spark, rows)))) is None


def test_defined_cases(spark):
    found = {r.conv_id: r for r in repair.repair(repair.untouched(made(spark, [
        (1, 1, "system", "S."), (1, 2, "user", "Q?"), (1, 3, "assistant", "A."),
        (2, None, None, "one."), (2, 5, "user", "same."), (2, 9, "user", "same."), (3, 1, "user", None)]))).collect()}
    assert (found[1].cost, found[1].audit, found[1].illegal, found[1].gaps) == (0, "KKK", 0, 0)
    assert found[1].repaired_sha256 == hashlib.sha256(b"system:S.\nuser:Q?\nassistant:A.").hexdigest()
    assert (found[2].gaps, found[2].duplicate, found[2].illegal) == (3, 1, 2)
    assert (found[3].blank, found[3].cost, found[3].audit) == (1, 3, "D")
    assert found[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert repair.repair(repair.damaged(made(spark, []))).count() == 0


def test_one_shuffle(spark, folder):
    plan = queries.op13_conversation_repair(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_conversation_over_many_batches(spark, partitions):
    rows = [(k % 3 // 2, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(3_000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.untouched(made(spark, rows).repartition(partitions))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {c: walked([r[1:] for r in rows if r[0] == c]) for c in (0, 1)}
