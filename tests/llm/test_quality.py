from __future__ import annotations

import re
from collections import Counter

import pytest
from compare import connect, difference
from conftest_llm import EDGES
from tuneledger.llm import quality, queries

CASES = [*EDGES, (20, "a b c d e a b c d e a b c d e"), (21, "x y\nx y\n \n\nx y\n x y"), (22, "#*$%&|<> !" * 20),
         (23, "one two three four five six seven eight nine"), (24, "one two three four five six seven eight nine ten"),
         (25, "the cat sat on the mat and the dog sat on the mat and the cow"), (26, "- a\n- b\n• c\n* d the of and to in is\n- e"),
         (27, "a b c\x0bd e\x0cf\x1cg h")]


def brute(text: str | None):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


def test_measures(spark, documents):
    rows = quality.judge(documents(CASES)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"]) for r in rows)
    assert got == Counter((k, *brute(t)) for k, t in CASES)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_corpus_and_sql(spark, folder, corpus):
    rows = quality.judge(corpus).collect()
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
               == brute(text[r["doc_id"]]) for r in rows)
    assert difference(connect(folder), queries.oracle_sql()["op9_quality"], queries.queries()["op9_quality"](spark, folder)) is None


def test_clean_documents_stay(spark, folder, corpus):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judge(corpus).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r for r in rows if r["quality"] == 1]
    assert good and sum(r["kept"] for r in good) >= 0.995 * len(good)
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(not r["kept"] for r in bad) >= 0.6 * len(bad)


def test_keep_returns_all_columns(spark, documents):
    kept = quality.keep(documents([(1, "the cat sat on a mat and saw the dog there"), (2, "no")]))
    assert kept.columns == documents([]).columns
    assert [r["doc_id"] for r in kept.collect()] == [1]
    assert quality.judge(documents([])).count() == 0


@pytest.mark.parametrize("name", [r.name for r in quality.RULES])
def test_rules_compare_whole_numbers(name):
    rule = next(r for r in quality.RULES if r.name == name)
    assert rule.low < rule.high and "1000 *" in rule.sql()


def test_no_user_function_in_the_plan(spark, corpus):
    plan = quality.judge(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
