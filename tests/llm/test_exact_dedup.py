import hashlib
import re

import pytest

from blockvault.llm import exact_dedup as E

from .cases import both, documents, frame


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    out = []
    for (i, _, _), t in zip(rows, norm, strict=True):
        same = [j for (j, _, _), u in zip(rows, norm, strict=True) if u == t]
        ids = [j for j in same if j is not None]
        out.append((i, min(ids) if ids else None, len(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_hot", [32, 1])
def test_brute_force(spark, monkeypatch, least_hot):
    monkeypatch.setattr(E, "LEAST_HOT", least_hot)
    rows = documents() + [(1000 + i, "a very common text", "en") for i in range(200)] + [(None, "only null", "en"), (None, "x", "en")]
    for df in both(spark, rows):
        got = E.exact_dedup(df).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
        stays = [r for r in got if r["kept"]]
        assert len(stays) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in stays)


@pytest.mark.parametrize("least_hot", [32, 1])
def test_keep_first_keeps_rows_whole(spark, monkeypatch, least_hot):
    monkeypatch.setattr(E, "LEAST_HOT", least_hot)
    rows = documents() + [(1000 + i, "a very common text", "en") for i in range(200)]
    df = frame(spark, rows, True)
    got = E.keep_first(df)
    assert got.columns == df.columns
    want = {r[0] for r in E.exact_dedup(df).filter("kept").select("doc_id").collect()}
    kept = [(r["doc_id"], r["text"], r["lang"]) for r in got.collect()]
    assert {k[0] for k in kept} == want and len(kept) == len(want) and set(kept) <= set(rows)


def test_empty_table(spark):
    assert E.exact_dedup(frame(spark, [])).count() == 0
    assert E.keep_first(frame(spark, [])).count() == 0


def test_plan_has_no_python_and_one_exchange_of_texts(spark):
    plan = E.exact_dedup(frame(spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
