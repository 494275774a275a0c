import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from blockvault.llm import language, quality
from blockvault.llm import queries as Q
from blockvault.llm.common import read_table

from ..support import oracle, plain, rows
from .cases import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 11)}


def test_stages_by_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns

    def stage(k, df):
        out = P.STAGES[k][1](spark, df, SF)
        return out if k == len(P.STAGES) - 1 else spark.createDataFrame(out.collect(), docs.schema)

    model = quality.learn(docs, read_table(spark, SF, "labels"))
    want = {i for i, t in text.items() if model.score(np.array([quality.statistics(t)]))[0] >= quality.THRESHOLD}
    df = stage(0, docs)
    assert df.columns == columns and {r["doc_id"] for r in df.collect()} == want and 0 < len(want) < len(text)

    speaker = language.learn(df)
    ids = sorted(want)
    names, scores = speaker.predict([text[i] for i in ids])
    want = {i for i, n, s in zip(ids, names, scores, strict=True) if n != "und" and s >= P.LEAST_LANGUAGE}
    df = stage(1, df)
    assert {r["doc_id"] for r in df.collect()} == want

    first: dict = {}
    for i in sorted(want):
        first.setdefault(" ".join((text[i] or "").split()), i)
    df = stage(2, df)
    want = set(first.values())
    assert {r["doc_id"] for r in df.collect()} == want

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(text[i]) for i in want}
    same = components(sorted(want), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    df = stage(3, df)
    want = {i for i, c in same.items() if i == c}
    assert df.columns == columns and {(r["doc_id"], r["text"]) for r in df.collect()} == {(i, text[i]) for i in want}

    pieces = stage(4, df).collect()
    assert {r["doc_id"] for r in pieces} == want
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    for i in want:
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == total[i]


def test_run_is_the_stages_in_turn(spark):
    docs = read_table(spark, SF, "documents")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    want = P.STAGES[-1][1](spark, docs, SF).select("doc_id", "start", "length", "ids_crc32")
    got = P.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()
    assert {plain(r["doc_id"]) for r in got} == {plain(r["doc_id"]) for r in want.collect()}
