"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tarnwick.plans import registry
from tarnwick.session import TABLES

SF = "/root/testdata/sf0.001"


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    found = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    key = lambda r: tuple(map(str, (x for x in r if not isinstance(x, float)))) + tuple(map(str, r))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want) > 0
    bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(_same, a, b))]
    assert not bad, bad[:3]


def _fold(rows):
    seen, out = {}, {}
    for seq, keys in sorted(rows):
        cluster = next((seen[k] for k in keys if k in seen), seq)
        for k in keys:
            seen.setdefault(k, cluster)
        out[seq] = cluster
    return out


def test_greedy_dedup_against_a_fold(spark):
    import random

    from tarnwick.operators import entity

    rng = random.Random(5)
    rows = [(i, [f"k{rng.randrange(60)}" for _ in range(rng.randrange(0, 4))]) for i in range(120)] + [(200 + i, ["k1", "k2"]) for i in range(20)]
    got = {r.seq: r.cluster for r in entity.greedy_merge(spark.createDataFrame(rows, "seq long, keys array<string>"), "seq", "keys").collect()}
    assert got == _fold(rows)


def test_greedy_dedup_of_documents(spark):
    import hashlib
    import re

    def keys(text):
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        kept = re.sub(r"[ \t\r\n]+", " ", re.sub(r"[^\w+#./ \t\r\n-]", " ", text.lower())).strip()
        words = [w for w in kept.split(" ") if w]
        return ["t:" + md5(text), "a:" + md5(" ".join(words[:100])), "z:" + md5(" ".join(words[-100:]))]

    docs = {r.doc_id: keys(r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.seq: r.cluster for r in registry.queries()["greedy_dedup"](spark, SF).collect()}
    assert got == _fold(docs.items())
