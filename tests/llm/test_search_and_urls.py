import math
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scorebook.llm import queries, search, urls
from scorebook.llm.common import staged
from tools.check_oracle import compare, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, cur = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare(rows_of(df.columns, df.collect()), rows_of(cols, cur.fetchall())) == "ok"


def brute_bm25(docs, queries_, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tf = {i: Counter((t or "").translate(low).encode().split()) for i, t in docs}
    mean, n = sum(map(Counter.total, tf.values())) / len(tf), len(tf)
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in queries_:
        score = {}
        for w, m in Counter((text or "").translate(low).encode().split()).items():
            for i, c in tf.items():
                if c[w]:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    score[i] = score.get(i, 0) + m * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 300)) for i in range(700)]
    docs += [(700 + i, docs[i][1]) for i in range(40)]  # ties
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    some = [d for d in docs if d[0] % 50 == 0]
    got = search.top_k(search.build_index(df), spark.createDataFrame(some, df.schema), k=7, query_bytes=3000)
    assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got.collect()) == brute_bm25(docs, some, 7)


def test_like_documents_become_neighbours():
    """Documents of four kinds in turn: in the order of a shard each kind is one run, and its blocks hold one kind each."""
    rng = np.random.default_rng(2)
    text = np.repeat(np.arange(256), 50)
    word = np.where(rng.random(len(text)) < 0.4, text % 4, 10 + 100 * (text % 4) + rng.integers(0, 90, len(text)))
    term, starts, doc, tf = search.counted(text, word)
    order, new, tf2 = search.ordered(starts, doc, tf, np.full(256, 50))
    assert (np.diff(order % 4) != 0).sum() == 3 and sorted(order) == list(range(256))
    ends = np.append(starts[1:], len(doc))
    for a, b in zip(starts, ends):
        assert (np.diff(new[a:b]) > 0).all() and dict(zip(order[new[a:b]], tf2[a:b])) == dict(zip(doc[a:b], tf[a:b]))

    def blocks(d):
        return sum(len(np.unique(d[a:b] // search.BLOCK_DOCS)) for a, b in zip(starts, ends))

    assert blocks(new) < 0.4 * blocks(doc)


def test_a_shard_is_a_row_group_of_its_own(spark):
    """A task's shards are neither written nor read together, and texts that come in small batches fill a shard."""
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' of the '), 8000) AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    index = search.build_index(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    (file,) = index.inputFiles()
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    text = docs.selectExpr("sum(length(text))").first()[0]
    assert meta.num_rows == meta.num_row_groups and text / search.SHARD_BYTES < meta.num_rows <= text / search.SHARD_BYTES * 1.3 + 1
    assert sorted(i for r in index.select("docs").collect() for i in r.docs) == list(range(300))


def test_shards_do_not_depend_on_batches():
    """The same rows whether texts come at once or one by one."""
    text = pa.array([f"a b{i % 7} c{i}" * (i % 5) or None for i in range(200)])
    whole = pa.RecordBatch.from_arrays([pa.array(range(200)), text], ["doc_id", "text"])
    (a,), (b,) = (pa.Table.from_batches(search._index(iter(x))).to_pylist() for x in ([whole], [whole.slice(i, 1) for i in range(200)]))
    assert a == b and len(a["docs"]) == 200 and len(a["starts"]) == len(a["terms"]) + 1


def test_top_k_edge_cases(spark, tricky, nothing):
    index = search.build_index(tricky)
    rows = search.top_k(index, tricky.where("doc_id % 100 = 0 or doc_id in (2, 4, 5)")).collect()
    by = Counter(r.query_id for r in rows)
    assert by[4] == by[5] == 0 and by[2] == 2 * by[100]  # null and empty find nothing; the repeated row is answered twice
    assert [r.doc_id for r in rows if r.query_id == 2 and r["rank"] == 1] == [1, 1] or {r.doc_id for r in rows if r.query_id == 2} >= {1, 2, 100}
    assert search.top_k(index, nothing).count() == 0
    assert search.top_k(search.build_index(nothing), tricky.where("doc_id = 1")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    universe = staged(spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key")).select("key", *urls.hashes(F.col("key"))), "u")
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = urls.build_cascade(listed, universe, 3000)
    rows = universe.toPandas()
    inside = cascade.contains(rows.h1.to_numpy(), rows.h2.to_numpy())
    assert (inside == (rows.key.str[1:].astype(int) % 7 == 0).to_numpy()).all()
    assert len(cascade.levels) > 1


def test_urls_edge_cases(spark):
    page = spark.createDataFrame([
        (1, "http://WWW.Example.COM/en/x?q=/de/", "h"), (2, None, "h"), (None, "no scheme", None), (3, "http://net", None), (4, "ftp://a.net/es/://b.com/", ""),
        (5, "http://example.com/en/", "h"), (5, "http://example.com/en/", "h"), (6, "http://notexample.com/en/", "h"), (7, "://#", "h"), (8, "x://É.net/fr/é#a", "h"),
        (9, "http://com?x", "h"), (10, "http://a.example.com/en", "h"),
    ], "page_id long, url string, host string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(page, rules).collect()}
    assert got == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (None, "", "", None, "allow"), (3, "net", "", None, "allow"),
        (4, "a.net", "/es/://b.com/", "net/es/", "block"), (5, "example.com", "/en/", "example.com/en/", "block"), (6, "notexample.com", "/en/", "com/", "allow"),
        (7, "", "", None, "allow"), (8, "É.net", "/fr/é", "net/fr/", "block"), (9, "com", "", None, "allow"), (10, "a.example.com", "/en", "com/", "allow"),
    }
    assert urls.judge(page, rules).count() == 12
    assert urls.judge(page.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(page, rules.limit(0)).collect()} == {"allow"}
