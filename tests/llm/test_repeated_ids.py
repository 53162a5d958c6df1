from pyspark.sql import functions as F

from scorebook.llm import spans


def test_null_ids_with_hashes_alike_in_24_bits(spark):
    """Texts without id whose hashes share 24 bits, one with a repeat beyond the other's last word."""
    passage = " ".join("p%d" % i for i in range(25))
    texts = ["a%d %s" % (i, passage) for i in range(15_000)] + ["b%d c d" % i for i in range(15_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", F.xxhash64("text").bitwiseAND(0xFFFFFF))
    alike = {}
    for r in df.collect():
        alike.setdefault(r.h, []).append(r.text)
    some = [t for v in alike.values() if {t[0] for t in v} == {"a", "b"} for t in v]
    assert len(some) > 2
    rows = [(None, passage), *[(None, t) for t in some]]
    got = sorted((r.n_words, r.n_removed, r.kept) for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(25, 0, passage)] + [(26, 25, t.split()[0]) if t[0] == "a" else (3, 0, t) for t in some])
