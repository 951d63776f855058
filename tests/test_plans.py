"""Registered queries on small tables made for a case that the given tables seldom have."""

import re

import pytest
from assayer.operators import dependencies, verdict
from assayer.operators import patterns as P
from assayer.plans import catalog, evidence, samples
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_one_content_under_several_names(spark, folder):
    """Equal texts with equal code under different names have the findings of their own names (a key in tests is none)."""
    docs = spark.range(640).select(F.col("id").alias("doc_id"), F.lit("plain words").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(11).cast("long").alias("n_chars"))
    sf = folder(documents=docs)
    names = [n for n, _ in samples.SNIPPETS]
    codes = [c for _, c in samples.SNIPPETS]
    assert len(set(codes)) < len(set(zip(names, codes, strict=True)))
    found = catalog.findings(spark, sf).withColumn("doc", F.split_part("path", F.lit("/"), F.lit(2))).groupBy("doc").agg(*verdict.severity_counts())
    alone = {r["doc"]: "malicious" if r["n_high"] or (r["n_medium"] >= 3 and r["n_vectors"] >= 3) else "suspicious" if r["n_medium"] else "inconclusive" for r in found.collect()}
    got = {r["root_path"]: (r["state"], r["depth"]) for r in evidence.nested_verdicts(spark, sf).collect()}
    assert got == {str(i): (alone.get(str(i), "inconclusive"), i % 8 + 1) for i in range(640)}


def test_names_are_compared_once(spark, folder):
    """Each different word is compared, not each word of each document."""
    texts = ["Expresss and lodahs", "lodahs, expresss; express react", "axois moments MOMENT webpackk", None, "", "1 2", "a raect reactt"]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = catalog.typosquat(spark, folder(documents=docs))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    words = [set(re.findall("[a-z]+", t.lower())) for t in texts if t]
    want = {(w, sum(w in x for x in words), r) for w in set().union(*words) if (r := dependencies.resembles(w, P.POPULAR_NODE))}
    assert {(r["name"], r["n_docs"], r["resembles"]) for r in found.collect()} == want and len(want) >= 4
