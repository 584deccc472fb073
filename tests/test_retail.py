"""The generated collection, from facts over pages and links to arms and their scores."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.questions import CATEGORICAL_FIELDS, parse_filters, target_type
from docloom.operators import arms, evaluation, metadata, store
from docloom.sources import markdown, retail


@pytest.fixture(scope="module")
def shop(spark):
    return {name: df.cache() for name, df in retail.generate(spark, regions=4, stores=6, suppliers=10, categories=20).items()}


def test_facts_keep_their_constraints(spark, shop):
    assert {r.rule: r.n_bad for r in retail.violations(shop).collect() if r.n_bad} == {}
    assert shop["store"].count() == 24 and shop["department"].count() == 15
    assert all([f.name for f in shop[n].schema] == [c.split()[0] for c in ddl.split(", ")] for n, ddl in retail.SCHEMAS.items())
    broken = dict(shop, store=shop["store"].unionByName(shop["store"].limit(1)).withColumn("status", F.lit("lost")))
    bad = {r.rule: r.n_bad for r in retail.violations(broken).collect() if r.n_bad}
    assert bad == {"store key": 1, "store status": 25}


def test_facts_follow_the_seed(spark, shop):
    again = retail.generate(spark, regions=4, stores=6)["store"].collect()
    assert sorted(again) == sorted(shop["store"].collect())
    assert sorted(retail.generate(spark, seed=8, regions=4, stores=6)["store"].collect()) != sorted(again)


def test_pages_without_parents_say_none(spark, shop):
    names = shop["region"].select(F.lit("store").alias("doc_type"), "name").unionByName(shop["department"].select(F.lit("category").alias("doc_type"), "name"))
    docs = {parents: markdown.documents(retail.render(shop, parents)).cache() for parents in (True, False)}
    told = lambda parents: store.parent_leaks(docs[parents], {"store": "region", "category": "department"}, names)
    assert told(False).count() == 0 and told(True).where("leak = 'link'").count() == 24 + 20
    assert docs[False].count() == docs[True].count() and markdown.links(docs[False])[1].count() == 0


def test_pages_questions_and_arms(spark, shop, tmp_path):
    docs = markdown.documents(retail.render(shop)).cache()
    edges, unresolved = markdown.links(docs)
    assert unresolved.count() == 0 and docs.select("path").distinct().count() == docs.count()
    fields = markdown.fields(docs).cache()
    kinds, values = metadata.field_types(docs, fields), metadata.categorical_values(fields, list(CATEGORICAL_FIELDS))
    asked = retail.questions()
    questions = spark.createDataFrame([(x["query_id"], x["text"]) for x in asked], "query_id string, text string")
    filters = parse_filters(questions, kinds, values).cache()
    wanted = questions.select("query_id", target_type(F.col("text")).alias("doc_type")).where("doc_type is not null")
    runs = arms.run_arms(questions, docs, fields, edges, filters, wanted)
    qrels = retail.gold(spark, shop, asked)
    scored = evaluation.ir_metrics(runs.withColumnRenamed("path", "doc"), qrels, "arm").join(qrels.select("query_id").distinct(), "query_id")
    sets = scored.where("query_id not like 'S1%'").groupBy("arm").agg(F.avg("ndcg10").alias("m")).collect()
    mean = {r.arm: r.m for r in sets}
    assert mean["R6f"] > 0.9 > mean["R2s"], json.dumps(mean)
