"""The pipeline against brute force, stage by stage, and the registered queries against their SQL."""

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from scripts.check_oracle import rows_of as sql_rows
from tests.llm.conftest import odd_texts
from tests.llm.test_dedup import cut_lines, one_of_each
from tests.llm.test_text import SOLID, base_rules, buckets, contamination, log_ratio_table
from tidemark.llm import quality_rules, registry

SF = "/root/testdata/sf0.001"
TRUSTED = {0, 5, 6, 7, 11, 12, 18, 19, 21}


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = dict(odd_texts())
    odd.drop("n_words", "key", "component_id", "rank").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in TRUSTED] + [(23, 0, 0), (16, 0, 1)]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(texts[18].split()[20:60])), (2, " ".join(texts[11].split()[7:25]))]
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def expected_rows(items):
    texts = odd_texts()
    ratios = log_ratio_table(texts, TRUSTED)
    kept = []
    for i, t in texts:
        b, g = base_rules(t), buckets(t)
        mean = sum(ratios[x] for x in g) / max(1, len(g))
        if b[0] >= 50 and 100 * b[4] <= 50 * b[0] and mean >= quality_rules.THRESHOLD:
            kept.append((i, t))
    cut = [(i, t) for i, t in cut_lines(kept, 20) if re.search(SOLID, t)]
    one = one_of_each(cut, 5, 80)
    clean = []
    for i, t in one:
        ((_, n, h, _),) = contamination([(i, t)], items)
        if not (h and 20 * h >= n):
            clean.append((i, t))
    return clean, (kept, cut, one)


def test_pipeline(spark, tables):
    folder, items = tables
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final, stages = expected_rows(items)
    assert len(odd_texts()) > len(stages[0]) >= len(stages[1]) > len(stages[2]) > len(final) > 3
    expected = []
    for i, t in final:
        ids = library.encode(t, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        expected.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), raw))
    got = [(*r[:4], bytes(r.ids)) for r in entry.queries()["pipeline"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_stages_return_the_columns_of_documents(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontaminate", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), folder)
        assert none.count() == 0
        if name != "bpe":
            assert none.dtypes == docs.dtypes
    cut = corpus_pipeline.dedup_lines(spark, docs, folder)
    assert cut.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("name", [n for n in registry.queries()])
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and "doc_id" in df.columns or "conv_id" in df.columns
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for table in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cur = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert sql_rows(df.columns, rows) == sql_rows(names, cur.fetchall())


def test_near_copies_of_five_words(spark):
    """200 words with 4 of them changed: 5-word sets at 0.815, 3-word sets at 0.886. With 5 changed 0.774: not similar."""
    texts = []
    for i, changed in enumerate(((), (30, 70, 110, 150), (20, 60, 100, 140, 180))):
        texts.append((i, " ".join(f"x{k}" if k in changed else f"w{k}" for k in range(200))))
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_similar(spark, docs, SF).collect()) == [0, 2]
    assert corpus_pipeline.ngram_join.keep_one(docs).count() == 3
