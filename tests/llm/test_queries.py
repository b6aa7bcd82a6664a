"""The registered queries over the driver's smallest tables: against DuckDB, and the pipeline against brute force."""

import glob
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from undula.llm import mixing, packing, queries
from undula.llm.classifier import resample

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(repr, got[names].astype(object).values.tolist())) == sorted(map(repr, want[names].astype(object).values.tolist()))


def test_vector_recall(spark):
    table = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    got = queries.op10_vector_search(spark, FOLDER).toPandas()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:20]]
        hits, total = hits + len(set(best) & set(got[got.query_id == q].vec_id)), total + 20
    assert hits / total >= 0.9


def test_language_of_held_out_documents(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    got = queries.op8_language_id(spark, FOLDER).toPandas().merge(docs, on="doc_id")
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95


def test_model_beats_single_words_on_held_out_documents(spark):
    got = queries.op3_class_lm(spark, FOLDER).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def brute_lines(docs):
    """Sets of words of all lines before, in order; a later similar line goes."""
    seen, out = [], []
    for row in docs.sort_values("doc_id").itertuples():
        kept, gone = [], 0
        for line in row.text.split("\n"):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if words and any(100 * len(words & s) >= 80 * len(words | s) for s in seen):
                gone += 1
            else:
                kept.append(line)
            if words:
                seen.append(words)
        text = "\n".join(kept)
        if not gone or re.search(r"[^\x20\x09-\x0D]", text):
            out.append((row.doc_id, text, row.lang, row.source, len(text) if gone else row.n_chars))
    return pd.DataFrame(out, columns=["doc_id", "text", "lang", "source", "n_chars"])


def brute_near(docs):
    from test_llm_operators import brute_components

    found = brute_components(list(zip(docs.doc_id, docs.text)))
    return docs[[found[i][1] == i for i in docs.doc_id]]


def test_pipeline_is_the_brute_force_version(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    first = resample(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).toPandas()
    docs = docs[docs.doc_id.isin(first[first.kept].doc_id)]
    docs = brute_near(brute_lines(docs))
    rows = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert sorted(rows.doc_id.unique()) == sorted(docs.doc_id)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for i, t in zip(docs.doc_id, docs.text):
        assert rows[rows.doc_id == i].length.sum() == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        kept[name] = out.toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    assert len(good & set(kept["quality"].doc_id)) >= 0.98 * len(good)
    assert sorted(kept["mixing"].doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_sequences_follow_the_schedule(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', CAST(100 + 90 * (id % 7) AS INT)) AS text", "'en' AS lang", "CASE WHEN id < 2400 THEN 'hot' WHEN id < 2700 THEN 'b' ELSE 'c' END AS source", "1L AS n_chars")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    corpus_pipeline.mixture(spark, docs, FOLDER).write.parquet(f"{tmp_path}/mixed")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(mixed.inputFiles()) > 1
    got = corpus_pipeline.packing(spark, mixed, FOLDER).toPandas()
    plain = packing.pack(mixed, queries.tokenizer_path()).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[key].values.tolist()) == sorted(plain[key].values.tolist()) and got.sequence_id.nunique() == plain.sequence_id.nunique()
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert (bin_.offset.to_numpy() == np.concatenate(([0], np.cumsum(bin_.length)[:-1]))).all() and bin_.length.sum() <= 2048
    got = got.merge(mixing.mix(docs).select("doc_id", "source", "position").toPandas(), on="doc_id")
    assert got.sequence_id.corr(got.position, method="pearson") > 0.98
    share = {"hot": 2400**0.7, "b": 300**0.7, "c": 300**0.7}
    start = got[got.sequence_id < got.sequence_id.max() * 0.3]  # before a source ends
    for s, w in share.items():
        assert abs(start.length[start.source == s].sum() / start.length.sum() - w / sum(share.values())) < 0.05


def test_entry_without_this_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "undula", tmp_path / "undula", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print('mpx_self' in q, any(n.startswith('op') for n in q), 'pipeline' in q, bool(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "False", "False", "True"], out.stderr
