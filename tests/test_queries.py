"""Every query runs, and matches its SQL where it has one."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessera.queries import registry

from .oracle import connect, rows

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(con.execute(sql).df())
    else:
        assert len(got)
        if name == "text_chunk_spans":
            # Joining parts anew may change the white space between them; all other chunks are the bytes at their span.
            assert (got["largest"] <= 500).all() and got["exact"].sum() > 0.95 * got["chunks"].sum()
        if "dim" in got:
            assert ((got["dim"] > 0) | got["embed_error"].notna()).all()


def test_vector_text_of_halves_and_small_negatives(spark, sf_dir, tmp_path):
    """Halves of the sixth decimal go to the even one, and first components that round to zero keep their sign."""
    vectors = [(0, [-0.0703125, 0.0078125], 0), (1, [-3e-6, 0.5], 0), (2, [-1e-7, -0.0], 0), (3, [-0.0, 1.5], 0), (4, [3e-6, 0.0234375], 0), (5, [0.015625, -3.0234375], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path)
    got = registry.queries()["vector_text_round_trip"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for name, files in (("embeddings", "embeddings.parquet/*.parquet"), ("documents", "documents.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{files}'")
    assert len(got) == 6 and rows(got) == rows(con.execute(registry.oracle_sql()["vector_text_round_trip"]).df())


def test_small_base_search_is_exact_over_many_shards(spark, sf_dir, tmp_path):
    """Five shards of 2,000 rows and a rest, more than the fanout: those near the query lie in shards whose centroids do not."""
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(10_500, 3)))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path)
    got = registry.queries()["vector_topk_small_kb"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for name, files in (("embeddings", "embeddings.parquet/*.parquet"), ("documents", "documents.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{files}'")
    assert len(got) == 10 and rows(got) == rows(con.execute(registry.oracle_sql()["vector_topk_small_kb"]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_folders(tmp_path):
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (here / name).exists():
            shutil.copy(here / name, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries()); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
