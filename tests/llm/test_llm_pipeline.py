"""The pipeline's stages on a small corpus, and registration with and without the subpackage."""

import random
import subprocess
import sys
from pathlib import Path

from tests.llm.test_llm_operators import prose, toxic_docs

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from palisade.llm import ngram_join, packing, surrogates, toxicity
    from palisade.llm.queries import TOKENIZER

    rng = random.Random(21)
    rows, labels = toxic_docs(rng, 200)
    rows += [(500, rows[1][1]), (501, rows[1][1] + " end"), (502, "mail bob.ray@mail.example.com " + prose(rng, 30)), (503, None), (504, "")]
    table = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in out.collect()})
        docs = out
    bad = {i for i, y in labels if y}
    assert not bad & set(seen[0]) and len(seen[0]) == len(rows) - len(bad)
    assert not {500, 501} & set(seen[1]) and {1, 502, 503, 504} <= set(seen[1])
    assert "bob.ray" not in seen[2][502].text and seen[2][502].n_chars == len(seen[2][502].text) and seen[2][503].text is None
    assert set(seen[3]) == set(seen[2])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())
    assert [len(x) for x in (toxicity.__doc__, ngram_join.__doc__, surrogates.__doc__, packing.__doc__)] and TOKENIZER


def test_entry_without_the_subpackage(tmp_path):
    """A copy of the library without the subpackage and the pipeline still imports and registers its own queries."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")})
