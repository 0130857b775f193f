"""The pipeline on a small corpus with planted cases."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel_kg.llm import common, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    texts = {i: prose(120) + "\n" + prose(60) for i in range(60)}
    passage = prose(70)
    for i in (10, 11):
        texts[i] = texts[i] + "\n" + passage
    for i in range(100, 115):
        texts[i] = " ".join(["junk#"] * 3 + [f"J{r.randrange(300)}#" for _ in range(90)])
    words = texts[5].replace("\n", " ").split()
    words[40] = "changed"
    texts[200] = " ".join(words)
    texts[201] = texts[6]
    item = " ".join(f"bench{i}" for i in range(20))
    texts[202] = prose(80) + " " + item
    texts[203] = prose(3)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in (*range(40), *range(100, 112))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            kept.append({x.doc_id: x.text for x in docs.collect()})
    clean = set(range(60))
    assert clean <= set(kept[0]) and not set(range(100, 115)) & set(kept[0]) and 203 not in kept[0] and {200, 201, 202} <= set(kept[0])
    assert clean <= set(kept[1]) and 201 not in kept[1] and passage in kept[1][10] and passage not in kept[1][11]
    assert clean <= set(kept[2]) and 200 not in kept[2] and kept[2][0] == texts[0]
    assert set(kept[3]) == clean
    tokenizer = tokens.load(tokens.default_path())
    packed = {}
    for p in docs.collect():
        packed[p.doc_id] = packed.get(p.doc_id, 0) + p.length
    assert packed == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept[3].items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert np.all([n > 0 for n in packed.values()])


def test_word_hashes_take_little_memory_in_each_worker():
    hashes, words = common.WordHash(), [b"w%d" % i for i in range(250_000)]
    found = hashes.array(words)
    assert len(hashes) <= 100_000 and found.tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]


def test_workers_take_bounded_parts_and_the_stages_bounded_batches(spark):
    rows = spark.range(0, 2_300, 1, 1)
    sizes = lambda batches: ({"n": pa.array([b.num_rows] * b.num_rows, pa.int32())} for b in batches)
    found = common.with_columns(rows, sizes, "n int")
    assert found.agg(F.max("n"), F.count("n"), F.sum("id")).first()[:] == (500, 2_300, 2_300 * 2_299 // 2)
    before = spark.conf.get(common.ARROW_BYTES, None)
    spark.conf.unset(common.ARROW_BYTES)
    common.written(rows, "rows")
    assert spark.conf.get(common.ARROW_BYTES, None) is None
    corpus_pipeline.pack(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert spark.conf.get(common.ARROW_BYTES, None) == str(common.BATCH_BYTES)
    spark.conf.unset(common.ARROW_BYTES) if before is None else spark.conf.set(common.ARROW_BYTES, before)


def test_a_worker_hands_back_what_a_task_freed():
    """In a process of its own, as workers are: a quarter of a million small objects between two that stay."""
    code = (
        "import re, pyarrow as pa\n"
        "from kestrel_kg.llm.common import lean\n"
        "mb = lambda: sum(map(int, re.findall(r'Pss_Anon:\\s+(\\d+)', open('/proc/self/smaps_rollup').read()))) / 1024\n"
        "kept = []\n"
        "def run(batches):\n"
        "    for b in batches:\n"
        "        held = [bytes(1000) for _ in range(250_000)]\n"
        "        kept.append(bytes(1000))\n"
        "        yield b\n"
        "batch = pa.RecordBatch.from_arrays([pa.array([1])], names=['a'])\n"
        "before = mb()\n"
        "assert len(list(lean(run)(iter([batch])))) == 1\n"
        "print(mb() - before)\n"
    )
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(corpus_pipeline.__file__).parent)
    assert float(found.stdout) < 60
