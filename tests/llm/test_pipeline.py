"""The pipeline's stages, each on what its predecessor kept, against brute force."""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import SMALL, components_by_force, fingerprint_by_force, targets_by_force, tiled_by_force, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from marketspark.llm import decontaminate, quality  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        assert docs.columns == COLUMNS or (k == 4 and docs.columns[:5] == COLUMNS)
    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    # 3: what scores enough, with scores as the classifier gives them
    space = quality.learned(start, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = quality.scored(start, space).filter(F.col("quality_score") >= quality.KEEP).collect()
    assert sorted(r["doc_id"] for r in kept[0]) == sorted(r["doc_id"] for r in good) and 0 < len(good) < start.count()
    # 9: the smallest doc_id of each component
    prints = {r["doc_id"]: fingerprint_by_force(r["text"]) for r in kept[0]}
    roots = components_by_force(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(set(roots.values()))
    # 4: documents that no item's tiles cover; an item without a common run of five words has none
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    runs = defaultdict(set)
    for n, item in enumerate(items):
        for i in range(len(item) - 4):
            runs[tuple(item[i : i + 5])].add(n)
    clean = []
    for r in kept[1]:
        doc = plain(r["text"])
        near = {n for i in range(len(doc) - 4) for n in runs.get(tuple(doc[i : i + 5]), ())}
        if all(tiled_by_force(items[n], doc) < decontaminate.COVERAGE * len(items[n]) for n in near):
            clean.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(clean) and len(clean) < len(kept[1])
    # 6: words by source near their targets, no document more than twice
    sizes, taken, times = Counter(), Counter(), Counter()
    for r in kept[2]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in kept[3]:
        taken[r["source"]] += len(words(r["text"]))
        times[r["doc_id"]] += 1
    target = targets_by_force(sizes)
    longest = max(len(words(r["text"])) for r in kept[2])
    assert max(times.values()) <= 2 and set(times) <= set(clean)
    assert all(abs(taken[s] - target[s]) <= longest / 2 for s in sizes)
    # 8: all rows, in shards of equal counts
    shards = Counter(r["shard"] for r in kept[4])
    assert Counter(r["doc_id"] for r in kept[4]) == times and set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= 1


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
