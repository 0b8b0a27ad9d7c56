"""The corpus pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing, toxicity
from tablewright.llm.store import table

from .helpers import DOC_SCHEMA, SMALL, WORD, brute_near, edge_documents
from .test_text import brute_schedule, library


def test_pipeline_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = toxicity.train(docs, table(spark, SMALL, "labels"))
    kept = {r.doc_id: r.text for r in toxicity.score_texts(docs, model).filter("predicted = 0").collect()}
    groups: dict[str, int] = {}
    for i in sorted(kept, key=lambda i: (-len(kept[i]), i)):
        groups.setdefault("".join(WORD.findall(kept[i])), i)
    left = {i: kept[i] for i in groups.values()}
    classes, _ = brute_near(left)
    left = {i: t for i, t in left.items() if classes[i] == i}
    made = library()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got.keys() == left.keys()
    for i, t in left.items():
        assert got[i].ids == made.encode(t, add_special_tokens=False).ids


def test_stages_on_edge_rows(spark, tmp_path):
    docs = edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).checkpoint()
        assert now.columns == docs.columns, name
    assert sorted(r.doc_id for r in now.collect()) == [4, 6, 7, 8]  # 5 is a near copy of 4
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 4


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_order_is_in_the_result(spark, monkeypatch):
    """Places come from what the mix wrote: without that stage they are others."""
    monkeypatch.setattr(mixing.mix_sources, "__defaults__", tuple(4 if d == mixing.BLOCK_ROWS else d for d in mixing.mix_sources.__defaults__))
    source = {r.doc_id: r.source for r in table(spark, SMALL, "documents").collect()}
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "place").collect()
    rows = defaultdict(list)
    for i in sorted((r.doc_id for r in got), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        rows[source[i]].append(i)
    scaled = sum(int(len(v) ** 0.5 * 1024 + 0.5) for v in rows.values())
    share = {k: int(len(v) ** 0.5 * mixing.QUANTUM * 1024 / scaled + 0.5) for k, v in rows.items()}
    period = sum(share.values())
    plan = {(k[1:], turn): t for t, (k, turn) in enumerate(brute_schedule({"=" + k: v for k, v in share.items()}, len(got)))}
    end = min(plan.get((k, -(-len(v) // 4)), len(got)) for k, v in rows.items())
    order = []
    for k, v in rows.items():
        for n, i in enumerate(v):
            slot = plan.get((k, n // 4), end)
            order.append((slot if slot < end else -(-(n // 4 + 1) * period // share[k]) - 1, k, n, i))
    assert len(rows) > 1 and sorted(r.place for r in got) == list(range(len(got)))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.place)] == [i for *_, i in sorted(order)]
    # the head of the mix has the target weights, not the sources' own shares
    head = [k for slot, k, _, _ in sorted(order) if slot < end]
    assert head
    for k in rows:
        assert head.count(k) / len(head) == pytest.approx(share[k] / period, abs=4 / len(head) + 1e-9)
