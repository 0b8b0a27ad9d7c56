"""Nearest-neighbour quality, conversation repair and Merkle manifest: edge cases and brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import knn_quality, manifest, turn_repair
from tablewright.llm.store import table

from .helpers import SMALL, edge_documents, empty_documents, sha

WHITE = " \t\n\x0b\x0c\r"


# --- quality votes

def test_terms():
    assert knn_quality.terms(None) == knn_quality.terms("") == knn_quality.terms(" \n") == {}
    got = knn_quality.terms("Aber aber 12ab! DAS das das")
    assert got == {"aber": 2, "12ab": 1, "das": 3, "\x01Aa": 1, "\x01a": 3, "\x019a!": 1, "\x01A": 1, "\x02word": 3, "\x02pair": 1}


def test_terms_by_bytes_and_by_characters():
    rnd = random.Random(6)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "B", "é", "É", "ß", "9", " ", "\n", "\x1c", "\xa0", "²", "_", "!", "ab", "\x0b", "µ", "ª", "÷"]) for _ in range(rnd.randrange(60)))
        words, stems, shapes = knn_quality._counted(text)
        bare, *counts = knn_quality._counted_latin(text.encode("latin-1"))
        assert [w.decode("latin-1") for w in bare] == words and counts == [stems, shapes]


def test_votes_against_brute_force():
    rng = np.random.default_rng(5)
    voters = knn_quality.unit(np.round(rng.normal(size=(60, 4)), 1))
    voters[7] = voters[3]
    model = knn_quality.Model({}, np.zeros((0, 4)), voters, (rng.random(60) < 0.7).astype(float), 0.7)
    places = np.vstack([knn_quality.unit(rng.normal(size=(30, 4))), voters[:10], np.zeros((1, 4))])
    for place, score in zip(places, knn_quality.vote(places, model, 6), strict=True):
        near = sorted(((round(float(sum(a * b for a, b in zip(place, v, strict=True))), 9), k) for k, v in enumerate(voters)), reverse=True)
        chosen = [(c, k) for c, k in near if c >= near[5][0] and c > 0]
        total = sum(c**8 for c, _ in chosen)
        want = sum(c**8 * model.votes[k] for c, k in chosen) / total if total else 0.7
        assert abs(score - want) < 1e-6


def test_document_counts(spark):
    docs = table(spark, SMALL, "documents").repartition(7)
    want = defaultdict(int)
    for (t,) in docs.select("text").collect():
        for term in knn_quality.terms(t):
            want[term] += 1
    assert {r.term: r.n for r in knn_quality.document_counts(docs).collect()} == want


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = knn_quality.op11_knn_quality(spark, sf)
    known = got.join(table(spark, sf, "labels"), "doc_id").filter("held_out").groupBy("quality", "predicted").count().collect()
    n = {(r.quality, r.predicted): r["count"] for r in known}
    assert n[0, 0] >= 0.9 * (n[0, 0] + n.get((0, 1), 0)) and n[1, 1] >= 0.98 * (n[1, 1] + n.get((1, 0), 0))


def test_quality_edges_and_partitions(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = knn_quality.train(docs, labels)
    other = knn_quality.train(docs.repartition(13), labels.union(labels).repartition(3))
    edges = edge_documents(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in knn_quality.score_quality(edges, model).collect())
    assert len(got) == 11 and got == sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in knn_quality.score_quality(edges.repartition(5), other).collect())
    assert {r.doc_id: r.score for r in knn_quality.score_quality(edges, model).collect()}[3] == model.prior
    assert all(0 <= s <= 1 for *_, s in got)
    assert knn_quality.score_quality(empty_documents(spark), model).count() == 0
    none = knn_quality.train(empty_documents(spark), labels)
    assert {r.score for r in knn_quality.score_quality(edges, none).collect()} == {0.5}
    assert knn_quality.train(docs, labels, max_labelled=5).voters.shape[0] <= 5


# --- conversations

def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def least_edits(rows, faults):
    """Cost, edits and lines by whole strings; inserts are tried at every gap, before and after deletes."""
    ok, shown = re.compile(r"(s?(ua)*u?)?").fullmatch, {"": "", "s": "s", "u": "u", "a": "ua"}
    put = lambda d, initials, v: d.update({initials[-1:]: min(d.get(initials[-1:], v), v)}) if ok(initials) else None

    def inserts(best):
        for _ in range(3):
            new = dict(best)
            for k, (c, e, ls) in best.items():
                for role in ("user", "assistant"):
                    put(new, shown[k] + role[0], (c + 3, e + "I", (*ls, (role, ""))))
            best = new
        return best

    best = inserts({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new: dict = {}
        for k, (c, e, ls) in best.items():
            put(new, shown[k], (c + 4, e + "D", ls))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a"):
                put(new, shown[k] + role[0], (c + late, e + "K", (*ls, (role, text))))
            for to in ("user", "assistant"):
                put(new, shown[k] + to[0], (c + 3 + late, e + "R", (*ls, (to, text))))
        best = inserts(new)
    return min(v for k, v in best.items() if k in ("", "a"))


def every_edit(rows, faults):
    """The same by trying every edit sequence with at most two inserts a gap (few rows only)."""
    found = []
    gaps = list(itertools.product(*[[(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]] * (len(rows) + 1)))
    for choice in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "Ruser", "Rassistant"] for f in faults]):
        for gap in gaps:
            cost, edits, lines = 0, "", []
            for k in range(len(rows) + 1):
                edits += "I" * len(gap[k])
                cost += 3 * len(gap[k])
                lines += [(r, "") for r in gap[k]]
                if k < len(rows):
                    edits += choice[k][0]
                    cost += {"D": 4, "K": 0, "R": 3}[choice[k][0]] + 3 * (faults[k] == "truncated" and choice[k] != "D")
                    if choice[k] != "D":
                        lines.append((choice[k][1:] or rows[k][1], rows[k][2]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
                found.append((cost, edits, tuple(lines)))
    return min(found)


def wanted(rows):
    left = after_damage(rows)
    faults, turns = faults_of(left), {t for t, _, _ in left if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
    cost, edits, lines = least_edits(left, faults)
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, sha("\n".join(f"{r}:{t}" for r, t in lines).encode())


ROLES = ["user", "assistant", "system", "user", "assistant", "", "Tool", None, "up"]
TEXTS = ["Hi.", "no end", "a.", "", None, "b!", "c?", "x", "y."]


def streamed(rows, faults, entry=0, leave=None):
    edits, lines = [], []

    def take(e, roles, row):
        edits.append(e)
        names = iter(roles)
        lines.extend((next(names), "") if x == "I" else row if x == "K" else (next(names), row[1]) for x in e if x != "D")

    run = turn_repair.Repair(entry, take)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        turn_repair._add(run, (role, text), role, 1, fault)
    return run.finish(leave), "".join(edits), tuple(lines)


def test_repair_is_least_and_folds_over_ranges():
    rnd = random.Random(1)
    for trial in range(600):
        rows = after_damage([(trial, rnd.choice([None, *range(8)]), rnd.choice(ROLES), rnd.choice([*TEXTS, f"{rnd.random()}."])) for _ in range(rnd.randrange(14))])
        faults = faults_of(rows)
        want = least_edits(rows, faults)
        assert streamed(rows, faults) == want
        if len(rows) <= 2:
            assert every_edit(rows, faults) == want
        at = [0, *sorted(rnd.sample(range(len(rows) + 1), min(len(rows) + 1, 3))), len(rows)]
        pieces = [(a, b) for a, b in itertools.pairwise(at) if a < b]
        tables = []
        for a, b in pieces:
            runs = [turn_repair.Repair(s) for s in range(4)]
            for (_, role, _), fault in zip(rows[a:b], faults[a:b], strict=True):
                for r in runs:
                    turn_repair._add(r, (), role, 1, fault)
            tables.append({s: r.border() for s, r in enumerate(runs)})
        parts = [streamed(rows[a:b], faults[a:b], *way) for (a, b), way in zip(pieces, turn_repair.fold(tables), strict=True)] if pieces else []
        assert (sum(p[0] for p in parts), "".join(p[1] for p in parts)) == want[:2]


def test_repair_holds_few_rows():
    run, most = turn_repair.Repair(), 0
    rnd = random.Random(2)
    for _ in range(5_000):
        role = rnd.choice(ROLES) or ""
        turn_repair._add(run, (role, "t."), role, 1, rnd.choice([None, None, "truncated", "blank"]))
        most = max(most, max(len(run.unresolved(n)) for _, n in run.best.values()))
    assert most < 200


def random_conversations(spark, n=3_000):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, *range(400)]), rnd.choice(ROLES), rnd.choice([*TEXTS, f"{rnd.random()}.", f"{rnd.random()}"])) for _ in range(n)]
    rows += [(9, 0, "user", None), (8, None, None, None), (7, 0, "user", "word " * 100_000), (6, 8, "user", "x.")] + [(5, 1, "assistant", "same.")] * 500
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("piece_rows", [20_000, 50])
def test_conversations_against_brute_force(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(turn_repair, "PART_CHARS", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, df = random_conversations(spark)
        groups = defaultdict(list)
        for r in rows:
            groups[r[0]].append(r)
        got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair_turns(turn_repair.damaged(df), piece_rows).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {c: wanted(rs) for c, rs in groups.items() if after_damage(rs)}


def test_conversation_query_and_sql(spark, tmp_path):
    rows, df = random_conversations(spark, 300)
    df.selectExpr("*", "1 AS cost", "'x' AS fault").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert got == {c: wanted(rs) for c, rs in groups.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert {r[0]: r[1:] for r in con.execute(turn_repair.ORACLE["op12_turn_repair"]).fetchall()} == got
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert turn_repair.op12_turn_repair(spark, f"{tmp_path}/none").count() == 0


# --- manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(leaves):
    """Root and, per leaf, the (left, right) siblings level by level."""
    nodes, steps = [(h, [k]) for k, h in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for k, (_, under) in enumerate(run):
                for i in under:
                    steps[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1:])))
            above.append((digest(*[h for h, _ in run]), [i for _, under in run for i in under]))
        nodes = above
    return nodes[0][0], steps


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, tops = tree([subs[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (_, _, leaf, r), own in zip(sorted(by[s], key=lambda x: x[:3]), subs[s][1], strict=True):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of(*r[:4], text)
            for left, right in own + top:
                folded = digest(left, folded, right)
            out.append((r[0], leaf, subs[s][0], root, digest(*[a + b for a, b in own + top]), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_brute_force(spark, monkeypatch, tmp_path, levels):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(-50, 400)]), rnd.choice(["a", "a", "a", "b", "ü", "", None, *[f"s{i}" for i in range(13)]]), rnd.choice(["en", None]),
             rnd.choice([None, 5]), rnd.choice([None, "", "x\ny", "ü\n" * 3, "plain"])) for _ in range(400)]
    rows += rows[:20] + [(1_000, "long", "en", 1, "word\n" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    df.repartition(5).selectExpr("*", "1 AS idx", "'x' AS leaf", "'y' AS digest").write.parquet(f"{tmp_path}/documents.parquet")
    real = manifest.rounds
    monkeypatch.setattr(manifest, "rounds", lambda nodes, group, _=None: real(nodes, group, levels))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, manifest.op13_manifest(spark, str(tmp_path)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_manifest(rows)


def test_manifest_small(spark, tmp_path):
    for name, rows in {"none": [], "one": [(7, None, None, None, None)]}.items():
        spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = [tuple(r) for r in manifest.op13_manifest(spark, f"{tmp_path}/{name}").collect()]
        assert got == (brute_manifest(rows) if rows else [])


def test_block_witnesses_grow_with_appends():
    block = manifest.Block()
    for k in range(7):
        block.append(str(k))
    assert [len(w) for w in block.witness] == [1] * 6 + [0]  # six leaves wait for the level above
    root = block.close(None)
    assert (root, block.witness) == tree([str(k) for k in range(7)])


def test_manifest_witness_is_public(spark):
    rows = [(k, "abc"[k % 3], digest(str(k))) for k in range(100)]
    made = manifest.manifest(spark.createDataFrame(rows, "doc_id bigint, source string, digest string"), "source", ["doc_id"], levels=2)
    assert made.filter(manifest.folded(F.col("digest"), F.col("witness")) != F.col("root")).count() == 0
    assert made.filter(F.col("idx") >= F.col("n")).count() == 0 and made.count() == 100
