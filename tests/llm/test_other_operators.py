"""Chat formatting, the quality classifier, vector search, the pipeline, and the registry."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relq.llm import chat, gam, hnsw, packing
from relq.llm.queries import oracle_sql, queries

from .test_text_operators import DOCS, ODD, documents

# chat


def fold_by_hand(events):
    """Events (conv, seq, msg, kind, role, text) in order -> [(conv, [(role, text)])]."""
    held: dict = {}
    for conv, seq, msg, kind, role, text in sorted(events, key=lambda e: (e[1], e[3] != "open")):
        m = held.setdefault((conv, msg), {"seq": seq, "text": "", "role": None, "gone": False})
        m["role"] = m["role"] or role
        if kind == "delta":
            m["text"] += text or ""
        else:
            m["text"], m["gone"] = text or "", kind == "remove"
    out: dict = {}
    for (conv, msg), m in sorted(held.items(), key=lambda x: (x[1]["seq"], x[0][1])):
        if not m["gone"]:
            out.setdefault(conv, []).append((m["role"] or "", m["text"]))
    return out


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant<|im_sep|>x", "<~|im_end|>", "<~~s>[~INST]", "a\\b $1 <", "", "😀é\n\n", "<<SYS>> <</SYS>> <s></s>", "[~/INST]~[INST"]


def test_folded_logs_read_back(spark):
    rng = np.random.default_rng(1)
    events = []
    for conv in range(12):
        seq = 0
        for msg in range(int(rng.integers(1, 6))):
            events.append((conv, seq := seq + 1, msg, "open", "assistant" if msg % 2 else "user", ""))
            for _ in range(int(rng.integers(0, 6))):
                kind = str(rng.choice(["delta", "delta", "delta", "edit", "regenerate", "remove"], p=[0.3, 0.3, 0.2, 0.1, 0.06, 0.04]))
                text = None if kind == "remove" else "" if kind == "regenerate" else str(rng.choice(NASTY))
                events.append((conv, seq := seq + 1, msg, kind, None, text))
    df = spark.createDataFrame(events, "conv_id long, seq long, msg long, kind string, role string, text string")
    made = chat.render(chat.fold(df.repartition(5)))
    rows = made.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = fold_by_hand(events)
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rows} == want
    for r in rows:
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(want[r.conv_id]) and "[INST]" not in r.formatted and "</s>" not in r.formatted


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 1, "assistant", "x"), (2, None, "assistant", "\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    made = chat.render(chat.fold(chat.conversation_events(df))).select("conv_id", chat.parse(F.col("formatted")).alias("turns"))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in made.collect()}
    assert got == {1: [("", ""), ("user", "b"), ("user", "b")], None: [("assistant", "x")], 2: [("assistant", "\n")]}
    assert chat.render(chat.fold(chat.conversation_events(df.limit(0)))).count() == 0


def test_the_probe_conversation(spark, sf):
    row = queries()["op8_chat_formatting"](spark, sf).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# quality


def test_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert {0, 1} in [{i, j} for i, j, _ in model.pairs]


def test_quality_of_held_out_rows(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries()["op6_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 10 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) >= 0.85


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [*ODD, None]).withColumn("f", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in gam.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, i % 2, 0) for i in range(14)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = gam.classify(docs, one).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert gam.classify(spark.createDataFrame([], DOCS), one).count() == 0


# vectors


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    v = (centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    v[100:700] = v[100]  # a fifth of all rows are one vector
    v[5:9] *= 4
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(9000, None, 0), (9001, [0.0] * 24, 0), (9002, [float("nan")] + [1.0] * 23, 0), (9003, [None] + [1.0] * 23, 0), (9004, [1.0, 2.0], 0), (None, v[0].tolist(), 0), (17, v[17].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    own = hnsw.usable(df)
    got = hnsw.nearest(hnsw.index(own, shard_rows=700), own.where("vec_id % 20 = 0"), 20, block_rows=40).collect()
    d = v.astype(np.float64)
    by: dict = {}
    for r in got:
        assert r.score == pytest.approx(d[r.query_id] @ d[r.vec_id], abs=1e-9) and r.vec_id != r.query_id
        by.setdefault(r.query_id, {})[r["rank"]] = r
    assert set(by) == set(range(0, 3000, 20))
    hit = 0
    for q, own in by.items():
        assert sorted(own) == list(range(1, 21))
        listed = [(-own[k].score, own[k].vec_id) for k in range(1, 21)]
        assert listed == sorted(listed)
        score = d @ d[q]
        score[q] = -np.inf
        hit += np.sum(score[[x for _, x in listed]] >= np.sort(score)[-20] - 1e-9)
    assert hit / (20 * len(by)) >= 0.95


def test_vectors_of_other_lengths_have_their_own_neighbours(spark):
    rng = np.random.default_rng(14)
    rows = [(i, rng.normal(size=3 if i % 5 == 0 else 8).tolist()) for i in range(200)]
    own = hnsw.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = hnsw.nearest(hnsw.index(own, shard_rows=50), own.where("vec_id % 20 = 0 or vec_id = 7"), 5).collect()
    vectors = dict(rows)
    for q in {r.query_id for r in got} | {0, 7}:
        best = sorted((-float(np.dot(vectors[q], v)), i) for i, v in rows if i != q and len(v) == len(vectors[q]))[:5]
        found = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in found] == [i for _, i in best]


def test_graph_of_many_cells_finds_the_nearest():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(3 * hnsw.CELL, 16)) + 3 * rng.normal(size=(40, 16))[rng.integers(0, 40, 3 * hnsw.CELL)]
    g = hnsw.build(np.arange(len(x)), x)
    q = x[::100]
    found, score = hnsw.search(g, q), q @ g["vectors"].T
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(set(f[:20].tolist()) & set(b.tolist())) / 20 for f, b in zip(found, best)]) >= 0.95


def test_few_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(3)], "vec_id long, embedding array<float>, label int")
    own = hnsw.usable(df)
    rows = hnsw.nearest(hnsw.index(own), own, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in rows] == [(0, 1), (0, 2), (1, 2), (1, 0), (2, 1), (2, 0)] or [(r.query_id, r.vec_id) for r in rows][2:] == [(1, 2), (1, 0), (2, 1), (2, 0)]
    none = hnsw.usable(df.limit(0))
    assert hnsw.nearest(hnsw.index(none), none).count() == 0


# the pipeline and the registry


def test_pipeline_stages(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = "an unusual sentence with a token=deadbeefdeadbeef0123 that only this one says in full"
    more = documents(spark, [text, text, None, ""], [900001, 900002, 900003, 900004], ["src1"] * 4)
    docs = docs.unionByName(more.select(*docs.columns))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        ids = [r.doc_id for r in docs.collect()]
        if name == "toxicity":
            calm = [i for i, t in labels.items() if not t]
            assert len(set(calm) & set(ids)) >= 0.95 * len(calm) and {900001, 900003} <= set(ids)
        if name == "near_dedup":
            assert len(set(ids)) == len(ids) and 900001 in ids and 900002 not in ids
        if name == "secrets":
            assert "<SECRET>" in docs.where("doc_id = 900001").first().text and sizes[-1] == sizes[-2]
        if name == "mixing":
            assert max(ids.count(i) for i in set(ids)) <= 2
    assert docs.columns == [c.split()[0] for c in packing.PIECES.split(", ")][:-1] + ["sequence_id", "offset"]


def test_registry():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_duckdb(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda r: [f"{x:.6f}" if isinstance(x, float) else x for x in r]
    assert sorted(plain(r) for r in df.select(*want.columns).collect()) == sorted(plain(r) for r in want.fetchall())
